"""A streaming source over a keyed Parquet table: its offset is the last key, its partitions are key ranges.

``latestOffset`` is the final key, so ``availableNow`` drains the table in one batch over many partitions and stops.
For folders that Python on the executors can open; remote stores are read by ``spark.readStream.parquet``.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class KeyRange(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


class KeysetReader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.key = schema, options["path"], options["key"]
        self.parts = int(options.get("partitions", "8"))

    def _end(self) -> int:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        top = None
        for b in ds.dataset(self.path).to_batches(columns=[self.key]):
            if b.num_rows and (m := pc.max(b.column(0)).as_py()) is not None:
                top = m if top is None else max(top, m)
        return -(2**63) if top is None else top

    def initialOffset(self) -> dict:
        return {"key": -(2**63)}

    def latestOffset(self) -> dict:
        return {"key": self._end()}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        if end["key"] <= start["key"]:
            return []
        first = min((m for b in ds.dataset(self.path).to_batches(columns=[self.key], filter=pc.field(self.key) > start["key"]) if b.num_rows and (m := pc.min(b.column(0)).as_py()) is not None), default=end["key"])
        step = max(1, -(-(end["key"] - first + 1) // self.parts))
        lows = range(first - 1, end["key"], step)
        return [KeyRange(a, min(a + step, end["key"])) for a in lows]

    def read(self, partition: KeyRange):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        k = pc.field(self.key)
        yield from ds.dataset(self.path).to_batches(columns=[f.name for f in self.schema], filter=(k > partition.low) & (k <= partition.high))

    def commit(self, end: dict) -> None:
        json.dumps(end)  # an offset that Spark's own log can hold is all the state there is


class KeysetSource(DataSource):
    """``spark.readStream.format("keyset").schema(...).option("key", ...).load(path)``; the key is an integer column."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self):
        raise ValueError("give the schema: a stream doesn't guess it")

    def streamReader(self, schema):
        return KeysetReader(schema, self.options)
