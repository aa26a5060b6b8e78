"""A table in micro-batches: Structured Streaming gives order, back-pressure and commit-then-checkpoint.

Each batch lands in a folder named by its number. A batch that Spark replays after a crash overwrites its own folder,
so rows count once without looking at the target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.load import load_batch, upsert


def copy_stream(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, on_batch: Callable[[int, int], None] | None = None, fail_after: int | None = None):
    """Drains what is there and stops. ``fail_after`` breaks off after that many batches' writes, before their commit (for tests)."""
    seen = []

    def write(df: DataFrame, batch_id: int) -> None:
        n = load_batch(df.sparkSession, transform(df), target, batch_id)
        seen.append(n)
        if on_batch:
            on_batch(batch_id, n)
        if fail_after is not None and len(seen) > fail_after:
            raise RuntimeError("stopped on request")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return seen


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(stream: DataFrame, base: str, key: list[str], checkpoint: str) -> None:
    """Keyed merge of each batch over a table of versions ``base/v=<n>``; the newest complete version is the table."""

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates(key)
        if batch_id:
            new = upsert(spark.read.parquet(f"{base}/v={batch_id - 1}"), new, key)
        new.write.mode("overwrite").parquet(f"{base}/v={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
