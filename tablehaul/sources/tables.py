"""Parquet folders as a source: ``<dir>/<table>.parquet``, with keys declared beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Column, ForeignKey, Table

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "documents": ("doc_id",),
    "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"), "embeddings": ("vec_id",),
}
FOREIGN = [
    ForeignKey(f"fk_{t}_{c}", t, (c,), p, (r,))
    for t, c, p, r in (
        ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"),
    )
]
SQL_TYPES = {"bigint": "bigint", "int": "int", "double": "double", "string": "text", "timestamp": "datetime", "timestamp_ntz": "datetime", "boolean": "tinyint(1)", "binary": "blob", "date": "date"}


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{table}.parquet")


class ParquetSource:
    """An immutable folder: every read sees the same rows, so all tables share one snapshot.

    Without ``tables`` it has those it is found to hold. Parquet declares no keys: what ``keys`` leaves out has none.
    """

    def __init__(self, spark: SparkSession, base: str, tables: list[str] | None = None, keys: dict | None = None, foreign: list[ForeignKey] | None = None):
        self.spark, self.base = spark, base
        self.keys = KEYS if keys is None else keys
        self.foreign = FOREIGN if foreign is None else foreign
        self.names = sorted(tables or self.found())

    def read(self, table: str) -> DataFrame:
        return read(self.spark, self.base, table)

    def found(self) -> list[str]:
        """Names of the folder's Parquet files and folders, through Hadoop's file systems."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = (f.getPath().getName() for f in fs.listStatus(path))
        return [n.removesuffix(".parquet") for n in names if n.endswith(".parquet")]

    def list_tables(self) -> list[str]:
        return self.names

    def table(self, name: str) -> Table:
        cols = tuple(Column(f.name, SQL_TYPES.get(f.dataType.simpleString(), "json"), f.nullable) for f in self.read(name).schema)
        return Table(name, cols, tuple(self.keys.get(name, ())), foreign_keys=tuple(k for k in self.foreign if k.table == name))

    def tables(self) -> list[Table]:
        return [self.table(n) for n in self.names]

    def catalog(self) -> DataFrame:
        """Rows (table_name, column_name, ordinal, type, nullable, key_position)."""
        rows = [(t.name, c.name, i, c.type, c.nullable, t.key.index(c.name) + 1 if c.name in t.key else 0) for t in self.tables() for i, c in enumerate(t.columns, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, type string, nullable boolean, key_position int")

    def version(self) -> str:
        """Changes when any file of the folder does."""
        from .snapshot import file_token

        return file_token(self.spark, self.base)


def match_columns(source: list[str], target: list[str]) -> dict[str, str]:
    """source name -> target name, equal but for case. A source column without a counterpart is an error."""
    low = {t.lower(): t for t in target}
    if missing := [s for s in source if s.lower() not in low]:
        raise ValueError(f"columns that the target lacks: {', '.join(missing)}")
    return {s: low[s.lower()] for s in source}
