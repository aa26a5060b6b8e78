"""Sinks: append, upsert by anti join and union, and a keyless load that publishes once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.names import quote

BIND_LIMIT = 65_535
MAX_ROWS = 1000


def chunk_rows(n_columns: int) -> int:
    """Rows that one multi-row INSERT may hold: the bind limit over the columns, at most 1000."""
    return 0 if n_columns <= 0 else min(MAX_ROWS, max(1, BIND_LIMIT // n_columns))


def dedupe_batch(batch: DataFrame, key: Sequence[str], latest: str | None = None) -> DataFrame:
    """One row for each key: the one with the largest ``latest``, or any. Two in one upsert are an error elsewhere."""
    if latest is None:
        return batch.dropDuplicates(list(key))
    w = Window.partitionBy(*key).orderBy(F.desc(latest))
    return batch.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert(target: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """``target`` with ``batch`` merged over it: rows of the batch win. Both are joined on the key alone."""
    if missing := [k for k in key if k not in batch.columns]:
        raise ValueError(f"conflict columns not in the batch: {', '.join(missing)}")
    kept = target.join(batch.select(*key), list(key), "left_anti").select(*target.columns)
    return kept.unionByName(batch.select(*target.columns))


def insert_sql(schema: str, table: str, columns: Sequence[str], conflict: Sequence[str], n_rows: int) -> str:
    """A multi-row INSERT with numbered places; with a key it updates what it meets."""
    if not columns or n_rows <= 0:
        raise ValueError("an insert needs columns and rows")
    if missing := [c for c in conflict if c not in columns]:
        raise ValueError(f"conflict columns not in the insert: {', '.join(missing)}")
    n = len(columns)
    rows = ", ".join("(" + ", ".join(f"${r * n + i + 1}" for i in range(n)) + ")" for r in range(n_rows))
    sql = f"INSERT INTO {quote(schema)}.{quote(table)} ({', '.join(map(quote, columns))}) VALUES {rows}"
    if not conflict:
        return sql
    sets = [c for c in columns if c not in conflict] or [conflict[0]]
    return f"{sql} ON CONFLICT ({', '.join(map(quote, conflict))}) DO UPDATE SET " + ", ".join(f"{quote(c)} = EXCLUDED.{quote(c)}" for c in sets)


def append_checked(df: DataFrame, path: str, expected: int | None = None, mode: str = "append") -> int:
    """Writes Parquet and returns the rows written, counted in the same pass; a count other than ``expected`` is an error."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    n = seen.get["n"]
    if expected is not None and n != expected:
        raise RuntimeError(f"{n} rows written to {path}, {expected} expected")
    return n


def shared_dir(spark) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the session's checkpoint folder names it.

    Without either, a session on one machine uses a folder of its own there; on a cluster that is an error.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not (own := getattr(spark.sparkContext, "_tablehaul_dir", None)):
        import tempfile

        own = spark.sparkContext._tablehaul_dir = f"file://{tempfile.mkdtemp(prefix='tablehaul-')}"
    return own


def clear(spark, base: str) -> None:
    """Removes what ``load_batch`` wrote to a folder; other files stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for f in fs.listStatus(path) if fs.exists(path) else []:
        if f.getPath().getName().startswith(("batch-", "_batch-")):
            fs.delete(f.getPath(), True)


def load_batch(spark, batch: DataFrame, base: str, batch_id: int) -> int:
    """A batch's files carry its number in their names, so a replay replaces them: each batch counts once.

    Rows are written to a hidden folder and their files moved beside those of other batches. The table is a plain
    folder of files with the batch's own columns, whatever they are called: no partition column is added.
    """
    path, held, mark = spark._jvm.org.apache.hadoop.fs.Path, f"{base}/_batch-{batch_id}", f"batch-{batch_id}-"
    fs = path(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    n = append_checked(batch, held, mode="overwrite")
    for f in fs.listStatus(path(base)):
        if f.getPath().getName().startswith(mark):
            fs.delete(f.getPath(), False)
    for f in fs.listStatus(path(held)):
        name = f.getPath().getName()
        if name.startswith("part-") and not fs.rename(f.getPath(), path(f"{base}/{mark}{name}")):
            raise RuntimeError(f"{name} of batch {batch_id} can't be moved to {base}")
    fs.delete(path(held), True)
    return n


def keyless_load(df: DataFrame, path: str) -> int:
    """A table without a key can't be resumed or merged: the target must be empty, and is written in one job."""
    spark = df.sparkSession
    try:
        filled = not spark.read.parquet(path).isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        filled = False
    if filled:
        raise RuntimeError(f"{path} holds rows already; a table without a primary key is loaded into an empty target only")
    return append_checked(df, path, mode="overwrite")


def replay_risk(rows_loaded: int, last_batch: int) -> bool:
    """True while rows may repeat what the crashed run wrote. Size 0 (an old checkpoint): always."""
    return last_batch == 0 or rows_loaded < last_batch


def use_append(method: str, at_risk: bool) -> bool:
    return method == "copy" and not at_risk


def checksum(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and an order-free sum of row hashes: equal for equal contents, made in one pass."""
    cols = columns or df.columns
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in cols))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n_rows"), F.sum(part.cast("decimal(38,0)")).cast("string").alias("digest"))
