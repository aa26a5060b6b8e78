"""Reading tables, cutting lineage and other things that the operators share."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.load import shared_dir

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHORT = 1 << 18
ARROW_BYTES, ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later reads don't compute it anew, and lost executors lose nothing.

    Shuffle files of the write are freed when it ends, for nothing reads them again.
    """
    return staged_parts([df], name)


def staged_parts(dfs: Iterable[DataFrame], name: str) -> DataFrame:
    """All of ``dfs`` (one at least, of one schema), written one after the other as one table: disk for the shuffles of the
    largest suffices, and plans that read it hold one scan."""
    path = ""
    for df in dfs:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        during = {FREE_SHUFFLES: "true"}
        before = {k: spark.conf.get(k) for k in during}
        for k, v in during.items():
            spark.conf.set(k, v)
        try:
            df.write.mode("append").parquet(path)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def short(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast in a join, if it has few rows; they are counted, so it should be cheap to read."""
    return F.broadcast(df) if df.count() <= SHORT else df


def discard(*stages: DataFrame) -> None:
    """Deletes staged results that nothing will read again: whatever came of them is staged itself."""
    for df in stages:
        if path := getattr(df, "_staged", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str, share: int = 1000, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``table``, which has each key once. Rows of keys that hold more than one in ``share`` of
    all rows stay where they are: there are at most ``share`` such keys, so what they need is broadcast. ``counted``: a
    cheaper table with the same keys."""
    counted = rows if counted is None else counted
    counts = counted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = counted.count()
    hot = [r[0] for r in counts.filter(F.col("__n") * share > total).select(key).collect()]  # fewer than ``share``
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(~is_hot).join(table.filter(~is_hot), key, "left").unionByName(rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key, "left"))


def crc32_mod(c: Column, n: int) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % n


def slices(batches: Iterable, size: int = 8 << 20) -> Iterator:
    """Arrow batches cut so that a slice holds about ``size`` bytes of variable-length data, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def trim() -> None:
    """Gives free memory of this process back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """The driver's Python and JVM let go of what earlier steps left: many plans in one session pile up there."""
    gc.collect()
    trim()
    jvm = spark._jvm
    jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):  # what its compiler has freed; not every JVM has this command
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)


def settle_executors(spark: SparkSession) -> None:
    """The executors' JVMs shrink to what is in use, so that the next step's Python workers find room beside them."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; when its task ends, the worker, which lives on, gives free memory back to the system."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a session, so that their Python finds it wherever it runs."""
    import tempfile
    import zipfile
    from pathlib import Path

    if spark.conf.get(ARROW_BYTES) != ARROW_LIMIT:  # batches of whole texts are bounded by bytes, not by rows alone
        spark.conf.set(ARROW_BYTES, ARROW_LIMIT)
    settle(spark)
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):  # else the driver is the only executor
        settle_executors(spark)
    if getattr(sc, "_tablehaul_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tablehaul-")) / "tablehaul.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._tablehaul_shipped = True
