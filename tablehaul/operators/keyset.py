"""Keyset batches: rows in key order after a cursor.

One batch is a filter the scan can take part in; a whole table is never walked batch by batch on the driver. Bulk
copies split the key's range once (``key_ranges``) and read all ranges in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quote_source


def predicate(keys: Sequence[str], cursor: Sequence) -> Column:
    """``(a > x) or (a = x and b > y) ...``: this form reaches the scan whole; a comparison of structs doesn't."""
    if not keys or len(keys) != len(cursor):
        raise ValueError(f"the cursor has {len(cursor)} parts, the key {len(keys)}")
    steps = []
    for i, k in enumerate(keys):
        same = [F.col(f"`{p}`") == F.lit(v) for p, v in zip(keys[:i], cursor[:i], strict=True)]
        steps.append(reduce(lambda a, b: a & b, [*same, F.col(f"`{k}`") > F.lit(cursor[i])]))
    return reduce(lambda a, b: a | b, steps)


def predicate_sql(keys: Sequence[str]) -> str:
    """The same for a source that takes SQL text, with ``?`` for each value."""
    steps = [" AND ".join([*(f"{quote_source(p)} = ?" for p in keys[:i]), f"{quote_source(k)} > ?"]) for i, k in enumerate(keys)]
    return " OR ".join(f"({s})" for s in steps)


def batch_sql(table: str, columns: Sequence[str], keys: Sequence[str], cursor: Sequence | None = None, offset: int = 0, size: int = 5000) -> tuple[str, list]:
    """Text and arguments of one batch's query. The offset serves old checkpoints that hold no cursor."""
    if not table or not columns or size <= 0:
        raise ValueError("a batch needs a table, columns and a positive size")
    if not keys:
        raise ValueError(f"{table} has no primary key: it can't be read in batches")
    if cursor is not None and len(cursor) != len(keys):
        raise ValueError(f"the cursor has {len(cursor)} parts, the key {len(keys)}")
    order = ", ".join(map(quote_source, keys))
    sql, args = f"SELECT {', '.join(map(quote_source, columns))} FROM {quote_source(table)}", []
    if cursor is not None:
        sql += f" WHERE {predicate_sql(keys)}"
        args = [v for i in range(len(keys)) for v in cursor[: i + 1]]
    sql += f" ORDER BY {order} LIMIT {int(size)}"
    return sql + (f" OFFSET {int(offset)}" if offset and cursor is None else ""), args


def stream_sql(table: str, columns: Sequence[str]) -> str:
    if not table or not columns:
        raise ValueError("a scan needs a table and columns")
    return f"SELECT {', '.join(map(quote_source, columns))} FROM {quote_source(table)}"


def batch(df: DataFrame, keys: Sequence[str], size: int, cursor: Sequence | None = None, offset: int = 0) -> DataFrame:
    """The next ``size`` rows in key order. The limit is the operator itself."""
    if not keys or size <= 0:
        raise ValueError("a batch needs a key and a positive size")
    if cursor is not None:
        df = df.filter(predicate(keys, cursor))
    rows = df.orderBy(*(f"`{k}`" for k in keys))
    return (rows.offset(offset) if offset and cursor is None else rows).limit(size)


def last_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: the largest key, by an aggregate and no sort. Names match without case; a missing one is an error."""
    have = {c.lower(): c for c in df.columns}
    if missing := [k for k in keys if k.lower() not in have]:
        raise ValueError(f"key columns not in the batch: {', '.join(missing)}")
    return df.agg(F.max(F.struct(*(F.col(f"`{have[k.lower()]}`") for k in keys))).alias("k")).select("k.*")


def assign_batches(df: DataFrame, keys: Sequence[str], size: int, buckets: int = 64) -> DataFrame:
    """``df`` with ``batch_no`` as one ordered walk would number it.

    Ranks come from ranges of the key: a range-partitioned sort, a count for each range, and ranks inside a range. No
    task sorts the whole table, as a window without partitions would.
    """
    parts = df.repartitionByRange(buckets, *(F.col(f"`{k}`") for k in keys)).withColumn("__part", F.spark_partition_id())
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))  # one row a range
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*(F.col(f"`{k}`") for k in keys)))
    return parts.withColumn("__rank", rank).join(F.broadcast(before), "__part").withColumn("batch_no", F.floor((F.col("__rank") + F.col("__before") - 1) / F.lit(size))).drop("__part", "__rank", "__before")


def key_ranges(df: DataFrame, key: str, parts: int) -> list[tuple[object, object]]:
    """At most ``parts`` half-open ranges (low, high] over the first key column, from approximate quantiles.

    The outer ends are open and null keys belong to the first range, so the ranges cover every row whatever the quantiles'
    error. ``parts`` bounds what the driver holds.
    """
    if parts <= 1:
        return [(None, None)]
    row = df.agg(F.percentile_approx(f"`{key}`", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()
    cuts = sorted(set(row.q or []))
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def range_predicate(key: str, low, high) -> Column:
    c = F.col(f"`{key}`")
    if low is None:
        return F.lit(True) if high is None else c.isNull() | (c <= F.lit(high))
    return c > F.lit(low) if high is None else (c > F.lit(low)) & (c <= F.lit(high))
