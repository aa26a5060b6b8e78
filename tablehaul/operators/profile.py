"""Many conditions over a table in one pass.

``Profiler`` gathers named aggregates for a table and runs them as a single ungrouped aggregate: one scan that reads
only the columns asked about, partial sums on every task, one row to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V

TEXT = (T.StringType, T.VarcharType, T.CharType)


class Profiler:
    def __init__(self, df: DataFrame):
        self.df, self.exprs = df, {}

    def count_if(self, name: str, condition: Column) -> Profiler:
        self.exprs[name] = F.count_if(condition)
        return self

    def add(self, name: str, aggregate: Column) -> Profiler:
        self.exprs[name] = aggregate
        return self

    def each(self, prefix: str, columns: list[str], condition: Callable[[Column], Column]) -> Profiler:
        for c in columns:
            self.count_if(f"{prefix}:{c}", condition(F.col(f"`{c}`")))
        return self

    def frame(self) -> DataFrame:
        """One row, a column for each expression."""
        return self.df.agg(*(e.alias(n) for n, e in self.exprs.items()))

    def long(self) -> DataFrame:
        """Rows (check, column, n) for expressions named ``check:column``."""
        rows = F.array(*(F.struct(F.lit(n.partition(":")[0]).alias("check"), F.lit(n.partition(":")[2]).alias("column"), F.col(f"`{n}`").cast("bigint").alias("n")) for n in self.exprs))
        return self.frame().select(F.explode(rows).alias("r")).select("r.*")

    def run(self) -> dict[str, int]:
        return self.frame().first().asDict() if self.exprs else {}


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TEXT)]


def standard(df: DataFrame, dates=(), times=(), enums=(), uuids=(), unsigned=()) -> Profiler:
    """The planner's four checks and both type decisions, fused: one scan instead of six."""
    p = Profiler(df).add("rows:", F.count("*"))
    p.each("zero_date", list(dates), V.is_zero_date)
    p.each("nul", [c for c in text_columns(df) if c not in dates and c not in times], V.has_nul)
    p.each("time_range", list(times), V.time_out_of_day)
    p.each("enum_marker", list(enums), lambda c: c == "")
    for c in uuids:
        p.count_if(f"uuid:{c}", V.uuid_invalid(F.col(f"`{c}`"), isinstance(df.schema[c].dataType, T.BinaryType)))
    for c in unsigned:
        p.add(f"max:{c}", F.max(F.col(f"`{c}`").cast("decimal(20,0)")))
    return p


def column_profile(df: DataFrame) -> DataFrame:
    """Rows (column, n_rows, n_null, n_blank, min_value, max_value), all from one aggregate."""
    exprs = [F.count("*").alias("n_rows")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        blank = F.trim(c) == "" if isinstance(f.dataType, TEXT) else F.lit(False)
        exprs += [F.count_if(c.isNull()).alias(f"n{i}"), F.count_if(blank).alias(f"b{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
    rows = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.col("n_rows"), F.col(f"n{i}").alias("n_null"), F.col(f"b{i}").alias("n_blank"), F.col(f"l{i}").alias("min_value"), F.col(f"h{i}").alias("max_value")) for i, f in enumerate(df.schema)))
    return df.agg(*exprs).select(F.explode(rows).alias("r")).select("r.*")


def estimated_rows(df: DataFrame) -> int | None:
    """The optimiser's row count, if statistics give one: what is shown where an exact count fails."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(stats.rowCount().get().toString()) if stats.rowCount().isDefined() else None


def count_or_estimate(df: DataFrame) -> tuple[int | None, bool]:
    """(rows, exact)."""
    try:
        return df.count(), True
    except Exception:  # a source that refuses the scan still has statistics
        return estimated_rows(df), False
