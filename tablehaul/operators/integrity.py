"""Keys and foreign keys over the data itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import quote
from ..functions.typemap import Unsupported, family, fk_rule
from ..model import ForeignKey


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows whose whole key is set and has no parent. A key with any null part refers to nothing.

    An anti join on all key columns; the parent side carries its distinct keys only. AQE picks the broadcast from
    the sizes it measures, and splits a hot child key.
    """
    refs = parent.select(*(F.col(f"`{p}`").alias(f"__p{i}") for i, p in enumerate(parent_columns)))
    held = child.filter(reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in columns)))
    on = reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.col(f"__p{i}") for i, c in enumerate(columns)))
    return held.join(refs, on, "left_anti")


def orphan_counts(fks: list[ForeignKey], read) -> DataFrame:
    """Rows (fk, child, parent, n_orphans). ``read(table)`` gives a frame; one plan for all keys."""
    rows = [
        orphans(read(k.table), list(k.columns), read(k.parent), list(k.parent_columns)).agg(F.count("*").alias("n_orphans")).select(F.lit(k.name).alias("fk"), F.lit(k.table).alias("child"), F.lit(k.parent).alias("parent"), "n_orphans")
        for k in fks
    ]
    return reduce(DataFrame.unionByName, rows)


def orphan_sql(k: ForeignKey) -> str:
    """What an operator can run at the source to see the orphans; it compares every key column."""
    on = " AND ".join(f"p.{quote(b)} = c.{quote(a)}" for a, b in zip(k.columns, k.parent_columns, strict=True))
    held = " AND ".join(f"c.{quote(a)} IS NOT NULL" for a in k.columns)
    return f"SELECT c.* FROM {quote(k.table)} c WHERE {held} AND NOT EXISTS (SELECT 1 FROM {quote(k.parent)} p WHERE {on});"


def duplicate_keys(df: DataFrame, key: list[str], nulls_repeat: bool = False) -> DataFrame:
    """Key values that more than one row has, with their count ``n`` (``n_`` if the key has a column n). In a unique index nulls don't repeat."""
    if not nulls_repeat:
        df = df.dropna(subset=key)
    n = "n_" if "n" in {k.lower() for k in key} else "n"
    return df.groupBy(*(f"`{k}`" for k in key)).agg(F.count("*").alias(n)).filter(F.col(n) > 1)


def types_fit(child: list[str], parent: list[str]) -> bool:
    """Text with text, integers with integers, anything else with itself."""
    return len(child) == len(parent) and all(family(a) == family(b) for a, b in zip(child, parent, strict=True))


def fk_sql(k: ForeignKey, schema: str = "public") -> str:
    names = lambda cs: ", ".join(map(quote, cs))
    return (
        f"ALTER TABLE {quote(schema)}.{quote(k.table)} ADD CONSTRAINT {quote(k.name)} FOREIGN KEY ({names(k.columns)}) "
        f"REFERENCES {quote(schema)}.{quote(k.parent)} ({names(k.parent_columns)}) ON DELETE {fk_rule(k.on_delete)} ON UPDATE {fk_rule(k.on_update)};"
    )


def fk_verdict(k: ForeignKey, source: set[str], target: set[str], existing: set[str], types: tuple[list[str], list[str]], n_orphans: int) -> str:
    """manual, error, exists or create: the first step of the ladder that applies."""
    if k.parent.lower() not in source:
        return "manual: the parent is not in the source"
    if k.parent.lower() not in target:
        return "error: the parent is not in the target"
    if k.name in existing:
        return "exists"
    if not types_fit(*types):
        return "error: key types of different families"
    try:
        fk_rule(k.on_delete), fk_rule(k.on_update)
    except Unsupported as e:
        return f"error: {e}"
    return f"manual: {n_orphans} orphan rows" if n_orphans else "create"
