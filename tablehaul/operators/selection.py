"""Which tables to move, and whether that choice is closed under foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import check_identifier
from ..model import ForeignKey, Table


class TableFilter:
    """Include or exclude, never both; names are trimmed and compared without case."""

    def __init__(self, include: list[str] | None = None, exclude: list[str] | None = None):
        clean = lambda names: list(dict.fromkeys(n.strip().lower() for n in names or () if n.strip()))
        self.include, self.exclude = clean(include), clean(exclude)
        if self.include and self.exclude:
            raise ValueError("give tables to include or to exclude, not both")

    @property
    def active(self) -> bool:
        return bool(self.include or self.exclude)

    def selects(self, table: str) -> bool:
        low = table.lower()
        return low in self.include if self.include else low not in self.exclude

    def apply(self, tables: list[str]) -> list[str]:
        """The chosen tables in the source's order. Unknown names and an empty choice are errors."""
        known = {t.lower() for t in tables}
        if unknown := sorted(set(self.include + self.exclude) - known):
            raise ValueError(f"unknown tables: {', '.join(unknown)}")
        chosen = [t for t in tables if self.selects(t)]
        if not chosen:
            raise ValueError("the filter leaves no table")
        return chosen

    def frame(self, catalog: DataFrame, name: str = "table_name") -> DataFrame:
        """The same choice over a catalog frame."""
        low = F.lower(name)
        return catalog.filter(low.isin(self.include) if self.include else ~low.isin(self.exclude)) if self.active else catalog


def check_selected(tables: list[Table], engine: str = "InnoDB") -> None:
    """Every chosen table has a bounded name and the engine that gives consistent snapshots."""
    for t in tables:
        check_identifier(t.name)
    if bad := sorted(t.name for t in tables if t.engine.lower() != engine.lower()):
        raise ValueError(f"tables without consistent snapshots (engine other than {engine}): {', '.join(bad)}")


def closure_violations(fks: DataFrame, selected: DataFrame, source: DataFrame) -> DataFrame:
    """Distinct (child, fk, parent): a chosen child, a parent that the source has but the choice leaves out."""
    pick = lambda df, c: df.select(F.lower("table_name").alias(c)).distinct()
    low = fks.select(F.lower("child").alias("child"), "fk", F.lower("parent").alias("parent")).distinct()
    return low.join(pick(selected, "child"), "child", "left_semi").join(pick(source, "parent"), "parent", "left_semi").join(pick(selected, "parent"), "parent", "left_anti").select("child", "fk", "parent")


def scope_violations(fks: list[tuple[ForeignKey, str]], selected: list[str], schema: str) -> list[str]:
    """Foreign keys of chosen tables into another database. Each comes with its parent's schema."""
    low = {s.lower() for s in selected}
    return sorted(f"{fk.table}.{fk.name} -> {at}.{fk.parent}" for fk, at in fks if fk.table.lower() in low and at.lower() != schema.lower())
