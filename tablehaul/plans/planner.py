"""The dry run: everything that would go wrong, found by reads alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typemap
from ..functions import values as V
from ..functions.typemap import Unsupported, target_type
from ..model import Finding, Report, Table
from ..operators import groups, integrity
from ..operators.profile import standard
from ..operators.selection import TableFilter
from . import ddl

SCHEMA = "severity string, table_name string, column_name string, kind string, n bigint, message string"


def _base(t: Table, names: set[str]) -> dict[str, list[str]]:
    """Columns by the check they need. A cast column is the user's own business."""
    by = lambda *kinds: [c.name for c in t.columns if not c.cast and c.name in names and ddl.plain_type(c.type) in kinds]
    return {"dates": by("date", "datetime", "timestamp"), "times": by("time"), "enums": by("enum")}


def plan_table(t: Table, df: DataFrame, report: Report, demoted: set[str], read: Callable[[str], DataFrame], known: set[str], orphans: bool = True) -> dict:
    """Adds a table's findings to the report: one profile scan, then one anti join for each foreign key."""
    note = lambda sev, col, kind, n, msg: report.findings.append(Finding(sev, t.name, col, kind, n, msg))
    types = {}
    for c in t.columns:
        try:
            types[c.name] = target_type(c, ddl.enum_name(t.name, c.name), c.name in demoted)
            ddl.column_sql(c, t.name, demoted=c.name in demoted)
        except (Unsupported, ValueError) as e:
            note("issue", c.name, "unsupported", 1, str(e))
    need = _base(t, set(df.columns))
    counts = standard(df, **need).run()
    nullable = {c.name: c.nullable for c in t.columns}
    for name, n in counts.items():
        check, _, col = name.partition(":")
        if not n or check == "rows":
            continue
        if check == "zero_date":
            note("warning" if nullable.get(col) else "issue", col, check, n, "zero dates become null" if nullable.get(col) else "zero dates in a NOT NULL column")
        elif check == "nul":
            note("warning", col, check, n, "NUL bytes are removed")
        elif check == "time_range":
            note("issue", col, check, n, V.INTERVAL_HINT)
        elif check == "enum_marker":
            note("warning", col, check, n, "the empty label is added to the enum")
    if not t.key:
        note("warning", "", "no_key", 1, "no primary key: one pass, not resumable")
    for ix in t.indexes:
        try:
            ddl.index_sql(t, ix)
        except Unsupported as e:
            note("issue", ix.name, "index", 1, str(e))
    for k in t.foreign_keys:
        if k.parent.lower() not in known:
            report.manual += ddl.report_only("fk_source_missing", [k.name], t.name)
        elif orphans and (n := integrity.orphans(df, list(k.columns), read(k.parent), list(k.parent_columns)).count()):
            note("warning", ",".join(k.columns), "orphans", n, integrity.orphan_sql(k))
    report.manual += ddl.report_only("trigger", list(t.triggers), t.name) + ddl.on_update_manual(t) + ddl.generated_manual(t)
    report.tables.append({"table": t.name, "rows": counts["rows:"], "key": list(t.key), "resumable": t.resumable, "types": types})
    return types


def dry_run(tables: list[Table], read: Callable[[str], DataFrame], chosen: TableFilter | None = None, views: list[str] = (), functions: list[str] = ()) -> Report:
    """Reads only. A bad filter raises; everything else becomes a finding, so one run shows all of them."""
    report = Report()
    names = (chosen or TableFilter()).apply([t.name for t in tables])
    picked = [t for t in tables if t.name in names]
    bad, largest = groups.profile_members(picked, read)
    uuids: dict = groups.resolve_uuid(picked, bad)
    try:
        unsigned = groups.resolve_unsigned(picked, largest)
    except ValueError as e:
        unsigned = {}
        report.findings.append(Finding("issue", "", "", "unsigned", 1, str(e)))
    known = {t.name.lower() for t in tables}
    if chosen and chosen.active:
        low = {n.lower() for n in names}
        for t in picked:
            for k in t.foreign_keys:
                if k.parent.lower() in known - low:
                    report.findings.append(Finding("issue", t.name, ",".join(k.columns), "closure", 1, f"{k.parent} is not chosen"))
    for t in picked:
        t2, demoted = groups.apply_decisions(t, uuids, unsigned)
        plan_table(t2, read(t.name), report, demoted, read, known)
    report.manual += ddl.report_only("view", list(views)) + ddl.report_only("function", list(functions))
    return report


def frame(spark: SparkSession, report: Report) -> DataFrame:
    """Findings and manual items as rows; their number is the schema's, not the data's."""
    rows = [(f.severity, f.table, f.column, f.kind, f.n, f.message) for f in report.findings]
    rows += [("manual", m.table, m.name, m.kind, 1, m.reason) for m in report.manual]
    return spark.createDataFrame(rows, SCHEMA)


def render(report: Report) -> str:
    out = []
    for t in report.tables:
        out.append(f"{t['table']}: {t['rows']:,} rows, key {', '.join(t['key']) or 'none'}{'' if t['resumable'] else ' (one pass)'}")
        out += [f"  {c}: {ty}" for c, ty in t["types"].items()]
    out += [f"{f.severity}: {f.table}{'.' * bool(f.column)}{f.column}: {f.kind} ({f.n:,}): {f.message}" for f in report.findings]
    out += [f"manual: {m.kind} {m.table} {m.name}: {m.reason}" for m in report.manual]
    out.append(f"{report.issues} issues, {len(report.manual)} manual items")
    return "\n".join(out)


def profile_rows(df: DataFrame, table: str) -> DataFrame:
    """Text columns' NUL counts and all rows, long form, for a report over many tables."""
    return standard(df).long().select(F.lit(table).alias("table_name"), "check", "column", "n")


__all__ = ["dry_run", "frame", "plan_table", "profile_rows", "render", "typemap"]
