"""``python -m tablehaul.cli``: session, dry-run, status, version."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .operators.selection import TableFilter
from .plans.planner import dry_run, render
from .plans.runner import Options, Runner
from .plans.state import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablehaul")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("session", "dry-run"):
        s = sub.add_parser(name)
        s.add_argument("source", help="a folder of Parquet tables, or a jdbc: URL")
        s.add_argument("--driver", help="a JDBC driver's class")
        s.add_argument("--schema", help="the schema (MySQL: database) of a jdbc: URL")
        s.add_argument("--include", nargs="*")
        s.add_argument("--exclude", nargs="*")
        s.add_argument("--key", action="append", default=[], help="TABLE=COLUMN,COLUMN: a table's primary key; the fixtures' keys hold if none is given")
        if name == "session":
            s.add_argument("target")
            s.add_argument("--store", default="tablehaul.db")
            s.add_argument("--id", default="default")
            s.add_argument("--workers", type=int, default=4)
            s.add_argument("--batch", type=int, default=5000)
            s.add_argument("--ranges", type=int, default=8)
            s.add_argument("--phase", default="all")
            s.add_argument("--fresh", action="store_true")
            s.add_argument("--cast", action="append", default=[])
            s.add_argument("--manual")
    s = sub.add_parser("status")
    s.add_argument("--store", default="tablehaul.db")
    s.add_argument("--id")
    s.add_argument("--events", type=int, default=15)
    sub.add_parser("version")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "status":
        store = Store(a.store)
        for c in store.checkpoints(a.id):
            print(f"{c.session_id} {c.table_name} {c.status} {c.last_offset}/{c.row_count} {c.error_message}")
        if a.id:
            for e in store.last_events(a.id, a.events):
                print(f"{e['id']} {e['level']} {e['table_name']} {e['message']}")
        return 0
    from pyspark.sql import SparkSession

    from .sources.jdbc import JdbcSource
    from .sources.tables import ParquetSource

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    keys = {t: tuple(cols.split(",")) for t, _, cols in (k.partition("=") for k in a.key)}
    source = JdbcSource(spark, a.source, a.driver, schema=a.schema) if a.source.startswith("jdbc:") else ParquetSource(spark, a.source, keys=keys or None)
    chosen = TableFilter(a.include, a.exclude)
    if a.command == "dry-run":
        report = dry_run(source.tables(), source.read, chosen)
        print(render(report))
        return int(report.issues > 0)
    store = Store(a.store)
    if not store.session(a.id):
        store.create_session(a.id)
    run = Runner(spark, source, a.target, store, a.id, Options(batch=a.batch, ranges=a.ranges, workers=a.workers, phase=a.phase, fresh=a.fresh, chosen=chosen, casts=a.cast, manual_path=a.manual, sink=lambda e: print(e["level"], e["table"], e["message"])))
    print(run.start()["rows"], "rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
