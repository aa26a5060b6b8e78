"""The run: gates, type decisions, tables side by side, checkpoints, integrity, manual work."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.casts import CastRules, parse_rules
from ..functions.cursor import decode, encode
from ..functions.formats import duration, progress
from ..functions.typemap import spark_type, target_type
from ..model import Manual, Table
from ..operators import groups, integrity, load
from ..operators.keyset import key_ranges, range_predicate
from ..operators.selection import TableFilter, check_selected
from . import ddl
from .state import Checkpoint, Store


@dataclass
class Options:
    batch: int = 5000
    ranges: int = 8
    workers: int = 4
    method: str = "copy"
    phase: str = "all"
    fresh: bool = False
    chosen: TableFilter = field(default_factory=TableFilter)
    casts: CastRules | list[str] = field(default_factory=list)
    sink: Callable[[dict], None] | None = None
    manual_path: str | None = None

    def __post_init__(self):
        if self.batch <= 0 or self.ranges <= 0:
            raise ValueError("the batch size and the number of ranges are positive")
        if not 1 <= self.workers <= 16:
            raise ValueError("1 to 16 workers")
        if self.method not in {"copy", "insert"}:
            raise ValueError("load method: copy or insert")
        if self.phase not in {"all", "schema-only", "data-only"}:
            raise ValueError("phase: all, schema-only or data-only")
        if isinstance(self.casts, list):
            self.casts = parse_rules(self.casts)


#: Types of a key's first column by which a table is cut into ranges; their values have a cursor form.
CUT = {"tinyint", "smallint", "int", "bigint", "float", "double", "timestamp"}


class Interrupted(RuntimeError):
    """The run was stopped; the table can be resumed."""


def cursor(values: list) -> str:
    """Empty where a value has no cursor form: there is nothing to resume from."""
    try:
        return encode(values)
    except (TypeError, ValueError):
        return ""


class Runner:
    """Moves tables of ``source`` (``read``, ``tables``, ``version``) into folders under ``target``.

    A table is loaded by ranges of its key's first column, ``batch`` rows or more each and ``ranges`` at most, for a source
    that isn't ordered by that key is read once a range. A range is one Spark job that all executors share, and its end is
    saved when its rows are in ``target/<table>``; ``workers`` is how many tables' jobs are in flight. A run that broke off
    goes on after the last end. A range's files are named by the rows before it, so a replay replaces them and never
    doubles. Keys that are text, decimals or dates make one range. A table without a key is one range too, and is only
    loaded into an empty target, unless this session's own load broke off there. The first failure cancels the other
    tables' jobs; they can be resumed.
    """

    def __init__(self, spark: SparkSession, source, target: str, store: Store, session: str, options: Options | None = None):
        self.spark, self.source, self.target, self.store, self.session = spark, source, target, store, session
        self.options, self.manual = options or Options(), []
        self.stop, self.lock, self.warned, self.rows = threading.Event(), threading.Lock(), set(), 0
        self.violations: dict[str, list] = {}
        self.tag = f"tablehaul-{uuid.uuid4().hex}"

    def emit(self, level: str, message: str, table: str = "", done: int = 0, total: int = 0) -> None:
        """Events are stored before anyone hears of them."""
        with self.lock:
            eid = self.store.append_event(self.session, level, message, table, done, total)
            if self.options.sink:
                self.options.sink({"id": eid, "level": level, "message": message, "table": table, "processed": done, "total": total})

    def warn_once(self, kind: str, table: str, column: str, message: str) -> bool:
        with self.lock:
            if new := (kind, table, column) not in self.warned:
                self.warned.add((kind, table, column))
        if new:
            self.emit("warn", message, table)
        return new

    def plan(self) -> list[tuple[Table, set[str]]]:
        tables = self.source.tables()
        names = self.options.chosen.apply([t.name for t in tables])
        picked = [t for t in tables if t.name in names]
        check_selected(picked)
        known, low = {t.name.lower() for t in tables}, {n.lower() for n in names}
        if self.options.chosen.active and (open_ := sorted(f"{t.name} -> {k.parent}" for t in picked for k in t.foreign_keys if k.parent.lower() in known - low)):
            raise ValueError(f"chosen tables refer to tables that are not: {', '.join(open_)}")
        picked = [Table(**{**t.__dict__, "columns": tuple(type(c)(**{**c.__dict__, "cast": self.options.casts.lookup(t.name, c.name, c.type) or c.cast}) for c in t.columns)}) for t in picked]
        bad, largest = groups.profile_members(picked, self.source.read)
        uuids, unsigned = groups.resolve_uuid(picked, bad), groups.resolve_unsigned(picked, largest)
        return [groups.apply_decisions(t, uuids, unsigned) for t in picked]

    def path(self, table: str) -> str:
        return f"{self.target}/{table}"

    def target_rows(self, table: str) -> int:
        try:
            return self.spark.read.parquet(self.path(table)).count()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return 0
            raise

    def converted(self, t: Table, demoted: set[str], df: DataFrame) -> DataFrame:
        """Rows of the table as its target holds them, with each row's violations."""
        plans = []
        for c in t.columns:
            labels = ddl.enum_labels(c.type) if ddl.plain_type(c.type) == "enum" and not c.cast else None
            plans.append(V.ValuePlan(c.name, target_type(c, "enum", c.name in demoted), c.nullable, tuple(labels) if labels else None))
        return V.apply(df, plans)

    def move(self, t: Table, demoted: set[str]) -> int:
        """One table: done tables are counted again, others are loaded from where they broke off. Fails closed on any violation."""
        self.spark.sparkContext.addJobTag(self.tag)
        c = self.store.checkpoint(self.session, t.name) or Checkpoint(self.session, t.name)
        if c.status == "done":
            if (n := self.target_rows(t.name)) != c.row_count:
                c.status, c.error_message, c.last_offset, c.last_cursor = "error", f"{n} rows in the target, {c.row_count} when it was finished", 0, ""
                self.store.save(c)
                raise RuntimeError(f"{t.name}: {c.error_message}")
            return 0
        try:
            if self.stop.is_set():
                raise Interrupted(t.name)
            if not t.key and c.status not in {"in_progress", "error"} and (held := self.target_rows(t.name)):
                raise RuntimeError(f"{t.name} has no primary key, and its target holds {held} rows already")
            df = self.source.read(t.name)
            first, moved = (t.key[0] if t.key and dict(df.dtypes).get(t.key[0]) in CUT else None), 0
            after = decode(c.last_cursor) if first and c.status != "pending" and c.last_offset else None
            if after is None:
                c.last_offset, c.last_cursor = 0, ""
                load.clear(self.spark, self.path(t.name))
            rest = df.filter(range_predicate(first, after[0], None)) if after else df
            seen = rest.agg(F.count(F.lit(1)).alias("n"), (F.max(F.struct(*(F.col(f"`{k}`") for k in t.key))) if t.key else F.lit(None)).alias("last")).first()
            total = c.last_offset + seen.n
            c.status, c.row_count, c.batch_size = "in_progress", total, self.options.batch
            self.store.save(c)
            if found := V.violation_counts(self.converted(t, demoted, rest)).orderBy("column", "reason").collect():  # a row for each column and reason
                self.violations[t.name] = found
                raise ValueError(f"{t.name}: " + "; ".join(f"{r.column}: {r.reason} ({r.n} rows)" for r in found))
            parts = min(self.options.ranges, -(-seen.n // self.options.batch)) if first else 1
            for low, high in key_ranges(rest, first, parts) if parts > 1 else [(None, None)]:
                if self.stop.is_set():
                    raise Interrupted(t.name)
                part = rest if low is None and high is None else rest.filter(range_predicate(first, low, high))
                n = load.load_batch(self.spark, self.shaped(t, demoted, part), self.path(t.name), c.last_offset)
                c.last_offset, moved = c.last_offset + n, moved + n
                c.last_cursor = cursor([high]) if high is not None else cursor(list(seen["last"])) if seen["last"] else c.last_cursor
                self.store.save(c)
                with self.lock:
                    self.rows += n
                self.emit("progress", progress(c.last_offset, total), t.name, c.last_offset, total)
            if c.last_offset != total or (here := self.target_rows(t.name)) != total:
                counted = f"{total} rows in the source, {c.last_offset} loaded, {here if c.last_offset == total else '?'} in the target"
                c.last_offset, c.last_cursor = 0, ""
                raise RuntimeError(f"{t.name}: {counted}")
            c.status, c.error_message = "done", ""
            self.store.save(c)
            return moved
        except Interrupted:
            raise
        except Exception as e:
            c.status, c.error_message = "error", str(e)[:1000]
            self.store.save(c)
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def shaped(self, t: Table, demoted: set[str], df: DataFrame) -> DataFrame:
        """Converted rows without their violations, decimals as such."""
        out = self.converted(t, demoted, df).drop("violations")
        types = {x.name: spark_type(target_type(x, "enum", x.name in demoted)) for x in t.columns}
        cast = {n: ty for n, ty in types.items() if ty.simpleString().startswith("decimal") and dict(out.dtypes)[n] == "string"}
        return out.withColumns({n: out[n].cast(ty) for n, ty in cast.items()}) if cast else out

    def objects(self, plan: list[tuple[Table, set[str]]]) -> list[dict]:
        """Unique indexes and foreign keys checked on the moved data; errors are gathered, not raised one by one."""
        known = {t.name.lower() for t in self.source.tables()}
        moved = {t.name.lower() for t, _ in plan}
        out = []
        for t, demoted in plan:
            self.manual += ddl.on_update_manual(t) + ddl.generated_manual(t) + ddl.report_only("trigger", list(t.triggers), t.name)
            if t.key and not (dup := integrity.duplicate_keys(self.spark.read.parquet(self.path(t.name)), list(t.key))).isEmpty():
                out.append({"object": ddl.key_name(t.name), "verdict": f"error: {dup.count()} repeated keys"})
            for k in t.foreign_keys:
                types = lambda tab, cols, d: [target_type(c, "enum", c.name in d) for n in cols for c in tab.columns if c.name == n]
                parent = next(((p, d) for p, d in plan if p.name.lower() == k.parent.lower()), None)
                n = integrity.orphans(self.spark.read.parquet(self.path(t.name)), list(k.columns), self.spark.read.parquet(self.path(k.parent)), list(k.parent_columns)).count() if parent else 0
                verdict = integrity.fk_verdict(k, known, moved, set(), (types(t, k.columns, demoted), types(parent[0], k.parent_columns, parent[1]) if parent else []), n)
                out.append({"object": k.name, "verdict": verdict})
                if verdict.startswith("manual"):
                    self.manual.append(Manual("foreign_key", t.name, k.name, integrity.orphan_sql(k) if n else integrity.fk_sql(k), verdict))
        return out

    def start(self) -> dict:
        began, opt = time.time(), self.options
        version = self.source.version()
        plan = self.plan()
        statements = [ddl.create_table_sql(t, demoted=d) for t, d in plan] if opt.phase != "data-only" else []
        if opt.fresh and (full := [t.name for t, _ in plan if self.target_rows(t.name)]):
            raise RuntimeError(f"a fresh session needs empty targets; these hold rows: {', '.join(full)}")
        objects: list[dict] = []
        try:
            if opt.phase != "schema-only":
                with ThreadPoolExecutor(opt.workers) as pool:
                    jobs = [pool.submit(self.move, t, d) for t, d in plan]
                    finished, _ = wait(jobs, return_when=FIRST_EXCEPTION)
                    if failed := next((j for j in finished if j.exception()), None):
                        self.stop.set()
                        for j in jobs:
                            j.cancel()
                        self.spark.sparkContext.cancelJobsWithTag(self.tag)
                        raise failed.exception()
                if self.source.version() != version:
                    raise RuntimeError("the source changed during the run")
            if opt.phase == "all":
                objects = self.objects(plan)
        finally:
            if opt.manual_path:
                ddl.write_manual(self.manual, opt.manual_path)
        seconds = time.time() - began
        self.emit("done", f"{self.rows} rows in {duration(seconds)}")
        return {"rows": self.rows, "seconds": seconds, "rows_per_s": self.rows / max(seconds, 1e-9), "statements": statements, "objects": objects, "manual": self.manual}
