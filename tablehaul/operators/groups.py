"""Key groups: columns that foreign keys tie together must get one type, or keys stop matching.

Two ways to components: ``components`` is distributed, for edges of any number; ``union_find`` is for the few edges
of a catalog, already on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.typemap import INT_TARGET, is_unsigned_bigint, is_uuid_storage, parts
from ..model import Column, ForeignKey, Table
from .profile import Profiler, standard

SIGNED_MAX = 2**63 - 1


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 64) -> DataFrame:
    """(node, root): root is the smallest node that edges reach. Labels spread to neighbours, then to labels' labels.

    Each round joins edges with labels on the node; it stops when no label moves. Lineage is cut by ``checkpoint()``
    where the session has a checkpoint folder.
    """
    spark = edges.sparkSession
    cut = (lambda d: d.checkpoint()) if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) else (lambda d: d.persist())
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct()
    both = cut(both)
    labels = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("root")).select(F.col("a").alias("node"), "root")
    labels = cut(labels)
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, labels.node == near.a, "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        up = moved.select(F.col("node").alias("r"), F.col("root").alias("up"))
        jumped = moved.join(up, moved.root == up.r, "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"))
        jumped = cut(jumped)
        still = jumped.join(labels.withColumnRenamed("root", "old"), "node").filter("root <> old").isEmpty()
        labels = jumped
        if still:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def union_find(nodes, edges) -> dict:
    """node -> smallest node of its component."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in up}


def verdicts(members: DataFrame) -> DataFrame:
    """Per group: is any member dirty, any anchored, do all fit, the largest overflow. Input: root, dirty, anchored, largest."""
    return members.groupBy("root").agg(F.bool_or("dirty").alias("any_dirty"), F.bool_or("anchored").alias("any_anchored"), F.bool_and(F.coalesce(F.col("largest") <= F.lit(SIGNED_MAX), F.lit(True))).alias("all_fit"), F.max("largest").alias("max_value")).withColumn("converts", ~F.col("any_dirty") & ~F.col("any_anchored"))


@dataclass(frozen=True)
class Decision:
    table: str
    column: str
    converts: bool
    reason: str = ""


def _fk_pairs(tables: list[Table]):
    for t in tables:
        for k in t.foreign_keys:
            for a, b in zip(k.columns, k.parent_columns, strict=True):
                yield (t.name.lower(), a.lower()), (k.parent.lower(), b.lower())


def _columns(tables: list[Table]) -> dict[tuple[str, str], Column]:
    return {(t.name.lower(), c.name.lower()): c for t in tables for c in t.columns}


def uuid_members(tables: list[Table]) -> set[tuple[str, str]]:
    """UUID-shaped, un-cast columns that are a key, refer to one, or are referred to by one."""
    cols = _columns(tables)
    shaped = {k for k, c in cols.items() if is_uuid_storage(c.type) and not c.cast}
    keys = {(t.name.lower(), c.lower()) for t in tables for c in t.key}
    out = shaped & keys
    for a, b in _fk_pairs(tables):
        if a in cols and b in cols and is_uuid_storage(cols[a].type) and is_uuid_storage(cols[b].type):
            out |= {a, b} & shaped
    return out


def resolve_uuid(tables: list[Table], dirty: dict[tuple[str, str], int]) -> dict[tuple[str, str], Decision]:
    """A group becomes uuid if no member holds a bad value and no peer outside it must keep its type."""
    cols, members = _columns(tables), uuid_members(tables)
    edges, anchored = [], set()
    for a, b in _fk_pairs(tables):
        for x, y in ((a, b), (b, a)):
            if x in members and y in members:
                edges.append((x, y))
            elif x in members and not (y in cols and (cols[y].cast or "").lower() == "uuid"):
                anchored.add(x)
    roots = union_find(members, edges)
    bad = {roots[m] for m in members if dirty.get(m, 0)}
    tied = {roots[m] for m in members & anchored}
    out = {}
    for m in sorted(members):
        ok = roots[m] not in bad | tied
        why = "" if ok else f"{dirty[m]} values are no uuid" if dirty.get(m) else "a linked column can't be uuid" if roots[m] in tied and roots[m] not in bad else "a linked column holds values that are no uuid"
        out[m] = Decision(*m, ok, why)
    return out


def resolve_unsigned(tables: list[Table], largest: dict[tuple[str, str], int | None]) -> dict[tuple[str, str], Decision]:
    """Unsigned bigints become signed if every value of the group fits. Raises if one doesn't and a peer is a plain integer."""
    cols = _columns(tables)
    members = {k for k, c in cols.items() if not c.cast and is_unsigned_bigint(c.type)}
    edges, anchored = [], set()
    for a, b in _fk_pairs(tables):
        for x, y in ((a, b), (b, a)):
            if x in members and y in members:
                edges.append((x, y))
            elif x in members and y in cols and parts(cols[y].type)[0] in INT_TARGET:
                anchored.add(x)
    roots = union_find(members, edges)
    over = {roots[m]: m for m in sorted(members) if (largest.get(m) or 0) > SIGNED_MAX}
    out = {}
    for m in sorted(members):
        if (worst := over.get(roots[m])) is None:
            out[m] = Decision(*m, True)
        elif any(roots[x] == roots[m] for x in anchored):
            raise ValueError(f"{'.'.join(worst)} exceeds a signed bigint, and a column linked to it is a plain integer: cast both")
        else:
            out[m] = Decision(*m, False, f"{'.'.join(worst)} exceeds a signed bigint")
    return out


def profile_members(tables: list[Table], read, cache: dict | None = None) -> tuple[dict, dict]:
    """(bad uuid counts, unsigned maxima) with one scan for each table that has members. ``cache`` spares repeats."""
    cache = {} if cache is None else cache
    members = uuid_members(tables)
    for t in tables:
        low = t.name.lower()
        uuids = [c.name for c in t.columns if (low, c.name.lower()) in members and ("uuid", low, c.name.lower()) not in cache]
        unsigned = [c.name for c in t.columns if not c.cast and is_unsigned_bigint(c.type) and ("max", low, c.name.lower()) not in cache]
        if not uuids and not unsigned:
            continue
        full, df = standard(df := read(t.name), uuids=uuids, unsigned=unsigned), df
        only = Profiler(df)
        only.exprs = {n: e for n, e in full.exprs.items() if n.startswith(("uuid:", "max:"))}
        for n, v in only.run().items():
            kind, _, c = n.partition(":")
            cache[kind, low, c.lower()] = int(v) if v is not None else None
    pick = lambda kind: {k[1:]: v for k, v in cache.items() if k[0] == kind}
    return pick("uuid"), pick("max")


def apply_decisions(t: Table, uuids: dict, unsigned: dict) -> tuple[Table, set[str]]:
    """The table with its uuid flags set, and the unsigned columns that become signed."""
    low = t.name.lower()
    cols = tuple(replace(c, is_uuid=bool((d := uuids.get((low, c.name.lower()))) and d.converts), demotion=d.reason if d else "") for c in t.columns)
    return replace(t, columns=cols), {c.name for c in t.columns if (d := unsigned.get((low, c.name.lower()))) and d.converts}


def schema_drift(planned: dict[str, str], existing: dict[str, str], table: str) -> list[str]:
    """ALTER statements that bring an existing target's columns to the planned types."""
    return [f'ALTER TABLE "{table}" ALTER COLUMN "{c}" TYPE {want} USING "{c}"::{want};' for c, want in planned.items() if (have := existing.get(c.lower())) and have.lower() != want.lower()]
