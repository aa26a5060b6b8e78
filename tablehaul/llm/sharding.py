"""Sharding by fixed virtual slots.

A record's hash puts it into one of thousands of virtual slots for good. Bytes are summed for each slot, and a
versioned map says which shard has which slot; balance is a matter of editing that map, never of hashing anew. With
many more slots than shards the heaviest slots are dealt first and light ones even the rest out, so shards come out
equal in bytes (law ``bytes``). Everything on the data's path is DataFrame functions: one aggregate by slot, and one
window inside each slot for the rows' places.

Equal texts are not kept together: a text that a third of the rows share would fill a shard alone. Repeated rows (equal
doc_id and text) have one hash, so a slot that would hold more than 1 / ``HEAVY`` of a shard, of which there are fewer than
``HEAVY`` times the shards, is split into ``PARTS`` by the rows' numbers in the staged records.

Defined results: a null text has no bytes and a crc32 of 0 (like an empty one); a null doc_id is a value like others;
repeated rows each count and are spread over shards like others; other columns are ignored; very long texts are sized
in the scan and go no further; the row order inside a slot is by doc_id, then text; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

SLOTS, HEAVY, PARTS = 4096, 8, 64


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of slot -> shard. Its size is the number of slots, whatever the data."""

    version: int
    shards: int
    owner: tuple[int, ...]
    note: str = field(default="", compare=False)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Rows (version, vslot, shard), made inside the JVM."""
        rows = F.explode(F.from_json(F.lit(json.dumps([{"vslot": i, "shard": s} for i, s in enumerate(self.owner)])), "array<struct<vslot:int,shard:int>>"))
        return spark.range(1).select(F.lit(self.version).alias("version"), rows.alias("r")).select("version", "r.*")

    def save(self, spark: SparkSession, base: str) -> None:
        """Each version is a folder of its own and is never changed."""
        self.frame(spark).coalesce(1).write.parquet(f"{base}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, base: str, version: int | None = None) -> SlotMap:
        """The newest version, or the one named."""
        df = spark.read.parquet(base)
        v = df.agg(F.max("version")).first()[0] if version is None else version
        rows = df.filter(F.col("version") == v).orderBy("vslot").collect()  # a row a slot
        return SlotMap(v, max(r.shard for r in rows) + 1, tuple(r.shard for r in rows))


def slot_of(slots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int, slot: str = "vslot", size: str = "size") -> list[int]:
    """Bytes of each slot: summed on every task first, ``slots`` rows at most to the driver."""
    out = [0] * slots
    for r in records.groupBy(slot).agg(F.sum(size).alias("b")).collect():
        out[r[slot]] = r.b
    return out


def balanced(weights: list[int], shards: int, version: int = 1) -> SlotMap:
    """The heaviest slot left goes to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    owner = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        load, s = heapq.heappop(heap)
        owner[i] = s
        heapq.heappush(heap, (load + weights[i], s))
    return SlotMap(version, shards, tuple(owner), "made from slot bytes")


def rebalance(old: SlotMap, weights: list[int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots move from the heaviest shard to the lightest until all are within ``tolerance`` of the mean.

    A slot that doesn't have to move stays. Slots of removed shards move first; new shards start empty.
    """
    n = shards or old.shards
    loads, slots = [0] * n, [[] for _ in range(n)]
    owner, homeless = list(old.owner), []
    for i, s in enumerate(owner):
        if s < n:
            loads[s] += weights[i]
            slots[s].append(i)
        else:
            homeless.append(i)
    for i in sorted(homeless, key=lambda i: (-weights[i], i)):
        s = min(range(n), key=lambda s: (loads[s], s))
        owner[i] = s
        loads[s] += weights[i]
        slots[s].append(i)
    mean = sum(weights) / n
    for _ in range(4 * len(weights)):
        high, low = max(range(n), key=lambda s: loads[s]), min(range(n), key=lambda s: loads[s])
        gap = loads[high] - loads[low]
        if loads[high] <= mean * (1 + tolerance) and loads[low] >= mean * (1 - tolerance):
            break
        fit = [i for i in slots[high] if 0 < weights[i] < gap]
        if not fit:
            break
        i = min(fit, key=lambda i: (abs(gap / 2 - weights[i]), i))
        slots[high].remove(i)
        slots[low].append(i)
        owner[i], loads[high], loads[low] = low, loads[high] - weights[i], loads[low] + weights[i]
    return SlotMap(old.version + 1, n, tuple(owner), f"edited from version {old.version}")


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot: the text itself goes no further."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32")).withColumn("vslot", slot_of(slots, "doc_id", "text_crc32"))


def assign(records: DataFrame, m: SlotMap) -> DataFrame:
    """Shard and gapless place of each record.

    A place is the record's rank in its virtual slot plus the rows of the shard's earlier slots, so no task ever sorts
    a whole shard.
    """
    spark = records.sparkSession
    counts = records.groupBy("vslot").agg(F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(m.frame(spark).drop("version")), "vslot").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")  # a row a slot
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("rank", rank).join(F.broadcast(offsets), "vslot").withColumn("slot", (F.col("rank") + F.col("before") - 1).cast("bigint")).drop("rank", "before")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_dir: str | None = None) -> DataFrame:
    """The whole way: slots, bytes, a map (kept as version 1 under ``map_dir``), places."""
    records = staged(with_slots(docs, slots).withColumn("row", F.monotonically_increasing_id()), "shard-records")  # numbers stay as written
    weights = slot_bytes(records, slots)
    heavy = [i for i, b in enumerate(weights) if b * HEAVY * shards > sum(weights)]
    if heavy:
        places = F.from_json(F.lit(json.dumps({str(v): slots + i * PARTS for i, v in enumerate(heavy)})), "map<string,int>")
        part = F.element_at(places, F.col("vslot").cast("string")) + F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")
        records = records.withColumn("vslot", F.coalesce(part, F.col("vslot")))
        weights = slot_bytes(records, slots + len(heavy) * PARTS)
    m = balanced(weights, shards)
    if map_dir:
        m.save(docs.sparkSession, map_dir)
    return assign(records.drop("row"), m)
