"""The thin queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, chat, decontaminate, jaccard, packing, pii, repeats, sharding, toxicity, url_filter
from .common import crc32_mod, read, ship

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        def run(spark, d):
            ship(spark)
            return f(spark, d)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return put


@query("op1_url_filter", url_filter.ORACLE)
def op1(spark, d):
    return url_filter.judge(read(spark, d, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query("op2_chat_perspectives", chat.ORACLE)
def op2(spark, d):
    return chat.rotate(read(spark, d, "conversations"))


@query("op6_slot_sharding")
def op6(spark, d):
    out = sharding.shard(read(spark, d, "documents").select("doc_id", "text"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


@query("op9_packing")
def op9(spark, d):
    import public_tokenizers

    return packing.pack(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_pii")
def op10(spark, d):
    return pii.detect(read(spark, d, "documents"))


@query("op3_toxicity")
def op3(spark, d):
    docs = read(spark, d, "documents")
    index, known = toxicity.train(docs, read(spark, d, "labels"))
    out = toxicity.score(docs, index, known)
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "evidence")


@query("op5_decontamination")
def op5(spark, d):
    return decontaminate.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query("op4_additive_ann")
def op4(spark, d):
    return ann.search(read(spark, d, "embeddings"))


@query("op7_jaccard_join")
def op7(spark, d):
    return jaccard.link(read(spark, d, "documents"))


@query("op8_repeats")
def op8(spark, d):
    return repeats.deduplicate(read(spark, d, "documents"), passage=repeats.PASSAGE)
