import numpy as np

import corpus_pipeline as cp
from tablehaul.llm import common, decontaminate, jaccard, packing, pii, toxicity
from tablehaul.llm.common import staged

from .test_jaccard import brute

SF = "/root/testdata/sf0.01"


def test_each_stage_against_its_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = {r.doc_id: r.text for r in docs.collect()}
    index, known = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {d: t for d, t in base.items() if index.score(t, known, {})[0] < 0.5}
    comp = {d: c for d, _, c in brute(list(want.items()))}
    want = {d: t for d, t in want.items() if comp[d] == d}
    items = [np.array(decontaminate.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = lambda t: f" {' '.join(decontaminate.words(t))} "
    leaked = {d for d, t in want.items() if any(f" {' '.join(i)} " in whole(t) for i in items)}
    got = docs
    for name, stage in cp.STAGES[:3]:
        got = staged(stage(spark, got, SF), f"test-{name}")
        assert got.columns == docs.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    assert leaked and not leaked & set(kept) and len(set(want) - leaked - set(kept)) <= 1
    assert all(kept[d] == base[d] for d in kept)
    trees, limits = pii.model()
    red = {r.doc_id: (r.text, r.n_chars) for r in cp.personal_data(spark, got, SF).collect()}
    assert set(red) == set(kept) and all(red[d] == (x := pii.redact_text(t, trees, limits), len(x)) for d, t in kept.items())
    pieces = cp.run(spark, SF).toPandas()
    e = packing.Encoder(__import__("public_tokenizers").path(cp.TOKENIZER))
    sizes = {d: len(e.direct(t)) // 4 + 1 for d, (t, _) in red.items()}
    assert pieces.groupby("doc_id").length.sum().to_dict() == sizes


def test_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert jaccard.keep_one(spark.read.parquet(str(tmp_path / "documents.parquet"))).count() == 0


def test_executors_collect_their_garbage(spark):
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    common.settle_executors(spark)  # here the driver is the executor
    assert full() > before
    common.settle(spark)
