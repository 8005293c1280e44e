import random
from collections import Counter

import pytest

import corpus_pipeline
from terraloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark, tmp_path):
    """The smallest tables with planted documents: benchmark passages of one item, copies, and toxic ones."""
    rng = random.Random(7)
    words = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    bench = table(spark, SF, "benchmark")
    passage = max((r.text for r in bench.collect()), key=len)
    original = words(150)
    edited = original.split()
    edited[70] = "changed"
    planted = {10**6: f"{words(40)} {passage} {words(40)}", 10**6 + 1: original, 10**6 + 2: original, 10**6 + 3: " ".join(edited), 10**6 + 4: None, 10**6 + 5: "", 10**6 + 6: words(200)}
    toxic = {2 * 10**6 + i: f"{words(20)}. you absolute blorgface {words(3)}. {words(20)}" for i in range(40)}
    clean = {3 * 10**6 + i: words(60) for i in range(80)}
    added = {**planted, **toxic, **clean}
    docs = table(spark, SF, "documents")
    more = spark.createDataFrame([(d, t, "en", "planted", len(t or "")) for d, t in added.items()], docs.schema)
    labels = table(spark, SF, "labels")
    marked = spark.createDataFrame([(d, 1, int(d < 3 * 10**6)) for d in (*toxic, *clean)], labels.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.unionByName(marked).write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), toxic, clean


def test_stages_take_effect(spark, corpus):
    sf, toxic, clean = corpus
    docs = table(spark, sf, "documents")
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, columns = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
        docs = corpus_pipeline.stage(function(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        kept[name] = (before, {r.doc_id for r in docs.select("doc_id").collect()})
    gone = {name: before - after for name, (before, after) in kept.items()}
    assert gone["toxicity"] >= set(toxic) and not gone["toxicity"] & set(clean)
    assert gone["near_duplicates"] >= {10**6 + 2, 10**6 + 3} and 10**6 + 1 in kept["near_duplicates"][1] and 10**6 + 6 in kept["near_duplicates"][1]
    assert 10**6 in gone["decontamination"] and not gone["decontamination"] & {10**6 + 1, 10**6 + 6, *clean}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in docs.collect())
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, last))


def test_odd_input(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 1, 1), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, some in ((odd_docs, True), (no_docs, False)):
        for name, function in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(function(spark, docs, str(tmp_path)), f"odd-{name}")
        assert (docs.count() > 0) == some and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
