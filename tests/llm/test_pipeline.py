import re
from collections import Counter

import corpus_pipeline

from scoreloom.llm import jaccard_join, mixing, packing, toxicity
from scoreloom.llm.common import stored

from .conftest import DATA
from .test_near import plain_classes
from .test_pii import base

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_one_after_the_other(spark, documents):
    """Each stage's rows against a plain computation on its own input."""
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, DATA), name)
        kept[name] = (before, docs)
        if name != "pack_sequences":
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before, after = map(texts, kept["toxicity"])
    judged = toxicity.judge(documents, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(after) == {r["doc_id"] for r in judged.collect() if not r["rejected"]} and all(after[i] == before[i] for i in after)

    before, after = map(texts, kept["ngram_jaccard_join"])
    assert sorted(after) == sorted({c for _, _, c in plain_classes(list(before.items()))})

    before, after = map(texts, kept["personal_data"])
    assert set(before) == set(after)
    assert {i for i in before if before[i] != after[i]} == {i for i in before if base(before[i])}
    assert not any(base(t) for t in after.values())

    before, after = kept["mix_sources"]
    source = {r["doc_id"]: r for r in before.collect()}
    times = Counter(r["doc_id"] for r in after.collect())
    size = {i: len(WORDS.findall(r["text"])) for i, r in source.items()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.sizes_of(before)).collect()}
    assert all(times[i] == int(taken[i] / size[i] + 0.5) if size[i] else times[i] == 1 for i in source)

    before, after = kept["pack_sequences"]
    pieces = after.collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == times
    fills = Counter()
    for r in pieces:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= packing.CAPACITY and len(fills) <= -(-sum(fills.values()) // packing.CAPACITY) + 2


def test_run_is_the_stages_chained(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 200


def test_stages_take_edge_rows_and_empty_tables(spark, edge, empty):
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), name)
        assert not docs.isEmpty()
        assert stage(spark, empty, DATA).isEmpty()
    assert jaccard_join.keep_one(empty, corpus_pipeline.COLUMNS).isEmpty()
