import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import language_model as lm
from scoreloom.llm import queries, toxicity

from .conftest import DATA, EDGE

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORDS.findall((text or "").translate(CAPITALS)) + ["</s>"]


class PlainModel:
    """The same model in dictionaries, from its definition."""

    def __init__(self, texts, order):
        self.order, train = order, [tokens(t) for t in texts]
        self.words = Counter(w for t in train for w in t)
        padded = [["<s>"] * (order - 1) + t for t in train]
        self.levels = {order: Counter(tuple(p[i : i + order]) for p in padded for i in range(len(p) - order + 1))}
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(k[1:] for k in self.levels[n + 1])
        self.discounts, self.stats = {}, {n: {} for n in self.levels}
        for n, counts in self.levels.items():
            of_counts = Counter(counts.values())
            self.discounts[n] = lm.discounts({k: of_counts[k] for k in (1, 2, 3, 4)})
            for k, c in counts.items():
                s = self.stats[n].setdefault(k[:-1], [0, 0, 0, 0])
                s[0] += c
                s[min(c, 3)] += 1

    def p(self, context, word, n):
        if n == 0:
            return 1 / (len(self.words) + 1)
        h = context[len(context) - (n - 1) :] if n > 1 else ()
        below, s, d = self.p(context, word, n - 1), self.stats[n].get(h), self.discounts[n]
        if s is None:
            return below
        c = self.levels[n][(*h, word)]
        return (c - (d[min(c, 3) - 1] if c else 0)) / s[0] + sum(x * y for x, y in zip(d, s[1:], strict=True)) / s[0] * below

    def score(self, text):
        t = tokens(text)
        padded = ["<s>"] * (self.order - 1) + t
        return sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), w, self.order)) for i, w in enumerate(t))

    def base(self, text):
        n, v = sum(self.words.values()), len(self.words)
        return sum(math.log10((self.words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(text))


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def check_scores(found, texts, order):
    plain = PlainModel([t for i, t in texts if not held_out(i)], order)
    want = sorted(((str(i), held_out(i), len(tokens(t)), sum(plain.words[w] > 0 for w in tokens(t)), sum(plain.words.values()), plain.base(t), plain.score(t)) for i, t in texts))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6, atol=1e-6)


def test_scores(spark, rows):
    found = queries.op8_kneser_ney(spark, DATA).collect()
    check_scores(found, [(i, t) for i, t, _ in rows], 2)
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_trigrams(documents, rows):
    check_scores(lm.score_held_out(documents.filter("doc_id < 60"), order=3).collect(), [(i, t) for i, t, _ in rows if i < 60], 3)


def test_score_edge_rows(edge, empty, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH_TOKENS", 1000)
    small = edge.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)")
    check_scores(lm.score_held_out(small).collect(), [(r[0], r[1]) for r in EDGE if r[0] not in (5, 6)], 2)
    assert len(lm.score_held_out(edge).collect()) == len(EDGE)
    assert lm.score_held_out(empty).collect() == []
    none = lm.score(edge, lm.train(empty.select("text"))).collect()
    assert {r["score"] for r in none} == {0.0} and {r["n_known"] for r in none} == {0}


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a b d", "c a b", "a a d"]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = PlainModel(texts, 2)
    vocabulary = [*plain.words, "<unknown>"]
    for context in ("a", "b", "never"):
        assert sum(plain.p((context,), w, 2) for w in vocabulary) == pytest.approx(1)
    scored = lm.score(spark.createDataFrame([(1, "a b zzz")], "doc_id long, text string"), model).first()
    assert scored["score"] == pytest.approx(plain.score("a b zzz"))


TOXIC = ["trash", "idiot", "scum", "moron", "loser"]


@pytest.fixture(scope="module")
def judged(spark):
    """Documents of which a tenth hold three to six of a few words; a twentieth of the labels is wrong."""
    rng = np.random.default_rng(3)
    docs, labels, truth = [], [], {}
    for i in range(3000):
        bad = i % 10 == 0
        words = [f"w{x}" for x in rng.zipf(1.3, int(rng.integers(5, 200))) % 5000]
        for w in rng.choice(TOXIC, int(rng.integers(3, 7))) if bad else []:
            words.insert(int(rng.integers(0, len(words))), str(w).upper() + "!!" if rng.random() < 0.3 else str(w))
        docs.append((i, " ".join(words)))
        truth[i] = bad
        if i % 3:
            labels.append((i, int(rng.integers(0, 2)), int(bad != (rng.random() < 0.05))))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_chain_finds_toxic_texts_without_labels(judged):
    docs, labels, truth = judged
    found = {r["doc_id"]: r["rejected"] for r in toxicity.judge(docs, labels).collect()}
    unseen = [i for i in truth if i % 3 == 0]
    assert sum(found[i] for i in unseen if truth[i]) >= 0.95 * sum(truth[i] for i in unseen)
    assert not any(found[i] for i in truth if not truth[i])
    kept = toxicity.keep_clean(docs, labels, ["doc_id", "text"])
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(not x for x in found.values())


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(5)
    n = 2000
    a = rng.random(n) < 0.3
    hashes, rows = [], []
    for i in range(n):
        hashes += [1 if a[i] else 2, *rng.integers(10, 200, 5)]
        rows += [i] * 6
    x = toxicity.Words(np.array(rows), np.array(hashes, np.uint64), np.ones(len(rows)), n)
    b = a & (rng.random(n) < 0.8)
    labels = np.column_stack([a, b]).astype(float)
    chain = toxicity.fit_chain(x, labels, np.arange(n) % toxicity.FOLDS, ["a", "b"])
    assert chain.models[1].chain[0] > 0
    p = chain.predict(x)
    assert ((p[:, 0] > 0.5) == a).mean() > 0.99 and ((p[:, 1] > 0.5) == b).mean() > 0.85


def test_many_rare_toxic_words(spark):
    """A hundred toxic words, three in a toxic text: none of them is in 5 % of the toxic texts."""
    rng = np.random.default_rng(11)
    docs, labels, bad = [], [], set()
    for i in range(8000):
        words = [f"w{x}" for x in rng.zipf(1.3, int(rng.integers(20, 60))) % 5000]
        if i % 8 == 0:
            bad.add(i)
            words += [f"slur{x}" for x in rng.choice(100, 3, replace=False)]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 8 == 0)))
    found = {r["doc_id"]: r["rejected"] for r in toxicity.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(found[i] for i in bad) >= 0.95 * len(bad)
    assert sum(found[i] for i in found if i not in bad) <= 0.001 * len(found)


def as_words(texts):
    parts = list(toxicity.text_words(pa.array(texts)))
    assert len(parts) == 1
    return parts[0]


def test_copies_have_one_vote():
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 40) % 5000) + (f" slur{i % 7}" if i % 8 == 0 else "") for i in range(1500)]
    y = [float(i % 8 == 0) for i in range(1500)]
    passage = [f"copied{k}" for k in range(60)]
    for i in range(30):  # wrongly labelled near copies, a word or two of each changed
        own = list(passage)
        own[int(rng.integers(0, 60))] = f"edit{i}"
        texts.append(" ".join(own))
        y.append(1.0)
    texts += ["exact copied passage of five"] * 20
    y += [1.0] * 20
    x = as_words(texts)
    groups = toxicity.near_equal(x)
    assert len(set(groups[1500:1530])) == 1 and len(set(groups[1530:])) == 1 and len(set(groups)) == 1502
    chosen = set(toxicity._choose_words(x, np.array(y), groups).tolist())
    hashed = lambda words: set(as_words([" ".join(words)]).hashes.tolist())
    assert hashed([f"slur{k}" for k in range(7)]) <= chosen
    assert not chosen & hashed([*passage, *"exact copied passage of five".split()])


def test_near_equal_compares_past_the_first_of_a_band():
    """Two groups of copies with a template in common, which fills most bands, and all pairs by brute force."""
    rng = np.random.default_rng(13)
    template = [f"t{k}" for k in range(60)]
    texts = [""]
    for g in range(6):
        own = template + [f"g{g}x{k}" for k in range(30)]
        texts += [" ".join(np.delete(own, rng.integers(0, 90, 2))) for _ in range(8)]
    groups = toxicity.near_equal(as_words(texts))
    sets = [set(t.split()) for t in texts]
    for i, j in combinations(range(1, len(texts)), 2):
        alike = len(sets[i] & sets[j]) >= toxicity.NEAR_EQUAL * len(sets[i] | sets[j])
        assert (groups[i] == groups[j]) == alike


def test_chain_edge_rows(spark, edge, empty, judged):
    _, labels, _ = judged
    found = toxicity.judge(edge, labels).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in EDGE)
    assert toxicity.judge(empty, labels).collect() == []
    none = toxicity.judge(edge, labels.limit(0)).collect()
    assert len(none) == len(EDGE) and not any(r["rejected"] for r in none)
    odd = spark.createDataFrame([(None, 1, 1), (4, None, 1), (4, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert len(toxicity.judge(edge, odd).collect()) == len(EDGE)


def test_query_is_whole_and_right(spark, documents, rows):
    found = {r["doc_id"]: r for r in queries.op10_toxicity_chain(spark, "/root/testdata/sf0.01").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert set(found) == set(texts)
    words = {"trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"}
    hits = {i: sum(w in words for w in re.findall("[a-z]+", t.lower())) for i, t in texts.items()}
    assert not any(found[i]["rejected"] for i in texts if not hits[i])
    assert sum(found[i]["rejected"] for i in texts if hits[i] >= 3) >= 0.95 * sum(h >= 3 for h in hits.values())


def test_repeats_do_not_change_the_split(edge):
    assert edge.filter(lm.is_held_out()).count() == sum(held_out(r[0]) for r in EDGE)
    assert edge.select(F.count(F.when(lm.is_held_out(), 1))).first()[0] == sum(held_out(r[0]) for r in EDGE)
