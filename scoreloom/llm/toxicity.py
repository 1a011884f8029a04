"""Toxicity by a classifier chain.

The categories are predicted in order by linear models over the words of a text; each model after the
first also sees the earlier categories' probabilities. While fitting, those come out of fold, so that
a later model never learns from a probability its own label helped to make.

The chain is fitted on at most ``max_labelled`` labelled documents, those with the smallest hash of
their id; only their words' hashes reach the driver. Words are lowered runs of letters and digits; a
word becomes a feature of a category when the shares of the two classes that have it differ by more
than chance (``MIN_Z``, however small the shares), and ``MIN_DOCUMENTS`` votes have it. Equal and
near-equal texts share one vote: words of a few copies with a wrong label are no evidence. Scoring
reads every whole text in place, without a shuffle; the fitted chain is at most ``MAX_FEATURES``
weights a category.

Null and empty texts have no words: they get the chain's base rates. Documents without a label, with
several (the largest counts) or with a null one are scored all the same. Without any labelled document
of both classes a category has the constant probability of its base rate (0 without labels). An empty
table gives an empty result. Columns of the same names as the categories are not overwritten but left
out: the result is (doc_id, a probability per category, rejected).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import LETTERS, free_name, mix, word_hashes

MAX_LABELLED = 8_000
MAX_FEATURES = 4096
MIN_DOCUMENTS = 5
MIN_Z = 4.5
#: texts whose sets of words are so alike (Jaccard) are near-equal; found by bands of smallest hashes
NEAR_EQUAL = 0.8
NEAR_BANDS, BAND_HASHES = 16, 4
FOLDS = 5
THRESHOLD = 0.5
#: a text counts a word this often at most
MOST_COUNTS = 3.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Words:
    """Sparse rows: the distinct word hashes of each text and how often it has them."""

    rows: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    n: int

    def take(self, keep: np.ndarray) -> Words:
        place = np.cumsum(keep) - 1
        inside = keep[self.rows]
        return Words(place[self.rows[inside]], self.hashes[inside], self.counts[inside], int(keep.sum()))


@dataclass
class Linear:
    """A logistic model over some words and the earlier probabilities."""

    words: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def score(self, x: Words, earlier: np.ndarray) -> np.ndarray:
        out = np.full(x.n, self.bias)
        if len(self.words) and len(x.hashes):
            at = np.minimum(np.searchsorted(self.words, x.hashes), len(self.words) - 1)
            hit = self.words[at] == x.hashes
            out += np.bincount(x.rows[hit], self.weights[at[hit]] * np.minimum(x.counts[hit], MOST_COUNTS), x.n)
        if earlier.shape[1]:
            out += _logit(earlier) @ self.chain
        return _sigmoid(out)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)

    def predict(self, x: Words) -> np.ndarray:
        """Probabilities (texts x categories); each feeds the next models."""
        out = np.zeros((x.n, 0))
        for model in self.models:
            out = np.column_stack([out, model.score(x, out)])
        return out


def near_equal(x: Words) -> np.ndarray:
    """A group number for every text; texts linked by near-equal sets of words have the same.

    Texts that share a band are compared with the first of them, those unlike it with the next that is left, until none is.
    """
    root = np.arange(x.n)
    order = np.argsort(x.rows, kind="stable")
    hashes, sizes = x.hashes[order], np.bincount(x.rows, minlength=x.n)
    ends = np.cumsum(sizes)
    some = np.flatnonzero(sizes)
    root[sizes == 0] = np.argmin(sizes) if x.n else 0
    if not len(some):
        return root
    sets = lambda i: hashes[ends[i] - sizes[i] : ends[i]]
    for band in range(NEAR_BANDS):
        key = np.zeros(len(some), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(band * BAND_HASHES, (band + 1) * BAND_HASHES):
                key = mix(key + np.minimum.reduceat(mix(hashes ^ mix(np.uint64(k + 1))), (ends - sizes)[some]))
        placed = np.argsort(key, kind="stable")
        for members in np.split(some[placed], np.flatnonzero(np.diff(key[placed])) + 1):
            while len(members) > 1:
                first, members = members[0], members[1:]
                members = members[root[members] != root[first]]
                if not len(members):
                    break
                own = np.sort(sets(first))
                theirs = np.concatenate([sets(i) for i in members])
                both = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                shared = np.add.reduceat(both.astype(np.int64), np.cumsum(sizes[members]) - sizes[members])
                alike = shared >= NEAR_EQUAL * (sizes[members] + len(own) - shared)
                root[np.isin(root, root[members[alike]])] = root[first]
                members = members[~alike]
    return root


def _choose_words(x: Words, y: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Words whose document shares in the two classes differ most, beyond chance; a group of texts has one vote.

    z is the root of the likelihood ratio, which holds for rare words too.
    """
    if not len(x.hashes):
        return np.zeros(0, np.uint64)
    words, back = np.unique(x.hashes, return_inverse=True)
    _, group, members = np.unique(groups, return_inverse=True, return_counts=True)
    vote = 1.0 / members[group]
    n1, n0 = float((vote * y).sum()), float((vote * (1 - y)).sum())
    d1 = np.bincount(back, (vote * y)[x.rows], len(words))
    d = np.bincount(back, vote[x.rows], len(words))
    p = np.clip(d / (n1 + n0), 0.0, 1.0)
    z2 = np.zeros(len(words))
    for have, n in ((d1, n1), (d - d1, n0)):
        for seen, expected in ((have, n * p), (n - have, n * (1 - p))):
            seen = np.maximum(seen, 0.0)
            z2 += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))
    keep = np.flatnonzero((z2 > MIN_Z**2) & (d >= MIN_DOCUMENTS - 1e-9))
    return words[np.sort(keep[np.argsort(-z2[keep], kind="stable")][:MAX_FEATURES])]


def fit_linear(x: Words, y: np.ndarray, earlier: np.ndarray, groups: np.ndarray, rounds: int = 300, ridge: float = 1.0) -> Linear:
    """Penalised logistic regression, by gradient descent with momentum on scaled columns."""
    y = y.astype(float)
    rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.0
    constant = Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), float(_logit(np.array(rate))))
    if not len(y) or y.min() == y.max():
        return constant
    words = _choose_words(x, y, groups)
    at = np.minimum(np.searchsorted(words, x.hashes), max(0, len(words) - 1))
    hit = words[at] == x.hashes if len(words) else np.zeros(len(x.hashes), bool)
    rows, cols, vals = x.rows[hit], at[hit], np.minimum(x.counts[hit], MOST_COUNTS)
    dense = _logit(earlier)
    k, n = len(words), len(y)
    w, c, b = np.zeros(k), np.zeros(dense.shape[1]), float(_logit(np.array(rate)))
    scale = 1.0 / np.sqrt(np.bincount(cols, vals**2, k) / 4 + ridge) if k else np.zeros(0)
    scale_c = 1.0 / np.sqrt((dense**2).sum(axis=0) / 4 + ridge)
    scale_b = 1.0 / np.sqrt(n / 4)
    # the largest curvature of the scaled problem, by power iterations
    v = np.ones(k + len(c) + 1)
    for _ in range(20):
        z = np.bincount(rows, (v[:k] * scale)[cols] * vals, n) + dense @ (v[k:-1] * scale_c) + v[-1] * scale_b
        g = np.concatenate([np.bincount(cols, z[rows] * vals, k) * scale, dense.T @ z * scale_c, [z.sum() * scale_b]]) / 4
        norm = np.linalg.norm(g)
        v = g / max(norm, 1e-12)
    step = 1.0 / (norm + 1.0)
    theta = np.concatenate([w, c, [b / scale_b]])
    ahead = theta.copy()
    for t in range(1, rounds + 1):
        z = np.bincount(rows, (ahead[:k] * scale)[cols] * vals, n) + dense @ (ahead[k:-1] * scale_c) + ahead[-1] * scale_b
        r = _sigmoid(z) - y
        g = np.concatenate([
            np.bincount(cols, r[rows] * vals, k) * scale + ridge * ahead[:k] * scale**2,
            dense.T @ r * scale_c + ridge * ahead[k:-1] * scale_c**2, [r.sum() * scale_b],
        ])
        last, theta = theta, ahead - step * g
        ahead = theta + (t - 1) / (t + 2) * (theta - last)
    w, c, b = theta[:k] * scale, theta[k:-1] * scale_c, float(theta[-1] * scale_b)
    return Linear(words, w, c, b)


def fit_chain(x: Words, labels: np.ndarray, folds: np.ndarray, categories: Sequence[str]) -> Chain:
    """A model per category; the probabilities that later models learn from are out of fold. NaN labels are left out."""
    chain = Chain(list(categories))
    earlier = np.zeros((x.n, 0))
    groups = near_equal(x)
    for i in range(len(categories)):
        known = ~np.isnan(labels[:, i])
        fit = lambda rows, i=i, earlier=earlier: fit_linear(x.take(rows), labels[rows, i], earlier[rows], groups[rows])
        chain.models.append(fit(known))
        out = np.zeros(x.n)
        for f in range(FOLDS):
            held = folds == f
            if held.any():
                out[held] = fit(known & ~held).score(x.take(held), earlier[held])
        earlier = np.column_stack([earlier, out])
    return chain


def text_words(texts: pa.Array) -> Iterator[Words]:
    """Distinct words of the texts, a bounded group of texts at a time."""
    for _, counts, hashes in word_hashes(texts, LETTERS):
        rows = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(first)
        yield Words(rows[at], hashes[at], np.diff(np.append(at, len(rows))).astype(float), len(counts))


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_labelled: int = MAX_LABELLED) -> Chain:
    """``labels``: doc_id and a 0/1 column per category."""
    spark = docs.sparkSession
    rated = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(f"y{i}") for i, c in enumerate(categories)])
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toArrow()
    ids = chosen.column("doc_id").to_numpy()
    order = np.argsort(ids)
    wanted = spark.createDataFrame(pa.table({"_labelled": pa.array(ids[order], pa.int64())}))
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids_ = 0, batch.column(0)
            for x in text_words(batch.column(1)):
                cut = np.searchsorted(x.rows, np.arange(x.n + 1))
                words = [x.hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                counts = [np.minimum(x.counts[a:b], 255).astype(np.uint8).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids_.slice(at, x.n), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], schema=schema)
                at += x.n

    # at most max_labelled ids: a bounded table, broadcast so that no text is shuffled
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(wanted), F.col("doc_id") == F.col("_labelled"), "left_semi").mapInArrow(features, "doc_id bigint, words binary, counts binary")
    got = found.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    doc_ids = got.column("doc_id").to_numpy()
    words = [np.frombuffer(b.as_py(), np.uint64) for b in got.column("words")]
    counts = [np.frombuffer(b.as_py(), np.uint8) for b in got.column("counts")]
    sizes = np.array([len(w) for w in words], np.int64)
    empty = np.zeros(0, np.uint64)
    x = Words(np.repeat(np.arange(len(words)), sizes), np.concatenate([empty, *words]), np.concatenate([np.zeros(0), *counts]).astype(float), len(words))
    rows = order[np.searchsorted(ids[order], doc_ids)] if len(doc_ids) else np.zeros(0, np.int64)
    y = np.column_stack([chosen.column(f"y{i}").to_numpy(zero_copy_only=False)[rows].astype(float) for i in range(len(categories))]) if len(rows) else np.zeros((0, len(categories)))
    with np.errstate(over="ignore"):
        folds = ((doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(FOLDS)
    return fit_chain(x, y, folds.astype(np.int64), categories)


def score(docs: DataFrame, chain: Chain, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, and a probability for each category."""
    text = free_name(keep, "text_")
    kept = docs.select(*keep, F.col("text").cast("string").alias(text))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]] + [f"`{c}` double" for c in chain.categories])

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chain.predict(x) for x in text_words(batch.column(batch.num_columns - 1))]
            p = np.concatenate(parts) if parts else np.zeros((0, len(chain.categories)))
            columns = [*batch.columns[:-1], *[pa.array(p[:, i]) for i in range(p.shape[1])]]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *chain.categories])

    return kept.mapInArrow(probabilities, schema)


def with_low_quality(labels: DataFrame) -> DataFrame:
    """The label table as categories, the ones that hold more often first."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


CATEGORIES = ["low_quality", "toxic"]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, low_quality, toxic, rejected) of every document."""
    chain = fit(docs, with_low_quality(labels), CATEGORIES)
    return score(docs, chain).withColumn("rejected", F.col("toxic") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject; labels may be fitted on any documents among them."""
    chain = fit(docs, with_low_quality(labels), CATEGORIES)
    return score(docs, chain, columns).filter(F.col("toxic") < threshold).select(*columns)
