"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays.

Tokens are words (ASCII capitals lowered) and one end per text. The n-grams of the training texts are
counted per task, dealt to buckets by the hash of their context (a context that would fill a bucket is
dealt by n-gram instead), merged there and written to the shared folder as raw arrays: sorted 64-bit
hashes of the n-grams with their counts, sorted hashes of the contexts with their totals and numbers
of continuations. Each lower order counts the distinct contexts before an n-gram and is built from the
order above in the same way. Workers map the arrays into memory and look up a window of text at a time;
no array is ever loaded whole, broadcast or sent through the driver, which sees bucket sizes, the
heaviest contexts (fewer than there are buckets) and counts of counts only.

The shared folder must be a path that all workers can map (a mounted file system). Files are written
under another name and renamed, so that a task that runs twice leaves one complete file.

Null and empty texts are one end. A null id counts as an empty text for the choice of training texts.
Rows with equal ids are scored, and trained on, one by one. Without training texts every text has
probability 1 in the base score (no token is known, N and V are 0) and uniform probability 1 in the
model. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import mix, new_path, word_hashes

END = np.uint64(0xE7D5C3B1A9081726)
START = np.uint64(0x1B2C3D4E5F607182)
NO_CONTEXT = np.uint64(0)
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 16
#: tokens that a task counts before it sends them on
FLUSH_TOKENS = 3_000_000
PART = "level int, bucket int, contexts binary, shorter binary, sizes binary, words binary, counts binary"
PART_SCHEMA = pa.schema([("level", pa.int32()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in ("contexts", "shorter", "sizes", "words", "counts")])
MERGED = "kind string, bucket int, key bigint, a bigint, b bigint, c bigint, d bigint"


def gram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * np.uint64(0x9FB21C651E98DF25) + word)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _hit(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted ``keys``: the places of ``wanted`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _save(path: str, values: np.ndarray) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    values.tofile(temporary)
    os.replace(temporary, path)


def _map(path: str, kind) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


@dataclass(frozen=True)
class Model:
    """Where a model's arrays lie, and its few global numbers. ``discounts``: per level from 1 up, for counts 1, 2 and more."""

    folder: str
    order: int
    buckets: int
    discounts: tuple[tuple[float, float, float], ...]
    tokens: int
    vocabulary: int
    bottom: tuple[int, int, int, int]


class Arrays:
    """One level's arrays in this process, mapped when first asked for."""

    def __init__(self, folder: str, level: str, buckets: int):
        self.folder, self.level, self.buckets, self.known = folder, level, buckets, {}
        self.hot = _map(f"{folder}/hot", np.uint64)

    def _file(self, name: str, bucket: int | str, kind) -> np.ndarray:
        path = f"{self.folder}/{self.level}-{name}-{bucket}"
        if path not in self.known:
            self.known[path] = _map(path, kind)
        return self.known[path]

    def counts(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of distinct n-grams; 0 for unseen ones."""
        keys = gram_key(contexts, words)
        buckets = _place(self.hot, contexts, keys, words, self.buckets)
        order = np.lexsort((keys, buckets))
        bounds = np.searchsorted(buckets[order], np.arange(self.buckets + 1))
        out = np.zeros(len(keys), np.int64)
        for b in range(self.buckets):
            rows = order[bounds[b] : bounds[b + 1]]
            if len(rows):
                at, hit = _hit(self._file("keys", b, np.uint64), keys[rows])
                found = self._file("counts", b, np.uint8)[at[hit]].astype(np.int64)
                large = np.flatnonzero(found == 255)
                if len(large):
                    more = self._file("large", b, np.int64).reshape(-1, 2)
                    found[large] = more[np.searchsorted(more[:, 0], at[hit][large]), 1]
                out[rows[hit]] = found
        return out

    def stats(self, contexts: np.ndarray) -> np.ndarray:
        """(total, ones, twos, more) of distinct contexts; zeros for unseen ones."""
        out = np.zeros((len(contexts), 4), np.float64)
        buckets = _bucket(contexts, self.buckets)
        for b in np.unique(buckets):
            rows = np.flatnonzero(buckets == b)
            at, hit = _hit(self._file("contexts", int(b), np.uint64), contexts[rows])
            out[rows[hit]] = self._file("stats", int(b), np.uint32).reshape(-1, 4)[at[hit]]
        at, hit = _hit(self._file("contexts", "hot", np.uint64), contexts)
        if hit.any():
            out[hit] = self._file("stats", "hot", np.int64).reshape(-1, 4)[at[hit]]
        return out


def _place(hot: np.ndarray, contexts: np.ndarray, keys: np.ndarray, words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each n-gram: by its context, by the n-gram where the context is hot, by the word where there is none."""
    by = np.where(contexts == NO_CONTEXT, mix(words), contexts)
    heavy = _hit(hot, contexts)[1]
    return _bucket(np.where(heavy, keys, by), buckets)


def _packed(level: int, contexts: np.ndarray, shorter: np.ndarray, words: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one level by bucket: equal n-grams added up, contexts written once for all their words."""
    if not len(words):
        return
    order = np.lexsort((words, contexts, buckets))
    contexts, shorter, words, counts, buckets = (x[order] for x in (contexts, shorter, words, counts, buckets))
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])
    first = np.flatnonzero(new)
    counts = np.add.reduceat(counts, first)
    contexts, shorter, words, buckets = contexts[first], shorter[first], words[first], buckets[first]
    bounds = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip(np.append(0, bounds), np.append(bounds, len(words)), strict=True):
        own = contexts[lo:hi]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        row = [level, int(buckets[lo]), own[starts].tobytes(), shorter[lo:hi][starts].tobytes(), np.diff(np.append(starts, hi - lo)).astype(np.uint32).tobytes(), words[lo:hi].tobytes(), counts[lo:hi].astype(np.uint32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, PART_SCHEMA, strict=True)], schema=PART_SCHEMA)


def text_tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, tokens per text) of a group of texts at a time; each text ends in END."""
    for _, counts, hashes in word_hashes(texts):
        ends = np.cumsum(counts)
        yield np.insert(hashes, ends, END), counts + 1


def _histories(tokens: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """The context hashes of length 0 to ``order`` - 1 before each token; START fills up."""
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(tokens))
    out, context = [np.full(len(tokens), NO_CONTEXT)], None
    for back in range(1, order):
        at = place - back
        word = np.where(at >= starts, tokens[at], START)
        # the words of a context from the nearest to the farthest
        context = gram_key(np.full(len(tokens), NO_CONTEXT) if context is None else context, word)
        out.append(context)
    return out


def _folder(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: the model's folder must be one that workers can map into memory")
    return url.path


def is_held_out(doc_id: str = "doc_id", parts: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0


def _count(texts: DataFrame, order: int, buckets: int, folder: str) -> DataFrame:
    """The n-grams of the texts, as packed rows."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _map(f"{folder}/hot", np.uint64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            words, contexts, shorter = (np.concatenate([h[i] for h in held]) for i in range(3))
            yield from _packed(order, contexts, shorter, words, np.ones(len(words), np.int64), _place(hot, contexts, gram_key(contexts, words), words, buckets))

        for batch in batches:
            for tokens, counts in text_tokens(batch.column(0)):
                history = _histories(tokens, counts, order)
                held.append((tokens, history[-1], history[max(0, order - 2)]))
                size += len(tokens)
                if size >= FLUSH_TOKENS:
                    yield from flushed()
                    held, size = [], 0
        if held:
            yield from flushed()

    return texts.mapInArrow(grams, PART)


def _merge(parts: DataFrame, name: str, level: int, buckets: int, folder: str, lower: bool) -> DataFrame:
    """Merges a level's buckets and writes their arrays.

    Rows: ``count`` (key: 1 to 4, a: how many n-grams have that count), ``size`` (a: n-grams, b: sum of counts),
    ``hot`` (key: a heavy context, a to d: its share of the totals); with ``lower`` also the packed rows of the level below.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        hot = _map(f"{folder}/hot", np.uint64)
        arrays = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in frame[c]])
        sizes = arrays("sizes", np.uint32)
        contexts, shorter = np.repeat(arrays("contexts", np.uint64), sizes), np.repeat(arrays("shorter", np.uint64), sizes)
        words, counts = arrays("words", np.uint64), arrays("counts", np.uint32).astype(np.int64)
        frame.drop(frame.index, inplace=True)
        keys = gram_key(contexts, words)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        counts = np.add.reduceat(counts[order], first)
        kept = order[first]
        keys, contexts, shorter, words = keys[kept], contexts[kept], shorter[kept], words[kept]
        _save(f"{folder}/{name}-keys-{bucket}", keys)
        _save(f"{folder}/{name}-counts-{bucket}", np.minimum(counts, 255).astype(np.uint8))
        large = np.flatnonzero(counts >= 255)
        _save(f"{folder}/{name}-large-{bucket}", np.column_stack([large, counts[large]]).astype(np.int64))
        out: list[tuple] = [("count", bucket, k, int((counts == k).sum()), 0, 0, 0) for k in (1, 2, 3, 4)]
        out.append(("size", bucket, 0, len(keys), int(counts.sum()), 0, 0))
        order = np.argsort(contexts, kind="stable")
        first = np.flatnonzero(np.append(True, contexts[order][1:] != contexts[order][:-1]))
        own, c = contexts[order][first], counts[order]
        stats = np.column_stack([np.add.reduceat(x, first) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))])
        heavy = _hit(hot, own)[1] | (own == NO_CONTEXT)
        _save(f"{folder}/{name}-contexts-{bucket}", own[~heavy])
        _save(f"{folder}/{name}-stats-{bucket}", stats[~heavy].astype(np.uint32))
        out += [("hot", bucket, int(k), *map(int, s)) for k, s in zip(own[heavy].view(np.int64), stats[heavy], strict=True)]
        rows = pd.DataFrame(out, columns=["kind", "bucket", "key", "a", "b", "c", "d"])
        rows["part"] = None
        if lower:
            short = shorter if level > 2 else np.full(len(words), NO_CONTEXT)
            below = np.full(len(words), NO_CONTEXT)
            to = _place(hot, short, gram_key(short, words), words, buckets)
            parts_ = [pd.DataFrame({"kind": "part", "bucket": b.column(1).to_pylist(), "key": level - 1, "a": 0, "b": 0, "c": 0, "d": 0, "part": [_one(b)]}) for b in _packed(level - 1, short, below, words, np.ones(len(words), np.int64), to)]
            rows = pd.concat([rows, *parts_], ignore_index=True)
        return rows

    return parts.groupBy("bucket").applyInPandas(merge, MERGED + ", part binary")


def _one(batch: pa.RecordBatch) -> bytes:
    """A packed row as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(merged: DataFrame) -> DataFrame:
    """The packed rows of the level below."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                with pa.ipc.open_stream(value.as_buffer()) as reader:
                    yield from reader

    return merged.filter("kind = 'part'").select("part").mapInArrow(read, PART)


def _level(parts: DataFrame, name: str, level: int, buckets: int, folder: str, lower: bool):
    """Merges, writes the heavy contexts' totals, and returns (merged rows, counts of counts, n-grams, sum, heavy totals)."""
    spark = parts.sparkSession
    path = new_path(spark, f"lm-{name}")
    _merge(parts, name, level, buckets, folder, lower).write.parquet(path)
    merged = spark.read.parquet(path)
    small = merged.filter("kind != 'part'").groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()
    of_counts = {r["key"]: r["a"] for r in small if r["kind"] == "count"}
    size = next(((r["a"], r["b"]) for r in small if r["kind"] == "size"), (0, 0))
    hot = {np.int64(r["key"]).view(np.uint64): (r["a"], r["b"], r["c"], r["d"]) for r in small if r["kind"] == "hot"}
    bottom = hot.pop(NO_CONTEXT, (0, 0, 0, 0))
    keys = np.array(sorted(hot), np.uint64)
    _save(f"{folder}/{name}-contexts-hot", keys)
    _save(f"{folder}/{name}-stats-hot", np.array([hot[k] for k in keys], np.int64).reshape(-1, 4))
    return merged, of_counts, size, bottom


def discounts(of_counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more; 0.75 where the counts of counts do not give one."""
    n1, n2, n3, n4 = (of_counts.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return (0.75, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def train(texts: DataFrame, order: int = 2) -> Model:
    """A model of the column ``text`` of ``texts``."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = texts.sparkSession
    texts = texts.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    folder = _folder(new_path(spark, "lm"))
    os.makedirs(folder, exist_ok=True)
    _, _, (vocabulary, tokens), _ = _level(_count(texts, 1, buckets, folder), "words", 1, buckets, folder, False)
    _save(f"{folder}/hot", _heavy_words(spark, folder, buckets, tokens))
    merged, of_counts, _, bottom = _level(_count(texts, order, buckets, folder), f"order{order}", order, buckets, folder, True)
    found = [discounts(of_counts)]
    for level in range(order - 1, 0, -1):
        merged, of_counts, _, bottom = _level(_unpacked(merged), f"order{level}", level, buckets, folder, level > 1)
        found.insert(0, discounts(of_counts))
    return Model(folder, order, buckets, tuple(found), tokens, vocabulary, tuple(bottom))


def _heavy_words(spark, folder: str, buckets: int, tokens: int) -> np.ndarray:
    """Contexts of one word, and START, that may fill a bucket: words with a bucket's share of all tokens, so fewer than there are buckets."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                more = _map(f"{folder}/words-large-{b}", np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(_map(f"{folder}/words-keys-{b}", np.uint64)[more[more[:, 1] * buckets >= tokens, 0]].view(np.int64))], names=["key"])

    # words are kept under their 1-gram key: contexts of one word have the same hash
    rows = spark.range(buckets).repartition(min(buckets, 64), "id").mapInArrow(heavy, "key bigint").collect()
    keys = [r["key"] for r in rows]
    start = gram_key(np.array([NO_CONTEXT]), np.array([START]))
    return np.unique(np.append(np.array(keys, np.int64).view(np.uint64), start))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words = Arrays(model.folder, "words", model.buckets)
        self.levels = [Arrays(model.folder, f"order{n}", model.buckets) for n in range(1, model.order + 1)]

    def _discount(self, level: int, counts: np.ndarray) -> np.ndarray:
        d = np.array((0.0, *self.model.discounts[level - 1]))
        return d[np.minimum(counts, 3)]

    def tokens(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token its count in training and its log10 probability."""
        m = self.model
        words, back = np.unique(tokens, return_inverse=True)
        none = np.full(len(words), NO_CONTEXT)
        seen = self.words.counts(none, words)[back]
        if not m.tokens:
            return seen, np.zeros(len(tokens))
        below = self.levels[0].counts(none, words)
        total, ones, twos, more = m.bottom
        d = m.discounts[0]
        rest = (d[0] * ones + d[1] * twos + d[2] * more) / max(total, 1)
        p = ((below - self._discount(1, below)) / max(total, 1) + rest / (m.vocabulary + 1))[back]
        for level, context in enumerate(_histories(tokens, counts, m.order)[1:], 2):
            arrays, d = self.levels[level - 1], m.discounts[level - 1]
            contexts, at = np.unique(context, return_inverse=True)
            stats = arrays.stats(contexts)[at]
            keys, first, again = np.unique(gram_key(context, tokens), return_index=True, return_inverse=True)
            found = arrays.counts(context[first], tokens[first])[again]
            known = stats[:, 0] > 0
            total = np.maximum(stats[:, 0], 1)
            p = np.where(known, (found - self._discount(level, found)) / total + stats[:, 1:] @ np.array(d) / total * p, p)
        return seen, np.log10(p)


_SCORERS: dict[str, Scorer] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every text; scores are log10 probabilities."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model.folder] = Scorer(model)
        scorer = _SCORERS[model.folder]
        whole = model.tokens + 0.1 * (model.vocabulary + 1)
        for batch in batches:
            row = 0
            for tokens, counts in text_tokens(batch.column(1)):
                seen, logs = scorer.tokens(tokens, counts)
                starts = np.cumsum(counts) - counts
                added = lambda x, starts=starts: np.add.reduceat(x, starts)
                columns = [batch.column(0).slice(row, len(counts)), counts, added((seen > 0).astype(np.int64)), added(np.log10((seen + 0.1) / whole)), added(logs)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                row += len(counts)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(scored, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def perplexity(scored: DataFrame) -> Column:
    """Per token, from the columns of ``score``."""
    return F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))


def score_held_out(docs: DataFrame, order: int = 2, parts: int = 10) -> DataFrame:
    """Every text scored by a model of the texts that are not held out."""
    model = train(docs.filter(~is_held_out(parts=parts)).select("text"), order)
    scored = score(docs, model)
    return scored.select(
        "doc_id", is_held_out(parts=parts).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
