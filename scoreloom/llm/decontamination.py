"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts.

Documents and test items are lowered and cut into words. Every ``window`` consecutive words of an item
are a pattern (a shorter item is one pattern). The patterns of all items go into one automaton, whose
letters spell the numbers of the benchmark's words; a word that no item has is a letter of its own, so the
automaton falls back to its root there. A document is scanned once, whole; matches are places of words,
which are mapped to code points of the original text.

The automaton is built in a task, written to the shared folder and loaded once by each Python worker. Its
size is bounded: items are dealt to as many automata of ``AUTOMATON_WORDS`` words as the benchmark needs
(one, for benchmarks of up to that size; only a longer item exceeds it). Where there are several, each
scans all documents, and the marked words and items of a document are united. Nothing is sent to the driver
but the number of the benchmark's words.

Null and empty texts have no words; a document without matches has no spans and the hash of the empty
string. Rows with equal document ids are rows of their own; test items with equal ids count as one, a null
item id is an empty string. An empty benchmark marks nothing, an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.arrow_words import numbered_words, split_words
from scoreloom.llm.common import LETTERS, new_path, stored, whole_text
from scoreloom.llm.language_model import _folder

WINDOW = 10
#: words of test items in an automaton, which takes up to 0.8 KB for each
AUTOMATON_WORDS = 500_000
#: a word's number is spelt with letters of this many bits, low bits first
LETTER_BITS = 8
SCANNED = "rid bigint, doc_id bigint, n_words bigint, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


class Windows:
    """An automaton over the windows of some test items, and the items of each window."""

    def __init__(self, names: pa.Array, texts: pa.Array, window: int):
        import ahocorasick

        parts = list(split_words(texts, LETTERS))
        codes, self.known = numbered_words([p.words for p in parts])
        counts = np.concatenate([p.counts for p in parts]) if parts else np.zeros(0, np.int64)
        self.letters = max(1, -(-len(self.known).bit_length() // LETTER_BITS))
        spelt = spell(codes + 1, self.letters)
        item, self.names = numbered_words([names])
        numbers: dict[tuple[int, ...], int] = {}
        pairs = set()
        lengths = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        at = 0
        for row, n in enumerate(counts.tolist()):
            long = min(window, n)
            for start in range(at, at + n - long + 1 if n else at):
                key = tuple(spelt[start : start + long].ravel().tolist())
                number = numbers.setdefault(key, len(numbers))
                if number == len(lengths):
                    lengths.append(long)
                    self.automaton.add_word(key, number)
                pairs.add((number, int(item[row])))
            at += n
        self.lengths = np.array(lengths, np.int64)
        held = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.bounds, self.items = np.searchsorted(held[:, 0], np.arange(len(lengths) + 1)), held[:, 1]
        if lengths:
            self.automaton.make_automaton()

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, number of the window) of every occurrence in a sequence of word numbers, 0 for unknown ones."""
        if not len(self.lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # only runs of known words that are long enough can hold a window; one unknown word ends a run
        known = codes > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.lengths.min()
        begin, end = begin[long], np.minimum(end[long] + 1, len(codes))
        sizes = end - begin
        places = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found = list(self.automaton.iter(tuple(spell(codes[places], self.letters).ravel().tolist())))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last, number = np.array(found, np.int64).T
        return places[last // self.letters], number


def spell(numbers: np.ndarray, letters: int) -> np.ndarray:
    """A row of letters per word number; letters of different places differ, so matches begin and end with words. 0 is spelt as 0 throughout."""
    shifts = LETTER_BITS * np.arange(letters)
    out = ((numbers[:, None] >> shifts) & ((1 << LETTER_BITS) - 1)) + 1 + (np.arange(letters) << LETTER_BITS)
    out[numbers == 0] = 0
    return out


_LOADED: dict[str, Windows] = {}


def _loaded(path: str) -> Windows:
    if path not in _LOADED:
        _LOADED.clear()
        with open(path, "rb") as f:
            _LOADED[path] = pickle.load(f)
    return _LOADED[path]


def build_automata(benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> list[str]:
    """Paths of the automata over the windows of ``benchmark`` (item_id, text)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), whole_text().alias("text")).distinct()
    # a word has a byte at least, and a byte beside it
    most = items.agg(F.sum(F.octet_length("text") + 1) / 2).first()[0] or 0
    shards = max(1, -(-int(most) // automaton_words))
    folder = _folder(new_path(benchmark.sparkSession, "automata"))
    os.makedirs(folder)

    def build(table: pa.Table) -> pa.Table:
        path = f"{folder}/{table.column('shard')[0].as_py()}"
        made = Windows(table.column("item_id").combine_chunks(), table.column("text").combine_chunks(), window)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            pickle.dump(made, f, pickle.HIGHEST_PROTOCOL)
        os.replace(part, path)
        return pa.table({"path": [path]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    built = dealt.groupBy("shard").applyInArrow(build, "path string")
    return [r["path"] for r in built.collect()]


def _spans(part, codes: np.ndarray, last: np.ndarray, length: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per text the maximal runs of marked words: places in the text, and code points of the original."""
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, last - length + 1, 1)
    np.add.at(change, last + 1, -1)
    marked = np.cumsum(change[:-1]) > 0
    # windows never leave a text, and runs are cut between texts
    bounds = np.concatenate([[0], np.cumsum(part.counts)])
    first = marked.copy()
    first[1:] &= ~marked[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(codes))]
    first[inner] = marked[inner]
    begin = np.flatnonzero(first)
    ends = np.append(begin[1:], len(codes))
    stop = begin + np.add.reduceat(marked.astype(np.int64), begin)
    stop = np.minimum(stop, ends) - 1
    points = np.cumsum((part.data & 0xC0) != 0x80)
    before = lambda at: np.where(at > 0, points[at - 1], 0)
    text = np.searchsorted(bounds, begin, "right") - 1
    base = before(part.starts[text])
    rows = zip(text.tolist(), (begin - bounds[text]).tolist(), (stop - bounds[text]).tolist(), (before(part.first[begin]) - base).tolist(), (before(part.end[stop]) - base).tolist())
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for row, *span in rows:
        out.setdefault(row, []).append(tuple(span))
    return out


def _scan(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (rid, doc_id, text) with their spans and items by one automaton."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _loaded(path)
        for batch in batches:
            for part in split_words(batch.column(2), LETTERS):
                distinct, spelt = numbered_words([part.words])
                numbers = pc.index_in(spelt, value_set=windows.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                codes = numbers[distinct]
                # texts are scanned one after the other, with an unknown word between them
                rows = part.rows
                apart = np.zeros(len(codes) + len(part.counts), np.int64)
                apart[np.arange(len(codes)) + rows] = codes
                last, number = windows.matches(apart)
                row = np.searchsorted(np.cumsum(part.counts + 1), last, "right")
                spans = _spans(part, codes, last - row, windows.lengths[number]) if len(last) else {}
                seen = np.unique(row * len(windows.lengths) + number) if len(last) else np.zeros(0, np.int64)
                items: dict[int, set[int]] = {}
                for r, w in zip((seen // max(1, len(windows.lengths))).tolist(), (seen % max(1, len(windows.lengths))).tolist()):
                    items.setdefault(r, set()).update(windows.items[windows.bounds[w] : windows.bounds[w + 1]].tolist())
                names = {r: sorted(windows.names[i].as_py() for i in found) for r, found in items.items()}
                n = len(part.counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.row, n), batch.column(1).slice(part.row, n), pa.array(part.counts, pa.int64()),
                        pa.array([[dict(zip(("first", "last", "start", "end"), s)) for s in spans.get(i, [])] for i in range(n)],
                                 pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")]))),
                        pa.array([names.get(i, []) for i in range(n)], pa.list_(pa.string())),
                    ],
                    names=["rid", "doc_id", "n_words", "spans", "items"],
                )

    return docs.mapInArrow(scan, SCANNED)


def _united(spans):
    """Runs of marked words of several automata as disjoint runs."""
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"] - 1),
        F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(
                F.try_element_at(done, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(done, F.lit(-1))["last"], s["last"]).alias("last"),
                F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(done, F.array(s)))
    kind = "array<struct<first:int,last:int,start:int,end:int>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), lambda done, s: step(done, s).cast(kind))


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document.

    ``spans``: maximal runs of words that windows of test items cover, as places of their first and last
    word and as code points (start, end) of the text; ``items``: ids of the items met, sorted.
    """
    paths = build_automata(benchmark, window, automaton_words)
    read = lambda df, rid: df.select(rid.alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    if len(paths) <= 1:
        rows = read(docs, F.lit(None).cast("bigint"))
        if not paths:
            paths = [_empty(docs, window)]
        return _scan(rows, paths[0]).drop("rid")
    rows = stored(read(docs, F.monotonically_increasing_id()), "passage-texts")
    found = reduce(DataFrame.unionByName, [_scan(rows, p) for p in paths])
    united = found.groupBy("rid", "doc_id", "n_words").agg(_united(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return united.drop("rid")


def _empty(docs: DataFrame, window: int) -> str:
    path = _folder(new_path(docs.sparkSession, "automaton"))
    with open(path, "wb") as f:
        pickle.dump(Windows(pa.array([], pa.string()), pa.array([], pa.string()), window), f)
    return path


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document how many words are hit and by which items."""
    found = find_passages(docs, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["last"] - s["first"] + 1).cast("bigint"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def without_passages(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int = WINDOW) -> DataFrame:
    """``columns`` of the documents in which no window of a test item occurs; null ids are kept with the clean."""
    bad = find_passages(docs, benchmark, window).filter(F.size("spans") > 0).select("doc_id").distinct()
    return docs.select(*columns).join(bad, "doc_id", "left_anti")
