"""Phrase collocations by the stripes pattern.

Words are cut from whole texts per language. In a task every prefix of two words keys a stripe: an
associative counter of the words that follow it, with an entry of its own (``END``) for occurrences that
end their piece, so that each occurrence of a prefix is in its stripe once. The empty prefix has a stripe
as well, the counter of all words. Stripes of one prefix are merged elementwise. A merged stripe then gives
all that is asked of the prefix: its entries are the counts of the extensions, its total is the count of
the prefix, and its largest entry says by how much one extension subsumes it. Nothing else is counted.

A prefix is merged in one task, where what is too rare is dropped at once, unless it has more following
words in some task's stripe than ``_limits`` allows. Such a stripe is dealt to parts by following word, each with a mark
(an entry of no occurrences) that says so; its merged parts are kept whole and added up by Spark. Tasks
combine before they send, so a prefix costs its distinct entries a task however often it occurs. A
bucket holds what about ``BUCKET_BYTES`` of text give.

Counts are exact; scores are computed in decimals, as products may pass 64 bits. Null languages are
``und``, null and empty texts have no words, repeated rows count again, an empty table gives no rows.
Extra columns are not read. Words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.arrow_words import numbered_words, split_words, string_hashes
from scoreloom.llm.common import mix, stored, text_buffers, whole_text

#: bytes that end a piece, and with them blanks the bytes that end a word
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
#: words counted before a task sends its stripes on
FLUSH_WORDS = 750_000
BUCKET_BYTES = 6 << 20
LEAST_BUCKETS = 16
#: entries of one prefix that a bucket may get
ENTRIES = 2_000_000
#: most following words of a stripe that is sent in one piece, and least parts of one that is not
WIDE, PARTS = 256, 64
#: lists of words are one text each, a line a word and an empty line for none; lists of numbers are their bytes; all compressed
STRIPES = "lang string, bucket int, first binary, second binary, width binary, following binary, count binary"
MERGED = "lang string, first string, second string, third string, count bigint, most bigint, whole boolean"
#: the score of a cut, as a whole number
SCALE = 1_000_000


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _packed(lines: pa.Array, numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of words as compressed texts; ``lines``: the words by number, each with the end of its line."""
    data, at = text_buffers(lines.take(pa.array(numbers, pa.int64())))
    squeeze = zstandard.ZstdCompressor(1).compress
    cuts = at[np.concatenate([[0], ends])].tolist()
    return pa.array([squeeze(data[a : b - 1].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.binary())


def _packed_numbers(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw = numbers.astype("<i4")
    squeeze = zstandard.ZstdCompressor(1).compress
    return pa.array([squeeze(raw[a:b].tobytes()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.binary())


def _lines(column: pa.ChunkedArray) -> pa.Array:
    """The words of all rows of ``_packed``."""
    spread = zstandard.ZstdDecompressor().decompress
    texts = pa.array([spread(x.as_buffer()) for x in column], pa.large_binary()).cast(pa.large_string())
    return pc.split_pattern(texts, "\n").flatten()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    spread = zstandard.ZstdDecompressor().decompress
    return np.concatenate([np.frombuffer(spread(x.as_buffer()), "<i4") for x in column])


def _limits(total_bytes: int) -> tuple[int, int, int]:
    """Buckets, most entries of a stripe sent in one piece, and parts of a larger one, for a text of so many bytes.

    No bucket gets more than about ``ENTRIES`` entries of one prefix, whatever its share of the text.
    """
    flushes = 1 + total_bytes // (4 * FLUSH_WORDS)
    return max(LEAST_BUCKETS, -(-total_bytes // BUCKET_BYTES)), max(1, min(WIDE, ENTRIES // flushes)), max(PARTS, flushes * FLUSH_WORDS // (2 * ENTRIES))


def _stripes(langs: list[pa.Array], lang_of: list[np.ndarray], words: list[pa.Array], left: list[np.ndarray], buckets: int, wide: int, parts: int) -> pa.RecordBatch:
    """The stripes of the words of some texts, by language and bucket; ``left``: words after a word in its piece, 2 for more."""
    codes, known = numbered_words(words)
    tongues, names = numbered_words(langs)
    lang, left = tongues[np.concatenate(lang_of)], np.concatenate(left)
    size = len(known)
    after = np.append(codes[1:], size)
    # no word has the number after the last word's
    third = np.where(left > 1, np.append(after[1:], size), size)
    prefix = (lang * (size + 1) + codes) * (size + 1) + np.where(left > 0, after, size)
    distinct, back = np.unique(prefix, return_inverse=True)
    entry, count = np.unique(back * (size + 1) + third, return_counts=True)
    stripe, third = np.divmod(entry, size + 1)
    del prefix, back, entry, after, left
    single, often = np.unique(lang * (size + 1) + codes, return_counts=True)
    empty = np.unique(single // (size + 1))
    # stripes of empty prefixes have numbers after the others'
    lang_at, first = np.divmod(np.concatenate([distinct // (size + 1), empty * (size + 1) + size]), size + 1)
    second = np.concatenate([distinct % (size + 1), np.full(len(empty), size)])
    names_of = names.cast(pa.string()).take(pa.array(lang_at, pa.int64()))
    hashes = np.append(string_hashes(known), np.uint64(0))
    spread = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        base = mix(mix(string_hashes(names)[lang_at] + hashes[first]) + hashes[second])
        split = np.bincount(stripe, minlength=len(distinct)) > wide
        large = split[stripe]
        part = np.where(large, 1 + (mix(hashes[third]) % np.uint64(parts)), 0).astype(np.uint64)
        # a mark in every part of a split stripe, and where it would be in one piece
        marks = np.unique(np.stack([stripe[large], part[large].astype(np.int64)], axis=1), axis=0)
        marks = np.concatenate([marks, np.stack([np.flatnonzero(split), np.zeros(int(split.sum()), np.int64)], axis=1)])
        alone = len(distinct) + np.searchsorted(empty, single // (size + 1))
        word = single % (size + 1)
        at = mix(np.concatenate([base[stripe] + part * spread, base[marks[:, 0]] + marks[:, 1].astype(np.uint64) * spread, base[alone] + hashes[word]]))
    stripe = np.concatenate([stripe, marks[:, 0], alone])
    third = np.concatenate([third, np.full(len(marks), size), word])
    count = np.concatenate([count, np.zeros(len(marks), np.int64), often])
    row = lang_at[stripe] * buckets + (at % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((third, stripe, row))
    stripe, third, count, row = stripe[order], third[order], count[order], row[order]
    # a row a language and bucket, in it a stripe a prefix
    row_heads = _runs(row)
    heads = np.union1d(_runs(stripe), row_heads)
    owner = stripe[heads]
    lines = pc.binary_join_element_wise(pa.concat_arrays([known, pa.array([""], pa.large_string())]), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    stripe_ends = np.append(np.searchsorted(heads, row_heads[1:]), len(heads))
    entry_ends = np.append(row_heads[1:], len(stripe))
    return pa.RecordBatch.from_arrays(
        [
            names_of.take(pa.array(stripe[row_heads], pa.int64())), pa.array(row[row_heads] % buckets, pa.int32()),
            _packed(lines, first[owner], stripe_ends), _packed(lines, second[owner], stripe_ends),
            _packed_numbers(np.diff(np.append(heads, len(stripe))), stripe_ends),
            _packed(lines, third, entry_ends), _packed_numbers(count, entry_ends),
        ],
        names=["lang", "bucket", "first", "second", "width", "following", "count"],
    )


def _merge(lang: str, table: pa.Table, least: int) -> pa.Table:
    """The stripes of a bucket merged elementwise, as rows of ``MERGED``; rare words, prefixes and entries are left out where all of them is here."""
    lists = [_lines(table.column(name)) for name in ("first", "second", "following")]
    codes, known = numbered_words(lists)
    size = len(known)
    none = pc.index(known, "").as_py()
    codes[codes == none] = size
    n = len(lists[0])
    prefixes, back = np.unique(codes[:n] * (size + 1) + codes[n : 2 * n], return_inverse=True)
    key = np.repeat(back, _numbers(table.column("width"))) * (size + 1) + codes[2 * n :]
    sent = _numbers(table.column("count"))
    split = np.zeros(len(prefixes), bool)
    split[key[sent == 0] // (size + 1)] = True
    order = np.argsort(key, kind="stable")
    heads = _runs(key[order])
    count = np.add.reduceat(sent[order].astype(np.int64), heads)
    stripe, third = np.divmod(key[order][heads], size + 1)
    stripes = _runs(stripe)
    total = np.add.reduceat(count, stripes)
    most = np.maximum.reduceat(np.where(third < size, count, 0), stripes)
    first, second = np.divmod(prefixes, size + 1)
    whole = ~split
    # all words together, words, prefixes, extensions
    empty, alone = first == size, (first == size)[stripe] & (count >= least)
    two = (second < size) & (split | (total >= least))
    three = ~empty[stripe] & (third < size) & (split[stripe] | (count >= least))
    blank = lambda mask: np.full(int(mask.sum()), size)
    zero = lambda mask: np.zeros(int(mask.sum()), np.int64)
    columns = [
        np.concatenate([blank(empty), third[alone], first[two], first[stripe[three]]]),
        np.concatenate([blank(empty), blank(alone), second[two], second[stripe[three]]]),
        np.concatenate([blank(empty), blank(alone), blank(two), third[three]]),
    ]
    counts = np.concatenate([total[empty], count[alone], total[two], count[three]])
    spelt = pa.concat_arrays([known.cast(pa.string()), pa.array([None], pa.string())])
    return pa.table(
        [pa.array([lang] * len(counts), pa.string()), *[spelt.take(pa.array(c, pa.int64())) for c in columns], pa.array(counts, pa.int64()),
         pa.array(np.concatenate([zero(empty), zero(alone), most[two], zero(three)]), pa.int64()),
         pa.array(np.concatenate([zero(empty) == 0, zero(alone) == 0, whole[two], whole[stripe[three]]]), pa.bool_())],
        names=["lang", "first", "second", "third", "count", "most", "whole"],
    )


def merged_stripes(docs: DataFrame, least: int) -> DataFrame:
    """Rows (lang, first, second, third, count, most, whole): words, prefixes with their largest extension, extensions, and all words (no ``first``).

    Rows that are ``whole`` are final and hold no count below ``least``; others are of the parts of a prefix and add up.
    """
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text")
    total = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    limits = _limits(total)
    flush = FLUSH_WORDS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, lang_of, words, left, rows, held = [], [], [], [], 0, 0
        for batch in batches:
            for part in split_words(batch.column(1), _WORD):
                n = len(part.first)
                piece = np.cumsum(_ENDS[part.data])[part.first] if n else np.zeros(0, np.int64)
                linked = np.zeros(n + 1, bool)
                linked[: max(0, n - 1)] = (piece[1:] == piece[:-1]) & (np.diff(part.rows) == 0)
                langs.append(batch.column(0).slice(part.row, len(part.counts)))
                lang_of.append(part.rows + rows)
                words.append(part.words)
                left.append(linked[:-1].astype(np.int8) + (linked[:-1] & linked[1:]))
                rows, held = rows + len(part.counts), held + n
                if held >= flush:
                    yield _stripes(langs, lang_of, words, left, *limits)
                    langs, lang_of, words, left, rows, held = [], [], [], [], 0, 0
        if held:
            yield _stripes(langs, lang_of, words, left, *limits)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return _merge(key[0].as_py(), table, least)

    # a partition a few buckets, whatever the configured number, so that tasks do not grow with the input
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-limits[0] // 4))
    sent = docs.select(lang, text).mapInArrow(send, STRIPES).repartition(partitions, "bucket")
    return stored(sent.groupBy("lang", "bucket").applyInArrow(merge, MERGED), "stripes")


def _cut(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE * a * a / (l * r)), exactly."""
    wide = lambda c: c.cast("decimal(18,0)").cast("decimal(38,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * wide(a) * wide(a), wide(l) * wide(r))


def collocations(docs: DataFrame, least: int = 10, share: tuple[int, int] = (50, 100), top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language.

    A phrase of at least ``least`` occurrences is scored by its weakest cut; one that is inside a longer
    frequent phrase with ``share`` of its occurrences is dropped.
    """
    merged = merged_stripes(docs, least)
    n = merged.filter("first IS NULL").groupBy("lang").agg(F.sum("count").alias("all"))
    words = merged.filter("first IS NOT NULL AND second IS NULL").select("lang", "first", F.col("count").alias("n"))
    # parts of split stripes add up; whole rows stay as they are
    parts = merged.filter(~F.col("whole"))
    three_of = parts.filter("third IS NOT NULL").groupBy("lang", "first", "second", "third").agg(F.sum("count").alias("a")).filter(F.col("a") >= least)
    triples = merged.filter("whole AND third IS NOT NULL").select("lang", "first", "second", "third", F.col("count").alias("a")).unionByName(three_of)
    most = triples.groupBy("lang", "first", "second").agg(F.max("a").alias("most"))
    two_of = parts.filter("third IS NULL").groupBy("lang", "first", "second").agg(F.sum("count").alias("a")).filter(F.col("a") >= least)
    two_of = two_of.join(most, ["lang", "first", "second"], "left").withColumn("most", F.coalesce("most", F.lit(0).cast("bigint")))
    pairs = merged.filter("whole AND second IS NOT NULL AND third IS NULL").select("lang", "first", "second", F.col("count").alias("a"), "most").unionByName(two_of)
    pairs = stored(pairs, "collocation-pairs")
    word = lambda place, out: words.select(F.col("lang"), F.col("first").alias(place), F.col("n").alias(out))
    pair = lambda one, two, out: pairs.select("lang", F.col("first").alias(one), F.col("second").alias(two), F.col("a").alias(out))

    # the largest extension to the right is in the stripe; those to the left are entries of other stripes
    before = triples.groupBy("lang", F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("a").alias("led"))
    longest = F.greatest("most", F.coalesce("led", F.lit(0)))
    inside = (longest >= least) & (longest * share[1] >= F.col("a") * share[0])
    two = pairs.join(before, ["lang", "first", "second"], "left").filter(~inside).join(word("first", "l"), ["lang", "first"]).join(word("second", "r"), ["lang", "second"])
    two = two.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", _cut(F.col("a"), F.col("l"), F.col("r")).alias("score"))

    three = triples.join(pair("first", "second", "l2"), ["lang", "first", "second"]).join(pair("second", "third", "r1"), ["lang", "second", "third"])
    three = three.join(word("first", "l1"), ["lang", "first"]).join(word("third", "r2"), ["lang", "third"])
    cut = lambda k: F.struct(_cut(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    three = three.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", F.least(cut(1), cut(2)).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))
    every = two.unionByName(three).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # the best of each part of a language first, so that no task sorts a whole language
    best = every.withColumn("rank", place("_part")).filter(F.col("rank") <= top).withColumn("rank", place()).filter(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
