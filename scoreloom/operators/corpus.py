"""Corpus and alignment metrics.

n-gram metrics put the texts of a pair on one partition once (``repartition`` by the pair id) and
count grams there: the gram rows, many times the text, are never shuffled, and character grams are no
rows at all. Block alignment works inside the row that holds a page's blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scoreloom.functions.bitwise import Packed, mutual_best
from scoreloom.functions.bitwise import common_subsequence as _lcs
from scoreloom.functions.text import bound, has_cjk, ocr_tokens, words


def characters(s: Column) -> Column:
    """Characters without white space."""
    return F.filter(F.split(F.regexp_replace(s, r"\s+", ""), ""), lambda c: c != "")


def text_tokens(s: Column) -> Column:
    """Words, or characters for Chinese text."""
    return F.when(has_cjk(s), characters(s)).otherwise(words(s))


def _windows(tokens: Column, n: int, sep: str) -> Column:
    """For every position the next ``n`` tokens as one string; shorter ones at the end."""
    return bound(tokens, lambda t: F.transform(t, lambda _, i: F.array_join(F.slice(t, i + 1, n), sep)))


def spread(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows over all shuffle partitions: for small texts that cause much work per row.

    The number is explicit, so adaptive execution does not fold the partitions by their byte size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ids)


def gram_counts(pairs: DataFrame, ids: Sequence[str], hyp: Column, ref: Column, max_n: int, sep: str = " ") -> DataFrame:
    """Counts (ids, n, gram, h, r) of both sides of every pair; ``hyp`` and ``ref`` are token arrays.

    Tokens joined by "" must be single characters, others must not hold ``sep``.
    """
    side = lambda tokens, h, r: F.struct(
        _windows(tokens, max_n, sep).alias("w"), F.lit(h).alias("h"), F.lit(r).alias("r"))
    sides = spread(pairs, ids).select(*ids, F.inline(F.array(side(hyp, 1, 0), side(ref, 0, 1))))
    spots = sides.select(*ids, "h", "r", F.explode("w").alias("w"))
    held = F.length("w") if sep == "" else F.length("w") - F.length(F.replace("w", F.lit(sep), F.lit(""))) + 1
    orders = spots.select(*ids, "h", "r", "w", F.explode(F.sequence(F.lit(1), held)).alias("n"))
    gram = F.col("w").substr(F.lit(1), F.col("n")) if sep == "" else F.call_function("substring_index", F.col("w"), F.lit(sep), F.col("n"))
    return orders.select(*ids, "n", gram.alias("gram"), "h", "r").groupBy(*ids, "n", "gram").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))


def gram_overlap(counts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per pair and order: hypothesis, reference and matching gram counts."""
    return counts.groupBy(*ids, "n").agg(F.sum("h").alias("h"), F.sum("r").alias("r"), F.sum(F.least("h", "r")).alias("m"))


def _gram_stats(hyps: pa.Array, refs: pa.Array, order: int) -> np.ndarray:
    """(order, pair, 3): character n-grams of both sides of every pair and those they share, as multisets.

    A gram is a number: that of the gram without its last character, times the alphabet, plus the last.
    """
    pairs = len(hyps)
    texts = [*hyps.to_pylist(), *refs.to_pylist()]
    _, chars = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    lengths = np.array([len(t) for t in texts], np.int64)
    text_of = np.repeat(np.arange(2 * pairs), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
    base = int(chars.max()) + 1 if len(chars) else 1
    at, grams, bound = np.arange(len(chars)), chars.astype(np.int64), base
    out = np.zeros((order, pairs, 3), np.int64)
    for n in range(1, order + 1):
        if n > 1:
            stays = left[at] >= n
            at = at[stays]
            if bound > (1 << 62) // (base * max(1, pairs)):
                known, grams = np.unique(grams, return_inverse=True)
                bound = len(known)
            grams, bound = grams[stays] * base + chars[at + n - 1], bound * base
        side = text_of[at] >= pairs
        pair = text_of[at] % max(1, pairs)
        keys = grams * pairs + pair
        (ours, many), (theirs, others) = (np.unique(keys[s], return_counts=True) for s in (~side, side))
        _, i, j = np.intersect1d(ours, theirs, assume_unique=True, return_indices=True)
        out[n - 1, :, 0], out[n - 1, :, 1] = np.bincount(pair[~side], minlength=pairs), np.bincount(pair[side], minlength=pairs)
        out[n - 1, :, 2] = np.bincount(ours[i] % max(1, pairs), np.minimum(many[i], others[j]), minlength=pairs)
    return out


def character_overlap(pairs: DataFrame, ids: Sequence[str], hyp: Column, ref: Column, order: int) -> DataFrame:
    """Per pair and order up to ``order``: character grams of the hypothesis (h), the reference (r) and shared (m); white space left out.

    Grams stay inside the task, as sorted arrays of numbers over some pairs at a time. Orders that neither side has give no row.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    sides = spread(pairs, ids).select(*ids, bare(hyp).alias("_hyp"), bare(ref).alias("_ref"))
    schema = StructType([*sides.schema.fields[: len(ids)], *StructType.fromDDL("n int, h bigint, r bigint, m bigint").fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                stats = _gram_stats(part.column(len(ids)), part.column(len(ids) + 1), order)
                n, row = np.nonzero(stats[:, :, 0] + stats[:, :, 1])
                columns = [part.column(c).take(pa.array(row, pa.int64())) for c in range(len(ids))]
                columns += [pa.array(n + 1, pa.int32()), *[pa.array(stats[n, row, k], pa.int64()) for k in range(3)]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return sides.mapInArrow(count, schema)


def _f_beta(stats: DataFrame, keys: Sequence[str], beta: float) -> DataFrame:
    """chrF of summed (h, r, m) per order: averages over the orders both sides have."""
    used = (F.col("h") > 0) & (F.col("r") > 0)
    p, r = F.avg(F.when(used, F.col("m") / F.col("h"))), F.avg(F.when(used, F.col("m") / F.col("r")))
    b = beta * beta
    score = F.coalesce(F.try_divide(100.0 * (1 + b) * p * r, b * p + r), F.lit(0.0))
    return stats.groupBy(*keys).agg(F.round(score, 6).alias("chrf"))


def chrf_sentence(pairs: DataFrame, ids: Sequence[str], hyp: str, ref: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    return _f_beta(character_overlap(pairs, ids, F.col(hyp), F.col(ref), order), ids, beta)


def chrf_corpus(pairs: DataFrame, ids: Sequence[str], views: Mapping[str, tuple[Column, Column]], order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF per view (name -> (hypothesis, reference)): counts are summed before the ratio."""
    rows = F.array(*[F.struct(F.lit(k).alias("view"), h.alias("hyp"), r.alias("ref")) for k, (h, r) in views.items()])
    flat = pairs.select(*ids, F.inline(rows))
    keys = [*ids, "view"]
    overlap = character_overlap(flat, keys, F.col("hyp"), F.col("ref"), order)
    sums = overlap.groupBy("view", "n").agg(*[F.sum(c).alias(c) for c in ("h", "r", "m")])
    return _f_beta(sums, ["view"], beta)


def bleu_references(pairs: DataFrame, ids: Sequence[str], hyp: str, refs: str, max_n: int = 4) -> DataFrame:
    """Corpus BLEU-1 to BLEU-``max_n`` with any number of references per pair (an array of texts).

    A gram counts at most as often as in the reference that has it most; the reference length of a
    pair is the one closest to the hypothesis, the shorter of two.
    """
    sides = F.concat(F.array(F.struct(F.lit(-1).alias("side"), F.col(hyp).alias("text"))), F.transform(refs, lambda t, i: F.struct(i.alias("side"), t.alias("text"))))
    texts = spread(pairs, ids).select(*ids, F.inline(sides)).withColumn("w", words(F.coalesce("text", F.lit(""))))
    lengths = texts.groupBy(*ids).agg(
        F.max(F.when(F.col("side") == -1, F.size("w"))).alias("h"), F.collect_list(F.when(F.col("side") >= 0, F.size("w"))).alias("refs"))
    closest = F.array_min(F.transform("refs", lambda r: F.struct(F.abs(r - F.col("h")).alias("d"), r.alias("r"))))["r"]
    sizes = lengths.agg(F.sum("h").alias("hl"), F.sum(closest).alias("rl")).select(F.lit(0).alias("n"), F.col("hl").alias("h"), F.col("rl").alias("m"))
    spots = texts.select(*ids, "side", F.explode(_windows(F.col("w"), max_n, " ")).alias("w"))
    held = F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) + 1
    grams = spots.select(*ids, "side", "w", F.explode(F.sequence(F.lit(1), held)).alias("n")).select(*ids, "side", "n", F.call_function("substring_index", F.col("w"), F.lit(" "), F.col("n")).alias("gram"))
    counts = grams.groupBy(*ids, "n", "gram", "side").agg(F.count("*").alias("c"))
    best = counts.groupBy(*ids, "n", "gram").agg(F.coalesce(F.max(F.when(F.col("side") == -1, F.col("c"))), F.lit(0)).alias("h"), F.coalesce(F.max(F.when(F.col("side") >= 0, F.col("c"))), F.lit(0)).alias("r"))
    sums = best.groupBy("n").agg(F.sum("h").alias("h"), F.sum(F.least("h", "r")).alias("m"))
    # the lengths go along as order 0
    parts = sums.unionByName(sizes).select(F.explode(F.sequence(F.greatest("n", F.lit(1)), F.lit(max_n))).alias("order"), "n", "h", "m")
    matched, whole = (F.col("n") > 0) & (F.col("m") > 0), lambda c: F.max(F.when(F.col("n") == 0, F.col(c)))
    orders = parts.groupBy("order").agg(
        F.avg(F.when(matched, F.log(F.col("m") / F.col("h")))).alias("p"), F.count(F.when(matched, 1)).alias("seen"), whole("h").alias("hl"), whole("m").alias("rl"))
    brevity = F.when(F.col("hl") >= F.col("rl"), 1.0).otherwise(F.exp(1.0 - F.col("rl") / F.col("hl")))
    return orders.select(
        F.concat(F.lit("bleu_"), F.col("order").cast("string")).alias("metric"), F.round(F.when(F.col("seen") == F.col("order"), brevity * F.exp("p")).otherwise(0.0), 6).alias("value"))


def bleu(pairs: DataFrame, ids: Sequence[str], hyp: str, ref: str, group: Sequence[str], max_n: int = 4) -> DataFrame:
    """Corpus BLEU per group and over all: clipped precisions, brevity penalty, no smoothing."""
    keys = [*ids, *[g for g in group if g not in ids]]
    counts = gram_counts(pairs, keys, words(F.col(hyp)), words(F.col(ref)), max_n)
    finest = gram_overlap(counts, keys).groupBy(*group, "n").agg(*[F.sum(c).alias(c) for c in ("h", "r", "m")])
    label = F.concat_ws("/", *[F.col(g).cast("string") for g in group])
    sums = finest.select(F.explode(F.array(label, F.lit("ALL"))).alias("group"), "n", "h", "r", "m").groupBy("group", "n").agg(
        *[F.sum(c).alias(c) for c in ("h", "r", "m")])
    logs = F.when(F.col("m") > 0, F.log(F.col("m") / F.col("h")))
    first = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    folded = sums.groupBy("group").agg(F.avg(logs).alias("p"), F.count(logs).alias("orders"), first("h").alias("hl"), first("r").alias("rl"))
    brevity = F.when(F.col("hl") >= F.col("rl"), 1.0).otherwise(F.exp(1.0 - F.col("rl") / F.col("hl")))
    return folded.select("group", F.round(F.when(F.col("orders") == max_n, brevity * F.exp("p")).otherwise(0.0), 6).alias("bleu"),
                         F.col("hl").alias("hyp_length"), F.col("rl").alias("ref_length"))


def gleu(pairs: DataFrame, ids: Sequence[str], hyp: str, ref: str, max_n: int = 4) -> DataFrame:
    """n-gram matches over the larger of the two n-gram totals."""
    counts = gram_counts(pairs, ids, text_tokens(F.col(hyp)), text_tokens(F.col(ref)), max_n)
    share = F.try_divide(F.sum(F.least("h", "r")), F.greatest(F.sum("h"), F.sum("r")))
    return counts.groupBy(*ids).agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("gleu"))


def _rouge_words(s: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def rouge_1(pairs: DataFrame, ids: Sequence[str], hyp: str, ref: str, tokens=_rouge_words) -> DataFrame:
    """Unigram F1; a pair without words on either side scores 0."""
    counts = gram_counts(pairs, ids, tokens(F.col(hyp)), tokens(F.col(ref)), 1)
    m, h, r = F.sum(F.least("h", "r")), F.sum("h"), F.sum("r")
    scored = counts.groupBy(*ids).agg(F.round(2.0 * m / (h + r), 6).alias("rouge1"))
    return pairs.select(*ids).join(scored, list(ids), "left").fillna(0.0, ["rouge1"])


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, in Arrow batches."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_lcs(p, q) for p, q in zip(x, y)], dtype="int64")

    return F.pandas_udf(batch, "long")(a, b)


def rouge_l(pairs: DataFrame, ids: Sequence[str], hyp: str, ref: str, beta: float = 1.2) -> DataFrame:
    """LCS-based F-score of the words; a long-text helper runs in Arrow batches."""
    return rouge_l_references(pairs.withColumn(ref, F.array(F.coalesce(ref, F.lit("")))), ids, hyp, ref, beta)


def rouge_l_references(pairs: DataFrame, ids: Sequence[str], hyp: str, refs: str, beta: float = 1.2) -> DataFrame:
    """ROUGE-L with any number of references (an array of texts): the best precision and the best recall over them make the F-score.

    An item without references, or whose words none of them shares, scores 0. The corpus value is the mean (``corpus_mean``).
    """
    tokens = spread(pairs, ids).select(*ids, words(F.coalesce(hyp, F.lit(""))).alias("_h"), F.posexplode_outer(refs).alias("_n", "_ref"))
    scored = tokens.withColumn("_r", words(F.coalesce("_ref", F.lit("")))).withColumn("_l", lcs_length(F.col("_h"), F.col("_r")))
    sides = scored.select(*ids, F.try_divide(F.col("_l"), F.size("_h")).alias("_p"), F.try_divide(F.col("_l"), F.size("_r")).alias("_q"))
    best = sides.groupBy(*ids).agg(F.max("_p").alias("p"), F.max("_q").alias("r"))
    p, r = F.col("p"), F.col("r")
    value = F.try_divide((1 + beta * beta) * p * r, r + beta * beta * p)
    return best.select(*ids, F.round(F.coalesce(value, F.lit(0.0)), 6).alias("rouge_l"))


def corpus_mean(scores: DataFrame, score: str) -> DataFrame:
    """The corpus value of a sentence score: its mean over all items, and their number."""
    return scores.agg(F.round(F.avg(score), 6).alias(score), F.count("*").alias("items"))


#: had set how many grams are told apart as hot; a gram has a row a block now, and nothing reads this
HOT_GRAMS = 4096
#: bytes of text whose grams one task numbers at a time
CIDER_BLOCK_BYTES = 2 << 20


def _block_grams(table: pa.Table, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(text, gram number) of every gram of a block and the grams by number, for each order.

    Texts are the rows' hypotheses, then their references. Numbers follow from the words of the block,
    not from the order of its rows.
    """
    sides = [table.column(c).combine_chunks() for c in ("_h", "_r")]
    lengths = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in sides]).astype(np.int64)
    coded = pa.concat_arrays([x.flatten().cast(pa.large_string()) for x in sides]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, words_ = place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    at, grams, names = np.arange(len(codes)), codes, words_
    for n in range(1, max_n + 1):
        if n > 1:
            stays = left[at] >= n
            at = at[stays]
            known, grams = np.unique(grams[stays] * len(words_) + codes[at + n - 1], return_inverse=True)
            take = lambda of, numbers: of.take(pa.array(numbers, pa.int64()))
            names = pc.binary_join_element_wise(take(names, known // max(1, len(words_))), take(words_, known % max(1, len(words_))), pa.scalar(" ", pa.large_string()))
        yield text_of[at], grams, names


def _numbers(table: pa.Table, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of every row's key, and the first row of each key."""
    seen: dict[tuple, int] = {}
    numbers = np.array([seen.setdefault(k, len(seen)) for k in zip(*[table.column(c).to_pylist() for c in columns], strict=True)], np.int64)
    return numbers, np.unique(numbers, return_index=True)[1]


def cider(pairs: DataFrame, ids: Sequence[str], hyp: str, refs: str, max_n: int = 4, sigma: float = 6.0) -> DataFrame:
    """TF-IDF n-gram similarity (x 10), document frequency over the whole reference corpus.

    ``refs`` is an array of references; the score of an item is the mean over them. Items are dealt to blocks of
    about ``CIDER_BLOCK_BYTES`` of text. A block sends each of its distinct grams once, with the number of its items
    that have it in a reference, and gets back the document frequencies above one; grams of single items stay in it.
    A gram has at most one row a block, so none fills a task.
    """
    size = F.octet_length(hyp) * F.size(refs) + F.octet_length(F.array_join(refs, ""))
    whole = pairs.agg(F.log(F.count("*").cast("double")).alias("n"), F.sum(size).alias("bytes")).first()
    blocks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(whole["bytes"] or 0) // CIDER_BLOCK_BYTES))
    keys = [*ids, "ref_no"]
    texts = pairs.select(F.pmod(F.xxhash64(*ids), F.lit(blocks)).alias("_block"), *ids, hyp, F.posexplode(refs).alias("ref_no", "ref"))
    texts = spread(texts, ["_block"]).select("_block", *keys, words(F.lower(hyp)).alias("_h"), words(F.lower("ref")).alias("_r"))

    def sent(key: tuple, table: pa.Table) -> pa.Table:
        item, _ = _numbers(table, ids)
        slots, names, counts = 0, [], []
        for text, gram, known in _block_grams(table, max_n):
            refs_ = text >= len(item)
            held = np.unique(item[text[refs_] - len(item)] * max(1, len(known)) + gram[refs_])
            counts.append(np.bincount(held % max(1, len(known)), minlength=len(known)))
            names.append(known)
            slots += len(known)
        return pa.table({"_block": pa.array(np.full(slots, key[0].as_py(), np.int64)), "slot": pa.array(np.arange(slots), pa.int32()),
                         "gram": pa.concat_arrays(names).cast(pa.string()), "df": pa.array(np.concatenate(counts), pa.int64())})

    def score(table: pa.Table, frequent: pa.Table) -> pa.Table:
        item, first = _numbers(table, keys)
        log_df = np.zeros(int(pc.max(frequent.column("slot")).as_py()) + 1 if frequent.num_rows else 0)
        log_df[frequent.column("slot").to_numpy()] = frequent.column("log_df").to_numpy()
        items, slots = len(first), 0
        total, gap, seen = np.zeros(items), np.zeros(items, np.int64), np.zeros(items, bool)
        for n, (text, gram, known) in enumerate(_block_grams(table, max_n), 1):
            logs = np.zeros(len(known))
            mine = log_df[slots : slots + len(known)]
            logs[: len(mine)] = mine
            slots += len(known)
            ref = text >= len(item)
            entries, entry = np.unique(item[text % max(1, len(item))] * max(1, len(known)) + gram, return_inverse=True)
            h, r = (np.bincount(entry[side], minlength=len(entries)) for side in (~ref, ref))
            at, number = np.divmod(entries, max(1, len(known)))
            vh, vr = h * (whole["n"] - logs[number]), r * (whole["n"] - logs[number])
            add = lambda values: np.bincount(at, values, minlength=items)
            norms = np.sqrt(add(vh * vh)) * np.sqrt(add(vr * vr))
            total += np.divide(add(np.minimum(vh, vr) * vr), norms, out=np.zeros(items), where=norms != 0)
            if n == 1:
                seen[at] = True
            if n == 2:
                # the length penalty uses the number of bigrams of both sides
                gap = add(h - r).astype(np.int64)
        at = np.flatnonzero(seen)
        out = table.select(keys).take(pa.array(first[at], pa.int64()))
        return out.append_column("total", pa.array(total[at])).append_column("gap", pa.array(gap[at], pa.int64()))

    grams = texts.groupBy("_block").applyInArrow(sent, "_block bigint, slot int, gram string, df bigint")
    known = grams.withColumn("df", F.sum("df").over(Window.partitionBy("gram"))).filter("df > 1")
    frequent = known.select("_block", "slot", F.log(F.col("df").cast("double")).alias("log_df"))
    schema = StructType([*texts.select(*keys).schema.fields, *StructType.fromDDL("total double, gap bigint").fields])
    scored = texts.groupBy("_block").cogroup(frequent.groupBy("_block")).applyInArrow(score, schema)
    similarity = F.col("total") / max_n * F.exp(-(F.col("gap") * F.col("gap")) / (2 * sigma * sigma))
    return scored.groupBy(*ids).agg(F.round(F.avg(similarity) * 10, 6).alias("cider"))


# -- recognised text and key-value extraction ----------------------------------------------------


def ocr_file_counts(files: DataFrame, name: str, gt: str, pred: str, **tokens) -> DataFrame:
    """Per file: tokens of both sides and their multiset overlap."""
    counts = gram_counts(files, [name], ocr_tokens(F.col(pred), **tokens), ocr_tokens(F.col(gt), **tokens), 1)
    sums = counts.groupBy(name).agg(F.sum("h").alias("pred_n"), F.sum("r").alias("gt_n"), F.sum(F.least("h", "r")).alias("right"))
    return files.select(name).join(sums, name, "left").fillna(0, ["pred_n", "gt_n", "right"])


def ocr_token_prf(files: DataFrame, name: str, gt: str, pred: str, **tokens) -> DataFrame:
    """Macro (mean per file) and micro (pooled counts) recall, precision and F1."""
    eps = 1e-9
    f1 = lambda r, p: 2 * r * p / (r + p + eps)
    per = ocr_file_counts(files, name, gt, pred, **tokens).select(
        "right", "gt_n", "pred_n", (F.col("right") / (F.col("gt_n") + eps)).alias("r"), (F.col("right") / (F.col("pred_n") + eps)).alias("p"))
    sums = per.agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum(f1(F.col("r"), F.col("p"))).alias("f"),
                   F.sum("right").alias("right"), F.sum("gt_n").alias("gt_n"), F.sum("pred_n").alias("pred_n"))
    c = F.col
    macro = {k: c(v) / (c("n") + eps) for k, v in (("macro_recall", "r"), ("macro_precision", "p"), ("macro_f1", "f"))}
    recall, precision = c("right") / (c("gt_n") + eps), c("right") / (c("pred_n") + eps)
    out = {**macro, "micro_recall": recall, "micro_precision": precision, "micro_f1": f1(recall, precision)}
    return sums.select(*[F.round(v, 6).alias(k) for k, v in out.items()])


def field_values(json_text: Column, depth: int = 6) -> Column:
    """(field, value) pairs of a JSON object of objects, lists and scalars, blanks dropped; null if unreadable.

    A nested field is named by its path (``a.b``), a list's items by the list. What is nested deeper
    than ``depth`` stays JSON text; ``with_field_values`` finds the depth that a table needs.
    """
    pair = lambda field, value: F.struct(field.alias("field"), value.alias("value"))

    def opened(p: Column) -> Column:
        entries = F.map_entries(F.from_json(p["value"], "map<string,string>"))
        inner = F.transform(entries, lambda e: pair(F.concat_ws(".", p["field"], e["key"]), e["value"]))
        listed = F.transform(F.from_json(p["value"], "array<string>"), lambda v: pair(p["field"], v))
        return F.coalesce(F.when(p["value"].startswith("{"), inner).when(p["value"].startswith("["), listed), F.array(p))

    top = F.transform(F.map_entries(F.from_json(json_text, "map<string,string>")), lambda e: pair(e["key"], e["value"]))
    for _ in range(depth - 1):
        top = F.flatten(F.transform(top, opened))
    return F.filter(F.transform(top, lambda p: pair(p["field"], F.trim(p["value"]))), lambda p: p["value"] != "")


def nesting(json_text: Column) -> Column:
    """How deep objects and lists are nested in a JSON text."""
    bare = F.regexp_replace(F.regexp_replace(json_text, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    state = lambda now, most: F.struct(now.alias("now"), most.alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return state(now, F.greatest(s["most"], now))

    return F.aggregate(F.split(bare, ""), state(F.lit(0), F.lit(0)), step, lambda s: s["most"])


def with_field_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each JSON column as its (field, value) pairs, opened until nothing is nested.

    One pass over the texts finds how deep they are nested.
    """
    deep = df.agg(F.max(F.greatest(F.lit(1), *[nesting(F.col(c)) for c in columns]))).first()[0] or 1
    return df.withColumns({c: field_values(F.col(c), deep) for c in columns})


#: files whose fields one task compares
KIE_FILES = 50_000


def kie_counts(files: DataFrame, name: str, pred: str, truth: str) -> DataFrame:
    """Counted full comparison per (file, field, value); inputs are arrays of (field, value)."""
    tag = lambda c, p, t: F.transform(c, lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), F.lit(p).alias("p"), F.lit(t).alias("t")))
    empty = F.array().cast("array<struct<field:string,value:string>>")
    both = F.concat(tag(F.coalesce(F.col(pred), empty), 1, 0), tag(F.coalesce(F.col(truth), empty), 0, 1))
    # the number of tasks follows the files: a task's counts are held in memory
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // KIE_FILES))
    rows = files.repartition(tasks, name).select(name, F.inline(both))
    counts = rows.groupBy(name, "field", "value").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    return counts.select(name, "field", "value", F.least("p", "t").alias("tp"), F.abs(F.col("p") - F.col("t")).alias("miss"))


def kie_field_f1(counts: DataFrame) -> DataFrame:
    """acc = tp / (tp + errors / 2 + 1e-6) per field and overall, most wrong first at a sink."""
    fields = counts.groupBy("field").agg(F.sum("tp").alias("tp"), F.sum("miss").alias("errors"))
    overall = fields.agg(F.sum("tp").alias("tp"), F.sum("errors").alias("errors")).withColumn("field", F.lit("OVERALL"))
    both = fields.unionByName(overall)
    return both.select("field", "tp", "errors", F.round(F.col("tp") / (F.col("tp") + F.col("errors") / 2 + 1e-6), 6).alias("acc"))


def kie_worst_files(counts: DataFrame, name: str) -> DataFrame:
    """All files with wrong fields by their number, the worst first."""
    errors = counts.groupBy(name).agg(F.sum("miss").alias("errors")).filter(F.col("errors") > 0)
    return errors.orderBy(F.desc("errors"), name)


# -- document samples ----------------------------------------------------------------------------


def edit_samples(samples: DataFrame, gt: str, pred: str) -> DataFrame:
    """Edit count, longer length and normalised distance of every sample with any text."""
    with_text = samples.filter((F.length(gt) > 0) | (F.length(pred) > 0))
    longest = F.greatest(F.length(gt), F.length(pred))
    return with_text.withColumns({"edits": F.levenshtein(gt, pred), "upper_len": longest}).withColumn(
        "edit_dist", F.col("edits") / F.col("upper_len"))


def edit_distance_pages(samples: DataFrame, page: str, gt: str, pred: str) -> DataFrame:
    """Edits over lengths per page, then the mean over pages."""
    pages = edit_samples(samples, gt, pred).groupBy(page).agg((F.sum("edits") / F.sum("upper_len")).alias("d"))
    return pages.agg(F.round(F.avg("d"), 6).alias("edit_dist"), F.count("*").alias("pages"))


def page_attribute_report(samples: DataFrame, page: str, attributes: str, metrics: str, length: str) -> DataFrame:
    """Per metric and attribute (and 'ALL'): page value, then mean over pages.

    Within a page, ``Edit_dist`` is weighted by text length, other metrics are plain means.
    """
    named = F.concat(F.array(F.lit("ALL")), F.flatten(F.transform(attributes, lambda m: F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))))
    rows = samples.select(page, F.col(length).alias("w"), F.explode(F.array_distinct(named)).alias("attribute"), metrics).select(
        page, "attribute", "w", F.explode(metrics).alias("metric", "score"))
    weighted = F.try_divide(F.sum(F.col("score") * F.col("w")), F.sum("w"))
    pages = rows.groupBy("metric", "attribute", page).agg(weighted.alias("wm"), F.avg("score").alias("pm"))
    value = F.when(F.col("metric") == "Edit_dist", F.col("wm")).otherwise(F.col("pm"))
    return pages.groupBy("metric", "attribute").agg(F.round(F.avg(value), 6).alias("value"), F.count("*").alias("pages"))


def attribute_label_means(samples: DataFrame, attributes: str, metrics: str) -> DataFrame:
    """Each distinct 'key: value' label of a sample receives every metric: mean and count per label."""
    labels = F.array_distinct(F.flatten(F.transform(attributes, lambda m: F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))))
    rows = samples.select(F.explode(labels).alias("label"), metrics).select("label", F.explode(metrics).alias("metric", "score"))
    return rows.groupBy("label", "metric").agg(F.round(F.avg("score"), 6).alias("value"), F.count("*").alias("n"))


def filter_groups(samples: DataFrame, attributes: str, groups: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Rows of every named group: all annotations of a sample meet the group's equalities; 'all' always."""

    def meets(rules: Mapping[str, str]) -> Column:
        return F.forall(attributes, lambda a: reduce(
            lambda x, y: x & y, [F.coalesce(F.try_element_at(a, F.lit(k)) == v, F.lit(False)) for k, v in rules.items()]))

    names = F.array_compact(F.array(F.lit("all"), *[F.when(meets(rules), F.lit(name)) for name, rules in groups.items()]))
    return samples.withColumn("group", F.explode(names))


#: characters of windows that are compared with a needle at once
WINDOW_CHARACTERS = 1 << 16


def nearest_window(needle: Sequence[str] | None, hay: Sequence[str] | None, sep: str) -> tuple[float | None, int | None]:
    """(similarity, place from 1) of the first of the hay's windows nearest to the needle, of those that share a token with it."""
    if needle is None or hay is None or not 0 < len(needle) <= len(hay):
        return None, None
    n, wanted = len(needle), set(needle)
    met = np.concatenate(([0], np.cumsum(np.fromiter((w in wanted for w in hay), np.int64, len(hay)))))
    starts = np.flatnonzero(met[n:] > met[:-n]).tolist()
    goal, at = sep.join(needle), 0
    best: tuple[float | None, int | None] = (None, None)
    while at < len(starts):
        texts, held = [], 0
        while at + len(texts) < len(starts) and held < WINDOW_CHARACTERS:
            i = starts[at + len(texts)]
            texts.append(sep.join(hay[i : i + n]))
            held += len(texts[-1])
        similarity = 1.0 - Packed(texts).shares(goal)
        k = int(similarity.argmax())
        if best[0] is None or similarity[k] > best[0]:
            best = float(similarity[k]), starts[at + k] + 1
        at += len(texts)
    return best


def _best_windows(needle: Column, hay: Column, joined: Column) -> Column:
    """``nearest_window`` of two token arrays, in Arrow batches; ``joined``: tokens stand without blanks between them."""

    def batch(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        found = [nearest_window(None if x is None else list(x), None if y is None else list(y), "" if z else " ") for x, y, z in zip(a, b, c)]
        return pd.DataFrame({"similarity": pd.array([f[0] for f in found], "Float64"), "start": pd.array([f[1] for f in found], "Int32")})

    return F.pandas_udf(batch, "similarity double, start int")(needle, hay, joined)


def _cut_up(needle: Column, hay: Column) -> Column:
    """struct of both texts' words (characters, where the needle is Chinese)."""
    chinese = has_cjk(needle)
    tokens = lambda s: F.when(chinese, characters(s)).otherwise(words(s))
    return F.struct(chinese.alias("chinese"), tokens(needle).alias("needle"), tokens(hay).alias("hay"))


def _window_scores(tokens: Column) -> Column:
    """The window and its scores, from a struct of chinese, needle, hay and best."""
    joined = lambda t, w: F.when(t["chinese"], F.array_join(w, "")).otherwise(F.array_join(w, " "))

    def found(t: Column) -> Column:
        window = F.when(t["best"]["start"].isNotNull(), F.slice(t["hay"], F.coalesce(t["best"]["start"], F.lit(1)), F.size(t["needle"])))
        best = F.struct(t["best"]["similarity"].alias("similarity"), window.alias("window"))
        return F.struct(t["chinese"].alias("chinese"), t["needle"].alias("needle"), best.alias("best"))

    def scores(x: Column) -> Column:
        window, goal = x["best"]["window"], x["needle"]
        shared = F.size(F.array_intersect(window, goal))
        p, r = shared / F.size(F.array_distinct(window)), shared / F.size(F.array_distinct(goal))
        zero = lambda c: F.when(window.isNotNull(), c).otherwise(0.0)
        times = lambda tokens, x: F.size(F.filter(tokens, lambda y: y == x))
        met = F.aggregate(F.array_distinct(goal), F.lit(0), lambda n, x: n + F.least(times(window, x), times(goal, x)))
        return F.struct(
            F.coalesce(joined(x, window), F.lit("")).alias("window"), zero(x["best"]["similarity"]).alias("similarity"),
            zero(p).alias("precision"), zero(r).alias("recall"), zero(2 * p * r / (p + r)).alias("f1"),
            zero(shared / F.size(F.array_union(window, goal))).alias("jaccard"), zero(2.0 * met / (F.size(window) + F.size(goal))).alias("rouge1"), zero(F.when(window == goal, 1.0).otherwise(0.0)).alias("exact"))

    return bound(bound(tokens, found), scores)


def best_ngram_window(needle: Column, hay: Column) -> Column:
    """struct of the hay's window most similar to the needle, and its scores against the needle.

    Windows have as many words (characters, where the needle is Chinese) as the needle and share one with it;
    similarity is one minus the edit distance over the longer length; the earliest best window wins.
    ``rouge1`` is the F1 of the words with their repeats, the other scores are of sets of words.
    """
    tokens = _cut_up(needle, hay)
    best = lambda t: _best_windows(t["needle"], t["hay"], t["chinese"])
    return _window_scores(F.struct(tokens["chinese"].alias("chinese"), tokens["needle"].alias("needle"), tokens["hay"].alias("hay"), best(tokens).alias("best")))


def best_windows(df: DataFrame, ids: Sequence[str], needle: str, hay: str) -> DataFrame:
    """``best_ngram_window`` of every row, spread over the cluster by ``ids``; windows are found in Arrow batches."""
    sides = spread(df, ids).select(*ids, _cut_up(F.col(needle), F.col(hay)).alias("_tokens")).select(*ids, "_tokens.*")
    # by number, as an id may be called like a column added here
    sides = sides.toDF(*[f"_{k}" for k in range(len(ids) + 3)])
    added = StructType.fromDDL(f"_{len(ids) + 3} double, _{len(ids) + 4} int")
    schema = StructType([*sides.schema.fields, *added.fields])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chinese, left, right = (batch.column(len(ids) + k) for k in range(3))
            found = [nearest_window(x.as_py(), y.as_py(), "" if z.as_py() else " ") for x, y, z in zip(left, right, chinese, strict=True)]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = sides.mapInArrow(nearest, schema)
    at = [F.col(f"_{k}") for k in range(len(ids), len(schema))]
    best = F.struct(at[3].alias("similarity"), at[4].alias("start"))
    tokens = F.struct(at[0].alias("chinese"), at[1].alias("needle"), at[2].alias("hay"), best.alias("best"))
    return rows.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(ids)], _window_scores(tokens).alias("_b")).select(*ids, "_b.*")


def align_blocks(pages: DataFrame, gts: str, preds: str, rounds: int | None = 1) -> DataFrame:
    """Match a page's blocks by lowest normalised edit distance, each used once.

    In every round the pairs that are each other's best are taken (the first of equally good ones);
    ``rounds``: None goes on until a side is used up. Blocks left over become pairs with an empty side.
    Both block lists are arrays of the page row, so nothing is shuffled; a block is compared with all
    blocks of the other side at once, and only the best partners are kept, so that a page of many
    thousand blocks takes memory for its texts alone. Null lists and texts are empty.
    Output: one row per pair with positions (null for none), texts and distance, beside the other columns.
    """
    others = [c for c in pages.columns if c not in (gts, preds)]
    pairs = pages.select(*others, gts, preds)
    added = StructType.fromDDL("gt_position int, pred_position int, gt string, pred string, distance double")
    schema = StructType([*pairs.schema.fields[: len(others)], *added.fields])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left, right = ([x or "" for x in batch.column(len(others) + k)[row].as_py() or []] for k in (0, 1))
                found = mutual_best(left, right, rounds)
                lone_left, lone_right = set(range(len(left))) - {i for i, _, _ in found}, set(range(len(right))) - {j for _, j, _ in found}
                every = [*found, *((i, None, 1.0) for i in sorted(lone_left)), *((None, j, 1.0) for j in sorted(lone_right))]
                for at in range(0, len(every), 1000):
                    part = every[at : at + 1000]
                    text = lambda side, k: "" if k is None else side[k]
                    columns = [batch.column(c).take(pa.array([row] * len(part), pa.int64())) for c in range(len(others))]
                    columns += [pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int32()),
                                pa.array([text(left, x[0]) for x in part], pa.string()), pa.array([text(right, x[1]) for x in part], pa.string()), pa.array([x[2] for x in part], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pairs.mapInArrow(match, schema)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two supplied vectors."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    return F.try_divide(dot, norm(a) * norm(b))


def embedding_score(df: DataFrame, hyp: str, ref: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(row scores, system mean) from supplied vectors."""
    rows = df.select(*keys, F.round(cosine_similarity(F.col(hyp), F.col(ref)), 6).alias("score"))
    return rows, rows.agg(F.round(F.avg("score"), 4).alias("system"), F.count("score").alias("n"))


def order_code(positions: Column) -> Column:
    """Positions as one character each, so that sequences compare by edit distance."""
    # characters beyond the surrogates: a million of them, more is an error
    checked = lambda p: F.when(p < 0x100000, F.lit(0x10000) + p).otherwise(F.raise_error(F.lit("more than a million positions in a page")).cast("bigint"))
    code = lambda p: F.decode(F.unhex(F.lpad(F.hex(checked(p)), 8, "0")), "UTF-32")
    return F.array_join(F.transform(positions, code), "")


def reading_order_distance(matches: Column) -> Column:
    """Edit distance of reading orders over the longer length, of one page's matches.

    ``matches`` are structs (gt_position, pred_position) of a page; those without a prediction count
    on the ground-truth side only, those without ground truth drop out.
    """

    def distance(m: Column) -> Column:
        truth = F.array_sort(F.transform(F.filter(m, lambda x: x["gt_position"].isNotNull()), lambda x: x["gt_position"]))
        both = F.filter(m, lambda x: x["gt_position"].isNotNull() & x["pred_position"].isNotNull())
        ordered = F.array_sort(F.transform(both, lambda x: F.struct(x["pred_position"].alias("p"), x["gt_position"].alias("g"))))
        said = F.transform(ordered, lambda x: x["g"])
        return F.try_divide(F.levenshtein(order_code(truth), order_code(said)), F.greatest(F.size(truth), F.size(said)))

    return bound(matches, distance)


def _chrf_of(counts: Sequence[tuple[Column, Column, Column]], beta: float) -> Column:
    """chrF of one row's (h, r, m) per order."""
    used = [(h > 0) & (r > 0) for h, r, _ in counts]
    n = sum((u.cast("int") for u in used), F.lit(0))
    ratio = lambda of: sum((F.coalesce(F.when(u, m / of(h, r)), F.lit(0.0)) for u, (h, r, m) in zip(used, counts, strict=True)), F.lit(0.0)) / n
    p, r, b = F.when(n > 0, ratio(lambda h, r: h)), F.when(n > 0, ratio(lambda h, r: r)), beta * beta
    return F.round(F.coalesce(F.try_divide(100.0 * (1 + b) * p * r, b * p + r), F.lit(0.0)), 6)


def mt_summary(pairs: DataFrame, ids: Sequence[str], views: Mapping[str, tuple[Column, Column]], order: int = 6, beta: float = 2.0) -> DataFrame:
    """Number of pairs, mean sentence scores (2 decimals) and corpus scores, one line each.

    Grams are counted once: a pair's counts give its sentence score, and added up the corpus score.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("view"), h.alias("hyp"), r.alias("ref")) for k, (h, r) in views.items()])
    keys = [*ids, "view"]
    counts = character_overlap(pairs.select(*ids, F.inline(rows)), keys, F.col("hyp"), F.col("ref"), order)
    parts = {c: F.col(c) for c in ("h", "r", "m")}
    spots = [(f"h{n}", f"r{n}", f"m{n}") for n in range(1, order + 1)]
    per_pair = counts.groupBy(*keys).agg(*[F.sum(F.when(F.col("n") == n, parts[c]).otherwise(0)).alias(f"{c}{n}") for n in range(1, order + 1) for c in parts])
    scored = per_pair.withColumn("chrf", _chrf_of([tuple(map(F.col, s)) for s in spots], beta))
    summed = scored.groupBy("view").agg(F.round(F.avg("chrf"), 2).alias("mean"), *[F.sum(c).alias(c) for s in spots for c in s])
    corpus = F.round(_chrf_of([tuple(map(F.col, s)) for s in spots], beta), 2)
    name = lambda kind: F.concat(F.lit(kind), "view")
    lines = summed.select(F.inline(F.array(
        F.struct(name("mean_chrf_").alias("name"), F.col("mean").alias("value")), F.struct(name("corpus_chrf_").alias("name"), corpus.alias("value")))))
    return pairs.agg(F.lit("n_pairs").alias("name"), F.count("*").cast("double").alias("value")).unionByName(lines)
