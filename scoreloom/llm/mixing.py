"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's documents are dealt to shards by a seeded hash and laid end to end in seeded order,
so a shard is a ring of words. Equal blocks of words are seats: highest quotients (target / (2 seats
+ 1)) give them to the sources, and inside a source its seats to the shards. A shard then takes its
seats as one run of consecutive blocks from a seeded start, going round the ring at most
``max_repeats`` times; a document is taken as often as the run passes over its words.

Only totals by source and shard reach the driver: one row per source, and at most ``MAX_SHARDS``
shards besides one per source. Documents without words, and null or empty texts, have size 0 and are
never taken. Null sources are a source of their own, last in order. Rows that are equal in all
columns are rows of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import count_words, stored, table, whole_text

MAX_SHARDS = 1 << 14
LEAST_SHARD_WORDS = 1 << 16
MAX_BLOCK_WORDS = 256
#: blocks that the smallest target is cut into, if a block is more than a word
LEAST_BLOCKS = 128


def share_out(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Targets by weight; none above ``most`` times its size, the excess shared by weight among the others."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] / total * budget > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = weights[i] / total * budget
            break
        for i in over:
            targets[i] = most * sizes[i]
            budget -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def apportion(claims: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Sainte-Laguë: each seat to the highest ``claim / (2 * own seats + 1)``, ties to the first; never above ``most``.

    Starts from the rounded shares and then adds or takes back single seats, which gives the same as
    dealing out every seat in turn.
    """
    total = sum(claims)
    if total <= 0 or seats <= 0:
        return [0] * len(claims)
    seats = min(seats, sum(m for c, m in zip(claims, most, strict=True) if c > 0))
    given = [min(m, int(c / total * seats + 0.5)) for c, m in zip(claims, most, strict=True)]
    # the quotient that won the last seat of i, and the one it bids with for the next
    won = [(claims[i] / (2 * g - 1), -i) for i, g in enumerate(given) if g > 0]
    heapq.heapify(won)
    extra = sum(given) - seats
    while extra > 0:
        _, i = heapq.heappop(won)
        given[-i] -= 1
        extra -= 1
        if given[-i] > 0:
            heapq.heappush(won, (claims[-i] / (2 * given[-i] - 1), i))
    bids = [(-claims[i] / (2 * g + 1), i) for i, g in enumerate(given) if claims[i] > 0 and g < most[i]]
    heapq.heapify(bids)
    while extra < 0:
        _, i = heapq.heappop(bids)
        given[i] += 1
        extra += 1
        if given[i] < most[i]:
            heapq.heappush(bids, (-claims[i] / (2 * given[i] + 1), i))
    return given


def mix(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: int = 17, block_words: int | None = None
) -> DataFrame:
    """Rows of ``sizes`` (doc_id, source, size) with ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    ``weights`` repeat over the sources in code point order. ``sizes`` is read three times: pass a stored table.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()
    words = [r["words"] for r in totals]
    targets = share_out(words, [weights[i % len(weights)] for i in range(len(words))], share * sum(words), max_repeats)
    smallest = min((t for t in targets if t > 0), default=1.0)
    block = block_words or max(1, min(MAX_BLOCK_WORDS, int(smallest / LEAST_BLOCKS)))
    shard_words = max(LEAST_SHARD_WORDS, sum(words) // MAX_SHARDS + 1)
    by_source = apportion(targets, round(sum(targets) / block), [max_repeats * w // block for w in words])
    sources = table(
        spark,
        [(r["source"], i, w, t, max(1, -(-w // shard_words))) for i, (r, w, t) in enumerate(zip(totals, words, targets, strict=True))],
        pa.schema([("source", pa.string()), ("_s", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("_shards", pa.int64())]),
    )
    known = sources.withColumnRenamed("source", "_source")
    place = F.xxhash64(F.lit(seed), "doc_id", "size")
    laid = (
        sizes.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_h", place).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.col("_shards")))
    )
    shards = laid.filter("size > 0").groupBy("_s", "_shard").agg(F.sum("size").alias("words")).orderBy("_s", "_shard").collect()
    runs, at = [], 0
    while at < len(shards):
        end = at
        while end < len(shards) and shards[end]["_s"] == shards[at]["_s"]:
            end += 1
        own = [r["words"] for r in shards[at:end]]
        given = apportion(own, by_source[shards[at]["_s"]], [max_repeats * w // block for w in own])
        for r, w, g in zip(shards[at:end], own, given, strict=True):
            runs.append((r["_s"], r["_shard"], w, g * block // w, g * block % w))
        at = end
    quotas = table(
        spark, runs, pa.schema([("_s", pa.int64()), ("_shard", pa.int64()), ("_words", pa.int64()), ("_rounds", pa.int64()), ("_run", pa.int64())])
    )
    before = Window.partitionBy("_s", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("_from", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("_to", F.col("_from") + F.col("size"))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "_s", "_shard"), F.floor((F.col("_words") - 1) / block) + 1) * block
    end = F.col("_start") + F.col("_run")
    shared = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("_to"), hi) - F.greatest(F.col("_from"), lo))
    taken = (
        F.col("_rounds") * F.col("size") + shared(F.col("_start"), F.least(end, F.col("_words"))) + shared(F.lit(0), end - F.col("_words"))
    )
    return (
        placed.join(quotas, ["_s", "_shard"], "left").withColumn("_start", start)
        .withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0).cast("bigint"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size in words) of every document, stored."""
    return stored(docs.select("doc_id", "source", count_words(whole_text()).alias("size")), "mix-sizes")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: every document as often as its words are taken, to the nearest whole time.

    Documents without words come through once: they have nothing to weigh.
    """
    taken = mix(sizes_of(docs), **options)
    times = taken.select(F.col("doc_id").alias("_id"), "source", "size", F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int").alias("_times"))
    times = times.withColumnRenamed("source", "_of").withColumn("_times", F.when(F.col("size") == 0, 1).otherwise(F.col("_times")))
    kept = times.filter("_times > 0").groupBy("_id", "_of", "size").agg(F.array_sort(F.collect_list("_times")).alias("_times"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", count_words(whole_text()).alias("_size"))
    ranked = rows.join(
        kept.withColumnRenamed("size", "_words"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of")) & (F.col("_size") == F.col("_words")),
    )
    return ranked.select("row", F.explode(F.sequence(F.lit(1), F.element_at("_times", 1))).alias("copy")).select("row.*")
