"""Divergence between the sources of each language, by three-dimensional cube partitioning.

Every source of a language has a smoothed term distribution over the language's kept terms, in whole
billionths. The divergence of two sources is the sum of the absolute differences over all kept terms. The
work is a cube (source, source, term): sources are dealt to blocks of about ``GROUP_BLOCK``, terms to
blocks of about ``TERM_BLOCK``. A source's counts in one term block are a slice; a slice is replicated
to the cells of all blocks its own block is compared with. The task of a cell (group block, group block,
term block) holds two blocks of slices, computes the partial divergences of their pairs, and the partial
sums are added along the term axis. No task sees a whole vocabulary or all sources, and a pair of
sources meets once a term block.

Terms that a slice does not hold have the source's share of an unseen term, so a cell needs the number of
its kept terms, not their names. Counts are combined in tasks before they are sent, by Arrow arrays;
shares are computed in decimals and differences in 64-bit integers, so all is exact.

Null text, language and source are read as empty strings. Every (language, source) that occurs is a group, also
without terms; its share of each kept term is then that of an unseen one. A language without kept terms has divergences of 0. Repeated
rows count again; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.arrow_words import ALPHABETIC, Words, numbered_words, split_words
from scoreloom.llm.common import stored, whole_text

#: entries (language, source, term, counts) that a task holds before it combines them
FLUSH_WORDS = 400_000
SENT_ROWS = 50_000
GROUP_BLOCK = 32
TERM_BLOCK = 8192
#: shares are in parts of this
WHOLE = 1_000_000_000
SMOOTHING = 5
COUNTED = "lang string, source string, term string, count bigint, docs bigint"
PARTIAL = "lang string, a string, b string, part bigint"


def _plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of every term in every group."""

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def counted(groups: pa.Array, part: Words) -> pa.Table:
        """The entries of some texts of a batch."""
        codes, known = numbered_words([part.words])
        langs, lang_names = numbered_words([groups.field("lang")])
        sources, source_names = numbered_words([groups.field("source")])
        group = langs * max(1, len(source_names)) + sources
        size = len(known)
        entry, count = np.unique(part.rows * size + codes, return_counts=True)  # once a document
        key = group[entry // size] * size + entry % size
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        at, term = np.divmod(key[heads], size)
        take = lambda names, numbers: names.cast(pa.string()).take(pa.array(numbers, pa.int64()))
        return pa.table(
            [take(lang_names, at // len(source_names)), take(source_names, at % len(source_names)), take(known, term),
             pa.array(np.add.reduceat(count[order], heads), pa.int64()), pa.array(np.diff(np.append(heads, len(key))), pa.int64())],
            schema=schema,
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only entries are held between texts, no words; they are sent when combining no longer helps
        held, entries = [], 0
        for batch in batches:
            for part in split_words(batch.column(1), ALPHABETIC):
                if not len(part.first):
                    continue
                held.append(counted(batch.column(0).slice(part.row, len(part.counts)), part))
                entries += held[-1].num_rows
                if entries >= FLUSH_WORDS:
                    held = [pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")]).rename_columns(schema.names)]
                    entries = held[0].num_rows
                    if 2 * entries >= FLUSH_WORDS:
                        yield from held[0].to_batches(SENT_ROWS)
                        held, entries = [], 0
        for table in held:
            yield from table.to_batches(SENT_ROWS)

    sent = docs.select(F.struct(_plain("lang"), _plain("source")).alias("group"), whole_text().alias("text")).mapInArrow(send, COUNTED)
    return sent.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(WHOLE * (count + SMOOTHING) / (n + SMOOTHING * v)), exactly."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", wide(F.lit(WHOLE)) * wide(count + SMOOTHING), wide(n + SMOOTHING * v))


def shares(docs: DataFrame, least_docs: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, terms, counts), stored.

    ``groups``: lang, source, unseen (share of a term that the group does not have; null without kept terms),
    ``v`` kept terms; ``terms``: lang, term, q (share in the language); ``counts``: lang, source, term, p of the
    kept terms that the group has.
    """
    counted = stored(term_counts(docs), "term-counts")
    totals = counted.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    totals = stored(totals.select("lang", "term", "all"), "kept-terms")
    langs = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("n_lang"))
    kept = counted.join(totals.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "count")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select(_plain("lang"), _plain("source")).distinct().join(sizes, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    terms = totals.join(langs, "lang").select("lang", "term", _share(F.col("all"), F.col("n_lang"), F.col("v")).alias("q"))
    counts = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("count"), F.col("n"), F.col("v")).alias("p"))
    unseen = F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.greatest("v", F.lit(1))))
    return groups.select("lang", "source", "v", unseen.alias("unseen")), stored(terms, "term-shares"), stored(counts, "group-shares")


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of a cell (lang, block, block, term block), each pair once."""
    side = table.column("side").to_numpy()
    unseen = table.column("unseen").to_numpy()
    kept = int(table.column("kept")[0].as_py())
    lists = table.column("terms").combine_chunks()
    width = lists.value_lengths().to_numpy()
    codes, known = numbered_words([lists.flatten()])
    p = np.repeat(unseen, len(known)).reshape(len(unseen), len(known)) if len(known) else np.zeros((len(unseen), 0), np.int64)
    p[np.repeat(np.arange(len(width)), width), codes] = table.column("shares").combine_chunks().flatten().to_numpy()
    names = table.column("source").to_pylist()
    # a pair has the same order in every term block, whatever order the slices come in
    by_name = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    lang, same = key[0].as_py(), key[1].as_py() == key[2].as_py()
    one, two = by_name[side[by_name] == 0], by_name[side[by_name] == 1]
    a, b, parts = [], [], []
    for k, i in enumerate(one.tolist()):
        against = one[k + 1 :] if same else two
        sums = np.abs(p[against] - p[i]).sum(axis=1) + (kept - len(known)) * np.abs(unseen[against] - unseen[i])
        a += [names[i]] * len(against)
        b += [names[j] for j in against.tolist()]
        parts.append(sums)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
                     "part": pa.array(np.concatenate(parts) if parts else [], pa.int64())})


def divergences(groups: DataFrame, terms: DataFrame, counts: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, a, b, value) of every pair of sources of a language, each pair once."""
    sized = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / group_block).alias("group_blocks"), F.greatest(F.ceil(F.max("v") / term_block), F.lit(1)).alias("term_blocks"))
    group_of = F.pmod(F.xxhash64(F.lit("group"), "source"), F.col("group_blocks"))
    term_of = F.pmod(F.xxhash64(F.lit("term"), "term"), F.col("term_blocks"))
    kept = terms.join(sized, "lang").groupBy("lang", term_of.alias("tb")).agg(F.count(F.lit(1)).alias("kept"))
    held = counts.join(sized, "lang").groupBy("lang", "source", term_of.alias("tb")).agg(F.collect_list(F.struct("term", "p")).alias("entries"))
    # every group has a slice in every term block, also an empty one
    slices = groups.join(sized, "lang").withColumn("gb", group_of).withColumn("tb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1)))
    slices = slices.join(held, ["lang", "source", "tb"], "left").join(kept, ["lang", "tb"], "left")
    entries = F.coalesce("entries", F.array().cast("array<struct<term:string,p:bigint>>"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("group_blocks") - 1))
    cells = slices.withColumn("other", other).select(
        "lang", "source", F.coalesce("unseen", F.lit(0).cast("bigint")).alias("unseen"), F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"),
        F.transform(entries, lambda e: e["term"]).alias("terms"), F.transform(entries, lambda e: e["p"]).alias("shares"),
        F.least("gb", "other").alias("b1"), F.greatest("gb", "other").alias("b2"), "tb", F.when(F.col("gb") <= F.col("other"), 0).otherwise(1).alias("side"))
    partial = cells.groupBy("lang", "b1", "b2", "tb").applyInArrow(_cell, PARTIAL)
    return partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language by divergence, all of them. Part ``term``: the ``top``
    terms that the source uses more than its language does, by the difference of their shares.
    """
    groups, terms, counts = shares(docs, least_docs)
    once = stored(divergences(groups, terms, counts, group_block, term_block), "divergences")
    both = once.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(once.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    raised = counts.join(terms, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return out(both, "pair").unionByName(out(raised, "term").filter(F.col("rank") <= top))
