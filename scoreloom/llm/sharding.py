"""K-d tree partitioning: shards of near-equal bytes that are boxes in metadata space.

A node is split along the dimension in which its rows spread widest (against the spread of the whole
table) at the distributed weighted median of a composite order: the value in that dimension, a hash of
the text, the document id. All nodes of a level share their jobs: one for spreads and totals, a few histograms
that narrow each node's interval, and one that writes the rows with their new nodes. A job sends the
driver at most ``BIN_ROWS`` histogram rows, never documents; each level reads what the last one wrote.

Equal texts move as a unit: they take the metadata of the row with the smallest id and have equal order
keys. Only a group that alone exceeds a shard is ordered by id as well, so that it is cut there.

Null metadata counts as 0, null texts as empty, null ids as the smallest. Rows equal in every ordered
column stay in one shard. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import numbered, stored, table, whole_text

#: histogram rows of a job, and most bins of a node
BIN_ROWS, BINS = 65_536, 1024
#: a cut may miss its goal by this part of a shard
TOLERANCE = 1e-3
INF = math.inf


def default_dimensions() -> dict[str, Column]:
    """Length on a log scale, and source and language as codes."""
    code = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")) / F.lit(float(1 << 32))
    return {"length": F.log2(F.octet_length(whole_text()) + F.lit(1.0)), "source": code("source"), "lang": code("lang")}


def described(docs: DataFrame, dimensions: Mapping[str, Column], shards: int | None, target_bytes: int | None) -> tuple[DataFrame, int]:
    """((doc_id, size, text_crc32, d0, d1, .., tie, last, node), number of shards): all that the tree needs, stored."""
    text = whole_text()
    dims = [F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"d{i}") for i, c in enumerate(dimensions.values())]
    names = [f"d{i}" for i in range(len(dims))]
    rows = stored(
        docs.select(
            "doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *dims,
            F.xxhash64(text).alias("text_hash"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-INF)).alias("last"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    key = ["text_hash", "size", "text_crc32"]
    copies = rows.groupBy(*key).agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*names), F.struct("last", *names)).alias("group")).filter("n > 1")
    joined = rows.join(copies, key, "left")
    # a group that no shard can hold is ordered by id
    large = F.col("all") > total / shards
    return stored(
        joined.select(
            "doc_id", "size", "text_crc32", *[F.coalesce(F.col(f"group.{c}"), F.col(c)).alias(c) for c in names], (F.col("text_hash") / F.lit(1024.0)).alias("tie"),
            F.when(F.coalesce(large, F.lit(False)), F.col("last")).otherwise(0.0).alias("last"), F.lit(1).cast("bigint").alias("node")),
        "shard-units",
    ), shards


def _value(dim: Column, dims: int) -> Column:
    return F.element_at(F.array(*[f"d{i}" for i in range(dims)]), dim + 1)


class _Cut:
    """The search for a node's cut: the interval of the current key that holds the goal, and the keys fixed before it."""

    def __init__(self, dim: int, goal: float, slack: float, ranges: list[tuple[float, float]]):
        self.dim, self.goal, self.slack, self.ranges = dim, goal, slack, ranges
        self.phase, self.below, self.fixed = 0, 0, [0.0, 0.0]
        self.lo, self.hi = ranges[0]
        self.cut: tuple[float, float, float] | None = None

    def narrow(self, bins: list[tuple[int, int, float, float]]) -> None:
        """Takes the bin (number, weight, least, largest) in which the weight reaches the goal."""
        for number, weight, lo, hi in sorted(bins):
            if self.below + weight >= self.goal or number == max(bins)[0]:
                break
            self.below += weight
        if lo == hi and self.phase < 2 and weight > self.slack:
            self.fixed[self.phase] = lo
            self.phase += 1
            self.lo, self.hi = self.ranges[self.phase]
        elif weight <= self.slack or lo == hi:
            # the side of the bin that is nearer to the goal
            after = self.below + weight - self.goal < self.goal - self.below
            self.cut = tuple([*self.fixed[: self.phase], hi if after else lo, *[INF if after else -INF] * 2][:3])
            if self.phase == 2 and not after:
                self.cut = (*self.fixed, math.nextafter(lo, -INF))
        else:
            self.lo, self.hi = lo, hi


def _cuts(rows: DataFrame, searches: dict[int, _Cut], dims: int) -> None:
    """Runs histograms over ``rows`` until every search has its cut."""
    spark = rows.sparkSession
    kinds = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("phase", pa.int32()), *[(c, pa.float64()) for c in ("one", "two", "lo", "hi")]])
    while open_ := {n: s for n, s in searches.items() if s.cut is None}:
        bins = max(2, min(BINS, BIN_ROWS // len(open_)))
        state = table(spark, [(n, s.dim, s.phase, *s.fixed, s.lo, s.hi) for n, s in open_.items()], kinds)
        first = _value(F.col("dim"), dims)
        v = F.when(F.col("phase") == 0, first).when(F.col("phase") == 1, F.col("tie")).otherwise(F.col("last"))
        inside = rows.join(F.broadcast(state), "node").withColumn("first", first).withColumn("v", v)
        inside = inside.filter("(phase = 0 OR first = one) AND (phase < 2 OR tie = two) AND v >= lo AND v <= hi")
        # an infinite end of an interval has a bin of its own
        place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
        bin_ = F.when((F.col("hi") == F.col("lo")) | (F.col("v") == F.lit(-INF)), 0).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.coalesce(place, F.lit(0)))))
        sums = inside.groupBy("node", bin_.cast("int").alias("bin")).agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found: dict[int, list[tuple[int, int, float, float]]] = {}
        for r in sums.toArrow().to_pylist():
            found.setdefault(r["node"], []).append((r["bin"], r["w"], r["lo"], r["hi"]))
        for n, s in open_.items():
            s.narrow(found[n])


def _split_level(rows: DataFrame, parts: Mapping[int, int], dims: int, spans: list[float], lasts: tuple[float, float], slack: float) -> DataFrame:
    """``rows`` with the nodes of more than one part split; children are 2n and 2n + 1 (left and right)."""
    spark = rows.sparkSession
    names = [f"d{i}" for i in range(dims)]
    stats = rows.join(F.broadcast(table(spark, [(n,) for n in parts], pa.schema([("node", pa.int64())]))), "node").groupBy("node").agg(
        F.sum("size").alias("total"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
    searches = {}
    for r in stats.toArrow().to_pylist():
        ends = [(r[f"lo_{c}"], r[f"hi_{c}"]) for c in names]
        dim = max(range(dims), key=lambda i: ((ends[i][1] - ends[i][0]) / (spans[i] or 1.0), -i))
        share = (parts[r["node"]] // 2) / parts[r["node"]]
        searches[r["node"]] = _Cut(dim, r["total"] * share, slack, [ends[dim], (-float(1 << 53), float(1 << 53)), lasts])
    _cuts(rows, searches, dims)
    kinds = pa.schema([("node", pa.int64()), ("dim", pa.int32()), *[(f"cut_{c}", pa.float64()) for c in ("value", "tie", "last")]])
    cuts = table(spark, [(n, s.dim, *s.cut) for n, s in searches.items()], kinds)
    v = _value(F.col("dim"), dims)
    right = (v > F.col("cut_value")) | ((v == F.col("cut_value")) & ((F.col("tie") > F.col("cut_tie")) | ((F.col("tie") == F.col("cut_tie")) & (F.col("last") > F.col("cut_last")))))
    node = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("bigint"))
    return rows.join(F.broadcast(cuts), "node", "left").withColumn("node", node).select(*rows.columns)


def kd_shards(rows: DataFrame, dims: int, shards: int) -> DataFrame:
    """``rows`` (of ``described``) with ``shard``: 0 to ``shards`` - 1, instead of ``node``."""
    names = [f"d{i}" for i in range(dims)]
    # infinite ids (of null ones) stand below all others
    finite = F.when(F.col("last") > F.lit(-INF), F.col("last"))
    ends = rows.agg(F.sum("size").alias("total"), F.min(finite).alias("first"), F.max(finite).alias("end"), *[(F.max(c) - F.min(c)).alias(c) for c in names]).first()
    lasts = ((ends["first"] or 0.0) - 1, ends["end"] or 0.0)
    out = rows.withColumn("last", F.greatest("last", F.lit(lasts[0])))
    tree, leaves = {1: shards}, {}
    while tree:
        wide = {n: k for n, k in tree.items() if k > 1}
        if wide:
            out = stored(_split_level(out, wide, dims, [ends[c] for c in names], lasts, ends["total"] / shards * TOLERANCE), "shard-level")
        leaves |= {n: k for n, k in tree.items() if k == 1}
        tree = {c: p for n, k in wide.items() for c, p in ((2 * n, k // 2), (2 * n + 1, k - k // 2))}
        # a side that got no rows is a leaf without any
        seen = {r["node"] for r in out.select("node").distinct().collect()} if tree else set()
        tree, leaves = {n: k for n, k in tree.items() if n in seen}, leaves | {n: 1 for n in tree if n not in seen}
    # leaves from left to right: by their path from the root, padded to the same depth
    deep = max(n.bit_length() for n in leaves)
    order = sorted(leaves, key=lambda n: n << (deep - n.bit_length()))
    shard_of = table(rows.sparkSession, [(n, i) for i, n in enumerate(order)], pa.schema([("node", pa.int64()), ("shard", pa.int32())]))
    return out.join(F.broadcast(shard_of), "node").drop("node")


def shard_documents(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None, dimensions: Mapping[str, Column] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): ``slot`` numbers a shard's rows without gaps."""
    dimensions = dimensions or default_dimensions()
    rows, shards = described(docs, dimensions, shards, target_bytes)
    if rows.isEmpty():
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    placed = stored(kd_shards(rows, len(dimensions), shards).select("doc_id", "size", "text_crc32", "tie", "shard"), "shard-leaves")
    return numbered(placed, "shard", ["doc_id", "tie"], placed.count(), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
