"""Nearest neighbours by cosine from vantage-point trees, one per shard.

Unit vectors are compared by their chord, a metric that falls as the cosine rises. A tree's node holds
a vantage point and, for both halves of the others, the range of their distances to it. A half whose
least possible distance, times ``factor``, is above the query's fifth best is skipped. By the triangle
inequality nothing is lost at factor 1; larger factors skip more.

Vectors are dealt to shards of bounded size by a hash of the id; every vector is in a tree. Queries are
packed in blocks, each block is joined with every shard, and a block walks a tree together. Scores are
cosines of the original vectors in double precision, summed in the same order for every pair, so
that equal vectors tie exactly. Shards' best lists are merged by rank.

Vectors that are null, empty, zero or hold a null or non-finite component take no part. Vectors of
different lengths are never compared. A query's own row is any row of its id; a query id counts once.
Null ids are no queries, but are found (as null, before other ids in ties). Fewer candidates than k
give fewer rows; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import stored

SHARD_ROWS = 4096
BLOCK_ROWS = 512
LEAF = 96
#: how much surer than the triangle inequality a half must be worse to be skipped; measured recall is above 0.99
FACTOR = 4.0
NO_ID = -(2**63)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of pairs of original rows."""
    a = queries / np.abs(queries).max(axis=1, keepdims=True)
    b = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


@dataclass
class Node:
    """Rows ``first`` to ``end`` of the tree's order; the vantage point is row ``first``."""

    first: int
    end: int
    halves: tuple | None = None  # (node, least and largest distance) of the near and the far half


class Tree:
    """A vantage-point tree over rows; building it reorders them so that each node is a slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        order = np.lexsort(ids[None, :])
        self.ids, self.vectors = ids[order], vectors[order]
        self.unit = _unit(self.vectors)
        self.root = self._build(0, len(ids))

    def _build(self, first: int, end: int) -> Node:
        if end - first <= LEAF:
            return Node(first, end)
        pick = int(self.rng.integers(first, end))
        self._swap(np.array([pick, first]), np.array([first, pick]))
        d = self._chords(self.unit[first : first + 1], first + 1, end)[0]
        order = np.argsort(d, kind="stable")
        rows = first + 1 + order
        self._swap(np.arange(first + 1, end), rows)
        d, half = d[order], (end - first - 1) // 2
        middle = first + 1 + half
        near, far = self._build(first + 1, middle), self._build(middle, end)
        return Node(first, end, ((near, d[0], d[half - 1]), (far, d[half], d[-1])))

    def _swap(self, to: np.ndarray, rows: np.ndarray) -> None:
        for a in (self.ids, self.vectors, self.unit):
            a[to] = a[rows].copy()

    def _chords(self, queries: np.ndarray, first: int, end: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (queries @ self.unit[first:end].T)))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, cosines) of the k best for each query, NO ROW as NaN, and how many pairs were measured."""
        n = len(ids)
        self.query_ids, self.queries, self.query_unit, self.factor = ids, queries, _unit(queries), factor
        self.best = np.full((n, k), -np.inf)
        self.best_ids = np.full((n, k), np.iinfo(np.int64).max)
        self.reach = np.full(n, np.inf)
        self.measured = 0
        if n:
            self._visit(self.root, np.arange(n))
        return self.best_ids, self.best, self.measured

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.halves is None:
            self._measure(rows, node.first, node.end)
            return
        d = self._measure(rows, node.first, node.first + 1)[:, 0]
        (near, near_lo, near_hi), (far, far_lo, far_hi) = node.halves
        bound = lambda lo, hi: np.maximum(0.0, np.maximum(lo - d, d - hi))
        to_near, to_far = bound(near_lo, near_hi), bound(far_lo, far_hi)
        near_first = to_near < to_far
        near_first |= (to_near == to_far) & (d <= (near_hi + far_lo) / 2)
        for first, mine in ((near, near_first), (far, ~near_first)):
            second, other = (far, to_far) if first is near else (near, to_near)
            own = to_near if first is near else to_far
            self._visit(first, rows[mine & (own * self.factor <= self.reach[rows])])
            self._visit(second, rows[mine & (other * self.factor <= self.reach[rows])])

    def _measure(self, rows: np.ndarray, first: int, end: int) -> np.ndarray:
        """Distances from queries to a slice; better ones enter the queries' lists."""
        d = self._chords(self.query_unit[rows], first, end)
        self.measured += d.size
        own = self.query_ids[rows][:, None] == self.ids[None, first:end]
        hit = (d <= self.reach[rows][:, None] + 1e-7) & ~own
        q, c = np.nonzero(hit)
        if len(q):
            score = _cosines(self.queries[rows[q]], self.vectors[first + c])
            k = self.best.shape[1]
            who = np.concatenate([np.repeat(np.unique(q), k), q])
            touched = np.unique(q)
            all_scores = np.concatenate([self.best[rows[touched]].ravel(), score])
            all_ids = np.concatenate([self.best_ids[rows[touched]].ravel(), self.ids[first + c]])
            order = np.lexsort((all_ids, -all_scores, who))
            who = who[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            top = order[rank < k]
            self.best[rows[touched]] = all_scores[top].reshape(-1, k)
            self.best_ids[rows[touched]] = all_ids[top].reshape(-1, k)
            worst = self.best[rows[touched], -1]
            self.reach[rows[touched]] = np.where(np.isfinite(worst), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(worst, -1.0))) + 1e-9, np.inf)
        return d


def _packed(frame: pd.DataFrame) -> tuple[bytes, bytes]:
    return frame["id"].to_numpy(np.int64).tobytes(), np.stack(frame["vector"].to_numpy()).astype("<f8").tobytes()


def _unpacked(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64).copy(), np.frombuffer(vectors, "<f8").reshape(-1, width).copy()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query. Both tables: id, vector."""
    double = lambda df: df.filter(usable(F.col("vector"))).select(F.coalesce(F.col("id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("width"))
    rows = stored(double(vectors), "vectors")
    asked = double(queries.filter("id IS NOT NULL")).dropDuplicates(["id", "width"])
    counts = rows.groupBy("width").count().withColumn("shards", F.ceil(F.col("count") / shard_rows)).drop("count")
    asked_n = asked.count()
    dealt = rows.join(counts, "width").withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "id", "vector"), F.col("shards")).cast("bigint"))
    blocks = max(1, -(-asked_n // block_rows))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        ids, values = _packed(frame)
        return pd.DataFrame({"width": [int(frame["width"].iloc[0])], "part": [int(frame["part"].iloc[0])], "ids": [ids], "vectors": [values]})

    packed = "width int, part bigint, ids binary, vectors binary"
    shard_table = dealt.select("width", F.col("shard").alias("part"), "id", "vector").groupBy("width", "part").applyInPandas(pack, packed)
    block_table = asked.select("width", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(blocks)).alias("part"), "id", "vector").groupBy("width", "part").applyInPandas(pack, packed)
    # every block of queries meets every shard of its width
    sent = block_table.join(counts, "width").select("width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("part"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    met = sent.join(shard_table, ["width", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                width, part, q_ids, q_vectors, ids, values = (batch.column(i)[row].as_py() for i in range(6))
                if last != (width, part):
                    last, tree = (width, part), Tree(*_unpacked(ids, values, width))
                query_ids, query_vectors = _unpacked(q_ids, q_vectors, width)
                found, scores, _ = tree.search(query_ids, query_vectors, k, factor)
                real = np.isfinite(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, k)[real.ravel()]), pa.array(found[real]), pa.array(scores[real])], names=["query_id", "vec_id", "score"])

    found = met.select("width", "part", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
