"""Near-duplicate documents: word n-gram sets with a Jaccard similarity, joined by T-occurrence search.

Two sets of sizes a and b reach the similarity when they share T = ceil(t / (1 + t) * (a + b)) n-grams
or more; DivideSkip finds such pairs by merging the short inverted lists and probing the long ones.
Around it:

1. Every n-gram is counted over all documents, as 40 bits beside its bucket; those in two sets or more
   are written to the shared folder as sorted arrays that workers map.
2. Every document looks its n-grams up. One that shares fewer than ceil(t * size) of them with any other
   can have no partner. The others are *active*; rare n-grams first, a partner must be met within the
   first size - ceil(t * size) + 1, so only those are used to find which sets belong together.
3. Sets connected through such n-grams go to the same task, large connected groups as pairs of
   blocks of bounded size, and are searched there. A pair that is connected already is not probed.
   A task returns a spanning forest of the links it found, never all pairs.
4. Components of all forests give the classes.

Equal sets are one set throughout, so copies cost a row each. Counts are used for order and for
safe rejection only: links are decided on whole sets. N-grams and sets are known by 64-bit hashes.

Null and empty texts have the empty set and are linked with nothing. Rows with equal ids are rows of
their own (equal texts link them); a null id takes part, and is never the smallest unless it is alone.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import mix, new_path, stored, whole_text, word_hashes
from scoreloom.llm.components import components
from scoreloom.llm.language_model import _bucket, _folder, _hit, _map, _save

WORDS = 5
#: similarity as a fraction of integers
SIMILARITY = (75, 100)
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 16
LOW = np.uint64((1 << 40) - 1)
#: n-grams that a task sends on at a time
FLUSH = 4_000_000
#: n-grams of a block, about
BLOCK_GRAMS = 400_000
DESCRIBED = "doc_id bigint, text_hash bigint, size bigint, set_id bigint, shared binary, posted array<bigint>"


def gram_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct n-grams, n-grams per text) of a group of texts at a time, sorted inside each text."""
    for _, counts, hashes in word_hashes(texts):
        n = len(hashes)
        rows = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        with np.errstate(over="ignore"):
            # a text of fewer words is one n-gram of all of them
            length = np.minimum(words, counts)
            grams = mix(length[rows].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            place = np.arange(n)
            for k in range(words):
                at = np.minimum(place + k, n - 1)
                grams = np.where(k < length[rows], mix(grams * np.uint64(0x9FB21C651E98DF25) + hashes[at]), grams)
        whole = place + length[rows] <= ends[rows]
        rows, grams = rows[whole], grams[whole]
        order = np.lexsort((grams, rows))
        rows, grams = rows[order], grams[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
        rows, grams = rows[new], grams[new]
        yield grams, np.bincount(rows, minlength=len(counts))


def _set_ids(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(grams + np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        ends = np.cumsum(sizes)
        return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _least(size: np.ndarray | int, similarity: tuple[int, int]):
    """What a set of this size must share with any partner."""
    return -(-size * similarity[0] // similarity[1])


def count_grams(texts: DataFrame, folder: str, buckets: int, words: int) -> None:
    """Writes, per bucket, the n-grams that two sets or more have, and in how many."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, np.zeros(0, np.int64)

        def flushed() -> Iterator[pa.RecordBatch]:
            # once each, with the number of sets: nearly all ones, which compress to nothing
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            bounds = np.searchsorted(_bucket(grams, buckets), np.arange(buckets + 1))
            low, times = (grams & LOW).view(np.uint8).reshape(-1, 8)[:, :5], times.astype("<u4")
            used = np.flatnonzero(np.diff(bounds)).tolist()
            squeeze = zstandard.ZstdCompressor(1).compress
            spans = [slice(bounds[b], bounds[b + 1]) for b in used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([low[x].tobytes() for x in spans], pa.binary()), pa.array([squeeze(times[x].tobytes()) for x in spans], pa.binary())],
                names=["bucket", "grams", "times"])

        for batch in batches:
            for grams, sizes in gram_sets(batch.column(0), words):
                ids = _set_ids(grams, sizes)
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                first &= ~_hit(seen, ids)[1]  # a set counts once in a task
                seen = np.union1d(seen, ids)
                held.append(grams[np.repeat(first, sizes)])
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flushed()
                    held, size = [], 0
        if size:
            yield from flushed()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        raw = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["grams"]]).reshape(-1, 5)
        spread = zstandard.ZstdDecompressor().decompress
        times = np.concatenate([np.frombuffer(spread(x), "<u4") for x in frame["times"]])
        frame.drop(frame.index, inplace=True)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        keys = wide.view(np.uint64).ravel()
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.add.reduceat(times[order].astype(np.int64), first)
        common = counts > 1
        _save(f"{folder}/grams-{bucket}", keys[first[common]])
        _save(f"{folder}/sets-{bucket}", np.minimum(counts[common], 0xFFFFFFFF).astype(np.uint32))
        return pd.DataFrame({"bucket": [bucket]})

    sent = texts.mapInArrow(send, "bucket int, grams binary, times binary")
    sent.groupBy("bucket").applyInPandas(merge, "bucket int").count()


class Counts:
    """In how many sets an n-gram is, from the mapped arrays; 1 where it is in no array."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, grams: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(grams, return_inverse=True)
        out = np.ones(len(distinct), np.int64)
        bounds = np.searchsorted(_bucket(distinct, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            if b not in self.known:
                self.known[b] = (_map(f"{self.folder}/grams-{b}", np.uint64), _map(f"{self.folder}/sets-{b}", np.uint32))
            keys, sets = self.known[b]
            at, hit = _hit(keys, distinct[bounds[b] : bounds[b + 1]] & LOW)
            out[bounds[b] : bounds[b + 1]][hit] = sets[at[hit]]
        return out[back]


_COUNTS: dict[str, Counts] = {}


def describe(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, size, set_id, shared, posted) of every row, stored.

    ``shared`` (sorted n-grams that other sets have) and ``posted`` (those that a partner must meet) are
    null unless the row is active.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    folder = _folder(new_path(spark, "grams"))
    os.makedirs(folder, exist_ok=True)
    count_grams(docs.select(F.col("text").cast("string")), folder, buckets, words)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("size", pa.int64()), ("set_id", pa.int64()), ("shared", pa.binary()), ("posted", pa.list_(pa.int64()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[folder] = Counts(folder, buckets)
        counts = _COUNTS[folder]
        for batch in batches:
            row = 0
            for grams, sizes in gram_sets(batch.column(2), words):
                sets = counts.of(grams)
                ends = np.cumsum(sizes)
                shared = np.add.reduceat(np.append(sets > 1, False).astype(np.int64), np.minimum(ends - sizes, len(grams))) * (sizes > 0)
                least = _least(sizes, similarity)
                active = (sizes > 0) & (shared >= least)
                blobs: list[bytes | None] = [None] * len(sizes)
                posted: list[np.ndarray | None] = [None] * len(sizes)
                for i in np.flatnonzero(active):
                    own, own_sets = grams[ends[i] - sizes[i] : ends[i]], sets[ends[i] - sizes[i] : ends[i]]
                    common = own_sets > 1
                    wanted = int(sizes[i] - least[i] + 1 - (sizes[i] - shared[i]))
                    own, own_sets = own[common], own_sets[common]
                    blobs[i] = own.tobytes()
                    posted[i] = own[np.lexsort((own, own_sets))[:wanted]].view(np.int64)
                columns = [batch.column(0).slice(row, len(sizes)), batch.column(1).slice(row, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array(_set_ids(grams, sizes)), pa.array(blobs, pa.binary()), pa.array(posted, schema.field("posted").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                row += len(sizes)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(whole_text()).alias("text_hash"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(look, DESCRIBED), "gram-sets")


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def roots(self) -> np.ndarray:
        """Every node's root, all paths flattened."""
        while True:
            next_ = self.up[self.up]
            if (next_ == self.up).all():
                return self.up
            self.up = next_

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def search_links(sets: Sequence[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs among ``sets``; with ``side`` 0 and 1, of the pairs across sides.

    T-occurrence search by DivideSkip: for each set, the lists of its n-grams hold the earlier sets that
    have them. The L longest are put aside; whoever is in T - L of the others is looked up in the long ones.
    """
    n = len(sets)
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), lengths)
    grams = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.lexsort((owner, grams))
    owners, sorted_grams = owner[order], grams[order]
    first = np.flatnonzero(np.append(True, sorted_grams[1:] != sorted_grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    list_of = np.empty(len(grams), np.int64)
    list_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grams))))
    ends = np.append(first[1:], len(grams))
    starts = np.cumsum(lengths) - lengths
    up, down = similarity
    forest, links = Forest(n), []
    # an n-gram's place in its list: the sets before it are the earlier ones
    place = np.empty(len(grams), np.int64)
    place[order] = np.arange(len(grams))
    for x in range(n):
        own = slice(starts[x], starts[x] + lengths[x])
        lists, until = list_of[own], place[own]
        counts = until - first[lists]
        met = counts > 0
        lists, until, counts = lists[met], until[met], counts[met]
        least = -(-int(sizes[x]) * up // down)  # of any partner: T is largest for the smallest partner, so this is the least
        if len(lists) < least:
            continue
        by = np.argsort(counts, kind="stable")
        lists, until, counts = lists[by], until[by], counts[by]
        # DivideSkip's choice of how many long lists to put aside
        long = min(int(least / (0.0085 * np.log2(counts[-1] + 1) + 1)), least - 1)
        short = len(lists) - long
        begin = first[lists[:short]]
        take = np.repeat(begin - (np.cumsum(counts[:short]) - counts[:short]), counts[:short]) + np.arange(counts[:short].sum())
        candidates, found = np.unique(owners[take], return_counts=True)
        keep = found >= least - long
        both = int(sizes[x]) + sizes[candidates]
        needed = -(-both * up // (up + down))
        smaller, larger = np.minimum(sizes[x], sizes[candidates]), np.maximum(sizes[x], sizes[candidates])
        keep &= (found + long >= needed) & (smaller * down >= larger * up)
        if side is not None:
            keep &= side[candidates] != side[x]
        roots = forest.roots()
        keep &= roots[candidates] != roots[x]
        candidates, found, needed = candidates[keep], found[keep], needed[keep]
        if not len(candidates):
            continue
        for k in range(short, len(lists)):
            inside = owners[first[lists[k]] : until[k]]
            found = found + _hit(inside, candidates)[1]
            alive = found + (len(lists) - 1 - k) >= needed
            if not alive.all():
                candidates, found, needed = candidates[alive], found[alive], needed[alive]
                if not len(candidates):
                    break
        for y in candidates[found >= needed].tolist():
            if forest.join(x, y):
                links.append((y, x))
    return links


def link_sets(described: DataFrame, similarity: tuple[int, int] = SIMILARITY, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(a, b): links between set ids that connect all linked sets."""
    spark = described.sparkSession
    active = described.filter("shared IS NOT NULL").groupBy("set_id", "size").agg(F.first("shared").alias("shared"), F.first("posted").alias("posted"))
    active = stored(active, "active-sets")
    posted = active.select("set_id", F.explode("posted").alias("gram"))
    leaders = posted.groupBy("gram").agg(F.min("set_id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    together = posted.join(leaders, "gram").filter("set_id != leader").select(F.col("set_id").alias("a"), F.col("leader").alias("b")).distinct()
    groups = components(together)
    grouped = active.select("set_id", "size", "shared").join(groups, F.col("set_id") == F.col("node")).select("label", "set_id", "size", "shared")
    grouped = stored(grouped, "grouped-sets")
    grams = F.octet_length("shared") / 8
    loads = grouped.groupBy("label").agg(F.sum(grams).alias("grams")).withColumn("blocks", F.ceil(F.col("grams") / block_grams))
    total = loads.agg(F.sum("grams")).first()[0] or 0
    bins = max(1, int(total // block_grams))
    placed = grouped.join(loads.select("label", "blocks"), "label")
    small = placed.filter("blocks = 1").select(
        F.pmod(F.xxhash64("label"), F.lit(bins)).cast("bigint").alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("block"), "set_id", "size", "shared"
    )
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    # a set goes to every pair of blocks that its block is in
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    large = placed.filter("blocks > 1").withColumn("block", block).withColumn("p", F.explode(pairs)).select(
        F.col("label").alias("task"), "p.i", "p.j", "block", "set_id", "size", "shared"
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "set_id"], ignore_index=True)
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        side = (frame["block"].to_numpy() == j).astype(np.int8) if i != j else None
        links = search_links([np.frombuffer(s, np.uint64) for s in frame["shared"]], frame["size"].to_numpy(), side, similarity)
        ids = frame["set_id"].to_numpy()
        return pd.DataFrame({"a": [ids[a] for a, _ in links], "b": [ids[b] for _, b in links]}, dtype="int64")

    return small.unionByName(large).groupBy("task", "i", "j").applyInPandas(search, "a bigint, b bigint")


def classes(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row."""
    described = describe(docs, words, similarity)
    labels = components(link_sets(described, similarity))
    sets = described.filter("size > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = sets.join(labels, sets["set_id"] == labels["node"], "left").select("set_id", "least", F.coalesce("label", "set_id").alias("class"))
    smallest = named.groupBy("class").agg(F.min("least").alias("component_id"))
    of_set = named.join(smallest, "class").select(F.col("set_id").alias("_set"), "component_id")
    rows = described.select("doc_id", "text_hash", F.col("size").alias("n_shingles"), "set_id")
    linked = rows.filter("n_shingles > 0").join(of_set, F.col("set_id") == F.col("_set")).select("doc_id", "text_hash", "n_shingles", "component_id")
    return linked.unionByName(rows.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, columns: Sequence[str], words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``columns`` of one row of every class: the smallest id's; rows without words all stay."""
    rows = stored(classes(docs, words, similarity), "classes")
    linked = rows.filter("n_shingles > 0")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "doc_id", "text_hash")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"), F.lit(True).alias("_one"))
    wordless = rows.filter("n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(False).alias("_one")).distinct()
    hashed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"))
    joined = hashed.join(kept.unionByName(wordless), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    once = joined.filter("_one").dropDuplicates(["_id", "_hash"])
    return once.select("row.*").unionByName(joined.filter("NOT _one").select("row.*"))
