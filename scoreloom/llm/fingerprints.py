"""Document fingerprints by a randomised edit embedding.

A text is embedded by a walk: at step j the walk stands on a character c, writes c down, and goes on
to the next character if a random bit, shared by all texts and fixed by (j, c), is set. Where two
texts differ the walks part, and as the bits are shared they meet again after a number of steps that
depends on the edit distance, not on the length; so few edits leave most written characters equal.
The Hamming distance of two embeddings thus stands for the edit distance of the texts.

A fingerprint keeps the characters written at sampled steps. A step's level is the number of trailing
zeros of its hash; a text takes the steps of the lowest level that leaves at most ``SAMPLES`` of them
on average, so texts of any length have samples in common with texts of similar and of other lengths.
Bands are small samples of a fingerprint; texts that share a band are compared by whole fingerprints,
with the leaders of its first groups of alike texts. What bands miss is found by pigeonholes: of more disjoint
blocks of samples than two alike fingerprints may differ in, one is the same in both.

The bits repeat after 256 steps, which makes a step one table lookup. Null and empty texts have an
empty embedding; two of them are alike (1), one of them is like no other text (0). Rows with equal or
null ids are rows of their own: order is by descending id, nulls last, then by a hash of the text. A
single row is its own next. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import mix, stored, whole_text
from scoreloom.llm.components import components

SAMPLES = 128
PERIOD = 256
PARTITION_BYTES = 16 << 20
#: characters embedded at a time
SEGMENT = 1 << 20
#: bands only gather most of what is alike; ``meeting_keys`` finds the rest
BANDS, BAND_SAMPLES = 8, 8
#: so many leaders a band are elected last
LEADERS = 16
ALIKE = 0.75


def _walk_states() -> list[list]:
    """State j as a list: entry c is the state after character c, the last entry is j itself."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    bits = rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    bits[0] |= bits.max(axis=0) == 0
    after = np.empty((PERIOD, 256), np.int64)
    following = np.argmax(bits, axis=0) + PERIOD
    for j in range(PERIOD - 1, -1, -1):
        following = np.where(bits[j] == 1, j, following)
        after[j] = (following + 1) % PERIOD
    states: list[list] = [[] for _ in range(PERIOD)]
    for j in range(PERIOD):
        states[j] += [states[k] for k in after[j].tolist()]
        states[j].append(j)
    return states


_STATES: list[list] = []
_STEPS: dict[str, np.ndarray] = {}


def _codes(text: str) -> np.ndarray:
    """A byte per code point; those below 256 are themselves."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (points ^ (points >> 8) * np.uint32(29) ^ (points >> 16) * np.uint32(101)).astype(np.uint8)


def _walk(codes: np.ndarray, at: int) -> np.ndarray:
    """The step (counted from the first's ``at``) after each character, as differences are unwrapped."""
    if not _STATES:
        _STATES.extend(_walk_states())
    out, state = [], at % PERIOD
    for k in range(0, len(codes), SEGMENT):
        raw = bytes(map(itemgetter(256), accumulate(codes[k : k + SEGMENT].tobytes(), getitem, initial=_STATES[state])))
        steps = np.frombuffer(raw, np.uint8)
        moved = (steps[1:] - steps[:-1]).astype(np.int64)
        moved[moved == 0] = PERIOD
        out.append(moved)
        state = int(steps[-1])
    return at + np.cumsum(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _levels(length: int) -> np.ndarray:
    """The level of each step below ``length``."""
    known = _STEPS.get("levels", np.zeros(0, np.uint8))
    if len(known) < length:
        grown = np.arange(max(length, 2 * len(known), 1 << 16), dtype=np.uint64)
        h = mix(grown + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1 << 62)
        low = h & (~h + np.uint64(1))
        known = np.log2(low.astype(np.float64)).astype(np.uint8)
        _STEPS.clear()
        _STEPS["levels"] = known
    return known


def sampled_steps(length: int, level: int) -> np.ndarray:
    """The steps below ``length`` of a level or higher."""
    name = f"at-{level}"
    levels = _levels(length)
    if name not in _STEPS:
        _STEPS[name] = np.flatnonzero(levels >= level)
    steps = _STEPS[name]
    return steps[: np.searchsorted(steps, length)]


def level_of(length: int) -> int:
    return max(0, (max(1, length) - 1) // SAMPLES).bit_length()


def embed(codes: np.ndarray, ends: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(length, level, sampled characters) of an embedding; ``ends``: the step after each character."""
    length = int(ends[-1]) if len(ends) else 0
    level = level_of(length)
    steps = sampled_steps(length, level)
    return length, level, codes[np.searchsorted(ends, steps, "right")]


def write(fingerprint: tuple[int, int, np.ndarray]) -> str:
    length, _, values = fingerprint
    return f"{length:x}:{values.tobytes().hex()}"


def read(text: str) -> tuple[int, int, np.ndarray]:
    head, _, body = text.partition(":")
    length = int(head, 16)
    return length, level_of(length), np.frombuffer(bytes.fromhex(body), np.uint8)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """The share of equal characters at the steps that the longer embedding is sampled at."""
    if a[0] < b[0]:
        a, b = b, a
    if not a[0]:
        return 1.0
    steps, own = sampled_steps(a[0], a[1]), sampled_steps(b[0], b[1])
    if not len(steps):
        return 1.0 if a[0] == b[0] else 0.0
    shared = steps[: np.searchsorted(steps, b[0])]
    return float((a[2][: len(shared)] == b[2][np.searchsorted(own, shared)]).sum() / len(steps))


def bands(fingerprint: tuple[int, int, np.ndarray]) -> list[int]:
    """Band keys on the own level and the next, so that texts on two sides of a level's border meet too."""
    length, level, values = fingerprint
    steps = sampled_steps(length, level)
    written = (steps * 256 + values).astype(np.uint64)
    which, out = np.arange(BANDS, dtype=np.uint64), []
    with np.errstate(over="ignore"):
        for up in (level, level + 1):
            at = np.flatnonzero(_levels(length)[steps] >= up) if up > level else np.arange(len(steps))
            if not len(at):
                continue
            # a band's own order of steps; it takes the first ones
            order = np.argsort(mix(steps[at].astype(np.uint64)[:, None] * np.uint64(12) + which % np.uint64(12) + (which // np.uint64(12) << np.uint64(40))), axis=0)[:BAND_SAMPLES]
            taken = written[at[order]]
            place = np.arange(len(taken), dtype=np.uint64)[:, None] * np.uint64(0x9FB21C651E98DF25)
            out += mix(mix(taken + place).sum(axis=0, dtype=np.uint64) + which + np.uint64(up * BANDS)).view(np.int64).tolist()
    return out


def above(value: Column, splits: list[int]) -> Column:
    """How many of the rising ``splits`` are below ``value``, by binary search; null values are below all."""
    if not splits:
        return F.lit(0)
    whole, steps = F.array(*[F.lit(s) for s in splits]), [1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]

    def step(at: Column, width: Column) -> Column:
        nxt = at + width
        return F.when((nxt <= len(splits)) & (F.get(whole, nxt - 1) < value), nxt).otherwise(at)

    return F.when(value.isNull(), 0).otherwise(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step))


def in_sequence(docs: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(run, ahead, doc_id, text): runs of consecutive ids, descending, each in one partition and in order.

    After its own rows a run holds the row that follows them (``ahead``), that of the first run after the last.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(1, -(-size // partition_bytes))
    splits = sorted({int(q) for q in rows.filter("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [k / runs for k in range(1, runs)], 1 / (8 * runs))}) if runs > 1 else []
    placed = rows.withColumn("run", F.lit(len(splits)) - above(F.col("doc_id"), splits))
    heads = placed.groupBy("run").agg(F.max("doc_id").alias("head")).orderBy("run").collect()
    head_of = [None] * (len(splits) + 1)
    before = [0] * (len(splits) + 1)
    for k, r in enumerate(heads):
        head_of[r["run"]], before[r["run"]] = r["head"], heads[k - 1]["run"]
    is_head = F.col("doc_id").eqNullSafe(F.get(F.array(*[F.lit(h).cast("bigint") for h in head_of]), F.col("run")))
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("ahead"))
    other = F.struct(F.get(F.array(*[F.lit(b) for b in before]), F.col("run")).alias("run"), F.lit(True).alias("ahead"))
    sent = placed.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, other)).otherwise(F.array(own))).alias("to")).select("to.run", "to.ahead", "doc_id", "text")
    dealt = sent.repartitionById(len(splits) + 1, F.col("run").cast("int"))
    return dealt.sortWithinPartitions("run", "ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, its edited text's, and how alike they and the next text's are.

    The edited text has its last half replaced by the beginning of the next document.
    """
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the row that waits for its next
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for number, ahead, doc, text in zip(*[batch.column(i) for i in range(4)], strict=True):
                number, ahead, text = number.as_py(), ahead.as_py(), text.as_py()
                if ahead and (before is None or before[0] != number):
                    continue  # a further row with the head's id
                codes = _codes(text)
                ends = _walk(codes, 0)
                mark = embed(codes, ends)
                if before is not None and before[0] == number:
                    out.append(_compare(before, text, codes, mark))
                    held += len(text)
                before = None if ahead else (number, doc.as_py(), text, codes, ends, mark)
                if held > SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return in_sequence(docs).mapInArrow(run, RESULT)


def _compare(row: tuple, next_text: str, next_codes: np.ndarray, next_mark: tuple) -> tuple:
    _, doc, text, codes, ends, mark = row
    n, half = len(text), len(text) // 2
    new = next_text[:half]
    edited_codes = np.concatenate([codes[: n - half], next_codes[:half]])
    kept = ends[: n - half]
    # the walk over what is kept is the same; only the new half is walked
    edited_ends = np.concatenate([kept, _walk(next_codes[:half], int(kept[-1]) if len(kept) else 0)])
    edited = embed(edited_codes, edited_ends)
    digest = hashlib.sha256((text[: n - half] + new).encode()).hexdigest()
    return doc, n, digest, write(mark), write(edited), likeness(mark, edited), likeness(mark, next_mark)


# ---- pigeonholes ----------------------------------------------------------------------------------

_KEY_PLACES: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
#: two random bits of each character
_BITS, _MORE_BITS = (np.random.Generator(np.random.PCG64(seed)).permutation(np.arange(256) % 2).astype(np.uint8) for seed in (77, 78))
_LEAST: dict[int, int] = {}
#: a text with fewer samples on a level above its own is too short for it: the level's texts have 64 or so
FEWEST = 16
PAIRS_AT_ONCE = 1_000_000
KEYS_A_TASK = 400_000
#: rows of one key that are compared in one task; more are dealt as pairs of blocks of so many
BLOCK = 4096
MEMBERS_A_TASK = 50_000


def _key_places(n: int, middle: bool) -> tuple[np.ndarray, np.ndarray]:
    """(scheme and block, places) of the blocks that lie within the first ``n`` samples; place -1 is none.

    Within the first m samples, m from 1, a scheme has more than m / 4 disjoint blocks: the first for m below
    12, the second for 12 to 47, the third from 48 on. A text takes part in each scheme that a shorter alike one may use.
    """
    known = _KEY_PLACES.get((n, middle))
    if known is None:
        every = lambda first: [range(k, k + 4) for k in range(first, n, 4)]
        blocks: list[tuple[int, int, Sequence[int]]] = []
        if middle and n < 16:
            blocks += [(0, k, b) for k, b in enumerate([range(1), range(1, 4), *every(4)])]
        if middle and 12 <= n < 64:
            blocks += [(1, k, b) for k, b in enumerate([*(range(k, 12, 4) for k in range(4)), *every(12)])]
        if n >= 48:
            blocks += [(2, k, b) for k, b in enumerate([*(range(k, 48, 14) for k in range(14)), *(range(c + k, c + 8, 2) for c in range(48, n, 8) for k in range(2))])]
        blocks = [x for x in blocks if x[2][-1] < n]
        places = np.array([[*b, *[-1] * (4 - len(b))] for _, _, b in blocks], np.int64).reshape(len(blocks), 4)
        known = _KEY_PLACES[n, middle] = np.array([scheme << 10 | k for scheme, k, _ in blocks], np.int64), places
    return known


def least_samples(level: int) -> int:
    """The samples of the shortest text of a level, counted some steps at a time."""
    if level and level not in _LEAST:
        length, mask = (SAMPLES << level >> 1) + 1, np.uint64((1 << level) - 1)
        with np.errstate(over="ignore"):
            _LEAST[level] = sum(
                int(np.count_nonzero(mix(np.arange(at, min(length, at + PERIOD * 256), dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)) & mask == 0))
                for at in range(0, length, PERIOD * 256))
    return _LEAST.get(level, 0)


def _held(fingerprint: tuple[int, int, np.ndarray], up: int) -> np.ndarray:
    """The samples at steps of level ``up`` or higher."""
    length, level, values = fingerprint
    return values[_levels(length)[sampled_steps(length, level)] >= up] if up > level else values


def meeting_keys(fingerprint: tuple[int, int, np.ndarray]) -> Iterator[tuple[np.ndarray, int, int, int, int]]:
    """(keys, low bits, high bits, more bits, samples) for each level at which the text is compared.

    Texts with a likeness of ``ALIKE`` or more share a key on the longer one's level: it has n samples there and
    the shorter one m of them, at most n / 4 are not the same, so at most m / 4 of the first m are not. The
    bits stand for the first 128 samples, the more bits for the first 64. Above the text's own level the samples are
    given as a negative number: two such texts are not compared there.
    """
    length, level, _ = fingerprint
    for up in range(level, level + 64):
        held = _held(fingerprint, up)
        n = len(held)
        if not n or n < FEWEST and up > level:
            return
        least = least_samples(up)
        if up > level and 4 * n < 3 * least:
            continue  # too short for any text of that level
        names, places = _key_places(n, not up or 3 * least < 4 * 48)
        codes = np.append(held, np.uint8(0))[places].astype(np.int64) @ (np.int64(1) << np.arange(0, 32, 8))
        bits = np.zeros(192, np.uint8)
        bits[: min(n, 128)] = _BITS[held[:128]]
        bits[128 : 128 + min(n, 64)] = _MORE_BITS[held[:64]]
        low, high, more = np.packbits(bits, bitorder="little").view(np.int64).tolist()
        yield codes | (names | up << 12) << 32, low, high, more, n if up == level else -n


def _meetings(table: pa.Table, block: int) -> pa.Table:
    """(key, mark, blocks): the rows with a key in common with one of another label that their bits do not rule out.

    A row is given once a key, with however many it may be alike. The rows of a key of more than ``block``
    are not compared here but all given, if of two labels, with the number of blocks to cut them into.
    """
    names = ("key", "mark", "label", "low", "high", "more", "n")
    rows = [table.column(c).to_numpy() for c in names]
    order = np.lexsort((rows[2], rows[0]))
    key, mark, label, low, high, more, n = (x[order] for x in rows)
    low, high, more, own, n = low.view(np.uint64), high.view(np.uint64), more.view(np.uint64), n > 0, np.abs(n).astype(np.int64)
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    other = np.append(True, label[1:] != label[:-1])[: len(key)] | fresh
    ends = lambda new: np.append(np.flatnonzero(new), len(key))[np.cumsum(new)]
    members = np.diff(np.append(np.flatnonzero(fresh), len(key)))[np.cumsum(fresh) - 1]
    blocks = -(-members // block)
    after, end = ends(other), ends(fresh)
    large = blocks > 1
    # all labels are one where the first one ends with the key
    given = large & (after[np.flatnonzero(fresh)] < end[np.flatnonzero(fresh)])[np.cumsum(fresh) - 1]
    many = np.where(large, 0, end - after)
    total = np.cumsum(many)
    ones = lambda k: np.where(k >= 64, ~np.uint64(0), (np.uint64(1) << np.clip(k, 0, 63).astype(np.uint64)) - np.uint64(1))
    at = 0
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        count = many[at:stop]
        a = np.repeat(np.arange(at, stop), count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + after[a]
        least, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        differ = np.bitwise_count((low[a] ^ low[b] | more[a] ^ more[b]) & ones(least)).astype(np.int64) + np.bitwise_count((high[a] ^ high[b]) & ones(least - 64))
        keep = (differ + most - least <= most // 4) & (own[a] | own[b])
        given[a[keep]] = given[b[keep]] = True
        at = stop
    return pa.table({"key": pa.array(key[given], pa.int64()), "mark": pa.array(mark[given], pa.int64()), "blocks": pa.array(blocks[given], pa.int32())})


def _linked(table: pa.Table, alike: float) -> pa.Table:
    """(a, b): a forest of labels with alike texts among the rows that share a key and a pair of blocks.

    Texts whose labels are connected already are not compared.
    """
    cells: dict[tuple[int, int, int], list[int]] = {}
    key, one, two, block, label = (table.column(c).to_pylist() for c in ("key", "one", "two", "block", "label"))
    for row, cell in enumerate(zip(key, one, two, strict=True)):
        cells.setdefault(cell, []).append(row)
    marks = [read(f) for f in table.column("fingerprint").to_pylist()]
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for (k, first, second), rows in cells.items():
        rows.sort(key=lambda r: block[r] == second and first != second)
        split = sum(block[r] == first for r in rows)
        tops = np.array([root(label[r]) for r in rows], np.int64)
        if (tops == tops[0]).all():
            continue
        up = k >> 44
        held = [_held(marks[r], up) for r in rows]
        n = np.array([len(h) for h in held])
        own = np.array([marks[r][1] == up for r in rows])
        width = int(n.max())
        values = np.full((len(rows), width), 256, np.uint16)
        for i, h in enumerate(held):
            values[i, : len(h)] = h
        for i in range(split):
            others = np.arange(i + 1 if first == second else split, len(rows))
            others = others[(tops[others] != tops[i]) & (own[others] | own[i])]
            if not len(others):
                continue
            most = np.maximum(n[others], n[i])
            # behind the longer of two both are filled up
            same = (values[others] == values[i]).sum(axis=1) - (width - most)
            for j in others[same / most >= alike].tolist():
                if tops[i] != tops[j]:
                    out.append((label[rows[i]], label[rows[j]]))
                    into, gone = int(tops[i]), int(tops[j])
                    parent[gone] = into
                    tops[tops == gone] = into
    return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})


def near_classes(marked: DataFrame, alike: float = ALIKE, block: int = BLOCK) -> DataFrame:
    """(fingerprint, label): fingerprints connected by shared bands and likeness of at least ``alike``.

    ``marked`` needs the column ``fingerprint``. Equal fingerprints are one. A band's members are compared
    with its first; those not alike to it with the next two that are left, then four, up to ``LEADERS``, so
    a band costs at most twice ``LEADERS`` comparisons a member. Texts of different groups that are alike but
    share no band, were led by others or are still left, meet by their keys (``meeting_keys``), of which those of one group are left out.
    A text goes on once for each key that it shares with a likely one, not once for each such text, and a task gives
    no more links than labels: rows grow with the texts of a group, comparisons of unlinked ones with their square.
    Keys are made for a likeness of ``ALIKE``; a lower ``alike`` is not taken.
    """
    if alike < ALIKE:
        raise ValueError(f"keys do not reach a likeness below {ALIKE}")
    marks = stored(marked.select("fingerprint").distinct().withColumn("mark", F.xxhash64("fingerprint")), "fingerprints")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bands(read(f)) for f in batch.column(0).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), pa.array([k for f in found for k in f], pa.int64())], names=["mark", "band"])

    # cheaper to compute twice than to keep: four dozen keys for each fingerprint
    banded = marks.mapInArrow(keys, "mark bigint, band bigint")
    leaders = banded.groupBy("band").agg(F.min("mark").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").withColumn("last", F.col("leader"))
    a = marks.select("mark", F.col("fingerprint").alias("fa"))
    b = marks.select(F.col("mark").alias("leader"), F.col("fingerprint").alias("fb"))
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [likeness(read(x), read(y)) >= alike for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def alike_pairs(met: DataFrame) -> DataFrame:
        both = met.select("mark", "leader").distinct().join(a, "mark").join(b, "leader")
        return stored(both.select("mark", "leader", "fa", "fb").mapInArrow(verify, "mark bigint, leader bigint"), "alike")

    left, found, many = banded, [], 1
    while True:
        met = stored(left.join(leaders, "band").filter("mark > leader").select("band", "mark", "leader", "last"), "met")
        if found and met.isEmpty():
            break
        found.append(alike_pairs(met))
        # the members that are no leaders and alike to none
        seen = met.filter("mark > last").join(found[-1].withColumn("alike", F.lit(1)), ["mark", "leader"], "left")
        left = stored(seen.groupBy("band", "mark").agg(F.max("alike").alias("alike")).filter("alike IS NULL").select("band", "mark"), "left")
        if many == LEADERS:
            break
        many *= 2
        place = F.row_number().over(Window.partitionBy("band").orderBy("mark"))
        first = left.withColumn("place", place).filter(F.col("place") <= many).select("band", F.col("mark").alias("leader"))
        leaders = first.join(first.groupBy("band").agg(F.max("leader").alias("last")), "band")
    linked = reduce(DataFrame.unionByName, found)
    # a mark's leaders belong together through it: tied to the first of them, which
    # many marks share, they need fewer links than one for each mark and leader
    tied = linked.groupBy("mark").agg(F.array_sort(F.collect_set("leader")).alias("l"))
    links = tied.select(F.explode(F.array_append(F.slice("l", F.lit(2), F.size("l")), F.col("mark"))).alias("a"), F.get("l", F.lit(0)).alias("b")).distinct()
    labels = components(links)
    named = stored(marks.join(labels, F.col("mark") == F.col("node"), "left").select("mark", "fingerprint", F.coalesce("label", "mark").alias("label")), "labels")

    def holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                met = [(row, *x) for row, text in enumerate(part.column(1).to_pylist()) for x in meeting_keys(read(text))]
                if not met:
                    continue
                many = [len(x[1]) for x in met]
                row = pa.array(np.repeat([x[0] for x in met], many), pa.int64())
                of = lambda k, kind: pa.array(np.repeat(np.array([x[k] for x in met], np.int64), many), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[1] for x in met]), pa.int64()), part.column(0).take(row), part.column(2).take(row), of(2, pa.int64()), of(3, pa.int64()), of(4, pa.int64()), of(5, pa.int32())],
                    names=["key", "mark", "label", "low", "high", "more", "n"])

    tasks = max(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-40 * marks.count() // KEYS_A_TASK))
    keyed = named.mapInArrow(holes, "key bigint, mark bigint, label bigint, low bigint, high bigint, more bigint, n int")
    dealt = keyed.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).repartition(tasks, "task")
    likely = stored(dealt.groupBy("task").applyInArrow(lambda table: _meetings(table, block), "key bigint, mark bigint, blocks int"), "likely")
    own = F.pmod(F.xxhash64(F.lit("block"), "mark"), F.col("blocks")).cast("int")
    cells = likely.withColumn("block", own).select("key", "mark", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = cells.select("key", "mark", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"))
    sent = cells.join(named, "mark").select("key", "one", "two", "block", "label", "fingerprint")
    tasks = max(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(likely.agg(F.sum("blocks")).first()[0] or 0) // MEMBERS_A_TASK))
    sent = sent.withColumn("task", F.pmod(F.xxhash64("key", "one", "two"), F.lit(tasks))).repartition(tasks, "task")
    joined = components(sent.groupBy("task").applyInArrow(lambda table: _linked(table, alike), "a bigint, b bigint").distinct())
    return named.join(joined.withColumnRenamed("label", "whole"), F.col("label") == F.col("node"), "left").select("fingerprint", F.coalesce("whole", "label").alias("label"))


def with_classes(marked: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``marked`` with ``class_id``: the smallest id among the texts of alike fingerprints."""
    marked = stored(marked, "marked")
    labels = near_classes(marked, alike)
    first = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("_first"))
    named = first.join(labels, "fingerprint")
    smallest = named.groupBy("label").agg(F.min("_first").alias("class_id"))
    classes = named.join(smallest, "label").select(F.xxhash64("fingerprint").alias("_mark"), "class_id")
    return marked.withColumn("_m", F.xxhash64("fingerprint")).join(classes, F.col("_m") == F.col("_mark")).drop("_m", "_mark")
