"""What the operators share: the shared folder, stored tables, chunked positions, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on a local master (tests) a temporary one where it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """A small table made on the driver, as a local relation whose size the optimizer knows."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words of a text that is not null."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*+", "x")
    return F.length(marked).cast("bigint") - F.rlike(text, F.lit(r"^[\x20\x09-\x0D]")).cast("bigint") * F.length(F.regexp_extract(text, r"^[\x20\x09-\x0D]+", 0))


def numbered(df: DataFrame, group: str, order: Sequence[str], rows: int, out: str, chunk_rows: int = 20_000) -> DataFrame:
    """``out``: a gapless position from 0 inside ``group``, in parallel also inside one large group.

    Rows are dealt to chunks by a hash of ``order``; a position is the offset of the chunk plus the
    place in it. ``rows`` is the row count of ``df``, which fixes the number of chunks.
    """
    chunks = max(8, -(-rows // chunk_rows))
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(out), *order), F.lit(chunks)))
    counts = dealt.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(group, "_chunk").orderBy(*order)
    placed = dealt.withColumn("_place", F.row_number().over(inside).cast("bigint") - 1)
    joined = placed.join(offsets, [group, "_chunk"])
    return joined.withColumn(out, F.col("_offset") + F.col("_place")).drop("_chunk", "_offset", "_place")


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ---- words of Arrow text columns, as 64-bit hashes -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: letters and digits of ASCII and every byte of a longer character
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
WINDOW_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def _window_words(data: np.ndarray, starts_text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of one window; ``starts_text``: where texts begin in it."""
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = starts_text[(starts_text > 0) & (starts_text < len(data))]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return first, span_sums(low, first, last + 1)


def span_sums(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of ``data``, from differences of one running sum of weighted bytes."""
    with np.errstate(over="ignore"):
        up, down = _powers(max(WINDOW_BYTES, len(data)) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = (sums[end] - sums[first]) * down[first]
        return mix(h + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes under a text column and where its rows begin and end in them."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)), bounds


def word_hashes(texts: pa.Array, word: np.ndarray = ~_SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The words of every text, ASCII capitals lowered, as hashes: (first row, words per row, hashes) a group of rows at a time.

    Memory is bounded by the window and one text's hashes: long texts are read in windows cut between words.
    """
    data, bounds = text_buffers(texts)
    row = 0
    with np.errstate(over="ignore"):
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + WINDOW_BYTES, "right")) - 1)
            lo, hi = int(bounds[row]), int(bounds[end])
            if end == row + 1 and hi - lo > WINDOW_BYTES:
                parts, at = [], lo
                while at < hi:
                    stop = min(hi, at + WINDOW_BYTES)
                    while stop < hi and word[data[stop - 1]] and word[data[stop]]:
                        back = np.flatnonzero(~word[data[at:stop]])
                        stop = at + int(back[-1]) + 1 if len(back) else min(hi, stop + WINDOW_BYTES)
                    parts.append(_window_words(data[at:stop], np.zeros(1, np.int64), word)[1])
                    at = stop
                found = np.concatenate(parts)
                yield row, np.array([len(found)]), found
            else:
                starts = bounds[row : end + 1] - lo
                first, found = _window_words(data[lo:hi], starts, word)
                yield row, np.diff(np.searchsorted(first, starts, "left")), found
            row = end


def arrow_bytes(values: Sequence[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())
