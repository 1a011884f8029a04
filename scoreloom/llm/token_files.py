"""Token ids as binary files: concatenated ids with Elias-Fano coded document bounds.

Documents are range partitioned and sorted by id, so files follow each other in id order. A file
holds whole documents, about ``FILE_IDS`` ids. Its bounds (the end of each document in the id array)
are an Elias-Fano sequence: the low bits packed, the high bits in unary with a sampled select index.
That takes about ``2 + log2(ids / documents)`` bits a document instead of a 64-bit table, and any
document's bounds are found without reading the others.

Files are written through Spark as one binary value each, so they can lie in any store. Null ids come
first; null and empty texts hold their end id only; rows with equal ids lie side by side. An empty
table writes no file. Extra columns are ignored.

File: ``HEADER`` (little endian), then documents' ids (8 bytes each, null ones 0), a bit per document
that says whether its id is null, low bits, high bits, select samples (4 bytes each), token ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import new_path
from scoreloom.llm.tokens import END_ID, default_path, encoder

MAGIC = b"EFTOKEN1"
#: magic, documents, ids, bytes an id, low bits, bytes of low bits, bytes of high bits, samples
HEADER = struct.Struct("<8sQQBBQQQ")
FILE_IDS = 1 << 20
PARTITION_BYTES = 16 << 20
SAMPLE = 256
FILES = "part int, number int, documents bigint, ids bigint, file binary"


class EliasFano:
    """A rising sequence of integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The place of the i-th set bit: from the sample before it, byte by byte."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = divmod(at, 8)
        window = self.high[byte : byte + SAMPLE // 4 + 1].copy()
        window[0] &= (0xFF << bit) & 0xFF
        while True:
            counts = np.cumsum(np.bitwise_count(window))
            if len(window) and counts[-1] > left:
                k = int(np.searchsorted(counts, left, "right"))
                left -= int(counts[k - 1]) if k else 0
                ones = np.flatnonzero(np.unpackbits(window[k : k + 1], bitorder="little"))
                return (byte + k) * 8 + int(ones[left])
            left -= int(counts[-1])
            byte += len(window)
            window = self.high[byte : byte + 4096]

    def __getitem__(self, i: int) -> int:
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return ((self.select(i) - i) << self.low_bits) | (raw >> (first % 8)) & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        """All values, at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class TokenFile:
    """Reads one file's bytes (or a memory map of them); ids stay where they are until asked for."""

    def __init__(self, raw):
        view = np.frombuffer(raw, np.uint8)
        magic, n, self.n_ids, width, low_bits, n_low, n_high, n_samples = HEADER.unpack_from(raw, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        keys = np.frombuffer(raw, "<i8", n, at)
        at += 8 * n
        null = np.unpackbits(view[at : at + (n + 7) // 8], count=n, bitorder="little")
        at += (n + 7) // 8
        low, high = view[at : at + n_low], view[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        samples = np.frombuffer(raw, "<u4", n_samples, at)
        at += 4 * n_samples
        self.keys = [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)]
        self.bounds = EliasFano(n, low_bits, low, high, samples)
        self.ids = np.frombuffer(raw, f"<u{width}", self.n_ids, at)

    def __len__(self) -> int:
        return self.bounds.n

    def start(self, i: int) -> int:
        """Where a document begins in the file's ids, found by select."""
        return self.bounds[i - 1] if i else 0

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, found by select."""
        return self.ids[self.start(i) : self.bounds[i]]


def file_bytes(keys: list[int | None], parts: list[np.ndarray], width: int) -> bytes:
    ends = np.cumsum([len(p) for p in parts])
    bounds = EliasFano.encode(ends)
    head = HEADER.pack(MAGIC, len(keys), int(ends[-1]) if len(keys) else 0, width, bounds.low_bits, len(bounds.low), len(bounds.high), len(bounds.samples))
    null = np.packbits(np.array([k is None for k in keys], np.uint8), bitorder="little")
    body = [np.array([k or 0 for k in keys], "<i8"), null, bounds.low, bounds.high, bounds.samples, *[p.astype(f"<u{width}") for p in parts]]
    return b"".join([head, *[b.tobytes() for b in body]])


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Token files of every document in ascending id order, as rows (part, number, .., file) below ``path``."""
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("file", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            columns = [part, number, len(keys), held, file_bytes(keys, parts, width)]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                keys.append(key)
                parts.append(np.append(ids, ids.dtype.type(end_id)))
                held += len(ids) + 1
                if held >= file_ids:
                    yield closed()
                    keys, parts, held, number = [], [], 0, number + 1
        if keys:
            yield closed()

    ordered.mapInArrow(write, FILES).write.parquet(path)


def read_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files below ``path``."""
    files = spark.read.schema(FILES).parquet(path)
    counts = files.select("part", "number", "ids")
    by_part = counts.groupBy("part").agg(F.sum("ids").alias("_ids"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select(F.col("part").alias("_part"), F.coalesce(F.sum("_ids").over(before(F.lit(0), "part")), F.lit(0)).alias("_before"))
    starts = counts.withColumn("_inside", F.coalesce(F.sum("ids").over(before("part", "number")), F.lit(0)))
    starts = starts.join(parts, F.col("part") == F.col("_part")).select("part", "number", (F.col("_before") + F.col("_inside")).alias("first"))
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, raw in zip(*[batch.column(i) for i in range(3)], strict=True):
                file = TokenFile(raw.as_buffer())
                n = len(file)
                bounds = [(file.start(i), file.document(i)) for i in range(n)]
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in bounds]
                columns = [[part.as_py()] * n, [number.as_py()] * n, file.keys, [at for at, _ in bounds], [len(ids) for _, ids in bounds], crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = files.select("part", "number", "file").mapInArrow(read, "part int, number int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Files written to the shared folder and read back."""
    path = new_path(docs.sparkSession, "token-files")
    write_files(docs, path, tokenizer)
    return read_files(docs.sparkSession, path)
