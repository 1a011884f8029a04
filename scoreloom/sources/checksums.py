"""Checksums of files of any size: byte ranges are read by tasks, and their sums combine by exclusive or.

A CRC-32 is linear over GF(2): the sum of a whole file is the exclusive or of its ranges' sums, each moved
by the number of bytes that follow its range. A task holds one block of a range at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: the CRC-32 polynomial, lowest power in the highest bit
POLYNOMIAL = 0xEDB88320
ONE, BYTE = 1 << 31, 1 << 23
BLOCK = 4 << 20


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return product


def moved(crc: int, n: int) -> int:
    """What ``crc`` adds to the sum of a file that goes on for ``n`` bytes after its range."""
    power, step = ONE, BYTE
    while n:
        if n & 1:
            power = _times(power, step)
        step, n = _times(step, step), n >> 1
    return _times(power, crc)


def _open(path: str):
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file://").removeprefix("file:"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _range_sum(path: str, start: int, n: int, length: int) -> int:
    crc, left = 0, n
    with _open(path) as file:
        file.seek(start)
        while left:
            block = file.read(min(BLOCK, left))
            if not block:
                raise OSError(f"{path} is shorter than when it was listed")
            crc, left = zlib.crc32(block, crc), left - len(block)
    return moved(crc, length - start - n)


def file_crc32(spark: SparkSession, path: str, part: int = 128 << 20) -> DataFrame:
    """(path, length, crc32) of every file under ``path``; ranges of ``part`` bytes are read side by side.

    Empty files have no row, as Spark's file reader leaves them out. Files must be readable by the workers
    under the paths that Spark lists.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(part).cast("bigint"))
    ranges = files.withColumn("start", F.explode(starts)).withColumn("n", F.least(F.lit(part).cast("bigint"), F.col("length") - F.col("start")))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            crc = [_range_sum(p, s, n, length) for p, s, n, length in zip(batch["path"], batch["start"], batch["n"], batch["length"])]
            yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "crc": pd.Series(crc, dtype="int64")})

    spread = ranges.repartition("path", "start")
    return spread.mapInPandas(sums, "path string, length long, crc long").groupBy("path", "length").agg(F.bit_xor("crc").alias("crc32"))
