"""Time arithmetic: clock strings, sampling of frames and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.text import bound
from scoreloom.operators.ordered import same_keys_join


def hms_to_seconds(s: Column) -> Column:
    part = lambda i: F.split_part(s, F.lit(":"), F.lit(i)).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def sample_array(items: Column, k: int) -> Column:
    """All when k >= n, else the items at floor(i * n / k)."""
    picked = lambda a: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(a, F.floor(i * F.size(a) / k).cast("int")))
    return bound(items, lambda a: F.when(F.size(a) <= k, a).otherwise(picked(a)))


def sample_by_rate(frames: Column, fps: Column, target: float) -> Column:
    """Frame numbers floor(i * fps / target) for int(duration * target) points."""
    points = F.floor(frames / fps * target).cast("int")
    return F.when(points > 0, F.transform(F.sequence(F.lit(0), points - 1), lambda i: F.floor(i * (fps / target)))).otherwise(F.array().cast("array<bigint>"))


def sample_by_count(frames: Column, n: int) -> Column:
    """Frame numbers floor(i * frames / (n + 1)), i = 1 .. n."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(i * (frames / (n + 1))))


def sample_in_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, k: int, fps: float) -> DataFrame:
    """Frames sampled inside a key's intervals, shared by length; all frames when k covers them.

    Each interval gets int(k * share) points, at least one, at the midpoints of equal segments.
    """
    frames = df.withColumns({"_a": F.round(F.col(start) * fps).cast("bigint"), "_b": F.round(F.col(end) * fps).cast("bigint")})
    totals = frames.groupBy(*keys).agg(F.sum(F.col("_b") - F.col("_a")).alias("_total"))
    length = F.col("_b") - F.col("_a")
    points = F.greatest(F.lit(1), F.floor(k * (length / F.col("_total"))).cast("int"))
    every = F.when(length > 0, F.sequence(F.col("_a"), F.col("_b") - 1)).otherwise(F.array().cast("array<bigint>"))
    segment = length / points
    chosen = F.transform(F.sequence(F.lit(0), points - 1), lambda i: F.floor(F.col("_a") + segment / 2 + segment * i))
    picked = same_keys_join(frames, totals, keys).withColumn("frame", F.explode(F.when(F.col("_total") <= k, every).otherwise(chosen)))
    return picked.drop("_a", "_b", "_total")
