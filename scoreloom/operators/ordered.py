"""Ordered computations (positions, running totals) that stay parallel on hot groups.

A plain window over a group runs in one task. Here rows are cut into chunks of the integer order
column, each chunk is folded to one row, the folds are scanned, and only then does a window run
inside each (keys, chunk). No task sees more than one chunk of a group plus the folds of one scan.
The folds are cut into chunks of chunks again until a scan holds at most 2^16 of them, however sparse
the order column is, with keys as without. Null keys are a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 16


def same_keys_join(left: DataFrame, right: DataFrame, keys: Sequence[str], never_null: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Equi-join by columns of the same names in which a null equals a null; ``right``'s copies are left out."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in [*keys, *never_null]})
    on = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys] + [F.col(k) == F.col(f"_same_{k}") for k in never_null]
    return left.join(other, on, how).drop(*[f"_same_{k}" for k in [*keys, *never_null]])


def prefix_fold(
    df: DataFrame,
    value: Column,
    order: str | Sequence[str],
    out: str,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    fold: Callable[[Column], Column] = F.sum,
    width: int = DEFAULT_WIDTH,
    levels: int | None = None,
) -> DataFrame:
    """``out`` = fold of ``value`` over the *earlier* rows of the same ``keys`` (null for none).

    ``order`` is an integer column, or several in order of weight; rows equal in all of them are
    placed by ``tie``. A chunk holds the rows of ``width`` consecutive values of the last order
    column, so name enough of them to make rows (nearly) unique. ``levels``: how often folds are
    folded in turn; three times by default, which 64-bit orders need at most.
    """
    levels = levels or 3
    if not isinstance(order, str) and len(order) > 1:
        return _by_groups(df, value, list(order), out, keys, tie, fold, width, levels)
    order = order if isinstance(order, str) else order[0]
    chunk, base, part = f"_{out}_chunk", f"_{out}_base", f"_{out}_part"
    combine = _combiner(fold)
    # never null, so that no null filter keeps the two uses of the input from sharing one exchange
    number = F.coalesce(F.floor(F.col(order) / width), F.lit(0).cast("bigint"))
    cut = df.withColumn(chunk, number).withColumn(part, value)
    sums = cut.groupBy(*keys, chunk).agg(fold(F.col(part)).alias(part))
    if levels > 1:
        sums = prefix_fold(sums, F.col(part), chunk, base, keys, (), fold, width, levels - 1)
    else:
        over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        before = over.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn(base, fold(F.col(part)).over(before))
    inside = (
        Window.partitionBy(*keys, chunk).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = same_keys_join(cut, sums.drop(part), keys, [chunk])
    return joined.withColumn(out, combine(F.col(base), fold(F.col(part)).over(inside))).drop(chunk, base, part)


def _by_groups(df, value, order, out, keys, tie, fold, width, levels) -> DataFrame:
    """Fold of the earlier groups of the first order column, combined with the fold inside the group."""
    first, base, part = order[0], f"_{out}_outer", f"_{out}_group"
    groups = df.groupBy(*keys, first).agg(fold(value).alias(part))
    before = prefix_fold(groups, F.col(part), first, base, keys, (), fold, width, levels).drop(part)
    inside = prefix_fold(df, value, order[1:], out, [*keys, first], tie, fold, width, levels)
    joined = same_keys_join(inside, before, [*keys, first])
    return joined.withColumn(out, _combiner(fold)(F.col(base), F.col(out))).drop(base)


def _combiner(fold) -> Callable[[Column, Column], Column]:
    if fold is F.sum:
        return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    if fold is F.max:
        return lambda a, b: F.greatest(a, b)
    if fold is F.min:
        return lambda a, b: F.least(a, b)
    raise ValueError("fold must be sum, max or min")


def with_position(
    df: DataFrame, order: str | Sequence[str], out: str = "position", keys: Sequence[str] = (), tie: Sequence[str] = (),
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Zero-based rank of every row by ``order`` (then ``tie``), within ``keys`` or over all rows."""
    ranked = prefix_fold(df, F.lit(1).cast("bigint"), order, out, keys, tie, F.sum, width)
    return ranked.withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("bigint")))


def fold_id(df: DataFrame, order: str | Sequence[str], folds: int, out: str = "fold", tie: Sequence[str] = ()) -> DataFrame:
    """Round-robin shard of each row by its rank."""
    return with_position(df, order, "_rank", tie=tie).withColumn(out, F.pmod("_rank", F.lit(folds))).drop("_rank")


def uniform_sample(df: DataFrame, order: str | Sequence[str], k: int, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Per key all rows when k >= n, else the rows at floor(i * n / k) for i < k."""
    ranked = with_position(df, order, "_pos", keys, tie)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    pos, n = F.col("_pos"), F.col("_n")
    # i is the only candidate with floor(i * n / k) = pos: the smallest i with i * n >= pos * k
    i = F.floor((pos * k + n - 1) / n)
    return same_keys_join(ranked, sizes, keys).filter((n <= k) | ((i < k) & (F.floor(i * n / k) == pos))).drop("_n")
