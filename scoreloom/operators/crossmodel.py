"""Sorting, set operations and reports across models, datasets and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed
from scoreloom.operators.ordered import with_position


def sort_by_index(df: DataFrame, index: str = "index") -> DataFrame:
    """Global order for a sink; numeric ids by value, others as text."""
    return df.orderBy(F.col(index).try_cast("bigint"), index)


def worst_cases(df: DataFrame, failed: Column, order: Sequence[Column]) -> DataFrame:
    """Every failed row, in ``order``."""
    return df.filter(failed).orderBy(*order)


def miss_distance(x: Column, y: Column, box: Column) -> Column:
    """Distance of a point outside a box to its border, 0 inside."""
    dx = F.greatest(box["x1"] - x, F.lit(0.0), x - box["x2"])
    dy = F.greatest(box["y1"] - y, F.lit(0.0), y - box["y2"])
    return F.sqrt(dx * dx + dy * dy)


def concat_datasets(parts: Mapping[str, DataFrame], order: str, tie: Sequence[str] = ()) -> DataFrame:
    """Tagged union with a new dense index; the members' own index kept as ``original_index``."""
    tagged = [df.withColumn("SUB_DATASET", F.lit(name)).withColumnRenamed("index", "original_index") for name, df in parts.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return with_position(whole, order, "index", tie=["SUB_DATASET", *tie])


def split_datasets(df: DataFrame, name: str) -> DataFrame:
    """One member back, with its original index."""
    return df.filter(F.col("SUB_DATASET") == name).drop("index", "SUB_DATASET").withColumnRenamed("original_index", "index")


def distinct_keys(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Distinct keys of a without b (``difference``) or in both (``intersection``)."""
    return a.subtract(b) if how == "difference" else a.intersect(b)


def leaderboard(scores: DataFrame, metrics: Sequence[str], model: str = "model", metric: str = "metric", value: str = "value") -> DataFrame:
    """Model x metric, absent values null."""
    return scores.groupBy(model).pivot(metric, list(metrics)).agg(F.first(value))


def headline(scores: DataFrame, rules: Mapping[str, tuple[Sequence[str], float]], model: str = "model", dataset: str = "dataset", metric: str = "metric", value: str = "value") -> DataFrame:
    """One headline value per (model, dataset): the sum of the listed metrics times a factor."""
    chosen = [F.when((F.col(dataset) == d) & F.col(metric).isin(list(ms)), F.col(value) * f) for d, (ms, f) in rules.items()]
    kept = scores.withColumn("_v", F.coalesce(*chosen)).filter(F.col("_v").isNotNull())
    return kept.groupBy(model, dataset).agg(F.round(F.sum("_v"), 6).alias("headline"))


def experiment_summary(scores: DataFrame, datasets: Sequence[str], weighted: bool = False) -> DataFrame:
    """Per metric: experiments x datasets x 100 with a (size-weighted) mean, null if any is missing.

    ``scores`` holds (metric, model, dataset, value, n), one row per cell.
    """
    listed = scores.filter(F.col("dataset").isin(list(datasets)))
    total = F.sum(F.col("value") * F.col("n")) / F.sum("n") if weighted else F.sum("value") / len(datasets)
    cells = [F.round(F.max(F.when(F.col("dataset") == d, F.col("value"))) * 100, 2).alias(d) for d in datasets]
    return listed.groupBy("metric", "model").agg(
        *cells, F.when(F.count("*") == len(datasets), F.round(total * 100, 2)).alias("summary"))


def transpose_report(report: DataFrame, splits: Sequence[str], digits: int = 1) -> DataFrame:
    """Categories down, splits across, x 100; input is long (split, group, value).

    Values should not be rounded yet (``rp.accuracy(.., digits=None)``): they are rounded here, once.
    """
    return report.groupBy("group").pivot("split", list(splits)).agg(F.round(F.first("value") * 100, digits))


def radar_normalise(scores: DataFrame, metric: str = "metric", value: str = "value", log: bool = False) -> DataFrame:
    """Rescale every metric to 0..100 in a common range around its middle.

    The common range is the widest metric range x 1.25 (x 1.005 for logs); it is moved below 100
    when it would exceed it. Metric ranges are one small row each.
    """
    v = F.log(value) if log else F.col(value)
    ranges = scores.groupBy(metric).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    span = ranges.agg((F.max(F.col("_hi") - F.col("_lo")) * (1.005 if log else 1.25)).alias("s")).scalar()
    placed = scores.join(ranges, metric).withColumn("_span", span)
    top = (F.col("_lo") + F.col("_hi")) / 2 + F.col("_span") / 2
    start = F.when(top < 100, top - F.col("_span")).otherwise(100 - F.col("_span"))
    return placed.withColumn("scaled", F.round((v - start) / F.col("_span") * 100, 6)).drop("_lo", "_hi", "_span")


def response_coverage(truth: DataFrame, responses: DataFrame, key: str, processed: str, groups: Sequence[str] = ()) -> DataFrame:
    """Expected files, files without a response, files that failed post-processing, success ratio."""
    seen = responses.select(key, F.col(processed).alias("_p"), F.lit(1).alias("_seen"))
    joined = truth.join(seen, key, "left")
    total, missing = F.count("*"), F.count_if(F.col("_seen").isNull())
    failed = F.count_if(F.col("_seen").isNotNull() & F.col("_p").isNull())
    return joined.groupBy(*groups).agg(
        total.alias("total"), missing.alias("missing"), failed.alias("failed"), F.round((total - missing - failed) / total, 6).alias("success"))


def failure_scan(results: DataFrame, prediction: str, log: str, score: str) -> DataFrame:
    """Per model and dataset: failed inferences and failed judgements with their shares."""
    bad = F.col(prediction).contains(fixed.FAILURE_TEXT)
    judged = F.col(log).contains("All 5 retries failed.") | F.col(log).contains(fixed.FAILURE_TEXT) | (F.col(score) == -1)
    n = F.count("*")
    return results.groupBy("model", "dataset").agg(
        F.count_if(bad).alias("failed"), F.round(F.count_if(bad) * 100.0 / n, 6).alias("failed_share"),
        F.count_if(F.coalesce(judged, F.lit(False))).alias("judge_failed"), n.alias("n"))


def merge_shards(shards: Sequence[DataFrame], key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union of result shards; a later shard wins for its keys."""
    tagged = [df.withColumn("_shard", F.lit(i)) for i, df in enumerate(shards)]
    whole = reduce(lambda a, b: a.unionByName(b), tagged)
    last = F.max_by(F.struct(*columns), F.col("_shard"))
    return whole.groupBy(*key).agg(last.alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in columns])


def latest_run(runs: DataFrame, keys: Sequence[str] = ("model", "dataset"), eval_id: str = "eval_id", columns: Sequence[str] = ()) -> DataFrame:
    """Newest run per key by run id, then by the carried columns."""
    best = F.max(F.struct(eval_id, *columns)).alias("_r")
    return runs.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (eval_id, *columns)])
