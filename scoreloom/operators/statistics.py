"""Corpus metrics as mergeable statistics: rows are mapped to numbers, numbers are merged, and a formula closes them.

A statistic's numbers merge by sum, least or greatest, so Spark combines them before it shuffles, tables of
partial results can be merged later, and any grouping uses the same three steps. ``STATISTICS`` finds them by name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.text import words
from scoreloom.operators import corpus as cp

_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Statistic:
    """``spread`` makes the numbers of each row (columns named by ``merges``, beside the group), ``close`` the value from merged ones."""

    spread: Callable[[DataFrame, Sequence[str]], DataFrame]
    merges: Mapping[str, str]
    close: Callable[[], Column]

    def merge(self, parts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
        """Numbers per group from those of rows or of other groups."""
        return parts.groupBy(*group).agg(*[_MERGES[how](c).alias(c) for c, how in self.merges.items()])

    def partial(self, df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
        return self.merge(self.spread(df, group), group)

    def closed(self, merged: DataFrame, group: Sequence[str] = (), out: str = "value", digits: int = 6) -> DataFrame:
        return merged.select(*group, F.round(self.close(), digits).alias(out))

    def value(self, df: DataFrame, group: Sequence[str] = (), out: str = "value", digits: int = 6) -> DataFrame:
        return self.closed(self.partial(df, group), group, out, digits)


def share(part: Column, whole: Column, scale: float = 1.0) -> Statistic:
    """Sum of ``part`` over sum of ``whole``: precision, recall, accuracy, a weighted mean."""
    numbers = lambda df, group: df.select(*group, part.cast("double").alias("_part"), F.when(part.isNotNull(), whole).cast("double").alias("_whole"))
    return Statistic(numbers, {"_part": "sum", "_whole": "sum"}, lambda: F.try_divide(scale * F.col("_part"), F.col("_whole")))


def mean(value: Column) -> Statistic:
    return share(value, F.lit(1))


def _grams(overlap: Callable[[DataFrame, Sequence[str]], DataFrame], order: int, close: Callable[[], Column]) -> Statistic:
    """A statistic over n-gram counts (h, r, m) of each order from 1 to ``order``."""
    names = [f"{c}{n}" for n in range(1, order + 1) for c in "hrm"]
    each = lambda df: [F.when(F.col("n") == int(x[1:]), F.col(x[0])).otherwise(0).alias(x) for x in names]
    return Statistic(lambda df, group: (lambda found: found.select(*group, *each(found)))(overlap(df, group)), {x: "sum" for x in names}, close)


def bleu(ids: Sequence[str], hyp: str, ref: str, order: int = 4) -> Statistic:
    """Corpus BLEU: clipped precisions, brevity penalty, no smoothing."""

    def overlap(df: DataFrame, group: Sequence[str]) -> DataFrame:
        keys = [*ids, *[g for g in group if g not in ids]]
        return cp.gram_overlap(cp.gram_counts(df, keys, words(F.col(hyp)), words(F.col(ref)), order), keys)

    def close() -> Column:
        logs = sum((F.log(F.col(f"m{n}") / F.col(f"h{n}")) for n in range(1, order + 1)), F.lit(0.0)) / order
        all_met = F.least(*[F.col(f"m{n}") for n in range(1, order + 1)], F.lit(1)) > 0
        brevity = F.when(F.col("h1") >= F.col("r1"), 1.0).otherwise(F.exp(1.0 - F.col("r1") / F.col("h1")))
        return F.when(all_met, brevity * F.exp(logs)).otherwise(0.0)

    return _grams(overlap, order, close)


def chrf(ids: Sequence[str], hyp: str, ref: str, order: int = 6, beta: float = 2.0) -> Statistic:
    """Corpus chrF: counts are summed before the ratios."""

    def overlap(df: DataFrame, group: Sequence[str]) -> DataFrame:
        return cp.character_overlap(df, [*ids, *[g for g in group if g not in ids]], F.col(hyp), F.col(ref), order)

    return _grams(overlap, order, lambda: cp._chrf_of([tuple(F.col(f"{c}{n}") for c in "hrm") for n in range(1, order + 1)], beta))


STATISTICS: dict[str, Callable[..., Statistic]] = {"mean": mean, "share": share, "bleu": bleu, "chrf": chrf}


def weighted_fields(scores: Column, weights: Column) -> Column:
    """Mean of a map of field scores, each weighted by its field's weight (1 where none is given); 0 without fields or weight."""
    weight = lambda e: F.coalesce(F.try_element_at(weights, e["key"]), F.lit(1.0)).cast("double")
    entries = F.map_entries(scores)
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["value"].cast("double") * weight(e))
    mass = F.aggregate(entries, F.lit(0.0), lambda s, e: s + weight(e))
    return F.when(mass > 0, total / mass).otherwise(0.0)


#: aggregation name -> builder of a row's score from its field scores and weights
AGGREGATIONS: dict[str, Callable[[Column, Column], Column]] = {"mean": weighted_fields}


def aggregate_fields(df: DataFrame, scores: str, weights: str, how: str = "mean", out: str = "score") -> DataFrame:
    """``out``: the row's field scores aggregated by the named rule; unknown names are the mean."""
    return df.withColumn(out, AGGREGATIONS.get(how, weighted_fields)(F.col(scores), F.col(weights)))
