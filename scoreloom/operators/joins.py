"""Joins of predictions, items, intervals and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import extract as ex
from scoreloom.operators.items import item_options
from scoreloom.operators.ordered import prefix_fold, same_keys_join, with_position


def attach_ground_truth(predictions: DataFrame, items: DataFrame, key: str = "index", answer: str = "answer") -> DataFrame:
    """Predictions of known items with their answer as ``GT``; strategy left to the optimizer."""
    return predictions.join(items.select(key, F.col(answer).alias("GT")), key)


def unknown_predictions(predictions: DataFrame, items: DataFrame, key: str = "index") -> DataFrame:
    """Predictions whose item is not in the benchmark; must be empty for a valid run."""
    return predictions.join(items.select(key), key, "left_anti")


def attach_optional(predictions: DataFrame, items: DataFrame, column: str, key: str = "index") -> DataFrame:
    return predictions.join(items.select(key, column), key, "left")


def rule_hits(predictions: DataFrame, items: DataFrame, key: str = "index") -> DataFrame:
    """Items joined with replies; ``inferred`` label and 0/1 ``hit``, unmatched replies 0."""
    joined = predictions.join(items, key).withColumn("inferred", ex.infer(F.col("prediction"), item_options()))
    return joined.withColumn("hit", F.coalesce((F.col("inferred") == F.col("answer")).cast("int"), F.lit(0)))


def align_parallel(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str], kind: str = "question_type") -> DataFrame:
    """Open questions of both sides joined on ``key``; columns get _src / _tgt when they exist."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = df.filter(F.col(kind) == "SAQ") if kind in df.columns else df
        return rows.select(key, *[F.col(c).alias(f"{c}_{tag}") for c in columns if c in df.columns])

    return side(source, "src").join(side(target, "tgt"), key)


def unmatched_source(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return source.select(key).join(target.select(key), key, "left_anti")


def join_variants(df: DataFrame, on: Sequence[str], variant: str, variants: Sequence, value: str = "hit") -> DataFrame:
    """One ``<value>_<v>`` column per variant, for the keys that have every variant."""
    columns = [F.max(F.when(F.col(variant) == v, F.col(value))).alias(f"{value}_{v}") for v in variants]
    return df.groupBy(*on).agg(*columns).dropna(subset=[f"{value}_{v}" for v in variants])


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int = 1 << 16) -> DataFrame:
    """Overlapping or touching intervals of a key merged.

    Starts are integers, cut into chunks of ``width``. A chunk merges its own intervals and is then known by
    two numbers, the start of its last island and how far it reaches. Such pairs combine in order: an
    island that begins within the reach of all before it belongs to the last island before. One scan over
    a key's pairs so tells every chunk what it continues; a hot key is spread over its chunks.
    """
    chunk, island = "_chunk", "_island"
    longest = df.groupBy(*keys, F.coalesce(F.floor(F.col(start) / width), F.lit(0)).alias(chunk), start).agg(F.max(end).alias(end))
    inside = Window.partitionBy(*keys, chunk).orderBy(start)
    reach = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = longest.withColumn("_reach", reach).withColumn(island, F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start)))
    own = marked.withColumn(island, F.max(island).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    islands = own.groupBy(*keys, chunk, island).agg(F.max(end).alias(end))
    pairs = islands.groupBy(*keys, chunk).agg(F.max(island).alias("_last"), F.max(end).alias("_far"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    known = pairs.withColumn("_reach", F.max("_far").over(before))
    fresh = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))
    carried = known.withColumn("_open", F.max(fresh).over(before)).select(*keys, chunk, "_reach", "_open")
    joined = same_keys_join(islands, carried, keys, [chunk])
    begin = F.when(F.col(island) <= F.col("_reach"), F.col("_open")).otherwise(F.col(island))
    return joined.groupBy(*keys, begin.alias(start)).agg(F.max(end).alias(end))


def _slices(start: Column, end: Column, width: int) -> Column:
    """Time slices an interval touches."""
    return F.sequence(F.floor(start / width), F.floor(end / width))


def interval_overlap_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, width: int
) -> DataFrame:
    """Overlap length per key of two interval tables, without pairing far-apart intervals.

    Both sides are cut at slice borders and joined on (key, slice); the pieces of one slice overlap
    independently of the others, so the lengths add up and hot keys spread over slices.
    """

    def pieces(df: DataFrame, tag: str) -> DataFrame:
        cut = df.select(*keys, start, end, F.explode(_slices(F.col(start), F.col(end), width)).alias("_slice"))
        low, high = F.col("_slice") * width, (F.col("_slice") + 1) * width
        return cut.select(*keys, "_slice", F.greatest(start, low).alias(f"{tag}_start"), F.least(end, high).alias(f"{tag}_end")).filter(
            F.col(f"{tag}_end") > F.col(f"{tag}_start"))

    met = same_keys_join(pieces(a, "a"), pieces(b, "b"), keys, ["_slice"])
    length = F.greatest(F.lit(0), F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))
    return met.groupBy(*keys).agg(F.sum(length).alias("overlap"))


def interval_iou_by_key(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, width: int = 1 << 16) -> DataFrame:
    """Merged overlap over union length per key, 0 without overlap.

    Both sides and their union are merged in one pass; the overlap is what the sides' lengths exceed the union's by.
    """
    side = lambda df, name: df.select(*keys, start, end, F.explode(F.array(F.lit(name), F.lit("u"))).alias("_side"))
    merged = merge_intervals(side(a, "a").unionByName(side(b, "b")), [*keys, "_side"], start, end, width)
    length = lambda name: F.coalesce(F.sum(F.when(F.col("_side") == name, F.col(end) - F.col(start))), F.lit(0).cast("bigint"))
    sums = merged.groupBy(*keys).agg(length("a").alias("a"), length("b").alias("b"), length("u").alias("union_length"))
    shared = F.col("a") + F.col("b") - F.col("union_length")
    return sums.select(*keys, shared.alias("overlap"), "union_length", F.round(F.coalesce(F.try_divide(shared, F.col("union_length")), F.lit(0.0)), 6).alias("iou"))


def _stretches(spans: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """``spans`` once per stretch of time: (_level, _node).

    Time is cut into cells of ``width``. The cells that lie wholly in a span are the fewest nodes of a binary
    tree over all cells (two a level at most); the cells of its two ends are at level -1.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    node = lambda level, n: F.struct(level.cast("int").alias("level"), n.cast("bigint").alias("node"))
    kind = "struct<lo:bigint,hi:bigint,out:array<struct<level:int,node:bigint>>>"
    state = lambda lo, hi, out: F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), out.alias("out")).cast(kind)
    odd = lambda n: F.pmod(n, F.lit(2)) == 1

    def step(s: Column, level: Column) -> Column:
        first = (s["lo"] < s["hi"]) & odd(s["lo"])
        lo = s["lo"] + first.cast("bigint")
        last = (lo < s["hi"]) & odd(s["hi"])
        hi = s["hi"] - last.cast("bigint")
        out = F.concat(s["out"], F.array_compact(F.array(F.when(first, node(level, s["lo"])), F.when(last, node(level, hi)))))
        return state(F.shiftright(lo, 1), F.shiftright(hi, 1), out)

    none = F.array().cast("array<struct<level:int,node:bigint>>")
    whole = F.greatest(F.lit(0), cell(end) - cell(start) - 1)
    levels = F.sequence(F.lit(0), F.ceil(F.log2(whole + 1.0)).cast("int"))
    inner = F.aggregate(levels, state(cell(start) + 1, cell(start) + 1 + whole, none), step, lambda s: s["out"])
    ends = F.array_distinct(F.array(node(F.lit(-1), cell(start)), node(F.lit(-1), cell(end))))
    kept = spans.filter(F.col(start) < F.col(end))
    return kept.withColumn("_s", F.explode(F.concat(ends, inner))).withColumns({"_level": F.col("_s.level"), "_node": F.col("_s.node")}).drop("_s")


def _climb(frames: DataFrame, stretches: DataFrame, key: str, time: str, width: float) -> DataFrame:
    """``frames`` once per level that spans of their key have: (_level, _node) of the stretch they lie in."""
    top = stretches.groupBy(key).agg(F.max("_level").alias("_top"))
    marked = same_keys_join(frames, top, [key]).withColumn("_level", F.explode(F.sequence(F.lit(-1), F.col("_top"))))
    cell = F.floor(F.col(time) / width).cast("bigint")
    return marked.withColumn("_node", F.call_function("shiftright", cell, F.greatest("_level", F.lit(0)))).drop("_top")


def _within(time: str, start: str, end: str) -> Column:
    return (F.col(start) < F.col(time)) & (F.col(time) < F.col(end))


def spans_covering(frames: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of a frame and a span of the same key (null is one) with start < time < end.

    A frame meets a span in the one stretch of the span it lies in, so the cost follows the rows, times
    the logarithm of the spans' length in cells of ``width``, and the result.
    """
    cut = _stretches(spans, start, end, width)
    met = same_keys_join(_climb(frames, cut, key, time, width), cut, [key], ["_level", "_node"])
    return met.filter(_within(time, start, end)).drop("_level", "_node")


def first_span_per_frame(frames: DataFrame, spans: DataFrame, key: str, frame: str, time: str, start: str, end: str, rank: str, text: str, width: float) -> DataFrame:
    """Form one: per frame the first covering span by ``rank`` (then by text).

    Of the spans that cover a stretch only the first is kept, so any number of long spans costs a row a stretch.
    """
    cut = _stretches(spans.select(key, start, end, F.struct(F.col(rank).alias("rank"), F.col(text).alias("text")).alias("_first")), start, end, width)
    climbed = _climb(frames.select(key, frame, time), cut, key, time, width)
    whole = cut.filter("_level >= 0").groupBy(key, "_level", "_node").agg(F.min("_first").alias("_first"))
    inner = same_keys_join(climbed, whole, [key], ["_level", "_node"])
    edges = same_keys_join(climbed.filter("_level < 0"), cut.filter("_level < 0"), [key], ["_level", "_node"]).filter(_within(time, start, end))
    columns = [key, frame, time, "_first"]
    return inner.select(*columns).unionByName(edges.select(*columns)).groupBy(key, frame, time).agg(F.min("_first")["text"].alias(text))


def next_frame(spans: DataFrame, frames: DataFrame, key: str, time: str, after: str, out: str, width: int) -> DataFrame:
    """``spans`` with the time of the first frame of their key later than ``after`` (null for none): one sweep from the last event to the first."""
    seconds = lambda c: F.col(c).cast("double")
    events = spans.withColumns({"_t": seconds(after), "_frame": F.lit(None).cast("double"), "_span": F.lit(True)}).unionByName(
        frames.select(key, seconds(time).alias("_t"), seconds(time).alias("_frame"), F.lit(False).alias("_span")).distinct(), allowMissingColumns=True)
    swept = prefix_fold(events.withColumn("_o", -F.floor("_t")), F.col("_frame"), "_o", out, [key], [F.desc("_t"), F.desc("_span")], F.min, width)
    return swept.filter("_span").drop("_t", "_frame", "_span", "_o")


def distinct_spans(frames: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, text: str, width: int) -> DataFrame:
    """Form two: every distinct text that covers some frame, with the first frame time it is seen at."""
    met = next_frame(spans.select(key, start, end, text).filter(F.col(start) < F.col(end)), frames, key, time, start, "_seen", width).filter(F.col("_seen") < F.col(end))
    return met.groupBy(key, text).agg(F.min("_seen").cast(frames.schema[time].dataType).alias("first_seen"))


def place_spans_among_frames(
    frames: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, text: str, width: int, duration: str | None = None
) -> DataFrame:
    """Frames and kept spans of each key in reading order.

    A span stands after the frames at or before its midpoint and is kept when some frame lies
    inside it; spans shorter than a second are widened by half a second on both sides. A span with an
    open end lasts to ``duration`` (a column of ``spans``), else to its key's last frame. Repeated
    spans are kept as often as they occur.
    """
    if duration is None:
        last = frames.groupBy(key).agg(F.max(time).alias("_last"))
        spans = same_keys_join(spans, last, [key], how="left")
    closed = spans.withColumn(end, F.coalesce(F.col(end), F.col(duration or "_last")))
    counted = closed.groupBy(key, text, start, end).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    middle = (F.col(start) + F.col(end)) / 2
    short = F.col(end) - F.col(start) < 1
    widened = counted.select(
        key, text, start, end, "_times", middle.alias("_at"),
        F.when(short, middle - 0.5).otherwise(F.col(start)).alias("_from"), F.when(short, middle + 0.5).otherwise(F.col(end)).alias("_to"))
    met = next_frame(widened, frames, key, time, "_from", "_seen", width).filter(F.col("_seen") < F.col("_to")).select(key, text, start, end, "_at", "_times")
    kept = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    events = frames.select(key, F.col(time).cast("double").alias("seconds"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias(text)).unionByName(
        kept.select(key, F.col("_at").alias("seconds"), F.lit(1).alias("kind"), text))
    whole = events.withColumn("_second", F.floor("seconds"))
    return with_position(whole, "_second", "position", [key], ["seconds", "kind", text], width).drop("_second")


def step_chain_join(df: DataFrame, key: str, step: str, steps: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of all steps side by side per id that has the first step; missing steps are null."""
    aggs = [F.max(F.when(F.col(step) == s, F.col(v))).alias(f"{v}_{s}") for s in steps for v in values]
    wide = df.groupBy(key).agg(*aggs, F.max(F.when(F.col(step) == steps[0], 1)).alias("_first"))
    return wide.filter(F.col("_first") == 1).drop("_first")


def taxonomy_join(scores: DataFrame, nodes: DataFrame, leaf: str, root: str, value: str) -> DataFrame:
    """Mean per leaf, then the mean of the leaf means per root; leaves without scores stay out."""
    means = scores.groupBy(leaf).agg(F.avg(value).alias("m"))
    return nodes.join(means, leaf, "left").groupBy(root).agg(F.round(F.avg("m"), 6).alias("value"), F.count("m").alias("leaves"))


def baseline_join(df: DataFrame, key: str, tag: str, removed: str, main: str, aux: str, text: str) -> DataFrame:
    """Main rows with the unconstrained answer of the aux row for the same (id, removed key)."""
    base = df.filter(F.col(tag) == aux).select(key, removed, F.col(text).alias("baseline"))
    return df.filter(F.col(tag) == main).join(base, [key, removed], "left")


def reverse_pair_union(df: DataFrame, index: str, first: str, second: str, both_orders: bool = True) -> DataFrame:
    """Every pair in both orders; reversed rows get ``_rev`` on the index and swapped sides."""
    if not both_orders:
        return df
    swapped = df.withColumns({index: F.concat(F.col(index), F.lit("_rev")), first: F.col(second), second: F.col(first)})
    return df.unionByName(swapped)


def undone(items: DataFrame, results: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Items without an accepted result; rows where ``failed`` holds count as not done."""
    done = results if failed is None else results.filter(~failed)
    return items.join(done.select(key), key, "left_anti")


def missing_matrix(
    runs: DataFrame, models: Sequence[str], datasets: Sequence[str], halves: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """(model, dataset) pairs of the two lists without a run; all halves of a dataset count as the whole."""
    done = runs.select("model", "dataset").distinct()
    for whole, parts in (halves or {}).items():
        both = done.filter(F.col("dataset").isin(list(parts))).groupBy("model").agg(F.count("*").alias("n"))
        done = done.unionByName(both.filter(F.col("n") == len(parts)).select("model", F.lit(whole).alias("dataset")))
    names = runs.sparkSession.createDataFrame([(m,) for m in models], "model string")
    wanted = names.select("model", F.explode(F.array(*map(F.lit, datasets))).alias("dataset"))
    return wanted.join(done, ["model", "dataset"], "left_anti")
