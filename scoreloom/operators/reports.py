"""Score reports in long form.

Every report is built on decomposable sums: the rows are reduced once at the finest grain (map-side
combined, one shuffle of group rows), and all coarser scopes are folded from that small table. Hot
groups therefore never travel as rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import score as sc
from scoreloom.functions.text import literal_map
from scoreloom.operators.ordered import prefix_fold, same_keys_join, with_position

ALL = "all"
#: values of the order column in one chunk of ``fold_std``
FOLD_CHUNK = 4096


def mean(total: str, n: str, scale: float = 1.0, digits: int | None = 6) -> Column:
    """Quotient of two summed columns, rounded unless ``digits`` is None; null when nothing was counted."""
    value = F.try_divide(F.col(total) * scale, F.col(n))
    return value if digits is None else F.round(value, digits)


def scoped_sums(
    df: DataFrame, scopes: Mapping[str, str | Sequence[str] | None], sums: Mapping[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Sums per (keys, scope, group): one row kind per entry of ``scopes``.

    A scope is a column, several columns (joined by '/'), or None for all rows.
    """
    parts = {k: [] if v is None else [v] if isinstance(v, str) else list(v) for k, v in scopes.items()}
    dims = list(dict.fromkeys(c for cols in parts.values() for c in cols if c not in keys))
    finest = df.groupBy(*keys, *dims).agg(*[v.alias(k) for k, v in sums.items()])
    members = F.array(*[
        F.struct(
            F.lit(kind).alias("scope"),
            (F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]) if cols else F.lit(ALL)).alias("group"),
        )
        for kind, cols in parts.items()
    ])
    spread = finest.select(*keys, *sums, F.inline(members))
    return spread.groupBy(*keys, "scope", "group").agg(*[F.sum(k).alias(k) for k in sums])


def accuracy(df: DataFrame, scopes: Mapping[str, str | Sequence[str] | None], value: str = "hit", keys: Sequence[str] = (), scale: float = 1.0, digits: int | None = 6) -> DataFrame:
    """Mean of ``value`` and row count per scope and group."""
    sums = scoped_sums(df, scopes, {"_s": F.sum(value), "_n": F.count(value), "n": F.count("*")}, keys)
    return sums.select(*keys, "scope", "group", mean("_s", "_n", scale, digits).alias("value"), "n")


def with_split(df: DataFrame) -> DataFrame:
    return df if "split" in df.columns else df.withColumn("split", F.lit("none"))


def wide(report: DataFrame, keys: Sequence[str], names: Sequence[str], value: str = "value") -> DataFrame:
    """Pivot a long report for display; ``names`` are the groups to show, absent ones null."""
    return report.groupBy(*keys).pivot("group", list(names)).agg(F.first(value))


def extraction_coverage(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Rows solved by rules against rows left for a judge."""
    total, matched = F.count("*"), F.count(value)
    return df.groupBy(*keys).agg(
        total.alias("total"), matched.alias("matched"), (total - matched).alias("unmatched"),
        F.round(matched * 100.0 / total, 6).alias("rate"),
    )


# -- accuracy by split and group -----------------------------------------------------------------


def report_acc(df: DataFrame, l2: str = "l2_category", category: str = "category", value: str = "hit") -> DataFrame:
    """Per split: overall, each l2 category, each category."""
    scopes = {"overall": None, "l2": l2, "category": category}
    present = {k: v for k, v in scopes.items() if v is None or v in df.columns}
    return accuracy(with_split(df), present, value, ["split"])


def report_acc_by(df: DataFrame, *columns: str, value: str = "hit") -> DataFrame:
    """Per split: overall, then one group column at a time."""
    return accuracy(with_split(df), {"overall": None, **{c: c for c in columns}}, value, ["split"])


def report_acc_hierarchical(df: DataFrame, l2: str = "l2_category", category: str = "category", value: str = "hit") -> DataFrame:
    """Splits plus ``ALL``; an l2 value is the unweighted mean of its categories' means.

    A category without rows in a split leaves its l2 value null there.
    """
    finest = with_split(df).groupBy("split", l2, category).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    both = finest.withColumn("split", F.explode(F.array("split", F.lit("ALL"))))
    overall = both.groupBy("split").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(
        "split", F.lit("overall").alias("scope"), F.lit(ALL).alias("group"), mean("s", "n").alias("value"))
    per_category = both.groupBy("split", category).agg((F.sum("s") / F.sum("n")).alias("m"))
    categories = per_category.select(
        "split", F.lit("category").alias("scope"), F.col(category).alias("group"), F.round("m", 6).alias("value"))
    members = finest.select(l2, category).distinct()
    sizes = members.groupBy(l2).agg(F.count("*").alias("size"))
    l2_means = same_keys_join(same_keys_join(members, per_category, [category]).groupBy("split", l2).agg(
        F.avg("m").alias("m"), F.count("*").alias("seen")), sizes, [l2]).select(
        "split", F.lit("l2").alias("scope"), F.col(l2).alias("group"),
        F.when(F.col("seen") == F.col("size"), F.round("m", 6)).alias("value"))
    return overall.unionByName(categories).unionByName(l2_means)


def report_acc_crosstab(df: DataFrame, subject: str, category: str, setting: str, settings: Sequence[str], value: str = "hit") -> DataFrame:
    """Subject x setting means (0 when absent) with their average; category and overall rows."""
    finest = df.filter(F.col(setting).isin(list(settings))).groupBy(subject, category, setting).agg(
        F.sum(value).alias("s"), F.count(value).alias("n"))
    rows = F.array(F.col(subject), F.concat(F.lit("CATEGORY_"), category), F.lit("Overall"))
    table = finest.withColumn("row", F.explode(rows)).groupBy("row").pivot(setting, list(settings)).agg(
        F.sum("s") / F.sum("n")).fillna(0.0, list(settings))
    average = reduce(lambda a, b: a + b, [F.col(f"`{x}`") for x in settings]) / len(settings)
    return table.select("row", *[F.round(f"`{x}`", 6).alias(x) for x in settings], F.round(average, 6).alias("Avg"))


def macro_over_sources(df: DataFrame, source: str, value: str = "hit") -> DataFrame:
    """Mean per source; Overall is the mean of the source means."""
    per = with_split(df).groupBy("split", source).agg((F.sum(value) / F.count(value)).alias("m"), F.count("*").alias("n"))
    sources = per.select("split", F.lit("source").alias("scope"), F.col(source).alias("group"), F.round("m", 6).alias("value"))
    overall = per.groupBy("split").agg(F.round(F.avg("m"), 6).alias("value")).select(
        "split", F.lit("overall").alias("scope"), F.lit(ALL).alias("group"), "value")
    return sources.unionByName(overall)


def cycle_report(df: DataFrame, cycle: str, category: str, value: str = "hit") -> DataFrame:
    """Accuracy per cycle and type; the Average row divides the sum over cycles by their number."""
    sums = scoped_sums(df, {"type": category, "all": None}, {"_s": F.sum(value), "_n": F.count(value)}, [cycle])
    exact = sums.select(F.col(cycle).cast("string").alias("cycle"), F.col("group").alias("type"), (F.col("_s") / F.col("_n")).alias("accuracy"))
    average = exact.groupBy("type").agg(F.sum("accuracy").alias("s"))
    # the number of cycles is the number of 'all' rows; only what is returned is rounded
    n = exact.filter(F.col("type") == ALL).agg(F.count("*").alias("n")).scalar()
    rows = exact.unionByName(average.select(F.lit("Average").alias("cycle"), "type", (F.col("s") / n).alias("accuracy")))
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def nested_rating(df: DataFrame, task: str, subtask: str, category: str, score: str = "score") -> DataFrame:
    """Category accuracy; subtask, task and overall pooled by counts; negative scores ignored."""
    name = F.lower(category)
    merged = F.when(name.contains("attribute"), F.concat(F.split_part(name, F.lit("/"), F.lit(1)), F.lit("/attribute"))).otherwise(name)
    valid = df.filter(F.col(score) >= 0).withColumn(category, merged)
    scopes = {"category": (task, subtask, category), "subtask": (task, subtask), "task": task, "overall": None}
    return accuracy(valid, scopes, score)


def count_accuracy(df: DataFrame, key: str, score: str = "score") -> DataFrame:
    """[correct, total, percent] per key and overall; any non-zero score is correct."""
    truthy = F.count_if(F.coalesce(F.col(score) != 0, F.lit(False)))
    sums = scoped_sums(df, {"key": key, "overall": None}, {"correct": truthy, "total": F.count("*")})
    return sums.select("scope", "group", "correct", "total", F.round(mean("correct", "total", 100.0, 6), 2).alias("percent"))


def rating_all_valid(df: DataFrame, tags: str, coarse: Mapping[str, str], score: str = "score") -> DataFrame:
    """Per tag and per coarse group: mean with invalid scores as 0, and mean of the valid ones.

    A row counts once per coarse group, however many of its tags belong to it.
    """
    value = F.col(score)
    finest = df.groupBy(tags).agg(
        F.sum(F.greatest(value, F.lit(0))).alias("s"), F.count("*").alias("n"), F.count_if(value >= 0).alias("valid"))
    groups = F.array_distinct(F.array_compact(F.transform(tags, lambda x: F.try_element_at(literal_map(dict(coarse)), x))))
    spread = finest.select(
        "s", "n", "valid",
        F.explode(F.concat(
            F.transform(tags, lambda x: F.struct(F.lit("fine").alias("scope"), x.alias("group"))),
            F.transform(groups, lambda x: F.struct(F.lit("coarse").alias("scope"), x.alias("group"))))).alias("t"),
    )
    return spread.groupBy("t.scope", "t.group").agg(*[F.sum(c).alias(c) for c in ("s", "n", "valid")]).select(
        "scope", "group", mean("s", "n").alias("all_mean"), mean("s", "valid").alias("valid_mean"), "n")


def dimension_cube(df: DataFrame, outer: str, dims: Sequence[str], score: str = "score") -> DataFrame:
    """``outer`` value (and 'overall') x each dimension, over valid scores."""
    valid = df.filter(F.col(score) >= 0)
    finest = valid.groupBy(outer, *dims).agg(F.sum(score).alias("s"), F.count("*").alias("n"))
    both = finest.withColumn(outer, F.explode(F.array(F.col(outer).cast("string"), F.lit("overall"))))
    sums = scoped_sums(both, {"overall": None, **{d: d for d in dims}}, {"s": F.sum("s"), "n": F.sum("n")}, [outer])
    return sums.select(outer, "scope", "group", mean("s", "n").alias("value"), "n")


def score_and_accuracy(df: DataFrame, tag: str, pred: str = "pred", score: str = "score") -> DataFrame:
    """Mean score over valid rows and share of 'yes' over parseable ones, per tag and overall."""
    good = F.col(score) >= 0
    sums = scoped_sums(df, {"tag": tag, "overall": None}, {
        "s": F.sum(F.when(good, F.col(score))), "valid": F.count_if(good),
        "yes": F.count_if((F.lower(pred) == "yes")), "parsed": F.count(pred)})
    return sums.select("scope", "group", mean("s", "valid").alias("score"), mean("yes", "parsed").alias("accuracy"))


# Upper edges of the duration buckets in minutes and their names.
BUCKET_EDGES = [10, 20, 30, 40, 50, 60]
BUCKETS = ["0-10", "10-20", "20-30", "30-40", "40-50", "50-60", "60+"]


def duration_bucket(seconds: Column) -> Column:
    """Right-closed ten-minute buckets."""
    chain = reduce(lambda acc, e: acc.when(seconds / 60 <= e[0], e[1]), zip(BUCKET_EDGES, BUCKETS), F)
    return chain.otherwise(BUCKETS[-1])


def bucketed_rating(df: DataFrame, seconds: str, dims: Sequence[str], score: str = "score") -> DataFrame:
    """Mean per duration bucket and dimension value, 4 decimals; empty buckets 0; -1 dropped."""
    valid = df.filter(F.col(score) != -1).withColumn("duration", duration_bucket(F.col(seconds)))
    sums = scoped_sums(valid, {"overall": None, "duration": "duration", **{d: d for d in dims}}, {"s": F.sum(score), "n": F.count("*")})
    labels = df.sparkSession.createDataFrame([("duration", b) for b in BUCKETS], "scope string, group string")
    missing = labels.join(sums, ["scope", "group"], "left_anti").select("scope", "group", F.lit(0.0).alias("value"))
    return sums.select("scope", "group", mean("s", "n", 1.0, 4).alias("value")).unionByName(missing)


# IoU thresholds of the grounding report.
GROUNDING_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5]


def _paired_modes(df: DataFrame, qid: str, carry: Sequence[str]) -> DataFrame:
    """One row per question: IoU of mode ``miou`` and accuracy of ``long_acc`` and ``clue_acc``."""
    of = lambda mode: F.max(F.when(F.col("task_mode") == mode, F.col("score")))
    return df.filter(F.col("score") != -1).groupBy(qid, *carry).agg(
        of("miou").alias("iou"), of("long_acc").alias("long"), of("clue_acc").alias("clue"))


def threshold_metrics(df: DataFrame, qid: str, scopes: Mapping[str, str | None]) -> DataFrame:
    """acc@IoU and rec@IoU averaged over the thresholds, each threshold rounded to 4 decimals."""
    paired = _paired_modes(df, qid, [c for c in scopes.values() if c])
    iou, long = F.col("iou"), F.col("long")
    sums = {"both": F.count_if(iou.isNotNull() & long.isNotNull()), "seen": F.count("iou")}
    for i, t in enumerate(GROUNDING_THRESHOLDS):
        sums[f"acc{i}"] = F.count_if((iou > t) & (long == 1))
        sums[f"rec{i}"] = F.count_if(iou > t)
    got = scoped_sums(paired, scopes, sums)
    share = lambda name, n: F.round(F.coalesce(F.try_divide(F.col(name), F.col(n)), F.lit(0.0)), 4)
    total = lambda kind, n: reduce(lambda a, b: a + b, [share(f"{kind}{i}", n) for i in range(5)]) / 5
    return got.select("scope", "group", F.round(total("acc", "both"), 4).alias("acc_at_iou"), F.round(total("rec", "seen"), 4).alias("rec_at_iou"))


def recovery_ratio(df: DataFrame, scopes: Mapping[str, str | None]) -> DataFrame:
    """min(long, clue) / clue of the mode means, 0 when the clue mean is 0."""
    valid = df.filter(F.col("score") != -1)
    of = lambda mode: F.when(F.col("task_mode") == mode, F.col("score"))
    sums = scoped_sums(valid, scopes, {
        "ls": F.sum(of("long_acc")), "ln": F.count(of("long_acc")), "cs": F.sum(of("clue_acc")), "cn": F.count(of("clue_acc"))})
    long, clue = F.try_divide(F.col("ls"), F.col("ln")), F.try_divide(F.col("cs"), F.col("cn"))
    ratio = F.when(clue != 0, F.round(F.when(long < clue, long).otherwise(clue) / clue, 4)).when(clue == 0, 0.0)
    return sums.select("scope", "group", F.when(long.isNotNull(), ratio).alias("crr"))


def _f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return f1, precision, recall


def binary_report(df: DataFrame, answer: str = "answer", extracted: str = "extracted", category: str = "category") -> DataFrame:
    """F1, accuracy, precision, recall x 100 per category; Overall counts the exploded rows."""
    yes, said = F.col(answer) == "Yes", F.col(extracted) == "Yes"
    finest = df.groupBy(category).agg(
        F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"),
        F.count_if(F.col(answer) == F.col(extracted)).alias("right"), F.count("*").alias("n"))
    each = finest.withColumn("split", F.explode(F.concat(
        F.split(category, ","), F.transform(F.split(category, ","), lambda _: F.lit("Overall")))))
    sums = each.groupBy("split").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "right", "n")])
    f1, precision, recall = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    show = lambda c: F.round(c * 100, 6)
    return sums.select("split", show(f1).alias("Overall"), mean("right", "n", 100.0).alias("acc"),
                       show(precision).alias("precision"), show(recall).alias("recall"), "n")


def confusion_report(df: DataFrame, kind: str, answer: str, score: str, original: str = "original", task: str | None = None) -> DataFrame:
    """Per kind (its rows plus the shared originals): confusion counts and rates; macro mean last.

    The prediction is the answer when the score is 1 and its opposite otherwise. With ``task`` the
    report is made per task, and tasks without originals are skipped.
    """
    yes, right = F.col(answer) == "Yes", F.col(score) == 1
    keys = [] if task is None else [task]
    counts = df.groupBy(*keys, kind).agg(
        F.count_if(yes & right).alias("tp"), F.count_if(~yes & ~right).alias("fp"),
        F.count_if(yes & ~right).alias("fn"), F.count_if(~yes & right).alias("tn"))
    # folded counts only: one row per kind
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    with_shared = [
        (F.when(F.col(kind) == original, 0).otherwise(F.col(c)) + F.sum(F.when(F.col(kind) == original, F.col(c))).over(over)).alias(c)
        for c in ("tp", "fp", "fn", "tn")
    ]
    per = counts.select(*keys, kind, *with_shared).filter((F.col(kind) != original) & F.col("tp").isNotNull())
    f1, precision, recall = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rated = per.select(*keys, F.col(kind).alias("group"), ((F.col("tp") + F.col("tn")) / total).alias("accuracy"),
                       precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "tn", "fp", "fn", "tp")
    rates = ("accuracy", "precision", "recall", "f1")
    macro = rated.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in rates]).withColumn("group", F.lit("overall"))
    out = rated.unionByName(macro, allowMissingColumns=True)
    return out.select(*keys, "group", *[F.round(c, 6).alias(c) for c in rates], "tn", "fp", "fn", "tp")


def answerability_report(df: DataFrame, truth: str, prediction: str, score: str, sources: str, pages: str, none: str = "Not answerable") -> DataFrame:
    """Overall F1 and accuracy, means per evidence source, means by page-count class."""
    s = F.col(score)
    answerable, answered = F.col(truth) != none, F.col(prediction) != none
    pages_class = F.when(F.col(pages) == 0, "unanswerable").when(F.col(pages) == 1, "single-page").otherwise("multi-page")
    finest = df.withColumn("_class", pages_class).groupBy(sources, "_class").agg(
        F.sum(s).alias("s"), F.count("*").alias("n"), F.sum(F.when(answerable, s)).alias("rs"), F.count_if(answerable).alias("rn"),
        F.sum(F.when(answered, s)).alias("ps"), F.count_if(answered).alias("pn"))
    tags = F.concat(F.array(F.lit("overall_acc"), F.col("_class")), F.split(sources, ","))
    sums = finest.select(F.explode(tags).alias("category"), "s", "n", "rs", "rn", "ps", "pn").groupBy("category").agg(
        *[F.sum(c).alias(c) for c in ("s", "n", "rs", "rn", "ps", "pn")])
    recall, precision = F.try_divide(F.col("rs"), F.col("rn")), F.try_divide(F.col("ps"), F.col("pn"))
    f1 = F.round(F.try_divide(2 * recall * precision, recall + precision), 6)
    means = sums.select("category", F.col("n").alias("num"), mean("s", "n").alias("avg_score"))
    overall = sums.filter(F.col("category") == "overall_acc").select(F.lit("overall_f1").alias("category"), F.col("n").alias("num"), f1.alias("avg_score"))
    return means.unionByName(overall)


def skill_report(df: DataFrame, skills: Column, hit: str, prefetch: str | None = None) -> DataFrame:
    """tot, hit (and rule-solved) counts with rates for Overall and every skill of a row."""
    sums = {"tot": F.count("*"), "hit": F.sum(hit)}
    if prefetch:
        sums["prefetch"] = F.sum(prefetch)
    finest = df.withColumn("_skills", F.array_union(F.array(F.lit("Overall")), skills)).groupBy("_skills").agg(
        *[v.alias(k) for k, v in sums.items()])
    out = finest.select(F.explode("_skills").alias("skill"), *sums).groupBy("skill").agg(*[F.sum(c).alias(c) for c in sums])
    rates = [mean("hit", "tot", 100.0).alias("acc")] + ([mean("prefetch", "tot", 100.0).alias("prefetch_rate")] if prefetch else [])
    return out.select("skill", *sums, *rates)


def skills_in_text(category: Column, skills: Sequence[str]) -> Column:
    """The skills whose name occurs in a combined category."""
    return F.filter(F.array(*map(F.lit, skills)), lambda s: F.contains(category, s))


def json_metadata_report(df: DataFrame, metadata: str, schema: str, version: str, fields: Sequence[str], score: str) -> DataFrame:
    """Metadata JSON flattened; per version overall and per field value, x 100."""
    parsed = df.withColumn("_m", F.from_json(metadata, schema)).select(score, "_m.*")
    return accuracy(parsed, {"overall": None, **{f: f for f in fields}}, score, [version], 100.0)


def relative_score(df: DataFrame, category: str, score: str, baseline: str) -> DataFrame:
    sums = scoped_sums(df, {"overall": None, "category": category}, {"s": F.sum(score), "b": F.sum(baseline), "n": F.count("*")})
    return sums.select("scope", "group", mean("s", "b", 100.0).alias("relative"), mean("s", "n", 10.0).alias("model"), mean("b", "n", 10.0).alias("baseline"))


def category_hit_report(df: DataFrame, category: str, hit: str, categories: Sequence[str], groups: Mapping[str, str]) -> DataFrame:
    """Listed categories (null when empty), their super-groups as sums, and the total."""
    sums = df.groupBy(category).agg(F.sum(hit).alias("s"), F.count("*").alias("n"))
    dim = df.sparkSession.createDataFrame([(c, groups.get(c)) for c in categories], f"`{category}` string, super string")
    listed = dim.join(sums, category, "left")
    each = listed.select(F.lit("category").alias("scope"), F.col(category).alias("group"), mean("s", "n", 100.0).alias("value"), F.col("s").alias("hits"))
    supers = listed.filter(F.col("super").isNotNull()).groupBy("super").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(
        F.lit("super").alias("scope"), F.col("super").alias("group"), mean("s", "n", 100.0).alias("value"), F.col("s").alias("hits"))
    total = listed.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(
        F.lit("total").alias("scope"), F.lit(ALL).alias("group"), F.round(F.col("s") / 10, 6).alias("value"), F.col("s").alias("hits"))
    return each.unionByName(supers).unionByName(total)


def vqa_report(df: DataFrame, value: str = "hit") -> DataFrame:
    """x 100: per split and overall when there is a split, else overall and per category."""
    scopes = {"split": "split", "overall": None} if "split" in df.columns else {"overall": None, "category": "category"}
    return accuracy(df, scopes, value, scale=100.0)


# IoU thresholds of the box report.
BOX_THRESHOLDS = [0.1, 0.3, 0.5, 0.7, 0.9]


def box_report(df: DataFrame, iou: str, center: str, kind: str) -> DataFrame:
    """Mean IoU, share above each threshold and centre accuracy; rows without IoU left out."""
    sums = {"n": F.count(iou), "iou": F.sum(iou), "center": F.count_if(F.col(center) & F.col(iou).isNotNull())}
    for t in BOX_THRESHOLDS:
        sums[f"acc_at_{int(t * 10)}0"] = F.count_if(F.col(iou) >= t)
    got = scoped_sums(df, {"overall": None, "kind": kind}, sums)
    return got.select("scope", "group", "n", *[mean(k, "n", 1.0).alias(k) for k in sums if k != "n"])


def point_report(df: DataFrame, hit: str, kind: str, category: str) -> DataFrame:
    """Accuracy and format-error rate (hit -1) overall, per kind and per category:kind."""
    h = F.col(hit)
    sums = {"n": F.count("*"), "right": F.count_if(h == 1), "broken": F.count_if(h == -1)}
    got = scoped_sums(df, {"overall": None, "kind": kind, "category": (category, kind)}, sums)
    return got.select("scope", "group", "n", mean("right", "n", 100.0).alias("accuracy"), mean("broken", "n", 100.0).alias("format_error"))


def weighted_field_score(fields: DataFrame, task: str, query: str, score: str = "score", weight: str = "weight", how: str = "mean") -> DataFrame:
    """Field scores >= 0 -> weighted mean (or min) per query, -1 if none; then task, macro and micro."""
    s, w = F.col(score), F.col(weight)
    good = s >= 0
    value = F.try_divide(F.sum(F.when(good, s * w)), F.sum(F.when(good, w))) if how == "mean" else F.min(F.when(good, s))
    queries = fields.groupBy(task, query).agg(F.coalesce(value, F.lit(-1.0)).alias("q"))
    tasks = queries.groupBy(task).agg(F.sum(F.greatest("q", F.lit(0.0))).alias("s"), F.count("*").alias("n"))
    each = tasks.select(F.lit("task").alias("scope"), F.col(task).alias("group"), mean("s", "n").alias("value"))
    total = tasks.agg(F.avg(F.col("s") / F.col("n")).alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))
    both = total.select(F.inline(F.array(
        F.struct(F.lit("macro").alias("scope"), F.lit(ALL).alias("group"), F.round("macro", 6).alias("value")),
        F.struct(F.lit("micro").alias("scope"), F.lit(ALL).alias("group"), F.round("micro", 6).alias("value")))))
    return each.unionByName(both)


def dims_all_valid(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Integer scores clipped to 0..10: x 10 over all rows and over the parseable ones."""
    clipped = lambda c: F.greatest(F.lit(0), F.least(F.lit(10), F.col(c).try_cast("int")))
    aggs = [x for c in dims for x in (
        F.sum(F.when(F.col(c).try_cast("int").isNotNull(), clipped(c))).alias(f"{c}_s"), F.count(F.col(c).try_cast("int")).alias(f"{c}_v"))]
    sums = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("dim"), F.round(F.col(f"{c}_s") * 10 / F.col("n"), 6).alias("all_score"),
                              F.round(F.try_divide(F.col(f"{c}_s") * 10, F.col(f"{c}_v")), 6).alias("valid_score")) for c in dims])
    return sums.select(F.inline(rows))


def two_level_weighted(df: DataFrame, tag: str, score: str) -> DataFrame:
    """Mean and count per level, and the level means combined by their counts."""
    per = df.groupBy(tag).agg((F.sum(score) / F.count(score)).alias("m"), F.count(score).alias("n"))
    total = per.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("n")).withColumn(tag, F.lit("overall"))
    return per.unionByName(total).select(F.col(tag).alias("level"), F.round("m", 6).alias("accuracy"), "n")


def fold_std(df: DataFrame, order: str | Sequence[str], value: str, k: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """Ordered outcomes in k consecutive folds (the last takes the rest): means x 100, population std.

    Rows are reduced to sums per chunk of the first order column (nulls count as 0). Chunks that a
    fold's end cuts (fewer than k) are reduced again by value, and only rows of a value that is cut are
    placed one by one.
    """
    orders = [order] if isinstance(order, str) else list(order)
    first = F.coalesce(F.col(orders[0]), F.lit(0)).cast("bigint")
    rows = df.withColumn("_at", first).withColumn("_chunk", F.floor(F.col("_at") / FOLD_CHUNK))
    summed = [F.sum(value).alias("s"), F.count(value).alias("v"), F.count("*").alias("n")]
    sums = rows.groupBy("_chunk").agg(*summed)
    size = F.nullif(F.floor(sums.agg(F.sum("n")).scalar() / k), F.lit(0))
    fold_of = lambda spot: F.least(F.floor(spot / size), F.lit(k - 1).cast("bigint"))
    ends = lambda placed: placed.withColumn("fold", fold_of(F.col("_before"))).withColumn("_last", fold_of(F.col("_before") + F.col("n") - 1))
    whole = lambda placed: placed.filter("fold = _last").select("fold", "s", "v")
    cut = lambda placed, key: same_keys_join(rows, placed.filter("fold <> _last").select(key, "_before"), (), [key])
    zero = F.lit(0).cast("bigint")

    chunks = ends(prefix_fold(sums, F.col("n"), "_chunk", "_before").withColumn("_before", F.coalesce("_before", zero)))
    earlier = Window.partitionBy("_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    by_value = cut(chunks, "_chunk").groupBy("_chunk", "_at", "_before").agg(*summed)
    values = ends(by_value.withColumn("_before", F.col("_before") + F.coalesce(F.sum("n").over(earlier), zero)))
    inside = with_position(cut(values, "_at"), orders[1:] or orders, "_spot", ["_at"], tie)
    placed = inside.groupBy(fold_of(F.col("_before") + F.col("_spot")).alias("fold")).agg(*summed[:2])
    parts = whole(chunks).unionByName(whole(values)).unionByName(placed)
    means = parts.groupBy("fold").agg(F.try_divide(F.sum("s") * 100.0, F.sum("v")).alias("m"))
    each = means.select(F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("name"), F.round("m", 6).alias("value"))
    return each.unionByName(means.agg(F.round(F.stddev_pop("m"), 6).alias("value")).select(F.lit("std").alias("name"), "value"))


def component_means(df: DataFrame, components: str) -> DataFrame:
    """Mean of each named component over the rows that have it."""
    each = df.select(F.explode(components).alias("component", "value"))
    return each.groupBy("component").agg(F.round(F.avg("value"), 6).alias("value"), F.count("value").alias("n"))


def metrics_mean_report(df: DataFrame, metrics: Sequence[str], subject: str, category: str) -> DataFrame:
    """Several metrics averaged by subject, by category (prefixed) and overall."""
    sums = {f"{m}_{x}": f(m) for m in metrics for x, f in (("s", F.sum), ("n", F.count))}
    got = scoped_sums(df, {"subject": subject, "category": category, "overall": None}, sums)
    label = F.when(F.col("scope") == "category", F.concat(F.lit("CATEGORY_"), "group")).when(F.col("scope") == "overall", "Overall").otherwise(F.col("group"))
    return got.select(label.alias("subject"), *[mean(f"{m}_s", f"{m}_n").alias(m) for m in metrics])


def doc_metric_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One line per metric: count and mean."""
    sums = df.agg(*[F.sum(m).alias(m) for m in metrics], F.count("*").alias("num"))
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("category"), F.col("num").alias("num"), F.round(F.col(m) / F.col("num"), 6).alias("avg")) for m in metrics])))


def typed_accuracy(df: DataFrame, kind: str, scores: Mapping[str, str]) -> DataFrame:
    """One column per answer type, the mean of that type's score; null without rows."""
    aggs = [F.round(F.avg(F.when(F.col(kind) == k, F.col(c))), 6).alias(f"{k}_accuracy") for k, c in scores.items()]
    return df.agg(*aggs)


def delta_report(df: DataFrame, value: str | Column, truth: str | Column, kind: str, deltas: Mapping[str, float]) -> DataFrame:
    """Share of values within each factor of the truth, over all and per ``kind``; one column per named factor."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    within = {name: F.sum(sc.ratio_within(column(value), column(truth), d)) for name, d in deltas.items()}
    sums = scoped_sums(df, {"overall": None, "type": kind}, {**within, "_n": F.count("*")})
    return sums.select("scope", "group", *[mean(name, "_n").alias(name) for name in deltas])


def score_with_missing(df: DataFrame, prediction: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Counts of missing predictions and unparsed scores next to the mean of the valid ones."""
    gone, s = F.col(prediction).isNull(), F.col(score)
    valid = ~gone & (s >= 0)
    return df.groupBy(*keys).agg(
        F.count_if(gone).alias("failed_prediction"), F.count_if(~gone & (s < 0)).alias("failed_parse"),
        F.round(F.avg(F.when(valid, s)), 6).alias("rating"), F.count("*").alias("n"))


def grain_rollup(df: DataFrame, source: str, hit: str, langs: Mapping[str, str], subjects: Mapping[str, str]) -> DataFrame:
    """Accuracy per source code, per language x subject, per subject, and over all, pooled by counts.

    ``langs`` and ``subjects`` map a fragment of the source code to a name; the first that occurs wins.
    """
    pick = lambda table: F.coalesce(*[F.when(F.col(source).contains(k), v) for k, v in table.items()], F.lit("other"))
    finest = df.groupBy(source).agg(F.sum(hit).alias("s"), F.count("*").alias("n")).withColumn("lang", pick(langs)).withColumn("subject", pick(subjects))
    scopes = {"source": source, "lang_subject": ("lang", "subject"), "subject": "subject", "overall": None}
    got = scoped_sums(finest, scopes, {"s": F.sum("s"), "n": F.sum("n")})
    return got.select("scope", "group", mean("s", "n", 100.0).alias("value"), F.col("n"))


def super_group_rows(report: DataFrame, key: str, success: str, total: str, groups: Mapping[str, str]) -> DataFrame:
    """Add rows that pool listed tasks (x 100, 1 decimal) and a general average (2 decimals)."""
    named = report.withColumn("super", F.try_element_at(literal_map(dict(groups)), F.col(key)))
    pooled = named.filter(F.col("super").isNotNull()).groupBy("super").agg(F.sum(success).alias(success), F.sum(total).alias(total)).select(
        F.col("super").alias(key), success, total, F.round(F.col(success) * 100 / F.col(total), 1).alias("acc"))
    average = report.agg(F.sum(success).alias(success), F.sum(total).alias(total)).select(
        F.lit("G-Avg").alias(key), success, total, F.round(F.col(success) / F.col(total), 2).alias("acc"))
    each = report.select(key, success, total, F.round(F.col(success) * 100 / F.col(total), 1).alias("acc"))
    return each.unionByName(pooled).unionByName(average)


def one_way_reports(df: DataFrame, columns: Sequence[str], value: str = "hit", scale: float = 100.0) -> DataFrame:
    """Overall plus one mean per value of each of several columns."""
    return accuracy(df, {"overall": None, **{c: c for c in columns}}, value, scale=scale)
