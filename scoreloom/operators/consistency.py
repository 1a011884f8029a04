"""The same question asked several ways: rotations, flips, pairs, quads and step chains.

Group verdicts are ``min`` / ``max`` aggregates, which combine map-side, so a hot group never has to
sit in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.extract import infer
from scoreloom.functions.text import literal_map, words
from scoreloom.operators import reports as rp
from scoreloom.operators.items import item_options
from scoreloom.operators.ordered import with_position


def abnormal_item(options: Column, labels: Sequence[str], answer: Column) -> Column:
    """Labels inside option texts, no options, or an answer that is no label."""
    names = F.slice(F.array(*map(F.lit, labels)), 1, F.size(options))
    spelled = lambda o: F.size(F.array_intersect(words(F.regexp_replace(o, "[^A-Za-z ]", " ")), names)) > 1
    bare = lambda o: F.contains(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), o)
    return (F.size(options) == 0) | ~F.array_contains(names, answer) | F.exists(options, lambda o: spelled(o) | bare(o))


def index_offset(items: DataFrame, index: str = "index") -> Column:
    """1e6, ten times more while an index reaches it."""
    longest = items.agg(F.max(F.length(F.col(index).cast("string"))).alias("n")).scalar()
    return F.pow(F.lit(10.0), F.greatest(F.lit(6), longest)).cast("bigint")


def circular_expand(items: DataFrame, labels: Sequence[str] = "ABCD", index: str = "index") -> DataFrame:
    """Each k-option item as k rotated rows; abnormal items once.

    Rotation i moves the text of label j to label (j - i) mod k and the answer with it.
    """
    labels = list(labels)
    offset = index_offset(items, index)
    rest = [c for c in items.columns if c not in (*labels, "answer", index)]
    packed = items.select(index, "answer", *rest, F.array_compact(F.array(*labels)).alias("_o"))
    k = F.size("_o")
    turns = F.when(abnormal_item(F.col("_o"), labels, F.col("answer")), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), k - 1))
    turned = packed.withColumn("_i", F.explode(turns)).withColumn("_at", F.ascii("answer") - 65)
    moved = F.chr((65 + F.pmod(F.col("_at") - F.col("_i"), k)).cast("bigint"))
    option = lambda j: F.when(F.lit(j) < k, F.get("_o", F.pmod(F.lit(j) + F.col("_i"), k)))
    return turned.select(
        (F.col(index) + F.col("_i") * offset).alias(index), F.col(index).alias("g_index"), *rest,
        *[option(j).alias(c) for j, c in enumerate(labels)],
        F.when(F.col("_i") == 0, F.col("answer")).otherwise(moved).alias("answer"),
    )


def rotation_hits(predictions: DataFrame, items: DataFrame, labels: Sequence[str] = "ABCD", index: str = "index") -> DataFrame:
    """Rotated items joined with replies: 0/1 ``hit`` per rotation, unmatched replies 0."""
    joined = predictions.join(items, index)
    return joined.withColumn("hit", F.coalesce((infer(F.col("prediction"), item_options(labels)) == F.col("answer")).cast("int"), F.lit(0)))


def group_all_hit(df: DataFrame, group: Sequence[str], is_main: Column, carry: Sequence[str], hit: str = "hit") -> DataFrame:
    """One row per group that has a main row: hit only if all rows hit, attributes of the main row."""
    kept = df.groupBy(*group).agg(
        F.min(hit).alias(hit), F.max(F.when(is_main, 1)).alias("_main"),
        *[F.max(F.when(is_main, F.col(c))).alias(c) for c in carry])
    return kept.filter(F.col("_main") == 1).drop("_main")


def circular_eval(rotated: DataFrame, carry: Sequence[str], keys: Sequence[str] = (), index: str = "index") -> DataFrame:
    """Group verdict over rotations: every rotation must be right."""
    return group_all_hit(rotated, [*keys, "g_index"], F.col(index) == F.col("g_index"), carry)


def vanilla_vs_circular(rotated: DataFrame, l2: str, category: str, keys: Sequence[str] = (), index: str = "index") -> DataFrame:
    """Three reports: first rotation, all rotations, circular.

    The rotations are reduced once, per group and its attributes; all three views are read from these rows.
    """
    df = rp.with_split(rotated)
    carry = [c for c in ("split", l2, category) if c in df.columns]
    is_main = F.col(index) == F.col("g_index")
    view = lambda name, kept: F.struct(
        F.lit(name).alias("setting"), F.sum(F.when(kept, F.col("hit"))).alias("_s"), F.count(F.when(kept, F.col("hit"))).alias("_v"),
        F.count_if(kept).alias("_r"))
    groups = df.groupBy(*keys, "g_index", *carry).agg(
        F.array(view("vanilla", is_main), view("all", F.lit(True))).alias("_views"), F.min("hit").alias("hit"), F.count_if(is_main).alias("_mains"))
    single = groups.select(*carry, F.inline("_views")).filter(F.col("_r") > 0)
    circular = group_all_hit(groups, [*keys, "g_index"], F.col("_mains") > 0, carry).select(
        *carry, F.lit("circular").alias("setting"), F.col("hit").alias("_s"), F.col("hit").isNotNull().cast("bigint").alias("_v"),
        F.lit(1).cast("bigint").alias("_r"))
    scopes = {"overall": None, "l2": l2, "category": category}
    present = {k: v for k, v in scopes.items() if v is None or v in df.columns}
    sums = rp.scoped_sums(single.unionByName(circular), present, {"_s": F.sum("_s"), "_n": F.sum("_v"), "n": F.sum("_r")}, ["setting", "split"])
    return sums.select("split", "scope", "group", rp.mean("_s", "_n").alias("value"), "n", "setting")


def flip_key(qid: Column, setting: str) -> Column:
    """Group id of a question id of 8 or 13 characters with an optional ``-flip``."""
    if setting == "flip":
        return F.replace(qid, F.lit("-flip"), F.lit(""))
    if setting == "circ":
        return F.when(qid.contains("-flip"), F.substring(qid, 1, 13)).otherwise(F.substring(qid, 1, 8))
    return F.substring(qid, 1, 8)


def consistency_eval(df: DataFrame, qid: str, category: str) -> DataFrame:
    """Accuracy as is, and with hits multiplied over flip, circular and both kinds of groups."""
    out = rp.accuracy(df, {"overall": None, "category": category}).withColumn("setting", F.lit("vanilla"))
    for name in ("flip", "circ", "flip_circ"):
        keyed = df.withColumn("_key", flip_key(F.col(qid), name))
        base = group_all_hit(keyed, ["_key"], F.col(qid) == F.col("_key"), [category])
        out = out.unionByName(rp.accuracy(base, {"overall": None, "category": category}).withColumn("setting", F.lit(name)))
    return out


def rotation_summary(wide: DataFrame, category: str, hits: Sequence[str]) -> DataFrame:
    """Per category and as average over categories: all right, all wrong, each variant (3 decimals)."""
    every, any_ = F.least(*hits), F.greatest(*hits)
    aggs = [F.avg(every).alias("all_right"), F.avg(1 - any_).alias("all_wrong"), *[F.avg(h).alias(h) for h in hits]]
    per = wide.groupBy(category).agg(*aggs)
    names = ["all_right", "all_wrong", *hits]
    average = per.agg(*[F.avg(n).alias(n) for n in names]).withColumn(category, F.lit("Average"))
    return per.unionByName(average).select(F.col(category).alias("category"), *[F.round(n, 3).alias(n) for n in names])


def worst_case_acc(df: DataFrame, qid: str, variant: str, hit: str, attributes: Sequence[str]) -> DataFrame:
    """Average accuracy over all variants against worst case, per attribute of variant 1 and overall."""
    first = F.col(variant) == 1
    groups = df.groupBy(qid).agg(
        F.sum(hit).alias("s"), F.count("*").alias("n"), F.min(hit).alias("worst"), F.max(F.when(first, 1)).alias("_first"),
        *[F.max(F.when(first, F.col(a))).alias(a) for a in attributes])
    kept = groups.filter(F.col("_first") == 1)
    sums = rp.scoped_sums(kept, {"overall": None, **{a: a for a in attributes}}, {
        "s": F.sum("s"), "n": F.sum("n"), "worst": F.sum("worst"), "groups": F.count("*")})
    return sums.select("scope", "group", rp.mean("s", "n", 100.0).alias("average"), rp.mean("worst", "groups", 100.0).alias("worst"), "groups")


def first_two(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and second value per key by ``order``; the group limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = df.withColumn("_rn", rank).filter(F.col("_rn") <= 2)
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("_rn") == 2, F.col(value))).alias("second"))


def paired_scores(df: DataFrame, category: str, image: str, order: Sequence[str], score: str, supers: Mapping[str, str]) -> DataFrame:
    """Per category mean plus mean product of an image's first two scores, x 100; super-category sums."""
    plain = df.groupBy(category).agg(F.avg(F.col(score).cast("double")).alias("m"))
    pairs = first_two(df, [category, image], order, score)
    plus = pairs.groupBy(category).agg(F.avg((F.col("first") * F.col("second")).cast("double")).alias("p"))
    per = plain.join(plus, category).select(F.col(category).alias("group"), ((F.col("m") + F.col("p")) * 100).alias("v"))
    named = per.withColumn("super", F.try_element_at(literal_map(dict(supers)), F.col("group")))
    sums = named.filter(F.col("super").isNotNull()).groupBy("super").agg(F.sum("v").alias("v")).select(
        F.lit("super").alias("scope"), F.col("super").alias("group"), F.round("v", 4).alias("value"))
    return per.select(F.lit("category").alias("scope"), "group", F.round("v", 4).alias("value")).unionByName(sums)


def all_correct_rate(df: DataFrame, category: str, l2: str, set_id: str, figure: str, question: str, score: str) -> DataFrame:
    """aAcc, fAcc and qAcc x 100: rows right, figures all right, questions all right; per scope."""
    scope = F.inline(F.array(
        F.struct(F.lit("overall").alias("scope"), F.lit(rp.ALL).alias("group")),
        F.struct(F.lit("category").alias("scope"), F.col(category).alias("group")),
        F.struct(F.lit("l2").alias("scope"), F.col(l2).alias("group"))))
    finest = df.groupBy(category, l2, set_id, figure, question).agg(F.sum(score).alias("s"), F.count("*").alias("n"), F.min(score).alias("m"))
    spread = finest.select("*", scope)
    rows = spread.groupBy("scope", "group").agg((F.sum("s") * 100.0 / F.sum("n")).alias("a"))

    def rate(member: str, name: str) -> DataFrame:
        each = spread.groupBy("scope", "group", l2, set_id, member).agg(F.min("m").alias("m"))
        return each.groupBy("scope", "group").agg((F.sum("m") * 100.0 / F.count("*")).alias(name))

    joined = rows.join(rate(figure, "f"), ["scope", "group"]).join(rate(question, "q"), ["scope", "group"])
    return joined.select("scope", "group", F.round("a", 6).alias("aAcc"), F.round("f", 6).alias("fAcc"), F.round("q", 6).alias("qAcc"))


def mean_by_type(df: DataFrame, category: str, score: str, types: Mapping[str, str]) -> DataFrame:
    """Categories mapped to types: mean x 100 per type and the mean of the type means."""
    kind = F.coalesce(F.try_element_at(literal_map(dict(types)), F.col(category)), F.col(category))
    per = df.groupBy(kind.alias("type")).agg((F.sum(score) * 100.0 / F.count(score)).alias("m"))
    return per.unionByName(per.agg(F.avg("m").alias("m")).select(F.lit("Avg ACC").alias("type"), "m")).select("type", F.round("m", 6).alias("value"))


def quad_scores(df: DataFrame, order: str | Sequence[str], answer: str, tie: Sequence[str] = ()) -> DataFrame:
    """Every four consecutive rows are two questions x two images with expected answers 1, 0, 0, 1.

    Question, image, binary and group accuracy; a trailing incomplete quad is left out.
    """
    columns = [order] if isinstance(order, str) else list(order)
    placed = with_position(df.select(*columns, answer, *tie), order, "_pos", tie=tie)
    slot = lambda i: F.max(F.when(F.col("_pos") % 4 == i, F.col(answer))).alias(f"a{i}")
    quads = placed.groupBy(F.floor(F.col("_pos") / 4).alias("quad")).agg(*[slot(i) for i in range(4)], F.count("*").alias("_n")).filter(F.col("_n") == 4)
    right = [F.col("a0") == 1, F.col("a1") == 0, F.col("a2") == 0, F.col("a3") == 1]
    both = lambda i, j: (right[i] & right[j]).cast("int")
    question, image = both(0, 1) + both(3, 2), both(0, 2) + both(3, 1)
    binary = sum((r.cast("int") for r in right[1:]), right[0].cast("int"))
    group = ((question == 2) & (image == 2)).cast("int")
    rate = lambda c, per, name: F.round(F.sum(c) / (F.count("*") * per), 6).alias(name)
    return quads.agg(rate(question, 2, "Q_Acc"), rate(image, 2, "I_Acc"), rate(binary, 4, "Acc"), rate(group, 1, "G_Acc"))


def pair_accuracy(df: DataFrame, index: str, right: str) -> DataFrame:
    """Groups by the id without its last ``_`` part: all of at least two rows right, over all groups."""
    prefix = F.regexp_replace(index, "_[^_]*$", "")
    groups = df.filter(F.col(index).contains("_")).groupBy(prefix.alias("g")).agg(F.count("*").alias("n"), F.min(F.col(right).cast("int")).alias("m"))
    good = F.count_if((F.col("n") >= 2) & (F.col("m") == 1))
    return groups.agg(F.round(F.coalesce(F.try_divide(good * 100.0, F.count("*")), F.lit(0.0)), 6).alias("accuracy"), F.count("*").alias("groups"))


def quad_consistency(df: DataFrame, index: str, score: str) -> DataFrame:
    """Share (x 100) of bases whose four versions all succeed; the base id is parts 0, 1 and 3."""
    part = F.split(index, "-")
    doc = F.get(part, F.lit(0)) == "DocVQA"
    success = F.when(doc, F.col(score) > 0.5).otherwise(F.col(score) == 1)
    base = F.concat_ws("-", F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.get(part, F.lit(3)))
    bases = df.groupBy(base.alias("base")).agg(F.count_if(success).alias("ok"), F.count("*").alias("n"))
    return bases.agg(F.round(F.count_if(F.col("ok") == 4) * 100.0 / (F.sum("n") / 4), 6).alias("consistency"), F.sum("n").alias("n"))


# The classes of step-chain outcomes.
MASTERY = ["InadequateGeneralization", "InsufficientKnowledge", "CompleteMastery_loose", "CompleteMastery_strict",
           "RoteMemorization_loose", "RoteMemorization_strict"]


def mastery_classes(chains: DataFrame, steps: Sequence[str], multi: str) -> DataFrame:
    """Counts and rates of the classes for chains with all single steps; loose and strict variants.

    ``steps`` and ``multi`` are boolean columns; the rote rate is taken over rote plus mastered.
    """
    all_right, any_right = F.lit(True), F.lit(False)
    any_wrong, all_wrong = F.lit(False), F.lit(True)
    for s in steps:
        all_right, any_right = all_right & F.col(s), any_right | F.col(s)
        any_wrong, all_wrong = any_wrong | ~F.col(s), all_wrong & ~F.col(s)
    m = F.col(multi)
    tests = [all_right & ~m, any_wrong & ~m, any_right & m, all_right & m, all_wrong & m, any_wrong & m]
    return chains.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for x, n in zip(tests, MASTERY)], F.count("*").alias("total"))


def mastery_report(counts: DataFrame) -> DataFrame:
    """Rates (percent, 2 decimals) and final scores from summed class counts."""
    total = counts.agg(*[F.sum(c).alias(c) for c in (*MASTERY, "total")])
    c = F.col
    rates = {n: c(n) / c("total") for n in MASTERY[:4]}
    for kind in ("loose", "strict"):
        rote, mastered = c(f"RoteMemorization_{kind}"), c(f"CompleteMastery_{kind}")
        rates[f"RoteMemorization_{kind}"] = F.try_divide(rote, rote + mastered)
        rates[f"Score_{kind}"] = (c("total") - 0.5 * c("InadequateGeneralization") - rote - c("InsufficientKnowledge")) / c("total")
    return total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.round(v * 100, 2).alias("percent")) for k, v in rates.items()])))
