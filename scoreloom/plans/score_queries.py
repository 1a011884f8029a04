"""Queries over row metrics (D)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scoreloom.functions import constraints as cs
from scoreloom.functions import extract as ex
from scoreloom.functions import score as sc
from scoreloom.functions.text import words
from scoreloom.plans import sqltext as q
from scoreloom.plans.catalog import query
from scoreloom.plans.extract_queries import _CASCADE, _JOINED, tally, tally_sql, with_items


def refs():
    return F.split("answers", r"\|")


_ANSWERS = "string_split(answers, '|')"


def answer_tally(t, **scores):
    return tally(t.multi, "prediction", answers=F.col("answers"), **{k: F.round(v.cast("double"), 6) for k, v in scores.items()})


def answer_sql(**scores):
    cols = ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in scores.items())
    return f"SELECT prediction AS reply, answers, {cols}, n FROM (SELECT prediction, answers, count(*) AS n FROM @multi GROUP BY ALL)"


def norm(s):
    return q.normalise_words(q.strip_punctuation(f"trim(translate({s}, chr(10) || chr(9), '  '))"))


@query("d1_exact_hit", f"""
    SELECT l2_category, CAST(sum(CASE WHEN upper(trim({_CASCADE})) = upper(trim(answer)) THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n
    FROM {_JOINED} GROUP BY l2_category""")
def _(t):
    hit = sc.exact_hit(ex.extract_choice_cascade(F.col("prediction")), F.col("answer"))
    return with_items(t).groupBy("l2_category").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))


_REFS = f"list_transform({_ANSWERS}, lambda a: {norm('a')})"
_HITS = f"len(list_filter(refs, lambda r: r = pred))"


@query("d2_vqa_score", f"""
    SELECT prediction AS reply, answers, round(list_sum(list_transform(refs, lambda r:
        least(1e0, ({_HITS} - CASE WHEN r = pred THEN 1 ELSE 0 END) / 3e0))) / len(refs), 6) AS score, n
    FROM (SELECT prediction, answers, n, {norm('prediction')} AS pred, {_REFS} AS refs
          FROM (SELECT prediction, answers, count(*) AS n FROM @multi GROUP BY ALL))""")
def _(t):
    items = t.multi.select("answers").distinct().withColumn("clean", sc.vqa_references(refs()))
    score = sc.vqa_score(F.col("prediction"), F.col("clean"), normalised=True)
    return tally(t.multi.join(items, "answers"), "prediction", answers=F.col("answers"), score=F.round(score, 6))


_PLAIN = f"list_transform({_ANSWERS}, lambda a: CASE WHEN lower(trim(a)) = lower(trim(prediction)) THEN 1e0 ELSE 0e0 END)"


@query("d3_any_equal", answer_sql(
    best=f"CASE WHEN list_contains({_REFS}, {norm('prediction')}) THEN 1 ELSE 0 END", plain_mean=f"list_sum({_PLAIN}) / len({_PLAIN})"))
def _(t):
    p = F.col("prediction")
    return answer_tally(t, best=sc.any_equal(p, refs()), plain_mean=sc.any_equal(p, refs(), normalise=False, how="mean"))


def _num(s):
    return f"CASE WHEN ends_with({s}, '%') THEN TRY_CAST(rtrim({s}, '%') AS DOUBLE) / 100e0 ELSE TRY_CAST({s} AS DOUBLE) END"


def _relaxed(target, other):
    return f"""CASE WHEN len(list_filter({_ANSWERS}, lambda a: CASE WHEN {_num(target)} IS NOT NULL AND {_num(other)} IS NOT NULL AND {_num(target)} <> 0
        THEN abs({_num(other)} - {_num(target)}) / abs({_num(target)}) <= 0.05e0 ELSE lower(a) = lower(trim(prediction)) END)) > 0 THEN 1 ELSE 0 END"""


@query("d4_relaxed_accuracy", answer_sql(legacy=_relaxed("trim(prediction)", "a"), straight=_relaxed("a", "trim(prediction)")))
def _(t):
    p = F.col("prediction")
    return answer_tally(t, legacy=sc.relaxed_accuracy(p, refs()), straight=sc.relaxed_accuracy(p, refs(), legacy=False))


def _squeeze(s):
    return f"array_to_string({q.words(f'lower({s})')}, ' ')"


_COST = f"""list_min(list_transform({_ANSWERS}, lambda a: CASE WHEN greatest(length(a), length(prediction)) = 0 THEN 0e0
    ELSE levenshtein({_squeeze('a')}, {_squeeze('prediction')}) / CAST(greatest(length(a), length(prediction)) AS DOUBLE) END))"""


@query("d5_anls", answer_sql(score=f"CASE WHEN 1 - {_COST} < 0.5 THEN 0e0 ELSE 1 - {_COST} END"))
def _(t):
    return answer_tally(t, score=sc.anls(F.col("prediction"), refs()))


def _anls_doc(a, b):
    v = f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1e0 ELSE 1e0 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END)"
    return f"CASE WHEN {v} <= 0.5 THEN 0e0 ELSE {v} END"


@query("d6_anls_doc", tally_sql("@multi", "prediction", answers="answers", score=f"round({_anls_doc('answers', 'prediction')}, 6)"))
def _(t):
    return tally(t.multi, "prediction", answers=F.col("answers"), score=F.round(sc.anls_doc(F.col("answers"), F.col("prediction")), 6))


def _clean(s):
    return f"trim(regexp_replace(trim(regexp_replace(trim(lower({s})), '\\s*\\([^)]*\\)', '', 'g')), '%+$', ''))"


def _list(s):
    return f"list_sort(CASE WHEN starts_with({s}, '[') THEN string_split(replace(replace(replace({s}, '[', ''), ']', ''), '''', ''), ', ') ELSE [{s}] END)"


_T, _P = f"TRY_CAST({_clean('truth')} AS DOUBLE)", f"TRY_CAST({_clean('prediction')} AS DOUBLE)"


def _digits(x):
    return f"length(split_part(CAST({x} AS VARCHAR), '.', 2))"


def _float_same(item):
    scale = f"pow(10e0, greatest(least({_digits(_P)}, {_digits(item)}), 2))"
    return f"(abs({item} - {_P}) <= 0.01e0 * greatest(abs({item}), abs({_P})) OR round_even({_P} * {scale}, 0) = round_even({item} * {scale}, 0))"


_LIST_SCORE = f"""CASE WHEN len({_list('truth')}) <> len({_list('prediction')}) THEN 0e0 ELSE
    list_min([{_anls_doc(_list('truth') + '[1]', _list('prediction') + '[1]')},
      CASE WHEN len({_list('truth')}) > 1 THEN {_anls_doc(_list('truth') + '[2]', _list('prediction') + '[2]')} ELSE 1e0 END]) END"""
_LIST_SCORE = _LIST_SCORE.replace("truth", "lower(truth)").replace("prediction", "lower(prediction)")
_DOC_SCORE = f"""CASE kind WHEN 'Int' THEN CASE WHEN CAST(truth AS BIGINT) = CAST(floor(CAST(prediction AS DOUBLE)) AS BIGINT) THEN 1e0 ELSE 0e0 END
    WHEN 'Float' THEN CASE WHEN {_float_same(f'({_T} / 100e0)')} OR {_float_same(_T)} OR {_float_same(f'({_T} * 100e0)')} THEN 1e0 ELSE 0e0 END
    WHEN 'Str' THEN CASE WHEN starts_with({_clean('truth')}, 'page') THEN CASE WHEN {_clean('truth')} = {_clean('prediction')} THEN 1e0 ELSE 0e0 END
         ELSE {_anls_doc(_clean('truth'), _clean('prediction'))} END
    ELSE {_LIST_SCORE} END"""


@query("d7_typed_doc_score", tally_sql("@docqa", "prediction", truth="truth", kind="kind", score=f"round({_DOC_SCORE}, 6)"))
def _(t):
    score = sc.typed_doc_score(F.col("truth"), F.col("prediction"), F.col("kind"), sc.parse_list)
    return tally(t.docqa, "prediction", truth=F.col("truth"), kind=F.col("kind"), score=F.round(score, 6))


_W = lambda s: q.words(s)


@query("d8_bag_f1", f"""
    SELECT conv_id, turn, CASE WHEN shared > 0 THEN round(2 * (shared / r) * (shared / p) / (shared / r + shared / p), 6) ELSE 0e0 END AS f1
    FROM (SELECT conv_id, turn, CAST(len(list_filter({_W('hyp')}, lambda x: list_contains({_W('ref')}, x))) AS DOUBLE) AS shared,
                 len({_W('ref')}) AS r, len({_W('hyp')}) AS p FROM @pairs)""")
def _(t):
    return t.pairs.select("conv_id", "turn", F.round(sc.bag_f1(F.col("ref"), F.col("hyp")), 6).alias("f1"))


@query("d9_contains_answer", answer_sql(
    plain=f"CASE WHEN len(list_filter({_ANSWERS}, lambda a: contains(lower(prediction), lower(a)))) > 0 THEN 1 ELSE 0 END",
    bare=f"CASE WHEN len(list_filter({_ANSWERS}, lambda a: contains(lower(translate(prediction, '. ', '')), lower(translate(a, '. ', ''))))) > 0 THEN 1 ELSE 0 END"))
def _(t):
    p = F.col("prediction")
    return answer_tally(t, plain=sc.contains_answer(p, refs()), bare=sc.contains_answer(p, refs(), ". "))


def _spaced(s):
    return f"' ' || regexp_replace({norm(s)}, '\\W', ' ', 'g') || ' '"


@query("d10_reciprocal_rank", answer_sql(score=f"""
    coalesce(1e0 / nullif(coalesce(list_position(list_transform({_ANSWERS}, lambda a: contains({_spaced('prediction')}, {_spaced('a')})), true), 0), 0), 0e0)"""))
def _(t):
    return answer_tally(t, score=sc.reciprocal_rank(F.col("prediction"), refs()))


def line_report(t, **scores):
    """Sum of each score per return flag; rows kept whole."""
    return t.lineitem.groupBy("l_returnflag").agg(
        *[F.round(F.sum(v.cast("double")), 4).alias(k) for k, v in scores.items()], F.count("*").alias("n"))


def line_sql(**scores):
    cols = ", ".join(f"round(sum(CAST({v} AS DOUBLE)), 4) AS {k}" for k, v in scores.items())
    return f"SELECT l_returnflag, {cols}, count(*) AS n FROM lineitem GROUP BY l_returnflag"


def qty():
    return F.col("l_quantity")


def line():
    return F.col("l_linenumber")


def disc():
    return F.col("l_discount")


def tax():
    return F.col("l_tax")


_RATIO = "greatest((l_quantity + 1e-8) / (l_linenumber * 8 + 1e-8), (l_linenumber * 8 + 1e-8) / (l_quantity + 1e-8))"


@query("d11_ratio_within", line_sql(two=f"CASE WHEN {_RATIO} < 2 THEN 1 ELSE 0 END", one_half=f"CASE WHEN {_RATIO} < 1.5e0 THEN 1 ELSE 0 END"))
def _(t):
    return line_report(t, two=sc.ratio_within(qty(), line() * 8, 2.0), one_half=sc.ratio_within(qty(), line() * 8, 1.5))


_MRA = " + ".join(f"CASE WHEN abs(l_linenumber * 8 - l_quantity) / (l_linenumber * 8) < {i}e0 / 100e0 THEN 1 ELSE 0 END" for i in range(5, 51, 5))


@query("d12_mean_relative_accuracy", line_sql(score=f"({_MRA}) / 10e0"))
def _(t):
    return line_report(t, score=sc.mean_relative_accuracy(qty(), line() * 8))


@query("d13_count_score", line_sql(score="""
    CASE WHEN l_quantity = l_linenumber THEN 100e0
         ELSE greatest(0e0, 100e0 * (1 - 4e0 / (l_linenumber + 9) * pow(abs(l_quantity - l_linenumber) / greatest(l_linenumber - 1, 9, 1), 0.1e0))) END"""))
def _(t):
    return line_report(t, score=sc.count_score(qty(), line(), line() + 9))


@query("d14_linear_decay", line_sql(
    score="CASE WHEN l_linenumber = 7 THEN 0 ELSE greatest(0e0, (0.5e0 - abs(l_discount * 10 - l_tax * 10)) / 0.5e0) END",
    valid="CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END"))
def _(t):
    raw = sc.linear_decay(F.when(line() != 7, disc() * 10), tax() * 10)
    return line_report(t, score=F.nullif(raw, F.lit(-1.0)), valid=(raw >= 0).cast("int"))


def said_box():
    return sc.box(*(F.col(c) for c in ("px1", "py1", "px2", "py2")))


def true_box():
    return sc.box(*(F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")))


_IOU = """CASE WHEN px1 IS NULL THEN NULL WHEN least(px2, gx2) <= greatest(px1, gx1) OR least(py2, gy2) <= greatest(py1, gy1) THEN 0e0 ELSE
  (least(px2, gx2) - greatest(px1, gx1)) * (least(py2, gy2) - greatest(py1, gy1))
  / ((px2 - px1) * (py2 - py1) + (gx2 - gx1) * (gy2 - gy1) - (least(px2, gx2) - greatest(px1, gx1)) * (least(py2, gy2) - greatest(py1, gy1))) END"""


@query("d15_box_iou", f"""
    SELECT data_type, category, round(sum({_IOU}), 4) AS iou_sum, CAST(count(*) FILTER (WHERE {_IOU} = 0) AS BIGINT) AS disjoint, count({_IOU}) AS n
    FROM @boxes GROUP BY ALL""")
def _(t):
    return t.boxes.select("data_type", "category", sc.box_iou(said_box(), true_box()).alias("iou")).groupBy("data_type", "category").agg(
        F.round(F.sum("iou"), 4).alias("iou_sum"), F.count_if(F.col("iou") == 0).alias("disjoint"), F.count("iou").alias("n"))


@query("d16_center_and_point_in_box", """
    SELECT data_type, CAST(count(*) FILTER (WHERE (px1 + px2) / 2 BETWEEN gx1 AND gx2 AND (py1 + py2) / 2 BETWEEN gy1 AND gy2) AS BIGINT) AS centers,
      CAST(count(*) FILTER (WHERE (pid % 1000) / 1000e0 BETWEEN line * 10 / 1000e0 AND (line * 10 + 400 - 1) / 1000e0
            AND (oid % 600) / 600e0 BETWEEN (oid % 50) / 600e0 AND (oid % 50 + 300 - 1) / 600e0) AS BIGINT) AS points
    FROM @boxes GROUP BY data_type""")
def _(t):
    w, h = F.lit(1000), F.lit(600)
    target = sc.corners_from_size(F.col("line") * 10, F.col("oid") % 50, F.lit(400), F.lit(300), w, h)
    # points in pixels: moved past 1 so that both coordinates are normalised by the size
    x, y = F.col("pid") % 1000 + 0.0, F.col("oid") % 600 + 0.0
    inside = F.when((x > 1) | (y > 1), sc.point_hit(x, y, target, w, h)).otherwise(sc.point_in_box(x / w, y / h, target))
    return t.boxes.groupBy("data_type").agg(
        F.count_if(sc.center_in_box(said_box(), true_box())).alias("centers"), F.count_if(inside).alias("points"))


_P1, _P2 = ("px1", "py1", "px2", "py2"), ("gy1", "gx1", "gy2", "gx2")
_G1, _G2 = ("gx1", "gy1", "gx2", "gy2"), ("px1 * 0.5e0", "py1 * 0.5e0", "px2 * 0.5e0", "py2 * 0.5e0")


def _iou2(p, g):
    """IoU of any two boxes given by their four corner expressions."""
    corners = {**dict(zip(_P1, p)), **dict(zip(_G1, g))}
    return re.sub(r"\b[pg][xy][12]\b", lambda m: f"({corners[m.group()]})", _IOU.replace("px1 IS NULL", "false"))


@query("d17_best_match_iou", f"""
    SELECT data_type, round(sum(CASE WHEN px1 IS NULL THEN {_iou2(_P2, _G1)} / 2e0 ELSE (greatest({_iou2(_P1, _G1)}, {_iou2(_P1, _G2)}) + greatest({_iou2(_P2, _G1)}, {_iou2(_P2, _G2)})) / 2e0 END), 4) AS best,
      round(sum(({_iou2(_P1, _G1)} + {_iou2(_P2, _G2)}) / 2e0), 4) AS positionwise, count(*) AS n FROM @boxes GROUP BY data_type""")
def _(t):
    preds = F.array(said_box(), sc.box(*(F.col(c) for c in _P2)))
    golds = F.array(true_box(), sc.box(*(F.col(c) * 0.5 for c in _P1)))
    return t.boxes.groupBy("data_type").agg(
        F.round(F.sum(sc.best_match_iou(preds, golds)), 4).alias("best"),
        F.round(F.sum(sc.positionwise_iou(preds, golds)), 4).alias("positionwise"), F.count("*").alias("n"))


@query("d18_interval_iou", """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_linenumber AS DOUBLE) AS a1, CAST(l_linenumber + 4 AS DOUBLE) AS a2,
                      CAST(l_linenumber + l_suppkey % 6 AS DOUBLE) AS b1, CAST(l_linenumber + l_suppkey % 6 + 3 AS DOUBLE) AS b2, l_quantity / 4 AS c1, l_quantity / 4 + 2 AS c2 FROM lineitem),
    m AS (SELECT *, CASE WHEN b1 <= a2 THEN a2 - a1 + greatest(b2 - a2, 0) ELSE a2 - a1 + b2 - b1 END AS len_a,
        CASE WHEN b1 <= a2 THEN greatest(0, least(greatest(a2, b2), c2) - greatest(a1, c1))
             ELSE greatest(0, least(a2, c2) - greatest(a1, c1)) + greatest(0, least(b2, c2) - greatest(b1, c1)) END AS shared FROM x)
    SELECT l_returnflag, round(sum(shared / (len_a + 2 - shared)), 4) AS iou, count(*) AS n FROM m GROUP BY l_returnflag""")
def _(t):
    span = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    shift = line() + F.col("l_suppkey") % 6
    said = F.array(span(shift, shift + 3), span(line(), line() + 4))
    return line_report(t, iou=sc.interval_iou(said, F.array(span(qty() / 4, qty() / 4 + 2))))


def said_words():
    return F.split(F.lower("prediction"), " ")


def true_words():
    return F.split(F.replace("answers", F.lit(" "), F.lit("|")), r"\|")


_SAID, _TRUE = "string_split(lower(prediction), ' ')", "string_split(replace(answers, ' ', '|'), '|')"
_I, _U = f"len(list_intersect({_SAID}, {_TRUE}))", f"len(list_distinct(list_concat({_SAID}, {_TRUE})))"


@query("d19_set_scores", answer_sql(
    jaccard=f"{_I} / CAST({_U} AS DOUBLE)", precision=f"{_I} / CAST(len(list_distinct({_SAID})) AS DOUBLE)", recall=f"{_I} / CAST(len(list_distinct({_TRUE})) AS DOUBLE)",
    equal=f"CASE WHEN {_U} = {_I} THEN 1 ELSE 0 END"))
def _(t):
    return answer_tally(t, jaccard=sc.jaccard(said_words(), true_words()), precision=sc.set_precision(said_words(), true_words()), recall=sc.set_recall(said_words(), true_words()), equal=sc.set_equal(said_words(), true_words()))


_ZIP = f"list_transform(range(1, CAST(least(len({_SAID}), len({_TRUE})) AS BIGINT) + 1), lambda i: ({_SAID})[i] = ({_TRUE})[i])"


@query("d20_sequence_scores", answer_sql(
    equal=f"CASE WHEN {_SAID} = {_TRUE} THEN 1 ELSE 0 END", equal_fold=f"CASE WHEN list_transform({_SAID}, lambda x: lower(x)) = list_transform({_TRUE}, lambda x: lower(x)) THEN 1 ELSE 0 END",
    accuracy=f"CASE WHEN len({_SAID}) = len({_TRUE}) THEN len(list_filter(range(1, CAST(len({_TRUE}) AS BIGINT) + 1), lambda i: lower(({_SAID})[i]) = lower(({_TRUE})[i]))) / CAST(len({_TRUE}) AS DOUBLE) ELSE 0 END",
    prefix=f"(coalesce(nullif(list_position({_ZIP}, false), 0), len({_ZIP}) + 1) - 1) / CAST(len({_TRUE}) AS DOUBLE)",
    sorted_equal=f"CASE WHEN list_sort({_SAID}) = list_sort({_TRUE}) THEN 1 ELSE 0 END"))
def _(t):
    return answer_tally(t, equal=sc.sequence_equal(said_words(), true_words()), equal_fold=sc.sequence_equal(said_words(), true_words(), True), accuracy=sc.sequence_accuracy(said_words(), true_words()),
                        prefix=sc.common_prefix_ratio(said_words(), true_words()), sorted_equal=sc.sorted_equal(said_words(), true_words()))


@query("d21_map_scores", """
    WITH m AS (SELECT task, pk, tk, pv, tv FROM (SELECT task, 'k' AS pk, CASE WHEN id % 3 = 0 THEN 'j' ELSE 'k' END AS tk,
                 json_extract_string(props, '$.k') AS pv, CAST(id % 100 AS VARCHAR) AS tv FROM @fields))
    SELECT task, CAST(sum(CASE WHEN pk = tk AND pv = tv THEN 1 ELSE 0 END) AS BIGINT) AS equal,
      round(sum(CASE WHEN pk = tk AND (pv = tv OR (length(tv) = 1 AND tv BETWEEN 'a' AND 'z')) THEN 1e0 ELSE 0e0 END), 4) AS precision,
      round(sum(CASE WHEN pk = tk AND pv = tv THEN 1e0 ELSE 0e0 END), 4) AS recall,
      round(sum(CASE WHEN pk <> tk THEN 0e0 WHEN pv = tv THEN 1e0 ELSE 0e0 END), 4) AS jaccard, count(*) AS n FROM m GROUP BY task""")
def _(t):
    said = F.from_json("props", "map<string,string>")
    truth = F.create_map(F.when(F.col("id") % 3 == 0, "j").otherwise("k"), (F.col("id") % 100).cast("string"))
    sets = lambda m: F.transform_values(m, lambda _, v: F.array(v))
    empty = F.array().cast("array<string>")
    rows = t.fields.select("task", said.alias("p"), truth.alias("g"))
    p, g = F.col("p"), F.col("g")
    return rows.groupBy("task").agg(
        F.sum(sc.map_equal(p, g)).alias("equal"), F.round(F.sum(sc.map_precision(p, g)), 4).alias("precision"),
        F.round(F.sum(sc.map_recall(p, g)), 4).alias("recall"),
        F.round(F.sum(sc.map_union_mean(sets(p), sets(g), sc.jaccard, empty)), 4).alias("jaccard"), F.count("*").alias("n"))


def _simple(s):
    return f"lower(translate({s}, ' -.' || chr(10) || chr(9), ''))"


_LETTER = "CASE WHEN regexp_matches(choice_truth1, '^[A-Za-z]$') AND length(choice) > 1 THEN coalesce(nullif(regexp_extract(choice, '^\\(?([A-Za-z])\\)?', 1), ''), choice) ELSE choice END"


@query("d22_string_field_scores", tally_sql(
    """(SELECT choice, choice_truth, substr(choice_truth, 1, CASE WHEN "index" % 2 = 0 THEN 1 ELSE 100 END) AS choice_truth1 FROM @notes)""", "choice", truth="choice_truth1",
    exact=f"CASE WHEN {_LETTER} = choice_truth1 THEN 1 ELSE 0 END", folded="CASE WHEN lower(choice) = lower(choice_truth1) THEN 1 ELSE 0 END",
    simple=f"""CASE WHEN (CASE WHEN regexp_matches({_simple('choice_truth1')}, '^[a-z]$') AND length({_simple('choice')}) > 1
        THEN coalesce(nullif(regexp_extract({_simple('choice')}, '^\\(?([A-Za-z])\\)?', 1), ''), {_simple('choice')}) ELSE {_simple('choice')} END) = {_simple('choice_truth1')} THEN 1 ELSE 0 END"""))
def _(t):
    truth = F.when(F.col("index") % 2 == 0, F.substring("choice_truth", 1, 1)).otherwise(F.col("choice_truth"))
    rows, c, g = t.notes.withColumn("truth", truth), F.col("choice"), F.col("truth")
    return tally(rows, "choice", truth=g, exact=sc.string_exact(c, g), folded=sc.string_exact_ignore_case(c, g), simple=sc.string_simple(c, g))


def _similar(a, b):
    return f"(1e0 - coalesce(levenshtein({a}, {b}) / CAST(nullif(greatest(length({a}), length({b})), 0) AS DOUBLE), 0e0))"


def _fold(s):
    return f"regexp_replace(lower({s}), '\\b(a|an|the)\\b\\s*', '', 'g')"


@query("d23_edit_similarity", tally_sql("@multi", "prediction", answers="answers", similarity=f"round({_similar('prediction', 'answers')}, 6)",
       near=f"round(CASE WHEN {_similar(_fold('prediction'), _fold('answers'))} >= 0.5 THEN {_similar(_fold('prediction'), _fold('answers'))} ELSE 0e0 END, 6)"))
def _(t):
    p, a = F.col("prediction"), F.col("answers")
    return tally(t.multi, "prediction", answers=a, similarity=F.round(sc.edit_similarity(p, a), 6), near=F.round(sc.near_match(p, a, 0.5), 6))


@query("d23_transposing_similarity", tally_sql("@notes", "choice", truth="choice_truth",
       similarity="round(1e0 - damerau_levenshtein(choice, choice_truth) / CAST(greatest(length(choice), length(choice_truth)) AS DOUBLE), 6)"))
def _(t):
    a, b = F.col("choice"), F.col("choice_truth")
    return tally(t.notes, "choice", truth=b, similarity=F.round(sc.transposing_similarity(a, b), 6))


@query("d24_numeric_field_scores", line_sql(
    relative="greatest(0e0, 1e0 - abs((l_quantity - l_linenumber * 8) / (l_linenumber * 8)))", squared="(l_quantity - l_linenumber) * (l_quantity - l_linenumber)",
    clipped="1e0 - least(abs(l_discount - l_tax), 0.1e0) / 0.1e0", sequence="1e0 - least((abs(l_quantity - 20) + abs(l_linenumber - 3)) / 2e0, 10e0) / 10e0",
    positive="CASE WHEN l_linenumber - 3 <= 0 AND l_suppkey % 5 - 2 <= 0 THEN -1 WHEN l_linenumber - 3 = l_suppkey % 5 - 2 THEN 1 ELSE 0 END"))
def _(t):
    return line_report(
        t, relative=sc.relative_difference(qty(), line() * 8), squared=sc.squared_error(qty(), line()), clipped=sc.clipped_error(disc(), tax()),
        sequence=sc.sequence_error(F.array(qty(), line().cast("double")), F.array(F.lit(20.0), F.lit(3.0))),
        positive=sc.positive_int_match(line() - 3, F.col("l_suppkey") % 5 - 2))


@query("d25_keypoint_similarity", """
    SELECT label, round(sum((exp(-10e0 * sqrt(pow(a1 - b1, 2) + pow(a2 - b2, 2)) / sqrt(2e0)) + exp(-10e0 * sqrt(pow(a3 - b3, 2) + pow(a4 - b4, 2)) / sqrt(2e0))) / 2e0), 4) AS similarity,
      round(sum(sqrt(pow(a1 - b1, 2) + pow(a2 - b2, 2) + pow(a3 - b3, 2) + pow(a4 - b4, 2))), 4) AS distance
    FROM (SELECT label, """ + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS a{i}, CAST(embedding[{i + 4}] AS DOUBLE) AS b{i}" for i in range(1, 5)) + " FROM embeddings) GROUP BY label")
def _(t):
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    point = lambda i: F.struct(v(i).alias("x"), v(i + 1).alias("y"))
    wide = t.embeddings.groupBy("label").agg(
        F.round(F.sum(sc.keypoint_similarity(F.array(point(0), point(2)), F.array(point(4), point(6)))), 4).alias("similarity"),
        F.round(F.sum(sc.point_distance(F.array(*map(v, range(4))), F.array(*map(v, range(4, 8))))), 4).alias("distance"))
    return wide


@query("d26_geo_proximity", line_sql(score="""
    exp(-2 * 6371.0088e0 * asin(sqrt(least(pow(sin(radians(l_discount * 100 - l_tax * 100) / 2), 2)
      + cos(radians(l_tax * 100)) * cos(radians(l_discount * 100)) * pow(sin(radians(l_linenumber - l_quantity) / 2), 2), 1e0))) / 1000e0)"""))
def _(t):
    return line_report(t, score=sc.geo_proximity(tax() * 100, qty(), disc() * 100, line(), 1000.0))


@query("d27_rubric_bucket", """
    SELECT l_returnflag, bucket, count(*) AS n FROM (SELECT l_returnflag,
      CASE WHEN l_linenumber = 7 THEN 0 WHEN l_quantity / 50 * 5 <= 2 THEN 1 WHEN l_quantity / 50 * 5 <= 4 THEN 3 ELSE 5 END AS bucket FROM lineitem) GROUP BY ALL""")
def _(t):
    bucket = sc.rubric_bucket(F.when(line() != 7, qty() / 50)).alias("bucket")
    return t.lineitem.select("l_returnflag", bucket).groupBy("l_returnflag", "bucket").agg(F.count("*").alias("n"))


@query("d28_tolerant_numbers", answer_sql(
    equal="CASE WHEN lower(trim(prediction)) = lower(trim(answers)) OR abs(TRY_CAST(trim(prediction) AS DOUBLE) - TRY_CAST(trim(answers) AS DOUBLE)) < 1e-6 THEN 1 ELSE 0 END",
    near="CASE WHEN ends_with(prediction, '%') AND abs(TRY_CAST(rtrim(prediction, '%') AS DOUBLE) / 100e0 - 0.05e0) <= 0.05e0 * 0.01e0 THEN 1 ELSE 0 END"))
def _(t):
    p, a = F.col("prediction"), F.col("answers")
    near = sc.within_one_percent(sc.strip_units(p), F.lit(0.05)) & p.endswith("%")
    return answer_tally(t, equal=sc.numbers_equal(p, a).cast("int"), near=near.cast("int"))


_VALS = lambda s: f"list_distinct(list_transform(string_split(replace({s}, '||', '|'), '|'), lambda x: trim(lower(regexp_replace(x, '\\s+', ' ', 'g')))))"


@query("d29_denotation_match", tally_sql("""(SELECT CASE WHEN run % 2 = 0 THEN '25|' || CAST(line AS VARCHAR) || '%' WHEN run % 3 = 0 THEN '24.0|26||25' ELSE prediction END AS said, answers FROM @multi)""",
    "said", answers="answers", score=f"""CASE WHEN len({_VALS('said')}) = len({_VALS('answers')}) AND len(list_filter({_VALS('answers')},
      lambda a: len(list_filter({_VALS('said')}, lambda p: p = a OR coalesce(abs(TRY_CAST(p AS DOUBLE) - TRY_CAST(a AS DOUBLE)) < 1e-6, false))) = 0)) = 0 THEN 1 ELSE 0 END"""))
def _(t):
    said = F.when(F.col("run") % 2 == 0, F.concat(F.lit("25|"), F.col("line").cast("string"), F.lit("%"))).when(
        F.col("run") % 3 == 0, "24.0|26||25").otherwise(F.col("prediction"))
    rows = t.multi.select(said.alias("said"), "answers")
    return tally(rows, "said", answers=F.col("answers"), score=sc.denotation_match(F.col("said"), F.col("answers")))


@query("d30_fintab_match", """
    SELECT said, truth, CASE WHEN sv = tv THEN 1 ELSE 0 END AS strict, CASE WHEN sv = tv OR sv = tb OR sb = tv OR sb = tb THEN 1 ELSE 0 END AS relaxed, count(*) AS n FROM (
      SELECT CASE WHEN l_orderkey % 2 = 0 THEN '$' || l_linenumber || ' million' ELSE '(' || l_linenumber || ') shares' END AS said,
             CASE WHEN l_partkey % 2 = 0 THEN l_linenumber || ',000,000' ELSE l_suppkey % 8 || '' END AS truth,
             CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber * 1e6 ELSE l_linenumber * 1e0 END AS sv, l_linenumber * 1e0 AS sb,
             CASE WHEN l_partkey % 2 = 0 THEN l_linenumber * 1e6 ELSE l_suppkey % 8 * 1e0 END AS tv, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber * 1e6 ELSE l_suppkey % 8 * 1e0 END AS tb
      FROM lineitem) GROUP BY ALL""")
def _(t):
    number = line().cast("string")
    said = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("$"), number, F.lit(" million"))).otherwise(F.concat(F.lit("("), number, F.lit(") shares")))
    truth = F.when(F.col("l_partkey") % 2 == 0, F.concat(number, F.lit(",000,000"))).otherwise((F.col("l_suppkey") % 8).cast("string"))
    rows = t.lineitem.select(said.alias("said"), truth.alias("truth"))
    a, b = sc.table_number_forms(F.col("said")), sc.table_number_forms(F.col("truth"))
    return rows.select("said", "truth", (a["exact"] == b["exact"]).cast("int").alias("strict"),
                       F.arrays_overlap(a["variants"], b["variants"]).cast("int").alias("relaxed")).groupBy(
        "said", "truth", "strict", "relaxed").agg(F.count("*").alias("n"))


@query("d31_truefalse_contains", tally_sql("@notes", "tf", truth="""CAST("index" % 2 AS VARCHAR)""", score="""
    CASE WHEN contains(lower(tf), 'true') AND contains(lower(tf), 'false') THEN NULL
         WHEN contains(lower(tf), 'true') AND "index" % 2 = 1 THEN 1 WHEN contains(lower(tf), 'false') AND "index" % 2 = 0 THEN 1 ELSE 0 END"""))
def _(t):
    truth = (F.col("index") % 2).cast("string")
    return tally(t.notes, "tf", truth=truth, score=sc.true_false_score(F.col("tf"), truth))


def check(rule, low=None, high=None, texts=(), ranges=()):
    spans = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in ranges])
    return F.struct(F.lit(rule).alias("rule"), F.lit(low).cast("int").alias("low"), F.lit(high).cast("int").alias("high"),
                    F.array(*map(F.lit, texts)).cast("array<string>").alias("texts"),
                    spans.cast("array<struct<low:int,high:int>>").alias("ranges"))


# the rule tables of the registered query: one constraint per line, all checks of a line must hold
def rules():
    return {
        "length": [check("paragraph_count", 1, 1), check("word_count", 60, 400)],
        "sentences": [check("sentence_count", 3, 40), check("paragraph_sentences", 1, 60)],
        "paragraph_words": [check("paragraph_words", 20, 500)],
        "clean": [check("without", texts=["###", "***", "http"])],
        "marks": [check("sentences_end", texts=["."]), check("paragraphs_end", texts=["."])],
        "opening": [check("begins", texts=["T"]), check("paragraphs_begin", texts=["T"])],
        "closing": [check("ends", texts=["."])],
        "keywords": [check("each_keyword", 1, 60, ["the", "of"]), check("total_keywords", 4, 80, ["the", "and"])],
        "percent": [check("percent_precision", 0, 0)],
    }


_TIDY = "trim(regexp_replace(text, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), ' ' || chr(9) || chr(10))"
_PARAS = f"list_filter(regexp_split_to_array(tidy, '\\n\\s*\\n'), lambda p: trim(p) <> '')"


def _sents(s):
    return f"list_filter(string_split(regexp_replace({s}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def _wc(s):
    kept = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}_\s.-]', '', 'g')"
    return f"len({q.words(kept)})"


def _kw(k):
    return f"CAST(len(list_filter(regexp_split_to_array(lower(tidy), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w = '{k}')) AS INT)"


_CHECKS = {
    "length": f"len(paras) BETWEEN 1 AND 1 AND {_wc('text')} BETWEEN 60 AND 400",
    "sentences": f"len({_sents('tidy')}) BETWEEN 3 AND 40 AND len(list_filter(paras, lambda p: NOT len({_sents('p')}) BETWEEN 1 AND 60)) = 0",
    "paragraph_words": f"len(list_filter(paras, lambda p: NOT {_wc('p')} BETWEEN 20 AND 500)) = 0",
    "clean": "NOT contains(text, '###') AND NOT contains(text, '***') AND NOT contains(text, 'http')",
    "marks": f"len(list_filter({_sents('tidy')}, lambda s: NOT ends_with(s, '.'))) = 0 AND len(list_filter(paras, lambda s: NOT ends_with(s, '.'))) = 0",
    "opening": "starts_with(trim(text, ' ' || chr(9) || chr(10)), 'T') AND len(list_filter(paras, lambda s: NOT starts_with(s, 'T'))) = 0",
    "closing": "ends_with(trim(text, ' ' || chr(9) || chr(10)), '.')",
    "keywords": f"{_kw('the')} BETWEEN 1 AND 60 AND {_kw('of')} BETWEEN 1 AND 60 AND {_kw('the')} + {_kw('and')} BETWEEN 4 AND 80",
    "percent": "NOT regexp_matches(text, '[0-9]\\.[0-9]+\\s*%')",
}


@query("d32_constraint_checks", f"""
    WITH t AS (SELECT doc_id, text, {_TIDY} AS tidy FROM documents), p AS (SELECT *, {_PARAS} AS paras FROM t)
    SELECT doc_id, {', '.join(f'({v}) AS {k}' for k, v in _CHECKS.items())},
      round(({' + '.join(f'CAST(({v}) AS INT)' for v in _CHECKS.values())}) / {len(_CHECKS)}e0, 6) AS score FROM p""")
def _(t):
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.array(*v).alias("checks")) for k, v in rules().items()])
    scored = cs.constraint_scores(t.documents.select("doc_id", "text").withColumn("rules", table), "text", "rules")
    flags = F.map_from_entries("passed")
    return scored.select("doc_id", *[flags[k].alias(k) for k in rules()], F.round("score", 6).alias("score"))


@query("d33_text_constraint_features", """
    SELECT item_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}_\\s.-]', '', 'g'), '\\s+'), lambda w: w <> '')) AS INT) AS words,
      CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INT) AS lines,
      CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w = 'the')) AS INT) AS phrase_count,
      starts_with(lower(trim(text)), 'th') AS starts, ends_with(lower(trim(text)), '.') AS ends FROM benchmark""")
def _(t):
    return t.benchmark.select("item_id", cs.text_features(F.col("text"), "the", "Th", ".").alias("f")).select("item_id", "f.*")
