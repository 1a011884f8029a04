"""Queries over reports (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import score as sc
from scoreloom.operators import reports as rp
from scoreloom.plans import sqltext as q
from scoreloom.plans.catalog import query
from scoreloom.plans.score_queries import _DOC_SCORE, _IOU, said_box, true_box


def scopes_sql(view: str, scopes: dict, exprs: dict[str, str], keys: str = "", where: str = "true") -> str:
    """One SELECT per scope, stacked."""
    lead = f"{keys}, " if keys else ""
    cols = ", ".join(f"{v} AS {k}" for k, v in exprs.items())
    parts = [
        f"SELECT {lead}'{name}' AS scope, {group or q.lit('all')} AS \"group\", {cols} FROM {view} WHERE {where} GROUP BY {lead}{group or q.lit('all')}"
        for name, group in scopes.items()
    ]
    return " UNION ALL ".join(parts)


HIT = {"value": "round(CAST(sum(hit) AS DOUBLE) / count(hit), 6)", "n": "count(*)"}
L2 = {"overall": None, "l2": "task", "category": "category"}


@query("g1_report_acc", scopes_sql("@scored", L2, HIT, "split"))
def _(t):
    return rp.report_acc(t.scored, "task", "category")


@query("g1_report_acc_from_predictions", f"""
    WITH judged AS (SELECT i.split, i.l2_category, i.category, CASE WHEN ({q.infer('p.prediction', 'i.')}) = i.answer THEN 1 ELSE 0 END AS hit
                    FROM @preds p JOIN @items i ON p."index" = i."index")
    {scopes_sql('judged', {'overall': None, 'l2': 'l2_category', 'category': 'category'}, HIT, 'split')}""")
def _(t):
    from scoreloom.operators.joins import rule_hits
    return rp.report_acc(rule_hits(t.preds, t.items))


@query("g2_report_acc_hierarchical", """
    WITH both_ AS (SELECT *, unnest([split, 'ALL']) AS sp FROM @scored),
    cat AS (SELECT sp, category, CAST(sum(hit) AS DOUBLE) / count(hit) AS m FROM both_ GROUP BY sp, category),
    mem AS (SELECT DISTINCT task, category FROM scored)
    SELECT sp AS split, 'overall' AS scope, 'all' AS "group", round(CAST(sum(hit) AS DOUBLE) / count(hit), 6) AS value FROM both_ GROUP BY sp
    UNION ALL SELECT sp, 'category', category, round(m, 6) FROM cat
    UNION ALL SELECT sp, 'l2', task, round(avg(m), 6) FROM mem JOIN cat USING (category) GROUP BY sp, task""")
def _(t):
    return rp.report_acc_hierarchical(t.scored, "task", "category")


def _cross(row):
    cells = ", ".join(f"round(coalesce(CAST(sum(hit) FILTER (WHERE model = 'M{i}') AS DOUBLE) / nullif(count(*) FILTER (WHERE model = 'M{i}'), 0), 0e0), 6) AS M{i}" for i in range(8))
    avg = " + ".join(f"coalesce(CAST(sum(hit) FILTER (WHERE model = 'M{i}') AS DOUBLE) / nullif(count(*) FILTER (WHERE model = 'M{i}'), 0), 0e0)" for i in range(8))
    return f"SELECT {row} AS \"row\", {cells}, round(({avg}) / 8, 6) AS Avg FROM @scored GROUP BY {row}"


@query("g3_report_acc_crosstab", " UNION ALL ".join(_cross(r) for r in ("category", "'CATEGORY_' || task", "'Overall'")))
def _(t):
    return rp.report_acc_crosstab(t.scored, "category", "task", "model", [f"M{i}" for i in range(8)])


@query("g4_report_acc_by", scopes_sql("@scored", {"overall": None, "subtask": "subtask", "model": "model"}, HIT, "split"))
def _(t):
    return rp.report_acc_by(t.scored, "subtask", "model")


@query("g5_macro_over_sources", """
    WITH m AS (SELECT split, subtask, CAST(sum(hit) AS DOUBLE) / count(hit) AS m FROM @scored GROUP BY split, subtask)
    SELECT split, 'source' AS scope, subtask AS "group", round(m, 6) AS value FROM m
    UNION ALL SELECT split, 'overall', 'all', round(avg(m), 6) FROM m GROUP BY split""")
def _(t):
    return rp.macro_over_sources(t.scored, "subtask")


@query("g6_cycle_report", """
    WITH m AS (SELECT CAST(line AS VARCHAR) AS cycle, task AS type, CAST(sum(hit) AS DOUBLE) / count(hit) AS accuracy FROM @scored GROUP BY line, task
               UNION ALL SELECT CAST(line AS VARCHAR), 'all', CAST(sum(hit) AS DOUBLE) / count(hit) FROM scored GROUP BY line)
    SELECT cycle, type, round(accuracy, 6) AS accuracy FROM m UNION ALL SELECT 'Average', type, round(sum(accuracy) / (SELECT count(DISTINCT cycle) FROM m), 6) FROM m GROUP BY type""")
def _(t):
    return rp.cycle_report(t.scored, "line", "task")


_NESTED = "(SELECT *, CASE WHEN category LIKE '%attribute%' THEN split_part(category, '/', 1) || '/attribute' ELSE category END AS cat FROM (SELECT task, subtask, score, CASE WHEN run % 4 = 0 THEN lower(category) || '/attribute x' ELSE lower(category) END AS category FROM @scored))"


@query("g7_nested_rating", scopes_sql(
    _NESTED, {"category": "task || '/' || subtask || '/' || cat", "subtask": "task || '/' || subtask", "task": "task", "overall": None},
    {"value": "round(CAST(sum(score) AS DOUBLE) / count(score), 6)", "n": "count(*)"}, where="score >= 0"))
def _(t):
    named = t.scored.withColumn("category", F.when(F.col("run") % 4 == 0, F.concat("category", F.lit("/attribute x"))).otherwise(F.col("category")))
    return rp.nested_rating(named, "task", "subtask", "category")


@query("g8_count_accuracy", scopes_sql("@scored", {"key": "category", "overall": None}, {
    "correct": "CAST(count(*) FILTER (WHERE score <> 0) AS BIGINT)", "total": "count(*)",
    "percent": "round(count(*) FILTER (WHERE score <> 0) * 100e0 / count(*), 2)"}))
def _(t):
    return rp.count_accuracy(t.scored, "category")


# tags of a row: its task, subtask and line; coarse groups by task only
def tags():
    return F.array("task", "subtask", F.concat(F.lit("line"), F.col("line").cast("string")))


COARSE = {"task0": "even", "task2": "even", "task1": "odd", "sub0": "even", "sub1": "odd"}


@query("g9_rating_all_valid", """
    WITH r AS (SELECT score, [task, subtask, 'line' || line] AS tags,
                 list_distinct(list_filter([CASE task WHEN 'task1' THEN 'odd' ELSE 'even' END, CASE subtask WHEN 'sub0' THEN 'even' WHEN 'sub1' THEN 'odd' END], lambda x: x IS NOT NULL)) AS coarse FROM @scored),
    e AS (SELECT 'fine' AS scope, unnest(tags) AS g, score FROM r UNION ALL SELECT 'coarse', unnest(coarse), score FROM r)
    SELECT scope, g AS "group", round(CAST(sum(greatest(score, 0)) AS DOUBLE) / count(*), 6) AS all_mean,
           round(CAST(sum(score) FILTER (WHERE score >= 0) AS DOUBLE) / count(*) FILTER (WHERE score >= 0), 6) AS valid_mean, count(*) AS n FROM e GROUP BY scope, g""")
def _(t):
    return rp.rating_all_valid(t.scored.withColumn("tags", tags()), "tags", COARSE)


@query("g10_dimension_cube", scopes_sql(
    "(SELECT *, unnest([split, 'overall']) AS duration FROM @scored)", {"overall": None, "task": "task", "subtask": "subtask", "category": "category"},
    {"value": "round(CAST(sum(score) AS DOUBLE) / count(*), 6)", "n": "count(*)"}, "duration", "score >= 0"))
def _(t):
    return rp.dimension_cube(t.scored.withColumnRenamed("split", "duration"), "duration", ["task", "subtask", "category"])


@query("g11_score_and_accuracy", scopes_sql(
    """(SELECT task, CASE WHEN contains(judge_json, 'pred') AND contains(judge_json, 'score') THEN nullif(regexp_extract(lower(judge_json), 'pred.: .(yes|no)', 1), '') END AS pred,
          CASE WHEN contains(judge_json, 'pred') AND contains(judge_json, 'score') THEN TRY_CAST(nullif(regexp_extract(judge_json, 'score.: ([0-9.]+)', 1), '') AS DOUBLE) ELSE -1e0 END AS score FROM @notes)""",
    {"tag": "task", "overall": None}, {"score": "round(avg(score) FILTER (WHERE score >= 0), 6)", "accuracy": "round(CAST(count(*) FILTER (WHERE pred = 'yes') AS DOUBLE) / count(pred), 6)"}))
def _(t):
    from scoreloom.functions.extract import parse_score_json
    return rp.score_and_accuracy(t.notes.select("task", parse_score_json(F.col("judge_json")).alias("j")).select("task", "j.*"), "task")


def _bucket(s):
    edges = " ".join(f"WHEN {s} / 60 <= {e} THEN '{b}'" for e, b in zip(rp.BUCKET_EDGES, rp.BUCKETS))
    return f"CASE {edges} ELSE '60+' END"


_BUCKETED = f"(SELECT *, {_bucket('amount * 100')} AS duration FROM @scored WHERE score <> -1)"


@query("g12_bucketed_rating", scopes_sql(_BUCKETED, {"overall": None, "duration": "duration", "task": "task", "subtask": "subtask"},
       {"value": "round(CAST(sum(score) AS DOUBLE) / count(*), 4)"}))
def _(t):
    return rp.bucketed_rating(t.scored.withColumn("seconds", F.col("amount") * 100), "seconds", ["task", "subtask"])


# one question per order, three modes by line number
_MODES = """(SELECT o AS qid, kind, mode AS task_mode, CASE mode WHEN 'miou' THEN CASE WHEN min(x) = 11 THEN -1 ELSE min(x) / 10e0 END ELSE CASE WHEN min(x) % 5 = 4 THEN -1e0 ELSE min(x) % 2 END END AS score
  FROM (SELECT l_orderkey AS o, 'k' || l_orderkey % 3 AS kind, CASE l_linenumber % 3 WHEN 0 THEN 'miou' WHEN 1 THEN 'long_acc' ELSE 'clue_acc' END AS mode, l_suppkey % 12 AS x FROM lineitem) GROUP BY o, kind, mode)"""


def _modes(t):
    mode = F.when(F.col("l_linenumber") % 3 == 0, "miou").when(F.col("l_linenumber") % 3 == 1, "long_acc").otherwise("clue_acc")
    kind = F.concat(F.lit("k"), (F.col("l_orderkey") % 3).cast("string"))
    x = F.col("x")
    value = F.when(F.col("task_mode") == "miou", F.when(x == 11, -1.0).otherwise(x / 10.0)).otherwise(F.when(x % 5 == 4, -1.0).otherwise((x % 2).cast("double")))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), kind.alias("kind"), mode.alias("task_mode")).agg(
        F.min(F.col("l_suppkey") % 12).alias("x")).withColumn("score", value)


def _threshold(kind, n):
    cond = "iou > {t} AND long = 1" if kind == "acc" else "iou > {t}"
    return "round((" + " + ".join(f"round(coalesce(count(*) FILTER (WHERE {cond.format(t=f'{x}e0')}) / CAST(nullif({n}, 0) AS DOUBLE), 0e0), 4)" for x in (0.1, 0.2, 0.3, 0.4, 0.5)) + ") / 5, 4)"


@query("g13_threshold_metrics", f"""WITH q AS (SELECT qid, kind, max(score) FILTER (WHERE task_mode = 'miou') AS iou, max(score) FILTER (WHERE task_mode = 'long_acc') AS long
    FROM {_MODES} WHERE score <> -1 GROUP BY qid, kind) """ + scopes_sql("q", {"overall": None, "kind": "kind"}, {
        "acc_at_iou": _threshold("acc", "count(*) FILTER (WHERE iou IS NOT NULL AND long IS NOT NULL)"), "rec_at_iou": _threshold("rec", "count(iou)")}))
def _(t):
    return rp.threshold_metrics(_modes(t), "qid", {"overall": None, "kind": "kind"})


_L, _C = "avg(score) FILTER (WHERE task_mode = 'long_acc')", "avg(score) FILTER (WHERE task_mode = 'clue_acc')"


@query("g14_recovery_ratio", scopes_sql(_MODES, {"overall": None, "kind": "kind"}, {
    "crr": f"CASE WHEN {_C} = 0 THEN 0e0 ELSE round(least({_L}, {_C}) / {_C}, 4) END"}, where="score <> -1"))
def _(t):
    return rp.recovery_ratio(_modes(t), {"overall": None, "kind": "kind"})


@query("g15_binary_report", """
    WITH e AS (SELECT answer, extracted, unnest(string_split(category, ',')) AS split FROM @yn),
    s AS (SELECT answer, extracted, split FROM e UNION ALL SELECT answer, extracted, 'Overall' FROM e),
    c AS (SELECT split, count(*) FILTER (WHERE answer = 'Yes' AND extracted = 'Yes') AS tp, count(*) FILTER (WHERE answer <> 'Yes' AND extracted = 'Yes') AS fp,
            count(*) FILTER (WHERE answer = 'Yes' AND extracted <> 'Yes') AS fn, count(*) FILTER (WHERE answer = extracted) AS ok, count(*) AS n FROM s GROUP BY split),
    r AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0e0) AS p, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0e0) AS rc FROM c)
    SELECT split, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0e0) * 100, 6) AS "Overall", round(ok * 100e0 / n, 6) AS acc, round(p * 100, 6) AS precision, round(rc * 100, 6) AS recall, n FROM r""")
def _(t):
    return rp.binary_report(t.yn)


_CONF = """WITH b AS (SELECT CASE WHEN "index" % 5 = 0 THEN 'original' ELSE source END AS kind, l2_category AS task, answer, CASE WHEN answer = extracted THEN 1 ELSE 0 END AS score FROM @yn),
    u AS (SELECT k.kind, {k} b.answer, b.score FROM b JOIN (SELECT DISTINCT kind {t2} FROM b WHERE kind <> 'original' {w}) k ON (b.kind = k.kind OR b.kind = 'original') {on}),
    c AS (SELECT kind, {g} count(*) FILTER (WHERE answer = 'Yes' AND score = 1) AS tp, count(*) FILTER (WHERE answer = 'No' AND score = 0) AS fp,
             count(*) FILTER (WHERE answer = 'Yes' AND score = 0) AS fn, count(*) FILTER (WHERE answer = 'No' AND score = 1) AS tn FROM u GROUP BY ALL),
    p AS (SELECT *, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0e0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0e0) AS recall FROM c),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0e0) AS f1 FROM p)
    SELECT {g} kind AS "group", round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, tn, fp, fn, tp FROM f
    UNION ALL SELECT {g} 'overall', round(avg(accuracy), 6), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), NULL, NULL, NULL, NULL FROM f {gb}"""


def _conf(t):
    return t.yn.select(F.when(F.col("index") % 5 == 0, "original").otherwise(F.col("source")).alias("kind"), F.col("l2_category").alias("task"),
                       "answer", (F.col("answer") == F.col("extracted")).cast("int").alias("score"))


@query("g16_confusion_report", _CONF.format(k="", t2="", on="", g="", gb="", w=""))
def _(t):
    return rp.confusion_report(_conf(t), "kind", "answer", "score")


@query("g16_confusion_by_task", _CONF.format(k="k.task,", t2=", task", on="AND b.task = k.task", g="task,", gb="GROUP BY task", w="AND task IN (SELECT task FROM b WHERE kind = 'original')"))
def _(t):
    return rp.confusion_report(_conf(t), "kind", "answer", "score", task="task")


_DOCS = f"(SELECT *, {_DOC_SCORE} AS score, CASE WHEN pages = 0 THEN 'unanswerable' WHEN pages = 1 THEN 'single-page' ELSE 'multi-page' END AS cls FROM @docqa)"


def _scored_docs(t):
    return t.docqa.withColumn("score", sc.typed_doc_score(F.col("truth"), F.col("prediction"), F.col("kind"), sc.parse_list))


@query("g17_answerability_f1", f"""
    WITH d AS {_DOCS}, e AS (SELECT *, unnest(list_concat(['overall_acc', cls], string_split(sources, ','))) AS category FROM d),
    r AS (SELECT avg(score) FILTER (WHERE truth <> 'Not answerable') AS rec, avg(score) FILTER (WHERE prediction <> 'Not answerable') AS pre, count(*) AS n FROM d)
    SELECT category, count(*) AS num, round(avg(score), 6) AS avg_score FROM e GROUP BY category UNION ALL SELECT 'overall_f1', n, round(2 * rec * pre / (rec + pre), 6) FROM r""")
def _(t):
    return rp.answerability_report(_scored_docs(t), "truth", "prediction", "score", "sources", "pages")


@query("g18_skill_report", """
    WITH e AS (SELECT hit, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS pre, unnest(list_distinct(['Overall', task, subtask, 'line' || line])) AS skill FROM @scored)
    SELECT skill, count(*) AS tot, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(pre) AS BIGINT) AS prefetch, round(sum(hit) * 100e0 / count(*), 6) AS acc,
           round(sum(pre) * 100e0 / count(*), 6) AS prefetch_rate FROM e GROUP BY skill""")
def _(t):
    return rp.skill_report(t.scored.withColumn("pre", (F.col("score") >= 0).cast("int")), tags(), "hit", "pre")


@query("g18_skill_report_by_text", """
    WITH e AS (SELECT hit, unnest(list_concat(['Overall'], list_filter(['task0', 'sub1', 'sub2', 'cat26'], lambda s: contains(task || ',' || subtask || ',' || category, s)))) AS skill FROM @scored)
    SELECT skill, count(*) AS tot, CAST(sum(hit) AS BIGINT) AS hit, round(sum(hit) * 100e0 / count(*), 6) AS acc FROM e GROUP BY skill""")
def _(t):
    return rp.skill_report(t.scored, rp.skills_in_text(F.concat_ws(",", "task", "subtask", "category"), ["task0", "sub1", "sub2", "cat26"]), "hit")


@query("g19_json_metadata_report", scopes_sql(
    "(SELECT split, task AS subject, category AS subfield, hit FROM @scored)", {"overall": None, "subject": "subject", "subfield": "subfield"},
    {"value": "round(sum(hit) * 100e0 / count(hit), 6)", "n": "count(*)"}, "split"))
def _(t):
    meta = F.concat(F.lit("{'split': '"), "split", F.lit("', 'subject': '"), "task", F.lit("', 'subfield': '"), "category", F.lit("'}"))
    rows = t.scored.select(meta.alias("metadata"), "hit")
    return rp.json_metadata_report(rows, "metadata", "split string, subject string, subfield string", "split", ["subject", "subfield"], "hit")


@query("g20_relative_score", scopes_sql("@scored", {"overall": None, "category": "task"}, {
    "relative": "round(sum(amount) * 100e0 / sum(line), 6)", "model": "round(sum(amount) * 10e0 / count(*), 6)", "baseline": "round(sum(line) * 10e0 / count(*), 6)"}))
def _(t):
    return rp.relative_score(t.scored, "task", "amount", "line")


CATEGORIES = [f"cat{i}" for i in range(0, 30, 3)]


@query("g21_category_hit_report", f"""
    WITH d AS (SELECT 'cat' || i AS category, CASE WHEN i < 15 THEN 'low' ELSE 'high' END AS super FROM range(0, 30, 3) r(i)),
    l AS (SELECT d.category, d.super, s, n FROM d LEFT JOIN (SELECT category, sum(hit) AS s, count(*) AS n FROM @scored GROUP BY category) x ON d.category = x.category)
    SELECT 'category' AS scope, category AS "group", round(s * 100e0 / n, 6) AS value, CAST(s AS BIGINT) AS hits FROM l
    UNION ALL SELECT 'super', super, round(sum(s) * 100e0 / sum(n), 6), CAST(sum(s) AS BIGINT) FROM l GROUP BY super
    UNION ALL SELECT 'total', 'all', round(sum(s) / 10e0, 6), CAST(sum(s) AS BIGINT) FROM l""")
def _(t):
    groups = {c: "low" if int(c[3:]) < 15 else "high" for c in CATEGORIES}
    return rp.category_hit_report(t.scored, "category", "hit", CATEGORIES, groups)


@query("g22_vqa_report", scopes_sql("@scored", {"split": "split", "overall": None}, {"value": "round(sum(hit) * 100e0 / count(hit), 6)", "n": "count(*)"}))
def _(t):
    return rp.vqa_report(t.scored)


_BOXED = f"(SELECT *, {_IOU} AS iou, (px1 + px2) / 2 BETWEEN gx1 AND gx2 AND (py1 + py2) / 2 BETWEEN gy1 AND gy2 AS center FROM @boxes)"


@query("g23_threshold_accuracy_report", scopes_sql(_BOXED, {"overall": None, "kind": "data_type"}, {
    "n": "count(iou)", "iou": "round(sum(iou) / count(iou), 6)", "center": "round(count(*) FILTER (WHERE center) / CAST(count(iou) AS DOUBLE), 6)",
    **{f"acc_at_{int(x * 10)}0": f"round(count(*) FILTER (WHERE iou >= {x}e0) / CAST(count(iou) AS DOUBLE), 6)" for x in rp.BOX_THRESHOLDS}}))
def _(t):
    return rp.box_report(t.boxes.select("data_type", sc.box_iou(said_box(), true_box()).alias("iou"), sc.center_in_box(said_box(), true_box()).alias("center")), "iou", "center", "data_type")


_POINT = "(SELECT data_type, category, CASE WHEN px1 IS NULL THEN -1 WHEN (px1 + px2) / 2 BETWEEN gx1 AND gx2 AND (py1 + py2) / 2 BETWEEN gy1 AND gy2 THEN 1 ELSE 0 END AS hit FROM @boxes)"


@query("g23_point_report", scopes_sql(_POINT, {"overall": None, "kind": "data_type", "category": "category || '/' || data_type"}, {
    "n": "count(*)", "accuracy": "round(count(*) FILTER (WHERE hit = 1) * 100e0 / count(*), 6)", "format_error": "round(count(*) FILTER (WHERE hit = -1) * 100e0 / count(*), 6)"}))
def _(t):
    hit = F.when(F.col("px1").isNull(), -1).when(sc.center_in_box(said_box(), true_box()), 1).otherwise(0)
    return rp.point_report(t.boxes.select("data_type", "category", hit.alias("hit")), "hit", "data_type", "category")


_FIELD = "(SELECT task, qq, field, CASE WHEN min(x) % 4 = 3 THEN -1e0 ELSE min(x) % 5 / 4e0 END AS score, 1 + field % 2 AS weight FROM (SELECT 't' || l_partkey % 5 AS task, l_orderkey AS qq, l_linenumber AS field, l_suppkey AS x FROM lineitem) GROUP BY task, qq, field)"


def _fields(t):
    rows = t.lineitem.select(F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string")).alias("task"), F.col("l_orderkey").alias("query"),
                             F.col("l_linenumber").alias("field"), F.col("l_suppkey").alias("x"))
    small = rows.groupBy("task", "query", "field").agg(F.min("x").alias("x"))
    score = F.when(F.col("x") % 4 == 3, -1.0).otherwise(F.col("x") % 5 / 4.0)
    return small.select("task", "query", score.alias("score"), (1 + F.col("field") % 2).alias("weight"))


def _weighted_sql(value):
    return f"""WITH f AS {_FIELD}, q AS (SELECT task, qq, coalesce({value}, -1e0) AS v FROM f GROUP BY task, qq),
    k AS (SELECT task, sum(greatest(v, 0e0)) AS s, count(*) AS n FROM q GROUP BY task)
    SELECT 'task' AS scope, task AS "group", round(s / n, 6) AS value FROM k UNION ALL SELECT 'macro', 'all', round(avg(s / n), 6) FROM k UNION ALL SELECT 'micro', 'all', round(sum(s) / sum(n), 6) FROM k"""


@query("g24_weighted_field_score", _weighted_sql("sum(score * weight) FILTER (WHERE score >= 0) / sum(weight) FILTER (WHERE score >= 0)"))
def _(t):
    return rp.weighted_field_score(_fields(t), "task", "query")


@query("g24_min_field_score", _weighted_sql("min(score) FILTER (WHERE score >= 0)"))
def _(t):
    return rp.weighted_field_score(_fields(t), "task", "query", how="min")


@query("g25_dims_all_valid", " UNION ALL ".join(
    f"SELECT '{name}' AS dim, round(sum(CASE WHEN TRY_CAST({expr} AS INT) IS NOT NULL THEN greatest(0, least(10, TRY_CAST({expr} AS INT))) END) * 10e0 / count(*), 6) AS all_score, round(sum(CASE WHEN TRY_CAST({expr} AS INT) IS NOT NULL THEN greatest(0, least(10, TRY_CAST({expr} AS INT))) END) * 10e0 / count(TRY_CAST({expr} AS INT)), 6) AS valid_score FROM @scored"
    for name, expr in {"style": "CASE WHEN run % 7 = 0 THEN 'bad' ELSE CAST(line * 2 AS VARCHAR) END", "depth": "CASE WHEN score < 0 THEN NULL ELSE CAST(score - 2 AS VARCHAR) END"}.items()))
def _(t):
    rows = t.scored.select(F.when(F.col("run") % 7 == 0, "bad").otherwise((F.col("line") * 2).cast("string")).alias("style"),
                           F.when(F.col("score") >= 0, (F.col("score") - 2).cast("string")).alias("depth"))
    return rp.dims_all_valid(rows, ["style", "depth"])


@query("g26_two_level_weighted", """
    WITH p AS (SELECT split AS level, avg(score) AS m, count(score) AS n FROM @scored GROUP BY split)
    SELECT level, round(m, 6) AS accuracy, n FROM p UNION ALL SELECT 'overall', round(sum(m * n) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM p""")
def _(t):
    return rp.two_level_weighted(t.scored, "split", "score")


@query("g27_fold_std", """
    WITH r AS (SELECT hit, row_number() OVER (ORDER BY qid, varid) - 1 AS pos, count(*) OVER () AS n FROM @variants),
    m AS (SELECT least(pos // (n // 5), 4) AS fold, sum(hit) * 100e0 / count(hit) AS m FROM r GROUP BY 1)
    SELECT 'fold' || fold AS name, round(m, 6) AS value FROM m UNION ALL SELECT 'std', round(stddev_pop(m), 6) FROM m""")
def _(t):
    return rp.fold_std(t.variants, ["qid", "varid"], "hit", 5)


@query("g28_component_means", """
    WITH c AS (SELECT unnest(['clarity', 'detail', 'total_score']) AS component, unnest([a, b, c]) AS v FROM (SELECT o_custkey % 5 / 5e0 AS a, o_orderkey % 3 / 3e0 AS b, o_custkey % 8 / 10e0 AS c FROM orders))
    SELECT component, round(avg(v), 6) AS value, count(*) AS n FROM c GROUP BY component""")
def _(t):
    from scoreloom.functions.extract import parse_component_scores
    parts = parse_component_scores(F.col("components"))
    named = F.map_from_arrays(F.array(*map(F.lit, ["clarity", "detail", "total_score"])), parts)
    return rp.component_means(t.notes.select(named.alias("parts")), "parts")


@query("g29_metrics_mean_report", " UNION ALL ".join(
    f"SELECT {g} AS subject, round(CAST(sum(hit) AS DOUBLE) / count(hit), 6) AS hit, round(sum(amount) / count(amount), 6) AS amount FROM @scored GROUP BY {g}"
    for g in ("subtask", "'CATEGORY_' || task", "'Overall'")))
def _(t):
    return rp.metrics_mean_report(t.scored, ["hit", "amount"], "subtask", "task")


_EM = "CASE WHEN lower(truth) = lower(prediction) THEN 1e0 ELSE 0e0 END"
_ANLS = "(CASE WHEN 1 - levenshtein(lower(truth), lower(prediction)) / CAST(greatest(length(truth), length(prediction)) AS DOUBLE) < 0.5 THEN 0e0 ELSE 1 - levenshtein(lower(truth), lower(prediction)) / CAST(greatest(length(truth), length(prediction)) AS DOUBLE) END)"


@query("g30_doc_metric_summary", f"""
    SELECT 'anls' AS category, count(*) AS num, round(avg({_ANLS}), 6) AS avg FROM @docqa UNION ALL SELECT 'em', count(*), round(avg({_EM}), 6) FROM docqa""")
def _(t):
    truth, said = F.lower("truth"), F.lower("prediction")
    rows = t.docqa.select(sc.anls(said, F.array(truth)).alias("anls"), sc.flag(truth == said).alias("em"))
    return rp.doc_metric_summary(rows, ["anls", "em"])


@query("g32_typed_accuracy", """
    SELECT round(avg(hit) FILTER (WHERE task = 'task0'), 6) AS task0_accuracy, round(avg(score) FILTER (WHERE task = 'task1'), 6) AS task1_accuracy,
           round(avg(hit) FILTER (WHERE task = 'none'), 6) AS none_accuracy FROM @scored""")
def _(t):
    return rp.typed_accuracy(t.scored, "task", {"task0": "hit", "task1": "score", "none": "hit"})


_WITHIN = "CASE WHEN greatest((amount + 1e-8) / (line * 8 + 1e-8), (line * 8 + 1e-8) / (amount + 1e-8)) < {} THEN 1 ELSE 0 END"


@query("g33_delta_report", scopes_sql("@scored", {"overall": None, "type": "task"}, {
    "delta_2": f"round(CAST(sum({_WITHIN.format('2')}) AS DOUBLE) / count(*), 6)", "delta_1_5": f"round(CAST(sum({_WITHIN.format('1.5e0')}) AS DOUBLE) / count(*), 6)"}))
def _(t):
    return rp.delta_report(t.scored, "amount", F.col("line") * 8, "task", {"delta_2": 2.0, "delta_1_5": 1.5})


@query("g34_score_with_missing", """
    SELECT task, CAST(count(*) FILTER (WHERE p IS NULL) AS BIGINT) AS failed_prediction, CAST(count(*) FILTER (WHERE p IS NOT NULL AND score < 0) AS BIGINT) AS failed_parse,
           round(avg(score) FILTER (WHERE p IS NOT NULL AND score >= 0), 6) AS rating, count(*) AS n
    FROM (SELECT task, score, CASE WHEN run % 9 = 0 THEN NULL ELSE model END AS p FROM @scored) GROUP BY task""")
def _(t):
    return rp.score_with_missing(t.scored.withColumn("p", F.when(F.col("run") % 9 != 0, F.col("model"))), "p", "score", ["task"])


_CODES = """(SELECT code, hit, CASE WHEN contains(code, '_en_') THEN 'en' ELSE 'zh' END || '/' || CASE WHEN contains(code, 'maths') THEN 'maths' ELSE 'physics' END AS ls,
  CASE WHEN contains(code, 'maths') THEN 'maths' ELSE 'physics' END AS su FROM (SELECT hit, 'OE_' || CASE WHEN line % 2 = 0 THEN 'maths' ELSE 'physics' END || CASE WHEN run % 2 = 0 THEN '_en_' ELSE '_zh_' END || task AS code FROM @scored))"""


@query("g35_grain_rollup", scopes_sql(_CODES, {"source": "code", "lang_subject": "ls", "subject": "su", "overall": None}, {"value": "round(sum(hit) * 100e0 / count(*), 6)", "n": "count(*)"}))
def _(t):
    code = F.concat(F.lit("OE_"), F.when(F.col("line") % 2 == 0, "maths").otherwise("physics"), F.when(F.col("run") % 2 == 0, "_en_").otherwise("_zh_"), "task")
    return rp.grain_rollup(t.scored.withColumn("code", code), "code", "hit", {"_en_": "en", "_zh_": "zh"}, {"maths": "maths", "physics": "physics"})


@query("g36_super_group_rows", """
    WITH r AS (SELECT subtask AS k, CAST(count(*) FILTER (WHERE score <> 0) AS BIGINT) AS correct, count(*) AS total FROM @scored GROUP BY subtask)
    SELECT k AS "group", correct, total, round(correct * 100e0 / total, 1) AS acc FROM r
    UNION ALL SELECT 'first', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT), round(sum(correct) * 100e0 / sum(total), 1) FROM r WHERE k IN ('sub0', 'sub1', 'sub2')
    UNION ALL SELECT 'G-Avg', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT), round(CAST(sum(correct) AS DOUBLE) / sum(total), 2) FROM r""")
def _(t):
    report = rp.count_accuracy(t.scored, "subtask").filter(F.col("scope") == "key")
    return rp.super_group_rows(report, "group", "correct", "total", {"sub0": "first", "sub1": "first", "sub2": "first"})


@query("g37_one_way_reports", scopes_sql("@scored", {"overall": None, "task": "task", "split": "split", "line": "CAST(line AS VARCHAR)"}, {"value": "round(sum(hit) * 100e0 / count(hit), 6)", "n": "count(*)"}))
def _(t):
    return rp.one_way_reports(t.scored, ["task", "split", "line"])
