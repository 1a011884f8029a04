"""Queries over sorting, set operations and cross-model reports (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import score as sc
from scoreloom.operators import crossmodel as cm
from scoreloom.operators import reports as rp
from scoreloom.operators.ordered import fold_id
from scoreloom.plans.catalog import query
from scoreloom.plans.score_queries import true_box


@query("k1_sort_by_index", """SELECT "index", question FROM @items""")
def _(t):
    return cm.sort_by_index(t.items.select("index", "question"))


_MISS = "sqrt(pow(greatest(gx1 - px1, 0, px1 - gx2), 2) + pow(greatest(gy1 - py1, 0, py1 - gy2), 2))"


@query("k2_worst_cases", f"""
    SELECT oid, line, pid, broken, round(miss, 6) AS miss FROM (SELECT DISTINCT oid, line, pid, CASE WHEN px1 IS NULL THEN 1 ELSE 0 END AS broken, CASE WHEN px1 IS NULL THEN 0e0 ELSE {_MISS} END AS miss FROM @boxes) WHERE broken = 1 OR miss > 0""")
def _(t):
    distance = F.coalesce(F.when(F.col("px1").isNotNull(), cm.miss_distance(F.col("px1"), F.col("py1"), true_box())), F.lit(0.0))
    rows = t.boxes.select("oid", "line", "pid", F.col("px1").isNull().cast("int").alias("broken"), F.round(distance, 6).alias("miss")).distinct()
    return cm.worst_cases(rows, (F.col("broken") == 1) | (F.col("miss") > 0), [F.desc("broken"), F.desc("miss"), F.col("oid"), F.col("line"), F.col("pid")])


@query("k3_concat_datasets", """
    WITH u AS (SELECT 'parts' AS "SUB_DATASET", "index" AS original_index, category, NULL AS lang FROM @items UNION ALL SELECT 'docs', doc_id, NULL, lang FROM documents)
    SELECT *, row_number() OVER (ORDER BY original_index, "SUB_DATASET") - 1 AS "index" FROM u""")
def _(t):
    parts = {"parts": t.items.select("index", "category"), "docs": t.documents.select(F.col("doc_id").alias("index"), "lang")}
    return cm.concat_datasets(parts, "original_index")


@query("k3_split_datasets", """SELECT doc_id AS "index", CAST(NULL AS VARCHAR) AS category, lang FROM documents""")
def _(t):
    parts = {"parts": t.items.select("index", "category"), "docs": t.documents.select(F.col("doc_id").alias("index"), "lang")}
    return cm.split_datasets(cm.concat_datasets(parts, "original_index"), "docs")


@query("k4_distinct_keys", """
    SELECT 'difference' AS op, o_custkey AS id FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'intersection', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(t):
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    out = lambda how: cm.distinct_keys(side("F"), side("P"), how).select(F.lit(how).alias("op"), "id")
    return out("difference").unionByName(out("intersection"))


_SCORES = """(SELECT model, dataset, CASE status WHEN 'F' THEN 'acc' WHEN 'O' THEN 'f1' ELSE 'rec' END AS metric, CAST(floor(min(value)) AS DOUBLE) AS value, count(*) AS n FROM @runs GROUP BY 1, 2, 3)"""


def _scores(t):
    metric = F.when(F.col("status") == "F", "acc").when(F.col("status") == "O", "f1").otherwise("rec")
    return t.runs.groupBy("model", "dataset", metric.alias("metric")).agg(
        F.floor(F.min("value")).cast("double").alias("value"), F.count("*").alias("n"))


NAMES = ["D0/acc", "D1/acc", "D2/f1", "D5/rec"]


@query("k5_leaderboard", "SELECT model, " + ", ".join(f"max(value) FILTER (WHERE dataset = '{x.split('/')[0]}' AND metric = '{x.split('/')[1]}') AS \"{x}\"" for x in NAMES) + f" FROM {_SCORES} GROUP BY model")
def _(t):
    named = _scores(t).withColumn("metric", F.concat_ws("/", "dataset", "metric"))
    return cm.leaderboard(named, NAMES)


@query("k5_headline", f"""
    SELECT model, dataset, round(sum(CASE dataset WHEN 'D0' THEN value * 100 ELSE value END), 6) AS headline FROM {_SCORES}
    WHERE (dataset = 'D0' AND metric = 'acc') OR (dataset = 'D3' AND metric IN ('acc', 'f1')) GROUP BY model, dataset""")
def _(t):
    return cm.headline(_scores(t), {"D0": (["acc"], 100.0), "D3": (["acc", "f1"], 1.0)})


SETS = [f"D{i}" for i in range(9)]


def _summary_sql(total):
    cells = ", ".join(f"round(max(value) FILTER (WHERE dataset = '{d}') * 100, 2) AS \"{d}\"" for d in SETS)
    return f"SELECT metric, model, {cells}, CASE WHEN count(*) = 9 THEN round({total} * 100, 2) END AS summary FROM {_SCORES} WHERE dataset IN ('D0', 'D1', 'D2', 'D3', 'D4', 'D5', 'D6', 'D7', 'D8') GROUP BY metric, model"


@query("k6_experiment_summary", _summary_sql("sum(value) / 9"))
def _(t):
    return cm.experiment_summary(_scores(t), SETS)


@query("k6_experiment_summary_weighted", _summary_sql("sum(value * n) / sum(n)"))
def _(t):
    return cm.experiment_summary(_scores(t), SETS, weighted=True)


@query("k7_transpose_report", """
    SELECT category AS "group", round(avg(hit) FILTER (WHERE split = 'dev') * 100, 1) AS dev, round(avg(hit) FILTER (WHERE split = 'test') * 100, 1) AS test FROM @scored GROUP BY category""")
def _(t):
    report = rp.accuracy(t.scored, {"category": "category"}, keys=["split"], digits=None)
    return cm.transpose_report(report, ["dev", "test"])


def _radar_sql(v, pad):
    return f"""WITH s AS (SELECT model, metric, avg(value) / 10000 AS value FROM {_SCORES} GROUP BY model, metric), r AS (SELECT metric, min({v}) AS lo, max({v}) AS hi FROM s GROUP BY metric),
    w AS (SELECT max(hi - lo) * {pad} AS span FROM r), p AS (SELECT s.*, lo, hi, span, (lo + hi) / 2 + span / 2 AS top FROM s JOIN r USING (metric) CROSS JOIN w)
    SELECT model, metric, round(value, 9) AS value, round(({v} - CASE WHEN top < 100 THEN top - span ELSE 100 - span END) / span * 100, 6) AS scaled FROM p"""


def _radar(t, log):
    scores = _scores(t).groupBy("model", "metric").agg((F.avg("value") / 10000).alias("value"))
    return cm.radar_normalise(scores, log=log).withColumn("value", F.round("value", 9))


@query("k8_radar_normalise", _radar_sql("value", "1.25e0"))
def _(t):
    return _radar(t, False)


@query("k8_radar_normalise_log", _radar_sql("ln(value)", "1.005e0"))
def _(t):
    return _radar(t, True)


@query("k9_response_coverage", """
    SELECT d.lang, count(*) AS total, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND l.quality = 0) AS failed,
           round((count(*) - count(*) FILTER (WHERE l.doc_id IS NULL) - count(*) FILTER (WHERE l.doc_id IS NOT NULL AND l.quality = 0)) / CAST(count(*) AS DOUBLE), 6) AS success
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def _(t):
    responses = t.labels.withColumn("done", F.when(F.col("quality") == 1, 1))
    return cm.response_coverage(t.documents.select("doc_id", "lang"), responses, "doc_id", "done", ["lang"])


@query("k10_failure_scan", """
    SELECT model, dataset, count(*) FILTER (WHERE f) AS failed, round(count(*) FILTER (WHERE f) * 100e0 / count(*), 6) AS failed_share, count(*) FILTER (WHERE j) AS judge_failed, count(*) AS n
    FROM (SELECT model, 'D' || "index" % 5 AS dataset, contains(prediction, 'Failed to obtain answer via API') AS f, run % 19 = 0 OR line = 7 AS j FROM @preds) GROUP BY ALL""")
def _(t):
    rows = t.preds.select("model", F.concat(F.lit("D"), (F.col("index") % 5).cast("string")).alias("dataset"), "prediction",
                          F.when(F.col("run") % 19 == 0, "All 5 retries failed.").alias("log"), F.when(F.col("line") == 7, -1).otherwise(1).alias("score"))
    return cm.failure_scan(rows, "prediction", "log", "score")


@query("k11_merge_shards", """
    WITH s AS (SELECT qid, varid, hit, 0 AS sh FROM @variants WHERE varid < 5 UNION ALL SELECT qid, varid, 1 - hit, 1 FROM variants WHERE varid > 3 UNION ALL SELECT qid, varid, hit + 10, 2 FROM variants WHERE qid % 5 = 0)
    SELECT qid, varid, max_by(hit, sh) AS hit FROM s GROUP BY qid, varid""")
def _(t):
    v = t.variants.select("qid", "varid", "hit")
    shards = [v.filter("varid < 5"), v.filter("varid > 3").withColumn("hit", 1 - F.col("hit")), v.filter("qid % 5 = 0").withColumn("hit", F.col("hit") + 10)]
    return cm.merge_shards(shards, ["qid", "varid"], ["hit"])


@query("k12_round_robin", """
    SELECT qid, varid, (row_number() OVER (ORDER BY qid, varid) - 1) % 8 AS fold FROM @variants""")
def _(t):
    return fold_id(t.variants.select("qid", "varid"), ["qid", "varid"], 8)


@query("a14_latest_run", """
    SELECT model, dataset, eval_id, file_no FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY eval_id DESC, file_no DESC) AS rn FROM @runs) WHERE rn = 1""")
def _(t):
    return cm.latest_run(t.runs, columns=["file_no"])
