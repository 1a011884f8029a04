"""Queries over joins (F) and time operators (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import joins as jn
from scoreloom.operators import timing as tm
from scoreloom.operators.ordered import uniform_sample
from scoreloom.plans.catalog import query


@query("f1_attach_ground_truth", """
    SELECT "GT", model, count(*) AS n FROM (SELECT p.model, i.answer AS "GT" FROM @preds p JOIN @items i ON p."index" = i."index") GROUP BY ALL""")
def _(t):
    return jn.attach_ground_truth(t.preds, t.items).groupBy("GT", "model").agg(F.count("*").alias("n"))


@query("f1_unknown_predictions", """
    SELECT 'dev' AS split, model, count(*) AS n FROM @preds WHERE "index" NOT IN (SELECT "index" FROM @items WHERE split = 'dev') GROUP BY model
    UNION ALL SELECT 'test', model, count(*) FROM @preds WHERE "index" NOT IN (SELECT "index" FROM @items WHERE split = 'test') GROUP BY model""")
def _(t):
    of = lambda split: jn.unknown_predictions(t.preds, t.items.filter(F.col("split") == split)).groupBy("model").agg(F.count("*").alias("n")).select(F.lit(split).alias("split"), "model", "n")
    return of("dev").unionByName(of("test"))


@query("f2_attach_optional", """
    SELECT model, answer, count(*) AS n FROM @preds p LEFT JOIN (SELECT "index", answer FROM @items) i ON p."index" = i."index" GROUP BY ALL""")
def _(t):
    return jn.attach_optional(t.preds, t.items, "answer").groupBy("model", "answer").agg(F.count("*").alias("n"))


def _corpus(t, side):
    kind = F.when(F.col("turn") % 3 == 0, "MCQ").otherwise("SAQ")
    rows = t.conversations.filter(F.col("role") == side)
    return rows.select((F.col("conv_id") * 100 + F.floor(F.col("turn") / 2)).alias("sample_id"), kind.alias("question_type"), F.col("text").alias("question"))


_SIDE = "(SELECT conv_id * 100 + CAST(floor(turn / 2) AS BIGINT) AS sample_id, CASE WHEN turn % 3 = 0 THEN 'MCQ' ELSE 'SAQ' END AS question_type, text FROM conversations WHERE role = '{}')"


@query("f3_align_parallel", f"""
    SELECT a.sample_id, md5(a.text) AS src, md5(b.text) AS tgt FROM {_SIDE.format('user')} a JOIN {_SIDE.format('assistant')} b ON a.sample_id = b.sample_id
    WHERE a.question_type = 'SAQ' AND b.question_type = 'SAQ'""")
def _(t):
    joined = jn.align_parallel(_corpus(t, "user"), _corpus(t, "assistant"), "sample_id", ["question", "answer"])
    return joined.select("sample_id", F.md5("question_src").alias("src"), F.md5("question_tgt").alias("tgt"))


@query("f3_unmatched_source", f"""
    SELECT a.sample_id FROM {_SIDE.format('user')} a WHERE NOT EXISTS (SELECT 1 FROM {_SIDE.format('assistant')} b WHERE a.sample_id = b.sample_id)""")
def _(t):
    return jn.unmatched_source(_corpus(t, "user"), _corpus(t, "assistant"), "sample_id")


@query("f4_join_variants", """
    SELECT a.qid, a.subject, a.hit AS hit_1, b.hit AS hit_2, c.hit AS hit_3 FROM @variants a JOIN variants b ON a.qid = b.qid AND b.varid = 2 JOIN variants c ON a.qid = c.qid AND c.varid = 3 WHERE a.varid = 1""")
def _(t):
    return jn.join_variants(t.variants, ["qid", "subject"], "varid", [1, 2, 3])


_MERGED = """SELECT {key}, min(start_s) AS start_s, max(end_s) AS end_s FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY {key} ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM {src})) GROUP BY {key}, island"""


@query("f5_merge_intervals", _MERGED.format(key="video", src="@spans"))
def _(t):
    return jn.merge_intervals(t.spans, ["video"], "start_s", "end_s")


_A, _B = "(SELECT * FROM @spans WHERE kind IN ('click', 'view'))", "(SELECT * FROM @spans WHERE kind NOT IN ('click', 'view'))"


@query("f6_interval_overlap_join", f"""
    WITH a AS ({_MERGED.format(key='video', src=_A)}), b AS ({_MERGED.format(key='video', src=_B)}),
    la AS (SELECT video, sum(end_s - start_s) AS la FROM a GROUP BY video), lb AS (SELECT video, sum(end_s - start_s) AS lb FROM b GROUP BY video),
    o AS (SELECT a.video, sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) AS overlap FROM a JOIN b ON a.video = b.video AND a.start_s < b.end_s AND b.start_s < a.end_s GROUP BY a.video)
    SELECT video, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap, CAST(coalesce(la, 0) + coalesce(lb, 0) - coalesce(overlap, 0) AS BIGINT) AS union_length,
      round(coalesce(overlap, 0) / CAST(coalesce(la, 0) + coalesce(lb, 0) - coalesce(overlap, 0) AS DOUBLE), 6) AS iou
    FROM la FULL JOIN lb USING (video) LEFT JOIN o USING (video)""")
def _(t):
    side = F.col("kind").isin("click", "view")
    return jn.interval_iou_by_key(t.spans.filter(side), t.spans.filter(~side), ["video"], "start_s", "end_s")


def _frames(t):
    return t.spans.filter(F.col("kind") == "click").select("video", F.col("event_id").alias("frame"), F.col("start_s").alias("time"))


def _subs(t):
    text = F.concat(F.lit("line "), (F.col("event_id") % 7).cast("string"))
    return t.spans.filter(F.col("kind") != "click").select("video", F.col("event_id").alias("rank"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), text.alias("text"))


_FRAMES = "frames AS (SELECT video, event_id AS frame, start_s AS time FROM @spans WHERE kind = 'click')"
_SUBS = "subs AS (SELECT video, event_id AS rank, start_s AS start_, end_s AS end_, 'line ' || event_id % 7 AS text FROM @spans WHERE kind <> 'click')"


@query("f7_nearest_text_to_frames", f"""
    WITH {_FRAMES}, {_SUBS},
    w AS (SELECT video, text, (start_ + end_) / 2e0 AS mid, CASE WHEN end_ - start_ < 1 THEN (start_ + end_) / 2e0 - 0.5 ELSE start_ END AS f, CASE WHEN end_ - start_ < 1 THEN (start_ + end_) / 2e0 + 0.5 ELSE end_ END AS g FROM subs),
    k AS (SELECT video, text, mid FROM w WHERE EXISTS (SELECT 1 FROM frames x WHERE x.video = w.video AND x.time > w.f AND x.time < w.g)),
    e AS (SELECT video, CAST(time AS DOUBLE) AS seconds, 0 AS kind, CAST(NULL AS VARCHAR) AS text FROM frames UNION ALL SELECT video, mid, 1, text FROM k)
    SELECT video, seconds, kind, text, row_number() OVER (PARTITION BY video ORDER BY seconds, kind, text) - 1 AS position FROM e""")
def _(t):
    return jn.place_spans_among_frames(_frames(t), _subs(t), "video", "time", "start", "end", "text", 3600)


_HITS = "hits AS (SELECT f.video, f.frame, f.time, s.rank, s.text FROM frames f JOIN subs s ON f.video = s.video AND s.start_ < f.time AND f.time < s.end_)"


@query("f8_first_subtitle_per_frame", f"WITH {_FRAMES}, {_SUBS}, {_HITS} SELECT video, frame, time, min_by(text, rank) AS text FROM hits GROUP BY video, frame, time")
def _(t):
    return jn.first_span_per_frame(_frames(t), _subs(t), "video", "frame", "time", "start", "end", "rank", "text", 60)


@query("f8_distinct_subtitles", f"WITH {_FRAMES}, {_SUBS}, {_HITS} SELECT video, text, min(time) AS first_seen FROM hits GROUP BY video, text")
def _(t):
    return jn.distinct_spans(_frames(t), _subs(t), "video", "time", "start", "end", "text", 3600)


@query("f9_step_chain_join", """
    SELECT a.qid, a.hit AS hit_1, b.hit AS hit_2, c.hit AS hit_3 FROM @variants a LEFT JOIN variants b ON a.qid = b.qid AND b.varid = 2 LEFT JOIN variants c ON a.qid = c.qid AND c.varid = 3 WHERE a.varid = 1""")
def _(t):
    return jn.step_chain_join(t.variants, "qid", "varid", [1, 2, 3], ["hit"])


@query("f10_taxonomy_join", """
    WITH m AS (SELECT pid AS leaf, avg(hit) AS m FROM (SELECT "index" AS pid, hit FROM @scored) GROUP BY 1)
    SELECT p_brand AS root, round(avg(m), 6) AS value, count(m) AS leaves FROM part LEFT JOIN m ON leaf = p_partkey GROUP BY p_brand""")
def _(t):
    nodes = t.part.select(F.col("p_partkey").alias("leaf"), F.col("p_brand").alias("root"))
    scores = t.scored.select(F.col("index").alias("leaf"), "hit")
    return jn.taxonomy_join(scores, nodes, "leaf", "root", "hit")


@query("f11_baseline_join", """
    WITH r AS (SELECT qid, 'c' || subject AS removed, CASE WHEN varid % 2 = 0 THEN 'main' ELSE 'aux' END AS tag, max(hit * 10 + varid) AS text FROM @variants GROUP BY ALL)
    SELECT a.qid, a.removed, a.text, b.text AS baseline FROM r a LEFT JOIN r b ON a.qid = b.qid AND a.removed = b.removed AND b.tag = 'aux' WHERE a.tag = 'main'""")
def _(t):
    tag = F.when(F.col("varid") % 2 == 0, "main").otherwise("aux")
    rows = t.variants.groupBy("qid", F.concat(F.lit("c"), "subject").alias("removed"), tag.alias("tag")).agg(F.max(F.col("hit") * 10 + F.col("varid")).alias("text"))
    return jn.baseline_join(rows, "qid", "tag", "removed", "main", "aux", "text").drop("tag")


@query("f12_reverse_pair_union", """
    SELECT CAST("index" AS VARCHAR) AS "index", task AS a, type AS b FROM @verdicts UNION ALL SELECT "index" || '_rev', type, task FROM verdicts""")
def _(t):
    rows = t.verdicts.select(F.col("index").cast("string").alias("index"), F.col("task").alias("a"), F.col("type").alias("b"))
    return jn.reverse_pair_union(rows, "index", "a", "b")


@query("f13_undone", """
    SELECT "index", category FROM @items WHERE "index" NOT IN (SELECT "index" FROM @preds WHERE model = 'M3' AND NOT contains(prediction, 'Failed to obtain answer via API'))""")
def _(t):
    from scoreloom.functions.text import is_failure
    done = t.preds.filter(F.col("model") == "M3")
    return jn.undone(t.items.select("index", "category"), done, "index", is_failure(F.col("prediction")))


MODELS, DATASETS = [f"M{i}" for i in range(8)], [f"D{i}" for i in range(10)]


@query("f14_missing_matrix", """
    WITH done AS (SELECT DISTINCT status, model, dataset FROM @runs),
    whole AS (SELECT status, model, dataset FROM done UNION ALL SELECT status, model, 'D9' FROM done WHERE dataset IN ('D1', 'D2') GROUP BY status, model HAVING count(*) = 2)
    SELECT s.status, m.model, d.dataset FROM (VALUES ('F'), ('O'), ('P')) s(status) CROSS JOIN (SELECT 'M' || i AS model FROM range(8) r(i)) m CROSS JOIN (SELECT 'D' || i AS dataset FROM range(10) r(i)) d
    WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.status = s.status AND w.model = m.model AND w.dataset = d.dataset)""")
def _(t):
    of = lambda status: jn.missing_matrix(t.runs.filter(F.col("status") == status), MODELS, DATASETS, {"D9": ["D1", "D2"]}).select(F.lit(status).alias("status"), "model", "dataset")
    return of("F").unionByName(of("O")).unionByName(of("P"))


@query("w1_hms_to_seconds", """
    SELECT event_id, round(CAST(floor((start_s % 86400) / 3600) AS DOUBLE) * 3600 + CAST(floor((start_s % 3600) / 60) AS DOUBLE) * 60 + start_s % 60 + 0.25e0, 6) AS seconds FROM @spans""")
def _(t):
    s = F.col("start_s")
    clock = F.concat_ws(":", F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60), F.concat((s % 60).cast("string"), F.lit(".25")))
    return t.spans.select("event_id", F.round(tm.hms_to_seconds(clock), 6).alias("seconds"))


@query("w2_uniform_sample", """
    WITH r AS (SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY video) AS n FROM @spans)
    SELECT r.video, event_id FROM r WHERE n <= 16 OR pos IN (SELECT CAST(floor(i * r.n / 16e0) AS BIGINT) FROM range(16) x(i))""")
def _(t):
    return uniform_sample(t.spans.select("video", "event_id"), "event_id", 16, ["video"]).select("video", "event_id")


@query("w2_sample_array", """
    SELECT doc_id, array_to_string(CASE WHEN len(w) <= 8 THEN w ELSE list_transform(range(8), lambda i: w[1 + CAST(floor(i * len(w) / 8e0) AS INT)]) END, ' ') AS sample
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def _(t):
    from scoreloom.functions.text import words
    return t.documents.select("doc_id", F.array_join(tm.sample_array(words(F.col("text")), 8), " ").alias("sample"))


@query("w3_sample_times", """
    SELECT event_id, array_to_string(list_transform(range(CAST(floor((100 + event_id % 50) / 25e0 * 2e0) AS BIGINT)), lambda i: CAST(floor(i * (25e0 / 2e0)) AS BIGINT)), ',') AS by_rate,
      array_to_string(list_transform(range(1, 5), lambda i: CAST(floor(i * ((100 + event_id % 50) / 5e0)) AS BIGINT)), ',') AS by_count FROM events""")
def _(t):
    frames = 100 + F.col("event_id") % 50
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return t.events.select("event_id", text(tm.sample_by_rate(frames, F.lit(25.0), 2.0)).alias("by_rate"), text(tm.sample_by_count(frames, 4)).alias("by_count"))


@query("w4_sample_in_intervals", """
    WITH f AS (SELECT event_id, video, CAST(round(start_s * 0.5e0) AS BIGINT) AS a, CAST(round(end_s * 0.5e0) AS BIGINT) AS b FROM @spans),
    t AS (SELECT *, sum(b - a) OVER (PARTITION BY video) AS total FROM f),
    p AS (SELECT *, greatest(1, CAST(floor(5000 * ((b - a) / CAST(total AS DOUBLE))) AS INT)) AS points FROM t)
    SELECT video, count(*) AS n, CAST(sum(frame) AS BIGINT) AS total FROM (SELECT video, unnest(CASE WHEN total <= 5000 THEN range(a, b) ELSE list_transform(range(points), lambda i: CAST(floor(a + (b - a) / CAST(points AS DOUBLE) / 2 + (b - a) / CAST(points AS DOUBLE) * i) AS BIGINT)) END) AS frame FROM p) GROUP BY video""")
def _(t):
    picked = tm.sample_in_intervals(t.spans.select("video", "start_s", "end_s"), ["video"], "start_s", "end_s", 5000, 0.5)
    return picked.groupBy("video").agg(F.count("*").alias("n"), F.sum("frame").alias("total"))
