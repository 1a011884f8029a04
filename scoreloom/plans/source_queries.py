"""Queries over sources, item shaping (A) and user functions (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.score import flag
from scoreloom.operators import apply as ap
from scoreloom.operators import items as it
from scoreloom.operators import statistics as stat
from scoreloom.operators.ordered import prefix_fold
from scoreloom.plans import sqltext as q
from scoreloom.plans.catalog import query
from scoreloom.plans.corpus_queries import word_counts
from scoreloom.sources import pages as pg
from scoreloom.sources import tables as tb


@query("a1_read_table", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, lang FROM documents")
def _(t):
    path = tb.scratch_folder(t.spark, "documents.tsv")
    tb.write_table(t.documents.select("doc_id", "text", "lang"), path)
    return tb.read_table(t.spark, path).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("a2_write_table", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def _(t):
    path = tb.scratch_folder(t.spark, "conversations.jsonl")
    tb.write_table(t.conversations, path)
    back = tb.read_table(t.spark, path, "conv_id bigint, turn bigint, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("a3_parquet_to_tsv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def _(t):
    path = tb.scratch_folder(t.spark, "supplier.tsv")
    tb.parquet_to_tsv(t.spark, f"{t.path}/supplier.parquet", path)
    return tb.read_table(t.spark, path).select("s_suppkey", "s_name", "s_nationkey")


@query("a4_read_parts", """SELECT "index", question, category, row_number() OVER (ORDER BY "index") - 1 AS position FROM @items""")
def _(t):
    kept = t.items.select("index", "question", "category")
    paths = []
    for split, rows in (("dev", kept.filter("index % 2 = 0")), ("test", kept.filter("index % 2 = 1"))):
        paths.append(tb.scratch_folder(t.spark, f"{split}.parquet"))
        tb.write_table(rows, paths[-1])
    return it.with_position(tb.read_parts(t.spark, paths), "index", "position")


@query("a5_read_json_annotations", """
    SELECT CAST("index" AS VARCHAR) AS "index", question, 'The choices are listed below:' || chr(10) || '(A) ' || "A" || chr(10) || '(B) ' || "B" || chr(10) || '(C) ' || "C" || chr(10) || '(D) none' || chr(10) || '(E) all' AS options_text,
      "A", "B", "C", 'none' AS "D", 'all' AS "E", answer FROM @items""")
def _(t):
    options = F.array(*[F.concat(F.lit(f"({c}) "), v) for c, v in (("A", F.col("A")), ("B", F.col("B")), ("C", F.col("C")), ("D", F.lit("none")), ("E", F.lit("all")))])
    rows = t.items.select(F.col("index").cast("string").alias("index"), "question", options.alias("multi-choice options"), "answer", "category", F.col("l2_category").alias("l2-category"))
    path = tb.scratch_folder(t.spark, "annotations")
    # files of a hundred records each, every one an array
    files = rows.groupBy(F.floor(F.col("index").cast("bigint") / 100).alias("file")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return tb.read_json_annotations(t.spark, path).select("index", "question", "options_text", *"ABCDE", "answer")


@query("a6_detect_kind", """
    SELECT 'items' AS name, 'TEXT' AS modality, 'MCQ' AS type, count(*) AS n FROM @items UNION ALL SELECT 'multi', 'TEXT', 'VQA', count(*) FROM @multi UNION ALL SELECT 'pages', 'IMAGE', 'VQA', count(*) FROM pages""")
def _(t):
    tables = {"items": t.items, "multi": t.multi.withColumn("question", F.col("prediction")), "pages": t.pages.select(F.col("url").alias("question"), F.col("html").alias("image"))}
    out = None
    for name, df in tables.items():
        modality, kind = tb.detect_kind(df.columns)
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(modality).alias("modality"), F.lit(kind).alias("type"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("a7_detect_dataset_by_profile", """
    SELECT max(CASE WHEN l_orderkey * 20 < 100000 THEN l_orderkey * 20 END) AS max_index, round(avg(CASE WHEN l_linenumber % 3 > 0 THEN 1e0 ELSE 0e0 END), 6) AS cjk_share,
           CASE WHEN avg(CASE WHEN l_linenumber % 3 > 0 THEN 1e0 ELSE 0e0 END) > 0.5 THEN 'cn' ELSE 'en' END AS language FROM lineitem""")
def _(t):
    question = F.when(F.col("l_linenumber") % 3 > 0, "图中有什么").otherwise("what is shown")
    return tb.profile(t.lineitem.select((F.col("l_orderkey") * 20).alias("index"), question.alias("question")))


@query("a8_verify_checksum", """
    WITH h AS (SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderstatus || chr(31) || o_orderpriority), 1, 8) AS BIGINT) AS h FROM orders)
    SELECT count(*) AS n, md5(count(*) || '|' || bit_xor(h) || '|' || CAST(sum(h) AS VARCHAR)) AS fingerprint FROM h""")
def _(t):
    return tb.fingerprint(t.orders, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


_SHARED = "(SELECT page_id AS \"index\", CASE page_id % 4 WHEN 0 THEN CAST(page_id + 1 AS VARCHAR) WHEN 2 THEN CAST(page_id + 2 AS VARCHAR) ELSE html END AS image FROM pages)"


@query("a9_resolve_shared_payload", f"""
    WITH s AS {_SHARED} SELECT a."index", md5(coalesce(b.image, a.image)) AS digest, CASE WHEN length(a.image) <= 64 AND b."index" IS NULL THEN 'unknown owner' END AS payload_error
    FROM s a LEFT JOIN s b ON length(a.image) <= 64 AND a.image = CAST(b."index" AS VARCHAR) AND length(b.image) > 64""")
def _(t):
    i = F.col("page_id")
    image = F.when(i % 4 == 0, (i + 1).cast("string")).when(i % 4 == 2, (i + 2).cast("string")).otherwise(F.col("html"))
    out = it.resolve_shared_payload(t.pages.select(i.alias("index"), image.alias("image")), "image")
    return out.select("index", F.md5("image").alias("digest"), "payload_error")


@query("a10_payload_fanout", """
    SELECT "index", CAST(pos AS INT) AS pos, CASE WHEN n > 1 THEN 'img/' || "index" || '_' || pos ELSE 'img/' || "index" END AS path, size FROM (
      SELECT "index", n, unnest(range(n)) AS pos, unnest(list_transform(o[1:n], lambda x: CAST(length(x) AS INT))) AS size FROM (SELECT "index", CAST(1 + "index" % 3 AS INT) AS n, ["A", "B", "C"] AS o FROM @items))""")
def _(t):
    images = F.slice(F.array(*[F.base64(F.encode(F.col(c), "utf-8")) for c in "ABC"]), 1, (1 + F.col("index") % 3).cast("int"))
    rows = t.items.select("index", F.concat(F.lit("img/"), F.col("index").cast("string")).alias("path"), images.alias("image"))
    files, _ = it.payload_fanout(rows, "image", "path")
    return files.select("index", "pos", "path", F.octet_length("content").alias("size"))


@query("a10_payload_paths", """
    SELECT "index", CASE "index" % 3 WHEN 0 THEN 'img/' || "index" WHEN 1 THEN 'img/' || "index" || '_0,img/' || "index" || '_1' ELSE 'img/' || "index" || '_0,img/' || "index" || '_1,img/' || "index" || '_2' END AS paths FROM @items""")
def _(t):
    images = F.slice(F.array("A", "B", "C"), 1, (1 + F.col("index") % 3).cast("int"))
    rows = t.items.select("index", F.concat(F.lit("img/"), F.col("index").cast("string")).alias("path"), images.alias("image"))
    return it.payload_fanout(rows, "image", "path")[1].select("index", F.array_join("paths", ",").alias("paths"))


_NAV = "list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"


_LEAD = "trim(regexp_replace({}, '^[\\s.,\\-:;]+', ''))"


@query("a11_pages_to_items", rf"""
    WITH l AS (SELECT page_id, {_NAV} AS li FROM pages),
    r AS (SELECT page_id, li, coalesce(li[2], '') AS "A", coalesce(li[3], '') AS "B", coalesce(li[4], '') AS "C", coalesce(li[5], '') AS "D",
            CASE WHEN page_id % 3 = 0 THEN li[3] WHEN page_id % 3 = 1 THEN 'C' ELSE 'zzz' END AS said FROM l WHERE len(li) > 0),
    s AS (SELECT *, CASE WHEN page_id % 3 < 2 THEN upper(regexp_extract(said, '(?i)^([a-d])', 1)) ELSE '' END AS letter,
            CASE WHEN page_id % 3 < 2 AND regexp_matches(said, '(?i)^[a-d]') THEN {_LEAD.format(r"regexp_replace(said, '(?i)^[a-d]\s*[).\-]?\s*', '')")} ELSE {_LEAD.format('said')} END AS txt FROM r)
    SELECT page_id, CAST(0 AS INT) AS "row", li[1] AS question, "A", "B", "C", "D",
      trim(regexp_replace(CASE WHEN txt <> '' THEN txt ELSE CASE letter WHEN 'A' THEN "A" WHEN 'B' THEN "B" WHEN 'C' THEN "C" WHEN 'D' THEN "D" ELSE '' END END, '^[\s.,\-:;]+', '')) AS answer,
      CASE WHEN letter <> '' THEN letter WHEN txt = '' THEN '' WHEN contains(lower("A"), lower(txt)) THEN 'A' WHEN contains(lower("B"), lower(txt)) THEN 'B' WHEN contains(lower("C"), lower(txt)) THEN 'C'
           WHEN contains(lower("D"), lower(txt)) THEN 'D' ELSE '' END AS correct_option, 'MCQ' AS question_type FROM s""")
def _(t):
    nav = F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)
    third = pg.inner_text(F.get(pg.elements(nav, "li"), F.lit(2)))
    said = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ans: "), third)).when(F.col("page_id") % 3 == 1, "C.").otherwise("zzz")
    # the whole page, with its list as a table row
    listed = F.concat(F.lit("<table><tr><td>"), nav, F.lit("</td><td>x</td><td>"), said, F.lit("</td></tr></table>"))
    rows = t.pages.select("page_id", F.when(nav == "", F.col("html")).otherwise(F.replace("html", F.concat(F.lit("<nav>"), nav, F.lit("</nav>")), listed)).alias("html"))
    return pg.pages_to_items(rows, "page_id", "html")


@query("a12_load_saq", "SELECT question_type, count(*) AS n FROM (SELECT CASE WHEN line % 2 = 0 THEN 'SAQ' ELSE 'MCQ' END AS question_type FROM @multi) WHERE question_type = 'SAQ' GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM @multi")
def _(t):
    typed = t.multi.withColumn("question_type", F.when(F.col("line") % 2 == 0, "SAQ").otherwise("MCQ"))
    saq = it.of_question_type(typed, "SAQ").groupBy("question_type").agg(F.count("*").alias("n"))
    return saq.unionByName(it.of_question_type(t.multi, "SAQ").agg(F.count("*").alias("n")).withColumn("question_type", F.lit("all")))


@query("a13_predictions_path", "SELECT DISTINCT 'model=' || model || '/eval_id=' || eval_id || '/dataset=' || dataset AS path FROM @runs")
def _(t):
    return t.runs.select(tb.predictions_path(F.col("model"), F.col("eval_id"), F.col("dataset")).alias("path")).distinct()


@query("a15_submission_export", f"""
    SELECT p.run, p.line, p."index", CASE WHEN i."A" IS NOT NULL THEN {q.infer('p.prediction', 'i.')} ELSE p.prediction END AS value
    FROM @preds p JOIN (SELECT "index", CASE WHEN "index" % 10 > 0 THEN "A" END AS "A", CASE WHEN "index" % 10 > 0 THEN "B" END AS "B", "C", "D" FROM @items) i ON p."index" = i."index" """)
def _(t):
    closed = F.col("index") % 10 > 0
    items = t.items.withColumns({c: F.when(closed, F.col(c)) for c in "AB"}).drop("question", "answer", "category", "l2_category", "split")
    joined = t.preds.join(items, "index")
    exported = joined.select("*", F.struct("run", "line", "index").alias("id"))
    return it.submission_export(exported, "id").select("id.*", "value")


@query("a15_submission_rows", f"""
    SELECT run, line, "index", coalesce(o, 'Z') AS opt, CASE WHEN o IS NULL THEN 'no option found in the reply' ELSE prediction END AS log
    FROM (SELECT p.run, p.line, p."index", p.prediction, {q.infer('p.prediction', 'i.')} AS o FROM @preds p JOIN @items i ON p."index" = i."index")""")
def _(t):
    joined = t.preds.join(t.items.drop("question", "answer", "category", "l2_category", "split"), "index")
    return it.submission_rows(joined).select("run", "line", "index", "opt", "log")


@query("a16_shuffle_two_options", """
    SELECT "index", CASE WHEN c = 1 THEN x ELSE y END AS "A", CASE WHEN c = 1 THEN y ELSE x END AS "B", CASE WHEN c = 1 THEN 'B' ELSE 'A' END AS answer FROM (SELECT "index", "A" AS x, "B" AS y, ("index" * 31 + 7) % 5 % 2 AS c FROM @items)""")
def _(t):
    rows = t.items.select("index", F.col("A").alias("attack"), F.col("B").alias("label"))
    return it.shuffle_two_options(rows, "attack", "label", (F.col("index") * 31 + 7) % 5 % 2)


@query("a17_organise_tasks", """
    WITH r AS (SELECT category, "index", question, l2_category, row_number() OVER (PARTITION BY category ORDER BY "index") - 1 AS pos FROM @items)
    SELECT category, pos AS position, "index" || ':' || question AS query, d AS description
    FROM r JOIN (SELECT category AS c, min(l2_category) AS d FROM r GROUP BY 1) ON category = c""")
def _(t):
    text = F.concat_ws(":", F.col("index").cast("string"), "question")
    return it.organise_tasks(t.items, "category", "index", "l2_category", text)


@query("a18_expand_qa_pairs", """
    SELECT "index", 0 AS pair, 'what is ' || question AS question, "A" AS answer FROM @items WHERE "index" % 4 > 0 UNION ALL SELECT "index", 1, 'type', "B" FROM @items WHERE "index" % 4 > 0""")
def _(t):
    pair = lambda a, b: F.concat(F.lit("{'question': '"), a, F.lit("', 'answer': '"), b, F.lit("'}"))
    listed = F.concat(F.lit("["), pair(F.concat(F.lit("what is "), "question"), F.col("A")), F.lit(", "), pair(F.lit("type"), F.col("B")), F.lit("]"))
    rows = t.items.select("index", F.when(F.col("index") % 4 > 0, listed).otherwise("not a list").alias("question"))
    return it.expand_qa_pairs(rows)[0]


@query("a19_pack_questions", """
    SELECT video, '{' || string_agg('"' || event_id || '":"' || kind || '"', ',' ORDER BY event_id) || '}' AS questions FROM @spans GROUP BY video""")
def _(t):
    return it.pack_questions(t.spans.select("video", "event_id", "kind"), "video", "event_id", "kind")


@query("a19_question_rows", 'SELECT video, row_number() OVER (PARTITION BY video ORDER BY event_id) - 1 AS position, CAST(event_id AS VARCHAR) AS "key", kind FROM @spans')
def _(t):
    return it.question_rows(t.spans.select("video", "event_id", "kind"), "video", "event_id", "kind")


def _packs(t):
    """Replies to the packs: some failed, some unreadable, some as loose lines."""
    packs = it.pack_questions(t.spans.select("video", "event_id", "kind"), "video", "event_id", "kind")
    loose = F.regexp_replace(F.regexp_replace("questions", ",", "\n"), '":"', '": "')
    reply = F.when(F.col("video") % 7 == 0, "Failed to obtain answer via API.").when(F.col("video") % 7 == 1, "no json").when(
        F.col("video") % 7 == 2, F.regexp_replace(loose, r"\}$", "")).otherwise(F.concat(F.lit("Answers: "), "questions"))
    return packs.select("video", reply.alias("reply"))


@query("a19_unpack_answers", "SELECT video, event_id, CASE WHEN video % 7 > 1 THEN kind END AS prediction FROM @spans")
def _(t):
    return it.unpack_answers(_packs(t), t.spans.select("video", "event_id"), "video", "event_id", "reply")[0]


@query("a19_unpack_counters", """
    WITH p AS (SELECT video, 1 AS packs, count(*) AS n FROM @spans GROUP BY video)
    SELECT 'GEN_FAIL' AS counter, CAST(sum(packs) FILTER (WHERE video % 7 = 0) AS BIGINT) AS n FROM p UNION ALL SELECT 'PARSE_OK', CAST(sum(packs) FILTER (WHERE video % 7 > 1) AS BIGINT) FROM p
    UNION ALL SELECT 'PARSE_FAIL', CAST(sum(packs) FILTER (WHERE video % 7 = 1) AS BIGINT) FROM p UNION ALL SELECT 'VALIDQ', CAST(sum(n) FILTER (WHERE video % 7 > 1) AS BIGINT) FROM p UNION ALL SELECT 'INVALIDQ', CAST(sum(n) FILTER (WHERE video % 7 < 2) AS BIGINT) FROM p""")
def _(t):
    return it.unpack_answers(_packs(t), t.spans.select("video", "event_id"), "video", "event_id", "reply")[1]


@query("a20_scatter_by_benchmark", """
    SELECT kind AS benchmark, round(avg(CASE kind WHEN 'A' THEN CASE WHEN prediction = 'Yes.' THEN 1e0 ELSE 0e0 END WHEN 'N' THEN CASE WHEN lower(prediction) = lower(split_part(answers, '|', 2)) THEN 1e0 ELSE 0e0 END END), 6) AS score,
      CASE WHEN kind = 'R' THEN 'R' END AS route_error, count(*) AS n FROM @multi GROUP BY kind""")
def _(t):
    scorers = {"A": flag(F.col("prediction") == "Yes."), "N": flag(F.lower("prediction") == F.lower(F.split_part("answers", F.lit("|"), F.lit(2))))}
    out = it.scatter_by_benchmark(t.multi, F.col("kind"), scorers)
    return out.groupBy("benchmark", "route_error").agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n"))


def _shout(row):
    if row["index"] % 50 == 7:
        raise ValueError("no answer")
    return row["question"].upper()


@query("h1_resumable_apply", """
    SELECT "index", CASE WHEN "index" % 3 = 0 AND "index" % 2 = 0 THEN 'kept ' || question WHEN "index" % 50 = 7 THEN 'Failed to obtain answer via API: no answer' ELSE upper(question) END AS prediction FROM @items""")
def _(t):
    items = t.items.select("index", "question")
    old = F.when(F.col("index") % 2 == 0, F.concat(F.lit("kept "), "question")).otherwise("Failed to obtain answer via API.")
    results = items.filter("index % 3 = 0").select("index", old.alias("prediction"))
    return ap.resumable_apply(items, results, _shout, "index")


def _judge(row, attempt):
    """A stand-in judge: reads replies that name a size, only on its second attempt."""
    return "C" if attempt > 0 and "large" in row["prediction"] else None


_RULED = q.infer("p.prediction", "i.")


@query("h2_rule_then_judge", f"""
    SELECT solved_by, answer, count(*) AS n FROM (SELECT CASE WHEN x IS NOT NULL THEN 'rule' ELSE 'judge' END AS solved_by, coalesce(x, CASE WHEN contains(prediction, 'large') THEN 'C' ELSE 'Z' END) AS answer
      FROM (SELECT p.prediction, {_RULED} AS x FROM @preds p JOIN @items i ON p."index" = i."index")) GROUP BY ALL""")
def _(t):
    from scoreloom.functions.extract import infer
    rows = t.preds.join(t.items.select("index", *"ABCD"), "index").select("index", "run", "line", "prediction", *"ABCD")
    return ap.rule_then_judge(rows, infer(F.col("prediction"), it.item_options()), _judge, "index").groupBy("solved_by", "answer").agg(F.count("*").alias("n"))


@query("h3_dialog_history", """
    SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS history_chars, count(text) OVER w AS history_turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    chars = prefix_fold(rows, F.col("size"), "turn", "history_chars", ["conv_id"])
    both = prefix_fold(chars, F.lit(1).cast("bigint"), "turn", "history_turns", ["conv_id"])
    return both.select("conv_id", "turn", F.coalesce("history_chars", F.lit(0)).alias("history_chars"), F.coalesce("history_turns", F.lit(0)).alias("history_turns"))


@query("h3_multi_turn_apply", """
    WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS turns FROM documents)
    SELECT doc_id, md5(array_to_string(list_transform(range(len(turns)), lambda i: (i * 2) || ' ' || length(turns[1 + i])), '|')) AS answers FROM d""")
def _(t):
    turns = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    said = ap.multi_turn_apply(t.documents.select("doc_id", turns.alias("turns")), lambda history, question: f"{len(history)} {len(question)}", "doc_id", "turns")
    return said.select("doc_id", F.md5(F.array_join("answers", "|")).alias("answers"))


@query("h4_metric_registry", """
    SELECT metric, round(sum(score), 4) AS score, count(*) AS n FROM (SELECT m AS metric, CASE m WHEN 'exact_str_match_case_insensitive' THEN CASE WHEN lower(a) = lower(b) THEN 1e0 ELSE 0e0 END
        WHEN 'edit_similarity' THEN 1e0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) WHEN 'jaccard' THEN len(list_intersect(string_split(a, ','), string_split(b, ','))) / CAST(len(list_distinct(list_concat(string_split(a, ','), string_split(b, ',')))) AS DOUBLE) END AS score
      FROM (SELECT choice AS a, choice_truth AS b, CASE "index" % 4 WHEN 0 THEN 'exact_str_match_case_insensitive' WHEN 1 THEN 'edit_similarity' WHEN 2 THEN 'jaccard' ELSE 'unknown' END AS m FROM @notes)) GROUP BY metric""")
def _(t):
    i = F.col("index") % 4
    name = F.when(i == 0, "exact_str_match_case_insensitive").when(i == 1, "edit_similarity").when(i == 2, "jaccard").otherwise("unknown")
    scored = ap.metric_scores(t.notes.select(name.alias("metric"), "choice", "choice_truth"), "metric", "choice", "choice_truth")
    return scored.groupBy("metric").agg(F.round(F.sum("score"), 4).alias("score"), F.count("*").alias("n"))


@query("h5_corpus_metric", """
    SELECT l_returnflag AS "group", round(100e0 * sum(least(l_quantity, l_linenumber * 8)) / sum(l_quantity), 6) AS precision FROM lineitem GROUP BY l_returnflag""")
def _(t):
    match = F.least(F.col("l_quantity"), (F.col("l_linenumber") * 8).cast("double"))
    rows = t.lineitem.withColumn("group", F.col("l_returnflag"))
    return stat.share(match, F.col("l_quantity"), 100.0).value(rows, ["group"], "precision")


@query("h5_corpus_bleu_by_turn", """
    WITH p AS (SELECT *, turn % 2 AS half FROM @pairs), g AS (""" + word_counts("(SELECT conv_id, turn, half, " + q.words("hyp") + " AS hw, " + q.words("ref") + " AS rw FROM p)", "conv_id, turn, half", "hw", "rw", 4) + """),
    s AS (SELECT half, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM g GROUP BY half, n),
    f AS (SELECT half, avg(CASE WHEN m > 0 THEN ln(m / CAST(h AS DOUBLE)) END) AS p, count(*) FILTER (WHERE m > 0) AS k, max(h) FILTER (WHERE n = 1) AS h, max(r) FILTER (WHERE n = 1) AS r FROM s GROUP BY half)
    SELECT half, round(CASE WHEN k = 4 THEN CASE WHEN h >= r THEN 1e0 ELSE exp(1e0 - r / CAST(h AS DOUBLE)) END * exp(p) ELSE 0e0 END, 6) AS bleu FROM f""")
def _(t):
    rows = t.pairs.withColumn("half", F.col("turn") % 2)
    return stat.STATISTICS["bleu"](["conv_id", "turn"], "hyp", "ref").value(rows, ["half"], "bleu")


@query("h4_field_aggregation", """
    SELECT l_orderkey, l_linenumber, round((l_discount * 2e0 + l_tax + CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END * 0.5e0) / 3.5e0, 6) AS score FROM lineitem""")
def _(t):
    scores = F.create_map(F.lit("discount"), F.col("l_discount").cast("double"), F.lit("tax"), F.col("l_tax").cast("double"), F.lit("returned"), flag(F.col("l_returnflag") == "R"))
    weights = F.create_map(F.lit("discount"), F.lit(2.0), F.lit("returned"), F.lit(0.5))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", scores.alias("s"), weights.alias("w"))
    return stat.aggregate_fields(rows, "s", "w").select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@query("h2_judge_groups", """
    WITH r AS (SELECT event_id // 4 AS quad, event_id, kind FROM @spans),
    x AS (SELECT quad, bool_or(kind = 'purchase' AND event_id % 11 = 0) AS lost FROM r GROUP BY quad),
    f AS (SELECT r.quad, event_id % 17 <> 0 AS ok, row_number() OVER (PARTITION BY r.quad ORDER BY event_id) AS n FROM r JOIN x ON x.quad = r.quad WHERE NOT lost AND kind <> 'purchase'),
    m AS (SELECT quad, min(n) FILTER (WHERE NOT ok) AS bad, count(*) AS n FROM f GROUP BY quad)
    SELECT x.quad, CASE WHEN lost OR bad IS NOT NULL THEN 0 ELSE 1 END AS hit, coalesce(bad, n, 0) AS judged FROM x LEFT JOIN m ON m.quad = x.quad""")
def _(t):
    rows = t.spans.select(F.floor(F.col("event_id") / 4).alias("quad"), "event_id", "kind", F.lit("A").alias("truth"))
    rule = F.when(F.col("kind") == "purchase", F.when(F.col("event_id") % 11 == 0, "B").otherwise("A"))
    return ap.judge_groups(rows, "quad", "event_id", "event_id", "truth", rule, lambda row, attempt: "A" if row["event_id"] % 17 else "C")
