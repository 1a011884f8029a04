"""Queries over normalisation and filters (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.functions.extract import all_found
from scoreloom.operators import items as it
from scoreloom.plans import sqltext as q
from scoreloom.plans.catalog import query


def digest(df, key: str, value):
    """Key, fingerprint and size of a long text result."""
    return df.select(key, F.md5(value).alias("digest"), F.length(value).alias("size"))


def digest_sql(key: str, value: str, table: str) -> str:
    return f"SELECT {key}, md5(value) AS digest, CAST(length(value) AS INT) AS size FROM (SELECT {key}, {value} AS value FROM {table})"


@query("b1_drop_missing_payload", """
    SELECT split, count(*) AS n FROM @items WHERE "D" IS NOT NULL GROUP BY split""")
def _(t):
    return it.drop_missing_payload(t.items, "D").groupBy("split").agg(F.count("*").alias("n"))


@query("b2_ensure_index", """
    SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS "index" FROM conversations""")
def _(t):
    return it.ensure_index(t.conversations.select("conv_id", "turn"), ["conv_id", "turn"])


@query("b2_index_as_number", """
    SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(TRY_CAST("index" AS BIGINT)) AS BIGINT) AS numeric_n,
           CAST(sum(TRY_CAST("index" AS BIGINT)) AS BIGINT) AS total
    FROM (SELECT CASE WHEN "index" % 10 = 0 THEN 'q' || "index" ELSE CAST("index" AS VARCHAR) END AS "index" FROM @items)""")
def _(t):
    mixed = t.items.select(F.when(F.col("index") % 10 == 0, F.concat(F.lit("q"), "index")).otherwise(F.col("index").cast("string")).alias("index"))
    return it.with_index_number(mixed).agg(
        F.count("*").alias("n"), F.count("index_num").alias("numeric_n"), F.sum("index_num").alias("total"))


@query("b3_normalise_columns", """
    SELECT "index" AS "index", question AS question, "A", "B", "C", "D", answer AS answer, category AS category,
           l2_category AS "l2_category", split AS split FROM @items""")
def _(t):
    shouted = t.items.select([F.col(c).alias(c.upper()) for c in t.items.columns])
    return it.normalise_columns(shouted)


@query("b4_open_to_choice", """
    SELECT "index", CASE WHEN "D" IS NULL THEN answer ELSE "A" END AS "A",
           CASE WHEN "D" IS NULL THEN 'Other Answers' ELSE "B" END AS "B",
           CASE WHEN "D" IS NULL THEN 'A' ELSE answer END AS answer
    FROM (SELECT "index", "A", "B", "D", CASE WHEN "D" IS NULL THEN question ELSE answer END AS answer FROM @items)""")
def _(t):
    open_rows = t.items.select(
        "index", F.when(F.col("D").isNotNull(), F.col("A")).alias("A"), F.when(F.col("D").isNotNull(), F.col("B")).alias("B"),
        F.when(F.col("D").isNull(), F.col("question")).otherwise(F.col("answer")).alias("answer"))
    return it.open_to_choice(open_rows)


@query("b5_strip_punctuation", digest_sql("doc_id", q.strip_punctuation("text"), "documents"))
def _(t):
    return digest(t.documents, "doc_id", tx.strip_punctuation(F.col("text")))


@query("b6_normalise_words", digest_sql("doc_id", q.normalise_words("text"), "documents"))
def _(t):
    return digest(t.documents, "doc_id", tx.normalise_words(F.col("text")))


@query("b7_normalise_answer", digest_sql(
    "item_id", q.normalise_words(q.strip_punctuation("trim(translate(text, chr(10) || chr(9), '  '), ' ')")), "benchmark"))
def _(t):
    return digest(t.benchmark, "item_id", tx.normalise_answer(F.col("text")))


@query("b8_clean_doc_string", digest_sql("doc_id", """
    trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(lower(text), ' '),
      '\\s*\\([^)]*\\)', '', 'g'), ' '), '^[''"]|[''"]$', '', 'g'), ' '), '^\\$+', ''), ' '), '%+$', ''), ' ')""", "documents"))
def _(t):
    return digest(t.documents, "doc_id", tx.clean_doc_string(F.col("text")))


@query("b9_ocr_tokens", """
    SELECT doc_id, CAST(len(tokens) AS INT) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM (
      SELECT doc_id, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(translate(text, chr(9) || chr(10), '  '),
        '###|\\*\\*\\*', '', 'g'), ' +', ' ', 'g'), ' ')), ' '), lambda w: w <> '') AS tokens FROM documents)""")
def _(t):
    tokens = tx.ocr_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query("b10_fullwidth_to_halfwidth", """
    SELECT "index", translate(wide, '（）ＡＢＣＤ：，！　', '()ABCD:,! ') AS narrow FROM (
      SELECT "index", '（' || translate(answer, 'ABCD', 'ＡＢＣＤ') || '）　：' || question || '，！' AS wide FROM @items)""")
def _(t):
    wide = F.concat(F.lit("（"), F.translate("answer", "ABCD", "ＡＢＣＤ"), F.lit("）　："), "question", F.lit("，！"))
    return t.items.select("index", tx.fullwidth_to_halfwidth(wide).alias("narrow"))


@query("b10_remove_spaces", """
    SELECT "index", '图中有' || split_part(question, ' ', 1) || ' ' || split_part(question, ' ', 2) || '苹果' AS tight FROM @items""")
def _(t):
    spaced = F.concat(F.lit("图 中 有 "), "question", F.lit(" 苹 果"))
    return t.items.select("index", tx.remove_spaces(spaced).alias("tight"))


@query("b11_clean_markdown", digest_sql("doc_id", """regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      text, '(?m)^```markdown\\n?', '', 'g'), '(?m)```\\n?$', '', 'g'), '_{4,}', '____', 'g'), ' {4,}', '    ', 'g')""", "documents"))
def _(t):
    return digest(t.documents, "doc_id", tx.clean_markdown(F.col("text")))


@query("b11_clean_string", digest_sql("doc_id", """
    regexp_replace(replace(replace(replace(replace(replace(replace(text, '\\t', ''), '\\n', ''), chr(9), ''), chr(10), ''), '/t', ''), '/n', ''),
      '[^a-zA-Z0-9_一-鿿]', '', 'g')""", "documents"))
def _(t):
    return digest(t.documents, "doc_id", tx.clean_string(F.col("text")))


@query("b12_has_cjk", """
    SELECT lang, CAST(count(*) FILTER (WHERE regexp_matches(text, '[一-鿿]')) AS BIGINT) AS with_cjk, count(*) AS n
    FROM documents GROUP BY lang""")
def _(t):
    return t.documents.groupBy("lang").agg(F.count_if(tx.has_cjk(F.col("text"))).alias("with_cjk"), F.count("*").alias("n"))


_LINES = """'A. ' || "A" || chr(10) || 'B. ' || "B" || chr(10) || 'C. ' || "C" || chr(10) || coalesce('D. ' || "D" || chr(10), '')"""


@query("b13_option_string", f"""SELECT "index", 'There are several options: ' || chr(10) || {_LINES} AS options FROM @items""")
def _(t):
    return t.items.select("index", tx.option_string(it.item_options()).alias("options"))


@query("b14_prompt_mcq", f"""
    SELECT "index", coalesce('Hint: ' || hint || chr(10), '') || 'Question: ' || question || chr(10) || 'Options:' || chr(10) || {_LINES}
      || 'Please select the correct answer from the options above. ' || chr(10) AS prompt
    FROM (SELECT *, CASE WHEN "index" % 2 = 0 THEN l2_category END AS hint FROM @items)""")
def _(t):
    hint = F.when(F.col("index") % 2 == 0, F.col("l2_category"))
    return t.items.select("index", tx.prompt_mcq(F.col("question"), it.item_options(), hint).alias("prompt"))


@query("b14_prompt_translation", """
    SELECT conv_id, turn, md5('Translate the question and the answer from English to French.' || chr(10)
      || 'Reply in two lines, ''Question: ...'' and ''Answer: ...''.' || chr(10)
      || 'Question: ' || ref || chr(10) || 'Answer: ' || hyp) AS digest FROM @pairs""")
def _(t):
    prompt = tx.prompt_translation(F.col("ref"), F.col("hyp"), "English", "French")
    return t.pairs.select("conv_id", "turn", F.md5(prompt).alias("digest"))


@query("b14_prompt_judge", """
    SELECT conv_id, turn, md5(CASE WHEN regexp_matches(ref, '[一-鿿]') THEN '问题：' || ref || chr(10) || '标准答案：' || hyp || chr(10) || '预测：' || hyp || chr(10) || '预测正确吗？请回答 yes 或 no。'
      ELSE 'Question: ' || ref || chr(10) || 'Ground truth: ' || hyp || chr(10) || 'Prediction: ' || hyp || chr(10) || 'Is the prediction right? Reply yes or no.' END) AS digest
    FROM @pairs""")
def _(t):
    prompt = tx.prompt_judge(F.col("ref"), F.col("hyp"), F.col("hyp"))
    return t.pairs.select("conv_id", "turn", F.md5(prompt).alias("digest"))


_EXAMPLES = {
    "en_single": [{"question": "How many cups?", "answer": "2", "prediction": "two cups", "correctness": "yes", "reason": "Two is 2."}],
    "en_multi": [{"question": "Which cups?", "answer": '["red", "blue"]', "prediction": "red", "correctness": "no", "reason": "Blue is missing."}],
    "cn_single": [{"question": "有几个杯子？", "answer": "2", "prediction": "两个", "correctness": "yes", "reason": "数目一致。"}],
}


def _judge_form(language, many):
    ask, given, said, _, _, rule, request = tx.JUDGE_LABELS[language]
    head = tx.judge_examples(_EXAMPLES.get(f"{language}_{'multi' if many else 'single'}", ()), language)
    tail = f"{rule}\n{request}" if many else request
    return f"{q.lit(head + ask)} || ref || {q.lit(chr(10) + given)} || truth || {q.lit(chr(10) + said)} || hyp || {q.lit(chr(10) + tail)}"


@query("b14_prompt_judge_forms", f"""
    SELECT conv_id, turn, many, md5(CASE WHEN regexp_matches(ref, '[一-鿿]') THEN CASE WHEN many THEN {_judge_form('cn', True)} ELSE {_judge_form('cn', False)} END
      WHEN many THEN {_judge_form('en', True)} ELSE {_judge_form('en', False)} END) AS digest
    FROM (SELECT *, turn % 4 = 0 AS many, CASE turn % 4 WHEN 3 THEN hyp WHEN 2 THEN hyp ELSE CAST(to_json([hyp, ref]) AS VARCHAR) END AS truth FROM @pairs)""")
def _(t):
    # two answers, two answers whose brackets stay, a list of one, a plain text
    place, ref, hyp = F.col("turn") % 4, F.col("ref"), F.col("hyp")
    written = F.when(place <= 1, F.to_json(F.array(hyp, ref))).when(place == 2, F.to_json(F.array(hyp))).otherwise(hyp)
    kind = F.when(place == 1, "exactMatch")
    prompt = tx.prompt_judge(ref, written, hyp, _EXAMPLES, kind)
    return t.pairs.select("conv_id", "turn", (F.size(tx.answer_list(written, kind)) > 1).alias("many"), F.md5(prompt).alias("digest"))


@query("b15_split_on_image_tags", """
    WITH tagged AS (SELECT conv_id, turn, replace(text, '. ', ' <image> ') AS text FROM conversations),
    sized AS (SELECT *, len(string_split(text, '<image>')) - 1 AS tags FROM tagged),
    placed AS (SELECT *, coalesce(sum(tags) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM sized),
    parts AS (SELECT conv_id, turn, base, unnest(string_split(text, '<image>')) AS part,
                     generate_subscripts(string_split(text, '<image>'), 1) - 1 AS segment FROM placed)
    SELECT conv_id, turn, CAST(segment AS INT) AS segment, CAST(CASE WHEN segment > 0 THEN base + segment - 1 END AS BIGINT) AS image,
           md5(trim(part, ' ')) AS digest FROM parts""")
def _(t):
    tagged = t.conversations.select("conv_id", "turn", F.replace("text", F.lit(". "), F.lit(" <image> ")).alias("text"))
    out = it.split_on_image_tags(tagged, "text", ["conv_id"], "turn")
    return out.select("conv_id", "turn", "segment", "image", F.md5(F.trim("part")).alias("digest"))


@query("b16_quality_filters", """
    SELECT CAST(count(*) FILTER (WHERE letters >= 3) AS BIGINT) AS letter_options,
           CAST(count(*) FILTER (WHERE bare) AS BIGINT) AS bare_letter_questions, count(*) AS n FROM (
      SELECT len(list_filter([answer, chr(CAST(65 + "index" % 30 AS INT)), CASE WHEN "index" % 2 = 0 THEN 'Both' ELSE "A" END, "B"],
                 lambda o: o IN ('{}', 'Both', 'None of above') OR length(o) <= 2)) AS letters,
             regexp_matches(question || ' ' || answer, '(^| )[A-Za-z]( |$)') AND "index" % 3 = 0 AS bare FROM @items)""")
def _(t):
    texts = F.array("answer", F.chr(65 + F.col("index") % 30), F.when(F.col("index") % 2 == 0, "Both").otherwise(F.col("A")), "B")
    question = F.when(F.col("index") % 3 == 0, F.concat_ws(" ", "question", "answer")).otherwise(F.col("question"))
    return t.items.agg(
        F.count_if(tx.mostly_letters(texts)).alias("letter_options"),
        F.count_if(tx.holds_bare_letter(question)).alias("bare_letter_questions"), F.count("*").alias("n"))


@query("b17_failed_rows", """
    SELECT model, CAST(count(*) FILTER (WHERE contains(prediction, 'Failed to obtain answer via API')) AS BIGINT) AS failed,
      CAST(count(*) FILTER (WHERE contains(prediction, 'I can''t') OR contains(prediction, 'I cannot') OR contains(lower(prediction), 'sorry')
        OR contains(prediction, '无法') OR contains(prediction, '抱歉')) AS BIGINT) AS refused, count(*) AS n
    FROM (SELECT model, CASE WHEN prediction = '' THEN 'Sorry, I cannot' ELSE prediction END AS prediction FROM @preds) GROUP BY model""")
def _(t):
    said = F.when(F.col("prediction") == "", "Sorry, I cannot").otherwise(F.col("prediction"))
    return t.preds.withColumn("prediction", said).groupBy("model").agg(
        F.count_if(tx.is_failure(F.col("prediction"))).alias("failed"),
        F.count_if(tx.is_refusal(F.col("prediction"))).alias("refused"), F.count("*").alias("n"))


@query("b18_valid_criteria", """
    SELECT split, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS valid, count(*) AS n FROM (
      SELECT split, regexp_matches("A", '[a-zA-Z]') AND
        (CASE WHEN "index" % 7 = 0 THEN '' WHEN "index" % 11 = 0 THEN '\\' WHEN "index" % 13 = 0 THEN '123' ELSE question END) NOT IN ('', '\\', '123') AS ok
      FROM @items) GROUP BY split""")
def _(t):
    i = F.col("index")
    weak = F.when(i % 7 == 0, "").when(i % 11 == 0, "\\").when(i % 13 == 0, "123").otherwise(F.col("question"))
    rubric = F.create_map(F.lit("style"), F.col("A"), F.lit("content"), weak)
    return t.items.groupBy("split").agg(F.count_if(tx.valid_criteria(rubric)).alias("valid"), F.count("*").alias("n"))
