"""Queries over answer extraction (C): each reply text, what was read from it, how often."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import extract as ex
from scoreloom.functions import fixed
from scoreloom.operators import items as it
from scoreloom.operators import reports as rp
from scoreloom.plans import sqltext as q
from scoreloom.plans.catalog import query


def tally(df, reply: str, **values):
    """Distinct replies with their extracted values and counts."""
    return df.select(F.col(reply).alias("reply"), *[v.alias(k) for k, v in values.items()]).groupBy(
        "reply", *values).agg(F.count("*").alias("n"))


def tally_sql(view: str, reply: str, **values: str) -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return f"SELECT {reply} AS reply, {cols}, count(*) AS n FROM {view} GROUP BY ALL"


def with_items(t):
    return t.preds.join(t.items, "index").withColumn("options", it.item_options())


_JOINED = '(SELECT p.prediction, i.* FROM @preds p JOIN @items i ON p."index" = i."index")'


def infer_sql(value: str) -> str:
    return f"""SELECT l2_category, value, count(*) AS n FROM (SELECT l2_category, {value} AS value FROM {_JOINED}) GROUP BY ALL"""


def infer_plan(t, fn):
    return with_items(t).select("l2_category", fn(F.col("prediction"), F.col("options")).alias("value")).groupBy(
        "l2_category", "value").agg(F.count("*").alias("n"))


@query("c1_infer_option", infer_sql(q.infer_option("prediction", q.options())))
def _(t):
    return infer_plan(t, ex.infer_option)


@query("c2_infer_text", infer_sql(q.infer_text("prediction")))
def _(t):
    return infer_plan(t, ex.infer_text)


@query("c3_infer", infer_sql(q.infer("prediction")))
def _(t):
    return infer_plan(t, ex.infer)


_UP = "upper(sequence)"
_WORD = q.found(_UP, r"\b([A-D]{4})\b")
_NAMED = "[" + ", ".join(q.found(_UP, f"(?:{p}).*?([A-D])") for p in ex.ORDINALS) + "]"
_STEPS = f"{q.found_all(_UP, ex.NUMBERED_STEP)}[1:4]"


@query("c4_infer_sequence", tally_sql("@notes", "sequence", value=f"""coalesce(
    CASE WHEN len(list_distinct(string_split({_WORD}, ''))) = 4 THEN {_WORD} END,
    CASE WHEN len(list_distinct({_NAMED})) = 4 THEN array_to_string({_NAMED}, '') END,
    CASE WHEN len(list_distinct({_STEPS})) = 4 THEN array_to_string({_STEPS}, '') END)"""))
def _(t):
    return tally(t.notes, "sequence", value=ex.infer_sequence(F.col("sequence")))


_CASCADE = "coalesce(" + ", ".join(
    f"upper({q.found('prediction', p)})" for p in ex.CHOICE_PATTERNS) + ", 'INVALID')"


@query("c5_extract_choice_cascade", tally_sql("@preds", "prediction", value=_CASCADE))
def _(t):
    return tally(t.preds, "prediction", value=ex.extract_choice_cascade(F.col("prediction")))


def _prefixes(s):
    for p in fixed.ANSWER_PREFIXES:
        s = f"replace({s}, {q.lit(p)}, '')"
    return s


@query("c6_extract_letter", f"""
    SELECT prediction AS reply, CASE WHEN regexp_matches(s, '[ABCDE]') THEN regexp_extract(s, '[ABCDE]', 0)
             WHEN len({q.words('s')}) > 10 THEN ''
             WHEN contains('(a)', lower(s)) THEN 'A' WHEN contains('(b)', lower(s)) THEN 'B' WHEN contains('(c)', lower(s)) THEN 'C'
             WHEN contains('(d)', lower(s)) THEN 'D' WHEN contains('(e)', lower(s)) THEN 'E' ELSE '' END AS value, count(*) AS n
    FROM (SELECT prediction, {_prefixes("trim(prediction)")} AS s FROM @preds) GROUP BY ALL""")
def _(t):
    return tally(t.preds, "prediction", value=ex.extract_letter(F.col("prediction")))


@query("c7_extract_cot_answer", """
    SELECT cot AS reply, CASE WHEN len(cands) <> 1 THEN cot WHEN len(list_distinct(regexp_extract_all(cands[1], '[A-Z]'))) = 1 THEN 'A'
             ELSE substr(cands[1], 8) END AS value, count(*) AS n
    FROM (SELECT cot, list_filter(string_split(cot, chr(10)), lambda x: starts_with(x, 'Answer:')) AS cands FROM @notes) GROUP BY ALL""")
def _(t):
    return tally(t.notes, "cot", value=ex.extract_cot_answer(F.col("cot")))


@query("c8_extract_final_answer", tally_sql(
    "@preds", "prediction", value="trim(CASE WHEN contains(prediction, 'FINAL ANSWER:') THEN string_split(prediction, 'FINAL ANSWER:')[-1] ELSE prediction END)"))
def _(t):
    return tally(t.preds, "prediction", value=ex.extract_final_answer(F.col("prediction")))


_TAIL = "string_split(string_split(trim(string_split(lower(prediction), {p})[-1]), chr(10))[1], '.')[1]"
_PHRASE = ", ".join(
    f"CASE WHEN contains(lower(prediction), {q.lit(p)}) THEN {q.found('upper(' + _TAIL.format(p=q.lit(p)) + ')', '^([ABCD])$')} END"
    for p in fixed.ANSWER_PHRASES)


@query("c9_extract_boxed_or_phrase", f"""
    SELECT prediction AS reply, coalesce(boxed, lang, 'Z') AS answer,
           CASE WHEN boxed IS NOT NULL THEN 'box' WHEN lang IS NOT NULL THEN 'lang' ELSE 'error' END AS how, count(*) AS n
    FROM (SELECT prediction, {q.found('prediction', r'\\boxed\{([ABCD])\}')} AS boxed,
            coalesce({q.found('prediction', r' \(?([ABCD])\)?\.$')}, {_PHRASE}, {q.found('prediction', '^([ABCD])$')}) AS lang FROM @preds)
    GROUP BY ALL""")
def _(t):
    both = ex.extract_boxed_or_phrase(F.col("prediction"))
    return tally(t.preds, "prediction", answer=both["answer"], how=both["how"])


_YN = q.words(q.strip_punctuation("lower(yesno)"))


@query("c10_extract_yes_no", tally_sql("@notes", "yesno", value=f"""
    CASE WHEN list_contains({_YN}, 'yes') AND NOT list_contains({_YN}, 'no') THEN 'Yes'
         WHEN list_contains({_YN}, 'no') AND NOT list_contains({_YN}, 'yes') THEN 'No' ELSE 'Unknown' END"""))
def _(t):
    return tally(t.notes, "yesno", value=ex.extract_yes_no(F.col("yesno")))


_TF = "regexp_extract_all(lower(tf), '\\b(true|false|t|f)\\b', 1)"


@query("c11_extract_true_false", tally_sql(
    "@notes", "tf", value=f"CASE WHEN len({_TF}) = 1 THEN upper(substr({_TF}[1], 1, 1)) END",
    error=f"CASE WHEN len({_TF}) > 1 THEN 'multiple_answers_found' WHEN len({_TF}) = 0 THEN 'no_answer_found' END"))
def _(t):
    both = ex.extract_true_false(F.col("tf"))
    return tally(t.notes, "tf", value=both["value"], error=both["error"])


@query("c11_extract_yes_no_prefix", tally_sql("@notes", "yesno", value="""
    CASE WHEN starts_with(lower(yesno), 'yes') THEN 'yes' WHEN starts_with(lower(yesno), 'no') THEN 'no' END"""))
def _(t):
    return tally(t.notes, "yesno", value=ex.extract_yes_no_prefix(F.col("yesno")))


def _binary(yes, no):
    hit = f"lower(regexp_extract(yesno, '(?i)\\b({yes}|{no})\\b', 1))"
    return f"CASE {hit} WHEN '{yes}' THEN 1 WHEN '{no}' THEN 0 ELSE -1 END"


@query("c12_extract_binary", tally_sql(
    "@notes", "yesno", kind="kind", value=f"CASE WHEN kind = 'yes_no' THEN {_binary('yes', 'no')} ELSE {_binary('a', 'b')} END"))
def _(t):
    return tally(t.notes, "yesno", kind=F.col("kind"), value=ex.extract_binary(F.col("yesno"), F.col("kind")))


@query("c13_rule_mcq", tally_sql("@notes", "choice", truth="choice_truth", value="""
    CASE WHEN choice = choice_truth THEN '1' WHEN choice IN ('A','B','C','D') OR substr(choice, 1, 2) IN ('A.','B.','C.','D.','A)','B)','C)','D)')
         THEN CASE WHEN substr(choice, 1, 1) = substr(choice_truth, 1, 1) THEN '1' ELSE '0' END ELSE 'fail' END"""))
def _(t):
    return tally(t.notes, "choice", truth=F.col("choice_truth"), value=ex.rule_mcq(F.col("choice"), F.col("choice_truth")))


@query("c13_rule_caption", tally_sql("@notes", "caption", truth="caption_truth", value="""
    CASE caption WHEN 'something else' THEN 'fail' ELSE CASE WHEN (caption IN ('Sentence A', 'a dog runs')) = starts_with(caption_truth, 'Sentence A')
         THEN '1' ELSE '0' END END"""))
def _(t):
    candidates = F.array(F.lit("Sentence A: a dog runs"), F.lit("Sentence B: a cat sits"))
    return tally(t.notes, "caption", truth=F.col("caption_truth"),
                 value=ex.rule_caption(F.col("caption"), F.col("caption_truth"), candidates))


_FIRST = "(contains(split_part(lower(trim(choice_truth)), ' ', 1), replace(split_part(lower(trim(choice)), ' ', 1), '.', '')) OR contains(split_part(lower(trim(choice)), ' ', 1), split_part(lower(trim(choice_truth)), ' ', 1)))"
_CONTENT = "trim(lower(regexp_replace(trim(choice_truth), '^\\S+ ?', '')), '. ' || chr(10))"


@query("c14_match_first_token", tally_sql(
    "@notes", "choice", truth="choice_truth", plain=_FIRST,
    advanced=f"{_FIRST} OR contains(trim(lower(choice), '. ' || chr(10)), CASE {_CONTENT} WHEN '2' THEN 'two' ELSE {_CONTENT} END)"))
def _(t):
    a, b = F.col("choice"), F.col("choice_truth")
    return tally(t.notes, "choice", truth=b, plain=ex.match_first_token(a, b), advanced=ex.match_first_token_or_text(a, b))


_PADDED = f"(' ' || trim(prediction, {q.lit(",.!?;:'")}) || ' ')"


def _latest(hay, needle):
    """Label of the option whose needle stands last; the first label of several in one place."""
    spot = lambda c: f"strpos(reverse({hay}), reverse({needle(c)}))"
    each = ", ".join(f"""CASE WHEN "{c}" IS NOT NULL AND {spot(c)} > 0 THEN {{'gap': {spot(c)}, 'label': '{c}'}} END""" for c in "ABCD")
    return f"list_sort(list_filter([{each}], lambda e: e IS NOT NULL))[1].label"


_DOTTED = "CASE " + " ".join(f"""WHEN "{c}" IS NOT NULL AND contains({_PADDED}, '{c}. ') THEN '{c}'""" for c in "ABCD") + " END"
_BY_LABEL = [_latest(_PADDED, lambda c: f"'({c})'"), _DOTTED, _latest(_PADDED, lambda c: f"' {c} '")]
_BY_TEXT = f"CASE WHEN len({q.words(_PADDED)}) > 5 THEN " + _latest(f"lower({_PADDED})", lambda c: f'lower("{c}")') + " END"


@query("c15_parse_choice_multi", infer_sql(f"coalesce({', '.join([*_BY_LABEL, _BY_TEXT])})"))
def _(t):
    return infer_plan(t, ex.parse_choice_multi)


@query("c16_extract_numbers", tally_sql("@notes", "count_text", numbers="""
    CASE WHEN regexp_matches(count_text, '[0-9]') THEN regexp_extract(count_text, '[0-9]+', 0) || CASE WHEN contains(count_text, 'four') THEN ',4' ELSE '' END
         WHEN contains(count_text, 'hundred') THEN '205' WHEN contains(count_text, 'twenty') THEN '20' WHEN contains(count_text, 'Seven') THEN '7' ELSE '' END""",
    first=f"""coalesce(TRY_CAST({q.found('lower(count_text)', r'\b([0-9]|1[0-9]|20)\b')} AS INT),
      CASE {q.found('lower(count_text)', r'\b(two|five|seven|twenty)\b')} WHEN 'two' THEN 2 WHEN 'five' THEN 5 WHEN 'seven' THEN 7 WHEN 'twenty' THEN 20 END)"""))
def _(t):
    s = F.col("count_text")
    return tally(t.notes, "count_text", numbers=F.array_join(ex.extract_numbers(s), ","), first=ex.first_count(s))


def _unit(s):
    return q.mapped(s, fixed.UNIT_CM, "0e0")


_SCALARS = f"list_transform(regexp_extract_all(regexp_extract(scalar_text, 'scalar\\{{([^}}]*)\\}}', 1), '[0-9]+\\.?[0-9]*'), lambda x: CAST(x AS DOUBLE))"


@query("c17_parse_quantity_with_unit", tally_sql("@notes", "scalar_text", text="quantity",
    scalar_cm=f"round(list_sum({_SCALARS}) / len({_SCALARS}) * {_unit(q.found('lower(scalar_text)', 'distance_unit[{]([^}]*)[}]'))}, 6)",
    quantity_cm=f"""round(coalesce(CASE WHEN contains(quantity, '-') THEN (CAST({q.found('quantity', r'^\(([0-9]+)-')} AS DOUBLE) + CAST({q.found('quantity', '-([0-9]+),')} AS DOUBLE)) / 2e0
        ELSE CAST({q.found('quantity', r'^\(([0-9.]+),')} AS DOUBLE) END * {_unit(q.found('quantity', r', (.+)\)'))}, 0e0), 6)"""))
def _(t):
    return tally(t.notes, "scalar_text", text=F.col("quantity"),
                 scalar_cm=F.round(ex.parse_scalar_unit(F.col("scalar_text")), 6),
                 quantity_cm=F.round(ex.parse_quantity(F.col("quantity")), 6))


_RC = f"""CASE WHEN regexp_matches(braces, '[Rr]ows?[^{{}}]*[{{][0-9]+[}}]') AND regexp_matches(braces, '[Cc]olumns?[^{{}}]*[{{][0-9]+[}}]')
  THEN regexp_extract(braces, '[Rr]ows?[^{{}}]*[{{]([0-9]+)[}}]', 1) || ',' || regexp_extract(braces, '[Cc]olumns?[^{{}}]*[{{]([0-9]+)[}}]', 1)
  WHEN regexp_matches(braces, '[(][0-9]+,\\s*[0-9]+[)]') THEN regexp_replace(regexp_extract(braces, '[(]([0-9]+,\\s*[0-9]+)[)]', 1), '\\s', '', 'g') END"""


@query("c18_parse_braces", tally_sql("@notes", "braces", first="regexp_extract(braces, '[{](.*?)[}]', 1)",
                                     last="regexp_extract_all(braces, '[{](.*?)[}]', 1)[-1]", grid=_RC))
def _(t):
    s = F.col("braces")
    return tally(t.notes, "braces", first=ex.first_braces(s), last=ex.last_braces(s), grid=ex.rows_columns(s))


_RESULT = q.found("fenced", r'(?s)```json\s*\{"result": "?([A-Za-z]+)"?\}\s*```')
_LETTERS = q.found_all("fenced", r"\b([A-H])\b")
_TRUTH = "chr(CAST(65 + \"index\" % 5 AS INT))"


@query("c19_parse_fenced_json", f"""
    SELECT fenced AS reply, {_TRUTH} AS truth, {_RESULT} AS result,
      CASE WHEN {_RESULT} IS NOT NULL THEN CAST({_RESULT} = {_TRUTH} AS INT) WHEN len({_LETTERS}) > 0 THEN CAST(list_contains({_LETTERS}, {_TRUTH}) AS INT) ELSE -1 END AS value,
      count(*) AS n FROM @notes GROUP BY ALL""")
def _(t):
    s, truth = F.col("fenced"), F.chr(65 + F.col("index") % 5)
    return tally(t.notes, "fenced", truth=truth, result=ex.fenced_json_result(s), value=ex.choice_from_fenced(s, truth))


@query("c19_number_pairs", tally_sql("@notes", "fenced", total="""
    CAST(floor(len(regexp_extract_all(fenced, '(-?[0-9]+\\.?[0-9]*)', 1)) / 2) AS INT)""",
    first="CASE WHEN len(regexp_extract_all(fenced, '(-?[0-9]+\\.?[0-9]*)', 1)) >= 2 THEN CAST(regexp_extract_all(fenced, '(-?[0-9]+\\.?[0-9]*)', 1)[2] AS DOUBLE) END"))
def _(t):
    pairs = ex.number_pairs(F.col("fenced"))
    return tally(t.notes, "fenced", total=F.size(pairs), first=F.get(pairs, F.lit(0))["end"])


@query("c20_parse_score_json", tally_sql("@notes", "judge_json",
    pred=f"CASE WHEN contains(judge_json, 'score') THEN {q.found('lower(judge_json)', 'pred.: .(yes|no)')} END",
    score=f"CASE WHEN contains(judge_json, 'pred') AND contains(judge_json, 'score') THEN CAST({q.found('judge_json', 'score.: ([0-9.]+)')} AS DOUBLE) ELSE -1e0 END"))
def _(t):
    both = ex.parse_score_json(F.col("judge_json"))
    return tally(t.notes, "judge_json", pred=both["pred"], score=both["score"])


def _pair(i):
    parts = "regexp_split_to_array(replace(split_part(score_pair, chr(10), 1), ',', ' '), ' ')"
    ok = f"len({parts}) = 2 AND TRY_CAST({parts}[1] AS DOUBLE) IS NOT NULL AND TRY_CAST({parts}[2] AS DOUBLE) IS NOT NULL"
    return f"CASE WHEN {ok} THEN TRY_CAST({parts}[{i}] AS DOUBLE) ELSE -1e0 END"


@query("c21_parse_score_pair", tally_sql("@notes", "score_pair", first=_pair(1), second=_pair(2)))
def _(t):
    both = ex.parse_score_pair(F.col("score_pair"))
    return tally(t.notes, "score_pair", first=both["first"], second=both["second"])


def _part(i):
    head = "split_part(components, '.', 1)"
    return (f"round(CAST(regexp_extract_all({head}, '([0-9]+)/([0-9]+)', 1)[{i}] AS DOUBLE) / CAST(regexp_extract_all({head}, '([0-9]+)/([0-9]+)', 2)[{i}] AS DOUBLE), 6)")


@query("c22_parse_component_scores", tally_sql("@notes", "components", clarity=_part(1), detail=_part(2), total=_part(3)))
def _(t):
    parts = ex.parse_component_scores(F.col("components"))
    return tally(t.notes, "components", clarity=F.round(F.get(parts, F.lit(0)), 6), detail=F.round(F.get(parts, F.lit(1)), 6),
                 total=F.round(F.get(parts, F.lit(2)), 6))


_BRACKETED = r"\[\[" + ex.VERDICT + r"\]\]"
_V = f"list_distinct({q.found_all('verdict_text', _BRACKETED)})"
_MARKED = q.found("replace(upper(verdict_text), ' ', '')", _BRACKETED)


@query("c23_parse_verdict", tally_sql(
    "@notes", "verdict_text", verdict=f"CASE WHEN len({_V}) = 1 THEN {_V}[1] END",
    marked=f"CASE WHEN contains(upper(verdict_text), 'FINAL VERDICT IS:') THEN {_MARKED} END"))
def _(t):
    s = F.col("verdict_text")
    return tally(t.notes, "verdict_text", verdict=ex.parse_verdict(s), marked=ex.parse_verdict(s, "FINAL VERDICT IS:"))


# The labels of the three ratings.
RATINGS = {
    "reality": r"Reality Assessment Score:\s*([\d.]+)",
    "aesthetics": r"Aesthetics Rating:\s*([\d.]+)",
    "consistency": r"Instruction Consistency Rating:\s*([\d.]+)",
}
_ALL = " AND ".join(f"regexp_matches(ratings, {q.lit('(?i)' + p)})" for p in RATINGS.values())


@query("c24_parse_named_scores", tally_sql("@notes", "ratings", **{
    k: f"CASE WHEN {_ALL} THEN CAST({q.found('ratings', '(?i)' + p)} AS DOUBLE) END" for k, p in RATINGS.items()}))
def _(t):
    scores = ex.parse_named_scores(F.col("ratings"), RATINGS)
    return tally(t.notes, "ratings", **{k: scores[k] for k in RATINGS})


def _ab(side):
    score = q.found("upper(replace(ab_scores, '*', ''))", rf"RESPONSE {side} VISUAL FACTUALITY SCORE:\s*([0-9.]+)")
    return f"TRY_CAST({score} AS DOUBLE)"


@query("c24_parse_ab_scores", tally_sql("@notes", "ab_scores", value=f"""
    CASE WHEN ab_scores = '' THEN 'NO_OBJECTIVE' WHEN {_ab('A')} BETWEEN 0 AND 10 AND {_ab('B')} BETWEEN 0 AND 10
         THEN CAST({_ab('A')} AS VARCHAR) || '|' || CAST({_ab('B')} AS VARCHAR) END"""))
def _(t):
    labels = ("Response A Visual Factuality Score:", "Response B Visual Factuality Score:")
    return tally(t.notes, "ab_scores", value=ex.parse_ab_scores(F.col("ab_scores"), *labels))


@query("c25_parse_qa_output", tally_sql("@notes", "qa_text",
    question="trim(regexp_replace(CASE WHEN regexp_matches(qa_text, '(?i)question:') THEN regexp_extract(qa_text, '(?is)question:\\s*(.+)', 1) ELSE '' END, '(?is)\\nanswer:.*', ''))",
    answer="trim(regexp_extract(qa_text, '(?is)answer:\\s*(.+)', 1))"))
def _(t):
    both = ex.parse_qa_output(F.col("qa_text"))
    return tally(t.notes, "qa_text", question=both["question"], answer=both["answer"])


@query("c26_parse_bbox", """
    SELECT data_type, round(sum(px1), 4) AS x1, round(sum(py1), 4) AS y1, round(sum(px2), 4) AS x2, round(sum(py2), 4) AS y2,
           count(px1) AS parsed, count(*) AS n FROM @boxes GROUP BY data_type""")
def _(t):
    box = ex.parse_bbox(F.col("prediction"))
    return t.boxes.select("data_type", box.alias("b")).groupBy("data_type").agg(
        *[F.round(F.sum(f"b.{c}"), 4).alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.count("b.x1").alias("parsed"), F.count("*").alias("n"))


@query("c27_parse_answer_line", tally_sql("@notes", "answer_line",
    line="trim(CASE WHEN regexp_matches(answer_line, '\\*\\*Answer:') THEN regexp_extract(answer_line, '\\*\\*Answer:\\s*([^*]*)', 1) WHEN contains(answer_line, 'Answer:') THEN regexp_extract(answer_line, 'Answer:\\s*(.*)', 1) ELSE answer_line END)",
    tag="regexp_extract(answer_line, '<ans>(.*)</ans>', 1)",
    code="CASE WHEN contains(answer_line, '```') THEN trim(regexp_extract(answer_line, '(?s)```[a-z]*\\s*(.*?)\\s*```', 1)) ELSE answer_line END"))
def _(t):
    s = F.col("answer_line")
    return tally(t.notes, "answer_line", line=ex.parse_answer_line(s), tag=ex.parse_tag(s, "ans"), code=ex.parse_code_block(s))


@query("c28_parse_fields_json", tally_sql("@notes", "field_json",
    colour="CASE WHEN starts_with(field_json, '{') THEN json_extract_string(TRY_CAST(field_json AS JSON), '$.colour') ELSE field_json END",
    size="CASE WHEN starts_with(field_json, '{') THEN json_extract_string(TRY_CAST(field_json AS JSON), '$.size') ELSE field_json END"))
def _(t):
    got = ex.parse_fields(F.col("field_json"), F.array(F.lit("colour"), F.lit("size")))
    return tally(t.notes, "field_json", colour=F.try_element_at(got, F.lit("colour")), size=F.try_element_at(got, F.lit("size")))


@query("c29_extraction_coverage", f"""
    SELECT category, count(*) AS total, count(value) AS matched, count(*) - count(value) AS unmatched,
           round(count(value) * 100e0 / count(*), 6) AS rate
    FROM (SELECT category, {q.infer('prediction')} AS value FROM {_JOINED}) GROUP BY category""")
def _(t):
    found = with_items(t).select("category", ex.infer(F.col("prediction"), F.col("options")).alias("value"))
    return rp.extraction_coverage(found, "value", ["category"])


_TAG = "trim(regexp_extract(prediction, '(?s)<answer>\\s*(.*?)\\s*</answer>', 1))"
_HAS = "contains(prediction, '<answer>')"


@query("c30_extract_tagged_letter", tally_sql("@preds", "prediction", value="coalesce(" + ", ".join(
    [f"CASE WHEN {_HAS} AND regexp_matches({_TAG}, '{c}[ :]|\\[{c}') THEN '{c}' END" for c in "ABCDEF"]
    + [f"CASE WHEN {_HAS} AND contains({_TAG}, '{c}') THEN '{c}' END" for c in "ABCDEF"]) + ", 'WRONG')"))
def _(t):
    return tally(t.preds, "prediction", value=ex.extract_tagged_letter(F.col("prediction")))


@query("c31_extract_answer_phrase", tally_sql("@notes", "phrase",
    value="CASE WHEN contains(phrase, 'So the final answer is ') THEN trim(regexp_extract_all(phrase, 'So the final answer is (.*)', 1)[-1]) ELSE phrase END",
    boxed="array_to_string(regexp_extract_all(phrase, '\\\\boxed[{]([^{}]*)[}]', 1), ',')"))
def _(t):
    s = F.col("phrase")
    return tally(t.notes, "phrase", value=ex.extract_answer_phrase(s), boxed=F.array_join(ex.boxed_contents(s), ","))


_UP = "list_filter(['A','B','C','D','E'], lambda c: contains(upper(typed), c))"
_TYPED = f"""CASE typed_kind WHEN 'float' THEN CAST(TRY_CAST(split_part(typed, ' ', 1) AS DOUBLE) AS VARCHAR)
   WHEN 'multiple choice' THEN CASE WHEN length(typed) = 1 THEN upper(typed) WHEN len({_UP}) = 1 THEN {_UP}[1] END ELSE typed END"""


@query("c32_parse_by_answer_type", tally_sql("@notes", "typed", kind="typed_kind", ok=f"({_TYPED}) IS NOT NULL", value=_TYPED))
def _(t):
    both = ex.parse_by_type(F.col("typed"), F.col("typed_kind"))
    return tally(t.notes, "typed", kind=F.col("typed_kind"), ok=both["ok"], value=both["value"])
