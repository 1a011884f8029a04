"""Evaluation tables derived from the driver's parquet tables.

Each view is one SELECT that both Spark and DuckDB understand, built by arithmetic on the
stored columns only, so the two engines see identical inputs. ``SECS(ts)`` is whole seconds
since 2024-01-01, the only spot where the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # multiple-choice items; every fifth item has three options
    "items": """
        SELECT p_partkey AS "index", p_name AS question,
               p_brand AS "A", p_type AS "B", 'size ' || CAST(p_size AS STRING) AS "C",
               CASE WHEN p_partkey % 5 = 0 THEN NULL
                    ELSE 'price ' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) END AS "D",
               CASE WHEN p_partkey % 5 = 0 THEN chr(CAST(65 + p_partkey % 3 AS INT))
                    ELSE chr(CAST(65 + p_partkey % 4 AS INT)) END AS answer,
               p_brand AS category, p_type AS l2_category,
               CASE WHEN p_size % 2 = 0 THEN 'dev' ELSE 'test' END AS split
        FROM {part}""",
    # one reply per line item: model = supplier class, item = part
    "preds": """
        SELECT 'M' || CAST(l_suppkey % 8 AS STRING) AS model, l_partkey AS "index",
               l_orderkey AS run, l_linenumber AS line,
               CASE (l_orderkey * 7 + l_suppkey * 13 + l_linenumber) % 16
                 WHEN 0 THEN chr(CAST(65 + (l_orderkey + l_linenumber) % 4 AS INT))
                 WHEN 1 THEN 'The answer is (' || chr(CAST(65 + l_orderkey % 4 AS INT)) || ').'
                 WHEN 2 THEN 'It must be brand#' || CAST(1 + l_orderkey % 25 AS STRING) || ' here'
                 WHEN 3 THEN chr(CAST(65 + l_orderkey % 4 AS INT)) || ' or ' || chr(CAST(65 + l_suppkey % 4 AS INT))
                 WHEN 4 THEN 'Cannot determine the answer'
                 WHEN 5 THEN 'Failed to obtain answer via API.'
                 WHEN 6 THEN ''
                 WHEN 7 THEN 'Reasoning first. FINAL ANSWER: **' || chr(CAST(65 + l_orderkey % 5 AS INT)) || '**'
                 WHEN 8 THEN 'I pick **' || chr(CAST(65 + l_suppkey % 5 AS INT)) || '.** since it fits'
                 WHEN 9 THEN 'Answer: ' || chr(CAST(65 + l_linenumber % 4 AS INT))
                 WHEN 10 THEN chr(CAST(65 + l_linenumber % 4 AS INT)) || '. promo'
                 WHEN 11 THEN 'Best Option: (' || chr(CAST(65 + l_suppkey % 4 AS INT)) || ')'
                 WHEN 12 THEN 'so the final answer is \\boxed{{' || chr(CAST(65 + l_orderkey % 4 AS INT)) || '}}'
                 WHEN 13 THEN '<answer>' || chr(CAST(65 + l_orderkey % 6 AS INT)) || ': it is</answer>'
                 WHEN 14 THEN 'Z'
                 ELSE 'a large thing or a small thing'
               END AS prediction
        FROM {lineitem}""",
    # graded variants of a question: one row per (question, variant)
    "variants": """
        SELECT l_orderkey AS qid, l_linenumber AS varid,
               CASE WHEN min(l_partkey * 3 + l_suppkey) % 4 > 0 THEN 1 ELSE 0 END AS hit,
               'subject' || CAST(l_orderkey % 7 AS STRING) AS subject,
               'level' || CAST(l_orderkey % 3 AS STRING) AS level
        FROM {lineitem}
        GROUP BY l_orderkey, l_linenumber""",
    # scored rows with three levels of labels; score -1 marks an unscorable row
    "scored": """
        SELECT 'M' || CAST(l_suppkey % 8 AS STRING) AS model, l_partkey AS "index",
               CASE WHEN (l_orderkey + l_partkey) % 3 = 0 THEN 1 ELSE 0 END AS hit,
               CASE WHEN l_orderkey % 11 = 0 THEN -1 ELSE CAST(l_quantity AS INT) % 6 END AS score,
               CASE WHEN l_linenumber % 2 = 0 THEN 'dev' ELSE 'test' END AS split,
               'task' || CAST(l_partkey % 3 AS STRING) AS task,
               'sub' || CAST(l_partkey % 9 AS STRING) AS subtask,
               'cat' || CAST(l_partkey % 27 AS STRING) AS category,
               l_quantity AS amount, l_linenumber AS line, l_orderkey AS run
        FROM {lineitem}""",
    # yes/no judgements over labelled documents
    "yn": """
        SELECT d.doc_id AS "index", CASE WHEN l.quality = 1 THEN 'Yes' ELSE 'No' END AS answer,
               CASE WHEN l.toxic = 1 THEN 'Yes' WHEN d.doc_id % 9 = 0 THEN 'Unknown'
                    WHEN d.n_chars % 2 = 0 THEN 'Yes' ELSE 'No' END AS extracted,
               d.lang || ',' || d.source AS category, d.lang AS l2_category,
               d.source AS source, d.n_chars AS n_chars
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    # a turn and the turn that answers it
    "pairs": """
        SELECT a.conv_id AS conv_id, a.turn AS turn, a.text AS ref, b.text AS hyp
        FROM {conversations} a JOIN {conversations} b
          ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    # timed spans of a key, whole seconds
    "spans": """
        SELECT event_id, user_id AS video, event_type AS kind,
               SECS(ts) AS start_s, SECS(ts) + 1 + CAST(floor(value * 40) AS BIGINT) AS end_s
        FROM {events}""",
    # box answers: prediction text and a target box
    "boxes": """
        SELECT l_orderkey AS oid, l_linenumber AS line, l_partkey AS pid,
               CASE WHEN l_orderkey % 13 = 0 THEN 'no box'
                    WHEN l_orderkey % 17 = 0 THEN '[0.1, 0.2, 0.3, 0.4] or [0.5, 0.6, 0.7, 0.8]'
                    ELSE 'box [' || CAST(l_partkey % 60 / 100e0 AS STRING) || ', ' || CAST(l_suppkey % 50 / 100e0 AS STRING)
                      || ', ' || CAST((l_partkey % 60 + 30) / 100e0 AS STRING) || ', ' || CAST((l_suppkey % 50 + 40) / 100e0 AS STRING) || ']'
               END AS prediction,
               CASE WHEN l_orderkey % 13 = 0 OR l_orderkey % 17 = 0 THEN NULL ELSE l_partkey % 60 / 100e0 END AS px1,
               CASE WHEN l_orderkey % 13 = 0 OR l_orderkey % 17 = 0 THEN NULL ELSE l_suppkey % 50 / 100e0 END AS py1,
               CASE WHEN l_orderkey % 13 = 0 OR l_orderkey % 17 = 0 THEN NULL ELSE (l_partkey % 60 + 30) / 100e0 END AS px2,
               CASE WHEN l_orderkey % 13 = 0 OR l_orderkey % 17 = 0 THEN NULL ELSE (l_suppkey % 50 + 40) / 100e0 END AS py2,
               l_orderkey % 50 / 100e0 AS gx1, l_linenumber * 5 / 100e0 AS gy1,
               (l_orderkey % 50 + 40) / 100e0 AS gx2, (l_linenumber * 5 + 50) / 100e0 AS gy2,
               CASE WHEN l_returnflag = 'N' THEN 'text' ELSE 'icon' END AS data_type,
               l_linestatus AS category
        FROM {lineitem}""",
    # pairwise verdicts
    "verdicts": """
        SELECT o_orderkey AS "index", o_orderkey % 2 AS rev,
               CASE (o_custkey + o_orderkey) % 7 WHEN 0 THEN 'A>>B' WHEN 1 THEN 'A>B' WHEN 2 THEN 'A=B'
                    WHEN 3 THEN 'B>A' WHEN 4 THEN 'A<B' WHEN 5 THEN 'A<<B' ELSE 'unclear' END AS verdict,
               o_orderstatus AS type, o_orderpriority AS task
        FROM {orders}""",
    # finished evaluation runs
    "runs": """
        SELECT 'M' || CAST(o_custkey % 6 AS STRING) AS model,
               'T' || replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') || '_G' || CAST(o_orderkey % 4 AS STRING) AS eval_id,
               'D' || CAST(o_orderkey % 9 AS STRING) AS dataset,
               o_orderkey AS file_no, o_totalprice AS value, o_orderstatus AS status
        FROM {orders}""",
    # reply texts in the formats the extractors read, by arithmetic on the order key
    "notes": r"""
        SELECT o_orderkey AS "index", o_orderpriority AS task, o_orderstatus AS type,
          CASE o_orderkey % 4 WHEN 0 THEN 'order ' || substr('ABCDDCBABADCACBDAABC', CAST(1 + o_orderkey % 17 AS INT), 4) || ' it is'
               WHEN 1 THEN 'first ' || chr(CAST(65 + o_orderkey % 4 AS INT)) || ', second ' || chr(CAST(65 + (o_orderkey + 1) % 4 AS INT))
                    || ', third ' || chr(CAST(65 + (o_orderkey + 2) % 4 AS INT)) || ', fourth ' || chr(CAST(65 + (o_orderkey + o_custkey) % 4 AS INT))
               WHEN 2 THEN 'step 1: B step 2: A step 3: D step 4: ' || chr(CAST(65 + o_custkey % 4 AS INT))
               ELSE 'no idea' END AS sequence,
          CASE o_orderkey % 3 WHEN 0 THEN 'thinking' || chr(10) || 'Answer: ' || chr(CAST(65 + o_custkey % 4 AS INT))
               WHEN 1 THEN 'Answer: a red box' || chr(10) || 'done' ELSE 'Answer: A' || chr(10) || 'Answer: B' END AS cot,
          CASE o_orderkey % 5 WHEN 0 THEN 'Yes, it is.' WHEN 1 THEN 'No - never' WHEN 2 THEN 'not sure: yes or no?'
               WHEN 3 THEN 'maybe (yes)' ELSE 'A is right, B is no' END AS yesno,
          CASE o_orderkey % 5 WHEN 0 THEN 'It is True' WHEN 1 THEN 'f' WHEN 2 THEN 'true or false' WHEN 3 THEN 'T.' ELSE 'neither' END AS tf,
          CASE WHEN o_custkey % 2 = 0 THEN 'yes_no' ELSE 'multiple_choice' END AS kind,
          CASE o_orderkey % 6 WHEN 0 THEN chr(CAST(65 + o_custkey % 4 AS INT)) WHEN 1 THEN chr(CAST(65 + o_custkey % 4 AS INT)) || '. red'
               WHEN 2 THEN chr(CAST(65 + o_custkey % 4 AS INT)) || ') red' WHEN 3 THEN 'B. two.' WHEN 4 THEN 'the answer is two' ELSE 'b' END AS choice,
          CASE o_custkey % 3 WHEN 0 THEN 'A. red' WHEN 1 THEN 'B. two.' ELSE 'C. 2.' END AS choice_truth,
          CASE o_orderkey % 6 WHEN 0 THEN 'Sentence A' WHEN 1 THEN 'B' WHEN 2 THEN 'a dog runs' WHEN 3 THEN 'Sentence B: a cat sits'
               WHEN 4 THEN '1) a cat sits' ELSE 'something else' END AS caption,
          CASE WHEN o_custkey % 2 = 0 THEN 'Sentence A: a dog runs' ELSE 'Sentence B: a cat sits' END AS caption_truth,
          CASE o_orderkey % 6 WHEN 0 THEN 'I see ' || CAST(o_custkey % 30 AS STRING) || ' cups' WHEN 1 THEN 'two hundred and five cups'
               WHEN 2 THEN 'there are twenty' WHEN 3 THEN '3 or four' WHEN 4 THEN 'Seven!' ELSE 'many' END AS count_text,
          CASE o_orderkey % 4 WHEN 0 THEN 'about scalar{{' || CAST(o_custkey % 9 AS STRING) || ' to ' || CAST(1 + o_custkey % 7 AS STRING) || '.5}} distance_unit{{ft}}'
               WHEN 1 THEN 'scalar{{12}} distance_unit{{Meters}}' WHEN 2 THEN 'scalar{{3}} distance_unit{{yards}}' ELSE 'scalar{{7.25}} distance_unit{{mm}}' END AS scalar_text,
          CASE o_orderkey % 4 WHEN 0 THEN '(' || CAST(o_custkey % 9 AS STRING) || '-' || CAST(o_custkey % 9 + 2 AS STRING) || ', cm)'
               WHEN 1 THEN '(2.5, inches)' WHEN 2 THEN 'two metres' ELSE '(4, foot)' END AS quantity,
          CASE o_orderkey % 4 WHEN 0 THEN 'Rows: {{' || CAST(o_custkey % 5 AS STRING) || '}} Columns: {{3}}' WHEN 1 THEN '(' || CAST(o_custkey % 5 AS STRING) || ', 3)'
               WHEN 2 THEN 'first {{x}} then {{y' || CAST(o_custkey % 3 AS STRING) || '}}' ELSE 'none' END AS braces,
          CASE o_orderkey % 4 WHEN 0 THEN 'see ```json' || chr(10) || '{{' || chr(34) || 'result' || chr(34) || ': ' || chr(CAST(65 + o_custkey % 8 AS INT)) || '}}' || chr(10) || '``` end'
               WHEN 1 THEN '```json {{' || chr(34) || 'result' || chr(34) || ': ' || chr(34) || 'C' || chr(34) || '}} ```'
               WHEN 2 THEN 'I think ' || chr(CAST(65 + o_custkey % 8 AS INT)) ELSE 'from 1.5 to ' || CAST(o_custkey % 50 AS STRING) || ', -3' END AS fenced,
          CASE o_orderkey % 4 WHEN 0 THEN '{{' || chr(39) || 'pred' || chr(39) || ': ' || chr(39) || 'yes' || chr(39) || ', ' || chr(39) || 'score' || chr(39) || ': ' || CAST(o_custkey % 6 AS STRING) || '}}'
               WHEN 1 THEN '{{' || chr(34) || 'pred' || chr(34) || ': ' || chr(34) || 'No' || chr(34) || ', ' || chr(34) || 'score' || chr(34) || ': 2.5}}'
               WHEN 2 THEN 'score 4' ELSE '{{' || chr(34) || 'pred' || chr(34) || ': ' || chr(34) || 'yes' || chr(34) || '}}' END AS judge_json,
          CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 10 AS STRING) || ' ' || CAST(o_custkey % 7 AS STRING) || '.5' || chr(10) || 'because'
               WHEN 1 THEN CAST(o_custkey % 10 AS STRING) || ',3' WHEN 2 THEN '8, 9' ELSE 'bad' END AS score_pair,
          'clarity: ' || CAST(o_custkey % 5 AS STRING) || '/5, detail: ' || CAST(o_orderkey % 3 AS STRING) || '/3, total_score: '
               || CAST(o_custkey % 8 AS STRING) || '/10. Rest: 1/1' AS components,
          CASE o_orderkey % 5 WHEN 0 THEN 'so [[A>>B]]' WHEN 1 THEN '[[A=B]] or [[A=B]]' WHEN 2 THEN '[[A>B]] but [[B>A]]' WHEN 3 THEN 'My final verdict is: [[ A << B ]]' ELSE 'tie' END AS verdict_text,
          'Reality Assessment Score: ' || CAST(o_custkey % 10 AS STRING) || chr(10) || 'Aesthetics Rating: 4.5' ||
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || 'instruction consistency rating: ' || CAST(o_orderkey % 5 AS STRING) END AS ratings,
          CASE o_orderkey % 4 WHEN 0 THEN 'Response A Visual Factuality Score: **' || CAST(o_custkey % 13 AS STRING) || '/10**' || chr(10) || 'Response B Visual Factuality Score: 7.5/10'
               WHEN 1 THEN '' WHEN 2 THEN 'Response A Visual Factuality Score: 3' ELSE 'Response A Visual Factuality Score: 3' || chr(10) || 'Response B Visual Factuality Score: 4/10' END AS ab_scores,
          CASE o_orderkey % 3 WHEN 0 THEN 'question: how many ' || CAST(o_custkey % 9 AS STRING) || '?' || chr(10) || 'ANSWER: ' || CAST(o_custkey % 7 AS STRING) || chr(10) || 'more'
               WHEN 1 THEN 'Answer: only ' || CAST(o_custkey % 4 AS STRING) ELSE 'Question: open end' END AS qa_text,
          CASE o_orderkey % 4 WHEN 0 THEN 'hm **Answer: ' || CAST(o_custkey % 9 AS STRING) || '** ok' WHEN 1 THEN 'So Answer: blue' || CAST(o_custkey % 3 AS STRING)
               WHEN 2 THEN 'x <ans>red' || CAST(o_custkey % 3 AS STRING) || '</ans> y' ELSE 'do ```python' || chr(10) || 'a = ' || CAST(o_custkey % 3 AS STRING) || chr(10) || '``` now' END AS answer_line,
          CASE o_orderkey % 3 WHEN 0 THEN '{{' || chr(34) || 'colour' || chr(34) || ': ' || chr(34) || 'red' || chr(34) || ', ' || chr(34) || 'size' || chr(34) || ': ' || chr(34) || CAST(o_custkey % 5 AS STRING) || chr(34) || '}}'
               WHEN 1 THEN 'red and ' || CAST(o_custkey % 5 AS STRING) ELSE '{{' || chr(34) || 'colour' || chr(34) || ': ' || chr(34) || 'blue' || chr(34) || '}}' END AS field_json,
          CASE o_orderkey % 3 WHEN 0 THEN 'First. So the final answer is x. So the final answer is ' || CAST(o_custkey % 9 AS STRING) || ' '
               WHEN 1 THEN 'only \boxed{{' || CAST(o_custkey % 9 AS STRING) || '}} and \boxed{{b}}' ELSE 'plain' END AS phrase,
          CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey % 9 AS STRING) WHEN 1 THEN '2.5 m' WHEN 2 THEN 'b' WHEN 3 THEN 'It is (C)' ELSE 'A or B' END AS typed,
          CASE o_custkey % 3 WHEN 0 THEN 'float' WHEN 1 THEN 'multiple choice' ELSE 'text' END AS typed_kind
        FROM {orders}""",
    # open answers with several references, `|` between them
    "multi": """
        SELECT l_orderkey AS run, l_linenumber AS line, l_quantity AS amount,
               CASE l_orderkey % 8 WHEN 0 THEN 'The ' || CAST(l_linenumber AS STRING) || ' cups.' WHEN 1 THEN 'Two cups'
                    WHEN 2 THEN CAST(l_quantity AS STRING) WHEN 3 THEN CAST(l_linenumber AS STRING) || '%' WHEN 4 THEN 'Yes.'
                    WHEN 5 THEN ' 24 cups, dont' WHEN 6 THEN '' ELSE 'a RED  cup' END AS prediction,
               CASE l_partkey % 6 WHEN 0 THEN 'yes|yes|yes|no' WHEN 1 THEN '2 cups|two cups|24|' || CAST(l_linenumber AS STRING) || ' cups'
                    WHEN 2 THEN 'red cup' WHEN 3 THEN CAST(l_linenumber AS STRING) || '%|25' WHEN 4 THEN '24|25|26' ELSE 'the red cups|Yes|two cups|no' END AS answers,
               l_returnflag AS kind, l_linestatus AS split
        FROM {lineitem}""",
    # typed answers over documents
    "docqa": """
        SELECT l_orderkey AS run, l_partkey AS pid, l_linenumber AS line,
               CASE l_partkey % 5 WHEN 0 THEN 'Int' WHEN 1 THEN 'Float' WHEN 2 THEN 'Str' WHEN 3 THEN 'List' ELSE 'None' END AS kind,
               CASE l_partkey % 5 WHEN 0 THEN CAST(l_linenumber AS STRING) WHEN 1 THEN CAST(l_discount AS STRING) || '%'
                    WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'page ' || CAST(l_linenumber AS STRING) ELSE 'The Red Cup (big)' END
                    WHEN 3 THEN '[' || chr(39) || 'red' || chr(39) || ', ' || chr(39) || 'cup' || CAST(l_linenumber AS STRING) || chr(39) || ']'
                    ELSE 'Not answerable' END AS truth,
               CASE l_partkey % 5 WHEN 0 THEN CAST(l_orderkey % 5 AS STRING) || '.0' WHEN 1 THEN CAST(l_tax * 100 AS STRING)
                    WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'page ' || CAST(l_linenumber AS STRING) ELSE 'the red cap' END
                    WHEN 3 THEN CASE WHEN l_suppkey % 3 = 0 THEN '[' || chr(39) || 'cup' || CAST(1 + l_suppkey % 7 AS STRING) || chr(39) || ', ' || chr(39) || 'red' || chr(39) || ']' ELSE 'red' END
                    ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'Not answerable' ELSE 'red' END END AS prediction,
               CASE l_suppkey % 4 WHEN 0 THEN 'Chart' WHEN 1 THEN 'Table,Figure' WHEN 2 THEN 'Text' ELSE 'Chart,Text' END AS sources,
               l_linenumber % 4 AS pages
        FROM {lineitem}""",
    # JSON fields
    "fields": """
        SELECT event_id AS id, user_id, event_type AS task, props, value, SECS(ts) AS secs
        FROM {events}""",
}

_REF = re.compile(r"@(\w+)")
_TABLE = re.compile(r"\{(\w+)\}")
_SECS = re.compile(r"SECS\((\w+)\)")


def _spark_text(view: str) -> str:
    text = _SECS.sub(r"timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', \1)", VIEWS[view])
    return text.replace('"', "`").replace("\\", "\\\\")


def oracle_text(sql: str) -> str:
    """Prefix ``sql`` with the bound views it mentions as ``@name``."""
    sql = sql.strip()
    used = list(dict.fromkeys(n for n in _REF.findall(sql) if n in VIEWS))
    if not used:
        return sql
    for name in used:
        sql = re.sub(rf"@{name}\b", name, sql)
    parts = []
    for name in used:
        text = _SECS.sub(r"CAST(floor(epoch(\1) - 1704067200) AS BIGINT)", VIEWS[name])
        text = text.format(**{t: t for t in BASE_TABLES})
        parts.append(f"{name} AS ({text})")
    views = ",\n".join(parts)
    if sql[:4].upper() == "WITH":
        return f"WITH {views},\n{sql[4:].lstrip()}"
    return f"WITH {views}\n{sql}"


class Tables:
    """Lazily reads the base tables of one directory and derives the bound views."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        used = {n: self.base(n) for n in _TABLE.findall(text) if n in BASE_TABLES}
        return self.spark.sql(text, **{**used, **frames})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(_spark_text(name))
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)
