"""Question rows from HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.extract import all_found, found
from scoreloom.functions.text import bound


def inner_text(html: Column) -> Column:
    """Text of a fragment: tags become blanks, runs of blanks one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"\s+", " "))


def elements(html: Column, tag: str) -> Column:
    """Contents of the elements ``tag``, not nested in each other."""
    return all_found(html, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")


def _clean_lead(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"^[\s\x{00A0}.,\-–—:;…]+", ""))


def split_answer(cell: Column) -> Column:
    """struct(letter, text) of an answer cell: ``ans: B) text``, ``B. text``, ``B`` or plain text."""
    s = F.trim(cell)
    named = r"(?i)^ans\s*[:\-]\s*([A-D])\s*[).\-]?\s*(.*)"
    lettered = r"^([A-D])\s*[).\-]\s*(.+)$"
    alone = r"(?i)^([A-D])[).\-]?$"
    spoken = r"(?i)^\(?\s*ans\s*[:\-]\s*(.*?)\s*\)?$"
    letter = F.coalesce(F.upper(found(s, named)), found(s, lettered), F.upper(found(s, alone)), F.lit(""))
    text = (
        F.when(s.rlike(named), F.regexp_extract(s, named, 2)).when(s.rlike(lettered), F.regexp_extract(s, lettered, 2))
        .when(s.rlike(alone), "").when(s.rlike(spoken), F.regexp_extract(s, spoken, 1)).otherwise(s)
    )
    return F.struct(letter.alias("letter"), _clean_lead(text).alias("text"))


def pages_to_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One item per table row with at least three cells and a list in the first one.

    The first list item is the question, the others are options. A missing letter is taken from the
    first option that contains the answer text, a missing text from the letter; rows without
    options are open questions (SAQ).
    """
    rows = pages.select(key, F.posexplode(elements(F.col(html), "tr")).alias("row", "tr"))
    cells = rows.select(key, "row", elements(F.col("tr"), "td").alias("td")).filter(F.size("td") >= 3)
    listed = cells.select(key, "row", F.transform(elements(F.get("td", F.lit(0)), "li"), inner_text).alias("li"),
                          inner_text(F.element_at("td", -1)).alias("cell")).filter(F.size("li") > 0)
    question = F.trim(F.regexp_replace(F.get("li", F.lit(0)), r"^\s*\d+\s*[).]\s*", ""))
    stripped = F.transform(F.slice("li", F.lit(2), F.size("li")), lambda o: F.trim(F.regexp_replace(o, r"^[A-D]\s*[).\-]\s*", "")))
    four = F.slice(F.concat(stripped, F.array_repeat(F.lit(""), 4)), 1, 4)
    shaped = listed.select(key, "row", question.alias("question"), four.alias("o"), split_answer(F.col("cell")).alias("said"), "cell")
    any_option = F.exists("o", lambda o: o != "")
    hit = bound(F.transform("o", lambda o: F.contains(F.lower(o), F.lower(F.col("said.text")))), lambda h: F.array_position(h, F.lit(True)))
    letter = F.when(F.col("said.letter") != "", F.col("said.letter")).when(
        any_option & (F.col("said.text") != "") & (hit > 0), F.substring(F.lit("ABCD"), 1, 4).substr(hit.cast("int"), F.lit(1))).otherwise("")
    text = F.when(F.col("said.text") != "", F.col("said.text")).when(
        any_option, F.coalesce(F.get("o", F.instr(F.lit("ABCD"), F.col("said.letter")) - 1), F.lit("")))
    answer = F.when(any_option, _clean_lead(F.coalesce(text, F.lit("")))).otherwise(F.when(F.col("said.text") != "", F.col("said.text")).otherwise(_clean_lead(F.col("cell"))))
    return shaped.select(
        key, "row", "question", *[F.get("o", F.lit(i)).alias(c) for i, c in enumerate("ABCD")], answer.alias("answer"),
        letter.alias("correct_option"), F.when(any_option, "MCQ").otherwise("SAQ").alias("question_type"))
