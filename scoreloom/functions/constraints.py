"""Rule checks on generated text: one boolean expression per rule kind, chosen by the rule row.

A constraint is ``struct<key, checks: array<struct<rule, low, high, texts, ranges>>>``; it holds when all its
checks hold, and a text's score is the mean over its constraints. Everything happens inside the row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.extract import all_found
from scoreloom.functions.score import flag, mean_of
from scoreloom.functions.text import words

CHECK_TYPE = "struct<rule:string,low:int,high:int,texts:array<string>,ranges:array<struct<low:int,high:int>>>"
CONSTRAINTS_TYPE = f"array<struct<key:string,checks:array<{CHECK_TYPE}>>>"


def tidy(text: Column) -> Column:
    """Lines trimmed one by one, then the whole."""
    return F.btrim(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), F.lit(" \t\n"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by blank space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.regexp_replace(text, r"[^\p{L}\p{N}_\s.-]", "")))


def spaced_words(text: Column) -> Column:
    """Lower-case words, each with a blank on both sides."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "  "), F.lit(" "))


def keyword_count(spaced: Column, keyword: Column) -> Column:
    """Whole-word occurrences, case ignored, in the result of ``spaced_words``."""
    needle = F.concat(F.lit(" "), F.lower(keyword), F.lit(" "))
    gone = F.length(spaced) - F.length(F.replace(spaced, needle, F.lit("")))
    return F.try_divide(gone, F.length(needle)).cast("int")


def _within(value: Column, check: Column) -> Column:
    return value.between(check["low"], check["high"])


def percent_digits(text: Column) -> Column:
    """Decimal places of every number that stands before a percent sign."""
    return F.transform(all_found(text, r"(\d+\.\d+|\d+)\s*%"), lambda n: F.length(F.split_part(n, F.lit("."), F.lit(2))))


def number_digits(text: Column) -> Column:
    """Decimal places of every free-standing number (mantissa only)."""
    pattern = r"(?<!\w)([+-]?(?:\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?%?)(?!\w)"
    mantissa = lambda n: F.split_part(F.regexp_replace(n, r"[,%]", ""), F.lit("e"), F.lit(1))
    return F.transform(all_found(text, pattern), lambda n: F.length(F.split_part(mantissa(F.lower(n)), F.lit("."), F.lit(2))))


def counted(text: Column, paras: Column, asked=lambda *rules: F.lit(True)) -> dict[str, Column]:
    """What only some rules compare with; ``asked`` tells whether some check is of the named rules."""
    return {
        "words": F.when(asked("word_count"), word_count(text)),
        "para_words": F.when(asked("paragraph_words"), F.transform(paras, word_count)),
        "para_sents": F.when(asked("paragraph_sentences", "paragraph_sentences_list"), F.transform(paras, lambda p: F.size(sentences(p)))),
        "percents": F.when(asked("percent_precision"), percent_digits(text)),
        "numbers": F.when(asked("number_precision"), number_digits(text)),
        "trimmed": F.btrim(text, F.lit(" \t\n")),
    }


def check_rule(text: Column, spaced: Column, paras: Column, sents: Column, c: Column, known: Mapping[str, Column] | Column | None = None) -> Column:
    """One check against the text, its spaced words, paragraphs and sentences.

    ``known``: the values of ``counted`` where they are computed already, as a struct column for instance.
    """
    first = F.get(c["texts"], F.lit(0))
    known = counted(text, paras) if known is None else known
    rules = {
        "paragraph_count": _within(F.size(paras), c),
        "sentence_count": _within(F.size(sents), c),
        "paragraph_sentences": F.forall(known["para_sents"], lambda n: _within(n, c)),
        "paragraph_sentences_list": (F.size(paras) == F.size(c["ranges"])) & F.forall(
            F.zip_with(known["para_sents"], c["ranges"], lambda n, r: n.between(r["low"], r["high"])), lambda x: x),
        "word_count": _within(known["words"], c),
        "paragraph_words": F.forall(known["para_words"], lambda n: _within(n, c)),
        "without": ~F.exists(c["texts"], lambda x: F.contains(text, x)),
        "sentences_begin": F.forall(sents, lambda s: F.startswith(s, first)),
        "sentences_end": F.forall(sents, lambda s: F.endswith(s, first)),
        "paragraphs_begin": F.forall(paras, lambda p: F.startswith(p, first)),
        "paragraphs_end": F.forall(paras, lambda p: F.endswith(p, first)),
        "begins": F.startswith(known["trimmed"], first),
        "ends": F.endswith(known["trimmed"], first),
        "each_keyword": F.forall(F.transform(c["texts"], lambda k: keyword_count(spaced, k)), lambda n: _within(n, c)),
        "total_keywords": _within(
            F.aggregate(c["texts"], F.lit(0), lambda a, k: a + keyword_count(spaced, k)), c),
        "percent_precision": F.forall(known["percents"], lambda d: d == c["low"]),
        "number_precision": F.forall(known["numbers"], lambda d: d == c["low"]),
        "no_arabic_numbers": ~text.rlike(r"(?<![.\w])\d[\d,]*(\.\d+)?([eE][+-]?\d+)?%?(?![.\w])"),
    }
    chain = reduce(lambda acc, kv: acc.when(c["rule"] == kv[0], kv[1]), rules.items(), F)
    return F.coalesce(chain.otherwise(False), F.lit(False))


def constraint_scores(df: DataFrame, text: str, constraints: str) -> DataFrame:
    """Add ``passed`` (key -> boolean pairs) and ``score`` (share of constraints that hold)."""
    facts = "_facts"
    while facts in df.columns:
        facts = f"_{facts}"
    asked = lambda *rules: F.exists(constraints, lambda k: F.exists(k["checks"], lambda c: c["rule"].isin(*rules)))
    # each fact once per text, in columns that later steps of the plan read
    tidied = df.withColumn(facts, F.struct(tidy(F.col(text)).alias("tidy")))
    cut = tidied.withColumn(facts, F.struct(
        paragraphs(F.col(facts)["tidy"]).alias("paras"), sentences(F.col(facts)["tidy"]).alias("sents"), spaced_words(F.col(text)).alias("spaced")))
    known = F.col(facts)
    counts = counted(F.col(text), known["paras"], asked)
    parts = cut.withColumn(facts, F.struct(known["paras"].alias("paras"), known["sents"].alias("sents"), known["spaced"].alias("spaced"), *[v.alias(k) for k, v in counts.items()]))

    def holds(constraint: Column) -> Column:
        return F.forall(constraint["checks"], lambda c: check_rule(F.col(text), known["spaced"], known["paras"], known["sents"], c, known))

    passed = F.transform(F.col(constraints), lambda k: F.struct(k["key"].alias("key"), holds(k).alias("ok")))
    scored = parts.withColumn("passed", passed)
    return scored.withColumn("score", mean_of(F.transform("passed", lambda p: flag(p["ok"])))).drop(facts)


def text_features(text: Column, phrase: str, start: str, end: str) -> Column:
    """Response-level facts of generated text: words, lines, phrase count, start and end."""
    return F.struct(
        word_count(text).alias("words"),
        F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).alias("lines"),
        keyword_count(spaced_words(text), F.lit(phrase)).alias("phrase_count"),
        F.startswith(F.lower(F.trim(text)), F.lit(start.lower())).alias("starts"),
        F.endswith(F.lower(F.trim(text)), F.lit(end.lower())).alias("ends"),
    )
