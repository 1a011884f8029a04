"""Fragments of oracle SQL that several queries share."""

from __future__ import annotations

from scoreloom.functions import fixed


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def found(s: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({s}, {lit(pattern)}, {group}), '')"


def found_all(s: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({s}, {lit(pattern)}, {group})"


def words(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: w <> '')"


def strip_punctuation(s: str) -> str:
    out = s
    for mark in fixed.PUNCTUATION:
        m = lit(mark)
        test = f"regexp_matches({s}, '[0-9],[0-9]') OR contains({s}, {m} || ' ') OR contains({s}, ' ' || {m})"
        out = f"replace({out}, {m}, CASE WHEN {test} THEN '' ELSE ' ' END)"
    # periods after or before a digit are parked in chr(1), the others go
    kept = f"regexp_replace(regexp_replace({out}, '([0-9])\\.', '\\1' || chr(1), 'g'), '\\.([0-9])', chr(1) || '\\1', 'g')"
    return f"replace(replace({kept}, '.', ''), chr(1), '.')"


def mapped(value: str, table: dict, default: str) -> str:
    keys = ", ".join(lit(k) for k in table)
    values = ", ".join(lit(v) if isinstance(v, str) else repr(v) for v in table.values())
    return f"coalesce(map([{keys}], [{values}])[{value}], {default})"


def normalise_words(s: str) -> str:
    articles = ", ".join(lit(a) for a in fixed.ARTICLES)
    plain = f"list_transform({words(f'lower({s})')}, lambda w: {mapped('w', fixed.DIGIT_WORDS, 'w')})"
    kept = f"list_filter({plain}, lambda w: w NOT IN ({articles}))"
    return f"array_to_string(list_transform({kept}, lambda w: {mapped('w', fixed.CONTRACTIONS, 'w')}), ' ')"


def options(prefix: str = "") -> str:
    """Labels present in a row of items."""
    return f"list_filter(['A','B','C','D'], lambda o: o <> 'D' OR {prefix}\"D\" IS NOT NULL)"


def infer_option(pred: str, labels: str) -> str:
    refused = " OR ".join(f"contains({pred}, {lit(r)})" for r in fixed.REFUSALS)
    tokens = words(f"translate({pred}, '.()[],:;!*#{{}}', '             ')")
    hit = f"list_filter({labels}, lambda o: list_contains({tokens}, o))"
    return f"""CASE WHEN contains({pred}, {lit(fixed.FAILURE_TEXT)}) THEN NULL WHEN {refused} THEN 'Z'
        WHEN len({hit}) = 1 THEN ({hit})[1]
        WHEN len({hit}) = 0 AND list_contains({tokens}, 'Z') THEN 'Z' END"""


def infer_text(pred: str, p: str = "") -> str:
    each = ", ".join(
        f"CASE WHEN contains(lower({pred}), lower({p}\"{c}\")) THEN '{c}' END" for c in "ABCD"
    )
    hit = f"list_filter([{each}], lambda o: o IS NOT NULL)"
    return f"CASE WHEN len({hit}) = 1 THEN ({hit})[1] END"


def infer(pred: str, p: str = "") -> str:
    return f"coalesce({infer_option(pred, options(p))}, {infer_text(pred, p)})"
