"""Answer extraction from free text: Column in, Column out, null when nothing is found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions import fixed
from scoreloom.functions.text import as_float, bound, literal_map, strip_punctuation, words


def found(s: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or null."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def all_found(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def only(a: Column) -> Column:
    """The element of a one-element array, else null."""
    return F.when(F.size(a) == 1, a[0])


def infer_option(prediction: Column, options: Column) -> Column:
    """The one option label among the tokens; Z for refusals and a lone Z."""
    marks = ".()[],:;!*#{}"
    tokens = words(F.translate(prediction, marks, " " * len(marks)))
    refused = reduce(lambda a, b: a | b, [prediction.contains(r) for r in fixed.REFUSALS])

    def pick(said: Column) -> Column:
        labels = F.array_intersect(F.map_keys(options), said)
        return bound(labels, lambda l: F.when(F.size(l) == 1, l[0]).when((F.size(l) == 0) & F.array_contains(said, "Z"), "Z"))

    return (
        F.when(prediction.contains(fixed.FAILURE_TEXT), F.lit(None)).when(refused, "Z").otherwise(bound(tokens, pick))
    )


def infer_text(prediction: Column, options: Column) -> Column:
    """The label whose text alone occurs in the reply."""
    low = F.lower(prediction)
    hits = F.filter(F.map_entries(options), lambda e: F.contains(low, F.lower(e.value)))
    return bound(hits, lambda h: F.when(F.size(h) == 1, h[0]["key"]))


def infer(prediction: Column, options: Column) -> Column:
    return F.coalesce(infer_option(prediction, options), infer_text(prediction, options))


# Phrases for the four places, and the shape of a numbered step.
ORDINALS = [
    "FIRST|1ST|首先|第一步", "SECOND|2ND|其次|第二步", "THIRD|3RD|再次|第三步", "FOURTH|4TH|最后|第四步",
]
NUMBERED_STEP = r"(?:STEP\s*[\d一二三四]+|步骤\s*[\d一二三四]+|第\s*[\d一二三四]\s*步).*?([A-D])"


def infer_sequence(prediction: Column) -> Column:
    """A permutation of ABCD: as one word, by ordinal phrases, or by numbered steps."""
    up = F.upper(prediction)
    word = found(up, r"\b([A-D]{4})\b")
    word = F.when(F.size(F.array_distinct(F.split(word, ""))) == 4, word)
    named = F.array_distinct(F.array_compact(F.array(*[found(up, f"(?:{p}).*?([A-D])") for p in ORDINALS])))
    numbered = all_found(up, NUMBERED_STEP)
    steps = F.array_distinct(F.slice(numbered, 1, 4))
    return F.coalesce(
        word,
        F.when(F.size(named) == 4, F.array_join(named, "")),
        F.when(F.size(steps) == 4, F.array_join(steps, "")),
    )


# The patterns of the choice cascade, tried in this order.
CHOICE_PATTERNS = [
    r"(?i)FINAL ANSWER:\s*\*?\*?([A-E])",
    r"\*\*([A-E])(?:\.|\*\*)",
    r"(?i)answer is:?\s*([A-E])",
    r"[Aa]nswer:\s*([A-E])",
    r"\b([A-E])\.",
    r"(?i)^([A-E])\b",
    r"\b([A-D])\b[^A-D]*$",
]


def extract_choice_cascade(prediction: Column) -> Column:
    text = F.trim(prediction)
    return F.coalesce(*[F.upper(found(text, p)) for p in CHOICE_PATTERNS], F.lit("INVALID"))


def extract_letter(s: Column) -> Column:
    """First letter A-E after known lead-ins are removed; blank when there is none."""
    text = reduce(lambda out, p: F.replace(out, F.lit(p), F.lit("")), fixed.ANSWER_PREFIXES, F.trim(s))
    letter = F.regexp_extract(text, "[ABCDE]", 0)
    low = F.lower(text)
    # a reply like "b" or "(b" is contained in the label "(B)"; an empty one fits the first label
    spoken = F.when(low == "", "A").when(low.rlike(r"^(\(|\)|\([a-e]|[a-e]\)?|\([a-e]\))$"),
        F.coalesce(F.nullif(F.upper(F.regexp_extract(low, "[a-e]", 0)), F.lit("")), F.lit("A")))
    return F.when(letter != "", letter).when(F.size(words(text)) > 10, "").otherwise(F.coalesce(spoken, F.lit("")))


def extract_cot_answer(s: Column) -> Column:
    """From the only line starting with ``Answer:``: its one capital, else the rest of the line."""
    lines = F.filter(F.transform(F.split(F.trim(s), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("Answer:"))
    line = only(lines)
    rest = F.substring(line, 8, 2147483647)
    capitals = F.array_distinct(all_found(rest, "([A-Z])"))
    # the word "Answer:" itself holds a capital A, so a second letter leaves the rest of the line
    return F.when(line.isNull(), s).when(F.size(F.array_union(capitals, F.array(F.lit("A")))) == 1, "A").otherwise(rest)


def extract_final_answer(s: Column) -> Column:
    upper = F.substring_index(s, "FINAL ANSWER:", -1)
    mixed = F.substring_index(s, "Final Answer:", -1)
    return F.trim(
        F.when(s.contains("FINAL ANSWER:"), upper).when(s.contains("Final Answer:"), mixed).otherwise(s)
    )


def extract_boxed_or_phrase(s: Column, labels: str = "ABCD") -> Column:
    """struct(answer, how): last boxed letter, else a phrase, else Z."""
    group = f"([{labels}])"
    boxed = last(all_found(s, r"\\boxed\{(?:\\text\{|\\rm\{|\\mathbf\{|\$)?\s*" + group + r"\s*\$?\}"))
    plain = F.replace(s, F.lit("<|endoftext|>"), F.lit(""))
    ends = lambda c: plain.endswith(f" {c}.") | plain.endswith(f" ({c}).")
    starts = lambda c: plain.startswith(f"{c}\n") | plain.startswith(f"({c})\n") | plain.startswith(f"({c}) {c}\n")
    framed = F.coalesce(*[F.when(ends(c) | starts(c), F.lit(c)) for c in labels])
    low = F.lower(plain)
    tail = lambda p: F.split_part(F.split_part(F.trim(F.substring_index(low, p, -1)), F.lit("\n"), F.lit(1)), F.lit("."), F.lit(1))
    phrase = F.coalesce(*[
        F.when(low.contains(p), found(F.upper(tail(p)), f"^{group}$")) for p in fixed.ANSWER_PHRASES
    ])
    lang = F.coalesce(framed, phrase, found(plain, f"^{group}$"))
    return F.when(boxed.isNotNull(), F.struct(boxed.alias("answer"), F.lit("box").alias("how"))).when(
        lang.isNotNull(), F.struct(lang.alias("answer"), F.lit("lang").alias("how"))
    ).otherwise(F.struct(F.lit("Z").alias("answer"), F.lit("error").alias("how")))


def extract_yes_no(s: Column) -> Column:
    tokens = words(strip_punctuation(F.lower(s)))
    yes, no = F.array_contains(tokens, "yes"), F.array_contains(tokens, "no")
    return F.when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("Unknown")


def extract_yes_no_prefix(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no")


def extract_true_false(s: Column) -> Column:
    """struct(value, error): the only true/false token."""
    tokens = F.transform(all_found(s, r"(?i)\b(true|false|t|f)\b"), lambda t: F.upper(F.substring(t, 1, 1)))
    value = F.when(F.size(tokens) == 1, tokens[0])
    error = F.when(F.size(tokens) > 1, "multiple_answers_found").when(F.size(tokens) == 0, "no_answer_found")
    return F.struct(value.alias("value"), error.alias("error"))


def extract_binary(s: Column, kind: Column) -> Column:
    """1 for yes/A, 0 for no/B, the earlier one when both occur, -1 for neither."""

    def first_of(yes: str, no: str) -> Column:
        hit = F.upper(F.regexp_extract(s, rf"(?i)\b({yes}|{no})\b", 1))
        return F.when(hit == yes.upper(), 1).when(hit == no.upper(), 0).otherwise(-1)

    return F.when(kind == "yes_no", first_of("yes", "no")).otherwise(first_of("a", "b"))


def rule_mcq(prediction: Column, answer: Column) -> Column:
    """'1' or '0' where a rule decides, otherwise 'fail'."""
    letter = F.coalesce(found(prediction, r"^([A-D])$"), found(prediction, r"^([A-D])[.)]"))
    same = lambda c: F.when(c, "1").otherwise("0")
    return (
        F.when(prediction == answer, "1")
        .when(letter.isNotNull(), same(letter == F.substring(answer, 1, 1)))
        .otherwise("fail")
    )


def rule_caption(prediction: Column, answer: Column, candidates: Column) -> Column:
    """Match a caption candidate ``Sentence A: text`` by whole, text or label."""
    label = lambda o: F.split_part(o, F.lit(": "), F.lit(1))
    body = lambda o: F.split_part(o, F.lit(": "), F.lit(2))
    short = lambda o: F.regexp_replace(label(o), "Sentence |Option |Caption ", "")
    plain = F.replace(prediction, F.lit("."), F.lit(""))
    after = F.split_part(prediction, F.lit(") "), F.lit(2))
    hit = F.filter(candidates, lambda o: (o == prediction) | (body(o) == prediction) | (body(o) == after)
                   | label(o).isin(prediction, plain) | short(o).isin(prediction, plain))
    return F.when(F.size(hit) == 0, "fail").when(F.array_contains(hit, answer), "1").otherwise("0")


def match_first_token(prediction: Column, truth: Column) -> Column:
    """First word of one side contained in the first word of the other."""
    head = lambda c: F.split_part(F.trim(F.lower(c)), F.lit(" "), F.lit(1))
    mine, theirs = head(prediction), head(truth)
    return F.contains(theirs, F.replace(mine, F.lit("."), F.lit(""))) | F.contains(mine, theirs)


def match_first_token_or_text(prediction: Column, truth: Column) -> Column:
    """As above, or the truth's text (digits as words) inside the reply."""
    digit_words = literal_map({str(v): k for k, v in fixed.NUMBER_WORDS.items() if v < 10})
    trimmed = lambda c: F.btrim(F.lower(c), F.lit(". \n"))
    content = trimmed(F.regexp_replace(F.trim(truth), r"^\S+ ?", ""))
    content = F.coalesce(F.try_element_at(digit_words, content), content)
    return match_first_token(prediction, truth) | F.contains(trimmed(prediction), content)


def parse_choice_multi(response: Column, options: Column) -> Column:
    """Bracketed label, spaced label, then option text; the last position wins; null for none."""
    def latest(hay: Column, entries: Column, needle) -> Column:
        """Label of the entry whose needle stands nearest the end of the reversed ``hay``."""
        spots = F.transform(entries, lambda e: F.struct(F.instr(hay, F.reverse(needle(e))).alias("gap"), e["key"].alias("label")))
        return F.try_element_at(F.array_sort(F.filter(spots, lambda x: x["gap"] > 0)), F.lit(1))["label"]

    def read(t: Column) -> Column:
        back, entries = t["back"], t["entries"]
        bracket = latest(back, entries, lambda e: F.concat(F.lit("("), e["key"], F.lit(")")))
        dotted = F.filter(F.transform(entries, lambda e: e["key"]), lambda k: F.contains(t["text"], F.concat(k, F.lit(". "))))
        spaced = latest(back, entries, lambda e: F.concat(F.lit(" "), e["key"], F.lit(" ")))
        by_text = F.when(F.size(words(t["text"])) > 5, latest(F.lower(back), entries, lambda e: F.lower(e["value"])))
        return F.coalesce(bracket, F.try_element_at(dotted, F.lit(1)), spaced, by_text)

    text = F.concat(F.lit(" "), F.btrim(response, F.lit(",.!?;:'")), F.lit(" "))
    facts = F.struct(text.alias("text"), F.reverse(text).alias("back"), F.map_entries(options).alias("entries"))
    return bound(facts, read)


def extract_numbers(s: Column) -> Column:
    """Digit runs, then the value of the number words read as one phrase."""
    low = F.lower(s)
    digits = F.transform(all_found(low, r"(\d+)"), lambda x: x.try_cast("bigint"))
    spoken = F.transform(
        all_found(low, r"\b(" + "|".join(fixed.NUMBER_WORDS) + r")\b"),
        lambda w: F.element_at(literal_map(fixed.NUMBER_WORDS), w),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("current"))
    value = F.aggregate(
        spoken, start,
        lambda a, v: F.when(
            v.isin(100, 1000),
            F.struct((a.total + F.greatest(a.current, F.lit(1)) * v).alias("total"), F.lit(0).cast("bigint").alias("current")),
        ).otherwise(F.struct(a.total.alias("total"), (a.current + v).alias("current"))),
        lambda a: a.total + a.current,
    )
    return F.concat(digits, F.when((F.size(spoken) > 0) & (value != 0), F.array(value)).otherwise(F.array().cast("array<bigint>")))


def first_count(s: Column) -> Column:
    """First number 0..20, written in digits or words."""
    small = {k: v for k, v in fixed.NUMBER_WORDS.items() if v <= 20}
    hit = found(F.lower(s), r"\b([0-9]|1[0-9]|20|" + "|".join(small) + r")\b")
    return F.coalesce(hit.try_cast("int"), F.try_element_at(literal_map(small), hit))


def unit_cm(unit: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.UNIT_CM), F.lower(unit)), F.lit(0.0))


def parse_scalar_unit(s: Column) -> Column:
    """``scalar{..} distance_unit{..}``: mean of the numbers times the unit, in centimetres."""
    numbers = F.transform(all_found(last(all_found(s, r"scalar\{([^}]*)\}")), r"(\d+\.?\d*)"), lambda x: x.try_cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(numbers)) * unit_cm(last(all_found(s, r"distance_unit\{([^}]*)\}")))


def parse_quantity(s: Column) -> Column:
    """``(a-b, unit)`` or ``(a, unit)`` in centimetres, the midpoint of a range; 0 if malformed."""
    number, unit = found(s, r"^\(([\d.-]+), (.+)\)", 1), found(s, r"^\(([\d.-]+), (.+)\)", 2)
    low = F.split_part(number, F.lit("-"), F.lit(1)).try_cast("double")
    high = F.split_part(number, F.lit("-"), F.lit(2)).try_cast("double")
    value = F.when(number.contains("-"), (low + high) / 2).otherwise(low)
    return F.coalesce(value * unit_cm(unit), F.lit(0.0))


def first_braces(s: Column) -> Column:
    return F.regexp_extract(s, r"\{(.*?)\}", 1)


def last_braces(s: Column) -> Column:
    return last(all_found(s, r"\{(.*?)\}"))


def rows_columns(s: Column) -> Column:
    """'rows,columns' from ``rows {n} … columns {m}`` or ``(n, m)``."""
    rows, cols = found(s, r"[Rr]ows?[^{}]*\{(\d+)\}"), found(s, r"[Cc]olumns?[^{}]*\{(\d+)\}")
    pair = F.concat_ws(",", found(s, r"\((\d+),\s*(\d+)\)", 1), found(s, r"\((\d+),\s*(\d+)\)", 2))
    return F.when(rows.isNotNull() & cols.isNotNull(), F.concat_ws(",", rows, cols)).otherwise(F.nullif(pair, F.lit("")))


def fenced_json_result(s: Column) -> Column:
    """``result`` of the first fenced JSON block, bare words quoted first."""
    block = F.trim(found(s, r"(?s)```json(.*?)```"))
    quoted = F.regexp_replace(block, r"(:\s)([A-Za-z_]\w*)", '$1"$2"')
    return F.get_json_object(quoted, "$.result")


def choice_from_fenced(s: Column, answer: Column) -> Column:
    """1/0 from the fenced result, else from the letters A-H in the reply, else -1."""
    result = fenced_json_result(s)
    letters = all_found(s, r"\b([A-H])\b")
    return (
        F.when(result.isNotNull(), (result == answer).cast("int"))
        .when(F.size(letters) > 0, F.array_contains(letters, answer).cast("int"))
        .otherwise(-1)
    )


def number_pairs(s: Column) -> Column:
    """Consecutive numbers paired into intervals; an odd last one is dropped."""
    numbers = F.transform(all_found(s, r"(-?\d+\.?\d*)"), lambda x: x.try_cast("double"))
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(numbers)), lambda i: (i % 2 == 0) & (i + 1 < F.size(numbers))),
        lambda i: F.struct(F.get(numbers, i).alias("start"), F.get(numbers, i + 1).alias("end")),
    )


def parse_score_json(s: Column) -> Column:
    """struct(pred, score) of a JSON or literal-style object; (null, -1) if unreadable."""
    read = F.from_json(s, "pred string, score string")
    pred, score = read["pred"], read["score"].try_cast("double")
    good = pred.isNotNull() & score.isNotNull()
    return F.struct(F.when(good, F.lower(pred)).alias("pred"), F.when(good, score).otherwise(-1.0).alias("score"))


def parse_score_pair(s: Column) -> Column:
    """struct(first, second) of the first line ``x y`` or ``x, y``; -1 for both otherwise."""
    parts = F.split(F.translate(F.split_part(s, F.lit("\n"), F.lit(1)), ",", " "), " ")
    a, b = as_float(F.get(parts, F.lit(0))), as_float(F.get(parts, F.lit(1)))
    good = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.struct(F.when(good, a).otherwise(-1.0).alias("first"), F.when(good, b).otherwise(-1.0).alias("second"))


def parse_component_scores(s: Column) -> Column:
    """Ratios of ``name: x/y`` parts in the first sentence; the last one is the total."""
    head = F.split_part(s, F.lit("."), F.lit(1))
    return F.transform(
        F.arrays_zip(all_found(head, r"(\d+)/(\d+)", 1).alias("x"), all_found(head, r"(\d+)/(\d+)", 2).alias("y")),
        lambda p: F.try_divide(p["x"].cast("double"), p["y"].cast("double")),
    )


VERDICT = r"(A>>B|A>B|A=B|B>A|B>>A|B<<A|B<A|B=A|A<B|A<<B)"


def parse_verdict(s: Column, marker: str | None = None) -> Column:
    """The one distinct ``[[verdict]]``; with ``marker``, only the first verdict on marked lines."""
    if marker is None:
        return only(F.array_distinct(all_found(s, rf"\[\[{VERDICT}\]\]")))
    lines = F.filter(F.transform(F.split(s, "\n"), F.upper), lambda x: F.contains(x, F.lit(marker.upper())))
    spaced = F.transform(lines, lambda x: F.regexp_extract(F.replace(x, F.lit(" "), F.lit("")), rf"\[\[{VERDICT}\]\]", 1))
    return F.try_element_at(F.filter(spaced, lambda v: v != ""), F.lit(1))


def parse_named_scores(s: Column, patterns: dict[str, str]) -> Column:
    """struct of named ratings; all null unless every pattern matches."""
    values = {k: found(s, f"(?i){p}").try_cast("double") for k, p in patterns.items()}
    complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in values.values()])
    return F.struct(*[F.when(complete, v).alias(k) for k, v in values.items()])


def parse_ab_scores(s: Column, label_a: str, label_b: str) -> Column:
    """'a|b' when both labelled scores lie in 0..10; NO_OBJECTIVE for an empty review."""
    text = F.regexp_replace(F.upper(s), "[“”*]", "")
    a = found(text, rf"(?m)^{label_a.upper()}\s*([\d.]+)").try_cast("double")
    b = found(text, rf"(?m)^{label_b.upper()}\s*([\d.]+)").try_cast("double")
    return F.when(F.coalesce(s, F.lit("")) == "", "NO_OBJECTIVE").when(
        a.between(0, 10) & b.between(0, 10), F.concat_ws("|", a.cast("string"), b.cast("string"))
    )


def parse_qa_output(s: Column) -> Column:
    """struct(question, answer) of ``Question: … Answer: …``, any case, over several lines."""
    question = F.regexp_extract(s, r"(?is)Question:\s*(.+?)(?=\nAnswer:|\z)", 1)
    answer = F.regexp_extract(s, r"(?is)Answer:\s*(.+?)\z", 1)
    return F.struct(F.trim(question).alias("question"), F.trim(answer).alias("answer"))


def parse_bbox(s: Column) -> Column:
    """struct(x1, y1, x2, y2) when exactly one group of four decimals below 10 is present."""
    pattern = r",\s?".join([r"\d?(?:\.\d+)?"] * 4)
    hits = all_found(F.replace(s, F.lit("\n"), F.lit("")), pattern, 0)
    number = lambda parts, i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    corners = lambda parts: F.struct(*[number(parts, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    return bound(bound(hits, lambda h: F.split(only(h), ",")), corners)


def parse_answer_line(s: Column) -> Column:
    """Text after ``Answer:`` or inside ``**Answer: …**``; the whole text when absent."""
    pattern = r"(?s)\*\*?Answer:\s*(.*?)\*\*?|\bAnswer:\s*(.*)"
    hit = F.coalesce(found(s, pattern, 1), found(s, pattern, 2), F.lit(""))
    return F.trim(F.when(s.rlike(pattern), hit).otherwise(s))


def parse_tag(s: Column, tag: str) -> Column:
    return F.regexp_extract(s, rf"(?s)<{tag}>(.*?)</{tag}>", 1)


def parse_code_block(s: Column) -> Column:
    pattern = r"(?s)```\w*\s*(.*?)\s*```"
    return F.when(s.rlike(pattern), F.trim(F.regexp_extract(s, pattern, 1))).otherwise(s)


def parse_fields(s: Column, fields: Column) -> Column:
    """field -> value of a JSON reply; every field gets the raw text when it does not parse."""
    parsed = F.from_json(s, "map<string,string>")
    return F.coalesce(parsed, F.map_from_arrays(fields, F.array_repeat(s, F.size(fields))))


def extract_tagged_letter(s: Column) -> Column:
    """Letter A-F of the last answer tag; spaced, colon or bracket forms before bare ones."""
    choice = F.trim(last(all_found(s, r"(?s)<answer>\s*(.*?)\s*</answer>")))
    marked = [F.when(choice.rlike(rf"{c}[ :]|\[{c}"), c) for c in "ABCDEF"]
    bare = [F.when(choice.contains(c), c) for c in "ABCDEF"]
    return F.coalesce(*marked, *bare, F.lit("WRONG"))


# The phrases that announce a final answer.
FINAL_PHRASES = {"en": "So the final answer is (.*)", "zh": "所以最终答案是(.*)"}


def extract_answer_phrase(s: Column, lang: str = "en") -> Column:
    hit = last(all_found(s, FINAL_PHRASES[lang]))
    return F.when(hit.isNotNull(), F.trim(hit)).otherwise(s)


def boxed_contents(s: Column) -> Column:
    return all_found(s, r"\\boxed\{([^{}]*)\}")


def parse_by_type(s: Column, kind: Column) -> Column:
    """struct(ok, value): numbers (a π suffix multiplies), single letters, or free text."""
    head = F.split_part(s, F.lit(" "), F.lit(1))
    factor = F.split_part(head, F.lit("π"), F.lit(1)).try_cast("double")
    number = F.when(head.contains("π"), factor * F.pi()).otherwise(as_float(head))
    up = F.upper(s)
    present = F.filter(F.array(*[F.lit(c) for c in "ABCDE"]), lambda c: F.contains(up, c))
    letter = F.when(F.length(s) == 1, up).when(F.size(present) == 1, present[0])
    value = F.when(kind == "float", number.cast("string")).when(kind == "multiple choice", letter).otherwise(s)
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"))
