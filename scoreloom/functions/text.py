"""Text normalisation as Column expressions (JVM side, no Python in the row path)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions import fixed

CJK = "[一-鿿]"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, where an expression needs it several times."""
    return F.transform(F.array(value), use)[0]


NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"


def as_float(s: Column) -> Column:
    """Number of a text or null; the pattern spares a failed conversion for every other text."""
    return F.when(F.trim(s).rlike(NUMBER), F.trim(s).try_cast("double"))


def looked_up(value: Column, table: dict) -> Column:
    """Entry of a fixed table, or the value itself; misses cost one hash probe."""
    return F.when(value.isin(list(table)), F.try_element_at(literal_map(table), value)).otherwise(value)


def words(s: Column) -> Column:
    """Whitespace-separated words without empty ones."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def strip_punctuation(s: Column) -> Column:
    """Drop or blank each mark by looking at the *input*, then drop periods outside numbers.

    A mark that stands beside a blank anywhere is dropped everywhere, and all marks are where a comma
    stands between digits; the others become blanks.
    """
    marks = "[" + "".join("\\" + m for m in fixed.PUNCTUATION) + "]"
    beside = F.array_join(F.array_distinct(F.regexp_extract_all(s, F.lit(rf"((?<= ){marks}|{marks}(?= ))"), F.lit(1))), "")
    some = F.regexp_replace(F.call_function("translate", s, beside, F.lit("")), marks, " ")
    out = F.when(s.rlike(r"\d,\d"), F.regexp_replace(s, marks, "")).otherwise(some)
    return F.regexp_replace(F.when(s.rlike(marks), out).otherwise(s), r"(?<!\d)\.(?!\d)", "")


def normalise_words(s: Column) -> Column:
    """Lower case, digits for number words, no articles, contractions restored."""
    plain = F.transform(words(F.lower(s)), lambda w: looked_up(w, fixed.DIGIT_WORDS))
    kept = F.filter(plain, lambda w: ~w.isin(fixed.ARTICLES))
    return F.array_join(F.transform(kept, lambda w: looked_up(w, fixed.CONTRACTIONS)), " ")


def normalise_answer(s: Column) -> Column:
    return normalise_words(strip_punctuation(F.trim(F.translate(s, "\n\t", "  "))))


def clean_doc_string(s: Column) -> Column:
    """Lower, trim, no parentheses groups, no outer quotes, no leading $ or trailing %."""
    out = F.trim(F.lower(s))
    out = F.trim(F.regexp_replace(out, r"\s*\([^)]*\)", ""))
    out = F.trim(F.regexp_replace(out, "^['\"]|['\"]$", ""))
    out = F.trim(F.regexp_replace(out, r"^\$+", ""))
    return F.trim(F.regexp_replace(out, "%+$", ""))


def ocr_tokens(s: Column, by_word: bool = True, lower: bool = True, alnum: bool = False) -> Column:
    """Tokens of a recognised text: words, or single characters when ``by_word`` is false."""
    out = F.regexp_replace(F.translate(s, "\t\n", "  "), r"###|\*\*\*", "")
    out = F.trim(F.regexp_replace(out, " +", " "))
    tokens = F.split(out, " ") if by_word else F.split(F.replace(out, F.lit(" "), F.lit("")), "")
    if lower:
        tokens = F.transform(tokens, F.lower)
    if alnum:
        tokens = F.transform(tokens, lambda t: F.regexp_replace(t, "[^A-Za-z0-9]+", ""))
    return F.filter(tokens, lambda t: t != "")


def fullwidth_to_halfwidth(s: Column) -> Column:
    wide = "".join(chr(c) for c in range(fixed.FULLWIDTH_FIRST, fixed.FULLWIDTH_LAST + 1))
    narrow = "".join(chr(ord(c) - fixed.FULLWIDTH_SHIFT) for c in wide)
    return F.translate(s, wide + "　、", narrow + " ,")


def remove_spaces(s: Column) -> Column:
    """No blanks beside CJK characters, one blank after a mark, one between digits and letters."""
    rules = [
        (f"(?<={CJK})\\s+(?=[一-鿿a-zA-Z0-9])", ""),
        (f"(?<=[a-zA-Z0-9])\\s+(?={CJK})", ""),
        (r"(?<![0-9])\s*([,.!?:;])\s*", "$1 "),
        (r"(?<=[0-9])(?=[a-zA-Z])|(?<=[a-zA-Z])(?=[0-9])", " "),
        (r"\s+", " "),
    ]
    return reduce(lambda out, rule: F.regexp_replace(out, *rule), rules, s)


def clean_markdown(s: Column) -> Column:
    """No code fences; long runs of blanks, underscores or other marks cut to four."""
    out = F.regexp_replace(s, r"(?m)^```markdown\n?", "")
    out = F.regexp_replace(out, r"(?m)```\n?$", "")
    out = F.regexp_replace(out, "_{4,}", "____")
    out = F.regexp_replace(out, " {4,}", "    ")
    return F.regexp_replace(out, r"([^a-zA-Z0-9])\1{10,}", "$1$1$1$1")


def clean_string(s: Column) -> Column:
    """Word characters and CJK only; tabs and newlines go, escaped ones too."""
    out = F.regexp_replace(s, r"\\t|\\n|\t|\n|/t|/n", "")
    return F.regexp_replace(out, "[^a-zA-Z0-9_一-鿿]", "")


def has_cjk(s: Column) -> Column:
    return s.rlike(CJK)


def options_map(df_columns: list[str], labels: list[str]) -> Column:
    """Map label -> text of the options that are present."""
    pairs = [x for c in labels if c in df_columns for x in (F.lit(c), F.col(c))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def option_string(options: Column) -> Column:
    lines = F.transform(F.map_entries(options), lambda e: F.concat(e.key, F.lit(". "), e.value, F.lit("\n")))
    return F.concat(F.lit("There are several options: \n"), F.array_join(lines, ""))


def prompt_mcq(question: Column, options: Column, hint: Column | None = None) -> Column:
    """Question, optional hint and options as one prompt text."""
    lines = F.array_join(
        F.transform(F.map_entries(options), lambda e: F.concat(e.key, F.lit(". "), e.value, F.lit("\n"))), ""
    )
    head = F.lit("") if hint is None else F.when(hint.isNotNull(), F.concat(F.lit("Hint: "), hint, F.lit("\n"))).otherwise("")
    tail = F.when(
        F.size(options) > 0,
        F.concat(F.lit("Options:\n"), lines, F.lit("Please select the correct answer from the options above. \n")),
    ).otherwise("")
    return F.concat(head, F.lit("Question: "), question, F.lit("\n"), tail)


def prompt_translation(question: Column, answer: Column, source: str, target: str) -> Column:
    """Message that asks for a translated question and answer in two labelled lines."""
    head = (
        f"Translate the question and the answer from {source} to {target}.\n"
        "Reply in two lines, 'Question: ...' and 'Answer: ...'.\n"
    )
    return F.concat(F.lit(head), F.lit("Question: "), question, F.lit("\nAnswer: "), answer)


#: labels of the judge prompt: question, ground truth, prediction, verdict, reason, rule for lists, request
JUDGE_LABELS = {
    "en": ("Question: ", "Ground truth: ", "Prediction: ", "Verdict: ", "Reason: ",
           "The ground truth is a list: a right prediction names everything in it and nothing else.",
           "Is the prediction right? Reply yes or no."),
    "cn": ("问题：", "标准答案：", "预测：", "判断：", "理由：", "标准答案是一个列表：预测须包含且仅包含其中全部内容。", "预测正确吗？请回答 yes 或 no。"),
}
# Answer types whose brackets are part of a single answer.
BRACKETS_STAY = ["exactMatch", "multipleChoice"]


def answer_list(answer: Column, answer_type: Column | None = None) -> Column:
    """Answers of a text: its elements when it is written as a list, else itself; null for a null.

    Brackets of the types in ``BRACKETS_STAY`` are text, and so is a list that cannot be read.
    """
    written = answer.startswith("[") & answer.endswith("]")
    if answer_type is not None:
        written &= ~F.coalesce(answer_type.isin(BRACKETS_STAY), F.lit(False))
    return F.coalesce(F.when(written, F.from_json(answer, "array<string>")), F.when(answer.isNotNull(), F.array(answer)))


def judge_examples(examples: Sequence[Mapping[str, str]], language: str = "en") -> str:
    """Worked examples (question, answer, prediction, correctness, reason) as the head of a judge prompt."""
    fields = ("question", "answer", "prediction", "correctness", "reason")
    return "".join("\n".join(label + example[f] for label, f in zip(JUDGE_LABELS[language], fields)) + "\n\n" for example in examples)


def prompt_judge(
    question: Column, answer: Column, prediction: Column, examples: Mapping[str, Sequence[Mapping[str, str]]] | None = None,
    answer_type: Column | None = None,
) -> Column:
    """Judge prompt; the language follows the question, the form whether the answer lists several.

    ``examples`` holds worked examples by form: ``en_single``, ``en_multi``, ``cn_single``, ``cn_multi``.
    A list of one is shown as its element, and a list of none as written. Null in any text gives null.
    """
    def form(language: str, many: bool, truth: Column) -> Column:
        ask, given, said, _, _, rule, request = JUDGE_LABELS[language]
        head = judge_examples((examples or {}).get(f"{language}_{'multi' if many else 'single'}", ()), language)
        tail = f"\n{rule}\n{request}" if many else f"\n{request}"
        return F.concat(F.lit(head + ask), question, F.lit("\n" + given), truth, F.lit("\n" + said), prediction, F.lit(tail))

    def both(truth: Column) -> Column:
        listed = lambda language: F.when(F.size(truth) > 1, form(language, True, F.to_json(truth))).otherwise(
            form(language, False, F.when(F.size(truth) == 1, truth[0]).otherwise(answer)))
        return F.when(has_cjk(question), listed("cn")).otherwise(listed("en"))

    return bound(answer_list(answer, answer_type), both)


def is_failure(prediction: Column) -> Column:
    return prediction.contains(fixed.FAILURE_TEXT)


def is_refusal(prediction: Column) -> Column:
    low = F.lower(prediction)
    spoken = [prediction.contains(p) for p in ("I can't", "I cannot", "无法", "抱歉")]
    return reduce(lambda a, b: a | b, spoken, low.contains("sorry"))


def valid_criteria(rubric: Column) -> Column:
    """Every value non-empty, not a lone backslash and holding a Latin letter."""
    return F.forall(F.map_values(rubric), lambda v: (v != "") & (v != "\\") & v.rlike("[a-zA-Z]"))


def reads_as_letters(option: Column) -> Column:
    """True for bare letters, pairs of letters and the stock non-answers."""
    stock = option.isin("{}", "Both", "None of above")
    tokens = words(strip_punctuation(F.regexp_replace(option, "^Stage ", "")))
    short = F.forall(tokens, lambda w: (F.length(w) <= 2) | (w == "and"))
    return stock | (F.length(option) <= 2) | short


def mostly_letters(options: Column, at_least: int = 3) -> Column:
    return F.size(F.filter(options, reads_as_letters)) >= at_least


def holds_bare_letter(question: Column) -> Column:
    return F.exists(words(strip_punctuation(question)), lambda w: w.rlike("^[A-Za-z]$"))
