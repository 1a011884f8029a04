"""Row metrics: prediction and ground truth in, score out, as Column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.text import as_float, bound, clean_doc_string, normalise_answer, words


def flag(c: Column) -> Column:
    """1.0 / 0.0, with an undecidable comparison counted as a miss."""
    return F.when(c, 1.0).otherwise(0.0)


def mean_of(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


# -- strings -----------------------------------------------------------------------------------


def exact_hit(prediction: Column, answer: Column) -> Column:
    return F.when(F.upper(F.trim(prediction)) == F.upper(F.trim(answer)), 1).otherwise(0)


def vqa_references(answers: Column) -> Column:
    """References normalised as ``vqa_score`` compares them: once an item, before its replies are joined."""
    return F.transform(answers, normalise_answer)


def vqa_score(prediction: Column, answers: Column, normalised: bool = False) -> Column:
    """Mean over references of min(1, other references equal to the prediction / 3).

    ``normalised``: the references come from ``vqa_references``.
    """
    references = answers if normalised else vqa_references(answers)

    def score(equal: Column) -> Column:
        others = lambda hits: mean_of(F.transform(equal, lambda e: F.least(F.lit(1.0), (hits - e) / 3.0)))
        return bound(sum_of(equal), others)

    equal = lambda pred: F.transform(references, lambda r: flag(r == pred))
    return bound(bound(normalise_answer(prediction), equal), score)


def any_equal(prediction: Column, answers: Column, normalise: bool = True, how: str = "max") -> Column:
    """Equality with each reference after normalisation or plain lower/trim; max or mean."""
    clean = normalise_answer if normalise else lambda s: F.lower(F.trim(s))
    hits = bound(clean(prediction), lambda pred: F.transform(answers, lambda r: flag(clean(r) == pred)))
    return F.array_max(hits) if how == "max" else bound(hits, mean_of)


def relaxed_accuracy(prediction: Column, answers: Column, tolerance: float = 0.05, legacy: bool = True) -> Column:
    """Numbers within a relative tolerance, else equal text; best over the references.

    ``legacy`` divides by the prediction, as scores published so far do; otherwise by the reference.
    """

    def number(s: Column) -> Column:
        percent = as_float(F.rtrim(s, F.lit("%"))) / 100.0
        return F.when(s.endswith("%"), percent).otherwise(as_float(s))

    side = lambda s: F.struct(s.alias("text"), number(s).alias("value"))

    def against(pred: Column) -> Column:
        def one(ref: Column) -> Column:
            target, other = (pred, ref) if legacy else (ref, pred)
            usable = target["value"].isNotNull() & other["value"].isNotNull() & (target["value"] != 0)
            close = F.abs(other["value"] - target["value"]) / F.abs(target["value"]) <= tolerance
            return flag(F.when(usable, close).otherwise(F.lower(target["text"]) == F.lower(other["text"])))

        return F.array_max(F.transform(F.transform(answers, side), one))

    return bound(side(F.trim(prediction)), against)


def anls(prediction: Column, answers: Column, threshold: float = 0.5) -> Column:
    """1 - smallest edit distance over the longer *raw* length; 0 below the threshold."""
    squeeze = lambda s: F.array_join(words(F.lower(s)), " ")
    costs = bound(squeeze(prediction), lambda pred: F.transform(answers, lambda r: F.coalesce(
        F.try_divide(F.levenshtein(squeeze(r), pred), F.greatest(F.length(r), F.length(prediction))), F.lit(0.0))))
    return bound(1.0 - F.array_min(costs), lambda v: F.when(v < threshold, 0.0).otherwise(v))


def anls_doc(truth: Column, prediction: Column, threshold: float = 0.5) -> Column:
    longest = F.greatest(F.length(truth), F.length(prediction))
    value = 1.0 - F.coalesce(F.try_divide(F.levenshtein(truth, prediction), longest), F.lit(0.0))
    return bound(value, lambda v: F.when(v <= threshold, 0.0).otherwise(v))


def float_equal(reference: Column, prediction: Column) -> Column:
    """Equal to the reference, a hundredth or a hundredfold of it, by 1 % or by rounding."""

    def digits(x: Column) -> Column:
        return F.length(F.split_part(x.cast("string"), F.lit("."), F.lit(2)))

    def one(item: Column, said: Column) -> Column:
        close = F.abs(item - said) <= 0.01 * F.greatest(F.abs(item), F.abs(said))
        scale = F.pow(F.lit(10.0), F.greatest(F.least(digits(said), digits(item)), F.lit(2)))
        return close | (F.rint(said * scale) == F.rint(item * scale))

    forms = F.array(reference / 100.0, reference, reference * 100.0)
    return F.coalesce(bound(prediction, lambda said: F.exists(forms, lambda item: one(item, said))), F.lit(False))


# Shapes of answers that only count when identical.
EXACT_SHAPES = "|".join([
    r"https://",
    r"\.py$",
    r"ipynb$",
    r"^page",
    r"^\d+(-\d+|\s\d+)?$",
    r"a\.m\.",
    r"p\.m\.",
    r"^\d{4}[-\s]\d{2}[-\s]\d{2}$",
    r"^\d{4}[-\s]\d{2}$",
    r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
])


def typed_doc_score(truth: Column, prediction: Column, kind: Column, parse_list) -> Column:
    """Score by answer type: Int, Float, Str, or a list compared in sorted order."""
    integer = F.trim(truth).try_cast("bigint") == as_float(prediction).try_cast("bigint")
    cleaned = F.struct(clean_doc_string(truth).alias("t"), clean_doc_string(prediction).alias("p"))
    number = bound(cleaned, lambda c: float_equal(as_float(c["t"]), as_float(c["p"])))
    text = bound(cleaned, lambda c: F.when(c["t"].rlike(EXACT_SHAPES), flag(c["t"] == c["p"])).otherwise(anls_doc(c["t"], c["p"])))

    def lists(c: Column) -> Column:
        ts, ps = c["t"], c["p"]
        exact = ts[0].rlike(EXACT_SHAPES) | as_float(ts[0]).isNotNull()
        return F.when(F.size(ts) != F.size(ps), 0.0).when(
            exact, flag(F.array_join(ts, "-") == F.array_join(ps, "-"))
        ).otherwise(F.array_min(F.zip_with(ts, ps, lambda a, b: anls_doc(a, b))))

    ordered = lambda s: F.array_sort(F.transform(parse_list(s), clean_doc_string))
    listed = bound(F.struct(ordered(truth).alias("t"), ordered(prediction).alias("p")), lists)
    return (
        F.when(kind == "Int", flag(integer)).when(kind == "Float", flag(number)).when(kind == "Str", text).otherwise(listed)
    )


def parse_list(s: Column) -> Column:
    """A list written as text; anything unreadable becomes one element."""
    parsed = F.from_json(s, "array<string>")
    return F.coalesce(F.when(s.startswith("["), parsed), F.array(s))


def bag_f1(truth: Column, prediction: Column) -> Column:
    gold, said = words(truth), words(prediction)
    shared = F.size(F.filter(said, lambda w: F.array_contains(gold, w)))
    recall, precision = F.try_divide(shared, F.size(gold)), F.try_divide(shared, F.size(said))
    both = recall + precision
    return F.when(both > 1e-4, 2 * recall * precision / both).otherwise(0.0)


def contains_answer(prediction: Column, answers: Column, drop: str = "") -> Column:
    """1 when any answer occurs in the reply, case ignored, after removing ``drop`` characters."""
    clean = lambda s: F.translate(F.lower(s), drop, "")
    return F.when(F.exists(answers, lambda a: F.contains(clean(prediction), clean(a))), 1).otherwise(0)


def reciprocal_rank(prediction: Column, answers: Column) -> Column:
    """1 / position of the first reference standing as whole words in the reply, else 0."""
    whole = lambda a: F.concat(F.lit(" "), F.regexp_replace(normalise_answer(a), r"\W", " "), F.lit(" "))
    inside = lambda text: F.array_position(F.transform(answers, lambda a: F.contains(text, whole(a))), F.lit(True))
    return bound(bound(whole(prediction), inside), lambda spot: F.when(spot > 0, 1.0 / spot).otherwise(0.0))


def string_exact(response: Column, answer: Column) -> Column:
    """Equality; a one-letter answer is compared with the letter the reply opens with."""
    letter = F.regexp_extract(response, r"^\(?([A-Za-z])\)?", 1)
    reply = F.when(answer.rlike("^[A-Za-z]$") & (F.length(response) > 1) & (letter != ""), letter).otherwise(response)
    return F.when(reply == answer, 1).otherwise(0)


def string_exact_ignore_case(response: Column, answer: Column) -> Column:
    return F.when(F.lower(response) == F.lower(answer), 1).otherwise(0)


def string_simple(response: Column, answer: Column) -> Column:
    bare = lambda s: F.lower(F.translate(s, " -\n\t.", ""))
    return string_exact(bare(response), bare(answer))


def string_any_reference(response: Column, answers: Column) -> Column:
    return F.when(F.exists(answers, lambda a: string_simple(response, a) == 1), 1).otherwise(0)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return 1.0 - F.coalesce(F.try_divide(F.levenshtein(a, b), longest), F.lit(0.0))


def _transposing_distance(a: str, b: str) -> int:
    """Edit distance that also counts a swap of neighbours as one step, edits between them allowed."""
    limit = len(a) + len(b)
    table = [[limit] * (len(b) + 2) for _ in range(len(a) + 2)]
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        table[i + 1][1] = i
        match = 0
        for j, y in enumerate(b, 1):
            row, col = seen.get(y, 0), match
            if x == y:
                match = j
            table[i + 1][j + 1] = min(
                table[i][j] + (x != y), table[i + 1][j] + 1, table[i][j + 1] + 1, table[row][col] + (i - row - 1) + 1 + (j - col - 1))
        seen[x] = i
    return table[-1][-1]


def transposing_similarity(a: Column, b: Column) -> Column:
    """Edit similarity with transpositions, in Arrow batches; for short answers."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        rate = lambda p, q: None if p is None or q is None else 1.0 - _transposing_distance(p, q) / max(len(p), len(q), 1)
        return pd.Series([rate(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(batch, "double")(a, b)


def near_match(a: Column, b: Column, cutoff: float = 0.9, similarity=edit_similarity) -> Column:
    """Edit similarity without articles and accents; zero below the cutoff."""
    accents, plain = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    fold = lambda s: F.translate(F.regexp_replace(F.lower(s), r"\b(a|an|the)\b\s*", ""), accents, plain)
    value = similarity(fold(a), fold(b))
    return F.when(value >= cutoff, value).otherwise(0.0)


# -- numbers -----------------------------------------------------------------------------------


def ratio_within(prediction: Column, truth: Column, limit: float) -> Column:
    p, g = prediction + 1e-8, truth + 1e-8
    return F.when(F.greatest(p / g, g / p) < limit, 1).otherwise(0)


def mean_relative_accuracy(prediction: Column, truth: Column) -> Column:
    """Share of the thresholds 0.05, 0.10 … 0.50 that the relative error stays under."""
    error = F.abs(truth - prediction) / F.nullif(truth, F.lit(0.0))
    return reduce(lambda a, b: a + b, [flag(error < t / 100.0) for t in range(5, 51, 5)]) / 10.0


def count_score(prediction: Column, truth: Column, length: Column) -> Column:
    """100 for the right count, else 100 * (1 - 4 / length * relative error ^ 0.1), floor 0."""
    miss = F.abs(prediction - truth)
    worst = F.greatest(truth - 1, length - truth, F.lit(1))
    penalty = 4.0 / length * F.pow(miss / worst, F.lit(0.1))
    return F.when(miss == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 * (1.0 - F.coalesce(penalty, F.lit(1.0)))))


def linear_decay(prediction: Column, truth: Column, span: float = 0.5) -> Column:
    """1 at the truth falling to 0 at ``span`` away; -1 without a prediction."""
    score = F.greatest(F.lit(0.0), (span - F.abs(truth - prediction)) / span)
    return F.when(prediction.isNull(), -1.0).otherwise(score)


def relative_difference(prediction: Column, truth: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs(F.try_divide(prediction - truth, truth))), F.lit(0.0))


def squared_error(prediction: Column, truth: Column) -> Column:
    return (prediction - truth) * (prediction - truth)


def clipped_error(prediction: Column, truth: Column, limit: float = 0.1) -> Column:
    return 1.0 - F.least(F.abs(prediction - truth), F.lit(limit)) / limit


def sequence_error(predictions: Column, truths: Column, limit: float = 10.0) -> Column:
    """1 - mean absolute difference clipped at ``limit``; 0 for unequal lengths."""
    gap = F.try_divide(sum_of(F.zip_with(predictions, truths, lambda p, t: F.abs(p - t))), F.size(truths))
    value = 1.0 - F.least(gap, F.lit(limit)) / limit
    return F.when(F.size(predictions) == F.size(truths), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def positive_int_match(prediction: Column, truth: Column) -> Column:
    """-1 (not applicable) when neither side is positive, else equality."""
    return F.when(prediction.isNull() | truth.isNull(), 0).when((prediction <= 0) & (truth <= 0), -1).otherwise(
        F.when(prediction == truth, 1).otherwise(0))


def within_one_percent(prediction: Column, truth: Column) -> Column:
    return F.coalesce(F.abs(prediction - truth) <= F.abs(truth) * 0.01, F.lit(False))


def strip_units(s: Column) -> Column:
    """Number text without currency, degrees and LaTeX wrappers; a percent sign divides by 100."""
    bare = F.regexp_replace(s, r"\\text\{[^}]*\}|[$¥]|°C?| C\b|,", "")
    value = as_float(F.replace(bare, F.lit("%"), F.lit("")))
    return F.when(bare.contains("%"), value / 100.0).otherwise(value)


def numbers_equal(prediction: Column, truth: Column, tolerance: float = 1e-6) -> Column:
    """Equal text, or numeric values closer than ``tolerance``."""
    close = F.abs(as_float(prediction) - as_float(truth)) < tolerance
    return F.coalesce((F.lower(F.trim(prediction)) == F.lower(F.trim(truth))) | F.coalesce(close, F.lit(False)), F.lit(False))


def number_lists_equal(predictions: Column, truths: Column) -> Column:
    pairs = F.zip_with(F.array_sort(predictions), F.array_sort(truths), within_one_percent)
    return (F.size(predictions) == F.size(truths)) & F.forall(pairs, lambda x: x)


def rubric_bucket(score: Column) -> Column:
    """A judge's 0..1 score as 1, 3 or 5; missing counts 0."""
    raw = score * 5
    return F.when(raw.isNull(), 0).when(raw <= 2, 1).when(raw <= 4, 3).otherwise(5)


# -- boxes, points, places -----------------------------------------------------------------------


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))])


def box_iou(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    shared = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    union = area(a) + area(b) - shared
    return F.when(a["x1"].isNull() | b["x1"].isNull(), F.lit(None)).when(union > 0, shared / union).otherwise(0.0)


def point_in_box(x: Column, y: Column, b: Column) -> Column:
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def center_in_box(a: Column, b: Column) -> Column:
    return point_in_box((a["x1"] + a["x2"]) / 2, (a["y1"] + a["y2"]) / 2, b)


def corners_from_size(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """(x, y, w, h) in pixels to corners in 0..1; a corner at -1 counts as 0."""
    safe = lambda v: F.when(v == -1, 0).otherwise(v)
    return box(safe(x) / width, safe(y) / height, safe(x + w - 1) / width, safe(y + h - 1) / height)


def point_hit(x: Column, y: Column, b: Column, width: Column, height: Column) -> Column:
    """Point in box, a point beyond 1 being normalised by the image size first."""
    pixels = (x > 1) | (y > 1)
    px, py = F.when(pixels, x / width).otherwise(x), F.when(pixels, y / height).otherwise(y)
    return point_in_box(px, py, b)


def best_match_iou(predictions: Column, truths: Column) -> Column:
    """Mean over predicted boxes of the best IoU with any target; 0 for none."""
    best = F.transform(predictions, lambda p: F.coalesce(F.array_max(F.transform(truths, lambda g: box_iou(p, g))), F.lit(0.0)))
    return F.coalesce(bound(best, mean_of), F.lit(0.0))


def positionwise_iou(predictions: Column, truths: Column) -> Column:
    value = mean_of(F.zip_with(predictions, truths, box_iou))
    return F.when(F.size(predictions) == F.size(truths), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum_of(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def keypoint_similarity(predictions: Column, truths: Column, k: float = 10.0) -> Column:
    """Mean of exp(-k * distance / sqrt 2) over positions; 0 when the counts differ."""
    each = F.zip_with(predictions, truths, lambda p, t: F.exp(
        -k * F.sqrt((p["x"] - t["x"]) * (p["x"] - t["x"]) + (p["y"] - t["y"]) * (p["y"] - t["y"])) / (2.0 ** 0.5)))
    return F.when(F.size(predictions) == F.size(truths), mean_of(each)).otherwise(0.0)


def geo_proximity(lat1: Column, lon1: Column, lat2: Column, lon2: Column, k: float = 100.0) -> Column:
    """exp(-km / k) by the great-circle distance."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    km = 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
    return F.exp(-km / k)


# -- sets, sequences, maps -----------------------------------------------------------------------


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(F.try_divide(part, whole))


def jaccard(a: Column, b: Column) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def set_precision(prediction: Column, truth: Column) -> Column:
    return _share(F.size(F.array_intersect(prediction, truth)), F.size(F.array_distinct(prediction)))


def set_recall(prediction: Column, truth: Column) -> Column:
    return _share(F.size(F.array_intersect(prediction, truth)), F.size(F.array_distinct(truth)))


def set_equal(a: Column, b: Column, ignore_case: bool = False) -> Column:
    fold = (lambda x: F.transform(x, F.upper)) if ignore_case else (lambda x: x)
    same = F.array_sort(F.array_distinct(fold(a))) == F.array_sort(F.array_distinct(fold(b)))
    return F.when(same, 1).otherwise(0)


def sequence_equal(a: Column, b: Column, ignore_case: bool = False) -> Column:
    fold = (lambda x: F.transform(x, F.lower)) if ignore_case else (lambda x: x)
    return F.when(fold(a) == fold(b), 1).otherwise(0)


def sequence_accuracy(prediction: Column, truth: Column) -> Column:
    """Share of equal positions, case ignored; 0 for unequal lengths."""
    hits = F.zip_with(prediction, truth, lambda p, t: flag(F.lower(p) == F.lower(t)))
    return F.when(F.size(prediction) == F.size(truth), F.coalesce(mean_of(hits), F.lit(0.0))).otherwise(0.0)


def common_prefix_ratio(prediction: Column, truth: Column) -> Column:
    differs = F.zip_with(prediction, truth, lambda p, t: F.coalesce(p != t, F.lit(True)))
    first = F.array_position(differs, F.lit(True))
    length = F.when(first == 0, F.size(truth)).otherwise(first - 1)
    return F.try_divide(length, F.size(truth))


def sorted_equal(a: Column, b: Column) -> Column:
    return F.when(F.array_sort(a) == F.array_sort(b), 1).otherwise(0)


def map_equal(prediction: Column, truth: Column) -> Column:
    pairs = lambda m: F.array_sort(F.map_entries(m))
    return F.when(pairs(prediction) == pairs(truth), 1).otherwise(0)


def map_precision(prediction: Column, truth: Column) -> Column:
    """Share of predicted keys whose value matches exactly; 0 for no keys."""
    hits = F.transform(F.map_keys(prediction), lambda k: F.coalesce(
        string_exact(F.try_element_at(prediction, k), F.try_element_at(truth, k)).cast("double"), F.lit(0.0)))
    return F.coalesce(mean_of(hits), F.lit(0.0))


def map_recall(prediction: Column, truth: Column) -> Column:
    hits = F.transform(F.map_keys(truth), lambda k: F.coalesce(
        string_exact(F.try_element_at(prediction, k), F.try_element_at(truth, k)).cast("double"), F.lit(0.0)))
    return mean_of(hits)


def map_union_mean(prediction: Column, truth: Column, score, empty: Column) -> Column:
    """Mean of a value score over the union of keys; an absent value counts as ``empty``."""
    keys = F.array_union(F.map_keys(prediction), F.map_keys(truth))
    value = lambda m, k: F.coalesce(F.try_element_at(m, k), empty)
    return mean_of(F.transform(keys, lambda k: score(value(prediction, k), value(truth, k)).cast("double")))


# -- table answers -------------------------------------------------------------------------------


def denotation_match(prediction: Column, truth: Column) -> Column:
    """``|``-separated values as sets: same count, every target met by text, number or date."""

    def values(s: Column) -> Column:
        norm = lambda x: F.trim(F.lower(F.regexp_replace(x, r"\s+", " ")))
        return F.array_distinct(F.transform(F.split(F.replace(s, F.lit("||"), F.lit("|")), r"\|"), norm))

    day = lambda s: F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s.try_cast("date"))

    def same(t: Column, p: Column) -> Column:
        close = F.coalesce(F.abs(as_float(t) - as_float(p)) < 1e-6, F.lit(False))
        return (t == p) | close | F.coalesce(day(t) == day(p), F.lit(False))

    ts, ps = values(truth), values(prediction)
    return F.when((F.size(ts) == F.size(ps)) & F.forall(ts, lambda t: F.exists(ps, lambda p: same(t, p))), 1).otherwise(0)


# Unit words removed from table answers.
TABLE_UNITS = [
    "dollar", "gallons", "square feet", "shares", "mbtu", "mbpd", "mbbls", "mmbtu", "unit", "gwh",
    "year", "mmcf", "mile", "mboe",
]
# Scale words and their exponents.
TABLE_SCALES = [(" ?\\bthousand\\b", "e3"), (" ?\\bmillion\\b", "e6"), (" ?\\bbillion\\b", "e9"), (" ?%", "e-2")]


def table_number_forms(s: Column) -> Column:
    """struct(exact, variants): the answer with and without its scale word, numbers as numbers."""
    bare = F.regexp_replace(F.trim(F.lower(s)), r"[$(),]", "")
    bare = F.regexp_replace(bare, r"(?i)\b(" + "|".join(TABLE_UNITS) + r")s?\b", "")
    scaled = reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), TABLE_SCALES, bare)
    unscaled = reduce(lambda x, r: F.regexp_replace(x, r[0], ""), TABLE_SCALES, bare)
    canonical = lambda x: F.coalesce(as_float(x).cast("string"), x)
    return F.struct(canonical(scaled).alias("exact"), F.array(canonical(scaled), canonical(unscaled)).alias("variants"))


def true_false_score(prediction: Column, truth: Column) -> Column:
    """1/0 for true/false against '1'/'0'; null when the reply says both."""
    low = F.lower(F.coalesce(prediction, F.lit("none")))
    yes, no = low.contains("true"), low.contains("false")
    return F.when(yes & no, F.lit(None)).when((yes & (truth == "1")) | (no & (truth == "0")), 1).otherwise(0)


# -- intervals inside a row ----------------------------------------------------------------------


def merge_spans(spans: Column) -> Column:
    """Sorted spans with overlapping or touching ones merged."""
    kind = "array<struct<start:double,end:double>>"

    def step(acc: Column, s: Column) -> Column:
        tail = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                         F.array(F.struct(tail["start"].alias("start"), F.greatest(tail["end"], s["end"]).alias("end"))))
        fresh = F.concat(acc, F.array(s))
        return F.when((F.size(acc) > 0) & (s["start"] <= tail["end"]), grown).otherwise(fresh).cast(kind)

    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), step)


def interval_iou(a: Column, b: Column) -> Column:
    """Overlap of the merged spans over the length of their union."""
    length = lambda spans: sum_of(F.transform(spans, lambda s: s["end"] - s["start"]))

    def score(sides: Column) -> Column:
        shared = sum_of(F.transform(sides["a"], lambda x: sum_of(F.transform(sides["b"], lambda y: F.greatest(
            F.lit(0.0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))))))
        total = length(sides["a"]) + length(sides["b"])
        return bound(shared, lambda s: F.when(total - s > 0, s / (total - s)).otherwise(0.0))

    return bound(F.struct(merge_spans(a).alias("a"), merge_spans(b).alias("b")), score)
