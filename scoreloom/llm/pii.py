"""Personal data: fixed shapes as seeds, and identifiers of other shapes found by their contexts.

All of it is DataFrame work. A text is cut at the matches of a shape; lengths of the pieces give the
matches' places in code points, whatever the length of the text. The shapes' valid matches are the
base spans. Contexts of the base spans (two words before, or the word before and the word after) are
patterns; other tokens with a digit, ``@`` or ``[at]`` in the same contexts are instances. Words are cut
at white space, commas, semicolons and bars, and are never shortened; words of base spans are stepped
over, so all entries of a list share the context of the list. Patterns and instances form a bipartite
graph that is scored in turns: a pattern's score for a kind is the shrunken mean score of its instances,
an instance's is the noisy-or of its patterns; seeds keep 1. Instances of a plausible shape whose score
passes ``MIN_INSTANCE`` through patterns with at least ``MIN_SEEDS`` different seeds and ``MIN_PATTERN``
score are spans too, wherever they occur.

Instances are tokens and, for numbers written in parts, sequences of tokens one space apart that hold 7
to 19 digits, no letter, and no token that is long enough by itself: ``555-0199-22 2024`` offers its
first token, ``555 0199 22`` itself. Accepted instances that overlap make one span. A token that a base
span touches belongs to that span and is no instance.

Matching is written so that no expression recurses or backtracks over long texts: loops are possessive,
and a run of characters is only tried from its start. Null and empty texts have no spans; rows with
equal or null ids are rows of their own; an empty table gives an empty result; extra columns are not
read. The pairs of a graph are distinct, so copies add no weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import stored, whole_text

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
#: leftmost non-overlapping matches of the four shapes; a card's shape holds its number of digits
SHAPES = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without a match of its kind's hint is not searched for that kind
HINTS = {"email": "@", "ip": r"\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
AT = r"[\[(][aA][tT][\])]"
#: what parts words
GAP, WORD = r"[\s,;|]", r"[^\s,;|]"
#: words that hold a digit, an at sign or its written form
TOKEN = rf"(?<!{WORD}){WORD}*(?:[0-9@]|{AT}){WORD}*+"
ANY_HINT = rf"[0-9@]|{AT}"
LAST_WORD = rf"(?<!{WORD})({WORD}++){GAP}++\z"
LAST_BUT_ONE = rf"(?<!{WORD})({WORD}++){GAP}++{WORD}++{GAP}++\z"
FIRST_WORD = rf"\A{GAP}*+({WORD}++)"
#: digits of a number written in several words
FEWEST_DIGITS, MOST_DIGITS = 7, 19
ROUNDS = 3
MIN_SEEDS = 3
MIN_PATTERN = 0.5
MIN_INSTANCE = 0.5
TAGS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


PIECE = "struct<kind:string,gap:bigint,value:string,spaced:boolean,l2:string,l1:string,r1:string>"


def _word(text: Column, pattern: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(""))


def _gap_words(gap: Column) -> list[Column]:
    """Last word but one, last word and first word between two tokens, null where there is none."""
    # the last 80 characters do if they hold two whole words; else all of the gap is looked at
    near = F.right(gap, F.lit(80))
    end = F.when(near.rlike(GAP + WORD + "++" + GAP + "++" + WORD + "++" + GAP + r"++\z"), near).otherwise(gap)
    return [_word(end, LAST_BUT_ONE).alias("l2"), _word(end, LAST_WORD).alias("l1"), _word(gap, FIRST_WORD).alias("r1")]


def _cut(text: Column, name: str, shape: str, hint: str) -> Column:
    """(kind, gap, value, ..) for every match of ``shape``, and a last one without value; tokens with the words of the gap before."""
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(shape), F.lit(0)).alias("value"), F.split(text, shape, -1).alias("gap"))
    none = [F.lit(None).cast("string").alias(c) for c in ("l2", "l1", "r1")]
    slim = F.transform(
        pieces,
        lambda p: F.struct(
            F.lit(name).alias("kind"), F.length(p["gap"]).cast("bigint").alias("gap"), p["value"].alias("value"), (p["gap"] == " ").alias("spaced"),
            *(_gap_words(p["gap"]) if name == "token" else none),
        ),
    )
    return F.when(text.rlike(hint), slim).otherwise(F.array().cast(f"array<{PIECE}>"))


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    odd = lambda i: (F.length(digits) - i) % 2 == 1
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(odd(i), doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", _luhn(digits)).when(kind == "phone", F.length(digits).between(8, 15))
    )


def pieces(docs: DataFrame) -> DataFrame:
    """One row per match and per searched text: (rid, doc_id, text_hash, kind, start, end, value, spaced, l2, l1, r1), stored.

    Rows of the kind ``text`` stand for the searched texts themselves. ``l2``, ``l1`` and ``r1`` are the words
    between a token and the tokens next to it.
    """
    text = F.col("text")
    searched = docs.select("doc_id", whole_text().alias("text")).filter(text.rlike(ANY_HINT)).withColumn("rid", F.monotonically_increasing_id())
    mark = F.array(
        F.struct(F.lit("text").alias("kind"), F.lit(0).cast("bigint").alias("gap"), F.lit("").alias("value"), F.lit(False).alias("spaced"),
                 *[F.lit(None).cast("string").alias(c) for c in ("l2", "l1", "r1")]))
    cuts = F.concat(mark, *[_cut(text, k, SHAPES[k], HINTS[k]) for k in KINDS], _cut(text, "token", TOKEN, ANY_HINT))
    rows = searched.select("rid", "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(cuts).alias("i", "p")).select("rid", "doc_id", "text_hash", "i", "p.*")
    rows = stored(rows, "pii-pieces")
    over = Window.partitionBy("rid", "kind").orderBy("i")
    length = F.coalesce(F.length("value"), F.lit(0)).cast("bigint")
    end = F.sum(F.col("gap") + length).over(over)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - length).withColumn("r1", F.lead("r1").over(over)).filter("value IS NOT NULL")
    return placed.select("rid", "doc_id", "text_hash", "kind", "start", "end", "value", "spaced", "l2", "l1", "r1")


def _in_context(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens with ``hit`` (touched by a base span) and the nearest words around them that are in no base span."""
    names = ["rid", "doc_id", "text_hash", "start", "end", "value", "spaced", "l2", "l1", "r1"]
    marks = base.select(*[F.col(c) if c in ("rid", "start", "end") else F.lit(None).cast(t).alias(c) for c, t in tokens.select(*names).dtypes], F.lit(True).alias("mark"))
    both = tokens.select(*names, F.lit(False).alias("mark")).unionByName(marks)
    so_far = lambda order: Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    forth, back = so_far([F.asc("start"), F.desc("mark")]), so_far([F.desc("start"), F.desc("mark")])
    reach, following = F.max(F.when(F.col("mark"), F.col("end"))).over(forth), F.min(F.when(F.col("mark"), F.col("start"))).over(back)
    touched = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    rows = both.withColumn("hit", touched).filter(~F.col("mark")).drop("mark")
    # the words each token adds to those before it: the token before, then the words of the gap
    order = Window.partitionBy("rid").orderBy("start")
    forth, back = so_far([F.asc("start")]), so_far([F.desc("start")])
    own = F.when(~F.col("hit"), F.lower("value"))
    rows = rows.withColumn("_c", F.array_compact(F.array(F.lag(own).over(order), F.col("l2"), F.col("l1")))).withColumn("_next", F.coalesce(F.col("r1"), F.lead(own).over(order)))
    last = F.element_at("_c", -1)
    rows = rows.withColumn("_last", F.when(F.size("_c") > 0, last)).withColumn("_earlier", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    pair = F.when(F.size("_c") > 0, F.struct(F.when(F.size("_c") > 1, F.element_at("_c", -2)).otherwise(F.col("_earlier")).alias("l2"), F.col("_last").alias("l1")))
    rows = rows.withColumn("_pair", pair).withColumn("_pair", F.last("_pair", ignorenulls=True).over(forth)).withColumn("r1", F.last("_next", ignorenulls=True).over(back))
    return rows.withColumn("l2", F.col("_pair.l2")).withColumn("l1", F.col("_pair.l1")).drop("_c", "_next", "_last", "_earlier", "_pair")


def _patterns() -> Column:
    found = F.array(
        F.when(F.col("l1").isNotNull() & F.col("l2").isNotNull(), F.concat(F.lit("before "), "l2", F.lit(" "), "l1")),
        F.when(F.col("l1").isNotNull() & F.col("r1").isNotNull(), F.concat(F.lit("around "), "l1", F.lit(" "), "r1")),
    )
    return F.array_compact(found)


def _plausible(kind: str, value: Column) -> Column:
    """Whether an unseen identifier may be of this kind at all."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return {
        "email": value.rlike("^[^@]+@[^@]+$") | value.rlike("[^\\[(]" + AT + "[^\\])]"), "ip": (digits >= 4) & (F.length(F.regexp_replace(value, "[^.:]", "")) >= 3) & ~value.contains(" "),
        "card": digits.between(12, 19), "phone": digits.between(7, 15) & ~value.rlike("[A-Za-z@]"),
    }[kind]


def _strip(tokens: DataFrame) -> DataFrame:
    """Tokens without the marks around them, lowered."""
    lead, trail = F.length(F.regexp_extract("value", r"^[\"'(<\[{]*+", 0)), F.length(F.regexp_extract("value", r"(?<![\"')>\]}.:!?*#$%&])[\"')>\]}.:!?*#$%&]*+\z", 0))
    cut = tokens.withColumn("_lead", lead).withColumn("_trail", trail)
    inside = F.substring(F.col("value"), F.col("_lead") + 1, F.greatest(F.lit(0), F.length("value") - F.col("_lead") - F.col("_trail")))
    cut = cut.withColumn("value", F.lower(inside)).withColumn("start", F.col("start") + F.col("_lead")).withColumn("end", F.col("end") - F.col("_trail"))
    return cut.filter("length(value) > 0").drop("_lead", "_trail")


def _in_parts(free: DataFrame) -> DataFrame:
    """Numbers written in several tokens, each too short by itself, as rows like those of ``free``."""
    digits = F.length(F.regexp_replace("value", "[^0-9]", "")).cast("bigint")
    parts = free.withColumn("digits", digits).filter(~F.col("value").rlike("[A-Za-z@]") & (digits < FEWEST_DIGITS))
    # every part holds a digit, so no number has more parts than digits
    ahead = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.currentRow, MOST_DIGITS - 1)
    item = F.struct("start", "end", "value", "spaced", "digits", "r1")
    listed = parts.withColumn("_list", F.collect_list(item).over(ahead))
    start = F.struct(
        F.col("end").alias("end"), F.col("value").alias("value"), F.col("digits").alias("digits"), F.lit(True).alias("whole"),
        F.array().cast("array<struct<end:bigint,value:string,r1:string>>").alias("found"))

    def grow(acc: Column, x: Column) -> Column:
        total = acc["digits"] + x["digits"]
        whole = acc["whole"] & x["spaced"] & (x["start"] == acc["end"] + 1) & (total <= MOST_DIGITS)
        value = F.when(whole, F.concat(acc["value"], F.lit(" "), x["value"])).otherwise(acc["value"])
        found = F.when(whole & (total >= FEWEST_DIGITS), F.concat(acc["found"], F.array(F.struct(x["end"].alias("end"), value.alias("value"), x["r1"].alias("r1"))))).otherwise(acc["found"])
        return F.struct(x["end"].alias("end"), value.alias("value"), total.alias("digits"), whole.alias("whole"), found.alias("found"))

    numbers = F.aggregate(F.slice("_list", 2, MOST_DIGITS), start, grow, lambda acc: acc["found"])
    each = listed.withColumn("_n", F.explode(numbers))
    names = [c for c in free.columns if c not in ("end", "value", "r1")]
    return each.select(*names, F.col("_n.end").alias("end"), F.col("_n.value").alias("value"), F.col("_n.r1").alias("r1"))


def score_graph(seeds: DataFrame, others: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score) of the unseen instances that pass. ``seeds``: kind, value, pattern; ``others``: value, pattern."""
    s, x = [f"s{i}" for i in range(len(KINDS))], [f"x{i}" for i in range(len(KINDS))]
    known = seeds.groupBy("pattern", "value").agg(*[F.max((F.col("kind") == k).cast("double")).alias(c) for k, c in zip(KINDS, s, strict=True)])
    unseen = others.select("pattern", "value").distinct().join(seeds.select("value").distinct(), "value", "left_anti")
    useful = unseen.join(known.select("pattern").distinct(), "pattern", "left_semi")
    edges = known.unionByName(useful.select("pattern", "value", *[F.lit(0.0).alias(c) for c in s]))
    edges = stored(edges.select("*", *[F.col(a).alias(b) for a, b in zip(s, x, strict=True)]), "pii-graph")
    for turn in range(rounds):
        patterns = edges.groupBy("pattern").agg(
            *[(F.sum(b) / (F.count(F.lit(1)) + 1)).alias(f"p{b}") for b in x], *[F.sum(a).alias(f"n{a}") for a in s]
        )
        trusted = [F.when((F.col(f"n{a}") >= MIN_SEEDS) & (F.col(f"p{b}") >= MIN_PATTERN), F.col(f"p{b}")).otherwise(0.0) for a, b in zip(s, x, strict=True)]
        scored = edges.join(patterns, "pattern").groupBy("value").agg(
            *[(1 - F.exp(F.sum(F.log1p(-F.least(t, F.lit(0.999)))))).alias(f"v{b}") for t, b in zip(trusted, x, strict=True)]
        )
        edges = edges.join(scored, "value").select("pattern", "value", *s, *[F.greatest(F.col(a), F.col(f"v{b}")).alias(b) for a, b in zip(s, x, strict=True)])
        if turn + 1 < rounds:
            edges = stored(edges, "pii-graph")
    fresh = edges.filter(" + ".join(s) + " = 0").groupBy("value").agg(*[F.max(b).alias(b) for b in x])
    best = F.array_max(F.array(*[F.struct(F.when(_plausible(k, F.col("value")), F.col(b)).otherwise(0.0).alias("score"), F.lit(k).alias("kind")) for k, b in zip(KINDS, x, strict=True)]))
    return fresh.select("value", best.alias("b")).filter(F.col("b.score") >= MIN_INSTANCE).select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))


def find_spans(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Base and discovered spans (rid, doc_id, text_hash, kind, start, end, value, base) from ``pieces``.

    A discovered span of several overlapping instances has the kind and value of the best of them.
    """
    base = found.filter(F.col("kind").isin(KINDS)).filter(_valid(F.col("kind"), F.col("value")))
    base = stored(base, "pii-base")
    tokens = stored(_in_context(found.filter("kind = 'token'"), base), "pii-tokens")
    bare = _strip(tokens)
    # a seed's context: of the token that it starts, and of the one that it ends
    first = bare.select("rid", "start", "l2", "l1")
    last = bare.select("rid", "end", "r1")
    seeds = base.drop("l2", "l1", "r1").join(first, ["rid", "start"]).join(last, ["rid", "end"], "left")
    seeds = seeds.select("kind", F.lower("value").alias("value"), F.explode(_patterns()).alias("pattern")).distinct()
    whole = tokens.filter("NOT hit").drop("hit")
    plausible = F.lit(False)
    for k in KINDS:
        plausible = plausible | _plausible(k, F.col("value"))
    # numbers in parts have 7 to 19 digits and no letter, so they are plausible as they are
    free = _strip(whole).filter(plausible).unionByName(_strip(_in_parts(whole)))
    free = stored(free.select("rid", "doc_id", "text_hash", "start", "end", "value", _patterns().alias("patterns")), "pii-instances")
    accepted = score_graph(seeds, free.select("value", F.explode("patterns").alias("pattern")), rounds)
    more = free.join(accepted, "value")
    # overlapping instances are one span
    over = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach > F.col("start"), 0).otherwise(1)
    island = F.sum("_fresh").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = F.max(F.struct("score", (F.col("end") - F.col("start")).alias("n"), "kind", "value"))
    more = more.withColumn("_fresh", fresh).withColumn("_island", island).groupBy("rid", "doc_id", "text_hash", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), best.alias("b"))
    names = ["rid", "doc_id", "text_hash", "kind", "start", "end", "value"]
    more = more.select("rid", "doc_id", "text_hash", "b.kind", "start", "end", "b.value", F.lit(False).alias("base"))
    return base.select(*names, F.lit(True).alias("base")).unionByName(more)


def report(docs: DataFrame) -> DataFrame:
    """Per document the numbers and a digest of the base spans, and all spans as ``kind:start:end``."""
    found = pieces(docs)
    spans = find_spans(found).select("rid", "doc_id", "kind", "start", "end", "base")
    texts = found.filter("kind = 'text'").select("rid", "doc_id", "kind", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), F.lit(False).alias("base"))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct(place.alias("place"), "start", "end", "kind", "base")
    rows = spans.unionByName(texts).groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), item))).alias("items"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda items: F.array_join(F.transform(items, name), ",")
    base = F.filter("items", lambda s: s["base"])
    count = lambda k: F.size(F.filter("items", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    out = lambda df, counts, base_text, all_text: df.select("doc_id", *counts, F.sha2(base_text.cast("binary"), 256).alias("base_sha256"), all_text.alias("spans"))
    with_spans = out(rows, [count(k) for k in KINDS], joined(base), joined(F.col("items")))
    without = out(docs.filter(~whole_text().rlike(ANY_HINT)), [F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS], F.lit(""), F.lit(""))
    return with_spans.unionByName(without)


def redact(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of every row, with each span of its text replaced by the tag of its kind; overlapping spans by the first's."""
    spans = find_spans(pieces(docs)).select("doc_id", "text_hash", "start", "end", "kind").distinct()
    lists = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_s"))
    # the end of what is covered before each span, so that overlaps are cut once
    lists = lists.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_h")
    rows = docs.select(F.struct(*columns).alias("row"), "doc_id", whole_text().alias("_text"))
    text = F.col("_text")
    hit = rows.filter(text.rlike(ANY_HINT)).withColumn("_hash", F.xxhash64(text))
    joined = hit.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    tag = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(t)) for k, t in TAGS.items()])
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), tag(s["kind"])).alias("out"))
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("_s", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    changed = joined.select(F.col("row").withField("text", F.when(F.col("_s").isNull(), F.col("row.text")).otherwise(whole)).alias("row")).select("row.*")
    return changed.unionByName(rows.filter(~text.rlike(ANY_HINT)).select("row.*"))
