import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import constraints as cs
from scoreloom.functions import score as sc
from scoreloom.operators import corpus as cp


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def test_vqa_score(value):
    assert value(lambda p: sc.vqa_score(p, arr("yes")), "yes") == 0.0
    assert value(lambda p: sc.vqa_score(p, arr("yes", "yes", "yes")), "Yes.") == pytest.approx(2 / 3)
    assert value(lambda p: sc.vqa_score(p, arr(*["yes"] * 10)), "yes") == 1.0
    for said in ("Two cups", "the yes.", "", None):
        refs = arr("2 cups", "Yes", "yes!", "two cups", "")
        assert value(lambda p: sc.vqa_score(p, sc.vqa_references(refs), normalised=True), said) == value(lambda p: sc.vqa_score(p, refs), said)


def test_relaxed_accuracy_divides_by_the_prediction(value):
    assert value(lambda p: sc.relaxed_accuracy(p, arr("100")), "95") == 0.0
    assert value(lambda p: sc.relaxed_accuracy(p, arr("100"), legacy=False), "95") == 1.0
    assert value(lambda p: sc.relaxed_accuracy(p, arr("0.05")), "5%") == 1.0
    assert value(lambda p: sc.relaxed_accuracy(p, arr("5")), "0") == 0.0
    assert value(lambda p: sc.relaxed_accuracy(p, arr("Red")), " red ") == 1.0


def test_anls(value):
    assert value(lambda p: sc.anls(p, arr("abcd")), "abce") == 0.75
    assert value(lambda p: sc.anls(p, arr("abcd")), "zzzz") == 0.0
    assert value(sc.anls_doc, "ab", "ax") == 0.0  # 0.5 is not enough
    assert value(sc.anls_doc, "", "") == 1.0


@pytest.mark.parametrize("truth,said,kind,expected", [
    ("3", "3.0", "Int", 1.0), ("3", "x", "Int", 0.0), ("5%", "0.05", "Float", 1.0), ("5", "abc", "Float", 0.0),
    ("page 3", "page 4", "Str", 0.0), ("['b', 'a']", "['a', 'b']", "List", 1.0), ("['a']", "['a', 'b']", "List", 0.0)])
def test_typed_doc_score(value, truth, said, kind, expected):
    assert value(lambda t, p, k: sc.typed_doc_score(t, p, k, sc.parse_list), truth, said, kind) == expected


def test_boxes(value):
    lit_box = lambda *v: sc.box(*[F.lit(float(x)) for x in v])
    assert value(lambda _: sc.box_iou(lit_box(0, 0, 1, 1), lit_box(2, 2, 3, 3)), 0) == 0.0
    assert value(lambda _: sc.box_iou(lit_box(0, 0, 2, 2), lit_box(0, 0, 2, 2)), 0) == 1.0
    assert value(lambda _: sc.box_iou(lit_box(0, 0, 2, 2), lit_box(1, 0, 3, 2)), 0) == pytest.approx(1 / 3)
    corners = value(lambda _: sc.corners_from_size(F.lit(-1), F.lit(10), F.lit(100), F.lit(50), F.lit(100), F.lit(100)), 0)
    assert corners == {"x1": 0.0, "y1": 0.1, "x2": 0.98, "y2": 0.59}
    assert value(lambda _: sc.point_hit(F.lit(50.0), F.lit(20.0), lit_box(0, 0, 0.98, 0.59), F.lit(100), F.lit(100)), 0) is True


def spans(*pairs):
    return F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in pairs]).cast("array<struct<start:double,end:double>>")


@pytest.mark.parametrize("a,b,expected", [
    ([(0, 2), (2, 4)], [(0, 4)], 1.0), ([(0, 1)], [(2, 3)], 0.0), ([(0, 4), (1, 2)], [(2, 6)], 2 / 6), ([], [], 0.0), ([(1, 1)], [(1, 1)], 0.0)])
def test_interval_iou(value, a, b, expected):
    assert value(lambda _: sc.interval_iou(spans(*a), spans(*b)), 0) == pytest.approx(expected)
    assert value(lambda _: sc.interval_iou(spans(*b), spans(*a)), 0) == pytest.approx(expected)


def test_sets_and_sequences(value):
    assert value(lambda _: sc.jaccard(arr(), arr()), 0) == 1.0
    assert value(lambda _: sc.set_precision(arr("a", "a", "b"), arr("a")), 0) == 0.5
    assert value(lambda _: sc.common_prefix_ratio(arr("a", "b"), arr("a", "b", "c")), 0) == pytest.approx(2 / 3)
    assert value(lambda _: sc.common_prefix_ratio(arr("x"), arr("a", "b")), 0) == 0.0
    assert value(lambda _: sc.sequence_accuracy(arr("A"), arr("a", "b")), 0) == 0.0
    assert value(sc.string_exact, "(A) red", "A") == 1
    assert value(sc.string_simple, "re-d cup.", "Redcup") == 1


def test_numbers(value):
    assert value(lambda p: sc.linear_decay(p, F.lit(1.0)), None) == -1.0
    assert value(lambda p: sc.positive_int_match(p, F.lit(0)), -1) == -1
    assert value(lambda p: sc.count_score(p, F.lit(3), F.lit(4)), 3) == 100.0
    assert value(lambda p: sc.mean_relative_accuracy(p, F.lit(100.0)), 80.0) == pytest.approx(0.6)
    assert value(lambda p: sc.geo_proximity(p, p, p, p), 10.0) == 1.0
    assert value(sc.true_false_score, "true or false", "1") is None


def test_constraint_rules(value):
    digits = lambda s: value(cs.number_digits, s)
    assert digits("1,234.56 and 7 or 2.5e3 x9") == [2, 0, 1]
    assert value(cs.percent_digits, "5.25% and 7 %") == [2, 0]
    assert value(lambda s: F.size(cs.sentences(s)), "One. Two! Three? four") == 4
    assert value(lambda s: cs.keyword_count(cs.spaced_words(s), F.lit("Red")), "red, Red redder red") == 3
    rule = lambda name, low=None, high=None, texts=(): F.struct(
        F.lit(name).alias("rule"), F.lit(low).cast("int").alias("low"), F.lit(high).cast("int").alias("high"), arr(*texts).alias("texts"),
        F.array().cast("array<struct<low:int,high:int>>").alias("ranges"))
    run = lambda s, r: value(lambda t: cs.check_rule(t, cs.spaced_words(t), cs.paragraphs(cs.tidy(t)), cs.sentences(cs.tidy(t)), r), s)
    assert run("a\n\nb", rule("paragraph_count", 2, 2)) is True
    assert run("It costs 5.", rule("no_arabic_numbers")) is True  # a trailing period hides the number, as in the rule's pattern
    assert run("It costs 5 now", rule("no_arabic_numbers")) is False
    assert run("1.50 and 2.25", rule("number_precision", 2, 2)) is True
    assert run("1.5 and 2.25", rule("number_precision", 2, 2)) is False
    assert run("x", rule("no such rule")) is False


def test_transpositions(spark):
    rows = [(1, "ab", "ba"), (2, "ca", "abc"), (3, "", ""), (4, "abcd", "abcd"), (5, "a cat", "a act")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r["id"]: r["s"] for r in df.select("id", sc.transposing_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {1: 0.5, 2: pytest.approx(1 / 3), 3: 1.0, 4: 1.0, 5: 0.8}


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_against_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert cp._lcs(a, b) == brute_lcs(a, b)


def test_rouge_l(spark):
    out = cp.rouge_l(spark.createDataFrame([(1, "a b c", "a c"), (2, "", "a")], "id int, hyp string, ref string"), ["id"], "hyp", "ref")
    got = {r["id"]: r["rouge_l"] for r in out.collect()}
    p, r, b = 2 / 3, 1.0, 1.44
    assert got[1] == pytest.approx((1 + b) * p * r / (r + b * p), abs=1e-6) and got[2] == 0.0


def test_chrf_and_bleu_of_identical_text(spark):
    text = "the quick brown fox jumps over"
    pairs = spark.createDataFrame([(1, text, text), (2, "ab", "zz")], "id int, hyp string, ref string")
    got = {r["id"]: r["chrf"] for r in cp.chrf_sentence(pairs, ["id"], "hyp", "ref").collect()}
    assert got == {1: 100.0, 2: 0.0}
    same = pairs.filter("id = 1")
    assert cp.chrf_corpus(same, ["id"], {"q": (F.col("hyp"), F.col("ref"))}).first()["chrf"] == 100.0
    assert {r["bleu"] for r in cp.bleu(same, ["id"], "hyp", "ref", ["id"]).collect()} == {1.0}
    assert cp.gleu(same, ["id"], "hyp", "ref").first()["gleu"] == 1.0


def test_cider_has_two_references(spark):
    rows = [(1, "a red cup", ["a red cup", "one cup"]), (2, "a dog", ["the dog runs"])]
    got = {r["id"]: r["cider"] for r in cp.cider(spark.createDataFrame(rows, "id int, hyp string, refs array<string>"), ["id"], "hyp", "refs").collect()}
    assert got[1] > got[2] >= 0


def test_align_blocks_rounds_use_every_block_once(spark):
    rows = [(1, ["red cup", "blue cup", "dog"], ["blue cups", "red cup", "zebra", "dig"])]
    out = cp.align_blocks(spark.createDataFrame(rows, "page int, g array<string>, p array<string>"), "g", "p", rounds=3).collect()
    assert sorted(r["gt_position"] for r in out if r["gt_position"] is not None) == [0, 1, 2]
    assert sorted(r["pred_position"] for r in out if r["pred_position"] is not None) == [0, 1, 2, 3]
    pairs = {(r["gt"], r["pred"]) for r in out}
    assert {("red cup", "red cup"), ("blue cup", "blue cups"), ("dog", "dig"), ("", "zebra")} == pairs


def test_reading_order(value):
    matches = lambda *pairs: F.array(*[F.struct(F.lit(g).cast("bigint").alias("gt_position"), F.lit(p).cast("bigint").alias("pred_position")) for g, p in pairs])
    assert value(lambda _: cp.reading_order_distance(matches((1, 1), (2, 2))), 0) == 0.0
    assert value(lambda _: cp.reading_order_distance(matches((1, 2), (2, 1))), 0) == 1.0
    assert math.isclose(value(lambda _: cp.reading_order_distance(matches((1, 1), (2, None), (None, 3), (4, 2))), 0), 1 / 3)


def test_hot_grams_score_like_the_others(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda: "the cat " + " ".join(rng.choice(["sat", "ran", "on", "a", "mat", "the"]) for _ in range(rng.randrange(1, 9)))
    df = spark.createDataFrame([(i, say(), [say() for _ in range(1 + i % 3)]) for i in range(40)], "id int, hyp string, refs array<string>")
    scores = []
    for hot in (1, 12, 4096):
        monkeypatch.setattr(cp, "HOT_GRAMS", hot)
        scores.append(sorted((r["id"], r["cider"]) for r in cp.cider(df, ["id"], "hyp", "refs").collect()))
    assert scores[0] == scores[1] == scores[2] and max(s for _, s in scores[0]) > 0


def test_tasks_of_field_counts_follow_the_files(spark, monkeypatch):
    monkeypatch.setattr(cp, "KIE_FILES", 10)
    one = F.array(F.struct(F.lit("a").alias("field"), F.col("id").cast("string").alias("value")))
    counts = cp.kie_counts(spark.range(400).select("id", one.alias("p"), one.alias("t")), "id", "p", "t")
    assert counts.groupBy(F.spark_partition_id()).count().count() > 30
    assert counts.agg(F.sum("tp")).first()[0] == 400


def test_cider_by_small_blocks_equals_a_plain_one(spark, monkeypatch):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice(["sat", "Ran", "on", "a", "mat", "the", "ünd"]) for _ in range(rng.randrange(0, 9)))
    rows = [(i, say(), [say() for _ in range(i % 3)]) for i in range(60)]
    grams = lambda t: Counter((n, *t.lower().split()[k : k + n]) for n in range(1, 5) for k in range(len(t.split()) - n + 1))
    df = Counter(g for _, _, refs in rows for g in {g for r in refs for g in grams(r)})
    wanted = {}
    for i, hyp, refs in rows:
        scores = []
        for r in refs:
            h, g = grams(hyp), grams(r)
            if not h and not g:
                continue
            idf = lambda x: math.log(60) - math.log(df[x] or 1)
            total = 0.0
            for n in range(1, 5):
                of = lambda c: {x: k * idf(x) for x, k in c.items() if x[0] == n}
                a, b = of(h), of(g)
                norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
                total += sum(min(a.get(x, 0), y) * y for x, y in b.items()) / norm if norm else 0.0
            gap = sum(k * (x[0] == 2) for x, k in h.items()) - sum(k * (x[0] == 2) for x, k in g.items())
            scores.append(total / 4 * math.exp(-gap * gap / 72))
        if scores:
            wanted[i] = 10 * sum(scores) / len(scores)
    monkeypatch.setattr(cp, "CIDER_BLOCK_BYTES", 100)
    got = {r["id"]: r["cider"] for r in cp.cider(spark.createDataFrame(rows, "id int, hyp string, refs array<string>"), ["id"], "hyp", "refs").collect()}
    assert got.keys() == wanted.keys() and all(math.isclose(got[i], wanted[i], abs_tol=2e-6) for i in wanted)


def test_nearest_window_is_the_first_best(monkeypatch):
    rng = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for sep, size in ((" ", 1 << 16), ("", 5)):
        monkeypatch.setattr(cp, "WINDOW_CHARACTERS", size)
        for _ in range(60):
            needle, hay = ([rng.choice(["a", "bé", "日本", "dd"]) for _ in range(rng.randrange(k))] for k in (5, 14))
            n, goal = len(needle), sep.join(needle)
            rated = [(1.0 - distance(sep.join(w), goal) / max(len(sep.join(w)), len(goal)), -i) for i in range(1, len(hay) - n + 2) if set(w := hay[i - 1 : i - 1 + n]) & set(needle)]
            best = max(rated, default=(None, None))
            assert cp.nearest_window(needle, hay, sep) == (best[0], best[1] and -best[1])
    assert cp.nearest_window(None, ["a"], " ") == cp.nearest_window(["a"], None, " ") == (None, None)
