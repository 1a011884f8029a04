"""Bit-parallel distances, block alignment and ROUGE-L against plain versions."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.functions import bitwise
from scoreloom.operators import corpus as cp


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


texts = st.lists(st.text("ab é日😀", max_size=9), max_size=7)


@settings(max_examples=150, deadline=None)
@given(st.text("ab é日😀", max_size=12), texts)
def test_packed_distances(one, many):
    assert bitwise.Packed(many).distances(one).tolist() == [plain_distance(one, x) for x in many]


def test_packed_distances_of_long_texts():
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    many = [say(n) for n in (0, 1, 63, 64, 65, 500, 0, 129)]
    packed = bitwise.Packed(many)
    for one in ("", "a", say(64), say(300)):
        assert packed.distances(one).tolist() == [plain_distance(one, x) for x in many]


def plain_rounds(left, right, rounds):
    share = lambda a, b: plain_distance(a, b) / max(len(a), len(b), 1)
    pairs = []
    while rounds is None or rounds > 0:
        rows, columns = ([k for k in range(len(x)) if k not in {p[side] for p in pairs}] for side, x in ((0, left), (1, right)))
        found = []
        for i in rows:
            best = min(((share(left[i], right[j]), j) for j in columns), default=None)
            if best and min((share(left[k], right[best[1]]), k) for k in rows)[1] == i:
                found.append((i, best[1], best[0]))
        if not found:
            break
        pairs += found
        rounds = None if rounds is None else rounds - 1
    return sorted(pairs)


@settings(max_examples=120, deadline=None)
@given(texts, texts, st.sampled_from([1, 2, None]))
def test_mutual_best_pairs(left, right, rounds):
    assert sorted(bitwise.mutual_best(left, right, rounds)) == plain_rounds(left, right, rounds)


def test_align_blocks_keeps_every_block(spark):
    rows = [
        (1, "x", ["über", "日本語", "same", "same", None], ["uber", "日本", "same", "", "far away"]), (2, "y", None, ["only"]), (3, None, [], []), (4, "z", ["a", "b"], []),
        (1, "x", ["über"], None),
    ]
    df = spark.createDataFrame(rows, "page int, kind string, g array<string>, p array<string>")
    out = cp.align_blocks(df, "g", "p", rounds=None)
    assert out.columns == ["page", "kind", "gt_position", "pred_position", "gt", "pred", "distance"]
    got = [tuple(r) for r in out.filter("page = 1 AND pred_position IS NOT NULL").collect()]
    assert sorted(got) == sorted([
        (1, "x", 0, 0, "über", "uber", 0.25), (1, "x", 1, 1, "日本語", "日本", pytest.approx(1 / 3)), (1, "x", 2, 2, "same", "same", 0.0), (1, "x", 4, 3, "", "", 0.0),
        (1, "x", 3, 4, "same", "far away", pytest.approx(plain_distance("same", "far away") / 8))])
    assert [tuple(r) for r in out.filter("page > 1").orderBy("page", "gt").collect()] == [
        (2, "y", None, 0, "", "only", 1.0), (4, "z", 0, None, "a", "", 1.0), (4, "z", 1, None, "b", "", 1.0)]
    assert out.filter("page = 1 AND gt = 'über'").count() == 2


def test_texts_in_chinese_differ(spark):
    rows = [(1, 1, "你好世界", "你好中国"), (1, 2, "abc", "abc")]
    samples = spark.createDataFrame(rows, "page int, n int, gt string, pred string")
    assert cp.edit_distance_pages(samples, "page", "gt", "pred").first()["edit_dist"] == round(2 / 7, 6)


def test_a_page_of_many_blocks_ends():
    """Time grows with the product of the sides by about a microsecond a pair: 10,000 blocks take minutes."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    left = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 14))) for _ in range(800)]
    right = [x[:3] + "#" + x[5:] for x in left[:700]] + [" ".join(rng.choice(words) for _ in range(6)) for _ in range(100)]
    order = list(range(800))
    rng.shuffle(order)
    began = time.time()
    pairs = bitwise.mutual_best(left, [right[k] for k in order], None)
    assert len(pairs) == 800 and sum(order[j] == i for i, j, _ in pairs) >= 695
    assert time.time() - began < 60


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_l_of_several_references(spark):
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice(["red", "cup", "dog", "on", "a", "the"]) for _ in range(rng.randrange(0, 12)))
    rows = [(i, say(), [say() for _ in range(rng.randrange(0, 4))]) for i in range(60)] + [(60, None, ["a"]), (61, "a", None), (62, "a", [None, "a"])]
    got = {r["id"]: r["rouge_l"] for r in cp.rouge_l_references(spark.createDataFrame(rows, "id int, hyp string, refs array<string>"), ["id"], "hyp", "refs").collect()}
    assert len(got) == len(rows)
    for i, hyp, refs in rows:
        h, rs = (hyp or "").split(), [(r or "").split() for r in refs or []]
        p = max((plain_lcs(h, r) / len(h) for r in rs if h), default=0.0)
        q = max((plain_lcs(h, r) / len(r) for r in rs if r), default=0.0)
        assert got[i] == pytest.approx((2.44 * p * q / (q + 1.44 * p)) if p and q else 0.0, abs=1e-6)
    scores = spark.createDataFrame([(1, 0.5), (2, 1.0)], "id int, rouge_l double")
    assert tuple(cp.corpus_mean(scores, "rouge_l").first()) == (0.75, 2)


def test_windows_of_chinese_and_repeated_words(spark):
    rows = [(1, "天气很好", "今天天气真好啊"), (2, "the cat the", "cat the the dog"), (3, "天气", "no such text"), (4, "", "x"), (5, "one", "")]
    got = {r["id"]: r for r in cp.best_windows(spark.createDataFrame(rows, "id int, needle string, hay string"), ["id"], "needle", "hay").collect()}
    one = got[1]
    assert one["window"] == "天气真好" and one["similarity"] == 0.75 and one["rouge1"] == 0.75 and one["jaccard"] == pytest.approx(3 / 5) and one["exact"] == 0.0
    two = got[2]
    assert two["window"] == "cat the the" and two["rouge1"] == 1.0 and two["f1"] == 1.0 and two["exact"] == 0.0
    assert all(got[k]["window"] == "" and got[k]["rouge1"] == 0.0 for k in (3, 4, 5))


def test_best_windows_of_ids_named_like_its_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x a b c"), (2, None, "a"), (3, "a", None), (3, "日本", "東日本語"), (None, "p q", "x p")], "start int, needle string, hay string")
    got = cp.best_windows(df, ["start", "needle"], "needle", "hay")
    alone = df.select("start", "needle", cp.best_ngram_window(F.col("needle"), F.col("hay")).alias("b")).select("start", "needle", "b.*")
    assert got.columns == alone.columns and sorted(map(repr, got.collect())) == sorted(map(repr, alone.collect()))
    assert {r["window"] for r in got.collect()} == {"a b", "", "日本", "x p"}
