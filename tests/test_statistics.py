"""Mergeable statistics, field aggregation and judging by groups."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import apply as ap
from scoreloom.operators import reports as rp
from scoreloom.operators import statistics as st


def test_partial_results_merge(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 1), ("b", None, 5), ("b", 4.0, 0), (None, 2.0, 4)], "g string, v double, w int")
    stat = st.share(F.col("v") * F.col("w"), F.col("w"))
    whole = {r["g"]: r["value"] for r in stat.value(df, ["g"]).collect()}
    assert whole == {"a": pytest.approx(5 / 3, abs=1e-6), "b": None, None: 2.0}
    halves = stat.partial(df.filter("w > 1"), ["g"]).unionByName(stat.partial(df.filter("w <= 1"), ["g"]))
    assert {r["g"]: r["value"] for r in stat.closed(stat.merge(halves, ["g"]), ["g"]).collect()} == whole
    assert st.STATISTICS["mean"](F.col("v")).value(df).first()["value"] == 2.5


def plain_bleu(rows, order=4):
    h, m, hl, rl = [0] * order, [0] * order, 0, 0
    for a, b in rows:
        a, b = a.split(), b.split()
        hl, rl = hl + len(a), rl + len(b)
        for n in range(order):
            x, y = (Counter(tuple(t[i : i + n + 1]) for i in range(len(t) - n)) for t in (a, b))
            h[n], m[n] = h[n] + x.total(), m[n] + (x & y).total()
    if not all(m):
        return 0.0
    return (1.0 if hl >= rl else math.exp(1 - rl / hl)) * math.exp(sum(math.log(x / y) for x, y in zip(m, h)) / order)


def test_bleu_and_chrf_by_group_in_parts(spark):
    texts = [("a red cup on the old table", "a red cup on the table"), ("the dog ran off", "the dog ran away fast"), ("one two three four five", "one two three four six"), ("x", "y")]
    df = spark.createDataFrame([(i, i % 2, *t) for i, t in enumerate(texts)], "id int, g int, hyp string, ref string")
    bleu = st.STATISTICS["bleu"](["id"], "hyp", "ref")
    got = {r["g"]: r["value"] for r in bleu.value(df, ["g"]).collect()}
    assert got == {g: pytest.approx(plain_bleu(texts[g::2]), abs=1e-6) for g in (0, 1)}
    parts = bleu.partial(df.filter("id < 2")).unionByName(bleu.partial(df.filter("id >= 2")))
    assert bleu.closed(bleu.merge(parts)).first()["value"] == pytest.approx(plain_bleu(texts), abs=1e-6)
    chrf = st.STATISTICS["chrf"](["id"], "hyp", "hyp")
    assert {r["value"] for r in chrf.value(df, ["g"]).collect()} == {100.0}


def test_fields_are_weighted(spark):
    rows = [({"a": 1.0, "b": 0.5}, {"a": 3.0}), ({}, {"a": 1.0}), ({"a": 0.5}, {"a": 0.0}), ({"a": 0.25}, None)]
    df = spark.createDataFrame(rows, "s map<string,double>, w map<string,double>")
    assert [r["score"] for r in st.aggregate_fields(df, "s", "w").collect()] == [pytest.approx(3.5 / 4), 0.0, 0.0, 0.25]


def test_a_group_leaves_at_its_first_failure(spark):
    rows = [(g, i, said, "A") for g, many in {
        "right": ["A", None, None], "wrong by rule": ["B", None, None], "second fails": [None, "no", None, None], "rules only": ["A", "A"], None: [None]}.items() for i, said in enumerate(many)]
    df = spark.createDataFrame(rows, "g string, i int, said string, truth string")
    asked = spark.sparkContext.accumulator(0)

    def judge(row, attempt):
        asked.add(1)
        return "C" if (row["g"], row["i"]) == ("second fails", 2) else "A"

    rule = F.when(F.col("said") == "no", F.lit(None).cast("string")).otherwise(F.col("said"))
    got = {r["g"]: (r["hit"], r["judged"]) for r in ap.judge_groups(df, "g", "i", "i", "truth", rule, judge).collect()}
    assert got == {"right": (1, 2), "wrong by rule": (0, 0), "second fails": (0, 3), "rules only": (1, 0), None: (1, 1)}
    assert asked.value == 2 + 3 + 1


def test_boxes_by_name(spark):
    df = spark.createDataFrame([("nbbox_iou_single", "0.0, 0.0, 0.5, 1.0", "0.0, 0.0, 1.0, 1.0"), ("nbbox_iou_single", "none", "0.0, 0.0, 1.0, 1.0"), ("xml_norm_point_in_bbox", "0.1, 0.1, 0.2, 0.2", "0.0, 0.0, 0.5, 0.5")], "m string, p string, t string")
    assert [r["score"] for r in ap.metric_scores(df, "m", "p", "t").collect()] == [0.5, 0.0, 1.0]


def test_delta_report(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 1.6), ("b", 9.0, 1.0)], "k string, v double, t double")
    got = {r["group"] if r["scope"] == "type" else "all": (r["d2"], r["d15"]) for r in rp.delta_report(df, "v", "t", "k", {"d2": 2.0, "d15": 1.5}).collect()}
    assert got == {"a": (1.0, 0.5), "b": (0.0, 0.0), "all": (pytest.approx(2 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6))}
