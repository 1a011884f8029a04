"""Rows that bindings lack: null keys, apostrophes, open ends, repeats, sparse orders."""

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import extract as ex
from scoreloom.functions import score as sc
from scoreloom.operators import corpus as cp
from scoreloom.operators import items as it
from scoreloom.operators import joins as jn
from scoreloom.operators import ordered as od
from scoreloom.operators import reports as rp
from scoreloom.operators import timing as tm


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 9)], "k string, o long, v long")
    got = sorted(((r["k"], r["o"], r["s"]) for r in od.prefix_fold(df, F.col("v"), "o", "s", ["k"]).collect()), key=str)
    assert got == sorted([(None, 1, None), (None, 2, 5), ("a", 1, None)], key=str)
    both = od.prefix_fold(df, F.col("v"), ["o", "v"], "s", ["k"])
    assert both.count() == 3
    assert od.uniform_sample(df, "o", 5, ["k"]).count() == 3
    spans = spark.createDataFrame([(None, 0.0, 2.0), ("a", 0.0, 2.0)], "k string, s double, e double")
    assert tm.sample_in_intervals(spans, ["k"], "s", "e", 4, 2.0).filter("k IS NULL").count() == 4
    whole = spark.createDataFrame([(None, 1, 5), (None, 4, 9), ("a", 1, 3)], "k string, s long, e long")
    assert sorted(((r["k"], r["overlap"], r["iou"]) for r in jn.interval_iou_by_key(whole, whole, ["k"], "s", "e").collect()), key=str) == [("a", 2, 1.0), (None, 8, 1.0)]


def test_null_categories_keep_their_parent(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", "c", 0), ("y", "c", 1)], "l2_category string, category string, hit int")
    got = {(r["split"], r["scope"], r["group"]): r["value"] for r in rp.report_acc_hierarchical(df).collect()}
    assert got["ALL", "l2", "x"] == pytest.approx(0.75) and got["ALL", "category", None] == 1.0


@pytest.mark.parametrize("step", [1, 1 << 20, 1 << 40])
def test_positions_over_sparse_orders(spark, step):
    df = spark.range(500).select((F.col("id") * step).alias("o"))
    got = od.with_position(df, "o").orderBy("o").collect()
    assert [r["position"] for r in got] == list(range(500))


def test_apostrophes_in_json(spark, value):
    rows = spark.createDataFrame([("""[{"question": "What's shown?", "answer": "it's a cat"}]""",), ("[{'question': 'q', 'answer': 'a'}]",), ("no",)], "question string")
    pairs, rejected = it.expand_qa_pairs(rows)
    assert sorted((r["question"], r["answer"]) for r in pairs.collect()) == [("What's shown?", "it's a cat"), ("q", "a")] and rejected.count() == 1
    assert value(ex.parse_score_json, '{"pred": "Yes", "score": 4, "reason": "it\'s right"}') == {"pred": "yes", "score": 4.0}
    assert value(ex.parse_score_json, "{'pred': 'no', 'score': 2}") == {"pred": "no", "score": 2.0}
    assert value(ex.parse_score_json, "nothing") == {"pred": None, "score": -1.0}
    assert value(sc.parse_list, """["it's", 'b']""") == ["it's", "b"]


def test_answer_frames(value):
    answer = lambda s: value(ex.extract_boxed_or_phrase, s)["answer"]
    assert answer("(A) A\nas it is") == "A" and answer("so it is (B).") == "B" and answer("so it is C.") == "C"


def test_spans_with_open_ends_and_repeats(spark):
    frames = spark.createDataFrame([("v", t) for t in (1.0, 5.0, 9.0)], "video string, time double")
    spans = spark.createDataFrame([("v", 4.0, 6.0, "twice"), ("v", 4.0, 6.0, "twice"), ("v", 8.0, None, "open"), ("v", 2.0, 3.0, "between")], "video string, start double, end double, text string")
    got = jn.place_spans_among_frames(frames, spans, "video", "time", "start", "end", "text", 4).filter("kind = 1")
    assert sorted(r["text"] for r in got.collect()) == ["twice", "twice"]  # the open one lasts to the last frame, which is not inside
    closed = spans.withColumn("length", F.lit(12.0))
    got = jn.place_spans_among_frames(frames, closed, "video", "time", "start", "end", "text", 4, "length").filter("kind = 1")
    assert sorted(r["text"] for r in got.collect()) == ["open", "twice", "twice"]


def test_reading_order_of_large_pages(value):
    order = lambda n, swap: cp.order_code(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("bigint")))
    assert len(value(lambda: order(60_000, False))) == 60_000


def test_all_queries_of_a_task_are_rows(spark):
    df = spark.range(1000).select(F.lit("t").alias("task"), "id", F.lit("d").alias("d"))
    got = it.organise_tasks(df, "task", "id", "d", F.col("id").cast("string"))
    assert got.count() == 1000 and got.agg(F.max("position")).first()[0] == 999


def test_nested_and_plain_fields(value):
    read = lambda s: sorted((x["field"], x["value"]) for x in value(cp.field_values, s) or [])
    assert read('{"menu": [{"name": ["cake"], "count": ["2"]}, {"name": "juice", "count": 1}], "b": "y", "c": ["x", " "], "d": null}') == [
        ("b", "y"), ("c", "x"), ("menu.count", "1"), ("menu.count", "2"), ("menu.name", "cake"), ("menu.name", "juice")]
    assert read('{"a": "[not json", "b": {"c": {"d": "z"}}}') == [("a", "[not json"), ("b.c.d", "z")]
    assert read("no json") == []


def test_repeated_results_count_once(spark):
    from scoreloom.operators import apply as ap

    items = spark.createDataFrame([(1,), (2,)], "index long")
    results = spark.createDataFrame([(1, "a"), (1, "b")], "index long, prediction string")
    assert sorted((r["index"], r["prediction"]) for r in ap.resumable_apply(items, results, lambda row: "new", "index").collect()) == [(1, "b"), (2, "new")]


def test_registry_names(spark):
    from scoreloom.operators import apply as ap

    rows = [
        ("jaccard_index", "a, b", "b,c", 1 / 3), ("jaccard_index_case_insensitive", "A", "a", 1.0), ("set_recall", "a", "a,b", 0.5),
        ("set_equality_case_insensitive", "A,b", "B,a", 1.0), ("str_set_equality_comma", "a,b", "b, a", 1.0), ("str_set_equality_line_break", "a\nb", "b\na", 1.0),
        ("sequence_equality_case_insensitive", "A,b", "a,B", 1.0), ("dict_equality", '{"a": 1}', '{"a": 1}', 1.0), ("dict_recall", '{"a": 1}', '{"a": 1, "b": 2}', 0.5),
        ("multi_ref_phrase", "b", "a|b", 1.0), ("nothing", "a", "a", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "metric string, p string, t string")
    got = {r["metric"]: r["score"] for r in ap.metric_scores(df, "metric", "p", "t").collect()}
    for name, _, _, score in rows:
        assert got[name] == (None if score is None else pytest.approx(score)), name


def test_lines_are_trimmed_of_blanks(value):
    assert value(ex.extract_cot_answer, "so\n  Answer: Big cat  ").strip() == "Big cat"
    assert value(it.read_answer_map, '{\n  "3": "x 1"\n "4": "y 2"') == {"3": "x 1", "4": "y 2"}


def test_fields_of_any_depth(spark):
    from functools import reduce

    deep = lambda n, leaf: reduce(lambda inner, k: f'{{"f{k}": {inner}, "x{k}": ["a", "}}{{"]}}', range(n), leaf)
    df = spark.createDataFrame([(1, deep(20, '"end"')), (2, '[[["no object"]]]'), (3, None), (4, "}}{{ no"), (5, "")], "id int, j string")
    got = {r["id"]: r["j"] for r in cp.with_field_values(df, ["j"]).collect()}
    found = sorted((x["field"], x["value"]) for x in got[1])
    path = lambda k: ".".join(f"f{i}" for i in range(19, k, -1))
    wanted = [(path(-1), "end")] + [(".".join(filter(None, [path(k), f"x{k}"])), v) for k in range(20) for v in ("a", "}{")]
    assert found == sorted(wanted) and not any(got[k] for k in (2, 3, 4, 5))


def test_sparse_order_of_one_key(spark):
    """No fold of a hot key is scanned in one task, however far its rows lie apart."""
    from scoreloom.operators import ordered as od

    df = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") * 3_000_000_000_000 - 4_000_000_000_000_000).alias("o"))
    got = od.with_position(df, "o", keys=["k"]).orderBy("o").collect()
    assert [r["position"] for r in got] == list(range(3000))


def test_character_overlap_against_counters(spark):
    from collections import Counter
    import random

    rng = random.Random(4)
    say = lambda: "".join(rng.choice("aab é日 ") for _ in range(rng.randrange(0, 14)))
    rows = [(i, say(), say()) for i in range(60)] + [(60, None, "abc"), (61, "", None), (62, "x" * 5000, "x" * 4999)]
    wide = [(100 + i, "".join(map(chr, rng.sample(range(0x4E00, 0x9000), 900))), "".join(map(chr, rng.sample(range(0x4E00, 0x9000), 900)))) for i in range(5)]
    got = {(r["id"], r["n"]): (r["h"], r["r"], r["m"]) for r in cp.character_overlap(
        spark.createDataFrame(rows + wide, "id int, hyp string, ref string"), ["id"], F.col("hyp"), F.col("ref"), 6).collect()}
    want = {}
    for i, a, b in rows + wide:
        a, b = ("".join((x or "").split()) for x in (a, b))
        for n in range(1, 7):
            h, r = (Counter(x[k : k + n] for k in range(len(x) - n + 1)) for x in (a, b))
            if h or r:
                want[i, n] = (h.total(), r.total(), (h & r).total())
    assert got == want
