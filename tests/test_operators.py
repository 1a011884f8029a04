import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import apply as ap
from scoreloom.operators import consistency as co
from scoreloom.operators import crossmodel as cm
from scoreloom.operators import items as it
from scoreloom.operators import joins as jn
from scoreloom.operators import ordered as od
from scoreloom.operators import reports as rp
from scoreloom.sources import pages as pg
from scoreloom.sources import tables as tb


def hot_rows(n=3000, seed=1):
    """A third of the rows share one key."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.34 else rng.randrange(1, 40), rng.randrange(5000), i, rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 100, 1 << 16])
def test_prefix_fold_on_a_hot_key(spark, width):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, o int, id int, v int")
    sums = {r["id"]: r["s"] for r in od.prefix_fold(df, F.col("v"), "o", "s", ["k"], ["id"], F.sum, width).collect()}
    tops = {r["id"]: r["s"] for r in od.prefix_fold(df, F.col("v"), "o", "s", ["k"], ["id"], F.max, width).collect()}
    seen = {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        before = seen.setdefault(k, [])
        assert sums[i] == (sum(before) if before else None)
        assert tops[i] == (max(before) if before else None)
        before.append(v)


@pytest.mark.parametrize("width", [1, 9, 1 << 16])
def test_several_order_columns_with_a_hot_first_one(spark, width):
    rows = [(0 if i % 3 == 0 else i // 50, i, i % 7) for i in range(1500)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    got = {r["b"]: (r["position"], r["s"]) for r in od.prefix_fold(
        od.with_position(df, ["a", "b"], width=width), F.col("v"), ["a", "b"], "s", width=width).collect()}
    total = 0
    for spot, (a, b, v) in enumerate(sorted(rows)):
        assert got[b] == (spot, total if spot else None)
        total += v


def test_positions_are_dense(spark):
    rows = hot_rows(2000)
    df = spark.createDataFrame(rows, "k int, o int, id int, v int")
    got = sorted((r["position"], r["o"], r["id"]) for r in od.with_position(df, "o", tie=["id"], width=13).collect())
    assert [g[0] for g in got] == list(range(2000))
    assert [(g[1], g[2]) for g in got] == sorted((r[1], r[2]) for r in rows)


@pytest.mark.parametrize("k", [1, 3, 7, 50])
def test_uniform_sample(spark, k):
    rows = [(key, i) for key, n in ((0, 40), (1, 3), (2, 7)) for i in range(n)]
    got = od.uniform_sample(spark.createDataFrame(rows, "k int, o int"), "o", k, ["k"]).collect()
    for key, n in ((0, 40), (1, 3), (2, 7)):
        want = list(range(n)) if k >= n else [int(i * (n / k)) for i in range(k)]
        assert sorted(r["o"] for r in got if r["k"] == key) == want


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("width", [5, 64, 1 << 16])
def test_intervals_on_a_hot_key(spark, width):
    rng = random.Random(5)
    make = lambda n, step: [(0 if rng.random() < 0.4 else rng.randrange(1, 9), s, s + rng.randrange(0, 30)) for s in (rng.randrange(step) for _ in range(n))]
    left, right = make(800, 6000), make(500, 6000)
    frame = lambda rows: spark.createDataFrame(rows, "k int, s bigint, e bigint")
    by_key = lambda rows: {k: merged([(s, e) for x, s, e in rows if x == k]) for k in {r[0] for r in rows}}
    got = {}
    for r in jn.merge_intervals(frame(left), ["k"], "s", "e", width).collect():
        got.setdefault(r["k"], []).append((r["s"], r["e"]))
    a, b = by_key(left), by_key(right)
    assert {k: sorted(v) for k, v in got.items()} == a
    iou = {r["k"]: (r["overlap"], r["union_length"]) for r in jn.interval_iou_by_key(frame(left), frame(right), ["k"], "s", "e", width).collect()}
    for k in set(a) | set(b):
        shared = sum(max(0, min(x[1], y[1]) - max(x[0], y[0])) for x in a.get(k, []) for y in b.get(k, []))
        total = sum(e - s for s, e in a.get(k, []) + b.get(k, []))
        assert iou[k] == (shared, total - shared)


def test_subtitles(spark):
    frames = spark.createDataFrame([("v", i, t) for i, t in enumerate([1, 10, 20, 30])], "v string, frame int, t int")
    subs = spark.createDataFrame([("v", 0, 5, 15, "x"), ("v", 1, 9, 11, "y"), ("v", 2, 20, 25, "edge"), ("v", 3, 19, 31, "x")], "v string, rank int, s int, e int, text string")
    first = {r["frame"]: r["text"] for r in jn.first_span_per_frame(frames, subs, "v", "frame", "t", "s", "e", "rank", "text", 8).collect()}
    assert first == {1: "x", 2: "x", 3: "x"}
    seen = {r["text"]: r["first_seen"] for r in jn.distinct_spans(frames, subs, "v", "t", "s", "e", "text", 8).collect()}
    assert seen == {"x": 10, "y": 10}
    order = [(r["position"], r["seconds"], r["text"]) for r in jn.place_spans_among_frames(frames, subs, "v", "t", "s", "e", "text", 8).orderBy("position").collect()]
    assert [x[2] for x in order] == [None, None, "x", "y", None, "x", None]


def test_circular_groups(spark):
    rows = [(1, "q", "aa", "bb", "cc", None, "B"), (2, "q", "A", "x", "y", "z", "A"), (3, "q", "dd", "ee", "ff", "gg", "D")]
    items = spark.createDataFrame(rows, "index bigint, question string, A string, B string, C string, D string, answer string")
    out = co.circular_expand(items).collect()
    assert len(out) == 3 + 1 + 4
    assert all(r[r["answer"]] == {1: "bb", 2: "A", 3: "gg"}[r["g_index"]] for r in out)
    assert {r["index"] % 1000000 for r in out} == {1, 2, 3}
    rotated = co.circular_expand(items)
    replies = rotated.select("index", F.when(F.col("index") == 1000003, "Z").otherwise(F.col("answer")).alias("prediction"))
    hits = co.rotation_hits(replies, rotated)
    verdict = {r["g_index"]: r["hit"] for r in co.circular_eval(hits, []).collect()}
    assert verdict == {1: 1, 2: 1, 3: 0}


def test_offset_grows_with_the_index(spark):
    big = spark.createDataFrame([(1000000,)], "index bigint")
    assert big.select(co.index_offset(big).alias("o")).first()["o"] == 10000000


def test_pairs_and_quads(spark):
    df = spark.createDataFrame([("a_1", True), ("a_2", True), ("b_1", True), ("c_1", True), ("c_2", False), ("plain", True)], "index string, right boolean")
    assert co.pair_accuracy(df, "index", "right").first().asDict() == {"accuracy": pytest.approx(100 / 3, abs=1e-6), "groups": 3}
    quad = spark.createDataFrame([(i, a) for i, a in enumerate([1, 0, 0, 1, 1, 1, 0, 0, 1])], "index int, a int")
    assert co.quad_scores(quad, "index", "a").first().asDict() == {"Q_Acc": 0.5, "I_Acc": 0.75, "Acc": 0.75, "G_Acc": 0.5}


def test_reports_leave_out_sentinels_and_keep_nulls(spark):
    df = spark.createDataFrame([("x", "dev", 1), ("x", "dev", 0), ("y", "test", 1)], "category string, split string, hit int")
    table = rp.wide(rp.report_acc(df, "l2", "category"), ["split"], ["all", "x", "y"]).collect()
    got = {r["split"]: (r["all"], r["x"], r["y"]) for r in table}
    assert got == {"dev": (0.5, 0.5, None), "test": (1.0, None, 1.0)}
    nested = spark.createDataFrame([("t", "s", "c", -1), ("t", "s", "c", 1), ("t", "s", "Attribute/x", 0)], "task string, sub string, category string, score int")
    rows = {(r["scope"], r["group"]): r["value"] for r in rp.nested_rating(nested, "task", "sub", "category").collect()}
    assert rows[("category", "t/s/attribute/attribute")] == 0.0 and rows[("overall", "all")] == 0.5


def test_concat_and_split_round_trip(spark):
    a = spark.createDataFrame([(5, "x"), (7, "y")], "index bigint, q string")
    b = spark.createDataFrame([(5, "z")], "index bigint, q string")
    both = cm.concat_datasets({"a": a, "b": b}, "original_index")
    assert sorted(r["index"] for r in both.collect()) == [0, 1, 2]
    assert sorted(tuple(r) for r in cm.split_datasets(both, "a").select("index", "q").collect()) == [(5, "x"), (7, "y")]


def test_payloads(spark):
    long = "p" * 80
    df = spark.createDataFrame([("1", long), ("2", "1"), ("3", "2"), ("4", "nope"), ("5", None)], "index string, image string")
    got = {r["index"]: (r["image"], r["payload_error"]) for r in it.resolve_shared_payload(df, "image").collect()}
    assert got["2"] == (long, None) and got["3"] == ("2", "unknown owner") and got["5"] == (None, None) and len(got) == 5


def test_answer_maps(value):
    assert value(it.read_answer_map, 'Sure: {"1": "yes", "2": "no"} ok') == {"1": "yes", "2": "no"}
    assert value(it.read_answer_map, "{\n'1': 'yes',\n\"2\": no\n") == {"1": "yes", "2": "no"}
    assert value(it.read_answer_map, "nothing") is None


def test_resumable_run(spark, tmp_path):
    items = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "index bigint, question string")
    path = str(tmp_path / "results")

    def weak(row):
        if row["index"] % 2:
            raise ValueError("down")
        return row["question"]

    first = {r["index"]: r["prediction"] for r in ap.resumable_run(items, path, weak, "index").collect()}
    assert first[2] == "q2" and "Failed" in first[3]
    second = {r["index"]: r["prediction"] for r in ap.resumable_run(items, path, lambda r: "again " + r["question"], "index").collect()}
    assert second == {i: f"q{i}" if i % 2 == 0 else f"again q{i}" for i in range(6)}
    assert spark.read.parquet(path).count() == 9


def test_judge_is_asked_only_for_open_rows(spark):
    df = spark.createDataFrame([(1, "A"), (2, "later"), (3, "never")], "index int, prediction string")
    rule = F.when(F.col("prediction") == "A", "A")
    judge = lambda row, attempt: "B" if row["prediction"] == "later" and attempt == 2 else None
    got = {r["index"]: (r["answer"], r["solved_by"]) for r in ap.rule_then_judge(df, rule, judge, "index").collect()}
    assert got == {1: ("A", "rule"), 2: ("B", "judge"), 3: ("Z", "judge")}


def test_multi_turn(spark):
    df = spark.createDataFrame([(1, ["a", "boom", "c"])], "id int, turns array<string>")

    def talk(history, question):
        if question == "boom":
            raise RuntimeError("x")
        return f"{question}{len(history)}"

    got = ap.multi_turn_apply(df, talk, "id", "turns").first()["answers"]
    assert got[0] == "a0" and "Failed" in got[1] and got[2] == "c4"


def test_tables_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted"\nline', "x\ty"), (2, "", "z")]
    df = spark.createDataFrame(rows, "id int, text string, other string")
    for fmt in ("csv", "tsv", "jsonl", "parquet"):
        path = str(tmp_path / f"t.{fmt}")
        tb.write_table(df, path)
        back = tb.read_table(spark, path, "id int, text string, other string")
        assert sorted((r["id"], r["text"] or "", r["other"]) for r in back.collect()) == rows
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.json").write_text(
        '[{"index": "1", "question": "q", "multi-choice options": ["(A) x", "(B) y"], "answer": "A", "category": "c", "l2-category": "d"}]')
    read = tb.read_json_annotations(spark, str(tmp_path / "notes")).first()
    assert (read["A"], read["B"], read["C"], read["index"]) == ("x", "y", None, "1")
    sums = tb.file_checksums(spark, str(tmp_path / "notes")).collect()
    assert len(sums) == 1 and len(sums[0]["md5"]) == 32
    with pytest.raises(ValueError):
        tb.read_table(spark, "x.xlsx")
    assert tb.fingerprint(df, df.columns).collect() == tb.fingerprint(df.orderBy(F.desc("id")), df.columns).collect()


def test_pages(spark):
    html = ("<table><tr><td><ul><li>1. What?</li><li>A) red</li><li>B. blue</li></ul></td><td></td><td>Ans: B</td></tr>"
            "<tr><td><li>Open?</li></td><td></td><td>because</td></tr><tr><td>short</td></tr></table>")
    got = pg.pages_to_items(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").orderBy("row").collect()
    assert [(r["question"], r["A"], r["B"], r["answer"], r["correct_option"], r["question_type"]) for r in got] == [
        ("What?", "red", "blue", "blue", "B", "MCQ"), ("Open?", "", "", "because", "", "SAQ")]


@pytest.mark.parametrize("width", [1, 3.5, 100])
def test_spans_and_frames_against_all_pairs(spark, width):
    rng = random.Random(9)
    key = lambda: rng.choice(["hot", "hot", "cold", None])
    frames = [(key(), i, rng.choice([rng.randrange(-40, 300), rng.random() * 300])) for i in range(150)]
    spans = []
    for i in range(120):
        begin = rng.choice([float(rng.randrange(-50, 300)), rng.random() * 300])
        spans.append((key(), i % 40, begin, begin + rng.choice([0.0, 0.4, 7.0, 160.0, 333.3]), f"line {i % 11}"))
    frames = [(k, i, float(t)) for k, i, t in frames]
    spans += [("hot", 1, 5.0, None, "open"), ("hot", 2, None, 5.0, "open")]
    f = spark.createDataFrame(frames, "k string, frame int, t double")
    sp = spark.createDataFrame(spans, "k string, rank int, s double, e double, text string")
    pairs = [(k, i, t, r, s, e, x) for k, i, t in frames for q, r, s, e, x in spans if k == q and s is not None and e is not None and s < t < e]
    got = [(r["k"], r["frame"], r["t"], r["rank"], r["s"], r["e"], r["text"]) for r in jn.spans_covering(f, sp, "k", "t", "s", "e", width).collect()]
    assert sorted(got, key=str) == sorted(pairs, key=str)
    first = {r["frame"]: r["text"] for r in jn.first_span_per_frame(f, sp, "k", "frame", "t", "s", "e", "rank", "text", width).collect()}
    assert first == {i: min((p[3], p[6]) for p in pairs if p[1] == i)[1] for i in {p[1] for p in pairs}}
    seen = {(r["k"], r["text"]): r["first_seen"] for r in jn.distinct_spans(f, sp, "k", "t", "s", "e", "text", max(1, int(width))).collect()}
    assert seen == {(k, x): min(p[2] for p in pairs if (p[0], p[6]) == (k, x)) for k, x in {(p[0], p[6]) for p in pairs}}


def test_one_key_with_many_long_spans(spark):
    """100,000 spans that cover most of 20,000 frames: two thousand million pairs, none of which are made."""
    frames = spark.range(20_000).select(F.lit("v").alias("k"), "id", F.col("id").alias("t"))
    spans = spark.range(100_000).select(F.lit("v").alias("k"), "id", (F.col("id") % 100).alias("s"), (20_000 - F.col("id") % 70).alias("e"), F.concat(F.lit("x"), F.col("id") % 1000).alias("text"))
    first = jn.first_span_per_frame(frames, spans, "k", "id", "t", "s", "e", "id", "text", 16).agg(F.count("*"), F.min("id"), F.max("id"), F.max("text")).first()
    assert tuple(first) == (19_999, 1, 19_999, "x0")
    seen = jn.distinct_spans(frames, spans, "k", "t", "s", "e", "text", 64)
    assert seen.count() == 1000 and seen.filter("text = 'x0'").first()["first_seen"] == 1


def test_intervals_merge_in_few_exchanges(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 100_000, 100_001), (1, 9, 70_000)], "k int, s bigint, e bigint")
    out = jn.interval_iou_by_key(df, df, ["k"], "s", "e")
    assert [tuple(r) for r in out.collect()] == [(1, 70_001, 70_001, 1.0)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    shuffles = plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange")
    assert shuffles <= 8


@pytest.mark.parametrize("k", [1, 3, 5, 50])
@pytest.mark.parametrize("order", [["o"], ["o", "id"]])
def test_fold_std_cuts_hot_and_sparse_chunks(spark, k, order):
    rng = random.Random(k)
    # a third of the rows share one order value, the rest spread over many chunks
    rows = [(5000 if i % 3 == 0 else rng.randrange(-50_000, 90_000), i, rng.randrange(2)) for i in range(1700)]
    got = {r["name"]: r["value"] for r in rp.fold_std(spark.createDataFrame(rows, "o int, id int, v int"), order, "v", k, tie=["id"]).collect()}
    size, folds = len(rows) // k, {}
    for spot, (_, _, v) in enumerate(sorted(rows)):
        folds.setdefault(min(spot // size, k - 1), []).append(v)
    means = {f: 100.0 * sum(vs) / len(vs) for f, vs in folds.items()}
    middle = sum(means.values()) / k
    assert got.pop("std") == pytest.approx((sum((m - middle) ** 2 for m in means.values()) / k) ** 0.5, abs=1e-5)
    assert got == {f"fold{f}": pytest.approx(m, abs=1e-5) for f, m in means.items()}


def test_fold_std_of_few_or_no_rows(spark):
    rows = spark.createDataFrame([(1, 1), (2, 0)], "o int, v int")
    got = {r["name"]: r["value"] for r in rp.fold_std(rows, "o", "v", 5).collect()}
    assert got == {"fold4": 50.0, "std": 0.0}
    assert {r["name"]: r["value"] for r in rp.fold_std(rows.limit(0), "o", "v", 5).collect()} == {"std": None}


def test_three_views_of_rotations(spark):
    # groups of unlike size, one without a main row, a null category, a null hit
    rows = [(1, 1, "dev", "x", "p", 1), (1000001, 1, "dev", "x", "p", 0), (2, 2, "dev", "x", None, 1), (1000002, 2, "dev", "x", None, 1),
            (1000003, 3, "test", "y", "p", 1), (4, 4, "test", "y", "q", None)]
    df = spark.createDataFrame(rows, "index long, g_index long, split string, l2 string, category string, hit int")
    got = {(r["setting"], r["split"], r["scope"], r["group"]): (r["value"], r["n"]) for r in co.vanilla_vs_circular(df, "l2", "category").collect()}
    plain = {"vanilla": df.filter("index = g_index"), "all": df, "circular": co.circular_eval(df, ["split", "l2", "category"])}
    want = {(name, r["split"], r["scope"], r["group"]): (r["value"], r["n"]) for name, view in plain.items() for r in rp.report_acc(view, "l2", "category").collect()}
    assert got == want
    keyless = co.vanilla_vs_circular(df.drop("split"), "l2", "category").filter("setting = 'circular' AND scope = 'overall'").collect()
    assert [(r["split"], r["value"], r["n"]) for r in keyless] == [("none", 0.5, 3)]
