import hashlib
import re

from pyspark.sql import functions as F

from scoreloom.llm import pii, queries

from .conftest import DATA, EDGE

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def expected(doc, text):
    spans = base(text or "")
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (doc, *[sum(s[0] == k for s in spans) for k in pii.KINDS], hashlib.sha256(joined.encode()).hexdigest())


def test_base_spans(spark, rows):
    found = sorted(tuple(r)[:6] for r in queries.op3_find_personal_data(spark, DATA).collect())
    assert found == sorted(expected(i, t) for i, t, _ in rows)
    assert sum(sum(r[1:5]) for r in found) > 10


ODD = [
    (1, "a@b.c%d@e.f x@y"), (2, "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 01.02.03.004"), (3, "4111 1111 1111 1111 4111111111111111 4111-1111-1111-1111-5"), (4, None),
    (6, "é😀 a@b.co 😀 +1 (555) 123-4567 +++12345678"), (7, "1" * 3000), (8, "a.b@c" + ".d" * 20000), (9, "5  4111111111111111"), (9, "5  4111111111111111"),
    (None, "x@y.z"), (10, "+1 " + "2 " * 4), (11, "9" * 3000 + " " + "a" * 3000), (12, "\n".join(["4111111111111111"] * 300)), (13, "1 " * 20000), (14, "+12345678. +1234567"),
]


def test_odd_texts(spark, edge, empty):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    assert sorted((tuple(r)[:6] for r in pii.report(df).collect()), key=repr) == sorted((expected(*r) for r in ODD), key=repr)
    assert sorted((tuple(r)[:6] for r in pii.report(edge).collect()), key=repr) == sorted((expected(r[0], r[1]) for r in EDGE), key=repr)
    assert pii.report(empty).collect() == [] and pii.redact(empty, empty.columns).collect() == []


def test_very_long_texts_do_not_recurse(spark):
    df = spark.createDataFrame([(1, "7" * 400_000 + " " + "a" * 400_000 + " +" + "1 " * 100_000), (2, "x@" + "y." * 200_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_card"] for r in pii.report(df).collect()} == {1: 0, 2: 0}


PLANTED = [(i, f"reach her by phone +1 555 123 {1000 + i} now") for i in range(5)] + [
    (200, "reach her by phone 555-0199-22 now"), (201, "chapter 12 of 555-0199-23 pages"), (202, "nothing by phone 12 now"),
]


def test_contexts_discover_unseen_identifiers(spark):
    df = spark.createDataFrame(PLANTED, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert found[200]["spans"] == "phone:19:30" and found[200]["n_phone"] == 0
    assert found[201]["spans"] == found[202]["spans"] == ""
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df, ["doc_id", "text"]).collect()}
    assert texts[0] == texts[200] == "reach her by phone <PHONE> now" and texts[201] == PLANTED[6][1]


def spans(spark, *more):
    df = spark.createDataFrame([*PLANTED, *enumerate(more, 300)], "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.report(df).filter("doc_id >= 300").collect()}


def test_numbers_end_where_the_next_begins(spark):
    found = spans(
        spark, "reach her by phone 555-0199-22 2024 now", "sold 555-0199-22, 2024 or 17 555-0199-22", "reach her by phone 555 0199 22 now",
        "in 2023 555 0199 22 were sold", "reach her by phone 2024 now", "reach her by phone (555) 0199 22. Now")
    assert found[300] == "phone:19:30" and found[301] == "phone:5:16,phone:29:40" and found[302] == "phone:19:30"
    assert found[303] == "phone:8:19" and found[304] == "" and found[305] == "phone:20:32"


MAILS = [(i, f"write to u{i}@site{i}.com today") for i in range(4)]


def test_lists_and_written_at_signs(spark):
    more = [
        (10, "write to x@y.com ann@intranet today"), (11, "write to bob[at]example.org today"), (12, "write to eve@intranet,x@y.com today"),
        (13, "we met (at) noon [at] home"), (14, "elsewhere ann@intranet and BOB[AT]example.org"),
        (15, "write to z@y.com; kim@intranet, x@y.com today"),
    ]
    df = spark.createDataFrame([*MAILS, *more], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df, ["doc_id", "text"]).collect()}
    assert texts[10] == "write to <EMAIL> <EMAIL> today" and texts[11] == "write to <EMAIL> today"
    assert texts[12] == "write to <EMAIL>,<EMAIL> today" and texts[15] == "write to <EMAIL>; <EMAIL>, <EMAIL> today" and texts[13] == more[3][1] and texts[14] == "elsewhere <EMAIL> and <EMAIL>"


def test_context_words_are_whole(spark):
    long = "p" * 300
    seeds = [(i, f"reach {long} by{long} +1 555 123 {1000 + i} now") for i in range(4)]
    other = [(10, f"reach {long} by{long} 555-0199-22 then"), (11, f"reach q{long} by{long} 555-0199-23 then")]
    df = spark.createDataFrame([*seeds, *other], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert found[10].startswith("phone:") and found[11] == ""


def test_instances_against_a_plain_computation(spark, rng):
    """Free tokens, numbers in parts and their contexts, compared with loops over the text."""
    pool = ["a", "bc", "12", "555", "0199", "x@y.com", "ann@in", "(44)", "+1", "4111111111111111", "7,", "c;", "2024.", "no", "bob[at]ex", "1.2.3.4"]
    docs = [(i, "".join(w + (" " if rng.random() < 0.8 else "  ") for w in rng.choice(pool, 40))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.pieces(df)
    base_spans = found.filter(F.col("kind").isin(pii.KINDS)).filter(pii._valid(F.col("kind"), F.col("value")))
    got = pii._in_context(found.filter("kind = 'token'"), base_spans)
    free = got.filter("NOT hit")
    key = lambda r: (r["doc_id"], r["start"], r["end"], r["value"], r["l2"], r["l1"], r["r1"])
    tokens, numbers = [], []
    for doc, text in docs:
        covered = {p for _, a, b in base(text) for p in range(a, b)}
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\s,;|]+", text)]
        touched = lambda w: any(p in covered for p in range(w[0], w[1])) and re.search("[0-9@]", w[2])
        seen = [w for w in words if not touched(w)]
        for a, b, w in seen:
            if re.search(r"[0-9@]|[\[(]at[\])]", w):
                left, right = [x[2] for x in seen if x[1] <= a][-2:], [x[2] for x in seen if x[0] >= b][:1]
                tokens.append((doc, a, b, w, *([None] * (2 - len(left)) + left), right[0] if right else None))
        part = {t[1]: t for t in tokens if t[0] == doc and not re.search("[A-Za-z@]", t[3]) and len(re.sub("[^0-9]", "", t[3])) < 7}
        for t in part.values():
            value, end, here = t[3], t[2], t
            while text[end:end + 1] == " " and end + 1 in part:
                here = part[end + 1]
                value, end = f"{value} {here[3]}", here[2]
                n = len(re.sub("[^0-9]", "", value))
                if n > 19:
                    break
                if n >= 7:
                    numbers.append((doc, t[1], end, value, t[4], t[5], here[6]))
    assert sorted(map(key, free.collect()), key=repr) == sorted(tokens, key=repr) and len(tokens) > 200
    assert sorted(map(key, pii._in_parts(free).collect()), key=repr) == sorted(numbers, key=repr) and len(numbers) > 20


def test_seeds_must_differ(spark):
    same = [(i, "reach her by phone +1 555 123 1000 now") for i in range(5)] + [PLANTED[5]]
    assert {r["spans"] for r in pii.report(spark.createDataFrame(same, "doc_id long, text string")).filter("doc_id = 200").collect()} == {""}


def test_redaction_keeps_the_rest(spark, documents, rows):
    found = {r["doc_id"]: r["text"] for r in pii.redact(documents, ["doc_id", "text"]).collect()}
    for doc, text, _ in rows:
        spans = sorted(((a, b, k) for k, a, b in base(text)))
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], pii.TAGS[k]]
            at = max(at, b)
        assert found[doc] == "".join(out) + text[at:]


def test_main_path_is_native(documents):
    for df in (pii.report(documents), pii.redact(documents, documents.columns)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_of_the_same_names_survive(edge):
    kept = pii.redact(edge.withColumn("_s", F.lit(1)), [*edge.columns, "_s"])
    assert kept.columns == [*edge.columns, "_s"] and kept.count() == len(EDGE)
