"""Collocations, decontamination and the divergence audit against plain versions and their SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from scoreloom.llm import collocations, decontamination, divergence, queries

from .conftest import DATA, EDGE


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    found = queries.QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert rows and sorted(rows, key=repr) == sorted(wanted.fetchall(), key=repr)


# ---- collocations ---------------------------------------------------------------------------------


def plain_collocations(rows, least, share, top):
    """Phrases one by one: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored, longer = [], Counter()
        for q, b in candidates.items():
            for part in {q[i:j] for i in range(len(q)) for j in range(i + 1, len(q) + 1) if j - i < len(q)}:
                longer[part] = max(longer[part], b)
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, s[2].decode(), -s[1], s[3], s[4], n[lang], -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_collocations_of_awkward_rows(edge):
    rows = [(r[2], r[1]) for r in EDGE]
    for least, share, top in ((1, 50, 2000), (2, 90, 5)):
        found = [tuple(r) for r in collocations.collocations(edge, least, (share, 100), top).collect()]
        assert sorted(found) == plain_collocations(rows, least, share, top)


@pytest.mark.parametrize("wide", [1, 3, 256])
def test_collocations_over_flushes_and_parts(spark, rng, monkeypatch, wide):
    words = ["a", "b", "c", "dd", "e,", "f.", "É", "A", "\x00", "b\x1fc"]
    rows = [(str(rng.choice(["x", "y"])), " ".join(rng.choice(words, int(rng.integers(0, 60))))) for _ in range(150)] + [(None, "a b a b a b a b")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 100)
    monkeypatch.setattr(collocations, "PARTS", 3)
    monkeypatch.setattr(collocations, "WIDE", wide)
    found = [tuple(r) for r in collocations.collocations(df, 4, (50, 100), 40).collect()]
    assert sorted(found) == plain_collocations(rows, 4, 50, 40)


def test_a_prefix_stays_small_in_every_bucket():
    for total in (0, 10**8, 10**11, 10**14):
        buckets, wide, parts = collocations._limits(total)
        flushes = 1 + total // (4 * collocations.FLUSH_WORDS)
        assert wide * flushes <= max(collocations.ENTRIES, flushes) and flushes * collocations.FLUSH_WORDS / 3 / parts <= 2 * collocations.ENTRIES
        assert buckets * collocations.BUCKET_BYTES >= total


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 3_000_000_000_001
    row = spark.createDataFrame([(big, big + 7, big + 11)], "a long, l long, r long")
    assert row.select(collocations._cut(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()["s"] == 1_000_000 * big * big // ((big + 7) * (big + 11))


def test_collocations_of_nothing(empty, spark):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "..,,"), ("en", "one")], "lang string, text string"), 1).count() == 0


# ---- decontamination ------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_passages(docs, items, window):
    patterns = defaultdict(set)
    for name, text in items:
        w = WORD.findall(lowered(text))
        if w:
            long = min(window, len(w))
            for i in range(len(w) - long + 1):
                patterns[tuple(w[i : i + long])].add(str(name) if name is not None else "")
    out = []
    for doc_id, text in docs:
        w, hit, ids = WORD.findall(lowered(text)), set(), set()
        for long in {len(p) for p in patterns}:
            for i in range(len(w) - long + 1):
                found = patterns.get(tuple(w[i : i + long]))
                if found:
                    hit |= set(range(i, i + long))
                    ids |= found
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
ITEMS = [
    ("q1", "One two THREE four"), ("q2", "four five"), ("q2", "five six"), (None, "mixed 日本語"), ("empty", ""), ("null", None), ("q10", "three; four! five"),
    ("q3", "word"), ("q1", "One two THREE four"), ("long", "w1x w2xx w3xxx w4xxxx w5 w6x w7xx w8xxx w9xxxx w10 w11x w12xx"),
]


@pytest.mark.parametrize("automaton_words", [500_000, 6])
def test_passages_of_awkward_rows(spark, edge, automaton_words, monkeypatch):
    bench = spark.createDataFrame([(a, b, 1) for a, b in ITEMS], "item_id string, text string, rid int")
    found = decontamination.find_passages(edge, bench, 3, automaton_words)
    monkeypatch.setattr(decontamination, "find_passages", lambda *_: found)
    rows = [tuple(r) for r in decontamination.report(edge, bench, 3).select(*COLUMNS).collect()]
    assert sorted(rows, key=repr) == plain_passages([(r[0], r[1]) for r in EDGE], ITEMS, 3)


def test_spans_are_places_in_the_original(spark):
    text = "Éa — (ONE  two, three) x four: FIVE six; ONE two three"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "one two three"), ("b", "two three x four five")], "item_id string, text string")
    row = decontamination.find_passages(docs, bench, 3).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["ONE  two, three) x four: FIVE", "ONE two three"]
    assert [(s["first"], s["last"]) for s in row["spans"]] == [(2, 7), (9, 11)] and row["items"] == ["a", "b"]
    several = decontamination.find_passages(docs, bench, 3, 2).first()
    assert several == row
    assert [r["doc_id"] for r in decontamination.without_passages(spark.createDataFrame([(1, text), (2, "free"), (None, "one two")], docs.schema), bench, ["doc_id"], 3).collect()] == [2, None]


def test_random_passages(spark, rng):
    words = [f"w{i}" for i in range(12)]
    say = lambda least, most: " ".join(rng.choice(words, int(rng.integers(least, most))))
    items = [(f"i{i}", say(0, 9)) for i in range(25)]
    docs = [(i, say(0, 80)) for i in range(60)]
    found = decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), 4)
    assert sorted([tuple(r) for r in found.select(*COLUMNS).collect()], key=repr) == plain_passages(docs, items, 4)


def test_letters_of_words_do_not_meet_between_words():
    import numpy as np

    spelt = decontamination.spell(np.array([0, 1, 256, 65_535]), 2)
    assert len(np.unique(spelt[1:, 0])) == 3 and not set(spelt[1:, 0]) & set(spelt[1:, 1]) and not spelt[0].any()


def test_empty_tables(spark, empty, documents):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontamination.report(empty, none).count() == 0
    assert not decontamination.report(documents, none).filter("contaminated OR n_hit > 0 OR n_items > 0").count()


# ---- divergence -----------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, least, top):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(lowered(text))
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang, seen in docs.items():
        kept = sorted(t for t, n in seen.items() if n >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum((Counter(c) for c in groups.values()), Counter()))
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_audit_of_awkward_rows(edge):
    for least, blocks in ((1, (32, 8192)), (2, (1, 7))):
        found = [tuple(r) for r in divergence.audit(edge, least, 3, *blocks).collect()]
        assert sorted(found) == plain_audit([(r[1], r[2], r[3]) for r in EDGE], least, 3)


def test_audit_by_small_blocks(spark, rng, monkeypatch):
    rows = [(" ".join(f"{c}é" for c in rng.choice(list("abcdefghijABC"), int(rng.integers(0, 30)))), str(rng.choice(["x", "y"])), f"s{int(rng.integers(0, 9))}") for _ in range(200)]
    rows += [("rare", "z", "only"), ("", "z", "other"), (None, None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    monkeypatch.setattr(divergence, "FLUSH_WORDS", 200)
    wanted = plain_audit(rows, 30, 4)
    for blocks in ((2, 3), (4, 1), (32, 8192)):
        assert sorted(tuple(r) for r in divergence.audit(df, 30, 4, *blocks).collect()) == wanted


def test_a_pair_is_named_alike_in_every_term_block():
    row = lambda source, terms, share: {"source": source, "unseen": 1, "kept": 3, "terms": terms, "shares": share, "side": 0}
    slices = [row("s2", ["x"], [5]), row("s1", ["x", "y"], [2, 4])]
    key = tuple(pa.scalar(k) for k in ("en", 0, 0, 0))
    types = pa.schema([("source", pa.string()), ("unseen", pa.int64()), ("kept", pa.int64()), ("terms", pa.list_(pa.string())), ("shares", pa.list_(pa.int64())), ("side", pa.int32())])
    for order in (slices, slices[::-1]):
        assert divergence._cell(key, pa.Table.from_pylist(order, types)).to_pylist() == [{"lang": "en", "a": "s1", "b": "s2", "part": 6}]


def test_pairs_over_many_term_blocks(spark, rng):
    rows = [(" ".join(f"{c}é" for c in rng.choice(list("abcdefghijklmnop"), 20)), "x", f"s{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    assert sorted(tuple(r) for r in divergence.audit(df, 3, 4, 32, 2).collect()) == plain_audit(rows, 3, 4)


def test_audit_of_nothing(empty):
    assert divergence.audit(empty).count() == 0
