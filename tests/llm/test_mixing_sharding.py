import re
import zlib
from collections import defaultdict

from scoreloom.llm import mixing, queries, sharding

from .conftest import DATA, EDGE

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORDS.findall(text or ""))


def dealt_seat_by_seat(claims, seats, most):
    given = [0] * len(claims)
    for _ in range(seats):
        open_ = [i for i in range(len(claims)) if claims[i] > 0 and given[i] < most[i]]
        if not open_:
            break
        given[max(open_, key=lambda i: (claims[i] / (2 * given[i] + 1), -i))] += 1
    return given


def test_apportion_is_seat_by_seat_sainte_lague(rng):
    for _ in range(200):
        n = int(rng.integers(1, 8))
        claims = [float(c) for c in rng.integers(0, 50, n)]
        most = [int(m) for m in rng.integers(0, 40, n)]
        seats = int(rng.integers(0, 120))
        assert mixing.apportion(claims, seats, most) == dealt_seat_by_seat(claims, seats, most)


def test_targets_share_the_excess():
    assert mixing.share_out([100, 100, 100], [3, 1, 2], 450, 2) == [200, 250 / 3, 500 / 3]
    assert mixing.share_out([10, 0, 100], [3, 1, 2], 165, 2) == [20, 0, 145]
    assert mixing.share_out([], [], 0, 2) == []


def check_mix(found, texts):
    sources = defaultdict(int)
    for _, text, source in texts:
        sources[source] += size(text)
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.share_out([sources[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sources.values()), 2), strict=True))
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sources[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(i), size(t)) for i, t, _ in texts)
    for s in order:
        assert abs(taken[s] - targets[s]) <= max(2, 0.02 * targets[s]), s


def test_mix(spark, rows):
    first = queries.op2_mix_sources(spark, DATA).collect()
    check_mix(first, rows)
    again = queries.op2_mix_sources(spark, DATA).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mix_edge_rows(edge, empty):
    check_mix(mixing.mix(mixing.sizes_of(edge)).collect(), [(r[0], r[1], r[3]) for r in EDGE])
    assert mixing.mix(mixing.sizes_of(empty)).collect() == []
    mixed = mixing.mix_documents(edge)
    assert mixed.columns == edge.columns
    assert sum(1 for r in mixed.collect() if not size(r["text"])) == 3
    assert mixing.mix_documents(empty).collect() == []


def check_shards(found, texts, shards):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_have_near_equal_bytes(spark, rows):
    found = queries.op9_kd_shards(spark, DATA).collect()
    check_shards(found, [(i, t) for i, t, _ in rows], 24)
    loads = defaultdict(int)
    for r in found:
        loads[r["shard"]] += r["size"]
    largest = max(r["size"] for r in found)
    mean = sum(loads.values()) / 24
    assert len(loads) == 24 and all(abs(x - mean) <= 2 * largest for x in loads.values())
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_equal_texts_of_one_place_are_cut_only_at_borders(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"own {i:04d}", "en", "s", 0) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    found = sharding.shard_documents(df, shards=8).collect()
    counts = defaultdict(int)
    for r in found:
        counts[r["shard"]] += r["size"]
    assert max(counts.values()) - min(counts.values()) <= 40


def test_shard_edge_rows(edge, empty):
    check_shards(sharding.shard_documents(edge, shards=5).collect(), [(r[0], r[1]) for r in EDGE], 5)
    assert sharding.shard_documents(empty).collect() == []
    by_bytes = sharding.shard_documents(edge, shards=None, target_bytes=300_000).collect()
    check_shards(by_bytes, [(r[0], r[1]) for r in EDGE], 8)


def test_equal_texts_stay_together(spark):
    """Whatever their metadata, unless they exceed a shard."""
    rows = [(i, f"text {i % 150:03d} " + "z" * (i % 150), ["en", "de"][i % 2], f"s{i % 7}", 0) for i in range(900)] + [(None, "text 003 zzz", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sharding.shard_documents(df, shards=9).collect()
    places, loads = defaultdict(set), defaultdict(int)
    for r in found:
        places[r["text_crc32"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert len(found) == 901 and all(len(p) == 1 for p in places.values())
    assert len(loads) == 9 and max(loads.values()) - min(loads.values()) < 0.25 * sum(loads.values()) / 9


def plain_tree(rows, shards, spans):
    """A k-d tree row by row: rows are (dims, tie, last, size); returns the shards' rows from left to right."""
    if shards == 1:
        return [rows]
    wide = max(range(len(spans)), key=lambda i: ((max(r[0][i] for r in rows) - min(r[0][i] for r in rows)) / (spans[i] or 1.0), -i))
    ordered = sorted(rows, key=lambda r: (r[0][wide], r[1], r[2]))
    goal, run, cut = sum(r[3] for r in rows) * (shards // 2) / shards, 0, 0
    while run + ordered[cut][3] < goal:
        run += ordered[cut][3]
        cut += 1
    cut += run + ordered[cut][3] - goal < goal - run
    return plain_tree(ordered[:cut], shards // 2, spans) + plain_tree(ordered[cut:], shards - shards // 2, spans)


def test_shards_are_those_of_a_plain_tree(spark, rng, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    monkeypatch.setattr(sharding, "BINS", 7)
    sizes = rng.integers(1, 400, 300)
    df = spark.createDataFrame([(int(i), f"{i:03d}" + "q" * int(n), int(n) % 5) for i, n in enumerate(sizes)], "doc_id long, text string, kind int")
    dimensions = {"kind": F.col("kind"), "length": F.length("text")}
    units, _ = sharding.described(df, dimensions, 6, None)
    kept = units.collect()
    plain = plain_tree([((r["d0"], r["d1"]), r["tie"], r["last"], r["size"], r["doc_id"]) for r in kept], 6, [4.0, float(max(sizes) - min(sizes))])
    wanted = {r[4]: i for i, part in enumerate(plain) for r in part}
    found = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 6, dimensions=dimensions).collect()}
    assert found == wanted
