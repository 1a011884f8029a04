import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import components, fingerprints, jaccard_join, neighbours, queries

from .conftest import DATA, EDGE

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPITALS))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def plain_classes(texts):
    """(id, size, smallest id reachable) of every row, by counting shared n-grams of all pairs."""
    sets = [shingles(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for g in s for j in lists[g]).items():
            if 100 * shared >= 75 * (len(s) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            lists[g].append(i)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        least[root(i)] += [doc] if doc is not None else []
    return sorted(((str(doc), len(sets[i]), min(least[root(i)], default=None)) for i, (doc, _) in enumerate(texts)), key=repr)


def found_classes(df):
    return sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_classes(spark, rows):
    texts = [(i, t) for i, t, _ in rows]
    expected = plain_classes(texts)
    assert found_classes(queries.op6_jaccard_join(spark, DATA)) == expected
    assert len({c for _, _, c in expected}) < len(texts)


def near_copies(rng, groups=6, members=60, words=120):
    """Groups whose members are random edits of one text: most pairs are below the similarity, chains are not."""
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(groups):
        base = [f"g{g}x{i}" for i in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(0, words))] = f"e{rng.integers(1 << 30)}"
            if rng.random() < 0.2:
                own += passage
            texts.append(" ".join(own))
    texts += [" ".join([*passage, *[f"o{i}y{k}" for k in range(int(rng.integers(3, 40)))]]) for i in range(80)]
    texts += texts[:20]
    return [(int(i), texts[k]) for k, i in enumerate(rng.permutation(len(texts)))]


@pytest.mark.parametrize("block", [400_000, 3_000])
def test_groups_of_near_copies_in_blocks(spark, rng, block, monkeypatch):
    texts = near_copies(rng)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", block)
    monkeypatch.setattr(jaccard_join.link_sets, "__defaults__", (jaccard_join.SIMILARITY, block))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert found_classes(jaccard_join.classes(df).drop("text_hash")) == plain_classes(texts)


def test_class_edge_rows(edge, empty):
    texts = [(r[0], r[1]) for r in EDGE]
    assert found_classes(jaccard_join.classes(edge)) == plain_classes(texts)
    assert jaccard_join.classes(empty).collect() == []
    kept = jaccard_join.keep_one(edge, edge.columns)
    assert kept.columns == edge.columns
    # the long text and its copy, the equal words, the six words: one each; three wordless rows stay
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "-9"])
    assert jaccard_join.keep_one(empty, empty.columns).collect() == []


def test_search_links_is_exact(rng):
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
        sets = []
        for _ in range(25):
            keep = base[rng.random(80) < rng.choice([0.5, 0.85, 0.95])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, int(rng.integers(0, 15))).astype(np.uint64)])))
        sets.sort(key=len)
        sizes = np.array([len(s) for s in sets])
        for side in (None, (np.arange(25) % 2).astype(np.int8)):
            forest = jaccard_join.Forest(25)
            for i in range(25):
                for j in range(i):
                    shared = len(np.intersect1d(sets[i], sets[j]))
                    if (side is None or side[i] != side[j]) and 100 * shared >= 75 * (sizes[i] + sizes[j] - shared):
                        forest.join(i, j)
            links = jaccard_join.search_links(sets, sizes, side, jaccard_join.SIMILARITY)
            other = jaccard_join.Forest(25)
            assert all(other.join(a, b) for a, b in links)
            assert [other.root(i) for i in range(25)] == [forest.root(i) for i in range(25)]


def test_components(spark, rng):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    loops = [(5000, 5000), (6000, 6001), (6001, 6000)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame([*path, *star, *loops], "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[1000 + i] for i in range(300)} == {1000} and found[6001] == 6000


def test_fingerprints(spark, rows):
    docs = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    found = {r["doc_id"]: r for r in queries.op1_edit_fingerprints(spark, DATA).collect()}
    mark = lambda t: fingerprints.embed(fingerprints._codes(t), fingerprints._walk(fingerprints._codes(t), 0))
    for k, (doc, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited, r = text[: len(text) - half] + following[:half], found[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.write(mark(text)) and r["edited_fingerprint"] == fingerprints.write(mark(edited))
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(mark(text), mark(edited)))
        assert r["near_next"] == pytest.approx(fingerprints.likeness(mark(text), mark(following)))
    assert np.mean([r["near_edited"] > r["near_next"] for r in found.values()]) > 0.98


def test_sequence_over_many_runs(spark):
    texts = [(int(i), f"text number {i} " * (i % 7)) for i in range(-50, 300, 3)] + [(None, "no id"), (400, ""), (400, "again"), (400, "again")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = fingerprints.in_sequence(df, partition_bytes=700).rdd.glom().collect()
    runs = {}
    for part in got:
        for r in part:
            runs.setdefault(r["run"], []).append((r["ahead"], r["doc_id"], r["text"]))
    assert len(runs) > 5
    order = [runs[k] for k in sorted(runs)]
    plain = [x[1:] for run in order for x in run if not x[0]]
    assert [i for i, _ in plain] == sorted((i for i, _ in texts if i is not None), reverse=True) + [None]
    for k, run in enumerate(order):
        following = order[(k + 1) % len(order)]
        assert next(x[1:] for x in run if x[0]) == following[0][1:]


def test_fingerprint_edge_rows(edge, empty):
    found = fingerprints.with_classes(fingerprints.fingerprint_documents(edge)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in found) == sorted((str(r[0]), len(r[1] or "")) for r in EDGE)
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (4,)}) == 1
    classes = {str(r["doc_id"]): r["class_id"] for r in found}
    assert classes["6"] == classes["5"] == 5
    assert fingerprints.fingerprint_documents(empty).collect() == []


def test_classes_of_documents_that_share_a_template(spark):
    """Pairs of alike texts, all with one template in three fifths of the text, against all pairs."""
    rng = np.random.default_rng(21)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    template, texts = letters(600), []
    for _ in range(200):
        own = template + letters(200)
        texts += [own + letters(200) for _ in range(2)]
    marks = [fingerprints.embed(fingerprints._codes(t), fingerprints._walk(fingerprints._codes(t), 0)) for t in texts]
    written = [fingerprints.write(m) for m in marks]
    alike = [(i, j) for i in range(400) for j in range(i) if fingerprints.likeness(marks[i], marks[j]) >= fingerprints.ALIKE]
    plain = list(range(400))
    for i, j in alike:
        plain = [plain[j] if x == plain[i] else x for x in plain]
    found = fingerprints.with_classes(spark.createDataFrame(list(enumerate(written)), "doc_id long, fingerprint string"))
    classes = {r["doc_id"]: r["class_id"] for r in found.collect()}
    assert len(set(plain)) > 100 and len(alike) >= 100
    assert [classes[i] for i in range(400)] == [plain.index(x) for x in plain]


def test_edits_lower_likeness_slowly(rng):
    base = "".join(rng.choice(list("abcdefgh ijkl mno"), 4000))
    mark = lambda t: fingerprints.embed(fingerprints._codes(t), fingerprints._walk(fingerprints._codes(t), 0))
    seen = []
    for edits in (0, 4, 40, 400):
        own = list(base)
        for _ in range(edits):
            at = int(rng.integers(0, len(own)))
            own[at : at + 1] = rng.choice(["", "z", own[at] + "y"])
        seen.append(fingerprints.likeness(mark(base), mark("".join(own))))
    other = "".join(rng.choice(list("abcdefgh ijkl mno"), 4000))
    assert seen[0] == 1 and seen[1] > 0.95 and seen[2] > 0.8 and seen[3] < seen[2] and fingerprints.likeness(mark(base), mark(other)) < 0.35
    assert fingerprints.read(fingerprints.write(mark(base)))[2].tolist() == mark(base)[2].tolist()


def plain_nearest(rows, queries_, k):
    out = {}
    for q, vector in queries_:
        a = np.array(vector, float)
        scored = []
        for i, other in rows:
            if i != q and len(other) == len(a):
                b = np.array(other, float)
                scored.append((-(a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), i))
        out[q] = sorted(scored)[:k]
    return out


def test_search_reaches_its_recall(spark):
    found = queries.op5_vantage_point_search(spark, "/root/testdata/sf0.1").collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    expected = plain_nearest(vectors, [v for v in vectors if v[0] % 50 == 0], 5)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in found}
    wanted = {(q, i): -s for q, best in expected.items() for s, i in best}
    assert len(found) == len(wanted) and len(got.keys() & wanted.keys()) >= 0.95 * len(wanted)
    assert all(abs(got[k] - wanted[k]) < 1e-12 for k in got.keys() & wanted.keys())


def test_factor_one_is_exact_and_ties_go_to_the_smaller_id(rng):
    centres = rng.normal(size=(12, 8))
    vectors = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.05 * rng.normal(size=(900, 8)), np.repeat(centres[:2], 30, axis=0)])
    ids = rng.permutation(len(vectors)).astype(np.int64)
    tree = neighbours.Tree(ids.copy(), vectors.copy())
    q = ids % 20 == 0
    found, scores, measured = tree.search(ids[q], vectors[q], 5, 1.0)
    expected = plain_nearest(list(zip(ids.tolist(), vectors, strict=True)), list(zip(ids[q].tolist(), vectors[q], strict=True)), 5)
    assert measured < 0.8 * q.sum() * len(ids)
    for row, i in enumerate(ids[q].tolist()):
        np.testing.assert_allclose(scores[row], [-s for s, _ in expected[i]], atol=1e-12)
        assert found[row].tolist() == [j for _, j in expected[i]]
    loose = tree.search(ids[q], vectors[q], 5, 3.0)[2]
    assert loose < measured


def test_search_edge_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0, 0.0]), (8, []), (None, [1.0, 1.0]), (50, [0.0, 2.0]), (100, [1.0, 0.0, 0.0]), (9, [None, 1.0]), (10, [1e-30, 1e-30]),
    ]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    found = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(df, df.filter("id % 50 = 0"), 3, shard_rows=4).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, None, 0.707107), (50, 1, None, 0.707107), (50, 2, 10, 0.707107), (50, 3, 0, 0.0), (100, 1, 7, 1.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).collect() == []


def test_an_ngram_of_all_documents_travels_once_a_task(spark, tmp_path):
    """Counts of sets are right, and a common n-gram is one entry of a task, however many documents have it."""
    common = "one two three four five"
    texts = [f"{common} {i} a b c d e f {i % 7}" for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    folder = str(tmp_path)
    jaccard_join.count_grams(df, folder, 4, 5)
    known = jaccard_join.Counts(folder, 4)
    grams = [next(iter(jaccard_join.gram_sets(pa.array([t]))))[0] for t in texts[:10]]
    plain = {}
    for t in texts:
        w = t.split()
        for k in range(len(w) - 4):
            plain.setdefault(tuple(w[k : k + 5]), set()).add(t)
    assert sorted(known.of(grams[0]).tolist()) == sorted(len(plain[tuple(texts[0].split()[k : k + 5])]) for k in range(9))
    assert known.of(grams[0]).max() == 3000


def test_classes_lose_no_link_at_the_threshold(spark, rng):
    marks = []
    for length in (1, 3, 4, 7, 9, 14, 17, 40, 64, 66, 100, 128, 131, 180, 250, 1000):
        for _ in range(12):
            n = len(fingerprints.sampled_steps(length, fingerprints.level_of(length)))
            values = rng.integers(97, 100, n).astype(np.uint8)
            marks.append((length, fingerprints.level_of(length), values))
            shorter = max(1, length - length // int(rng.integers(5, 30)))
            level = fingerprints.level_of(shorter)
            other = dict(zip(fingerprints.sampled_steps(length, fingerprints.level_of(length)).tolist(), values.tolist()))
            near = np.array([other.get(k, 120) for k in fingerprints.sampled_steps(shorter, level).tolist()], np.uint8)
            spots = rng.permutation(len(near))[: int(rng.integers(0, 1 + len(near) // 4))]
            near[spots] = 121
            marks.append((shorter, level, near))
    written = sorted({fingerprints.write(m) for m in marks})
    marks = [fingerprints.read(t) for t in written]
    label = list(range(len(marks)))
    for i in range(len(marks)):
        for j in range(i):
            if label[i] != label[j] and fingerprints.likeness(marks[i], marks[j]) >= fingerprints.ALIKE:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    found = fingerprints.with_classes(spark.createDataFrame(list(enumerate(written)), "doc_id long, fingerprint string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == dict(enumerate(label))


def test_least_samples_of_a_level():
    for level in range(14):
        least = len(fingerprints.sampled_steps((fingerprints.SAMPLES << level >> 1) + 1, level)) if level else 0
        assert fingerprints.least_samples(level) == least and (not level or 3 * least > 4 * fingerprints.FEWEST)


def edited_copies(rng, n):
    """Fingerprints of texts of which all share much and most pairs are a little too unlike, and their classes by all pairs."""
    base = "".join(rng.choice(list("abcdefgh ijkl mno"), 900))
    texts = []
    for _ in range(n):
        own = list(base)
        for _ in range(int(rng.integers(4, 16))):
            at = int(rng.integers(0, len(own)))
            own[at : at + 1] = rng.choice(["", "z", own[at] + "yx"])
        texts.append("".join(own))
    mark = lambda t: fingerprints.embed(fingerprints._codes(t), fingerprints._walk(fingerprints._codes(t), 0))
    written = sorted({fingerprints.write(mark(t)) for t in texts})
    marks = [fingerprints.read(t) for t in written]
    label = list(range(len(marks)))
    for i in range(len(marks)):
        for j in range(i):
            if label[i] != label[j] and fingerprints.likeness(marks[i], marks[j]) >= fingerprints.ALIKE:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return written, label


def test_rows_of_near_copies_do_not_grow_with_their_pairs(rng):
    written, label = edited_copies(rng, 300)
    found = [(i, *x) for i, text in enumerate(written) for x in fingerprints.meeting_keys(fingerprints.read(text))]
    rows = [(int(k), i, i, *rest) for i, keys, *rest in found for k in keys]
    table = pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("key", "mark", "label", "low", "high", "more", "n"), zip(*rows, strict=True), strict=True)})
    likely = fingerprints._meetings(table, fingerprints.BLOCK)
    assert likely.num_rows <= table.num_rows
    of = likely.column("mark").to_pylist()
    zero = pa.array([0] * len(of), pa.int32())
    met = pa.table({"key": likely.column("key"), "one": zero, "two": zero, "block": zero, "label": likely.column("mark"), "fingerprint": pa.array([written[i] for i in of])})
    links = fingerprints._linked(met, fingerprints.ALIKE)
    # a forest that ties just what is tied by all pairs
    plain = list(range(len(written)))
    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True):
        old, new = max(plain[a], plain[b]), min(plain[a], plain[b])
        assert old != new
        plain = [new if x == old else x for x in plain]
    assert plain == label and 10 < len(set(label)) < len(label) - 10
    # bits alone let through more pairs than there are rows
    marks = [fingerprints.read(t) for t in written]
    near = sum(fingerprints.likeness(marks[i], marks[j]) >= 0.6 for i in range(len(marks)) for j in range(i))
    assert near > likely.num_rows / 2


def test_classes_of_near_copies_in_blocks(spark, rng):
    written, label = edited_copies(rng, 150)
    marked = spark.createDataFrame(list(enumerate(written)), "doc_id long, fingerprint string")
    for block in (fingerprints.BLOCK, 7):
        named = {r["fingerprint"]: r["label"] for r in fingerprints.near_classes(marked, block=block).collect()}
        first = {}
        assert [first.setdefault(named[t], i) for i, t in enumerate(written)] == label


def test_unlike_members_of_a_band_are_not_all_compared(spark, rng, monkeypatch):
    """Fingerprints that are the same at 70 of 100 places, a whole band among them, and alike to none."""
    length, widest = 100, 0
    while widest < 500:
        values = np.tile(rng.integers(0, 256, length).astype(np.uint8), (500, 1))
        values[:, rng.permutation(length)[:30]] = rng.integers(0, 256, (500, 30))
        widest = max(np.unique([k for v in values for k in fingerprints.bands((length, 0, v))], return_counts=True)[1])
    written = sorted({fingerprints.write((length, 0, v)) for v in values})
    met, stored = [], fingerprints.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(fingerprints, "stored", counted)
    found = fingerprints.with_classes(spark.createDataFrame(list(enumerate(written)), "doc_id long, fingerprint string")).collect()
    assert len({r["class_id"] for r in found}) == len(written) == 500
    shared = sum(n for n in np.unique([k for v in values for k in fingerprints.bands((length, 0, v))], return_counts=True)[1] if n > 1)
    assert sum(met) < 2 * fingerprints.LEADERS * shared
