import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import packing, queries, token_files, tokens

from .conftest import DATA, EDGE

ODD = [
    "a  b", "a   b\n\n c. ", "x .,! y.,", "don't 'tis a.b 3.14, 1,000. ", "a \xa0 b c", "\n a\r\n\tb ", "<|endoftext|> x", "é.ü, ß. ×y ÷.", "", " ", "..  ..,", "a.\n.b ,c",
    "日本語。 テスト, ok.", "€, ×. à.", "x", "\n", "a\n\nb", " \n", "a\x1cb \x0b c", "  b",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def plain(tokenizer, texts):
    return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("window", [16, 64, 1 << 20])
def test_parts_give_the_ids_of_the_whole(tokenizer, rows, window, monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", window)
    texts = [*ODD, None, *[t for _, t, _ in rows[:60]]]
    found = list(tokens.Encoder(tokens.default_path()).encode(pa.array(texts)))
    assert [f.tolist() for f in found] == [p.tolist() for p in plain(tokenizer, texts)]


def check_pieces(found, texts, ids, capacity):
    left = sorted((str(d), zlib.crc32(x.tobytes()), len(x)) for d, x in zip(texts, ids, strict=True))
    lengths = sorted(r["length"] for r in found)
    assert lengths == sorted(n for x in ids for n in packing.piece_lengths(len(x), capacity))
    assert sum(n for _, _, n in left) == sum(lengths)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(lengths) // capacity)


def test_pack(spark, rows, tokenizer):
    found = queries.op4_pack_sequences(spark, DATA).collect()
    ids = [np.append(x, np.uint32(0)) for x in plain(tokenizer, [t for _, t, _ in rows])]
    used, least = check_pieces(found, [i for i, _, _ in rows], ids, 2048)
    assert used <= least + 2
    by = dict(zip([i for i, _, _ in rows], ids, strict=True))
    for r in found:
        part = by[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"]


def test_pack_edge_rows(edge, empty, tokenizer):
    ids = [np.append(x, np.uint32(0)) for x in plain(tokenizer, [r[1] for r in EDGE])]
    check_pieces(packing.pack_documents(edge, capacity=256).collect(), [r[0] for r in EDGE], ids, 256)
    assert packing.pack_documents(empty).collect() == []


def test_sequences_hold_their_pieces(documents, rows, tokenizer):
    pieces = packing.stored(packing.token_pieces(documents, tokens.default_path(), 512, with_ids=True), "pieces")
    built = packing.sequences(pieces, packing.place(pieces.drop("ids"), 512)).collect()
    total = sum(len(x) + 1 for x in plain(tokenizer, [t for _, t, _ in rows]))
    assert sum(len(r["ids"]) // 4 for r in built) == total and max(len(r["ids"]) // 4 for r in built) <= 512


def test_exchanges_save_sequences(rng):
    for lengths in (rng.integers(600, 1100, 1500), rng.integers(500, 900, 1500), np.minimum(2048, rng.lognormal(6, 1.2, 3000).astype(int) + 1)):
        bins = packing.Bins(lengths.astype(np.int64), 2048)
        before, squares = len(bins.free), (np.bincount(bins.bin, lengths) ** 2).sum()
        bins.improve()
        fill = np.bincount(bins.bin, lengths)
        assert fill.max() <= 2048 and len(np.unique(bins.bin)) <= before and (fill**2).sum() >= squares
    assert packing.pack_lengths(np.array([], int)).tolist() == []


def improving(lengths, bins, capacity):
    """An exchange of up to two pieces for up to two that raises the sum of squared fills, by trying all."""
    fill = np.bincount(bins, lengths).astype(int)
    inside = [[int(n) for n in lengths[bins == b]] for b in range(len(fill))]
    some = lambda own: {0, *own, *[x + y for x, y in combinations(own, 2)]}
    open_ = [b for b in range(len(fill)) if 0 < fill[b] < capacity]
    for a, b in combinations(open_, 2):
        for x in some(inside[a]):
            for y in some(inside[b]):
                after = (fill[a] - x + y, fill[b] + x - y)
                if max(after) <= capacity and after[0] ** 2 + after[1] ** 2 > fill[a] ** 2 + fill[b] ** 2:
                    return a, b, x, y
    return None


@pytest.mark.parametrize("seed", range(6))
def test_search_ends_without_an_exchange_left(seed):
    rng = np.random.default_rng(seed)
    for lengths in (rng.integers(600, 1100, 120), rng.choice([410, 640, 700, 900], 120), rng.integers(150, 400, 120)):
        bins = packing.Bins(lengths.astype(np.int64), 2048)
        bins.improve()
        spare = sum(f for f in bins.free if f < 2048)
        assert np.bincount(bins.bin, lengths).max() <= 2048
        assert spare < 2048 or improving(lengths, bins.bin, 2048) is None


@pytest.mark.parametrize(("low", "high", "most"), [(500, 900, 0.94), (600, 1100, 0.98)])
def test_a_full_shard_needs_fewer_sequences(low, high, most):
    lengths = np.sort(np.random.default_rng(7).integers(low, high, packing.SHARD_PIECES))[::-1].copy()
    best_fit = len(packing.Bins(lengths, 2048).free)
    placed = packing.pack_lengths(lengths)
    assert np.bincount(placed, lengths).max() <= 2048
    assert len(np.unique(placed)) <= most * best_fit


def test_elias_fano(rng):
    for values in (np.cumsum(rng.integers(1, 900, 3000)), np.array([5]), np.array([0, 0, 3, 1_000_000, 1_000_001]), np.cumsum(rng.integers(0, 2, 2000)), np.array([], int)):
        code = token_files.EliasFano.encode(values)
        assert code.decode().tolist() == values.tolist()
        assert [code[i] for i in range(0, len(values), 7)] == values[::7].tolist()
        if len(values) > 1000:
            assert 8 * (len(code.low) + len(code.high)) <= len(values) * (2.1 + max(0, np.log2(values[-1] / len(values))))


def check_files(found, texts, tokenizer):
    ids = dict()
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    expected = {}
    for doc, text in order:
        x = np.append(plain(tokenizer, [text])[0], np.uint32(0)).astype("<u4")
        expected.setdefault(doc, []).append((len(x), zlib.crc32(x.tobytes())))
        ids.setdefault(doc, at)
        at += len(x)
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert set(got) == set(expected)
    for doc, parts in got.items():
        assert sorted((n, c) for _, n, c in parts) == sorted(expected[doc])
        start = ids[doc]
        for s, n, _ in sorted(parts):
            assert s == start
            start += n


def test_token_files(spark, rows, tokenizer):
    check_files(queries.op7_token_files(spark, DATA).collect(), [(i, t) for i, t, _ in rows], tokenizer)


def test_token_files_edge_rows(edge, empty, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "PARTITION_BYTES", 100_000)
    check_files(token_files.token_files(edge).collect(), [(r[0], r[1]) for r in EDGE], tokenizer)
    assert token_files.token_files(empty).collect() == []


def test_one_document_is_read_by_select():
    parts = [np.arange(n, dtype=np.uint32) for n in (1, 5, 300, 2)]
    file = token_files.TokenFile(token_files.file_bytes([4, None, 6, 7], parts, 2))
    assert file.keys == [4, None, 6, 7] and [file.document(i).tolist() for i in range(4)] == [p.tolist() for p in parts]
