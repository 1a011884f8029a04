"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The pre-tokenizer of a byte-level BPE never joins characters across the start of a run of blanks, nor
a letter and the one mark that ends its word, so a text may be cut there and equal parts encoded
once. Parts are found and looked up by 64-bit hash, a window of text at a time. Texts with other
white space or with a special token's string are given to the tokenizer whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from scoreloom.llm.common import mix, span_sums, text_buffers

END_ID = 0
CACHE_PARTS = 1_000_000
JOINED = 2000
WINDOW = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A, 0x0D, 0x09]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ODD = np.zeros(256, bool)
_ODD[[0x0B, 0x0C, *range(0x1C, 0x20)]] = True
#: the other characters that some definition of white space has
_WIDE = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_KNOWN: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _part_starts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where parts begin: at texts, at runs of blanks, at one ``.`` or ``,`` between a letter and blanks."""
    blank = _BLANK[data]
    begin = np.empty(len(data), bool)
    begin[0] = True
    np.logical_and(blank[1:], ~blank[:-1], out=begin[1:])
    ends = np.empty(len(data), bool)
    ends[-1] = True
    ends[:-1] = blank[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    ends[cuts - 1] = True
    mark = np.flatnonzero(((data == 0x2E) | (data == 0x2C)) & ends)
    mark = mark[mark > 1]
    before, lead = data[mark - 1], data[mark - 2]
    latin = (lead == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)
    begin[mark[_ALNUM[before] | latin]] = True
    begin[cuts] = True
    return np.flatnonzero(begin)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self._ids(["\n"])[0][0]
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _ids(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """Adds the ids of parts that are not known yet.

        A new line between parts that begin with at most one blank, and end in none, is a token of its
        own, so thousands of parts are encoded as one text.
        """
        plain = np.fromiter((not _BLANK[p[-1]] and b"\n" not in p and not (len(p) > 1 and _BLANK[p[0]] and (p[0] != 32 or _BLANK[p[1]])) for p in parts), bool, len(parts))
        easy, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, lengths = [], np.zeros(len(parts), np.int64)
        joined = [b"\n".join(parts[i] for i in easy[at : at + JOINED]).decode() for at in range(0, len(easy), JOINED)]
        for n, found in enumerate(self._ids(joined) if joined else []):
            flat = np.array(found, np.uint32)
            line = np.flatnonzero(flat == self.line)
            lengths[easy[n * JOINED : (n + 1) * JOINED]] = np.diff(np.concatenate([[-1], line, [len(flat)]])) - 1
            ids.append(np.delete(flat, line))
        for i, found in zip(rest, self._ids([parts[i].decode() for i in rest]) if len(rest) else [], strict=True):
            lengths[i] = len(found)
            ids.append(np.array(found, np.uint32))
        order = np.concatenate([easy, rest])
        flat = np.concatenate(ids)
        if self.used + len(flat) > len(self.pool):
            grown = np.zeros(2 * (self.used + len(flat)), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(flat)] = flat
        starts = np.zeros(len(parts), np.int64)
        starts[order] = self.used + np.cumsum(lengths[order]) - lengths[order]
        self.used += len(flat)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, starts.astype(np.int32))
        self.lengths = np.insert(self.lengths, at, lengths.astype(np.int32))

    def _window(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a window of whole parts, and the number of ids of each text; ``cuts``: bounds of the texts."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(cuts) - 1, np.int64)
        first = _part_starts(data, cuts)
        end = np.append(first[1:], len(data))
        distinct, where, back = np.unique(span_sums(data, first, end), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_PARTS:
            self._clear()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(first[where[new]].tolist(), end[where[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        lengths = self.lengths[at][back].astype(np.int64)
        sums = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        ids = self.pool[np.repeat(self.starts[at][back] - sums[:-1], lengths) + np.arange(sums[-1])]
        return ids, np.diff(sums[np.searchsorted(first, cuts)])

    def _odd(self, raw: bytes, data: np.ndarray) -> list[int]:
        """Places of what is encoded with the whole text only."""
        found = np.flatnonzero(_ODD[data]).tolist()
        for sign in [*self.special, *_WIDE]:
            at = raw.find(sign)
            while at >= 0:
                found.append(at)
                at = raw.find(sign, at + 1)
        return found

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order, without an end id; a null text has none."""
        data, bounds = text_buffers(texts)
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + WINDOW, "right")) - 1)
            lo, hi = int(bounds[row]), int(bounds[stop])
            window = data[lo:hi]
            raw = window.tobytes()
            cuts = bounds[row : stop + 1] - lo
            odd = np.unique(np.searchsorted(cuts, self._odd(raw, window), "right") - 1) if hi > lo else np.zeros(0, np.int64)
            if hi - lo > WINDOW and not len(odd):
                yield self._long(window)
            else:
                whole = dict(zip(odd.tolist(), self._ids([raw[cuts[i] : cuts[i + 1]].decode() for i in odd]), strict=True)) if len(odd) else {}
                ids, counts = self._window(window, cuts) if hi - lo <= WINDOW else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
                at = np.zeros(len(counts) + 1, np.int64)
                np.cumsum(counts, out=at[1:])
                for i in range(stop - row):
                    yield np.array(whole[i], np.uint32) if i in whole else ids[at[i] : at[i + 1]]
            row = stop

    def _long(self, data: np.ndarray) -> np.ndarray:
        parts, at = [], 0
        while at < len(data):
            stop = min(len(data), at + WINDOW)
            if stop < len(data):
                blank = _BLANK[data[at:]] if stop + WINDOW >= len(data) else _BLANK[data[at : stop + WINDOW]]
                runs = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
                inside = runs[runs <= stop - at]
                stop = at + int(inside[-1]) if len(inside) else at + int(runs[0]) if len(runs) else len(data)
            parts.append(self._window(data[at:stop], np.array([0, stop - at]))[0])
            at = stop
        return np.concatenate(parts)


def encoder(path: str) -> Encoder:
    """One encoder per file in this process."""
    if path not in _KNOWN:
        _KNOWN[path] = Encoder(path)
    return _KNOWN[path]
