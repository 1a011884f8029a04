"""Edit distances and common subsequences by bit-parallel columns, on Python's unbounded integers.

A column of the dynamic program is kept as bits of two integers (where it rises and where it falls), and
one character of the other text moves the whole column on by a dozen operations. ``Packed`` lays the columns
of many texts side by side in the same integers, a spare bit after each, so that one text is compared with
all of them at once: a page of 10,000 blocks costs some thousand steps a block, not 10,000 comparisons.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: bytes of the integers that ``Packed`` keeps for the characters it has met
CACHE_BYTES = 64 << 20


def common_subsequence(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    column = full
    for x in b:
        met = column & places.get(x, 0)
        column = (column + met | column - met) & full
    return len(a) - column.bit_count()


class Packed:
    """Texts that others are compared with, all at once."""

    def __init__(self, texts: Sequence[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.bits = int((self.lengths + 1).sum())
        self.bytes = -(-self.bits // 8)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.arange(len(points)) + np.repeat(np.arange(len(texts)), self.lengths)
        order = np.argsort(points, kind="stable")
        self.points, self.place = points[order], place[order]
        self.full, self.low = self._integer(place), self._integer(self.starts[self.lengths > 0])
        self.known: dict[str, int] = {}

    def _integer(self, places: np.ndarray) -> int:
        raw = np.zeros(self.bytes, np.uint8)
        np.bitwise_or.at(raw, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
        return int.from_bytes(raw.tobytes(), "little")

    def _of(self, c: str) -> int:
        found = self.known.get(c)
        if found is None:
            lo, hi = np.searchsorted(self.points, [ord(c), ord(c) + 1])
            found = self._integer(self.place[lo:hi])
            if (len(self.known) + 1) * self.bytes > CACHE_BYTES:
                self.known.clear()
            self.known[c] = found
        return found

    def _counts(self, column: int) -> np.ndarray:
        raw = np.frombuffer(column.to_bytes(self.bytes, "little"), np.uint8)
        return np.add.reduceat(np.unpackbits(raw, bitorder="little")[: self.bits], self.starts, dtype=np.int64)

    def distances(self, text: str) -> np.ndarray:
        """The edit distance of ``text`` to each of the texts, in code points."""
        if not len(self.lengths):
            return np.zeros(0, np.int64)
        full, low = self.full, self.low
        rise, fall = full, 0
        for c in text:
            same = self._of(c)
            kept = same | fall
            across = (((same & rise) + rise) ^ rise | same) & full
            up = (fall | full ^ (across | rise)) << 1
            down = (rise & across) << 1 & full
            up = (up | low) & full
            rise, fall = down | full ^ (kept | up), up & kept
        # a column begins at the length of the text and rises or falls by one a row
        return len(text) + self._counts(rise) - self._counts(fall)

    def shares(self, text: str) -> np.ndarray:
        """Distances over the longer length, 0 between empty texts."""
        return self.distances(text) / np.maximum(np.maximum(self.lengths, len(text)), 1)


def mutual_best(left: Sequence[str], right: Sequence[str], rounds: int | None) -> list[tuple[int, int, float]]:
    """Pairs (i, j, share) of texts that are each other's nearest among the free ones, taken in rounds.

    Of equally near ones the first is nearest. ``rounds``: None goes on until one side is used up. Only
    nearest partners are kept, and sought again when they are taken; no matrix of all pairs exists.
    """
    if not left or not right:
        return []
    ours, theirs = Packed(left), Packed(right)
    best = [np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)]
    cost = [np.zeros(len(left)), np.full(len(right), np.inf)]
    for i, text in enumerate(left):
        share = theirs.shares(text)
        best[0][i] = share.argmin()
        cost[0][i] = share[best[0][i]]
        nearer = share < cost[1]
        best[1][nearer], cost[1][nearer] = i, share[nearer]
    free = [np.ones(len(left), bool), np.ones(len(right), bool)]
    pairs: list[tuple[int, int, float]] = []
    while free[0].any() and free[1].any():
        at = np.flatnonzero(free[0])
        at = at[best[1][best[0][at]] == at]
        pairs += zip(at.tolist(), best[0][at].tolist(), cost[0][at].tolist())
        free[0][at], free[1][best[0][at]] = False, False
        rounds = None if rounds is None else rounds - 1
        if rounds == 0:
            break
        for side, texts, other in ((0, left, theirs), (1, right, ours)):
            if free[1 - side].any():
                for k in np.flatnonzero(free[side] & ~free[1 - side][best[side]]).tolist():
                    share = np.where(free[1 - side], other.shares(texts[k]), np.inf)
                    best[side][k] = share.argmin()
                    cost[side][k] = share[best[side][k]]
    return pairs
