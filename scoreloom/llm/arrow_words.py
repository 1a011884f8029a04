"""The words of Arrow text columns as Arrow string arrays, ASCII capitals lowered.

Words are spans of bytes of a given class; their bytes are laid end to end, so Arrow's own dictionary
encoding numbers them exactly. Memory is bounded by the window, or by one text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from scoreloom.llm.common import _LOWER, text_buffers

#: A-Z, a-z and every byte of a longer character
ALPHABETIC = np.zeros(256, bool)
ALPHABETIC[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Words:
    """Words of the texts ``row`` to ``row + len(counts) - 1`` of a column."""

    row: int
    counts: np.ndarray
    #: lowered bytes of the texts, where each word begins and ends in them, and where the texts begin (and the last ends)
    data: np.ndarray
    first: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    words: pa.LargeStringArray

    @property
    def rows(self) -> np.ndarray:
        """The text of each word, from 0."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def split_words(texts: pa.Array, word: np.ndarray, window: int = 1 << 21) -> Iterator[Words]:
    """The words of every text, some whole texts at a time; null texts have none."""
    data, bounds = text_buffers(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + window, "right")) - 1)
        lo, hi = int(bounds[row]), int(bounds[stop])
        low = _LOWER[data[lo:hi]]
        starts = bounds[row : stop + 1] - lo
        inside = word[low]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = starts[(starts > 0) & (starts < len(low))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        first, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(end - first, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
        yield Words(row, np.diff(np.searchsorted(first, starts, "left")), low, first, end, starts, words)
        row = stop


def numbered_words(parts: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """The number of every word of ``parts``, one after the other, and the distinct words by number."""
    if not sum(map(len, parts)):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    coded = pa.concat_arrays([p.cast(pa.large_string()) for p in parts]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def string_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    from scoreloom.llm.common import span_sums

    data, bounds = text_buffers(values)
    return span_sums(data, bounds[:-1], bounds[1:]) if len(values) else np.zeros(0, np.uint64)
