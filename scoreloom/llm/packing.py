"""Best-fit packing of token sequences with a swap-based local search.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut, the first
piece taking the rest. Pieces are dealt to shards of bounded size by a hash. Each shard is packed by
best fit, longest first, and then improved: the underfull sequences, the emptiest first, give pieces
away by exchanges with others (up to two pieces for up to two, of any lengths), each of which raises
the sum of squared fills, until a whole pass finds no exchange or the volume allows no fewer sequences.
What a sequence could take in is indexed by length, so an attempt costs a look-up for each length given.
Full pieces are sequences of their own.

Null and empty texts are one end id long. Rows with equal or null ids are packed one by one, as rows
of their own; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import stored
from scoreloom.llm.tokens import END_ID, default_path, encoder

CAPACITY = 2048
#: pieces of a shard, about
SHARD_PIECES = 12_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"


def piece_lengths(n: int, capacity: int) -> list[int]:
    """The first piece takes the rest, the others are full."""
    return [n] if n <= capacity else [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and end id; with their ids as unsigned 32-bit integers if wanted."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                raw = np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes()
                at = 0
                for piece, n in enumerate(piece_lengths(len(raw) // 4, capacity)):
                    part = raw[4 * at : 4 * (at + n)]
                    rows.append((doc, piece, at, n, zlib.crc32(part)) + ((part,) if with_ids else ()))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


class Bins:
    """Sequences under work: which piece lies where, and how much room each has."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bin = np.full(len(lengths), -1, np.int64)
        self.free: list[int] = []
        self._best_fit(np.argsort(-lengths, kind="stable"))

    def _best_fit(self, order: np.ndarray) -> None:
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r is set when a sequence has room r
        for i, n in zip(order.tolist(), self.lengths[order].tolist(), strict=True):
            fitting = rooms >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                self.free[b] = room - n
            else:
                b = len(self.free)
                self.free.append(self.capacity - n)
            self.bin[i] = b
            room = self.free[b]
            if room:
                by_room[room].append(b)
                rooms |= 1 << room

    def improve(self) -> int:
        """Exchanges until a whole pass over the open sequences finds none that raises the sum of squared fills.

        Returns how many were made. It also ends where no sequence can be saved any more.
        """
        made, spare = 0, sum(self.free)
        self._index()
        while spare >= self.capacity:
            before = made
            queue = [(-room, b) for b, room in enumerate(self.free) if 0 < room < self.capacity]
            heapify(queue)
            while queue and spare >= self.capacity:
                room, source = heappop(queue)
                if -room != self.free[source]:  # it was a target meanwhile
                    if self.free[source]:
                        heappush(queue, (-self.free[source], source))
                    continue
                self._leave(source)
                while self.free[source] < self.capacity and self._exchange(source):
                    made += 1
                if self.free[source] == self.capacity:
                    spare -= self.capacity
                self._enter(source)
            if made == before:
                break
        return made

    def _index(self) -> None:
        """What the open sequences can give, by the length they could take in for it."""
        self._inside: dict[int, dict[int, list[int]]] = {}  # sequence: length: its pieces
        self._reach: dict[int, dict[int, dict[int, None]]] = {}  # length taken in at most: room: sequences
        self._rooms = [0] * (self.capacity + 1)  # for such a length, bit r is set when a sequence of room r has it
        self._reaches = 0  # bit k is set when there is such a length k
        for i, (b, n) in enumerate(zip(self.bin.tolist(), self.lengths.tolist(), strict=True)):
            if self.free[b]:
                self._inside.setdefault(b, {}).setdefault(n, []).append(i)
        for b in self._inside:
            self._enter(b)

    def _sums(self, b: int) -> set[int]:
        """The lengths of one piece of a sequence and of two."""
        own = sorted(self._inside[b])
        sums = set(own)
        sums.update(2 * n for n in own if len(self._inside[b][n]) > 1)
        for i, n in enumerate(own):
            sums.update([n + m for m in own[i + 1 :]])
        return sums

    def _enter(self, b: int) -> None:
        room = self.free[b]
        if 0 < room < self.capacity:
            for k in (room, *[room + s for s in self._sums(b)]):
                self._reach.setdefault(k, {}).setdefault(room, {})[b] = None
                self._rooms[k] |= 1 << room
                self._reaches |= 1 << k

    def _leave(self, b: int) -> None:
        room = self.free[b]
        for k in (room, *[room + s for s in self._sums(b)]):
            same = self._reach[k][room]
            del same[b]
            if not same:
                self._rooms[k] &= ~(1 << room)
                if not self._rooms[k]:
                    self._reaches &= ~(1 << k)

    def _pieces(self, b: int, total: int) -> list[int]:
        """At most two lengths in a sequence that make up ``total``."""
        own = self._inside[b]
        if not total or total in own:
            return [total] * (total > 0)
        return next([n, total - n] for n in own if total - n in own and (2 * n != total or len(own[n]) > 1))

    def _exchange(self, source: int) -> bool:
        """One exchange of up to two pieces of ``source`` for up to two of another, the one that fills the other best.

        It raises the sum of squares when the other is left with less room than either had. ``source`` is not in the index.
        """
        least, best = self.free[source], None
        for given in sorted(self._sums(source), reverse=True):
            near = self._reaches >> given & ((1 << least) - 1)
            while near:
                left = (near & -near).bit_length() - 1
                rooms = self._rooms[given + left] >> (left + 1)
                if rooms:
                    least, best = left, (given, left + rooms.bit_length())
                    break
                near &= near - 1
            if not least:
                break
        if best is None:
            return False
        given, room = best
        target = next(iter(self._reach[given + least][room]))
        self._leave(target)
        give, take = self._pieces(source, given), self._pieces(target, given + least - room)
        for lengths, a, b in ((give, source, target), (take, target, source)):
            moved = [self._inside[a][n].pop() for n in lengths]
            for n in lengths:
                if n in self._inside[a] and not self._inside[a][n]:
                    del self._inside[a][n]
            self._arrive(moved, b)
        self.free[source] += room - least
        self.free[target] = least
        self._enter(target)
        return True

    def _arrive(self, pieces: list[int], b: int) -> None:
        for i in pieces:
            self.bin[i] = b
            self._inside[b].setdefault(int(self.lengths[i]), []).append(i)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each piece."""
    bins = Bins(np.asarray(lengths, np.int64), capacity)
    bins.improve()
    return bins.bin


def place(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pass a stored table, it is counted first."""
    shards = max(1, -(-pieces.count() // shard_pieces))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins = pack_lengths(frame["length"].to_numpy(), capacity)
        shard = int(frame["_shard"].iloc[0])
        order = np.argsort(bins, kind="stable")
        lengths = frame["length"].to_numpy()[order]
        ends = np.cumsum(lengths)
        first = np.searchsorted(bins[order], bins[order], "left")
        offset = np.empty(len(frame), np.int64)
        offset[order] = ends - lengths - (ends - lengths)[first]
        return frame.drop(columns="_shard").assign(sequence_id=(shard << 32) + bins, offset=offset)

    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(pack, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(stored(token_pieces(docs, tokenizer or default_path(), capacity), "pack-pieces"), capacity)


def sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, joined from its pieces; ids must name documents uniquely."""
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"))
