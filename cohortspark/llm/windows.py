"""Packing into fixed windows: best fit, decreasing, over a segment tree of open windows; what is left open is filled by cuts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import TEXT_ROWS
from cohortspark.llm.tokens import word_tokens

WINDOW = 1024
#: Tokens of short pieces that a task holds before it packs them.
HELD_TOKENS = 1 << 22
#: Rows given out at once; a row has at most one window of ids.
OUT_ROWS = 2048

_END = b"\0\0\0\0"


class Piece(NamedTuple):
    """``length`` ids of one document from ``start`` on; ``key`` is its place among the keys of the task."""

    key: object
    start: int
    length: int
    ids: memoryview
    total: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.key, self.start, at, self.ids[: 4 * at], self.total),
            Piece(self.key, self.start + at, self.length - at, self.ids[4 * at :], self.total),
        )


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities counts them and finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, and its room; it is taken out."""
        count, at = self.count, length + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return self.windows[room].pop(), room


def best_fit_decreasing(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of pieces no longer than ``capacity``: the longest first, each into the tightest open window."""
    open_, out = OpenWindows(capacity), []
    for piece in sorted(pieces, key=lambda p: -p.length):
        found = open_.take(piece.length)
        if found is None:
            window, room = len(out), capacity
            out.append([])
        else:
            window, room = found
        out[window].append(piece)
        if room > piece.length:
            open_.put(window, room - piece.length)
    return out


def fill_by_cuts(windows: list[list[Piece]], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of less than one window that are left.

    The emptiest windows are dissolved, and their pieces, cut where needed, fill the fullest ones up.
    """
    full, partly = [], []
    for window in windows:
        room = capacity - sum(p.length for p in window)
        (partly if room else full).append((room, window))
    partly.sort(key=lambda w: w[0])
    full = [w for _, w in full]
    loose: list[Piece] = []
    held = 0
    at, end = 0, len(partly)
    while at < end:
        room, window = partly[at]
        while held < room and end > at + 1:
            end -= 1
            loose += partly[end][1]
            held += capacity - partly[end][0]
        if held < room:
            return full, window + loose
        held -= room
        while room:
            piece = loose.pop()
            if piece.length > room:
                piece, rest = piece.cut(room)
                loose.append(rest)
            window.append(piece)
            room -= piece.length
        full.append(window)
        at += 1
    return full, loose


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces, cut into windows whose lengths are different powers of two, so that none needs padding."""
    left, out = list(reversed(pieces)), []
    total = sum(p.length for p in pieces)
    while total:
        size = room = 1 << (total.bit_length() - 1)
        window = []
        while room:
            piece = left.pop()
            if piece.length > room:
                piece, rest = piece.cut(room)
                left.append(rest)
            window.append(piece)
            room -= piece.length
        out.append(window)
        total -= size
    return out


def pack_windows(
    df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", capacity: int = WINDOW, held_tokens: int = HELD_TOKENS
) -> DataFrame:
    """``key, start, length, ids, doc_tokens, sequence_id, offset``: the ids of all documents in windows of ``capacity`` ids.

    A document is the ids of its text and the id 0; ``ids`` are a piece's ids as little-endian 32-bit numbers, ``start`` is the number of
    its document's ids before it.  Documents above ``capacity`` are first cut into full windows, each a sequence of its own.
    Their rests and the short documents are packed by best fit, decreasing, as many at a time as have ``held_tokens`` ids;
    windows left open are filled up by cutting pieces of the emptiest ones, and what then remains goes on to the next ones.
    The last ids of a task, fewer than ``capacity``, become sequences whose lengths are powers of two.  So no sequence
    is padded, a task adds at most one small sequence per power of two, and nothing is shuffled.

    A null or empty text is the one id 0.  Null keys and repeated rows are documents of their own; other columns are not
    read; a very long text is one row in memory; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(vocabulary)
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        kept: list[Piece] = []
        held = 0
        key_type = None

        def put(windows: list[list[Piece]]) -> None:
            nonlocal number
            for window in windows:
                at = 0
                for p in window:
                    rows.append((p.key, p.start, p.length, p.ids.tobytes(), p.total, number, at))
                    at += p.length
                number += 1

        def batch() -> pa.RecordBatch:
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for whole in batches:
            key_type = whole.column(0).type
            for first in range(0, whole.num_rows, TEXT_ROWS):
                part = whole.slice(first, TEXT_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for k, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    ids = memoryview(ids + _END)
                    total = len(ids) // 4
                    cut = total - total % capacity
                    for start in range(0, cut, capacity):
                        put([[Piece(k, start, capacity, ids[4 * start : 4 * (start + capacity)], total)]])
                        if len(rows) >= OUT_ROWS:
                            yield batch()
                    if cut < total:
                        rest = memoryview(ids[4 * cut :].tobytes())  # so that a long text's ids need not be held for its rest
                        kept.append(Piece(k, cut, total - cut, rest, total))
                        held += total - cut
                if held >= held_tokens:
                    full, kept = fill_by_cuts(best_fit_decreasing(kept, capacity), capacity)
                    held = sum(p.length for p in kept)
                    for at in range(0, len(full), OUT_ROWS):
                        put(full[at : at + OUT_ROWS])
                        yield batch()
        full, kept = fill_by_cuts(best_fit_decreasing(kept, capacity), capacity)
        put(full)
        put(powers_of_two(kept))
        if rows:
            yield batch()

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
