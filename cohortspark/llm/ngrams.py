"""Hashed n-grams of many texts at once, as numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one numpy call; a longer text is taken in several blocks, so temporaries stay small.
BLOCK_BYTES = 1 << 19

_GOLDEN = np.uint32(2654435761)
_MIX = np.uint32(0x85EBCA6B)


_SPACES = re.compile(rb"[\x20\x09-\x0D][^\x20\x09-\x0D]*\Z")


def _piece_end(padded: bytes, start: int) -> int:
    """Where a block of a long text ends: after the last white space that fits, so that no word is cut, unless it fills the block."""
    end = start + BLOCK_BYTES
    if end >= len(padded):
        return len(padded)
    for reach in (256, BLOCK_BYTES - 1):
        found = _SPACES.search(padded, end - reach, end)
        if found:
            return found.start() + 1
    return end


def text_blocks(texts: list[bytes], gap: bytes, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(bytes, owner, ends)``: all texts, each between ``gap`` bytes, in blocks of bounded size.

    ``owner`` is the index of the text for every byte, ``ends`` the places at which texts end in this block.  Blocks of one
    long text overlap by ``overlap`` bytes, so a window of ``overlap + 1`` bytes that starts in a block's new part lies
    in that block; a window is to be taken only at its first ``len(bytes) - overlap`` places.  After the last text stand ``gap`` bytes.
    """
    parts: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size = 0
    tail = gap * overlap

    def pack():
        buffer = np.frombuffer(b"".join([*parts, tail]), np.uint8)
        sizes = np.array([n for _, n in owners], np.int64)
        return buffer, np.repeat(np.array([o for o, _ in owners], np.int64), sizes), np.cumsum(sizes)

    for i, raw in enumerate(texts):
        padded = gap + raw + gap
        start = 0
        while start < len(padded):
            end = _piece_end(padded, start)
            if start or end < len(padded):  # the pieces of a long text stand alone, as they do not begin with a gap
                buffer = np.frombuffer(padded[start : end + overlap].ljust(end - start + overlap, gap), np.uint8)
                ends = np.array([end - start] if end == len(padded) else [], np.int64)
                yield buffer, np.full(end - start, i, np.int64), ends
                start = end
                continue
            parts.append(padded[start:])
            owners.append((i, end - start))
            size += end - start
            start = end
            if size >= BLOCK_BYTES:
                yield pack()
                parts, owners, size = [], [], 0
    if parts:
        yield pack()


def blocks(texts: list[bytes], gap: bytes, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``text_blocks`` without the ends."""
    for buffer, owner, _ in text_blocks(texts, gap, overlap):
        yield buffer, owner


def crossing(ends: np.ndarray, n: int) -> np.ndarray:
    """Places from which a window of ``n`` bytes would run over the end of its text; every text has two bytes at least."""
    return np.unique(np.maximum(ends[:, None] - np.arange(1, n), np.concatenate([[0], ends[:-1]])[:, None])) if n > 1 and len(ends) else ends[:0]


def gram_hashes(buffer: np.ndarray, count: int, n: int, bits: int) -> np.ndarray:
    """Bucket of the ``n`` bytes from each of the first ``count`` places, below ``2**bits``."""
    code = np.full(count, n, np.uint32)
    for i in range(n):
        code *= _MIX
        code += buffer[i : i + count]
        code ^= code >> np.uint32(15)
    code *= _GOLDEN
    return code >> np.uint32(32 - bits)


#: Blank, tab, line feed, vertical tab, form feed and carriage return separate words; no other byte does.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LETTER = np.random.default_rng(20_260_101).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for ``i < n``; ``base`` is odd."""
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over the whole range (two multiply-and-shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class SpanHasher:
    """Hashes of spans ``[start, end)`` of a sequence of 64-bit values, in time that does not depend on their length."""

    def __init__(self, base: int):
        self.base = base | 1
        self.up, self.down = powers(self.base, 1 << 12)

    def hash(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(values) + 1 > len(self.up):
            self.up, self.down = powers(self.base, 2 * len(values) + 2)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a buffer of bytes."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~SPACE[buffer]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buffer: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and its start offset."""
    starts, ends = word_spans(buffer)
    return hasher.hash(_LETTER[buffer], starts, ends), starts
