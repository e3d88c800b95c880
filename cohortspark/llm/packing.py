"""Best-fit packing of documents into sequences, by bin completion with branch and bound."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import TEXT_ROWS, stored
from cohortspark.llm.tokens import word_tokens

CAPACITY = 2048
#: Fillings kept per bin, pieces chosen and sizes tried for each before best fit goes on, and bins completed in all, before the best packing so far is taken.
FILLINGS = 8
DEPTH = 3
BRANCHES = 24
NODES = 3_000

_END = b"\0\0\0\0"


@dataclass(frozen=True)
class Filling:
    """``times`` sequences that each hold ``count`` pieces of every ``size`` in ``sizes``."""

    sizes: tuple[tuple[int, int], ...]
    times: int


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can beat.

    For each ``k``: pieces above ``capacity - k`` stand alone among pieces of at least ``k``, those above half a bin have a bin each, and the
    others of at least ``k`` use what these leave.
    """
    sizes = np.arange(capacity + 1)
    number = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(counts * sizes)])
    half = capacity // 2
    k = np.arange(half + 1)
    large = number[-1] - number[capacity - k + 1]
    middle = number[capacity - k + 1] - number[half + 1]
    room = middle * capacity - (volume[capacity - k + 1] - volume[half + 1])
    small = volume[half + 1] - volume[k]
    bounds = large + middle + np.maximum(0, -(-(small - room) // capacity))
    return int(max(bounds.max(), -(-volume[-1] // capacity)))


def _best_fit(counts: np.ndarray, sizes: np.ndarray, chosen: list[int], room: int) -> tuple[tuple[int, ...], int]:
    """``chosen`` and the largest pieces that still fit, one after another; and the room that is left."""
    held = Counter(chosen)
    added = list(chosen[1:])
    at = len(sizes)
    while room:
        at = min(at, int(np.searchsorted(sizes, room, "right")))
        while at and counts[sizes[at - 1]] <= held[int(sizes[at - 1])]:
            at -= 1
        if not at:
            break
        size = int(sizes[at - 1])
        n = int(min(room // size, counts[size] - held[size]))
        held[size] += n
        added += [size] * n
        room -= n * size
    return tuple(added), room


def fillings(counts: np.ndarray, largest: int, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Ways to complete a bin that holds ``largest``: ``(added sizes, waste)``, least waste first.

    Up to ``DEPTH`` pieces are chosen in falling order, the rest is best fit.  A way is dominated by one with fewer and larger
    pieces that wastes no more, so a longer choice is only kept while it wastes less than every shorter one.
    """
    sizes = np.flatnonzero(counts)
    start = [largest]
    whole = _best_fit(counts, sizes, start, capacity - largest)
    found, best = [whole], whole[1]
    stack = [(start, capacity - largest)]
    for _ in range(DEPTH):
        if not best:
            break
        ways = []
        for chosen, room in stack:
            most = min(room, chosen[-1]) if len(chosen) > 1 else room
            for size in sizes[: np.searchsorted(sizes, most, "right")][::-1][:BRANCHES].tolist():
                if counts[size] > chosen.count(size):
                    ways.append(([*chosen, size], room - size))
        for chosen, room in ways:
            way = _best_fit(counts, sizes, chosen, room)
            if way[1] < best:
                found.append(way)
                best = way[1]
                if not best:
                    break
        stack = ways[:BRANCHES]
    return sorted(found, key=lambda f: f[1])[:FILLINGS]


def _take(left: np.ndarray, held: dict[int, int]) -> Filling:
    """Use a filling as often as the pieces last."""
    times = int(min(left[s] // n for s, n in held.items()))
    for s, n in held.items():
        left[s] -= n * times
    return Filling(tuple(sorted(held.items(), reverse=True)), times)


def _greedy(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best fit, falling: around each largest piece, add the largest that fits until none does."""
    left = counts.copy()
    out = []
    while len(sizes := np.flatnonzero(left)):
        largest = int(sizes[-1])
        added, _ = _best_fit(left, sizes, [largest], capacity - largest)
        out.append(_take(left, dict(Counter((largest, *added)))))
    return out


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Fillings for all pieces, given how many there are of each size from 1 to ``capacity``.

    Depth first over bins: the largest piece left is completed in each undominated way, least waste first, and a filling is
    used as often as the pieces last.  A branch whose bins, with the waste bound of the rest, would not be fewer than
    the incumbent's is cut.  The first incumbent is best fit; the search ends at the bound of all pieces, or after ``NODES``.
    """
    start = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        start[size] = n
    least = waste_bound(start, capacity)
    best = _greedy(start, capacity)
    best_bins = sum(f.times for f in best)

    def node(left: np.ndarray, done, bins: int):
        largest = int(np.flatnonzero(left)[-1])
        return left, done, bins, iter(fillings(left, largest, capacity)), largest

    path = [node(start, (), 0)] if best_bins > least else []
    nodes = 0
    while path and best_bins > least and nodes < NODES:
        left, done, bins, ways, largest = path[-1]
        way = next(ways, None)
        if way is None:
            path.pop()
            continue
        nodes += 1
        after = left.copy()
        filling = _take(after, dict(Counter((largest, *way[0]))))
        used = bins + filling.times
        if used + waste_bound(after, capacity) >= best_bins:
            continue
        if after.any():
            path.append(node(after, (done, filling), used))
        else:
            best, best_bins = _chain((done, filling)), used
    return best


def _chain(done) -> list[Filling]:
    out = []
    while done:
        done, filling = done
        out.append(filling)
    return out[::-1]


@dataclass
class Places:
    """Where the pieces of each size go: entry ``e`` takes ``times * count`` pieces from rank ``first`` on."""

    size: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with this rank among those of its size."""
        entry = np.zeros(len(size), np.int64)
        for s in np.unique(size):
            mine = size == s
            a, b = np.searchsorted(self.size, (s, s + 1))
            entry[mine] = a + np.searchsorted(self.first[a:b], rank[mine], side="right") - 1
        within = rank - self.first[entry]
        n = self.count[entry]
        return self.sequence[entry] + within // n, self.offset[entry] + within % n * size


def places(packed: list[Filling]) -> Places:
    rows, used, sequence = [], {}, 0
    for filling in packed:
        offset = 0
        for size, n in filling.sizes:
            rows.append((size, used.get(size, 0), n, sequence, offset))
            used[size] = used.get(size, 0) + n * filling.times
            offset += n * size
        sequence += filling.times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Places(*columns)


def pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every document's pieces; the ids end with id 0.

    A longer document is cut into pieces of ``capacity`` ids, of which the first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                batch = whole.slice(at, TEXT_ROWS)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids = memoryview(ids + _END)
                    total = len(ids) // 4
                    begin, number = 0, 0
                    while begin < total:
                        size = (total - begin - 1) % capacity + 1 if not number else capacity
                        row.append(i)
                        piece.append(number)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * begin : 4 * (begin + size)]))
                        begin, number = begin + size, number + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        *[pa.array(c, pa.int64()) for c in (start, length, crc)],
                    ],
                    names=[key, "piece", "start", "length", "ids_crc32"],
                )

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def pack(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` ids, filled without gaps.

    A null or empty text is the one id 0.  Null keys and repeated rows are pieces of their own.  An empty table gives no
    rows.  The packing itself needs only the number of pieces of each length, at most ``capacity`` numbers, however many
    pieces there are; each piece then finds its place from its rank among those of its length.  Ranks are counted in
    hashed buckets of a length, so a length that very many pieces share is split.
    """
    spark = df.sparkSession
    cut = stored(pieces(df, vocabulary, key, text, capacity), "pieces")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = cut.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(pack_counts(counts, capacity)))  # at most a few entries per length
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "start", "ids_crc32")
    ranked = cut.withColumn("_at", F.row_number().over(inside)).join(starts, ["length", "_bucket"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("_at") - 1).alias("_rank"))
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = where.value.find(size, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
