"""Hard negatives by an inverted multi-index: cells of two half-space codebooks, visited by falling bound until windows are certified."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import stored

#: Codewords of each half, and the rows (those with the smallest hash of the key) that they are fitted on.  Every row is indexed.
CODEWORDS = 16
SAMPLE_ROWS = 4_096
ROUNDS = 12
#: Rows of one shard, which a task holds as an index while the anchors stream by.
SHARD_ROWS = 32_768
#: Rows scored in one call.
STEP_ROWS = 256
#: Below this size products of integers are exact in double precision.
_EXACT = float(1 << 52)
_LIMIT = float(1 << 62)


def fit_codebook(rows: np.ndarray, codewords: int = CODEWORDS, seed: int = 3) -> np.ndarray:
    """Centres of a k-means over ``rows``; at least one, even for no rows."""
    rows = np.unique(rows, axis=0)
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:codewords]]
    for _ in range(ROUNDS):
        near = nearest(rows, centres)
        centres = np.array([rows[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (rows @ centres.T), axis=1)


@dataclass
class Codebooks:
    """The two codebooks, the largest distance of a cell's rows from its codewords, and how cells are dealt to shards."""

    halves: tuple[np.ndarray, np.ndarray]
    radii: np.ndarray | None = None  # of each cell: first half, second half; -inf where it has no rows
    first: np.ndarray | None = None  # first shard of each cell
    parts: np.ndarray | None = None  # shards that a cell is split into

    @property
    def split(self) -> int:
        return self.halves[0].shape[1]

    def cell(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, and its distances from the cell's two codewords."""
        a, b = self.halves
        x, y = rows[:, : self.split], rows[:, self.split :]
        i, j = nearest(x, a), nearest(y, b)
        return i * len(b) + j, np.sqrt(((x - a[i]) ** 2).sum(1)), np.sqrt(((y - b[j]) ** 2).sum(1))

    def half_scores(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Products of both halves with their codewords, and the lengths of both halves."""
        x, y = rows[:, : self.split], rows[:, self.split :]
        return x @ self.halves[0].T, y @ self.halves[1].T, np.sqrt((x**2).sum(1)), np.sqrt((y**2).sum(1))

    def shard_bounds(self, rows: np.ndarray) -> np.ndarray:
        """An upper bound of the product of each row with the rows of each shard."""
        a, b, la, lb = self.half_scores(rows)
        cells = (a[:, :, None] + b[:, None, :]).reshape(len(rows), -1)
        bound = cells + la[:, None] * self.radii[0] + lb[:, None] * self.radii[1]
        out = np.full((len(rows), int((self.first + self.parts).max(initial=1))), -np.inf)
        for cell in np.flatnonzero(np.isfinite(self.radii[0])):
            span = slice(self.first[cell], self.first[cell] + self.parts[cell])
            out[:, span] = np.maximum(out[:, span], bound[:, cell, None])
        return widened(out)


def widened(bound: np.ndarray) -> np.ndarray:
    """Upper bounds that hold in spite of rounding."""
    with np.errstate(invalid="ignore"):
        return bound + 1e-9 * (1 + np.abs(bound))


def deal(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``first`` and ``parts``: neighbouring cells share a shard up to ``rows`` rows; a larger cell is split over several."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > rows:
            shard, held = shard + 1, 0
        first[cell] = shard
        if n > rows:
            parts[cell] = -(-n // rows)
            shard, held = shard + int(parts[cell]), 0
        else:
            held += n
    return first, parts


def falling_cells(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """``(a[i] + b[j], i, j)`` of all pairs by falling sum: the multi-sequence walk over both sorted half-scores."""
    in_a, in_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    in_a, in_b = in_a[np.isfinite(a[in_a])], in_b[np.isfinite(b[in_b])]
    if not len(in_a) or not len(in_b):
        return
    a, b = a[in_a].tolist(), b[in_b].tolist()
    in_a, in_b = in_a.tolist(), in_b.tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, in_a[i], in_b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class ShardIndex:
    """The rows of one shard, listed by cell and label."""

    def __init__(self, books: Codebooks, ids, labels, vectors, cells, near_a, near_b):
        kinds, label = np.unique(labels, return_inverse=True)
        order = np.lexsort((label, cells))
        self.books = books
        self.ids, self.label, self.vectors = ids[order], label[order], vectors[order]
        self.of_label = {k: i for i, k in enumerate(kinds.tolist())}
        wide = len(books.halves[1])
        n = len(books.halves[0]) * wide
        cells = cells[order]
        self.cuts = np.searchsorted(cells, np.arange(n + 1))
        self.listed = cells * len(kinds) + self.label  # rising
        self.radii = [np.full(len(h), -np.inf) for h in books.halves]
        np.maximum.at(self.radii[0], cells // wide, near_a[order])
        np.maximum.at(self.radii[1], cells % wide, near_b[order])
        self.floats = self.vectors.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0)) * self.floats.shape[1]

    def scores(self, rows: np.ndarray, query: np.ndarray, query_float: np.ndarray) -> np.ndarray:
        size = self.largest * float(np.abs(query_float).max(initial=0))
        if size < _EXACT:
            return (self.floats[rows] @ query_float).astype(np.int64)
        if size >= _LIMIT:
            raise OverflowError("an inner product may exceed 64 bits")
        return self.vectors[rows] @ query

    def _walk(self, query: np.ndarray):
        """Cells by falling bound: ``(upper bound, lower bound, cell)``; those without rows are passed over."""
        a, b, la, lb = (x[0] for x in self.books.half_scores(query[None]))
        ra, rb = la * self.radii[0], lb * self.radii[1]
        upper_a, upper_b = widened(a + ra), widened(b + rb)
        wide = len(b)
        for bound, i, j in falling_cells(upper_a, upper_b):
            cell = i * wide + j
            if self.cuts[cell] < self.cuts[cell + 1]:
                yield bound, a[i] - ra[i] + b[j] - rb[j], cell

    def nearest_of_label(self, query: np.ndarray, own: int, label, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of rows with this label that may be among the ``k`` best, given a score that ``k`` rows are known to reach."""
        at = self.of_label.get(label)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if at is None:
            return ids, scores
        whole, query = query, query.astype(np.float64)
        kinds = len(self.of_label)
        parts, held = [], 0

        def score():
            nonlocal ids, scores, floor
            rows = np.concatenate(parts)
            found = self.scores(rows, whole, query)
            keep = (found >= floor) & (self.ids[rows] != own)
            ids, scores = best(np.concatenate([ids, self.ids[rows][keep]]), np.concatenate([scores, found[keep]]), k)
            if len(scores) == k:
                floor = max(floor, float(scores[-1]))

        for bound, _, cell in self._walk(query):
            if bound < floor:
                break
            a, b = np.searchsorted(self.listed, (cell * kinds + at, cell * kinds + at + 1))
            if a < b:
                parts.append(np.arange(a, b))
                held += b - a
                if held >= STEP_ROWS:
                    score()
                    parts, held = [], 0
        if parts:
            score()
        return ids, scores

    def windows(self, query: np.ndarray, label, spans: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each span of scores the ``k`` first rows of other labels inside it: ids and scores.

        A window is certified once no cell that is left can hold a row before its ``k``-th one.
        """
        at = self.of_label.get(label, -1)
        whole, query = query, query.astype(np.float64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in spans]
        need = [float(low) if low <= high else np.inf for low, high in spans]  # a row below this cannot enter the window
        top = max((high for low, high in spans if low <= high), default=-1)
        parts, held = [], 0

        def score():
            rows = np.concatenate(parts)
            got = self.scores(rows, whole, query)
            keep = (self.label[rows] != at) & (got >= min(need)) & (got <= top)
            ids, got = self.ids[rows][keep], got[keep]
            for w, (low, high) in enumerate(spans):
                mine = (got >= need[w]) & (got <= high)
                if mine.any():
                    found[w] = best(np.concatenate([found[w][0], ids[mine]]), np.concatenate([found[w][1], got[mine]]), k)
                    if len(found[w][0]) == k:
                        need[w] = max(need[w], float(found[w][1][-1]))

        for bound, least, cell in self._walk(query):
            if bound < min(need, default=np.inf):
                break
            if least - 1e-9 * (1 + abs(least)) > top:
                continue
            parts.append(np.arange(self.cuts[cell], self.cuts[cell + 1]))
            held += len(parts[-1])
            if held >= STEP_ROWS:
                score()
                parts, held = [], 0
        if parts:
            score()
        return found


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows with the highest scores, ties by smaller id; sorted."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def span_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers ``x`` with ``low * score <= 100 * x <= high * score``, as first and last."""
    return -(-low * score // 100), high * score // 100


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _with_cells(df: DataFrame, books, dim: int) -> DataFrame:
    """``id, label, v`` with the row's cell and its distances from both codewords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, a, b = books.value.cell(_matrix(batch.column(2), dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(a), pa.array(b)], names=["id", "label", "v", "cell", "near_a", "near_b"]
            )

    return df.select("id", "label", "v").mapInArrow(run, "id long, label string, v array<long>, cell int, near_a double, near_b double")


_ASKED = "id long, label string, v array<long>, home int, floor double, spans array<struct<positive: long, score: long>>"


def _reached(asked: DataFrame, books, dim: int, low: int, home_too: bool) -> DataFrame:
    """Each anchor once for every shard whose bound reaches its floor or its lowest window; ``home`` is the shard searched before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = books.value.shard_bounds(_matrix(batch.column(2), dim).astype(np.float64))
            floor = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            reach = bounds >= np.where(np.isnan(floor), -np.inf, floor)[:, None]
            reach &= np.isfinite(bounds)
            if not home_too:
                reach[np.arange(len(reach)), batch.column(3).to_numpy()] = False
            row, shard = np.nonzero(reach)
            for at in range(0, len(row), 4096):
                part = pa.array(row[at : at + 4096])
                columns = [c.take(part) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shard[at : at + 4096], pa.int32())], names=[*batch.schema.names, "shard"])

    return asked.mapInArrow(run, f"{_ASKED}, shard int")


def _searched(rows: DataFrame, asked: DataFrame, books, dim: int, search, schema: str) -> DataFrame:
    """``search(index, anchor row)`` for every anchor and the shard that it is sent to.

    Anchors and rows meet by shard in one shuffle; in a task the rows of a shard come first and become its index, then its
    anchors stream by, so a shard's rows are moved once however many anchors there are.
    """
    both = rows.select("shard", F.lit(0).alias("kind"), "id", "label", "v", "cell", "near_a", "near_b").unionByName(
        asked.select("shard", F.lit(1).alias("kind"), "id", "label", "v", "floor", "spans"), allowMissingColumns=True
    )
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, index = None, [], None
        for batch in batches:
            tag = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tag)) + 1).tolist(), len(tag)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                shard, kind = divmod(int(tag[a]), 2)
                part = batch.slice(a, b - a)
                if shard != current:
                    current, held, index = shard, [], None
                if not kind:
                    held.append(part)
                    continue
                if index is None and not held:
                    continue  # a part of a split cell that got no rows
                if index is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    column = lambda name: table.column(name).chunk(0)
                    held = []
                    index = ShardIndex(
                        books.value, column("id").to_numpy(), np.array(column("label").to_pylist(), object).astype(str), _matrix(column("v"), dim),
                        column("cell").to_numpy(zero_copy_only=False).astype(np.int64), column("near_a").to_numpy(zero_copy_only=False),
                        column("near_b").to_numpy(zero_copy_only=False),
                    )
                queries = _matrix(part.column("v"), dim)
                out: list[list] = [[] for _ in names]
                for query, row in zip(queries, part.select(["id", "label", "floor", "spans"]).to_pylist()):
                    for got in search(index, query, row):
                        for c, value in zip(out, got):
                            c.extend(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, schema)


def hard_negatives(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: float = 256.0, codewords: int = CODEWORDS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: rows of other labels that score near a positive.

    Anchors are the rows whose key is divisible by ``every``; a score is the inner product of ``floor(scale * x)``, higher first,
    ties by smaller key.  An anchor's positives are its ``positives`` first other rows of its label; for each, the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's are returned, ranked
    from 1; of a negative positive score there are none.  All are returned where there are fewer.

    Rows with a null key, label, vector or component, or a component that is not finite, take no part.  Rows of one key count as
    one, that with the largest label and vector.  Vectors of another length than the most common one (of equally common ones the
    longest) take no part, as they have no product with the others.  Products beyond 64 bits are an error.  An empty table, or one
    without anchors, gives no rows.  Other columns are not read.

    Of rows that agree in vector and label only the smallest keys can be among the first, so as many as any list takes are kept
    for the search; they stay anchors all the same.  Rows lie in shards of neighbouring cells; a cell above ``shard_rows`` is
    split.  Positives are sought first in the anchor's own shard, whose last score then bounds the others; a shard is left out
    for an anchor whose bound it cannot reach.
    """
    spark = df.sparkSession
    # Not-a-number compares above every number in Spark, so the test on infinity takes it in.
    sound = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | (F.abs(x.cast("double")) >= float("inf"))
    )
    rows = df.where(sound).select(
        F.col(key).cast("long").alias("id"),
        F.struct(F.col(label).cast("string").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).alias("r"),
    )
    rows = stored(rows.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.*"), "vectors")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    rows = rows.where(F.size("v") == dim)
    sample = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    sample = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), dim)
    books = Codebooks((fit_codebook(sample[:, : dim // 2], codewords), fit_codebook(sample[:, dim // 2 :], codewords)))
    coded = spark.sparkContext.broadcast(books)

    # The limit is applied before the shuffle too, so a vector that very many rows share is a few rows from each task.
    place = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    few = rows.withColumn("_place", place).where(F.col("_place") <= max(positives + 1, negatives)).drop("_place")
    placed = stored(_with_cells(few, coded, dim), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("near_a").alias("a"), F.max("near_b").alias("b")).collect()  # codewords squared rows
    cells = len(books.halves[0]) * len(books.halves[1])
    counts, books.radii = np.zeros(cells, np.int64), np.full((2, cells), -np.inf)
    for r in sizes:
        counts[r["cell"]], books.radii[0, r["cell"]], books.radii[1, r["cell"]] = r["n"], r["a"], r["b"]
    books.first, books.parts = deal(counts, shard_rows)
    dealt = spark.sparkContext.broadcast(books)
    firsts, parts = (F.array(*[F.lit(int(n)) for n in x]) for x in (books.first, books.parts))
    shard = F.get(firsts, F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell"))).cast("int")
    placed = placed.withColumn("shard", shard.cast("int"))

    anchors = _with_cells(rows.where(F.col("id") % every == 0), dealt, dim)
    none = F.lit(None).cast("array<struct<positive: long, score: long>>")
    asked = stored(anchors.select("id", "label", "v", shard.cast("int").alias("home"), F.lit(None).cast("double").alias("floor"), none.alias("spans")), "anchors")

    def same(index: ShardIndex, query: np.ndarray, row: dict):
        floor = -np.inf if row["floor"] is None else row["floor"]
        ids, scores = index.nearest_of_label(query, row["id"], row["label"], positives, floor)
        yield [row["id"]] * len(ids), ids.tolist(), scores.tolist()

    found = "id long, other long, score long"
    at_home = stored(_searched(placed, asked.withColumn("shard", F.col("home")), dealt, dim, same, found), "home")
    floors = at_home.groupBy("id").agg(F.when(F.count("*") >= positives, F.min("score")).cast("double").alias("floor"))
    # Anchors are one row each and floors too, joined by key.
    floored = asked.drop("floor").join(floors, "id", "left").select("id", "label", "v", "home", "floor", "spans")
    elsewhere = _searched(placed, _reached(floored, dealt, dim, low, False), dealt, dim, same, found)
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    chosen = at_home.union(elsewhere).withColumn("_place", order).where(F.col("_place") <= positives)
    spans = chosen.groupBy("id").agg(F.collect_list(F.struct(F.col("other").alias("positive"), "score")).alias("spans"))  # at most ``positives`` each
    least = F.array_min(F.transform(F.filter("spans", lambda s: s["score"] >= 0), lambda s: s["score"]))
    windows = asked.drop("spans", "floor").join(spans, "id").withColumn("floor", F.floor(least * low / 100).cast("double"))
    windows = stored(windows.where("floor is not null").select("id", "label", "v", "home", "floor", "spans"), "windows")

    def others(index: ShardIndex, query: np.ndarray, row: dict):
        spans = [span_of(s["score"], low, high) for s in row["spans"]]
        for s, (ids, scores) in zip(row["spans"], index.windows(query, row["label"], spans, negatives)):
            n = len(ids)
            yield [row["id"]] * n, [s["positive"]] * n, [s["score"]] * n, ids.tolist(), scores.tolist()

    made = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    mined = _searched(placed, _reached(windows, dealt, dim, low, True), dealt, dim, others, made)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = mined.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
