"""Exact top-k inner products: ball-tree branch and bound per shard, with the current k-th score shared."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import stored

#: Vectors of one shard and queries of one block: what a task holds at once.
SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
LEAF_ROWS = 128
#: Candidates held between two cuts to the k best.
HELD_ROWS = 1 << 20
#: Below this size products of integers are exact in double precision.
_EXACT = float(1 << 52)
#: A little below 2**63, as sizes are compared in double precision.
_LARGEST = float(1 << 63) * (1 - 1e-9)


class BallTree:
    """Balls around a set of integer vectors, level by level: node ``i`` has children ``2i+1`` and ``2i+2``."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.depth = max(0, math.ceil(math.log2(max(1, len(ids)) / leaf_rows)))
        spans = [(0, len(ids))]
        levels = [spans]
        for _ in range(self.depth):
            below = []
            for a, b in spans:
                middle = (a + b) // 2
                if b - a > 1:
                    part = vectors[order[a:b]]
                    # Split at the median along the line between two far points.
                    far = part[np.argmax(((part - part[0]) ** 2).sum(1))]
                    other = part[np.argmax(((part - far) ** 2).sum(1))]
                    place = np.argpartition(part @ (other - far), middle - a)
                    order[a:b] = order[a:b][place]
                below += [(a, middle), (middle, b)]
            spans = below
            levels.append(spans)
        self.vectors, self.ids = vectors[order], ids[order]
        self.leaves = spans
        self.centres, self.radii = [], []
        for spans in levels:
            parts = [self.vectors[a:b] for a, b in spans]
            centres = np.array([p.mean(0) if len(p) else np.zeros(vectors.shape[1]) for p in parts])
            radii = [math.sqrt(((p - c) ** 2).sum(1).max()) if len(p) else -np.inf for p, c in zip(parts, centres)]
            self.centres.append(centres)
            self.radii.append(np.array(radii))

    def bounds(self, level: int, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with the members of each ball, safe against rounding."""
        with np.errstate(invalid="ignore"):
            bound = queries @ self.centres[level].T + lengths[:, None] * self.radii[level]
        return bound + 1e-9 * (1 + np.abs(bound))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray, exact: bool) -> tuple:
        """``(query index, id, score)`` of every candidate that can be among the ``k`` best of its query.

        ``floor`` is a score that ``k`` candidates are known to reach.  Balls below it are cut level by level; the
        leaves that are left are taken by falling bound, and each round of leaves raises the floor.
        """
        m = len(queries)
        floor = floor.astype(np.float64).copy()
        lengths = np.sqrt((queries**2).sum(1))
        alive = np.ones((m, 1), bool)
        for level in range(self.depth + 1):
            if level:
                alive = np.repeat(alive, 2, axis=1)
            bound = self.bounds(level, queries, lengths)
            alive &= bound >= floor[:, None]
        best_first = np.argsort(np.where(alive, -bound, np.inf), axis=1, kind="stable")
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if exact else np.float64))
        at, step = 0, 1
        while at < len(self.leaves):
            columns = best_first[:, at : at + step]
            rows = np.repeat(np.arange(m), columns.shape[1])
            leaf = columns.ravel()
            open_ = alive[rows, leaf] & (bound[rows, leaf] >= floor[rows])
            rows, leaf = rows[open_], leaf[open_]
            if not len(rows):
                break
            found, held = [top], 0
            order = np.argsort(leaf, kind="stable")
            rows, leaf = rows[order], leaf[order]
            for piece in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
                mine, (a, b) = rows[piece], self.leaves[leaf[piece[0]]]
                scores = queries[mine] @ self.vectors[a:b].T
                keep = (scores >= floor[mine][:, None]) & (query_ids[mine][:, None] != self.ids[a:b])
                i, j = np.nonzero(keep)
                found.append((mine[i], self.ids[a:b][j], scores[i, j].astype(top[2].dtype)))
                held += len(i)
                if held > HELD_ROWS:  # many equal scores: cut to the k best at once
                    found, held = [best(*(np.concatenate(c) for c in zip(*found)), k)], 0
            top = best(*(np.concatenate(c) for c in zip(*found)), k)
            count = np.bincount(top[0], minlength=m)
            last = np.cumsum(count) - 1
            full = count >= k
            floor[full] = np.maximum(floor[full], top[2][last[full]])
            at += step
            step *= 2
        return top


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The ``k`` best rows of each query by score, then by smaller id; sorted."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(table.num_rows, -1) if table.num_rows else values.reshape(0, 0)


def _search_group(k: int, shards: pa.Table, queries: pa.Table) -> pa.Table:
    """One shard against one block of queries, for each length of vectors that occurs."""
    names = ["query_id", "vec_id", "score"]
    if not shards.num_rows or not queries.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    vectors, asked = _matrix(shards, "v"), _matrix(queries, "q")
    ids = shards.column("vec_id").to_numpy()
    query_ids = queries.column("query_id").to_numpy()
    floor = queries.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
    floor = np.where(np.isnan(floor), -np.inf, floor)
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(1, vectors.shape[1])
    exact = largest < _EXACT
    if exact:
        tree = BallTree(vectors.astype(np.float64), ids)
        row, found, score = tree.search(asked.astype(np.float64), query_ids, k, floor, True)
    else:  # beyond double precision: whole 64-bit products, leaf by leaf and without bounds
        parts = [(np.zeros(0, np.int64),) * 3]
        for a in range(0, len(ids), LEAF_ROWS):
            scores = asked @ vectors[a : a + LEAF_ROWS].T
            i, j = np.nonzero(query_ids[:, None] != ids[a : a + LEAF_ROWS])
            size = np.abs(asked.astype(np.float64) @ vectors[a : a + LEAF_ROWS].astype(np.float64).T)[i, j]
            if (size >= _LARGEST).any():
                raise OverflowError("an inner product does not fit into 64 bits")
            parts = [best(*(np.concatenate(c) for c in zip(*parts, (i, ids[a : a + LEAF_ROWS][j], scores[i, j]))), k)]
        row, found, score = parts[0]
    return pa.table({"query_id": query_ids[row], "vec_id": found.astype(np.int64), "score": score.astype(np.int64)})


def top_k(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: float = 256.0,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other rows: ``query_id, rank, vec_id, score``.

    Queries are the rows whose key is divisible by ``every``.  Components become ``floor(scale * x)``.  Rows with a null
    key, a null vector, or a null or non-finite component take no part.  Vectors are compared with those of the same
    length only.  A key that occurs several times is one query (its largest vector) and several candidates, none of
    them for itself; ties go to the smaller key.  An empty table gives no rows; a score beyond 64 bits is an error.

    Rows are dealt to shards by hash and queries to blocks; a task has one shard and one block.  A first pass searches
    one shard for every query; the ``k``-th score found there is the floor with which all other shards start.
    """
    # Not-a-number compares above every number in Spark, so the test on infinity takes it in.
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | (F.abs(x.cast("double")) >= float("inf"))
    )
    rows = df.where(sound).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )
    rows = stored(rows.withColumn("dim", F.size("v")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.max("v").alias("q"))
    asked = asked.groupBy("vec_id").agg(F.max(F.struct("q", "dim")).alias("r")).select(
        F.col("vec_id").alias("query_id"), "r.q", "r.dim"
    )
    count = rows.count()
    shards = max(1, math.ceil(count / shard_rows))
    blocks = max(1, math.ceil(count / every / block_rows))
    dealt = lambda name, n, seed: F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(n)).cast("int")
    sharded = rows.withColumn("shard", dealt("vec_id", shards, 1))
    asked = stored(asked.withColumn("block", dealt("query_id", blocks, 2)).withColumn("home", F.col("block") % shards), "queries")
    schema = "query_id long, vec_id long, score long"
    by = ["shard", "block", "dim"]

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _search_group(k, left, right)

    def run(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        asked_by = [f"q_{c}" for c in by]
        renamed = queries.select("query_id", "q", "floor", *[F.col(c).alias(f"q_{c}") for c in by])
        return candidates.groupBy(*by).cogroup(renamed.groupBy(*asked_by)).applyInArrow(search, schema)

    homes = asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("double"))
    home_blocks = asked.select("block", "home", "dim").distinct()
    first = stored(
        run(sharded.join(home_blocks.withColumnRenamed("home", "shard"), ["shard", "dim"]), homes.drop("home")), "first"
    )
    if shards == 1:
        found = first
    else:
        floors = first.groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor")
        )
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        others = asked.join(floors, "query_id", "left").withColumn("shard", everywhere).where("shard != home").drop("home")
        copies = sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(
            F.col("block") % shards != F.col("shard")
        )
        found = first.union(run(copies, others))
    # The limit per query is applied before the shuffle too, so a query has at most k rows from each task.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
