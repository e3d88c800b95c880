"""Connected components of voxel sets, for many volumes at once.

Voxels are folded to runs along x and neighbouring runs become edges.  Volumes with a bounded number of runs come sorted
through a task, which solves as many whole ones at once as have a bounded number of edges.  Only larger volumes
are contracted over all tasks: every node moves to the neighbour that a per-round hash ranks lowest, which about halves
the graph in each round whatever its shape (local contraction, Lacki, Mirrokni and Wlodarczyk 2018).  Joins are then on
(volume, node), so a large volume is spread out.  Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.scale import MAX_GROUP_ROWS, numbered, shuffled
from cohortspark.session import cut_lineage

#: Edges that a task solves at once, beside those of one volume.
BATCH_EDGES = 200_000
#: Runs of a volume that one task may solve; a run has a handful of edges.
VOLUME_RUNS = 250_000

# Half of the neighbouring (dy, dz) lines; the other half is covered by symmetry.
_LINES = {26: ((1, 0), (-1, 1), (0, 1), (1, 1)), 6: ((1, 0), (0, 1))}


def _node(x: Column, y: Column, z: Column) -> Column:
    """One number per position; indices stay below 2**20."""
    return F.shiftleft(z.cast("bigint"), 40) + F.shiftleft(y.cast("bigint"), 20) + x.cast("bigint")


def runs_of(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs along x: ``keys, y, z, x0, x1, node``.  A line is at most as long as the volume is wide."""
    line = Window.partitionBy(*keys, "y", "z").orderBy("x")
    return (
        voxels.select(*keys, "x", "y", "z", (F.col("x") - F.row_number().over(line)).alias("_island"))
        .groupBy(*keys, "y", "z", "_island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_island")
        .withColumn("node", _node(F.col("x0"), F.col("y"), F.col("z")))
    )


def _run_edges(runs: DataFrame, keys: Sequence[str], conn: int) -> DataFrame:
    slack = 1 if conn == 26 else 0
    lines = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dy, dz in _LINES[conn]])
    left = runs.withColumn("_o", F.explode(lines)).select(
        *keys,
        (F.col("y") + F.col("_o.dy")).alias("y"),
        (F.col("z") + F.col("_o.dz")).alias("z"),
        F.col("x0").alias("a0"),
        F.col("x1").alias("a1"),
        F.col("node").alias("u"),
    )
    right = runs.select(*keys, "y", "z", "x0", "x1", F.col("node").alias("v"))
    touch = (F.col("a0") <= F.col("x1") + slack) & (F.col("x0") <= F.col("a1") + slack)
    return left.join(shuffled(right), [*keys, "y", "z"]).where(touch).select(*keys, "u", "v")


def large_volumes(runs: DataFrame, keys: Sequence[str], volume_runs: int = VOLUME_RUNS) -> DataFrame:
    """``keys`` of the volumes with more than ``volume_runs`` runs: so many times fewer rows than there are runs."""
    return runs.groupBy(*keys).count().where(F.col("count") > volume_runs).select(*keys)


def component_runs(
    voxels: DataFrame, keys: Sequence[str] = ("voi_id",), conn: int = 26, max_group_rows: int = VOLUME_RUNS
) -> DataFrame:
    """Runs with the ``root`` node of their component; volumes with more than ``max_group_rows`` runs are solved over all tasks."""
    keys = list(keys)
    runs = cut_lineage(runs_of(voxels, keys))
    large = cut_lineage(large_volumes(runs, keys, max_group_rows))
    small_edges = _run_edges(runs.join(large, keys, "left_anti"), keys, conn)
    large_edges = cut_lineage(_run_edges(runs.join(large, keys, "left_semi"), keys, conn))
    targets = _solve_small(small_edges, keys).unionByName(_contract_all(large_edges, keys))
    rooted = runs.join(shuffled(targets.withColumnRenamed("u", "node")), [*keys, "node"], "left")
    return cut_lineage(rooted.withColumn("root", F.coalesce("to", "node")).drop("to"))


def _lowest(u: np.ndarray, v: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` nodes the lowest one that edges tie it to."""
    low = np.arange(count)
    while True:
        before = low.copy()
        shared = np.minimum(low[u], low[v])
        np.minimum.at(low, u, shared)
        np.minimum.at(low, v, shared)
        low = low[low]
        if np.array_equal(low, before):
            return low


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places in sorted edges at which a volume begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        code = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _solve_small(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, u, to``: the lowest node of each component.

    Edges come sorted by volume, and whole volumes are solved together as soon as they have ``BATCH_EDGES`` edges; so a task
    holds that many and one volume's, however volumes are dealt.
    """
    schema = edges.select(*keys, "u", F.col("u").alias("to")).schema
    names = schema.names

    def solved(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        volume = np.zeros(table.num_rows, np.int64)
        volume[starts[1:]] = 1
        volume = np.cumsum(volume)
        ends = [table.column(c).to_numpy() for c in ("u", "v")]
        places, codes = np.unique(np.concatenate(ends), return_inverse=True)
        # A node is a (volume, position) pair; pairs are numbered in that order.
        nodes, at = np.unique(np.concatenate([volume, volume]) * len(places) + codes, return_inverse=True)
        low = _lowest(at[: len(volume)], at[len(volume) :], len(nodes))
        position = places[nodes % len(places)]
        rows = pa.array(starts[nodes // len(places)])
        columns = [table.column(k).take(rows).combine_chunks() for k in keys]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(position), pa.array(position[low])], names=names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < BATCH_EDGES:
                continue
            table = pa.Table.from_batches(held)
            starts = _starts(table, keys)
            if len(starts) > 1:  # all volumes but the last one, which may go on
                yield solved(table.slice(0, starts[-1]), starts[:-1])
                table = table.slice(starts[-1])
            held, rows = table.combine_chunks().to_batches(), table.num_rows
        if rows:
            table = pa.Table.from_batches(held)
            yield solved(table, _starts(table, keys))

    return edges.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(solve, schema)


def _contract_all(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, u, to``: one node per component for every node with an edge, by rounds over all tasks."""
    moves: list[DataFrame] = []
    # Each round keeps its edges only; its moves follow from them and are worked out again when put together.
    while not edges.isEmpty():
        moves.append(_lowest_neighbour(edges, keys, len(moves)))
        edges = cut_lineage(_contract(edges, moves[-1], keys))
    if not moves:
        return edges.select(*keys, "u", F.col("v").alias("to"))
    # from the last, smallest round back to the first
    target = moves.pop()
    while moves:
        onward = target.select(*keys, F.col("u").alias("to"), F.col("to").alias("_final"))
        target = (
            moves.pop()
            .join(shuffled(onward), [*keys, "to"], "left")
            .select(*keys, "u", F.coalesce("_final", "to").alias("to"))
        )
    return target


def _lowest_neighbour(edges: DataFrame, keys: list[str], round_no: int) -> DataFrame:
    """Per node the lowest-ranked node among itself and its neighbours; ranks change from round to round."""

    def rank(c):
        node = F.col(c)
        return F.struct(F.xxhash64(node, F.lit(round_no)).alias("h"), node.alias("n"))

    both = edges.select(*keys, "u", F.least(rank("u"), rank("v")).alias("r")).union(
        edges.select(*keys, "v", F.least(rank("u"), rank("v")))
    )
    return both.groupBy(*keys, "u").agg(F.min("r").alias("r")).select(*keys, "u", F.col("r.n").alias("to"))


def _contract(edges: DataFrame, move: DataFrame, keys: list[str]) -> DataFrame:
    moved_u = move.select(*keys, "u", F.col("to").alias("_tu"))
    moved_v = move.select(*keys, F.col("u").alias("v"), F.col("to").alias("_tv"))
    return (
        edges.join(shuffled(moved_u), [*keys, "u"])
        .join(shuffled(moved_v), [*keys, "v"])
        .where("_tu <> _tv")
        .select(*keys, F.least("_tu", "_tv").alias("u"), F.greatest("_tu", "_tv").alias("v"))
        .distinct()
    )


def component_table(
    runs: DataFrame, keys: Sequence[str] = ("voi_id",), order: Sequence[str] = ("x", "y", "z")
) -> DataFrame:
    """One row per component with its size, coordinate sums and bounds.

    ``component`` counts from 1 in the order of the first voxel, the axis named first being the slowest.
    """
    keys = list(keys)
    n = F.col("x1") - F.col("x0") + 1
    axis = {"x": F.col("x0"), "y": F.col("y"), "z": F.col("z")}
    found = runs.groupBy(*keys, "root").agg(
        F.sum(n).cast("bigint").alias("volume_vox"),
        F.sum(n * (F.col("x0") + F.col("x1")) / 2.0).alias("sum_x"),
        F.sum(n * F.col("y")).cast("double").alias("sum_y"),
        F.sum(n * F.col("z")).cast("double").alias("sum_z"),
        F.min("x0").alias("min_x"),
        F.min("y").alias("min_y"),
        F.min("z").alias("min_z"),
        F.max("x1").alias("max_x"),
        F.max("y").alias("max_y"),
        F.max("z").alias("max_z"),
        F.min(F.struct(*[axis[a].alias(a) for a in order])).alias("first_voxel"),
    )
    total = runs.count()
    bound = total if total <= MAX_GROUP_ROWS else None  # the whole table bounds its largest group
    return numbered(found, keys, [F.col("first_voxel")], "component", group_rows=bound)


def connected_components(
    voxels: DataFrame,
    keys: Sequence[str] = ("voi_id",),
    conn: int = 26,
    order: Sequence[str] = ("x", "y", "z"),
) -> DataFrame:
    """Voxels with their ``component`` number."""
    keys = list(keys)
    runs = component_runs(voxels, keys, conn)
    numbers = component_table(runs, keys, order).select(*keys, "root", "component")
    return (
        runs.join(shuffled(numbers), [*keys, "root"])
        .select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", "component")
    )
