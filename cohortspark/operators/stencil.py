"""Neighbourhoods of voxels over folded lines.

A line is one row for all region voxels with the same volume, y and z: ``x0`` and an array of levels by x, null where the region has a
gap.  Neighbours in x are shifts of an array, neighbours in y and z come from other lines, so what is shuffled is a few arrays
per line and never a row per pair of voxels.  A line is at most as long as its volume is wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.scale import shuffled

LINE = ("voi_id", "y", "z")

# One of each pair of opposite neighbours.
DIRECTIONS = [
    (dx, dy, dz)
    for dz in (0, 1)
    for dy in (-1, 0, 1)
    for dx in (-1, 0, 1)
    if (dz, dy, dx) > (0, 0, 0)
]


def fold_lines(levels: DataFrame) -> DataFrame:
    """``voi_id, y, z, x0, levels`` from rows ``voi_id, x, y, z, level``; one shuffle of the voxels, places are unique."""
    before = F.lag("x").over(Window.partitionBy(*LINE).orderBy("x"))
    gap = F.array_repeat(F.lit(None).cast("int"), F.coalesce(F.col("x") - before - 1, F.lit(0)).cast("int"))
    piece = F.struct("x", F.concat(gap, F.array("level")).alias("piece"))
    sewn = F.flatten(F.sort_array(F.collect_list("piece"))["piece"])
    return (
        levels.select(*LINE, "x", piece.alias("piece"))
        .groupBy(*LINE)
        .agg(F.min("x").alias("x0"), sewn.alias("levels"))
    )


def _sent(lines: DataFrame, offsets: Sequence[tuple[int, int, Sequence[tuple[int, int]]]]) -> DataFrame:
    """Each line as ``x0_a, a`` at the places ``(y + dy, z + dz)``, with what is to be done there: ``(direction, dx)``."""
    targets = F.array(
        *[
            F.struct(
                (F.col("y") + dy).alias("y"),
                (F.col("z") + dz).alias("z"),
                F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(dx).alias("dx")) for d, dx in todo]).alias("todo"),
            )
            for dy, dz, todo in offsets
        ]
    )
    return lines.select("voi_id", F.col("x0").alias("x0_a"), F.col("levels").alias("a"), F.inline(targets))


def _overlaid(met: DataFrame) -> DataFrame:
    """``a`` and ``b`` cut to the places ``x`` of a and ``x + dx`` of b that both lines have."""
    each = met.select(*[c for c in met.columns if c != "todo"], F.inline("todo"))
    low = F.greatest(F.col("x0_a"), F.col("x0_b") - F.col("dx"))
    high = F.least(F.col("x0_a") + F.size("a"), F.col("x0_b") + F.size("b") - F.col("dx"))
    each = each.withColumns({"low": low, "n": F.greatest(high - low, F.lit(0))}).where("n > 0")
    return each.withColumns(
        {
            "a": F.slice("a", F.col("low") - F.col("x0_a") + 1, F.col("n")),
            "b": F.slice("b", F.col("low") + F.col("dx") - F.col("x0_b") + 1, F.col("n")),
        }
    )


def level_pairs(lines: DataFrame) -> DataFrame:
    """Each pair of touching region voxels once: ``voi_id, direction, level_a, level_b``, the second at the first's place plus the direction.

    A line is sent to four neighbours and stays where it is: five rows a line.
    """
    of = {d: i for i, d in enumerate(DIRECTIONS)}
    beside = sorted({(dy, dz) for _, dy, dz in DIRECTIONS if (dy, dz) != (0, 0)})
    sent = _sent(lines, [(dy, dz, [(of[dx, dy, dz], dx) for dx in (-1, 0, 1)]) for dy, dz in beside])
    held = lines.select(*LINE, F.col("x0").alias("x0_b"), F.col("levels").alias("b"))
    met = sent.join(shuffled(held), list(LINE)).select("voi_id", "x0_a", "a", "x0_b", "b", "todo")
    inside = F.array(F.struct(F.lit(of[1, 0, 0]).alias("direction"), F.lit(1).alias("dx")))
    own = held.select("voi_id", F.col("x0_b").alias("x0_a"), F.col("b").alias("a"), "x0_b", "b", inside.alias("todo"))
    cut = _overlaid(met.unionByName(own)).select("voi_id", "direction", F.col("a").alias("level_a"), F.col("b").alias("level_b"))
    return cut.select("voi_id", "direction", F.inline(F.arrays_zip("level_a", "level_b"))).where(
        "level_a is not null and level_b is not null"
    )


def neighbour_sums(lines: DataFrame, alpha: int = 0) -> DataFrame:
    """Region voxels with the number ``k``, level sum ``total`` and number ``alike`` (within ``alpha``) of their neighbours in the region.

    A line is sent to the nine places around it; what a voxel meets there is added up where it meets it, without another shuffle.
    """
    around = [(dy, dz, [(0, dx) for dx in (-1, 0, 1)]) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]
    # What is sent is the neighbour; the line that stays asks.
    sent = _sent(lines, around).select("voi_id", "y", "z", F.col("x0_a").alias("x0_b"), F.col("a").alias("b"), "todo")
    held = lines.select(*LINE, F.col("x0").alias("x0_a"), F.col("levels").alias("a"))
    cut = _overlaid(shuffled(held).join(sent, list(LINE)))
    places = F.sequence(F.col("low"), F.col("low") + F.col("n") - 1)
    cut = cut.select(*LINE, places.alias("x"), F.col("a").alias("level"), F.col("b").alias("other"))
    met = cut.select(*LINE, F.inline(F.arrays_zip("x", "level", "other"))).where("level is not null and other is not null")
    alike = F.abs(F.col("level") - F.col("other")) <= alpha
    # Every voxel has met itself too.
    return met.groupBy(*LINE, "x", "level").agg(
        (F.count("*") - 1).alias("k"),
        (F.sum("other") - F.col("level")).alias("total"),
        (F.sum(alike.cast("int")) - 1).alias("alike"),
    )


def _sheets(lines: DataFrame) -> DataFrame:
    """Each line once for every bundle of directions: ``sheet`` holds the lines that such a direction passes, ``t`` counts them.

    The direction along x needs one line only; the four others need the lines of a plane.  A plane is at most a slice.
    """
    y, z = F.col("y"), F.col("z")
    of = {d: i for i, d in enumerate(DIRECTIONS)}

    def bundle(kind: int, sheet: Column, t: Column, dy: int, dz: int):
        todo = F.array(*[F.struct(F.lit(of[dx, dy, dz]).alias("direction"), F.lit(dx).alias("dx")) for dx in (-1, 0, 1)])
        return F.struct(F.lit(kind).alias("kind"), sheet.alias("sheet"), t.alias("t"), todo.alias("todo"))

    planes = F.array(
        bundle(1, z, y, 1, 0), bundle(2, y, z, 0, 1), bundle(3, y - z, z, 1, 1), bundle(4, y + z, z, -1, 1)
    )
    return lines.select("voi_id", "x0", "levels", F.inline(planes))


def level_runs(lines: DataFrame) -> DataFrame:
    """Maximal runs of one level: ``voi_id, direction, level, length``, for each of the 13 directions.

    Runs along x are read off the array positions of a line.  For all others a line goes to four planes; chains of places are
    made and cut into runs inside a plane, without another shuffle.
    """
    x, level = F.col("pos"), F.col("level")
    along = lines.select(*LINE, F.posexplode("levels").alias("pos", "level")).where("level is not null")
    island = x - F.row_number().over(Window.partitionBy(*LINE, "level").orderBy("pos"))
    along = along.withColumn("island", island).groupBy(*LINE, "level", "island").agg(F.count("*").alias("length"))
    along = along.select("voi_id", F.lit(DIRECTIONS.index((1, 0, 0))).alias("direction"), "level", "length")
    plane = ["voi_id", "kind", "sheet"]
    dealt = _sheets(lines).repartition(*plane)
    places = dealt.select(*plane, "x0", "t", "todo", F.posexplode("levels").alias("pos", "level")).where("level is not null")
    places = places.select(*plane, "x0", "t", "pos", "level", F.inline("todo"))
    chain = F.col("x0") + F.col("pos") - F.col("dx") * F.col("t")
    chained = places.select(*plane, "direction", chain.alias("chain"), "t", "level")
    line = [*plane, "direction", "chain", "level"]
    island = F.col("t") - F.row_number().over(Window.partitionBy(*line).orderBy("t"))
    runs = chained.withColumn("island", island).groupBy(*line, "island").agg(F.count("*").alias("length"))
    return along.unionByName(runs.select("voi_id", "direction", level, "length"))


def interior_edge(voxels: DataFrame) -> DataFrame:
    """Places whose 3 x 3 neighbourhood in the slice is not whole: ``voi_id, x, y, z``.

    A line's places whose neighbours in x are there go to the lines above and below; a place is inside if all three lines
    have it.  Three rows a line.
    """
    x = F.col("x")
    folded = voxels.groupBy(*LINE).agg(
        F.collect_list(x).alias("xs"), F.collect_list(x - 1).alias("left"), F.collect_list(x + 1).alias("right")
    )
    whole = F.array_intersect(F.array_intersect("xs", "left"), "right")
    lines = folded.select(*LINE, "xs", whole.alias("whole"))
    targets = F.array(
        *[
            F.struct((F.col("y") + dy).alias("y"), F.when(F.lit(dy == 0), F.col("xs")).alias("xs"))
            for dy in (-1, 0, 1)
        ]
    )
    sent = lines.select("voi_id", "z", "whole", F.inline(targets))
    met = sent.groupBy(*LINE).agg(F.max("xs").alias("xs"), F.collect_list("whole").alias("three")).where("xs is not null")
    inside = F.when(F.size("three") == 3, F.array_intersect(F.array_intersect(F.get("three", F.lit(0)), F.get("three", F.lit(1))), F.get("three", F.lit(2))))
    edge = F.array_except("xs", F.coalesce(inside, F.array().cast(met.schema["xs"].dataType)))
    return met.select("voi_id", F.explode(edge).alias("x"), "y", "z")
