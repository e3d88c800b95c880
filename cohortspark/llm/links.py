"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stored

MAX_ROUNDS = 60


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star operation on rows ``(u, v)``; every node's neighbours are tied to the smallest node near it.

    The smallest neighbour is an aggregate that is combined before the shuffle, and the edges meet it in a join, so a
    node with very many neighbours is split like any skewed join key.
    """
    if larger_only:
        sided = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = sided.join(lowest, "u")
    if larger_only:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v"))
        )
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in the rows ``(u, v)``; ``root`` is the smallest node that can be reached.

    Ids may be of any ordered type.  Null ends and loops are left out; a node that has only loops is not returned.
    Each round is stored in the shared folder, so a lost executor repeats one round at most.
    """
    now = stored(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        now = stored(_stars(_stars(now, True), False), "links")
        # Finished when nothing changed: compare size and a sum of hashes, both counted where the rows are.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
