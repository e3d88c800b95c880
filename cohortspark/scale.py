"""Building blocks that keep ordered and quantile work spread out when one key is hot.

A plain ``Window.partitionBy(key)`` puts a whole key into one task, and a global ``orderBy`` window puts
everything into one.  The helpers here first look at the size of the largest group; only groups of a bounded
size take the plain window, all others are range-partitioned on (key, order) and continued across partitions
with one small carry row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import cut_lineage, staged

MAX_GROUP_ROWS = 1_000_000
TASK_ROWS = 500_000
HASH_BUCKETS = 8192
SMALL_SPLITS = 4

_SCANS = {"sum": F.sum, "min": F.min, "max": F.max}


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group; partial counts are combined before the shuffle."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def group_bound(df: DataFrame, keys: Sequence[str], enough: int = MAX_GROUP_ROWS) -> int:
    """Rows that no group has more of: of the largest hash bucket if that is at most ``enough``, else of the largest group.

    For many small groups: buckets are counted before the shuffle, while counting the groups would shuffle all of them.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS)).cast("int")
    bound = largest_group(df.select(bucket.alias("_bucket")), ["_bucket"])
    return bound if bound <= enough else largest_group(df, keys)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    scans: Mapping[str, tuple[str, Column]],
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
    group_rows: int | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order``.

    ``scans`` maps an output column to ``(function, value)`` with function ``sum``, ``min`` or ``max``.
    ``order`` must be total within a key.  With ``inclusive=False`` the current row is left out.
    A caller that knows the size of the largest group passes it as ``group_rows`` and saves the count.
    """
    upper = Window.currentRow if inclusive else -1
    if group_rows is None:
        group_rows = largest_group(df, keys)
    if group_rows <= max_group_rows:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
        return df.select("*", *[_SCANS[fn](value).over(window).alias(name) for name, (fn, value) in scans.items()])
    return _running_ranged(df, keys, order, scans, upper)


def range_parts(df: DataFrame) -> int:
    """Partitions for sorting ``df``: the session's number, or more if a task would get over ``TASK_ROWS`` rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def _running_ranged(df, keys, order, scans, upper):
    parts = range_parts(df)
    inputs = {f"_in_{name}": value for name, (_, value) in scans.items()}
    ranged = cut_lineage(
        df.withColumns(inputs)
        .withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0)))
        .repartitionByRange(parts, F.col("_key"), *order)
        .withColumn("_part", F.spark_partition_id())
    )
    partials = ranged.groupBy("_part", "_key").agg(
        *[_SCANS[fn](f"_in_{name}").alias(f"_t_{name}") for name, (fn, _) in scans.items()]
    )
    # A running total over the parts of each key.  Only the first key of a part can have rows in earlier parts, so one row
    # per part is left: the number of partitions bounds what is broadcast.
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = partials.select(
        F.col("_part").alias("_cp"), F.col("_key").alias("_ck"), *[_SCANS[fn](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (fn, _) in scans.items()]
    ).where(" or ".join(f"`_c_{name}` is not null" for name in scans))
    window = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
    # One part to a task.  Left to itself, Spark joins parts by their compressed size until a task sorts millions of rows.
    joined = ranged.repartitionById(parts, F.col("_part")).select(
        "*", *[_SCANS[fn](f"_in_{name}").over(window).alias(f"_l_{name}") for name, (fn, _) in scans.items()]
    ).join(F.broadcast(carry), (F.col("_part") == F.col("_cp")) & F.col("_key").eqNullSafe(F.col("_ck")), "left")
    merged = []
    for name, (fn, _) in scans.items():
        local, carried = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if fn == "sum":
            both = F.coalesce(local + carried, local, carried)
        else:
            both = (F.least if fn == "min" else F.greatest)(local, carried)
        merged.append(both.alias(name))
    return joined.select(*df.columns, *merged)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    *,
    start: int = 1,
    max_group_rows: int = MAX_GROUP_ROWS,
    group_rows: int | None = None,
) -> DataFrame:
    """Row numbers from ``start`` per ``keys`` in ``order``; with no keys, over the whole table."""
    if group_rows is None:
        group_rows = largest_group(df, keys)
    if group_rows <= max_group_rows:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, (position + F.lit(start - 1)).cast("bigint"))
    counted = running(
        df, keys, order, {"_rn": ("sum", F.lit(1))}, max_group_rows=max_group_rows, group_rows=group_rows
    )
    return counted.withColumn(name, (F.col("_rn") + F.lit(start - 1)).cast("bigint")).drop("_rn")


def fold_values(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """``keys, _v, _x, _n``: how often each number ``_x`` that is not null stands in the named value ``_v``.

    The input is read once; moments, deviations, histograms and percentiles all follow from what is stored here.
    """
    names = list(values)
    if len(names) == 1:
        pairs = df.select(*keys, F.lit(names[0]).alias("_v"), values[names[0]].cast("double").alias("_x"))
    else:
        pairs = df.select(
            *keys,
            F.explode(
                F.array(*[F.struct(F.lit(n).alias("_v"), values[n].cast("double").alias("_x")) for n in names])
            ).alias("_p"),
        ).select(*keys, "_p._v", "_p._x")
    return staged(pairs.where("_x is not null").groupBy(*keys, "_v", "_x").agg(F.count("*").alias("_n")), "values")


def folded_moments(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n, energy, mean, min, max, variance, skewness, kurtosis, mad`` of rows ``keys, _x, _n``.

    Deviations are taken from the mean itself, so that nothing cancels; without spread, skewness and kurtosis are NULL.
    """
    x, n = F.col("_x"), F.col("_n")
    base = folded.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.sum(n * x * x).alias("energy"),
        (F.sum(n * x) / F.sum("_n")).alias("mean"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    key = F.struct(*keys) if keys else F.lit(0)
    rows, means = folded.select(key.alias("_k"), "_x", "_n"), shuffled(base.select(key.alias("_k"), F.col("mean").alias("_m")))
    away = x - F.col("_m")
    powers = [F.sum(n * value).alias(name) for name, value in (("_2", away * away), ("_3", away * away * away), ("_4", away * away * away * away), ("_1", F.abs(away)))]
    spread = spread_join(rows, means, "_k", ["_x"]).groupBy("_k").agg(*powers)
    variance = F.col("_2") / F.col("n")
    uneven = F.col("max") > F.col("min")
    return (
        base.withColumn("_k", key)
        .join(shuffled(spread), "_k")
        .select(
            *keys, "n", "energy", "mean", "min", "max",
            variance.alias("variance"),
            F.when(uneven, F.col("_3") / F.col("n") / (variance * F.sqrt(variance))).alias("skewness"),
            F.when(uneven, F.col("_4") / F.col("n") / (variance * variance)).alias("kurtosis"),
            (F.col("_1") / F.col("n")).alias("mad"),
        )
    )


def folded_percentiles(
    folded: DataFrame, by: Sequence[str], percents: Mapping[str, float], *, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """``by, _q``: the percentiles of rows ``by, _x, _n`` as an array, linearly interpolated.

    Where a key keeps too many different values for one task, the order statistics are read off a running count
    instead of the built-in aggregate; both are exact.
    """
    if largest_group(folded, by) > max_group_rows:
        return _ranked_percentiles(folded, by, percents)
    points = F.array(*[F.lit(p / 100.0) for p in percents.values()])
    return folded.groupBy(*by).agg(F.percentile("_x", points, F.col("_n")).alias("_q"))


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    percents: Mapping[str, float],
    *,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Linearly interpolated percentiles, one row per ``keys``, columns ``{value}_{percent name}``."""
    wide = folded_percentiles(fold_values(df, keys, values), [*keys, "_v"], percents, max_group_rows=max_group_rows)
    picked = [
        F.max(F.when(F.col("_v") == n, F.col("_q")[i])).alias(f"{n}_{p}") for n in values for i, p in enumerate(percents)
    ]
    return wide.groupBy(*keys).agg(*picked) if keys else wide.agg(*picked)


def _ranked_percentiles(folded, by, percents):
    totals = folded.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranked = running(folded, by, [F.col("_x")], {"_upto": ("sum", F.col("_n"))}, max_group_rows=0)
    key = F.struct(*by)
    ranked, totals = ranked.withColumn("_k", key), totals.select(key.alias("_k"), "_total")
    placed = spread_join(ranked, totals, "_k", ["_x"]).withColumn("_from", F.col("_upto") - F.col("_n"))
    sides = []
    for i, p in enumerate(percents):
        rank = (F.col("_total") - 1) * F.lit(percents[p] / 100.0)
        low, high = F.floor(rank), F.ceil(rank)
        inside = lambda r: (F.col("_from") <= r) & (r < F.col("_upto"))
        sides += [
            F.max(F.when(inside(low), F.col("_x"))).alias(f"_lo{i}"),
            F.max(F.when(inside(high), F.col("_x"))).alias(f"_hi{i}"),
            F.max(rank - low).alias(f"_w{i}"),
        ]
    flat = placed.groupBy(*by).agg(*sides)
    points = [
        F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(
            F.col(f"_lo{i}") * (1 - F.col(f"_w{i}")) + F.col(f"_hi{i}") * F.col(f"_w{i}")
        )
        for i in range(len(percents))
    ]
    return flat.select(*by, F.array(*points).alias("_q"))


def spread_join(big: DataFrame, small: DataFrame, key: str, by: Sequence[str], salts: int | None = None) -> DataFrame:
    """Inner join of many rows with few rows per key, when a single key may hold much of the big side.

    The big side is dealt to ``salts`` parts of each key by the columns ``by``, the small side is copied to all of
    them.  Without ``salts`` there are 16, or an eighth of the shuffle partitions up to 256.  A following aggregate
    combines the parts before its own shuffle.
    """
    if salts is None:
        salts = min(256, max(16, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    part = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", part).join(copies, [key, "_salt"]).drop("_salt")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, never collected on the driver and broadcast.

    For tables that grow with the input: Spark guesses their size from compressed files and does not see how many rows are
    made of one, so a table of several hundred MB can look smaller than the bound for broadcasts.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input of at most ``SMALL_SPLITS`` splits, dealt out to all tasks.

    Such an input is smaller than so many times the split size, whatever the cluster; all others are left as they are.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(slots) if splits <= SMALL_SPLITS and splits < slots else df


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the highest ``order`` per key; an aggregate, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the lowest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
