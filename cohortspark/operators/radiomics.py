"""The radiomics study: cohort building, group comparison, and voxel features per volume."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import fixed
from cohortspark.functions.text import let
from cohortspark.operators.components import component_runs
from cohortspark.operators.stencil import DIRECTIONS, fold_lines, level_pairs, level_runs, neighbour_sums
from cohortspark.scale import exact_percentiles, fold_values, folded_moments, folded_percentiles, running, shuffled, spread_join

AXES = ("x", "y", "z")
RANGE = (-150.0, 250.0)
BIN_WIDTH = 25.0

# ---- cohort ----------------------------------------------------------------------------------------------


def merge_groups(rows: DataFrame, column: str = "class_raw", keep: Sequence[str] = tuple(fixed.STUDY_GROUPS)) -> DataFrame:
    """``group_label`` by merging mixed classes; only the compared groups stay."""
    label = F.col(column)
    merged = F.when(F.lit(False), F.lit(None))
    for source, target in fixed.STUDY_MERGES.items():
        merged = merged.when(label == source, target)
    return rows.withColumn("group_label", merged.otherwise(label)).where(F.col("group_label").isin(*keep))


def feature_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in fixed.STUDY_ID_COLUMNS]


def missingness(rows: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """``feature, missing`` share, in one pass."""
    features = list(features or feature_columns(rows))
    shares = rows.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    return shares.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("missing")) for f in features]))
    )


def missingness_filter(rows: DataFrame, max_missing: float = 0.2) -> DataFrame:
    """Drop feature columns with more than the allowed share of missing values; identifiers always stay."""
    dropped = [r["feature"] for r in missingness(rows).where(F.col("missing") > max_missing).collect()]  # column names
    return rows.drop(*dropped)


def patient_cohort(rows: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row per patient and phase: features averaged over VOIs."""
    features = list(features or feature_columns(rows))
    return rows.groupBy("patient_id", "group_label", "contrast_phase").agg(
        *[F.avg(f).alias(f) for f in features], F.count("*").alias("n_vois")
    )


def unpivot(cohort: DataFrame, features: Sequence[str]) -> DataFrame:
    return cohort.unpivot(
        ["patient_id", "group_label", "contrast_phase"], list(features), "feature", "value"
    ).where("value is not null")


def describe_groups(long: DataFrame) -> DataFrame:
    """n, mean, deviation, median and IQR per feature, group and phase."""
    keys = ["feature", "group_label", "contrast_phase"]
    moments = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    points = exact_percentiles(long, keys, {"v": F.col("value")}, {"p25": 25.0, "median": 50.0, "p75": 75.0})
    return moments.join(points, keys).select(
        *keys, "n", "mean", "std", F.col("v_median").alias("median"), (F.col("v_p75") - F.col("v_p25")).alias("iqr")
    )


def normal_tail(z: Column) -> Column:
    """Two-sided p of a normal score (Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)

    def poly(t):
        out = F.lit(1.061405429)
        for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
            out = out * t + c
        return out * t

    return let(1.0 / (1.0 + 0.3275911 * x), poly) * F.exp(-x * x)


def compare_groups(long: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Mann-Whitney U of two groups per feature and phase, with Holm-adjusted p within a phase.

    Values are folded to (value, n_a, n_b), so ties need no ranks of single rows, and the running count is
    spread out when a feature has very many different values.
    """
    keys = ["feature", "contrast_phase"]
    folded = (
        long.where(F.col("group_label").isin(a, b))
        .groupBy(*keys, "value")
        .agg(F.count_if(F.col("group_label") == a).alias("na"), F.count_if(F.col("group_label") == b).alias("nb"))
    )
    t = F.col("na") + F.col("nb")
    ranked = running(folded, keys, [F.col("value")], {"upto": ("sum", t)})
    mean_rank = F.col("upto") - t + (t + 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.sum("na").alias("n_a"),
        F.sum("nb").alias("n_b"),
        F.sum(F.col("na") * mean_rank).alias("ra"),
        F.sum((t * t * t - t).cast("double")).alias("ties"),
    )
    n = F.col("n_a") + F.col("n_b")
    both = F.col("n_a") * F.col("n_b")
    u = F.col("ra") - F.col("n_a") * (F.col("n_a") + 1) / 2.0
    var = both / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), (n * (n - 1)).cast("double")))
    tested = (
        sums.where("n_a > 0 and n_b > 0")
        .withColumns({"u": u, "_var": var})
        .withColumn("z", F.when(F.col("_var") > 0, (F.col("u") - both / 2.0) / F.sqrt("_var")).otherwise(0.0))
        .withColumns({"effect": 2 * F.col("u") / both - 1, "p": normal_tail(F.col("z"))})
    )
    # one row per feature from here on
    by_p = Window.partitionBy("contrast_phase").orderBy("p", "feature")
    left = F.count("*").over(Window.partitionBy("contrast_phase")) - F.row_number().over(by_p) + 1
    return (
        tested.withColumn("_h", F.least(F.lit(1.0), left * F.col("p")))
        .withColumn("p_holm", F.max("_h").over(by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select(*keys, "n_a", "n_b", "u", "z", "effect", "p", "p_holm")
    )


# ---- voxel features --------------------------------------------------------------------------------------


def roi_voxels(voxels: DataFrame, label: int = 2, hu_range: tuple[float, float] = RANGE) -> DataFrame:
    """Voxels of the region whose intensity lies in the range."""
    return voxels.where((F.col("label") == label) & F.col("hu").between(*hu_range)).select("voi_id", *AXES, "hu")


def discretize(roi: DataFrame, bin_width: float = BIN_WIDTH) -> DataFrame:
    """``level`` from 1 by fixed bin width, counted from the bin of the smallest value of the volume."""
    lowest = roi.groupBy("voi_id").agg(F.floor(F.min("hu") / bin_width).alias("_low"))
    level = (F.floor(F.col("hu") / bin_width) - F.col("_low") + 1).cast("int")
    return spread_join(roi, shuffled(lowest), "voi_id", AXES).withColumn("level", level).drop("_low")


FIRST_ORDER_PERCENTS = {"p10": 10.0, "p25": 25.0, "median": 50.0, "p75": 75.0, "p90": 90.0}


def firstorder_features(roi: DataFrame, volumes: DataFrame, bin_width: float = BIN_WIDTH) -> DataFrame:
    """Intensity features of each region; the voxels are read once, to fold them to (volume, value, count)."""
    folded = fold_values(roi, ["voi_id"], {"hu": F.col("hu")})
    base = folded_moments(folded, ["voi_id"])
    points = folded_percentiles(folded, ["voi_id"], FIRST_ORDER_PERCENTS).select(
        "voi_id", *[F.col("_q")[i].alias(p) for i, p in enumerate(FIRST_ORDER_PERCENTS)]
    )
    k, total = F.col("k"), F.sum("k")
    histogram = (
        folded.groupBy("voi_id", F.floor(F.col("_x") / bin_width).alias("bin"))
        .agg(F.sum("_n").alias("k"))
        .groupBy("voi_id")
        .agg(
            (F.log2(total.cast("double")) - F.sum(k * F.log2(k.cast("double"))) / total).alias("entropy"),
            (F.sum(k.cast("double") * k) / (total.cast("double") * total)).alias("uniformity"),
        )
    )
    sp = F.col("spacing")
    return (
        base.join(shuffled(points), "voi_id")
        .join(shuffled(histogram), "voi_id")
        .join(shuffled(volumes.select("voi_id", "spacing")), "voi_id")
        .select(
            "voi_id",
            "n",
            "energy",
            (F.col("energy") * sp[0] * sp[1] * sp[2]).alias("total_energy"),
            "entropy",
            "uniformity",
            F.col("min").alias("minimum"),
            F.col("max").alias("maximum"),
            "mean",
            "median",
            "p10",
            "p90",
            (F.col("p75") - F.col("p25")).alias("iqr"),
            (F.col("max") - F.col("min")).alias("range"),
            "mad",
            F.sqrt(F.col("energy") / F.col("n")).alias("rms"),
            "variance",
            "skewness",
            "kurtosis",
        )
    )


def shape_features(voxels: DataFrame, volumes: DataFrame, label: int = 2) -> DataFrame:
    """Voxel volume, box extents in mm and principal-axis lengths from the covariance of voxel centres."""
    names = [f"c{a}{b}" for i, a in enumerate(AXES) for b in AXES[i:]]
    moments = (
        voxels.where(F.col("label") == label)
        .groupBy("voi_id")
        .agg(
            F.count("*").alias("n"),
            *[F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]],
            *[(F.max(a) - F.min(a) + 1).alias(f"e{a}") for a in AXES],
        )
        .join(shuffled(volumes.select("voi_id", "spacing")), "voi_id")
    )
    sp = {a: F.col("spacing")[i] for i, a in enumerate(AXES)}
    scaled = {f"c{a}{b}": F.col(f"c{a}{b}") * sp[a] * sp[b] for i, a in enumerate(AXES) for b in AXES[i:]}
    m = moments.withColumns(scaled | {f"e{a}": F.col(f"e{a}") * sp[a] for a in AXES})
    # closed form for symmetric 3 x 3 matrices
    c = {n: F.col(n) for n in names}
    q = (c["cxx"] + c["cyy"] + c["czz"]) / 3.0
    off = c["cxy"] * c["cxy"] + c["cxz"] * c["cxz"] + c["cyz"] * c["cyz"]
    m = m.withColumn("_q", q).withColumn(
        "_p",
        F.sqrt(
            (F.pow(c["cxx"] - F.col("_q"), 2) + F.pow(c["cyy"] - F.col("_q"), 2) + F.pow(c["czz"] - F.col("_q"), 2) + 2 * off)
            / 6.0
        ),
    )
    p = F.col("_p")
    bx, by, bz = ((c[n] - F.col("_q")) for n in ("cxx", "cyy", "czz"))
    det = (
        bx * (by * bz - c["cyz"] * c["cyz"])
        - c["cxy"] * (c["cxy"] * bz - c["cyz"] * c["cxz"])
        + c["cxz"] * (c["cxy"] * c["cyz"] - by * c["cxz"])
    )
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2.0 * p * p * p)))).otherwise(1.0)
    m = m.withColumn("_phi", F.acos(r) / 3.0)
    first = F.col("_q") + 2.0 * p * F.cos("_phi")
    third = F.col("_q") + 2.0 * p * F.cos(F.col("_phi") + 2.0 * math.pi / 3.0)
    m = m.withColumns({"l1": first, "l3": third}).withColumn("l2", 3.0 * F.col("_q") - F.col("l1") - F.col("l3"))

    def length(name):
        return 4.0 * F.sqrt(F.greatest(F.col(name), F.lit(0.0)))

    return m.select(
        "voi_id",
        "n",
        (F.col("n") * sp["x"] * sp["y"] * sp["z"]).alias("voxel_volume"),
        *[F.col(f"e{a}").alias(f"extent_{a}") for a in AXES],
        length("l1").alias("major_axis"),
        length("l2").alias("minor_axis"),
        length("l3").alias("least_axis"),
        F.sqrt(F.greatest(F.try_divide("l2", "l1"), F.lit(0.0))).alias("elongation"),
        F.sqrt(F.greatest(F.try_divide("l3", "l1"), F.lit(0.0))).alias("flatness"),
    )


def glcm_counts(levels: DataFrame) -> DataFrame:
    """Symmetric pair counts ``voi_id, direction, i, j, n``."""
    pairs = level_pairs(fold_lines(levels)).groupBy("voi_id", "direction", "level_a", "level_b").agg(F.count("*").alias("c"))
    both = pairs.select(
        "voi_id",
        "direction",
        "c",
        F.inline(
            F.array(
                F.struct(F.col("level_a").alias("i"), F.col("level_b").alias("j")),
                F.struct(F.col("level_b").alias("i"), F.col("level_a").alias("j")),
            )
        ),
    )
    return both.groupBy("voi_id", "direction", "i", "j").agg(F.sum("c").alias("n"))


def glcm_features(counts: DataFrame) -> DataFrame:
    """Contrast, energy and correlation per volume, averaged over the directions that have pairs."""
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    # the matrix is symmetric, so both margins share mean and variance
    sums = counts.groupBy("voi_id", "direction").agg(
        F.sum(n).alias("t"),
        F.sum(n * n).alias("sq"),
        F.sum(n * (i - j) * (i - j)).alias("diff"),
        F.sum(n * i).alias("si"),
        F.sum(n * i * i).alias("sii"),
        F.sum(n * i * j).alias("sij"),
    )
    t = F.col("t").cast("double")
    mean = F.col("si") / t
    var = F.col("sii") / t - mean * mean
    # a flat matrix counts as fully correlated
    correlation = F.when(var > 1e-12, (F.col("sij") / t - mean * mean) / var).otherwise(1.0)
    per = sums.select(
        "voi_id", (F.col("diff") / t).alias("contrast"), (F.col("sq") / (t * t)).alias("energy"), correlation.alias("correlation")
    )
    return per.groupBy("voi_id").agg(*[F.avg(c).alias(c) for c in ("contrast", "energy", "correlation")])


def glrlm_counts(levels: DataFrame) -> DataFrame:
    """Run-length counts ``voi_id, direction, level, length, n``."""
    runs = level_runs(fold_lines(levels))
    return runs.groupBy("voi_id", "direction", "level", "length").agg(F.count("*").alias("n"))


def glszm_counts(levels: DataFrame) -> DataFrame:
    """Zone-size counts ``voi_id, level, size, n`` of 26-connected zones of one level."""
    keys = ["voi_id", "level"]
    zones = component_runs(levels.select(*keys, *AXES), keys, 26)
    sizes = zones.groupBy(*keys, "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
    return sizes.groupBy(*keys, "size").agg(F.count("*").alias("n"))


def gldm_counts(levels: DataFrame, alpha: int = 0) -> DataFrame:
    """Dependence counts ``voi_id, level, dependence, n``; a voxel counts itself."""
    dependence = (F.col("alike") + 1).alias("dependence")
    return neighbour_sums(fold_lines(levels), alpha).groupBy("voi_id", "level", dependence).agg(F.count("*").alias("n"))


def ngtdm_counts(levels: DataFrame) -> DataFrame:
    """``voi_id, level, n, s``: voxels with neighbours, and their summed distance to the neighbour mean."""
    seen = neighbour_sums(fold_lines(levels)).where("k > 0")
    return seen.groupBy("voi_id", "level").agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("level") - F.col("total") / F.col("k"))).alias("s")
    )


# ---- features of the count tables ------------------------------------------------------------------------


def _entropy(total: Column, weighted_log: Column) -> Column:
    """Entropy in bits of counts with this sum and this sum of ``n * log2(n)``."""
    return F.log2(total) - weighted_log / total


def _n_log_n(n: Column) -> Column:
    return n * F.log2(n)


def largest_level(levels: DataFrame) -> DataFrame:
    """``voi_id, ng``: the number of grey levels of each region, counted up to the highest one that occurs."""
    return levels.groupBy("voi_id").agg(F.max("level").alias("ng"))


def glcm_feature_table(counts: DataFrame, largest: DataFrame) -> DataFrame:
    """All pair-count features that have a closed form, per volume, averaged over the directions that have pairs.

    Everything is a sum over the counts of a direction: moments of levels, sums and differences, and sums of ``n * log2(n)`` over the
    pairs, the levels, the differences and the level sums.  A volume without any pair has no row.
    """
    n, i, j = F.col("n").cast("double"), F.col("i"), F.col("j")
    d, s = F.abs(i - j), i + j
    by = ["voi_id", "direction"]
    ng = F.col("ng").cast("double")
    direct = counts.join(shuffled(largest), "voi_id").groupBy(*by).agg(
        F.sum(n).alias("t"), F.max(n).alias("top"), F.sum(n * n).alias("nn"), F.sum(_n_log_n(n)).alias("log_ij"),
        F.sum(n * i).alias("si"), F.sum(n * i * i).alias("sii"), F.sum(n * i * j).alias("sij"),
        F.sum(n * d).alias("d1"), F.sum(n * d * d).alias("d2"), F.sum(F.when(d > 0, n / (d * d)).otherwise(0.0)).alias("iv"),
        *[F.sum(n * F.pow(s, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)],
        F.sum(n / (1 + d)).alias("id"), F.sum(n / (1 + d * d)).alias("idm"), F.sum(n / (1 + d / ng)).alias("idn"), F.sum(n / (1 + d * d / (ng * ng))).alias("idmn"),
    )
    parts = F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("int").alias("at")) for kind, key in (("i", i), ("d", d), ("s", s))])
    margins = counts.select(*by, "n", F.inline(parts)).groupBy(*by, "kind", "at").agg(F.sum("n").cast("double").alias("m"))
    logs = margins.groupBy(*by).agg(
        *[F.sum(F.when(F.col("kind") == k, _n_log_n(F.col("m"))).otherwise(0.0)).alias(f"log_{k}") for k in ("i", "d", "s")]
    )
    f = direct.join(shuffled(logs), by)
    t = F.col("t")
    mean, m1 = F.col("si") / t, F.col("s1") / t
    m2, m3, m4 = (F.col(f"s{k}") / t for k in (2, 3, 4))
    variance = F.col("sii") / t - mean * mean
    joint, single = _entropy(t, F.col("log_ij")), _entropy(t, F.col("log_i"))
    # Both margins are equal, so the cross entropies of the margins are twice the entropy of one.
    features = {
        "autocorrelation": F.col("sij") / t,
        "joint_average": mean,
        "cluster_tendency": m2 - m1 * m1,
        "cluster_shade": m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1,
        "cluster_prominence": m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1,
        "contrast": F.col("d2") / t,
        "correlation": F.when(variance > 1e-12, (F.col("sij") / t - mean * mean) / variance).otherwise(1.0),
        "difference_average": F.col("d1") / t,
        "difference_variance": F.col("d2") / t - (F.col("d1") / t) * (F.col("d1") / t),
        "difference_entropy": _entropy(t, F.col("log_d")),
        "joint_energy": F.col("nn") / (t * t),
        "joint_entropy": joint,
        "imc1": F.when(single > 1e-12, (joint - 2 * single) / single).otherwise(0.0),
        "imc2": F.sqrt(F.greatest(1 - F.exp(-2 * (2 * single - joint)), F.lit(0.0))),
        "id": F.col("id") / t,
        "idm": F.col("idm") / t,
        "idn": F.col("idn") / t,
        "idmn": F.col("idmn") / t,
        "inverse_variance": F.col("iv") / t,
        "maximum_probability": F.col("top") / t,
        "sum_average": m1,
        "sum_entropy": _entropy(t, F.col("log_s")),
        "sum_squares": variance,
    }
    per = f.select("voi_id", *[c.alias(name) for name, c in features.items()])
    return per.groupBy("voi_id").agg(*[F.avg(name).alias(name) for name in features])


def emphasis_features(counts: DataFrame, size: str, extra: Sequence[str] = ()) -> DataFrame:
    """Emphases, non-uniformities, variances and entropy of a table of counts by level and size.

    ``counts`` has ``voi_id, level, n`` and ``size``: run lengths, zone sizes or dependences.  With ``extra`` keys, such as
    the direction of runs, every feature is worked out for each and then averaged per volume.
    """
    by = ["voi_id", *extra]
    n, i, j = F.col("n").cast("double"), F.col("level").cast("double"), F.col(size).cast("double")
    direct = counts.groupBy(*by).agg(
        F.sum(n).alias("t"), F.sum(n * j).alias("voxels"), F.sum(_n_log_n(n)).alias("logs"),
        F.sum(n / (j * j)).alias("short"), F.sum(n * j * j).alias("long"), F.sum(n / (i * i)).alias("low"), F.sum(n * i * i).alias("high"),
        F.sum(n / (i * i * j * j)).alias("short_low"), F.sum(n * i * i / (j * j)).alias("short_high"),
        F.sum(n * j * j / (i * i)).alias("long_low"), F.sum(n * i * i * j * j).alias("long_high"), F.sum(n * i).alias("levels"),
    )
    parts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("at")) for kind, c in (("level", "level"), ("size", size))])
    margins = counts.select(*by, "n", F.inline(parts)).groupBy(*by, "kind", "at").agg(F.sum("n").cast("double").alias("m"))
    squares = margins.groupBy(*by).agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("m") * F.col("m")).otherwise(0.0)).alias(f"sq_{k}") for k in ("level", "size")]
    )
    t = F.col("t")
    of = lambda name: F.col(name) / t
    features = {
        "short_emphasis": of("short"),
        "long_emphasis": of("long"),
        "level_nonuniformity": of("sq_level"),
        "level_nonuniformity_normalized": of("sq_level") / t,
        "size_nonuniformity": of("sq_size"),
        "size_nonuniformity_normalized": of("sq_size") / t,
        "percentage": t / F.col("voxels"),
        "level_variance": of("high") - of("levels") * of("levels"),
        "size_variance": of("long") - of("voxels") * of("voxels"),
        "entropy": _entropy(t, F.col("logs")),
        "low_level_emphasis": of("low"),
        "high_level_emphasis": of("high"),
        "short_low_emphasis": of("short_low"),
        "short_high_emphasis": of("short_high"),
        "long_low_emphasis": of("long_low"),
        "long_high_emphasis": of("long_high"),
    }
    per = direct.join(shuffled(squares), by).select("voi_id", *[c.alias(name) for name, c in features.items()])
    if not extra:
        return per
    return per.groupBy("voi_id").agg(*[F.avg(name).alias(name) for name in features])


def ngtdm_features(counts: DataFrame) -> DataFrame:
    """Coarseness, contrast, busyness, complexity and strength per volume, from ``voi_id, level, n, s``.

    Pairs are pairs of grey levels, of which the intensity range bounds the number.  Flat regions have coarseness a million and
    otherwise zeros.
    """
    totals = counts.groupBy("voi_id").agg(
        F.sum("n").cast("double").alias("t"), F.sum("s").alias("all_s"), F.count("*").alias("ngp"), F.sum(F.col("n") * F.col("s")).alias("ns")
    )
    one = counts.select("voi_id", F.col("level").cast("double").alias("i"), F.col("n").cast("double").alias("a"), F.col("s").alias("sa"))
    other = counts.select("voi_id", F.col("level").cast("double").alias("j"), F.col("n").cast("double").alias("b"), F.col("s").alias("sb"))
    i, j, a, b, sa, sb = (F.col(c) for c in ("i", "j", "a", "b", "sa", "sb"))
    # Counts stand for shares here; the totals divide them out below.
    pairs = one.join(shuffled(other), "voi_id").groupBy("voi_id").agg(
        F.sum(a * b * (i - j) * (i - j)).alias("spread"), F.sum(F.abs(i * a - j * b)).alias("uneven"),
        F.sum(F.abs(i - j) * (a * sa + b * sb) / (a + b)).alias("complex"), F.sum((a + b) * (i - j) * (i - j)).alias("strong"),
    )
    t, ns = F.col("t"), F.col("ns") / F.col("t")
    ngp = F.col("ngp")
    return totals.join(shuffled(pairs), "voi_id").select(
        "voi_id",
        F.when(ns > 1e-12, 1 / ns).otherwise(1e6).alias("coarseness"),
        F.when(ngp > 1, F.try_divide(F.col("spread") / (t * t), ngp * (ngp - 1)) * F.col("all_s") / t).otherwise(0.0).alias("contrast"),
        F.when(F.col("uneven") > 1e-12, ns / (F.col("uneven") / t)).otherwise(0.0).alias("busyness"),
        (F.col("complex") / t).alias("complexity"),
        F.when(F.col("all_s") > 1e-12, F.col("strong") / t / F.col("all_s")).otherwise(0.0).alias("strength"),
    )
