"""Patient splits and lesion-centred patch plans.

Random choices are orderings or uniforms of ``md5(seed | id)``: the same on every cluster and partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import fixed
from cohortspark.scale import numbered
from cohortspark.session import cut_lineage

RARE = "__rare__"
AXES = ("x", "y", "z")


def draw(seed: int, *parts: Column | str) -> Column:
    """A hash text that orders rows at random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]).cast("binary"))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the hash."""
    return F.conv(F.substring(draw(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def safe_strata(patients: DataFrame, min_count: int) -> DataFrame:
    """``stratum``: the class, or one pool for classes below the least count and for patients without class."""
    counts = patients.groupBy(F.col("class").alias("_class")).agg(F.count("*").alias("_n"))
    stratum = F.when(F.col("_n") >= min_count, F.col("class"))
    joined = patients.join(counts, F.col("class").eqNullSafe(F.col("_class")))
    return joined.withColumn("stratum", F.coalesce(stratum, F.lit(RARE))).drop("_n", "_class")


def class_distribution(patients: DataFrame, n_folds: int = 5) -> DataFrame:
    n = F.col("n")
    notice = F.when(n < 2, "forced into train only").when(n < n_folds, "pooled as rare for fold stratification")
    return patients.groupBy("class").agg(F.count("*").alias("n")).withColumn("notice", notice)


def holdout_split(patients: DataFrame, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Patients with ``is_test``; each stratum gives its share by largest remainder.

    A single rare patient cannot be stratified and stays in train.
    """
    strata = safe_strata(patients, 2)
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("n"))
    sizes = sizes.where(~((F.col("stratum") == RARE) & (F.col("n") == 1)))
    total = sizes.agg(F.sum("n").alias("t")).scalar()
    wanted = F.ceil(F.col("_total") * F.lit(test_ratio)).cast("bigint")
    exact = F.col("n") * F.col("_k")
    # a dozen strata: windows over them are small
    quota = (
        sizes.withColumn("_total", total)
        .withColumn("_k", wanted)
        .withColumn("_base", F.floor(exact / F.col("_total")).cast("bigint"))
        .withColumn("_rest", exact % F.col("_total"))
        .withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_rest"), "stratum")))
        .withColumn("_short", F.col("_k") - F.sum("_base").over(Window.partitionBy()))
        .select(
            "stratum", "n", (F.col("_base") + F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0)).alias("quota")
        )
    )
    largest = sizes.agg(F.max("n")).first()[0] or 0
    order = [draw(seed, "patient_id"), F.col("patient_id")]
    ranked = numbered(strata, ["stratum"], order, "_pos", group_rows=largest)
    return (
        ranked.join(quota.select("stratum", "quota"), "stratum", "left")
        .withColumn("is_test", F.coalesce(F.col("_pos") <= F.col("quota"), F.lit(False)))
        .drop("_pos", "quota", "stratum")
    )


def stratified_kfold(train: DataFrame, n_folds: int = 5, seed: int = 42, order: str = "first_path") -> DataFrame:
    """Train patients with their validation ``fold``; classes under k members are pooled.

    Members are dealt out in turn, each class going on where the one before stopped.
    """
    strata = safe_strata(train, n_folds)
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    earlier = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("stratum", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    dealt = numbered(
        strata, ["stratum"], [draw(seed, F.lit("fold"), "patient_id"), F.col("patient_id")], "_pos", start=0, group_rows=largest
    )
    return (
        dealt.join(offsets, "stratum")
        .withColumn("fold", ((F.col("_offset") + F.col("_pos")) % n_folds).cast("int"))
        .drop("_offset", "_pos", "stratum")
    )


def build_splits(patients: DataFrame, n_folds: int = 5, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """``fold, split, patient_id``: train and val per fold, and test with fold NULL."""
    known = cut_lineage(patients.select("patient_id", "class", "first_path"))
    held = cut_lineage(holdout_split(known, test_ratio, seed))
    folds = stratified_kfold(held.where("not is_test"), n_folds, seed)
    runs = folds.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(n_folds)]))).select(
        F.col("_f").alias("fold"), F.when(F.col("_f") == F.col("fold"), "val").otherwise("train").alias("split"), "patient_id"
    )
    test = held.where("is_test").select(F.lit(None).cast("int").alias("fold"), F.lit("test").alias("split"), "patient_id")
    return runs.unionByName(test)


def select_fold(splits: DataFrame, fold: int) -> DataFrame:
    """Rows of one fold; an unknown fold is an error."""
    rows = splits.where(F.col("fold") == fold)
    if rows.isEmpty():
        raise ValueError(f"fold {fold} not found")
    return rows


# ---- patches ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SamplerOptions:
    patch: tuple[int, int, int] = (96, 96, 64)
    background_prob: float = 0.0
    jitter: float = 0.10
    border_shift: float = 0.30
    context_shift: float = 0.55
    min_shift: float = 2.0
    max_per_lesion: int | None = None
    stochastic: bool = False
    seed: int = 42


def lesion_order(lesions: DataFrame) -> DataFrame:
    """Position of each lesion in its VOI by size bin, falling size, id."""
    order = [F.coalesce("size_bin", F.lit("")), F.desc("volume_vox"), F.col("lesion_id")]
    return numbered(lesions, ["voi_id"], order, "position")


def lesions_for_subject(subjects: DataFrame, lesions: DataFrame) -> DataFrame:
    """Subjects with their lesions by catalog key; a subject without a key is an error."""
    key = F.coalesce("catalog_key", F.raise_error(F.lit("subject without catalog_key")))
    keyed = lesions.withColumnRenamed("mask_path", "catalog_key").where(F.coalesce("catalog_key", F.lit("")) != "")
    return subjects.withColumn("catalog_key", key).join(keyed, "catalog_key", "left")


def patch_budget(options: SamplerOptions) -> Column:
    """Patches per lesion from ``patch_budget, empirical, target`` of its size bin."""
    weight = F.when(
        F.col("empirical") > 0, F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("target") / F.col("empirical")))
    ).otherwise(1.0)
    base = F.coalesce("patch_budget", F.lit(fixed.PATCH_BUDGET_DEFAULT))
    budget = F.greatest(F.lit(1), F.bround(base * F.coalesce(weight, F.lit(1.0)), 0).cast("int"))
    return budget if options.max_per_lesion is None else F.least(budget, F.lit(options.max_per_lesion))


def assign_roles(lesions: DataFrame, options: SamplerOptions) -> DataFrame:
    """One row per patch: ``patch_index, role``.

    Needs ``budget`` and ``prior_*``; roles go round by falling prior, or are drawn by prior.
    """
    rows = lesions.withColumn("patch_index", F.explode(F.sequence(F.lit(0), F.col("budget") - 1)))
    priors = [F.coalesce(f"prior_{r}", F.lit(p)) for r, p in zip(fixed.ROLES, fixed.ROLE_PRIORS_DEFAULT)]
    if options.stochastic:
        u = uniform(options.seed, F.lit("role"), "voi_id", "lesion_id", "patch_index") * (priors[0] + priors[1] + priors[2])
        role = F.when(u < priors[0], "center").when(u < priors[0] + priors[1], "border").otherwise("context")
        return rows.withColumn("role", role)
    # falling prior, ties in the fixed order
    falling = F.sort_array(
        F.array(*[F.struct((-p).alias("p"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, (r, p) in enumerate(zip(fixed.ROLES, priors))])
    )
    return rows.withColumn("role", F.get(falling, (F.col("patch_index") % 3).cast("int"))["r"])


def role_center(options: SamplerOptions) -> Column:
    """Patch centre for ``role`` from ``centroid_vox, bbox_size_vox, patch_index``."""
    extent = F.transform(F.col("bbox_size_vox").cast("array<double>"), lambda e: F.greatest(e, F.lit(1.0)))
    widest = F.array_max(extent)
    axis = F.array_position(extent, widest) - 1
    ids = ("voi_id", "lesion_id", "patch_index")
    if options.stochastic:
        sign = F.when(uniform(options.seed, F.lit("sign"), *ids) < 0.5, -1.0).otherwise(1.0)
    else:
        sign = F.when(F.col("patch_index") % 2 == 0, -1.0).otherwise(1.0)
    share = F.when(F.col("role") == "border", options.border_shift).otherwise(options.context_shift)
    distance = sign * F.greatest(F.lit(options.min_shift), share * widest)
    centre = []
    for i, a in enumerate(AXES):
        at = F.col("centroid_vox")[i]
        still = at
        if options.stochastic:
            u1, u2 = (uniform(options.seed, F.lit(f"{n}{a}"), *ids) for n in ("u", "v"))
            normal = F.sqrt(-2 * F.log(1 - u1)) * F.cos(F.lit(2 * math.pi) * u2)
            still = at + normal * F.greatest(F.lit(1.0), options.jitter * extent[i])
        moved = F.when(axis == i, at + distance).otherwise(at)
        centre.append(F.when(F.col("role") == "center", still).otherwise(moved))
    return F.array(*centre)


def center_to_start(centre: Column, shape: Sequence[Column], patch: Sequence[int]) -> list[Column]:
    """Patch start per axis, half to even, kept inside the volume (padded to at least the patch)."""
    return [
        F.greatest(
            F.lit(0),
            F.least(
                F.bround(centre[i] - F.lit(patch[i] / 2.0), 0).cast("int"),
                F.greatest(shape[i] - patch[i], F.lit(0)),
            ),
        )
        for i in range(3)
    ]


def plan_patches(lesions: DataFrame, profile: DataFrame, subjects: DataFrame, options: SamplerOptions) -> DataFrame:
    """The patch plan: ``voi_id, plan_order, lesion_id, role, start_x, start_y, start_z``.

    ``subjects`` has ``voi_id, nx, ny, nz``; subjects without a lesion get a background patch if that is enabled.
    """
    shape = [F.col("nx"), F.col("ny"), F.col("nz")]
    # lesions go in ``lesion_order``; its columns are carried along instead of numbered, so the plan is numbered once
    ordered = lesions.withColumn("_bin", F.coalesce("size_bin", F.lit(""))).withColumn("size_bin", F.coalesce("size_bin", F.lit("medium")))
    budgeted = ordered.join(profile, "size_bin", "left").withColumn("budget", patch_budget(options))
    patches = assign_roles(budgeted, options).withColumn("_c", role_center(options)).join(subjects.select("voi_id", "nx", "ny", "nz"), "voi_id")
    starts = center_to_start(F.col("_c"), shape, options.patch)
    planned = patches.select(
        "voi_id", "_bin", "volume_vox", "patch_index", "lesion_id", "role", *[s.alias(f"start_{a}") for a, s in zip(AXES, starts)]
    )
    if options.background_prob > 0:
        bare = subjects.join(lesions.select("voi_id").distinct(), "voi_id", "left_anti")
        begin = []
        for i, a in enumerate(AXES):
            room = F.greatest(shape[i] - options.patch[i], F.lit(0))
            if options.stochastic:
                begin.append(F.floor(uniform(options.seed, F.lit(f"bg{a}"), "voi_id") * (room + 1)).cast("int"))
            else:
                begin.append(F.floor(room / 2).cast("int"))
        planned = planned.unionByName(
            bare.select(
                "voi_id",
                F.lit("").alias("_bin"),
                F.lit(0).cast(planned.schema["volume_vox"].dataType).alias("volume_vox"),
                F.lit(0).alias("patch_index"),
                F.lit(-1).cast("bigint").alias("lesion_id"),
                F.lit("background").alias("role"),
                *[b.alias(f"start_{a}") for a, b in zip(AXES, begin)],
            )
        )
    order = [F.col("_bin"), F.desc("volume_vox"), F.col("lesion_id"), F.col("patch_index")]
    if options.stochastic:
        order = [draw(options.seed, F.lit("order"), "voi_id", "lesion_id", "patch_index"), *order]
    return numbered(planned, ["voi_id"], order, "plan_order").drop("_bin", "volume_vox", "patch_index")


def plan_audit(plan: DataFrame) -> DataFrame:
    """Per VOI: lesions and patches in the plan, patches per role."""
    return plan.groupBy("voi_id").agg(
        F.count_distinct(F.when(F.col("lesion_id") >= 0, F.col("lesion_id"))).alias("num_lesions"),
        F.count("*").alias("num_planned_patches"),
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in (*fixed.ROLES, "background")],
    )
