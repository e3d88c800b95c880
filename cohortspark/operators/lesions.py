"""Lesion catalog, dataset fingerprint and sampling profile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import fixed
from cohortspark.operators import voxels as vx
from cohortspark.operators.components import component_runs, component_table
from cohortspark.scale import exact_percentiles, folded_percentiles, numbered
from cohortspark.session import cut_lineage, staged

AXES = vx.AXES


@dataclass(frozen=True)
class FingerprintOptions:
    tumor_label: int = 2
    kidney_label: int = 1
    bbox_labels: tuple[int, ...] = (1, 2)
    hu_range: tuple[float, float] = (-200.0, 300.0)
    target_spacing: tuple[float, float, float] | None = None
    size_bin_percentiles: tuple[float, ...] = (25.0, 50.0, 75.0)
    balancing_alpha: float = 0.5
    min_lesion_voxels: int = 5
    contact_dilation_iters: int = 1
    patch_size_candidates: tuple[tuple[int, int, int], ...] = ()


# The values in force when the planner configuration sets none.
PLANNER_OPTIONS = FingerprintOptions(
    bbox_labels=(1, 2, 3),
    target_spacing=(1.0, 1.0, 1.0),
    size_bin_percentiles=(0.0, 20.0, 50.0, 80.0, 95.0, 100.0),
    balancing_alpha=0.7,
    min_lesion_voxels=10,
)


@dataclass(frozen=True)
class Components:
    """Lesion components before and after the size filter."""

    runs: DataFrame
    table: DataFrame


def lesion_components(voxels: DataFrame, label: int = 2) -> Components:
    runs = component_runs(voxels.where(F.col("label") == label), ["voi_id"], 26)
    return Components(runs, cut_lineage(component_table(runs, ["voi_id"])))


def lesion_geometry(table: DataFrame, spacing: Sequence[float] | None = None) -> DataFrame:
    """Size, centroid, box and extent per component; the mm columns are NULL without a spacing."""
    sizes = {a: F.col(f"max_{a}") - F.col(f"min_{a}") + 1 for a in AXES}
    centre = {a: F.col(f"sum_{a}") / F.col("volume_vox") for a in AXES}
    if spacing is None:
        none = F.lit(None).cast("double")
        volume_mm3, size_mm, centre_mm, extent_mm = none, none.cast("array<double>"), none.cast("array<double>"), none
        size_mm = centre_mm = F.lit(None).cast("array<double>")
    else:
        sp = dict(zip(AXES, (float(s) for s in spacing)))
        volume_mm3 = F.col("volume_vox") * F.lit(sp["x"] * sp["y"] * sp["z"])
        size_mm = F.array(*[sizes[a] * sp[a] for a in AXES])
        centre_mm = F.array(*[centre[a] * sp[a] for a in AXES])
        extent_mm = F.array_max(size_mm)
    return table.select(
        "voi_id",
        "component",
        "root",
        "volume_vox",
        volume_mm3.alias("volume_mm3"),
        F.array(*centre.values()).alias("centroid_vox"),
        centre_mm.alias("centroid_mm"),
        F.array(*[F.col(f"min_{a}") for a in AXES]).alias("bbox_min_vox"),
        F.array(*[F.col(f"max_{a}") + 1 for a in AXES]).alias("bbox_max_vox"),
        F.array(*sizes.values()).alias("bbox_size_vox"),
        size_mm.alias("bbox_size_mm"),
        F.greatest(*sizes.values()).alias("max_extent_vox"),
        extent_mm.alias("max_extent_mm"),
    )


def min_lesion_filter(table: DataFrame, vois: DataFrame, least: int) -> DataFrame:
    """Per VOI: kept and skipped components and the warnings that follow."""
    counts = table.groupBy("voi_id").agg(
        F.count_if(F.col("volume_vox") >= least).alias("n_kept"),
        F.count_if(F.col("volume_vox") < least).alias("n_skipped"),
    )
    skipped = F.format_string(
        f"Skipped %d connected component(s) smaller than min_lesion_voxels={least}.", F.col("n_skipped")
    )
    none_left = "Tumor voxels were present, but all connected components were below min_lesion_voxels."
    return (
        vois.select("voi_id")
        .join(counts, "voi_id", "left")
        .select(
            "voi_id",
            F.col("n_kept").isNotNull().alias("has_tumor"),
            F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
            F.coalesce("n_skipped", F.lit(0)).alias("n_skipped"),
            F.array_compact(
                F.array(F.when(F.col("n_skipped") > 0, skipped), F.when(F.col("n_kept") == 0, none_left))
            ).alias("lesion_warnings"),
        )
    )


def analyze_vois(voxels: DataFrame, vois: DataFrame, components: Components, options: FingerprintOptions) -> DataFrame:
    """One row per VOI: counts, tumour flag and warnings.

    ``vois`` has ``voi_id, nx, ny, nz`` and, for the image, ``image_path`` and ``image_shape``.
    """
    shape = F.array("nx", "ny", "nz")
    missing = F.col("image_path").isNull()
    mismatch = ~missing & (F.col("image_shape") != shape)

    def tuple_text(c):
        return F.concat(F.lit("("), F.array_join(c.cast("array<string>"), ", "), F.lit(")"))

    mismatch_text = F.concat(
        F.lit("Image/mask shape mismatch: image "),
        tuple_text(F.col("image_shape")),
        F.lit(" vs mask "),
        tuple_text(shape),
        F.lit("; skipped intensity extraction."),
    )
    counts = (
        voxels.where(F.col("label").isin(*options.bbox_labels))
        .groupBy("voi_id")
        .agg(F.count("*").alias("bbox_voxel_count"))
    )
    kept = min_lesion_filter(components.table, vois, options.min_lesion_voxels)
    n = F.coalesce("bbox_voxel_count", F.lit(0))
    return (
        vois.join(counts, "voi_id", "left")
        .join(kept, "voi_id")
        .select(
            "voi_id",
            n.alias("bbox_voxel_count"),
            F.when(missing | mismatch, 0).otherwise(n).alias("filtered_bbox_voxel_count"),
            "has_tumor",
            "n_kept",
            "n_skipped",
            F.concat(
                F.array_compact(
                    F.array(
                        F.when(missing, "Image file missing; skipped intensity extraction."),
                        F.when(mismatch, mismatch_text),
                    )
                ),
                "lesion_warnings",
            ).alias("warnings"),
        )
    )


def lesion_catalog(
    voxels: DataFrame, vois: DataFrame, components: Components, options: FingerprintOptions
) -> DataFrame:
    """The 25-field lesion table.

    ``vois``: ``voi_id, case_id, laterality, mask_path, image_path, image_shape, nx, ny, nz``.
    """
    kept = components.table.where(F.col("volume_vox") >= options.min_lesion_voxels)
    ids = numbered(kept, ["voi_id"], [F.col("component")], "lesion_id", start=0)
    geometry = lesion_geometry(ids, options.target_spacing).join(
        ids.select("voi_id", "component", "lesion_id"), ["voi_id", "component"]
    )
    lesion_runs = components.runs.join(
        ids.select("voi_id", "root", F.col("lesion_id").alias("lesion")), ["voi_id", "root"]
    )
    touching = vx.contact_ratio(lesion_runs, voxels, vois, options.contact_dilation_iters, options.kidney_label)
    analysis = analyze_vois(voxels, vois, components, options).select("voi_id", "n_kept", "warnings")
    return (
        geometry.join(touching.withColumnRenamed("lesion", "lesion_id"), ["voi_id", "lesion_id"], "left")
        .join(vois, "voi_id")
        .join(analysis, "voi_id")
        .select(
            "case_id",
            "voi_id",
            F.coalesce("laterality", F.lit("unknown")).alias("laterality"),
            "mask_path",
            "image_path",
            "lesion_id",
            F.col("n_kept").alias("num_lesions_in_voi"),
            F.array("nx", "ny", "nz").alias("voi_shape"),
            F.lit("voi_local").alias("coordinates_reference"),
            F.lit(False).alias("full_volume_coordinates_available"),
            "volume_vox",
            "volume_mm3",
            "centroid_vox",
            "centroid_mm",
            "bbox_min_vox",
            "bbox_max_vox",
            "bbox_size_vox",
            "bbox_size_mm",
            "max_extent_vox",
            "max_extent_mm",
            F.lit(0).alias("kidney_overlap_vox"),  # a voxel has one label, so lesion and kidney never overlap
            F.coalesce("kidney_contact_vox", F.lit(0)).alias("kidney_contact_vox"),
            F.coalesce("kidney_contact_ratio", F.lit(0.0)).alias("kidney_contact_ratio"),
            F.lit(None).cast("string").alias("size_bin"),
            F.sort_array(F.array_distinct("warnings")).alias("warnings"),
        )
    )


# ---- size bins and sampling profile ----------------------------------------------------------------------


def _metric(lesions: DataFrame, mm: str, vox: str) -> str:
    """The mm column where every row has it, else the voxel column."""
    return vox if lesions.where(F.col(mm).isNull()).limit(1).count() else mm


def size_cuts(lesions: DataFrame, percentiles: Sequence[float]) -> tuple[str, list[float], list[float]]:
    """Metric, cut per percentile, and the strictly rising cuts; a handful of numbers on the driver."""
    sizes = staged(lesions.groupBy("volume_mm3", "volume_vox").agg(F.count("*").alias("_n")), "sizes")
    metric = _metric(sizes, "volume_mm3", "volume_vox")
    named = {f"p{i}": float(p) for i, p in enumerate(sorted(percentiles))}
    known = sizes.select(F.col(metric).cast("double").alias("_x"), "_n").where("_x is not null")
    found = folded_percentiles(known, [], named).first()["_q"]
    row = {f"v_{p}": found[i] if found else None for i, p in enumerate(named)}
    cuts = [row[f"v_{p}"] for p in named]
    rising: list[float] = []
    for cut in cuts:
        if cut is not None and (not rising or cut > rising[-1]):
            rising.append(cut)
    return metric, cuts, rising


def bin_labels(n_bins: int) -> list[str]:
    labels = fixed.SIZE_BIN_LABELS
    return labels[:n_bins] if n_bins <= len(labels) else [f"bin_{i}" for i in range(n_bins)]


def assign_size_bins(lesions: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """``size_bin`` by the first cut that is not below the value: bins are (lower, upper]."""
    metric, _, cuts = size_cuts(lesions, percentiles)
    labels = bin_labels(len(cuts) + 1)
    below = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(metric)) if cuts else F.array()
    names = F.array(*[F.lit(label) for label in labels])
    return lesions.withColumn("size_bin", F.get(names, F.size(below)))


def size_bin_table(lesions: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """The bins in order with their bounds; ``min_inclusive`` is a name only, the bound itself is left out."""
    metric, _, cuts = size_cuts(lesions, percentiles)
    labels = bin_labels(len(cuts) + 1)
    bounds = [None, *cuts, None]
    rows = [(i, label, metric, bounds[i], bounds[i + 1]) for i, label in enumerate(labels)]
    return lesions.sparkSession.createDataFrame(
        rows, "bin_no int, name string, metric string, min_inclusive double, max_inclusive double"
    )


def _by_bin(bin_name: Column, mapping: dict, default) -> Column:
    chain = F.when(F.lit(False), F.lit(None))
    for name, value in mapping.items():
        chain = chain.when(bin_name == name, F.lit(value))
    return chain.otherwise(F.lit(default))


def bin_profile(lesions: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Per size bin: count, empirical and target share, patch budget and role priors."""
    alpha = min(1.0, max(0.0, alpha))
    counts = lesions.groupBy("size_bin").agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("total"), F.count("*").alias("k")).alias("t")).scalar()
    share = F.col("n") / F.col("_t.total")
    priors = {
        role: _by_bin(F.col("size_bin"), {b: p[i] for b, p in fixed.ROLE_PRIORS.items()}, fixed.ROLE_PRIORS_DEFAULT[i])
        for i, role in enumerate(fixed.ROLES)
    }
    return counts.withColumn("_t", totals).select(
        "size_bin",
        "n",
        share.alias("empirical"),
        ((1 - alpha) * share + alpha * (1 / F.col("_t.k"))).alias("target"),
        _by_bin(F.col("size_bin"), fixed.PATCH_BUDGET, fixed.PATCH_BUDGET_DEFAULT).alias("patch_budget"),
        *[c.alias(f"prior_{role}") for role, c in priors.items()],
    )


PROFILE_PERCENTS = {f"p{p}": float(p) for p in (5, 10, 25, 50, 75, 90, 95)}
BOX_PERCENTS = {f"p{p}": float(p) for p in (25, 50, 75, 90)}


def sampling_profile(lesions: DataFrame) -> DataFrame:
    """Percentiles of volume, extent and box per axis as ``measure, metric, percentile, value``."""
    pairs = [("volume_mm3", "volume_vox"), ("max_extent_mm", "max_extent_vox"), ("bbox_size_mm", "bbox_size_vox")]
    lacking = lesions.agg(*[F.bool_or(F.col(mm).isNull()).alias(mm) for mm, _ in pairs]).first()
    volume, extent, box = [vox if lacking[mm] else mm for mm, vox in pairs]
    measures = {"volume": F.col(volume), "extent": F.col(extent)} | {
        f"bbox_{a}": F.col(box)[i] for i, a in enumerate(AXES)
    }
    metric = {"volume": volume, "extent": extent} | {f"bbox_{a}": box for a in AXES}
    wide = exact_percentiles(lesions, [], measures, PROFILE_PERCENTS)
    rows = [
        F.struct(F.lit(m).alias("measure"), F.lit(metric[m]).alias("metric"), F.lit(p).alias("percentile"), F.col(f"{m}_{p}").alias("value"))
        for m in measures
        for p in (BOX_PERCENTS if m.startswith("bbox") else PROFILE_PERCENTS)
    ]
    return wide.select(F.inline(F.array(*rows)))


def patch_recommendations(lesions: DataFrame, margin: float = 12.0) -> DataFrame:
    """Per size bin and axis the p75 and p90 extent, and both with a margin on each side."""
    per_bin_mm = lesions.groupBy("size_bin").agg(F.count_if(F.col("bbox_size_mm").isNull()).alias("_without"))
    flagged = lesions.join(per_bin_mm, "size_bin")
    size = F.when(F.col("_without") == 0, F.col("bbox_size_mm")).otherwise(F.col("bbox_size_vox").cast("array<double>"))
    units = F.when(F.col("_without") == 0, "mm").otherwise("vox")
    rows = flagged.select("size_bin", units.alias("units"), size.alias("_s"))
    wide = exact_percentiles(
        rows, ["size_bin", "units"], {a: F.col("_s")[i] for i, a in enumerate(AXES)}, {"p75": 75.0, "p90": 90.0}
    )
    return wide.select(
        "size_bin",
        "units",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("axis"),
                        F.col(f"{a}_p75").alias("extent_p75"),
                        F.col(f"{a}_p90").alias("extent_p90"),
                        (F.col(f"{a}_p75") + 2 * margin).alias("min_patch"),
                        (F.col(f"{a}_p90") + 2 * margin).alias("context_patch"),
                    )
                    for a in AXES
                ]
            )
        ),
    )


def patch_coverage(lesions: DataFrame, candidates: Sequence[Sequence[int]]) -> DataFrame:
    """Share of lesions whose box fits into each candidate patch."""
    sizes = lesions.groupBy("bbox_size_vox").agg(F.count("*").alias("n"))
    options = F.array(*[F.array(*[F.lit(int(v)) for v in c]) for c in candidates])
    offered = sizes.withColumn("c", F.explode(options))
    b, c = F.col("bbox_size_vox"), F.col("c")
    fits = (c[0] >= b[0]) & (c[1] >= b[1]) & (c[2] >= b[2])
    return offered.groupBy(F.array_join(c.cast("array<string>"), "x").alias("candidate")).agg(
        (F.sum(F.when(fits, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"),
        F.sum("n").alias("num_lesions"),
    )


def dataset_fingerprint(
    voxels: DataFrame, vois: DataFrame, analysis: DataFrame, lesions: DataFrame, options: FingerprintOptions
) -> DataFrame:
    """The dataset summary as one nested row; intensities come from VOIs whose image is usable."""
    usable = analysis.where("filtered_bbox_voxel_count > 0").select("voi_id")
    stats = vx.intensity_stats(voxels.join(usable, "voi_id", "left_semi"), options.bbox_labels, options.hu_range)
    fields = ["mean", "std", "min", "max", *vx.INTENSITY_PERCENTS, "iqr"]
    by_kind = stats.agg(
        *[
            F.max(F.when(F.col("kind") == kind, F.struct(*fields))).alias(name)
            for kind, name in (("raw", "foreground_intensity"), ("windowed", "windowed_intensity"))
        ]
    )
    totals = analysis.agg(
        F.struct(
            F.sum("bbox_voxel_count").alias("total_bbox_voxels"),
            F.sum("filtered_bbox_voxel_count").alias("filtered_bbox_voxels"),
            F.count("*").alias("num_vois"),
            F.count_if("has_tumor").alias("num_vois_with_tumor"),
        ).alias("t")
    ).scalar()
    shapes = vx.shape_stats(vois).agg(
        F.sort_array(F.collect_list(F.struct("axis", "min", "max", "mean", "median"))).alias("s")
    )  # three rows
    return (
        by_kind.withColumns(
            {"_t": totals, "shape": shapes.scalar(), "num_lesions": lesions.agg(F.count("*").alias("n")).scalar()}
        )
        .select(
            F.lit(3).alias("version"),
            "foreground_intensity",
            "windowed_intensity",
            F.struct(
                F.lit("window_rescale").alias("method"),
                F.lit(options.hu_range[0]).alias("window_min"),
                F.lit(options.hu_range[1]).alias("window_max"),
                F.lit(-1.0).alias("output_min"),
                F.lit(1.0).alias("output_max"),
            ).alias("normalization"),
            F.col("shape").alias("voi_shape_statistics"),
            "_t.*",
            "num_lesions",
        )
    )
