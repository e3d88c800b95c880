"""Operators on voxel tables ``voi_id, x, y, z, hu, label`` and volume tables ``voi_id, nx, ny, nz, spacing, ...``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.geometry import clip
from cohortspark.operators.components import component_runs, component_table
from cohortspark.operators.stencil import interior_edge
from cohortspark.scale import fold_values, folded_percentiles, spread_join

AXES = ("x", "y", "z")
SLAB = 8  # slices that are matched with crop boxes together
INTENSITY_PERCENTS = {
    "p0_5": 0.5, "p5": 5.0, "p25": 25.0, "median": 50.0, "p75": 75.0, "p95": 95.0, "p99_5": 99.5,
}


def label_masks(voxels: DataFrame, bbox_labels: Sequence[int] = (1, 2, 3), mask_labels: Sequence[int] = (2,)) -> DataFrame:
    return voxels.withColumns(
        {"in_bbox": F.col("label").isin(*bbox_labels), "in_mask": F.col("label").isin(*mask_labels)}
    )


def apply_mask(voxels: DataFrame, inside: Column, background: float = -1000.0) -> DataFrame:
    return voxels.withColumn("hu", F.when(inside, F.col("hu")).otherwise(F.lit(background)))


def transpose_axes(df: DataFrame) -> DataFrame:
    """ZYX to XYZ order and back."""
    return df.withColumnsRenamed({"x": "_z", "z": "x"}).withColumnRenamed("_z", "z")


def flip_axis(voxels: DataFrame, volumes: DataFrame, axis: str = "x") -> DataFrame:
    size = volumes.select("voi_id", F.col(f"n{axis}").alias("_n"))
    return spread_join(voxels, size, "voi_id", AXES).withColumn(axis, F.col("_n") - 1 - F.col(axis)).drop("_n")


def reorient_ras(voxels: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Permute and flip axes so that x runs to the right's opposite, y to the back's opposite, z upwards (RAS).

    ``direction`` holds the row-major cosines of axis-aligned volumes; the result has diag(-1, -1, 1).
    """
    d = F.col("direction")
    sign = {0: -1.0, 1: -1.0, 2: 1.0}
    source = {}
    for world in range(3):
        row = F.transform(F.slice(d, 3 * world + 1, 3), F.abs)
        source[world] = (F.array_position(row, F.array_max(row)) - 1).cast("int")
    frame = volumes.withColumns({f"_a{w}": source[w] for w in range(3)}).withColumns(
        {f"_f{w}": F.get(d, F.col(f"_a{w}") + 3 * w) * F.lit(sign[w]) < 0 for w in range(3)}
    )
    dims, spacing = F.array("nx", "ny", "nz"), F.col("spacing")
    moved = frame.select(
        "voi_id",
        *[F.get(dims, F.col(f"_a{w}")).alias(f"n{AXES[w]}") for w in range(3)],
        F.array(*[F.get(spacing, F.col(f"_a{w}")) for w in range(3)]).alias("spacing"),
        # a flipped axis starts at the far end of the old one
        F.array(
            *[
                F.col("origin")[w]
                + F.when(
                    F.col(f"_f{w}"),
                    F.get(d, F.col(f"_a{w}") + 3 * w)
                    * F.get(spacing, F.col(f"_a{w}"))
                    * (F.get(dims, F.col(f"_a{w}")) - 1),
                ).otherwise(0.0)
                for w in range(3)
            ]
        ).alias("origin"),
        F.array(*[F.lit(v) for v in (-1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0)]).alias("direction"),
    )
    plan = frame.select(
        "voi_id", *[f"_a{w}" for w in range(3)], *[f"_f{w}" for w in range(3)], dims.alias("_dims")
    )
    old = F.array("x", "y", "z")
    new = {
        AXES[w]: F.when(F.col(f"_f{w}"), F.get("_dims", F.col(f"_a{w}")) - 1 - F.get(old, F.col(f"_a{w}"))).otherwise(
            F.get(old, F.col(f"_a{w}"))
        )
        for w in range(3)
    }
    joined = spread_join(voxels, plan, "voi_id", AXES).withColumns(new)
    return joined.select(*voxels.columns), moved


# ---- statistics ------------------------------------------------------------------------------------------


def tumor_metrics(voxels: DataFrame, volumes: DataFrame, tumor_label: int = 2) -> DataFrame:
    """Size and intensity of the tumour voxels, one row per volume, with ``has_tumor``."""
    stats = (
        voxels.where(F.col("label") == tumor_label)
        .groupBy("voi_id")
        .agg(
            F.count("*").alias("tumor_voxels"),
            F.avg("hu").alias("mean_hu"),
            F.stddev_pop("hu").alias("std_hu"),
            F.min("hu").alias("min_hu"),
            F.max("hu").alias("max_hu"),
        )
    )
    sp = F.col("spacing")
    mm3 = F.col("tumor_voxels") * (sp[0] * sp[1] * sp[2])
    return volumes.join(stats, "voi_id", "left").select(
        "voi_id",
        F.col("tumor_voxels").isNotNull().alias("has_tumor"),
        F.coalesce("tumor_voxels", F.lit(0)).alias("tumor_voxels"),
        mm3.alias("tumor_volume_mm3"),
        (mm3 / 1000).alias("tumor_volume_cm3"),
        "mean_hu",
        "std_hu",
        "min_hu",
        "max_hu",
    )


def intensity_stats(
    voxels: DataFrame,
    bbox_labels: Sequence[int] = (1, 2),
    hu_range: tuple[float, float] = (-200.0, 300.0),
    accuracy: int | None = None,
) -> DataFrame:
    """Foreground intensity statistics, raw and clipped to the window: two rows.

    Percentiles are exact unless ``accuracy`` asks for the approximate aggregate.
    """
    inside = fold_values(voxels.where(F.col("label").isin(*bbox_labels)), [], {"hu": F.col("hu")})
    kinds = inside.select(
        "_n",
        F.inline(
            F.array(
                F.struct(F.lit("raw").alias("kind"), F.col("_x")),
                F.struct(F.lit("windowed").alias("kind"), clip(F.col("_x"), *hu_range).alias("_x")),
            )
        ),
    )
    # deviations from the middle of the window, so that squares stay small; equal values need no second fold
    n, away = F.col("_n"), F.col("_x") - sum(hu_range) / 2.0
    mean = F.sum(n * away) / F.sum(n)
    moments = kinds.groupBy("kind").agg(
        F.sum(n).alias("n"),
        (mean + sum(hu_range) / 2.0).alias("mean"),
        F.sqrt(F.greatest(F.sum(n * away * away) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    if accuracy is None:
        points = folded_percentiles(kinds, ["kind"], INTENSITY_PERCENTS)
        points = points.select("kind", *[F.col("_q")[i].alias(name) for i, name in enumerate(INTENSITY_PERCENTS)])
    else:
        rows = voxels.where(F.col("label").isin(*bbox_labels)).select(F.col("hu").cast("double").alias("hu"))
        shares = F.array(*[F.lit(p / 100.0) for p in INTENSITY_PERCENTS.values()])
        both = rows.agg(
            F.percentile_approx("hu", shares, accuracy).alias("raw"),
            F.percentile_approx(clip(F.col("hu"), *hu_range), shares, accuracy).alias("windowed"),
        )
        kind = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("_q")) for k in ("raw", "windowed")]))
        points = both.select(kind).select("kind", *[F.col("_q")[i].alias(name) for i, name in enumerate(INTENSITY_PERCENTS)])
    return moments.join(points, "kind").withColumn("iqr", F.col("p75") - F.col("p25"))


def shape_stats(volumes: DataFrame) -> DataFrame:
    """Per axis min, max, mean and median of the volume sizes."""
    sizes = volumes.groupBy("nx", "ny", "nz").agg(F.count("*").alias("n"))
    long = sizes.select(
        "n", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"n{a}").alias("size")) for a in AXES]))
    )
    # an axis has few thousand different sizes, so the counted percentile is small
    return long.groupBy("axis").agg(
        F.min("size").alias("min"),
        F.max("size").alias("max"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("size", 0.5, F.col("n")).alias("median"),
    )


def focus_voxel(voxels: DataFrame, volumes: DataFrame, label: int = 2) -> DataFrame:
    """Truncated and clipped centroid of the label, else the middle of the volume."""
    centre = voxels.where(F.col("label") == label).groupBy("voi_id").agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    return volumes.join(centre, "voi_id", "left").select(
        "voi_id",
        *[
            F.coalesce(
                F.least(F.greatest(F.col(f"c{a}").cast("int"), F.lit(0)), F.col(f"n{a}") - 1),
                F.expr(f"n{a} div 2").cast("int"),
            ).alias(a)
            for a in AXES
        ],
    )


# ---- validation ------------------------------------------------------------------------------------------


def validate_voi(
    voxels: DataFrame,
    volumes: DataFrame,
    min_bbox: int = 0,
    min_save: int = 0,
    bbox_labels: Sequence[int] = (1, 2, 3),
    mask_labels: Sequence[int] = (2,),
) -> DataFrame:
    """Voxel counts per volume with the first reason to reject it, or ``OK``."""
    counts = voxels.groupBy("voi_id").agg(
        F.count_if(F.col("label").isin(*bbox_labels)).alias("bv"), F.count_if(F.col("label").isin(*mask_labels)).alias("sv")
    )
    full = volumes.select("voi_id").join(counts, "voi_id", "left").na.fill(0, ["bv", "sv"])
    reason = (
        F.when(F.col("bv") == 0, "Empty bbox_mask (no tissue)")
        .when(
            (F.lit(min_bbox) > 0) & (F.col("bv") < min_bbox),
            F.format_string(f"Insufficient tissue (%d < {min_bbox} voxels)", "bv"),
        )
        .when(F.col("sv") == 0, "Empty save_mask (no target labels)")
        .when(
            (F.lit(min_save) > 0) & (F.col("sv") < min_save),
            F.format_string(f"Insufficient target labels (%d < {min_save} voxels)", "sv"),
        )
        .otherwise("OK")
    )
    return full.withColumn("reason", reason).withColumn("valid", F.col("reason") == "OK")


def mask_integrity(masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Masks (``voi_id, x, y, z, value``) hold only 0 and 1 and fill the volume."""
    seen = masks.groupBy("voi_id").agg(
        F.count_if(~F.col("value").isin(0, 1)).alias("odd"), F.array(*[F.max(a) + 1 for a in AXES]).alias("shape")
    )
    joined = volumes.select("voi_id", F.array("nx", "ny", "nz").alias("expected")).join(seen, "voi_id", "left")
    reason = (
        F.when(F.col("odd") > 0, "Mask contains invalid values")
        .when(~F.col("shape").eqNullSafe(F.col("expected")), "Shape mismatch")
        .otherwise("OK")
    )
    return joined.select("voi_id", reason.alias("reason"), (reason == "OK").alias("valid"))


def sanity_flags(
    voxels: DataFrame,
    volumes: DataFrame,
    margin: int = 5,
    min_tumor: int = 100,
    min_size: Sequence[int] = (96, 96, 64),
    hu_range: tuple[float, float] = (-200.0, 300.0),
    min_in_range: float = 0.5,
    tumor_label: int = 2,
) -> DataFrame:
    """Flags that do not reject: boundary contact, small tumour, small volume, intensities out of range."""
    joined = spread_join(voxels, volumes.select("voi_id", "nx", "ny", "nz"), "voi_id", AXES)
    near = F.lit(False)
    for a in AXES:
        near = near | (F.col(a) < margin) | (F.col(a) >= F.col(f"n{a}") - margin)
    tumor = F.col("label") == tumor_label
    seen = joined.groupBy("voi_id").agg(
        F.count_if(tumor).alias("tumor"),
        F.count_if(tumor & near).alias("edge"),
        F.count_if(F.col("hu").between(*hu_range)).alias("inside"),
        F.count("*").alias("n"),
    )
    small = F.lit(False)
    for a, least in zip(AXES, min_size):
        small = small | (F.col(f"n{a}") < least)
    return volumes.join(seen, "voi_id", "left").select(
        "voi_id",
        F.array_compact(
            F.array(
                F.when(F.col("edge") > 0, "boundary_contact"),
                F.when(F.coalesce("tumor", F.lit(0)) < min_tumor, "small_tumor"),
                F.when(small, "below_min_voi"),
                F.when(F.try_divide("inside", "n") < min_in_range, "anomalous_hu"),
            )
        ).alias("flags"),
    )


# ---- boxes and grids -------------------------------------------------------------------------------------


def separate_kidneys(
    voxels: DataFrame, volumes: DataFrame, bbox_labels: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    """The one or two largest 6-connected parts, named by side, with box, centre slice and size."""
    tissue = voxels.where(F.col("label").isin(*bbox_labels))
    parts = component_table(component_runs(tissue, ["voi_id"], 6), ["voi_id"], ("z", "y", "x"))
    frame = volumes.select("voi_id", "nx", "spacing", "origin", "direction")
    d, sp = F.col("direction"), F.col("spacing")
    centre = F.col("origin")[0]
    for i, a in enumerate(AXES):
        centre = centre + d[i] * sp[i] * (F.col(f"sum_{a}") / F.col("volume_vox"))
    box = F.struct(
        (-F.col("volume_vox")).alias("size"),
        F.col("component").alias("component"),
        F.col("cx").alias("cx"),
        *[F.col(f"min_{a}") for a in AXES],
        *[F.col(f"max_{a}") for a in AXES],
    )
    placed = parts.join(frame, "voi_id").withColumn("cx", centre)
    # two smallest structs = two largest parts; ties go to the lower component number
    lead = placed.groupBy("voi_id").agg(
        F.min(box).alias("a"),
        F.count("*").alias("n_parts"),
        F.max("nx").alias("nx"),
        F.max(sp[0]).alias("sx"),
    )
    second = (
        placed.join(lead.select("voi_id", F.col("a.component").alias("_c")), "voi_id")
        .where("component <> _c")
        .groupBy("voi_id")
        .agg(F.min(box).alias("b"))
    )
    both = lead.join(second, "voi_id", "left")
    alone = F.when(F.col("a.cx") < F.col("nx") * F.col("sx") / 2, "L").otherwise("R")
    a_left = F.col("a.cx") <= F.col("b.cx")
    sides = F.array_compact(
        F.array(
            F.struct(F.when(F.col("b").isNull(), alone).when(a_left, "L").otherwise("R").alias("side"), F.col("a").alias("p")),
            F.when(
                F.col("b").isNotNull(), F.struct(F.when(a_left, "R").otherwise("L").alias("side"), F.col("b").alias("p"))
            ),
        )
    )
    shown = both.select("voi_id", F.inline(sides))
    return shown.select(
        "voi_id",
        "side",
        *[F.col(f"p.min_{a}").alias(f"start_{a}") for a in AXES],
        *[(F.col(f"p.max_{a}") - F.col(f"p.min_{a}") + 1).alias(f"size_{a}") for a in AXES],
        (F.col("p.min_z") + F.expr("(p.max_z - p.min_z + 1) div 2")).cast("int").alias("center_slice"),
        (-F.col("p.size")).alias("voxel_count"),
    )


def crop_window(boxes: DataFrame, expansion_mm: float) -> DataFrame:
    """Boxes (``start_*, size_*``) widened by a margin in mm and kept inside the image (``nx.., spacing``)."""
    out = boxes
    for i, a in enumerate(AXES):
        margin = F.ceil(F.lit(expansion_mm) / F.col("spacing")[i]).cast("int")
        low = F.greatest(F.lit(0), F.col(f"start_{a}") - margin)
        high = F.least(F.col(f"n{a}"), F.col(f"start_{a}") + F.col(f"size_{a}") + margin)
        out = out.withColumns(
            {
                f"margin_{a}": margin,
                f"crop_{a}": low,
                f"crop_size_{a}": F.greatest(F.lit(1), high - low),
            }
        )
    return out


def min_size_in_source(target_size: int, target_spacing: float, spacing: Column) -> Column:
    """Voxels of the target grid as voxels of the source grid, cut off and not rounded."""
    return (F.lit(target_size) * F.lit(target_spacing) / spacing).cast("int")


def enforce_min_size(boxes: DataFrame, min_size: dict[str, Column]) -> DataFrame:
    """Grow ``crop_*, crop_size_*`` to a least size: half to each side, the rest to the side with room."""
    out = boxes
    for a in AXES:
        out = (
            out.withColumn("_d", F.greatest(min_size[a] - F.col(f"crop_size_{a}"), F.lit(0)))
            .withColumn("_room_low", F.col(f"crop_{a}"))
            .withColumn("_room_high", F.col(f"n{a}") - F.col(f"crop_{a}") - F.col(f"crop_size_{a}"))
            .withColumn("_low", F.expr("_d div 2").cast("int"))
            # what does not fit below goes above, what does not fit above goes below, then both are clipped
            .withColumn("_low", F.least("_low", "_room_low"))
            .withColumn("_high", F.col("_d") - F.col("_low"))
            .withColumn("_low", F.col("_low") + F.greatest(F.col("_high") - F.col("_room_high"), F.lit(0)))
            .withColumn("_low", F.least("_low", "_room_low"))
            .withColumn("_high", F.least("_high", "_room_high"))
        )
        out = out.withColumns(
            {
                f"grow_low_{a}": F.col("_low").cast("int"),
                f"grow_high_{a}": F.col("_high").cast("int"),
                f"crop_{a}": (F.col(f"crop_{a}") - F.col("_low")).cast("int"),
                f"crop_size_{a}": (F.col(f"crop_size_{a}") + F.col("_low") + F.col("_high")).cast("int"),
            }
        ).drop("_d", "_room_low", "_room_high", "_low", "_high")
    return out


def crop_voxels(voxels: DataFrame, boxes: DataFrame, slab: int = SLAB) -> DataFrame:
    """Voxels inside the boxes of their volume, with box-local coordinates added.

    A box is listed once for each slab of ``slab`` slices that it reaches into, and voxels meet it by volume and slab.  So a
    large volume is dealt out by its own slabs, and voxels of slabs without a box are never compared.
    """
    last = F.col("crop_z") + F.col("crop_size_z") - 1
    size = F.lit(slab)
    slabs = F.when(
        (F.col("crop_size_x") > 0) & (F.col("crop_size_y") > 0) & (F.col("crop_size_z") > 0),
        F.sequence(F.floor(F.col("crop_z") / size), F.floor(last / size)),
    )
    reached = boxes.withColumn("_slab", F.explode(slabs))
    placed = voxels.withColumn("_slab", F.floor(F.col("z") / size))
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) >= F.col(f"crop_{a}")) & (F.col(a) < F.col(f"crop_{a}") + F.col(f"crop_size_{a}"))
    joined = placed.join(reached, ["voi_id", "_slab"]).where(inside).drop("_slab")
    return joined.withColumns({f"{a}_local": F.col(a) - F.col(f"crop_{a}") for a in AXES})


def resample_grid(volumes: DataFrame, target: Sequence[float], aniso_thresh: float = 2.0) -> DataFrame:
    """New sizes, anisotropy ratio and the chosen method."""
    sp = F.col("spacing")
    ratio = F.array_max(sp) / F.array_min(sp)
    sizes = {f"m{a}": F.ceil(F.col(f"n{a}") * (sp[i] / F.lit(float(target[i])))).cast("int") for i, a in enumerate(AXES)}
    return volumes.withColumns(
        {
            **sizes,
            "aniso_ratio": ratio,
            "anisotropic": ratio > aniso_thresh,
            "method": F.when(ratio > aniso_thresh, "two_step_bspline").otherwise("one_shot_bspline"),
        }
    )


def resample_voxels(
    voxels: DataFrame,
    volumes: DataFrame,
    target: Sequence[float],
    value: str = "hu",
    method: str = "nearest",
    default: float = -1000.0,
) -> DataFrame:
    """Values on the grid of the target spacing; positions past the last half voxel take the default.

    Every source voxel emits the output voxels it feeds, so no grid is built and, for ``nearest``, nothing is
    shuffled beyond the join with the volume sizes.
    """
    grid = resample_grid(volumes, target).select("voi_id", "nx", "ny", "nz", "mx", "my", "mz", "spacing")
    values = voxels.select("voi_id", *AXES, F.col(value).cast("double").alias("_v"))
    # A slice stays in one task, so what its voxels give to one output voxel is added up before the shuffle.
    current = spread_join(values, grid, "voi_id", ["z"])
    current = current.withColumn("_w", F.lit(1.0)).withColumn("_outside", F.lit(False))
    for i, a in enumerate(AXES):
        step = F.lit(float(target[i])) / F.col("spacing")[i]
        reach = F.lit(0.5 if method == "nearest" else 1.0)
        last = F.col(a) == F.col(f"n{a}") - 1
        low = F.greatest(F.floor((F.col(a) - reach) / step), F.lit(0)).cast("int")
        high = F.when(last, F.col(f"m{a}") - 1).otherwise(
            F.least(F.ceil((F.col(a) + reach) / step).cast("int"), F.col(f"m{a}") - 1)
        )
        spread = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        current = current.withColumn("_i", F.explode(spread))
        at = F.col("_i") * step
        if method == "nearest":
            near = F.least(F.floor(at + 0.5), F.col(f"n{a}") - 1)
            current = current.where(near == F.col(a))
        else:
            weight = 1.0 - F.abs(F.least(at, F.col(f"n{a}") - 1.0) - F.col(a))
            current = current.withColumn("_w", F.col("_w") * weight).where(weight > 0)
        current = current.withColumn("_outside", F.col("_outside") | (at >= F.col(f"n{a}") - 0.5)).withColumnRenamed(
            "_i", f"_{a}"
        )
    out = [F.col(f"_{a}").alias(a) for a in AXES]
    if method == "nearest":
        return current.select("voi_id", *out, F.when(F.col("_outside"), default).otherwise(F.col("_v")).alias(value))
    return (
        current.select("voi_id", *out, (F.col("_w") * F.col("_v")).alias("_p"), "_outside")
        .groupBy("voi_id", *AXES)
        .agg(F.when(F.bool_or("_outside"), default).otherwise(F.sum("_p")).alias(value))
    )


def pad_to_min(volumes: DataFrame, voxels: DataFrame, patch: Sequence[int], fill: float = -200.0) -> DataFrame:
    """Voxels of volumes padded to at least the patch size; the low side takes the odd voxel.

    Old voxels are shifted; only padding voxels are made, slab by slab, so nothing is joined against a full grid.
    """
    sized = volumes.select(
        "voi_id",
        "nx",
        "ny",
        "nz",
        *[F.greatest(F.lit(int(p)) - F.col(f"n{a}"), F.lit(0)).alias(f"_p{a}") for a, p in zip(AXES, patch)],
    )
    for a in AXES:
        sized = sized.withColumn(f"_l{a}", F.expr(f"(_p{a} + 1) div 2").cast("int")).withColumn(
            f"_t{a}", F.col(f"n{a}") + F.col(f"_p{a}")
        )
    moved = spread_join(voxels.select("voi_id", *AXES, "hu"), sized, "voi_id", AXES)
    moved = moved.select("voi_id", *[(F.col(a) + F.col(f"_l{a}")).alias(a) for a in AXES], "hu")
    lines = sized.where("_px + _py + _pz > 0")
    for a in ("z", "y"):
        lines = lines.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"_t{a}") - 1)))
    inside = F.lit(True)
    for a in ("y", "z"):
        inside = inside & (F.col(a) >= F.col(f"_l{a}")) & (F.col(a) < F.col(f"_l{a}") + F.col(f"n{a}"))
    whole = F.sequence(F.lit(0), F.col("_tx") - 1)
    ends = F.filter(whole, lambda x: (x < F.col("_lx")) | (x >= F.col("_lx") + F.col("nx")))
    padding = lines.withColumn("x", F.explode(F.when(inside, ends).otherwise(whole)))
    return moved.unionByName(padding.select("voi_id", *AXES, F.lit(fill).cast("double").alias("hu")))


# ---- neighbourhoods --------------------------------------------------------------------------------------


def tumor_boundary(voxels: DataFrame, label: int = 2) -> DataFrame:
    """Label voxels whose 3 x 3 neighbourhood in the slice is not all of that label."""
    return interior_edge(voxels.where(F.col("label") == label))


def contact_ratio(
    lesion_runs: DataFrame, voxels: DataFrame, volumes: DataFrame, iterations: int = 1, kidney_label: int = 1
) -> DataFrame:
    """Kidney voxels in the shell around each lesion, and their share of the shell.

    ``lesion_runs`` are runs with ``lesion`` (see ``component_runs``); growing by a 26-neighbourhood n times is
    the cube of radius n, so a run becomes (2n+1)^2 longer runs.
    """
    r = max(1, iterations)
    around = [(dy, dz) for dy in range(-r, r + 1) for dz in range(-r, r + 1)]
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dy, dz in around])
    grown = (
        spread_join(lesion_runs, volumes.select("voi_id", "nx", "ny", "nz"), "voi_id", ["x0", "y", "z"])
        .withColumn("o", F.explode(offsets))
        .withColumns({"_y": F.col("y") + F.col("o.dy"), "_z": F.col("z") + F.col("o.dz")})
        .where("_y >= 0 and _y < ny and _z >= 0 and _z < nz")
        .withColumn("x", F.explode(F.sequence(F.greatest(F.col("x0") - r, F.lit(0)), F.least(F.col("x1") + r, F.col("nx") - 1))))
    )
    own = (F.col("o.dy") == 0) & (F.col("o.dz") == 0) & F.col("x").between(F.col("x0"), F.col("x1"))
    cells = grown.select("voi_id", "lesion", "x", F.col("_y").alias("y"), F.col("_z").alias("z"), own.alias("own"))
    shell = cells.groupBy("voi_id", "lesion", "x", "y", "z").agg(F.bool_or("own").alias("own")).where("not own")
    kidney = voxels.where(F.col("label") == kidney_label).select("voi_id", "x", "y", "z", F.lit(1).alias("k"))
    return (
        shell.join(kidney, ["voi_id", "x", "y", "z"], "left")
        .groupBy("voi_id", "lesion")
        .agg(F.count("k").alias("kidney_contact_vox"), (F.count("k") / F.count("*")).alias("kidney_contact_ratio"))
    )


def select_slices(voxels: DataFrame, volumes: DataFrame, num_slices: int, centred: bool = True) -> DataFrame:
    """Voxels of n slices along z, around the middle or evenly spread."""
    depth = volumes.select("voi_id", F.col("nz").alias("_d")).withColumn(
        "_n", F.greatest(F.lit(1), F.least(F.lit(num_slices), F.col("_d")))
    )
    if centred:
        start = F.greatest(F.lit(0), F.expr("_d div 2") - F.expr("_n div 2"))
        start = F.least(start, F.col("_d") - F.col("_n"))
        return (
            spread_join(voxels, depth, "voi_id", AXES)
            .where((F.col("z") >= start) & (F.col("z") < start + F.col("_n")))
            .drop("_d", "_n")
        )
    spread = F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("_n") - 1),
            lambda i: F.bround(i * (F.col("_d") - 1) / (F.col("_n") - 1).cast("double"), 0).cast("int"),
        )
    )
    picks = depth.select("voi_id", F.array_distinct(spread).alias("_s"))
    return spread_join(voxels, picks, "voi_id", AXES).where(F.array_contains("_s", F.col("z"))).drop("_s")
