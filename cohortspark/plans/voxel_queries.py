"""Queries on voxels, volumes and lesions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions import geometry
from cohortspark.operators import components as cc
from cohortspark.operators import lesions as les
from cohortspark.operators import voxels as vx
from cohortspark.plans.registry import query
from cohortspark.sources.derived import image_meta, table, with_tables

OPTIONS = les.FingerprintOptions(target_spacing=(0.8, 0.8, 1.5), min_lesion_voxels=3)
CANDIDATES = [(2, 2, 2), (3, 3, 2), (4, 4, 3), (4, 4, 4)]


def r6(c):
    return F.round(c, 6)


def voi_table(spark: SparkSession, sf: str) -> DataFrame:
    """VOI records: every ninth has no image, every thirteenth an image of another shape."""
    vol = table(spark, sf, "volumes")
    v = F.col("voi_id")
    path = F.format_string("A/case_%05d/ART/%05d.npy", F.expr("voi_id div 2"), v)
    return vol.select(
        "voi_id",
        "nx",
        "ny",
        "nz",
        "spacing",
        F.format_string("case_%05d", F.expr("voi_id div 2")).alias("case_id"),
        F.when(v % 2 == 0, "L").otherwise("R").alias("laterality"),
        path.alias("mask_path"),
        F.when(v % 9 != 0, path).alias("image_path"),
        F.when(v % 13 == 0, F.array(F.lit(4), F.lit(4), F.lit(5))).otherwise(F.array("nx", "ny", "nz")).alias("image_shape"),
    )


def components(spark, sf) -> les.Components:
    return les.lesion_components(table(spark, sf, "voxels"))


def catalog_rows(spark, sf) -> DataFrame:
    return les.lesion_catalog(table(spark, sf, "voxels"), voi_table(spark, sf), components(spark, sf), OPTIONS)


def small_catalog(spark, sf) -> DataFrame:
    """Geometry of the kept lesions only, for the profile queries."""
    parts = components(spark, sf)
    return les.lesion_geometry(parts.table.where("volume_vox >= 3"), OPTIONS.target_spacing)


# ---- check text ------------------------------------------------------------------------------------------


def _cc_sql(name: str, where: str, conn: int, order: str = "(x * 4 + y) * 4 + z", extra: str = "") -> str:
    """Components by a reachability search; fine for volumes of 64 voxels."""
    near = (
        "abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and abs(a.z - b.z) <= 1"
        if conn == 26
        else "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"
    )
    same = f" and a.{extra} = b.{extra}" if extra else ""
    more = f", {extra}" if extra else ""
    return f"""
{name}_v as (select voi_id, x, y, z{more}, {order} as p from voxels where {where}),
{name}_e as (select a.voi_id, a.p as u, b.p as v from {name}_v a join {name}_v b on a.voi_id = b.voi_id and {near}{same}),
{name}_r as (select voi_id, p as u, p as v from {name}_v union select r.voi_id, r.u, e.v from {name}_r r join {name}_e e on e.voi_id = r.voi_id and e.u = r.v),
{name}_m as (select voi_id, u as p, min(v) as first_p from {name}_r group by 1, 2),
{name} as (select v.*, dense_rank() over (partition by v.voi_id{', v.' + extra if extra else ''} order by m.first_p) as component from {name}_v v join {name}_m m on m.voi_id = v.voi_id and m.p = v.p)"""


_LESIONS = (
    _cc_sql("les", "label = 2", 26)
    + """,
les_g as (select voi_id, component, count(*) as volume_vox, sum(x)/count(*) as cx, sum(y)/count(*) as cy, sum(z)/count(*) as cz,
  min(x) as x0, min(y) as y0, min(z) as z0, max(x) + 1 as x1, max(y) + 1 as y1, max(z) + 1 as z1 from les group by 1, 2),
kept as (select *, row_number() over (partition by voi_id order by component) - 1 as lesion_id,
  count(*) over (partition by voi_id) as n_kept,
  volume_vox * (0.8::double * 0.8::double * 1.5::double) as volume_mm3,
  x1 - x0 as dx, y1 - y0 as dy, z1 - z0 as dz, (x1 - x0) * 0.8::double as mx, (y1 - y0) * 0.8::double as my, (z1 - z0) * 1.5::double as mz
  from les_g where volume_vox >= 3)"""
)


def _with_vox(body: str, *more: str) -> str:
    return with_tables(body, "voxels", *more)


# ---- labels, intensities, statistics ---------------------------------------------------------------------


@query(
    "F27 F28",
    _with_vox("""select voi_id, x, y, z, round(2 * (least(greatest(hu, -200), 300) + 200) / 500 - 1, 6) as scaled,
  round(least(greatest(((2 * (least(greatest(hu, -200), 300) + 200) / 500 - 1 + 1) / 2 * 500 - 200 + 200) / 500, 0), 1), 6) as display,
  round((least(greatest(hu, -150), 250) + 150) / 400, 6) as hu_display from voxels"""),
)
def window_voxels(spark, sf):
    scaled = geometry.window_rescale(F.col("hu"))
    return table(spark, sf, "voxels").select(
        "voi_id",
        "x",
        "y",
        "z",
        r6(scaled).alias("scaled"),
        r6(geometry.window_to_display(scaled)).alias("display"),
        r6(geometry.hu_to_display(F.col("hu"))).alias("hu_display"),
    )


@query(
    "V1 V10 V12",
    _with_vox("""select voi_id, z as x, y, x as z, label in (1, 2, 3) as in_bbox, label = 2 as in_mask,
  case when label = 2 then round(hu, 6) else -1000.0 end as hu from voxels"""),
)
def label_masks(spark, sf):
    flagged = vx.label_masks(table(spark, sf, "voxels"))
    out = vx.transpose_axes(vx.apply_mask(flagged, F.col("in_mask")))
    return out.select("voi_id", "x", "y", "z", "in_bbox", "in_mask", r6("hu").alias("hu"))


@query("V16", _with_vox("select voi_id, 3 - x as x, y, z, label from voxels"))
def flip_axis(spark, sf):
    out = vx.flip_axis(table(spark, sf, "voxels"), table(spark, sf, "volumes"))
    return out.select("voi_id", "x", "y", "z", "label")


def _oriented(spark, sf):
    """Volumes with one of four axis-aligned directions."""
    kinds = [
        [1, 0, 0, 0, 1, 0, 0, 0, 1],
        [-1, 0, 0, 0, -1, 0, 0, 0, 1],
        [0, 0, 1, 1, 0, 0, 0, -1, 0],
        [0, 1, 0, 1, 0, 0, 0, 0, -1],
    ]
    d = F.array(*[F.array(*[F.lit(float(v)) for v in k]) for k in kinds])
    return table(spark, sf, "volumes").withColumn("direction", d[(F.col("voi_id") % 4).cast("int")])


@query(
    "V11",
    _with_vox("""select voi_id, case voi_id % 4 when 0 then 3 - x when 1 then x when 2 then 3 - z else 3 - y end as x,
  case voi_id % 4 when 0 then 3 - y when 1 then y when 2 then 3 - x else 3 - x end as y,
  case voi_id % 4 when 0 then z when 1 then z when 2 then 3 - y else 3 - z end as z, label from voxels"""),
)
def reorient_ras(spark, sf):
    out, _ = vx.reorient_ras(table(spark, sf, "voxels"), _oriented(spark, sf))
    return out.select("voi_id", "x", "y", "z", "label")


@query(
    "A8",
    _with_vox("""select v.voi_id, s.n is not null as has_tumor, coalesce(s.n, 0) as tumor_voxels,
  round(s.n * (0.8::double * 0.8::double * (1 + v.voi_id % 4)), 6) as mm3, round(m, 6) as mean_hu, round(sd, 6) as std_hu, round(lo, 6) as min_hu, round(hi, 6) as max_hu
from (select distinct voi_id from voxels) v left join (select voi_id, count(*) as n, avg(hu) as m, stddev_pop(hu) as sd, min(hu) as lo, max(hu) as hi
  from voxels where label = 2 group by 1) s on s.voi_id = v.voi_id"""),
)
def tumor_metrics(spark, sf):
    out = vx.tumor_metrics(table(spark, sf, "voxels"), table(spark, sf, "volumes"))
    return out.select(
        "voi_id", "has_tumor", "tumor_voxels", r6("tumor_volume_mm3").alias("mm3"),
        *[r6(c).alias(c) for c in ("mean_hu", "std_hu", "min_hu", "max_hu")],
    )


_STATS = """count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max,
  round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.005), 6) as p0_5, round(quantile_cont(v, 0.05), 6) as p5,
  round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.75), 6) as p75, round(quantile_cont(v, 0.95), 6) as p95,
  round(quantile_cont(v, 0.995), 6) as p99_5, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) as iqr"""


_STAT_NAMES = ["mean", "std", "min", "max", "median", "p0_5", "p5", "p25", "p75", "p95", "p99_5", "iqr"]


def _prefixed(name: str, source: str) -> str:
    return ", ".join(f"{source}.{c} as {name}_{c}" for c in _STAT_NAMES)


@query(
    "A9",
    _with_vox(f"""with k as (select 'raw' as kind, hu as v from voxels where label in (1, 2)
  union all select 'windowed', least(greatest(hu, -200), 300) from voxels where label in (1, 2))
select kind, {_STATS} from k group by 1"""),
)
def intensity_stats(spark, sf):
    out = vx.intensity_stats(table(spark, sf, "voxels"))
    return out.select("kind", "n", *[r6(c).alias(c) for c in out.columns if c not in ("kind", "n")])


@query(
    "A10",
    with_tables(
        " union all ".join(
            f"select '{a}' as axis, min(n{a}) as min, max(n{a}) as max, round(avg(n{a}), 6) as mean, median(n{a}) as median from image_headers"
            for a in "xyz"
        ),
        "image_headers",
    ),
)
def shape_stats(spark, sf):
    out = vx.shape_stats(table(spark, sf, "image_headers"))
    return out.withColumn("mean", r6("mean"))


@query(
    "V18",
    _with_vox("""select v.voi_id, coalesce(s.x, 2) as x, coalesce(s.y, 2) as y, coalesce(s.z, 2) as z from (select distinct voi_id from voxels) v
left join (select voi_id, trunc(avg(x))::int as x, trunc(avg(y))::int as y, trunc(avg(z))::int as z from voxels where label = 2 group by 1) s on s.voi_id = v.voi_id"""),
)
def focus_voxel(spark, sf):
    return vx.focus_voxel(table(spark, sf, "voxels"), table(spark, sf, "volumes"))


@query(
    "V4",
    _with_vox("""select voi_id, bv, sv, case when bv = 0 then 'Empty bbox_mask (no tissue)' when bv < 45 then concat('Insufficient tissue (', bv, ' < 45 voxels)')
  when sv = 0 then 'Empty save_mask (no target labels)' when sv < 10 then concat('Insufficient target labels (', sv, ' < 10 voxels)') else 'OK' end as reason
from (select voi_id, count(*) filter (where label in (1, 2, 3)) as bv, count(*) filter (where label = 2) as sv from voxels group by 1)"""),
)
def validate_voi(spark, sf):
    out = vx.validate_voi(table(spark, sf, "voxels"), table(spark, sf, "volumes"), 45, 10)
    return out.select("voi_id", "bv", "sv", "reason")


@query(
    "V4",
    _with_vox("""select voi_id, case when max(label) > 2 then 'Mask contains invalid values' else 'OK' end as reason, max(label) <= 2 as valid
from voxels group by 1"""),
)
def mask_integrity(spark, sf):
    label = F.col("label")
    masks = table(spark, sf, "voxels").withColumn("value", F.when(label == 3, 3).otherwise((label == 2).cast("int")))
    return vx.mask_integrity(masks, table(spark, sf, "volumes"))


@query(
    "V5",
    _with_vox("""select voi_id, concat_ws(',', case when count(*) filter (where label = 2 and (x < 1 or x >= 3 or y < 1 or y >= 3 or z < 1 or z >= 3)) > 0 then 'boundary_contact' end,
  case when count(*) filter (where label = 2) < 12 then 'small_tumor' end, case when 4 < 5 then 'below_min_voi' end,
  case when count(*) filter (where hu between -100 and 100) / count(*) < 0.7 then 'anomalous_hu' end) as flags from voxels group by 1"""),
)
def sanity_flags(spark, sf):
    out = vx.sanity_flags(
        table(spark, sf, "voxels"), table(spark, sf, "volumes"), 1, 12, (5, 4, 4), (-100.0, 100.0), 0.7
    )
    return out.select("voi_id", F.array_join("flags", ",").alias("flags"))


# ---- boxes, grids, neighbourhoods ------------------------------------------------------------------------


@query(
    "V3 W10",
    _with_vox(
        "with recursive "
        + _cc_sql("kid", "label in (1, 2, 3)", 6, "(z * 4 + y) * 4 + x")
        + """,
parts as (select voi_id, component, count(*) as n, avg(x) * 0.8 as cx, min(x) as x0, min(y) as y0, min(z) as z0, max(x) - min(x) + 1 as sx,
  max(y) - min(y) + 1 as sy, max(z) - min(z) + 1 as sz from kid group by 1, 2),
ranked as (select *, row_number() over (partition by voi_id order by n desc, component) as rn, least(2, count(*) over (partition by voi_id)) as k from parts),
top as (select *, row_number() over (partition by voi_id order by cx, rn) as xr from ranked where rn <= 2)
select voi_id, case when k = 1 then case when cx < 4 * 0.8 / 2 then 'L' else 'R' end when xr = 1 then 'L' else 'R' end as side,
  x0 as start_x, y0 as start_y, z0 as start_z, sx as size_x, sy as size_y, sz as size_z, z0 + sz // 2 as center_slice, n as voxel_count from top"""
    ),
)
def separate_kidneys(spark, sf):
    return vx.separate_kidneys(table(spark, sf, "voxels"), table(spark, sf, "volumes"))


def _boxes(spark, sf):
    """Boxes inside header-sized volumes, one per image header."""
    heads = image_meta(table(spark, sf, "image_headers"))
    o = F.col("ord")
    return heads.select(
        F.col("ord").alias("voi_id"),
        "spacing",
        *[F.col("dims")[i].alias(f"n{a}") for i, a in enumerate("xyz")],
        *[(o * 7 % (F.col("dims")[i] - 10)).cast("int").alias(f"start_{a}") for i, a in enumerate("xyz")],
        *[(o % 9 + 1).cast("int").alias(f"size_{a}") for a in "xyz"],
    )


_CROP = ",\n".join(
    f"""greatest(0, start_{a} - ceil(5.0 / s{a})::int) as crop_{a},
  greatest(1, least(n{a}, start_{a} + size_{a} + ceil(5.0 / s{a})::int) - greatest(0, start_{a} - ceil(5.0 / s{a})::int)) as crop_size_{a}"""
    for a in "xyz"
)
_BOXES = f"""boxes as (select ord as voi_id, nx, ny, nz, sx, sy, sz, {', '.join(f'ord * 7 % (n{a} - 10) as start_{a}, ord % 9 + 1 as size_{a}' for a in 'xyz')} from image_headers),
crops as (select voi_id, nx, ny, nz, sx, sy, sz, {_CROP} from boxes)"""


@query(
    "V6",
    with_tables(
        f"with {_BOXES} select voi_id, crop_x, crop_y, crop_z, crop_size_x, crop_size_y, crop_size_z from crops", "image_headers"
    ),
)
def crop_window(spark, sf):
    out = vx.crop_window(_boxes(spark, sf), 5.0)
    return out.select("voi_id", *[f"crop_{a}" for a in "xyz"], *[f"crop_size_{a}" for a in "xyz"])


_GROW = """
g0_{a} as (select *, least(least(d_{a} // 2, crop_{a}) + greatest(d_{a} - least(d_{a} // 2, crop_{a}) - (n{a} - crop_{a} - crop_size_{a}), 0), crop_{a}) as low_{a},
  least(d_{a} - least(d_{a} // 2, crop_{a}), n{a} - crop_{a} - crop_size_{a}) as high_{a} from {prev})"""


@query(
    "V7",
    with_tables(
        f"""with {_BOXES},
want as (select *, greatest(trunc(96 * 1.0 / sx)::int - crop_size_x, 0) as d_x, greatest(trunc(96 * 1.0 / sy)::int - crop_size_y, 0) as d_y,
  greatest(trunc(64 * 1.0 / sz)::int - crop_size_z, 0) as d_z from crops),
{_GROW.format(a='x', prev='want')}, {_GROW.format(a='y', prev='g0_x')}, {_GROW.format(a='z', prev='g0_y')}
select voi_id, {', '.join(f'crop_{a} - low_{a} as crop_{a}, crop_size_{a} + low_{a} + high_{a} as crop_size_{a}' for a in 'xyz')} from g0_z""",
        "image_headers",
    ),
)
def enforce_min_size(spark, sf):
    crops = vx.crop_window(_boxes(spark, sf), 5.0)
    least = {a: vx.min_size_in_source(m, 1.0, F.col("spacing")[i]) for i, (a, m) in enumerate(zip("xyz", (96, 96, 64)))}
    out = vx.enforce_min_size(crops, least)
    return out.select("voi_id", *[f"crop_{a}" for a in "xyz"], *[f"crop_size_{a}" for a in "xyz"])


@query(
    "V8",
    with_tables(
        """select ord, ceil(nx * (sx / 1.0))::int as mx, ceil(ny * (sy / 1.0))::int as my, ceil(nz * (sz / 1.0))::int as mz,
  round(greatest(sx, sy, sz) / least(sx, sy, sz), 6) as aniso_ratio,
  case when greatest(sx, sy, sz) / least(sx, sy, sz) > 2 then 'two_step_bspline' else 'one_shot_bspline' end as method from image_headers""",
        "image_headers",
    ),
)
def resample_grid(spark, sf):
    vol = table(spark, sf, "image_headers").withColumn("spacing", F.array("sx", "sy", "sz"))
    out = vx.resample_grid(vol, (1.0, 1.0, 1.0))
    return out.select("ord", "mx", "my", "mz", r6("aniso_ratio").alias("aniso_ratio"), "method")


_GRID = """
vol as (select voi_id, 1.0::double + voi_id % 4 as s from volumes),
grid as (select voi_id, s, i.i, j.j, k.k from vol, unnest(range(0, 6)) i(i), unnest(range(0, 6)) j(j), unnest(range(0, 64)) k(k)
  where i.i < ceil(4 * (0.8::double / 0.7)) and j.j < ceil(4 * (0.8::double / 0.7)) and k.k < ceil(4 * (s / 0.9))),
pos as (select *, i * (0.7 / 0.8::double) as px, j * (0.7 / 0.8::double) as py, k * (0.9 / s) as pz from grid),
loc as (select *, px >= 3.5 or py >= 3.5 or pz >= 3.5 as outside from pos)"""


@query(
    "V9",
    _with_vox(
        f"""with {_GRID}
select g.voi_id, i as x, j as y, k as z, case when outside then -1000 else round(v.hu, 6) end as hu from loc g join voxels v on v.voi_id = g.voi_id
  and v.x = least(floor(px + 0.5), 3) and v.y = least(floor(py + 0.5), 3) and v.z = least(floor(pz + 0.5), 3)""",
        "volumes",
    ),
)
def resample_nearest(spark, sf):
    out = vx.resample_voxels(table(spark, sf, "voxels"), table(spark, sf, "volumes"), (0.7, 0.7, 0.9))
    return out.withColumn("hu", r6("hu"))


@query(
    "V9",
    _with_vox(
        f"""with {_GRID},
cl as (select *, least(px, 3) as cx, least(py, 3) as cy, least(pz, 3) as cz from loc)
select g.voi_id, i as x, j as y, k as z, case when bool_or(outside) then -1000
  else round(sum(v.hu * (1 - abs(cx - v.x)) * (1 - abs(cy - v.y)) * (1 - abs(cz - v.z))), 6) end as hu
from cl g join voxels v on v.voi_id = g.voi_id and abs(cx - v.x) < 1 and abs(cy - v.y) < 1 and abs(cz - v.z) < 1 group by 1, 2, 3, 4""",
        "volumes",
    ),
)
def resample_linear(spark, sf):
    out = vx.resample_voxels(table(spark, sf, "voxels"), table(spark, sf, "volumes"), (0.7, 0.7, 0.9), method="linear")
    return out.withColumn("hu", r6("hu"))


@query(
    "V15",
    _with_vox("""with full_grid as (select voi_id, i.i as x, j.j as y, k.k as z from (select distinct voi_id from voxels) v, unnest(range(0, 5)) i(i), unnest(range(0, 4)) j(j), unnest(range(0, 7)) k(k))
select g.voi_id, g.x, g.y, g.z, round(coalesce(v.hu, -200), 6) as hu from full_grid g left join voxels v
  on v.voi_id = g.voi_id and v.x = g.x - 1 and v.y = g.y and v.z = g.z - 2"""),
)
def pad_to_min(spark, sf):
    out = vx.pad_to_min(table(spark, sf, "volumes"), table(spark, sf, "voxels"), (5, 3, 7))
    return out.withColumn("hu", r6("hu"))


@query(
    "V14",
    _with_vox("""select a.voi_id, a.x, a.y, a.z from voxels a join voxels b on a.voi_id = b.voi_id and a.z = b.z
  and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and b.label = 2 where a.label = 2 group by 1, 2, 3, 4 having count(*) < 9"""),
)
def tumor_boundary(spark, sf):
    return vx.tumor_boundary(table(spark, sf, "voxels"))


@query(
    "P3",
    _with_vox("""select 'centred' as mode, voi_id, z, count(*) as n from voxels where z in (1, 2) group by 2, 3
union all select 'spread', voi_id, z, count(*) from voxels where z in (0, 2, 3) group by 2, 3"""),
)
def select_slices(spark, sf):
    v, vol = table(spark, sf, "voxels"), table(spark, sf, "volumes")
    centred = vx.select_slices(v, vol, 2).select(F.lit("centred").alias("mode"), "voi_id", "z")
    spread = vx.select_slices(v, vol, 3, centred=False).select(F.lit("spread"), "voi_id", "z")
    return centred.union(spread).groupBy("mode", "voi_id", "z").agg(F.count("*").alias("n"))


@query(
    "J12",
    _with_vox("""select voi_id, x - voi_id % 2 as x, y - voi_id % 3 as y, z as z, label from voxels
where x >= voi_id % 2 and x < voi_id % 2 + 2 and y >= voi_id % 3 and y < voi_id % 3 + 2 and z < 3"""),
)
def crop_voxels(spark, sf):
    v = F.col("voi_id")
    boxes = table(spark, sf, "volumes").select(
        "voi_id", (v % 2).alias("crop_x"), (v % 3).alias("crop_y"), F.lit(0).alias("crop_z"),
        F.lit(2).alias("crop_size_x"), F.lit(2).alias("crop_size_y"), F.lit(3).alias("crop_size_z"),
    )
    out = vx.crop_voxels(table(spark, sf, "voxels"), boxes)
    return out.select("voi_id", *[F.col(f"{a}_local").alias(a) for a in "xyz"], "label")


# ---- components and lesions ------------------------------------------------------------------------------


@query("V2", _with_vox("with recursive " + _cc_sql("les", "label = 2", 26) + "\nselect voi_id, x, y, z, component from les"))
def connected_components_26(spark, sf):
    return cc.connected_components(table(spark, sf, "voxels").where("label = 2"))


@query(
    "V2",
    _with_vox(
        "with recursive " + _cc_sql("kid", "label in (1, 2)", 6, "(z * 4 + y) * 4 + x") + "\nselect voi_id, x, y, z, component from kid"
    ),
)
def connected_components_6(spark, sf):
    return cc.connected_components(table(spark, sf, "voxels").where("label in (1, 2)"), conn=6, order=("z", "y", "x"))


@query(
    "A12",
    _with_vox(
        "with recursive "
        + _LESIONS
        + """
select voi_id, lesion_id, volume_vox, round(volume_mm3, 6) as volume_mm3, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz,
  x0, y0, z0, dx, dy, dz, round(greatest(mx, my, mz), 6) as max_extent_mm, greatest(dx, dy, dz) as max_extent_vox from kept"""
    ),
)
def lesion_geometry(spark, sf):
    kept = components(spark, sf).table.where("volume_vox >= 3")
    ids = les.numbered(kept, ["voi_id"], [F.col("component")], "lesion_id", start=0)
    out = les.lesion_geometry(ids, OPTIONS.target_spacing).join(
        ids.select("voi_id", "component", "lesion_id"), ["voi_id", "component"]
    )
    return out.select(
        "voi_id", "lesion_id", "volume_vox", r6("volume_mm3").alias("volume_mm3"),
        *[r6(F.col("centroid_vox")[i]).alias(f"c{a}") for i, a in enumerate("xyz")],
        *[F.col("bbox_min_vox")[i].alias(f"{a}0") for i, a in enumerate("xyz")],
        *[F.col("bbox_size_vox")[i].alias(f"d{a}") for i, a in enumerate("xyz")],
        r6("max_extent_mm").alias("max_extent_mm"), "max_extent_vox",
    )


_SHELL = """
shell as (select distinct k.voi_id, k.lesion_id, s.x, s.y, s.z, s.label from kept k join les l on l.voi_id = k.voi_id and l.component = k.component
  join voxels s on s.voi_id = l.voi_id and abs(s.x - l.x) <= 1 and abs(s.y - l.y) <= 1 and abs(s.z - l.z) <= 1
  where not exists (select 1 from les o where o.voi_id = s.voi_id and o.x = s.x and o.y = s.y and o.z = s.z and o.component = k.component)),
touch as (select voi_id, lesion_id, count(*) filter (where label = 1) as contact, count(*) filter (where label = 1) / count(*) as ratio from shell group by 1, 2)"""


@query(
    "V13",
    _with_vox(
        "with recursive " + _LESIONS + "," + _SHELL + "\nselect voi_id, lesion_id, contact, round(ratio, 6) as ratio from touch"
    ),
)
def contact_ratio(spark, sf):
    parts = components(spark, sf)
    kept = parts.table.where("volume_vox >= 3")
    ids = les.numbered(kept, ["voi_id"], [F.col("component")], "lesion", start=0).select("voi_id", "root", "lesion")
    runs = parts.runs.join(ids, ["voi_id", "root"])
    out = vx.contact_ratio(runs, table(spark, sf, "voxels"), table(spark, sf, "volumes"))
    return out.select(
        "voi_id", F.col("lesion").alias("lesion_id"), F.col("kidney_contact_vox").alias("contact"),
        r6("kidney_contact_ratio").alias("ratio"),
    )


_WARN = """
skips as (select voi_id, count(*) filter (where volume_vox < 3) as n_skipped, count(*) filter (where volume_vox >= 3) as n_kept from les_g group by 1),
bb as (select voi_id, count(*) filter (where label in (1, 2)) as bv from voxels group by 1),
warned as (select b.voi_id, bv, s.voi_id is not null as has_tumor, coalesce(n_kept, 0) as n_kept, coalesce(n_skipped, 0) as n_skipped,
  b.voi_id % 9 = 0 or b.voi_id % 13 = 0 as unusable,
  concat_ws('|', case when b.voi_id % 9 = 0 then 'Image file missing; skipped intensity extraction.' end,
    case when b.voi_id % 13 = 0 and b.voi_id % 9 <> 0 then 'Image/mask shape mismatch: image (4, 4, 5) vs mask (4, 4, 4); skipped intensity extraction.' end,
    case when n_skipped > 0 then concat('Skipped ', n_skipped, ' connected component(s) smaller than min_lesion_voxels=3.') end,
    case when n_kept = 0 then 'Tumor voxels were present, but all connected components were below min_lesion_voxels.' end) as warnings
  from bb b left join skips s on s.voi_id = b.voi_id)"""


@query(
    "V17 P5",
    _with_vox(
        "with recursive " + _LESIONS + "," + _WARN
        + """
select voi_id, bv as bbox_voxel_count, case when unusable then 0 else bv end as filtered_bbox_voxel_count, has_tumor, n_kept, n_skipped, warnings from warned"""
    ),
)
def analyze_vois(spark, sf):
    out = les.analyze_vois(table(spark, sf, "voxels"), voi_table(spark, sf), components(spark, sf), OPTIONS)
    return out.withColumn("warnings", F.array_join("warnings", "|"))


@query(
    "V17 A12 V13 W9",
    _with_vox(
        "with recursive " + _LESIONS + "," + _SHELL + "," + _WARN
        + """
select printf('case_%05d', k.voi_id // 2) as case_id, k.voi_id, case when k.voi_id % 2 = 0 then 'L' else 'R' end as laterality, k.lesion_id, k.n_kept as num_lesions_in_voi,
  volume_vox, round(volume_mm3, 6) as volume_mm3, round(cx, 6) as cx, round(cz * 1.5, 6) as cz_mm, greatest(dx, dy, dz) as max_extent_vox,
  coalesce(t.contact, 0) as kidney_contact_vox, round(coalesce(t.ratio, 0), 6) as kidney_contact_ratio,
  list_aggregate(list_sort(string_split(w.warnings, '|')), 'string_agg', '|') as warnings
from kept k left join touch t on t.voi_id = k.voi_id and t.lesion_id = k.lesion_id join warned w on w.voi_id = k.voi_id"""
    ),
)
def lesion_catalog(spark, sf):
    out = catalog_rows(spark, sf)
    return out.select(
        "case_id", "voi_id", "laterality", "lesion_id", "num_lesions_in_voi", "volume_vox", r6("volume_mm3").alias("volume_mm3"),
        r6(F.col("centroid_vox")[0]).alias("cx"), r6(F.col("centroid_mm")[2]).alias("cz_mm"), "max_extent_vox",
        "kidney_contact_vox", r6("kidney_contact_ratio").alias("kidney_contact_ratio"), F.array_join("warnings", "|").alias("warnings"),
    )


_BINS = """
cuts as (select quantile_cont(volume_mm3, 0.25) as c1, quantile_cont(volume_mm3, 0.5) as c2, quantile_cont(volume_mm3, 0.75) as c3 from kept),
cutlist as (select list_sort(list_distinct([c1, c2, c3])) as c from cuts),
binned as (select k.*, ['tiny', 'small', 'medium', 'large'][len(list_filter(c, lambda v: v < volume_mm3)) + 1] as size_bin from kept k, cutlist)"""


@query("A13", _with_vox("with recursive " + _LESIONS + "," + _BINS + "\nselect voi_id, component, size_bin from binned"))
def size_bins(spark, sf):
    out = les.assign_size_bins(small_catalog(spark, sf), OPTIONS.size_bin_percentiles)
    return out.select("voi_id", "component", "size_bin")


@query(
    "A13",
    _with_vox(
        "with recursive " + _LESIONS
        + """, cuts as (select list_sort(list_distinct(quantile_cont(volume_vox, [0, 0.2, 0.5, 0.8, 0.95, 1.0]))) as c from kept),
names as (select c, len(c) + 1 as n from cuts)
select i.i - 1 as bin_no, case when n <= 5 then ['tiny', 'small', 'medium', 'large', 'huge'][i.i] else concat('bin_', i.i - 1) end as name, 'volume_vox' as metric,
  round(case when i.i > 1 then c[i.i - 1] end, 6) as min_inclusive, round(c[i.i], 6) as max_inclusive from names, unnest(range(1, n + 1)) i(i)"""
    ),
)
def size_bin_table(spark, sf):
    rows = small_catalog(spark, sf).withColumn("volume_mm3", F.lit(None).cast("double"))
    return les.size_bin_table(rows, les.PLANNER_OPTIONS.size_bin_percentiles)


_PROFILE = """
prof as (select size_bin, count(*) as n, count(*) / sum(count(*)) over () as empirical, 0.5 * (count(*) / sum(count(*)) over ()) + 0.5 * (1.0 / count(*) over ()) as target,
  case size_bin when 'tiny' then 2 when 'small' then 2 when 'medium' then 3 when 'large' then 4 when 'huge' then 5 else 3 end as patch_budget,
  case size_bin when 'tiny' then 0.85 when 'small' then 0.65 when 'medium' then 0.5 when 'large' then 0.4 when 'huge' then 0.3 else 0.5 end as prior_center,
  case size_bin when 'tiny' then 0.10 when 'small' then 0.25 when 'medium' then 0.3 when 'large' then 0.35 when 'huge' then 0.4 else 0.3 end as prior_border,
  case size_bin when 'tiny' then 0.05 when 'small' then 0.10 when 'medium' then 0.2 when 'large' then 0.25 when 'huge' then 0.3 else 0.2 end as prior_context
  from binned group by 1)"""


@query(
    "A14 A15",
    _with_vox(
        "with recursive " + _LESIONS + "," + _BINS + "," + _PROFILE
        + "\nselect size_bin, n, round(empirical, 6) as empirical, round(target, 6) as target, patch_budget, prior_center, prior_border, prior_context from prof"
    ),
)
def bin_profile(spark, sf):
    binned = les.assign_size_bins(small_catalog(spark, sf), OPTIONS.size_bin_percentiles)
    return les.bin_profile(binned).withColumns({"empirical": r6("empirical"), "target": r6("target")})


def _profile_sql():
    rows = []
    for measure, metric, expr in (
        ("volume", "volume_mm3", "volume_mm3"),
        ("extent", "max_extent_mm", "greatest(mx, my, mz)"),
        ("bbox_x", "bbox_size_mm", "mx"),
        ("bbox_y", "bbox_size_mm", "my"),
        ("bbox_z", "bbox_size_mm", "mz"),
    ):
        for p in (25, 50, 75, 90) if measure.startswith("bbox") else (5, 10, 25, 50, 75, 90, 95):
            rows.append(
                f"select '{measure}' as measure, '{metric}' as metric, 'p{p}' as percentile, round(quantile_cont({expr}, {p / 100}), 6) as value from kept"
            )
    return " union all ".join(rows)


@query("A15", _with_vox("with recursive " + _LESIONS + "\n" + _profile_sql()))
def sampling_profile(spark, sf):
    return les.sampling_profile(small_catalog(spark, sf)).withColumn("value", r6("value"))


@query(
    "A16",
    _with_vox(
        "with recursive " + _LESIONS + "," + _BINS
        + "\n"
        + " union all ".join(
            f"""select size_bin, 'mm' as units, '{a}' as axis, round(quantile_cont(m{a}, 0.75), 6) as extent_p75, round(quantile_cont(m{a}, 0.9), 6) as extent_p90,
  round(quantile_cont(m{a}, 0.75) + 24, 6) as min_patch, round(quantile_cont(m{a}, 0.9) + 24, 6) as context_patch from binned group by 1"""
            for a in "xyz"
        )
    ),
)
def patch_recommendations(spark, sf):
    binned = les.assign_size_bins(small_catalog(spark, sf), OPTIONS.size_bin_percentiles)
    out = les.patch_recommendations(binned)
    return out.select("size_bin", "units", "axis", *[r6(c).alias(c) for c in ("extent_p75", "extent_p90", "min_patch", "context_patch")])


@query(
    "A17",
    _with_vox(
        "with recursive " + _LESIONS + "\n"
        + " union all ".join(
            f"select '{a}x{b}x{c}' as candidate, round(avg((dx <= {a} and dy <= {b} and dz <= {c})::int), 6) as coverage, count(*) as num_lesions from kept"
            for a, b, c in CANDIDATES
        )
    ),
)
def patch_coverage(spark, sf):
    return les.patch_coverage(small_catalog(spark, sf), CANDIDATES).withColumn("coverage", r6("coverage"))


@query(
    "A11",
    _with_vox(
        "with recursive " + _LESIONS + "," + _WARN + f""",
k as (select 'raw' as kind, hu as v from voxels join warned using (voi_id) where label in (1, 2) and not unusable
  union all select 'windowed', least(greatest(hu, -200), 300) from voxels join warned using (voi_id) where label in (1, 2) and not unusable),
st as (select kind, {_STATS} from k group by 1)
select 3 as version, {_prefixed("raw", "r")}, {_prefixed("win", "w")},
  {", ".join(f"4.0 as shape_{a}_{s}" for a in "xyz" for s in ("min", "max", "mean", "median"))},
  'window_rescale' as method, -200.0 as window_min, 300.0 as window_max, -1.0 as output_min, 1.0 as output_max,
  (select sum(bv) from warned) as total_bbox_voxels, (select sum(case when unusable then 0 else bv end) from warned) as filtered_bbox_voxels,
  (select count(*) from warned) as num_vois, (select count(*) from warned where has_tumor) as num_vois_with_tumor, (select count(*) from kept) as num_lesions
from st r, st w where r.kind = 'raw' and w.kind = 'windowed'"""
    ),
)
def dataset_fingerprint(spark, sf):
    v, vois, parts = table(spark, sf, "voxels"), voi_table(spark, sf), components(spark, sf)
    analysis = les.analyze_vois(v, vois, parts, OPTIONS)
    kept = parts.table.where("volume_vox >= 3")
    out = les.dataset_fingerprint(v, vois, analysis, kept, OPTIONS)
    raw, win = "foreground_intensity", "windowed_intensity"
    shape = {a: F.col("voi_shape_statistics")[i] for i, a in enumerate("xyz")}  # sorted by axis
    return out.select(
        "version",
        *[r6(f"{kind}.{c}").alias(f"{name}_{c}") for kind, name in ((raw, "raw"), (win, "win")) for c in _STAT_NAMES],
        *[shape[a][s].cast("double").alias(f"shape_{a}_{s}") for a in "xyz" for s in ("min", "max", "mean", "median")],
        "normalization.*",
        "total_bbox_voxels", "filtered_bbox_voxels", "num_vois", "num_vois_with_tumor", "num_lesions",
    )
