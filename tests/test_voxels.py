import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import components as cc
from cohortspark.operators import radiomics as rad
from cohortspark.operators import voxels as vx


def cube(spark, shape, seed=1, voi=1):
    rng = np.random.default_rng(seed)
    hu = rng.normal(size=shape) * 100
    label = rng.integers(0, 4, size=shape)
    rows = [(voi, *map(int, c), float(hu[c]), int(label[c])) for c in itertools.product(*map(range, shape))]
    voxels = spark.createDataFrame(rows, "voi_id bigint, x int, y int, z int, hu double, label int")
    return voxels, hu, label


def volume(spark, shape, spacing=(1.0, 1.0, 1.0), voi=1):
    d = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    return spark.createDataFrame(
        [(voi, *shape, list(spacing), [0.0, 0.0, 0.0], d)],
        "voi_id bigint, nx int, ny int, nz int, spacing array<double>, origin array<double>, direction array<double>",
    )


def as_array(df, shape, column):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert math.isnan(out[r.x, r.y, r.z])  # each place once
        out[r.x, r.y, r.z] = r[column]
    return out


@pytest.mark.parametrize("spacing, target", [((0.8, 1.0, 3.3), (1.0, 1.0, 1.0)), ((2.0, 0.5, 1.0), (0.7, 0.9, 1.6))])
@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_resample(spark, spacing, target, method):
    shape = (4, 5, 3)
    voxels, hu, _ = cube(spark, shape)
    size = [math.ceil(n * (s / t)) for n, s, t in zip(shape, spacing, target)]
    want = np.empty(size)
    for out in itertools.product(*map(range, size)):
        at = [i * (t / s) for i, s, t in zip(out, spacing, target)]
        if any(a >= n - 0.5 for a, n in zip(at, shape)):
            want[out] = -1000
        elif method == "nearest":
            want[out] = hu[tuple(min(math.floor(a + 0.5), n - 1) for a, n in zip(at, shape))]
        else:
            at = [min(a, n - 1) for a, n in zip(at, shape)]
            total = 0.0
            for corner in itertools.product(*[(math.floor(a), math.floor(a) + 1) for a in at]):
                w = math.prod(1 - abs(a - c) for a, c in zip(at, corner))
                if w > 0:
                    total += w * hu[corner]
            want[out] = total
    got = vx.resample_voxels(voxels, volume(spark, shape, spacing), target, method=method)
    np.testing.assert_allclose(as_array(got, size, "hu"), want, atol=1e-9)


def grow(start, size, total, least):
    """Plain rule for one axis: half below, rest above, what does not fit goes to the other side, then clip."""
    short = least - size
    if short <= 0:
        return start, size
    below = short // 2
    above = short - below
    if below > start:
        above, below = above + below - start, start
    over = start + size + above - total
    if over > 0:
        below, above = below + over, above - over
    below = min(max(below, 0), start)
    above = min(max(above, 0), total - start - size)
    return start - below, size + below + above


def test_enforce_min_size(spark):
    rows = [
        (i, start, size, total, least)
        for i, (start, size, total, least) in enumerate(
            (s, n, t, m) for t in (6, 9) for n in (1, 3) for s in range(t - n + 1) for m in (1, 4, 5, 9, 12)
        )
    ]
    df = spark.createDataFrame(rows, "i int, s int, n int, t int, m int")
    boxes = df.select(
        "i", "m", *[F.col("s").alias(f"crop_{a}") for a in "xyz"], *[F.col("n").alias(f"crop_size_{a}") for a in "xyz"],
        *[F.col("t").alias(f"n{a}") for a in "xyz"],
    )
    out = vx.enforce_min_size(boxes, {a: F.col("m") for a in "xyz"}).collect()
    for r in out:
        _, s, n, t, m = rows[r.i]
        assert (r.crop_x, r.crop_size_x) == grow(s, n, t, m) == (r.crop_z, r.crop_size_z)


def test_min_size_is_cut_off(spark):
    row = spark.range(1).select(vx.min_size_in_source(96, 1.0, F.lit(0.7)).alias("v")).first()
    assert row.v == 137  # 137.14


def test_contact_ratio_at_the_edge(spark):
    shape = (3, 3, 3)
    label = {(0, 0, 0): 2, (1, 0, 0): 1, (0, 1, 0): 1, (2, 2, 2): 1}
    rows = [(1, *c, label.get(c, 0)) for c in itertools.product(range(3), repeat=3)]
    voxels = spark.createDataFrame(rows, "voi_id bigint, x int, y int, z int, label int")
    runs = cc.component_runs(voxels.where("label = 2")).withColumn("lesion", F.lit(0))
    one = vx.contact_ratio(runs, voxels, volume(spark, shape)).first()
    assert (one.kidney_contact_vox, one.kidney_contact_ratio) == (2, pytest.approx(2 / 7))
    two = vx.contact_ratio(runs, voxels, volume(spark, shape), iterations=2).first()
    assert (two.kidney_contact_vox, two.kidney_contact_ratio) == (3, pytest.approx(3 / 26))


def test_pad_gives_the_odd_voxel_to_the_low_side(spark):
    voxels, hu, _ = cube(spark, (2, 3, 2))
    got = as_array(vx.pad_to_min(volume(spark, (2, 3, 2)), voxels, (5, 2, 3)), (5, 3, 3), "hu")
    want = np.full((5, 3, 3), -200.0)
    want[2:4, :, 1:3] = hu
    np.testing.assert_allclose(got, want)


def test_validate_and_integrity(spark):
    rows = [(1, 0, 0, 0, 0), (2, 0, 0, 0, 1), (3, 0, 0, 0, 2)]
    voxels = spark.createDataFrame(rows, "voi_id bigint, x int, y int, z int, label int")
    vols = volume(spark, (1, 1, 1), voi=1).union(volume(spark, (1, 1, 1), voi=2)).union(volume(spark, (1, 1, 2), voi=3)).union(volume(spark, (1, 1, 1), voi=4))
    reasons = {r.voi_id: r.reason for r in vx.validate_voi(voxels, vols).collect()}
    assert reasons == {
        1: "Empty bbox_mask (no tissue)", 2: "Empty save_mask (no target labels)", 3: "OK", 4: "Empty bbox_mask (no tissue)",
    }
    masks = voxels.withColumn("value", F.col("label"))
    found = {r.voi_id: r.reason for r in vx.mask_integrity(masks, vols).collect()}
    assert found == {1: "OK", 2: "OK", 3: "Mask contains invalid values", 4: "Shape mismatch"}


def test_approximate_percentiles_option(spark):
    voxels, hu, label = cube(spark, (6, 6, 6))
    out = {r.kind: r for r in vx.intensity_stats(voxels, accuracy=10000).collect()}
    inside = hu[np.isin(label, (1, 2))]
    assert abs(out["raw"].median - np.median(inside)) < 10
    assert out["raw"]["std"] == pytest.approx(inside.std())


def test_shape_axes_are_eigenvalues(spark):
    voxels, _, label = cube(spark, (5, 4, 6), seed=3)
    out = rad.shape_features(voxels, volume(spark, (5, 4, 6), (0.8, 0.9, 2.0))).first()
    points = np.argwhere(label == 2) * np.array([0.8, 0.9, 2.0])
    values = np.sort(np.linalg.eigvalsh(np.cov(points.T, bias=True)))[::-1]
    np.testing.assert_allclose([out.major_axis, out.minor_axis, out.least_axis], 4 * np.sqrt(values), rtol=1e-9)
    one = voxels.where("x = 0 and y = 0 and z = 0").withColumn("label", F.lit(2))
    assert rad.shape_features(one, volume(spark, (5, 4, 6))).first().major_axis == 0.0


def test_mann_whitney_by_counting(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 7.0], [2.0, 3.0, 5.0, 5.0]
    rows = [(f"p{i}", g, "art", "f", v) for i, (g, v) in enumerate([("A", v) for v in a] + [("B", v) for v in b])]
    rows += [("q", "A", "art", "g", 1.0)]  # one group only: not compared
    long = spark.createDataFrame(rows, "patient_id string, group_label string, contrast_phase string, feature string, value double")
    out = rad.compare_groups(long).collect()
    assert len(out) == 1
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert out[0].u == u
    assert out[0].effect == pytest.approx(2 * u / 20 - 1)
    assert out[0].p == pytest.approx(math.erfc(abs(out[0].z) / math.sqrt(2)), abs=3e-7)
    assert out[0].p_holm == out[0].p


def test_resampling_keeps_slices_together(spark):
    """Voxels are dealt by slice, so that most of what meets in an output voxel is added up before the shuffle."""
    voxels = spark.createDataFrame([(1, x, y, 0, 1.0) for x in range(2) for y in range(2)], "voi_id long, x int, y int, z int, hu double")
    volumes = spark.createDataFrame([(1, 2, 2, 1, [1.0, 1.0, 1.0])], "voi_id long, nx int, ny int, nz int, spacing array<double>")
    out = vx.resample_voxels(voxels, volumes, (0.5, 0.5, 1.0), method="linear")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(z#" in plan and "xxhash64(x#" not in plan
    assert out.count() == 16
