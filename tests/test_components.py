"""Components against a plain flood fill, by both ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import components as cc
from cohortspark.operators import voxels as vx
from cohortspark.operators.lesions import lesion_components, lesion_geometry, min_lesion_filter

LIMITS = [0, cc.MAX_GROUP_ROWS]


def flood(cells, conn):
    """Component number per cell, numbered by first cell in (x, y, z) order."""
    cells = set(cells)
    label, n = {}, 0
    for start in sorted(cells):
        if start in label:
            continue
        n += 1
        stack, label[start] = [start], n
        while stack:
            x, y, z = stack.pop()
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    for dz in (-1, 0, 1):
                        if conn == 6 and abs(dx) + abs(dy) + abs(dz) != 1:
                            continue
                        c = (x + dx, y + dy, z + dz)
                        if c in cells and c not in label:
                            label[c] = n
                            stack.append(c)
    return label


def table(spark, cells):
    return spark.createDataFrame([(v, *c) for v, cs in cells.items() for c in cs], "voi_id bigint, x int, y int, z int")


@pytest.mark.parametrize("conn", [6, 26])
@pytest.mark.parametrize("limit", LIMITS)
def test_random_volumes(spark, conn, limit):
    rng = np.random.default_rng(5)
    cells = {}
    for voi, (shape, density) in enumerate([((9, 8, 7), 0.25), ((5, 5, 5), 0.6), ((20, 3, 2), 0.3), ((4, 4, 4), 0.02)]):
        cells[voi] = [tuple(int(i) for i in c) for c in np.argwhere(rng.random(shape) < density)]
    voxels = table(spark, cells)
    runs = cc.component_runs(voxels, ["voi_id"], conn, max_group_rows=limit)
    numbers = cc.component_table(runs)
    got = runs.join(numbers.select("voi_id", "root", "component"), ["voi_id", "root"]).select(
        "voi_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", "component"
    )
    found = {(r.voi_id, r.x, r.y, r.z): r.component for r in got.collect()}
    want = {(v, *c): n for v, cs in cells.items() for c, n in flood(cs, conn).items()}
    assert found == want


@pytest.mark.parametrize("limit", LIMITS)
def test_long_snake(spark, limit):
    """A winding path needs many rounds and is one component."""
    cells = []
    for y in range(0, 40, 2):
        cells += [(x, y, 0) for x in range(12)]
        cells.append((11 if y % 4 == 0 else 0, y + 1, 0))
    runs = cc.component_runs(table(spark, {1: cells}), ["voi_id"], 6, max_group_rows=limit)
    assert runs.select("root").distinct().count() == 1


def test_diagonal_blobs_and_partitioning(spark):
    cells = {7: [(0, 0, 0), (1, 1, 1)]}
    voxels = table(spark, cells)
    count = lambda df, conn: cc.component_table(cc.component_runs(df, ["voi_id"], conn)).count()
    assert (count(voxels, 26), count(voxels, 6)) == (1, 2)
    assert count(voxels.repartition(7), 6) == 2


def test_lesion_filter_and_geometry(spark):
    cells = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (3, 3, 3)]
    voxels = table(spark, {1: cells}).withColumn("label", F.lit(2)).withColumn("hu", F.lit(1.0))
    parts = lesion_components(voxels)
    vois = spark.createDataFrame([(1,), (2,)], "voi_id bigint")
    kept = {r.voi_id: r for r in min_lesion_filter(parts.table, vois, 2).collect()}
    assert (kept[1].n_kept, kept[1].n_skipped, kept[2].has_tumor) == (1, 1, False)
    assert kept[1].lesion_warnings == ["Skipped 1 connected component(s) smaller than min_lesion_voxels=2."]
    none = {r.voi_id: r for r in min_lesion_filter(parts.table, vois, 9).collect()}
    assert len(none[1].lesion_warnings) == 2
    geo = lesion_geometry(parts.table, (0.5, 1.0, 2.0)).where("volume_vox = 3").first()
    assert geo.centroid_vox == pytest.approx([2 / 3, 1 / 3, 0.0])
    assert (geo.bbox_size_vox, geo.bbox_size_mm, geo.max_extent_mm) == ([2, 2, 1], [1.0, 2.0, 2.0], 2.0)
    assert lesion_geometry(parts.table).where("volume_vox = 3").first().volume_mm3 is None


def test_single_kidney_side_uses_physical_centre(spark):
    cells = [(4, 0, 0, 1), (5, 0, 0, 2)]
    voxels = spark.createDataFrame([(1, *c) for c in cells], "voi_id bigint, x int, y int, z int, label int")

    def side(origin, dx):
        d = [dx, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
        vol = spark.createDataFrame(
            [(1, 6, 1, 1, [1.0, 1.0, 1.0], [origin, 0.0, 0.0], d)],
            "voi_id bigint, nx int, ny int, nz int, spacing array<double>, origin array<double>, direction array<double>",
        )
        return vx.separate_kidneys(voxels, vol).first().side

    assert side(0.0, 1.0) == "R"  # 4.5 against 3
    assert side(-10.0, 1.0) == "L"
    assert side(5.0, -1.0) == "L"  # 0.5 against 3


def test_only_the_large_volume_is_contracted(spark, monkeypatch):
    """One large volume among small ones: it alone goes through the loop, and all have their components."""
    rng = np.random.default_rng(11)
    cells = {voi: [tuple(int(i) for i in c) for c in np.argwhere(rng.random((4, 4, 4)) < 0.3)] for voi in range(40)}
    cells[7] = [tuple(int(i) for i in c) for c in np.argwhere(rng.random((14, 14, 14)) < 0.3)]
    seen = []
    contract = cc._contract_all

    def watched(edges, keys):
        seen.extend(r.voi_id for r in edges.select("voi_id").distinct().collect())
        return contract(edges, keys)

    monkeypatch.setattr(cc, "_contract_all", watched)
    monkeypatch.setattr(cc, "BATCH_EDGES", 50)
    runs = cc.component_runs(table(spark, cells), ["voi_id"], 26, max_group_rows=100)
    numbers = cc.component_table(runs)
    got = runs.join(numbers.select("voi_id", "root", "component"), ["voi_id", "root"]).select(
        "voi_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", "component"
    )
    assert seen == [7]
    assert {(r.voi_id, r.x, r.y, r.z): r.component for r in got.collect()} == {
        (v, *c): n for v, cs in cells.items() for c, n in flood(cs, 26).items()
    }
