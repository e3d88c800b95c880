"""Deliveries merged into stored state, plans rolled up to directories, crops by slabs."""

import random

import pytest

from cohortspark.operators import curation
from cohortspark.operators import voxels as vx
from cohortspark.sources import state


def _decisions(spark, rows):
    return spark.createDataFrame(rows, "key string, action string, ord bigint")


def _plain(spark, at):
    return {r.key: (r.action, r.ord) for r in state.read_state(spark, at).collect()}


def test_deliveries_in_any_order_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None, "é" * 40, ""]), rng.choice(["NC", "CLEAR", "delete"]), i) for i in range(60)]
    want = {}
    for key, action, ord_ in rows:
        want[key] = (action, ord_)
    parts = [rows[0::3], rows[1::3], rows[2::3], rows[1::3], []]
    for turn in range(2):
        at = state.decisions_state(str(tmp_path / f"s{turn}"), buckets=3)
        assert state.read_state(spark, at).collect() == []
        for part in (parts if turn == 0 else parts[::-1]):
            state.merge_delivery(spark, at, _decisions(spark, part))
        assert _plain(spark, at) == want


def test_ties_extra_columns_and_buckets(spark, tmp_path):
    at = state.decisions_state(str(tmp_path / "s"), buckets=2)
    rows = spark.createDataFrame([("a", "NC", 1, 7), ("a", "VEN", 1, 7)], "key string, action string, ord int, bucket int")
    state.merge_delivery(spark, at, rows)
    state.merge_delivery(spark, at, rows.limit(1))
    assert _plain(spark, at) == {"a": ("VEN", 1)}
    with pytest.raises(ValueError):
        state.merge_delivery(spark, state.decisions_state(at.path, buckets=5), rows)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    at = state.decisions_state(str(tmp_path / "s"), buckets=8)
    state.merge_delivery(spark, at, _decisions(spark, [(f"k{i}", "NC", i) for i in range(40)]))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    state.merge_delivery(spark, at, _decisions(spark, [("k1", "ART", 99)]))
    kept = [p for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert len({p.parent for p in before} - {p.parent for p in kept}) == 1
    assert _plain(spark, at)["k1"] == ("ART", 99) and len(_plain(spark, at)) == 40


def test_a_lost_run_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    at = state.decisions_state(str(tmp_path / "s"), buckets=2)
    state.merge_delivery(spark, at, _decisions(spark, [("a", "NC", 1)]))
    publish = state._publish
    calls = []

    def lost(session, one):
        calls.append(one)
        if len(calls) == 2:
            raise RuntimeError("lost")
        publish(session, one)

    monkeypatch.setattr(state, "_publish", lost)
    with pytest.raises(RuntimeError):
        state.merge_delivery(spark, at, _decisions(spark, [("a", "ART", 2), ("b", "NC", 3)]))
    assert _plain(spark, at) == {"a": ("NC", 1)}
    monkeypatch.setattr(state, "_publish", publish)
    state.merge_delivery(spark, at, _decisions(spark, []))
    assert _plain(spark, at) == {"a": ("ART", 2), "b": ("NC", 3)}
    assert not (tmp_path / "s" / "_pending").exists()


def test_files_and_directories_after_a_plan(spark):
    files = spark.createDataFrame([(p,) for p in ("images/A/a", "images/A/a", "images/B/b", "mask/C/c", "x")], "path string")
    rows = [("images/A/a", "images/B/a", "move"), ("images/A/a", "images/B/a", "move"), ("mask/C/c", "mask/D/c", "done")]
    plan = spark.createDataFrame(rows, "from_path string, to_path string, state string")
    left = sorted(r.path for r in curation.files_after(files, plan).collect())
    assert left == ["images/B/a", "images/B/b", "mask/C/c", "x"]
    assert [r.directory for r in curation.empty_dirs(files, plan).collect()] == ["images/A"]
    # a file that moves on to where another one stood
    swap = spark.createDataFrame([("images/A/a", "images/B/b", "move"), ("images/B/b", "mask/C/b", "move")], plan.schema)
    assert sorted(r.path for r in curation.files_after(files, swap).collect()) == ["images/B/b", "mask/C/b", "mask/C/c", "x"]


def test_empty_directories_read_files_and_plan_once(spark, tmp_path):
    spark.createDataFrame([("images/A/a",)], "path string").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([("images/A/a", "images/B/a", "move")], "from_path string, to_path string, state string").write.parquet(str(tmp_path / "p"))
    out = curation.empty_dirs(spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "p")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2 and "Join" not in plan


@pytest.mark.parametrize("slab", [1, 3, 64])
def test_crop_by_slabs_equals_brute_force(spark, slab):
    rng = random.Random(slab)
    cells = [(v, x, y, z, float(x)) for v in (1, 2, 3) for x in range(3) for y in range(3) for z in range(9)]
    boxes = [(v, rng.randrange(-1, 2), 0, rng.randrange(-2, 8), 2, rng.randrange(0, 3), rng.randrange(0, 6)) for v in (1, 1, 2, 4)]
    voxels = spark.createDataFrame(cells, "voi_id int, x int, y int, z int, hu double")
    names = "voi_id int, crop_x int, crop_y int, crop_z int, crop_size_x int, crop_size_y int, crop_size_z int"
    out = vx.crop_voxels(voxels, spark.createDataFrame(boxes, names), slab)
    got = sorted((r.voi_id, r.x, r.y, r.z, r.x_local, r.y_local, r.z_local) for r in out.collect())
    want = sorted(
        (v, x, y, z, x - b[1], y - b[2], z - b[3]) for v, x, y, z, _ in cells for b in boxes
        if b[0] == v and all(lo <= c < lo + n for c, lo, n in zip((x, y, z), b[1:4], b[4:7]))
    )
    assert got == want
