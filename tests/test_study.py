"""Statistics from one fold, and the study from files and voxels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark import scale
from cohortspark.operators import cohort, study
from cohortspark.operators import evaluation as ev
from cohortspark.operators import radiomics as rad
from cohortspark.operators import voxels as vx


def _region(spark, seed=3, shape=(4, 5, 6), vois=(1, 2, 3, 4)):
    rng = np.random.default_rng(seed)
    rows = [
        (v, int(x), int(y), int(z), float(rng.integers(-200, 300)), int(rng.integers(0, 3)))
        for v in vois for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])
    ]
    return spark.createDataFrame(rows, "voi_id bigint, x int, y int, z int, hu double, label int"), rows


def test_folded_moments_are_numpys(spark):
    voxels, rows = _region(spark)
    folded = scale.fold_values(voxels, ["voi_id"], {"hu": F.col("hu")})
    for r in scale.folded_moments(folded, ["voi_id"]).collect():
        x = np.array([row[4] for row in rows if row[0] == r.voi_id])
        d = x - x.mean()
        want = [len(x), (x * x).sum(), x.mean(), x.min(), x.max(), x.var(), (d**3).mean() / x.std() ** 3, (d**4).mean() / x.var() ** 2, np.abs(d).mean()]
        assert list(r)[1:] == pytest.approx(want)
    whole = scale.folded_moments(folded, []).first()
    assert whole.n == len(rows) and whole.variance == pytest.approx(np.var([row[4] for row in rows]))


def test_moments_without_spread(spark):
    flat = spark.createDataFrame([(1, 0.1)] * 7 + [(2, None)], "k int, v double")
    r = scale.folded_moments(scale.fold_values(flat, ["k"], {"v": F.col("v")}), ["k"]).collect()
    assert len(r) == 1 and r[0].skewness is None and r[0].kurtosis is None and r[0].variance == pytest.approx(0, abs=1e-20)


def test_intensities_read_the_voxels_once(spark, tmp_path):
    voxels, rows = _region(spark)
    voxels.write.parquet(str(tmp_path / "v"))
    out = vx.intensity_stats(spark.read.parquet(str(tmp_path / "v")))
    assert str(tmp_path) not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.kind: r for r in out.collect()}
    x = np.array([row[4] for row in rows if row[5] in (1, 2)])
    for kind, values in (("raw", x), ("windowed", x.clip(-200, 300))):
        r = got[kind]
        assert [r.n, r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([len(x), values.mean(), values.std(), values.min(), values.max()])
        assert [r.p0_5, r.median, r.p95] == pytest.approx(list(np.percentile(values, [0.5, 50, 95])))


def _files(spark, vois):
    groups = {1: "A", 2: "AB", 3: "B", 4: "BC"}
    rel = {v: f"{groups[v]}/p{v}/ART/0{v}_p{v}_L.npy" for v in vois}
    paths = [f"{kind}/{r}" for r in rel.values() for kind in ("images", "mask")]
    paths += ["mask/A/p9/ART/09_p9_L.npy", "images/A/p8/ART/08_p8_R.npy", "mask/A/p8/ART/08_p8_R.npy", paths[0]]
    keys = [(r, v) for v, r in rel.items()] + [("A/p8/ART/08_p8_R.npy", 8)]
    return spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(keys, "mask_path string, voi_id bigint")


def test_study_from_files_and_voxels(spark):
    voxels, rows = _region(spark)
    volumes = spark.createDataFrame([(v, [1.0, 1.0, 2.0]) for v in (1, 2, 3, 4, 5)], "voi_id bigint, spacing array<double>")
    files, keys = _files(spark, (1, 2, 3, 4))
    compared, described = study.run_study(cohort.index_vois(files, phase="all"), keys, voxels, volumes)
    got = {r.feature: r for r in compared.collect()}
    families = {name.split("_")[0] for name in got}
    assert families == {"firstorder", "shape", "glcm", "glrlm", "glszm", "gldm", "ngtdm"} and len(got) > 90
    # means of the region in range, by hand: the repeated file and those without volume add nothing
    means = {v: np.mean([r[4] for r in rows if r[0] == v and r[5] == 2 and -150 <= r[4] <= 250]) for v in (1, 2, 3, 4)}
    u = sum((means[a] > means[b]) + 0.5 * (means[a] == means[b]) for a in (1, 2) for b in (3, 4))
    mean = got["firstorder_mean"]
    assert (mean.n_a, mean.n_b, mean.u) == (2, 2, u)
    a = [r for r in described.collect() if (r.feature, r.group_label) == ("firstorder_mean", "A")]
    assert a[0]["mean"] == pytest.approx((means[1] + means[2]) / 2, abs=1e-5)


def test_study_drops_features_that_are_often_missing(spark):
    rows = [(f"s{i}", "A" if i % 2 else "B", f"p{i}", "art", float(i), None if i < 4 else 1.0) for i in range(10)]
    table = spark.createDataFrame(rows, "sample_id string, class_raw string, patient_id string, contrast_phase string, f_x double, f_y double")
    assert {r.feature for r in study.study_rows(table).collect()} == {"f_x"}
    loose = study.StudyOptions(max_missing=0.5)
    assert {r.feature for r in study.study_rows(table, loose).collect()} == {"f_x", "f_y"}
    assert rad.compare_groups(study.study_rows(table)).first().n_a == 5


def test_binary_curve_needs_both_outcomes(spark):
    df = spark.createDataFrame([(1, 1, [0.2, 0.8]), (2, 1, [0.6, 0.4])], "id bigint, label int, probs array<double>")
    with pytest.raises(ValueError):
        ev.require_both_classes(ev.binary_rows(df, 1))
    with pytest.raises(ValueError):
        ev.require_both_classes(ev.binary_rows(df.limit(0), 1))
    both = df.union(spark.createDataFrame([(3, 0, [0.9, 0.1])], df.schema))
    assert ev.roc_summary(ev.require_both_classes(ev.binary_rows(both, 1))).first().auc == 1.0


def test_shape_check_survives_pruning(spark):
    files = spark.createDataFrame([("images/A/p/NC/f.npy",)], "path string")
    shapes = spark.createDataFrame([("images/A/p/NC/f.npy", [1, 2]), ("mask/A/p/NC/f.npy", [1, 3])], "path string, shape array<int>")
    with pytest.raises(Exception, match="image and mask shape differ"):
        cohort.training_index(files, shapes).select("path").collect()
    with pytest.raises(Exception, match="image and mask shape differ"):
        cohort.training_index(files, shapes).count()
