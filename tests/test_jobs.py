"""Splits, patches, evaluation, curation and stored tables on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cohort, curation
from cohortspark.operators import evaluation as ev
from cohortspark.operators import lesions as les
from cohortspark.operators import sampling as smp
from cohortspark.operators import series
from cohortspark.sources import tables as io


def patients(spark, sizes):
    rows = [(f"{c}{i:03d}", c, f"{c}/{i:03d}") for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "patient_id string, class string, first_path string")


@pytest.mark.parametrize("sizes", [{"A": 40, "B": 23, "D": 7, "NG": 3}, {"A": 30, "B": 1}, {"A": 30, "B": 1, "C": 1}])
def test_split_invariants(spark, sizes):
    rows = patients(spark, sizes)
    splits = smp.build_splits(rows, 5, 0.1, 42).toPandas()
    test = set(splits[splits.split == "test"].patient_id)
    lone = sum(1 for n in sizes.values() if n == 1) == 1
    eligible = sum(sizes.values()) - (1 if lone else 0)
    assert len(test) == math.ceil(eligible * 0.1)
    if lone:
        assert "B000" not in test
    everyone = {r.patient_id for r in rows.collect()}
    seen = []
    for _, part in splits[splits.split != "test"].groupby("fold"):
        train, val = set(part[part.split == "train"].patient_id), set(part[part.split == "val"].patient_id)
        assert not train & val and not (train | val) & test and train | val | test == everyone
        seen.append(val)
    assert sum(map(len, seen)) == len(everyone - test)
    for c, n in sizes.items():
        counts = [sum(p.startswith(c) and p[len(c):].isdigit() for p in v) for v in seen]
        if n >= 10:
            assert max(counts) - min(counts) <= 1


def test_splits_do_not_depend_on_partitions(spark):
    rows = patients(spark, {"A": 20, "B": 15})
    one = smp.build_splits(rows, 3, 0.2, 7).collect()
    two = smp.build_splits(rows.repartition(7), 3, 0.2, 7).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    with pytest.raises(ValueError):
        smp.select_fold(smp.build_splits(rows, 3, 0.2, 7), 9)


def lesion_rows(spark):
    return spark.createDataFrame(
        [(1, 0, 9, "tiny", [2.0, 2.0, 2.0], [3, 5, 2]), (1, 1, 30, None, [5.0, 1.0, 1.0], [4, 4, 4])],
        "voi_id bigint, lesion_id bigint, volume_vox bigint, size_bin string, centroid_vox array<double>, bbox_size_vox array<int>",
    )


def test_patch_plan(spark):
    profile = les.bin_profile(spark.createDataFrame([("tiny",), ("medium",), ("tiny",)], "size_bin string"), 0.5)
    subjects = spark.createDataFrame([(1, 8, 8, 8), (2, 3, 9, 8)], "voi_id bigint, nx int, ny int, nz int")
    options = smp.SamplerOptions(patch=(4, 3, 4), background_prob=1.0)
    plan = smp.plan_patches(lesion_rows(spark), profile, subjects, options).orderBy("voi_id", "plan_order").collect()
    # the lesion without a bin sorts first and counts as medium: 3 patches, rebalanced 3 * 1.25 = 3.75 -> 4
    assert [(r.lesion_id, r.role) for r in plan if r.voi_id == 1] == [
        (1, "center"), (1, "border"), (1, "context"), (1, "center"), (0, "center"), (0, "border"),
    ]
    first = plan[0]
    assert (first.start_x, first.start_y, first.start_z) == (3, 0, 0)  # 5-2, 1-1.5 -> -0 (even), clipped
    border = plan[1]
    assert border.start_x == 4  # 5 + 2 - 2 = 5, last place is 4
    lone = [r for r in plan if r.voi_id == 2]
    assert [(r.lesion_id, r.role, r.start_x, r.start_y, r.start_z) for r in lone] == [(-1, "background", 0, 3, 2)]


def test_stochastic_plan_is_reproducible(spark):
    profile = les.bin_profile(lesion_rows(spark).select("size_bin").na.fill("medium"), 0.5)
    subjects = spark.createDataFrame([(1, 20, 20, 20)], "voi_id bigint, nx int, ny int, nz int")
    options = smp.SamplerOptions(patch=(4, 3, 4), stochastic=True, max_per_lesion=2)
    one = smp.plan_patches(lesion_rows(spark), profile, subjects, options).collect()
    two = smp.plan_patches(lesion_rows(spark).repartition(5), profile, subjects, options).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 4
    u = spark.range(5000).select(smp.uniform(1, F.col("id").cast("string")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.02 and 0 <= u[1] and u[2] < 1
    with pytest.raises(Exception, match="without catalog_key"):
        smp.lesions_for_subject(
            spark.createDataFrame([(None,)], "catalog_key string"), lesion_rows(spark).withColumn("mask_path", F.lit("a"))
        ).collect()


def test_size_bins_with_ties(spark):
    rows = spark.createDataFrame([(float(v), v) for v in (5, 5, 5, 5, 9, 20)], "volume_mm3 double, volume_vox int")
    assert les.size_cuts(rows, [25, 50, 75])[2] == [5.0, 8.0]
    got = sorted((r.volume_vox, r.size_bin) for r in les.assign_size_bins(rows, [25, 50, 75]).collect())
    assert got == [(5, "tiny")] * 4 + [(9, "medium"), (20, "medium")]
    many = les.size_bin_table(rows.withColumn("volume_mm3", F.when(F.col("volume_vox") < 9, F.col("volume_mm3"))), [0, 60, 70, 80, 90, 100])
    assert [r.name for r in many.collect()] == ["bin_0", "bin_1", "bin_2", "bin_3", "bin_4", "bin_5"] and many.first().metric == "volume_vox"


def preds(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label int, probs array<double>").withColumn("pred", ev.argmax_prediction(F.col("probs")))


def test_classification(spark):
    df = preds(spark, [(1, 0, [0.5, 0.5, 0.0]), (2, 1, [0.1, 0.8, 0.1]), (3, 1, [0.6, 0.3, 0.1])])
    cells = {(r.label, r.pred): (r.n, r["share"]) for r in ev.confusion_matrix(df, 3).collect()}
    assert len(cells) == 9 and cells[(1, 0)] == (1, 0.5) and cells[(2, 2)] == (0, 0.0) and cells[(0, 0)] == (1, 1.0)
    macro = ev.macro_prf(df, 3).first()
    assert macro.accuracy == pytest.approx(2 / 3) and macro.precision == pytest.approx((0.5 + 1 + 0) / 3)


@pytest.mark.parametrize("limit", [None, 0])
def test_roc(spark, limit):
    rows = [(i, int((i * 7) % 3 == 0), float((i * 13) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, positive int, score double").withColumn("class", F.lit(0))
    out = ev.roc_summary(df, max_group_rows=limit).first()
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    pos, neg = sum(r[1] for r in rows), sum(1 - r[1] for r in rows)
    tp = fp = area = 0
    best = (0.0, math.inf, 0.0, 1.0)
    for _, p, score in ordered:
        tp, fp = tp + p, fp + 1 - p
        area += 0 if p else tp / pos / neg
        if tp / pos - fp / neg > best[0] + 1e-15:
            best = (tp / pos - fp / neg, score, tp / pos, 1 - fp / neg)
    assert out.auc == pytest.approx(area)
    assert (out.threshold, out.sensitivity, out.specificity) == pytest.approx(best[1:])
    points = ev.roc_curve(df, max_group_rows=limit).collect()
    assert len(points) == 61 and sum(math.isinf(p.threshold) for p in points) == 1
    with pytest.raises(ValueError):
        ev.require_both_classes(df.withColumn("positive", F.lit(1)))
    assert ev.macro_auc(ev.roc_summary(df.withColumn("positive", F.lit(1)))).first().macro_auc == 0.0


def test_auc_is_mann_whitney(spark):
    rows = [(i, int(i % 3 == 0), float((i * 37) % 101)) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, positive int, score double").withColumn("class", F.lit(0))
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    u = sum(a > b for a in pos for b in neg)
    assert ev.roc_summary(df).first().auc == pytest.approx(u / len(pos) / len(neg))


def test_quality_and_losses(spark):
    same = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.25, 0.25)], "batch int, x double, x_hat double")
    row = ev.reconstruction_quality(same, 2.0).first()
    assert math.isinf(row.psnr) and row.similarity == 1.0
    lone = ev.weighted_masked_l1(same.withColumn("x_hat", F.col("x") + 1), F.lit(False), 5.0, 2.0).first()
    assert lone.loss == pytest.approx(2.0)
    lat = spark.createDataFrame([(1, [1.0], [0.0])], "batch int, mu array<double>, sigma array<double>")
    assert ev.kl_divergence(lat).first().kl == pytest.approx(0.5 * (1 - math.log(1e-6) - 1))


def test_metric_history(spark):
    rows = [("a/val", 0, "1.0", 1), ("a/val", 0, "2.5", 2), ("step_x", 0, "1", 3), ("a/val", 1, "abc", 4), ("a/val", 2, "NaN", 5)]
    events = spark.createDataFrame(rows, "tag string, epoch int, value string, ord bigint")
    got = {r.epoch: r.value for r in ev.upsert_metrics(events, drop_nan=True).collect()}
    assert got == {0: 2.5}
    earlier = spark.createDataFrame([("a/val", 0, 9.0), ("a/val", 7, 9.0)], "tag string, epoch int, value double")
    assert {r.epoch: r.value for r in ev.upsert_metrics(events, earlier, True).collect()} == {0: 2.5, 7: 9.0}
    hist = spark.createDataFrame([("t", 0, 3.0), ("t", 1, 3.0), ("t", 2, None), ("t", 3, 1.0)], "tag string, epoch int, value double")
    best = {r.epoch: (r.improved, r.best) for r in ev.running_best(hist, ["tag"]).collect()}
    assert best == {0: (True, 3.0), 1: (False, 3.0), 3: (True, 1.0)}
    lines = spark.createDataFrame([("t", '[{"epoch":1,"value":2},{"epoch":null,"value":1},{"epoch":2,"value":"x"}]')], "tag string, series string")
    assert [tuple(r) for r in io.history_points(lines).collect()] == [("t", 1, 2.0)]


def test_runs(spark):
    rows = [
        (0, "r1", 5.0, False, True, "checkpoints/best_gan.pth"), (0, "r1", 6.0, False, True, "checkpoints/best_vae.pth"),
        (0, "r2", 1.0, True, True, "checkpoint_best.pth"), (1, "r3", 9.0, False, False, "checkpoint_best.pth"),
        (2, "r4", 1.0, True, True, "other.pth"), (2, "r5", 2.0, False, True, "checkpoint_best.pth"),
    ]
    df = spark.createDataFrame(rows, "fold int, run string, mtime double, is_latest boolean, has_config boolean, artifact string")
    best = {r.run: r.artifact for r in ev.best_artifact(df).collect()}
    assert best["r1"] == "checkpoints/best_vae.pth" and "r4" not in best
    assert [(r.fold, r.run) for r in ev.latest_run_per_fold(df).collect()] == [(0, "r2")]
    with pytest.raises(ValueError):
        ev.best_artifact(df, "nope")


def test_curation(spark):
    rows = [(1, "a", "NC"), (2, "a", "CLEAR"), (3, "b", "ART"), (4, "b", "delete"), (5, "c", "CLEAR"), (6, "c", "VEN")]
    dec = curation.upsert_decisions(spark.createDataFrame(rows, "ord bigint, key string, action string"))
    assert {r.key: r.action for r in dec.collect()} == {"b": "delete", "c": "VEN"}
    plan_in = dec.withColumnRenamed("key", "filename")
    files = spark.createDataFrame([("nifti/b",), ("deleted/x",)], "path string")
    plan = curation.soft_delete_plan(plan_in, files)
    assert [(r.filename, r.state) for r in plan.collect()] == [("b", "move")]
    moved = spark.createDataFrame([("deleted/b",)], "path string")
    assert curation.soft_delete_plan(plan_in, moved).first().state == "done"
    log = curation.append_log(spark.createDataFrame([("nifti/o", "deleted/o")], "from_path string, to_path string"), plan)
    assert log.count() == 2


def test_empty_dirs_go_bottom_up(spark):
    files = spark.createDataFrame([("images/A/p/NC/f.npy",), ("images/A/q/NC/f.npy",), ("mask/A/p/NC/f.npy",)], "path string")
    plan = spark.createDataFrame(
        [("images/A/p/NC/f.npy", "deleted/f", "move"), ("mask/A/p/NC/f.npy", "mask/A/p/ART/f.npy", "move")],
        "from_path string, to_path string, state string",
    )
    got = {r.directory for r in curation.empty_dirs(files, plan).collect()}
    assert got == {"images/A/p", "images/A/p/NC", "mask/A/p/NC"}


def test_pairs_and_manifest(spark, tmp_path):
    images = spark.createDataFrame([("00_case_00001_0000.nii.gz",), ("01_case_00001_0000.nii.gz",)], "filename string")
    masks = spark.createDataFrame([("00_case_00001.nii.gz",)], "filename string")
    manifest = spark.createDataFrame(
        [(1, "00_case_00001_0000.nii.gz", "A", "art", "c1"), (2, "00_case_00001_0000.nii.gz", None, "ven", None), (3, "", "B", "nc", "c")],
        "ord bigint, filename string, group string, phase string, case_id string",
    )
    got = cohort.pair_images_masks(images, masks, cohort.manifest_by_filename(manifest)).collect()
    assert [(r["group"], r.phase, r.case_id) for r in got] == [("NG", "ven", "case_00001")]
    with pytest.raises(ValueError):
        cohort.pair_images_masks(images, masks.where(F.lit(False)), require=True)
    path = str(tmp_path / "m")
    assert io.write_manifest(manifest.drop("ord"), path, "csv")
    back = io.read_manifest(spark, path, ["filename", "group", "phase", "case_id"], "csv")
    assert sorted(map(str, back.collect())) == sorted(map(str, manifest.drop("ord").collect()))
    assert not io.write_manifest(manifest.where(F.lit(False)), path)


def test_shape_mismatch_fails_the_index(spark):
    files = spark.createDataFrame([("images/A/p/NC/f.npy",)], "path string")
    shapes = spark.createDataFrame([("images/A/p/NC/f.npy", [1, 2]), ("mask/A/p/NC/f.npy", [1, 3])], "path string, shape array<int>")
    with pytest.raises(Exception, match="image and mask shape differ"):
        cohort.training_index(files, shapes).collect()


def test_missing_shape_fails_the_index(spark):
    files = spark.createDataFrame([("images/A/p/NC/f.npy",)], "path string")
    shapes = spark.createDataFrame([("images/A/p/NC/f.npy", [1, 2])], "path string, shape array<int>")
    with pytest.raises(Exception, match="no shape of image or mask"):
        cohort.training_index(files, shapes).collect()


def test_spacing_of_all_headers(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 100 else 3.0, 1.0, 1.0) for i in range(301)], "ord int, sx double, sy double, sz double")
    assert cohort.target_spacing(rows).first().x == 3.0
    assert cohort.target_spacing(rows, max_samples=100).first().x == 1.0


def test_patients_without_class_stay(spark):
    rows = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", None)], "patient_id string, class string")
    assert sorted((r.patient_id, r.stratum) for r in smp.safe_strata(rows, 2).collect()) == [
        ("a", "A"), ("b", "A"), ("c", smp.RARE),
    ]


def test_files_beside_folders_are_no_series(spark):
    rows = spark.createDataFrame([("r/x.dcm", "u"), ("r/a/1.dcm", "u"), ("r/a/2.dcm", "u")], "file string, series_uid string")
    assert [(r.directory, r.num_slices) for r in series.discover_series(rows).collect()] == [("r/a", 2)]
    assert series.series_files(rows).count() == 2


def test_patient_report(spark):
    manifest = spark.createDataFrame(
        [(1, "T1", "c1", "ART", "m1"), (2, "T2", "c1", "ven", "m2")], "ord bigint, patient_id string, case_id string, phase string, manufacturer string"
    ).withColumns({"manufacturer_model": F.lit("x"), "institution": F.lit("y")})
    results = spark.createDataFrame(
        [
            (1, "c1", "L", "ok", "", True), (2, "c1", "R", "skipped", "small", False), (3, "c1", "R", "skipped", "small", False),
            (4, "c2", None, "failed", "boom", False), (5, "c3", "L", "ok", "", False),
        ],
        "ord bigint, patient_id string, side string, status string, reason string, has_tumor boolean",
    )
    got = {r.CaseID: r for r in cohort.patient_preprocess(manifest, results).collect()}
    assert (got["c1"].Status, got["c1"].LTumor, got["c1"].Comments, got["c1"].TCGA_ID) == ("Warning", True, "R: small; R: small", "T1")
    assert (got["c2"].Status, got["c2"].Comments) == ("Fail", "Error: boom; Processing failed")
    assert (got["c3"].Status, got["c3"].N_Series) == ("Pass", 0)
    assert cohort.patient_comments(results).count() == 4


def test_pairs_take_the_manifest_row_of_their_file(spark):
    files = [f"{k}/A/p1/ven/{n}.npy" for k in ("images", "mask") for n in ("00_case_00001_L", "00_case_00001_R", "01_case_00001_L")]
    manifest = spark.createDataFrame(
        [(1, "00_case_00001_0000.nii.gz", "p1", "M1"), (2, "01_case_00001_0000.nii.gz", "p1", "M2"), (3, "00_case_00001_0000.nii.gz", "p1", "M3")],
        "ord int, filename string, patient_id string, manufacturer string",
    )
    got = cohort.index_vois(spark.createDataFrame([(f,) for f in files], "path string"), manifest)
    assert sorted((r.sample_id.rsplit("/", 1)[1], r.manufacturer) for r in got.collect()) == [
        ("00_case_00001_L", "M3"), ("00_case_00001_R", "M3"), ("01_case_00001_L", "M2"),
    ]


def test_file_lists_shuffle_slices_once(spark):
    files = ["r/x.dcm", "r/a/1.dcm", "r/a/2.dcm", "/t/1", "/u", "lone", "s//y/1", "s//z", "v/w/q/1", "v/2", None]
    rows = spark.createDataFrame([(f, "u") for f in files], "file string, series_uid string")
    made = series.series_files(rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.directory, r.file, r.position) for r in made.collect()) == [
        ("/t", "/t/1", 1), ("lone", "lone", 1), ("r/a", "r/a/1.dcm", 1), ("r/a", "r/a/2.dcm", 2), ("s//y", "s//y/1", 1), ("v/w/q", "v/w/q/1", 1),
    ]
    # the other two are of folders above others, combined before their shuffle
    assert plan.count("Exchange hashpartitioning") <= 3
