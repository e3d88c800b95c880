"""Registry lists and the linear probe on literal rows."""

import numpy as np
from pyspark.sql import functions as F

from cohortspark.operators import cohort, models

SIDES = "ord long, patient_id string, case_name string, grp string, phase string, side string, status string, reason string"
ROWS = [
    (1, "p1", "c1", "A", "art", "L", "ok", ""),
    (2, "p1", "c1", "A", "art", "R", "failed", "cannot read"),
    (3, "p1", "c2", "A", "ven", "L", "ok", ""),
    (4, "p2", "c3", None, None, "R", "failed", None),
    (5, "p3", "c4", "", "", "L", "ok", None),
    (6, "p3", "c4", "", "", "R", None, None),
]


def test_registry_lists(spark):
    results = spark.createDataFrame(ROWS, SIDES).withColumn("extra", F.lit(1))
    registry = cohort.dataset_registry(results)
    cases = {tuple(r) for r in cohort.registry_cases(results).collect()}
    assert cases == {("p1", "c1", 1, True), ("p1", "c2", 3, True), ("p2", "c3", 4, False), ("p3", "c4", 5, True)}
    files = sorted(r.path for r in cohort.registry_files(results).collect())
    assert files == [
        "images/A/p1/ART/c1_L.npy", "images/A/p1/VEN/c2_L.npy", "images/NG/p3/UNDEFINED/c4_L.npy",
        "mask/A/p1/ART/c1_L.npy", "mask/A/p1/VEN/c2_L.npy", "mask/NG/p3/UNDEFINED/c4_L.npy",
    ]
    totals = cohort.registry_totals(registry, results).first()
    assert totals.num_mask_files + totals.num_image_files == len(files)
    outcomes = {tuple(r) for r in cohort.registry_outcomes(registry, results).collect()}
    assert outcomes == {
        ("success", "p1", None), ("success", "p3", None), ("failed", "c1", "cannot read"), ("failed", "c3", None)
    }
    covered = {r.patient_id: (r.coverage, list(r.phases)) for r in cohort.phase_coverage_patients(registry).collect()}
    assert covered == {"p1": ("multi", ["art", "ven"]), "p2": ("none", []), "p3": ("none", [])}


def test_registry_lists_of_nothing(spark):
    none = spark.createDataFrame([], SIDES)
    registry = cohort.dataset_registry(none)
    for found in (cohort.registry_cases(none), cohort.registry_files(none), cohort.registry_outcomes(registry, none)):
        assert found.count() == 0


def probe_rows(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, 120)
    points = rng.normal(size=(120, 4)) + np.eye(3, 4)[labels] * 1.5
    rows = [(i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(labels, points))]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), labels, points


def test_probe_scores_are_numpys(spark):
    rows, labels, points = probe_rows(spark)
    weights = models.fit_probe(rows.where("vec_id % 4 > 0"), iterations=500)
    fitted = sorted(weights.collect())
    scores = points @ np.array([r.weights for r in fitted]).T + np.array([r.bias for r in fitted])
    probs = np.exp(scores - scores.max(1, keepdims=True))
    probs /= probs.sum(1, keepdims=True)
    got = models.probe_scores(rows, weights).orderBy("vec_id").collect()
    assert np.allclose([r.probs for r in got], probs)
    assert [r.prediction for r in got] == probs.argmax(1).tolist()
    held = np.arange(120) % 4 == 0
    told = models.linear_probe(rows.where("vec_id % 4 > 0"), rows.where("vec_id % 4 = 0"), iterations=500).first()
    assert told.n == held.sum() and abs(told.probe_acc - (probs.argmax(1) == labels)[held].mean()) < 1e-12
    assert told.probe_acc > 0.6
    # the optimum: every class has, over the training rows, as much probability as rows
    assert np.allclose(probs[~held].sum(0), np.bincount(labels[~held], minlength=3), atol=0.05)
