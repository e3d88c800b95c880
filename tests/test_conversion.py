"""Series that cannot be read and conversions that fail: counted, listed, and left out of the manifest."""

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import series as ops

SF = "/root/testdata/sf0.001"


def test_spacing_texts(spark):
    rows = [("1", r"0.8\0.75\2"), ("2", r"0.8\x\1"), ("3", "0.8"), ("4", r"0.8\-1\1"), ("5", None), ("6", "")]
    got = {r.k: r for r in ops.with_geometry(spark.createDataFrame(rows, "k string, spacing_raw string")).collect()}
    assert (got["1"].spacing_x, got["1"].spacing_y, got["1"].spacing_z, got["1"].error) == (0.8, 0.75, 2.0, None)
    assert all(got[k].error == f"cannot read spacing '{dict(rows)[k]}'" and got[k].spacing_x is None for k in "2346")
    assert got["5"].error is None and got["5"].spacing_z is None


@pytest.fixture(scope="module")
def slices(spark):
    rows = [
        ("a/s1/2.dcm", "u1", {"0010|0020": "late"}), ("a/s1/1.dcm", "u1", {"0010|0020": "P1"}), ("a/s1/1b.dcm", "u2", None),
        ("a/loose.dcm", "u3", {}), ("b/1.dcm", "u1", {"0010|0020": "P9"}), ("top", "u4", None),
    ]
    return spark.createDataFrame(rows, "file string, series_uid string, tags map<string,string>")


def test_discovery_carries_the_first_header(slices):
    got = {(r.directory, r.series_uid): (r.num_slices, r.first_file, r.tags) for r in ops.discover_series(slices).collect()}
    assert got == {
        ("a/s1", "u1"): (2, "a/s1/1.dcm", {"0010|0020": "P1"}),
        ("a/s1", "u2"): (1, "a/s1/1b.dcm", None),
        ("b", "u1"): (1, "b/1.dcm", {"0010|0020": "P9"}),
        ("top", "u4"): (1, "top", None),
    }
    assert ops.discover_series(slices.drop("tags")).columns == ["directory", "series_uid", "num_slices", "first_file"]


def test_unreadable_series_are_quarantined(spark, slices):
    found = ops.discover_series(slices).withColumns({"nonuniformity_mm": F.lit(None).cast("double"), "series_ord": F.monotonically_increasing_id()})
    found = found.withColumn("read_error", F.when(F.col("directory") == "b", "cut off"))
    series = ops.filter_series(ops.describe_series(found), 1)
    reasons = {(r.directory, r.series_uid): r.reason for r in series.collect()}
    assert reasons == {("a/s1", "u1"): None, ("a/s1", "u2"): ops.READ_FAILED, ("b", "u1"): ops.READ_FAILED, ("top", "u4"): ops.READ_FAILED}
    assert {(r.series_uid, r.error) for r in ops.unreadable_series(series).collect()} == {("u2", "no header"), ("u1", "cut off"), ("u4", "no header")}
    assert {r.value for r in ops.discovery_stats(series).where("stat = 'pid_source'").collect()} == {"dicom_PatientID"}


def test_summary_sections(spark):
    from cohortspark.plans.catalog import catalog

    rows = {(r.section, r["item"]): r.n for r in catalog()["conversion_summary"].run(spark, SF).collect()}
    failed = catalog()["failed_conversions"].run(spark, SF).collect()
    assert rows["total", "failed_conversions"] == len(failed) > 0 and all("spacing" in r.error for r in failed)
    assert rows["label", "matched_patients"] > 0 and rows["label", "unmatched_rows"] > 0
    assert rows["total", "successful_conversions"] + rows["total", "skipped_series"] == rows["total", "total_series_discovered"]
    assert {"total", "group", "phase", "label", "duplicate_patient", "duplicate_label_key", "stat_scan_plane", "stat_modality", "stat_quality", "stat_pid_source"} == {s for s, _ in rows}


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "patient_id string, group string, phase string, validation string")
    got = {(r.section, r["item"]): r.n for r in ops.conversion_summary(empty, empty).collect()}
    assert got == {("total", k): 0 for k in ops.SUMMARY_TOTALS}


def test_header_values_are_cleaned_in_one_place(spark):
    """One trim for all values: as columns of their own they make a method that the JVM does not compile."""
    from cohortspark.plans.catalog import catalog

    rows = catalog()["series_metadata"].run(spark, SF)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
    assert len(rows.columns) == 17 and rows.where("sex = 'M' and DOB is not null and age_at_scan > 0").count() > 0
