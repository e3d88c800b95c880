import pytest
from pyspark.sql import functions as F

from cohortspark.functions import fixed, geometry, text
from cohortspark.operators import series as ops
from cohortspark.sources import tables as io


def apply(spark, fn, values, schema="v string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in rows.select(fn(F.col("v"))).collect()]


def test_phase_rules(spark):
    cases = {
        "late arterial chest": "excluded", "Delayed venous": "delay", "arterial delayed": "art", "W/O contrast": "nc",
        "non-contrast": "nc", "Porto-Venous": "ven", "nephro_phase": "ven", "14 sec": "undefined", "15 sec": "art",
        "40sec": "art", "41 sec": "undefined", "55 sec": "ven", "120 sec": "ven", "121 sec": "undefined", "150 sec": "delay",
        "2 min": "undefined", "4 min": "delay", "": "undefined", "artéria": "undefined", "parts": "undefined",
        "mpré": "undefined", "smart, prep": "undefined", "smart-prep": "excluded", "chest.": "excluded", "(pv)": "ven",
        "123 min": "undefined", "7 sec 30 min": "delay", None: "undefined", "x15 sec": "undefined", "vr": "excluded",
    }
    assert apply(spark, text.classify_phase_text, list(cases)) == list(cases.values())


def test_every_keyword_is_found(spark):
    for words, phase in [
        (fixed.EXCLUDED_WORDS, "excluded"), (fixed.NATIVE_WORDS, "nc"), (fixed.ARTERIAL_WORDS, "art"),
        (fixed.DELAYED_WORDS, "delay"), (fixed.VENOUS_WORDS, "ven"),
    ]:
        assert set(apply(spark, text.classify_phase_text, [f"ct,{w}; 1" for w in words])) == {phase}


def test_excluded_text_ends_one_search_only(spark):
    tags = F.create_map(F.lit("0008|103e"), F.lit("MPR"))
    row = spark.range(1).select(
        text.detect_protocol(tags, F.lit("a/art/b")).alias("p"),
        text.detect_phase_embedded(F.create_map(F.lit("SeriesDescription"), F.lit("MPR")), F.lit("x_art.nii")).alias("e"),
    ).first()
    assert tuple(row.p) == ("undefined", "metadata")
    assert tuple(row.e) == ("art", "filename")


def test_ids(spark):
    assert apply(spark, text.clean_cell, [" 12.0 ", "nan", "None", None, "1.50", " x\t"]) == ["12", "", "", "", "1.50", "x"]
    assert apply(spark, text.sanitize_id, ["é a//b", "..", "_x.-", ""]) == ["é_a_b", "UNKNOWN", "x.-", "UNKNOWN"]
    keys = ["Anonym_ab1", "anonym--x", "ANONYM", "0012", "kits-1", "12.0", "nan"]
    assert apply(spark, text.normalize_patient_key, keys) == ["ANONYM-AB1", "ANONYM-X", "ANONYM", "0012", "KITS-1", "12", ""]
    assert apply(spark, text.is_valid_pid, ["a", "Test", "1.2.3", "123", "ab", "", None]) == [False, False, False, True, True, False, False]
    assert apply(spark, text.normalize_case_id, ["kits7", "case_000123456", "x"]) == ["case_00007", "case_123456", "x"]
    pattern = r"(?:\d{2}_)?(case_\d{5})|^(TCGA-[A-Z0-9]+-[A-Z0-9]+)"
    names = ["00_case_00001", "TCGA-A1-B2_x", "other"]
    assert apply(spark, lambda c: text.patient_id_from_case(c, pattern), names) == ["case_00001", "TCGA-A1-B2", "other"]


def test_patient_id_sources(spark):
    def found(tags, path):
        cols = [p for k, v in tags.items() for p in (F.lit(k), F.lit(v))]
        tag_map = F.create_map(*cols) if cols else F.create_map(F.lit("x"), F.lit("y"))
        return tuple(spark.range(1).select(text.extract_patient_id(tag_map, F.lit(path)).alias("i")).first().i)

    assert found({"0010|0020": " ", "0010|0010": "A^B"}, "") == ("A_B", "dicom_PatientName")
    assert found({"0010|0020": "1.2", "0010|1000": "zz"}, "") == ("zz", "dicom_OtherPatientIDs")
    assert found({}, "/d/TCGA-AB-1234/CT_1/1.2.3") == ("TCGA-AB-1234", "directory_tcga")
    assert found({}, "/d/Anonym_7/1.2") == ("Anonym_7", "directory_ukbonn")
    assert found({}, "/abc/case_1/MR_x") == ("case_1", "directory_kits")
    assert found({}, "/a/b") == ("UNKNOWN", "fallback")


def test_planes(spark):
    iops = [r"1\0\0\0\1\0", r"1\0\0\0\0\1", r"0\1\0\0\0\1", r"0.7\0.7\0\0\0.7\0.7", r"1\x\0\0\1\0", r"1\0\0"]
    assert apply(spark, geometry.scan_plane_from_iop, iops) == ["AXIAL", "CORONAL", "SAGITTAL", "OBLIQUE", None, None]
    assert apply(spark, geometry.scan_plane_from_text, ["t2 COR x", "sagittal", ""]) == ["CORONAL", "SAGITTAL", "AXIAL"]
    assert apply(spark, geometry.scan_plane_from_direction, [[1.0, 0.0]], "v array<double>") == ["AXIAL"]


def test_dates_and_rounding(spark):
    assert apply(spark, text.format_dicom_date, ["20200102", "2020", "abcdefgh", None]) == ["2020-01-02", None, "abcd-ef-gh", None]
    assert apply(spark, text.format_dicom_time, ["101530.2", "10153"]) == ["10:15:30", None]
    age = lambda c: text.age_at_scan(F.lit("2000-01-01"), c)
    assert apply(spark, age, ["2010-01-01", "2010-13-01", "abcd-ef-gh"]) == [10.0, None, None]


def test_classes(spark):
    assert apply(spark, text.normalize_class, [" a+b ", "x", "d"]) == ["AB", "NG", "D"]
    assert apply(spark, text.collapse_class, ["AC", "BD", "?"]) == ["A", "B", "NG"]
    with pytest.raises(Exception, match="unexpected class label"):
        apply(spark, lambda c: text.collapse_class(c, strict=True), ["?"])


def test_severity(spark):
    lines = ["Maximum nonuniformity: 50.1", "maximum nonuniformity 10.5", "maximum nonuniformity:3", "fine"]
    found = apply(spark, lambda c: text.spacing_severity(text.nonuniformity_from_warning(c)), lines)
    assert found == ["critical", "moderate", "minor", "ok"]


def test_metric_names(spark):
    assert [tuple(v) for v in apply(spark, text.split_metric_tag, ["a/b/val", "val", "a/b"])] == [("a/b", "val"), ("val", None), ("a/b", None)]
    specs = apply(spark, text.axis_spec, ["F1", "x_kl", "tackle", "loss_d", ""])
    assert [s.label for s in specs] == ["F1 (%)", "KL divergence (a.u.)", "Tackle (a.u.)", "Discriminator loss (a.u.)", "Metric (a.u.)"]
    assert [tuple(v) for v in apply(spark, text.parse_monitor_name, ["train_x", "loss"])] == [("train", "x"), ("val", "loss")]
    assert apply(spark, text.slugify, ["A/b C", "//"]) == ["a_b_c", "metric"]


def test_label_tables(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("﻿patient_id,class,case_id\np1,a+b,7.0\np1,B,\nnan,A,1\n", encoding="utf-8")
    rows = io.read_label_table(spark, str(path))
    assert rows.columns == ["ord", "patient_id", "class", "case_id"]
    found = ops.load_class_labels(rows).collect()
    assert [(r.patient_id, r["group"], r.case_id) for r in found] == [("p1", "B", "7")]
    classes, aliases = ops.load_conversion_labels(rows, "ukbonn")
    assert classes is not None and aliases is None
    assert not ops.sniff_alias_format(rows)


def test_label_tables_keep_file_order_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("patient_id,class,case_id\np1,A,1\n")
    (tmp_path / "b.csv").write_text("patient_id,class,case_id\n" + 'x,"A\nb",2\n' * 50 + "p1,B,3\n")
    rows = io.read_label_table(spark, str(tmp_path))
    assert rows.count() == 52
    found = {r.patient_id: r["group"] for r in ops.load_class_labels(rows).collect()}
    assert found["p1"] == "B"


def test_alias_owner_is_the_first_row(spark):
    rows = [(1, "Anonym_a", "5.0", "x"), (2, "anonym-A", "6", "y"), (3, "Anonym_b", "Anonym_b", "z")]
    labels = spark.createDataFrame(rows, "ord bigint, Anonym string, ID string, `Manual Label` string")
    found = {r.alias: (r.row_ord, r.manual_label, r.n_rows) for r in ops.load_alias_labels(labels).collect()}
    assert found == {"ANONYM-A": (1, "x", 2), "5": (1, "x", 1), "6": (2, "y", 1), "ANONYM-B": (3, "z", 1)}


def test_group_lookup_order(spark):
    labels = spark.createDataFrame(
        [("p-a", "A", None, 1), ("P-A", "B", None, 2), ("p-b", "C", None, 3), ("p-B", "D", None, 4)],
        "patient_id string, group string, case_id string, first_ord bigint",
    )
    patients = spark.createDataFrame([("p-a",), ("P-a",), ("P-b",), ("zz",)], "patient_id string")
    found = {r.patient_id: r["group"] for r in ops.lookup_group(patients, labels).collect()}
    assert found == {"p-a": "A", "P-a": "B", "P-b": "C", "zz": "NG"}


def test_fingerprint_versions(spark):
    old = '{"foreground_intensity_properties_per_channel": {"0": {"mean": 1, "std": 2, "median": 3, "percentile_25_0": 0, "p25": 5, "percentile_75": 6}}}'
    bare = '{"mean": 1, "std": 2, "median": 3, "p25": 0.0, "p75": 4}'
    stats = lambda c: F.struct(*[v.alias(k) for k, v in io.read_fingerprint_stats(c).items()])
    a, b = apply(spark, stats, [old, bare])
    assert tuple(a) == (1.0, 2.0, 3.0, 5.0, 6.0)
    assert tuple(b) == (1.0, 2.0, 3.0, 0.0, 4.0)
    named = '{"windowed_intensity": {"ct": {"mean": 1, "std": 2, "median": 3, "p25": 4, "p75": 5}}, "foreground_intensity": {"channel_0": {"mean": 9}}}'
    assert tuple(apply(spark, stats, [named])[0]) == (1.0, 2.0, 3.0, 4.0, 5.0)
    with pytest.raises(Exception, match="fingerprint has no"):
        apply(spark, stats, ['{"mean": 1}'])


def test_sanitized_once(spark):
    """The patterns run once for an id, not once to look for a blank and once for the value."""
    rows = spark.createDataFrame([("a b",), ("__.",), ("",), (None,), ("_x..y_",)], "c string")
    made = rows.select("c", text.sanitize_id(F.col("c")).alias("s"))
    assert [r.s for r in made.collect()] == ["a_b", "UNKNOWN", "UNKNOWN", "UNKNOWN", "x..y"]
    nested = spark.createDataFrame([(["a b"],)], "c array<string>").select(F.transform("c", text.sanitize_id).alias("s"))
    assert nested._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2
