"""From slice headers to the series manifest: discovery, filtering, label matching, numbering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import fixed, geometry, text
from cohortspark.scale import first_per_key, group_bound, numbered, spread_join
from cohortspark.session import cut_lineage

# The columns of a manifest in their order, those of the alias labels, and what is said of a series that cannot be read.
MANIFEST_COLUMNS = [
    "filename", "patient_id", "case_id", "group", "phase", "phase_source", "scan_idx", "modality", "scan_plane",
    "image_orientation", "spacing_quality", "nonuniformity_mm", "sex", "DOB", "age", "age_at_scan", "DOS",
    "study_time", "series_description", "series_number", "manufacturer", "manufacturer_model", "institution",
    "kvp", "contrast_agent", "spacing_x", "spacing_y", "spacing_z", "dim_x", "dim_y", "dim_z", "slice_thickness",
    "num_slices", "conversion_date", "dataset_type", "output_path", "validation", "ukb_anonym", "ukb_id",
    "manual_label", "lb", "hb", "sn", "label_source",
]
READ_FAILED = "Failed to read DICOM series"
SUMMARY_TOTALS = ["total_patients", "total_series_discovered", "successful_conversions", "failed_conversions", "skipped_series"]
ALIAS_COLUMNS = ["ukb_anonym", "ukb_id", "manual_label", "lb", "hb", "sn", "label_source"]


# ---- discovery -------------------------------------------------------------------------------------------


def parent_dir(path: Column) -> Column:
    """The path without its last part; a path of one part is its own folder."""
    name = F.length(F.substring_index(path, "/", -1))
    return F.when(F.contains(path, F.lit("/")), F.left(path, F.length(path) - name - 1)).otherwise(path)


def leaf_dirs(files: DataFrame, path: str = "path") -> DataFrame:
    """Directories that hold files and no directory."""
    return _leaves(files.select(parent_dir(F.col(path)).alias("directory")).distinct())


def _ancestors(folders: DataFrame, proper: bool = True) -> DataFrame:
    """Every ancestor of the folders once, with or without the folders themselves."""
    parts = F.split("directory", "/")
    last = F.size(parts) - 1 if proper else F.size(parts)
    return folders.select(
        F.explode(
            F.transform(
                F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
                lambda n: F.array_join(F.slice(parts, 1, n), "/"),
            )
        ).alias("directory")
    ).distinct()


def _leaves(with_files: DataFrame) -> DataFrame:
    # every proper ancestor of a directory with files has a sub-directory
    return with_files.join(_ancestors(with_files), "directory", "left_anti")


def in_leaf_dirs(slices: DataFrame) -> DataFrame:
    """Slices (``file``) of leaf folders, with their ``directory``.

    Folders above others are found from the parents of the files' folders, which are combined before the shuffle; so slices are
    shuffled only once, by folder.
    """
    placed = slices.where(F.col("file").isNotNull()).withColumn("directory", parent_dir(F.col("file")))
    above = text.let(F.split("file", "/"), lambda p: F.when(F.size(p) > 2, F.array_join(F.slice(p, 1, F.size(p) - 2), "/")))
    parents = slices.select(above.alias("directory")).distinct()
    return placed.join(_ancestors(parents, proper=False), "directory", "left_anti")


def discover_series(slices: DataFrame) -> DataFrame:
    """Slices folded to series: number of slices, first file and, if slices have ``tags``, those of the first file.

    Only leaf folders hold series: files beside sub-folders are left out.  Slices are folded before folders are looked
    at, so they are shuffled once and only as partial counts.  The file list is ``series_files``.
    """
    first = {"first_file": F.min("file")}
    if "tags" in slices.columns:
        first["tags"] = F.min_by("tags", "file")
    placed = slices.withColumn("directory", parent_dir(F.col("file")))
    folded = placed.groupBy("directory", "series_uid").agg(F.count("*").alias("num_slices"), *[c.alias(n) for n, c in first.items()])
    return folded.join(_leaves(folded.select("directory").distinct()), "directory", "left_semi")


def series_files(slices: DataFrame) -> DataFrame:
    """Long form of the file list: one row per file with its position in the series."""
    keys = ["directory", "series_uid"]
    # all slices bound those of leaf folders, so the join is not made twice
    bound = group_bound(slices.select(parent_dir(F.col("file")).alias("directory"), "series_uid"), keys)
    return numbered(in_leaf_dirs(slices).select(*keys, "file"), keys, [F.col("file")], "position", group_rows=bound)


def describe_series(series: DataFrame) -> DataFrame:
    """Patient, plane, quality and modality of each series, from its tags."""
    tags = F.col("tags")
    identity = text.extract_patient_id(tags, F.col("directory"))
    return (
        series.withColumn("_id", identity)
        .withColumns(
            {
                "patient_id": F.col("_id.patient_id"),
                "pid_source": F.col("_id.source"),
                "modality": text.blank_to_null(text.get_tag(tags, fixed.TAG_MODALITY)),
                "scan_plane": geometry.detect_scan_plane(
                    text.get_tag(tags, fixed.TAG_ORIENTATION), text.get_tag(tags, fixed.TAG_DESCRIPTION)
                ),
                "severity": text.spacing_severity(F.col("nonuniformity_mm")),
                "root": F.substring_index("directory", "/", 1),
            }
        )
        .drop("_id")
    )


def readable(series: DataFrame) -> Column:
    """Whether a series could be read: it has header values and, where the reader reports one, no ``read_error``."""
    read = F.col("tags").isNotNull()
    return read & F.col("read_error").isNull() if "read_error" in series.columns else read


def skip_reason(min_slices: int = 10, read: Column | None = None) -> Column:
    """First reason to leave a series out, else NULL."""
    slices = F.col("num_slices").cast("string")
    return (
        F.when(~(F.lit(True) if read is None else read), READ_FAILED)
        .when(F.col("modality") == "SEG", "SEG modality (segmentation)")
        .when(F.col("severity") == "critical", "Critical spacing nonuniformity")
        .when(F.col("scan_plane") != "AXIAL", F.concat(F.lit("Non-axial scan ("), "scan_plane", F.lit(")")))
        .when(
            F.col("num_slices") < min_slices,
            F.concat(F.lit("Too few slices ("), slices, F.lit(f" < {min_slices})")),
        )
    )


def filter_series(series: DataFrame, min_slices: int = 10) -> DataFrame:
    """Series with the first ``reason`` to leave them out; an unreadable one is left out whatever else it is."""
    return series.withColumn("reason", skip_reason(min_slices, readable(series)))


def unreadable_series(series: DataFrame) -> DataFrame:
    """The quarantine table: series that could not be read, with what the reader said."""
    said = F.col("read_error") if "read_error" in series.columns else F.lit(None).cast("string")
    return series.where(~readable(series)).select("series_uid", "directory", F.coalesce(said, F.lit("no header")).alias("error"))


def select_metadata(tags: Column) -> Column:
    """``struct`` of the fifteen header values, dates formatted, age added; missing is NULL.

    The values stand in one array that is cleaned once.  As columns of their own they make one generated method that is too
    large for the JVM to compile, which then interprets it for every row.
    """
    names = [*fixed.METADATA_TAGS]
    raw = F.array(*[tags[key] for key in fixed.METADATA_TAGS.values()])
    cleaned = F.transform(F.transform(raw, text.strip), lambda v: F.when(v != "", v))

    def formatted(found):
        values = {name: F.get(found, F.lit(i)) for i, name in enumerate(names)}
        values["DOB"] = text.format_dicom_date(values["DOB"])
        values["DOS"] = text.format_dicom_date(values["DOS"])
        values["study_time"] = text.format_dicom_time(values["study_time"])
        values["age_at_scan"] = text.age_at_scan(values["DOB"], values["DOS"])
        return F.struct(*[c.alias(name) for name, c in values.items()])

    return text.let(cleaned, formatted)


def dataset_type(headers: DataFrame) -> DataFrame:
    """One row: the type told by the patient id of the first readable series."""
    pid = text.get_tag(F.col("tags"), fixed.TAG_PATIENT_ID)
    return headers.agg(F.min_by(pid, F.col("directory")).alias("pid")).select(
        F.coalesce(text.dataset_type(F.col("pid")), F.lit("generic")).alias("dataset_type")
    )


# ---- labels ----------------------------------------------------------------------------------------------


def resolve_column(candidates: Sequence[str], columns: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def sniff_alias_format(labels: DataFrame) -> bool:
    return set(fixed.ALIAS_HEADERS) <= set(labels.columns) and not labels.isEmpty()


def load_class_labels(labels: DataFrame, ord_column: str = "ord") -> DataFrame:
    """``patient_id, group, case_id, first_ord``; later rows win, blank case ids do not overwrite."""
    pid = resolve_column(fixed.PATIENT_HEADERS, labels.columns)
    cls = resolve_column(fixed.CLASS_HEADERS, labels.columns)
    cid = resolve_column(fixed.CASE_HEADERS, labels.columns)
    if pid is None or cls is None:
        empty = labels.select(F.lit("").alias("patient_id"), F.lit("").alias("group"), F.lit("").alias("case_id"))
        return empty.withColumn("first_ord", F.lit(0).cast("bigint")).where(F.lit(False))
    case = text.blank_to_null(text.clean_cell(F.col(cid))) if cid else F.lit(None).cast("string")
    rows = labels.select(
        F.col(ord_column).alias("_ord"),
        text.clean_cell(F.col(pid)).alias("patient_id"),
        text.normalize_class(text.clean_cell(F.col(cls))).alias("group"),
        case.alias("case_id"),
    ).where(F.col("patient_id") != "")
    return rows.groupBy("patient_id").agg(
        F.max_by("group", "_ord").alias("group"),
        F.max_by("case_id", F.when(F.col("case_id").isNotNull(), F.col("_ord"))).alias("case_id"),
        F.min("_ord").alias("first_ord"),
    )


def load_alias_labels(labels: DataFrame, ord_column: str = "ord", source: str = "labels.csv") -> DataFrame:
    """One row per alias: the first row owns it; ``n_rows`` tells how many rows claim it."""

    def cell(name):
        return text.clean_cell(F.col(f"`{name}`")) if name in labels.columns else F.lit("")

    rows = labels.select(
        F.col(ord_column).alias("row_ord"),
        *[cell(h).alias(c) for h, c in zip(fixed.ALIAS_HEADERS, ALIAS_COLUMNS)],
        F.lit(source).alias("label_source"),
    )
    keys = F.array(text.normalize_patient_key(F.col("ukb_anonym")), text.normalize_patient_key(F.col("ukb_id")))
    claims = rows.withColumn("alias", F.explode(F.array_distinct(keys))).where(F.col("alias") != "")
    record = F.struct("row_ord", *ALIAS_COLUMNS)
    return (
        claims.groupBy("alias")
        .agg(F.min_by(record, F.col("row_ord")).alias("r"), F.count("*").alias("n_rows"))
        .select("alias", "r.*", "n_rows")
    )


def load_conversion_labels(
    labels: DataFrame | None, dataset_type: str = "generic", ord_column: str = "ord"
) -> tuple[DataFrame | None, DataFrame | None]:
    """Class labels always; alias labels for the alias dataset type or where the headers match."""
    if labels is None:
        return None, None
    alias_headers = set(fixed.ALIAS_HEADERS) <= set(labels.columns)
    wanted = alias_headers and (dataset_type == "ukbonn" or not labels.isEmpty())
    return load_class_labels(labels, ord_column), load_alias_labels(labels, ord_column) if wanted else None


def lookup_group(patients: DataFrame, class_labels: DataFrame, default: str = "NG") -> DataFrame:
    """Patients with their group: by id, by normalised id, then by ids normalised on both sides."""
    exact = class_labels.select(F.col("patient_id").alias("_k"), F.col("group").alias("_g"))
    loose = first_per_key(
        class_labels.select(
            text.normalize_patient_key(F.col("patient_id")).alias("_k3"), F.col("group").alias("_g3"), "first_ord"
        ),
        ["_k3"],
        F.col("first_ord"),
    ).drop("first_ord")
    return (
        patients.withColumn("_n", text.normalize_patient_key(F.col("patient_id")))
        .join(exact.toDF("_k1", "_g1"), F.col("patient_id") == F.col("_k1"), "left")
        .join(exact.toDF("_k2", "_g2"), F.col("_n") == F.col("_k2"), "left")
        .join(loose, F.col("_n") == F.col("_k3"), "left")
        .withColumn("group", F.coalesce("_g1", "_g2", "_g3", F.lit(default)))
        .drop("_n", "_k1", "_g1", "_k2", "_g2", "_k3", "_g3")
    )


def attach_alias_labels(patients: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Patients with the seven alias columns, blank where no label matches."""
    if aliases is None:
        return patients.withColumns({c: F.lit("") for c in ALIAS_COLUMNS})
    record = aliases.select("alias", F.struct(*ALIAS_COLUMNS).alias("_rec"))
    found = (
        patients.withColumn("_n", text.normalize_patient_key(F.col("patient_id")))
        .join(record.toDF("_a1", "_r1"), F.col("patient_id") == F.col("_a1"), "left")
        .join(record.toDF("_a2", "_r2"), F.col("_n") == F.col("_a2"), "left")
        .withColumn("_r", F.coalesce("_r1", "_r2"))
    )
    return found.withColumns({c: F.coalesce(F.col(f"_r.{c}"), F.lit("")) for c in ALIAS_COLUMNS}).drop(
        "_n", "_a1", "_a2", "_r1", "_r2", "_r"
    )


def unmatched_labels(labels: DataFrame, aliases: DataFrame, manifest: DataFrame, ord_column: str = "ord") -> DataFrame:
    """Label rows that no manifest row matched."""
    matched = manifest.where(F.col("label_source") != "")
    keys = matched.select(
        F.explode(
            F.array(*[text.normalize_patient_key(F.col(c)) for c in ("ukb_anonym", "ukb_id", "patient_id")])
        ).alias("alias")
    ).distinct()
    rows = aliases.join(keys, "alias", "left_semi").select(F.col("row_ord").alias(ord_column)).distinct()
    return labels.join(rows, ord_column, "left_anti")


# ---- numbering -------------------------------------------------------------------------------------------


def assign_case_ids(patients: DataFrame, start: int = 1, n_patients: int | None = None) -> DataFrame:
    """Patients (``patient_id, first_seen, mapped_case``) with a case id.

    Mapped patients keep theirs, the others are numbered in first-seen order, ties by ``patient_id``.  ``n_patients`` saves a count.
    """
    mapped = patients.where(F.col("mapped_case").isNotNull()).withColumn(
        "case_id", text.normalize_case_id(F.col("mapped_case"))
    )
    others = numbered(
        patients.where(F.col("mapped_case").isNull()), [], [F.col("first_seen"), F.col("patient_id")], "_no", start=start, group_rows=n_patients
    ).withColumn("case_id", text.case_id(F.col("_no")))
    return mapped.unionByName(others.drop("_no"))


def case_id_collisions(patients: DataFrame) -> DataFrame:
    return patients.groupBy("case_id").agg(F.count("*").alias("n_patients")).where("n_patients > 1")


def series_numbers(series: DataFrame, largest_case: int | None = None) -> DataFrame:
    """Scan index per patient, counter per case, and the file name made of it.

    A patient lies in one case, so ``largest_case`` (rows) bounds both groups.
    """
    order = [F.col("first_seen"), F.col("series_ord")]
    counted = numbered(series, ["case_id"], order, "case_no", start=0, group_rows=largest_case)
    counted = numbered(
        counted, ["case_id", "patient_id"], [F.col("series_ord")], "scan_idx", start=0, group_rows=largest_case
    )
    name = F.format_string("%02d_%s_0000.nii.gz", F.col("case_no"), F.col("case_id"))
    return counted.withColumn("filename", name)


def parse_spacing(raw: Column) -> tuple[Column, Column]:
    """Three numbers of a backslash-separated text, and the error if it does not hold them; a null text is no error."""
    parts = F.split(raw, r"\\")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    bad = (F.size(parts) != 3) | F.exists(numbers, lambda v: v.isNull() | (v <= 0))
    error = F.when(bad, F.concat(F.lit("cannot read spacing '"), raw, F.lit("'")))
    return F.when(error.isNull(), numbers), error


def with_geometry(series: DataFrame) -> DataFrame:
    """Series with ``spacing_x``, ``spacing_y`` and ``spacing_z`` from ``spacing_raw``, and the ``error`` of a text that cannot be read."""
    numbers, error = parse_spacing(F.col("spacing_raw"))
    parsed = series.withColumns({"_spacing": numbers, "error": error})
    return parsed.withColumns({f"spacing_{a}": F.get("_spacing", F.lit(i)) for i, a in enumerate("xyz")}).drop("_spacing")


def conversion_failures(rows: DataFrame) -> DataFrame:
    """``patient_id, series_path, error`` of the rows of ``convert_series`` that failed."""
    return rows.where(F.col("error").isNotNull()).select("series_ord", "patient_id", F.col("directory").alias("series_path"), "error")


def converted(rows: DataFrame) -> DataFrame:
    """The manifest rows among the rows of ``convert_series``."""
    return rows.where(F.col("error").isNull()).select("series_ord", *MANIFEST_COLUMNS)


def build_manifest(
    kept: DataFrame,
    class_labels: DataFrame,
    aliases: DataFrame | None = None,
    start_case_id: int = 1,
    dataset: str = "generic",
) -> DataFrame:
    """Manifest rows of kept series, without those whose conversion fails."""
    return converted(convert_series(kept, class_labels, aliases, start_case_id, dataset))


def convert_series(
    kept: DataFrame,
    class_labels: DataFrame,
    aliases: DataFrame | None = None,
    start_case_id: int = 1,
    dataset: str = "generic",
) -> DataFrame:
    """Kept series (see ``describe_series``) to manifest rows with ``directory`` and ``error``; a failed series keeps its number.

    The kept series are used twice, so they are stored once and the slices are not counted again.  Labels and case
    ids are worked out once per patient, on a small table of its own, and joined back once.
    """
    kept = cut_lineage(kept)
    patients = cut_lineage(
        kept.groupBy("patient_id").agg(F.min("series_ord").alias("first_seen"), F.count("*").alias("n_series"))
    )
    n_patients = patients.count()
    mapped = class_labels.select("patient_id", F.col("case_id").alias("mapped_case"))
    patients = lookup_group(patients, class_labels).join(mapped, "patient_id", "left")
    patients = cut_lineage(
        assign_case_ids(attach_alias_labels(patients, aliases), start_case_id, n_patients).drop("mapped_case")
    )
    largest_case = patients.groupBy("case_id").agg(F.sum("n_series").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = series_numbers(spread_join(kept, patients, "patient_id", ["series_ord"]), largest_case)
    protocol = text.detect_protocol(F.col("tags"), F.col("directory"))
    columns = {name: F.col(f"_m.{name}") for name in [*fixed.METADATA_TAGS, "age_at_scan"]} | {
        "modality": F.col("modality"),
        "phase": F.col("_p.phase"),
        "phase_source": F.col("_p.source"),
        "spacing_quality": F.col("severity"),
        "dataset_type": F.lit(dataset),
        "output_path": F.col("filename"),
        "validation": F.lit("ok"),
        "conversion_date": F.current_timestamp().cast("string"),
    }
    columns["error"] = F.col("error") if "error" in kept.columns else F.lit(None).cast("string")
    for name in ("spacing_x", "spacing_y", "spacing_z"):
        columns[name] = F.col(name) if name in kept.columns else F.lit(None).cast("double")
    for name in ("dim_x", "dim_y", "dim_z"):
        columns[name] = F.col(name) if name in kept.columns else F.lit(None).cast("int")
    read = rows.withColumns({"_p": protocol, "_m": select_metadata(F.col("tags"))})
    return read.withColumns(columns).select("series_ord", *MANIFEST_COLUMNS, "directory", "error")


def manifest_from_image_headers(headers: DataFrame, suffix: str = "_0000.nii.gz", pattern: str | None = None) -> DataFrame:
    """Fallback manifest from ``filename, meta, spacing, dims, direction``; missing is NULL."""
    meta, name = F.col("meta"), F.col("filename")
    stem = F.when(name.endswith(suffix), F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(
        F.regexp_replace(name, r"\.[^.]*$", "")
    )
    case = text.header_value(
        meta, "CaseID", text.patient_id_from_case(F.regexp_replace(stem, "_0000$", ""), pattern)
    )
    phase = text.detect_phase_embedded(meta, name)
    value = lambda key: text.header_value(meta, key)
    missing = F.lit(None).cast("string")
    return headers.select(
        "filename",
        text.header_value(meta, "PatientID", case).alias("patient_id"),
        case.alias("case_id"),
        text.normalize_class(text.header_value(meta, "AssignedClass", F.lit("NG"))).alias("group"),
        phase["phase"].alias("phase"),
        phase["source"].alias("phase_source"),
        text.scan_index(name).alias("scan_idx"),
        value("Modality").alias("modality"),
        geometry.scan_plane_from_direction(F.col("direction")).alias("scan_plane"),
        geometry.direction_to_string(F.col("direction")).alias("image_orientation"),
        F.lit("unknown").alias("spacing_quality"),
        *[missing.alias(c) for c in ("nonuniformity_mm", "sex", "DOB", "age", "age_at_scan")],
        text.format_dicom_date(value("StudyDate")).alias("DOS"),
        text.format_dicom_time(value("StudyTime")).alias("study_time"),
        value("SeriesDescription").alias("series_description"),
        value("SeriesNumber").alias("series_number"),
        value("Manufacturer").alias("manufacturer"),
        value("ManufacturerModelName").alias("manufacturer_model"),
        value("InstitutionName").alias("institution"),
        value("KVP").alias("kvp"),
        value("ContrastBolusAgent").alias("contrast_agent"),
        *[F.col("spacing")[i].alias(f"spacing_{a}") for i, a in enumerate("xyz")],
        *[F.col("dims")[i].alias(f"dim_{a}") for i, a in enumerate("xyz")],
        value("SliceThickness").alias("slice_thickness"),
        F.get(F.col("dims"), F.lit(2)).alias("num_slices"),
        value("ConversionDate").alias("conversion_date"),
        text.header_value(meta, "DatasetType", F.lit("generic")).alias("dataset_type"),
        name.alias("output_path"),
        F.lit("generated").alias("validation"),
        phase["source"].alias("protocol_source"),
        F.lit("").alias("Laterality"),
        F.lit("").alias("Tumor"),
    )


# ---- reports ---------------------------------------------------------------------------------------------


def discovery_stats(series: DataFrame) -> DataFrame:
    """Counts by plane, modality (missing left out), quality and id source, of the series that could be read."""
    stats = F.array(
        *[
            F.struct(F.lit(stat).alias("stat"), F.col(column).alias("value"))
            for stat, column in [
                ("scan_plane", "scan_plane"),
                ("modality", "modality"),
                ("quality", "severity"),
                ("pid_source", "pid_source"),
            ]
        ]
    )
    # fold to the four values first, so that at most one row per combination is exploded
    read = series.where(readable(series)) if "tags" in series.columns else series
    folded = read.groupBy("scan_plane", "modality", "severity", "pid_source").agg(F.count("*").alias("n"))
    return (
        folded.select("n", F.inline(stats))
        .where("value is not null")
        .groupBy("stat", "value")
        .agg(F.sum("n").alias("n"))
    )


def duplicate_patients(series: DataFrame) -> DataFrame:
    """Patients under more than one root folder."""
    roots = series.select("patient_id", "root").distinct()
    return (
        roots.groupBy("patient_id")
        .agg(F.count("*").alias("n_roots"), F.array_join(F.sort_array(F.collect_set("root")), ",").alias("roots"))
        .where("n_roots > 1")
    )


def label_report(labels: DataFrame, aliases: DataFrame, manifest: DataFrame, ord_column: str = "ord") -> DataFrame:
    """How the alias labels met the manifest, as ``section, item, n``: totals, and the keys that several label rows claim."""
    hits = manifest.where(F.col("label_source") != "").agg(F.countDistinct("patient_id").alias("n"))
    total = lambda item, counted: counted.select(F.lit("label").alias("section"), F.lit(item).alias("item"), F.col("n").cast("bigint").alias("n"))
    left = unmatched_labels(labels, aliases, manifest, ord_column)
    rows = [
        total("labels_loaded", labels.agg(F.count("*").alias("n"))),
        total("label_keys_loaded", aliases.agg(F.count("*").alias("n"))),
        total("matched_patients", hits),
        total("unmatched_rows", left.agg(F.count("*").alias("n"))),
        aliases.where("n_rows > 1").select(F.lit("duplicate_label_key").alias("section"), F.col("alias").alias("item"), F.col("n_rows").cast("bigint").alias("n")),
    ]
    return reduce(DataFrame.unionByName, rows)


def conversion_summary(
    manifest: DataFrame,
    skipped: DataFrame,
    failures: DataFrame | None = None,
    series: DataFrame | None = None,
    label_rows: DataFrame | None = None,
) -> DataFrame:
    """Totals and distributions as ``section, item, n``.

    ``series`` (all described series) adds the discovery statistics and the patients under several roots, ``label_rows`` (see
    ``label_report``) the label counts.  Lists of failed, skipped and unmatched rows are tables of their own.
    """
    counted = lambda df, item: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(item).alias("item"), "n")
    # A group of one folded row per (group, phase) gives all distributions; patients are counted once.
    folded = manifest.groupBy("group", "phase", "validation").agg(F.count("*").alias("n"))
    spread = folded.select(
        F.inline(
            F.array(
                F.struct(F.lit("group").alias("section"), F.col("group").alias("item"), "n"),
                F.struct(F.lit("phase").alias("section"), F.col("phase").alias("item"), "n"),
                F.struct(F.lit("total").alias("section"), F.lit("total_series_discovered").alias("item"), "n"),
                F.struct(F.lit("total").alias("section"), F.lit("successful_conversions").alias("item"), F.when(F.col("validation") == "ok", F.col("n")).otherwise(0).alias("n")),
            )
        )
    )
    patients = manifest.agg(F.countDistinct("patient_id").alias("n")).select(F.lit("total").alias("section"), F.lit("total_patients").alias("item"), "n")
    # Totals stand in the report even if they are 0; skipped series count as discovered too.
    zeros = manifest.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(k).alias("item"), F.lit(0).cast("bigint").alias("n")) for k in SUMMARY_TOTALS]))
    )
    rows = [zeros, spread, patients, counted(skipped, "skipped_series"), counted(skipped, "total_series_discovered")]
    if failures is not None:
        rows.append(counted(failures, "failed_conversions"))
    if series is not None:
        stats = discovery_stats(series).select(F.concat(F.lit("stat_"), "stat").alias("section"), F.col("value").alias("item"), "n")
        twice = duplicate_patients(series.where(readable(series)))
        rows += [stats, twice.select(F.lit("duplicate_patient").alias("section"), F.col("patient_id").alias("item"), F.col("n_roots").alias("n"))]
    if label_rows is not None:
        rows.append(label_rows)
    return reduce(DataFrame.unionByName, rows).groupBy("section", "item").agg(F.sum("n").alias("n"))


def skipped_details(skipped: DataFrame, top: int | None = None) -> DataFrame:
    """All skipped series, or the first ``top`` in discovery order for a short report."""
    rows = skipped if top is None else skipped.orderBy("series_ord").limit(top)
    return rows.select("series_ord", "patient_id", "series_uid", "directory", "reason")


def phase_filter(df: DataFrame, phase: str | None, column: str = "phase") -> DataFrame:
    """One phase; ``None`` or ``all`` keep every row."""
    if phase is None or phase.lower() == "all":
        return df
    return df.where(F.lower(F.col(column)) == phase.lower())


