"""File tables, pairing, preprocessing reports and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import text
from cohortspark.scale import exact_percentiles, last_per_key, numbered, shuffled, spread_join


def _without_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def below(files: DataFrame, folder: str) -> DataFrame:
    """Rows under ``folder/`` with their relative path ``rel``."""
    prefix = folder.rstrip("/") + "/"
    return files.where(F.col("path").startswith(prefix)).withColumn(
        "rel", F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    )


def scan_vois(files: DataFrame, suffix: str = ".npy") -> DataFrame:
    """Mask files with their image, if there is one, and the ids taken from the path."""
    masks = below(files, "mask").where(F.col("rel").endswith(suffix)).select("rel")
    images = below(files, "images").select("rel", F.lit(True).alias("has_image"))
    parts = F.split("rel", "/")
    lat = text.parse_laterality(_without_suffix(text.base_name(F.col("rel"))))
    prefix = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "__")
    return masks.join(shuffled(images), "rel", "left").select(
        F.when(prefix == "", lat["stem"]).otherwise(F.concat(prefix, F.lit("__"), lat["stem"])).alias("case_id"),
        _without_suffix(F.col("rel")).alias("voi_id"),
        lat["side"].alias("laterality"),
        F.col("rel").alias("mask_path"),
        F.when(F.col("has_image"), F.col("rel")).alias("image_path"),
    )


def index_vois(files: DataFrame, manifest: DataFrame | None = None, phase: str | None = None) -> DataFrame:
    """Image and mask pairs for the radiomics study, with class, case, phase and, if given, manifest columns.

    A pair takes the manifest row of its own file: the last one whose ``filename``, without the image suffix, is the
    pair's name without its side.  Manifest columns that the pair has too are left out.
    """
    parts = F.split("mask_path", "/")
    rows = scan_vois(files).where(F.col("image_path").isNotNull()).select(
        F.col("voi_id").alias("sample_id"),
        F.get(parts, F.lit(0)).alias("class_raw"),
        F.get(parts, F.lit(1)).alias("patient_id"),
        F.lower(F.get(parts, F.lit(2))).alias("contrast_phase"),
        F.col("laterality").alias("side"),
        "image_path",
        "mask_path",
        text.parse_laterality(_without_suffix(text.base_name(F.col("image_path"))))["stem"].alias("_stem"),
    )
    if phase is not None and phase != "all":
        rows = rows.where(F.col("contrast_phase") == phase)
    if manifest is None:
        return rows.drop("_stem")
    named = manifest_by_filename(manifest).drop(*[c for c in rows.columns if c in manifest.columns])
    stem = F.regexp_replace("filename", r"(_0000)?\.nii(\.gz)?$", "")
    named = last_per_key(named.withColumn("_stem", stem), ["_stem"], F.col("filename"))
    return rows.join(named, "_stem", "left").drop("_stem")


def patient_files(files: DataFrame, folder: str = "images", suffix: str = ".npy") -> DataFrame:
    """``class, patient_id, path`` of files at least two folders deep."""
    parts = F.split("rel", "/")
    return (
        below(files, folder)
        .where(F.col("rel").endswith(suffix) & (F.size(parts) >= 3))
        .select(parts[0].alias("class"), parts[1].alias("patient_id"), "path")
    )


def scan_patients(files: DataFrame, folder: str = "images") -> DataFrame:
    """One row per patient: class of the last path, number of files, first path (the order of appearance).

    The files themselves stay in long form, see ``patient_files`` and ``gather_files``.
    """
    return (
        patient_files(files, folder)
        .groupBy("patient_id")
        .agg(F.max_by("class", "path").alias("class"), F.count("*").alias("n_files"), F.min("path").alias("first_path"))
    )


def gather_files(ids: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the listed patients (``patient_id`` and further columns)."""
    return spread_join(files.select("patient_id", "path"), ids, "patient_id", ["path"])


def discover_review_cases(files: DataFrame, phase: str = "ALL") -> DataFrame:
    """Images in the exact class/patient/phase/file layout with mask path and key."""
    parts = F.split("rel", "/")
    rows = (
        below(files, "images")
        .where((F.size(parts) == 4) & F.col("rel").endswith(".npy"))
        .select(
            parts[0].alias("class"),
            parts[1].alias("patient_id"),
            F.upper(parts[2]).alias("protocol"),
            parts[3].alias("filename"),
            F.col("path").alias("image_path"),
            F.concat(F.lit("mask/"), "rel").alias("mask_path"),
            F.col("rel").alias("key"),
        )
    )
    return rows if phase == "ALL" else rows.where(F.col("protocol") == phase.upper())


def manifest_by_filename(manifest: DataFrame, order: str = "ord") -> DataFrame:
    """One row per file name, the last one; rows without a name are left out."""
    named = manifest.where(F.coalesce("filename", F.lit("")) != "")
    return last_per_key(named, ["filename"], F.col(order)).drop(order)


def pair_images_masks(
    images: DataFrame,
    masks: DataFrame,
    manifest: DataFrame | None = None,
    image_suffix: str = "_0000.nii.gz",
    mask_suffix: str = ".nii.gz",
    pattern: str | None = None,
    require: bool = False,
) -> DataFrame:
    """Images (``filename``) with their mask (``filename``), group and phase of the manifest, or defaults.

    With ``require`` an empty result is an error.
    """
    stem = F.replace(F.col("filename"), F.lit(image_suffix), F.lit(""))
    derived = images.select("filename", stem.alias("case_name")).withColumn(
        "mask_name", F.concat(F.regexp_replace("case_name", "_0000$", ""), F.lit(mask_suffix))
    )
    pairs = derived.join(masks.select(F.col("filename").alias("mask_name")).distinct(), "mask_name")
    if manifest is None:
        pairs = pairs.withColumns({c: F.lit(None).cast("string") for c in ("group", "phase", "case_id")})
    else:
        pairs = pairs.join(manifest.select("filename", "group", "phase", "case_id"), "filename", "left")
    if require and pairs.isEmpty():
        raise ValueError("no image has a mask")
    pid = text.patient_id_from_case(F.col("case_name"), pattern)

    def given(column, default):
        return F.coalesce(text.blank_to_null(text.strip(F.col(column))), default)

    return pairs.select(
        "case_name",
        given("group", F.lit("NG")).alias("group"),
        given("phase", F.lit("undefined")).alias("phase"),
        F.col("filename").alias("image_name"),
        "mask_name",
        pid.alias("patient_id"),
        given("case_id", pid).alias("case_id"),
    )


def target_spacing(
    spacings: DataFrame,
    mode: str = "anisotropic",
    z_coarse: float = 2.0,
    fixed: Sequence[float] | None = None,
    max_samples: int | None = None,
) -> DataFrame:
    """One row ``x, y, z``: fixed, or from the exact median of all spacings (``ord, sx, sy, sz``).

    ``max_samples`` takes the first so many spacings in place of all.
    """
    if fixed is not None:
        return spacings.sparkSession.range(1).select(*[F.lit(float(v)).alias(a) for a, v in zip("xyz", fixed)])
    sample = spacings if max_samples is None else spacings.orderBy("ord").limit(max_samples)
    # Headers share few different spacings, so they are counted by value before the median is taken.
    med = exact_percentiles(sample, [], {a: F.col(f"s{a}") for a in "xyz"}, {"mid": 50.0})
    med = med.select(*[F.col(f"{a}_mid").alias(a) for a in "xyz"])
    least = F.least("x", "y", "z")
    if mode == "isotropic":
        return med.select(*[least.alias(a) for a in "xyz"])
    sharper = F.greatest(F.least("z", F.lit(1.0)), F.least("x", "y"))
    return med.select("x", "y", F.when(F.col("z") > z_coarse, sharper).otherwise(F.col("z")).alias("z"))


def case_key(c: Column) -> Column:
    return F.coalesce(text.blank_to_null(F.regexp_extract(c, r"case_\d{5}", 0)), c)


def update_manifest_laterality(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """``Laterality`` and ``Tumor`` per manifest row from side results (``patient_id, side, status, has_tumor``)."""
    ok = F.col("status") == "ok"
    info = results.groupBy(F.col("patient_id").alias("_pid")).agg(
        F.coalesce(F.bool_or(ok & (F.col("side") == "L")), F.lit(False)).alias("_l"),
        F.coalesce(F.bool_or(ok & (F.col("side") == "R")), F.lit(False)).alias("_r"),
        F.coalesce(F.bool_or(ok & F.col("has_tumor")), F.lit(False)).alias("_t"),
    )
    rows = manifest.withColumn("_pid", case_key(F.col("case_id"))).join(info, "_pid", "left")
    side = (
        F.when(F.col("_l") & F.col("_r"), "Both").when(F.col("_l"), "L").when(F.col("_r"), "R").otherwise("")
    )
    tumor = F.when(F.col("_t").isNull(), "").when(F.col("_t"), "Yes").otherwise("No")
    return rows.withColumns({"Laterality": side, "Tumor": tumor}).drop("_pid", "_l", "_r", "_t")


def patient_comments(results: DataFrame) -> DataFrame:
    """All comments in long form: ``patient_id, late, ord, comment``.

    Status ``error`` is a reported problem, ``failed`` a case that broke off, which adds a closing comment.
    """
    status = F.col("status")
    first = F.when(status.isin("error", "failed"), F.concat(F.lit("Error: "), "reason")).when(
        status == "skipped", F.concat("side", F.lit(": "), "reason")
    )
    closing = F.when(status == "failed", "Processing failed")
    said = F.array(
        F.struct(F.lit(0).alias("late"), first.alias("comment")), F.struct(F.lit(1).alias("late"), closing.alias("comment"))
    )
    return results.select("patient_id", "ord", F.inline(said)).where("comment is not null")


def patient_preprocess(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Per-case report: series and phase counts, first equipment, tumour sides, status, comments.

    The cell has all comments of the case in the order of its results, then those of results that broke off;
    ``patient_comments`` has them in long form.  ``manifest`` needs ``ord``.
    """
    phase = F.lower("phase")
    series = manifest.groupBy(F.col("case_id").alias("patient_id")).agg(
        F.min_by("patient_id", "ord").alias("TCGA_ID"),
        F.count("*").alias("N_Series"),
        *[F.count_if(phase == p).alias(f"N_{p.upper()}") for p in ("art", "ven", "delay", "undefined")],
        F.min_by(F.struct("manufacturer", "manufacturer_model", "institution"), "ord").alias("_eq"),
    )
    ok, tumor = F.col("status") == "ok", F.col("has_tumor")
    outcome = results.groupBy("patient_id").agg(
        F.bool_or(ok & tumor & (F.col("side") == "R")).alias("RTumor"),
        F.bool_or(ok & tumor & (F.col("side") != "R")).alias("LTumor"),
        F.bool_or(ok).alias("_ok"),
        F.bool_or(F.col("status") == "skipped").alias("_skipped"),
        F.bool_or(F.col("status").isin("error", "failed")).alias("_error"),
    )
    comments = (
        patient_comments(results)
        .groupBy("patient_id")
        .agg(F.sort_array(F.collect_list(F.struct("late", "ord", "comment"))).alias("said"))  # of one patient
        .select("patient_id", F.array_join(F.col("said.comment"), "; ").alias("Comments"))
    )
    status = (
        F.when(F.col("_error") & ~F.col("_ok"), "Fail")
        .when(F.col("_skipped"), "Warning")
        .when(F.col("_ok"), "Pass")
        .otherwise("Fail")
    )
    blank = F.lit("")
    return (
        outcome.join(series, "patient_id", "left")
        .join(comments, "patient_id", "left")
        .select(
            F.coalesce("TCGA_ID", blank).alias("TCGA_ID"),
            F.col("patient_id").alias("CaseID"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("N_Series", "N_ART", "N_VEN", "N_DELAY", "N_UNDEFINED")],
            "RTumor",
            "LTumor",
            F.coalesce("_eq.manufacturer", blank).alias("Manufacturer"),
            F.coalesce("_eq.manufacturer_model", blank).alias("ManufacturerModel"),
            F.coalesce("_eq.institution", blank).alias("Institution"),
            status.alias("Status"),
            F.coalesce("Comments", blank).alias("Comments"),
        )
    )


def dataset_registry(results: DataFrame) -> DataFrame:
    """Per patient: group, sides, phases, case and file counts, PASS or FAIL."""
    ok = F.col("status") == "ok"
    # two files, mask and image, are saved per finished side
    return results.groupBy("patient_id").agg(
        F.coalesce(text.blank_to_null(F.min_by("grp", "ord")), F.lit("NG")).alias("group"),
        F.count_distinct("case_name").alias("n_cases"),
        F.array_sort(F.collect_set(F.when(ok, F.col("side")))).alias("kidneys"),
        F.array_sort(F.collect_set(text.blank_to_null(F.col("phase")))).alias("phases"),
        F.count_if(ok).alias("n_mask_files"),
        F.count_if(ok).alias("n_image_files"),
        F.when(F.bool_or(ok), "PASS").otherwise("FAIL").alias("status"),
    )


def registry_totals(registry: DataFrame, results: DataFrame) -> DataFrame:
    return registry.agg(
        F.count_if(F.col("status") == "PASS").alias("num_cases"),
        F.count("*").alias("num_patients"),
        F.sum("n_mask_files").alias("num_mask_files"),
        F.sum("n_image_files").alias("num_image_files"),
    ).withColumn("num_failed", results.agg(F.count_if(F.col("status") == "failed").alias("n")).scalar())


def registry_cases(results: DataFrame) -> DataFrame:
    """The cases of every patient, one row each, with their first place in the results and whether a side was finished."""
    return results.groupBy("patient_id", "case_name").agg(
        F.min("ord").alias("first_ord"), F.coalesce(F.bool_or(F.col("status") == "ok"), F.lit(False)).alias("finished")
    )


def registry_files(results: DataFrame) -> DataFrame:
    """The files of every patient, one row each: a mask and an image per finished side."""
    kinds = F.explode(F.array(F.lit("mask"), F.lit("images")))
    saved = results.where("status = 'ok'").select("patient_id", "case_name", "side", "grp", "phase", kinds.alias("kind"))
    path = text.voi_output_path(F.col("kind"), F.col("grp"), F.col("patient_id"), F.col("phase"), F.col("case_name"), F.col("side"))
    return saved.select("patient_id", "case_name", "side", "kind", path.alias("path"))


def registry_outcomes(registry: DataFrame, results: DataFrame) -> DataFrame:
    """``outcome, name, detail``: patients that passed, and failed sides by case with the reason given."""
    passed = registry.where("status = 'PASS'").select(
        F.lit("success").alias("outcome"), F.col("patient_id").alias("name"), F.lit(None).cast("string").alias("detail")
    )
    failed = results.where("status = 'failed'").select(
        F.lit("failed").alias("outcome"), F.col("case_name").alias("name"), F.col("reason").alias("detail")
    )
    return passed.unionByName(failed)


def _coverage() -> Column:
    n = F.size("phases")
    return F.when(n > 1, "multi").when(n == 1, "single").otherwise("none")


def phase_coverage(registry: DataFrame) -> DataFrame:
    """Number of patients with several, one or no phase."""
    return registry.groupBy(_coverage().alias("coverage")).agg(F.count("*").alias("n_patients"))


def phase_coverage_patients(registry: DataFrame) -> DataFrame:
    """``coverage, patient_id, phases``: who has several, one or no phase, and which."""
    return registry.select(_coverage().alias("coverage"), "patient_id", "phases")


def training_index(files: DataFrame, shapes: DataFrame | None = None, voi_root: str = "") -> DataFrame:
    """Per image file: mask path, category, phase code and catalog key.

    ``shapes`` (``path, shape``) adds the check that image and mask have one shape; a mismatch and a file without
    shape fail the job.
    """
    root = f"{voi_root.rstrip('/')}/" if voi_root else ""
    path = F.col("path")
    rows = files.select(
        "path",
        F.replace(path, F.lit("images"), F.lit("mask")).alias("mask_path"),
        text.collapse_class(text.class_from_path(path), strict=True).alias("label"),
        text.phase_code(F.get(F.reverse(F.split(path, "/")), F.lit(1))).alias("phase"),
    ).withColumn("catalog_key", text.catalog_key(F.col("mask_path"), f"{root}mask"))
    if shapes is None:
        return rows
    image = shapes.select("path", F.col("shape").alias("_i"))
    mask = shapes.select(F.col("path").alias("mask_path"), F.col("shape").alias("_m"))
    checked = rows.join(image, "path", "left").join(mask, "mask_path", "left")
    fault = F.when(F.col("_i").isNull() | F.col("_m").isNull(), "no shape of image or mask: ").otherwise(
        "image and mask shape differ: "
    )
    # a filter, as a column that nobody reads would be pruned together with its check
    same = F.when(F.col("_i") == F.col("_m"), F.lit(True)).otherwise(F.raise_error(F.concat(fault, "path")).cast("boolean"))
    return checked.where(same).drop("_i", "_m")


def review_order(cases: DataFrame) -> DataFrame:
    """Review cases with their position in path order."""
    return numbered(cases, [], [F.col("key")], "position")
