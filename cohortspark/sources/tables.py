"""Reading and writing the study's files: label tables, manifests, catalogs, splits, histories, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions import text
from cohortspark.session import staging_path

BOM = "﻿"

_DOUBLES = {"nonuniformity_mm", "age_at_scan", "spacing_x", "spacing_y", "spacing_z"}
_INTS = {"scan_idx", "dim_x", "dim_y", "dim_z", "num_slices"}


def manifest_schema(columns: Sequence[str]) -> T.StructType:
    def kind(c):
        return T.DoubleType() if c in _DOUBLES else T.IntegerType() if c in _INTS else T.StringType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


LESION_SCHEMA = (
    "case_id string, voi_id string, laterality string, mask_path string, image_path string, lesion_id bigint, "
    "num_lesions_in_voi bigint, voi_shape array<int>, coordinates_reference string, full_volume_coordinates_available boolean, "
    "volume_vox bigint, volume_mm3 double, centroid_vox array<double>, centroid_mm array<double>, bbox_min_vox array<int>, "
    "bbox_max_vox array<int>, bbox_size_vox array<int>, bbox_size_mm array<double>, max_extent_vox int, max_extent_mm double, "
    "kidney_overlap_vox bigint, kidney_contact_vox bigint, kidney_contact_ratio double, size_bin string, warnings array<string>"
)


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every cell cleaned to text; a byte order mark before the first header is dropped.

    ``ord`` keeps the file order: file name, then position in the file.  A quoted cell may hold line breaks, so a
    file is read by one task from start to end and positions in it increase.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position"))
    cells = [text.clean_cell(F.col(f"`{c}`")).alias(c.removeprefix(BOM)) for c in rows.columns]
    return rows.select(place.alias("ord"), *cells)


def write_manifest(manifest: DataFrame, path: str, fmt: str = "parquet", partition: bool = False) -> bool:
    """Write a manifest, unless it is empty; CSV shows missing values as ``nan``.  Tells whether it wrote.

    The rows are staged first, so the test for emptiness does not work them out a second time.
    """
    spark = manifest.sparkSession
    staged = staging_path(spark, "manifest")
    manifest.write.parquet(staged)
    rows = spark.read.schema(manifest.schema).parquet(staged)
    if rows.isEmpty():
        return False
    writer = rows.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy("group", "phase")
    if fmt == "csv":
        writer.csv(path, header=True, nullValue="nan")
    else:
        writer.parquet(path)
    return True


def read_manifest(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(manifest_schema(columns)).csv(path, header=True, nullValue="nan")
    return spark.read.parquet(path)


def write_lesions(lesions: DataFrame, path: str) -> None:
    """One JSON object per line; NULL fields are written too."""
    lesions.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_lesions(spark: SparkSession, path: str) -> DataFrame:
    """Lesion lines; blank lines are skipped."""
    return spark.read.schema(LESION_SCHEMA).json(path)


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("fold").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("fold", F.col("fold").cast("int"))


def json_report(row: DataFrame) -> DataFrame:
    """One JSON text per row, for ``write.text``."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("value"))


def history_json(history: DataFrame) -> DataFrame:
    """Per tag one line ``tag, series`` with points in epoch order.

    A tag has one point per epoch, so a line is as long as the run has epochs.
    """
    points = F.sort_array(F.collect_list(F.struct("epoch", "value")))
    return history.groupBy("tag").agg(F.to_json(points).alias("series"))


def history_points(lines: DataFrame) -> DataFrame:
    """Points back from ``history_json`` lines; points without epoch or number are dropped."""
    parsed = F.from_json("series", "array<struct<epoch:string,value:string>>")
    rows = lines.select("tag", F.inline(parsed))
    return rows.select(
        "tag", F.col("epoch").try_cast("int").alias("epoch"), F.col("value").try_cast("double").alias("value")
    ).where("epoch is not null and value is not null")


# Sections by channel, with the name of the channel that is preferred; else their first channel counts.
_CHANNEL_SECTIONS = (
    ("windowed_intensity", "channel_0"),
    ("foreground_intensity_properties_per_channel", "0"),
    ("foreground_intensity", "channel_0"),
)
_PLAIN_SECTIONS = ("$.dataset_statistics", "$.intensity_properties", "$.foreground_intensity_properties", "$")


def read_fingerprint_stats(payload: Column) -> dict[str, Column]:
    """``mean, std, median, p25, p75`` of a fingerprint JSON text of any version.

    The first section that exists is used.  A percentile of 0 under an older name gives way to the next name.
    """

    def channel(name, preferred):
        found = F.from_json(F.get_json_object(payload, f"$.{name}"), "map<string,string>")
        return F.coalesce(F.try_element_at(found, F.lit(preferred)), F.get(F.map_values(found), F.lit(0)))

    sections = [channel(*s) for s in _CHANNEL_SECTIONS] + [F.get_json_object(payload, p) for p in _PLAIN_SECTIONS]
    section = F.coalesce(*[text.blank_to_null(F.nullif(s, F.lit("{}"))) for s in sections])

    def number(*names):
        found = [F.get_json_object(section, f"$.{n}").try_cast("double") for n in names]
        choices = [F.nullif(f, F.lit(0.0)) for f in found[:-1]] + [found[-1]]
        name = names[-1]
        return F.coalesce(*choices, F.raise_error(F.lit(f"fingerprint has no {name}")).cast("double"))

    return {
        "mean": number("mean"),
        "std": number("std"),
        "median": number("median"),
        "p25": number("percentile_25_0", "percentile_25", "p25"),
        "p75": number("percentile_75_0", "percentile_75", "p75"),
    }
