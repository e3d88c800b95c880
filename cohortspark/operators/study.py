"""The radiomics study as one job: index of VOIs, features of their voxels, cohort, missing values, group comparison."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import radiomics as rad
from cohortspark.scale import shuffled
from cohortspark.session import staged


@dataclass(frozen=True)
class StudyOptions:
    """``digits``: decimals of patient means, so that means that differ by the order of a sum only are ties."""

    label: int = 2
    hu_range: tuple[float, float] = rad.RANGE
    bin_width: float = rad.BIN_WIDTH
    max_missing: float = 0.2
    groups: tuple[str, str] = ("A", "B")
    digits: int = 6


def indexed_volumes(index: DataFrame, keys: DataFrame, volumes: DataFrame) -> DataFrame:
    """Index rows with the ``voi_id`` of their volume: ``keys`` has ``mask_path, voi_id``.

    Index rows without a volume are left out, repeated ones count once.
    """
    return index.distinct().join(shuffled(keys), "mask_path").join(shuffled(volumes.select("voi_id")), "voi_id", "left_semi")


def feature_families(voxels: DataFrame, volumes: DataFrame, options: StudyOptions = StudyOptions()) -> dict[str, DataFrame]:
    """All feature tables by family, one row per ``voi_id``.

    The voxel table is read once: the region is stored, and its levels after that; every family starts from these two.
    """
    region = staged(voxels.where(F.col("label") == options.label).select("voi_id", *rad.AXES, "hu", "label"), "region")
    roi = rad.roi_voxels(region, options.label, options.hu_range)
    levels = staged(rad.discretize(roi, options.bin_width), "levels")
    return {
        "firstorder": rad.firstorder_features(roi, volumes, options.bin_width).drop("n"),
        "shape": rad.shape_features(region, volumes, options.label).drop("n"),
        "glcm": rad.glcm_feature_table(rad.glcm_counts(levels), rad.largest_level(levels)),
        "glrlm": rad.emphasis_features(rad.glrlm_counts(levels), "length", ["direction"]),
        "glszm": rad.emphasis_features(rad.glszm_counts(levels), "size"),
        "gldm": rad.emphasis_features(rad.gldm_counts(levels), "dependence"),
        "ngtdm": rad.ngtdm_features(rad.ngtdm_counts(levels)),
    }


def feature_table(index: DataFrame, families: Mapping[str, DataFrame]) -> DataFrame:
    """Index rows beside all features, named ``family_feature``; a VOI without a feature has NULL there.

    The tables have one row per VOI.  It is stored, as names of columns depend on its shares of missing values.
    """
    rows = index
    for name, features in families.items():
        renamed = features.select("voi_id", *[F.col(c).cast("double").alias(f"{name}_{c}") for c in features.columns if c != "voi_id"])
        rows = rows.join(shuffled(renamed), "voi_id", "left")
    return staged(rows.drop("voi_id"), "features")


def study_rows(table: DataFrame, options: StudyOptions = StudyOptions()) -> DataFrame:
    """Patient means as ``patient_id, group_label, contrast_phase, feature, value`` of the features that are kept."""
    kept = rad.missingness_filter(table, options.max_missing)
    cohort = rad.patient_cohort(rad.merge_groups(kept, keep=options.groups))
    features = [c for c in rad.feature_columns(kept)]
    rounded = cohort.withColumns({c: F.round(c, options.digits) for c in features})
    return rad.unpivot(rounded, features)


def run_study(
    index: DataFrame, keys: DataFrame, voxels: DataFrame, volumes: DataFrame, options: StudyOptions = StudyOptions()
) -> tuple[DataFrame, DataFrame]:
    """The comparison of the two groups and the description of each, from VOI index and voxels."""
    found = staged(indexed_volumes(index, keys, volumes), "index")
    studied = voxels.join(shuffled(found.select("voi_id")), "voi_id", "left_semi")
    rows = staged(study_rows(feature_table(found, feature_families(studied, volumes, options)), options), "study")
    return rad.compare_groups(rows, *options.groups), rad.describe_groups(rows)
