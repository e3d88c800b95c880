"""Study tables derived from the star-schema test tables (see FIXTURES.md).

Each text is a SELECT that Spark SQL and DuckDB both run, so a query and its check start from the same rows.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.scale import spread

SHARED = {
    "series": """
select o_orderkey as series_ord,
  concat('1.2.840.', cast(o_orderkey as string)) as series_uid,
  case when o_custkey % 5 = 0 then '' else concat('TCGA-B', cast(o_custkey % 10 as string), '-', lpad(cast(o_custkey as string), 4, '0')) end as tag_patient_id,
  concat('root', cast(o_orderkey % 3 as string), '/TCGA-B', cast(o_custkey % 10 as string), '-', lpad(cast(o_custkey as string), 4, '0'), '/', cast(o_orderkey as string)) as directory,
  case when o_orderkey % 17 = 0 then 'SEG' else 'CT' end as modality,
  case o_orderkey % 12 when 0 then 'ARTERIAL PHASE' when 1 then 'Portal-Venous 70 sec' when 2 then 'W/O contrast'
    when 3 then 'delayed 5 min' when 4 then 'late arterial chest' when 5 then 'abd 30 sec' when 6 then 'abd 90 sec'
    when 7 then 'AXIAL' when 8 then 'MPR coronal' when 9 then 'nephro_phase' when 10 then 'abd 12 min' else '' end as series_description,
  replace(case o_orderkey % 4 when 0 then '1|0|0|0|1|0' when 1 then '1|0|0|0|0|1' when 2 then '' else '0.7|0.7|0|0|0.7|0.7' end, '|', chr(92)) as iop_raw,
  replace(cast(cast(o_orderdate as date) as string), '-', '') as study_date,
  concat(cast(1930 + o_custkey % 60 as string), '0615') as birth_date,
  case o_orderkey % 23 when 0 then 60.0E0 when 1 then 12.5E0 when 2 then 3.0E0 else null end as nonuniformity_mm,
  case o_custkey % 3 when 0 then 'F' when 1 then ' M ' else '' end as sex,
  case when o_custkey % 4 = 0 then '' else concat('0', cast(20 + o_custkey % 60 as string), 'Y') end as age,
  case when o_orderkey % 5 = 0 then '10' else concat(lpad(cast(o_orderkey % 24 as string), 2, '0'), '3015.250') end as study_time,
  cast(o_orderkey % 9 as string) as series_number,
  case o_orderkey % 3 when 0 then 'MAKER ONE' when 1 then ' MAKER TWO ' else '' end as manufacturer,
  concat('Model ', cast(o_custkey % 5 as string)) as manufacturer_model,
  case when o_custkey % 6 = 0 then '' else concat('Site ', cast(o_custkey % 6 as string)) end as institution,
  case o_orderkey % 4 when 0 then '120' when 1 then '100' else '' end as kvp,
  case when o_orderkey % 7 = 0 then 'APPLIED' else '' end as contrast_agent,
  case o_orderkey % 5 when 0 then '5.0' when 1 then '1.25' else '2' end as slice_thickness,
  case when o_orderkey % 31 = 0 then replace('0.8|x|1', '|', chr(92)) when o_orderkey % 29 = 0 then '0.8'
    else replace(concat('0.8|0.75|', cast(1 + o_orderkey % 4 as string)), '|', chr(92)) end as spacing_raw,
  case when o_orderkey % 37 = 0 then 'truncated file' end as read_error
from {orders}""",
    "slices": """
select concat('1.2.840.', cast(l_orderkey as string)) as series_uid, l_linenumber as slice_ord,
  concat('root', cast(l_orderkey % 3 as string), '/', cast(l_orderkey as string), '/IM', lpad(cast(l_linenumber as string), 4, '0')) as file
from {lineitem}""",
    "label_rows": """
select c_custkey as ord,
  concat('TCGA-B', cast(c_custkey % 10 as string), '-', lpad(cast(c_custkey as string), 4, '0')) as patient_id,
  case c_mktsegment when 'MACHINERY' then 'a+b' when 'BUILDING' then ' B ' when 'AUTOMOBILE' then 'D' when 'HOUSEHOLD' then 'x' else 'AC' end as class_raw,
  case when c_custkey % 7 = 0 then concat('kits', cast(c_custkey as string)) else 'nan' end as case_raw
from {customer}""",
    "alias_labels": """
select s_suppkey as ord, case when s_suppkey % 4 = 3 then concat('TCGA-B', cast(s_suppkey % 10 as string), '-', lpad(cast(s_suppkey as string), 4, '0'))
  else concat('Anonym_x', cast(s_suppkey % 8 as string)) end as anonym,
  concat(cast(s_suppkey + 1000 as string), '.0') as id, cast(s_nationkey % 3 as string) as manual_label
from {supplier}""",
    "voi_files": """
select o_orderkey as ord, concat('images/', case o_custkey % 6 when 0 then 'A' when 1 then 'B' when 2 then 'AB' when 3 then 'D' when 4 then 'BC' else 'NG' end,
  '/case_', lpad(cast(o_custkey as string), 5, '0'), '/', case o_orderkey % 4 when 0 then 'NC' when 1 then 'ART' when 2 then 'VEN' else 'DELAY' end,
  '/', lpad(cast(o_orderkey % 100 as string), 2, '0'), '_case_', lpad(cast(o_custkey as string), 5, '0'), case when o_orderkey % 2 = 0 then '_L' else '_r' end, '.npy') as path,
  o_orderkey % 9 <> 0 as has_mask
from {orders}""",
    # headers of image files: one per order
    "image_headers": """
select o_orderkey as ord,
  concat(lpad(cast(o_orderkey % 100 as string), 2, '0'), '_case_', lpad(cast(o_custkey as string), 5, '0'),
    case o_orderkey % 5 when 0 then '_art' when 1 then '_chest' else '' end, '_', cast(o_orderkey as string), '_0000.nii.gz') as filename,
  case o_orderkey % 6 when 0 then 'ART' when 1 then ' ven ' when 2 then 'Undefined' when 3 then 'other' else '' end as detected,
  case o_orderkey % 7 when 0 then 'delayed 5 min' when 1 then 'MPR chest' when 2 then 'plain' else '' end as description,
  case o_orderkey % 4 when 0 then concat('PID-', cast(o_custkey as string)) else '' end as patient,
  case o_orderkey % 3 when 0 then 'a+b' when 1 then 'D' else '' end as assigned,
  replace(cast(cast(o_orderdate as date) as string), '-', '') as study_date,
  case when o_orderkey % 5 = 0 then '' else '101530.25' end as study_time,
  o_orderkey % 4 as dir_kind,
  0.5E0 + (o_custkey % 8) * 0.0625E0 as sx, 0.5E0 + (o_custkey % 4) * 0.125E0 as sy, 1.0E0 + (o_orderkey % 9) * 0.5E0 as sz,
  cast(256 + o_orderkey % 256 as int) as nx, cast(256 + o_custkey % 256 as int) as ny, cast(20 + o_orderkey % 80 as int) as nz
from {orders}""",
    # a file table with images, some masks and some nested files
    "file_table": """
select path, ord from {voi_files}
union all
select concat('mask/', substring(path, 8)), ord from {voi_files} where has_mask
union all
select concat('images/old/', cast(ord % 50 as string), '/', cast(ord as string), '.npy'), ord from {voi_files} where ord % 10 = 0
union all
select concat('images/old/', cast(ord as string), '.txt'), ord from {voi_files} where ord % 100 = 0""",
    "predictions": """
select event_id as id, cast(user_id % 3 as int) as label, least(value, 20.0) / 20.0 as p_raw0,
  (event_id * 37 % 101) / 101.0E0 as p_raw1, (event_id * 53 % 97) / 97.0E0 as p_raw2
from {events}""",
    "metric_events": """
select event_id as ord, cast(event_id % 50 as int) as epoch, cast(user_id % 5 as int) as fold, value,
  case event_type when 'click' then 'Loss/train' when 'view' then 'Loss/val' when 'purchase' then 'Psnr/val' when 'signup' then 'LR/generator' else 'step_train_loss' end as tag
from {events}""",
    "decisions": """
select event_id as ord, concat('case_', lpad(cast(user_id as string), 5, '0')) as key,
  case event_type when 'click' then 'NC' when 'view' then 'ART' when 'purchase' then 'VEN' when 'signup' then 'delete' else 'CLEAR' end as action
from {events}""",
    # decisions on VOI files
    "voi_decisions": """
select ord, path, split_part(path, '/', 2) as class, split_part(path, '/', 3) as patient_id, split_part(path, '/', 4) as protocol,
  split_part(path, '/', 5) as filename, case ord % 5 when 0 then 'art' when 1 then 'VEN' when 2 then 'delete' when 3 then 'NC' else 'CLEAR' end as action
from {voi_files}""",
    "run_artifacts": """
select cast(p_partkey % 5 as int) as fold, concat('run', cast(p_partkey as string)) as run, p_retailprice as mtime, p_partkey = 3 as is_latest,
  p_size % 3 <> 0 as has_config,
  case p_size % 4 when 0 then 'checkpoint_best.pth' when 1 then 'checkpoints/checkpoint_best.pth' when 2 then 'checkpoints/best_vae.pth' else 'other.pth' end as artifact
from {part}""",
    # a manifest with repeated file names and blank groups, and what is known of each file
    "study_manifest": """
select o_orderkey as ord, concat(lpad(cast(o_orderkey % 4 as string), 2, '0'), '_case_', lpad(cast(o_custkey as string), 5, '0'), '_0000.nii.gz') as filename,
  concat('TCGA-', cast(o_custkey as string)) as patient_id, concat('case_', lpad(cast(o_custkey as string), 5, '0')) as case_id,
  case o_orderkey % 7 when 0 then 'A' when 1 then 'B' when 2 then '' else 'NG' end as grp,
  case o_orderkey % 5 when 0 then 'NC' when 1 then 'art' when 2 then 'ven' when 3 then 'delay' else 'undefined' end as phase,
  concat('M', cast(o_orderkey % 3 as string)) as manufacturer, concat('X', cast(o_orderkey % 5 as string)) as manufacturer_model,
  o_orderpriority as institution, 'metadata' as protocol_source,
  o_orderkey % 9 <> 0 as has_mask, o_orderkey % 4 <> 1 as is_live, o_orderkey % 20 = 0 as is_deleted
from {orders}""",
    # outcome of VOI processing, one row per case and side
    "side_results": """
select o_orderkey as ord, concat(lpad(cast(o_orderkey % 100 as string), 2, '0'), '_case_', lpad(cast(o_custkey as string), 5, '0'), '_', cast(o_orderkey as string)) as case_name,
  concat('case_', lpad(cast(o_custkey as string), 5, '0')) as patient_id,
  case o_custkey % 6 when 0 then 'A' when 1 then 'B' when 2 then 'AB' when 3 then 'D' when 4 then '' else 'NG' end as grp,
  case o_orderkey % 5 when 0 then 'nc' when 1 then 'art' when 2 then 'ven' when 3 then 'delay' else '' end as phase,
  case when o_orderkey % 2 = 0 then 'L' else 'R' end as side,
  case when o_orderkey % 22 = 0 then 'failed' when o_orderkey % 11 = 0 then 'error' when o_orderkey % 7 = 0 then 'skipped' else 'ok' end as status,
  case when o_orderkey % 11 = 0 then 'cannot read' when o_orderkey % 7 = 0 then 'Empty save_mask (no target labels)' else '' end as reason,
  o_orderkey % 3 = 0 as has_tumor
from {orders}""",
}

_BOTH = {
    "voxels": (
        """
select vec_id as voi_id, grp, cast(pos % 4 as int) as x, cast(floor(pos / 4) % 4 as int) as y, cast(floor(pos / 16) as int) as z,
  cast(v as double) * 800 as hu, cast(v as double) * 720 as hu_rec,
  case when v > 0.1 then 2 when v > -0.1 then 1 when v < -0.3 then 3 else 0 end as label
from (select vec_id, label as grp, posexplode(embedding) as (pos, v) from {embeddings})""",
        """
select vec_id as voi_id, grp, cast(pos % 4 as int) as x, cast(floor(pos / 4) % 4 as int) as y, cast(floor(pos / 16) as int) as z,
  cast(v as double) * 800 as hu, cast(v as double) * 720 as hu_rec,
  case when v > 0.1 then 2 when v > -0.1 then 1 when v < -0.3 then 3 else 0 end as label
from (select vec_id, label as grp, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings)""",
    ),
    "volumes": (
        """
select vec_id as voi_id, 4 as nx, 4 as ny, 4 as nz, array(0.8E0, 0.8E0, 1.0E0 + vec_id % 4) as spacing,
  array(0.0E0, 0.0E0, 0.0E0) as origin, array(1.0E0, 0.0E0, 0.0E0, 0.0E0, 1.0E0, 0.0E0, 0.0E0, 0.0E0, 1.0E0) as direction
from {embeddings}""",
        """
select vec_id as voi_id, 4 as nx, 4 as ny, 4 as nz, [0.8::double, 0.8::double, (1 + vec_id % 4)::double] as spacing from embeddings""",
    ),
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# Tables whose rows cost much to work on; a file of one row group would otherwise be one task.
_HEAVY = {"documents", "series", "image_headers", "voxels"}


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A base table or a derived one."""
    heavy = heavy or name in _HEAVY
    if name in TABLES:
        rows = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
        return spread(rows) if heavy else rows
    text = SHARED[name] if name in SHARED else _BOTH[name][0]
    inputs = {ref: table(spark, sf_dir, ref, heavy) for ref in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **inputs)


def check_sql(name: str) -> str:
    """The same derived table as text for the check engine."""
    text = SHARED[name] if name in SHARED else _BOTH[name][1]
    return re.sub(
        r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else f"({check_sql(m[1])}\n)", text
    )


def with_tables(body: str, *names: str) -> str:
    """``body`` preceded by the named derived tables."""
    parts = [f"{n} as ({check_sql(n)}\n)" for n in names]
    body = body.strip()
    for head in ("with recursive ", "with "):
        if body.lower().startswith(head):
            return head + ",\n".join(parts) + ",\n" + body[len(head):]
    return "with " + ",\n".join(parts) + "\n" + body


def header_tags(series: DataFrame) -> DataFrame:
    """The series table with its header values as a tag map."""
    tags = F.create_map(
        *[
            part
            for key, name in [
                ("0010|0020", "tag_patient_id"),
                ("0008|0060", "modality"),
                ("0008|103e", "series_description"),
                ("0020|0037", "iop_raw"),
                ("0008|0020", "study_date"),
                ("0010|0030", "birth_date"),
                ("0010|0040", "sex"),
                ("0010|1010", "age"),
                ("0008|0030", "study_time"),
                ("0020|0011", "series_number"),
                ("0008|0070", "manufacturer"),
                ("0008|1090", "manufacturer_model"),
                ("0008|0080", "institution"),
                ("0018|0060", "kvp"),
                ("0018|0010", "contrast_agent"),
                ("0018|0050", "slice_thickness"),
            ]
            for part in (F.lit(key), F.col(name))
        ]
    )
    return series.select("series_ord", "series_uid", "directory", "nonuniformity_mm", tags.alias("tags"), "spacing_raw", "read_error")


def image_meta(headers: DataFrame) -> DataFrame:
    """Image headers with a metadata map, spacing, dims and a direction of nine values."""
    directions = {
        0: [1, 0, 0, 0, 1, 0, 0, 0, 1],
        1: [1, 0, 0, 0, 0, 1, 0, -1, 0],
        2: [0, 1, 0, 0, 0, 1, 1, 0, 0],
        3: [0.7, 0.7, 0, 0, 0.7, 0.7, 0.7, 0, 0.7],
    }
    kinds = F.array(*[F.array(*[F.lit(float(v)) for v in d]) for d in directions.values()])
    meta = F.create_map(
        *[
            part
            for key, name in [
                ("DetectedProtocol", "detected"),
                ("SeriesDescription", "description"),
                ("PatientID", "patient"),
                ("AssignedClass", "assigned"),
                ("StudyDate", "study_date"),
                ("StudyTime", "study_time"),
            ]
            for part in (F.lit(key), F.col(name))
        ]
    )
    return headers.select(
        "ord",
        "filename",
        meta.alias("meta"),
        F.array("sx", "sy", "sz").alias("spacing"),
        F.array("nx", "ny", "nz").alias("dims"),
        kinds[F.col("dir_kind").cast("int")].alias("direction"),
    )
