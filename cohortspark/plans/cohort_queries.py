"""Queries on file tables, pairing, reports, curation, splits and patch plans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import cohort, curation, sampling
from cohortspark.operators import lesions as les
from cohortspark.plans import check_text as ck
from cohortspark.plans import voxel_queries as vq
from cohortspark.plans.registry import query
from cohortspark.plans.series_queries import CASE_PATTERN
from cohortspark.session import cut_lineage, staging_path
from cohortspark.sources import state
from cohortspark.sources.derived import table, with_tables

SEED = 42
FOLDS = 5


def study_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "study_manifest").withColumnRenamed("grp", "group")


def patients(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.scan_patients(table(spark, sf, "file_table"))


# ---- files -----------------------------------------------------------------------------------------------

_MASKS = r"""
m as (select substring(path, 6) as rel from file_table where starts_with(path, 'mask/')),
i as (select substring(path, 8) as rel from file_table where starts_with(path, 'images/')),
s as (select m.rel, i.rel is not null as has_image, regexp_replace(regexp_extract(m.rel, '[^/]*$'), '\.npy$', '') as stem,
  replace(regexp_replace(m.rel, '/[^/]*$', ''), '/', '__') as prefix from m left join i on i.rel = m.rel),
vois as (select concat(prefix, '__', regexp_replace(stem, '(?i)_[lr]$', '')) as case_id, regexp_replace(rel, '\.npy$', '') as voi_id,
  upper(regexp_extract(stem, '(?i)_([lr])$', 1)) as laterality, rel as mask_path, case when has_image then rel end as image_path from s)"""


@query("S10", with_tables(f"with {_MASKS} select * from vois", "file_table"))
def scan_vois(spark, sf):
    return cohort.scan_vois(table(spark, sf, "file_table"))


@query(
    "Q1 P2",
    with_tables(
        f"""with {_MASKS} select voi_id as sample_id, string_split(mask_path, '/')[1] as class_raw, string_split(mask_path, '/')[2] as patient_id,
  'art' as contrast_phase, laterality as side, image_path, mask_path from vois where image_path is not null and string_split(mask_path, '/')[3] = 'ART'""",
        "file_table",
    ),
)
def index_vois(spark, sf):
    return cohort.index_vois(table(spark, sf, "file_table"), phase="art")


_PATIENTS = """
pf as (select string_split(path, '/')[2] as class, string_split(path, '/')[3] as patient_id, path from file_table
  where starts_with(path, 'images/') and path like '%.npy' and len(string_split(path, '/')) >= 4),
pats as (select patient_id, arg_max(class, path) as class, count(*) as n_files, min(path) as first_path from pf group by 1)"""


@query("S11", with_tables(f"with {_PATIENTS} select * from pats", "file_table"))
def scan_patients(spark, sf):
    return patients(spark, sf)


@query(
    "S12",
    with_tables(
        """select string_split(path, '/')[2] as class, string_split(path, '/')[3] as patient_id, 'VEN' as protocol, string_split(path, '/')[5] as filename,
  path as image_path, concat('mask/', substring(path, 8)) as mask_path, substring(path, 8) as key from file_table
where starts_with(path, 'images/') and path like '%.npy' and len(string_split(path, '/')) = 5 and upper(string_split(path, '/')[4]) = 'VEN'""",
        "file_table",
    ),
)
def discover_review_cases(spark, sf):
    return cohort.discover_review_cases(table(spark, sf, "file_table"), "ven")


@query(
    "S19",
    with_tables(
        f"""select path, replace(path, 'images', 'mask') as mask_path, {ck.CLASS_CASE.format(c="string_split(path, '/')[2]")} as label,
  case string_split(path, '/')[4] when 'NC' then 0 when 'ART' then 1 when 'VEN' then 2 end as phase, substring(path, 8) as catalog_key
from (select distinct path from voi_files)""",
        "voi_files",
    ),
)
def training_index(spark, sf):
    files = table(spark, sf, "voi_files").select("path").distinct()
    shape = F.array(F.length("path") % 7, F.lit(3), F.lit(4))
    shapes = files.select("path", shape.alias("shape"))
    shapes = shapes.union(files.select(F.replace("path", F.lit("images"), F.lit("mask")), shape))
    return cohort.training_index(files, shapes)


@query(
    "S7",
    with_tables("select filename, max(ord) as last_ord, arg_max(phase, ord) as phase from study_manifest group by 1", "study_manifest"),
)
def manifest_by_filename(spark, sf):
    rows = study_manifest(spark, sf).withColumn("last_ord", F.col("ord"))
    return cohort.manifest_by_filename(rows).select("filename", "last_ord", "phase")


@query(
    "J6 F6",
    with_tables(
        r"""with img as (select distinct filename from (select concat(lpad(cast(ord % 5 as varchar), 2, '0'), '_', case_id, '_0000.nii.gz') as filename from study_manifest)),
last_row as (select filename, arg_max(grp, ord) as grp, arg_max(phase, ord) as phase, arg_max(case_id, ord) as case_id from study_manifest group by 1),
msk as (select distinct concat(lpad(cast(ord % 5 as varchar), 2, '0'), '_', case_id, '.nii.gz') as filename from study_manifest where has_mask)
select replace(i.filename, '_0000.nii.gz', '') as case_name, coalesce(nullif(l.grp, ''), 'NG') as "group", coalesce(l.phase, 'undefined') as phase,
  i.filename as image_name, m.filename as mask_name, regexp_extract(i.filename, 'case_\d{5}') as patient_id, coalesce(l.case_id, regexp_extract(i.filename, 'case_\d{5}')) as case_id
from img i join msk m on m.filename = replace(i.filename, '_0000.nii.gz', '.nii.gz') left join last_row l on l.filename = i.filename""",
        "study_manifest",
    ),
)
def pair_images_masks(spark, sf):
    rows = study_manifest(spark, sf)
    stem = F.concat(F.lpad((F.col("ord") % 5).cast("string"), 2, "0"), F.lit("_"), "case_id")
    images = rows.select(F.concat(stem, F.lit("_0000.nii.gz")).alias("filename")).distinct()
    masks = rows.where("has_mask").select(F.concat(stem, F.lit(".nii.gz")).alias("filename"))
    return cohort.pair_images_masks(images, masks, cohort.manifest_by_filename(rows), pattern=CASE_PATTERN, require=True)


@query(
    "A4",
    with_tables(
        """with m as (select median(sx) as x, median(sy) as y, median(sz) as z from image_headers)
select 'anisotropic' as mode, x, y, case when z > 2 then greatest(least(z, 1), least(x, y)) else z end as z from m
union all select 'isotropic', least(x, y, z), least(x, y, z), least(x, y, z) from m
union all select 'fixed', 1, 1, 1""",
        "image_headers",
    ),
)
def target_spacing(spark, sf):
    rows = table(spark, sf, "image_headers").select("ord", "sx", "sy", "sz")
    parts = [
        (mode, cohort.target_spacing(rows, mode, fixed=(1.0, 1.0, 1.0) if mode == "fixed" else None))
        for mode in ("anisotropic", "isotropic", "fixed")
    ]
    out = None
    for mode, part in parts:
        part = part.select(F.lit(mode).alias("mode"), "x", "y", "z")
        out = part if out is None else out.union(part)
    return out


@query(
    "J7",
    with_tables(
        """with info as (select patient_id as pid, bool_or(status = 'ok' and side = 'L') as l, bool_or(status = 'ok' and side = 'R') as r,
  bool_or(status = 'ok' and has_tumor) as t from side_results group by 1)
select ord, filename, case when l and r then 'Both' when l then 'L' when r then 'R' else '' end as "Laterality",
  case when t is null then '' when t then 'Yes' else 'No' end as "Tumor" from study_manifest m left join info i on i.pid = m.case_id""",
        "side_results",
        "study_manifest",
    ),
)
def update_manifest_laterality(spark, sf):
    out = cohort.update_manifest_laterality(study_manifest(spark, sf), table(spark, sf, "side_results"))
    return out.select("ord", "filename", "Laterality", "Tumor")


_COMMENTS = """
said as (select patient_id, ord, 0 as late, case when status in ('error', 'failed') then concat('Error: ', reason) when status = 'skipped' then concat(side, ': ', reason) end as c from side_results
  union all select patient_id, ord, 1, 'Processing failed' from side_results where status = 'failed'),
texts as (select patient_id, string_agg(c, '; ' order by late, ord, c) as comments from said where c is not null group by 1)"""


@query(
    "A5",
    with_tables(f"with {_COMMENTS} select patient_id, late, ord, c as comment from said where c is not null", "side_results"),
)
def patient_comments(spark, sf):
    return cohort.patient_comments(table(spark, sf, "side_results"))


@query(
    "A5",
    with_tables(
        f"""with {_COMMENTS},
ser as (select case_id, arg_min(patient_id, ord) as tcga, count(*) as n, count(*) filter (where lower(phase) = 'art') as art, count(*) filter (where lower(phase) = 'ven') as ven,
  count(*) filter (where lower(phase) = 'delay') as delay, count(*) filter (where lower(phase) = 'undefined') as undef, arg_min(manufacturer, ord) as mf,
  arg_min(manufacturer_model, ord) as mm, arg_min(institution, ord) as inst from study_manifest group by 1),
res as (select patient_id, bool_or(status = 'ok' and has_tumor and side = 'R') as rt, bool_or(status = 'ok' and has_tumor and side <> 'R') as lt,
  bool_or(status = 'ok') as ok, bool_or(status = 'skipped') as sk, bool_or(status in ('error', 'failed')) as er from side_results group by 1)
select coalesce(tcga, '') as "TCGA_ID", r.patient_id as "CaseID", coalesce(n, 0) as "N_Series", coalesce(art, 0) as "N_ART", coalesce(ven, 0) as "N_VEN",
  coalesce(delay, 0) as "N_DELAY", coalesce(undef, 0) as "N_UNDEFINED", rt as "RTumor", lt as "LTumor", coalesce(mf, '') as "Manufacturer",
  coalesce(mm, '') as "ManufacturerModel", coalesce(inst, '') as "Institution",
  case when er and not ok then 'Fail' when sk then 'Warning' when ok then 'Pass' else 'Fail' end as "Status", coalesce(comments, '') as "Comments"
from res r left join ser s on s.case_id = r.patient_id left join texts t on t.patient_id = r.patient_id""",
        "side_results",
        "study_manifest",
    ),
)
def patient_preprocess(spark, sf):
    return cohort.patient_preprocess(study_manifest(spark, sf), table(spark, sf, "side_results"))


_REGISTRY = """
reg as (select patient_id, coalesce(nullif(arg_min(grp, ord), ''), 'NG') as "group", count(distinct case_name) as n_cases,
  coalesce(string_agg(distinct side, ',' order by side) filter (where status = 'ok'), '') as kidneys,
  coalesce(string_agg(distinct phase, ',' order by phase) filter (where phase <> ''), '') as phases,
  count(*) filter (where status = 'ok') as n_mask_files, count(*) filter (where status = 'ok') as n_image_files,
  case when bool_or(status = 'ok') then 'PASS' else 'FAIL' end as status from side_results group by 1)"""


@query("A6", with_tables(f"with {_REGISTRY} select * from reg", "side_results"))
def dataset_registry(spark, sf):
    out = cohort.dataset_registry(table(spark, sf, "side_results"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("kidneys", "phases")})


@query(
    "A6",
    with_tables(
        f"""with {_REGISTRY} select count(*) filter (where status = 'PASS') as num_cases, count(*) as num_patients, sum(n_mask_files) as num_mask_files,
  sum(n_image_files) as num_image_files, (select count(*) from side_results where status = 'failed') as num_failed from reg""",
        "side_results",
    ),
)
def registry_totals(spark, sf):
    results = table(spark, sf, "side_results")
    return cohort.registry_totals(cohort.dataset_registry(results), results)


@query(
    "A6",
    with_tables(
        "select patient_id, case_name, min(ord) as first_ord, bool_or(status = 'ok') as finished from side_results group by 1, 2", "side_results"
    ),
)
def registry_cases(spark, sf):
    return cohort.registry_cases(table(spark, sf, "side_results"))


@query(
    "A6 F24",
    with_tables(
        """select patient_id, case_name, side, kind, concat_ws('/', kind, coalesce(nullif(grp, ''), 'NG'), patient_id, upper(coalesce(nullif(phase, ''), 'undefined')),
  concat(case_name, '_', side, '.npy')) as path from side_results, (values ('mask'), ('images')) k(kind) where status = 'ok'""",
        "side_results",
    ),
)
def registry_files(spark, sf):
    return cohort.registry_files(table(spark, sf, "side_results"))


@query(
    "A6",
    with_tables(
        f"""with {_REGISTRY} select 'success' as outcome, patient_id as name, null::varchar as detail from reg where status = 'PASS'
union all select 'failed', case_name, reason from side_results where status = 'failed'""",
        "side_results",
    ),
)
def registry_outcomes(spark, sf):
    results = table(spark, sf, "side_results")
    return cohort.registry_outcomes(cohort.dataset_registry(results), results)


@query(
    "A7",
    with_tables(
        f"""with {_REGISTRY} select case when phases = '' then 'none' when contains(phases, ',') then 'multi' else 'single' end as coverage, patient_id, phases from reg""",
        "side_results",
    ),
)
def phase_coverage_patients(spark, sf):
    found = cohort.phase_coverage_patients(cohort.dataset_registry(table(spark, sf, "side_results")))
    return found.withColumn("phases", F.array_join("phases", ","))


@query(
    "A7",
    with_tables(
        f"""with {_REGISTRY} select case when phases = '' then 'none' when contains(phases, ',') then 'multi' else 'single' end as coverage, count(*) as n_patients from reg group by 1""",
        "side_results",
    ),
)
def phase_coverage(spark, sf):
    return cohort.phase_coverage(cohort.dataset_registry(table(spark, sf, "side_results")))


# ---- curation --------------------------------------------------------------------------------------------

_LAST = """last_dec as (select key, arg_max(action, ord) as action, max(ord) as ord from decisions group by 1 having arg_max(action, ord) <> 'CLEAR')"""


@query("U3", with_tables(f"with {_LAST} select * from last_dec", "decisions"))
def upsert_decisions(spark, sf):
    return curation.upsert_decisions(table(spark, sf, "decisions")).select("key", "action", "ord")


@query("U3 stored", with_tables(f"with {_LAST} select * from last_dec", "decisions"))
def decision_state(spark, sf):
    """Three deliveries out of order and one of them again give what a rebuild gives."""
    at = state.decisions_state(staging_path(spark, "decisions"))
    rows = table(spark, sf, "decisions")
    for part in (2, 0, 1, 0):
        state.merge_delivery(spark, at, rows.where(F.col("ord") % 3 == part))
    return curation.current_decisions(state.read_state(spark, at))


def _file_decisions(spark, sf, rows=None):
    """Decisions on manifest file names."""
    rows = table(spark, sf, "decisions") if rows is None else rows
    return curation.upsert_decisions(rows).withColumn("filename", F.concat(F.lit("00_"), "key", F.lit("_0000.nii.gz")))


_FILE_DEC = _LAST + ", fd as (select *, concat('00_', key, '_0000.nii.gz') as filename from last_dec)"


@query(
    "J9",
    with_tables(
        f"""with {_FILE_DEC} select m.ord, m.filename, case when d.action in ('NC', 'VEN', 'ART', 'DELAY') then lower(d.action) else m.phase end as phase,
  case when d.action in ('NC', 'VEN', 'ART', 'DELAY') then 'manual' else m.protocol_source end as protocol_source
from study_manifest m left join fd d on d.filename = m.filename""",
        "decisions",
        "study_manifest",
    ),
)
def apply_reclassification(spark, sf):
    out = curation.apply_reclassification(study_manifest(spark, sf), _file_decisions(spark, sf))
    return out.select("ord", "filename", "phase", "protocol_source")


@query(
    "J9",
    with_tables(
        f"with {_FILE_DEC} select filename, action from fd where action in ('NC', 'VEN', 'ART', 'DELAY') and filename not in (select filename from study_manifest)",
        "decisions",
        "study_manifest",
    ),
)
def missing_reclassifications(spark, sf):
    out = curation.missing_reclassifications(study_manifest(spark, sf), _file_decisions(spark, sf))
    return out.select("filename", "action")


def _study_files(spark, sf):
    rows = study_manifest(spark, sf)
    files = rows.where("is_live").select(F.concat(F.lit("nifti/"), "filename").alias("path"))
    return files.union(rows.where("is_deleted").select(F.concat(F.lit("deleted/"), "filename")))


def _delete_plan(spark, sf):
    return curation.soft_delete_plan(_file_decisions(spark, sf), _study_files(spark, sf))


_DELETE = (
    _FILE_DEC
    + """, plan as (select filename, concat('nifti/', filename) as from_path, concat('deleted/', filename) as to_path,
  case when filename in (select filename from study_manifest where is_deleted) then 'done' when filename in (select filename from study_manifest where is_live) then 'move'
    else 'missing' end as state from fd where action = 'delete')"""
)


@query("U4", with_tables(f"with {_DELETE} select * from plan", "decisions", "study_manifest"))
def soft_delete_plan(spark, sf):
    return _delete_plan(spark, sf)


@query(
    "U4",
    with_tables(
        f"""with {_DELETE} select m.ord, m.filename, case when p.filename is not null then 'deleted' else m.phase end as phase
from study_manifest m left join plan p on p.filename = m.filename and p.state = 'move'""",
        "decisions",
        "study_manifest",
    ),
)
def soft_delete(spark, sf):
    return curation.soft_delete(study_manifest(spark, sf), _delete_plan(spark, sf)).select("ord", "filename", "phase")


_EARLY = """early as (select key, arg_max(action, ord) as action from decisions where ord % 3 <> 0 group by 1),
free as (select distinct filename from study_manifest where is_live and filename not in (select filename from study_manifest where is_deleted)),
m1 as (select f.filename from early e join free f on f.filename = concat('00_', e.key, '_0000.nii.gz') where e.action = 'delete'),
m2 as (select f.filename from last_dec e join free f on f.filename = concat('00_', e.key, '_0000.nii.gz') where e.action = 'delete' and f.filename not in (select filename from m1))"""


@query(
    "U4 stored",
    with_tables(
        f"""with {_LAST}, {_EARLY} select run, concat('nifti/', filename) as from_path, concat('deleted/', filename) as to_path
from (select 1 as run, filename from m1 union all select 2, filename from m2)""",
        "decisions",
        "study_manifest",
    ),
)
def move_log(spark, sf):
    """Moves of a run on the earlier decisions and of one on all of them, which finds the files as the first left them."""
    at = state.move_log_state(staging_path(spark, "moves"))
    decisions, files = table(spark, sf, "decisions"), _study_files(spark, sf)
    for run, rows in ((1, decisions.where(F.col("ord") % 3 != 0)), (2, decisions)):
        plan = cut_lineage(curation.soft_delete_plan(_file_decisions(spark, sf, rows), files))
        files = curation.files_after(files, plan)
        for _ in range(2):  # the second time adds nothing
            state.merge_delivery(spark, at, curation.run_moves(plan, run))
    return state.read_state(spark, at)


def _voi_decisions(spark, sf):
    return table(spark, sf, "voi_decisions").withColumn("key", F.substring("path", 8, 1 << 30))


_RELOC = """
roots as (select unnest(['images', 'mask']) as kind),
known as (select distinct path from file_table),
reloc as (select kind, substring(path, 8) as key, concat_ws('/', kind, class, patient_id, protocol, filename) as from_path,
  concat_ws('/', kind, class, patient_id, upper(action), filename) as to_path from voi_decisions, roots
  where upper(action) in ('NC', 'ART', 'VEN') and protocol <> upper(action)),
stated as (select r.*, case when t.path is not null then 'done' when s.path is not null then 'move' else 'missing' end as state
  from reloc r left join known s on s.path = r.from_path left join known t on t.path = r.to_path)"""


@query("U5", with_tables(f"with {_RELOC} select * from stated", "file_table", "voi_decisions"))
def relocation_plan(spark, sf):
    return curation.relocation_plan(_voi_decisions(spark, sf), table(spark, sf, "file_table"))


@query(
    "U5",
    with_tables(
        """select ord, case when upper(action) in ('NC', 'ART', 'VEN') then concat_ws('/', class, patient_id, upper(action), filename) else substring(path, 8) end as key,
  case when upper(action) in ('NC', 'ART', 'VEN') then upper(action) else protocol end as protocol from voi_decisions""",
        "voi_decisions",
    ),
)
def rewrite_keys(spark, sf):
    return curation.rewrite_keys(_voi_decisions(spark, sf)).select("ord", "key", "protocol")


@query(
    "U4",
    with_tables(
        """with known as (select distinct path from file_table), roots as (select unnest(['images', 'mask']) as kind)
select kind, substring(v.path, 8) as key, concat(kind, '/', substring(v.path, 8)) as from_path, concat('deleted/', kind, '/', substring(v.path, 8)) as to_path,
  case when k.path is not null then 'move' else 'missing' end as state from voi_decisions v cross join roots left join known k on k.path = concat(kind, '/', substring(v.path, 8))
where action = 'delete'""",
        "file_table",
        "voi_decisions",
    ),
)
def deletion_plan(spark, sf):
    return curation.deletion_plan(_voi_decisions(spark, sf), table(spark, sf, "file_table"))


@query(
    "U6",
    with_tables(
        """with gone as (select concat(kind, '/', substring(path, 8)) as path from voi_decisions, (select unnest(['images', 'mask']) as kind) where action = 'delete'),
lft as (select distinct path from file_table where path not in (select path from gone)),
dirs as (select distinct array_to_string(string_split(path, '/')[1:n.n], '/') as directory from file_table, unnest(range(1, len(string_split(path, '/')))) n(n)),
used as (select distinct array_to_string(string_split(path, '/')[1:n.n], '/') as directory from lft, unnest(range(1, len(string_split(path, '/')))) n(n))
select directory from dirs where directory like '%/%' and directory not in (select directory from used)""",
        "file_table",
        "voi_decisions",
    ),
)
def empty_dirs(spark, sf):
    files = table(spark, sf, "file_table")
    return curation.empty_dirs(files, curation.deletion_plan(_voi_decisions(spark, sf), files))


@query(
    "U7",
    with_tables(
        f"""with {_LAST},
cases as (select string_split(path, '/')[4] as protocol, concat('mask/', substring(path, 8)) as mask_path from file_table
  where starts_with(path, 'images/') and path like '%.npy' and len(string_split(path, '/')) = 5)
select 'action' as section, action as item, count(*) as n from last_dec group by 2
union all select 'new_phase', action, count(*) from last_dec where action in ('NC', 'VEN', 'ART', 'DELAY') group by 2
union all select 'phase', phase, count(*) from study_manifest group by 2
union all select 'group', grp, count(*) from study_manifest group by 2
union all select 'protocol', protocol, count(*) from cases group by 2
union all select 'missing_masks', 'all', count(*) from cases where mask_path not in (select path from file_table)""",
        "decisions",
        "study_manifest",
        "file_table",
    ),
)
def review_summary(spark, sf):
    files = table(spark, sf, "file_table")
    last = curation.upsert_decisions(table(spark, sf, "decisions"))
    return curation.review_summary(last, study_manifest(spark, sf), cohort.discover_review_cases(files), files)


# ---- splits ----------------------------------------------------------------------------------------------

_HOLDOUT = f"""
cls as (select class, count(*) as n from pats group by 1),
strata as (select p.*, case when c.n >= 2 then p.class else '__rare__' end as stratum from pats p join cls c on c.class = p.class),
sizes as (select stratum, count(*) as n from strata group by 1 having not (stratum = '__rare__' and count(*) = 1)),
tot as (select sum(n) as total, ceil(sum(n) * 0.1)::bigint as k from sizes),
base as (select stratum, n, (n * k) // total as b, (n * k) % total as rest, k from sizes, tot),
quota as (select stratum, b + case when row_number() over (order by rest desc, stratum) <= k - sum(b) over () then 1 else 0 end as quota from base),
ranked as (select s.*, row_number() over (partition by s.stratum order by md5(concat('{SEED}|', patient_id)), patient_id) as pos from strata s),
held as (select r.patient_id, r.class, r.first_path, coalesce(r.pos <= q.quota, false) as is_test from ranked r left join quota q on q.stratum = r.stratum)"""

_KFOLD = f"""
tcls as (select class, count(*) as n from held where not is_test group by 1),
tstrata as (select h.*, case when c.n >= {FOLDS} then h.class else '__rare__' end as stratum from held h join tcls c on c.class = h.class where not is_test),
tsizes as (select stratum, count(*) as n, min(first_path) as f from tstrata group by 1),
offs as (select stratum, coalesce(sum(n) over (order by f rows between unbounded preceding and 1 preceding), 0) as off from tsizes),
dealt as (select t.*, row_number() over (partition by t.stratum order by md5(concat('{SEED}|fold|', patient_id)), patient_id) - 1 as pos from tstrata t),
folds as (select d.patient_id, d.class, cast((o.off + d.pos) % {FOLDS} as int) as fold from dealt d join offs o on o.stratum = d.stratum),
splits as (select f.f as fold, case when f.f = folds.fold then 'val' else 'train' end as split, patient_id from folds, unnest(range(0, {FOLDS})) f(f)
  union all select null, 'test', patient_id from held where is_test)"""


def _split_sql(body):
    return with_tables(f"with {_PATIENTS}, {_HOLDOUT}, {_KFOLD} {body}", "file_table")


@query("L1", _split_sql(f"select patient_id, class, stratum from strata"))
def safe_strata(spark, sf):
    return sampling.safe_strata(patients(spark, sf), 2).select("patient_id", "class", "stratum")


@query("L2", _split_sql("select patient_id, class, is_test from held"))
def holdout_split(spark, sf):
    return sampling.holdout_split(patients(spark, sf), 0.1, SEED).select("patient_id", "class", "is_test")


@query("L3", _split_sql("select patient_id, class, fold from folds"))
def stratified_kfold(spark, sf):
    held = sampling.holdout_split(patients(spark, sf), 0.1, SEED)
    return sampling.stratified_kfold(held.where("not is_test"), FOLDS, SEED).select("patient_id", "class", "fold")


@query("L2 L3 S15", _split_sql("select fold, split, patient_id from splits"))
def build_splits(spark, sf):
    return sampling.build_splits(patients(spark, sf), FOLDS, 0.1, SEED)


@query(
    "J10 S15",
    _split_sql("select split, s.patient_id, path from splits s join pf on pf.patient_id = s.patient_id where fold = 2"),
)
def fold_files(spark, sf):
    fold = sampling.select_fold(sampling.build_splits(patients(spark, sf), FOLDS, 0.1, SEED), 2)
    out = cohort.gather_files(fold, cohort.patient_files(table(spark, sf, "file_table")))
    return out.select("split", "patient_id", "path")


@query(
    "L9",
    _split_sql(f"""select class, count(*) as n, case when count(*) < 2 then 'forced into train only' when count(*) < {FOLDS} then 'pooled as rare for fold stratification' end as notice
from pats group by 1"""),
)
def class_distribution(spark, sf):
    return sampling.class_distribution(patients(spark, sf), FOLDS)


# ---- patch plans -----------------------------------------------------------------------------------------

PLAN = sampling.SamplerOptions(patch=(2, 3, 2), background_prob=1.0, min_shift=0.5)


def _lesion_rows(spark, sf):
    """Kept lesions with id, bin and the bin profile."""
    parts = vq.components(spark, sf)
    ids = les.numbered(parts.table.where("volume_vox >= 3"), ["voi_id"], [F.col("component")], "lesion_id", start=0)
    rows = les.lesion_geometry(ids, vq.OPTIONS.target_spacing).join(
        ids.select("voi_id", "component", "lesion_id"), ["voi_id", "component"]
    )
    rows = les.assign_size_bins(rows, vq.OPTIONS.size_bin_percentiles)
    return rows, les.bin_profile(rows)


_ORDERED = vq._LESIONS + "," + vq._BINS + "," + vq._PROFILE + """,
ordered as (select b.*, row_number() over (partition by voi_id order by size_bin, volume_vox desc, lesion_id) as position from binned b),
budget as (select o.*, p.empirical, p.target, p.patch_budget, prior_center, prior_border, prior_context,
  greatest(1, round_even(patch_budget * greatest(0.5, least(2.0, target / empirical)), 0)::int) as budget from ordered o join prof p on p.size_bin = o.size_bin),
roles as (select b.*, i.i as patch_index, list_sort([(-prior_center, 0, 'center'), (-prior_border, 1, 'border'), (-prior_context, 2, 'context')])[i.i % 3 + 1][3] as role
  from budget b, unnest(range(0, b.budget)) i(i)),
dist as (select *, case when role = 'center' then 0 else (case when patch_index % 2 = 0 then -1 else 1 end) * greatest(0.5, (case when role = 'border' then 0.30 else 0.55 end)::double * greatest(dx, dy, dz)) end as sh,
  case when dx >= dy and dx >= dz then 0 when dy >= dz then 1 else 2 end as ax from roles),
centred as (select *, cx + case when ax = 0 then sh else 0 end as px, cy + case when ax = 1 then sh else 0 end as py, cz + case when ax = 2 then sh else 0 end as pz from dist),
planned as (select voi_id, position, patch_index, lesion_id, role, greatest(0, least(round_even(px - 1.0, 0)::int, 2)) as start_x, greatest(0, least(round_even(py - 1.5, 0)::int, 1)) as start_y,
  greatest(0, least(round_even(pz - 1.0, 0)::int, 2)) as start_z from centred
  union all select distinct voi_id, 1, 0, -1, 'background', 1, 0, 1 from voxels where voi_id not in (select voi_id from kept)),
plan as (select voi_id, row_number() over (partition by voi_id order by position, patch_index) as plan_order, lesion_id, role, start_x, start_y, start_z from planned)"""


def _plan_sql(body):
    return with_tables("with recursive " + _ORDERED + "\n" + body, "voxels")


@query("W9", _plan_sql("select voi_id, lesion_id, size_bin, position from ordered"))
def lesion_order(spark, sf):
    rows, _ = _lesion_rows(spark, sf)
    return sampling.lesion_order(rows).select("voi_id", "lesion_id", "size_bin", "position")


@query("L4", _plan_sql("select voi_id, lesion_id, budget from budget"))
def patch_budget(spark, sf):
    rows, profile = _lesion_rows(spark, sf)
    return rows.join(profile, "size_bin").select("voi_id", "lesion_id", sampling.patch_budget(PLAN).alias("budget"))


@query("L5 L6", _plan_sql("select voi_id, lesion_id, patch_index, role, round(px, 6) as px, round(py, 6) as py, round(pz, 6) as pz from centred"))
def role_centers(spark, sf):
    rows, profile = _lesion_rows(spark, sf)
    patches = sampling.assign_roles(rows.join(profile, "size_bin").withColumn("budget", sampling.patch_budget(PLAN)), PLAN)
    out = patches.withColumn("c", sampling.role_center(PLAN))
    return out.select(
        "voi_id", "lesion_id", "patch_index", "role", *[F.round(F.col("c")[i], 6).alias(f"p{a}") for i, a in enumerate("xyz")]
    )


@query("L4 L5 L6 L7 L8 W9", _plan_sql("select * from plan"))
def plan_patches(spark, sf):
    rows, profile = _lesion_rows(spark, sf)
    return sampling.plan_patches(rows, profile, table(spark, sf, "volumes"), PLAN)


@query(
    "L8",
    _plan_sql("""select voi_id, count(distinct lesion_id) filter (where lesion_id >= 0) as num_lesions, count(*) as num_planned_patches, count(*) filter (where role = 'center') as n_center,
  count(*) filter (where role = 'border') as n_border, count(*) filter (where role = 'context') as n_context, count(*) filter (where role = 'background') as n_background from plan group by 1"""),
)
def plan_audit(spark, sf):
    return sampling.plan_audit(plan_patches(spark, sf))


def _u(*parts):
    """The uniform of ``sampling.uniform`` as check text."""
    joined = ", ".join(parts)
    return f"(('0x' || substring(md5(concat_ws('|', '{SEED}', {joined})), 1, 13))::bigint / 4503599627370496.0::double)"


_ID = ("cast(voi_id as varchar)", "cast(lesion_id as varchar)", "cast(patch_index as varchar)")


@query(
    "L5 L6 L8 stochastic",
    _plan_sql(f"""select voi_id, lesion_id, patch_index, case when u < prior_center then 'center' when u < prior_center + prior_border then 'border' else 'context' end as role, sign
from (select b.*, i.i as patch_index, {_u("'role'", *_ID)} * (prior_center + prior_border + prior_context) as u, case when {_u("'sign'", *_ID)} < 0.5 then -1.0 else 1.0 end as sign
  from budget b, unnest(range(0, b.budget)) i(i))"""),
)
def stochastic_roles(spark, sf):
    rows, profile = _lesion_rows(spark, sf)
    options = sampling.SamplerOptions(patch=(2, 3, 2), stochastic=True)
    patches = sampling.assign_roles(rows.join(profile, "size_bin").withColumn("budget", sampling.patch_budget(options)), options)
    u = sampling.uniform(options.seed, F.lit("sign"), "voi_id", "lesion_id", "patch_index")
    return patches.select("voi_id", "lesion_id", "patch_index", "role", F.when(u < 0.5, -1.0).otherwise(1.0).alias("sign"))


def _still(axis, extent):
    """A centre moved by a normal draw, as check text."""
    u1, u2 = (_u(f"'{n}{axis}'", *_ID) for n in "uv")
    return f"c{axis} + sqrt(-2.0::double * ln(1.0::double - {u1})) * cos({2 * math.pi!r}::double * {u2}) * greatest(1.0::double, 0.1::double * {extent})"


def _start(at, half, room):
    return f"greatest(0, least(round_even({at} - {half}, 0)::int, {room}))"


_AXES = (("x", 0, 1.0, 2), ("y", 1, 1.5, 1), ("z", 2, 1.0, 2))
_ID_ORDER = f"md5(concat_ws('|', '{SEED}', 'order', {', '.join(_ID)}))"


@query(
    "L5 L6 L8 stochastic",
    _plan_sql(f""", drawn as (select b.*, i.i as patch_index, {_u("'role'", *_ID)} * (prior_center + prior_border + prior_context) as u,
  case when {_u("'sign'", *_ID)} < 0.5 then -1.0::double else 1.0::double end as sign, case when dx >= dy and dx >= dz then 0 when dy >= dz then 1 else 2 end as ax
  from budget b, unnest(range(0, b.budget)) i(i)),
given as (select *, case when u < prior_center then 'center' when u < prior_center + prior_border then 'border' else 'context' end as role from drawn),
pushed as (select *, sign * greatest(0.5::double, (case when role = 'border' then 0.30 else 0.55 end)::double * greatest(dx, dy, dz)) as sh from given),
placed as (select voi_id, lesion_id, patch_index, role, size_bin, volume_vox,
  {", ".join(f"case when role = 'center' then {_still(a, f'd{a}')} else c{a} + case when ax = {i} then sh else 0 end end as p{a}" for a, i, _, _ in _AXES)} from pushed),
random_plan as (select voi_id, lesion_id, patch_index, role, size_bin, volume_vox, {", ".join(f"{_start(f'p{a}', h, r)} as start_{a}" for a, _, h, r in _AXES)} from placed
  union all select voi_id, -1, 0, 'background', '', 0, {", ".join(f"floor({_u(f"'bg{a}'", 'cast(voi_id as varchar)')} * {r + 1})::int" for a, _, _, r in _AXES)}
  from (select distinct voi_id from voxels where voi_id not in (select voi_id from kept)))
select voi_id, row_number() over (partition by voi_id order by {_ID_ORDER}, size_bin, volume_vox desc, lesion_id, patch_index) as plan_order, lesion_id, role, start_x, start_y, start_z
from random_plan"""),
)
def plan_patches_stochastic(spark, sf):
    rows, profile = _lesion_rows(spark, sf)
    options = sampling.SamplerOptions(patch=(2, 3, 2), background_prob=1.0, min_shift=0.5, stochastic=True)
    return sampling.plan_patches(rows, profile, table(spark, sf, "volumes"), options)


@query(
    "J8",
    _plan_sql("""select v.voi_id, k.lesion_id, k.volume_vox from (select distinct voi_id from voxels) v left join kept k on k.voi_id = v.voi_id"""),
)
def lesions_for_subject(spark, sf):
    rows, _ = _lesion_rows(spark, sf)
    key = F.format_string("A/%d.npy", "voi_id")
    subjects = table(spark, sf, "volumes").select("voi_id", key.alias("catalog_key"))
    lesions = rows.select(key.alias("mask_path"), "lesion_id", "volume_vox")
    return sampling.lesions_for_subject(subjects, lesions).select("voi_id", "lesion_id", "volume_vox")


