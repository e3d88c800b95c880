"""Queries from raw series to the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions import geometry, text
from cohortspark.operators import series as ops
from cohortspark.plans import check_text as ck
from cohortspark.plans.registry import query
from cohortspark.session import cut_lineage
from cohortspark.sources.derived import header_tags, image_meta, table, with_tables

MIN_SLICES = 3
CASE_PATTERN = r"(?:\d{2}_)?(case_\d{5})|^(TCGA-[A-Z0-9]+-[A-Z0-9]+)"


def series_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Series with tags and their slice counts."""
    counts = table(spark, sf, "slices").groupBy("series_uid").agg(F.count("*").alias("num_slices"))
    headers = header_tags(table(spark, sf, "series"))
    return headers.join(counts, "series_uid", "left").withColumn("num_slices", F.coalesce("num_slices", F.lit(0)))


def screened(spark: SparkSession, sf: str) -> DataFrame:
    return ops.filter_series(ops.describe_series(series_headers(spark, sf)), MIN_SLICES)


def class_labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "label_rows").withColumnsRenamed({"class_raw": "class", "case_raw": "case_id"})
    return ops.load_class_labels(raw)


def alias_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "alias_labels")
    return rows.select(
        "ord",
        F.col("anonym").alias("Anonym"),
        F.col("id").alias("ID"),
        F.col("manual_label").alias("Manual Label"),
        *[F.lit("").alias(c) for c in ("LB", "HB", "SN")],
    )


def converted_series(spark: SparkSession, sf: str, all_series: DataFrame | None = None) -> DataFrame:
    """Kept series as manifest rows, those that fail with their error."""
    kept = (screened(spark, sf) if all_series is None else all_series).where("reason is null")
    return ops.convert_series(ops.with_geometry(kept), class_labels(spark, sf), ops.load_alias_labels(alias_table(spark, sf)))


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ops.converted(converted_series(spark, sf))


# ---- check text for the shared steps ---------------------------------------------------------------------

_PLANE_TEXT = """case when contains(upper(series_description), 'AXIAL') then 'AXIAL'
  when contains(upper(series_description), ' AX ') then 'AXIAL' when contains(upper(series_description), 'TRANSVERSE') then 'AXIAL'
  when contains(upper(series_description), 'CORONAL') then 'CORONAL' when contains(upper(series_description), ' COR ') then 'CORONAL'
  when contains(upper(series_description), 'SAGITTAL') then 'SAGITTAL' when contains(upper(series_description), ' SAG ') then 'SAGITTAL'
  else 'AXIAL' end"""

_DESCRIBED = rf"""
iop as (select *, string_split(iop_raw, chr(92)) as v from series),
normal as (select *, case when len(v) = 6 then
    [abs(v[2]::double*v[6]::double - v[3]::double*v[5]::double), abs(v[3]::double*v[4]::double - v[1]::double*v[6]::double),
     abs(v[1]::double*v[5]::double - v[2]::double*v[4]::double)] end as nrm from iop),
parts as (select *, list_filter(list_reverse(string_split(directory, '/')), lambda p:
    regexp_matches(p, '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}') or regexp_matches(p, '(?i)^anonym[-_]') or regexp_matches(p, '^case_\d+')
    or (regexp_matches(p, '^[A-Za-z0-9][-_A-Za-z0-9]{{2,}}$') and not regexp_matches(p, '^(CT_|MR_|PT_)')))[1] as part from normal),
counts as (select series_uid, count(*) as n from slices group by 1),
described as (select p.*, coalesce(c.n, 0) as num_slices,
    case when tag_patient_id <> '' then tag_patient_id when part is null then 'UNKNOWN' else part end as patient_id,
    case when tag_patient_id <> '' then 'dicom_PatientID' when part is null then 'fallback'
      when regexp_matches(part, '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}') then 'directory_tcga' else 'directory_folder' end as pid_source,
    case when nrm is null then {_PLANE_TEXT}
      when list_max(nrm) < 0.8 then 'OBLIQUE' else ['SAGITTAL','CORONAL','AXIAL'][list_position(nrm, list_max(nrm))] end as scan_plane,
    case when nonuniformity_mm > 50 then 'critical' when nonuniformity_mm > 10 then 'moderate'
      when nonuniformity_mm is not null then 'minor' else 'ok' end as severity,
    string_split(directory, '/')[1] as root
  from parts p left join counts c on c.series_uid = p.series_uid),
screened as (select *, case when read_error is not null then 'Failed to read DICOM series' when modality = 'SEG' then 'SEG modality (segmentation)'
    when severity = 'critical' then 'Critical spacing nonuniformity'
    when scan_plane <> 'AXIAL' then concat('Non-axial scan (', scan_plane, ')')
    when num_slices < {MIN_SLICES} then concat('Too few slices (', num_slices, ' < {MIN_SLICES})') end as reason from described)
"""

_CLASSES = f"""
cleaned as (select ord, {ck.clean('patient_id')} as pid, {ck.normalize_class('(' + ck.clean('class_raw') + ')')} as grp,
    nullif({ck.clean('case_raw')}, '') as cid from label_rows),
classes as (select pid, arg_max(grp, ord) as grp, arg_max(cid, ord) filter (where cid is not null) as cid, min(ord) as first_ord
  from cleaned where pid <> '' group by pid)
"""

_ALIASES = f"""
claims as (select ord, {ck.key('anonym')} as k from alias_labels union select ord, {ck.key('id')} from alias_labels),
owners as (select k, min(ord) as row_ord, count(*) as n_rows from claims where k <> '' group by k),
aliases as (select o.k as alias, o.row_ord, {ck.clean('l.anonym')} as ukb_anonym, {ck.clean('l.id')} as ukb_id,
  {ck.clean('l.manual_label')} as manual_label, o.n_rows from owners o join alias_labels l on l.ord = o.row_ord)
"""


_TAG_VALUES = """concat(birth_date[1:4], '-', birth_date[5:6], '-', birth_date[7:8]) as "DOB",
    concat(study_date[1:4], '-', study_date[5:6], '-', study_date[7:8]) as "DOS",
    round_even((strptime(study_date, '%Y%m%d')::date - strptime(birth_date, '%Y%m%d')::date) / 365.25, 1) as age_at_scan,
    nullif(series_description, '') as series_description, nullif(trim(sex), '') as sex, nullif(age, '') as age,
    case when length(study_time) >= 6 then concat(study_time[1:2], ':', study_time[3:4], ':', study_time[5:6]) end as study_time,
    series_number, nullif(trim(manufacturer), '') as manufacturer, manufacturer_model, nullif(institution, '') as institution,
    nullif(kvp, '') as kvp, nullif(contrast_agent, '') as contrast_agent, slice_thickness"""

_MANIFEST = rf"""
kept as (select *, {ck.norm('series_description')} as t_meta, {ck.norm('directory')} as t_path from screened where reason is null),
phased as (select *, {ck.phase_of_norm('t_meta')} as p_meta, {ck.phase_of_norm('t_path')} as p_path from kept),
pats as (select patient_id, min(series_ord) as first_seen from kept group by 1),
norms as (select {ck.key('pid')} as k, arg_min(grp, first_ord) as grp from classes group by 1),
grouped as (select p.*, coalesce(a.grp, b.grp, c.grp, 'NG') as grp, a.cid from pats p
  left join classes a on a.pid = p.patient_id left join classes b on b.pid = {ck.key('p.patient_id')}
  left join norms c on c.k = {ck.key('p.patient_id')}),
cased as (select *, case when cid is not null and regexp_matches(cid, '\d') then {ck.case_number(r"regexp_extract(cid, '\d+')")}
    when cid is not null then cid
    else {ck.case_number('cast(no as varchar)')} end as case_id from (select *, row_number() over (partition by cid is null order by first_seen, patient_id) as no from grouped)),
numbered as (select k.*, c.grp, c.case_id,
    row_number() over (partition by k.patient_id order by series_ord) - 1 as scan_idx,
    row_number() over (partition by c.case_id order by c.first_seen, series_ord) - 1 as case_no
  from phased k join cased c on c.patient_id = k.patient_id),
spaced as (select *, string_split(spacing_raw, chr(92)) as sv from numbered),
measured as (select *, case when len(sv) <> 3 or len(list_filter(sv, lambda v: coalesce(try_cast(v as double), 0) <= 0)) > 0
    then concat('cannot read spacing ', chr(39), spacing_raw, chr(39)) end as error from spaced),
named as (select m.*, coalesce(a.ukb_anonym, b.ukb_anonym, '') as ukb_anonym, coalesce(a.ukb_id, b.ukb_id, '') as ukb_id, coalesce(a.manual_label, b.manual_label, '') as manual_label,
    case when coalesce(a.alias, b.alias) is null then '' else 'labels.csv' end as label_source
  from measured m left join aliases a on a.alias = m.patient_id left join aliases b on b.alias = {ck.key('m.patient_id')}),
manifest as (select series_ord, concat(lpad(cast(case_no as varchar), greatest(2, length(cast(case_no as varchar)))::int, '0'), '_', case_id, '_0000.nii.gz') as filename,
    patient_id, case_id, grp as "group",
    case when p_meta in ('nc','art','ven','delay') then p_meta when p_meta = 'excluded' then 'undefined'
      when p_path in ('nc','art','ven','delay') then p_path else 'undefined' end as phase,
    case when p_meta <> 'undefined' then 'metadata' when p_path <> 'undefined' then 'filename' else 'undefined' end as phase_source,
    scan_idx, modality, scan_plane, nullif(iop_raw, '') as image_orientation, severity as spacing_quality, nonuniformity_mm,
    {_TAG_VALUES},
    try_cast(sv[1] as double) as spacing_x, try_cast(sv[2] as double) as spacing_y, try_cast(sv[3] as double) as spacing_z,
    cast(null as int) as dim_x, cast(null as int) as dim_y, cast(null as int) as dim_z, num_slices, 'generic' as dataset_type,
    concat(lpad(cast(case_no as varchar), greatest(2, length(cast(case_no as varchar)))::int, '0'), '_', case_id, '_0000.nii.gz') as output_path, 'ok' as validation,
    ukb_anonym, ukb_id, manual_label, '' as lb, '' as hb, '' as sn, label_source from named where error is null)
"""

# All columns of a manifest but the time of the run.
_SHOWN = ["series_ord", *[c for c in ops.MANIFEST_COLUMNS if c != "conversion_date"]]
_STATS = """select 'scan_plane' as stat, scan_plane as value, count(*) as n from read group by 2
union all select 'modality', modality, count(*) from read group by 2
union all select 'quality', severity, count(*) from read group by 2
union all select 'pid_source', pid_source, count(*) from read group by 2"""


def _joined(body: str) -> str:
    """A body that has tables of its own goes on with the list of tables."""
    return ",\n" + body.removeprefix("with ") if body.startswith("with ") else "\n" + body


def _screened_sql(body: str) -> str:
    return with_tables(f"with {_DESCRIBED}{_joined(body)}", "series", "slices")


def _manifest_sql(body: str) -> str:
    return with_tables(f"with {_DESCRIBED}, {_CLASSES}, {_ALIASES}, {_MANIFEST}{_joined(body)}", "series", "slices", "label_rows", "alias_labels")


# ---- discovery -------------------------------------------------------------------------------------------


@query(
    "S1",
    with_tables(
        """with d as (select distinct regexp_replace(path, '/[^/]*$', '') as directory from file_table)
select directory from d where not exists (select 1 from d c where starts_with(c.directory, concat(d.directory, '/')))""",
        "file_table",
    ),
)
def leaf_dirs(spark, sf):
    return ops.leaf_dirs(table(spark, sf, "file_table"))


@query(
    "S2",
    with_tables(
        """select regexp_replace(file, '/[^/]*$', '') as directory, series_uid, count(*) as num_slices, min(file) as first_file from slices group by 1, 2""",
        "slices",
    ),
)
def discover_series(spark, sf):
    return ops.discover_series(table(spark, sf, "slices"))


@query(
    "S2",
    with_tables(
        """select regexp_replace(file, '/[^/]*$', '') as directory, series_uid, file,
  row_number() over (partition by regexp_replace(file, '/[^/]*$', ''), series_uid order by file) as position from slices""",
        "slices",
    ),
)
def series_files(spark, sf):
    return ops.series_files(table(spark, sf, "slices"))


# ---- scalar functions over the tables --------------------------------------------------------------------


@query(
    "F1 F7 F19 S4",
    with_tables(
        rf"""select ord, cell, {ck.normalize_class('cls')} as class, case when regexp_matches(cell, '\d')
    then {ck.case_number(r"regexp_extract(cell, '\d+')")} else cell end as case_id
from (select ord, {ck.clean('case_raw')} as cell, {ck.clean('class_raw')} as cls from label_rows)""",
        "label_rows",
    ),
)
def label_cells(spark, sf):
    rows = table(spark, sf, "label_rows")
    cell = text.clean_cell(F.col("case_raw"))
    return rows.select(
        "ord",
        cell.alias("cell"),
        text.normalize_class(text.clean_cell(F.col("class_raw"))).alias("class"),
        text.normalize_case_id(cell).alias("case_id"),
    )


@query(
    "F2 F3 F4",
    with_tables(
        rf"""select raw, {ck.sanitize('raw')} as sanitized,
  length(raw) >= 2 and lower(raw) not in ('unknown','anonymous','none','test','patient')
    and not (regexp_matches(raw, '^[0-9.]+$') and contains(raw, '.')) as valid, {ck.key('raw')} as key
from (select anonym as raw from alias_labels union all select id from alias_labels union all select p_name from part
  union all select tag_patient_id from series)""",
        "alias_labels",
        "series",
    ),
)
def patient_keys(spark, sf):
    aliases = table(spark, sf, "alias_labels")
    raw = (
        aliases.select(F.col("anonym").alias("raw"))
        .union(aliases.select("id"))
        .union(table(spark, sf, "part").select("p_name"))
        .union(table(spark, sf, "series").select("tag_patient_id"))
    )
    c = F.col("raw")
    return raw.select(
        "raw",
        text.sanitize_id(c).alias("sanitized"),
        text.is_valid_pid(c).alias("valid"),
        text.normalize_patient_key(c).alias("key"),
    )


@query("F5 S3", _screened_sql("select series_uid, patient_id, pid_source from described"))
def series_patient_ids(spark, sf):
    return ops.describe_series(header_tags(table(spark, sf, "series")).withColumn("num_slices", F.lit(0))).select(
        "series_uid", "patient_id", "pid_source"
    )


@query(
    "F6 F22 F23 F24",
    with_tables(
        r"""with f as (select path, regexp_extract(path, '[^/]*$') as name from voi_files),
g as (select *, regexp_replace(name, '\.npy$', '') as stem from f)
select path, regexp_extract(stem, 'case_\d{5}') as patient_id, regexp_replace(stem, '(?i)_[lr]$', '') as case_stem,
  upper(regexp_extract(stem, '(?i)_([lr])$', 1)) as side, regexp_extract(name, '^(\d+)_', 1)::int as scan_idx,
  replace(path, 'images/', '') as catalog_key,
  concat('mask/', string_split(path, '/')[2], '/', string_split(path, '/')[3], '/', string_split(path, '/')[4], '/',
    regexp_replace(stem, '(?i)_[lr]$', ''), '_', upper(regexp_extract(stem, '(?i)_([lr])$', 1)), '.npy') as voi_path
from g""",
        "voi_files",
    ),
)
def voi_names(spark, sf):
    files = table(spark, sf, "voi_files").select("path")
    name = text.base_name(F.col("path"))
    stem = F.regexp_replace(name, r"\.npy$", "")
    lat = text.parse_laterality(stem)
    parts = F.split("path", "/")
    return files.select(
        "path",
        text.patient_id_from_case(stem, CASE_PATTERN).alias("patient_id"),
        lat["stem"].alias("case_stem"),
        lat["side"].alias("side"),
        text.scan_index(name).alias("scan_idx"),
        text.catalog_key(F.regexp_replace("path", "^images/", "voi/mask/"), "voi/mask").alias("catalog_key"),
        text.voi_output_path(F.lit("mask"), parts[1], parts[2], parts[3], lat["stem"], lat["side"]).alias("voi_path"),
    )


@query(
    "F8 F9",
    f"""select doc_id, length(t) as norm_chars, md5(t) as norm_md5, {ck.phase_of_norm('t')} as phase
from (select doc_id, {ck.norm('text')} as t from documents)""",
)
def document_phase_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.norm_text(F.col("text")).alias("t"))
    return docs.select(
        "doc_id",
        F.length("t").alias("norm_chars"),
        F.md5(F.col("t").cast("binary")).alias("norm_md5"),
        text.classify_normed(F.col("t")).alias("phase"),
    )


@query(
    "F10",
    with_tables(
        f"""with n as (select series_uid, {ck.norm('series_description')} as m, {ck.norm('directory')} as p from series),
c as (select series_uid, {ck.phase_of_norm('m')} as pm, {ck.phase_of_norm('p')} as pp from n)
select series_uid, case when pm in ('nc','art','ven','delay') then pm when pm = 'excluded' then 'undefined'
    when pp in ('nc','art','ven','delay') then pp else 'undefined' end as phase,
  case when pm <> 'undefined' then 'metadata' when pp <> 'undefined' then 'filename' else 'undefined' end as source from c""",
        "series",
    ),
)
def series_protocol(spark, sf):
    found = text.detect_protocol(F.col("tags"), F.col("directory"))
    return header_tags(table(spark, sf, "series")).withColumn("p", found).select("series_uid", "p.phase", "p.source")


_HEADER_PHASE = f"""
hn as (select *, lower({ck.strip('detected')}) as emb, {ck.norm('description')} as m, {ck.norm('filename')} as f from image_headers),
hc as (select *, {ck.phase_of_norm('m')} as pm, {ck.phase_of_norm('f')} as pf from hn),
hp as (select *, case when emb in ('nc','art','ven','delay','undefined') then emb when pm in ('nc','art','ven','delay') then pm
    when pf in ('nc','art','ven','delay') then pf else 'undefined' end as phase,
  case when emb in ('nc','art','ven','delay') then 'metadata' when emb = 'undefined' then 'undefined'
    when pm in ('nc','art','ven','delay') then 'metadata' when pf in ('nc','art','ven','delay') then 'filename' else 'undefined' end as phase_source from hc)
"""


@query(
    "F11",
    with_tables(f"with {_HEADER_PHASE} select filename, phase, phase_source as source from hp", "image_headers"),
)
def header_phase(spark, sf):
    found = text.detect_phase_embedded(F.col("meta"), F.col("filename"))
    heads = image_meta(table(spark, sf, "image_headers"))
    return heads.withColumn("p", found).select("filename", "p.phase", "p.source")


@query("F12 F13", _screened_sql("select series_uid, scan_plane from described"))
def series_scan_plane(spark, sf):
    plane = geometry.detect_scan_plane(
        text.get_tag(F.col("tags"), "0020|0037"), text.get_tag(F.col("tags"), "0008|103e")
    )
    return header_tags(table(spark, sf, "series")).select("series_uid", plane.alias("scan_plane"))


_DIR_TEXT = r"""case dir_kind when 0 then '1.000000\0.000000\0.000000\0.000000\1.000000\0.000000'
  when 1 then '1.000000\0.000000\0.000000\0.000000\0.000000\1.000000'
  when 2 then '0.000000\1.000000\0.000000\0.000000\0.000000\1.000000'
  else '0.700000\0.700000\0.000000\0.000000\0.700000\0.700000' end"""
_DIR_PLANE = "case dir_kind when 0 then 'AXIAL' when 1 then 'CORONAL' when 2 then 'SAGITTAL' else 'OBLIQUE' end"


@query(
    "F14 F15",
    with_tables(
        f"select filename, {_DIR_PLANE} as scan_plane, {_DIR_TEXT} as image_orientation from image_headers", "image_headers"
    ),
)
def header_scan_plane(spark, sf):
    heads = image_meta(table(spark, sf, "image_headers"))
    return heads.select(
        "filename",
        geometry.scan_plane_from_direction(F.col("direction")).alias("scan_plane"),
        geometry.direction_to_string(F.col("direction")).alias("image_orientation"),
    )


@query(
    "F16",
    with_tables(
        """select series_uid, case when nonuniformity_mm > 50 then 'critical' when nonuniformity_mm > 10 then 'moderate'
  when nonuniformity_mm is not null then 'minor' else 'ok' end as severity, nonuniformity_mm as parsed from series""",
        "series",
    ),
)
def spacing_quality(spark, sf):
    rows = table(spark, sf, "series")
    warning = F.concat(F.lit("Non uniform sampling, Maximum nonuniformity: "), F.col("nonuniformity_mm").cast("string"))
    parsed = text.nonuniformity_from_warning(warning)
    return rows.select("series_uid", text.spacing_severity(parsed).alias("severity"), parsed.alias("parsed"))


@query(
    "F17 F18",
    with_tables(
        """select series_uid, concat(study_date[1:4], '-', study_date[5:6], '-', study_date[7:8]) as dos,
  concat(birth_date[1:4], '-', birth_date[5:6], '-', birth_date[7:8]) as dob,
  case when length(concat('0', series_uid)) >= 6 then concat(series_uid[1:2], ':', series_uid[3:4], ':', series_uid[5:6]) end as time_text,
  round_even((strptime(study_date, '%Y%m%d')::date - strptime(birth_date, '%Y%m%d')::date) / 365.25, 1) as age from series""",
        "series",
    ),
)
def dicom_dates(spark, sf):
    rows = table(spark, sf, "series")
    dos, dob = text.format_dicom_date(F.col("study_date")), text.format_dicom_date(F.col("birth_date"))
    return rows.select(
        "series_uid",
        dos.alias("dos"),
        dob.alias("dob"),
        text.format_dicom_time(F.col("series_uid")).alias("time_text"),
        text.age_at_scan(dob, dos).alias("age"),
    )


@query(
    "F20 F21",
    with_tables(
        f"""select path, cat, case cat when 'A' then 0 when 'B' then 1 when 'D' then 2 else 3 end as class_code,
  case string_split(path, '/')[4] when 'NC' then 0 when 'ART' then 1 when 'VEN' then 2 end as phase_code
from (select path, {ck.CLASS_CASE.format(c="string_split(path, '/')[2]")} as cat from voi_files)""",
        "voi_files",
    ),
)
def class_codes(spark, sf):
    files = table(spark, sf, "voi_files").select("path")
    category = text.collapse_class(text.class_from_path(F.col("path")), strict=True)
    folder = F.get(F.reverse(F.split("path", "/")), F.lit(1))
    return files.select(
        "path",
        category.alias("cat"),
        text.class_code(category).alias("class_code"),
        text.phase_code(folder).alias("phase_code"),
    )


@query(
    "F25",
    with_tables(
        """select case when pid like 'TCGA-__-____%' then 'tcga' else 'generic' end as dataset_type
from (select arg_min(tag_patient_id, directory) as pid from series)""",
        "series",
    ),
)
def dataset_type(spark, sf):
    return ops.dataset_type(header_tags(table(spark, sf, "series")))


@query(
    "F26",
    with_tables(
        f"""select series_uid, nullif(iop_raw, '') as image_orientation, modality, {_TAG_VALUES} from series""",
        "series",
    ),
)
def series_metadata(spark, sf):
    headers = header_tags(table(spark, sf, "series"))
    return headers.select("series_uid", ops.select_metadata(F.col("tags")).alias("m")).select("series_uid", "m.*")


# ---- filters, labels, manifest ---------------------------------------------------------------------------


@query("P1", _screened_sql("select series_uid, num_slices, reason from screened"))
def filter_series(spark, sf):
    return screened(spark, sf).select("series_uid", "num_slices", "reason")


@query("P2", _manifest_sql("select series_ord, phase from manifest where phase = 'art'"))
def phase_filter(spark, sf):
    return ops.phase_filter(manifest_rows(spark, sf), "ART").select("series_ord", "phase")


@query(
    "J2 S5",
    with_tables(f'with {_CLASSES} select pid as patient_id, grp as "group", cid as case_id, first_ord from classes', "label_rows"),
)
def load_class_labels(spark, sf):
    return class_labels(spark, sf)


@query("J3 S6 J13", with_tables(f"with {_ALIASES} select * from aliases", "alias_labels"))
def load_alias_labels(spark, sf):
    _, aliases = ops.load_conversion_labels(alias_table(spark, sf), "ukbonn")
    return aliases.select("alias", "row_ord", "ukb_anonym", "ukb_id", "manual_label", "n_rows")


_ALIAS_PATIENTS = """
alias_patients as (select concat('ANONYM-X', cast(c_custkey % 5 as varchar)) as patient_id, c_custkey as k from customer
  union all select cast(c_custkey * 3 as varchar), c_custkey from customer)
"""


def alias_patients(spark: SparkSession, sf: str) -> DataFrame:
    """Patient ids that partly match the alias labels."""
    rows = table(spark, sf, "customer")
    named = rows.select(F.concat(F.lit("ANONYM-X"), (F.col("c_custkey") % 5).cast("string")).alias("patient_id"), F.col("c_custkey").alias("k"))
    return named.union(rows.select((F.col("c_custkey") * 3).cast("string"), "c_custkey"))


_ATTACHED = f"""
attached as (select p.patient_id, p.k, coalesce(a.ukb_anonym, b.ukb_anonym, '') as ukb_anonym, coalesce(a.ukb_id, b.ukb_id, '') as ukb_id,
  coalesce(a.manual_label, b.manual_label, '') as manual_label,
  case when coalesce(a.alias, b.alias) is null then '' else 'labels.csv' end as label_source
  from alias_patients p left join aliases a on a.alias = p.patient_id left join aliases b on b.alias = {ck.key('p.patient_id')})
"""


@query("J4", with_tables(f"with {_ALIASES}, {_ALIAS_PATIENTS}, {_ATTACHED} select * from attached", "alias_labels"))
def attach_alias_labels(spark, sf):
    aliases = ops.load_alias_labels(alias_table(spark, sf))
    found = ops.attach_alias_labels(alias_patients(spark, sf), aliases)
    return found.select("patient_id", "k", "ukb_anonym", "ukb_id", "manual_label", "label_source")


@query(
    "J5",
    with_tables(
        f"""with {_ALIASES}, {_ALIAS_PATIENTS}, {_ATTACHED},
hit as (select distinct row_ord from aliases where alias in (
  select {ck.key('ukb_anonym')} from attached where label_source <> '' union select {ck.key('ukb_id')} from attached where label_source <> ''
  union select {ck.key('patient_id')} from attached where label_source <> ''))
select ord, anonym, id from alias_labels where ord not in (select row_ord from hit)""",
        "alias_labels",
    ),
)
def unmatched_labels(spark, sf):
    labels = alias_table(spark, sf)
    aliases = ops.load_alias_labels(labels)
    manifest = ops.attach_alias_labels(alias_patients(spark, sf), aliases)
    left = ops.unmatched_labels(labels, aliases, manifest)
    return left.select("ord", F.col("Anonym").alias("anonym"), F.col("ID").alias("id"))


@query("J1", _manifest_sql('select patient_id, grp as "group" from grouped'))
def lookup_group(spark, sf):
    patients = screened(spark, sf).where("reason is null").select("patient_id").distinct()
    return ops.lookup_group(patients, class_labels(spark, sf))


@query("W1", _manifest_sql("select patient_id, case_id, first_seen from cased"))
def assign_case_ids(spark, sf):
    kept = screened(spark, sf).where("reason is null")
    patients = kept.groupBy("patient_id").agg(F.min("series_ord").alias("first_seen"))
    mapped = class_labels(spark, sf).select("patient_id", F.col("case_id").alias("mapped_case"))
    return ops.assign_case_ids(patients.join(mapped, "patient_id", "left")).select("patient_id", "case_id", "first_seen")


@query("W1", _manifest_sql("select case_id, count(*) as n_patients from cased group by 1 having count(*) > 1"))
def case_id_collisions(spark, sf):
    return ops.case_id_collisions(assign_case_ids(spark, sf))


@query("S8 W2 J1 J2 F26", _manifest_sql("select " + ", ".join(f'"{c}"' for c in _SHOWN) + " from manifest"))
def manifest(spark, sf):
    return manifest_rows(spark, sf).select(*_SHOWN)


@query("A3", _manifest_sql('select "group", phase, count(*) as n_series, count(distinct patient_id) as n_patients from manifest group by 1, 2'))
def manifest_group_phase(spark, sf):
    return (
        manifest_rows(spark, sf)
        .groupBy("group", "phase")
        .agg(F.count("*").alias("n_series"), F.countDistinct("patient_id").alias("n_patients"))
    )


@query(
    "A1",
    _screened_sql(f"with read as (select * from described where read_error is null) {_STATS}"),
)
def discovery_stats(spark, sf):
    return ops.discovery_stats(ops.describe_series(series_headers(spark, sf)))


@query(
    "A2",
    _screened_sql("""select patient_id, count(distinct root) as n_roots, string_agg(distinct root, ',' order by root) as roots
from described where read_error is null group by 1 having count(distinct root) > 1"""),
)
def duplicate_patients(spark, sf):
    found = ops.describe_series(series_headers(spark, sf))
    return ops.duplicate_patients(found.where(ops.readable(found)))


@query(
    "A3 J5 A1 A2",
    _manifest_sql(f"""with read as (select * from described where read_error is null), stats as ({_STATS}),
keys as (select {ck.key('ukb_anonym')} as k from manifest where label_source <> '' union select {ck.key('ukb_id')} from manifest where label_source <> '' union select {ck.key('patient_id')} from manifest where label_source <> '')
select 'total' as section, 'total_patients' as item, (select count(distinct patient_id) from manifest) as n
union all select 'total', 'total_series_discovered', (select count(*) from manifest) + (select count(*) from screened where reason is not null)
union all select 'total', 'successful_conversions', (select count(*) from manifest)
union all select 'total', 'failed_conversions', (select count(*) from measured where error is not null)
union all select 'total', 'skipped_series', (select count(*) from screened where reason is not null)
union all select 'group', "group", count(*) from manifest group by 2
union all select 'phase', phase, count(*) from manifest group by 2
union all select concat('stat_', stat), value, n from stats
union all select 'duplicate_patient', patient_id, count(distinct root) from read group by 2 having count(distinct root) > 1
union all select 'label', 'labels_loaded', (select count(*) from alias_labels)
union all select 'label', 'label_keys_loaded', (select count(*) from aliases)
union all select 'label', 'matched_patients', (select count(distinct patient_id) from manifest where label_source <> '')
union all select 'label', 'unmatched_rows', (select count(*) from alias_labels where ord not in (select row_ord from aliases where alias in (select k from keys)))
union all select 'duplicate_label_key', alias, n_rows from aliases where n_rows > 1"""),
)
def conversion_summary(spark, sf):
    found = cut_lineage(screened(spark, sf))
    rows = cut_lineage(converted_series(spark, sf, found))
    done = ops.converted(rows)
    labels = alias_table(spark, sf)
    report = ops.label_report(labels, ops.load_alias_labels(labels), done)
    return ops.conversion_summary(done, found.where("reason is not null"), ops.conversion_failures(rows), found, report)


@query("A3", _manifest_sql("select series_ord, patient_id, directory as series_path, error from measured where error is not null"))
def failed_conversions(spark, sf):
    return ops.conversion_failures(converted_series(spark, sf))


@query("A3 P1", _screened_sql("select series_uid, directory, read_error as error from described where read_error is not null"))
def unreadable_series(spark, sf):
    return ops.unreadable_series(ops.describe_series(series_headers(spark, sf)))


@query(
    "A3",
    _screened_sql("""select series_ord, patient_id, series_uid, directory, reason from screened where reason is not null"""),
)
def skipped_details(spark, sf):
    return ops.skipped_details(screened(spark, sf).where("reason is not null"))


@query(
    "S9",
    with_tables(
        rf"""with {_HEADER_PHASE}
select filename, case when patient <> '' then patient else regexp_extract(filename, 'case_\d{{5}}') end as patient_id,
  regexp_extract(filename, 'case_\d{{5}}') as case_id, {ck.normalize_class("coalesce(nullif(assigned, ''), 'NG')")} as "group", phase, phase_source,
  regexp_extract(filename, '^(\d+)_', 1)::int as scan_idx, {_DIR_PLANE} as scan_plane, {_DIR_TEXT} as image_orientation,
  concat(study_date[1:4], '-', study_date[5:6], '-', study_date[7:8]) as "DOS",
  case when study_time <> '' then '10:15:30' end as study_time, nullif(description, '') as series_description,
  sx as spacing_x, nz as dim_z, nz as num_slices, 'generic' as dataset_type, 'generated' as validation from hp""",
        "image_headers",
    ),
)
def manifest_from_image_headers(spark, sf):
    rows = ops.manifest_from_image_headers(image_meta(table(spark, sf, "image_headers")), pattern=CASE_PATTERN)
    return rows.select(
        "filename", "patient_id", "case_id", "group", "phase", "phase_source", "scan_idx", "scan_plane",
        "image_orientation", "DOS", "study_time", "series_description", "spacing_x", "dim_z", "num_slices",
        "dataset_type", "validation",
    )
