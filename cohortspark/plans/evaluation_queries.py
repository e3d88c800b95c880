"""Queries on predictions, metrics, runs, embeddings, the radiomics study and stored tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions import text
from cohortspark.operators import evaluation as ev
from cohortspark.operators import models
from cohortspark.operators import radiomics as rad
from cohortspark.operators import cohort, study
from cohortspark.operators import series as series_ops
from cohortspark.operators import voxels as vx
from cohortspark.plans import cohort_queries as cq
from cohortspark.plans import series_queries as sq
from cohortspark.plans import voxel_queries as vq
from cohortspark.plans.registry import REGISTRY, query
from cohortspark.scale import shuffled
from cohortspark.session import staged, staging_path
from cohortspark.sources import state
from cohortspark.sources import tables as io
from cohortspark.sources.derived import table, with_tables

K = 3


def r6(c):
    return F.round(c, 6)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    probs = F.array("p_raw0", "p_raw1", "p_raw2")
    return table(spark, sf, "predictions").select(
        "id", "label", probs.alias("probs"), ev.argmax_prediction(probs).alias("pred")
    )


_PRED = """
pr as (select *, case when p_raw0 >= p_raw1 and p_raw0 >= p_raw2 then 0 when p_raw1 >= p_raw2 then 1 else 2 end as pred from predictions),
cells as (select l.l as label, p.p as pred, (select count(*) from pr where pr.label = l.l and pr.pred = p.p) as n from unnest(range(0, 3)) l(l), unnest(range(0, 3)) p(p)),
prf as (select c.c as class, sum(n) filter (where label = c.c and pred = c.c) as tp, sum(n) filter (where label <> c.c and pred = c.c) as fp,
  sum(n) filter (where label = c.c and pred <> c.c) as fn from cells, unnest(range(0, 3)) c(c) group by 1),
prs as (select *, tp / (tp + fp + 1e-12) as p, tp / (tp + fn + 1e-12) as r from prf),
sc as (select 0 as class, id, p_raw0 as score, (label = 0)::int as pos from pr union all select 1, id, p_raw1, (label = 1)::int from pr union all select 2, id, p_raw2, (label = 2)::int from pr),
cum as (select class, id, score, pos, sum(pos) over w as tp, row_number() over w as seen, sum(pos) over (partition by class) as np, count(*) over (partition by class) as nn
  from sc window w as (partition by class order by score desc, id)),
pts as (select *, tp / np as tpr, (seen - tp) / (nn - np) as fpr from cum)"""


def _pred_sql(body):
    return with_tables(f"with {_PRED}\n{body}", "predictions")


@query("A22", _pred_sql("select id, label, pred from pr"))
def argmax_prediction(spark, sf):
    return predictions(spark, sf).select("id", "label", "pred")


@query("A20", _pred_sql("select label, pred, n, round(coalesce(n / nullif(sum(n) over (partition by label), 0), 0), 6) as share from cells"))
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(predictions(spark, sf), K).withColumn("share", r6("share"))


@query(
    "A21",
    _pred_sql("""select round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(2 * p * r / (p + r + 1e-12)), 6) as f1,
  round((select count(*) filter (where label = pred) / count(*) from pr), 6) as accuracy from prs"""),
)
def macro_prf(spark, sf):
    out = ev.macro_prf(predictions(spark, sf), K)
    return out.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "W3",
    # shares are rounded as whole numbers: round() of a double takes some halves down
    _pred_sql("""select class, score as threshold, id, (2000000 * (seen - tp) + nn - np) // (2 * (nn - np)) / 1e6 as fpr, (2000000 * tp + np) // (2 * np) / 1e6 as tpr from pts
union all select unnest(range(0, 3)), 'inf'::double, null, 0, 0"""),
)
def roc_curve(spark, sf):
    out = ev.roc_curve(ev.score_rows(predictions(spark, sf), K))
    return out.withColumns({"fpr": r6("fpr"), "tpr": r6("tpr")})


@query(
    "W3 tie-collapsed",
    _pred_sql("""select class, score as threshold, max(id) as id, round(arg_max(fpr, seen), 6) as fpr, round(arg_max(tpr, seen), 6) as tpr from pts group by 1, 2
union all select unnest(range(0, 3)), 'inf'::double, null, 0, 0"""),
)
def roc_curve_by_score(spark, sf):
    out = ev.roc_curve(ev.score_rows(predictions(spark, sf), K), collapse_ties=True)
    return out.withColumns({"fpr": r6("fpr"), "tpr": r6("tpr")})


_AUC = """
trap as (select class, tpr, fpr, seen, score, coalesce(lag(tpr) over w, 0) as t0, coalesce(lag(fpr) over w, 0) as f0 from pts window w as (partition by class order by seen)),
auc as (select class, sum((fpr - f0) * (tpr + t0) / 2) as auc from trap group by 1),
best as (select class, score, tpr, fpr from pts qualify row_number() over (partition by class order by tpr - fpr desc, seen) = 1)"""


@query(
    "W4 W5",
    _pred_sql("").replace("\n", "\n").rstrip() + "," + _AUC
    + """ select a.class, round(auc, 6) as auc, case when tpr - fpr > 0 then score else 'inf'::double end as threshold,
  round(case when tpr - fpr > 0 then tpr else 0 end, 6) as sensitivity, round(case when tpr - fpr > 0 then 1 - fpr else 1 end, 6) as specificity
from auc a join best b on a.class = b.class""",
)
def auc_youden(spark, sf):
    out = ev.roc_summary(ev.score_rows(predictions(spark, sf), K))
    return out.select("class", r6("auc").alias("auc"), "threshold", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


@query(
    "W3 W4 binary",
    _pred_sql("").rstrip() + "," + _AUC
    + """ select round(auc, 6) as auc, case when tpr - fpr > 0 then score else 'inf'::double end as threshold,
  round(case when tpr - fpr > 0 then tpr else 0 end, 6) as sensitivity, round(case when tpr - fpr > 0 then 1 - fpr else 1 end, 6) as specificity
from auc a join best b on a.class = b.class where a.class = 2""",
)
def binary_roc(spark, sf):
    """The last class against the others; here one outcome is an error."""
    rows = ev.require_both_classes(ev.binary_rows(predictions(spark, sf), K - 1))
    return ev.roc_summary(rows).select(r6("auc").alias("auc"), "threshold", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


@query("W5", _pred_sql("").rstrip() + "," + _AUC + " select round(avg(auc), 6) as macro_auc, count(*) as n_classes from auc")
def ovr_auc(spark, sf):
    out = ev.macro_auc(ev.roc_summary(ev.score_rows(predictions(spark, sf), K)))
    return out.withColumn("macro_auc", r6("macro_auc"))


# ---- reconstruction --------------------------------------------------------------------------------------


def _pairs(spark, sf):
    return table(spark, sf, "voxels").select(
        F.col("voi_id").alias("batch"), "label", (F.col("hu") / 1000).alias("x"), (F.col("hu_rec") / 1000).alias("x_hat")
    )


@query(
    "A23",
    with_tables(
        """with e as (select voi_id as batch, avg(abs(hu - hu_rec) / 1000) as l1, avg((hu / 1000 - hu_rec / 1000) * (hu / 1000 - hu_rec / 1000)) as mse from voxels group by 1)
select batch, round(l1, 6) as l1, round(mse, 8) as mse, round(-10 * log10(mse), 4) as psnr_eval, round(20 * log10(2.0) - 10 * log10(mse), 4) as psnr_train,
  round(least(1, greatest(0, 1 - l1)), 6) as similarity from e""",
        "voxels",
    ),
)
def reconstruction_quality(spark, sf):
    one = ev.reconstruction_quality(_pairs(spark, sf), 1.0)
    two = ev.reconstruction_quality(_pairs(spark, sf), 2.0).select("batch", F.round("psnr", 4).alias("psnr_train"))
    return one.select(
        "batch", r6("l1").alias("l1"), F.round("mse", 8).alias("mse"), F.round("psnr", 4).alias("psnr_eval"), r6("similarity").alias("similarity")
    ).join(two, "batch")


@query(
    "A24",
    with_tables(
        """select voi_id as batch, round(0.7 * coalesce(sum(abs(hu - hu_rec) / 1000) filter (where label = 2), 0) / greatest(count(*) filter (where label = 2), 1e-6)
  + 0.3 * coalesce(sum(abs(hu - hu_rec) / 1000) filter (where label <> 2), 0) / greatest(count(*) filter (where label <> 2), 1e-6), 6) as loss from voxels group by 1""",
        "voxels",
    ),
)
def weighted_masked_l1(spark, sf):
    out = ev.weighted_masked_l1(_pairs(spark, sf), F.col("label") == 2, 0.7, 0.3)
    return out.withColumn("loss", r6("loss"))


def latents(spark: SparkSession, sf: str) -> DataFrame:
    """Halves of an embedding as mean and deviation."""
    as_double = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 8).alias("batch"),
        F.slice(as_double, 1, 32).alias("mu"),
        F.transform(F.slice(as_double, 33, 32), lambda v: F.abs(v) + 0.05).alias("sigma"),
    )


_LATENT = """
lat as (select vec_id, vec_id % 8 as batch, unnest(embedding[1:32])::double as m, unnest(embedding[33:64])::double as raw, generate_subscripts(embedding[1:32], 1) - 1 as c from embeddings),
kls as (select vec_id, batch, 0.5 * sum(m * m + (abs(raw) + 0.05) * (abs(raw) + 0.05) - ln(greatest((abs(raw) + 0.05) * (abs(raw) + 0.05), 1e-6)) - 1) as kl from lat group by 1, 2)"""


@query("A25", f"with {_LATENT} select batch, round(avg(kl), 6) as kl from kls group by 1")
def kl_divergence(spark, sf):
    return ev.kl_divergence(latents(spark, sf)).withColumn("kl", r6("kl"))


@query(
    "A26",
    f"""with {_LATENT}, pool as (select vec_id, c // 4 as ch, avg(m) as v from lat group by 1, 2),
nrm as (select vec_id, ch, v / greatest(sqrt(sum(v * v) over (partition by vec_id)), 1e-12) as p from pool)
select vec_id, """
    + ", ".join(f"round(max(p) filter (where ch = {i}), 6) as p{i}" for i in range(8))
    + " from nrm group by 1",
)
def mean_pool_l2(spark, sf):
    out = ev.mean_pool_l2(latents(spark, sf), 8)
    return out.select("vec_id", *[r6(F.col("pooled")[i]).alias(f"p{i}") for i in range(8)])


@query(
    "A27",
    with_tables(
        f"""with {_LATENT},
q as (select voi_id, avg(abs(hu - hu_rec) / 1000) as l1, avg((hu - hu_rec) * (hu - hu_rec) / 1e6) as mse from voxels group by 1),
b as (select case when q.voi_id % 3 = 0 then 'val' else 'train' end as split, l1, case when q.voi_id % 7 <> 0 then kl end as kl, l1 / 2 as pl, -10 * log10(mse) as psnr, 1 - l1 as sim
  from q join kls on kls.vec_id = q.voi_id)
select split, round(avg(l1), 6) as recon_loss, round(avg(0.1 * kl), 6) as kl_loss, round(avg(pl), 6) as perceptual_loss, round(avg(l1 + 0.1 * kl + 0.5 * pl), 6) as total_loss,
  round(avg(psnr), 4) as psnr, round(avg(sim), 6) as similarity from b where kl is not null group by 1""",
        "voxels",
    ),
)
def evaluation_aggregate(spark, sf):
    quality = ev.reconstruction_quality(_pairs(spark, sf), 1.0)
    kl = latents(spark, sf).select(F.col("vec_id").alias("batch"), ev.kl_per_sample(F.col("mu"), F.col("sigma")).alias("kl"))
    b = F.col("batch")
    batches = quality.join(kl, "batch").select(
        F.when(b % 3 == 0, "val").otherwise("train").alias("split"),
        F.col("l1").alias("recon_loss"),
        F.when(b % 7 != 0, F.col("kl")).alias("kl"),
        (F.col("l1") / 2).alias("perceptual_loss"),
        "psnr",
        "similarity",
    )
    out = ev.evaluation_aggregate(batches, 0.1, 0.5)
    digits = {"psnr": 4}
    return out.select("split", *[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns if c != "split"])


# ---- metrics ---------------------------------------------------------------------------------------------

_HIST = """
hist as (select tag, epoch, arg_max(value, ord) as value from metric_events where not starts_with(tag, 'step_') group by 1, 2)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    return ev.upsert_metrics(table(spark, sf, "metric_events"))


def _hist_sql(body):
    return with_tables(f"with {_HIST}\n{body}", "metric_events")


@query("U1", _hist_sql("select * from hist"))
def upsert_metrics(spark, sf):
    return history(spark, sf)


@query("U1 stored", _hist_sql("select * from hist"))
def metric_state(spark, sf):
    """A resumed run: later events first, an earlier part that comes late, and the same part again."""
    at = state.metrics_state(staging_path(spark, "metrics"))
    rows = ev.metric_rows(table(spark, sf, "metric_events"))
    for part in (1, 2, 0, 2):
        state.merge_delivery(spark, at, rows.where(F.col("ord") % 3 == part))
    return state.read_state(spark, at).drop("ord")


@query(
    "U2 F29",
    _hist_sql("""select regexp_replace(tag, '/(train|val|test)$', '') as base_tag, regexp_extract(tag, '/(train|val|test)$', 1) as split, count(*) as n_points,
  min(epoch) as first_epoch, max(epoch) as last_epoch, case when tag like 'Loss%' then 'Loss (a.u.)' else 'PSNR (dB)' end as label, 1.0 as scale,
  case when tag like 'Loss%' then 'loss' else 'psnr' end as slug from hist where not starts_with(tag, 'LR/') group by tag"""),
)
def metric_groups(spark, sf):
    return ev.metric_groups(history(spark, sf))


@query(
    "F29 F30",
    """with t as (select distinct p_name, p_type, concat(p_type, '/', lower(p_brand), '_f1/val') as tag from part)
select p_name, tag, regexp_replace(tag, '/val$', '') as base, 'val' as split, 'F1 (%)' as label, 100.0 as scale,
  trim(regexp_replace(lower(tag), '[^a-z0-9]+', '_', 'g'), '_') as slug, concat(upper(substring(replace(replace(p_type, '_', ' '), '/', ' '), 1, 1)), substring(replace(replace(p_type, '_', ' '), '/', ' '), 2)) as title,
  case when starts_with(concat('val_', p_name), 'val_') then 'val' end as mon_split, p_name as mon_key from t""",
)
def metric_tags(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_name", "p_type", F.concat("p_type", F.lit("/"), F.lower("p_brand"), F.lit("_f1/val")).alias("tag")
    ).distinct()
    tag = text.split_metric_tag(F.col("tag"))
    spec = text.axis_spec(tag["base"])
    monitor = text.parse_monitor_name(F.concat(F.lit("val_"), "p_name"))
    return rows.select(
        "p_name", "tag", tag["base"].alias("base"), tag["split"].alias("split"), spec["label"].alias("label"), spec["scale"].alias("scale"),
        text.slugify(F.col("tag")).alias("slug"), text.humanize(F.col("p_type")).alias("title"),
        monitor["split"].alias("mon_split"), monitor["key"].alias("mon_key"),
    )


@query(
    "W6",
    _hist_sql("""select tag, epoch, value, coalesce(value < b, true) as improved, least(value, b) as best
from (select *, min(value) over (partition by tag order by epoch rows between unbounded preceding and 1 preceding) as b from hist)"""),
)
def running_best(spark, sf):
    return ev.running_best(history(spark, sf), ["tag"], "min")


@query(
    "J11",
    _hist_sql("""select t.epoch, 'Loss' as "group", t.value as train, v.value as val from hist t join hist v on t.epoch = v.epoch and t.tag = 'Loss/train' and v.tag = 'Loss/val'"""),
)
def paired_epoch_metrics(spark, sf):
    tag = text.split_metric_tag(F.col("tag"))
    rows = history(spark, sf).select("epoch", F.lower(tag["base"]).alias("key"), tag["split"].alias("split"), "value")
    return ev.paired_epoch_metrics(rows)


@query(
    "P4",
    with_tables("select ord, epoch, value from metric_events where tag = 'step_train_loss' and ord % 50 = 0", "metric_events"),
)
def step_thinning(spark, sf):
    steps = table(spark, sf, "metric_events").where("tag = 'step_train_loss'")
    return ev.step_thinning(steps, 50, "ord").select("ord", "epoch", "value")


_STEPS = """
steps as (select epoch, ord // 3 as batch, case ord % 3 when 0 then 'loss' when 1 then 'PSNR' else 'SSIM' end as key, value from metric_events),
bt as (select epoch, count(distinct batch) as nb, count(distinct batch) filter (where key = 'PSNR') as np from steps group by 1)"""


@query(
    "A19",
    with_tables(
        f"""with {_STEPS} select s.epoch, s.key, round(sum(value) / greatest(1, case when s.key = 'PSNR' then max(np) else max(nb) end), 9) as value
from steps s join bt on bt.epoch = s.epoch where s.key = 'loss' or np > 0 group by 1, 2""",
        "metric_events",
    ),
)
def epoch_average(spark, sf):
    o = F.col("ord")
    steps = table(spark, sf, "metric_events").select(
        "epoch", F.expr("ord div 3").alias("batch"),
        F.when(o % 3 == 0, "loss").when(o % 3 == 1, "PSNR").otherwise("SSIM").alias("key"), "value",
    )
    return ev.epoch_average(steps).withColumn("value", F.round("value", 9))


@query(
    "A18",
    with_tables(
        """with f as (select fold, case when epoch % 2 = 0 then 'val' else 'train' end as split, tag as metric, avg(value) as value from metric_events group by 1, 2, 3)
select split, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(*) as n_folds from f group by 1, 2""",
        "metric_events",
    ),
)
def fold_summary(spark, sf):
    split = F.when(F.col("epoch") % 2 == 0, "val").otherwise("train").alias("split")
    folds = table(spark, sf, "metric_events").groupBy("fold", split, F.col("tag").alias("metric")).agg(F.avg("value").alias("value"))
    out = ev.fold_summary(folds)
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


_RANK = """case artifact when 'checkpoint_best.pth' then 0 when 'checkpoints/checkpoint_best.pth' then 1 when 'checkpoints/best_vae.pth' then 3 end"""
_BESTS = f"""
ranked as (select *, {_RANK} as p from run_artifacts),
bests as (select fold, run, arg_min(artifact, p) as artifact, arg_min(mtime, p) as mtime, bool_or(has_config) as has_config from ranked where p is not null group by 1, 2)"""


@query("W8", with_tables(f"with {_BESTS} select fold, run, artifact, mtime from bests", "run_artifacts"))
def best_artifact(spark, sf):
    return ev.best_artifact(table(spark, sf, "run_artifacts")).select("fold", "run", "artifact", "mtime")


@query(
    "W7",
    with_tables(
        f"""with {_BESTS},
lat as (select distinct fold, run from run_artifacts where is_latest),
cand as (select coalesce(b.fold, l.fold) as fold, coalesce(b.run, l.run) as run, b.artifact, b.mtime, b.has_config, l.run is not null as is_latest
  from bests b full join lat l on l.fold = b.fold and l.run = b.run),
top as (select * from cand qualify row_number() over (partition by fold order by is_latest desc, mtime desc nulls last, run desc) = 1)
select fold, run, artifact from top where artifact is not null and has_config""",
        "run_artifacts",
    ),
)
def latest_run_per_fold(spark, sf):
    return ev.latest_run_per_fold(table(spark, sf, "run_artifacts"))


# ---- stored tables: written to the shared folder and read back -------------------------------------------


@query("S4 S5", with_tables(
    "select patient_id, coalesce(nullif(case_raw, 'nan'), '') as case_raw, count(*) as n from label_rows group by 1, 2", "label_rows"))
def label_table_from_csv(spark, sf):
    path = staging_path(spark, "labels")
    table(spark, sf, "label_rows").select("patient_id", "class_raw", "case_raw").write.csv(path, header=True)
    return io.read_label_table(spark, path).groupBy("patient_id", "case_raw").agg(F.count("*").alias("n"))


@query("S7 S8", sq._manifest_sql('select filename, patient_id, case_id, "group", phase, scan_idx, "DOS", age_at_scan, image_orientation, num_slices from manifest'))
def manifest_from_csv(spark, sf):
    path = staging_path(spark, "manifest")
    io.write_manifest(sq.manifest_rows(spark, sf).drop("series_ord"), path, "csv")
    rows = io.read_manifest(spark, path, series_ops.MANIFEST_COLUMNS, "csv")
    return rows.select("filename", "patient_id", "case_id", "group", "phase", "scan_idx", "DOS", "age_at_scan", "image_orientation", "num_slices")


@query("S8 partitioned", sq._manifest_sql('select filename, "group", phase from manifest where phase = \'ven\''))
def manifest_by_partition(spark, sf):
    path = staging_path(spark, "manifest")
    io.write_manifest(sq.manifest_rows(spark, sf), path, partition=True)
    return io.read_manifest(spark, path, []).where("phase = 'ven'").select("filename", "group", "phase")


@query("S14", vq._with_vox("with recursive " + vq._LESIONS + "\nselect voi_id::varchar as voi_id, lesion_id, volume_vox, round(cx, 6) as cx, dz as size_z from kept"))
def lesions_from_json(spark, sf):
    path = staging_path(spark, "lesions")
    io.write_lesions(vq.catalog_rows(spark, sf), path)
    return io.read_lesions(spark, path).select(
        "voi_id", "lesion_id", "volume_vox", r6(F.col("centroid_vox")[0]).alias("cx"), F.col("bbox_size_vox")[2].alias("size_z")
    )


@query("S15", cq._split_sql("select fold, split, patient_id from splits"))
def splits_from_parquet(spark, sf):
    path = staging_path(spark, "splits")
    io.write_splits(cq.build_splits(spark, sf), path)
    return io.read_splits(spark, path).select("fold", "split", "patient_id")


@query("S16", vq._with_vox(
    """select round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(median(v), 6) as median, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.75), 6) as p75
from (select least(greatest(hu, -200), 300) as v from voxels where label in (1, 2))"""))
def fingerprint_stats(spark, sf):
    stats = vx.intensity_stats(table(spark, sf, "voxels"))
    fields = F.struct("mean", "std", "median", "p25", "p75")
    payload = stats.agg(
        F.struct(
            F.struct(F.max(F.when(F.col("kind") == "windowed", fields)).alias("channel_0")).alias("windowed_intensity"),
            F.struct(F.max(F.when(F.col("kind") == "raw", fields)).alias("channel_0")).alias("foreground_intensity"),
        ).alias("f")
    ).select(F.to_json("f").alias("value"))
    read = io.read_fingerprint_stats(F.col("value"))
    return payload.select(*[r6(c).alias(n) for n, c in read.items()])


@query("S17", _hist_sql("select tag, epoch, value from hist"))
def history_from_json(spark, sf):
    return io.history_points(io.history_json(history(spark, sf)))


@query("S18", _hist_sql("""select epoch, max(value) filter (where tag = 'LR/generator') as lr, max(value) filter (where tag = 'Loss/train') as loss_train,
  max(value) filter (where tag = 'Loss/val') as loss_val, max(value) filter (where tag = 'Psnr/val') as psnr_val from hist group by 1"""))
def history_wide(spark, sf):
    tags = {"LR/generator": "lr", "Loss/train": "loss_train", "Loss/val": "loss_val", "Psnr/val": "psnr_val"}
    return ev.history_wide(history(spark, sf), list(tags)).withColumnsRenamed(tags)


@query("S13", sq._manifest_sql("""select count(*) as n_series, count(distinct patient_id) as n_patients from manifest"""))
def json_report(spark, sf):
    row = sq.manifest_rows(spark, sf).agg(F.count("*").alias("n_series"), F.countDistinct("patient_id").alias("n_patients"))
    path = staging_path(spark, "report")
    io.json_report(row).write.text(path)
    return spark.read.schema("n_series bigint, n_patients bigint").json(path)


# ---- embeddings ------------------------------------------------------------------------------------------


@query("M1")
def linear_probe(spark, sf):
    rows = table(spark, sf, "embeddings")
    # labels are spread over the vectors, so a hash of the id splits them evenly
    part = F.pmod(F.xxhash64("vec_id"), F.lit(5))
    return models.linear_probe(rows.where(part > 0), rows.where(part == 0))


@query(
    "M1 by what SQL can check",
    """select label, count(*) filter (where vec_id % 5 <> 0) as n_train, count(*) filter (where vec_id % 5 = 0) as n_val,
  (count(*) filter (where vec_id % 5 <> 0))::double as fitted, true as sums_to_one from embeddings group by 1""",
)
def linear_probe_checks(spark, sf):
    """A fitted softmax with biases gives each class, summed over the training rows, as much probability as it has rows.

    No other classifier does; so the sums show that the weights are the optimum, which SQL can tell from the labels alone.
    """
    rows = table(spark, sf, "embeddings")
    train = F.col("vec_id") % 5 != 0
    scored = models.probe_scores(rows, models.fit_probe(rows.where(train), iterations=1000))
    per_class = (
        scored.where(train)
        .select(F.posexplode("probs").alias("label", "p"))
        .groupBy(F.col("label").cast("bigint").alias("label"))
        .agg(F.round(F.sum("p"), 1).alias("fitted"))
    )
    total = F.aggregate("probs", F.lit(0.0), lambda t, v: t + v)
    counts = scored.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_val"), F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one")
    )
    return counts.join(per_class, "label").select("label", "n_train", "n_val", "fitted", "sums_to_one")


@query("M2")
def embedding_projection(spark, sf):
    return models.embedding_projection(table(spark, sf, "embeddings"))


@query(
    "M2 by what SQL can check",
    """with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
per as (select i, var_samp(v) as s from x group by 1)
select count(*) as n_components, round(sum(s), 5) as total_variance, true as falling, 0.0 as largest_covariance from per""",
)
def projection_checks(spark, sf):
    """All components together have the variance of the vectors, are uncorrelated, and the first has the most."""
    rows = table(spark, sf, "embeddings")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    placed = models.embedding_projection(rows, dims)
    spread = placed.agg(
        *[F.var_samp(f"c{i}").alias(f"s{i}") for i in range(dims)], *[F.covar_samp("c0", f"c{i}").alias(f"k{i}") for i in range(1, dims)]
    )
    variances = [F.col(f"s{i}") for i in range(dims)]
    falling = F.forall(F.sequence(F.lit(1), F.lit(dims - 1)), lambda i: F.array(*variances)[i] <= F.array(*variances)[i - 1] + 1e-9)
    return spread.select(
        F.lit(dims).cast("bigint").alias("n_components"),
        F.round(sum(variances[1:], variances[0]), 5).alias("total_variance"),
        falling.alias("falling"),
        F.abs(F.round(F.greatest(*[F.abs(F.col(f"k{i}")) for i in range(1, dims)]), 6)).alias("largest_covariance"),
    )


# ---- radiomics -------------------------------------------------------------------------------------------

_ROI = """
roi as (select voi_id, x, y, z, hu from voxels where label = 2 and hu between -150 and 250),
lev as (select r.voi_id, x, y, z, hu, (floor(hu / 25) - floor(min(hu) over (partition by r.voi_id) / 25) + 1)::int as level from roi r)"""


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return rad.discretize(rad.roi_voxels(table(spark, sf, "voxels")))


def _roi_sql(body, *more):
    return with_tables(f"with {_ROI}\n{body}", "voxels", *more)


_FO = """
mom as (select voi_id, count(*) as n, avg(hu) as m, sum(hu * hu) as e, min(hu) as lo, max(hu) as hi, var_pop(hu) as v from roi group by 1),
dev as (select r.voi_id, avg(abs(hu - m)) as mad, avg((hu - m) * (hu - m) * (hu - m)) as m3, avg((hu - m) * (hu - m) * (hu - m) * (hu - m)) as m4 from roi r join mom on mom.voi_id = r.voi_id group by 1),
hst as (select voi_id, floor(hu / 25) as b, count(*) as k from roi group by 1, 2),
ent as (select h.voi_id, sum(-(k / n) * log2(k / n)) as entropy, sum((k / n) * (k / n)) as uniformity from hst h join mom on mom.voi_id = h.voi_id group by 1),
pct as (select voi_id, median(hu) as md, quantile_cont(hu, 0.1) as p10, quantile_cont(hu, 0.9) as p90, quantile_cont(hu, 0.75) - quantile_cont(hu, 0.25) as iqr from roi group by 1),
fo as (select m.voi_id, n, round(e, 4) as energy, round(e * (0.8::double * 0.8::double * (1 + m.voi_id % 4)), 4) as total_energy, round(entropy, 6) as entropy, round(uniformity, 6) as uniformity,
  round(lo, 6) as minimum, round(hi, 6) as maximum, round(m, 6) as mean, round(md, 6) as median, round(p10, 6) as p10, round(p90, 6) as p90, round(iqr, 6) as iqr, round(hi - lo, 6) as range,
  round(mad, 6) as mad, round(sqrt(e / n), 6) as rms, round(v, 4) as variance, round(case when v > 1e-9 then m3 / (v * sqrt(v)) end, 4) as skewness, round(case when v > 1e-9 then m4 / (v * v) end, 4) as kurtosis
  from mom m join dev d on d.voi_id = m.voi_id join ent on ent.voi_id = m.voi_id join pct on pct.voi_id = m.voi_id)"""


@query("Q7", with_tables(f"with {_ROI}, {_FO} select * from fo", "voxels"))
def firstorder_features(spark, sf):
    out = rad.firstorder_features(rad.roi_voxels(table(spark, sf, "voxels")), table(spark, sf, "volumes"))
    digits = {"energy": 4, "total_energy": 4, "variance": 4, "skewness": 4, "kurtosis": 4}
    return out.select("voi_id", "n", *[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns[2:]])


@query(
    "Q8",
    with_tables(
        """with s as (select voi_id, x * 0.8::double as x, y * 0.8::double as y, z * (1.0::double + voi_id % 4) as z, x as ix, y as iy, z as iz from voxels where label = 2),
c as (select voi_id, count(*) as n, var_pop(x) as xx, var_pop(y) as yy, var_pop(z) as zz, covar_pop(x, y) as xy, covar_pop(x, z) as xz, covar_pop(y, z) as yz,
  (max(ix) - min(ix) + 1) * 0.8 as ex, (max(iy) - min(iy) + 1) * 0.8 as ey, (max(iz) - min(iz) + 1) * (1 + voi_id % 4) as ez from s group by 1),
q as (select *, (xx + yy + zz) / 3 as q from c),
p as (select *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) as p from q),
d as (select *, (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz) as det from p),
f as (select *, acos(case when p > 0 then greatest(-1, least(1, det / (2 * p * p * p))) else 1 end) / 3 as phi from d),
l as (select *, q + 2 * p * cos(phi) as l1, q + 2 * p * cos(phi + 2 * pi() / 3) as l3 from f)
select voi_id, n, round(n * (0.8::double * 0.8::double * (1 + voi_id % 4)), 6) as voxel_volume, round(ex, 6) as extent_x, round(ey, 6) as extent_y, round(ez, 6) as extent_z,
  round(4 * sqrt(greatest(l1, 0)), 2) as major_axis, round(4 * sqrt(greatest(3 * q - l1 - l3, 0)), 2) as minor_axis, round(4 * sqrt(greatest(l3, 0)), 2) as least_axis from l""",
        "voxels",
    ),
)
def shape_features(spark, sf):
    out = rad.shape_features(table(spark, sf, "voxels"), table(spark, sf, "volumes"))
    return out.select(
        "voi_id", "n", r6("voxel_volume").alias("voxel_volume"), *[r6(f"extent_{a}").alias(f"extent_{a}") for a in "xyz"],
        *[F.round(c, 2).alias(c) for c in ("major_axis", "minor_axis", "least_axis")],
    )


_DIRS = "dirs as (select * from (values " + ", ".join(f"({i}, {d[0]}, {d[1]}, {d[2]})" for i, d in enumerate(rad.DIRECTIONS)) + ") t(direction, dx, dy, dz))"
_GLCM = (
    _DIRS
    + """,
pairs as (select a.voi_id, d.direction, a.level as i, b.level as j, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by, b.z as bz from lev a, dirs d, lev b
  where b.voi_id = a.voi_id and b.x = a.x + d.dx and b.y = a.y + d.dy and b.z = a.z + d.dz),
glcm as (select voi_id, direction, i, j, count(*) as n from (select voi_id, direction, i, j from pairs union all select voi_id, direction, j, i from pairs) group by 1, 2, 3, 4)"""
)


@query("Q9", _roi_sql("").rstrip() + "," + _GLCM + " select * from glcm")
def glcm_counts(spark, sf):
    return rad.glcm_counts(levels(spark, sf))


@query(
    "Q9",
    _roi_sql("").rstrip() + "," + _GLCM
    + """, tot as (select voi_id, direction, sum(n) as t, sum(n * i) / sum(n) as mu, sum(n * i * i) / sum(n) - (sum(n * i) / sum(n)) * (sum(n * i) / sum(n)) as var from glcm group by 1, 2),
f as (select g.voi_id, g.direction, sum(n / t * (i - j) * (i - j)) as contrast, sum((n / t) * (n / t)) as energy,
  case when max(var) > 1e-12 then (sum(n / t * i * j) - max(mu) * max(mu)) / max(var) else 1 end as correlation from glcm g join tot on tot.voi_id = g.voi_id and tot.direction = g.direction group by 1, 2)
select voi_id, round(avg(contrast), 6) as contrast, round(avg(energy), 6) as energy, round(avg(correlation), 6) as correlation from f group by 1""",
)
def glcm_features(spark, sf):
    out = rad.glcm_features(rad.glcm_counts(levels(spark, sf)))
    return out.select("voi_id", *[r6(c).alias(c) for c in ("contrast", "energy", "correlation")])


@query(
    "Q10",
    with_tables(
        "with recursive " + _ROI + "," + _DIRS
        + """,
starts as (select a.voi_id, d.direction, a.level, a.x, a.y, a.z, 1 as len, d.dx, d.dy, d.dz from lev a, dirs d where not exists (select 1 from lev b
  where b.voi_id = a.voi_id and b.level = a.level and b.x = a.x - d.dx and b.y = a.y - d.dy and b.z = a.z - d.dz)),
walk as (select * from starts union all select w.voi_id, w.direction, w.level, b.x, b.y, b.z, w.len + 1, w.dx, w.dy, w.dz from walk w join lev b
  on b.voi_id = w.voi_id and b.level = w.level and b.x = w.x + w.dx and b.y = w.y + w.dy and b.z = w.z + w.dz),
runs as (select voi_id, direction, level, x - (len - 1) * dx as sx, y - (len - 1) * dy as sy, z - (len - 1) * dz as sz, max(len) as length from walk group by all)
select voi_id, direction, level, length, count(*) as n from runs group by 1, 2, 3, 4""",
        "voxels",
    ),
)
def glrlm_counts(spark, sf):
    return rad.glrlm_counts(levels(spark, sf))


@query(
    "Q11",
    with_tables(
        "with recursive " + _ROI + "," + vq._cc_sql("zone", "true", 26, extra="level").replace("from voxels", "from lev")
        + """,
sized as (select voi_id, level, component, count(*) as size from zone group by 1, 2, 3)
select voi_id, level, size, count(*) as n from sized group by 1, 2, 3""",
        "voxels",
    ),
)
def glszm_counts(spark, sf):
    return rad.glszm_counts(levels(spark, sf))


_NB = _GLCM + """,
nb as (select a.voi_id, a.x, a.y, a.z, a.level, count(b.voi_id) as k, sum(b.level) as total, count(*) filter (where b.level = a.level) as alike from lev a left join lev b
  on a.voi_id = b.voi_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and abs(a.z - b.z) <= 1 and not (a.x = b.x and a.y = b.y and a.z = b.z) group by all)"""


@query("Q12", _roi_sql("").rstrip() + "," + _NB + " select voi_id, level, alike + 1 as dependence, count(*) as n from nb group by 1, 2, 3")
def gldm_counts(spark, sf):
    return rad.gldm_counts(levels(spark, sf))


@query(
    "Q12",
    _roi_sql("").rstrip() + "," + _NB + " select voi_id, level, count(*) as n, round(sum(abs(level - total / k)), 6) as s from nb where k > 0 group by 1, 2",
)
def ngtdm_counts(spark, sf):
    return rad.ngtdm_counts(levels(spark, sf)).withColumn("s", r6("s"))


_GLCM_ALL = """, tot as (select voi_id, direction, sum(n) as t from glcm group by 1, 2),
p as (select voi_id, direction, i, j, n / t as p, (select max(level) from lev where lev.voi_id = g.voi_id) as ng from glcm g join tot using (voi_id, direction)),
mu as (select voi_id, direction, sum(p * i) as mu, sum(p * i * i) - sum(p * i) * sum(p * i) as v from p group by 1, 2),
px as (select voi_id, direction, -sum(p * log2(p)) as hx from (select voi_id, direction, i, sum(p) as p from p group by 1, 2, 3) group by 1, 2),
pd as (select voi_id, direction, -sum(p * log2(p)) as hd, sum(k * p) as da, sum(case when k > 0 then p / (k * k) else 0 end) as iv from (select voi_id, direction, abs(i - j) as k, sum(p) as p from p group by 1, 2, 3) group by 1, 2),
dv as (select voi_id, direction, sum(p * (abs(i - j) - da) * (abs(i - j) - da)) as dv from p join pd using (voi_id, direction) group by 1, 2),
ps as (select voi_id, direction, -sum(p * log2(p)) as hs from (select voi_id, direction, i + j as k, sum(p) as p from p group by 1, 2, 3) group by 1, 2),
f as (select voi_id, direction, sum(p * i * j) as autocorrelation, max(mu) as joint_average, sum(p * pow(i + j - 2 * mu, 2)) as cluster_tendency, sum(p * pow(i + j - 2 * mu, 3)) as cluster_shade,
  sum(p * pow(i + j - 2 * mu, 4)) as cluster_prominence, sum(p * (i - j) * (i - j)) as contrast, case when max(v) > 1e-12 then sum(p * (i - mu) * (j - mu)) / max(v) else 1 end as correlation,
  max(da) as difference_average, max(dv) as difference_variance, max(hd) as difference_entropy, sum(p * p) as joint_energy, -sum(p * log2(p)) as joint_entropy, max(hx) as hx,
  sum(p / (1 + abs(i - j))) as id, sum(p / (1 + (i - j) * (i - j))) as idm, sum(p / (1 + abs(i - j) / ng)) as idn, sum(p / (1 + (i - j) * (i - j) / (ng * ng))) as idmn, max(iv) as inverse_variance,
  max(p) as maximum_probability, sum(p * (i + j)) as sum_average, max(hs) as sum_entropy, sum(p * (i - mu) * (i - mu)) as sum_squares
  from p join mu using (voi_id, direction) join px using (voi_id, direction) join pd using (voi_id, direction) join dv using (voi_id, direction) join ps using (voi_id, direction) group by 1, 2),
g as (select *, case when hx > 1e-12 then (joint_entropy - 2 * hx) / hx else 0 end as imc1, sqrt(greatest(1 - exp(-2 * (2 * hx - joint_entropy)), 0)) as imc2 from f)"""
_GLCM_NAMES = [
    "autocorrelation", "joint_average", "cluster_tendency", "cluster_shade", "cluster_prominence", "contrast", "correlation", "difference_average",
    "difference_variance", "difference_entropy", "joint_energy", "joint_entropy", "imc1", "imc2", "id", "idm", "idn", "idmn", "inverse_variance",
    "maximum_probability", "sum_average", "sum_entropy", "sum_squares",
]


def _rounded(name: str, value: str | None = None) -> str:
    """Rounded a little off the middle, so that halves fall to the same side in both engines."""
    return f"round({value or f'avg({name})'} + 1e-8, 5) as {name}"


def r5(name: str):
    return F.round(F.col(name) + 1e-8, 5).alias(name)


@query("Q9", _roi_sql("").rstrip() + "," + _GLCM + _GLCM_ALL + " select voi_id, " + ", ".join(map(_rounded, _GLCM_NAMES)) + " from g group by 1")
def glcm_feature_table(spark, sf):
    lev = levels(spark, sf)
    out = rad.glcm_feature_table(rad.glcm_counts(lev), rad.largest_level(lev))
    return out.select("voi_id", *[r5(c) for c in _GLCM_NAMES])


_EMPHASIS = """, m as (select *, sum(n) over (partition by {keys}) as t from cnt),
lv as (select {keys}, sum(k * k) as sq from (select {keys}, level, sum(n) as k from cnt group by all) group by all),
sz as (select {keys}, sum(k * k) as sq from (select {keys}, {size}, sum(n) as k from cnt group by all) group by all),
ctr as (select {keys}, sum(n / t * level) as ml, sum(n / t * {size}) as ms from m group by all),
f as (select voi_id, sum(n / t / ({size} * {size})) as short_emphasis, sum(n / t * {size} * {size}) as long_emphasis, max(lv.sq) / max(t) as level_nonuniformity, max(lv.sq) / (max(t) * max(t)) as level_nonuniformity_normalized,
  max(sz.sq) / max(t) as size_nonuniformity, max(sz.sq) / (max(t) * max(t)) as size_nonuniformity_normalized, max(t) / sum(n * {size}) as percentage, sum(n / t * (level - ml) * (level - ml)) as level_variance,
  sum(n / t * ({size} - ms) * ({size} - ms)) as size_variance, -sum(n / t * log2(n / t)) as entropy, sum(n / t / (level * level)) as low_level_emphasis, sum(n / t * level * level) as high_level_emphasis,
  sum(n / t / (level * level * {size} * {size})) as short_low_emphasis, sum(n / t * level * level / ({size} * {size})) as short_high_emphasis, sum(n / t * {size} * {size} / (level * level)) as long_low_emphasis,
  sum(n / t * level * level * {size} * {size}) as long_high_emphasis from m join lv using ({keys}) join sz using ({keys}) join ctr using ({keys}) group by {group})"""
_EMPHASIS_NAMES = [
    "short_emphasis", "long_emphasis", "level_nonuniformity", "level_nonuniformity_normalized", "size_nonuniformity", "size_nonuniformity_normalized",
    "percentage", "level_variance", "size_variance", "entropy", "low_level_emphasis", "high_level_emphasis", "short_low_emphasis", "short_high_emphasis",
    "long_low_emphasis", "long_high_emphasis",
]


def _emphasis_sql(counts: str, size: str, keys: str = "voi_id") -> str:
    """``counts`` is the whole check text of the counts; its last select becomes a table."""
    starts = [m.start() for m in re.finditer(r"\bselect\b", counts)]
    at = next(i for i in reversed(starts) if counts.count("(", 0, i) == counts.count(")", 0, i))
    head, last = counts[:at], counts[at + len("select") :]
    return head + ", cnt as (select" + last + ")" + _EMPHASIS.format(keys=keys, size=size, group=keys) + " select voi_id, " + ", ".join(map(_rounded, _EMPHASIS_NAMES)) + " from f group by 1"


def _emphasis(counts, size, extra=()):
    out = rad.emphasis_features(counts, size, extra)
    return out.select("voi_id", *[r5(c) for c in _EMPHASIS_NAMES])


@query("Q10", _emphasis_sql(REGISTRY["glrlm_counts"].sql, "length", "voi_id, direction"))
def glrlm_features(spark, sf):
    return _emphasis(rad.glrlm_counts(levels(spark, sf)), "length", ["direction"])


@query("Q11", _emphasis_sql(REGISTRY["glszm_counts"].sql, "size"))
def glszm_features(spark, sf):
    return _emphasis(rad.glszm_counts(levels(spark, sf)), "size")


@query("Q12", _emphasis_sql(REGISTRY["gldm_counts"].sql, "dependence"))
def gldm_features(spark, sf):
    return _emphasis(rad.gldm_counts(levels(spark, sf)), "dependence")


_NGTDM_NAMES = ["coarseness", "contrast", "busyness", "complexity", "strength"]


@query(
    "Q12",
    _roi_sql("").rstrip() + "," + _NB
    + """, c as (select voi_id, level, count(*) as n, sum(abs(level - total / k)) as s from nb where k > 0 group by 1, 2),
w as (select *, n / sum(n) over (partition by voi_id) as p, sum(n) over (partition by voi_id) as t, sum(s) over (partition by voi_id) as all_s, count(*) over (partition by voi_id) as ngp from c),
f as (select a.voi_id, max(a.t) as t, max(a.all_s) as all_s, max(a.ngp) as ngp, sum(a.p * b.p * (a.level - b.level) * (a.level - b.level)) as spread, sum(abs(a.level * a.p - b.level * b.p)) as uneven,
  sum(abs(a.level - b.level) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) as complexity, sum((a.p + b.p) * (a.level - b.level) * (a.level - b.level)) as strong from w a join w b on a.voi_id = b.voi_id group by 1),
ps as (select voi_id, sum(p * s) as ps from w group by 1)
select voi_id, round(case when ps > 1e-12 then 1 / ps else 1e6 end + 1e-8, 5) as coarseness, round(case when ngp > 1 then spread / (ngp * (ngp - 1)) * all_s / t else 0 end + 1e-8, 5) as contrast,
  round(case when uneven > 1e-12 then ps / uneven else 0 end + 1e-8, 5) as busyness, round(complexity / t + 1e-8, 5) as complexity, round(case when all_s > 1e-12 then strong / all_s else 0 end + 1e-8, 5) as strength from f join ps using (voi_id)""",
)
def ngtdm_features(spark, sf):
    out = rad.ngtdm_features(rad.ngtdm_counts(levels(spark, sf)))
    return out.select("voi_id", *[r5(c) for c in _NGTDM_NAMES])


# study rows: one per VOI, features of the region, some values missing
_FEATURES = ["mean", "energy", "maximum", "sparse"]
_STUDY = (
    _ROI
    + """,
feat as (select voi_id, avg(hu) as mean, sum(hu * hu) as energy, case when voi_id % 10 = 0 then null else max(hu) end as maximum, case when voi_id % 3 = 0 then null else min(hu) end as sparse from roi group by 1),
study as (select f.*, concat('p', voi_id // 3) as patient_id, case voi_id // 3 % 7 when 0 then 'A' when 1 then 'C' when 2 then 'AB' when 3 then 'B' when 4 then 'BC' when 5 then 'D' else 'AD' end as class_raw,
  case when voi_id % 3 = 0 then 'art' else 'ven' end as contrast_phase from feat f),
merged as (select *, case class_raw when 'C' then 'A' when 'AB' then 'A' when 'AC' then 'A' when 'BC' then 'B' else class_raw end as group_label from study),
kept_groups as (select * from merged where group_label in ('A', 'B')),
cohort as (select patient_id, group_label, contrast_phase, avg(mean) as mean, avg(energy) as energy, avg(maximum) as maximum, count(*) as n_vois from kept_groups group by 1, 2, 3),
lng as (select patient_id, group_label, contrast_phase, 'mean' as feature, mean as value from cohort union all select patient_id, group_label, contrast_phase, 'energy', energy from cohort
  union all select patient_id, group_label, contrast_phase, 'maximum', maximum from cohort where maximum is not null)"""
)


def study_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("voi_id")
    roi = rad.roi_voxels(table(spark, sf, "voxels"))
    features = roi.groupBy("voi_id").agg(
        F.avg("hu").alias("mean"), F.sum(F.col("hu") * F.col("hu")).alias("energy"), F.max("hu").alias("maximum"), F.min("hu").alias("sparse")
    )
    classes = F.array(*[F.lit(c) for c in ("A", "C", "AB", "B", "BC", "D", "AD")])
    return features.select(
        v.alias("sample_id"),
        F.concat(F.lit("p"), F.expr("voi_id div 3").cast("string")).alias("patient_id"),
        classes[F.expr("voi_id div 3 % 7").cast("int")].alias("class_raw"),
        F.when(v % 3 == 0, "art").otherwise("ven").alias("contrast_phase"),
        "mean",
        "energy",
        F.when(v % 10 != 0, F.col("maximum")).alias("maximum"),
        F.when(v % 3 != 0, F.col("sparse")).alias("sparse"),
    )


def study_cohort(spark, sf) -> DataFrame:
    return rad.patient_cohort(rad.merge_groups(rad.missingness_filter(study_rows(spark, sf))))


def _study_sql(body):
    return with_tables(f"with {_STUDY}\n{body}", "voxels")


@query("Q2", _study_sql("select voi_id as sample_id, class_raw, group_label from kept_groups"))
def merge_groups(spark, sf):
    return rad.merge_groups(study_rows(spark, sf)).select("sample_id", "class_raw", "group_label")


@query("Q3", _study_sql(" union all ".join(f"select '{f}' as feature, round(avg(({f} is null)::int), 6) as missing from study" for f in _FEATURES)))
def missingness(spark, sf):
    return rad.missingness(study_rows(spark, sf)).withColumn("missing", r6("missing"))


@query("Q4 Q3", _study_sql("select patient_id, group_label, contrast_phase, round(mean, 6) as mean, round(energy, 4) as energy, round(maximum, 6) as maximum, n_vois from cohort"))
def patient_cohort(spark, sf):
    return study_cohort(spark, sf).withColumns({"mean": r6("mean"), "energy": F.round("energy", 4), "maximum": r6("maximum")})


@query("Q5", _study_sql("""select feature, group_label, contrast_phase, count(*) as n, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std, round(median(value), 4) as median,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) as iqr from lng group by 1, 2, 3"""))
def describe_groups(spark, sf):
    out = rad.describe_groups(rad.unpivot(study_cohort(spark, sf), _FEATURES[:3]))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median", "iqr")})


_COMPARE_SQL = """, rk as (select *, rank() over w + (count(*) over (partition by feature, contrast_phase, value) - 1) / 2 as r, count(*) over (partition by feature, contrast_phase, value) as t
  from lng window w as (partition by feature, contrast_phase order by value)),
s as (select feature, contrast_phase, count(*) filter (where group_label = 'A') as n_a, count(*) filter (where group_label = 'B') as n_b, count(*) as n,
  sum(r) filter (where group_label = 'A') as ra, sum(t * t - 1) as ties from rk group by 1, 2),
u as (select *, ra - n_a * (n_a + 1) / 2 as u from s),
v as (select *, n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1))) as v from u),
z as (select * exclude (v), case when v > 0 then (u - n_a * n_b / 2) / sqrt(v) else 0 end as z from v),
p as (select *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) as k from z),
pp as (select *, ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-z * z / 2) as p from p),
h as (select *, least(1, (count(*) over (partition by contrast_phase) - row_number() over (partition by contrast_phase order by p, feature) + 1) * p) as h from pp)
select feature, contrast_phase, n_a, n_b, round(u, 4) as u, round(z, 6) as z, round(2 * u / (n_a * n_b) - 1, 6) as effect, round(p, 6) as p,
  round(max(h) over (partition by contrast_phase order by p, feature rows unbounded preceding), 6) as p_holm from h"""


@query("Q6", _study_sql(_COMPARE_SQL).replace("\n, rk", ", rk"))
def compare_groups(spark, sf):
    out = rad.compare_groups(rad.unpivot(study_cohort(spark, sf), _FEATURES[:3]))
    return out.withColumns({"u": F.round("u", 4), **{c: r6(c) for c in ("z", "effect", "p", "p_holm")}})


# ---- the whole study -------------------------------------------------------------------------------------

_SHAPE_NAMES = ["voxel_volume", "extent_x", "extent_y", "extent_z", "major_axis", "minor_axis", "least_axis"]
_FIRST_ORDER_NAMES = [
    "energy", "total_energy", "entropy", "uniformity", "minimum", "maximum", "mean", "median", "p10", "p90", "iqr", "range", "mad", "rms",
    "variance", "skewness", "kurtosis",
]
_FAMILIES = {
    "firstorder": ("firstorder_features", _FIRST_ORDER_NAMES),
    "shape": ("shape_features", _SHAPE_NAMES),
    "glcm": ("glcm_feature_table", _GLCM_NAMES),
    "glrlm": ("glrlm_features", _EMPHASIS_NAMES),
    "glszm": ("glszm_features", _EMPHASIS_NAMES),
    "gldm": ("gldm_features", _EMPHASIS_NAMES),
    "ngtdm": ("ngtdm_features", _NGTDM_NAMES),
}
_DIGITS = {"energy": 4, "total_energy": 4, "variance": 4, "skewness": 4, "kurtosis": 4, "major_axis": 2, "minor_axis": 2, "least_axis": 2}


def _whole_study_sql(body: str) -> str:
    families = ",\n".join(f"fam_{f} as ({REGISTRY[q].sql})" for f, (q, _) in _FAMILIES.items())
    columns = ", ".join(f"fam_{f}.{c}::double as {f}_{c}" for f, (_, names) in _FAMILIES.items() for c in names)
    joins = " ".join(f"left join fam_{f} on fam_{f}.voi_id = keyed.vid" for f in _FAMILIES)
    return with_tables(
        f"""with {cq._MASKS},
idx as (select distinct voi_id as sample_id, string_split(mask_path, '/')[1] as class_raw, string_split(mask_path, '/')[2] as patient_id,
  lower(string_split(mask_path, '/')[3]) as contrast_phase, mask_path from vois where image_path is not null),
keyed as (select idx.*, k.vid from idx join (select substring(path, 8) as rel, min(ord) as vid from voi_files group by 1) k on k.rel = idx.mask_path
  where k.vid in (select vec_id from embeddings)),
{families},
wide as (select sample_id, class_raw, patient_id, contrast_phase, {columns} from keyed {joins}),
tall as (select * from wide unpivot include nulls (value for feature in (columns(* exclude (sample_id, class_raw, patient_id, contrast_phase))))),
usable as (select feature from tall group by 1 having avg((value is null)::int) <= 0.2),
merged as (select *, case class_raw when 'C' then 'A' when 'AB' then 'A' when 'AC' then 'A' when 'BC' then 'B' else class_raw end as group_label
  from tall where feature in (select feature from usable)),
lng as (select patient_id, group_label, contrast_phase, feature, round(avg(value), 6) as value from merged where group_label in ('A', 'B') and value is not null group by 1, 2, 3, 4)
{body}""",
        "voi_files",
        "file_table",
    )


def _study_keys(spark, sf):
    return table(spark, sf, "voi_files").groupBy(F.substring("path", 8, 1 << 30).alias("mask_path")).agg(F.min("ord").alias("voi_id"))


def _study_long(spark, sf):
    """From files and voxels to patient means; features are rounded as in the queries of their families."""
    index = cohort.index_vois(table(spark, sf, "file_table"), phase="all")
    volumes = table(spark, sf, "volumes")
    found = staged(study.indexed_volumes(index, _study_keys(spark, sf), volumes), "index")
    voxels = table(spark, sf, "voxels").join(shuffled(found.select("voi_id")), "voi_id", "left_semi")
    families = study.feature_families(voxels, volumes)
    textures = ("glcm", "glrlm", "glszm", "gldm", "ngtdm")
    rounded = {
        f: rows.select("voi_id", *[r5(c) if f in textures else F.round(c, _DIGITS.get(c, 6)).alias(c) for c in _FAMILIES[f][1]])
        for f, rows in families.items()
    }
    return study.study_rows(study.feature_table(found, rounded))


@query("Q1 Q2 Q3 Q4 Q6 Q7 Q8 Q9 Q10 Q11 Q12 run-all", _whole_study_sql("select * from (with " + _COMPARE_SQL.lstrip(", \n") + ")"))
def whole_study(spark, sf):
    out = rad.compare_groups(staged(_study_long(spark, sf), "study"))
    return out.withColumns({"u": F.round("u", 4), **{c: r6(c) for c in ("z", "effect", "p", "p_holm")}})
