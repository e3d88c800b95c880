"""Predictions, ROC curves, metric histories and run selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import text
from cohortspark.scale import last_per_key, running


# ---- classification --------------------------------------------------------------------------------------


def argmax_prediction(probs: Column) -> Column:
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def class_pairs(predictions: DataFrame, num_classes: int) -> DataFrame:
    """Counts of every (label, pred) pair, zero pairs included; K x K rows from here on."""
    grid = predictions.sparkSession.range(num_classes * num_classes).select(
        (F.col("id") / num_classes).cast("int").alias("label"), (F.col("id") % num_classes).cast("int").alias("pred")
    )
    counts = predictions.groupBy("label", "pred").agg(F.count("*").alias("n"))
    return grid.join(counts, ["label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_matrix(predictions: DataFrame, num_classes: int) -> DataFrame:
    """``label, pred, n, share`` with rows normalised; an empty row has share 0."""
    pairs = class_pairs(predictions, num_classes)
    total = F.sum("n").over(Window.partitionBy("label"))
    return pairs.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def per_class_prf(predictions: DataFrame, num_classes: int, eps: float = 1e-12) -> DataFrame:
    pairs = class_pairs(predictions, num_classes)
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")),
                F.struct(F.col("pred").alias("class"), F.lit(0).alias("tp"), F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).alias("fn")),
            )
        )
    )
    counted = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision = F.col("tp") / (F.col("tp") + F.col("fp") + eps)
    recall = F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    return counted.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)
    )


def macro_prf(predictions: DataFrame, num_classes: int) -> DataFrame:
    """Accuracy and macro means, one row."""
    correct = class_pairs(predictions, num_classes).agg(
        (F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a")
    )
    return (
        per_class_prf(predictions, num_classes)
        .agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
        .withColumn("accuracy", correct.scalar())
    )


def score_rows(predictions: DataFrame, num_classes: int) -> DataFrame:
    """One-vs-rest rows ``class, id, score, positive``."""
    return predictions.select(
        "id", "label", F.posexplode(F.slice("probs", 1, num_classes)).alias("class", "score")
    ).select("class", "id", "score", (F.col("label") == F.col("class")).cast("int").alias("positive"))


def binary_rows(predictions: DataFrame, positive: int) -> DataFrame:
    """Rows of the one class ``positive``, scored by the last probability, for a curve that must exist."""
    return predictions.select(
        F.lit(positive).alias("class"), "id", F.element_at("probs", -1).alias("score"), (F.col("label") == positive).cast("int").alias("positive")
    )


def _totals(rows: DataFrame) -> DataFrame:
    # One row per class; classes with only one outcome have no curve.  Broadcast, as a join by class would put each into one task.
    totals = rows.groupBy("class").agg(F.sum("positive").alias("n_pos"), (F.count("*") - F.sum("positive")).alias("n_neg"))
    return F.broadcast(totals.where("n_pos > 0 and n_neg > 0"))


def roc_curve(rows: DataFrame, collapse_ties: bool = False, max_group_rows: int | None = None) -> DataFrame:
    """Points ``class, threshold, id, fpr, tpr`` by falling score; ties by id, or one point per score.

    The starting point has threshold infinity and id NULL.
    """
    limit = {} if max_group_rows is None else {"max_group_rows": max_group_rows}
    totals = _totals(rows)
    if collapse_ties:
        steps = rows.groupBy("class", "score").agg(
            F.sum("positive").alias("p"), F.count("*").alias("n"), F.max("id").alias("id")
        )
        order = [F.desc("score")]
    else:
        steps = rows.select("class", "score", "id", F.col("positive").alias("p"), F.lit(1).alias("n"))
        order = [F.desc("score"), F.col("id")]
    counted = running(steps, ["class"], order, {"tp": ("sum", F.col("p")), "seen": ("sum", F.col("n"))}, **limit)
    points = counted.join(totals, "class").select(
        "class",
        F.col("score").alias("threshold"),
        "id",
        ((F.col("seen") - F.col("tp")) / F.col("n_neg")).alias("fpr"),
        (F.col("tp") / F.col("n_pos")).alias("tpr"),
    )
    start = totals.select(
        "class",
        F.lit(float("inf")).alias("threshold"),
        F.lit(None).cast("bigint").alias("id"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return start.unionByName(points)


def require_both_classes(rows: DataFrame) -> DataFrame:
    """The rows, or an error where a class has only one outcome: a single curve must exist, one of several is left out."""
    outcomes = rows.groupBy("class").agg((F.min("positive") < F.max("positive")).alias("both"))
    if not outcomes.agg(F.bool_and(F.coalesce("both", F.lit(False)))).first()[0]:
        raise ValueError("cannot compute a ROC curve with only one class present")
    return rows


def roc_summary(rows: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Per class: AUC by trapezoids over single rows, and the first point with the largest TPR - FPR.

    A step to a positive has no width, a step to a negative has width 1 / n_neg and constant height, so the area
    is the mean of TPR over the negatives, and no previous point has to be looked up.
    """
    limit = {} if max_group_rows is None else {"max_group_rows": max_group_rows}
    counted = running(
        rows, ["class"], [F.desc("score"), F.col("id")], {"tp": ("sum", F.col("positive")), "seen": ("sum", F.lit(1))}, **limit
    ).join(_totals(rows), "class")
    tpr = F.col("tp") / F.col("n_pos")
    fpr = (F.col("seen") - F.col("tp")) / F.col("n_neg")
    # first maximum: compare by gain, then by the earlier position
    key = F.struct((tpr - fpr).alias("gain"), (-F.col("seen")).alias("early"))
    best = F.max_by(F.struct(F.col("score").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("gain")), key)
    found = counted.groupBy("class").agg(
        (F.sum(F.when(F.col("positive") == 0, F.col("tp"))) / (F.max("n_pos") * F.max("n_neg"))).alias("auc"), best.alias("b")
    )
    # the starting point (gain 0, threshold infinity) comes before every row, so only a gain above 0 beats it
    use = F.col("b.gain") > 0
    return found.select(
        "class",
        "auc",
        F.when(use, F.col("b.threshold")).otherwise(F.lit(float("inf"))).alias("threshold"),
        F.when(use, F.col("b.tpr")).otherwise(0.0).alias("sensitivity"),
        F.when(use, 1.0 - F.col("b.fpr")).otherwise(1.0).alias("specificity"),
    )


def macro_auc(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.avg("auc"), F.lit(0.0)).alias("macro_auc"), F.count("*").alias("n_classes"))


# ---- reconstruction and latents --------------------------------------------------------------------------


def reconstruction_quality(pairs: DataFrame, data_range: float = 1.0, by: str = "batch") -> DataFrame:
    """L1, MSE, PSNR (infinite without error) and ``1 - MAE / range`` from ``x, x_hat`` per batch."""
    diff = F.col("x_hat") - F.col("x")
    errors = pairs.groupBy(by).agg(F.avg(F.abs(diff)).alias("l1"), F.avg(diff * diff).alias("mse"))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(
        20 * F.log10(F.lit(data_range)) - 10 * F.log10(F.col("mse"))
    )
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("l1") / max(data_range, 1e-6)))
    return errors.withColumns({"psnr": psnr, "similarity": similarity})


def weighted_masked_l1(
    pairs: DataFrame, tumor: Column, tumor_weight: float = 1.0, other_weight: float = 1.0, by: str = "batch"
) -> DataFrame:
    loss = F.abs(F.col("x_hat") - F.col("x"))

    def mean(where):
        return F.coalesce(F.sum(F.when(where, loss)), F.lit(0.0)) / F.greatest(F.count_if(where), F.lit(1e-6))

    return pairs.groupBy(by).agg((tumor_weight * mean(tumor) + other_weight * mean(~tumor)).alias("loss"))


def kl_per_sample(mu: Column, sigma: Column, floor: float | None = 1e-6) -> Column:
    """Half the sum of mu^2 + sigma^2 - log sigma^2 - 1; training floors sigma^2, evaluation does not."""

    def term(m, s):
        var = s * s
        return m * m + var - F.log(var if floor is None else F.greatest(var, F.lit(floor))) - 1

    return 0.5 * F.aggregate(F.zip_with(mu, sigma, term), F.lit(0.0), lambda acc, t: acc + t)


def kl_divergence(latents: DataFrame, by: str = "batch", floor: float | None = 1e-6) -> DataFrame:
    return latents.groupBy(by).agg(F.avg(kl_per_sample(F.col("mu"), F.col("sigma"), floor)).alias("kl"))


def mean_pool_l2(latents: DataFrame, channels: int, column: str = "mu") -> DataFrame:
    """``pooled``: the mean of each channel's block of values, scaled to length one."""
    size = (F.size(column) / channels).cast("int")
    means = F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda c: F.aggregate(F.slice(F.col(column), c * size + 1, size), F.lit(0.0), lambda a, v: a + v) / size,
    )
    norm = F.sqrt(F.aggregate(F.col("_m"), F.lit(0.0), lambda a, v: a + v * v))
    return (
        latents.withColumn("_m", means)
        .withColumn("_n", F.greatest(norm, F.lit(1e-12)))
        .withColumn("pooled", F.transform("_m", lambda v: v / F.col("_n")))
        .drop("_m", "_n")
    )


def evaluation_aggregate(batches: DataFrame, kl_weight: float = 1.0, perceptual_weight: float = 1.0) -> DataFrame:
    """Mean of each metric per split; a batch that failed has NULLs and does not count.

    ``batches``: ``split, recon_loss, kl, perceptual_loss, psnr, similarity``.
    """
    weighted = batches.withColumn("kl_loss", kl_weight * F.col("kl")).withColumn(
        "total_loss", F.col("recon_loss") + F.col("kl_loss") + perceptual_weight * F.col("perceptual_loss")
    )
    usable = weighted.where(F.col("total_loss").isNotNull())
    names = ("recon_loss", "kl_loss", "perceptual_loss", "total_loss", "psnr", "similarity")
    return usable.groupBy("split").agg(*[F.avg(n).alias(n) for n in names])


# ---- metric histories ------------------------------------------------------------------------------------


def upsert_metrics(events: DataFrame, earlier: DataFrame | None = None, drop_nan: bool = False) -> DataFrame:
    """``tag, epoch, value``: the last value of each epoch.

    Step tags and values that are no number are left out; NaN only on import.  A resumed run starts from
    ``earlier`` (same columns without ``ord``).
    """
    rows = metric_rows(events, drop_nan)
    if earlier is not None:
        before = earlier.select("tag", "epoch", "value", F.lit(-1).cast("bigint").alias("ord"))
        rows = before.unionByName(rows.withColumn("ord", F.col("ord").cast("bigint")))
    return last_per_key(rows, ["tag", "epoch"], F.col("ord")).drop("ord")


def metric_rows(events: DataFrame, drop_nan: bool = False) -> DataFrame:
    """``tag, epoch, value, ord`` of the events that a history takes."""
    rows = events.select("tag", F.col("epoch").cast("int").alias("epoch"), F.col("value").try_cast("double").alias("value"), "ord")
    rows = rows.where(~F.col("tag").startswith("step_") & F.col("value").isNotNull())
    return rows.where(~F.isnan("value")) if drop_nan else rows


def metric_groups(history: DataFrame, excluded: str = "LR/") -> DataFrame:
    """Series by base tag and split with the axis label, as the progress plots show them."""
    named = history.where(~F.col("tag").startswith(excluded)).withColumn("_t", text.split_metric_tag(F.col("tag")))
    grouped = named.groupBy(
        F.col("_t.base").alias("base_tag"), F.coalesce("_t.split", F.lit("default")).alias("split")
    ).agg(F.count("*").alias("n_points"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))
    spec = text.axis_spec(F.col("base_tag"))
    return grouped.withColumns(
        {"label": spec["label"], "scale": spec["scale"], "slug": text.slugify(F.col("base_tag"))}
    )


def history_wide(history: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row per epoch, one column per tag."""
    return history.groupBy("epoch").agg(*[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in tags])


def running_best(history: DataFrame, keys: Sequence[str], mode: str = "min") -> DataFrame:
    """Best value so far and whether the epoch improved on it, strictly; NULL values are ignored."""
    if mode not in ("min", "max"):
        raise ValueError(f"unsupported mode {mode!r}")
    known = history.where(F.col("value").isNotNull())
    before = running(known, keys, [F.col("epoch")], {"_b": (mode, F.col("value"))}, inclusive=False)
    better = F.col("value") < F.col("_b") if mode == "min" else F.col("value") > F.col("_b")
    improved = F.col("_b").isNull() | better
    best = (F.least if mode == "min" else F.greatest)(F.col("value"), F.col("_b"))
    return before.withColumns({"improved": improved, "best": best}).drop("_b")


def paired_epoch_metrics(metrics: DataFrame) -> DataFrame:
    """``epoch, group, train, val`` of metrics present in both splits; ``metrics``: ``epoch, key, split, value``."""
    train = metrics.where("split = 'train'").select("epoch", "key", F.col("value").alias("train"))
    val = metrics.where("split = 'val'").select("epoch", "key", F.col("value").alias("val"))
    key = F.col("key")
    capital = F.concat(F.upper(F.substring(key, 1, 1)), F.lower(F.substring(key, 2, 1 << 30)))
    return train.join(val, ["epoch", "key"]).select("epoch", capital.alias("group"), "train", "val")


def step_thinning(steps: DataFrame, interval: int = 50, column: str = "global_step") -> DataFrame:
    return steps.where(F.pmod(F.col(column), F.lit(interval)) == 0)


def epoch_average(steps: DataFrame) -> DataFrame:
    """Mean per epoch and key over all batches; PSNR over the batches that have it, quality dropped without it.

    ``steps``: ``epoch, batch, key, value``.
    """
    batches = steps.groupBy("epoch", "batch").agg(F.max((F.col("key") == "PSNR").cast("int")).alias("p")).groupBy("epoch").agg(
        F.count("*").alias("n_batches"), F.sum("p").alias("n_psnr")
    )
    sums = steps.groupBy("epoch", "key").agg(F.sum("value").alias("s"))
    quality = F.col("key").isin("PSNR", "SSIM")
    mean = F.when(F.col("key") == "PSNR", F.col("s") / F.greatest(F.lit(1), F.col("n_psnr"))).otherwise(
        F.col("s") / F.greatest(F.lit(1), F.col("n_batches"))
    )
    return sums.join(batches, "epoch").where(~quality | (F.col("n_psnr") > 0)).select("epoch", "key", mean.alias("value"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of ``fold, split, metric, value``."""
    return folds.groupBy("split", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n_folds")
    )


# ---- runs and artifacts ----------------------------------------------------------------------------------


def artifact_priority(name: Column, mode: str = "autoencoder") -> Column:
    """Rank of a checkpoint name for a training mode; NULL for names that do not count."""
    aliases = {"autoencoder": "autoencoder", "vae": "autoencoder", "gan": "autoencoder", "classifier": "classifier"}
    mode = mode.lower()
    if mode not in aliases:
        raise ValueError(f"unknown training mode {mode!r}")
    modes = [mode, "autoencoder", "vae", "gan"] if aliases[mode] == "autoencoder" else [mode, aliases[mode]]
    names = ["checkpoint_best.pth", "checkpoints/checkpoint_best.pth"]
    names += [f"checkpoints/best_{m}.pth" for m in dict.fromkeys(modes)]
    rank = F.when(F.lit(False), F.lit(None))
    for i, candidate in enumerate(names):
        rank = rank.when(name == candidate, F.lit(i))
    return rank


def best_artifact(artifacts: DataFrame, mode: str = "autoencoder") -> DataFrame:
    """Per fold and run the preferred existing checkpoint."""
    ranked = artifacts.withColumn("_p", artifact_priority(F.col("artifact"), mode)).where("_p is not null")
    return ranked.groupBy("fold", "run").agg(
        F.min_by("artifact", "_p").alias("artifact"),
        F.min_by("mtime", "_p").alias("mtime"),
        F.bool_or("is_latest").alias("is_latest"),
        F.bool_or("has_config").alias("has_config"),
    )


def latest_run_per_fold(artifacts: DataFrame, mode: str = "autoencoder") -> DataFrame:
    """The run behind the ``latest`` pointer, else the newest with a checkpoint; left out if it lacks its
    configuration or checkpoint."""
    best = best_artifact(artifacts, mode)
    pointed = artifacts.where("is_latest").select("fold", "run").distinct().withColumn("_latest", F.lit(True))
    candidates = best.join(pointed, ["fold", "run"], "full")
    chosen = candidates.groupBy("fold").agg(
        F.max_by(
            F.struct("run", "artifact", "has_config"),
            F.struct(F.coalesce("_latest", F.lit(False)).alias("l"), F.col("mtime").alias("m"), F.col("run").alias("r")),
        ).alias("c")
    )
    return chosen.select("fold", "c.*").where("artifact is not null and has_config").drop("has_config")
