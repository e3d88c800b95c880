"""Linear probe and projection of embeddings with the ML library."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_probe(train: DataFrame, reg: float = 1e-4, iterations: int = 100) -> DataFrame:
    """The fitted linear classifier of ``label, embedding`` as a table, one row per class: ``class, bias, weights``.

    One number per class and component, which does not grow with the rows.  Two classes have one row each, too.
    """
    as_vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    model = LogisticRegression(regParam=reg, maxIter=iterations, family="multinomial").fit(train.select("label", as_vector))
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(c, float(bias[c]), [float(w) for w in weights[c]]) for c in range(len(bias))]
    return train.sparkSession.createDataFrame(rows, "class int, bias double, weights array<double>")


def probe_scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with ``probs`` (by class) and ``prediction``, the most probable class, the smaller one of equals."""
    fitted = weights.agg(F.array_sort(F.collect_list(F.struct("class", "bias", "weights"))).alias("_fit"))
    vector = F.col("embedding").cast("array<double>")
    dot = lambda w: F.aggregate(F.zip_with(vector, w, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    # one row of weights, joined by a scalar; scores less the largest, so that no exponential overflows
    scored = rows.withColumn("_fit", fitted.scalar()).withColumn("_s", F.transform("_fit", lambda c: c["bias"] + dot(c["weights"])))
    top = F.array_max("_s")
    powers = scored.withColumn("_p", F.transform("_s", lambda v: F.exp(v - top)))
    total = F.aggregate("_p", F.lit(0.0), lambda t, v: t + v)
    return (
        powers.withColumn("probs", F.transform("_p", lambda v: v / total))
        .withColumn("prediction", F.get("_fit", (F.array_position("_s", top) - 1).cast("int"))["class"])
        .drop("_fit", "_s", "_p")
    )


def linear_probe(train: DataFrame, val: DataFrame, reg: float = 1e-4, iterations: int = 100) -> DataFrame:
    """Accuracy on ``val`` of a linear classifier fitted on ``train`` (``label, embedding``)."""
    scored = probe_scores(val, fit_probe(train, reg, iterations))
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return scored.agg(F.avg(hit).alias("probe_acc"), F.count("*").alias("n"))


def embedding_projection(embeddings: DataFrame, dims: int = 2) -> DataFrame:
    """Main-component coordinates ``vec_id, label, c0, c1, ...``."""
    rows = embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    placed = PCA(k=dims, inputCol="features", outputCol="pc").fit(rows).transform(rows)
    coords = vector_to_array("pc")
    return placed.select("vec_id", "label", *[coords[i].alias(f"c{i}") for i in range(dims)])
