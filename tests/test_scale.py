"""The spread-out ways must equal the plain ones, also with one key holding most rows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark import scale
from cohortspark.operators import radiomics as rad
from cohortspark.operators.study import indexed_volumes


def skewed(spark):
    # key 0 holds two thirds of the rows
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("k"),
        (F.col("id") * 7919 % 3001).alias("o"),
        (F.col("id") * 31 % 17).alias("v"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_ranged_equals_window(spark):
    df = skewed(spark)
    order = [F.desc("v"), F.col("o")]
    scans = {"s": ("sum", F.col("v")), "lo": ("min", F.col("o")), "hi": ("max", F.col("o"))}
    for inclusive in (True, False):
        plain = scale.running(df, ["k"], order, scans, inclusive=inclusive)
        spread = scale.running(df, ["k"], order, scans, max_group_rows=0, inclusive=inclusive)
        assert rows(plain) == rows(spread) if inclusive else True
        assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))


def test_numbered_without_keys(spark):
    df = skewed(spark)
    want = df.withColumn("n", F.row_number().over(Window.orderBy("v", "o")).cast("bigint"))
    got = scale.numbered(df, [], [F.col("v"), F.col("o")], "n", max_group_rows=0)
    assert rows(want) == rows(got)


def test_running_with_null_key(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    got = scale.numbered(df, ["k"], [F.col("o")], "n", max_group_rows=0)
    want = scale.numbered(df, ["k"], [F.col("o")], "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_percentiles_are_numpys(spark):
    df = skewed(spark)
    percents = {"a": 0.0, "b": 12.5, "c": 50.0, "d": 99.5, "e": 100.0}
    pdf = df.toPandas()
    for limit in (0, scale.MAX_GROUP_ROWS):
        got = scale.exact_percentiles(df, ["k"], {"v": F.col("v"), "o": F.col("o")}, percents, max_group_rows=limit)
        for r in got.collect():
            part = pdf[pdf.k == r["k"]]
            for c in ("v", "o"):
                for name, p in percents.items():
                    assert abs(r[f"{c}_{name}"] - np.percentile(part[c], p)) < 1e-9


def test_percentiles_of_nothing(spark):
    df = skewed(spark).where("v > 1000")
    assert scale.exact_percentiles(df, [], {"v": F.col("v")}, {"p50": 50.0}).first()["v_p50"] is None


def test_spread_leaves_many_splits_alone(spark):
    df = spark.range(100).repartition(16)
    assert scale.spread(df).rdd.getNumPartitions() == 16
    assert scale.spread(df.coalesce(5)).rdd.getNumPartitions() == 5
    assert scale.spread(df.coalesce(1)).rdd.getNumPartitions() == 4


def test_no_broadcast_of_what_grows(spark):
    """Tables that look small as files may be large in memory, so these joins never broadcast one."""
    levels = spark.createDataFrame([(v, x, 0, 0, 1 + x % 2) for v in range(3) for x in range(3)], "voi_id long, x int, y int, z int, level int")
    roi = levels.select("voi_id", "x", "y", "z", (F.col("level") * 30.0).alias("hu"))
    volumes = spark.createDataFrame([(v, [1.0, 1.0, 1.0]) for v in range(3)], "voi_id long, spacing array<double>")
    counts = rad.glcm_counts(levels)
    made = [
        counts,
        rad.discretize(roi),
        rad.glcm_feature_table(counts, rad.largest_level(levels)),
        rad.emphasis_features(rad.gldm_counts(levels), "dependence"),
        rad.ngtdm_features(rad.ngtdm_counts(levels)),
        rad.firstorder_features(roi, volumes),
        indexed_volumes(spark.createDataFrame([("m", "a")], "mask_path string, s string"), volumes.select(F.lit("m").alias("mask_path"), "voi_id"), volumes),
    ]
    for rows in made:
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().sparkPlan().toString()
    assert rad.glszm_counts(levels).count() == 6


def test_ranged_parts_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Parts grow with the rows and stay one to a task, so that what a task sorts does not grow."""
    monkeypatch.setattr(scale, "TASK_ROWS", 50, raising=False)
    rows = spark.range(1000).select(F.lit(1).alias("k"), "id")
    got = scale.running(rows, ["k"], [F.desc("id")], {"n": ("sum", F.lit(1))}, max_group_rows=0)
    sizes = [len(part) for part in got.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) < 200
    assert sorted(tuple(r) for r in got.collect()) == [(1, i, 1000 - i) for i in range(1000)]


def test_group_bound(spark):
    rows = skewed(spark)
    largest = rows.groupBy("k").count().agg(F.max("count")).first()[0]
    assert largest <= scale.group_bound(rows, ["k"]) <= rows.count()
    assert scale.group_bound(rows, ["k"], enough=10) == largest
    assert scale.group_bound(rows.where("false"), ["k"]) == 0
