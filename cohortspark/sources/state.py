"""State that deliveries are merged into: review decisions, metric histories, the log of moves.

A state is a Parquet table of one row per key, partitioned by a hash bucket of the key.  A delivery reads and rewrites the
buckets of its own keys only.  The row with the highest order wins, whenever it comes, so deliveries may arrive late, out
of order or again; what is stored is always what a rebuild from all of them would give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.session import cut_lineage


@dataclass(frozen=True)
class State:
    """Where a state lies, its columns (DDL), its keys and the column that orders rows of a key.

    ``buckets`` bounds what a task holds, a bucket's share of all keys, and stays the same for the life of the state.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    order: str
    buckets: int = 64

    @property
    def columns(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).fieldNames()

    @property
    def pending(self) -> str:
        return f"{self.path.rstrip('/')}/_pending"


def decisions_state(path: str, buckets: int = 64) -> State:
    """Every key's last decision; ``CLEAR`` is kept as a row, so that an older decision that comes late stays cleared."""
    return State(path, "key string, action string, ord bigint", ("key",), "ord", buckets)


def metrics_state(path: str, buckets: int = 64) -> State:
    return State(path, "tag string, epoch int, value double, ord bigint", ("tag", "epoch"), "ord", buckets)


def move_log_state(path: str, buckets: int = 64) -> State:
    """Moves by run: a run that is logged again adds nothing, a file that a later run moves again is listed again."""
    return State(path, "run bigint, from_path string, to_path string", ("run", "from_path", "to_path"), "run", buckets)


def read_state(spark: SparkSession, state: State) -> DataFrame:
    """The stored rows; none before the first delivery."""
    return _stored(spark, state).select(*state.columns)


def merge_delivery(spark: SparkSession, state: State, delivery: DataFrame) -> None:
    """Merge a delivery (with at least the state's columns) into the stored rows.

    The new content of the touched buckets is written beside the state first and swapped in after that, so a run that is
    lost on the way leaves either the old state or a finished ``_pending`` folder, which the next merge swaps in.  One
    writer at a time.  Rows of equal order are decided by their other columns, null orders lose, null keys are a key.
    """
    _publish(spark, state)
    other = _stored(spark, state).where(F.col("buckets") != state.buckets)
    if not other.isEmpty():  # a filter on the outer folder: no file is read
        raise ValueError(f"the state has another number of buckets than {state.buckets}")
    bucket = F.pmod(F.xxhash64(*state.keys), F.lit(state.buckets)).cast("int")
    typed = delivery.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(state.schema)])
    new = cut_lineage(_last(typed, state).withColumn("bucket", bucket))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    old = _stored(spark, state).where(F.col("bucket").isin(touched)).select(*new.columns)
    # keys are folded on both sides, so a bucket is as large as its number of keys; one shuffle serves the fold and the files
    together = old.unionByName(new).repartition(len(touched), "bucket")
    merged = _last(together, state, ["bucket"]).withColumn("buckets", F.lit(state.buckets))
    merged.write.mode("overwrite").partitionBy("buckets", "bucket").parquet(state.pending)
    _publish(spark, state)


def _last(rows: DataFrame, state: State, more: list[str] | None = None) -> DataFrame:
    keys = [*(more or []), *state.keys]
    rest = [c for c in state.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    best = F.max(F.struct(*sorted(rest, key=lambda c: c != state.order))).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*")


def _stored(spark, state):
    schema = f"{state.schema}, buckets int, bucket int"
    if not _exists(spark, state.path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(state.path)


def _publish(spark, state):
    """Swap in a finished ``_pending`` folder; repeating it gives the same files' rows."""
    if _exists(spark, f"{state.pending}/_SUCCESS"):
        rows = spark.read.schema(f"{state.schema}, buckets int, bucket int").parquet(state.pending)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("buckets", "bucket").parquet(state.path)
        system, at = _file_system(spark, state.pending)
        system.delete(at, True)


def _file_system(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark, path):
    system, at = _file_system(spark, path)
    return system.exists(at)
