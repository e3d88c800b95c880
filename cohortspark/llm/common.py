"""Shared pieces: table access, mapping texts in bounded batches, labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortspark.session import staging_path

#: Rows handed to a text function at once; bounds what one call holds beside its texts.
TEXT_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back.

    Cuts lineage like a reliable checkpoint, but runs ``df`` once instead of twice and keeps columns apart.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` gave, once all that was made of them has been stored too."""
    for table in tables:
        session = table.sparkSession
        files = table.inputFiles()
        if not files:
            continue
        jvm = session._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def map_texts(
    df: DataFrame,
    carry: Sequence[str],
    text: str,
    fn: Callable[[list], Sequence],
    fields: str,
) -> DataFrame:
    """``carry`` columns of each row beside the columns ``fields`` that ``fn`` makes from lists of texts.

    ``fn`` gets at most ``TEXT_ROWS`` texts (null: None) and returns one sequence per field.  Only ``carry`` and
    ``text`` are read; further columns of any name do no harm.
    """
    made = T.StructType.fromDDL(fields)
    carried = [T.StructField(c, df.schema[c].dataType) for c in carry]
    schema = T.StructType([*carried, *made.fields])
    kinds = list(to_arrow_schema(made).types)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXT_ROWS):
                batch = whole.slice(start, TEXT_ROWS)
                columns = fn(batch.column(batch.num_columns - 1).to_pylist())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=names)

    picked = df.select(*[F.col(c) for c in carry], F.col(text).cast("string").alias("_text"))
    return picked.mapInArrow(run, schema)


def labelled_sample(df: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (``key``, ``label``) of each label: those with the smallest hash of the key.

    Whole tables are looked at; each task keeps at most ``per_label`` rows of a label before the shuffle.
    """
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return (
        df.select(key, label)
        .where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= per_label)
        .drop("_rank")
    )
