"""Repeated runs of lines, by a suffix array over line ids that is built by distributed prefix doubling.

Level ``k`` of the doubling has, for every place whose next ``2**k`` lines occur more than once, the rank of those lines among
all such prefixes; ranks of level ``k + 1`` come from sorting pairs of ranks ``2**k`` lines apart.  Places whose prefix
occurs once are dropped, as every longer prefix of theirs occurs once too.  Two runs of ``n`` lines are equal if the ranks of
their first and of their last ``2**k`` lines are (``2**k <= n < 2**(k+1)``): they are in one interval of the suffix array whose
longest common prefix is at least ``n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from cohortspark.llm.common import map_texts, stored

#: Words that a repeated run must have, so that short lines that recur by chance stay.
MIN_WORDS = 5


def least_runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """Runs ``(first line, lines)`` with at least ``least`` words that cannot be shortened at one of their ends.

    Every line of a longer run lies in one of these inside it: in the shortest run that starts at the line, or else in the
    shortest one that ends where the longer run ends.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    upto = np.searchsorted(total, total[:-1] + least)
    found = {(i, int(e) - i) for i, e in enumerate(upto) if e <= n}
    back = np.searchsorted(total, total[1:] - least, side="right") - 1
    found |= {(int(s), e + 1 - int(s)) for e, s in enumerate(back) if s >= 0 and total[e + 1] - total[s] >= least}
    return sorted(found)


def survey(texts: list, least: int) -> list[list]:
    """Per text: both halves of each line's 128-bit hash, and the shortest runs with enough words."""
    one, two, starts, sizes = [], [], [], []
    for text in texts:
        lines = (text or "").split("\n") if text is not None else []
        raw = [line.encode("utf-8", "replace") for line in lines]
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), np.int64).reshape(-1, 2)
        runs = least_runs([len(line.split()) for line in raw], least) if raw else []
        one.append(hashes[:, 0])
        two.append(hashes[:, 1])
        starts.append([s for s, _ in runs])
        sizes.append([n for _, n in runs])
    return [one, two, starts, sizes]


def ranks(pairs: DataFrame) -> DataFrame:
    """``(a, b, rank)`` of every different pair that occurs more than once; ranks follow the order of the pairs.

    The pairs are range-partitioned and sorted; a pair's rank is its place in its partition, after the sizes of the
    partitions before it (one number per partition).
    """
    repeated = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    sorted_pairs = repeated.repartitionByRange("a", "b").sortWithinPartitions("a", "b")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=["a", "b", "part", "at"]
            )
            at += n

    placed = stored(sorted_pairs.mapInArrow(number, "a long, b long, part int, at long"), "ranks")
    sizes = dict(placed.groupBy("part").count().collect())
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    offsets = placed.sparkSession.createDataFrame(rows, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").select("a", "b", (F.col("before") + F.col("at")).alias("rank"))


def doubled(level: DataFrame, step: int) -> DataFrame:
    """The next level: ranks of pairs of ranks that are ``step`` lines apart in one text."""
    later = level.select("doc", (F.col("line") - step).alias("line"), F.col("rank").alias("b"))
    pairs = stored(level.withColumnRenamed("rank", "a").join(later, ["doc", "line"]).select("doc", "line", "a", "b"), "pairs")
    return stored(pairs.join(ranks(pairs), ["a", "b"]).select("doc", "line", "rank"), "level")


def repeated_runs(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """``doc, start, size`` of every shortest run with enough words that also starts at an earlier place.

    Places are ordered by key, then by a hash of the text, then by line; ``doc`` is the struct of the first two.
    """
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("th"))
    keyed = df.select(place.alias("doc"), F.col(text).cast("string").alias("_text"))
    fields = "h1 array<long>, h2 array<long>, starts array<int>, sizes array<int>"
    read = stored(map_texts(keyed, ["doc"], "_text", lambda texts: survey(texts, min_words), fields).dropDuplicates(["doc"]), "lines")
    lines = read.select("doc", F.posexplode(F.arrays_zip("h1", "h2")).alias("line", "h"))
    lines = lines.select("doc", "line", F.col("h.h1").alias("a"), F.col("h.h2").alias("b"))
    runs = read.select("doc", F.explode(F.arrays_zip("starts", "sizes")).alias("r"))
    runs = runs.select("doc", F.col("r.starts").alias("start"), F.col("r.sizes").alias("size"))
    runs = runs.withColumn("level", F.floor(F.log2("size") + 1e-9).cast("int"))
    longest = runs.agg(F.max("level")).first()[0]
    level = stored(lines.join(ranks(lines.select("a", "b")), ["a", "b"]).select("doc", "line", "rank"), "level")
    found = []
    for k in range((longest if longest is not None else -1) + 1):
        if k:
            level = doubled(level, 1 << (k - 1))
        mine = runs.where(F.col("level") == k).withColumn("last", F.col("start") + F.col("size") - (1 << k))
        first = level.select("doc", F.col("line").alias("start"), F.col("rank").alias("head"))
        last = level.select("doc", F.col("line").alias("last"), F.col("rank").alias("tail"))
        found.append(mine.join(first, ["doc", "start"]).join(last, ["doc", "last"]).select("doc", "start", "size", "head", "tail"))
        if level.isEmpty():
            break
    if not found:
        return df.sparkSession.createDataFrame([], read.select("doc", F.lit(0).alias("start"), F.lit(0).alias("size")).schema)
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    # Equal size and ranks: one interval of the suffix array.  Its earliest place stays.
    whole = stored(whole.withColumn("at", F.struct("doc", "start")), "runs")
    by = ["size", "head", "tail"]
    # Stored, so that the join shuffles both sides anew and a run that very many texts share can be split.
    first = whole.groupBy(*by).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(first, "first")
    return whole.join(first, by).where("at > first").select("doc", "start", "size")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with all its columns, ``text`` without later copies of repeated runs, ``n_lines`` and ``n_removed``.

    A line is deleted if it lies in a run of lines with at least ``min_words`` words in all whose lines also stand, in the same
    order and without others between, at an earlier place: in a row with a smaller key, or earlier in the same text.
    Runs are judged on the input.  Lines end at line feeds and are compared unchanged.  A text that loses all its lines is empty;
    a null text stays null and has no lines.  A null key comes last.  Rows with equal key are ordered by a hash of their text; equal
    rows are edited alike.  An empty table gives no rows.
    """
    stretches = repeated_runs(df, key, text, min_words)
    cuts = stretches.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("cut"))  # of one text
    # The columns of ``df`` travel in one struct, so that names of any kind do not meet those of the join.
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    field = lambda name: F.col("row").getField(name)
    same_row = field(key).eqNullSafe(F.col("doc.key")) & (F.xxhash64(field(text)) == F.col("doc.th"))
    rows = row.join(cuts, same_row, "left").select("row", "cut")

    @pandas_udf("struct<text:string,removed:int>")
    def edit(texts, cuts):
        import pandas as pd

        out, gone = [], []
        for t, cut in zip(texts, cuts):
            if cut is None or t is None:
                out.append(None)
                gone.append(0)
                continue
            lines = t.split("\n")
            keep = np.ones(len(lines), bool)
            for x in cut:
                keep[x["start"] : x["start"] + x["size"]] = False
            out.append("\n".join(line for line, k in zip(lines, keep) if k))
            gone.append(int((~keep).sum()))
        return pd.DataFrame({"text": out, "removed": gone})

    # Only texts that lose lines go to Python; the others are passed as null and stay as they are.
    touched = F.when(F.col("cut").isNotNull(), field(text))
    lines = F.coalesce(F.length(field(text)) - F.length(F.translate(field(text), "\n", "")) + 1, F.lit(0))
    rows = rows.withColumn("edit", edit(touched, F.col("cut")))
    columns = [
        (F.coalesce("edit.text", field(text)) if c == text else field(c)).alias(c)
        for c in df.columns
        if c not in ("n_lines", "n_removed")
    ]
    return rows.select(*columns, lines.cast("int").alias("n_lines"), F.col("edit.removed").alias("n_removed"))
