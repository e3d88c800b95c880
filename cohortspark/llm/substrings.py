"""Repeated word passages across documents, by prefix-partitioned suffix trees.

A suffix matters here if a window of ``window`` words starts at it.  Suffixes are dealt to groups by a prefix of variable
length: the words up to the end of the window's smallest ``PREFIX``-gram (by hash), whose hash names the group.  Equal
windows have equal prefixes, neighbouring windows mostly share one, so a document gives short fragments instead of one row
per suffix, and prefixes that only one text has are dropped before any text is moved.  Groups are packed to the memory of a
task; one prefix with too many fragments is split by fragment.  Each group sorts its suffixes by doubling; runs of suffixes
that share ``window`` words are the subtree's deep internal nodes.  Nodes of a split prefix are merged by a second, small table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortspark.llm.common import stored
from cohortspark.llm.ngrams import SpanHasher, word_hashes

PREFIX = 10
#: Fragments in one group, and of one prefix in a group.
GROUP_FRAGMENTS = 12_000
#: Suffixes in one fragment; a longer run of windows with one prefix gives several.
FRAGMENT_WINDOWS = 256
#: Bytes hashed at once.
PART_BYTES = 1 << 20

_letters = SpanHasher(0x9E3779B97F4A7C15)
_grams = SpanHasher(0xC2B2AE3D27D4EB4F)
_node = (SpanHasher(0x165667B19E3779F9), SpanHasher(0xD6E8FEB86659FD93))
_NONE = np.uint64((1 << 64) - 1)


def hashed_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, in blocks of bounded size."""
    out, part, size = [], [], 0
    for word in words:
        part.append(word)
        size += len(word) + 1
        if size >= PART_BYTES:
            out.append(word_hashes(np.frombuffer(b" ".join(part), np.uint8), _letters)[0])
            part, size = [], 0
    if part:
        out.append(word_hashes(np.frombuffer(b" ".join(part), np.uint8), _letters)[0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_prefixes(hashes: np.ndarray, window: int, prefix: int = PREFIX) -> np.ndarray:
    """For each window of words, the smallest hash of the ``prefix``-grams in it."""
    count = len(hashes) - window + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    places = np.arange(len(hashes) - prefix + 1)
    low = _grams.hash(hashes, places, places + prefix)
    span, need = 1, window - prefix + 1
    while 2 * span <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:count], low[need - span : need - span + count])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _map(df: DataFrame, schema: str, rows, kinds: dict[str, T.DataType], budget: int = 1 << 22) -> DataFrame:
    """``mapInArrow`` with a generator of tuples over the rows of a batch; ``budget`` values are held at once."""
    types = T.StructType.fromDDL(schema)
    types = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in types])
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for row, weight in rows(*(c.to_pylist() for c in part.columns)):
                    held.append(row)
                    size += weight
                    if size >= budget:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    return df.mapInArrow(run, types)


def deep_nodes(texts: list[bytes], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix sorting of fragments to depth ``window``.

    Fragment ``i`` has ``counts[i] + window - 1`` words; its first ``counts[i]`` suffixes are leaves.  Returns for each leaf its
    fragment, its offset there, its node (leaves with the same ``window`` words share one), and its place in all words.
    """
    lengths = counts + window - 1
    words: list[bytes] = []
    for t in texts:
        words += t.split()
    hashes = hashed_words(words)
    rank = np.unique(hashes, return_inverse=True)[1]
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        pair = rank[: len(rank) - step] * (np.int64(rank.max(initial=0)) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        depth += step
    fragment = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    offset = np.arange(len(fragment)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = first[fragment] + offset
    return fragment, offset, rank[place], hashes


def _group(window: int, table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Covered stretches of the fragments of one group, and the first window of each node of a split prefix."""
    order = table.column("ord").to_numpy()
    counts = table.column("n").to_numpy()
    fragment, offset, node, hashes = deep_nodes(table.column("words").to_pylist(), counts, window)
    docs = order[fragment]
    first = np.full(node.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, node, docs)
    covered = docs > first[node]
    start = table.column("start").to_numpy()[fragment] + offset
    # Neighbouring covered windows of a fragment become one stretch.
    mark = np.where(covered, fragment * 2, fragment * 2 + 1)
    a, b = _runs(mark)
    keep = covered[a] if len(a) else np.zeros(0, bool)
    a, b = a[keep], b[keep]
    parts = [(fragment[a], start[a], start[b - 1] + window, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64))]
    split = table.column("split").to_numpy(zero_copy_only=False)
    lone = np.flatnonzero(~covered & split[fragment])
    if len(lone):
        lengths = counts + window - 1
        place = (np.concatenate([[0], np.cumsum(lengths)[:-1]]))[fragment[lone]] + offset[lone]
        one, two = (_signed(h.hash(hashes, place, place + window)) for h in _node)
        parts.append((fragment[lone], start[lone], start[lone] + window, one, two))
    row, begin, end, one, two = (np.concatenate(c) for c in zip(*parts))
    lead = table.select([*schema.names[:3]]).take(pa.array(row))
    node_row = np.concatenate([np.zeros(len(parts[0][0]), bool), *[np.ones(len(p[0]), bool) for p in parts[1:]]])
    columns = [*(c.combine_chunks() for c in lead.columns), *map(pa.array, (begin, end, node_row, one, two))]
    return pa.Table.from_arrays([pa.chunked_array([c], t) if not isinstance(c, pa.ChunkedArray) else c for c, t in zip(columns, schema.types)], schema=schema)


def dedup_passages(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = 50, with_text: bool = False,
    group_fragments: int = GROUP_FRAGMENTS,
) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every row (and ``kept``, the words left joined by one space, if asked for).

    A word is removed if a window of ``window`` words covers it whose words also start in a row with a smaller key.  Words
    are split at blanks, tabs and line breaks; windows are judged on the input.  A null text has no words.  A null key
    comes after all others.  Rows with the same key do not remove words of each other; repeated rows stay repeated.  An
    empty table gives no rows.

    Rows with equal words are one text in the trees, held by their smallest key; the others are removed whole (if they have
    a window at all).
    """
    kinds = {"key": df.schema[key].dataType}
    rows = df.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("ord"),
        F.col(text).cast("string").alias("text"),
    )

    def survey(keys, hashes, orders, texts):
        for k, h, o, t in zip(keys, hashes, orders, texts):
            words = _split(t)
            digest = hashlib.sha256(b" ".join(words)).hexdigest()
            low = window_prefixes(hashed_words(words), window) if len(words) >= window else np.zeros(0, np.uint64)
            starts, ends = _runs(low)
            found, at = np.unique(low[starts], return_inverse=True)
            pieces = np.bincount(at, -(-(ends - starts) // FRAGMENT_WINDOWS), len(found)).astype(np.int64)
            yield (k, h, o, len(words), digest, _signed(found), pieces), 20 + 2 * len(found)

    meta = stored(
        _map(rows, "key long, th long, ord long, n_words long, sha string, prefixes array<long>, pieces array<long>", survey, kinds), "survey"
    )
    # Tables of one row per key are stored before they meet the rows they come from: the join then shuffles both sides
    # anew, and Spark can split a key that very many rows have.
    classes = meta.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("ord").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.where("n > 1").drop("n"), "classes")
    placed = stored(
        meta.join(classes, "sha", "left").select(
            "key", "th", "ord", "n_words", "sha", (F.col("ord") > F.col("least")).alias("copy")
        ),
        "placed",
    )
    # A prefix matters if two different texts have it; texts are told apart by a part of their digest.
    content = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("content")
    held = meta.select("key", "th", content, F.explode(F.arrays_zip("prefixes", "pieces")).alias("p"))
    held = held.select("key", "th", "content", F.col("p.prefixes").alias("prefix"), F.col("p.pieces").alias("pieces"))
    shared = held.groupBy("prefix").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.sum("pieces").alias("n"))
    shared = stored(shared.where("a != b").select("prefix", "n"), "shared")
    kept_rows = placed.where(~F.coalesce(F.col("copy"), F.lit(False))).select(F.col("key").alias("rk"), F.col("th").alias("rth"))
    active = (
        held.join(shared, "prefix")
        .groupBy("key", "th")
        .agg(F.collect_list(F.struct("prefix", "n", "pieces")).alias("active"))  # at most the prefixes of one text
        .withColumnsRenamed({"key": "ak", "th": "ath"})
        .join(kept_rows.distinct(), F.col("ak").eqNullSafe(F.col("rk")) & (F.col("ath") == F.col("rth")), "left_semi")
    )
    texts = stored(
        rows.join(active, F.col("key").eqNullSafe(F.col("ak")) & (F.col("th") == F.col("ath"))).select("key", "th", "ord", "text", "active"),
        "texts",
    )

    def fragments(keys, hashes, orders, texts, actives):
        for k, h, o, t, listed in zip(keys, hashes, orders, texts, actives):
            words = _split(t)
            low = _signed(window_prefixes(hashed_words(words), window))
            sizes = {x["prefix"]: x["n"] for x in listed}
            for a, b in zip(*_runs(low)):
                n = sizes.get(int(low[a]))
                for at in range(a, b if n is not None else a, FRAGMENT_WINDOWS):
                    count = min(FRAGMENT_WINDOWS, int(b) - at)
                    part = b" ".join(words[at : at + count + window - 1])
                    yield (k, h, o, int(low[a]), n, int(at), count, part), 60 + len(part)

    cut = _map(
        texts.select("key", "th", "ord", "text", "active"),
        "key long, th long, ord long, prefix long, held long, start long, n long, words binary", fragments, kinds,
    )
    total = texts.agg(F.sum(F.aggregate("active.pieces", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    groups = max(1, -(-total // group_fragments))
    parts = F.ceil(F.col("held") / group_fragments)
    salt = F.pmod(F.xxhash64("ord", "th", "start"), parts)
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("prefix", salt), F.lit(groups))).withColumn("split", parts > 1)
    dealt = dealt.select("key", "th", "ord", "start", "n", "words", "split", "group")
    out = T.StructType.fromDDL("key long, th long, ord long, start long, end long, node boolean, h1 long, h2 long")
    out = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in out])
    arrow = to_arrow_schema(out)

    def subtree(table: pa.Table) -> pa.Table:
        return _group(window, table, arrow)

    found = stored(dealt.groupBy("group").applyInArrow(subtree, out), "nodes")
    nodes = found.where("node")
    firsts = nodes.groupBy("h1", "h2").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least != most")
    late = nodes.join(firsts.select("h1", "h2", "least"), ["h1", "h2"]).where("ord > least")
    stretches = found.where("not node").select("key", "th", "start", "end").union(late.select("key", "th", "start", "end"))
    listed = stretches.groupBy("key", "th").agg(F.collect_list(F.struct("start", "end")).alias("cut"))  # of one text
    listed = listed.withColumnsRenamed({"key": "ck", "th": "cth"})
    joined = texts.join(listed, F.col("key").eqNullSafe(F.col("ck")) & (F.col("th") == F.col("cth"))).select("key", "th", "text", "cut")

    def remove(keys, hashes, texts, cuts):
        for k, h, t, cut in zip(keys, hashes, texts, cuts):
            words = np.array(_split(t), object)
            keep = np.ones(len(words), bool)
            for x in cut:
                keep[x["start"] : x["end"]] = False
            kept = b" ".join(words[keep])
            left = kept.decode("utf-8") if with_text else None
            yield (k, h, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), left), 60 + len(kept) * with_text

    edited = _map(joined, "key long, th long, removed long, new_sha string, kept string", remove, kinds)
    edited = edited.dropDuplicates(["key", "th"]).withColumnsRenamed({"key": "ek", "th": "eth"})
    whole = F.coalesce(F.col("copy"), F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    result = placed.join(edited, F.col("key").eqNullSafe(F.col("ek")) & (F.col("th") == F.col("eth")), "left").select(
        F.col("key").alias(key), "th", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"), F.col("key").alias("_key"),
    )
    columns = [key, "n_words", "n_removed", "kept_sha256"]
    if not with_text:
        return result.select(*columns)
    # A row that loses nothing keeps all its words; its text is read again where it stands, one of each key and text.
    words = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t-\r]+"), lambda w: w != ""), " ")
    unedited = rows.select(F.col("key").alias("uk"), F.col("th").alias("uth"), words.alias("words")).dropDuplicates(["uk", "uth"])
    met = result.join(unedited, F.col("_key").eqNullSafe(F.col("uk")) & F.col("th").eqNullSafe(F.col("uth")))
    return met.select(*columns, F.coalesce("kept", "words").alias("kept"))
