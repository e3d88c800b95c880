"""SimHash near-duplicates, found by covering locality-sensitive hashing."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import map_texts, stored
from cohortspark.llm.links import connected_components

BITS = 64
SEED = 42
#: Shingles hashed at once; bounds the memory of a very long text.
BLOCK = 1 << 16
_FULL = (1 << BITS) - 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit majority over the XXH64 of all ``words``-word shingles; 0 without words.

    A-Z are lower-cased and words are runs of other characters than blank, tab and line breaks: what ``bytes`` methods do.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + np.arange(len(found))
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found))).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    total = len(found) - words + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, BLOCK):
        upto = min(at + BLOCK, total)
        spans = zip(starts[at:upto], ends[at + words - 1 : upto + words - 1])
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, upto - at)
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS)
        # Sums of up to 255 rows fit in a byte; adding bytes is several times faster than adding wide integers.
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > total).view(np.uint64)[0])


def signed_print(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed long."""
    x = fingerprint(text, words)
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def fingerprints(df: DataFrame, carry: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """``carry`` columns and ``bits`` (the fingerprint as a signed long) of every row; no shuffle."""
    return map_texts(df, carry, text, lambda texts: [[signed_print(t, words) for t in texts]], "bits long")


def covering_masks(radius: int) -> list[int]:
    """Bit masks such that any ``radius`` positions are all outside some mask.

    Position ``i`` gets a nonzero vector ``m(i)`` of ``radius + 1`` bits; mask ``v`` (every nonzero vector) has the
    positions whose ``m(i)`` has odd overlap with ``v``.  ``radius`` vectors never span the space, so some ``v`` is
    orthogonal to all of them: two fingerprints that differ at those positions agree on that mask.
    """
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        masks.append(sum(1 << i for i in range(BITS) if ((1 + i % vectors) & v).bit_count() % 2))
    return masks


def _long(x: int) -> Column:
    return F.lit(x - (1 << BITS) if x >= 1 << (BITS - 1) else x).cast("long")


def _flips(mask: int, count: int) -> list[int]:
    """All ways to flip up to ``count`` bits outside ``mask``."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    ways = {0}
    for _ in range(count):
        ways |= {a ^ b for a, b in product(ways, free)}
    return sorted(ways, key=lambda x: (x.bit_count(), x))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Rows ``(u, v)`` that tie all fingerprints within ``radius`` differing bits, without pairs of a bucket.

    ``prints`` has distinct ``bits``.  Each table's key is the fingerprint under a covering mask; a key that only one
    fingerprint has is dropped.  Of the others, every fingerprint names its neighbours at half the radius outside the
    mask: two of them share a name exactly if they differ in at most ``radius`` bits (for an even radius), and a name has
    few holders however large the bucket is.  Holders are tied to the smallest one.
    """
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(_long(m)).alias("k")) for t, m in enumerate(masks)])
    keyed = prints.select("bits", F.explode(tables).alias("x")).select("bits", "x.t", "x.k")
    shared = keyed.groupBy("t", "k").agg(F.min("bits").alias("a"), F.max("bits").alias("b")).where("a != b").select("t", "k")
    members = keyed.join(shared, ["t", "k"])
    moves = reduce(
        lambda rest, t: F.when(F.col("t") == t, F.array(*[_long(w) for w in _flips(masks[t], radius // 2)])).otherwise(rest),
        range(len(masks) - 1),
        F.array(*[_long(w) for w in _flips(masks[-1], radius // 2)]),
    )
    named = members.select("bits", F.explode(moves).alias("w")).select("bits", F.col("bits").bitwiseXOR(F.col("w")).alias("name"))
    # A name has at most one holder per flip: the group is bounded, and its smallest holder is found by an aggregate.
    hubs = named.groupBy("name").agg(F.min("bits").alias("u"), F.max("bits").alias("b")).where("u != b").select("name", "u")
    return named.join(hubs, "name").where("bits != u").select("u", F.col("bits").alias("v")).distinct()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, carry: tuple[str, ...] = (), words: int = 3, radius: int = 2
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits), ``component_id`` and ``carry`` columns of every row.

    ``component_id`` is the smallest key that can be reached over links of at most ``radius`` differing bits.  Null and
    empty texts have fingerprint zero and are linked like any other; equal texts have equal fingerprints and are one node,
    so groups of copies cost nothing.  Null keys are kept, and are never the smallest unless no other is there; repeated
    rows stay repeated; an empty table gives no rows.
    """
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return _grouped(df, key, text, carry, words, radius).select(key, digits.alias("fingerprint"), "component_id", *carry)


def _grouped(df: DataFrame, key: str, text: str, carry: tuple[str, ...], words: int, radius: int) -> DataFrame:
    """``key``, ``carry``, ``bits``, ``component_id`` and ``root``, the smallest fingerprint of the component, of every row.

    Only ``root`` tells components apart: ``component_id`` does not where keys are null or repeated.
    """
    prints = stored(fingerprints(df, [key, *carry], text, words), "fingerprints")
    nodes = stored(prints.groupBy("bits").agg(F.min(key).alias("least")), "nodes")
    roots = connected_components(links(nodes.select("bits"), radius))
    placed = nodes.join(roots, nodes["bits"] == roots["node"], "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("bits", "root", "component_id")
    return prints.join(named, "bits")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``df``, with all its columns, of each group of near-duplicates: the one with the smallest key.

    Of rows with that key the one with the smallest hash of its text stays, and equal rows count once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")  # names of any kind stay apart from those used here
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), row)
    found = _grouped(rows.select("key", "text", "hash"), "key", "text", ("hash",), words, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "hash")).alias("r"))
    kept = first.select(F.col("r.key").alias("kept"), F.col("r.hash").alias("kept_hash"))
    same = rows["key"].eqNullSafe(kept["kept"]) & (rows["hash"] == kept["kept_hash"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["key", "hash"]).select("row.*")
