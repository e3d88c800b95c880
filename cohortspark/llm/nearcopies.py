"""Near copies by exact Jaccard similarity of word shingles; candidates by MinHash bands."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import simhash
from cohortspark.llm.common import discard, map_texts, stored
from cohortspark.llm.links import connected_components
from cohortspark.llm.ngrams import SpanHasher, mixed, word_hashes

WORDS = 5
#: Shingles that two texts must share, of all that either has, as a fraction.
LEAST = (4, 5)
#: A pair at similarity 0.8 shares no band with probability ``(1 - 0.8**4) ** 24``, 3 in a million.
BANDS, ROWS = 24, 4
#: Hashes of a text that meet all permutations at once.
BLOCK = 1 << 10
#: A bucket's members meet one of them a round while more than this many pairs a member would be left.
PAIRS_A_MEMBER = 8
HUB_ROUNDS = 2

_SCALE = np.random.default_rng(20_260_102).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_hasher = SpanHasher(0x9E3779B97F4A7C15)


def grams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different 64-bit hashes of all ``words``-word shingles; a shorter text is one shingle.

    Words are those of ``simhash.fingerprint``: A-Z lower-cased, between blanks, tabs and line breaks.
    """
    raw = (text or "").encode("utf-8", "replace").lower()
    found = word_hashes(np.frombuffer(raw, np.uint8), _hasher)[0]
    n = min(words, len(found))
    if not n:
        return np.zeros(0, np.uint64)
    total = len(found) - n + 1
    code = np.full(total, n, np.uint64)
    for i in range(n):
        code = mixed(code * np.uint64(0xD1342543DE82EF95) + found[i : i + total])
    return np.unique(code)


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band of minima over permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (_SCALE * found[at : at + BLOCK]).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0xD1342543DE82EF95) + row)
    return key.view(np.int64)


def sketches(texts: list, words: int = WORDS) -> list[list]:
    """Per text: a hash of its set of shingles, their number, and the band keys (none without words)."""
    node, size, keys = [], [], []
    for text in texts:
        found = grams(text, words)
        node.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
        size.append(len(found))
        keys.append(bands(found) if len(found) else [])
    return [node, size, keys]


#: For texts of sizes ``size`` and ``n``, of whose shingles ``common`` and ``c`` stand in another text: no more than the
#: smaller of these can be shared, so no pair that can reach the similarity is left out.
_CAN_BE = f"root != r and {sum(LEAST)} * least(common, c) >= {LEAST[0]} * (size + n)"


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with their new roots, without the buckets whose members are all in one component."""
    placed = members.drop("root").join(roots, "node", "left").select("band", "node", "size", "common", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "members")
    several = stored(placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("band"), "open")
    still = stored(placed.join(several, "band"), "members")
    discard(placed, several, members)
    return still


def _to_hubs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(u, v)`` of one member of each bucket with those of other components.

    It is one with few shingles of its own, which more of the others are like.
    """
    order = F.struct((F.col("size") - F.col("common")).alias("own"), F.xxhash64("node", F.lit(turn)).alias("order"), "node", "size", "common", "root")
    hubs = members.groupBy("band").agg(F.min(order).alias("h"))
    hubs = stored(hubs.select("band", F.col("h.node").alias("hub"), F.col("h.size").alias("n"), F.col("h.common").alias("c"), F.col("h.root").alias("r")), "hubs")
    met = members.join(hubs, "band").where(_CAN_BE)
    return met.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def _all_pairs(members: DataFrame) -> DataFrame:
    """All pairs ``(u, v)`` of members of a bucket that are in different components."""
    other = members.select("band", F.col("node").alias("v"), F.col("size").alias("n"), F.col("common").alias("c"), F.col("root").alias("r"))
    met = members.join(other, "band").where(f"node < v and {_CAN_BE}")
    return met.select(F.col("node").alias("u"), "v").distinct()


def _pairs_left(members: DataFrame) -> tuple[int, int]:
    """Pairs in different components, counted in each bucket, and members."""
    sizes = members.groupBy("band", "root").agg(F.count("*").cast("double").alias("n"))
    each = sizes.groupBy("band").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("own"))
    left, count = each.agg(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2), F.sum("m")).first()
    return left or 0, count or 0


def _with_common(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with the number of their shingles that another member has, without those that have too few of them."""
    each = sets.select("node", F.explode("grams").alias("gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    counts = stored(each.join(shared, "gram").groupBy("node").agg(F.count("*").cast("int").alias("common")), "counts")
    met = members.drop("common").join(counts, "node").where(f"{LEAST[1]} * common >= {LEAST[0]} * size")
    kept = stored(met.select("band", "node", "size", "common", "root"), "members")
    discard(counts, members)
    return kept


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose sets of shingles have exact Jaccard similarity ``LEAST`` at least."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    same = F.size(F.array_intersect("gu", "gv"))
    return both.where(same * (LEAST[0] + LEAST[1]) >= LEAST[0] * (F.size("gu") + F.size("gv"))).select("u", "v")


def components(nodes: DataFrame, sets_of) -> DataFrame:
    """``(node, root)`` of the nodes that have a similar one; ``nodes`` are ``(node, size, bands)``.

    Pairs are looked for in each bucket of nodes with a band key in common.  Shingles that only one node has are counted
    first, which rules out pairs.  While many pairs of different components are left, one member of each meets all others and components are taken anew, which empties a large bucket of near
    copies of one another without its pairs; then all pairs are compared that are still in different components.
    Pairs inside a component need no comparison, so the components are those of all pairs in the buckets.
    ``sets_of`` gives ``(node, grams)`` of a table of nodes.
    """
    buckets = stored(nodes.where("size > 0").select("node", "size", F.explode("bands").alias("band")), "buckets")
    shared = stored(buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    members = stored(buckets.join(shared, "band").select("band", "node", "size", F.col("size").alias("common"), F.col("node").alias("root")), "members")
    discard(buckets, shared)
    sets = stored(sets_of(members.select("node").distinct()), "sets")
    members = _with_common(members, sets)
    done = links = None
    for turn in range(HUB_ROUNDS + 1):
        left, count = _pairs_left(members)
        last = left <= PAIRS_A_MEMBER * count or turn == HUB_ROUNDS
        pairs = _all_pairs(members) if last else _to_hubs(members, turn)
        pairs = stored(pairs if done is None else stored(pairs, "met").join(done, ["u", "v"], "left_anti"), "pairs")
        done = pairs if done is None else done.union(pairs)
        found = stored(similar(pairs, sets), "similar")
        links = found if links is None else links.union(found)
        roots = stored(connected_components(links), "roots")
        if last:
            return roots
        members = _open(members, roots)
    raise AssertionError("the last turn returns")


def _with_prints(roots: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """``(node, root)`` over the ties of ``roots`` and those of SimHash fingerprints; ``prints`` are ``(node, bits)``.

    Nodes whose fingerprints are in one component of links of at most ``radius`` bits are tied to the smallest of them.
    """
    linked = stored(connected_components(simhash.links(prints.select("bits").distinct(), radius)), "prints")
    placed = prints.join(linked, prints["bits"] == linked["node"], "left").select(prints["node"], F.coalesce("root", "bits").alias("print"))
    hubs = placed.groupBy("print").agg(F.min("node").alias("u"), F.max("node").alias("b")).where("u != b").select("print", "u")
    ties = placed.join(hubs, "print").where("node != u").select("u", F.col("node").alias("v")).distinct()
    return connected_components(ties.union(roots.select(F.col("root").alias("u"), F.col("node").alias("v"))))


def keep_one_copy(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = WORDS, radius: int | None = None) -> DataFrame:
    """One row of ``df``, with all its columns, of each group of near copies: the one with the smallest key.

    Near copies are tied by an exact Jaccard similarity of 0.8 of their ``words``-word shingles, directly or through others;
    candidates are texts with a band of ``ROWS`` minima in common.  With ``radius``, texts whose fingerprints (see
    ``simhash.near_duplicates``) differ in at most so many bits are tied too.  Texts with equal sets of shingles are one node, so
    groups of copies cost nothing; null texts and texts without words are one.  A null key comes last; of rows with equal
    key the one with the smallest hash of its text stays, and equal rows count once.  Unlike texts stay whatever their keys.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")  # names of any kind stay apart from those used here
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), row)
    fields = "node long, size int, bands array<long>, bits long"

    def marked(texts: list) -> list[list]:
        return [*sketches(texts, words), [simhash.signed_print(t) if radius is not None else None for t in texts]]

    marks = stored(map_texts(rows, ["key", "hash"], "text", marked, fields), "marks")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("first")
    nodes = stored(marks.groupBy("node", "size").agg(first, F.first("bands").alias("bands")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        at = stored(nodes.join(wanted, "node").select("node", F.col("first.key").alias("k"), F.col("first.hash").alias("h")), "wanted")
        texts = rows.select("key", "hash", "text").join(at, rows["key"].eqNullSafe(at["k"]) & (rows["hash"] == at["h"]))
        one = texts.groupBy("node").agg(F.min("text").alias("text"))
        return map_texts(one, ["node"], "text", lambda texts: [[grams(t, words).view(np.int64) for t in texts]], "grams array<long>")

    roots = components(nodes.select("node", "size", "bands"), sets_of)
    if radius is not None:
        roots = _with_prints(roots, stored(marks.select("node", "bits").distinct(), "prints"), radius)
    placed = nodes.select("node", "first").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = stored(placed.groupBy("root").agg(F.min("first").alias("r")).select(F.col("r.key").alias("kept"), F.col("r.hash").alias("kept_hash")), "kept")
    same = rows["key"].eqNullSafe(kept["kept"]) & (rows["hash"] == kept["kept_hash"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["key", "hash"]).select("row.*")
