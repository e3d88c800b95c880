"""Top-k search and near-duplicates against brute force."""

import random
from itertools import combinations
from unittest import mock

import numpy as np
import pytest

import corpus_pipeline
from cohortspark.llm import nearcopies
from cohortspark.llm.balltree import BallTree, top_k
from cohortspark.llm.links import connected_components
from cohortspark.llm.nearcopies import keep_one_copy
from cohortspark.llm.simhash import BITS, covering_masks, fingerprint, keep_one, links, near_duplicates

rng = np.random.default_rng(5)


def brute_top(rows, every, k):
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows}
    out = []
    for q in (i for i in whole if i % every == 0):
        scored = [(-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q and len(whole[c]) == len(whole[q])]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows", [(1_000_000, 4096), (60, 3)])
def test_top_k(spark, shard_rows, block_rows):
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows[7] = (7, rows[8][1])  # ties
    rows[100] = (100, rows[8][1])
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, shard string, v int")
    got = sorted(tuple(r) for r in top_k(df, shard_rows=shard_rows, block_rows=block_rows).collect())
    assert got == brute_top(rows, 50, 5)


def test_top_k_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]),
        (6, []), (50, []), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (100, [1e13, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(df).collect())
    assert (50, 1, 6, 0) in got and all(r[0] != 2 and r[2] not in (1, 2, 3, 4, 5) for r in got)
    assert [r[2] for r in got if r[0] == 0] == [100, 7]
    assert top_k(df.limit(0)).count() == 0


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e13, 1e13]), (1, [1e13, 1e13]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        top_k(df).collect()
    assert top_k(df.where("vec_id <> 1")).first().score == 2 * int(256e13) * 256


def test_ball_bounds_hold():
    vectors = rng.integers(-300, 300, (500, 16)).astype(float)
    tree = BallTree(vectors, np.arange(500), leaf_rows=20)
    query = rng.integers(-300, 300, (5, 16)).astype(float)
    bound = tree.bounds(tree.depth, query, np.sqrt((query**2).sum(1)))
    for leaf, (a, b) in enumerate(tree.leaves):
        assert (query @ tree.vectors[a:b].T <= bound[:, leaf][:, None]).all()


def test_equal_vectors(spark):
    df = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(300)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, shard_rows=70).where("query_id = 50").orderBy("rank").collect()]
    assert got == [(50, r, i, 2 * 128 * 128) for r, i in enumerate(range(5), 1)]


def test_masks_cover_every_pair():
    masks = covering_masks(2)
    assert len(masks) == 7
    for i, j in combinations(range(BITS), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_fingerprint_matches_spark_hash(spark):
    text = "The Quick bröwn fox\tjumps\nover the Lazy dog"
    words = [w.decode() for w in text.encode().lower().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    rows = spark.createDataFrame([(s,) for s in shingles], "s string").selectExpr("xxhash64(s) as h").collect()
    ones = [sum(r.h >> b & 1 for r in rows) for b in range(64)]
    assert fingerprint(text) == sum(1 << b for b in range(64) if 2 * ones[b] > len(rows))
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("x " * 300_000) == fingerprint("x x x")


def brute_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {p: find(p) for p in prints}


def test_links_lose_no_pair(spark):
    random.seed(3)
    prints = set()
    for _ in range(40):
        base = random.getrandbits(63)
        for _ in range(random.choice([1, 2, 12])):
            at = base
            for b in random.sample(range(63), random.choice([0, 1, 1, 2])):
                at ^= 1 << b
            prints.add(at)
            base = random.choice([base, at])
    roots = brute_components(sorted(prints))
    got = links(spark.createDataFrame([(p,) for p in prints], "bits long"))
    found = {r.node: r.root for r in connected_components(got).collect()}
    assert {p: found.get(p, p) for p in prints} == roots
    assert all((r.u ^ r.v).bit_count() <= 2 for r in got.collect())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, "a b c d"), (4, "A B  c\nd"), (None, "a b c d"), (9, "q w e r t"), (9, "q w e r t")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, row string, bits int")
    got = near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    assert by[3, "0" * 16] == 1 and by[1, "0" * 16] == 1
    assert {v for (i, _), v in by.items() if i in (2, 4, None)} == {2}
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_one_row_of_each_group_where_keys_do_not_tell_groups_apart(spark):
    a, b, c, d = ("one two three four", "quite another text here", "third text without a key", "fourth of them all")
    rows = [(None, a), (None, b), (None, c), (5, c + " x y"), (5, d), (7, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in keep_one(df).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (None, c), (5, c + " x y"), (5, d)], key=str)
    # (5, 'text A'), (5, 'text B'), (7, 'text B') are two components that are both called 5
    df = spark.createDataFrame([(5, a), (5, b), (7, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in keep_one(df).collect()) == [(5, a), (5, b)]


def jaccard(a, b):
    split = lambda t: t.lower().split()
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (split(a), split(b)))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("pairs", [0, 8])
def test_near_copies_against_all_pairs(spark, pairs):
    """``pairs = 0`` takes the way for large buckets."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdef") for _ in range(4))
    texts = []
    for group in [1] * 10 + [3] * 10 + [25]:
        base = [word() for _ in range(random.choice([3, 60, 120]))]
        for _ in range(group):
            copy = list(base)
            for i in random.sample(range(len(copy)), random.randint(0, min(3, len(copy)))):
                copy[i] = word()
            texts.append(" ".join(copy))
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, row string, node int")
    with mock.patch.object(nearcopies, "PAIRS_A_MEMBER", pairs):
        got = keep_one_copy(df)
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(root))


def test_near_copies_odd_rows(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve one more"
    rows = [(None, a), (None, b), (5, "x " + b), (5, "short"), (7, "SHORT"), (9, None), (8, ""), (8, ""), (6, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in keep_one_copy(df).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, "x " + b), (5, "short"), (6, "  ")], key=str)
    assert keep_one_copy(df.limit(0)).count() == 0


def test_stage_ties_by_fingerprints_too(spark):
    """Fingerprints within two bits tie texts of a smaller similarity, also over a copy that only shingles tie."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    alike = None
    while alike is None:
        changed = list(words)
        for at in rng.choice(np.arange(5, 395, 6), 10, replace=False):
            changed[at] = f"x{at}"
        text = " ".join(changed)
        if (fingerprint(text) ^ fingerprint(" ".join(words))).bit_count() <= 2:
            alike = changed
    copy = list(alike)
    copy[200] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(alike)), (3, " ".join(copy)), (4, " ".join(words[::-1]))]
    grams = [set(nearcopies.grams(t).tolist()) for _, t in rows]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert jaccard(grams[0], grams[1]) < 0.8 <= jaccard(grams[1], grams[2])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one_copy(df).collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 4]
