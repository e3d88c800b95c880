"""Hard negatives against brute force; the walk over cells and its bounds."""

import math

import numpy as np
import pytest

from cohortspark.llm.multiindex import Codebooks, ShardIndex, deal, falling_cells, fit_codebook, hard_negatives, span_of

rng = np.random.default_rng(13)


def brute(rows, every, positives=5, negatives=10):
    whole = {i: ([math.floor(256 * x) for x in v], label) for i, v, label in rows}
    out = []
    for anchor in (i for i in whole if i % every == 0):
        q, mine = whole[anchor]
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, label == mine) for i, (v, label) in whole.items() if i != anchor)
        for positive, pid in [(-s, i) for s, i, same in scored if same][:positives]:
            inside = [(i, -s) for s, i, same in scored if not same and 30 * positive <= -100 * s <= 90 * positive]
            out += [(anchor, pid, rank, i, positive, s) for rank, (i, s) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mine(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, shard int, cell string").repartition(3)
    return sorted(tuple(r) for r in hard_negatives(df, **options).collect())


@pytest.mark.parametrize("shard_rows,codewords", [(100_000, 16), (60, 4), (7, 1)])
def test_against_brute_force(spark, shard_rows, codewords):
    centres = rng.normal(0, 0.2, (4, 8))
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(0, 0.1, 8)], int(rng.integers(0, 4))) for i in range(300)]
    hot = rows[8][1]
    rows += [(1000 + i, hot, int(i % 2)) for i in range(150)]  # one vector of a third of all rows, anchors among them
    rows += [(2000 + i, [round(x, 1) for x in rows[i][1]], int(i % 3)) for i in range(60)]  # ties
    assert mine(spark, rows, every=20, shard_rows=shard_rows, codewords=codewords) == brute(rows, 20)


def test_odd_rows(spark):
    base = [(i, [float(x) for x in rng.normal(0.1, 0.2, 3)], i % 2) for i in range(1, 40)] + [(0, [0.3, 0.2, 0.1], 0), (100, [0.0, 0.0, 0.0], 1)]
    odd = [
        (None, [0.1, 0.1, 0.1], 1), (50, None, 1), (51, [None, 0.1, 0.1], 1), (52, [float("nan"), 0.1, 0.1], 0), (53, [float("inf"), 0.1, 0.1], 0),
        (54, [0.1, 0.1, 0.1], None), (55, [0.5], 1), (200, [0.5], 1), (56, [], 0), base[3], base[3],
    ]
    assert mine(spark, base + odd) == brute(base, 100)
    assert mine(spark, []) == [] and mine(spark, [(1, [0.1], 1), (2, None, 1)]) == []
    assert mine(spark, [(0, [0.1, 0.2], 1), (1, [0.1, 0.2], 1)]) == []
    large = [(i, [x * 1e5 for x in v], label) for i, v, label in base]  # beyond double precision, within 64 bits
    assert mine(spark, large) == brute(large, 100)
    with pytest.raises(Exception, match="64 bits"):
        mine(spark, [(0, [1e12, 1.0], 1), (1, [1e12, 1.0], 1)])


def test_walk_falls_and_is_complete():
    a, b = rng.normal(size=6), rng.normal(size=5)
    b[2] = -np.inf
    walk = list(falling_cells(a, b))
    assert len(walk) == 24 and len({(i, j) for _, i, j in walk}) == 24
    assert all(x[0] >= y[0] for x, y in zip(walk, walk[1:])) and all(math.isclose(s, a[i] + b[j]) for s, i, j in walk)
    assert list(falling_cells(np.full(3, -np.inf), b)) == []


def test_bounds_hold():
    vectors = rng.integers(-200, 200, (400, 6))
    books = Codebooks((fit_codebook(vectors[:50, :3].astype(float), 4), fit_codebook(vectors[:50, 3:].astype(float), 4)))
    cell, a, b = books.cell(vectors.astype(float))
    n = len(books.halves[0]) * len(books.halves[1])
    books.radii = np.full((2, n), -np.inf)
    np.maximum.at(books.radii[0], cell, a)
    np.maximum.at(books.radii[1], cell, b)
    books.first, books.parts = deal(np.bincount(cell, minlength=n), 40)
    assert (books.first[1:] >= books.first[:-1]).all() and books.parts.max() >= 1
    index = ShardIndex(books, np.arange(400), np.array(["x"] * 400), vectors, cell, a, b)
    for q in rng.integers(-200, 200, (5, 6)):
        product = vectors @ q
        bounds = books.shard_bounds(q[None].astype(float))[0]
        assert all(product[i] <= bounds[books.first[cell[i]]] for i in range(400))
        seen = 0
        for upper, lower, c in index._walk(q.astype(float)):
            inside = product[cell == c]
            assert (inside <= upper).all() and (inside >= lower - 1e-6).all()
            seen += len(inside)
        assert seen == 400
        # With the walk stopped early, the first rows are still right.
        ids, scores = index.nearest_of_label(q, -1, "x", 5, -np.inf)
        assert scores.tolist() == sorted(product.tolist(), reverse=True)[:5]


def test_spans():
    for score in [*range(-20, 200), 10**12 + 7]:
        low, high = span_of(score, 30, 90)
        for x in range(low - 2, low + 3) if score > 1000 else range(-70, 200):
            assert (low <= x <= high) == (30 * score <= 100 * x <= 90 * score)
