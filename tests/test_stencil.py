"""Neighbourhoods over folded lines against plain loops, on regions with gaps."""

import random
from collections import Counter

import pytest

from cohortspark.operators.radiomics import gldm_counts, glcm_counts, glrlm_counts, ngtdm_counts
from cohortspark.operators.stencil import DIRECTIONS, fold_lines, interior_edge, level_runs


def _region(seed):
    rng = random.Random(seed)
    shape = [(1, 9, 7, 5, 0.6), (2, 30, 2, 1, 0.9), (3, 1, 6, 8, 0.8), (4, 6, 6, 6, 0.15)]
    out = {}
    for voi, nx, ny, nz, share in shape:
        for x in range(nx):
            for y in range(ny):
                for z in range(nz):
                    if rng.random() < share:
                        out[voi, x, y, z] = rng.choice([1, 1, 2, 3, 300])
    out[5, 0, 0, 0] = 1  # a lone voxel
    return out


@pytest.fixture(scope="module")
def region():
    return _region(8)


@pytest.fixture(scope="module")
def levels(spark, region):
    return spark.createDataFrame([(*p, v) for p, v in region.items()], "voi_id long, x int, y int, z int, level int").repartition(3)


def _beside(p, d, k=1):
    return (p[0], *(a + k * b for a, b in zip(p[1:], d)))


def test_folded_lines(levels, region):
    for line in fold_lines(levels).collect():
        places = {x: v for (voi, x, y, z), v in region.items() if (voi, y, z) == (line.voi_id, line.y, line.z)}
        assert {line.x0 + i: v for i, v in enumerate(line.levels) if v is not None} == places
        assert line.levels[0] is not None and line.levels[-1] is not None


def test_pair_counts(levels, region):
    want = Counter()
    for p, v in region.items():
        for i, d in enumerate(DIRECTIONS):
            w = region.get(_beside(p, d))
            if w is not None:
                want[p[0], i, v, w] += 1
                want[p[0], i, w, v] += 1
    assert {(r.voi_id, r.direction, r.i, r.j): r.n for r in glcm_counts(levels).collect()} == dict(want)


def test_run_counts(levels, region):
    want = Counter()
    for p, v in region.items():
        for i, d in enumerate(DIRECTIONS):
            if region.get(_beside(p, d, -1)) != v:
                n = 1
                while region.get(_beside(p, d, n)) == v:
                    n += 1
                want[p[0], i, v, n] += 1
    assert {(r.voi_id, r.direction, r.level, r.length): r.n for r in glrlm_counts(levels).collect()} == dict(want)
    assert level_runs(fold_lines(levels.limit(0))).count() == 0


@pytest.mark.parametrize("alpha", [0, 1])
def test_neighbour_counts(levels, region, alpha):
    around = [d for d in DIRECTIONS] + [tuple(-x for x in d) for d in DIRECTIONS]
    dependence, seen = Counter(), {}
    for p, v in region.items():
        near = [region[q] for d in around if (q := _beside(p, d)) in region]
        dependence[p[0], v, 1 + sum(abs(v - w) <= alpha for w in near)] += 1
        if near:
            n, s = seen.get((p[0], v), (0, 0.0))
            seen[p[0], v] = n + 1, s + abs(v - sum(near) / len(near))
    assert {(r.voi_id, r.level, r.dependence): r.n for r in gldm_counts(levels, alpha).collect()} == dict(dependence)
    got = {(r.voi_id, r.level): (r.n, r.s) for r in ngtdm_counts(levels).collect()}
    assert got.keys() == seen.keys() and all(got[k][0] == seen[k][0] and abs(got[k][1] - seen[k][1]) < 1e-9 * (1 + seen[k][1]) for k in seen)


def test_edge(levels, region):
    want = set()
    for voi, x, y, z in region:
        if not all((voi, x + dx, y + dy, z) in region for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
            want.add((voi, x, y, z))
    got = [tuple(r) for r in interior_edge(levels).collect()]
    assert len(got) == len(set(got)) and set(got) == want
