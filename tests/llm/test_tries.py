"""The radix tree and the prefix trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import turntrie
from cohortspark.llm.radix import RadixTree, shared
from cohortspark.llm.turntrie import NO_ENDS, prefix_trie, with_shared_heads


def _find(tree, key):
    node, at = tree.root, 0
    while at < len(key):
        node = node.child(key[at])
        if node is None or not key.startswith(node.path, at + 1):
            return None
        at += 1 + len(node.path)
    return node.value if at == len(key) else None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6) | st.binary(min_size=1, max_size=1).map(lambda b: b + b"zz"), max_size=400))
def test_radix_tree(keys):
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    want = {key: i for i, key in enumerate(keys)}
    assert {k: _find(tree, k) for k in want} == want and _find(tree, b"\xff" * 9) is None
    nodes = list(tree.bottom_up())
    assert nodes[-1][0] is tree.root
    assert sorted(n.value for n, *_ in nodes if n.value is not None) == sorted(want.values())
    if want:
        first = [n for n, _, _, on_first, _ in nodes if on_first]
        last = [n for n, _, _, _, on_last in nodes if on_last]
        assert first[0].value == want[min(want)] and last[0].value == want[max(want)]


def test_layouts_grow():
    tree = RadixTree()
    seen = set()
    for label in random.Random(3).sample(range(256), 256):
        tree.insert(bytes([label, 1, 2]), label + 1)
        seen.add(tree.root.places)
    assert seen == {4, 16, 48, 256} and [n.value for n in tree.root.children()] == list(range(1, 257))
    assert shared(b"abcd", b"abxd") == 2 and shared(b"ab", b"abc") == 2 and shared(b"", b"x") == 0


def brute_trie(rows):
    """Nodes of the rebuilt conversations; ``rows`` hold key, turn, role and text, no equal turns in one conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        childless = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
            len(childless), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(repr, out))


def _trie(spark, rows, **options):
    df = spark.createDataFrame(
        [(*r, "x", b"y", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, ids binary, depth int"
    )
    return sorted(repr(tuple(r)) for r in prefix_trie(with_shared_heads(df.repartition(3)), **options).collect())


@pytest.mark.parametrize("range_bytes", [200, 1 << 20])
def test_trie_against_brute_force(spark, range_bytes):
    rng = random.Random(range_bytes)
    rows = []
    for c in range(120):
        turns = [None, *rng.sample(range(-3, 30), rng.randint(0, 7))]
        rows += [(c, t, rng.choice(["user", None, ""]), rng.choice(["a", "bé", "", None, "long " * 9])) for t in turns if t is not None or rng.random() < 0.3]
    rows += [(200 + i, t, "user", "same") for i in range(40) for t in range(3)]  # copies
    rows += [(1000, t, "r", f"{t}") for t in range(300)] + [(1003, t, "r", f"{t}") for t in range(200)]  # long
    rows += [(None, 1, "user", "nobody's"), (7001, 1, None, None), (7003, 1, "user", "ü" * 100_000)]
    assert _trie(spark, rows, range_bytes=range_bytes) == brute_trie(rows)


def test_trie_of_many_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "CHUNK_BITS", 3)
    rows = [(5 * i, t, "u", f"t{t}") for i in range(60) for t in range(2)] + [(-5 * i, 1, "u", "n") for i in range(1, 30)]
    assert _trie(spark, rows) == brute_trie(rows)


def test_trie_odd_tables(spark):
    assert _trie(spark, []) == []
    assert _trie(spark, [(None, None, None, None)]) == []
    # A conversation whose group has no first one and whose own turns all fall away is a member of the root alone.
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    got = _trie(spark, [(lone, None, None, None)])
    assert got == brute_trie([(lone, None, None, None)]) and len(got) == 1 and NO_ENDS not in got[0]
    # Repeated rows are turns of their own; equal turns are ordered by their ids, whatever the order of the rows.
    rows = [(0, 1, "a", "x"), (0, 1, "a", "x"), (0, None, "b", "y"), (0, None, "c", "z")]
    assert _trie(spark, rows) == _trie(spark, rows[::-1])
