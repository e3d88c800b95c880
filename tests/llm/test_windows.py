"""Best-fit decreasing packing: against a plain best fit, and every id in one place."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortspark.llm import queries
from cohortspark.llm.windows import Piece, best_fit_decreasing, fill_by_cuts, pack_windows, powers_of_two

SF = "/root/testdata/sf0.01"


def _pieces(lengths):
    return [Piece(i, 0, n, memoryview(bytes(4 * n)), n) for i, n in enumerate(lengths)]


def _plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return Counter(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_best_fit_and_filling(case):
    capacity, lengths = case
    windows = best_fit_decreasing(_pieces(lengths), capacity)
    assert Counter(capacity - sum(p.length for p in w) for w in windows) == _plain_best_fit(lengths, capacity)
    full, rest = fill_by_cuts(windows, capacity)
    last = powers_of_two(rest)
    assert all(sum(p.length for p in w) == capacity for w in full) and sum(p.length for p in rest) < capacity
    sizes = [sum(p.length for p in w) for w in last]
    assert all(n & (n - 1) == 0 for n in sizes) and len(set(sizes)) == len(sizes)
    seen = {}
    for w in [*full, *last]:
        for p in w:
            assert p.length == len(p.ids) // 4 > 0
            seen.setdefault(p.key, []).append((p.start, p.length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == n


def check_windows(rows, docs, capacity):
    """Every document's ids once, in sequences without gaps and without padding; the number of sequences."""
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    want = Counter()
    ids = {}
    for k, text in docs:
        mine = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        raw = b"".join(i.to_bytes(4, "little") for i in mine)
        want[k, len(mine)] += len(mine)
        ids.setdefault((k, len(mine)), set()).add(raw)
    got, sequences = Counter(), {}
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        assert any(zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for raw in ids[r.doc_id, r.doc_tokens])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    return len(sequences)


@pytest.mark.parametrize("held", [1, 3_000, 1 << 22])
def test_odd_documents(spark, held):
    random.seed(held)
    docs = [(k, " ".join(random.choice(["one", "two", "three", "x"]) for _ in range(random.randint(0, 90)))) for k in range(150)]
    docs += [(200, None), (201, ""), (None, "null key"), (None, "another one"), (202, "same"), (202, "same"), (203, "long " * 5_000), (204, " " * 200_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, ids string, length int").repartition(3)
    packed = pack_windows(df, queries.vocabulary(), capacity=64, held_tokens=held).selectExpr("*", "crc32(ids) as ids_crc32").collect()
    total = sum(r.length for r in packed)
    assert check_windows(packed, docs, 64) <= total // 64 + 3 * 6
    by_key = pack_windows(df.selectExpr("cast(doc_id as string) as doc_id", "text"), queries.vocabulary())
    assert by_key.schema["doc_id"].dataType.simpleString() == "string" and by_key.where("doc_id is null and start = 0").count() == 2
    assert pack_windows(df.limit(0), queries.vocabulary()).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op12_windows(spark, SF).collect()
    total = sum(r.length for r in rows)
    assert check_windows(rows, docs, 1024) <= total // 1024 + 10 * 8
