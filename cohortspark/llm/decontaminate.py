"""Benchmark decontamination: BM25 over test items with block-max pruning, then a check of question and answer."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from cohortspark.llm.common import map_texts, stored

K1, B = 1.2, 0.75
SHINGLE = 5
OVERLAP = 0.8
#: Items in a block of the index, whose largest impacts are kept for pruning.
BLOCK_ITEMS = 16
#: Words of items in one index; a larger benchmark is searched in several.
SHARD_WORDS = 400_000

#: ASCII punctuation and control characters become blanks, so that words compare without them.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer if others stand before it; an item of one sentence is all question."""
    parts = [plain_words(s) for s in _SENTENCE.split(text or "")]
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


@dataclass
class Item:
    item_id: object
    question: tuple[int, ...]
    answer: tuple[int, ...]

    @property
    def words(self) -> tuple[int, ...]:
        return self.question + self.answer


@dataclass
class ItemIndex:
    """Postings of the items by term, with impacts as shares of the item's threshold, in blocks of items.

    An impact is the term's BM25 contribution, divided by the least score that a passage must reach to hold
    ``OVERLAP`` of the item's shingles: a passage with a word missing lacks at least one shingle, so at most a share
    ``1 - OVERLAP`` of the item's word places can be missing, and at worst the heaviest ones.  A scaled score of 1 is
    thus never missed by a passage that would be verified.
    """

    terms: dict[bytes, int]
    items: list[Item]
    largest: np.ndarray  # per term, over all items
    block_at: np.ndarray  # per term: where its blocks start
    blocks: np.ndarray
    block_max: np.ndarray
    post_at: np.ndarray  # per term: where its items start
    posts: np.ndarray
    impact: np.ndarray
    least: np.ndarray  # per item: the threshold in BM25 units
    segment: int  # words between two passages; a passage has two segments

    def passages(self, word_ids: np.ndarray) -> list[tuple[int, int, float]]:
        """``(passage, item, score)`` of all passages of a text whose scaled score reaches 1."""
        at = np.flatnonzero(word_ids >= 0)
        if not len(at):
            return []
        term, piece = word_ids[at].astype(np.int64), at // self.segment
        # One row for each different term of a segment, then for each passage of two segments.
        key = np.unique(piece * len(self.terms) + term)
        piece, term = key // len(self.terms), key % len(self.terms)
        count = len(word_ids) // self.segment + 1
        bound = np.bincount(piece, self.largest[term], count + 1)
        open_ = bound + np.concatenate([bound[1:], [0.0]]) >= 1 - 1e-9  # list maxima, a term of both segments counted twice
        if not open_.any():
            return []
        both = np.concatenate([key, key - len(self.terms)])
        passage = both // len(self.terms)
        both = np.unique(both[(passage >= 0) & open_[np.maximum(passage, 0)]])
        passage, term = both // len(self.terms), both % len(self.terms)
        # List maxima once more, without repeats; then block maxima; then the items of blocks that may reach 1.
        keep = np.bincount(passage, self.largest[term], count + 1)[passage] >= 1 - 1e-9
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return []
        many = math.ceil(len(self.items) / BLOCK_ITEMS)
        row, entry = _expand(self.block_at, term)
        sums, inverse = _sums(passage[row] * many + self.blocks[entry], self.block_max[entry])
        live = sums[inverse] >= 1 - 1e-9
        live_blocks = np.unique((passage[row] * many + self.blocks[entry])[live])
        if not len(live_blocks):
            return []
        hot = np.unique(live_blocks // many)
        keep = np.isin(passage, hot)
        passage, term = passage[keep], term[keep]
        row, entry = _expand(self.post_at, term)
        inside = np.isin(passage[row] * many + self.posts[entry] // BLOCK_ITEMS, live_blocks)
        row, entry = row[inside], entry[inside]
        pair = passage[row] * len(self.items) + self.posts[entry]
        keys, where = np.unique(pair, return_inverse=True)
        scores = np.bincount(where, self.impact[entry])
        good = scores >= 1 - 1e-9
        return [(int(k) // len(self.items), int(k) % len(self.items), float(s)) for k, s in zip(keys[good], scores[good])]


def _expand(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``term``, all entries of that term."""
    n = at[term + 1] - at[term]
    row = np.repeat(np.arange(len(term)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[term], n)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return np.bincount(inverse, values, len(found)), inverse


def shingles(words: tuple[int, ...]) -> list[tuple[int, ...]]:
    n = min(SHINGLE, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def build_index(items: list[tuple[object, list[bytes], list[bytes]]], frequency: dict[bytes, int], total: int, mean: float) -> ItemIndex:
    """``items`` are (id, question words, answer words) of one shard; the statistics are those of all items."""
    terms = {w: i for i, w in enumerate(sorted({w for _, q, a in items for w in (*q, *a)}))}
    postings: dict[int, list[tuple[int, float]]] = {}
    made, least = [], []
    for number, (item_id, question, answer) in enumerate(items):
        item = Item(item_id, tuple(terms[w] for w in question), tuple(terms[w] for w in answer))
        made.append(item)
        counts = Counter((*question, *answer))
        size = sum(counts.values())
        weight = {}
        for word, n in counts.items():
            idf = math.log(1 + (total - frequency[word] + 0.5) / (frequency[word] + 0.5))
            weight[word] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean))
        lost = math.floor((1 - OVERLAP) * len(shingles(item.words)) + 1e-9)
        threshold = max(sum(weight.values()) - sum(sorted(weight.values())[::-1][:lost]), 1e-9)
        least.append(threshold)
        for word, w in weight.items():
            postings.setdefault(terms[word], []).append((number, w / threshold))
    block_at, blocks, block_max, post_at, posts, impact = [0], [], [], [0], [], []
    for t in range(len(terms)):
        tops: dict[int, float] = {}
        for number, w in postings[t]:
            posts.append(number)
            impact.append(w)
            tops[number // BLOCK_ITEMS] = max(tops.get(number // BLOCK_ITEMS, 0.0), w)
        post_at.append(len(posts))
        blocks += tops
        block_max += tops.values()
        block_at.append(len(blocks))
    impact_array = np.array(impact)
    at = np.array(post_at, np.int64)
    largest = np.maximum.reduceat(impact_array, at[:-1]) if terms else np.zeros(0)
    longest = max((len(i.words) for i in made), default=1)
    return ItemIndex(
        terms, made, largest, np.array(block_at, np.int64), np.array(blocks, np.int64), np.array(block_max), at,
        np.array(posts, np.int64), impact_array, np.array(least), max(32, longest),
    )


def verify(item: Item, passage: list[int]) -> tuple[float, float, float]:
    """Shares of the item's shingles, of the question's words and of the answer's words that the passage holds."""
    wanted = shingles(item.words)
    n = min(SHINGLE, len(item.words))
    here = set(zip(*(passage[i:] for i in range(n))))
    overlap = sum(s in here for s in wanted) / len(wanted)
    there = Counter(passage)
    share = lambda words: sum(min(n, there[w]) for w, n in Counter(words).items()) / len(words) if words else 1.0
    return overlap, share(item.question), share(item.answer)


def leaks(index: ItemIndex, text: str | None) -> list[tuple[int, float, float, float, float]]:
    """Items that a text holds: ``(item, bm25, overlap, question, answer)``, the best passage of each."""
    if not index.items:
        return []
    words = plain_words(text)
    ids = np.fromiter(map(index.terms.get, words, repeat(-1)), np.int64, len(words))
    best: dict[int, tuple] = {}
    for passage, number, score in index.passages(ids):
        item = index.items[number]
        start = passage * index.segment
        overlap, question, answer = verify(item, ids[start : start + 2 * index.segment].tolist())
        if overlap >= OVERLAP:  # the shares of question and answer are told, but an item may have lost either
            found = (overlap, score * index.least[number], question, answer)
            if found > best.get(number, ()):
                best[number] = found
    return [(n, round(s, 6), o, q, a) for n, (o, s, q, a) in sorted(best.items())]


def item_indexes(items: DataFrame, key: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> list[ItemIndex]:
    """Inverted indexes over the items, each of about ``shard_words`` words, with the statistics of all items.

    Items without words are left out.  A shard's items come to the driver one shard at a time.
    """

    def split(texts):
        both = [question_and_answer(t) for t in texts]
        return [q for q, _ in both], [a for _, a in both]

    fields = "question array<binary>, answer array<binary>"
    parsed = stored(map_texts(items, [key], text, split, fields).withColumn("words", F.concat("question", "answer")).where("size(words) > 0"), "items")
    total, mean, size = parsed.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.size("words"))).first()
    if not total:
        return []
    shards = math.ceil(size / shard_words)
    dealt = parsed.withColumn("shard", F.pmod(F.xxhash64(key, "words"), F.lit(shards)))
    counted = dealt.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    out = []
    for shard in range(shards):
        mine = dealt.where(F.col("shard") == shard)
        rows = mine.select(key, "question", "answer").orderBy(key).collect()
        used = mine.select(F.explode("words").alias("w")).distinct()
        frequency = {bytes(r["w"]): r["n"] for r in counted.join(used, "w", "left_semi").collect()}
        listed = [(r[key], [bytes(w) for w in r["question"]], [bytes(w) for w in r["answer"]]) for r in rows]
        out.append(build_index(listed, frequency, total, mean))
    return out


def find_leaks(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``key, item_id, bm25, overlap, question_overlap, answer_overlap`` of each item that a text holds.

    Every text is cut into passages of two segments (a segment is as long as the longest item), each passage is a query,
    and all items above their threshold are retrieved and verified: a passage holds an item if it has ``OVERLAP`` of its
    five-word shingles.  The shares of the question's and of the answer's words in it are given beside.  Null and empty texts and items hold and are nothing;
    null keys and repeated rows are kept; with an empty table there are no rows.  No shuffle of the texts.
    """
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType
    out = None
    for index in item_indexes(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(index)  # bounded by the words of a shard

        def search(texts, shared=shared):
            return [[leaks(shared.value, t) for t in texts]]

        found = map_texts(docs, [key], text, search, "found array<struct<item:int,bm25:double,overlap:double,question:double,answer:double>>")
        ids = spark.createDataFrame([(i, item.item_id) for i, item in enumerate(index.items)], f"item int, `{item_key}` {kind.simpleString()}")
        rows = found.select(key, F.explode("found").alias("f")).select(key, "f.*").join(F.broadcast(ids), "item")
        rows = rows.select(
            key, item_key, "bm25", "overlap", F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap")
        )
        out = rows if out is None else out.union(rows)
    if out is None:
        fields = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {kind.simpleString()}, bm25 double, overlap double, question_overlap double, answer_overlap double"
        return spark.createDataFrame([], fields)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item."""
    for index in item_indexes(items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @pandas_udf("boolean")
        def clean(texts, shared=shared):
            return texts.map(lambda t: not leaks(shared.value, t), na_action=None).astype(bool)

        docs = docs.where(clean(F.col(text)))
    return docs
