"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, one per range of sorted keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import stored
from cohortspark.llm.radix import RadixTree, shared

#: A turn's id: the first bytes of the SHA-256 of role and text, then the text's length in UTF-8 bytes, both big-endian.
HASH_BYTES, LENGTH_BYTES = 16, 4
WIDTH = HASH_BYTES + LENGTH_BYTES
#: Key bytes (and what a key costs besides) of one range, whose tree a task holds.
RANGE_BYTES = 8 << 20
KEY_COST = 96
#: Conversations of one key whose ids are kept in one row: as many neighbouring ids as this power of two.
CHUNK_BITS = 12
OUT_ROWS = 1 << 15

NO_ENDS = hashlib.sha256(b"").hexdigest()

_PARTIAL = "part int, prefix binary, depth long, convs long, least long, children long, leaves long, bytes_in long, bytes_once long, ends string, parent long, up binary, first binary, last binary"
_FIX = "prefix binary, children long, leaves long, bytes_once long"


def turn_id(role, text):
    """The fixed-width id of a turn, as a column; a null role or text is empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 2 * HASH_BYTES), F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH_BYTES, "0")))


def with_shared_heads(
    df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", of: int = 5, cycle: int = 9
) -> DataFrame:
    """``conv_id, path``: every conversation with its head taken from the first conversation of its group.

    ``c`` gets the first ``h = crc32(c) % cycle`` turns of ``c - c % of`` (all, if fewer; none, if that one is absent), then its
    own turns after its first ``h``.  ``path`` is the ids of its turns, one after another.  Turns are ordered by ``turn``, null
    first; equal ones by their id.  Rows without key belong to no conversation; repeated rows are turns of their own;
    an empty table gives no rows; other columns are not read.  A conversation is one row: its ids, not its texts.
    """
    number = F.col(key).cast("long")
    turns = df.where(F.col(key).isNotNull()).select(
        (number - number % of).alias("base"),
        number.alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("id")).alias("t"),
    )
    # One shuffle for both groupings; a group of bases has at most 2 * of conversations.
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t"))["id"].alias("ids"))
    grouped = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "ids")).alias("all"))
    head = F.coalesce(F.get(F.filter("all", lambda c: c["conv_id"] == F.col("base")), F.lit(0))["ids"], F.array().cast("array<binary>"))
    each = grouped.select(F.slice(head, 1, cycle - 1).alias("head"), F.explode("all").alias("c")).select("head", "c.*")
    h = (F.crc32(F.col("conv_id").cast("string")) % cycle).cast("int")
    ids = F.concat(F.slice("head", F.lit(1), h), F.slice("ids", h + 1, F.greatest(F.size("ids") - h, F.lit(0))))
    return each.select("conv_id", F.unhex(F.array_join(F.transform(ids, lambda x: F.hex(x)), "")).alias("path"))


class _Rows:
    """Columns that are filled row by row and given out as batches."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.columns: list[list] = [[] for _ in schema]

    def put(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def __len__(self) -> int:
        return len(self.columns[0])

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return out


def _prefix_ids(key: bytes) -> list[bytes]:
    """An id for each of the key's turn-aligned beginnings, the empty one first."""
    running = hashlib.sha256()
    out = [running.digest()[:16]]
    for at in range(0, len(key), WIDTH):
        running.update(key[at : at + WIDTH])
        out.append(running.digest()[:16])
    return out


_PARTIAL_ARROW = pa.schema(
    [("part", pa.int32()), ("prefix", pa.binary())]
    + [(n, pa.int64()) for n in ("depth", "convs", "least", "children", "leaves", "bytes_in", "bytes_once")]
    + [("ends", pa.string()), ("parent", pa.int64()), ("up", pa.binary()), ("first", pa.binary()), ("last", pa.binary())]
)
_FIX_ARROW = pa.schema([("prefix", pa.binary()), ("children", pa.int64()), ("leaves", pa.int64()), ("bytes_once", pa.int64())])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, tuple[int, int, str]]]:
    """``key, (conversations, smallest, hash of their ids)`` from rows sorted by key and chunk; one key at a time is held."""
    key, count, least, running = None, 0, 0, None
    for batch in batches:
        ids = batch.column(1)
        flat, offsets = ids.flatten().to_pylist(), ids.offsets.to_pylist()
        base = offsets[0] if offsets else 0
        for i, path in enumerate(batch.column(0).to_pylist()):
            members = flat[offsets[i] - base : offsets[i + 1] - base]
            text = ",".join(map(str, members)).encode()
            if path == key:
                running.update(b"," + text)
                count += len(members)
                continue
            if key is not None:
                yield key, (count, least, running.hexdigest())
            key, count, least, running = path, len(members), members[0], hashlib.sha256(text)
    if key is not None:
        yield key, (count, least, running.hexdigest())


def range_nodes(keys: Iterator[tuple[bytes, tuple[int, int, str]]], part: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of sorted keys, as far as the range knows them.

    Nodes that begin the range's first or last key may go on in other ranges: they have ``prefix``.  All others are
    complete.  ``bytes_in`` sums members times bytes over the subtree, ``bytes_once`` bytes alone, so both add up over ranges.
    A node whose parent may be in other ranges names it by ``up``, all others by ``parent``.
    """
    tree, first, last = RadixTree(), None, None
    for last, value in keys:
        first = last if first is None else first
        tree.insert(last, value)
    if first is None:
        return
    ids = {True: _prefix_ids(first), False: _prefix_ids(last)}
    out = _Rows(_PARTIAL_ARROW)
    # What the subtrees of nodes on the stack have given: members, least, leaves, bytes_in, bytes_once, rows without a parent.
    given: list[tuple] = []
    for node, begin, end, on_first, on_last in tree.bottom_up():
        n, least, leaves, bytes_in, bytes_once, ends = 0, None, 0, 0, 0, None
        if node.value is not None:
            n, least, ends = node.value
        waiting: list[list] = []
        below = len(node.children())
        if below:
            for part_of in given[-below:]:
                n += part_of[0]
                least = part_of[1] if least is None or part_of[1] < least else least
                leaves += part_of[2]
                bytes_in += part_of[3]
                bytes_once += part_of[4]
                waiting += part_of[5]
            del given[-below:]
        else:
            leaves = 1
        top = 0 if end == 0 else begin // WIDTH + 1  # the root has depth 0; an edge has the depths that end on it
        edge_ends = end // WIDTH
        spine = on_first or on_last
        edge = b"\0" + node.path
        for depth in range(edge_ends, top - 1, -1):
            if depth:
                at = depth * WIDTH - begin  # ids differ within their hash, so the length that ends here lies on this edge
                size = int.from_bytes(edge[at - LENGTH_BYTES : at], "big")
                bytes_in += n * size
                bytes_once += size
            prefix = ids[on_first][depth] if spine else None
            for row in waiting:
                if spine:
                    row[11] = prefix
                else:
                    row[10] = least
                out.put(*row)
            whole = ends if depth * WIDTH == end else None
            row = [part, prefix, depth, n, least, len(waiting), leaves, bytes_in, bytes_once, whole, None, None, None, None]
            if not depth:
                row[12:] = first, last
                out.put(*row)
                waiting = []
            else:
                waiting = [row]
            if len(out) >= OUT_ROWS:
                yield out.batch()
        given.append((n, least, leaves, bytes_in, bytes_once, waiting))
    if len(out):
        yield out.batch()


def _fixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges have both counted: the nodes of the common beginning of one's last and the other's first key."""
    out = _Rows(_FIX_ARROW)
    for batch in batches:
        for last, following in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            common = shared(last, following) // WIDTH
            ids = _prefix_ids(following[: common * WIDTH])
            twice = 0
            goes_on = int(len(last) == common * WIDTH)  # the last key is no leaf: the following one goes on from it
            for depth in range(common, -1, -1):
                if depth:
                    twice += int.from_bytes(following[depth * WIDTH - LENGTH_BYTES : depth * WIDTH], "big")
                out.put(ids[depth], -int(depth < common), -goes_on, -twice)
                if len(out) >= OUT_ROWS:
                    yield out.batch()
    if len(out):
        yield out.batch()


def prefix_trie(members: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per distinct beginning of the paths of ``members`` (``conv_id, path``, as ``with_shared_heads`` gives them).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the
    subtree), ``saved_tokens`` (over the subtree, ``n_convs - 1`` times the last turn's bytes) and ``ends_sha256`` (of the ids
    that end here, ascending and comma-joined).  An empty table gives no rows; an empty path ends at the root.

    Members with equal paths are folded before they are sorted, in rows of at most ``2 ** CHUNK_BITS`` ids, so a path that very many
    share is a few rows.  Sorted paths are cut into ranges; each is one tree in one task.  Only nodes on the way to a
    range's first or last key can be in several ranges; their sums are added, less what neighbouring ranges both counted.
    """
    spark = members.sparkSession
    folded = members.groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    folded = stored(folded.select("path", "ids", "chunk"), "trie-paths")
    weight = folded.agg(F.sum(F.length("path") + KEY_COST)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // range_bytes))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return range_nodes(_keys(batches), TaskContext.get().partitionId())

    ordered = folded.repartitionByRange(ranges, "path").sortWithinPartitions("path", "chunk")
    nodes = stored(ordered.mapInArrow(trees, _PARTIAL), "trie-nodes")

    spine = nodes.where("prefix is not null")
    # One row per range: their number, not the data, bounds this window.
    follows = F.lead("first").over(Window.orderBy("part"))
    seams = nodes.where("first is not null").select("last", follows.alias("following")).where("following is not null")
    fixes = seams.mapInArrow(_fixes, _FIX)
    sums = ["convs", "children", "leaves", "bytes_in", "bytes_once"]
    both = spine.select("prefix", "depth", "least", "ends", "up", *sums).unionByName(fixes, allowMissingColumns=True)
    merged = both.groupBy("prefix").agg(
        F.max("depth").alias("depth"), F.min("least").alias("least"), F.max("ends").alias("ends"), F.max("up").alias("up"),
        *[F.sum(c).alias(c) for c in sums],
    )
    merged = stored(merged, "trie-spine")
    parents = merged.select(F.col("prefix").alias("up"), F.col("least").alias("parent"))
    tops = merged.join(parents, "up", "left")
    # Nodes below a spine node find its members by range, so a node with very many children is met range by range.
    known = spine.select("part", F.col("prefix").alias("up")).join(parents, "up")
    hanging = nodes.where("prefix is null and up is not null").drop("parent").join(known, ["part", "up"])
    inside = nodes.where("prefix is null and up is null")
    columns = [
        F.col("least").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("bytes_in") - F.col("bytes_once")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    ]
    return inside.select(columns).union(hanging.select(columns)).union(tops.select(columns))
