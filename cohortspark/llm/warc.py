"""WARC archives as a table of payload chunks, written and read by Spark's text source.

An archive line ends with CR LF, so a record (header, blank line, block, CR LF, CR LF) is one row whose row separator is
the last CR LF.  A block larger than ``chunk_bytes`` becomes several rows: WARC segments (a first record and
``continuation`` records).  Reading yields rows (record id, chunk number): a task holds one chunk and the digest state,
never a whole payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_BYTES = 1 << 20
#: Bytes of rows that are handed on together.
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"

_CRLF = b"\r\n"
_VISIBLE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")

CHUNKS = (
    "record_id string, warc_type string, target_uri string, refers_to string, chunk_no int, start long, data binary, "
    "payload_bytes long, payload_digest string, last boolean"
)


def bare_digest(state) -> str:
    return base64.b32encode(state.digest()).decode()


def record_name(page_id, digest: str) -> str:
    """A record's URI; the page id can be read back from it."""
    return f"urn:page:{'' if page_id is None else quote(str(page_id), safe='')}:{digest}"


def record_rows(page_id, url, payload: memoryview, refers_to, is_copy: bool, chunk_bytes: int) -> Iterator[bytes]:
    """The archive rows of one page: a revisit without block, or a response in one or more segments."""
    state = hashlib.sha1()
    for start in range(0, len(payload), chunk_bytes):
        state.update(payload[start : start + chunk_bytes])
    digest = bare_digest(state)
    name = record_name(page_id, digest)
    common = [
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=_VISIBLE) if url else name}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]

    def row(fields: list[str], *block) -> bytes:
        return b"".join([_CRLF.join(s.encode() for s in ["WARC/1.1", *fields]), _CRLF * 2, *block, _CRLF])

    if is_copy:
        yield row(
            [
                "WARC-Type: revisit",
                f"WARC-Record-ID: <{name}>",
                *common,
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                f"WARC-Refers-To: <{record_name(refers_to, digest)}>",
                f"X-Payload-Length: {len(payload)}",
                "Content-Length: 0",
            ]
        )
        return
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    pieces = [payload[i : i + chunk_bytes] for i in range(0, len(payload), chunk_bytes)] or [payload]
    for k, piece in enumerate(pieces, 1):
        block = (http, piece) if k == 1 else (piece,)
        kind = "response" if k == 1 else "continuation"
        fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name if k == 1 else f'{name}:{k}'}>", *common]
        if k == 1:
            fields.append("Content-Type: application/http;msgtype=response")
        if len(pieces) > 1:
            fields.append(f"WARC-Segment-Number: {k}")
        if k > 1:
            fields.append(f"WARC-Segment-Origin-ID: <{name}>")
            if k == len(pieces):
                fields.append(f"WARC-Segment-Total-Length: {len(http) + len(payload)}")
        yield row([*fields, f"Content-Length: {sum(map(len, block))}"], *block)


def _batched(rows: Iterator[tuple], sizes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sizes(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    revisit_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    compression: str = "gzip",
) -> None:
    """Write one record per page below ``path``, a ``revisit`` where a smaller page id has the same payload.

    Payloads shorter than ``revisit_bytes`` are always responses.  A null payload is empty; a null URL is replaced by the
    record's name; a null page id comes after all others.  Pages with the same id and payload are all responses, or all
    revisits.  Only the three columns are read.  The payload is shuffled once, by page id, so copies do not meet in a
    task; the digests' smallest ids are counted before the shuffle.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    digest = F.sha1(body)
    rows = pages.select(
        F.col(page_id).alias("_id"), F.col(url).cast("string").alias("_url"), body.alias("_body"), digest.alias("_sha1")
    )
    side = rows.where(F.length("_body") >= revisit_bytes).select("_id", "_sha1")
    firsts = side.groupBy("_sha1").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copies = (
        side.join(firsts, "_sha1")
        .where("_first is not null and (_id is null or _id > _first)")
        .distinct()
        .withColumnsRenamed({"_id": "_cid", "_sha1": "_csha1"})
    )
    joined = rows.join(copies, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_sha1") == F.col("_csha1")), "left")
    joined = joined.select("_id", "_url", "_body", "_first")
    schema = to_arrow_schema(joined.select(F.col("_body").alias("value")).schema)

    def run(batches):
        def rows():
            for batch in batches:
                ids, urls, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3))
                bodies = batch.column(2)
                for i, (one, where, first) in enumerate(zip(ids, urls, firsts)):
                    data = memoryview(bodies[i].as_buffer())
                    for value in record_rows(one, where, data, first, first is not None, chunk_bytes):
                        yield (value,)

        return _batched(rows(), lambda r: len(r[0]), schema)

    lines = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n").option("compression", compression).text(path)


class RecordParser:
    """Turns the CR LF separated lines of an archive into payload chunks, with the digest of all payload so far."""

    def __init__(self, chunk_bytes: int, with_data: bool):
        self.chunk_bytes, self.with_data = chunk_bytes, with_data
        self.mode, self.need = "idle", 0
        self.head: dict[str, str] = {}
        self.record: dict | None = None

    def line(self, line: bytes) -> Iterator[tuple]:
        if self.mode == "idle":
            if line.startswith(b"WARC/"):
                self.mode, self.head = "head", {}
            elif line:
                raise ValueError(f"a record starts with {line[:40]!r}")
        elif self.mode == "head":
            if line:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                self.head[name.strip().lower()] = value.strip()
            else:
                yield from self._begin()
        else:
            self.need -= len(line)
            more = self.need > 0
            self.need -= 2 * more
            if self.need < 0:
                raise ValueError("a block is longer than its Content-Length")
            yield from self._block(line, more)
            if not more:
                yield from self._end()

    def close(self) -> None:
        if self.mode != "idle" or self.record:
            raise ValueError("an archive ends inside a record")

    def _begin(self):
        head = self.head
        if head["warc-type"] == "continuation":
            if not self.record or head.get("warc-segment-origin-id") != self.record["id"]:
                raise ValueError("a continuation does not follow its record")
        else:
            self.record = {
                "id": head["warc-record-id"],
                "head": head,
                "http": head.get("content-type", "").startswith("application/http"),
                "sha1": hashlib.sha1(),
                "bytes": 0,
                "held": bytearray(),
                "chunk": 0,
            }
        self.need = int(head["content-length"])
        if self.need:
            self.mode = "block"
        else:
            yield from self._end()

    def _block(self, line: bytes, more: bool):
        r = self.record
        if r["http"]:
            r["http"] = bool(line)
            return
        held = r["held"]
        held += line
        if more:
            held += _CRLF
        while len(held) >= self.chunk_bytes:
            yield self._chunk(bytes(held[: self.chunk_bytes]), False)
            del held[: self.chunk_bytes]

    def _chunk(self, data: bytes, last: bool) -> tuple:
        r, head = self.record, self.record["head"]
        start = r["bytes"]
        r["sha1"].update(data)
        r["bytes"] += len(data)
        r["chunk"] += 1
        digest, size = bare_digest(r["sha1"]), r["bytes"]
        said = head.get("warc-payload-digest", "").removeprefix("sha1:")
        if head["warc-type"] == "revisit":
            digest, size = said, int(head.get("x-payload-length", 0))
        elif last and said and said != digest:
            raise ValueError(f"the payload of {r['id']} does not have its digest")
        link = head.get("warc-refers-to")
        return (
            r["id"].strip("<>"), head["warc-type"], head.get("warc-target-uri"), link and link.strip("<>"),
            r["chunk"] - 1, start, data if self.with_data else None, size, digest, last,
        )

    def _end(self):
        self.mode = "idle"
        head = self.head
        if "warc-segment-number" in head and "warc-segment-total-length" not in head:
            return
        yield self._chunk(bytes(self.record["held"]), True)
        self.record = None


def read_warc(spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Payload chunks of the gzip archives below ``path``: columns ``CHUNKS``, one row with ``last`` per record.

    ``payload_bytes`` and ``payload_digest`` cover the payload up to and with the chunk, so the last row has those of
    the whole payload (for a revisit: of the record it refers to).  A payload that does not have its digest, and an archive that
    is cut off, raise an error.  An archive is read by one task from start to end; archives are as large as a partition.
    """
    lines = spark.read.option("lineSep", "\r\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = to_arrow_schema(spark.createDataFrame([], CHUNKS).schema)

    def run(batches):
        def rows():
            file, parser = None, None
            for batch in batches:
                values = batch.column(1)
                for i, name in enumerate(batch.column(0).to_pylist()):
                    if name != file:
                        if parser:
                            parser.close()
                        file, parser = name, RecordParser(chunk_bytes, with_data)
                    yield from parser.line(values[i].as_py())
            if parser:
                parser.close()

        return _batched(rows(), lambda r: 200 + len(r[6] or b""), schema)

    return lines.mapInArrow(run, CHUNKS)


def page_of(record: str | None) -> str | None:
    """The page id, as text, in a record's name."""
    if not record or not record.startswith("urn:page:"):
        return None
    return unquote(record.split(":")[2]) or None
