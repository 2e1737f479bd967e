"""WARC archives of pages: a writer with revisit records and a reader that salvages damaged files.

The writer makes each page a record of its own gzip member (or plain, with gzip=False) in archives of
bounded size. Of pages with equal payloads of at least min_bytes bytes, the one with the smallest id is
a response and the others are revisits that refer to it; rows that repeat the id and payload of that
response are responses too. A null payload counts as empty, rows with a null id are written with an
empty id. Extra columns are ignored; an empty table writes no archive. Archives of an attempt have names of
their own, and those of the attempts that count are listed, so a task that runs again leaves nothing behind that is read.

The reader checks every member and record (inflate checksum, version line, lengths, block and payload
digests). After a failed check it searches for the next gzip member or version line that parses, goes
on from there, and logs the bytes in between as a quarantined gap, so no byte is passed over silently. Of a
member that fails, the good records among what inflates are given too, with the member's place.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, shared_dir, shuffle_partitions

log = logging.getLogger(__name__)

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 16 << 20
MAGIC = b"\x1f\x8b\x08"
URN = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as bytes: a response with its payload, or a revisit without it."""
    block = HTTP if refers_to is not None else HTTP + payload
    lines = [
        VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Sink:
    """A folder, local or of any scheme that pyarrow opens; files appear whole or not at all."""

    def __init__(self, folder: str):
        u = urlparse(folder)
        self.fs, self.folder = None, u.path
        if u.scheme not in ("", "file"):
            from pyarrow import fs

            self.fs, self.folder = fs.FileSystem.from_uri(folder)

    def put(self, name: str, parts: list[bytes]) -> None:
        path, part = f"{self.folder}/{name}", f"{self.folder}/_{name}.{uuid.uuid4().hex}"
        if self.fs is not None:
            self.fs.create_dir(self.folder, recursive=True)
            with self.fs.open_output_stream(part) as f:
                for x in parts:
                    f.write(x)
            self.fs.move(part, path)
            return
        os.makedirs(self.folder, exist_ok=True)
        with open(part, "wb") as f:
            f.writelines(parts)
        os.replace(part, path)

    def get(self, name: str) -> bytes:
        if self.fs is not None:
            with self.fs.open_input_file(f"{self.folder}/{name}") as f:
                return f.read()
        with open(f"{self.folder}/{name}", "rb") as f:
            return f.read()


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary) and refers_to: the response's id for revisits, else null."""
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    keyed = p.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("size"))
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    again = keyed.join(groups, ["sha", "size"]).where(F.col("page_id") != F.col("first")).select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    return p.withColumn("sha", F.sha1("payload")).join(again, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")


def write(pages: DataFrame, folder: str, gzip: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of with_revisits() as archives under folder; returns (path, records, bytes) of each archive.

    Only the archives in this table count: an attempt that failed may have left others.
    """
    suffix = ".warc.gz" if gzip else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, task = _Sink(folder), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        parts, size, seq, done = [], 0, 0, {"path": [], "records": [], "bytes": []}

        def flush():
            nonlocal parts, size, seq
            if parts:
                name = f"part-{task}-{seq:04d}{suffix}"
                sink.put(name, parts)
                for k, v in (("path", f"{folder}/{name}"), ("records", len(parts)), ("bytes", size)):
                    done[k].append(v)
                parts, size, seq = [], 0, seq + 1

        for batch in batches:
            ids, urls, refs = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            payloads = batch.column("payload")
            for i in range(batch.num_rows):
                one = record("" if ids[i] is None else str(ids[i]), urls[i], payloads[i].as_py(), None if refs[i] is None else str(refs[i]))
                if gzip:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    one = z.compress(one) + z.flush()
                parts.append(one)
                size += len(one)
                if size >= archive_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return keep(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "warc-archives")


class Bad(Exception):
    pass


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What inflates of the member at this offset, the offset after it (-1 if its end isn't found) and what is wrong, if anything."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    while not z.eof and at < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(view[at : at + 16384]))
        except zlib.error as e:
            # the step again, byte by byte, for what comes before the damage
            try:
                for i in range(at, min(at + 16384, len(data))):
                    out.append(before.decompress(view[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), -1, f"gzip: {e}"
        at += 16384
    if not z.eof:
        return b"".join(out), -1, "gzip: truncated member"
    return b"".join(out), min(at, len(data)) - len(z.unused_data), ""


def _records(out: bytes) -> tuple[list, str]:
    """The good records of a member, and what is wrong with the first bad one, if any."""
    some, at, wrong = [], 0, "" if out else "empty member"
    while 0 <= at < len(out):
        try:
            head, block, at = _record(out, at)
            some.append((head, block))
        except Bad as e:
            wrong, at = wrong or str(e), out.find(b"WARC/", at + 1)
    return some, wrong


def _record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and the offset after the record that begins here."""
    if not data.startswith(b"WARC/", at):
        raise Bad("no version line")
    if not VERSION_LINE.match(data, at):
        raise Bad("malformed version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Bad("headers don't end")
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Bad("malformed header")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise Bad("no length")
    a = stop + 4
    b = a + int(head["content-length"])
    if data[b : b + 4] != b"\r\n\r\n":
        raise Bad("record doesn't end where its length says")
    block = data[a:b]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise Bad("block digest differs")
    if head.get("warc-type") == "response":
        want = head.get("warc-payload-digest", "")
        if want.startswith("sha1:") and want[5:] != digest(block.partition(b"\r\n\r\n")[2]):
            raise Bad("payload digest differs")
    return head, block, b + 4


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, b"") in order; they cover all bytes."""
    at, n, lost, reason = 0, len(data), None, ""
    while at < n:
        try:
            if data.startswith(MAGIC, at):
                out, end, wrong = _inflate(data, at)
                some, bad = _records(out)
                if wrong or bad:
                    raise Bad(wrong or bad)
            else:
                some, end = [], -1
                head, block, end = _record(data, at)
                some = [(head, block)]
        except Bad as e:
            # good records of a bad member lie in a gap, which says that not all of the member could be read
            nexts = [i for i in (data.find(MAGIC, at + 1), data.find(b"WARC/", at + 1)) if i >= 0]
            after = end if end >= 0 else min(nexts, default=n)
            if some and lost is not None:
                yield "gap", lost, at, reason, b""
                lost = None
            for head, block in some:
                yield "record", at, after, head, block
            if lost is None:
                lost, reason = at, str(e)
            at = after
            continue
        if lost is not None:
            yield "gap", lost, at, reason, b""
            lost = None
        for head, block in some:
            yield "record", at, end, head, block
        at = end
    if lost is not None:
        yield "gap", lost, n, reason, b""


READ_SCHEMA = "path string, kind string, start long, end long, reason string, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _rows(path: str, data: bytes, payloads: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for kind, a, b, head, block in salvage(data):
        row = dict.fromkeys(schema.names) | {"path": path, "kind": kind, "start": a, "end": b}
        if kind == "gap":
            row["reason"] = head
        else:
            bare = lambda k: (head.get(k) or "").strip("<>").removeprefix(URN) or None  # noqa: B023, E731
            payload = block.partition(b"\r\n\r\n")[2]
            length = head.get("x-payload-length", "")
            row |= {
                "record_type": head.get("warc-type"), "record_id": bare("warc-record-id"), "uri": head.get("warc-target-uri"), "refers_to": bare("warc-refers-to"),
                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                "payload_bytes": int(length) if length.isdigit() else len(payload), "payload": payload if payloads else None,
            }
            size += len(payload) if payloads else 0
        rows.append(row)
        if len(rows) >= 2000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in READ_SCHEMA.split(", "))])


def read(spark: SparkSession, paths: str | list[str], payloads: bool = True) -> DataFrame:
    """Records (kind = record) and quarantined gaps (kind = gap) of the archives under these paths, up to 2 GB each."""
    schema = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _rows(batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), payloads, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(paths)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


def read_written(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """As read(), of the archives that write() listed; workers open them as they wrote them."""
    schema = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                folder, _, name = path.rpartition("/")
                yield from _rows(path, _Sink(folder).get(name), payloads, schema)

    spread = max(2, shuffle_partitions(archives.sparkSession))
    return archives.select("path").repartition(spread, "path").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back; what was quarantined is logged."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/chronoweave/warc-{uuid.uuid4().hex}"
    found = keep(read_written(write(with_revisits(pages), folder), payloads=False), "warc-records")
    lost = found.where(F.col("kind") == "gap").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes")).first()
    if lost["n"]:
        log.warning("%d gaps of %d bytes quarantined in %s", lost["n"], lost["bytes"], folder)
    return found
