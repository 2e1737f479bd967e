"""Removal of byte strings of LENGTH bytes that occurred before, by bucket-pointer refinement.

Sorting all suffixes to depth LENGTH puts equal strings into one bucket; all but a bucket's first start
go. Only suffixes that can share their bucket are sorted:

* Initial buckets: of the GRAM-byte grams in a string of LENGTH bytes, the one with the smallest hash is
  its anchor, so equal strings have equal anchors at equal offsets. Anchors are bucketed by their gram.
  The starts that share an anchor are one run, named by the hash of all bytes they cover. Buckets of one
  run are final. In the others, runs with one name are equal throughout: the first stays, later ones go.
* Refinement: where a bucket has runs of several names, its starts are sorted, a block of texts at a time,
  by their first 8 bytes, then by the bucket pointers of the starts 8, 16, 32 and so on bytes later, each
  round reusing the pointers of the round before, up to LENGTH bytes. All but the first of a bucket go;
  the first ones of all blocks meet by the name of their bytes, and all but the first of these go.

In a block, bytes are compared. Across blocks strings are known by 128-bit names computed from the bytes by two
hashes, the same in every task, in place of ranks that would take a global sort; among 10**14 starts, two different
strings share one with a chance below 10**-10. Texts are kept as blocks in a bucketed table, so that verdicts, which are
small, travel to the texts. Equal runs of a block collapse before they are dealt out, so a passage that
very many documents share costs one entry a block.

Order is by doc_id (null last), then block, then position; rows that share an id count as documents one
after the other. Null texts count as empty. Matches don't cross documents. Extra columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucket_ids, keep, keep_bucketed, shuffle_partitions, text_of
from .tokens import BYTE_CODE, U64, hash_runs, mix, prefix, texts

_CODE = mix(BYTE_CODE + U64(0x6A09E667F3BCC909))

#: Length of the strings; of the grams that anchor them; bytes of text in a block; entries in a shard.
LENGTH, GRAM, BLOCK_BYTES, SHARD = 100, 24, 3 << 20, 400_000
_NO_ID = (1 << 63) - 1
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, ids, has_id, off, data) of some MB of text each, in a table bucketed by block."""
    names = ["block", "ids", "has_id", "off", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers, ids, parts, sizes, total = bucket_ids(TaskContext.get().partitionId(), buckets), [], [], [], 0

        def made():
            has = np.array([i is not None for i in ids])
            values = [np.array([_NO_ID if i is None else i for i in ids], np.int64), has, np.cumsum([0, *sizes]).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values), pa.array([b"".join(parts)], pa.binary())], names)

        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            for t in texts(batch.column("t"), limit=1 << 20):
                ids += doc[t.first : t.first + t.n]
                parts.append(t.data.tobytes())
                sizes += np.diff(t.off).tolist()
                total += len(t.data)
                if total >= BLOCK_BYTES:
                    yield made()
                    ids, parts, sizes, total = [], [], [], 0
        if ids:
            yield made()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    buckets = shuffle_partitions(docs.sparkSession)
    return keep_bucketed(source.mapInArrow(run, "block long, ids binary, has_id binary, off binary, data binary"), "blocks", "block", buckets)


def _slices(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about limit bytes, as ranges of off."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
        yield lo, hi
        lo = hi


def other_sums(data: np.ndarray) -> np.ndarray:
    """Sums for a second hash of runs: each place stands for three bytes, so a run ends two places early."""
    wide = np.zeros(len(data) + 2, dtype=U64)
    wide[: len(data)] = _CODE[data]
    return prefix(mix(wide[:-2] + wide[1:-1] * _LEFT + wide[2:] * _RIGHT))


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor name, run name, second run name, first start, starts) of the runs of starts that share an anchor."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (U64, U64, U64, np.int64, np.int64))
    sums = prefix(BYTE_CODE[data])
    at = np.arange(n - gram + 1)
    g = hash_runs(sums, at, at + gram)
    m = (g & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    width, window = 1, length - gram + 1
    while width * 2 <= window:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < window:
        m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
    own = (m & U64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = text[: n - length + 1] == text[length - 1 :]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (inside[1:] != inside[:-1]) | (text[1 : len(own)] != text[: len(own) - 1])
    edge = np.append(np.flatnonzero(new), len(own))
    first, size = edge[:-1], np.diff(edge)
    ok = inside[first]
    first, size = first[ok], size[ok]
    a = own[first]
    end, place = first + size - 1 + length, (a - first).astype(U64) * _LEFT
    return g[a], mix(hash_runs(sums, first, end) ^ place), mix(hash_runs(other_sums(data), first, end - 2) ^ place), first, size


def _cover(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Places in the width bytes from each start on."""
    edge = np.zeros(size + 1, np.int32)
    edge[starts] = 1
    edge[starts + width] -= 1
    return np.flatnonzero(np.cumsum(edge[:size], dtype=np.int32))


def _heads(keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys, the index of the first that equals it."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys), dtype=np.int32), 0))


def refine(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers of these starts at depth length: equal just where the length bytes from there on are.

    A bucket is a range of the sorted suffixes and its pointer is where it begins. Suffixes are sorted into
    buckets by their first 8 bytes. Then each bucket of several is sorted by the pointers of the suffixes
    `depth` bytes on, which splits it into buckets of twice the depth; these pointers serve the next round.
    starts: distinct, each with length bytes of one text after it.
    """
    depth = min(8, length)
    at = _cover(starts, length - depth + 1, len(data)).astype(np.int32)
    word = np.zeros((len(at), 8), np.uint8)
    word[:, 8 - depth :] = np.lib.stride_tricks.sliding_window_view(data, depth)[at]
    word = word.view(">u8").ravel().astype(U64)
    o = np.argsort(word)
    pointer, n = np.zeros(len(data), np.int32), len(at)
    pointer[at[o]] = _heads(word[o])
    while depth < length:
        step = min(depth, length - depth)
        at = _cover(starts, length - depth - step + 1, len(data)).astype(np.int32)
        own = pointer[at]
        several = np.bincount(own, minlength=n)[own] > 1
        at, own = at[several], own[several]
        both = own.astype(np.int64) * n + pointer[at + step]
        o = np.argsort(both)
        own = own[o]
        pointer[at[o]] = own + _heads(both[o]) - _heads(own)
        depth += step
    return pointer[starts]


def names(data: np.ndarray, off: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two names of 64 bits each of the length bytes from each of the sorted starts on."""
    out = [(np.zeros(0, U64), np.zeros(0, U64))]
    for lo, hi in _slices(off):
        a, b = np.searchsorted(starts, off[[lo, hi]])
        if a < b:
            part, s = data[off[lo] : off[hi]], starts[a:b] - off[lo]
            out.append((mix(hash_runs(prefix(BYTE_CODE[part]), s, s + length)), mix(hash_runs(other_sums(part), s, s + length - 2))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A sort by keys, then by order; and whether each sorted row is the first with its keys."""
    o = np.lexsort([*order[::-1], *keys[::-1]])
    first = np.ones(len(o), dtype=bool)
    if len(o):
        first[1:] = np.logical_or.reduce([k[o][1:] != k[o][:-1] for k in keys])
    return o, first


WHOLE, MIXED, START = 1, 2, 3


def _deal(shards: int, name: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[list[bytes]]]:
    """Columns cut by shard of the name: shard numbers and the cuts of each column."""
    s = (((name >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)
    o = np.argsort(s, kind="stable")
    edge = np.searchsorted(s[o], np.arange(shards + 1))
    some = [k for k in range(shards) if edge[k] < edge[k + 1]]
    return some, [[c[o[edge[k] : edge[k + 1]]].tobytes() for k in some] for c in columns]


def _by_block(block: np.ndarray, kind: np.ndarray, at: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    o = np.lexsort([at, kind, block])
    edge = np.flatnonzero(np.concatenate([[True], (block[o][1:] != block[o][:-1]) | (kind[o][1:] != kind[o][:-1])])) if len(o) else np.zeros(0, np.int64)
    cut = np.append(edge, len(o))
    rows = [(int(block[o[a]]), int(kind[o[a]]), at[o[a:b]].astype(np.uint32).tobytes(), size[o[a:b]].astype(np.uint32).tobytes()) for a, b in zip(cut[:-1], cut[1:])]
    return pd.DataFrame(rows, columns=["block", "kind", "at", "size"])


VERDICT = "block long, kind int, at binary, size binary"


def _runs(made: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """Verdicts on runs: WHOLE ones go, MIXED ones need refinement."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                data, off, ids = np.frombuffer(row["data"], np.uint8), np.frombuffer(row["off"], np.int64), np.frombuffer(row["ids"], np.int64)
                got = []
                for lo, hi in _slices(off):
                    a, name, more, first, size = anchors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length, gram)
                    got.append((a, name, more, first + off[lo], size))
                if not got:
                    continue
                a, name, more, first, size = (np.concatenate(x) for x in zip(*got))
                doc = ids[np.searchsorted(off, first, side="right") - 1]
                o, lead = _first_of([a, name, more], [doc, first])
                later = o[~lead]
                o = o[lead]
                # an anchor has the smallest hash around it, so its own bits would fill a few shards only
                some, cuts = _deal(shards, mix(a[o]), [a[o], name[o], more[o], doc[o], first[o].astype(np.uint32), size[o].astype(np.uint16 if length < 60000 else np.uint32)])
                rows = [some, [row["block"]] * len(some), *cuts]
                if len(later):
                    rows[0].append(shards + row["block"] % shards)
                    rows[1].append(row["block"])
                    for c, x in zip(rows[2:], (b"", b"", b"", b"", first[later].astype(np.uint32).tobytes(), size[later].astype(np.uint16 if length < 60000 else np.uint32).tobytes())):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[2:])], ["shard", "block", "a", "name", "more", "doc", "first", "size"])

    small = np.uint16 if length < 60000 else np.uint32

    def judge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["first"]]).astype(np.int64)
        size = np.concatenate([np.frombuffer(x, small) for x in pdf["size"]]).astype(np.int64)
        block = np.repeat(pdf["block"].to_numpy(), [len(x) // 4 for x in pdf["first"]])
        if key[0] >= shards:
            return _by_block(block, np.full(len(block), WHOLE), first, size)
        a, name, more, doc = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("a", U64), ("name", U64), ("more", U64), ("doc", np.int64)))
        o, lead = _first_of([a, name, more], [doc, block, first])
        bucket = np.cumsum(np.concatenate([[0], a[o][1:] != a[o][:-1]]))
        names = np.bincount(bucket, lead)
        kind = np.where(~lead, WHOLE, np.where(names[bucket] > 1, MIXED, 0))
        some = kind > 0
        o, kind = o[some], kind[some]
        return _by_block(block[o], kind, first[o], size[o])

    dealt = made.select("block", "ids", "off", "data").mapInArrow(deal, "shard int, block long, a binary, name binary, more binary, doc binary, first binary, size binary")
    return keep(dealt.groupBy("shard").applyInPandas(judge, VERDICT), "repeat-runs")


def _told(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("block").agg(F.collect_list(F.struct("kind", "at", "size")).alias("told"))


def _starts(told: list[dict], kind: int) -> np.ndarray:
    at = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x["at"], np.uint32) for x in told if x["kind"] == kind)]).astype(np.int64)
    size = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x["size"], np.uint32) for x in told if x["kind"] == kind)]).astype(np.int64)
    o = np.argsort(at, kind="stable")
    at, size = at[o], size[o]
    return np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(at) else at


def _refined(made: DataFrame, runs: DataFrame, shards: int, length: int) -> DataFrame:
    """Verdicts on the starts of MIXED runs: those that aren't the first of their bucket at depth length go."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                data, off, ids = np.frombuffer(row["data"], np.uint8), np.frombuffer(row["off"], np.int64), np.frombuffer(row["ids"], np.int64)
                starts = _starts(row["told"], MIXED)
                doc = ids[np.searchsorted(off, starts, side="right") - 1]
                o, lead = _first_of([refine(data, starts, length)], [doc, starts])
                # of equal starts in the block, the first stands for all; the rest go whatever others say
                first = np.sort(o[lead])
                name, more = names(data, off, starts[first], length)
                some, cuts = _deal(shards, name, [name, more, doc[first], starts[first].astype(np.uint32)])
                rows = [some, [row["block"]] * len(some), *cuts]
                if not lead.all():
                    rows[0].append(shards + row["block"] % shards)
                    rows[1].append(row["block"])
                    for c, x in zip(rows[2:], (b"", b"", b"", starts[o[~lead]].astype(np.uint32).tobytes())):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[2:])], ["shard", "block", "name", "more", "doc", "at"])

    def judge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["at"]]).astype(np.int64)
        block = np.repeat(pdf["block"].to_numpy(), [len(x) // 4 for x in pdf["at"]])
        if key[0] < shards:
            name, more, doc = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("name", U64), ("more", U64), ("doc", np.int64)))
            o, lead = _first_of([name, more], [doc, block, at])
            at, block = at[o[~lead]], block[o[~lead]]
        return _by_block(block, np.full(len(block), START), at, np.ones(len(block)))

    met = made.select("block", "ids", "off", "data").join(_told(runs.where(F.col("kind") == MIXED)), "block")
    dealt = met.mapInArrow(deal, "shard int, block long, name binary, more binary, doc binary, at binary")
    return keep(dealt.groupBy("shard").applyInPandas(judge, VERDICT), "repeat-starts")


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """OUT of every row: sizes, the removed spans (bytes) and a digest of what is left."""
    spark = docs.sparkSession
    made = blocks(docs, id_col, text_col)
    size = made.agg(F.sum(F.length("data"))).first()[0] or 0
    shards = max(1, int(-(-size // (SHARD * (length - gram) // 2))))
    runs = _runs(made, shards, length, gram)
    mixed = runs.where(F.col("kind") == MIXED).agg(F.sum(F.length("at") / 4)).first()[0] or 0
    starts = _refined(made, runs, max(1, int(-(-mixed * (length - gram) // 2 // SHARD))), length)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                data, off, told = row["data"], np.frombuffer(row["off"], np.int64), row["told"] or []
                ids, has = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["has_id"], bool)
                gone = np.union1d(_starts(told, WHOLE), _starts(told, START))
                text = np.searchsorted(off, gone, side="right") - 1
                # spans: starts at most length apart in one text cover bytes without a gap
                new = np.concatenate([[True], (np.diff(gone) > length) | (text[1:] != text[:-1])]) if len(gone) else np.zeros(0, bool)
                a = gone[new]
                b = gone[np.append(np.flatnonzero(new)[1:] - 1, len(gone) - 1)] + length if len(gone) else gone
                owner = text[new]
                edge = np.searchsorted(owner, np.arange(len(off)))
                out = []
                for k in range(len(ids)):
                    zero, end = int(off[k]), int(off[k + 1])
                    digest, at, spans = hashlib.sha256(), zero, []
                    for x, y in zip(a[edge[k] : edge[k + 1]].tolist(), b[edge[k] : edge[k + 1]].tolist()):
                        digest.update(data[at:x])
                        at = y
                        spans.append({"start": x - zero, "end": y - zero})
                    digest.update(data[at:end])
                    out.append((int(ids[k]) if has[k] else None, end - zero, sum(s["end"] - s["start"] for s in spans), len(spans), digest.hexdigest(), spans))
                for lo in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out[lo : lo + 5000]], f.type) for j, f in enumerate(schema)], schema=schema)

    told = _told(runs.where(F.col("kind") == WHOLE).union(starts))
    return made.join(told, "block", "left").mapInArrow(run, OUT)
