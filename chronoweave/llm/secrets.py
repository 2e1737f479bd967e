"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for the three base kinds and for long mixed tokens that no base kind covers.
The values' hashes are counted over the whole corpus by distinct repositories and owners: a value that
many owners or many repositories have is a copied example, one that stays with few of both looks like a live
credential. Mixed tokens become spans of kind `owned` only if they look live; base spans always stay.

A document is a repository, its owner_col the owner. Null texts count as empty, a null owner as an owner of its
own, rows with a null id are kept and are one repository. Each row is scanned on its own, so repeated rows give repeated
results, but one repository in the counts. Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, text_of
from .tokens import runs, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS_OF_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
ORDER = {"assign": 0, "access": 1, "hex": 2, "owned": 3}
#: A mixed token: this long, with this many digits and letters.
TOKEN, DIGITS, LETTERS = 24, 4, 4


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


IS_HEX = _mask(b"0123456789abcdef")
IS_DIGIT = _mask(b"0123456789")
IS_LETTER = _mask(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
IS_TOKEN = IS_DIGIT | IS_LETTER | _mask(b"+/_-")


def _long_runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = runs(mask, off)
    long = b - a >= least
    return a[long], b[long]


def _value(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def scan_texts(column: pa.Array) -> Iterator[dict[int, list[tuple[int, int, str, int]]]]:
    """For the rows of the column that have candidates: {row: [(start, end, kind, value hash)]}, in code points."""
    for t in texts(column):
        data, off = t.data, t.off
        found: dict[int, list] = {}
        blob = data.tobytes()
        low = blob.lower()
        rows = set()
        for word in WORDS_OF_ASSIGN:
            at = low.find(word)
            while at >= 0:
                row = int(np.searchsorted(off, at, side="right")) - 1
                rows.add(row)
                at = low.find(word, int(off[row + 1]))
        at = blob.find(b"AKIA")
        access = set()
        while at >= 0:
            row = int(np.searchsorted(off, at, side="right")) - 1
            access.add(row)
            at = blob.find(b"AKIA", int(off[row + 1]))
        for row in rows | access:
            text = t.bytes_of(row).decode("utf-8", "replace")
            some = found.setdefault(row, [])
            if row in rows:
                some += [(m.start(), m.end(), "assign", _value(m[2].encode())) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
            if row in access:
                some += [(m.start(), m.end(), "access", _value(m[0].encode())) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        a, b = _long_runs(IS_HEX[data], off, LEAST["hex"])
        c, d = _long_runs(IS_TOKEN[data], off, TOKEN)
        digits, letters = (np.concatenate([[0], np.cumsum(x[data], dtype=np.int64)]) for x in (IS_DIGIT, IS_LETTER))
        mixed = (digits[d] - digits[c] >= DIGITS) & (letters[d] - letters[c] >= LETTERS)
        c, d = c[mixed], d[mixed]
        if len(a) or len(c):
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
            for kind, starts, ends in (("hex", a, b), ("owned", c, d)):
                for i, j, row in zip(starts.tolist(), ends.tolist(), (np.searchsorted(off, starts, side="right") - 1).tolist()):
                    zero = chars[off[row]]
                    found.setdefault(row, []).append((int(chars[i] - zero), int(chars[j] - zero), kind, _value(blob[i:j])))
        out = {}
        for row, some in found.items():
            base = [x for x in some if x[2] != "owned"]
            more = [x for x in some if x[2] == "owned" and not any(y[0] < x[1] and x[0] < y[1] for y in base)]
            out[t.first + row] = sorted(base + more, key=lambda x: (x[0], ORDER[x[2]]))
        yield out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """row_id, doc_id, owner and found array<struct<start, end, kind, value>> of every row."""
    span = "array<struct<start:int,end:int,kind:string,value:bigint>>"
    item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {}
            for some in scan_texts(batch.column("t")):
                found |= some
            lists = [[{"start": a, "end": b, "kind": k, "value": v} for a, b, k, v in found.get(i, ())] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("owner"), pa.array(lists, item)], ["doc_id", "owner", "found"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), text_of(text_col).alias("t"))
    return source.mapInArrow(run, f"doc_id long, owner string, found {span}")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners: over how many distinct documents and owners each value goes.

    Repeats go before anything is counted, so a value of very many rows is gathered nowhere. It is kept, so that the
    join with the rows can be split where a value has very many.
    """
    each = found.select("doc_id", F.coalesce("owner", F.lit("")).alias("owner"), F.explode("found.value").alias("value"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("owners"))
    by_repo = each.groupBy("value", "doc_id").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("repositories"))
    return keep(by_owner.join(by_repo, "value"), "secret-owners")


SPAN = "struct<start:int,end:int,kind:string,live:boolean,owners:bigint,repositories:bigint>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = 3, example_repositories: int = 10) -> DataFrame:
    """doc_id and spans array<SPAN> of every row, in order of start, then kind.

    live: fewer than example_owners owners and fewer than example_repositories repositories have the value. `owned`
    spans are live ones only.
    """
    found = keep(candidates(docs, id_col, text_col, owner_col).withColumn("row_id", F.monotonically_increasing_id()), "secrets")
    some = found.where(F.size("found") > 0)
    each = some.select("row_id", F.explode("found").alias("f"))
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv)), F.col("f.kind")).alias("rank")
    judged = (
        each.join(ownership(some).withColumn("live", live), each["f.value"] == F.col("value")).where((F.col("f.kind") != "owned") | F.col("live"))
        .groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.col("f.start").alias("start"), rank, F.col("f.end").alias("end"), F.col("f.kind").alias("kind"), "live", "owners", "repositories"))).alias("s"))
    )
    spans = F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "kind", "live", "owners", "repositories"))))
    return found.drop("found", "owner").join(judged, "row_id", "left").select("doc_id", F.coalesce(spans, F.array().cast(f"array<{SPAN}>")).alias("spans"))
