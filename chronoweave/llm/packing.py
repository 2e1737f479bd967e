"""Packing of tokenised documents into fixed windows by lexical retrieval.

A document's ids are cut into whole windows and a tail. Tails are dealt to shards of bounded size by their
strongest BM25 term, so that tails about one thing meet at any size of the corpus; a term of too many
tails is split by hash. Each shard has a BM25 inverted index over its tails (terms are token ids, document
frequencies come from the whole corpus). The longest unused tail is a seed: the index, asked with all its terms,
returns its unused neighbours, best first, which fill the seed's window, the last one cut to fit; its rest stays in
the pool. Where no neighbour is left the longest unused tails fill the window. Only the last window of a shard can
stay short.

Null texts count as empty, so every row has at least the end id; rows with null or repeated ids are
packed as documents of their own. Names of special tokens in a text are these tokens, as the tokenizer says. Extra
columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, keep, text_of

WINDOW, END_ID = 1024, 0
#: Tokens of tails in a shard; BM25's k1 and b.
SHARD_TOKENS, K1, B = 1_000_000, 1.2, 0.75


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken, which gives the same ids in a fifth of the time."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, special = file["model"]["vocab"], {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in vocab.items() if token not in special and all(c in to_byte for c in token)}
    if max(*vocab.values(), *special.values(), END_ID) >= 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shelf: list[str] | None = None) -> DataFrame:
    """Per document doc_id, n (ids), full (checksums of its whole windows), tail (the rest, 16-bit ids).

    A task adds one row with df: over how many of its documents each id goes.
    """
    path = path or vocabulary_path()
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("full", pa.list_(pa.int64())), ("tail", pa.binary()), ("df", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        df = np.zeros(enc.n_vocab + 1, dtype=np.int64)
        for batch in batches:
            column = batch.column("t")
            for lo in range(0, batch.num_rows, 512):
                n, full, tails = [], [], []
                for text in column.slice(lo, 512).to_pylist():
                    ids = np.append(enc.encode_to_numpy(text, allowed_special="all"), END_ID).astype(np.uint16)
                    df[np.unique(ids)] += 1
                    cut = len(ids) // WINDOW * WINDOW
                    n.append(len(ids))
                    full.append([_crc(ids[i : i + WINDOW]) for i in range(0, cut, WINDOW)])
                    tails.append(ids[cut:].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 512), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.nulls(len(n), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([df.tobytes()])], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return keep(source.mapInArrow(run, "doc_id long, n long, full array<long>, tail binary, df binary"), "tokens", shelf=shelf)


def _sum_df(tokens: DataFrame) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("df").to_pylist():
                x = np.frombuffer(x, np.int64)
                total = x + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["df"])

    parts = tokens.where("df is not null").select("df").coalesce(16).mapInArrow(add, "df binary").collect()
    return sum(np.frombuffer(r["df"], np.int64) for r in parts)


def strength(tf: np.ndarray, idf: np.ndarray, length: np.ndarray | int, mean_length: float) -> np.ndarray:
    """BM25's weight of terms that occur tf times in texts of these lengths."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


class Index:
    """BM25 over some bags of token ids."""

    def __init__(self, bags: list[np.ndarray], idf: np.ndarray, mean_length: float):
        size = np.array([len(b) for b in bags], dtype=np.int64)
        owner = np.repeat(np.arange(len(bags), dtype=np.int64), size)
        key, tf = np.unique((owner << 16) | np.concatenate(bags).astype(np.int64), return_counts=True)
        doc, self.term = key >> 16, key & 0xFFFF
        weight = strength(tf, idf[self.term], size[doc], mean_length).astype(np.float32)
        self.n, self.first = len(bags), np.searchsorted(doc, np.arange(len(bags) + 1))
        order = np.argsort(self.term, kind="stable")
        self.doc, self.by_term = doc[order], weight[order].astype(np.float64)
        self.at = np.searchsorted(self.term[order], np.arange(len(idf) + 1)).tolist()

    def scores(self, i: int) -> np.ndarray:
        """Of every bag against the terms of bag i."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.term[self.first[i] : self.first[i + 1]].tolist()]
        return np.bincount(np.concatenate([self.doc[x] for x in spans]), np.concatenate([self.by_term[x] for x in spans]), minlength=self.n)


def best_first(s: np.ndarray) -> Iterator[int]:
    """Places of the positive scores, highest first, ties by place; the best few are sorted before the rest."""
    near = np.flatnonzero(s > 0)
    if len(near) > 256:
        least = np.partition(s[near], -64)[-64]
        top = near[s[near] >= least]
        yield from top[np.argsort(-s[top], kind="stable")].tolist()
        near = near[s[near] < least]
    yield from near[np.argsort(-s[near], kind="stable")].tolist()


def fill(tails: list[np.ndarray], idf: np.ndarray, mean_length: float) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, start in it, length)."""
    if not tails:
        return
    index = Index(tails, idf, mean_length)
    start = np.zeros(len(tails), dtype=np.int64)
    left = np.array([len(t) for t in tails], dtype=np.int64)
    order = np.argsort(-left, kind="stable")
    at = 0
    while at < len(order):
        seed = order[at]
        if not left[seed]:
            at += 1
            continue
        window, room = [], WINDOW

        def take(j):
            nonlocal room
            k = int(min(room, left[j]))
            window.append((int(j), int(start[j]), k))
            start[j] += k
            left[j] -= k
            room -= k

        take(seed)
        if room:
            s = index.scores(seed)
            s[left == 0] = 0
            for j in best_first(s):
                take(j)
                if not room:
                    break
            while room and at + 1 < len(order):
                at += 1
                if left[order[at]]:
                    take(order[at])
        yield window


def _strongest(rows: DataFrame, idf: np.ndarray, mean_length: float) -> DataFrame:
    """rows with term: the id of the tail's strongest term, -1 for an empty tail."""
    names = ["doc_id", "n", "full", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for tail in batch.column("tail").to_pylist():
                ids, tf = np.unique(np.frombuffer(tail, np.uint16), return_counts=True)
                terms.append(int(ids[np.argmax(strength(tf, idf[ids], len(tail) // 2, mean_length))]) if len(ids) else -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(terms, pa.int32())], [*names, "term"])

    return rows.select(*names).mapInArrow(run, "doc_id long, n long, full array<long>, tail binary, term int")


def _shards(sizes: dict[int, float], limit: int) -> dict[int, tuple[int, int]]:
    """term -> (first shard, number of shards): small terms share one up to the limit, large ones have several."""
    out, shard, room = {}, -1, 0.0
    for term, size in sorted(sizes.items()):
        if size > limit:
            k = int(-(-size // limit))
            out[term] = (shard + 1, k)
            shard, room = shard + k, 0.0
            continue
        if size > room:
            shard, room = shard + 1, float(limit)
        out[term] = (shard, 1)
        room -= size
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark, shelf = docs.sparkSession, []
    tokens = tokenise(docs, id_col, text_col, path, shelf)
    rows = tokens.where("df is null").drop("df")
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    total = rows.agg(F.count("*").alias("n"), F.sum(F.length("tail") / 2).alias("ids")).first()
    if not total["n"]:
        return spark.createDataFrame([], out)
    df = _sum_df(tokens)
    idf = np.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
    mean_length = max(1.0, total["ids"] / total["n"])
    keyed = keep(_strongest(rows, idf, mean_length), "packing-terms")
    discard(spark, shelf)
    # one row a term, so never more than the vocabulary; a short tail costs a shard more than its ids
    sizes = {r["term"]: float(r["size"]) for r in keyed.groupBy("term").agg(F.sum(F.greatest(F.length("tail") / 2, F.lit(32.0))).alias("size")).collect()}
    of = spark.createDataFrame([(t, a, k) for t, (a, k) in _shards(sizes, shard_tokens).items()], "term int, first int, k int")
    dealt = keyed.join(F.broadcast(of), "term").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("doc_id", F.crc32("tail")), F.col("k")).cast("int")).drop("term", "first", "k")

    def one_shard(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"], kind="stable")
        doc, n, full = pdf["doc_id"].to_numpy(), pdf["n"].to_numpy(), list(pdf["full"])
        tails = [np.frombuffer(t, np.uint16) for t in pdf["tail"]]
        pieces, sequence = [], int(key[0]) << 32
        for d, m, crcs in zip(doc, n, full):
            for i, crc in enumerate(crcs):
                pieces.append((d, i * WINDOW, WINDOW, crc, m, sequence, 0))
                sequence += 1
        has = [i for i, t in enumerate(tails) if len(t)]
        for window in fill([tails[i] for i in has], idf, mean_length):
            offset = 0
            for j, a, k in window:
                i = has[j]
                pieces.append((doc[i], n[i] // WINDOW * WINDOW + a, k, _crc(tails[i][a : a + k]), n[i], sequence, offset))
                offset += k
            sequence += 1
        return pd.DataFrame(pieces, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return dealt.groupBy("shard").applyInPandas(one_shard, out)
