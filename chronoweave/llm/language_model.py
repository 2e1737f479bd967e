"""Language-model scoring with a weighted backoff automaton over words.

Tokens are words as in tokens.py and one end after each text. The model is a smoothed trigram model:

    P(w)      = (c(w) + 1) / (N + V + 1)
    P(w | v)  = max(c(v w) - D, 0) / c(v) + L(v) P(w)         L(v)   = D n(v) / c(v), n: distinct words after v
    P(w | uv) = c(u v w) / (c(u v) + M) + L(u v) P(w | v)     L(u v) = M / (c(u v) + M)

that is, add-one words, absolute discounting of bigrams and a Dirichlet prior of weight M on the words after a
pair; each sums to one. Every bigram of the training texts is kept, and every trigram whose first two words occur LEAST
times or more. As an automaton: a state for every such pair, one for every word, and a root. From a state,
an arc for a kept n-gram emits the word with its probability above; without such an arc the state's failure arc
leads to the state of its last word, or to the root, at weight L. A text starts in the state of the end and is
read once from left to right; the state and the sum of log probabilities are carried. After each token the
state is the longest kept suffix of what was read, so the states of a whole block are found in one step.

The corpus becomes blocks of some hundred thousand tokens: per text the ranks of its words in the block's
own vocabulary. N-grams are dealt to shards by hash, where the training counts of each are summed and sent
back to the blocks that asked, so no task holds the corpus vocabulary or the whole automaton: words and bigrams
first, then trigrams and the distinct words after each word, which the one block that owns a bigram counts.

Null texts count as empty: one end. Rows with a null id are not held out. Repeated rows count as often
as they come. If nothing can be learned, every token has probability 1. Extra columns don't matter; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucket_ids, discard, keep, keep_bucketed, shuffle_partitions, text_of
from .tokens import U64, Words, mix, texts

#: Tokens in a block; discount of bigrams; weight of the prior of trigrams; occurrences from which a pair is a state; n-grams in a shard, counted in every block that has them.
BLOCK, DISCOUNT, PRIOR, LEAST, SHARD = 300_000, 0.5, 4.0, 2, 500_000
END = U64(0x454E44)
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def joined_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of the n-gram of a context's key and a word."""
    return mix(h * _LEFT + w * _RIGHT + U64(1))


BLOCK_SCHEMA = "block long, doc_ids binary, no_id binary, held binary, offsets binary, low binary, high binary, vocab binary, n_train long, n_tokens long"


def blocks(docs: DataFrame, id_col: str, text_col: str, held: str, block_tokens: int, shelf: list[str]) -> DataFrame:
    """Rows of BLOCK_SCHEMA: the texts as ranks in the block's vocabulary."""
    names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]

    def made(block: int, ids: list, flags: list, hashes: list) -> pa.RecordBatch:
        size = np.array([len(h) for h in hashes], dtype=np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        vocab, inverse, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        rank = np.empty(len(vocab), dtype=np.int64)
        order = np.argsort(-count, kind="stable")
        rank[order] = np.arange(len(vocab))
        stream, vocab = rank[inverse], vocab[order]
        n_train = int(size[~np.array(flags, dtype=bool)].sum())
        idn = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        values = [idn, np.array([i is None for i in ids]), np.array(flags, dtype=bool), off, (stream & 0xFFFF).astype(np.uint16), (stream >> 16).astype(np.uint16), vocab, n_train, len(stream)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], pa.int64()) for v in values)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = bucket_ids(TaskContext.get().partitionId(), buckets)
        ids, flags, hashes, total = [], [], [], 0
        for batch in batches:
            doc, held_out = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            for t in texts(batch.column("t")):
                w = Words(t)
                for i in range(t.n):
                    ids.append(doc[t.first + i])
                    flags.append(held_out[t.first + i])
                    hashes.append(np.append(w.hash[w.off[i] : w.off[i + 1]], END))
                    total += len(hashes[-1])
                    if total >= block_tokens:
                        yield made(next(numbers), ids, flags, hashes)
                        ids, flags, hashes, total = [], [], [], 0
        if ids:
            yield made(next(numbers), ids, flags, hashes)

    buckets = shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), text_of(text_col).alias("t"))
    return keep_bucketed(source.mapInArrow(run, BLOCK_SCHEMA), "lm_blocks", "block", buckets, shelf)


def _bigrams(off: np.ndarray, stream: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Of every token, the rank of the word before it and its own, in one number; a text's first word follows the end."""
    before = np.concatenate([[0], stream[:-1]])
    before[off[:-1]] = np.flatnonzero(vocab == END)[0]
    return before.astype(U64) << U64(32) | stream.astype(U64)


def _sides(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, without the upper ones that are empty; the first byte counts them."""
    planes = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([k]) + np.ascontiguousarray(planes[:k]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    k = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(k, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :k] = planes.T
    return out.view("<u8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, whose upper planes are empty."""
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=U64)


class Block:
    """A block's tokens as n-grams: words are ranks in vocab, bigrams places in pair, trigrams places in triple.

    stream and of_pair give each token's word and bigram; c and n, once they are told, the training counts
    of words and bigrams in the whole corpus.
    """

    def __init__(self, row: dict):
        get = lambda c, t: np.frombuffer(row[c], dtype=t)
        self.off, self.vocab, self.held = get("offsets", np.int64), get("vocab", U64), get("held", bool)
        self.stream = get("low", np.uint16).astype(np.int64) | get("high", np.uint16).astype(np.int64) << 16
        self.pair, self.of_pair = np.unique(_bigrams(self.off, self.stream, self.vocab), return_inverse=True)
        self.left, self.right = _sides(self.pair)
        self.train = np.repeat(~self.held, np.diff(self.off))
        self.pair_keys = joined_key(self.vocab[self.left], self.vocab[self.right])
        self.word_order, self.pair_order = np.argsort(self.vocab), np.argsort(self.pair_keys)

    def find_triples(self) -> None:
        """Trigrams whose first two words are a state; tokens where one ends, and which."""
        inner = np.ones(len(self.stream), dtype=bool)
        inner[self.off[:-1]] = False
        at = np.flatnonzero(inner)
        context = self.of_pair[at - 1]
        some = self.n[context] >= LEAST
        self.at = at[some]
        self.triple, self.of_triple = np.unique(context[some].astype(U64) << U64(32) | self.stream[self.at].astype(U64), return_inverse=True)
        self.context, last = _sides(self.triple)
        self.triple_keys = joined_key(self.pair_keys[self.context], self.vocab[last])
        self.triple_order = np.argsort(self.triple_keys)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Words that occur more than once, and their order by key; after any other word there is one word."""
        often = self.c > 1
        return np.flatnonzero(often), (np.cumsum(often) - 1)[self.word_order[often[self.word_order]]]


def score_tokens(b: Block, triple_count: np.ndarray, arcs: np.ndarray, n_train: int, n_vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of P(w) and of the automaton's probability of every token; arcs: n of every word."""
    c = b.c.astype(float)
    root = ((c + 1) / (n_train + n_vocab + 1))[b.stream]
    fail = np.where(c > 0, DISCOUNT * arcs / np.maximum(c, 1), 1.0)
    arc = np.where(b.n > 0, b.n - DISCOUNT, 0) / np.maximum(c[b.left], 1)
    p = arc[b.of_pair] + fail[b.left][b.of_pair] * root
    # from the states of two words
    n = b.n[b.context].astype(float)
    arc, fail = triple_count / (n + PRIOR), PRIOR / (n + PRIOR)
    p[b.at] = arc[b.of_triple] + fail[b.of_triple] * p[b.at]
    return np.log10(root), np.log10(p)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
PIECE = "family int, shard int, block long, v binary, c binary"
ANSWER = "family int, shard int, block long, c binary, d binary"


def _cut(block: int, families: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of PIECE: for each (family, shards, keys, order, c) the keys in order, cut by shard."""
    rows: list[list] = [[], [], [], [], []]
    for family, shards, keys, o, c in families:
        keys, c = keys[o], c[o]
        edge = np.searchsorted(((keys >> U64(32)) * U64(shards)) >> U64(32), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            part = slice(edge[s], edge[s + 1])
            for column, value in zip(rows, (family, s, block, _pack_keys(keys[part]), _pack(c[part]))):
                column.append(value)
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], [f.split()[0] for f in PIECE.split(", ")])


def _told(pieces: list[dict] | None, family: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two columns of a family's answers, which come in this order of the keys."""
    mine = sorted((x for x in pieces or [] if x["family"] == family), key=lambda x: x["shard"])
    both = []
    for column in ("c", "d"):
        x = np.zeros(len(order), np.int64)
        if len(order) and mine[0][column]:
            x[order] = np.concatenate([_unpack(y[column]) for y in mine])
        both.append(x)
    return both[0], both[1]


#: What is asked of the shards: counts of words, of bigrams and of trigrams, distinct words after a word.
WORDS, PAIRS, TRIPLES, AFTER = 0, 1, 2, 3


def _sum(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over the blocks of a shard; d: for words and bigrams, which block owns one that was counted."""
    pdf = pdf.sort_values("block")
    v = [_unpack_keys(x) for x in pdf["v"]]
    at = np.cumsum([len(x) for x in v])[:-1]
    _, first, inverse = np.unique(np.concatenate(v), return_index=True, return_inverse=True)
    c = np.bincount(inverse, np.concatenate([_unpack(x) for x in pdf["c"]])).astype(np.int64)
    own = [b""] * len(pdf)
    if key[0] in (WORDS, PAIRS):
        d = np.zeros(len(inverse), np.int64)
        d[first[c > 0]] = 1
        own = [_pack(x) for x in np.split(d, at)]
    return pd.DataFrame({"family": key[0], "shard": key[1], "block": pdf["block"].to_numpy(), "c": [_pack(x) for x in np.split(c[inverse], at)], "d": own})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: str = "held_out", block_tokens: int = BLOCK, shard_words: int = SHARD) -> DataFrame:
    """OUT for every row; docs has a boolean column `held` of the rows that aren't learned from."""
    spark, shelf = docs.sparkSession, []
    made = blocks(docs, id_col, text_col, held, block_tokens, shelf)
    size = made.agg(F.sum("n_train").alias("n"), F.sum(F.length("vocab") / 8).alias("words"), F.sum("n_tokens").alias("pairs")).first()
    if size["words"] is None:
        return spark.createDataFrame([], OUT)
    n_train = int(size["n"])
    w_shards, p_shards = (max(1, int(-(-size[k] // shard_words))) for k in ("words", "pairs"))
    body = made.select("block", "held", "offsets", "low", "high", "vocab")

    def ask(source: DataFrame, families: Callable[[dict], list], tag: str) -> DataFrame:
        """Deal what families() gives for each block to shards and keep the sums that come back, a list a block."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield _cut(row["block"], families(row))

        return keep(source.mapInArrow(deal, PIECE).groupBy("family", "shard").applyInPandas(_sum, ANSWER), tag, "zstd", shelf)

    def by_block(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("block").agg(F.collect_list(F.struct("family", "shard", "c", "d")).alias(name))

    def counts(row: dict) -> Block:
        b = Block(row)
        b.c, _ = _told(row["one"], WORDS, b.word_order)
        b.n, own = _told(row["one"], PAIRS, b.pair_order)
        b.own = own > 0
        b.find_triples()
        return b

    def first(row: dict) -> list:
        b = Block(row)
        c, n = (np.bincount(x[b.train], minlength=len(y)) for x, y in ((b.stream, b.vocab), (b.of_pair, b.pair)))
        return [(WORDS, w_shards, b.vocab, b.word_order, c), (PAIRS, p_shards, b.pair_keys, b.pair_order, n)]

    def second(row: dict) -> list:
        b = counts(row)
        some, order = b.repeated()
        after = np.bincount(b.left[b.own], minlength=len(b.vocab))[some]
        return [(TRIPLES, p_shards, b.triple_keys, b.triple_order, np.bincount(b.of_triple[b.train[b.at]], minlength=len(b.triple))), (AFTER, w_shards, b.vocab[some], order, after)]

    one = ask(body, first, "lm-counts")
    n_vocab = int(one.where(F.col("family") == WORDS).select(_ones("d").alias("n")).agg(F.sum("n")).first()[0] or 0)
    with_one = made.join(by_block(one, "one"), "block")
    two = ask(with_one.select(*body.columns, "one"), second, "lm-arcs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = counts(row)
                some, order = b.repeated()
                arcs = np.ones(len(b.vocab), np.int64)
                arcs[some], _ = _told(row["two"], AFTER, order)
                root, logp = score_tokens(b, _told(row["two"], TRIPLES, b.triple_order)[0], arcs, n_train, n_vocab)
                start, known = b.off[:-1], (b.c[b.stream] > 0).astype(np.int64)
                ids = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["no_id"], bool))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(b.held), pa.array(np.diff(b.off)), pa.array(np.add.reduceat(known, start)), pa.array(np.full(len(ids), n_train)), pa.array(np.add.reduceat(root, start)), pa.array(np.add.reduceat(logp, start)),
                ], [f.split()[0] for f in OUT.split(", ")])

    whole = with_one.select(*body.columns, "doc_ids", "no_id", "one").join(by_block(two, "two"), "block", "left")
    out = keep(whole.mapInArrow(finish, OUT), "lm-scores")
    discard(spark, shelf)
    return out


def _ones(column: str):
    """How many ones a packed column of zeros and ones holds."""
    return F.length(F.regexp_replace(F.hex(F.substring(column, 2, 1 << 30)), "0", "")).cast("long")
