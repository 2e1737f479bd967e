"""Benchmark decontamination: passages of documents within a few word edits of a benchmark item.

Words (as in tokens.py) are the symbols. The random walk of the CGK embedding reads a window from its
first word: at each step it emits the word it stands on, and a random bit of (repetition, step, word)
says whether it moves on. Two windows a few edits apart then emit words that differ at few steps. Each
of REPEATS repetitions samples SAMPLES steps of the walk; windows of documents whose sampled words equal
those of an item's window are candidates. Windows reach from an anchor to the item's end. The more edits a
walk has passed, the less it says, so repetitions sample it up to horizons from HORIZONS on, as long as the window
allows. An item has anchors in proportion to its length, each the rarest word (in the benchmark) of its stretch of the
item's first three quarters, so edited anchors lose nothing. Every word of every document that is some anchor's
word starts a window. Candidates are verified by the exact edit distance of the item to the best run of words
around them, by bit-parallel steps.

With a fifth of the words edited, an anchor and the few words after it that a short horizon samples are left
alone with probability 0.3 or more, so that of six anchors and sixteen repetitions one meets; README has the measured recall.

Items of fewer than min_words words are found where they are all the words of a document. Items without words
aren't searched. Null and empty texts match nothing; items that repeat a text are reported each; rows that repeat
a doc_id are searched each and reported once, rows with a null id under a null id. Extra columns of docs don't matter to
passages() and pass through decontaminate(). Empty tables give no passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, text_of
from .tokens import U64, Texts, Words, mix, texts

#: Repetitions; steps sampled in each; anchors of an item at least, at most, and words that give one more; horizons in steps.
REPEATS, SAMPLES, ANCHORS, HORIZONS = 16, 3, (6, 32, 16), (10, 20, 40, 80)
#: Edits allowed as a share of an item's words; shortest item searched by windows; bytes of items that a task holds at once.
MAX_SHARE, MIN_WORDS, ITEM_BYTES = 0.2, 5, 16 << 20
_CLASSES = np.array([3, 5, 8, 12, 18, 27, 40, 1 << 40])


def _steps(repeat: int, size: int) -> np.ndarray:
    """The sampled steps for windows of at least size words."""
    rng = np.random.default_rng([11, repeat, size])
    top = max(SAMPLES + 1, min(int(1.6 * size), HORIZONS[repeat % len(HORIZONS)]))
    return np.sort(rng.choice(np.arange(1, top), SAMPLES, replace=False))


def walk(words: np.ndarray, start: np.ndarray, end: np.ndarray, repeat: int, steps: np.ndarray) -> dict[int, np.ndarray]:
    """What the walks from start emit at these steps; 0 beyond end."""
    out, at, wanted = {}, start.copy(), set(steps.tolist())
    if not len(start):
        return {s: np.zeros(0, U64) for s in wanted}
    for step in range(int(steps.max()) + 1):
        over = at >= end
        here = words[np.minimum(at, end - 1)]
        if step in wanted:
            out[step] = np.where(over, U64(0), here)
        # one mixed word of the hash gives the bits of 32 steps: its upper half
        if step % 32 == 0:
            salt = U64((repeat * 100_000 + step // 32 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        bit = ((here ^ salt) * U64(0xBF58476D1CE4E5B9)) >> U64(63 - step % 32)
        at += (bit & U64(1)).astype(np.int64)
    return out


class Items:
    """The benchmark's words, and for each repetition and size class the keys of its windows."""

    def __init__(self, ids: list[int], item_texts: list[str], min_words: int = MIN_WORDS, max_share: float = MAX_SHARE):
        self.max_share, self.min_words = max_share, min_words
        words = [w for t in texts(pa.array(item_texts, pa.string()), limit=1 << 40) for w in _split(t)]
        self.short: dict[bytes, list[int]] = {}
        for i, w in zip(ids, words):
            if 0 < len(w) < min_words:
                self.short.setdefault(w.tobytes(), []).append(i)
        some = [(i, w) for i, w in zip(ids, words) if len(w) >= min_words]
        self.ids, self.words = [i for i, _ in some], [w for _, w in some]
        flat = np.concatenate(self.words) if some else np.zeros(0, U64)
        off = np.cumsum([0, *map(len, self.words)])
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        item, at, size = [], [], []
        least, most, per = ANCHORS
        for k, w in enumerate(self.words):
            reach = max(1, len(w) - max(3, len(w) // 4))
            n = min(reach, max(least, min(most, len(w) // per)))
            edge = np.arange(n + 1) * reach // n
            rare = [int(a + np.argmin(count[inverse[off[k] + a : off[k] + b]])) for a, b in zip(edge[:-1], edge[1:])]
            item += [k] * n
            at += rare
            size += [len(w) - a for a in rare]
        self.item, self.at = np.array(item, np.int64), np.array(at, np.int64)
        klass = np.searchsorted(_CLASSES, np.maximum(size, 3), side="right") - 1
        self.classes = []
        for c in np.unique(klass):
            of = np.flatnonzero(klass == c)
            start = off[self.item[of]] + self.at[of]
            tables = []
            for r in range(REPEATS):
                steps = _steps(r, int(_CLASSES[c]))
                keys = _key(flat[start], walk(flat, start, off[self.item[of] + 1], r, steps), steps)
                order = np.argsort(keys, kind="stable")
                tables.append((steps, keys[order], of[order]))
            first = np.unique(flat[start])
            low = np.zeros(1 << 16, dtype=bool)
            low[(first & U64(0xFFFF)).astype(np.int64)] = True
            self.classes.append((first, low, tables))


def _key(first: np.ndarray, emitted: dict[int, np.ndarray], steps: np.ndarray) -> np.ndarray:
    k = mix(first + U64(1))
    for s in steps.tolist():
        k = mix(k * U64(0x9E3779B97F4A7C15) + emitted[s])
    return k


def _split(t: Texts) -> list[np.ndarray]:
    w = Words(t)
    return [w.hash[w.off[i] : w.off[i + 1]] for i in range(t.n)]


def _last_row(item: list[int], run: list[int], free: bool) -> list[int]:
    """Edit distances of item to the runs of words that end at each place: bit-parallel, a word of run a step.

    free: runs may begin anywhere; else they begin at the start of run.
    """
    n = len(item)
    full, top, where = (1 << n) - 1, 1 << (n - 1), {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    up, down, score, out = full, 0, n, [n]
    edge = 0 if free else 1
    for y in run:
        same = where.get(y, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(h | up)), up & h
        score += 1 if more & top else -1 if less & top else 0
        more, less = (more << 1 | edge) & full, less << 1 & full
        up, down = less | (full & ~(v | more)), more & v
        out.append(score)
    return out


def edit_distance(item: list[int], run: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of run nearest to item, if within most; ties to the earliest end, then the longest part."""
    row = _last_row(item, run, True)
    d = min(row)
    if d > most:
        return None
    end = row.index(d)
    back = _last_row(item[::-1], run[:end][::-1], False)
    return d, end - max(j for j, x in enumerate(back) if x == d), end


def candidates(items: Items, w: Words) -> np.ndarray:
    """Rows (text, item, first word of the item there) of the windows that meet an item's in some repetition."""
    h, found = w.hash, []
    bits = (h & U64(0xFFFF)).astype(np.int64)
    for first, low, tables in items.classes:
        near = np.flatnonzero(low[bits])
        near = near[np.isin(h[near], first)]
        if not len(near):
            continue
        text = np.searchsorted(w.off, near, side="right") - 1
        end = w.off[text + 1]
        for r, (steps, keys, of) in enumerate(tables):
            k = _key(h[near], walk(h, near, end, r, steps), steps)
            a, b = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
            hit = np.flatnonzero(a < b)
            n = b[hit] - a[hit]
            j = of[np.repeat(a[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(hit) else np.zeros(0, np.int64)
            found.append(np.stack([np.repeat(text[hit], n), items.item[j], np.repeat(near[hit], n) - items.at[j]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def search(items: Items, t: Texts) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item id, distance, start, end in bytes) of every verified passage, one a text and item."""
    w = Words(t)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    covered: dict[tuple[int, int], int] = {}
    for text, item, at in candidates(items, w).tolist():
        words = items.words[item]
        most = int(items.max_share * len(words))
        lo, hi = max(int(w.off[text]), at - most - 1), min(int(w.off[text + 1]), at + len(words) + most + 1)
        if (text, item) in best and best[text, item][0] == 0:
            continue
        if at >= w.off[text] and at + len(words) <= w.off[text + 1] and np.array_equal(w.hash[at : at + len(words)], words):
            hit = (0, at, at + len(words))
        elif covered.get((text, item), -1) >= at:
            # candidates come in order of place; a stretch that the last one covered has been judged
            continue
        else:
            # one distance for this candidate and those within a few words of it
            hi = min(int(w.off[text + 1]), hi + most)
            covered[text, item] = at + most
            run = w.hash[lo:hi]
            # words of the item that the run lacks are edits each
            hit = None
            if len(words) - int(np.isin(words, run).sum()) <= most:
                hit = edit_distance(words.tolist(), run.tolist(), most)
            hit = hit and (hit[0], lo + hit[1], lo + hit[2])
        if hit and hit[1] < hit[2] and hit < best.get((text, item), (1 << 60,)):
            best[text, item] = hit
    for (text, item), (d, a, b) in best.items():
        zero = int(t.off[text])
        yield text, items.ids[item], d, int(w.start[a]) - zero, int(w.end[b - 1]) - zero
    if items.short:
        for text in np.flatnonzero((w.count > 0) & (w.count < items.min_words)).tolist():
            a, b = int(w.off[text]), int(w.off[text + 1])
            for i in items.short.get(w.hash[a:b].tobytes(), ()):
                yield text, i, 0, int(w.start[a] - t.off[text]), int(w.end[b - 1] - t.off[text])


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_share: float = MAX_SHARE, min_words: int = MIN_WORDS, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start_char, end_char: each document's best passage for each item.

    The benchmark is read in blocks of about block_bytes bytes of text, of which one is held at once; each block
    takes a pass over the documents.
    """
    bench = benchmark.select(F.col(item_id).cast("long").alias("item_id"), text_of(item_text).alias("t"))
    blocks = max(1, -(-(bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64())])
    out = None
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).collect()
        items = Items([r["item_id"] for r in rows], [r["t"] for r in rows], min_words, max_share)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for t in texts(batch.column("t")) if items.ids or items.short else ():
                    for text, item, d, a, z in search(items, t):
                        chars = len(t.bytes_of(text)[:a].decode("utf-8", "replace"))
                        more = len(t.bytes_of(text)[a:z].decode("utf-8", "replace"))
                        rows.append((ids[t.first + text].as_py(), item, d, chars, chars + more))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        some = source.mapInArrow(run, "doc_id long, item_id long, distance int, start_char long, end_char long")
        out = some if out is None else out.union(some)
    best = F.min(F.struct("distance", "start_char", "end_char")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.distance", "b.start_char", "b.end_char")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without a passage of the benchmark; rows with a null id stay."""
    leaked = free_name(docs, "__leaked")
    found = passages(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col(leaked), "left_anti")
