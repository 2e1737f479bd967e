"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams (letters only, A-Z lower-cased, other ASCII as one
separator), scaled to unit length. Each language has several centroids from spherical k-means; the best
cosine names the language, and a text that is too far from every centroid for its length is rejected. How far
that is, is learned from stretches of the sample's texts, as short texts lie further off than long ones.

The classifier is fitted on a bounded sample: the sample_per_lang distinct labelled rows of each language with
the smallest hash of id and text. Null or letterless texts are `und` with score 0 and rejected; so is
every text if nothing could be learned. Rows with null or repeated ids each get a row of their own. Extra columns
pass through; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name
from .tokens import U64, texts

#: Vector length; n-gram lengths; labelled rows of a language that are learned from; centroids of a language.
DIM, GRAMS, SAMPLE, CENTROIDS = 4096, (2, 3), 400, 4
#: Languages at most: their counts and centroids go to the driver.
MOST_LANGS = 1000
#: A text is rejected below this share of the cosine that all but this part of stretches of its length reach; the
#: classes of length by their first bytes, with the length of their stretches; shorter texts are too far only
#: without any n-gram in common.
REJECT, QUANTILE = 0.75, 0.01
LENGTHS, STRETCHES = np.array([18, 35, 70, 140, 280, 560]), (25, 50, 100, 200, 400, 1000)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, counts of each row's n-grams, whether it has a letter, its bytes), for runs of rows."""
    for t in texts(column, limit=1 << 20, rows=256):
        b = FOLD[t.data]
        row = np.repeat(np.arange(t.n), np.diff(t.off))
        out = np.zeros((t.n, DIM), dtype=np.float32)
        x = b.astype(U64)
        for k in GRAMS:
            if len(b) < k:
                continue
            g = np.zeros(len(b) - k + 1, dtype=U64)
            for j in range(k):
                g = (g << U64(8)) | x[j : len(b) - k + 1 + j]
            at = ((g + U64(k << 32)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - DIM.bit_length() + 1)
            ok = (row[: len(g)] == row[k - 1 :]) & (g & U64(0xFFFF) != U64(0x2020))
            out += np.bincount(row[: len(g)][ok] * DIM + at[ok].astype(np.int64), minlength=t.n * DIM).reshape(t.n, DIM)
        plain = np.bincount(row[(b != 32) & (b < 128)], minlength=t.n) > 0
        for i in np.flatnonzero(~plain & (np.bincount(row[b >= 128], minlength=t.n) > 0)):
            plain[i] = any(map(str.isalpha, t.bytes_of(i).decode("utf-8", "replace")))
        yield t.first, out, plain, np.diff(t.off)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


@dataclass
class Model:
    """A language and a row of limits, by class of length, for each centroid."""

    langs: list[str]
    centroids: np.ndarray
    limit: np.ndarray
    idf: np.ndarray


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; seeds are drawn with chances by their distance from those before."""
    rng, chosen = np.random.default_rng(5), [0]
    while len(chosen) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[chosen].T).max(axis=1), 0)
        if far.sum() < 1e-6:
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[chosen]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """lang, t of the per_lang distinct rows of each language with the smallest keys.

    Counts of the languages give a bound of the keys under which there are about three times as many, so few rows
    travel and no language's rows go to one task.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    share = [(r["lang"], int(min(1.0, 3.0 * per_lang / r["n"]) * (1 << 62))) for r in counts]
    bound = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, bound long"))
    some = named.join(bound, "lang").where(F.shiftrightunsigned("key", 2) <= F.col("bound"))
    some = some.where(F.col("t").rlike("\\p{L}")).groupBy("lang", "key").agg(F.min("t").alias("t"))
    return some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("n") <= per_lang).select("lang", "t")


def thin(counts: np.ndarray) -> bytes:
    """The places and values of a row's counts that aren't 0: a stretch has a few hundred at most, of DIM."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.float32).tobytes()


def dense(row: bytes) -> np.ndarray:
    """The counts that thin() was given."""
    n, out = len(row) // 6, np.zeros(DIM, np.float32)
    out[np.frombuffer(row, np.uint16, n)] = np.frombuffer(row[2 * n :], np.float32)
    return out


def _stretches(text: str) -> list[tuple[int, str]]:
    """(class of length, a stretch of that length) of a text, from a place that depends on the text alone."""
    data, out = text.encode(), [(-1, text)]
    for k, n in enumerate(STRETCHES):
        if len(data) >= n:
            at = zlib.crc32(data) % (len(data) - n + 1)
            out.append((k, data[at : at + n].decode("utf-8", "ignore")))
    return out


def counted(some: DataFrame) -> DataFrame:
    """lang, class of length, thin counts of each text of a sample and of its stretches."""
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
                cut = _stretches(text)
                rows = [thin(r) for _, x, *_ in features(pa.array([t for _, t in cut])) for r in x]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(rows), "k": [k for k, _ in cut], "x": rows}, schema=schema)

    return some.mapInArrow(run, "lang string, k int, x binary")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from the labelled rows of docs; the caller leaves held-out rows away."""
    counts = counted(sample(docs, id_col, text_col, lang_col, sample_per_lang)).persist()
    counts.count()  # else the tasks that read them first would run two Python workers each

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM), 0
        for batch in batches:
            for x in batch.column("x").to_pylist():
                total += dense(x) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"df": [total.tobytes()], "n": [n]}, schema=pa.schema([("df", pa.binary()), ("n", pa.int64())]))

    parts = counts.where("k = -1").coalesce(8).mapInArrow(document_frequency, "df binary, n long").collect()
    n = sum(r["n"] for r in parts)
    idf = np.log((1 + n) / (1 + sum((np.frombuffer(r["df"]) for r in parts), np.zeros(DIM)))) + 1

    def cluster(key, pdf: pd.DataFrame) -> pd.DataFrame:
        made = lambda k: weigh(np.stack(sorted((dense(v) for v in pdf.loc[pdf["k"] == k, "x"]), key=bytes)), idf)
        c = _cluster(made(-1), centroids)
        limit = np.zeros(len(STRETCHES))
        for k in range(len(STRETCHES)):
            if (pdf["k"] == k).any():
                limit[k] = REJECT * np.quantile((made(k) @ c.T).max(axis=1), QUANTILE)
            elif k:
                limit[k] = limit[k - 1]
        return pd.DataFrame({"lang": key[0], "c": [r.astype(np.float32).tobytes() for r in c], "limit": [limit.tobytes()] * len(c)})

    rows = counts.groupBy("lang").applyInPandas(cluster, "lang string, c binary, limit binary").collect()
    counts.unpersist()
    rows = sorted(rows, key=lambda r: (r["lang"], r["c"]))
    stack = lambda name, t, width: np.stack([np.frombuffer(r[name], t) for r in rows]) if rows else np.zeros((0, width), t)
    return Model([r["lang"] for r in rows], stack("c", np.float32, DIM), stack("limit", np.float64, len(STRETCHES)), idf.astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected, named with the prefix; columns of these names are replaced."""
    added = [prefix + c for c in ("lang_pred", "score", "rejected")]
    kept = [c for c in docs.columns if c not in added]
    # texts travel once, unless they need a cast or their column is replaced
    once = text_col in kept and isinstance(docs.schema[text_col].dataType, T.StringType)
    given = text_col if once else free_name(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = [], [], []
            for _, x, letters, size in features(batch.column(given).cast(pa.large_string())):
                if not model.langs:
                    lang += ["und"] * len(x)
                    score += [0.0] * len(x)
                    rejected += [True] * len(x)
                    continue
                near = weigh(x, model.idf) @ model.centroids.T
                best = near.argmax(axis=1)
                top = np.clip(near[np.arange(len(x)), best].astype(float), 0, 1)
                klass = np.searchsorted(LENGTHS, size, side="right") - 1
                far = (top <= 0) | (klass >= 0) & (top < model.limit[best, np.maximum(klass, 0)])
                lang += [model.langs[j] if ok else "und" for j, ok in zip(best, letters)]
                score += np.where(letters, top, 0).tolist()
                rejected += (far | ~letters).tolist()
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [*kept, *added])

    out = T.StructType([docs.schema[c] for c in kept]).add(added[0], "string").add(added[1], "double").add(added[2], "boolean")
    more = [] if once else [F.col(text_col).cast("string").alias(given)]
    return docs.select(*kept, *more).mapInArrow(run, out)
