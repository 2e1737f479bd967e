"""Baseline segmenters: embedding windows and lexical cohesion over token blocks."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from .joins import KEY


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(n > 0, _dot(a, b) / n).otherwise(0.0)


def _mean(vectors: Column) -> Column:
    add = F.aggregate(F.slice(vectors, 2, 1000), F.get(vectors, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    return F.transform(add, lambda x: x / F.size(vectors))


def embedding_gaps(units: DataFrame, width: int = 3, key: str = KEY) -> DataFrame:
    """key, gap, dissimilarity between the mean vectors of the width units before and after each gap.

    units: key, seq (0, 1, ...), v. Gap g stands before unit g; n - 2 * width + 1 gaps have full windows.
    """
    w = Window.partitionBy(key).orderBy("seq")
    before, after = F.collect_list("v").over(w.rowsBetween(-width, -1)), F.collect_list("v").over(w.rowsBetween(0, width - 1))
    met = units.select(key, F.col("seq").alias("gap"), before.alias("a"), after.alias("b")).where((F.size("a") == width) & (F.size("b") == width))
    return met.select(key, "gap", (F.lit(1.0) - cosine(_mean(F.col("a")), _mean(F.col("b")))).alias("dissimilarity"))


def smooth(gaps: DataFrame, value: str, radius: int, key: str = KEY) -> DataFrame:
    w = Window.partitionBy(key).orderBy("gap").rowsBetween(-radius, radius)
    return gaps.withColumn(value, F.avg(value).over(w))


def peaks(gaps: DataFrame, value: str, factor: float, sample_sd: bool = False, key: str = KEY) -> DataFrame:
    """Local maxima of value that reach mean + factor * sd of their program."""
    w, all_ = Window.partitionBy(key).orderBy("gap"), Window.partitionBy(key)
    sd = (F.stddev_samp if sample_sd else F.stddev_pop)(value).over(all_)
    threshold = F.avg(value).over(all_) + factor * sd
    v = F.col(value)
    met = gaps.withColumns({"threshold": threshold, "__l": F.lag(value).over(w), "__r": F.lead(value).over(w)})
    top = (F.col("__l").isNull() | (v >= F.col("__l"))) & (F.col("__r").isNull() | (v > F.col("__r")))
    return met.where((v >= F.col("threshold")) & top).drop("__l", "__r")


def embedding_boundaries(units: DataFrame, unit_sec: float = 15.0, width: int = 3, radius: int = 1, factor: float = 0.5, min_gap_sec: float = 30.0, key: str = KEY) -> DataFrame:
    """Boundary times from embeddings of fixed-length units, at least min_gap_sec apart."""
    found = peaks(smooth(embedding_gaps(units, width, key), "dissimilarity", radius, key), "dissimilarity", factor, key=key)
    points = found.select(key, (F.col("gap") * unit_sec).alias("time_sec"), F.col("gap").alias("seq"))
    return folds.thin(points, min_gap_sec, key=key).select(key, "time_sec")


def placed_words(texts: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """key, w (the words of a text), before and all: the words of the program before it, in order of seq, and in all.

    Running sums are taken over counts alone, so no text passes a window; the texts move once, to meet them.
    Equal texts of one seq stand one after the other.
    """
    words = F.filter(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    named = texts.where(F.col(key).isNotNull()).select(key, F.struct("seq").alias("__seq"), F.xxhash64(text).alias("__h"), F.col(text))
    own = [key, "__seq", "__h"]
    counts = named.select(*own, F.size(words).cast("long").alias("__n")).where("__n > 0").groupBy(*own).agg(F.first("__n").alias("__n"), F.sum("__n").alias("__all"))
    w = Window.partitionBy(key).orderBy("__seq", "__h")
    sums = counts.select(*own, "__n", F.coalesce(F.sum("__all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("__all").over(Window.partitionBy(key)).alias("all"))
    copy = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0))) - 1
    return named.join(sums, own).select(key, words.alias("w"), (F.col("before") + copy * F.col("__n")).alias("before"), "all")


def token_blocks(texts: DataFrame, size: int = 20, text: str = "text", key: str = KEY) -> DataFrame:
    """key, block, term, n: word counts of pseudo-sentences of `size` words, words in order of the texts' seq."""
    placed = placed_words(texts, text, key).select(key, "before", F.posexplode("w").alias("i", "term"))
    return placed.withColumn("block", F.floor((F.col("before") + F.col("i")) / F.lit(size)).cast("int")).groupBy(key, "block", "term").agg(F.count("*").alias("n"))


#: Blocks whose gaps one task computes at once.
CHUNK = 256


def _chunk_gaps(program: str, place: int, total: int, block: np.ndarray, term: np.ndarray, n: np.ndarray | None, width: int, chunk: int, key: str) -> pd.DataFrame:
    """key, gap, similarity of a chunk's gaps: the counts on the two sides of each are differences of running sums over the blocks."""
    first = place * chunk
    gaps = np.arange(max(first, width), min(first + chunk, total - width + 1))
    if not len(gaps):
        return pd.DataFrame({key: pd.Series([], dtype=object), "gap": pd.Series([], dtype="int32"), "similarity": pd.Series([], dtype="float64")})
    zero = int(gaps[0]) - width
    high, wide = int(gaps[-1]) + width - zero + 1, int(term.max()) + 1
    block = block - zero
    inside = (block >= 0) & (block < high - 1)
    sums = np.bincount((block[inside] + 1) * wide + term[inside], None if n is None else n[inside], high * wide).astype(float).reshape(high, wide)
    np.cumsum(sums, axis=0, out=sums)
    g = gaps - zero
    before, after = sums[g] - sums[g - width], sums[g + width] - sums[g]
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    norm = np.sqrt(dot(before, before) * dot(after, after))
    return pd.DataFrame({key: [program] * len(gaps), "gap": gaps.astype(np.int32), "similarity": np.where(norm > 0, dot(before, after) / np.where(norm > 0, norm, 1), 0.0)})


def cohesion_gaps(blocks: DataFrame, width: int = 10, key: str = KEY, chunk: int = CHUNK) -> DataFrame:
    """key, gap, similarity: cosine of the word counts of the width blocks before and after each gap.

    Gaps are dealt out in chunks; a chunk gets its own blocks and the width blocks on either side, so a
    program is spread over tasks.
    """
    n = blocks.groupBy(key).agg((F.max("block") + 1).alias("__n"))
    each = blocks.join(n, key).where(F.col("__n") >= 2 * width)
    low, high = F.greatest(F.col("block") - width + 1, F.lit(0)), F.col("block") + width
    at = F.explode(F.sequence(F.floor(low / F.lit(chunk)).cast("int"), F.floor(high / F.lit(chunk)).cast("int")))
    dealt = each.select(key, "__n", at.alias("__chunk"), "block", "term", F.col("n").cast("long").alias("n"))

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        return _chunk_gaps(k[0], int(k[1]), int(pdf["__n"].iloc[0]), pdf["block"].to_numpy(), pd.factorize(pdf["term"])[0], pdf["n"].to_numpy(), width, chunk, key)

    return dealt.groupBy(key, "__chunk").applyInPandas(run, f"{key} string, gap int, similarity double")


def text_gaps(texts: DataFrame, size: int = 20, width: int = 10, text: str = "text", key: str = KEY, chunk: int = CHUNK) -> DataFrame:
    """cohesion_gaps() of the token_blocks() of texts, whose words go to the chunks as pieces of text, not as a row a word."""
    n, before, at = F.size("w").cast("long"), F.col("before"), F.col("__chunk")
    whole = lambda x, by: F.floor(x / F.lit(by)).cast("long")
    each = placed_words(texts, text, key).withColumn("__n", whole(F.col("all") + (size - 1), size)).where(F.col("__n") >= 2 * width)
    low, high = F.greatest(whole(before, size) - (width - 1), F.lit(width)), F.least(whole(before + n - 1, size) + width, F.col("__n") - width)
    dealt = each.where(low <= high).withColumn("__chunk", F.explode(F.sequence(whole(low, chunk), whole(high, chunk))))
    first, past = F.greatest((at * chunk - width) * size - before, F.lit(0)), F.least((at * chunk + (chunk - 1 + width)) * size - before, n)
    piece = F.array_join(F.slice("w", (first + 1).cast("int"), (past - first).cast("int")), " ")
    pieces = dealt.where(past > first).select(key, "__chunk", "__n", (before + first).alias("at"), piece.alias("words"))

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        words = [x.split(" ") for x in pdf["words"]]
        place = np.concatenate([np.arange(a, a + len(x)) for a, x in zip(pdf["at"].tolist(), words)])
        term = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))[0]
        return _chunk_gaps(k[0], int(k[1]), int(pdf["__n"].iloc[0]), place // size, term, None, width, chunk, key)

    return pieces.groupBy(key, "__chunk").applyInPandas(run, f"{key} string, gap int, similarity double")


def depth_scores(gaps: DataFrame, key: str = KEY) -> DataFrame:
    """gaps with depth: how far the similarity rises to the nearest peak on both sides.

    Going left, the climb from a gap ends where its run of scores that don't rise begins; going right, where
    its run of scores that don't fall ends.
    """
    w, x = Window.partitionBy(key).orderBy("gap"), F.col("similarity")
    runs = gaps.withColumns({"__up": F.coalesce((x > F.lag(x).over(w)).cast("int"), F.lit(1)), "__down": F.coalesce((x < F.lag(x).over(w)).cast("int"), F.lit(1))})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumns({"__up": F.sum("__up").over(upto), "__down": F.sum("__down").over(upto)})
    peak = lambda run: F.max(x).over(Window.partitionBy(key, run))
    return runs.select(key, "gap", "similarity", (peak("__up") - x + peak("__down") - x).alias("depth"))


def cohesion_boundaries(texts: DataFrame, size: int = 20, width: int = 10, radius: int = 2, factor: float = -0.5, digits: int = 9, key: str = KEY) -> DataFrame:
    """Gaps whose depth is a local maximum and reaches mean - sd / 2.

    Scores are rounded to some digits on the way, so that the last bits of sums don't split a plateau.
    """
    rounded = lambda df, c: df.withColumn(c, F.bround(c, digits))
    gaps = rounded(text_gaps(texts, size, width, key=key), "similarity")
    scores = rounded(smooth(gaps, "similarity", radius, key), "similarity")
    return peaks(rounded(depth_scores(scores, key), "depth"), "depth", factor, key=key).select(key, "gap", "depth")
