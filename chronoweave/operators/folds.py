"""Greedy passes in order, one program at a time, as folds over a sorted array.

Rows become sorted arrays that are folded in the JVM. Where a pass forgets what lies further back than some
gap, a program is cut at such gaps first; in other passes a program must fit one row (thousands of entries do).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import KEY, overlap_join, points_in_spans


def fold(df: DataFrame, order: list[str], start: Callable[[Column], Column], step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Fold the sorted rows of each group; explode what finish (or the state) gives, an array of structs."""
    rest = [c for c in df.columns if c not in (*order, *by)]
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("rows"))
    kept = F.aggregate("rows", start(F.col("rows")), step, finish) if finish else F.aggregate("rows", start(F.col("rows")), step)
    return rows.select(*by, F.explode(kept).alias("k")).select(*by, "k.*")


def stretches(df: DataFrame, apart: Callable[[Column], Column], order: list[str], key: str = KEY) -> DataFrame:
    """df with __part, which counts the rows that are far enough from the row before them.

    apart says so of the column of times; what such a row meets doesn't depend on the rows before it, so each
    part can be folded alone and no fold carries a whole program.
    """
    w = Window.partitionBy(key).orderBy(*order)
    t = F.col(order[0])
    new = F.coalesce(apart(t - F.lag(t).over(w)).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _none(rows: Column) -> Column:
    return F.slice(rows, 1, 0)


def _last(a: Column) -> Column:
    return F.element_at(a, -1)


def thin(points: DataFrame, gap: float, duration: str | None = None, edge: float = 0.5, time: str = "time_sec", key: str = KEY) -> DataFrame:
    """Points at least gap after the one kept before them, the first one after gap; none within edge of the ends."""
    inside = points.where(F.col(time) > edge)
    if duration:
        inside = inside.where(~F.coalesce(F.col(time) >= F.col(duration) - edge, F.lit(False)))

    def step(acc: Column, x: Column) -> Column:
        near = F.when(F.size(acc) > 0, x[time] - _last(acc)[time] < gap).otherwise((x["__first"] == 1) & (x[time] < gap))
        return F.when(near, acc).otherwise(F.array_append(acc, x))

    cut = stretches(inside, lambda d: d >= gap, [time, "seq"], key).withColumn("__first", F.col("__part"))
    return fold(cut, [time, "seq"], _none, step, by=(key, "__part")).drop("__part", "__first")


def keep_strongest(points: DataFrame, gap: float, inclusive: bool, rank: str = "rank", time: str = "time_sec", key: str = KEY) -> DataFrame:
    """Of points within gap of the last kept one, a strictly stronger one takes its place, others go.

    inclusive: whether a distance of exactly gap is within it. Equal times keep the order of seq.
    """

    def step(acc: Column, x: Column) -> Column:
        dt = x[time] - _last(acc)[time]
        near = (F.size(acc) > 0) & ((dt <= gap) if inclusive else (dt < gap))
        stronger = x[rank] > _last(acc)[rank]
        replaced = F.array_append(F.slice(acc, 1, F.size(acc) - 1), x)
        return F.when(~near, F.array_append(acc, x)).when(stronger, replaced).otherwise(acc)

    cut = stretches(points, lambda d: (d > gap) if inclusive else (d >= gap), [time, "seq"], key)
    return fold(cut, [time, "seq"], _none, step, by=(key, "__part")).drop("__part")


def stitch(points: DataFrame, tolerance: float = 15.0, **names) -> DataFrame:
    return keep_strongest(points, tolerance, True, **names)


def outside_and_spaced(points: DataFrame, spans: DataFrame, gap: float, key: str = KEY, **names) -> DataFrame:
    """Points outside the spans, thinned to the strongest within gap."""
    return keep_strongest(points_in_spans(points, spans, "left_anti", key=key), gap, False, key=key, **names)


def merge_short(ranges: DataFrame, least: float = 2.0, key: str = KEY) -> DataFrame:
    """Contiguous ranges with the short ones joined to the range on their left; leading ones to the right."""

    def step(acc: Column, x: Column) -> Column:
        last = _last(acc)
        pending = (F.size(acc) == 1) & (last["end_sec"] - last["start_sec"] < least)
        longer = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["start_sec"].alias("start_sec"), x["end_sec"].alias("end_sec")))
        join_left = x["end_sec"] - x["start_sec"] < least
        return F.when(F.size(acc) == 0, F.array_append(acc, x)).when(pending | join_left, longer).otherwise(F.array_append(acc, x))

    return fold(ranges.select(key, "start_sec", "end_sec"), ["start_sec", "end_sec"], _none, step, by=(key,))


def add_disjoint(kept: DataFrame, candidates: DataFrame, most: float = 1.0, key: str = KEY) -> DataFrame:
    """kept, and the candidates in order whose overlap with everything kept so far stays below most (over 0) seconds.

    Both have seq, start_sec, end_sec; candidates rows are marked added. An overlap join takes out what kept
    spans forbid; what is left is cut where no candidate overlaps the ones before it, and folded in order of seq.
    """
    if most <= 0:
        raise ValueError("most must be over 0 seconds")
    span = ["seq", "start_sec", "end_sec"]
    met = overlap_join(kept.select(key, *span), candidates.select(key, *span), key=key)
    over = F.least("l_end_sec", "r_end_sec") - F.greatest("l_start_sec", "r_start_sec")
    barred = met.where(over >= most).select(key, *(F.col("r_" + c).alias(c) for c in span)).distinct()
    free = candidates.join(barred, [key, *span], "left_anti")
    w = Window.partitionBy(key).orderBy("start_sec", "end_sec", "seq")
    before = F.max("end_sec").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start_sec") >= before).cast("int"), F.lit(1))
    cut = free.withColumn("__new", new).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")

    def step(acc: Column, x: Column) -> Column:
        meets = F.exists(acc, lambda y: F.least(x["end_sec"], y["end_sec"]) - F.greatest(x["start_sec"], y["start_sec"]) >= most)
        return F.when(meets, acc).otherwise(F.array_append(acc, x))

    added = fold(cut, span, _none, step, by=(key, "__part")).drop("__part")
    return kept.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))


def pack(items: DataFrame, target: int, size: str = "tokens", key: str = KEY) -> DataFrame:
    """Items with batch: consecutive items up to target in size; an item over it is alone."""

    def step(acc: Column, x: Column) -> Column:
        fits = acc["room"] >= x[size]
        batch = F.when(acc["n"] == 0, 0).when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        room = F.when((acc["n"] > 0) & fits, acc["room"] - x[size]).otherwise(F.lit(target).cast("long") - x[size])
        return F.struct((acc["n"] + 1).alias("n"), batch.alias("batch"), room.alias("room"), F.array_append(acc["out"], F.struct(batch.alias("batch"), x["seq"].alias("seq"))).alias("out"))

    start = lambda rows: F.struct(F.lit(0).alias("n"), F.lit(0).alias("batch"), F.lit(target).cast("long").alias("room"), F.array().cast("array<struct<batch:int,seq:bigint>>").alias("out"))
    slim = items.select(key, F.col("seq").cast("long").alias("seq"), F.col(size).cast("long").alias(size))
    return fold(slim, ["seq"], start, step, lambda acc: acc["out"], by=(key,))


def batch_ranges(items: DataFrame, batch: str = "batch", key: str = KEY) -> DataFrame:
    """First start and last end of each batch."""
    return items.groupBy(key, batch).agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))


def overlapping_chunks(segments: DataFrame, target: int = 6000, overlap: float = 90.0, size: str = "tokens", key: str = KEY) -> DataFrame:
    """chunk, first and last (positions in order of seq), start_sec, end_sec of chunks of up to target tokens.

    A chunk has one segment at least. The next one begins with the earliest segment that starts less than
    overlap before the chunk's end, but always further on. Needs random access, so it runs in Python, over
    sorted batches; what is kept between them is the segments from the open chunk's first one on.
    """
    import numpy as np
    import pandas as pd

    def chunks(start: np.ndarray, end: np.ndarray, size: np.ndarray, over: bool) -> tuple[list[tuple[int, int]], int]:
        """first and past-the-last place of each chunk whose end is known, and where the next one begins; over: no segment follows."""
        tokens, found, i, n = np.concatenate([[0], np.cumsum(size)]), [], 0, len(start)
        reach = np.maximum(np.arange(n) + 1, np.searchsorted(tokens, tokens[:-1] + target, side="right") - 1).tolist()
        s, e = start.tolist(), (end - overlap).tolist()
        while i < n and (over or reach[i] < n):
            j = reach[i]
            found.append((i, j))
            if j >= n:
                return found, n
            k = j
            while k - 1 > i and s[k - 1] > e[j - 1]:
                k -= 1
            i = k
        return found, i

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, chunk, at, held = None, 0, 0, [np.empty(0), np.empty(0), np.empty(0, dtype=np.int64)]

        def settled(over: bool) -> pd.DataFrame:
            nonlocal chunk, at, held
            found, i = chunks(*held, over)
            first, past = np.array(found, dtype=np.int64).reshape(-1, 2).T
            out = pd.DataFrame({key: program, "chunk": chunk + np.arange(len(first)), "first": at + first, "last": at + past - 1, "start_sec": held[0][first], "end_sec": held[1][past - 1]})
            chunk, at, held = chunk + len(first), at + i, [x[i:] for x in held]
            return out

        for batch in batches:
            names = batch[key].to_numpy()
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(names[1:] != names[:-1]) + 1):
                if not len(rows):
                    continue
                if names[rows[0]] != program:
                    if len(held[0]):
                        yield settled(True)
                    program, chunk, at, held = names[rows[0]], 0, 0, [x[:0] for x in held]
                held = [np.concatenate([x, batch[c].to_numpy()[rows]]) for x, c in zip(held, ("start_sec", "end_sec", "n"))]
                yield settled(False)
        if len(held[0]):
            yield settled(True)

    slim = segments.select(key, "seq", "start_sec", "end_sec", F.col(size).cast("long").alias("n"))
    in_order = slim.repartition(key).sortWithinPartitions(key, "seq").drop("seq")
    return in_order.mapInPandas(run, f"{key} string, chunk int, first int, last int, start_sec double, end_sec double")
