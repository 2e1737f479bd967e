"""Change detection over consecutive rows of a program."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import KEY


def by_order(key: str = KEY, order: str = "seq"):
    return Window.partitionBy(key).orderBy(order)


def distance_series(frames: DataFrame, text: str = "text", key: str = KEY, order: str = "seq") -> DataFrame:
    """frames with distance to the next frame's text; null for the last."""
    w = by_order(key, order)
    return frames.withColumn("distance", F.when(F.lead(order).over(w).isNotNull(), S.text_distance(text, F.lead(text).over(w))))


def change_points(series: DataFrame, threshold: float = 0.5, gray: float = 0.6, suppress: bool = False, highest: float = 0.7, spread: float = 0.15, key: str = KEY, order: str = "seq") -> DataFrame:
    """Rows whose distance is over the threshold, with kind gray or high, and confirmed.

    suppress: two adjacent changes with calm rows on both sides, neither over highest and at most spread
    apart, are an anomaly and aren't confirmed.
    """
    w = by_order(key, order)
    d = F.col("distance")
    at = lambda k: F.lead("distance", k).over(w) if k > 0 else F.lag("distance", -k).over(w)
    high = lambda x: F.coalesce(x > threshold, F.lit(False))
    alike = lambda x: (d <= highest) & (x <= highest) & (F.abs(d - x) <= spread)
    first = high(at(1)) & ~high(at(2)) & ~high(at(-1)) & alike(at(1))
    second = high(at(-1)) & ~high(at(-2)) & ~high(at(1)) & alike(at(-1))
    anomaly = F.coalesce(first | second, F.lit(False)) if suppress else F.lit(False)
    out = series.withColumn("suppressed", anomaly)
    return out.where(d > threshold).withColumns({"kind": F.when(d < gray, "gray").otherwise("high"), "confirmed": ~F.col("suppressed")})


def cluster_firsts(points: DataFrame, gap: int = 2, key: str = KEY, order: str = "seq") -> DataFrame:
    """First of each chain of rows at most gap apart in order, with the chain's size."""
    w = by_order(key, order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(1))
    chains = points.withColumn("__c", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chains.groupBy(key, "__c").agg(F.min(order).alias(order), F.count("*").alias("n")).drop("__c")


def frame_seconds(points: DataFrame, fps: float = 1.0, key: str = KEY, order: str = "seq") -> DataFrame:
    """Distinct times of the changes: the frame after the one that a change follows."""
    return points.select(key, F.bround((F.col(order) + 1) / F.lit(fps), 2).alias("time_sec")).distinct()


def frame_mid_seconds(points: DataFrame, start: float = 0.0, fps: float = 1.0, key: str = KEY, order: str = "seq") -> DataFrame:
    """As frame_seconds(), between the anchors of the two frames, which lie half a frame in."""
    return points.select(key, F.bround(F.lit(start) + (F.col(order) + 1.0) / F.lit(fps), 2).alias("time_sec")).distinct()


def _middle(a, b):
    """Half-way between two times, rounded; rounding the sum first keeps ties exact."""
    return F.bround(F.bround(a + b, 2) / 2.0, 2)


def voronoi_spans(points: DataFrame, duration: str, time: str = "time_sec", key: str = KEY, order: str = "seq") -> DataFrame:
    """Each point's span: from the middle to the point before to the middle to the next, over the whole program."""
    w = Window.partitionBy(key).orderBy(time, order)
    before, after = F.lag(time).over(w), F.lead(time).over(w)
    return points.withColumns({
        "start_sec": F.coalesce(_middle(before, F.col(time)), F.lit(0.0)),
        "end_sec": F.coalesce(_middle(F.col(time), after), F.bround(duration, 2)),
    })


def drop_repeats(rows: DataFrame, text: str = "text", key: str = KEY, order: str = "seq") -> DataFrame:
    """Non-blank rows whose text differs from the non-blank row before them."""
    some = rows.where(F.coalesce(S.strip(text), F.lit("")) != "")
    w = by_order(key, order)
    return some.withColumn("__b", F.lag(text).over(w)).where(F.col("__b").isNull() | (F.col("__b") != F.col(text))).drop("__b")
