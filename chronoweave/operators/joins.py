"""Joins of spans and points on one program's time axis.

A range condition alone would compare every pair of rows of a program. Both sides are therefore dealt
to time bins, joined on program and bin, and a pair is kept only in the first bin that both have, so no
pass over the result is needed to drop repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "program_id"


def _bin(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def _bins(df: DataFrame, start: Column, end: Column, width: float, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(_bin(start, width), F.greatest(_bin(start, width), _bin(end, width)))))


def _prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(F.col(key), *(F.col(c).alias(prefix + c) for c in df.columns if c != key))


def overlap_join(left: DataFrame, right: DataFrame, bin_sec: float = 60.0, how: str = "inner", key: str = KEY, closed: bool = False, margin: float = 0.0) -> DataFrame:
    """Pairs of spans that overlap; columns get l_ and r_ before their names.

    closed: ends that touch count, after the right spans are widened by margin. how: inner or left;
    left keeps left rows without a match, with nulls on the right.
    """
    a, b = _prefixed(left, "l_", key), _prefixed(right, "r_", key)
    lo, hi = F.col("r_start_sec") - F.lit(margin), F.col("r_end_sec") + F.lit(margin)
    if how == "left":
        a = a.withColumn("__row", F.monotonically_increasing_id())
    x = _bins(a, F.col("l_start_sec"), F.col("l_end_sec"), bin_sec, "__bin")
    y = _bins(b, lo, hi, bin_sec, "__bin")
    first = F.greatest(_bin(F.col("l_start_sec"), bin_sec), _bin(lo, bin_sec))
    if closed:
        meet = (F.col("l_end_sec") >= lo) & (F.col("l_start_sec") <= hi)
    else:
        meet = F.least(F.col("l_end_sec"), F.col("r_end_sec")) > F.greatest(F.col("l_start_sec"), F.col("r_start_sec"))
    pairs = x.join(y, [key, "__bin"]).where((F.col("__bin") == first) & meet).drop("__bin")
    if how == "inner":
        return pairs
    missing = a.join(pairs.select("__row").distinct(), "__row", "left_anti")
    return pairs.unionByName(missing, allowMissingColumns=True).drop("__row")


def points_in_spans(points: DataFrame, spans: DataFrame, how: str = "inner", time: str = "time_sec", include_start: bool = True, bin_sec: float = 60.0, key: str = KEY) -> DataFrame:
    """Points that lie in a span, [start, end) or, with include_start=False, strictly inside.

    how: inner gives pairs (span columns with r_ before their names), left_semi and left_anti filter the
    points. Each point is in one bin, so only the spans are multiplied.
    """
    p = points.withColumn("__bin", _bin(F.col(time), bin_sec))
    s = _bins(_prefixed(spans, "r_", key), F.col("r_start_sec"), F.col("r_end_sec"), bin_sec, "__r_bin").withColumnRenamed(key, "__r_key")
    after = F.col(time) >= F.col("r_start_sec") if include_start else F.col(time) > F.col("r_start_sec")
    condition = (F.col(key) == F.col("__r_key")) & (F.col("__bin") == F.col("__r_bin")) & after & (F.col(time) < F.col("r_end_sec"))
    return p.join(s, condition, how).drop("__r_key", "__r_bin", "__bin")


def nearest(points: DataFrame, candidates: DataFrame, tolerance: float, time: str = "time_sec", seq: str = "seq", candidate_time: str = "time_sec", candidate_seq: str = "seq", key: str = KEY) -> DataFrame:
    """Every point with its nearest candidate within the tolerance, on either side, or nulls.

    Adds near_time, near_seq and near_dt (absolute). Equal distances go to the smallest candidate seq. Points are
    dealt to wide bins, candidates to all bins that they can be near in; in the order of time only the candidates
    just before and after a point are compared with it, however many lie within the tolerance.
    """
    width = max(60.0, 8.0 * tolerance)
    at = F.col(candidate_time)
    some = candidates.where(F.col(key).isNotNull() & at.isNotNull()).groupBy(F.col(key), at.alias("__c")).agg(F.min(candidate_seq).alias("__s"))
    some = some.withColumns({"__bin": F.explode(F.sequence(_bin(F.col("__c") - tolerance, width), _bin(F.col("__c") + tolerance, width))), "__t": F.col("__c")})
    each = points.withColumns({"__bin": _bin(F.col(time), width), "__t": F.col(time), "__p": F.lit(True)}).unionByName(some, allowMissingColumns=True)
    c = F.when(F.col("__p").isNull(), F.struct(F.col("__c").alias("t"), F.col("__s").alias("s")))
    w = Window.partitionBy(key, "__bin")
    # at equal times candidates come first in both directions
    before, after = (F.last(c, True).over(w.orderBy(t, F.col("__p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)) for t in (F.asc("__t"), F.desc("__t")))
    near = lambda x: F.when(F.abs(x["t"] - F.col(time)) <= tolerance, F.struct(F.abs(x["t"] - F.col(time)).alias("dt"), x["s"].alias("s"), x["t"].alias("t")))
    met = each.withColumns({"__a": before, "__b": after}).where("__p").withColumn("__n", F.least(near(F.col("__a")), near(F.col("__b"))))
    rest = [n for n in points.columns if n not in (key, seq)]
    return met.select(key, seq, *rest, F.col("__n.t").alias("near_time"), F.col("__n.s").alias("near_seq"), F.col("__n.dt").alias("near_dt"))


def snap(points: DataFrame, candidates: DataFrame, tolerance: float, **names) -> DataFrame:
    """Points moved to their nearest candidate within the tolerance; moved tells which ones changed."""
    time = names.get("time", "time_sec")
    met = nearest(points, candidates, tolerance, **names)
    to = F.coalesce("near_time", time)
    return met.withColumn("moved", to != F.col(time)).withColumn("raw_" + time, F.col(time)).withColumn(time, to)


def context_text(spans: DataFrame, entries: DataFrame, margin: float = 45.0, key: str = KEY, bin_sec: float = 300.0) -> DataFrame:
    """Each span's entries within the margin (closed), in order, one on each line; null without any.

    The texts' length grows with the square of the density, so pairs are never shuffled. Spans are dealt by their starts to
    bins; a bin gets the entries that meet any of its spans, as one longer span, and makes its texts in Python.
    """
    if margin < 0:
        raise ValueError("margin must not be negative")
    low, high = F.col("start_sec") - F.lit(margin), F.col("end_sec") + F.lit(margin)
    home = F.when(F.col("end_sec").isNotNull(), _bin(low, bin_sec))
    homes = spans.select(key, home.alias("home"), low.alias("start_sec"), high.alias("end_sec")).where("home IS NOT NULL").groupBy(key, "home").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))
    met = overlap_join(entries.select(key, "seq", "start_sec", "end_sec", "text"), homes, key=key, closed=True, bin_sec=bin_sec)
    dealt = met.select(key, F.col("r_home").alias("__home"), *(F.col("l_" + c).alias(c) for c in ("seq", "start_sec", "end_sec", "text")))
    given = spans.withColumns({"__home": home, "__low": low, "__high": high})
    names, schema = spans.columns, T.StructType([*spans.schema.fields, T.StructField("context", T.StringType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("start_sec", "ascending"), ("seq", "ascending"), ("text", "ascending")])
        start, end, texts = right["start_sec"].to_numpy(), right["end_sec"].to_numpy(), np.array(right["text"].to_pylist(), dtype=object)
        some = np.array([t is not None for t in texts], dtype=bool)
        found = []
        for lo, n in zip(left["__low"].to_pylist(), np.searchsorted(start, left["__high"].to_numpy(), side="right").tolist() if len(start) else [0] * len(left)):
            near = np.flatnonzero(end[:n] >= lo) if n else ()
            found.append("\n".join(texts[near[some[near]]]) if len(near) else None)
        return left.select(names).append_column("context", pa.array(found, pa.string()))

    out = given.groupBy(key, "__home").cogroup(dealt.groupBy(key, "__home")).applyInArrow(run, schema)
    return out.select(key, "seq", *(c for c in out.columns if c not in (key, "seq")))


def pair_by_position(left: DataFrame, right: DataFrame, order: str = "seq", key: str = KEY) -> DataFrame:
    """The n-th row of left in each program with the n-th of right, whose columns get r_; nulls beyond its end."""
    number = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return number(left).join(_prefixed(number(right), "r_", key).withColumnRenamed("r___n", "__n"), [key, "__n"], "left").drop("__n")


def by_id(rows: DataFrame, originals: DataFrame, ids: str = "id") -> DataFrame:
    """Rows with the columns of the original of their id; unknown ids go, repeated ones stay."""
    return rows.join(originals, ids)
