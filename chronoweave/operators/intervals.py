"""Algebra of spans: islands, coverage, clipping, splitting and merging, within each program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import KEY, overlap_join, points_in_spans, snap


def merge_islands(spans: DataFrame, gap: float = 5.0, kind: str = "kind", key: str = KEY) -> DataFrame:
    """Spans of one kind at most gap apart become one; a span of another kind in between parts them.

    Order is (start, end, kind). Adds n, and keeps lists under `ids` where spans have an `id` column.
    """
    w = Window.partitionBy(key).orderBy("start_sec", "end_sec", kind)
    change = F.coalesce((F.lag(kind).over(w) != F.col(kind)).cast("int"), F.lit(1))
    runs = spans.withColumn("__run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(key, "__run").orderBy("start_sec", "end_sec")
    before = F.max("end_sec").over(r.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start_sec") > before + gap).cast("int"), F.lit(1))
    islands = runs.withColumn("__island", F.sum(new).over(r.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "id"))), lambda x: x["id"])).alias("ids")] if "id" in spans.columns else []
    out = islands.groupBy(key, "__run", "__island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.first(kind).alias(kind), F.count("*").alias("n"), *extra)
    return out.drop("__run", "__island")


def union_length(spans: DataFrame, by: list[str]) -> DataFrame:
    """by..., covered: length of the union of each group's spans."""
    w = Window.partitionBy(*by).orderBy("start_sec", "end_sec")
    before = F.max("end_sec").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("end_sec") - F.greatest(F.col("start_sec"), F.coalesce(before, F.col("start_sec"))))
    return spans.select(*by, fresh.alias("__fresh")).groupBy(*by).agg(F.sum("__fresh").alias("covered"))


def coverage(topics: DataFrame, segments: DataFrame, key: str = KEY) -> DataFrame:
    """topics with coverage: the share of each that the union of the segments covers; 0 for empty ones."""
    met = overlap_join(topics.select(key, "seq", "start_sec", "end_sec"), segments.select(key, "start_sec", "end_sec"), key=key)
    clipped = met.select(key, F.col("l_seq").alias("seq"), F.greatest("l_start_sec", "r_start_sec").alias("start_sec"), F.least("l_end_sec", "r_end_sec").alias("end_sec"))
    covered = union_length(clipped, [key, "seq"])
    length = F.col("end_sec") - F.col("start_sec")
    return topics.join(covered, [key, "seq"], "left").withColumn("coverage", F.when(length > 0, F.coalesce("covered", F.lit(0.0)) / length).otherwise(0.0)).drop("covered")


def below(share: float) -> Column:
    """Whether coverage is under the share, to nine digits: the last bits of a sum don't keep a topic that is covered by the share itself."""
    return F.bround("coverage", 9) < share


def drop_covered(topics: DataFrame, segments: DataFrame, share: float = 0.7, key: str = KEY) -> DataFrame:
    """Topics that the segments cover by less than the share."""
    return coverage(topics, segments, key).where(below(share))


def clip(spans: DataFrame, low: Column | float, high: Column | float, shift: bool = False) -> DataFrame:
    """Spans cut to [low, high], empty ones dropped; shift counts time from low."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    s, e = F.greatest(low, F.least("start_sec", high)), F.greatest(low, F.least("end_sec", high))
    zero = low if shift else F.lit(0.0)
    return spans.withColumns({"__s": s, "__e": e}).where(F.col("__e") > F.col("__s")).withColumns({"start_sec": F.col("__s") - zero, "end_sec": F.col("__e") - zero}).drop("__s", "__e")


def normalise_ranges(ranges: DataFrame, duration: Column, key: str = KEY) -> DataFrame:
    """Ranges relative to the program: shifted by the first start where they lie beyond the duration, then clipped.

    Empty ranges go. ranges has seq; a program whose ranges all vanish gives none here, see whole_if_none().
    """
    some = ranges.withColumn("__d", duration).where("end_sec > start_sec")
    w = Window.partitionBy(key)
    beyond = (F.min("start_sec").over(w) > F.col("__d")) | (F.max("end_sec").over(w) > F.col("__d") + 5.0)
    first = F.min_by("start_sec", "seq").over(w)
    moved = some.withColumn("__o", F.when(beyond, first).otherwise(0.0))
    cut = lambda c: F.bround(F.greatest(F.lit(0.0), F.least(F.col(c) - F.col("__o"), F.col("__d"))), 2)
    return moved.withColumns({"__s": cut("start_sec"), "__e": cut("end_sec")}).where("__e > __s").withColumns({"start_sec": F.col("__s"), "end_sec": F.col("__e")}).drop("__s", "__e", "__o", "__d")


def whole_if_none(ranges: DataFrame, programs: DataFrame, key: str = KEY) -> DataFrame:
    """One range over the whole program (duration_sec of programs) for programs without any."""
    whole = programs.join(ranges.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"))
    return ranges.select(key, F.col("seq").cast("long").alias("seq"), "start_sec", "end_sec").union(whole)


def cuts_to_spans(cuts: DataFrame, key: str = KEY, time: str = "time_sec") -> DataFrame:
    """Spans between consecutive distinct cuts, numbered from 0 in seq."""
    w = Window.partitionBy(key).orderBy(time)
    distinct = cuts.select(key, time).distinct()
    spans = distinct.select(key, F.col(time).alias("start_sec"), F.lead(time).over(w).alias("end_sec"), (F.row_number().over(w) - 1).cast("long").alias("seq"))
    return spans.where(F.col("end_sec").isNotNull())


def edge_cuts(programs: DataFrame, key: str = KEY) -> DataFrame:
    return programs.select(key, F.explode(F.array(F.lit(0.0), F.bround("duration_sec", 2))).alias("time_sec"))


def insert_cuts(ranges: DataFrame, cuts: DataFrame, margin: float = 0.5, key: str = KEY) -> DataFrame:
    """Ranges split at the cuts that lie further than margin from both ends; n_inserted counts them."""
    shrunk = ranges.select(key, "seq", (F.col("start_sec") + margin).alias("start_sec"), (F.col("end_sec") - margin).alias("end_sec"))
    inside = points_in_spans(cuts.select(key, "time_sec").distinct(), shrunk, include_start=False, key=key).select(key, F.col("r_seq").alias("seq"), "time_sec")
    points = inside.groupBy(key, "seq").agg(F.array_sort(F.collect_list("time_sec")).alias("__cuts"))
    met = ranges.join(points, [key, "seq"], "left").withColumn("__cuts", F.coalesce("__cuts", F.array().cast("array<double>")))
    return _split(met)


def _split(met: DataFrame) -> DataFrame:
    """Rows with an array __cuts of interior points become one row a part; part counts from 0."""
    edges = F.concat(F.array("start_sec"), F.col("__cuts"), F.array("end_sec"))
    parts = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(a.alias("s"), b.alias("e")))
    out = met.withColumn("n_inserted", F.size("__cuts")).select("*", F.posexplode(parts).alias("part", "__p"))
    return out.withColumns({"start_sec": F.col("__p.s"), "end_sec": F.col("__p.e")}).drop("__cuts", "__p")


def split_long_at(ranges: DataFrame, points: DataFrame, least: float = 10.0, key: str = KEY) -> DataFrame:
    """Ranges of at least `least` seconds split at the points strictly inside; origin keeps the range's seq."""
    long = ranges.where(F.col("end_sec") - F.col("start_sec") >= least)
    inside = points_in_spans(points.select(key, "time_sec").distinct(), long.select(key, "seq", "start_sec", "end_sec"), include_start=False, key=key)
    found = inside.groupBy(key, F.col("r_seq").alias("seq")).agg(F.array_sort(F.collect_list("time_sec")).alias("__cuts"))
    met = ranges.join(found, [key, "seq"], "left").withColumn("__cuts", F.coalesce("__cuts", F.array().cast("array<double>")))
    return _split(met).withColumnRenamed("seq", "origin").withColumn("is_part", F.col("n_inserted") > 0).drop("n_inserted")


def points_by_span(spans: DataFrame, points: DataFrame, key: str = KEY) -> DataFrame:
    """spans with the sorted points strictly inside each, an empty list where there are none."""
    inside = points_in_spans(points.select(key, "time_sec"), spans.select(key, "seq", "start_sec", "end_sec"), include_start=False, key=key)
    found = inside.groupBy(key, F.col("r_seq").alias("seq")).agg(F.array_sort(F.collect_list("time_sec")).alias("points"))
    return spans.join(found, [key, "seq"], "left").withColumn("points", F.coalesce("points", F.array().cast("array<double>")))


def force_split(ranges: DataFrame, longest: float = 30.0, target: float = 20.0) -> DataFrame:
    """Ranges over longest seconds in equal parts of about target seconds."""
    length = F.col("end_sec") - F.col("start_sec")
    n = F.when(length > longest, F.ceil(length / target).cast("int")).otherwise(1)
    out = ranges.withColumn("__n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = lambda i: F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) * i / F.col("__n")
    last = F.col("part") + 1 == F.col("__n")
    return out.withColumns({"__s": at(F.col("part")), "__e": F.when(last, F.col("end_sec")).otherwise(at(F.col("part") + 1))}).withColumns({"start_sec": F.col("__s"), "end_sec": F.col("__e")}).drop("__s", "__e", "__n")


def round_bounds(ranges: DataFrame, places: int = 2) -> DataFrame:
    """Contiguous ranges with their shared bounds rounded, so that none drift apart; empty ones go.

    Microseconds are rounded first, so that a half-way case isn't lost to the last bits of a sum.
    """
    near = lambda c: F.bround(F.bround(c, 6), places)
    return ranges.withColumns({"start_sec": near("start_sec"), "end_sec": near("end_sec")}).where("end_sec > start_sec")


def refine_ranges(
    ranges: DataFrame, cuts: DataFrame, silence_ends: DataFrame, long_sec: float = 20.0, snap_sec: float = 1.0, margin: float = 0.5, least: float = 2.0, longest: float = 30.0, target: float = 20.0, key: str = KEY,
) -> tuple[DataFrame, DataFrame]:
    """(ranges, counts): further cuts inside the long ranges, moved to ends of silence, then short ones merged and long ones split.

    ranges: seq, start_sec, end_sec, contiguous. cuts and silence_ends: time_sec. A range is long if it lasts
    over long_sec. counts has a row a program with how many rows each step met or made.
    """
    from .folds import merge_short

    long = ranges.where(F.col("end_sec") - F.col("start_sec") > long_sec)
    inside = points_in_spans(cuts.select(key, "time_sec").distinct(), long.select(key, "start_sec", "end_sec"), "left_semi", include_start=False, key=key)
    order = Window.partitionBy(key).orderBy("time_sec")
    numbered = lambda df: df.select(key, "time_sec").distinct().withColumn("seq", F.row_number().over(order))
    moved = snap(numbered(inside), numbered(silence_ends), snap_sec, key=key)
    parts = insert_cuts(ranges, moved.select(key, "time_sec").distinct(), margin, key)
    merged = merge_short(parts, least, key)
    split = force_split(merged, longest, target)
    out = round_bounds(split).select(key, "start_sec", "end_sec")
    out = out.withColumn("seq", (F.row_number().over(Window.partitionBy(key).orderBy("start_sec")) - 1).cast("long"))
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    counts = ranges.select(key).distinct()
    steps = {
        "n_silence_ends": silence_ends, "n_scenes_in": ranges, "n_long_scenes": long, "n_second_pass_cuts": inside, "n_cuts_snapped": moved.where("moved"),
        "n_parts": parts, "n_after_merge": merged, "n_after_split": split, "n_scenes_out": out,
    }
    for name, df in steps.items():
        counts = counts.join(count(df, name), key, "left")
    counts = counts.na.fill(0)
    made = {"n_cuts_inserted": F.col("n_parts") - F.col("n_scenes_in"), "n_merged": F.col("n_parts") - F.col("n_after_merge"), "n_forced_split_cuts": F.col("n_after_split") - F.col("n_after_merge")}
    return out, counts.withColumns(made).drop("n_parts", "n_after_merge", "n_after_split")


def non_editorial_intervals(annotations: DataFrame, gap: float = 5.0, key: str = KEY) -> DataFrame:
    """Islands of the non-editorial frames' spans by kind.

    annotations: start_sec, end_sec, non_editorial_kind, is_probably_editorial, sponsor_presentation; lists of
    frame_id are kept under ids.
    """
    from ..functions import scalars as S

    some = annotations.where(S.is_non_editorial("non_editorial_kind", "is_probably_editorial", "sponsor_presentation"))
    kind = S.resolved_kind("non_editorial_kind", "sponsor_presentation").alias("kind")
    own = [F.col("frame_id").alias("id")] if "frame_id" in annotations.columns else []
    return merge_islands(some.select(key, "start_sec", "end_sec", kind, *own), gap, key=key)


def scene_cut_candidates(ranges: DataFrame, programs: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct cuts of a program's scenes: full score at its edges, 0.72 inside."""
    firsts = ranges.groupBy(key).agg(F.min("start_sec").alias("time_sec"))
    cuts = firsts.union(ranges.select(key, F.col("end_sec").alias("time_sec"))).select(key, F.bround("time_sec", 2).alias("time_sec")).distinct()
    edge = (F.col("time_sec") <= 0) | (F.col("time_sec") >= F.col("duration_sec"))
    return cuts.join(programs, key).select(key, "time_sec", F.when(edge, 1.0).otherwise(0.72).alias("score"))
