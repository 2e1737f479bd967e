"""Evaluation of segmentations: boundaries, matching, window metrics, error kinds, groups and bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import KEY, overlap_join

#: Metrics for which a smaller value is better.
LOWER_IS_BETTER = ("pk", "window_diff", "onset_mae_sec", "offset_mae_sec", "topic_count_error")


def boundaries(topics: DataFrame, tolerance: float = 0.5, key: str = KEY, edges: tuple[str, ...] = ("start_sec", "end_sec")) -> DataFrame:
    """Distinct starts and ends of each program's topics; points at most tolerance after the one before join it."""
    points = topics.select(key, F.explode(F.array(*edges)).alias("time_sec")).distinct()
    w = Window.partitionBy(key).orderBy("time_sec")
    new = F.coalesce((F.col("time_sec") - F.lag("time_sec").over(w) > tolerance).cast("int"), F.lit(1))
    return points.withColumn("__new", new).where("__new = 1").drop("__new")


def match_counts(predicted: DataFrame, truth: DataFrame, tolerance: float, key: str = KEY, time: str = "time_sec") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of the largest one-to-one matching within the tolerance.

    Of two sorted lists, matching the earliest points that are left whenever they are near enough, and
    passing over the earlier one otherwise, gives the largest matching. A program is first cut where two
    points in a row are further apart than the tolerance, which no match spans, so that each fold is short;
    it carries the points of one side that still wait for a partner.
    """
    each = predicted.select(key, F.col(time).cast("double").alias("x"), F.lit(1).alias("p")).unionAll(truth.select(key, F.col(time).cast("double"), F.lit(0)))
    w = Window.partitionBy(key).orderBy("x", "p")
    new = F.coalesce((F.col("x") - F.lag("x").over(w) > tolerance).cast("int"), F.lit(1))
    islands = each.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = islands.groupBy(key, "__island").agg(F.array_sort(F.collect_list(F.struct("x", "p"))).alias("r"))
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<double>").alias("wait"), F.lit(0).alias("tp"))

    def step(acc: Column, y: Column) -> Column:
        left = F.filter(acc["wait"], lambda x: y["x"] - x <= tolerance)
        meets = (F.size(left) > 0) & (acc["p"] != y["p"])
        wait = F.when(meets, F.slice(left, 2, F.greatest(F.size(left), F.lit(1)))).when(acc["p"] == y["p"], F.array_append(left, y["x"])).otherwise(F.array(y["x"]))
        return F.struct(F.when(meets, acc["p"]).otherwise(y["p"]).alias("p"), wait.alias("wait"), (acc["tp"] + meets.cast("int")).alias("tp"))

    tp = F.aggregate("r", start, step, lambda acc: acc["tp"])
    n_p = F.aggregate("r", F.lit(0), lambda acc, x: acc + x["p"])
    counted = rows.select(key, tp.alias("tp"), n_p.alias("n_p"), F.size("r").alias("n")).groupBy(key).agg(*(F.sum(c).cast("int").alias(c) for c in ("tp", "n_p", "n")))
    return with_rates(counted.select(key, "tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n") - F.col("n_p") - F.col("tp")).alias("fn")))


def with_rates(counts: DataFrame) -> DataFrame:
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def iou_pairs(predicted: DataFrame, truth: DataFrame, key: str = KEY) -> DataFrame:
    """Overlapping pairs of topics with iou; pairs without an overlap have none."""
    met = overlap_join(predicted.select(key, "seq", "start_sec", "end_sec"), truth.select(key, "seq", "start_sec", "end_sec"), key=key, bin_sec=600.0)
    over = F.least("l_end_sec", "r_end_sec") - F.greatest("l_start_sec", "r_start_sec")
    whole = F.greatest("l_end_sec", "r_end_sec") - F.least("l_start_sec", "r_start_sec")
    return met.select(key, F.col("l_seq").alias("pred"), F.col("r_seq").alias("true"), "l_start_sec", "l_end_sec", "r_start_sec", "r_end_sec", over.alias("overlap"), (over / whole).alias("iou"))


def assign(value: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of the largest total value (-1 for none): shortest augmenting paths."""
    rows, cols = value.shape
    if rows > cols:
        back = assign(value.T)
        out = np.full(rows, -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    cost = value.max(initial=0.0) - value
    u, v, owner = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, dtype=int)
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, came, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, dtype=int), np.zeros(cols + 1, dtype=bool)
        while owner[at]:
            done[at] = True
            row, free = owner[at], ~done[1:]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], at
            to = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[to]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            at = to
        while at:
            owner[at], at = owner[came[at]], came[at]
    out = np.full(rows, -1)
    for j in range(1, cols + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _chain(pred: np.ndarray, true: np.ndarray, value: np.ndarray, base: float) -> tuple[np.ndarray, float] | None:
    """Which rows make the matching of the largest total value, and base plus this total; None if the rows aren't a chain."""
    n, first = len(value), []
    for x in (pred, true):
        new = np.concatenate([[True], x[1:] != x[:-1]])
        if len(np.unique(x)) != np.count_nonzero(new):
            return None
        first.append(np.maximum.accumulate(np.where(new, np.arange(n), 0)))
    free, best = np.minimum(*first).tolist(), [base]
    for k, v in enumerate(value.tolist()):
        best.append(max(best[k], v + best[free[k]]))
    out, k = np.zeros(n, dtype=bool), n
    while k:
        if best[k] > best[k - 1]:
            out[k - 1], k = True, free[k - 1]
        else:
            k -= 1
    return out, best[n]


def chain_matching(pred: np.ndarray, true: np.ndarray, value: np.ndarray) -> np.ndarray | None:
    """Which rows make the matching of the largest total value, or None if the rows aren't a chain.

    Rows are overlaps in order of time. They are a chain if all rows of one topic stand together, as they do
    where the topics of neither side overlap each other. Then a row can be taken after the last one that shares
    no topic with it. Of equal totals the one with the earlier rows is taken.
    """
    found = _chain(pred, true, value, 0.0)
    return None if found is None else found[0]


def linked(pred: np.ndarray, true: np.ndarray) -> list[np.ndarray]:
    """Rows of each connected group of overlapping topics, for topics numbered from 0."""
    parent = np.arange(len(np.unique(pred)) + len(np.unique(true)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    shift = len(np.unique(pred))
    for i, j in zip(pred.tolist(), true.tolist()):
        parent[root(i)] = root(shift + j)
    label = np.array([root(i) for i in pred.tolist()])
    order = np.argsort(label, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(label[order])) + 1)


def _best(pred: np.ndarray, true: np.ndarray, value: np.ndarray, base: float) -> tuple[np.ndarray, float]:
    """Which overlaps, in order of time, make the matching of the largest total value, and base plus this total."""
    found = _chain(pred, true, value, base)
    if found is not None:
        return found
    _, pred = np.unique(pred, return_inverse=True)
    _, true = np.unique(true, return_inverse=True)
    out = np.zeros(len(value), dtype=bool)
    for rows in linked(pred, true):
        some = chain_matching(pred[rows], true[rows], value[rows])
        if some is None:
            (p, i), (t, j) = (np.unique(x[rows], return_inverse=True) for x in (pred, true))
            m = np.zeros((len(p), len(t)))
            m[i, j] = value[rows]
            some = assign(m)[i] == j
        out[rows] = some
    return out, base + float(value[out].sum())


def best_matching(pred: np.ndarray, true: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which overlaps, in order of time, make the matching of the largest total value."""
    return _best(pred, true, value, 0.0)[0]


def topic_matches(predicted: DataFrame, truth: DataFrame, least: float = 0.3, key: str = KEY) -> DataFrame:
    """Pairs of the assignment with the largest total IoU, without those below least; errors are predicted - true.

    Overlaps come in order of time, a batch at a time, and are settled where no topic of an earlier one lasts on,
    which no choice spans; the total goes on from there. What is settled at once is solved as a chain in linear time;
    only connected groups of topics that overlap others of their own side need the general assignment.
    """
    edges = ["l_start_sec", "l_end_sec", "r_start_sec", "r_end_sec"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, reach, base, held = None, -np.inf, 0.0, []

        def settled() -> pd.DataFrame:
            nonlocal base
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            taken, base = _best(pdf["pred"].to_numpy(), pdf["true"].to_numpy(), pdf["iou"].to_numpy(), base)
            out = pdf[taken & (pdf["iou"].to_numpy() >= max(least, 1e-300))].copy()
            out["onset_error"], out["offset_error"] = out["l_start_sec"] - out["r_start_sec"], out["l_end_sec"] - out["r_end_sec"]
            return out[[key, "pred", "true", "iou", "onset_error", "offset_error"]]

        for batch in batches:
            names = batch[key].to_numpy()
            for pdf in np.split(np.arange(len(batch)), np.flatnonzero(names[1:] != names[:-1]) + 1):
                pdf = batch.iloc[pdf]
                if not len(pdf):
                    continue
                if pdf[key].iloc[0] != program:
                    if held:
                        yield settled()
                    program, reach, base = pdf[key].iloc[0], -np.inf, 0.0
                lasts = np.maximum.accumulate(np.concatenate([[reach], np.maximum(pdf["l_end_sec"], pdf["r_end_sec"])]))
                cuts, reach = np.flatnonzero(np.maximum(pdf["l_start_sec"], pdf["r_start_sec"]).to_numpy() >= lasts[:-1]), lasts[-1]
                at = int(cuts[-1]) if len(cuts) else 0
                if len(cuts) and (at or held):
                    held.append(pdf.iloc[:at])
                    yield settled()
                held.append(pdf.iloc[at:])
        if held:
            yield settled()

    pairs = iou_pairs(predicted, truth, key).select(key, F.col("pred").cast("long").alias("pred"), F.col("true").cast("long").alias("true"), "iou", *edges)
    in_time = pairs.repartition(key).sortWithinPartitions(key, F.greatest("l_start_sec", "r_start_sec"), F.least("l_end_sec", "r_end_sec"), "pred", "true")
    return in_time.mapInPandas(run, f"{key} string, pred long, true long, iou double, onset_error double, offset_error double")


def match_summary(predicted: DataFrame, truth: DataFrame, matches: DataFrame, key: str = KEY) -> DataFrame:
    """Counts, topic_count_error, match_rate, mean_iou_matched and the mean absolute onset and offset errors."""
    n = truth.groupBy(key).agg(F.count("*").alias("n_ground_truth")).join(predicted.groupBy(key).agg(F.count("*").alias("n_prediction")), key, "full").na.fill(0)
    m = matches.groupBy(key).agg(F.count("*").alias("n_matched"), F.avg("iou").alias("mean_iou_matched"), F.avg(F.abs("onset_error")).alias("onset_mae_sec"), F.avg(F.abs("offset_error")).alias("offset_mae_sec"))
    out = n.join(m, key, "left").na.fill(0, ["n_matched"])
    return out.withColumns({"topic_count_error": F.abs(F.col("n_prediction") - F.col("n_ground_truth")), "match_rate": F.when(F.col("n_ground_truth") > 0, F.col("n_matched") / F.col("n_ground_truth")).otherwise(0.0)})


def window_size(programs: DataFrame, truth_boundaries: DataFrame, key: str = KEY) -> DataFrame:
    """programs with n (frames of a second) and k, half the mean distance between boundaries."""
    count = truth_boundaries.groupBy(key).agg(F.count("*").alias("__b"))
    out = programs.join(count, key, "left")
    k = F.bround(F.col("duration_sec") / (F.coalesce("__b", F.lit(0)) + 1) / 2.0, 0).cast("int")
    return out.withColumns({"n": F.bround("duration_sec", 0).cast("int"), "k": k}).drop("__b")


def window_metrics(programs: DataFrame, predicted: DataFrame, truth: DataFrame, tolerance: float = 0.5, key: str = KEY) -> DataFrame:
    """k, pk and window_diff of each program.

    Frame t has as label the number of boundaries up to t + 0.5. The number of boundaries in (t, t + k]
    is a sum over those boundaries' own frames, so boundaries are spread over the windows that they lie
    in, not windows over boundaries.
    """
    p, t = boundaries(predicted, tolerance, key), boundaries(truth, tolerance, key)
    size = window_size(programs, t, key)

    def counted(b: DataFrame, name: str) -> DataFrame:
        frame = F.greatest(F.ceil(F.col("time_sec") - 0.5), F.lit(0)).cast("int")
        inside = b.join(size, key).withColumn("__f", frame)
        first, last = F.greatest(F.col("__f") - F.col("k"), F.lit(0)), F.least(F.col("__f") - 1, F.col("n") - F.col("k") - 1)
        return inside.where(last >= first).select(key, F.explode(F.sequence(first, last)).alias("__t")).groupBy(key, "__t").agg(F.count("*").alias(name))

    met = counted(p, "dp").join(counted(t, "dt"), [key, "__t"], "full").na.fill(0, ["dp", "dt"])
    wrong = met.groupBy(key).agg(F.sum(((F.col("dp") == 0) != (F.col("dt") == 0)).cast("int")).alias("a"), F.sum((F.col("dp") != F.col("dt")).cast("int")).alias("b"))
    out = size.join(wrong, key, "left").na.fill(0, ["a", "b"])
    frames = F.col("n") - F.col("k")
    share = lambda c: F.when(frames > 0, F.col(c) / frames).otherwise(0.0)
    return out.select(key, "k", share("a").alias("pk"), share("b").alias("window_diff"))


def splits(predicted: DataFrame, truth: DataFrame, share: float = 0.5, key: str = KEY) -> DataFrame:
    """over_split and under_split errors with the topics involved, as sorted lists of seq."""
    pairs = iou_pairs(predicted, truth, key)
    ids = lambda c: F.array_sort(F.collect_list(c))
    part = pairs.where(F.col("overlap") / (F.col("l_end_sec") - F.col("l_start_sec")) >= share)
    over = part.groupBy(key, "true").agg(ids("pred").alias("predictions")).where(F.size("predictions") >= 2).select(key, F.lit("over_split").alias("kind"), "predictions", F.array("true").alias("truths"))
    part = pairs.where(F.col("overlap") / (F.col("r_end_sec") - F.col("r_start_sec")) >= share)
    under = part.groupBy(key, "pred").agg(ids("true").alias("truths")).where(F.size("truths") >= 2).select(key, F.lit("under_split").alias("kind"), F.array("pred").alias("predictions"), "truths")
    return over.union(under)


def other_errors(predicted: DataFrame, truth: DataFrame, matches: DataFrame, split: DataFrame, phase: float = 0.1, key: str = KEY) -> DataFrame:
    """phase_shifted, hallucinated and missed topics among those that neither a match nor a split explains."""
    used = lambda c, m, s: m.select(key, F.col(c).alias("seq")).union(s.select(key, F.explode("predictions" if c == "pred" else "truths")))
    p = predicted.join(used("pred", matches, split), [key, "seq"], "left_anti")
    t = truth.join(used("true", matches, split), [key, "seq"], "left_anti")
    shifted = iou_pairs(p, t, key).where(F.col("iou") >= phase)
    none = F.array().cast("array<bigint>")
    lone = lambda df, c: df.join(shifted.select(key, F.col(c).alias("seq")), [key, "seq"], "left_anti")
    a = shifted.select(key, F.lit("phase_shifted").alias("kind"), F.array(F.col("pred").cast("long")).alias("predictions"), F.array(F.col("true").cast("long")).alias("truths"))
    b = lone(p, "pred").select(key, F.lit("hallucinated"), F.array(F.col("seq").cast("long")), none)
    c = lone(t, "true").select(key, F.lit("missed"), none, F.array(F.col("seq").cast("long")))
    return a.union(b).union(c)


def chapter_topics(chapters: DataFrame, key: str = KEY) -> DataFrame:
    """Topics of a map from HH:MM:SS to title: each ends where the next begins, the last at duration_sec."""
    each = chapters.select(key, "duration_sec", F.explode("chapters").alias("at", "label"))
    p = F.split("at", ":")
    start = (F.get(p, F.lit(0)).cast("int") * 3600 + F.get(p, F.lit(1)).cast("int") * 60 + F.get(p, F.lit(2)).cast("int")).cast("double")
    w = Window.partitionBy(key).orderBy("start_sec")
    return each.withColumn("start_sec", start).select(key, (F.row_number().over(w) - 1).cast("long").alias("seq"), "start_sec", F.coalesce(F.lead("start_sec").over(w), "duration_sec").alias("end_sec"), "label")


def grouped(rows: DataFrame, metrics: list[str], group: str) -> DataFrame:
    """grp, metric, n, mean, sd of every metric over all rows and over each group, by grouping sets."""
    each = rows.select(group, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select(group, "x.metric", "x.v")
    sets = each.groupingSets([[F.col("metric")], [F.col("metric"), F.col(group)]], F.col("metric"), F.col(group))
    out = sets.agg(F.grouping(group).alias("g"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col(group).cast("string")).alias("grp"), "metric", "n", "mean", "sd")


def five_numbers(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, min, exact median, max and mean of each group."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def wins(rows: DataFrame, metric: Column, a: Column, b: Column, by: list[Column]) -> DataFrame:
    """How often a is better than b, equal, or worse; for some metrics the smaller value is better."""
    sign = F.when(metric.isin(*LOWER_IS_BETTER), -1).otherwise(1) * F.signum(a - b)
    return rows.groupBy(*by).agg(F.sum((sign > 0).cast("int")).alias("wins"), F.sum((sign == 0).cast("int")).alias("ties"), F.sum((sign < 0).cast("int")).alias("losses"), F.avg(a - b).alias("mean_difference"))


def nearest_recall(truth: DataFrame, predicted: DataFrame, tolerances: tuple[float, ...] = (5.0, 30.0), kind: str = "kind", key: str = KEY) -> DataFrame:
    """By kind of true boundary: n, the share with a prediction within each tolerance, the median distance to the nearest."""
    each = predicted.select(key, "time_sec", F.lit(0).alias("side"), F.lit(None).cast("string").alias(kind)).union(truth.select(key, "time_sec", F.lit(1), F.col(kind)))
    up = Window.partitionBy(key).orderBy("time_sec", "side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("time_sec"), "side").rowsBetween(Window.unboundedPreceding, 0)
    p = F.when(F.col("side") == 0, F.col("time_sec"))
    d = F.least(F.col("time_sec") - F.last(p, True).over(up), F.last(p, True).over(down) - F.col("time_sec"))
    met = each.withColumn("d", d).where("side = 1")
    hits = [F.avg(F.coalesce(F.col("d") <= t, F.lit(False)).cast("double")).alias(f"recall_{int(t)}") for t in tolerances]
    return met.groupBy(kind).agg(F.count("*").alias("n"), *hits, F.expr("percentile(d, 0.5)").alias("median_error"))


def boundary_kind(notes: Column) -> Column:
    """The boundary type that annotators put into their notes in square brackets."""
    found = F.regexp_extract(notes, r"\[境界タイプ[:：]\s*([^\]]+)\]", 1)
    return F.when(found != "", F.trim(found))


#: Rows of evaluation results (programs) that one set of draws may be over; its values go through one task.
MOST_ROWS = 1_000_000


def resample(values: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """The mean of each column of values in each draw of as many rows with replacement.

    The draws are rows of rng.integers(0, n, (draws, n)), made some at a time, which gives the same numbers.
    """
    n = len(values)
    some = max(1, 4_000_000 // n)
    return np.concatenate([values[rng.integers(0, n, (min(some, draws - lo), n))].mean(axis=1) for lo in range(0, draws, some)])


def bootstrap(rows: DataFrame, order: str, values: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """metric, n, mean, ci_low, ci_high: percentile intervals of the means over draws with replacement.

    All metrics share the draws. Rows are results of programs, at most MOST_ROWS of them, and fit one task.
    """
    return interval_table(rows, order, values, [None], draws, seed, shared=True).drop("grp")


def interval_table(rows: DataFrame, order: str, values: list[str], groups: list[str | None], draws: int = 1000, seed: int = 42, shared: bool = False, by: str | None = None) -> DataFrame:
    """grp, metric, n, mean, sd, ci_low, ci_high for each of groups (None: all rows) and each metric.

    One generator goes through the groups and metrics in their order; with shared, all metrics of a group
    take the same draws. Rows are taken in order of `order`. Nulls aren't counted.
    """
    schema = "grp string, metric string, n long, mean double, sd double, ci_low double, ci_high double"
    slim = rows.select(F.col(order).alias("__o"), *(F.col(v).cast("double").alias(v) for v in values), *([F.col(by).cast("string").alias("__g")] if by else []))

    def run(batches):
        pdf = pd.concat(list(batches), ignore_index=True) if batches else None
        if pdf is None or not len(pdf):
            return
        if len(pdf) > MOST_ROWS:
            raise ValueError(f"{len(pdf)} rows to draw from; at most {MOST_ROWS}")
        pdf, rng, out = pdf.sort_values("__o", kind="stable"), np.random.default_rng(seed), []
        for g in groups:
            some = pdf if g is None else pdf[pdf["__g"] == g]
            if not len(some):
                continue
            if shared:
                rng = np.random.default_rng(seed)
            means = resample(some[values].to_numpy(), draws, rng) if shared else None
            for i, v in enumerate(values):
                x = some[v].dropna().to_numpy()
                if not len(x):
                    continue
                low, high = np.percentile(means[:, i] if shared else resample(x[:, None], draws, rng)[:, 0], [2.5, 97.5])
                out.append(("all" if g is None else g, v, len(x), x.mean(), x.std(ddof=1) if len(x) > 1 else None, low, high))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return slim.coalesce(1).mapInPandas(run, schema)


def start_end_scores(predicted: DataFrame, truth: DataFrame, tolerance: float, key: str = KEY) -> DataFrame:
    """key, start_f1, end_f1: the largest matching of starts only and of ends only."""
    one = lambda edge, name: match_counts(*(boundaries(x, key=key, edges=(edge,)) for x in (predicted, truth)), tolerance, key).select(key, F.col("f1").alias(name))
    return one("start_sec", "start_f1").join(one("end_sec", "end_f1"), key, "full").na.fill(0.0)


def start_end_contrast(reference: DataFrame, other: DataFrame, key: str = KEY, draws: int = 1000, seed: int = 42) -> DataFrame:
    """n, start_gain, end_gain, mean_contrast, ci_low, ci_high of the paired difference of the two gains.

    reference and other: scores of two conditions as from start_end_scores(); only common programs count.
    """
    a, b = reference.select(key, F.col("start_f1").alias("__s"), F.col("end_f1").alias("__e")), other.select(key, "start_f1", "end_f1")
    gains = a.join(b, key).select(key, (F.col("__s") - F.col("start_f1")).alias("start_gain"), (F.col("__e") - F.col("end_f1")).alias("end_gain"))
    table = bootstrap(gains.withColumn("contrast", F.col("start_gain") - F.col("end_gain")), key, ["start_gain", "end_gain", "contrast"], draws, seed)
    of = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    return table.agg(
        of("contrast", "n").alias("n"), of("start_gain", "mean").alias("start_gain"), of("end_gain", "mean").alias("end_gain"), of("contrast", "mean").alias("mean_contrast"),
        of("contrast", "ci_low").alias("ci_low"), of("contrast", "ci_high").alias("ci_high"),
    )


def summary(programs: DataFrame, predicted: DataFrame, truth: DataFrame, tolerances: tuple[float, ...] = (5.0, 30.0), key: str = KEY) -> DataFrame:
    """One row a program with the metrics of matching, boundaries (bf1_<tolerance>) and windows."""
    out = match_summary(predicted, truth, topic_matches(predicted, truth, key=key), key)
    p, t = boundaries(predicted, key=key), boundaries(truth, key=key)
    for tol in tolerances:
        out = out.join(match_counts(p, t, tol, key).select(key, F.col("f1").alias(f"bf1_{tol:g}".replace(".", "_"))), key, "left")
    out = out.join(window_metrics(programs, predicted, truth, key=key), key, "left")
    names = ["n_ground_truth", "n_prediction", "topic_count_error", "match_rate", "mean_iou_matched", "onset_mae_sec", "offset_mae_sec"]
    return out.select(key, *names, *(f"bf1_{tol:g}".replace(".", "_") for tol in tolerances), "pk", "window_diff")


def tiou_scores(predicted: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9), key: str = KEY) -> DataFrame:
    """Per program and threshold: precision and recall of topics whose best temporal IoU reaches it."""
    pairs = iou_pairs(predicted, truth, key)
    best = lambda side, df, name: df.select(key, "seq").join(pairs.groupBy(key, F.col(side).alias("seq")).agg(F.max("iou").alias("iou")), [key, "seq"], "left").groupBy(key).agg(*(F.avg((F.coalesce("iou", F.lit(0.0)) >= t).cast("double")).alias(f"{name}_{t}") for t in thresholds))
    met = best("pred", predicted, "p").join(best("true", truth, "r"), key, "full")
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.coalesce(F.col(f"`p_{t}`"), F.lit(0.0)).alias("precision"), F.coalesce(F.col(f"`r_{t}`"), F.lit(0.0)).alias("recall")) for t in thresholds))).alias("x")
    return met.select(key, rows).select(key, "x.*").withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
