"""Literal cases of the operators, edge cases first, and properties against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import baselines, changes, evaluation, evidence, folds, intervals, joins


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0)).select(expr.alias("x")).first()["x"]


def test_islands_break_at_other_kinds(spans):
    s = spans([(0.0, 10.0, "a"), (12.0, 20.0, "a"), (21.0, 22.0, "b"), (23.0, 30.0, "a")], "start_sec double, end_sec double, kind string")
    assert rows(intervals.merge_islands(s), "start_sec", "end_sec", "kind", "n") == [(0, 20, "a", 2), (21, 22, "b", 1), (23, 30, "a", 1)]


def test_coverage(spans):
    t = spans([(0.0, 100.0), (5.0, 5.0)])
    s = spans([(-10.0, 20.0), (10.0, 30.0), (50.0, 60.0)])
    assert rows(intervals.coverage(t, s), "seq", "coverage") == [(0, 0.4), (1, 0.0)]
    assert rows(intervals.drop_covered(t, s, 0.4), "seq") == [(1,)]


def test_coverage_against_a_grid(spans):
    rng = random.Random(3)
    cs = lambda: tuple(x / 100 for x in sorted(rng.sample(range(0, 2000), 2)))
    topics, segments = [cs() for _ in range(12)], [cs() for _ in range(15)]
    got = dict(rows(intervals.coverage(spans(topics), spans(segments)), "seq", "coverage"))
    for i, (a, b) in enumerate(topics):
        inside = sum(any(s <= x / 100 < e for s, e in segments) for x in range(round(a * 100), round(b * 100)))
        assert abs(got[i] - inside / (round(b * 100) - round(a * 100))) < 1e-9


def test_overlap_and_closed_overlap(spans):
    a, b = spans([(0.0, 10.0)]), spans([(10.0, 20.0)])
    assert joins.overlap_join(a, b).count() == 0
    assert joins.overlap_join(a, b, closed=True).count() == 1
    assert joins.overlap_join(a, b, how="left").count() == 1


def test_overlap_join_against_all_pairs(spans):
    rng = random.Random(4)
    make = lambda n: [(x, x + rng.choice([0.0, 1.0, 70.0, 500.0])) for x in (rng.uniform(0, 2000) for _ in range(n))]
    a, b = make(60), make(50)
    want = sorted((i, j) for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)) if min(x[1], y[1]) > max(x[0], y[0]))
    for width in (7.0, 60.0, 5000.0):
        assert rows(joins.overlap_join(spans(a), spans(b), width), "l_seq", "r_seq") == want


def test_points_in_spans(spans):
    p = spans([(10.0,), (20.0,), (5.0,)], "time_sec double")
    s = spans([(10.0, 20.0)])
    assert rows(joins.points_in_spans(p, s, "left_semi"), "seq") == [(0,)]
    assert rows(joins.points_in_spans(p, s, "left_anti"), "seq") == [(1,), (2,)]
    assert joins.points_in_spans(p, s, include_start=False).count() == 0


def test_nearest_prefers_the_earlier_candidate(spans):
    hint = spans([(100.0,), (500.0,)], "time_sec double")
    cand = spans([(94.0,), (106.0,), (109.0,)], "time_sec double")
    assert rows(joins.snap(hint, cand, 8.0), "seq", "time_sec", "moved") == [(0, 94.0, True), (1, 500.0, False)]


def test_stitch_replaces_and_moves_the_anchor(spans):
    p = spans([(10.0, 1), (20.0, 3), (34.0, 1), (60.0, 2)], "time_sec double, rank int")
    assert rows(folds.stitch(p, 15.0), "time_sec", "rank") == [(20.0, 3), (60.0, 2)]
    q = spans([(0.0, 1), (15.0, 1)], "time_sec double, rank int")
    assert folds.stitch(q, 15.0).count() == 1
    assert folds.keep_strongest(q, 15.0, False).count() == 2


def test_thin_starts_from_zero(spans):
    p = spans([(0.4,), (30.0,), (60.0,), (100.0,), (121.0,)], "time_sec double")
    assert rows(folds.thin(p, 60.0), "time_sec") == [(60.0,), (121.0,)]


def test_insert_cuts(spans):
    out = intervals.insert_cuts(spans([(0.0, 10.0)]), spans([(0.4,), (5.0,), (9.6,)], "time_sec double"))
    assert rows(out, "start_sec", "end_sec", "n_inserted") == [(0, 5, 1), (5, 10, 1)]


def test_merge_short(spans):
    short = spans([(0.0, 1.0), (1.0, 5.0), (5.0, 6.0), (6.0, 9.0)])
    assert rows(folds.merge_short(short), "start_sec", "end_sec") == [(0, 6), (6, 9)]
    assert rows(folds.merge_short(spans([(0.0, 0.5), (0.5, 1.0)])), "start_sec", "end_sec") == [(0, 1)]


def test_force_split(spans):
    assert rows(intervals.force_split(spans([(0.0, 30.0), (30.0, 75.0)])), "start_sec", "end_sec") == [(0, 30), (30, 45), (45, 60), (60, 75)]


def test_add_disjoint_sees_what_it_added(spans):
    kept, more = spans([(0.0, 10.0)]), spans([(9.0, 20.0), (9.5, 12.0), (11.0, 13.0), (30.0, 31.0)])
    assert rows(folds.add_disjoint(kept, more), "start_sec", "added") == [(0.0, False), (9.5, True), (30.0, True)]


def test_normalise_and_whole(spark, spans):
    out = intervals.normalise_ranges(spans([(1000.0, 1010.0), (1010.0, 1200.0), (5.0, 5.0)]), F.lit(100.0))
    assert rows(out, "start_sec", "end_sec") == [(0, 10), (10, 100)]
    programs = spark.createDataFrame([("p", 50.0), ("q", 60.0)], "program_id string, duration_sec double")
    assert rows(intervals.whole_if_none(spans([(0.0, 1.0)]), programs), "program_id", "end_sec") == [("p", 1.0), ("q", 60.0)]


def test_clusters_and_distances(spark, spans):
    p = spark.createDataFrame([("p", i) for i in (3, 5, 9, 10)], "program_id string, seq long")
    assert rows(changes.cluster_firsts(p), "seq") == [(3,), (9,)]
    d = S.text_distance(F.lit("ab"), F.lit("ac"))
    assert one(spark, d) == 0.5 and one(spark, S.text_distance(F.lit(""), F.lit(""))) == 0 and one(spark, S.text_distance(F.lit(""), F.lit("a"))) == 1


def test_isolated_pairs_can_be_suppressed(spans):
    s = spans([(0.1,), (0.6,), (0.65,), (0.1,), (0.9,)], "distance double")
    assert rows(changes.change_points(s, suppress=True), "seq", "kind", "confirmed") == [(1, "high", False), (2, "high", False), (4, "high", True)]


def test_text_functions(spark):
    assert one(spark, S.truncate_text(F.lit("abcdefgh"), 5)) == "abcd..."
    assert one(spark, S.truncate_text(F.lit("　ab  c\n"), 5)) == "ab c"
    assert one(spark, S.compact(F.lit("Ａ Ｂ　c"))) == "abc"
    assert one(spark, S.clock(F.lit(3661.4))) == "1:01:01" and one(spark, S.clock(F.lit(59.6))) == "1:00"
    assert one(spark, S.caption_time(F.lit("0:12:34.56"))) == 754.56
    assert one(spark, S.speaker(F.lit("（司会）こんばんは"))) == "司会" and one(spark, S.without_speaker(F.lit("（司会） こんばんは"))) == "こんばんは"
    assert one(spark, S.without_tags(F.lit(r"{\pos(1,2)} x "))) == "x"
    assert one(spark, S.dedupe(F.array(F.lit(" a"), F.lit("a "), F.lit(""), F.lit("b")), 0)) == ["a"]
    assert one(spark, S.cue(F.lit("このあとは天気です"))["cue_type"]) == "cm_transition"
    assert one(spark, S.cue(F.lit("続いては特集です"))["cue_type"]) == "topic_transition"
    assert one(spark, S.numbered("t", F.lit(1234), 3)) == "t1234" and one(spark, S.scene_of_frame(F.lit("scene_0001_mid"))) == "scene_0001"
    assert abs(one(spark, S.frame_rate(F.lit("30000/1001"))) - 29.97002997) < 1e-6 and one(spark, S.frame_rate(F.lit("0/0"))) == 0
    assert one(spark, S.mid_frame_time(F.lit(0.0), F.lit(10.0), F.lit(4.0))) == 3.5
    assert one(spark, S.logical_duration(F.lit(10.0), F.lit(70.0), F.lit(69.5))) == 60 and one(spark, S.logical_duration(F.lit(10.0), F.lit(71.0), F.lit(69.5))) is None


def test_classification_falls_back(spark):
    words = {"b": ["x", "y"], "a": ["z", "x"]}
    none = F.array().cast("array<string>")
    assert one(spark, evidence.classify(F.lit("X and z, y"), none, words))[:2] == ("a", ["b"])
    assert one(spark, evidence.classify(F.lit("q"), F.array(F.lit("h"), F.lit("i")), words))[:3] == ("h", ["i"], 0.5)
    assert one(spark, evidence.classify(F.lit(""), F.array(F.lit("h")), words))[0] == "society"


def test_window_ids_skip_empty_windows(spark, spans):
    programs = spark.createDataFrame([("p", 180.0)], "program_id string, duration_sec double")
    text = spans([(130.0, 131.0, "hello")], "start_sec double, end_sec double, text string")
    out = evidence.evidence_windows(evidence.evidence_spans(programs), primary=text)
    assert rows(out, "window_id", "start_sec") == [("w0002", 120.0)]


def test_boundaries_join_near_points(spans):
    t = spans([(0.0, 10.0), (10.0, 20.0), (20.3, 30.0)])
    assert [r[0] for r in rows(evaluation.boundaries(t), "time_sec")] == [0, 10, 20, 30]


def test_window_size(spark):
    programs = spark.createDataFrame([("p", 1820.16)], "program_id string, duration_sec double")
    b = spark.createDataFrame([("p", float(i)) for i in range(7)], "program_id string, time_sec double")
    assert evaluation.window_size(programs, b).first()["k"] == 114


def _matches(p, t, tol):
    """The largest matching, over all choices for the first true point."""
    if not t:
        return 0
    near = [y for y in p if abs(y - t[0]) <= tol]
    return max([_matches(p, t[1:], tol), *(1 + _matches([z for z in p if z != y], t[1:], tol) for y in near)])


def test_the_largest_matching_is_not_greedy(spark):
    make = lambda xs: spark.createDataFrame([("p", x) for x in xs], "program_id string, time_sec double")
    assert evaluation.match_counts(make([75.0, 115.0]), make([100.0, 140.0]), 30.0).first()["tp"] == 2
    got = evaluation.match_counts(make([75.0, 115.0, 900.0]), make([100.0]), 30.0).first()
    assert (got["tp"], got["fp"], got["fn"]) == (1, 2, 0)


def _best_total(pairs, used=()):
    if not pairs:
        return 0.0
    (p, t, v), rest = pairs[0], pairs[1:]
    free = ("p", p) not in used and ("t", t) not in used
    return max(_best_total(rest, used), v + _best_total(rest, (*used, ("p", p), ("t", t))) if free else 0.0)


@pytest.mark.parametrize("apart", [True, False])
def test_topic_matching_against_all_choices(apart):
    rng = np.random.default_rng(9)
    for _ in range(200):
        if apart:
            spans = [np.sort(rng.choice(60, 2 * rng.integers(1, 6), replace=False)).reshape(-1, 2) for _ in "pt"]
        else:
            spans = [np.sort(rng.integers(0, 60, (rng.integers(1, 5), 2)), axis=1) for _ in "pt"]
        pairs = [(i, j, (min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))) for i, a in enumerate(spans[0]) for j, b in enumerate(spans[1]) if min(a[1], b[1]) > max(a[0], b[0])]
        pairs.sort(key=lambda x: (max(spans[0][x[0]][0], spans[1][x[1]][0]), min(spans[0][x[0]][1], spans[1][x[1]][1])))
        if pairs:
            p, t, v = (np.array(x) for x in zip(*pairs))
            taken = evaluation.best_matching(p, t, v)
            assert len(set(p[taken])) == len(set(t[taken])) == taken.sum()
            assert abs(v[taken].sum() - _best_total(pairs)) < 1e-9
            assert not apart or evaluation.chain_matching(p, t, v) is not None


def test_match_counts_against_brute_force(spark):
    rng = random.Random(5)
    cases = [(sorted(rng.sample(range(40), rng.randint(1, 5))), sorted(rng.sample(range(40), rng.randint(1, 5)))) for _ in range(30)]
    make = lambda k: spark.createDataFrame([(str(i), float(x)) for i, c in enumerate(cases) for x in c[k]], "program_id string, time_sec double")
    got = dict(rows(evaluation.match_counts(make(0), make(1), 4.0), "program_id", "tp"))
    assert got == {str(i): _matches(p, t, 4.0) for i, (p, t) in enumerate(cases)}


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        v = rng.random((n, m)) * (rng.random((n, m)) < 0.6)
        to = evaluation.assign(v)
        used = [j for j in to if j >= 0]
        assert len(used) == len(set(used)) == min(n, m)
        wide = v if n <= m else v.T
        best = max(sum(wide[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert abs(sum(v[i, j] for i, j in enumerate(to) if j >= 0) - best) < 1e-9


def test_window_metrics_against_labels(spark, spans):
    p, t = [(0.0, 31.0), (31.0, 70.0), (70.0, 100.0)], [(0.0, 30.0), (30.0, 100.0)]
    programs = spark.createDataFrame([("p", 100.0)], "program_id string, duration_sec double")
    got = evaluation.window_metrics(programs, spans(p), spans(t)).first()
    bounds = lambda x: sorted({v for s in x for v in s})
    label = lambda b, u: sum(v <= u + 0.5 for v in b)
    k = round(100 / (len(bounds(t)) + 1) / 2)
    d = [(label(bounds(p), u + k) - label(bounds(p), u), label(bounds(t), u + k) - label(bounds(t), u)) for u in range(100 - k)]
    assert got["k"] == k
    assert abs(got["pk"] - np.mean([(a == 0) != (b == 0) for a, b in d])) < 1e-12
    assert abs(got["window_diff"] - np.mean([a != b for a, b in d])) < 1e-12


def test_bootstrap_repeats_numpy(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "program_id string, m double")
    got = evaluation.bootstrap(df, "program_id", ["m"]).first()
    means = np.array(values)[np.random.default_rng(42).integers(0, 4, (1000, 4))].mean(axis=1)
    index = np.random.default_rng(3).integers(0, 7, (100, 7))
    assert (evaluation.resample(np.arange(7.0)[:, None], 100, np.random.default_rng(3))[:, 0] == np.arange(7.0)[index].mean(axis=1)).all()
    assert abs(got["ci_low"] - np.percentile(means, 2.5)) < 1e-12 and abs(got["ci_high"] - np.percentile(means, 97.5)) < 1e-12


def test_chunks_overlap_and_move_on(spark):
    s = spark.createDataFrame([("p", i, i * 10.0, i * 10.0 + 10, 5) for i in range(10)], "program_id string, seq long, start_sec double, end_sec double, tokens int")
    assert rows(folds.overlapping_chunks(s, 20, 15.0), "chunk", "first", "last") == [(0, 0, 3), (1, 3, 6), (2, 6, 9)]
    assert rows(folds.pack(s, 12), "seq", "batch")[:4] == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_depth_scores(spans, spark):
    g = spark.createDataFrame([("p", i, v) for i, v in enumerate([0.5, 0.9, 0.2, 0.4, 0.8, 0.1])], "program_id string, gap int, similarity double")
    got = dict(rows(baselines.depth_scores(g), "gap", "depth"))
    assert abs(got[2] - (0.7 + 0.6)) < 1e-9 and abs(got[1]) < 1e-9 and abs(got[5] - 0.7) < 1e-9


def test_cohesion_in_chunks_is_the_same(spark):
    rng = random.Random(4)
    texts = spark.createDataFrame([("p", i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 40)))) for i in range(40)], "program_id string, seq long, text string")
    blocks = baselines.token_blocks(texts, 5)
    whole, cut = (dict(rows(baselines.cohesion_gaps(blocks, 3, chunk=k), "gap", "similarity")) for k in (1000, 4))
    assert whole.keys() == cut.keys() and all(abs(whole[g] - cut[g]) < 1e-12 for g in whole) and len(whole) > 20


def test_refine_chain_counts(spark, spans):
    ranges = spans([(0.0, 50.0), (50.0, 51.0), (51.0, 100.0)])
    at = lambda xs: spark.createDataFrame([("p", x) for x in xs], "program_id string, time_sec double")
    out, counts = intervals.refine_ranges(ranges, at([20.0, 50.5, 99.8]), at([20.4, 90.0]))
    assert rows(out, "start_sec", "end_sec") == [(0.0, 20.4), (20.4, 51.0), (51.0, 75.5), (75.5, 100.0)] or rows(out, "start_sec", "end_sec")[0] == (0.0, 20.4)
    got = counts.first().asDict()
    assert (got["n_scenes_in"], got["n_long_scenes"], got["n_second_pass_cuts"], got["n_cuts_snapped"], got["n_cuts_inserted"], got["n_merged"]) == (3, 2, 2, 1, 1, 1)
    assert got["n_scenes_out"] == out.count() == 3 - 1 + 1 + got["n_forced_split_cuts"]


def test_start_end_contrast(spark):
    make = lambda rows_: spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows_)], "program_id string, start_f1 double, end_f1 double")
    got = evaluation.start_end_contrast(make([(0.9, 0.5), (0.8, 0.6)]), make([(0.5, 0.5), (0.6, 0.4)])).first()
    assert got["n"] == 2 and abs(got["start_gain"] - 0.3) < 1e-12 and abs(got["end_gain"] - 0.1) < 1e-12 and abs(got["mean_contrast"] - 0.2) < 1e-12
    assert got["ci_low"] <= 0.2 <= got["ci_high"]


def test_pieces_of_tokens():
    from chronoweave.functions.models import split_by_tokens

    assert split_by_tokens("a\nb", 9, len) == ["a\nb"] and split_by_tokens("", 0, len) == [""]
    assert split_by_tokens("aaa\nbbb\nccccccccc\nd", 8, len) == ["aaa\nbbb", "ccccccccc", "d"]


def test_schema_and_validation(spark, tmp_path):
    from chronoweave.sources import sinks

    t = spark.createDataFrame([("p", "t0", 0.0, 5.0, ["x"]), ("p", "t1", 5.0, 9.0, [])], "program_id string, topic_id string, start_sec double, end_sec double, evidence array<string>")
    made = sinks.response_format("topics", t.schema)["json_schema"]["schema"]
    assert made["required"] == t.columns and made["properties"]["evidence"]["anyOf"][0] == {"type": "array", "items": {"type": "string"}} and made["additionalProperties"] is False
    sinks.write_metadata(t, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).selectExpr("size(topics)").first()[0] == 2
    with pytest.raises(Exception, match="invalid topic"):
        sinks.validated(t.withColumn("end_sec", F.lit(1.0))).collect()


def test_merged_lists_are_one_in_compatibility_form(spark):
    df = spark.createDataFrame([(["Ａ", " b "], ["A", None, "", "ｂ", "c"])], "x array<string>, y array<string>")
    assert df.select(S.merge_lists(F.array("x", "y"), 2).alias("m"), S.merge_lists(F.array("x", "y")).alias("n")).first() == (["A", "b"], ["A", "b", "c"])
    assert spark.range(1).select(S.merge_lists(F.array(F.array().cast("array<string>")))).first()[0] == []


def test_a_non_editorial_span_of_no_length_cuts(spark, spans):
    programs = spark.createDataFrame([("p", 100.0)], "program_id string, duration_sec double")
    cues = spans([(60.0,)], "time_sec double")
    out = evidence.editorial_spans(programs, spans([(20.0, 20.0), (70.0, 80.0), (95.0, 120.0)]), cues)
    assert rows(out, "start_sec", "end_sec", "seq") == [(0.0, 20.0, 0), (20.0, 60.0, 1), (60.0, 70.0, 2), (80.0, 95.0, 3)]


def test_a_share_of_exactly_the_limit_is_covered(spark, spans):
    edges = [(k * 10 + 0.1, k * 10 + 0.1 + 0.02 * n, k * 10 + 0.1 + 0.01 * n) for k, n in ((i, i % 400 + 1) for i in range(400))]
    rounded = [tuple(round(x, 2) for x in e) for e in edges]
    topics, half = spans([e[:2] for e in rounded]), spans([(e[0], e[2]) for e in rounded])
    assert intervals.drop_covered(topics, half, 0.5).count() == 0
    programs = spark.createDataFrame([("p", 5000.0)], "program_id string, duration_sec double")
    kept, _, removed = evidence.finalise(topics.withColumn("topic_id", S.numbered("t", "seq", 3)), half, half.limit(0), programs, 0.5)
    assert kept.count() == 0 and removed.first()["n"] == 400


def test_equal_totals_take_the_earlier_overlaps():
    p, t, v = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([0.25, 0.5, 0.25])
    assert list(evaluation.best_matching(p, t, v)) == [False, True, False]
    p, t, v = np.array([0, 0]), np.array([0, 1]), np.array([0.5, 0.5])
    assert list(evaluation.best_matching(p, t, v)) == [True, False]


def test_topic_matches_in_batches_are_the_same(spark):
    rng = random.Random(11)
    cut = lambda: sorted(rng.sample(range(1, 600), 60))
    chain = lambda: [(str(k), i, float(a), float(b)) for k in range(3) for i, (a, b) in enumerate(itertools.pairwise([0, *cut(), 600]))]
    loose = lambda: [("x", i, float(a), a + rng.uniform(1, 30)) for i, a in enumerate(rng.choices(range(600), k=40))]
    p, t = (spark.createDataFrame([*chain(), *loose()], "program_id string, seq long, start_sec double, end_sec double") for _ in "pt")
    found = evaluation.topic_matches(p, t)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # no task holds a whole program
    whole = rows(found, "program_id", "pred", "true", "iou")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows(evaluation.topic_matches(p, t), "program_id", "pred", "true", "iou") == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in "012x":
        pairs = sorted((r["program_id"], max(r["l_start_sec"], r["r_start_sec"]), min(r["l_end_sec"], r["r_end_sec"]), r["pred"], r["true"], r["iou"]) for r in evaluation.iou_pairs(p, t).where(F.col("program_id") == k).collect())
        _, _, _, i, j, v = (np.array(c) for c in zip(*pairs))
        taken = evaluation.best_matching(i, j, v)
        assert abs(sum(r[3] for r in whole if r[0] == k) - v[taken & (v >= 0.3)].sum()) < 1e-9


def test_chunks_in_batches_are_the_same(spark):
    rng = random.Random(12)
    t = {k: np.cumsum([rng.uniform(0, 12) for _ in range(n)]) for k, n in (("a", 90), ("b", 1), ("c", 200))}
    table = [(k, i, float(x), float(x) + rng.uniform(0, 20), rng.choice([0, 1, 5, 30])) for k, xs in t.items() for i, x in enumerate(xs)]
    s = spark.createDataFrame(table, "program_id string, seq long, start_sec double, end_sec double, tokens int")
    found = folds.overlapping_chunks(s, 20, 15.0)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # no task holds a whole program
    want = []
    for name in t:
        own, i, c = [r for r in table if r[0] == name], 0, 0
        while True:
            j = i + 1
            while j < len(own) and sum(r[4] for r in own[i : j + 1]) <= 20:
                j += 1
            want.append((name, c, i, j - 1, own[i][2], own[j - 1][3]))
            if j >= len(own):
                break
            i, c = min(m for m in range(i + 1, j + 1) if all(own[x][2] > own[j - 1][3] - 15.0 for x in range(m, j))), c + 1
    names = ("program_id", "chunk", "first", "last", "start_sec", "end_sec")
    for size in (10000, 7, 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert rows(folds.overlapping_chunks(s, 20, 15.0), *names) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_against_all_pairs(spark):
    rng = random.Random(13)
    table = lambda n: [(rng.choice("ab"), i, rng.choice([None, *(x / 4 for x in range(-40, 4000))])) for i in range(n)]
    p, c = table(150), [*table(60), *[("b", 1000 + i, 500.0) for i in range(40)], (None, 5, 1.0)]
    make = lambda t: spark.createDataFrame(t, "program_id string, seq long, time_sec double")
    points = make([*p, (None, 999, 1.0)])
    found = joins.nearest(points, make(c), 8.0)
    got = {r["seq"]: (r["near_dt"], r["near_seq"], r["near_time"]) for r in found.collect()}
    for k, i, t in p:
        near = min(((abs(x - t), j, x) for m, j, x in c if m == k and x is not None and abs(x - t) <= 8.0), default=(None, None, None)) if t is not None else (None, None, None)
        assert got[i] == near
    assert got[999] == (None, None, None) and len(got) == found.count() == points.count()
    # no pairs are made
    assert " Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_context_against_all_pairs(spark):
    rng = random.Random(14)
    span = lambda: (lambda a: (a, a + rng.choice([0.0, 3.0, 40.0, 900.0])))(rng.randrange(2000) / 2)
    s = [(rng.choice("ab"), i, *span(), "x") for i in range(80)] + [("c", 0, 1.0, 2.0, "x"), (None, 1, 1.0, 2.0, "x"), ("a", 200, None, None, "x")]
    e = [(rng.choice("ab"), i, *span(), rng.choice([None, f"t{i}"])) for i in range(90)] + [(None, 1, 1.0, 2.0, "n"), ("d", 1, 1.0, 2.0, "d")]
    df = spark.createDataFrame(s, "program_id string, seq long, start_sec double, end_sec double, kind string")
    found = joins.context_text(df, spark.createDataFrame(e, "program_id string, seq long, start_sec double, end_sec double, text string"), 45.0)
    assert found.columns == [*df.columns, "context"]
    want = []
    for k, i, a, b, kind in s:
        near = sorted((x, j, t or "") for m, j, x, y, t in e if k is not None and a is not None and m == k and y >= a - 45 and x <= b + 45)
        want.append((str(k), i, kind, "\n".join(t for _, _, t in near if t) if near else None))
    assert sorted(((str(r["program_id"]), r["seq"], r["kind"], r["context"]) for r in found.collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    # no pairs are made: entries meet bins, and these meet the spans in one step
    assert "FlatMapCoGroups" in found._jdf.queryExecution().toString()


def test_gaps_of_texts_are_those_of_their_blocks(spark):
    rng = random.Random(15)
    words = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    table = [("p", i, words(rng.choice([0, 1, 7, 40, 300]))) for i in range(40)] + [("p", 7, "a b c, D"), ("p", 7, "a b c, D"), ("p", 8, None), ("q", 0, words(31)), ("r", 0, words(29)), (None, 0, words(60))]
    texts = spark.createDataFrame(table, "program_id string, seq long, text string")
    found = {}
    for k in (1000, 4, 1):
        found[k] = rows(baselines.text_gaps(texts, 5, 3, chunk=k), "program_id", "gap", "similarity")
    assert found[1000] == found[4] == found[1] and {r[0] for r in found[4]} == {"p", "q", "r"}
    assert found[4] == rows(baselines.cohesion_gaps(baselines.token_blocks(texts, 5), 3), "program_id", "gap", "similarity")
    lines = {}
    for program, seq, text in sorted((r for r in table if r[0] and r[2]), key=lambda r: r[:2]):
        lines.setdefault(program, []).extend(text.lower().replace(",", "").split())
    assert rows(baselines.token_blocks(texts, 10**6).groupBy("program_id").agg(F.sum("n").alias("n")), "program_id", "n") == sorted((k, len(v)) for k, v in lines.items())
    # a text moves once to its place and once to its chunks, and no row is a word
    plan = baselines.text_gaps(texts, 5, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "RepartitionByExpression" not in plan
