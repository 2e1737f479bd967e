"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import baselines, changes, evaluation, evidence, folds, intervals, joins
from . import roles as R
from .roles import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["x04_heuristic_topics"](spark, sf_dir)


def _listed(column):
    return F.array_join(column.cast("array<string>"), ",")


# Joins

_GRID = "grid AS (SELECT program_id, CAST(k AS BIGINT) AS seq, k * 60.0::DOUBLE AS start_sec, (k + 1) * 60.0::DOUBLE AS end_sec FROM prog, range(1440) t(k))"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.cuts_to_spans(evidence.grid(R.programs(spark, sf_dir)))


@query("j01_overlap_windows", sql("""
    SELECT g.program_id, g.seq AS win, count(*) AS n, array_to_string(list_slice(list(s.seq ORDER BY s.seq), 1, 3), ',') AS first_three
    FROM grid g JOIN seg s ON g.program_id = s.program_id AND least(g.end_sec, s.end_sec) > greatest(g.start_sec, s.start_sec) GROUP BY 1, 2""", _GRID))
def j01(spark, sf_dir):
    met = joins.overlap_join(_windows(spark, sf_dir), R.segments(spark, sf_dir))
    return met.groupBy("program_id", F.col("l_seq").alias("win")).agg(F.count("*").alias("n"), _listed(F.slice(F.array_sort(F.collect_list("r_seq")), 1, 3)).alias("first_three"))


@query("j03_kinds_per_window", sql("""
    SELECT program_id, win, string_agg(kind, ',' ORDER BY first) AS kinds FROM (
        SELECT g.program_id, g.seq AS win, n.kind, min(n.seq) AS first FROM grid g JOIN ne n
        ON g.program_id = n.program_id AND least(g.end_sec, n.end_sec) > greatest(g.start_sec, n.start_sec) GROUP BY 1, 2, 3) GROUP BY 1, 2""", _GRID))
def j03(spark, sf_dir):
    found = evidence.collect_in(_windows(spark, sf_dir), R.non_editorial(spark, sf_dir), F.col("r_kind"), "kinds", 6)
    return found.select("program_id", F.col("seq").alias("win"), F.array_join("kinds", ",").alias("kinds"))


@query("j04_cuts_in_long_ranges", sql("""
    SELECT program_id, seq, time_sec FROM click c WHERE EXISTS (SELECT 1 FROM rng r WHERE r.program_id = c.program_id AND r.end_sec - r.start_sec > 1200 AND c.time_sec > r.start_sec AND c.time_sec < r.end_sec)"""))
def j04(spark, sf_dir):
    long = R.ranges(spark, sf_dir).where("end_sec - start_sec > 1200")
    return joins.points_in_spans(R.points(spark, sf_dir, "click"), long, "left_semi", include_start=False, bin_sec=900.0).select("program_id", "seq", "time_sec")


@query("j05_point_anti", sql("""
    SELECT program_id, seq, time_sec FROM click c WHERE NOT EXISTS (SELECT 1 FROM ne n WHERE n.program_id = c.program_id AND c.time_sec >= n.start_sec AND c.time_sec < n.end_sec)"""))
def j05(spark, sf_dir):
    return joins.points_in_spans(R.points(spark, sf_dir, "click"), R.non_editorial(spark, sf_dir), "left_anti").select("program_id", "seq", "time_sec")


@query("j06_middle_anti", sql("""
    SELECT program_id, seq FROM seg s WHERE label = 'view' AND NOT EXISTS (
        SELECT 1 FROM ne n WHERE n.program_id = s.program_id AND (s.start_sec + s.end_sec) / 2.0 >= n.start_sec AND (s.start_sec + s.end_sec) / 2.0 < n.end_sec)"""))
def j06(spark, sf_dir):
    s = R.segments(spark, sf_dir).where("label = 'view'").withColumn("mid", (F.col("start_sec") + F.col("end_sec")) / 2.0)
    return joins.points_in_spans(s, R.non_editorial(spark, sf_dir), "left_anti", time="mid").select("program_id", "seq")


@query("j07_points_by_scene", sql("""
    SELECT r.program_id, r.seq, count(c.seq) AS n, coalesce(min(c.time_sec), -1) AS first, coalesce(max(c.time_sec), -1) AS last
    FROM rng r LEFT JOIN click c ON c.program_id = r.program_id AND c.time_sec > r.start_sec AND c.time_sec < r.end_sec GROUP BY 1, 2"""))
def j07(spark, sf_dir):
    out = intervals.points_by_span(R.ranges(spark, sf_dir), R.points(spark, sf_dir, "click"))
    return out.select("program_id", "seq", F.size("points").cast("long").alias("n"), F.coalesce(F.array_min("points"), F.lit(-1.0)).alias("first"), F.coalesce(F.array_max("points"), F.lit(-1.0)).alias("last"))


_NEAREST = """
    SELECT c.program_id, c.seq, coalesce(arg_min(b.time_sec, (abs(b.time_sec - c.time_sec), b.seq)), c.time_sec) AS time_sec, coalesce(arg_min(b.seq, (abs(b.time_sec - c.time_sec), b.seq)), -1) AS near_seq
    FROM click c LEFT JOIN buy b ON b.program_id = c.program_id AND abs(b.time_sec - c.time_sec) <= {tolerance} GROUP BY c.program_id, c.seq, c.time_sec"""


@query("j08_nearest_snap", sql(_NEAREST.format(tolerance=120)))
def j08(spark, sf_dir):
    return joins.snap(R.points(spark, sf_dir, "click"), R.points(spark, sf_dir, "purchase"), 120.0).select("program_id", "seq", "time_sec", F.coalesce("near_seq", F.lit(-1)).alias("near_seq"))


@query("j09_snap_distinct", sql(f"""
    SELECT program_id, count(DISTINCT time_sec) AS n_times, count(*) FILTER (WHERE time_sec <> raw) AS n_moved
    FROM (SELECT s.*, k.time_sec AS raw FROM ({_NEAREST.format(tolerance=60)}) s JOIN click k USING (program_id, seq)) GROUP BY 1"""))
def j09(spark, sf_dir):
    out = joins.snap(R.points(spark, sf_dir, "click"), R.points(spark, sf_dir, "purchase"), 60.0)
    return out.groupBy("program_id").agg(F.count_distinct("time_sec").alias("n_times"), F.sum(F.col("moved").cast("long")).alias("n_moved"))


@query("j10_context", sql("""
    SELECT a.program_id, a.seq, string_agg(CAST(b.seq AS VARCHAR), chr(10) ORDER BY b.start_sec, b.seq) AS context
    FROM ne a LEFT JOIN seg b ON a.program_id = b.program_id AND b.label = 'view' AND b.end_sec >= a.start_sec - 45 AND b.start_sec <= a.end_sec + 45 GROUP BY 1, 2"""))
def j10(spark, sf_dir):
    views = R.segments(spark, sf_dir).where("label = 'view'").select("program_id", "seq", "start_sec", "end_sec", F.col("seq").cast("string").alias("text"))
    return joins.context_text(R.non_editorial(spark, sf_dir), views).select("program_id", "seq", "context")


@query("j12_paths_of_frames", sql("""
    SELECT r.program_id, r.seq, string_agg(s.label || '/' || CAST(s.seq AS VARCHAR), ';' ORDER BY s.seq) AS paths
    FROM rng r JOIN seg s ON s.program_id = r.program_id AND s.start_sec > r.start_sec AND s.start_sec < r.end_sec AND s.label = 'error' GROUP BY 1, 2"""))
def j12(spark, sf_dir):
    """Ids kept in a list per scene, exploded and looked up again."""
    errors = R.points(spark, sf_dir, "error")
    inside = joins.points_in_spans(errors, R.ranges(spark, sf_dir), include_start=False)
    lists = inside.groupBy("program_id", F.col("r_seq").alias("seq")).agg(F.array_sort(F.collect_list("seq")).alias("ids"))
    paths = R.segments(spark, sf_dir).select(F.col("seq").alias("id"), F.concat_ws("/", "label", F.col("seq").cast("string")).alias("path"))
    met = lists.select("program_id", "seq", F.explode("ids").alias("id")).join(paths, "id")
    return met.groupBy("program_id", "seq").agg(F.array_join(S.ordered(F.col("path"), "id"), ";").alias("paths"))


@query("j11_restore_times", sql("SELECT h.program_id, h.seq, s.start_sec, s.end_sec FROM hint h JOIN seg s USING (program_id, seq) WHERE h.rank = 3"))
def j11(spark, sf_dir):
    rows = R.hints(spark, sf_dir).where("rank = 3").select("program_id", F.col("seq").alias("id"))
    return joins.by_id(rows, R.segments(spark, sf_dir).select(F.col("seq").alias("id"), "start_sec", "end_sec")).select("program_id", F.col("id").alias("seq"), "start_sec", "end_sec")


@query("j14_positional_pairs", sql("""
    SELECT r.program_id, r.seq, coalesce(c.seq, -1) AS other FROM rng r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 AS i FROM click) c ON r.program_id = c.program_id AND r.seq = c.i"""))
def j14(spark, sf_dir):
    out = joins.pair_by_position(R.ranges(spark, sf_dir), R.points(spark, sf_dir, "click"))
    return out.select("program_id", "seq", F.coalesce("r_seq", F.lit(-1)).alias("other"))


# Intervals

_ISLANDS = """
    runs AS (SELECT *, sum(changed) OVER (PARTITION BY program_id ORDER BY start_sec, end_sec, kind ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY program_id ORDER BY start_sec, end_sec, kind) = kind THEN 0 ELSE 1 END AS changed FROM ne)),
    isl AS (SELECT *, sum(fresh) OVER (PARTITION BY program_id, run ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN start_sec <= max(end_sec) OVER (PARTITION BY program_id, run ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS fresh FROM runs)),
    merged AS (SELECT program_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, any_value(kind) AS kind, count(*) AS n FROM isl GROUP BY program_id, run, island)"""


@query("g01_merge_islands", sql("SELECT * FROM merged", _ISLANDS))
def g01(spark, sf_dir):
    return intervals.merge_islands(R.non_editorial(spark, sf_dir))


_COVERAGE = """
    cut AS (SELECT t.program_id, t.seq, greatest(t.start_sec, n.start_sec) AS s, least(t.end_sec, n.end_sec) AS e FROM pred t JOIN ne n
        ON t.program_id = n.program_id AND least(t.end_sec, n.end_sec) > greatest(t.start_sec, n.start_sec)),
    fresh AS (SELECT program_id, seq, greatest(0.0::DOUBLE, e - greatest(s, coalesce(max(e) OVER (PARTITION BY program_id, seq ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s))) AS f FROM cut),
    cov AS (SELECT p.program_id, p.seq, p.start_sec, p.end_sec, round_even(coalesce(sum(f), 0) / (p.end_sec - p.start_sec), 6) AS coverage FROM pred p LEFT JOIN fresh USING (program_id, seq)
        WHERE p.end_sec > p.start_sec GROUP BY p.program_id, p.seq, p.start_sec, p.end_sec)"""


@query("a03_union_coverage", sql("SELECT program_id, seq, coverage FROM cov", _COVERAGE))
def a03(spark, sf_dir):
    out = intervals.coverage(R.topics(spark, sf_dir, 1), R.non_editorial(spark, sf_dir)).where("end_sec > start_sec")
    return out.select("program_id", "seq", F.bround("coverage", 6).alias("coverage"))


@query("i15_drop_covered", sql("SELECT program_id, seq FROM cov WHERE coverage < 0.7", _COVERAGE))
def i15(spark, sf_dir):
    topics = R.topics(spark, sf_dir, 1).where("end_sec > start_sec")
    return intervals.drop_covered(topics, R.non_editorial(spark, sf_dir), 0.7).select("program_id", "seq")


@query("f18_clip", sql("""
    SELECT program_id, seq, greatest(0, least(start_sec, 43200.0::DOUBLE)) AS start_sec, greatest(0, least(end_sec, 43200.0::DOUBLE)) AS end_sec FROM seg
    WHERE greatest(0, least(end_sec, 43200)) > greatest(0, least(start_sec, 43200))"""))
def f18(spark, sf_dir):
    return intervals.clip(R.segments(spark, sf_dir), 0.0, 43200.0).select("program_id", "seq", "start_sec", "end_sec")


@query("i02_clip_and_shift", sql("""
    SELECT program_id, seq, greatest(least(start_sec, 7200.0::DOUBLE), 3600) - 3600 AS start_sec, greatest(least(end_sec, 7200.0::DOUBLE), 3600) - 3600 AS end_sec FROM rng
    WHERE greatest(least(end_sec, 7200), 3600) > greatest(least(start_sec, 7200), 3600)"""))
def i02(spark, sf_dir):
    return intervals.clip(R.ranges(spark, sf_dir), 3600.0, 7200.0, shift=True)


@query("i01_normalise_ranges", sql("""
    SELECT program_id, seq, s AS start_sec, e AS end_sec FROM (
        SELECT program_id, seq, round_even(greatest(0, least(start_sec - o, 43200.0::DOUBLE)), 2) AS s, round_even(greatest(0, least(end_sec - o, 43200.0::DOUBLE)), 2) AS e FROM (
            SELECT *, CASE WHEN min(start_sec) OVER w > 43200 OR max(end_sec) OVER w > 43205 THEN first_value(start_sec) OVER (PARTITION BY program_id ORDER BY seq) ELSE 0 END AS o
            FROM seg WHERE end_sec > start_sec WINDOW w AS (PARTITION BY program_id))) WHERE e > s"""))
def i01(spark, sf_dir):
    return intervals.normalise_ranges(R.segments(spark, sf_dir).select("program_id", "seq", "start_sec", "end_sec"), F.lit(43200.0))


_INSERT = """
    ins AS (SELECT r.program_id, r.seq, c.time_sec FROM rng r JOIN (SELECT DISTINCT program_id, time_sec FROM click) c
        ON c.program_id = r.program_id AND c.time_sec > r.start_sec + 0.5 AND c.time_sec < r.end_sec - 0.5),
    parts AS (SELECT program_id, seq, a AS start_sec, lead(a) OVER (PARTITION BY program_id, seq ORDER BY a) AS end_sec FROM (
        SELECT program_id, seq, start_sec AS a FROM rng UNION ALL SELECT program_id, seq, end_sec FROM rng UNION ALL SELECT program_id, seq, time_sec FROM ins))"""


@query("i07_insert_cuts", sql("SELECT program_id, seq, start_sec, end_sec FROM parts WHERE end_sec IS NOT NULL", _INSERT))
def i07(spark, sf_dir):
    return intervals.insert_cuts(R.ranges(spark, sf_dir), R.points(spark, sf_dir, "click")).select("program_id", "seq", "start_sec", "end_sec")


@query("i06_split_long", sql("""
    SELECT program_id, seq AS origin, a AS start_sec, b AS end_sec, row_number() OVER (PARTITION BY program_id, seq ORDER BY a) - 1 AS part, n > 0 AS is_part FROM (
        SELECT *, lead(a) OVER (PARTITION BY program_id, seq ORDER BY a) AS b, count(*) OVER (PARTITION BY program_id, seq) - 2 AS n FROM (
            SELECT program_id, seq, start_sec AS a FROM rng UNION ALL SELECT program_id, seq, end_sec FROM rng UNION ALL
            SELECT r.program_id, r.seq, c.time_sec FROM rng r JOIN (SELECT DISTINCT program_id, time_sec FROM click) c ON c.program_id = r.program_id AND c.time_sec > r.start_sec AND c.time_sec < r.end_sec
            WHERE r.end_sec - r.start_sec >= 600)) WHERE b IS NOT NULL"""))
def i06(spark, sf_dir):
    out = intervals.split_long_at(R.ranges(spark, sf_dir), R.points(spark, sf_dir, "click"), 600.0)
    return out.select("program_id", "origin", "start_sec", "end_sec", F.col("part").cast("long").alias("part"), "is_part")


@query("i09_force_split", sql("""
    SELECT program_id, seq, start_sec + (end_sec - start_sec) * p / n AS start_sec, CASE WHEN p + 1 = n THEN end_sec ELSE start_sec + (end_sec - start_sec) * (p + 1) / n END AS end_sec
    FROM (SELECT *, CASE WHEN end_sec - start_sec > 300 THEN CAST(ceil((end_sec - start_sec) / 200.0::DOUBLE) AS INT) ELSE 1 END AS n FROM rng) r, LATERAL (SELECT unnest(range(n)) AS p)"""))
def i09(spark, sf_dir):
    return intervals.force_split(R.ranges(spark, sf_dir), 300.0, 200.0).select("program_id", "seq", "start_sec", "end_sec")


@query("i10_round_bounds", sql("SELECT program_id, seq, round_even(start_sec, 1) AS start_sec, round_even(end_sec, 1) AS end_sec FROM rng WHERE round_even(end_sec, 1) > round_even(start_sec, 1)"))
def i10(spark, sf_dir):
    return intervals.round_bounds(R.ranges(spark, sf_dir), 1)


_EVEN = "(q + CASE WHEN 2 * r > n OR (2 * r = n AND q % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE"


@query("i11_refine_ranges", sql(f"""
    SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY start_sec) - 1 AS seq, start_sec, end_sec FROM (
        SELECT program_id, max(b) FILTER (WHERE side = 0) AS start_sec, max(b) FILTER (WHERE side = 1) AS end_sec FROM (SELECT program_id, s, i, side, {_EVEN} AS b FROM edges) GROUP BY program_id, s, i) WHERE end_sec > start_sec""",
    "cuts0 AS (SELECT DISTINCT c.program_id, c.time_sec AS t FROM click c JOIN rng r ON c.program_id = r.program_id AND r.end_sec - r.start_sec > 600 AND c.time_sec > r.start_sec AND c.time_sec < r.end_sec)",
    """cuts1 AS (SELECT DISTINCT c.program_id, coalesce((SELECT n.start_sec FROM ne n WHERE n.program_id = c.program_id AND abs(n.start_sec - c.t) <= 60 ORDER BY abs(n.start_sec - c.t), n.start_sec LIMIT 1), c.t) AS t FROM cuts0 c)""",
    "pts AS (SELECT program_id, start_sec AS a FROM rng UNION SELECT program_id, end_sec FROM rng UNION SELECT r.program_id, c.t FROM rng r JOIN cuts1 c ON c.program_id = r.program_id AND c.t > r.start_sec + 0.5 AND c.t < r.end_sec - 0.5)",
    "rng1 AS (SELECT * FROM (SELECT program_id, a AS s, lead(a) OVER (PARTITION BY program_id ORDER BY a) AS e FROM pts) WHERE e IS NOT NULL)",
    """rng2 AS (SELECT program_id, k.s AS s, k.e AS e FROM (SELECT program_id, unnest(list_reduce(list_transform(list({{'s': s, 'e': e}} ORDER BY s), lambda x: [x]), lambda acc, x:
            CASE WHEN (len(acc) = 1 AND acc[-1].e - acc[-1].s < 300) OR x[1].e - x[1].s < 300 THEN list_concat(acc[:-2], [{{'s': acc[-1].s, 'e': x[1].e}}]) ELSE list_concat(acc, x) END)) AS k FROM rng1 GROUP BY 1))""".replace("{{", "{").replace("}}", "}"),
    "rng3 AS (SELECT program_id, CAST(round(s * 100) AS BIGINT) AS s, CAST(round(e * 100) AS BIGINT) AS e, CASE WHEN e - s > 900 THEN CAST(ceil((e - s) / 600) AS BIGINT) ELSE 1 END AS n FROM rng2)",
    "edges AS (SELECT program_id, s, i, side, n, (s * n + (e - s) * (i + side)) // n AS q, (s * n + (e - s) * (i + side)) % n AS r FROM rng3, LATERAL (SELECT unnest(range(n)) AS i) x, (VALUES (0), (1)) v(side))"))
def i11(spark, sf_dir):
    silence = R.non_editorial(spark, sf_dir).select("program_id", F.col("start_sec").alias("time_sec"))
    out, _ = intervals.refine_ranges(R.ranges(spark, sf_dir), R.points(spark, sf_dir, "click"), silence, 600.0, 60.0, 0.5, 300.0, 900.0, 600.0)
    return out


@query("i14_non_editorial_intervals", sql("SELECT * FROM merged", _ISLANDS.replace("FROM ne))", "FROM shown))", 1).replace("    runs AS", """
    shown AS (SELECT program_id, start_sec, end_sec, CASE WHEN label IN ('error', 'signup') THEN CASE label WHEN 'error' THEN 'commercial' ELSE 'sponsor' END WHEN user_id % 7 = 0 THEN 'sponsor' END AS kind
        FROM seg WHERE label = 'error' OR (label = 'signup' AND user_id % 2 = 1) OR user_id % 7 = 0),
    runs AS""")))
def i14(spark, sf_dir):
    s = R.segments(spark, sf_dir).withColumns({
        "non_editorial_kind": F.when(F.col("label") == "error", "commercial").when(F.col("label") == "signup", "sponsor").otherwise("none"), "is_probably_editorial": F.col("user_id") % 2 == 0,
        "sponsor_presentation": F.when(F.col("user_id") % 7 == 0, "fullscreen_sponsor_credit").otherwise("none")})
    return intervals.non_editorial_intervals(s)


@query("i12_cut_candidates", sql("""
    SELECT program_id, time_sec, CASE WHEN time_sec <= 0 OR time_sec >= 86400 THEN 1.0 ELSE 0.72 END::DOUBLE AS score FROM (
        SELECT program_id, round_even(min(start_sec), 2) AS time_sec FROM rng GROUP BY 1 UNION SELECT program_id, round_even(end_sec, 2) FROM rng)"""))
def i12(spark, sf_dir):
    return intervals.scene_cut_candidates(R.ranges(spark, sf_dir), R.programs(spark, sf_dir))


# Folds

_EACH = "SELECT program_id, unnest(list_reduce(list_transform(list({{'t': {t}, 'seq': seq{more}}} ORDER BY {t}, seq), lambda x: [x]), lambda acc, x: {step})) AS k FROM {source} GROUP BY 1"


@query("g02_min_gap", sql("""
    SELECT program_id, last AS time_sec FROM rec WHERE last > 0""",
    """rec AS (SELECT program_id, 0.0::DOUBLE AS last FROM prog UNION ALL
        SELECT program_id, t FROM (SELECT r.program_id, min(c.time_sec) AS t FROM rec r JOIN click c ON c.program_id = r.program_id AND c.time_sec - r.last >= 900 AND c.time_sec > 0.5 AND c.time_sec < 86399.5 GROUP BY r.program_id))""", recursive=True))
def g02(spark, sf_dir):
    clicks = R.points(spark, sf_dir, "click").withColumn("duration_sec", F.lit(R.DAY))
    return folds.thin(clicks, 900.0, duration="duration_sec").select("program_id", "time_sec")


def _strongest(compare: str, source: str) -> str:
    step = f"CASE WHEN x[1].t - acc[-1].t {compare} THEN list_concat(acc, x) WHEN x[1].rank > acc[-1].rank THEN list_concat(acc[:-2], x) ELSE acc END"
    return _EACH.format(t="time_sec", more=", 'rank': rank", step=step, source=source)


@query("g06_stitch", sql(f"SELECT program_id, k.t AS time_sec, k.seq AS seq, k.rank AS rank FROM ({_strongest('> 600', 'hint')})"))
def g06(spark, sf_dir):
    return folds.stitch(R.hints(spark, sf_dir), 600.0).select("program_id", "time_sec", "seq", "rank")


@query("g07_filter_hints", sql(f"SELECT program_id, k.t AS time_sec, k.seq AS seq FROM ({_strongest('>= 600', 'free')})",
    "free AS (SELECT * FROM hint h WHERE NOT EXISTS (SELECT 1 FROM ne n WHERE n.program_id = h.program_id AND h.time_sec >= n.start_sec AND h.time_sec < n.end_sec))"))
def g07(spark, sf_dir):
    return folds.outside_and_spaced(R.hints(spark, sf_dir), R.non_editorial(spark, sf_dir), 600.0).select("program_id", "time_sec", "seq")


@query("i08_merge_short", sql("""
    SELECT program_id, k.s AS start_sec, k.e AS end_sec FROM (
        SELECT program_id, unnest(list_reduce(list_transform(list({'s': start_sec, 'e': end_sec} ORDER BY start_sec), lambda x: [x]), lambda acc, x:
            CASE WHEN (len(acc) = 1 AND acc[-1].e - acc[-1].s < 300) OR x[1].e - x[1].s < 300 THEN list_concat(acc[:-2], [{'s': acc[-1].s, 'e': x[1].e}]) ELSE list_concat(acc, x) END)) AS k FROM rng GROUP BY 1)"""))
def i08(spark, sf_dir):
    return folds.merge_short(R.ranges(spark, sf_dir), 300.0).select("program_id", "start_sec", "end_sec")


@query("j13_add_disjoint", sql("""
    SELECT program_id, k.seq AS seq, k.added AS added FROM (
        SELECT program_id, unnest(list_reduce(list_transform(list({'seq': seq, 's': start_sec, 'e': end_sec, 'added': label <> 'error'} ORDER BY label <> 'error', seq), lambda x: [x]), lambda acc, x:
            CASE WHEN x[1].added AND len(list_filter(acc, lambda y: least(x[1].e, y.e) - greatest(x[1].s, y.s) >= 1)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k
        FROM seg WHERE label IN ('error', 'signup') GROUP BY 1)"""))
def j13(spark, sf_dir):
    s = R.segments(spark, sf_dir).select("program_id", "seq", "start_sec", "end_sec", "label")
    kept, more = (s.where(F.col("label") == x).drop("label") for x in ("error", "signup"))
    return folds.add_disjoint(kept, more).select("program_id", "seq", "added")


@query("g09_pack_batches", sql("""
    SELECT program_id, batch, count(*) AS n, sum(size) AS tokens FROM packed GROUP BY 1, 2""",
    "sized AS (SELECT program_id, seq, length(text) AS size, row_number() OVER (PARTITION BY program_id ORDER BY seq) AS i FROM turn)",
    """packed AS (SELECT program_id, seq, size, i, 0 AS batch, 1200 - size AS room FROM sized WHERE i = 1 UNION ALL
        SELECT s.program_id, s.seq, s.size, s.i, CASE WHEN p.room >= s.size THEN p.batch ELSE p.batch + 1 END, CASE WHEN p.room >= s.size THEN p.room - s.size ELSE 1200 - s.size END
        FROM packed p JOIN sized s ON s.program_id = p.program_id AND s.i = p.i + 1)""", recursive=True))
def g09(spark, sf_dir):
    items = R.turns(spark, sf_dir).select("program_id", "seq", F.length("text").alias("tokens"))
    met = folds.pack(items, 1200).join(items, ["program_id", "seq"])
    return met.groupBy("program_id", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("g08_overlapping_chunks", sql("""
    SELECT program_id, CAST(chunk AS INT) AS chunk, CAST(i - 1 AS INT) AS first, CAST(j - 1 AS INT) AS last, start_sec, end_sec FROM chain""",
    "line AS (SELECT program_id, row_number() OVER w AS p, start_sec, end_sec, sum(length(label)) OVER w AS cum, length(label) AS n FROM seg WINDOW w AS (PARTITION BY program_id ORDER BY seq))",
    "reach AS (SELECT a.program_id, a.p, a.start_sec, greatest(a.p, coalesce(max(b.p), 0)) AS j FROM line a LEFT JOIN line b ON b.program_id = a.program_id AND b.p >= a.p AND b.cum - a.cum + a.n <= 120 GROUP BY 1, 2, 3)",
    "jump AS (SELECT r.program_id, r.p, r.j, r.start_sec, e.end_sec, greatest(r.p + 1, coalesce(max(m.p), 0) + 1) AS nxt, (SELECT max(p) FROM line l WHERE l.program_id = r.program_id) AS size FROM reach r JOIN line e ON e.program_id = r.program_id AND e.p = r.j LEFT JOIN line m ON m.program_id = r.program_id AND m.p > r.p AND m.p <= r.j AND m.start_sec <= e.end_sec - 900 GROUP BY 1, 2, 3, 4, 5)",
    "chain AS (SELECT program_id, 0 AS chunk, p AS i, j, start_sec, end_sec, nxt, size FROM jump WHERE p = 1 UNION ALL SELECT c.program_id, c.chunk + 1, u.p, u.j, u.start_sec, u.end_sec, u.nxt, u.size FROM chain c JOIN jump u ON u.program_id = c.program_id AND u.p = c.nxt WHERE c.j < c.size)", recursive=True))
def g08(spark, sf_dir):
    return folds.overlapping_chunks(R.segments(spark, sf_dir).withColumn("tokens", F.length("label")), 120, 900.0)


# Changes

#: DuckDB's distance counts bytes, so each accented letter of the tables becomes one capital first.
_DIST = """dist AS (SELECT program_id, seq, CASE WHEN nxt IS NULL THEN NULL WHEN greatest(length(text), length(nxt)) = 0 THEN 0.0 ELSE levenshtein(text, nxt) / greatest(length(text), length(nxt))::DOUBLE END AS d
        FROM (SELECT program_id, seq, text, lead(text) OVER (PARTITION BY program_id ORDER BY seq) AS nxt FROM (SELECT program_id, seq, translate(lower(regexp_replace(text, '\\s+', '', 'g')), 'àâäçèéêëîïñóôöùûüßíáú', 'ABCDEFGHIJKLMNOPQRSTU') AS text FROM turn)))"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.turns(spark, sf_dir).select("program_id", "seq", S.compact("text").alias("text"))


@query("g14_distance_series", sql("SELECT program_id, seq, round_even(d, 6) AS distance FROM dist", _DIST))
def g14(spark, sf_dir):
    return changes.distance_series(_frames(spark, sf_dir)).select("program_id", "seq", F.bround("distance", 6).alias("distance"))


@query("g11_change_points", sql("""
    SELECT program_id, seq, CASE WHEN d < 0.8 THEN 'gray' ELSE 'high' END AS kind, NOT coalesce(
        (h1 AND NOT h2 AND NOT hb AND d <= 0.85 AND d1 <= 0.85 AND abs(d - d1) <= 0.15) OR (hb AND NOT hbb AND NOT h1 AND d <= 0.85 AND db <= 0.85 AND abs(d - db) <= 0.15), false) AS confirmed
    FROM (SELECT *, coalesce(d1 > 0.75, false) AS h1, coalesce(d2 > 0.75, false) AS h2, coalesce(db > 0.75, false) AS hb, coalesce(dbb > 0.75, false) AS hbb FROM (
        SELECT *, lead(d) OVER w AS d1, lead(d, 2) OVER w AS d2, lag(d) OVER w AS db, lag(d, 2) OVER w AS dbb FROM dist WINDOW w AS (PARTITION BY program_id ORDER BY seq))) WHERE d > 0.75""", _DIST))
def g11(spark, sf_dir):
    series = changes.distance_series(_frames(spark, sf_dir))
    return changes.change_points(series, 0.75, 0.8, suppress=True, highest=0.85).select("program_id", "seq", "kind", "confirmed")


@query("g12_cluster_first", sql("""
    SELECT program_id, min(seq) AS seq, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY program_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM (
        SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY program_id ORDER BY seq) <= 12 THEN 0 ELSE 1 END AS fresh FROM click)) GROUP BY program_id, c"""))
def g12(spark, sf_dir):
    return changes.cluster_firsts(R.points(spark, sf_dir, "click"), 12)


@query("g13_change_seconds", sql("SELECT DISTINCT program_id, round_even((seq + 1) / 2.0::DOUBLE, 2) AS time_sec FROM click"))
def g13(spark, sf_dir):
    return changes.frame_seconds(R.points(spark, sf_dir, "click"), 2.0)


_MID = "(CASE WHEN {h} % 2 = 0 THEN {h} // 2 ELSE {h} // 2 + ({h} // 2) % 2 END) / 100.0::DOUBLE"


@query("g15_voronoi_spans", sql(f"""
    SELECT program_id, seq, CASE WHEN h0 IS NULL THEN 0.0 ELSE {_MID.format(h="h0")} END AS start_sec, CASE WHEN h1 IS NULL THEN 86400.0 ELSE {_MID.format(h="h1")} END AS end_sec FROM (
        SELECT program_id, seq, CAST(round((lag(time_sec) OVER w + time_sec) * 100) AS BIGINT) AS h0, CAST(round((time_sec + lead(time_sec) OVER w) * 100) AS BIGINT) AS h1
        FROM click WINDOW w AS (PARTITION BY program_id ORDER BY time_sec, seq))"""))
def g15(spark, sf_dir):
    pts = R.points(spark, sf_dir, "click").withColumn("duration_sec", F.lit(R.DAY))
    return changes.voronoi_spans(pts, "duration_sec").select("program_id", "seq", "start_sec", "end_sec")


@query("s12_drop_repeats", sql("SELECT program_id, seq, label FROM (SELECT *, lag(label) OVER (PARTITION BY program_id ORDER BY seq) AS before FROM seg) WHERE before IS NULL OR before <> label"))
def s12(spark, sf_dir):
    return changes.drop_repeats(R.segments(spark, sf_dir), "label").select("program_id", "seq", "label")


# Evidence and topics

_EDITORIAL = """
    cue AS (WITH RECURSIVE r AS (SELECT program_id, 0.0::DOUBLE AS last FROM prog UNION ALL
        SELECT program_id, t FROM (SELECT r.program_id, min(c.start_sec) AS t FROM r JOIN seg c ON c.program_id = r.program_id AND c.label = 'purchase' AND c.start_sec - r.last >= 1800 AND c.start_sec > 0.5 AND c.start_sec < 86399.5 GROUP BY r.program_id))
        SELECT program_id, last AS time_sec FROM r WHERE last > 0),
    cuts AS (SELECT program_id, 0.0::DOUBLE AS t FROM prog UNION SELECT program_id, 86400.0::DOUBLE FROM prog UNION SELECT program_id, time_sec FROM cue
        UNION SELECT program_id, start_sec FROM ne UNION SELECT program_id, least(end_sec, 86400.0::DOUBLE) FROM ne),
    spans AS (SELECT program_id, t AS start_sec, lead(t) OVER (PARTITION BY program_id ORDER BY t) AS end_sec FROM cuts),
    ed AS (SELECT program_id, start_sec, end_sec, row_number() OVER (PARTITION BY program_id ORDER BY start_sec) - 1 AS seq FROM spans s WHERE end_sec IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM ne n WHERE n.program_id = s.program_id AND (s.start_sec + s.end_sec) / 2.0 >= n.start_sec AND (s.start_sec + s.end_sec) / 2.0 < n.end_sec))"""


@query("g03_editorial_spans", sql("SELECT * FROM ed", _EDITORIAL, recursive=True))
def g03(spark, sf_dir):
    cues = R.points(spark, sf_dir, "purchase").withColumn("duration_sec", F.lit(R.DAY))
    kept = folds.thin(cues, 1800.0, duration="duration_sec")
    return evidence.editorial_spans(R.programs(spark, sf_dir), R.non_editorial(spark, sf_dir), kept)


@query("g05_evidence_spans", sql("""
    SELECT program_id, t AS start_sec, e AS end_sec, seq FROM (SELECT program_id, t, lead(t) OVER w AS e, row_number() OVER w - 1 AS seq FROM (
        SELECT program_id, k * 60.0::DOUBLE AS t FROM prog, range(1441) x(k) UNION SELECT program_id, round_even(greatest(0, start_sec), 2) FROM ne UNION SELECT program_id, round_even(least(86400, end_sec), 2) FROM ne
        UNION SELECT program_id, round_even(time_sec, 2) FROM buy UNION SELECT program_id, round_even(time_sec, 2) FROM click WHERE time_sec > 0 AND time_sec < 86400) WINDOW w AS (PARTITION BY program_id ORDER BY t)) WHERE e IS NOT NULL"""))
def g05(spark, sf_dir):
    return evidence.evidence_spans(R.programs(spark, sf_dir), 60.0, R.non_editorial(spark, sf_dir), R.points(spark, sf_dir, "purchase"), R.points(spark, sf_dir, "click"))


@query("a01_evidence_windows", sql("""
    SELECT program_id, 'w' || lpad(CAST(seq AS VARCHAR), 4, '0') AS window_id, coalesce(cap, '') AS captions, CASE WHEN cap IS NULL THEN coalesce(asr, '') ELSE '' END AS asr, coalesce(kinds, '') AS kinds FROM grid
    LEFT JOIN (SELECT program_id, seq, string_agg(text, '|' ORDER BY first) FILTER (WHERE label = 'view' AND pos <= 12) AS cap, string_agg(text, '|' ORDER BY first) FILTER (WHERE label = 'click' AND pos <= 12) AS asr FROM (
        SELECT *, row_number() OVER (PARTITION BY program_id, seq, label ORDER BY first) AS pos FROM (
            SELECT g.program_id, g.seq, s.label, 'user ' || CAST(s.user_id AS VARCHAR) AS text, min(s.seq) AS first FROM grid g JOIN seg s ON g.program_id = s.program_id AND s.label IN ('view', 'click')
            AND least(g.end_sec, s.end_sec) > greatest(g.start_sec, s.start_sec) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2) USING (program_id, seq)
    LEFT JOIN (SELECT program_id, seq, string_agg(kind, '|' ORDER BY first) AS kinds FROM (SELECT g.program_id, g.seq, n.kind, min(n.seq) AS first FROM grid g JOIN ne n ON g.program_id = n.program_id
        AND least(g.end_sec, n.end_sec) > greatest(g.start_sec, n.start_sec) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (program_id, seq)
    WHERE cap IS NOT NULL OR asr IS NOT NULL OR kinds IS NOT NULL""", _GRID))
def a01(spark, sf_dir):
    s = R.segments(spark, sf_dir).withColumn("text", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    stream = lambda label: s.where(F.col("label") == label).select("program_id", "seq", "start_sec", "end_sec", "text")
    out = evidence.evidence_windows(_windows(spark, sf_dir), captions=stream("view"), asr=stream("click"), non_editorial=R.non_editorial(spark, sf_dir))
    return out.select("program_id", "window_id", *(F.array_join(c, "|").alias(n) for c, n in (("captions", "captions"), ("asr", "asr"), ("non_editorial", "kinds"))))


#: Keywords for the tables' invented prose, which holds no words of real news.
KEYWORDS = {"articles": ["the", "a "], "relations": ["with", "from", "for"], "pointers": ["that", "this"], "endings": ["tion", "ing"], "romance": ["que", "les"], "german": ["ein", "sch"]}


def _count_sql(text: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{d}' AS domain, {' + '.join(f'contains(lower({text}), $${w}$$)::INT' for w in words)} AS n FROM documents" for d, words in KEYWORDS.items())


@query("g04_classify", f"""
    SELECT doc_id, domain, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, domain) - 1 AS place FROM ({_count_sql('text')}) WHERE n > 0""")
def g04(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id", "text")
    return evidence.keyword_scores(docs, KEYWORDS, ["doc_id"]).select("doc_id", "domain", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


@query("f13_cues", sql("""
    SELECT program_id, 'cue' || lpad(CAST(row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 AS VARCHAR), 5, '0') AS cue_id, seq, cue_type FROM (
        SELECT *, CASE WHEN regexp_matches(text, 'thing') THEN 'cm_transition' WHEN regexp_matches(text, 'anan') THEN 'resume_after_cm' WHEN regexp_matches(text, 'ere|tion') THEN 'topic_transition' ELSE 'weak_discourse' END AS cue_type FROM turn)
    WHERE cue_type <> 'weak_discourse' OR regexp_matches(text, 'the')"""))
def f13(spark, sf_dir):
    t = R.turns(spark, sf_dir).withColumns({"start_sec": F.col("seq") * 1.0, "end_sec": F.col("seq") + 1.0})
    return evidence.cue_rows(t, "thing", "anan", "ere|tion", "the").select("program_id", "cue_id", "seq", "cue_type")


@query("u01_candidates", sql("""
    SELECT program_id, 'b_src_' || lpad(CAST(seq AS VARCHAR), 6, '0') AS boundary_id, start_sec AS time_sec, 'scene' AS boundary_type, 'scene_detector' AS source, 0.72 AS score FROM rng
    UNION ALL SELECT program_id, 'b_ocr_' || lpad(CAST(seq AS VARCHAR), 6, '0'), time_sec, 'scene', 'ocr_text_change', 0.55 FROM click
    UNION ALL SELECT program_id, 'b_cue' || lpad(CAST(seq AS VARCHAR), 5, '0'), time_sec, 'topic', 'cue', 0.62 FROM buy
    UNION ALL SELECT program_id, 'b_cm_' || lpad(CAST(seq AS VARCHAR), 6, '0') || '_start', round_even(start_sec, 2), 'cm_start', 'cm_detector', 0.86 FROM ne
    UNION ALL SELECT program_id, 'b_cm_' || lpad(CAST(seq AS VARCHAR), 6, '0') || '_end', round_even(end_sec, 2), 'cm_end', 'cm_detector', 0.86 FROM ne"""))
def u01(spark, sf_dir):
    scenes = R.ranges(spark, sf_dir).select("program_id", S.numbered("b_src_", "seq", 6).alias("boundary_id"), F.col("start_sec").alias("time_sec"), F.lit("scene").alias("boundary_type"), F.lit(0.72).alias("score"))
    cues = R.points(spark, sf_dir, "purchase").select("program_id", S.numbered("cue", "seq", 5).alias("cue_id"), F.col("time_sec").alias("start_sec"), F.lit("topic_transition").alias("cue_type"), F.lit(0.62).alias("confidence"), F.lit("buy").alias("text"))
    out = evidence.boundary_candidates(scenes, cues, R.points(spark, sf_dir, "click"), R.non_editorial(spark, sf_dir))
    return out.select("program_id", "boundary_id", "time_sec", "boundary_type", "source", "score")


_TOPIC_SQL = sql("""
    SELECT program_id, 't' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END AS topic_id, round_even(start_sec, 2) AS start_sec, round_even(end_sec, 2) AS end_sec,
        CASE WHEN nv > 0 AND nv >= nc THEN 'browsing' WHEN nc > 0 THEN 'clicking' ELSE 'society' END AS domain, first AS title, n FROM (
        SELECT e.program_id, e.seq, e.start_sec, e.end_sec, count(*) AS n, arg_min(s.label || ' ' || CAST(s.user_id AS VARCHAR), s.seq) AS first,
            max((s.label = 'view' AND r <= 8)::INT) AS nv, max((s.label = 'click' AND r <= 8)::INT) AS nc
        FROM ed e JOIN (SELECT e2.program_id AS p2, e2.seq AS e_seq, s2.*, row_number() OVER (PARTITION BY e2.program_id, e2.seq ORDER BY s2.seq) AS r FROM ed e2 JOIN seg s2 ON s2.program_id = e2.program_id
            AND s2.label IN ('view', 'click', 'purchase') AND least(e2.end_sec, s2.end_sec) > greatest(e2.start_sec, s2.start_sec)) s ON s.p2 = e.program_id AND s.e_seq = e.seq
        GROUP BY 1, 2, 3, 4)""", _EDITORIAL, recursive=True)


@query("x04_heuristic_topics", _TOPIC_SQL)
def x04(spark, sf_dir):
    s = R.segments(spark, sf_dir).where(F.col("label").isin("view", "click", "purchase"))
    primary = s.select("program_id", "seq", "start_sec", "end_sec", F.concat_ws(" ", "label", F.col("user_id").cast("string")).alias("text"))
    out = evidence.heuristic_topics(R.programs(spark, sf_dir), primary, R.non_editorial(spark, sf_dir), "^purchase", {"browsing": ["view"], "clicking": ["click"]}, 1800.0)
    met = joins.overlap_join(out.select("program_id", "topic_id", "start_sec", "end_sec"), primary)
    n = met.groupBy("program_id", F.col("l_topic_id").alias("topic_id")).agg(F.count("*").alias("n"))
    return out.join(n, ["program_id", "topic_id"]).select("program_id", "topic_id", "start_sec", "end_sec", "domain", "title", "n")


@query("x10_finalise", sql("""
    SELECT program_id, seq FROM cov2 WHERE coverage < 0.5""",
    "kept AS (SELECT program_id, unnest(list_reduce(list_transform(list({'seq': seq, 's': start_sec, 'e': least(end_sec, 86400.0::DOUBLE), 'added': label <> 'error'} ORDER BY label <> 'error', seq), lambda x: [x]), lambda acc, x: CASE WHEN x[1].added AND len(list_filter(acc, lambda y: least(x[1].e, y.e) - greatest(x[1].s, y.s) >= 1)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM seg WHERE label IN ('error', 'signup') AND start_sec < 86400 GROUP BY 1)",
    "cut2 AS (SELECT t.program_id, t.seq, greatest(t.start_sec, k.s) AS s, least(t.end_sec, k.e) AS e FROM pred t JOIN kept n ON t.program_id = n.program_id AND least(t.end_sec, k.e) > greatest(t.start_sec, k.s))",
    "fresh2 AS (SELECT program_id, seq, greatest(0.0::DOUBLE, e - greatest(s, coalesce(max(e) OVER (PARTITION BY program_id, seq ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s))) AS f FROM cut2)",
    "cov2 AS (SELECT p.program_id, p.seq, round_even(coalesce(sum(f), 0) / (p.end_sec - p.start_sec), 9) AS coverage FROM pred p LEFT JOIN fresh2 USING (program_id, seq) WHERE p.end_sec > p.start_sec GROUP BY p.program_id, p.seq, p.start_sec, p.end_sec)"))
def x10(spark, sf_dir):
    s = R.segments(spark, sf_dir)
    some = lambda label: s.where(F.col("label") == label).select("program_id", "seq", "start_sec", "end_sec")
    topics = R.topics(spark, sf_dir, 1).withColumn("topic_id", S.numbered("t", "seq", 3))
    return evidence.finalise(topics, some("error"), some("signup").where(F.col("start_sec") < R.DAY).withColumn("end_sec", F.least("end_sec", F.lit(R.DAY))), R.programs(spark, sf_dir), 0.5)[0].select("program_id", "seq")


# Evaluation

_BOUNDS = """
    bnd AS (SELECT parity, program_id, t FROM (SELECT *, t - lag(t) OVER (PARTITION BY parity, program_id ORDER BY t) AS d FROM (SELECT DISTINCT parity, program_id, unnest([start_sec, end_sec]) AS t FROM top)) WHERE d IS NULL OR d > 0.5)"""


@query("e01_boundaries", sql("SELECT program_id, t AS time_sec FROM bnd WHERE parity = 0", _BOUNDS))
def e01(spark, sf_dir):
    return evaluation.boundaries(R.topics(spark, sf_dir, 0))


#: Two pointers over the sorted lists p and g: match what is near enough, else pass over the earlier point.
_TWO = """
    two AS (SELECT program_id, p, g, 1 AS i, 1 AS j, 0 AS tp FROM lists UNION ALL
        SELECT program_id, p, g, CASE WHEN p[i] > g[j] + 30 THEN i ELSE i + 1 END, CASE WHEN p[i] < g[j] - 30 THEN j ELSE j + 1 END, tp + (abs(p[i] - g[j]) <= 30)::INT
        FROM two WHERE i <= len(p) AND j <= len(g)),
    fin AS (SELECT program_id, max(tp) AS tp, any_value(len(p)) AS n_p, any_value(len(g)) AS n_t FROM two GROUP BY 1)"""
_LISTS = "lists AS (SELECT program_id, coalesce(list(t ORDER BY t) FILTER (WHERE parity = 1), []) AS p, coalesce(list(t ORDER BY t) FILTER (WHERE parity = 0), []) AS g FROM bnd GROUP BY 1)"


@query("e02_f1", sql("SELECT program_id, tp, n_p - tp AS fp, n_t - tp AS fn, round_even(2.0 * tp / (n_p + n_t), 6) AS f1 FROM fin", _BOUNDS, _LISTS, _TWO, recursive=True))
def e02(spark, sf_dir):
    p, t = (evaluation.boundaries(R.topics(spark, sf_dir, k)) for k in (1, 0))
    out = evaluation.match_counts(p, t, 30.0)
    return out.select("program_id", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), F.bround("f1", 6).alias("f1"))


#: The largest total IoU over chains of pairs in order of time: a pair is taken after the last one that shares no topic with it.
_MATCHES = """
    pr AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY s, e, pred, truth) AS k FROM (
        SELECT p.program_id, p.seq AS pred, t.seq AS truth, greatest(p.start_sec, t.start_sec) AS s, least(p.end_sec, t.end_sec) AS e, p.start_sec - t.start_sec AS onset, p.end_sec - t.end_sec AS offs,
            (least(p.end_sec, t.end_sec) - greatest(p.start_sec, t.start_sec)) / (greatest(p.end_sec, t.end_sec) - least(p.start_sec, t.start_sec)) AS iou
        FROM pred p JOIN truth t ON p.program_id = t.program_id AND least(p.end_sec, t.end_sec) > greatest(p.start_sec, t.start_sec))),
    fr AS (SELECT program_id, k, iou, least(min(k) OVER (PARTITION BY program_id, pred), min(k) OVER (PARTITION BY program_id, truth)) - 1 AS free FROM pr),
    dp AS (SELECT program_id, v, f, 1 AS k, [v[1]] AS b FROM (SELECT program_id, list(iou ORDER BY k) AS v, list(free ORDER BY k) AS f FROM fr GROUP BY 1) UNION ALL
        SELECT program_id, v, f, k + 1, list_append(b, greatest(b[k], v[k + 1] + coalesce(b[f[k + 1]], 0))) FROM dp WHERE k < len(v)),
    tr AS (SELECT program_id, f, b, CAST(k AS BIGINT) AS k FROM dp WHERE k = len(v) UNION ALL SELECT program_id, f, b, CASE WHEN b[k] > coalesce(b[k - 1], 0) THEN f[k] ELSE k - 1 END FROM tr WHERE k > 0),
    mt AS (SELECT pr.* FROM pr JOIN tr ON pr.program_id = tr.program_id AND pr.k = tr.k WHERE iou >= 0.3 AND b[tr.k] > coalesce(b[tr.k - 1], 0))"""


@query("e03_topic_matches", sql('SELECT program_id, pred, truth AS "true", round_even(iou, 6) AS iou, round_even(onset, 6) AS onset_error, round_even(offs, 6) AS offset_error FROM mt', _MATCHES, recursive=True))
def e03(spark, sf_dir):
    out = evaluation.topic_matches(R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0))
    return out.select("program_id", "pred", "true", *(F.bround(c, 6).alias(c) for c in ("iou", "onset_error", "offset_error")))


@query("e04_match_summary", sql("""
    SELECT program_id, n_ground_truth, n_prediction, coalesce(n_matched, 0) AS n_matched, round_even(i, 6) AS mean_iou_matched, round_even(a, 6) AS onset_mae_sec, round_even(o, 6) AS offset_mae_sec,
        abs(n_prediction - n_ground_truth) AS topic_count_error, round_even(coalesce(n_matched, 0) / n_ground_truth, 6) AS match_rate
    FROM (SELECT program_id, count(*) FILTER (WHERE parity = 0) AS n_ground_truth, count(*) FILTER (WHERE parity = 1) AS n_prediction FROM top GROUP BY 1)
    LEFT JOIN (SELECT program_id, count(*) AS n_matched, avg(iou) AS i, avg(abs(onset)) AS a, avg(abs(offs)) AS o FROM mt GROUP BY 1) USING (program_id)""", _MATCHES, recursive=True))
def e04(spark, sf_dir):
    p, t = R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0)
    out = evaluation.match_summary(p, t, evaluation.topic_matches(p, t))
    return out.select("program_id", "n_ground_truth", "n_prediction", "n_matched", "topic_count_error", *(F.bround(c, 6).alias(c) for c in ("mean_iou_matched", "onset_mae_sec", "offset_mae_sec", "match_rate")))


@query("e07_window_metrics", sql("""
    SELECT s.program_id, any_value(k) AS k, round_even(sum((dp = 0)::INT != (dt = 0)::INT)::DOUBLE / any_value(n - k), 6) AS pk, round_even(sum((dp != dt)::INT)::DOUBLE / any_value(n - k), 6) AS window_diff FROM (
        SELECT z.program_id, z.k, z.n, f.t, (SELECT count(*) FROM bnd b WHERE b.program_id = z.program_id AND b.parity = 1 AND b.t > f.t + 0.5 AND b.t <= f.t + z.k + 0.5) AS dp,
            (SELECT count(*) FROM bnd b WHERE b.program_id = z.program_id AND b.parity = 0 AND b.t > f.t + 0.5 AND b.t <= f.t + z.k + 0.5) AS dt FROM sizes z, LATERAL (SELECT unnest(range(z.n - z.k)) AS t) f) s GROUP BY 1""".replace("sum((dp = 0)::INT != (dt = 0)::INT)", "sum(((dp = 0) != (dt = 0))::INT)"), _BOUNDS,
    "sizes AS (SELECT program_id, 86400 AS n, CAST(round_even(86400.0::DOUBLE / (count(*) + 1) / 2.0, 0) AS INT) AS k FROM bnd WHERE parity = 0 GROUP BY 1)"))
def e07(spark, sf_dir):
    out = evaluation.window_metrics(R.programs(spark, sf_dir), R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0))
    return out.select("program_id", "k", F.bround("pk", 6).alias("pk"), F.bround("window_diff", 6).alias("window_diff"))


_OVER = """ov AS (SELECT p.program_id, p.seq AS pred, t.seq AS truth, least(p.end_sec, t.end_sec) - greatest(p.start_sec, t.start_sec) AS o, p.end_sec - p.start_sec AS lp, t.end_sec - t.start_sec AS lt
        FROM pred p JOIN truth t ON p.program_id = t.program_id AND least(p.end_sec, t.end_sec) > greatest(p.start_sec, t.start_sec))"""


@query("e09_splits", sql("""
    SELECT program_id, 'over_split' AS kind, string_agg(CAST(pred AS VARCHAR), ';' ORDER BY pred) AS predictions, CAST(truth AS VARCHAR) AS truths FROM ov WHERE o / lp >= 0.5 GROUP BY program_id, truth HAVING count(*) >= 2
    UNION ALL SELECT program_id, 'under_split', CAST(pred AS VARCHAR), string_agg(CAST(truth AS VARCHAR), ';' ORDER BY truth) FROM ov WHERE o / lt >= 0.5 GROUP BY program_id, pred HAVING count(*) >= 2""", _OVER))
def e09(spark, sf_dir):
    out = evaluation.splits(R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0))
    return out.select("program_id", "kind", *(F.array_join(F.col(c).cast("array<string>"), ";").alias(c) for c in ("predictions", "truths")))


@query("e10_other_errors", sql("""
    SELECT program_id, 'phase_shifted' AS kind, CAST(pred AS VARCHAR) AS predictions, CAST(truth AS VARCHAR) AS truths FROM shifted
    UNION ALL SELECT program_id, 'hallucinated', CAST(seq AS VARCHAR), '' FROM free_p p WHERE NOT EXISTS (FROM shifted s WHERE s.program_id = p.program_id AND s.pred = p.seq)
    UNION ALL SELECT program_id, 'missed', '', CAST(seq AS VARCHAR) FROM free_t t WHERE NOT EXISTS (FROM shifted s WHERE s.program_id = t.program_id AND s.truth = t.seq)""", _OVER, _MATCHES,
    "told AS (SELECT program_id, pred, truth FROM mt UNION ALL SELECT program_id, pred, truth FROM ov WHERE o / lp >= 0.5 QUALIFY count(*) OVER (PARTITION BY program_id, truth) >= 2 UNION ALL SELECT program_id, pred, truth FROM ov WHERE o / lt >= 0.5 QUALIFY count(*) OVER (PARTITION BY program_id, pred) >= 2)",
    "free_p AS (SELECT program_id, seq FROM pred p WHERE NOT EXISTS (FROM told WHERE told.program_id = p.program_id AND told.pred = p.seq))",
    "free_t AS (SELECT program_id, seq FROM truth t WHERE NOT EXISTS (FROM told WHERE told.program_id = t.program_id AND told.truth = t.seq))",
    "shifted AS (SELECT pr.program_id, pred, truth FROM pr JOIN free_p p ON p.program_id = pr.program_id AND p.seq = pred JOIN free_t t ON t.program_id = pr.program_id AND t.seq = truth WHERE iou >= 0.1)", recursive=True))
def e10(spark, sf_dir):
    p, t = R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0)
    out = evaluation.other_errors(p, t, evaluation.topic_matches(p, t), evaluation.splits(p, t))
    return out.select("program_id", "kind", *(F.array_join(F.col(c).cast("array<string>"), ";").alias(c) for c in ("predictions", "truths")))


@query("e13_chapters", sql("""
    SELECT program_id, row_number() OVER w - 1 AS seq, s AS start_sec, coalesce(lead(s) OVER w, 86400.0) AS end_sec, label FROM (
        SELECT program_id, floor(time_sec)::DOUBLE AS s, arg_min('c' || CAST(seq AS VARCHAR), seq) AS label FROM buy GROUP BY 1, 2) WINDOW w AS (PARTITION BY program_id ORDER BY s)"""))
def e13(spark, sf_dir):
    p = R.points(spark, sf_dir, "purchase").withColumn("s", F.floor("time_sec"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    at = F.concat_ws(":", two(F.floor(F.col("s") / 3600)), two(F.floor(F.col("s") % 3600 / 60)), two(F.col("s") % 60))
    one = p.groupBy("program_id", at.alias("at")).agg(F.concat(F.lit("c"), F.min("seq").cast("string")).alias("label"))
    chapters = one.groupBy("program_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "label"))).alias("chapters")).withColumn("duration_sec", F.lit(R.DAY))
    return evaluation.chapter_topics(chapters)


@query("e14_tiou_scores", sql("""
    SELECT program_id, threshold, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (
        SELECT program_id, threshold, avg((iou >= threshold)::INT) FILTER (WHERE side = 'pred') AS p, avg((iou >= threshold)::INT) FILTER (WHERE side = 'truth') AS r FROM (
            SELECT p.program_id, 'pred' AS side, coalesce(max(o / (lp + lt - o)), 0) AS iou FROM pred p LEFT JOIN ov ON ov.program_id = p.program_id AND ov.pred = p.seq GROUP BY p.program_id, p.seq
            UNION ALL SELECT t.program_id, 'truth', coalesce(max(o / (lp + lt - o)), 0) FROM truth t LEFT JOIN ov ON ov.program_id = t.program_id AND ov.truth = t.seq GROUP BY t.program_id, t.seq),
            (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold) GROUP BY 1, 2)""", _OVER))
def e14(spark, sf_dir):
    out = evaluation.tiou_scores(R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0))
    return out.select("program_id", "threshold", *(F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("e15_recall_by_type", sql("""
    SELECT label AS kind, count(*) AS n, round_even(avg((d <= 60)::INT), 6) AS recall_60, round_even(avg((d <= 300)::INT), 6) AS recall_300, round_even(median(d), 6) AS median_error FROM (
        SELECT t.label, (SELECT min(abs(p.start_sec - t.start_sec)) FROM pred p WHERE p.program_id = t.program_id) AS d FROM truth t) GROUP BY 1"""))
def e15(spark, sf_dir):
    truth = R.topics(spark, sf_dir, 0).select("program_id", F.col("start_sec").alias("time_sec"), F.col("label").alias("kind"))
    out = evaluation.nearest_recall(truth, R.topics(spark, sf_dir, 1).select("program_id", F.col("start_sec").alias("time_sec")), (60.0, 300.0))
    return out.select("kind", "n", *(F.bround(c, 6).alias(c) for c in ("recall_60", "recall_300", "median_error")))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.segments(spark, sf_dir)
    return s.groupBy("program_id", (F.col("user_id") % 3).alias("broadcaster")).agg(F.count("*").cast("double").alias("bf1_5"), F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("pk"))


_DAILY = "daily AS (SELECT program_id, user_id % 3 AS broadcaster, count(*)::DOUBLE AS bf1_5, sum(round(value * 100)::BIGINT)::DOUBLE AS pk FROM seg GROUP BY 1, 2)"


@query("a07_grouping_sets", sql("""
    SELECT coalesce(CAST(broadcaster AS VARCHAR), 'all') AS grp, metric, count(*) AS n, round_even(avg(v), 4) AS mean, round_even(stddev_samp(v), 4) AS sd
    FROM (SELECT broadcaster, 'bf1_5' AS metric, bf1_5 AS v FROM daily UNION ALL SELECT broadcaster, 'pk', pk FROM daily) GROUP BY GROUPING SETS ((metric), (metric, broadcaster))""", _DAILY))
def a07(spark, sf_dir):
    return evaluation.grouped(_daily(spark, sf_dir), ["bf1_5", "pk"], "broadcaster").withColumns({"mean": F.bround("mean", 4), "sd": F.bround("sd", 4)})


@query("a08_five_numbers", sql("SELECT broadcaster, count(*) AS n, min(pk) AS min, median(pk) AS median, max(pk) AS max, round_even(avg(pk), 4) AS mean FROM daily GROUP BY 1", _DAILY))
def a08(spark, sf_dir):
    return evaluation.five_numbers(_daily(spark, sf_dir), "broadcaster", "pk").withColumn("mean", F.bround("mean", 4))


@query("a09_boundary_kinds", "SELECT source AS kind, count(*) AS n, median(n_chars) AS median_chars FROM documents GROUP BY 1")
def a09(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select(F.concat(F.lit("note [境界タイプ: "), "source", F.lit("] end")).alias("notes"), "n_chars")
    return docs.groupBy(evaluation.boundary_kind(F.col("notes")).alias("kind")).agg(F.count("*").alias("n"), F.expr("percentile(n_chars, 0.5)").alias("median_chars"))


@query("a11_win_tie_loss", sql("""
    SELECT metric, sum((s * sign(a - b) > 0)::INT) AS wins, sum((a = b)::INT) AS ties, sum((s * sign(a - b) < 0)::INT) AS losses, round_even(avg(a - b), 6) AS mean_difference FROM (
        SELECT 'bf1_5' AS metric, 1 AS s, x.bf1_5 AS a, y.bf1_5 AS b FROM daily x JOIN daily y USING (program_id) WHERE x.broadcaster = 0 AND y.broadcaster = 1
        UNION ALL SELECT 'pk', -1, x.pk, y.pk FROM daily x JOIN daily y USING (program_id) WHERE x.broadcaster = 0 AND y.broadcaster = 1) GROUP BY 1""", _DAILY))
def a11(spark, sf_dir):
    d = _daily(spark, sf_dir)
    long = d.select("program_id", "broadcaster", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("bf1_5", "pk")))).alias("x")).select("program_id", "broadcaster", "x.*")
    a, b = (long.where(F.col("broadcaster") == k).select("program_id", "metric", F.col("v").alias(n)) for k, n in ((0, "a"), (1, "b")))
    out = evaluation.wins(a.join(b, ["program_id", "metric"]), F.col("metric"), F.col("a"), F.col("b"), [F.col("metric")])
    return out.withColumn("mean_difference", F.bround("mean_difference", 6))


@query("e12_bootstrap")
def e12(spark, sf_dir):
    rows = _daily(spark, sf_dir).withColumn("row", F.concat_ws("/", "program_id", "broadcaster"))
    return evaluation.bootstrap(rows, "row", ["bf1_5", "pk"])


@query("a07_intervals")
def a07_intervals(spark, sf_dir):
    rows = _daily(spark, sf_dir).withColumn("row", F.concat_ws("/", "program_id", "broadcaster"))
    return evaluation.interval_table(rows, "row", ["bf1_5", "pk"], [None, "0", "1", "2"], by="broadcaster")


_AT_5 = ORACLE_SQL["e02_f1"].replace("g[j] + 30", "g[j] + 5").replace("g[j] - 30", "g[j] - 5").replace("<= 30", "<= 5")


@query("e11_summary", f"""
    SELECT program_id, n_ground_truth, n_prediction, topic_count_error, match_rate, mean_iou_matched, onset_mae_sec, offset_mae_sec, a.f1 AS bf1_5, b.f1 AS bf1_30, pk, window_diff
    FROM ({ORACLE_SQL["e04_match_summary"]}) LEFT JOIN ({_AT_5}) a USING (program_id) LEFT JOIN ({ORACLE_SQL["e02_f1"]}) b USING (program_id) LEFT JOIN ({ORACLE_SQL["e07_window_metrics"]}) w USING (program_id)""")
def e11(spark, sf_dir):
    out = evaluation.summary(R.programs(spark, sf_dir), R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0))
    counts = ["program_id", "n_ground_truth", "n_prediction", "topic_count_error"]
    return out.select(*counts, *(F.bround(c, 6).alias(c) for c in out.columns if c not in counts))


def _one_edge(edge: str) -> str:
    """The matching of e02 for one edge of the topics only, as a subquery."""
    cut = f"bnd AS (SELECT parity, program_id, t FROM (SELECT *, t - lag(t) OVER (PARTITION BY parity, program_id ORDER BY t) AS d FROM (SELECT DISTINCT parity, program_id, {edge} AS t FROM top)) WHERE d IS NULL OR d > 0.5)"
    return f"(WITH RECURSIVE {cut}, {_LISTS}, {_TWO} SELECT program_id, round_even(2.0 * tp / (n_p + n_t), 6) AS f1 FROM fin)"


@query("e16_start_end_f1", sql(f"SELECT program_id, s.f1 AS start_f1, e.f1 AS end_f1 FROM {_one_edge('start_sec')} s JOIN {_one_edge('end_sec')} e USING (program_id)"))
def e16(spark, sf_dir):
    out = evaluation.start_end_scores(R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0), 30.0)
    return out.select("program_id", *(F.bround(c, 6).alias(c) for c in ("start_f1", "end_f1")))


@query("e16_contrast")
def e16_contrast(spark, sf_dir):
    p, t = R.topics(spark, sf_dir, 1), R.topics(spark, sf_dir, 0)
    blunt = intervals.cuts_to_spans(p.where("seq % 2 = 0").select("program_id", F.col("start_sec").alias("time_sec")).union(R.programs(spark, sf_dir).select("program_id", F.lit(R.DAY))))
    return evaluation.start_end_contrast(evaluation.start_end_scores(p, t, 30.0), evaluation.start_end_scores(blunt, t, 30.0))


# Baselines


_UNITS = """
    WITH u AS (SELECT CAST(vec_id % 4 AS VARCHAR) AS program_id, embedding::DOUBLE[64] AS v, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY label, vec_id) - 1 AS seq FROM embeddings),
    sums AS (SELECT g.program_id, g.seq AS gap, d.i, sum(CASE WHEN o.seq < g.seq THEN o.v[d.i] END) / 3 AS a, sum(CASE WHEN o.seq >= g.seq THEN o.v[d.i] END) / 3 AS b, count(*) AS n
        FROM u g JOIN u o ON g.program_id = o.program_id AND o.seq BETWEEN g.seq - 3 AND g.seq + 2, (SELECT unnest(range(1, 65)) AS i) d GROUP BY 1, 2, 3),
    far AS (SELECT program_id, gap, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS d FROM sums WHERE n = 6 GROUP BY 1, 2)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("program_id").orderBy("label", "vec_id")
    e = R.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).cast("string").alias("program_id"), "label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.withColumn("seq", F.row_number().over(w) - 1).select("program_id", "seq", "v")


#: Peaks lie two units of 15 seconds apart at least, so the least distance of 30 seconds drops none of them.
@query("b01_embedding_window", _UNITS + """,
    sm AS (SELECT program_id, gap, avg(d) OVER (PARTITION BY program_id ORDER BY gap ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d FROM far),
    pk AS (SELECT *, avg(d) OVER p + 0.5 * stddev_pop(d) OVER p AS high, lag(d) OVER o AS l, lead(d) OVER o AS r FROM sm WINDOW p AS (PARTITION BY program_id), o AS (PARTITION BY program_id ORDER BY gap))
    SELECT program_id, gap * 15.0::DOUBLE AS time_sec FROM pk WHERE d >= high AND (l IS NULL OR d >= l) AND (r IS NULL OR d > r)""")
def b01(spark, sf_dir):
    return baselines.embedding_boundaries(_units(spark, sf_dir))


@query("b01_dissimilarity", _UNITS + " SELECT program_id, gap, round_even(d, 6) AS dissimilarity FROM far")
def b01_gaps(spark, sf_dir):
    return baselines.embedding_gaps(_units(spark, sf_dir)).select("program_id", F.col("gap").cast("long").alias("gap"), F.bround("dissimilarity", 6).alias("dissimilarity"))


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return docs.select(F.col("source").alias("program_id"), F.col("doc_id").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))


_COHESION = """
    WITH tok AS (SELECT source AS program_id, doc_id, i, term FROM (SELECT source, doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS term FROM (
            SELECT source, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents))),
    blk AS (SELECT program_id, (row_number() OVER (PARTITION BY program_id ORDER BY doc_id, i) - 1) // 20 AS block, term FROM tok),
    cnt AS (SELECT program_id, block, term, count(*) AS n FROM blk GROUP BY 1, 2, 3),
    size AS (SELECT program_id, max(block) + 1 AS n FROM blk GROUP BY 1),
    side AS (SELECT c.program_id, g.gap, c.term, sum(CASE WHEN c.block < g.gap THEN c.n ELSE 0 END) AS a, sum(CASE WHEN c.block >= g.gap THEN c.n ELSE 0 END) AS b
        FROM cnt c JOIN (SELECT program_id, unnest(range(10, n - 9)) AS gap FROM size WHERE n >= 20) g ON c.program_id = g.program_id AND c.block BETWEEN g.gap - 10 AND g.gap + 9 GROUP BY 1, 2, 3),
    gaps AS (SELECT program_id, gap, sum(a * b)::DOUBLE / sqrt(sum(a * a)::DOUBLE * sum(b * b)::DOUBLE) AS s FROM side GROUP BY 1, 2)"""


@query("b02_cohesion_gaps", _COHESION + " SELECT program_id, gap, round_even(s, 6) AS similarity FROM gaps")
def b02_gaps(spark, sf_dir):
    out = baselines.text_gaps(_prose(spark, sf_dir))
    return out.select("program_id", F.col("gap").cast("long").alias("gap"), F.bround("similarity", 6).alias("similarity"))


@query("b02_depth_scores", _COHESION + """,
    runs AS (SELECT *, sum(CASE WHEN s > l THEN 1 ELSE 0 END) OVER w AS up, sum(CASE WHEN s < l THEN 1 ELSE 0 END) OVER w AS down
        FROM (SELECT program_id, gap, round_even(s, 6) AS s, lag(round_even(s, 6)) OVER (PARTITION BY program_id ORDER BY gap) AS l FROM gaps) WINDOW w AS (PARTITION BY program_id ORDER BY gap))
    SELECT program_id, gap, round_even(max(s) OVER (PARTITION BY program_id, up) + max(s) OVER (PARTITION BY program_id, down) - 2 * s, 6) AS depth FROM runs""")
def b02_depth(spark, sf_dir):
    gaps = baselines.text_gaps(_prose(spark, sf_dir)).withColumn("similarity", F.bround("similarity", 6))
    return baselines.depth_scores(gaps).select("program_id", F.col("gap").cast("long").alias("gap"), F.bround("depth", 6).alias("depth"))


@query("b02_cohesion_boundaries", _COHESION + """,
    sm AS (SELECT program_id, gap, round_even(avg(round_even(s, 9)) OVER (PARTITION BY program_id ORDER BY gap ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS s FROM gaps),
    runs AS (SELECT *, sum((s > l)::INT) OVER w AS up, sum((s < l)::INT) OVER w AS down FROM (SELECT *, lag(s, 1, s) OVER (PARTITION BY program_id ORDER BY gap) AS l FROM sm) WINDOW w AS (PARTITION BY program_id ORDER BY gap)),
    deep AS (SELECT program_id, gap, round_even(max(s) OVER (PARTITION BY program_id, up) + max(s) OVER (PARTITION BY program_id, down) - 2 * s, 9) AS d FROM runs),
    pk AS (SELECT *, avg(d) OVER p - 0.5 * stddev_pop(d) OVER p AS high, lag(d) OVER o AS l, lead(d) OVER o AS r FROM deep WINDOW p AS (PARTITION BY program_id), o AS (PARTITION BY program_id ORDER BY gap))
    SELECT program_id, gap, round_even(d, 6) AS depth FROM pk WHERE d >= high AND (l IS NULL OR d >= l) AND (r IS NULL OR d > r)""")
def b02(spark, sf_dir):
    out = baselines.cohesion_boundaries(_prose(spark, sf_dir))
    return out.select("program_id", F.col("gap").cast("long").alias("gap"), F.bround("depth", 6).alias("depth"))
