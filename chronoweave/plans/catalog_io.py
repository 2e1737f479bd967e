"""Queries over sources, sinks, scalar functions, models and streaming variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions import scalars as S
from ..operators import evidence, folds, intervals, joins
from ..sources import readers, resolve, sinks
from ..streaming import variants
from . import roles as R
from .catalog import _ISLANDS, query
from .roles import sql


def _docs(spark, sf_dir, **names):
    """Every program's segments as a JSON document; names gives the fields' columns."""
    s = R.segments(spark, sf_dir)
    fields = F.struct(*(F.col(c).alias(n) for n, c in names.items()))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", fields.alias("x")))), lambda r: r["x"])
    return s.groupBy("program_id").agg(rows.alias("segments"))


@query("s01_captions", sql("""
    SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 AS seq, round_even(greatest(0, start_sec - 4.5), 2) AS start_sec,
        round_even(greatest(greatest(0, start_sec - 4.5) + 0.1, end_sec - 4.5), 2) AS end_sec, label AS text FROM seg"""))
def s01(spark, sf_dir):
    docs = _docs(spark, sf_dir, start_sec="start_sec", end_sec="end_sec", text="label").select("program_id", F.to_json(F.struct("segments")).alias("doc"))
    return readers.captions_from(docs).select("program_id", "seq", "start_sec", "end_sec", "text")


@query("s02_asr", sql("SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 AS seq, round_even(start_sec, 2) AS start_sec, round_even(end_sec, 2) AS end_sec, label AS text FROM seg"))
def s02(spark, sf_dir):
    docs = _docs(spark, sf_dir, start="start_sec", end="end_sec", text="label").select("program_id", F.to_json("segments").alias("doc"))
    return readers.asr_from(docs).select("program_id", "seq", "start_sec", "end_sec", "text")


@query("s06_boundaries", sql("SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY t) - 1 AS seq, t AS time_sec FROM (SELECT DISTINCT program_id, round_even(start_sec, 2) AS t FROM seg)"))
def s06(spark, sf_dir):
    s = R.segments(spark, sf_dir).groupBy("program_id").agg(F.collect_list("start_sec").alias("boundaries_sec"))
    return readers.boundaries_from(s.select("program_id", F.to_json(F.struct("boundaries_sec")).alias("doc")))


@query("s07_dialogues", sql("""
    SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 AS seq, floor(start_sec)::DOUBLE AS start_sec, floor(start_sec) + 2.5::DOUBLE AS end_sec, CAST(user_id AS VARCHAR) AS speaker, label AS text, CAST(user_id AS INT) AS y FROM seg"""))
def s07(spark, sf_dir):
    s = R.segments(spark, sf_dir)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    t = F.floor("start_sec")
    at = lambda x, c: F.concat(F.floor(x / 3600).cast("string"), F.lit(":"), two(F.floor(x % 3600 / 60)), F.lit(":"), two(x % 60), F.lit(c))
    line = F.concat(F.lit("Dialogue: 0,"), at(t, ".00"), F.lit(","), F.concat(at(t + 2, ".50")), F.lit(",nsz,,0,0,0,,{\\pos(10,"), F.col("user_id").cast("string"), F.lit(")}（"), F.col("user_id").cast("string"), F.lit("） "), "label")
    lines = s.select("program_id", F.col("seq").alias("i"), line.alias("value")).union(s.select("program_id", "seq", F.lit("Comment: not a dialogue")))
    return readers.dialogues_from(lines).select("program_id", "seq", "start_sec", "end_sec", "speaker", "text", "y")


@query("s21_silence_ends", sql("SELECT DISTINCT program_id, round_even(end_sec - 20000.0, 3) AS time_sec FROM seg WHERE end_sec >= 20000"))
def s21(spark, sf_dir):
    lines = R.segments(spark, sf_dir).select("program_id", F.col("seq").alias("i"), F.concat(F.lit("[silencedetect] silence_end: "), F.format_string("%.2f", "end_sec"), F.lit(" | silence_duration: 1")).alias("value"))
    return readers.silence_ends_from(lines, 20000.0)


@query("s13_segmentations", sql("SELECT program_id, seq, 86400.0::DOUBLE AS duration_sec, start_sec, end_sec, label FROM truth"))
def s13(spark, sf_dir):
    t = R.topics(spark, sf_dir, 0).withColumn("topic_id", S.numbered("t", "seq", 3))
    docs = sinks.document(t, "topics", ["topic_id", "start_sec", "end_sec", "label", "seq"], ["seq"]).withColumn("duration_sec", F.lit(R.DAY))
    found = readers.segmentations_from(docs.select("program_id", F.to_json(F.struct("program_id", "duration_sec", "topics")).alias("doc")))
    return found.select("program_id", "seq", "duration_sec", "start_sec", "end_sec", "label")


@query("s16_scene_frames", sql("""
    SELECT program_id, 'scene_' || lpad(CAST(seq AS VARCHAR), 4, '0') || '_mid' AS frame_id, CASE WHEN e - s > 100 THEN greatest(s, least(greatest(s + 25, least(m, e - 25)), e, 8639950)) ELSE greatest(s, least(m, 8639950)) END / 100.0::DOUBLE AS timestamp_sec
    FROM (SELECT *, h // 2 + CASE WHEN h % 2 = 1 AND (h // 2) % 2 = 1 THEN 1 ELSE 0 END AS m FROM (
        SELECT program_id, seq, CAST(round(start_sec * 100) AS BIGINT) AS s, CAST(round(end_sec * 100) AS BIGINT) AS e, CAST(round(start_sec * 100) AS BIGINT) + CAST(round(end_sec * 100) AS BIGINT) AS h FROM rng))"""))
def s16(spark, sf_dir):
    return readers.scene_frames(R.ranges(spark, sf_dir), R.DAY).select("program_id", "frame_id", "timestamp_sec")


@query("s18_sampled_frames", sql("SELECT program_id, CAST(k AS BIGINT) AS seq, (k + 0.5::DOUBLE) / 0.01::DOUBLE AS timestamp_sec FROM prog, range(864) t(k)"))
def s18(spark, sf_dir):
    return readers.sampled_frames(R.programs(spark, sf_dir), 0.01)


@query("f23_best_source", sql("""
    SELECT program_id, seq, source FROM (SELECT *, min(p) OVER (PARTITION BY program_id) AS best FROM (
        SELECT program_id, seq, CASE label WHEN 'view' THEN 'caption' WHEN 'click' THEN 'asr' END AS source, CASE label WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS p FROM seg
        WHERE label IN ('view', 'click') AND NOT (label = 'view' AND program_id < '2024-01-10'))) WHERE p = best"""))
def f23(spark, sf_dir):
    source = F.when(F.col("label") == "view", "caption").when(F.col("label") == "click", "asr")
    s = R.segments(spark, sf_dir).withColumn("source", source).where(F.col("source").isNotNull() & ~((F.col("label") == "view") & (F.col("program_id") < "2024-01-10")))
    return evidence.best_source(s.select("program_id", "seq", "source"))


@query("f20_text_units", sql("""
    SELECT program_id, 'tu' || lpad(CAST(row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 AS VARCHAR), 6, '0') AS unit_id, start_sec, greatest(end_sec, start_sec + 0.1) AS end_sec,
        CASE label WHEN 'view' THEN 'subtitle' WHEN 'click' THEN 'asr' ELSE 'none' END AS provenance, CASE label WHEN 'view' THEN 0.78 WHEN 'click' THEN 0.55 ELSE 0.0 END::DOUBLE AS confidence FROM seg"""))
def f20(spark, sf_dir):
    s = R.segments(spark, sf_dir).select("program_id", "seq", "start_sec", "end_sec", F.col("label").alias("text"), F.when(F.col("label") == "view", "caption").when(F.col("label") == "click", "asr").otherwise("none").alias("source"))
    return evidence.text_units(s, F.lit(True), F.lit(False)).drop("text")


@query("f03_text_forms", sql("""
    SELECT program_id, seq, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '...' ELSE t END AS cut, '[' || CAST(seq * 61 // 60 AS VARCHAR) || ':' || lpad(CAST(seq * 61 % 60 AS VARCHAR), 2, '0') || '] ' || role AS line,
        CASE WHEN seq * 997 >= 3600 THEN CAST(seq * 997 // 3600 AS VARCHAR) || ':' || lpad(CAST(seq * 997 % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(seq * 997 // 60 AS VARCHAR) END || ':' || lpad(CAST(seq * 997 % 60 AS VARCHAR), 2, '0') AS clock,
        lower(regexp_replace(text, '\\s+', '', 'g')) AS compact FROM (SELECT *, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM turn)"""))
def f03(spark, sf_dir):
    t = R.turns(spark, sf_dir)
    return t.select("program_id", "seq", S.truncate_text("text", 60).alias("cut"), S.timeline_line(F.col("seq") * 61, F.col("role")).alias("line"), S.clock(F.col("seq") * 997).alias("clock"), S.compact("text").alias("compact"))


@query("f04_dedupe", sql("""
    SELECT program_id, string_agg(role, ',' ORDER BY first) AS roles, count(*) AS n FROM (SELECT program_id, role, min(seq) AS first FROM turn WHERE trim(role) <> '' GROUP BY 1, 2) GROUP BY 1"""))
def f04(spark, sf_dir):
    out = R.turns(spark, sf_dir).groupBy("program_id").agg(S.dedupe(S.ordered(F.col("role"), "seq"), 6).alias("r"))
    return out.select("program_id", F.array_join("r", ",").alias("roles"), F.size("r").cast("long").alias("n"))


@query("f22_segments", sql("""
    SELECT program_id, 'ne' || lpad(CAST(i AS VARCHAR), greatest(3, length(CAST(i AS VARCHAR)))::INT, '0') AS segment_id, start_sec, end_sec, kind,
        CASE kind WHEN 'commercial' THEN 'CM/ad interval' ELSE 'program promotion interval' END AS summary
    FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY start_sec, end_sec, kind) - 1 AS i FROM merged)""", _ISLANDS))
def f22(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("program_id").orderBy("start_sec", "end_sec", "kind")
    merged = intervals.merge_islands(R.non_editorial(spark, sf_dir)).withColumn("seq", F.row_number().over(w) - 1)
    return sinks.non_editorial_segments(merged)


@query("f15_non_editorial", sql("""
    SELECT program_id, seq, CASE WHEN kind0 = 'none' AND full_ THEN 'sponsor' WHEN kind0 = 'none' THEN 'ambiguous' ELSE kind0 END AS kind FROM (
        SELECT program_id, seq, CASE label WHEN 'error' THEN 'commercial' WHEN 'signup' THEN 'sponsor' ELSE 'none' END AS kind0, user_id % 2 = 0 AS editorial, user_id % 7 = 0 AS full_ FROM seg)
    WHERE (kind0 <> 'none' AND NOT editorial) OR kind0 = 'commercial' OR full_"""))
def f15(spark, sf_dir):
    s = R.segments(spark, sf_dir).withColumns({
        "kind": F.when(F.col("label") == "error", "commercial").when(F.col("label") == "signup", "sponsor").otherwise("none"), "editorial": F.col("user_id") % 2 == 0,
        "sponsor": F.when(F.col("user_id") % 7 == 0, "fullscreen_sponsor_credit").otherwise("none")})
    return s.where(S.is_non_editorial("kind", "editorial", "sponsor")).select("program_id", "seq", S.resolved_kind("kind", "sponsor").alias("kind"))


@query("f24_first_windows", sql("""
    SELECT program_id, seq, omitted FROM (SELECT program_id, seq, row_number() OVER (PARTITION BY program_id ORDER BY seq) AS r, greatest(count(*) OVER (PARTITION BY program_id) - 20, 0) AS omitted FROM rng) WHERE r <= 20"""))
def f24(spark, sf_dir):
    return evidence.first_windows(R.ranges(spark, sf_dir), 20).select("program_id", "seq", "omitted")


@query("f24_payload", sql("""
    SELECT r.program_id, count(*) AS windows, any_value(omitted) AS omitted, any_value(segments) AS segments, any_value(CASE WHEN hints > 0 THEN 6 ELSE 5 END) AS rules, any_value(coalesce(hints, 0)) AS hints FROM (
        SELECT program_id, seq, row_number() OVER (PARTITION BY program_id ORDER BY seq) AS r, greatest(count(*) OVER (PARTITION BY program_id) - 20, 0) AS omitted FROM rng) r
    LEFT JOIN (SELECT program_id, count(*) AS segments FROM ne GROUP BY 1) s USING (program_id) LEFT JOIN (SELECT program_id, count(*) AS hints FROM hint WHERE rank = 3 GROUP BY 1) h USING (program_id) WHERE r <= 20 GROUP BY 1"""))
def f24_payload(spark, sf_dir):
    hints = R.hints(spark, sf_dir).where("rank = 3").select("program_id", "seq", "time_sec")
    out = evidence.finaliser_payload(R.programs(spark, sf_dir), R.ranges(spark, sf_dir), R.non_editorial(spark, sf_dir), hints, most=20)
    count = lambda path: F.coalesce(F.json_array_length(F.get_json_object("payload", path)), F.lit(0)).cast("long")
    return out.select("program_id", count("$.windows").alias("windows"), F.get_json_object("payload", "$.omitted").cast("long").alias("omitted"), count("$.segments").alias("segments"), count("$.rules").alias("rules"), count("$.hints").alias("hints"))


@query("f31_visual_candidates", sql("SELECT program_id, round_even(start_sec, 2) AS time_sec FROM (SELECT program_id, start_sec FROM rng UNION SELECT program_id, end_sec FROM rng) GROUP BY 1, 2"))
def f31(spark, sf_dir):
    scenes = intervals.scene_cut_candidates(R.ranges(spark, sf_dir), R.programs(spark, sf_dir))
    cuts = scenes.select("program_id", "time_sec", F.lit("scene_detector").alias("source"))
    others = R.points(spark, sf_dir, "click").select("program_id", "time_sec", F.when(F.col("seq") % 2 == 0, "cue").otherwise("cm_detector"))
    return evidence.visual_candidates(cuts.union(others)).select("program_id", "time_sec")


@query("g10_token_pieces", sql("""
    SELECT program_id, seq, CASE WHEN whole <= 40 THEN 1 ELSE 0 END AS is_whole FROM (SELECT program_id, seq, length(text) AS whole FROM turn)"""))
def g10(spark, sf_dir):
    pieces = models.token_pieces(R.turns(spark, sf_dir), 40, len)
    same = (F.size("pieces") == 1) & (F.length("text") <= 40)
    joined = F.array_join("pieces", "\n") == F.col("text")
    return pieces.where(joined).select("program_id", "seq", same.cast("int").alias("is_whole"))


@query("x03_synthesise", sql("SELECT program_id, 0 AS seq, min(start_sec) AS start_sec FROM rng GROUP BY 1"))
def x03(spark, sf_dir):
    payloads = evidence.finaliser_payload(R.programs(spark, sf_dir), R.ranges(spark, sf_dir), R.non_editorial(spark, sf_dir), most=20)
    found = models.synthesise(payloads, lambda p: [{"start_sec": p["windows"][0]["start_sec"], "end_sec": p["program"]["duration_sec"]}])
    return found.select("program_id", "seq", "start_sec")


@query("a02_batch_ranges", sql("SELECT program_id, user_id % 5 AS batch, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM seg GROUP BY 1, 2"))
def a02(spark, sf_dir):
    return folds.batch_ranges(R.segments(spark, sf_dir).withColumn("batch", F.col("user_id") % 5))


@query("k03_flat_rows", sql("SELECT program_id, seq, '[\"' || label || '\"]' AS labels FROM seg"))
def k03(spark, sf_dir):
    s = R.segments(spark, sf_dir).withColumn("labels", F.array("label"))
    return sinks.flat(s, ["program_id", "seq", "labels"])


@query("k08_frame_manifest", sql("""
    SELECT program_id, 'scene_' || CAST(seq AS VARCHAR) || '_a' AS frame_id, CASE WHEN seq % 2 = 0 THEN 'scene_' || CAST(seq // 2 AS VARCHAR) ELSE 'scene_' || CAST(seq AS VARCHAR) END AS scene_id, sha256(label) AS sha256 FROM seg"""))
def k08(spark, sf_dir):
    s = R.segments(spark, sf_dir)
    frame = F.concat(F.lit("scene_"), F.col("seq").cast("string"), F.lit("_a"))
    frames = s.select("program_id", frame.alias("frame_id"), F.col("label").alias("path"))
    scenes = s.where("seq % 2 = 0").select("program_id", F.concat(F.lit("scene_"), F.expr("CAST(seq div 2 AS STRING)")).alias("scene_id"), F.array(frame).alias("frame_ids"))
    files = s.select(F.col("label").alias("path"), F.col("label").cast("binary").alias("content")).distinct()
    sizes = files.select("path", F.lit(1).alias("width"), F.lit(1).alias("height"))
    return sinks.frame_manifest(frames, scenes, files, sizes).select("program_id", "frame_id", "scene_id", "sha256")


@query("k09_research_rows", sql("""
    SELECT program_id, 'topic' AS level, start_sec, end_sec FROM truth UNION ALL SELECT program_id, 'scene', start_sec, end_sec FROM rng UNION ALL SELECT program_id, 'non_editorial', start_sec, end_sec FROM ne"""))
def k09(spark, sf_dir):
    t = R.topics(spark, sf_dir, 0).select("program_id", S.numbered("t", "seq", 3).alias("topic_id"), "start_sec", "end_sec", F.col("label").alias("domain"), F.col("label").alias("title"))
    scenes = R.ranges(spark, sf_dir).withColumn("scene_id", S.numbered("scene_", "seq", 4))
    out = sinks.research_rows(t, scenes, sinks.non_editorial_segments(R.non_editorial(spark, sf_dir)))
    return out.select("program_id", "level", "start_sec", "end_sec")


@query("k11_config_hash", sql("""SELECT program_id, '{"gap":"5.0","window":"60"}' AS parameters, substr(sha256('{"gap":"5.0","window":"60"}'), 1, 16) AS config_hash FROM prog"""))
def k11(spark, sf_dir):
    return sinks.run_manifest(R.programs(spark, sf_dir), {"window": "60", "gap": "5.0"})


@query("k13_unfinished_batches", sql("SELECT program_id, batch, n FROM (SELECT program_id, user_id % 5 AS batch, count(*) AS n FROM seg GROUP BY 1, 2) WHERE batch IN (0, 3)"))
def k13(spark, sf_dir):
    work = R.segments(spark, sf_dir).groupBy("program_id", (F.col("user_id") % 5).alias("batch")).agg(F.count("*").alias("n"))
    done = work.where("batch <> 3").withColumn("n", F.when(F.col("batch") == 0, F.col("n") + 1).otherwise(F.col("n")))
    return resolve.unfinished(work, done, ["program_id", "batch"])


@query("k15_stage_counts", sql("""
    SELECT program_id, count(*) AS segments, count(*) FILTER (WHERE label = 'click') AS clicks, count(*) FILTER (WHERE label IN ('error', 'signup')) AS non_editorial FROM seg GROUP BY 1"""))
def k15(spark, sf_dir):
    return sinks.stage_counts({"segments": R.segments(spark, sf_dir), "clicks": R.points(spark, sf_dir, "click"), "non_editorial": R.non_editorial(spark, sf_dir)})


@query("u05_unmatched", sql("SELECT program_id, seq FROM click EXCEPT SELECT c.program_id, c.seq FROM click c JOIN buy b ON c.program_id = b.program_id AND abs(c.time_sec - b.time_sec) <= 60"))
def u05(spark, sf_dir):
    near = joins.nearest(R.points(spark, sf_dir, "click"), R.points(spark, sf_dir, "purchase"), 60.0)
    return near.where(F.col("near_seq").isNull()).select("program_id", "seq")


@query("x05_refine_with_fallback", sql("SELECT program_id, CAST(0 AS INT) AS batch, seq, text, user_ AS fallback FROM (SELECT *, max((text LIKE '%zz%')::INT) OVER (PARTITION BY program_id) = 1 AS user_ FROM turn)"))
def x05(spark, sf_dir):
    def model(given, context):
        if any("zz" in t for t in given):
            raise ValueError("refused")
        return given

    rows = R.turns(spark, sf_dir).select("program_id", F.lit(0).alias("batch"), "seq", F.col("seq").cast("double").alias("start_sec"), (F.col("seq") + 1.0).alias("end_sec"), "text", F.lit("").alias("context"))
    return models.refine(rows, model).select("program_id", "batch", "seq", "text", "fallback")


@query("x08_token_counts", sql("""
    SELECT program_id, sum((length(regexp_replace(text, '[^\\x21-\\x7e]', '', 'g')) + 3) // 4 + length(regexp_replace(text, '[\\x00-\\x7e\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')))::BIGINT AS tokens FROM turn GROUP BY 1"""))
def x08(spark, sf_dir):
    return models.token_counts(R.turns(spark, sf_dir)).groupBy("program_id").agg(F.sum("tokens").alias("tokens"))


@query("t01_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t01(spark, sf_dir):
    out = variants.tumbling(R.table(spark, sf_dir, "events"), [F.col("event_type")], [F.count("*").alias("n")], "1 hour")
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query("t02_sliding", """
    SELECT s AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS s, ts FROM events, range(2) t(k)) GROUP BY 1""")
def t02(spark, sf_dir):
    out = variants.sliding(R.table(spark, sf_dir, "events"), [], [F.count("*").alias("n")], "2 hours", "1 hour")
    return out.select(F.col("window.start").alias("start"), "n")


@query("t03_sessions", """
    SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def t03(spark, sf_dir):
    out = variants.sessions(R.table(spark, sf_dir, "events"), [F.col("user_id")], [F.count("*").alias("n")], 6 * 3600.0)
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")
