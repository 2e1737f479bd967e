"""Queries over single readers, sinks, lists and plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions import scalars as S
from ..operators import evidence
from ..sources import readers, resolve, sinks
from ..streaming import variants
from . import roles as R
from .catalog import _GRID, _windows, query
from .catalog_io import _docs
from .roles import sql

_ODD = "CAST(substr(program_id, 9, 2) AS INT) % 2 = 1"


@query("s03_asr_documents", sql(f"""
    SELECT program_id, CASE WHEN {_ODD} THEN NULL ELSE 'small' END AS model, CASE WHEN {_ODD} THEN round_even(arg_max(end_sec, seq), 2) ELSE 86400.0 END AS duration_sec FROM seg GROUP BY 1"""))
def s03(spark, sf_dir):
    held = F.to_json(F.struct(F.lit("small").alias("model"), F.lit(R.DAY).alias("duration"), "segments"))
    docs = _docs(spark, sf_dir, start="start_sec", end="end_sec", text="label").select("program_id", F.when(F.expr(_ODD), F.to_json("segments")).otherwise(held).alias("doc"))
    return readers.asr_documents_from(docs)


@query("s04_entries", sql("SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 AS seq, 'A' || label AS text FROM seg QUALIFY label <> 'signup'"))
def s04(spark, sf_dir):
    s = R.segments(spark, sf_dir).withColumn("wide", F.when(F.col("label") == "signup", "　").otherwise(F.concat(F.lit(" Ａ"), "label")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("start_sec", F.col("wide").alias("text")).alias("x")))), lambda r: r["x"])
    docs = s.groupBy("program_id").agg(rows.alias("segments")).select("program_id", F.to_json(F.struct("segments")).alias("doc"))
    return readers.normalised_entries(readers.captions_from(docs)).select("program_id", "seq", "text")


@query("s05_annotations", sql("""
    SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 AS seq, CASE WHEN user_id % 3 = 0 OR seq % 2 = 1 THEN 'own' ELSE 'inner' END || CAST(seq AS VARCHAR) AS frame_id,
        CASE WHEN seq % 2 = 0 THEN user_id ELSE row_number() OVER (PARTITION BY program_id ORDER BY seq) - 1 END::INT AS frame_index, CASE WHEN label = 'view' THEN 0.0 ELSE start_sec END AS timestamp_sec,
        CASE WHEN label = 'click' THEN end_sec WHEN label = 'view' THEN 0.0 ELSE start_sec END AS end_sec, CASE WHEN user_id % 2 = 0 THEN label ELSE '' END AS image_path FROM seg"""))
def s05(spark, sf_dir):
    name = lambda kind: F.concat(F.lit(kind), F.col("seq").cast("string"))
    at = F.when(F.col("label") != "view", F.col("start_sec")).alias("timestamp_sec")
    path, end = F.when(F.col("user_id") % 2 == 0, F.col("label")).alias("image_path"), F.when(F.col("label") == "click", F.col("end_sec")).alias("span_end_sec")
    nested = F.to_json(F.struct(F.when(F.col("user_id") % 3 == 0, name("own")).alias("frame_id"), F.struct(name("inner").alias("frame_id"), F.col("user_id").alias("frame_index"), at).alias("annotation"), path, end))
    items = R.segments(spark, sf_dir).withColumn("item", F.when(F.col("seq") % 2 == 0, nested).otherwise(F.to_json(F.struct(name("own").alias("frame_id"), at, path, end))))
    docs = items.groupBy("program_id").agg(F.concat(F.lit("["), F.array_join(S.ordered(F.col("item"), "seq"), ","), F.lit("]")).alias("doc"))
    return readers.annotations_from(docs).select("program_id", "seq", "frame_id", "frame_index", "timestamp_sec", "end_sec", "image_path")


@query("s08_service_ids", sql(f"SELECT program_id, CASE WHEN {_ODD} THEN CAST(replace(program_id, '-', '') AS INT) END AS service_id FROM prog"))
def s08(spark, sf_dir):
    note = F.when(F.expr(_ODD), F.concat(F.lit("ServiceID:"), F.replace("program_id", F.lit("-"), F.lit("")))).otherwise(F.lit("no number"))
    # the first bytes are a word in code page 932 that isn't valid UTF-8
    return readers.service_ids_from(R.programs(spark, sf_dir).select("program_id", F.concat(F.unhex(F.lit("94D491678D0A")), note.cast("binary")).alias("content")))


@query("s15_interval_frames", sql("""
    SELECT program_id, CAST(k AS BIGINT) AS seq, round_even(least(5.0, d / 2) + k * 700.5, 2) AS timestamp_sec FROM (SELECT program_id, 705.5 + 7005.0 * (CAST(substr(program_id, 9, 2) AS INT) % 3) AS d FROM prog), range(30) t(k)
    WHERE k = 0 OR (k < 20 AND least(5.0, d / 2) + k * 700.5 < d)"""))
def s15(spark, sf_dir):
    # in every third program a frame would fall exactly on the end, where there is none
    lasting = F.lit(705.5) + 7005.0 * (F.substring("program_id", 9, 2).cast("int") % 3)
    return readers.interval_frames(R.programs(spark, sf_dir).withColumn("duration_sec", lasting), 700.5, 20)


@query("s24_image_sizes", sql("SELECT program_id || '/' || CAST(seq AS VARCHAR) AS path, CAST(seq AS INT) AS width, CAST(user_id + 1 AS INT) AS height FROM seg"))
def s24(spark, sf_dir):
    four = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A" + "00" * 8), four(F.col("seq")), four(F.col("user_id") + 1)))
    return resolve.image_sizes(R.segments(spark, sf_dir).select(F.concat_ws("/", "program_id", F.col("seq").cast("string")).alias("path"), header.alias("content")))


@query("k01_documents", sql("""
    SELECT program_id, '{"program_id":"' || program_id || '","rows":[' || string_agg('{"label":"' || label || '","seq":' || CAST(seq AS VARCHAR) || ',"clicked":' || CASE WHEN label = 'click' THEN 'true' ELSE 'null' END || '}', ',' ORDER BY seq) || ']}' AS json FROM seg GROUP BY 1"""))
def k01(spark, sf_dir):
    s = R.segments(spark, sf_dir).withColumn("clicked", F.when(F.col("label") == "click", True))
    return sinks.json_documents(sinks.document(s, "rows", ["label", "seq", "clicked"], ["seq"]))


@query("k02_json_lines", sql("""SELECT '{"program_id":"' || program_id || '","seq":' || CAST(seq AS VARCHAR) || ',"label":' || CASE WHEN label = 'view' THEN 'null' ELSE '"' || label || '"' END || '}' AS json FROM seg"""))
def k02(spark, sf_dir):
    return sinks.json_lines(R.segments(spark, sf_dir).select("program_id", "seq", F.when(F.col("label") != "view", F.col("label")).alias("label")))


@query("k04_evidence_document", sql("""
    SELECT program_id, n, coalesce(spans, '') AS spans, 'captions.json' AS captions FROM (SELECT program_id, count(*) AS n FROM rng GROUP BY 1)
    LEFT JOIN (SELECT program_id, string_agg(CAST(start_sec AS VARCHAR) || '/' || CAST(end_sec AS VARCHAR) || '/' || kind, ';' ORDER BY start_sec, end_sec, kind) AS spans FROM ne GROUP BY 1) USING (program_id)"""))
def k04(spark, sf_dir):
    out = sinks.evidence_document(R.ranges(spark, sf_dir), R.non_editorial(spark, sf_dir), {"captions": "captions.json"})
    spans = F.transform("non_editorial_intervals", lambda x: F.concat_ws("/", x["start_sec"].cast("string"), x["end_sec"].cast("string"), x["kind"]))
    return out.select("program_id", F.size("windows").cast("long").alias("n"), F.coalesce(F.array_join(spans, ";"), F.lit("")).alias("spans"), F.element_at("sources", "captions").alias("captions"))


@query("k05_subtitles", sql("SELECT program_id, 'sub' || lpad(CAST(seq AS VARCHAR), 6, '0') AS subtitle_id, start_sec, end_sec, label AS text FROM seg WHERE label IN ('view', 'click')"))
def k05(spark, sf_dir):
    primary = R.segments(spark, sf_dir).where(F.col("label").isin("view", "click")).withColumn("text", F.col("label"))
    units = evidence.text_units(primary.withColumn("source", F.lit("caption")), F.lit(True), F.lit(False))
    return sinks.text_stage(primary, units, evidence.cue_rows(primary))["subtitles"]


@query("k06_scene_sources", sql("SELECT program_id, seq, CASE label WHEN 'view' THEN 'hash' ELSE 'manual' END AS source FROM seg WHERE label IN ('view', 'purchase')"))
def k06(spark, sf_dir):
    source = F.when(F.col("label") == "view", "hash").when(F.col("label") == "purchase", "manual").when(F.col("label") == "click", "cue")
    return sinks.scene_sources(R.segments(spark, sf_dir).select("program_id", "seq", source.alias("source")))


@query("k07_cm_rows", sql("SELECT program_id, 'cm_' || lpad(CAST(seq AS VARCHAR), 6, '0') AS cm_id, round_even(start_sec, 2) AS start_sec, round_even(end_sec, 2) AS end_sec, kind FROM ne"))
def k07(spark, sf_dir):
    return sinks.cm_rows(R.non_editorial(spark, sf_dir))


@query("k10_validated", sql("SELECT program_id, count(*) AS n, string_agg(CAST(start_sec AS VARCHAR), ' ' ORDER BY start_sec, seq) AS starts FROM pred GROUP BY 1"))
def k10(spark, sf_dir):
    checked = sinks.validated(R.topics(spark, sf_dir, 1).withColumn("topic_id", S.numbered("t", "seq", 3)))
    docs = sinks.document(checked, "topics", ["topic_id", "start_sec", "end_sec", "seq"], ["start_sec", "seq"])
    return docs.select("program_id", F.size("topics").cast("long").alias("n"), F.array_join(F.transform("topics", lambda t: t["start_sec"].cast("string")), " ").alias("starts"))


@query("f01_span_overlap", sql("""
    SELECT program_id, seq, round_even(greatest(0.0::DOUBLE, least(end_sec, e) - greatest(start_sec, s)), 6) AS shared FROM (
        SELECT *, lead(start_sec) OVER w AS s, lead(end_sec) OVER w AS e FROM seg WINDOW w AS (PARTITION BY program_id ORDER BY start_sec, seq)) WHERE s IS NOT NULL"""))
def f01(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("program_id").orderBy("start_sec", "seq")
    s = R.segments(spark, sf_dir).withColumns({"s": F.lead("start_sec").over(w), "e": F.lead("end_sec").over(w)}).where("s IS NOT NULL")
    return s.select("program_id", "seq", F.bround(S.span_overlap("start_sec", "end_sec", "s", "e"), 6).alias("shared"))


@query("f12_confidence_rank", sql("SELECT program_id, seq, CASE WHEN value < 30 THEN 1 WHEN value < 90 THEN 2 WHEN value < 200 THEN 3 ELSE 0 END AS rank FROM seg"))
def f12(spark, sf_dir):
    name = F.when(F.col("value") < 30, "low").when(F.col("value") < 90, "medium").when(F.col("value") < 200, "high")
    return R.segments(spark, sf_dir).select("program_id", "seq", S.confidence_rank(name).alias("rank"))


@query("f14_cue_pattern", sql("SELECT program_id, seq FROM turn WHERE text LIKE '%tion%' OR text LIKE '%ere%' OR regexp_matches(text, 'an(d|t) ')"))
def f14(spark, sf_dir):
    return R.turns(spark, sf_dir).where(F.col("text").rlike(S.any_of(["tion", "ere", "an(d|t) "]))).select("program_id", "seq")


@query("f17_logical_duration", sql("""
    SELECT program_id, seq, CASE label WHEN 'view' THEN 86400.0 WHEN 'click' THEN NULL ELSE CASE WHEN start_sec < end_sec AND end_sec <= 86401 THEN end_sec - start_sec END END AS duration_sec FROM seg"""))
def f17(spark, sf_dir):
    known = F.col("label") != "view"
    s = R.segments(spark, sf_dir).select("program_id", "seq", F.when(known, F.col("start_sec")).alias("a"), F.when(known & (F.col("label") != "click"), F.col("end_sec")).alias("b"))
    return s.select("program_id", "seq", S.logical_duration("a", "b", F.lit(R.DAY)).alias("duration_sec"))


@query("f25_merged_glossaries", sql("""
    SELECT program_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY pos) AS r FROM (
        SELECT program_id, term, min(seq * 100000 + k) AS pos FROM (SELECT program_id, seq, CASE WHEN k % 5 = 1 THEN '1' || x ELSE x END AS term, k FROM (
            SELECT program_id, seq, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS k FROM turn)) WHERE term <> '' GROUP BY 1, 2)) WHERE r <= 30 GROUP BY 1"""))
def f25(spark, sf_dir):
    # every fifth word has a full-width digit before it, which is one to the word with a plain digit
    terms = F.transform(F.split("text", " "), lambda x, i: F.when(i % 5 == 0, F.concat(F.when(F.col("seq") % 2 == 0, "１").otherwise("1"), x)).otherwise(x))
    t = R.turns(spark, sf_dir).select("program_id", "seq", terms.alias("terms"))
    out = t.groupBy("program_id").agg(S.merge_lists(S.ordered(F.col("terms"), "seq"), 30).alias("terms"))
    return out.select("program_id", F.array_join("terms", " ").alias("terms"))


@query("f28_sections", sql("""
    SELECT program_id, seq, CASE WHEN label = 'view' THEN '' ELSE '# Terms' || chr(10) || label || chr(10) || chr(10) END || '# Text' || chr(10) || CAST(user_id AS VARCHAR) AS content FROM seg"""))
def f28(spark, sf_dir):
    terms = F.when(F.col("label") != "view", F.col("label"))
    return R.segments(spark, sf_dir).select("program_id", "seq", S.sections(("# Terms", terms), ("# Text", F.col("user_id").cast("string"))).alias("content"))


#: Groups of forty events, whose purchases (in each third group), views and clicks are texts and whose errors are frames.
_GROUPED = """
    part AS (SELECT program_id, seq // 40 AS g, seq, label, 'user ' || CAST(user_id AS VARCHAR) AS text, user_id AS u, CASE WHEN label = 'purchase' AND (seq // 40) % 3 <> 0 THEN 'none' ELSE label END AS kind FROM seg),
    nth AS (SELECT *, row_number() OVER (PARTITION BY program_id, g, kind ORDER BY seq) AS r FROM part),
    best AS (SELECT program_id, g, CASE WHEN max((kind = 'purchase')::INT) = 1 THEN 'purchase' WHEN max((kind = 'view')::INT) = 1 THEN 'view' ELSE 'click' END AS kind FROM part GROUP BY 1, 2)"""


def _grouped(spark, sf_dir):
    s = R.segments(spark, sf_dir).withColumns({"g": F.expr("seq div 40"), "text": F.concat(F.lit("user "), F.col("user_id").cast("string"))})
    u, named = F.col("user_id"), lambda p, n: F.concat(F.lit(p), (F.col("user_id") % n).cast("string"))
    frame = F.struct(F.array(named("a", 3), named("b", 2)).alias("ocr_texts"), F.when(u % 4 == 0, "").otherwise(named("t", 5)).alias("telop"), named("v", 7).alias("visual"))
    of = lambda label, value: S.ordered(F.when(F.col("label") == label, value), "seq")
    third = F.when(F.col("g") % 3 == 0, F.col("text"))
    return s.groupBy("program_id", "g").agg(of("purchase", third).alias("primary"), of("view", F.col("text")).alias("captions"), of("click", F.col("text")).alias("asr"), of("error", frame).alias("frames"))


@query("f29_evidence_texts", sql("""
    SELECT program_id, g, string_agg(text, '|' ORDER BY pos) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY program_id, g ORDER BY pos) AS place FROM (
        SELECT program_id, g, text, min(pos) AS pos FROM (
            SELECT program_id, g, CASE kind WHEN 'purchase' THEN 'primary: ' WHEN 'view' THEN 'caption: ' ELSE 'asr: ' END || text AS text, r AS pos FROM nth JOIN best USING (program_id, g, kind) WHERE r <= 8
            UNION ALL SELECT program_id, g, 'ocr: a' || CAST(u % 3 AS VARCHAR), 100 * r FROM nth WHERE kind = 'error' AND r <= 8
            UNION ALL SELECT program_id, g, 'ocr: b' || CAST(u % 2 AS VARCHAR), 100 * r + 1 FROM nth WHERE kind = 'error' AND r <= 8
            UNION ALL SELECT program_id, g, 'telop: t' || CAST(u % 5 AS VARCHAR), 100 * r + 2 FROM nth WHERE kind = 'error' AND r <= 8 AND u % 4 <> 0
            UNION ALL SELECT program_id, g, 'visual: v' || CAST(u % 7 AS VARCHAR), 100 * r + 3 FROM nth WHERE kind = 'error' AND r <= 8) GROUP BY 1, 2, 3)) WHERE place <= 24 GROUP BY 1, 2""", _GROUPED))
def f29(spark, sf_dir):
    texts = evidence.evidence_texts(F.col("primary"), F.col("captions"), F.col("asr"), F.col("frames"))
    return _grouped(spark, sf_dir).select("program_id", "g", F.array_join(texts, "|").alias("texts")).where("texts <> ''")


@query("f30_title_summary", sql("""
    SELECT program_id, g, coalesce(telop, spoken, 'group ' || CAST(g AS VARCHAR)) AS title, coalesce(nullif(p8, ''), nullif(c8, ''), nullif(v3, ''), 'Editorial segment with limited text evidence.') AS summary FROM (
        SELECT program_id, g, arg_min('t' || CAST(u % 5 AS VARCHAR), seq) FILTER (WHERE kind = 'error' AND u % 4 <> 0) AS telop, arg_min(text, seq) FILTER (WHERE nth.kind = best.kind) AS spoken,
            string_agg(text, '' ORDER BY seq) FILTER (WHERE kind = 'purchase' AND r <= 8) AS p8, string_agg(text, '' ORDER BY seq) FILTER (WHERE kind = 'view' AND r <= 8) AS c8,
            string_agg('v' || CAST(u % 7 AS VARCHAR), chr(12290) ORDER BY seq) FILTER (WHERE kind = 'error' AND r <= 3) AS v3 FROM nth JOIN best USING (program_id, g) GROUP BY 1, 2)""".replace("WHERE kind", "WHERE nth.kind"), _GROUPED))
def f30(spark, sf_dir):
    telops, visuals = F.transform("frames", lambda f: f["telop"]), F.transform("frames", lambda f: f["visual"])
    spoken = F.when(F.size("primary") > 0, F.col("primary")).when(F.size("captions") > 0, F.col("captions")).otherwise(F.col("asr"))
    fallback = F.concat(F.lit("group "), F.col("g").cast("string"))
    return _grouped(spark, sf_dir).select("program_id", "g", evidence.title(telops, spoken, fallback).alias("title"), evidence.summary(F.col("primary"), F.col("captions"), visuals).alias("summary"))


_FRAME_LISTS = ("frame_ids", "ocr", "telop", "visual", "presentation", "domain")


@query("j02_frame_lists", sql(f"""
    SELECT program_id, 'w' || lpad(CAST(win AS VARCHAR), 4, '0') AS window_id, {', '.join(f"coalesce(string_agg(text, '|' ORDER BY pos) FILTER (WHERE name = '{n}'), '') AS {n}" for n in _FRAME_LISTS)} FROM (
        SELECT *, row_number() OVER (PARTITION BY program_id, win, name ORDER BY pos) AS r FROM (SELECT program_id, win, name, most, text, min(pos) AS pos FROM (
            SELECT program_id, win, 'frame_ids' AS name, 1000000 AS most, seq * 10 AS pos, 'f' || CAST(seq AS VARCHAR) AS text FROM hit
            UNION ALL SELECT program_id, win, 'ocr', 20, seq * 10, 'a' || CAST(u AS VARCHAR) FROM hit UNION ALL SELECT program_id, win, 'ocr', 20, seq * 10 + 1, 'b' || CAST(u % 3 AS VARCHAR) FROM hit
            UNION ALL SELECT program_id, win, 'telop', 8, seq * 10, 't' || CAST(u AS VARCHAR) FROM hit WHERE u % 4 <> 0 UNION ALL SELECT program_id, win, 'visual', 8, seq * 10, 'v' || CAST(u AS VARCHAR) FROM hit
            UNION ALL SELECT program_id, win, 'presentation', 6, seq * 10, 'p' || CAST(u % 9 AS VARCHAR) FROM hit UNION ALL SELECT program_id, win, 'domain', 6, seq * 10, 'd' || CAST(u % 8 AS VARCHAR) FROM hit) GROUP BY 1, 2, 3, 4, 5)) WHERE r <= most GROUP BY 1, 2""", _GRID,
    "hit AS (SELECT g.program_id, g.seq AS win, f.seq, f.user_id AS u FROM grid g JOIN seg f ON g.program_id = f.program_id AND f.label = 'view' AND least(g.end_sec, f.end_sec) > greatest(g.start_sec, f.start_sec))"))
def j02(spark, sf_dir):
    named = lambda p, n=None: F.concat(F.lit(p), (F.col("user_id") % n if n else F.col("user_id")).cast("string"))
    frames = R.segments(spark, sf_dir).where("label = 'view'").select(
        "program_id", "seq", "start_sec", "end_sec", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("frame_id"), F.array(named("a"), named("b", 3)).alias("ocr_texts"),
        F.when(F.col("user_id") % 4 != 0, named("t")).alias("telop"), named("v").alias("visual"), named("p", 9).alias("presentation"), F.array(named("d", 8)).alias("domain_hints"))
    out = evidence.evidence_windows(_windows(spark, sf_dir), frames=frames)
    return out.select("program_id", "window_id", *(F.array_join(c, "|").alias(c) for c in _FRAME_LISTS))


@query("u04_split", sql("SELECT CASE WHEN program_id < '2024-01-15' THEN 'development' ELSE 'evaluation' END AS part, program_id FROM prog"))
def u04_split(spark, sf_dir):
    first = F.col("program_id") < "2024-01-15"
    ids = lambda c: F.struct(F.collect_set(F.when(c, F.col("program_id"))).alias("program_ids"))
    return readers.split_from(R.programs(spark, sf_dir).agg(F.to_json(F.struct(ids(first).alias("development"), ids(~first).alias("evaluation"))).alias("doc")))


@query("x06_glossary", sql("SELECT program_id, CAST(seq AS INT) AS chunk, CASE WHEN text LIKE '%zz%' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS n FROM turn"))
def x06(spark, sf_dir):
    def model(text):
        if "zz" in text:
            raise ValueError("refused")
        return text.split(" ")

    chunks = R.turns(spark, sf_dir).select("program_id", F.col("seq").cast("int").alias("chunk"), "text")
    return models.glossary(chunks, model).select("program_id", "chunk", F.size("terms").cast("long").alias("n"))


@query("x07_boundary_hints", sql("SELECT program_id, CAST(seq AS INT) AS chunk, length(text)::DOUBLE AS time_sec, 'high' AS confidence FROM turn WHERE text NOT LIKE '%zz%' AND length(text) BETWEEN 20 AND 90"))
def x07(spark, sf_dir):
    def model(text):
        if "zz" in text:
            raise ValueError("refused")
        return [(float(len(text)), "title", "high")]

    chunks = R.turns(spark, sf_dir).select("program_id", F.col("seq").cast("int").alias("chunk"), F.lit(20.0).alias("start_sec"), F.lit(90.0).alias("end_sec"), "text")
    return models.boundary_hints(chunks, model).select("program_id", "chunk", "time_sec", "confidence")


@query("a06_token_sums", sql("SELECT program_id, role, sum(length(text))::BIGINT AS tokens FROM turn GROUP BY 1, 2"))
def a06(spark, sf_dir):
    return models.token_counts(R.turns(spark, sf_dir), len).groupBy("program_id", "role").agg(F.sum("tokens").alias("tokens"))


@query("t04_lag_correction", "SELECT time_bucket(INTERVAL '1 minute', ts - INTERVAL '4500 milliseconds') AS start, count(*) AS n FROM events GROUP BY 1")
def t04(spark, sf_dir):
    out = variants.tumbling(variants.corrected(R.table(spark, sf_dir, "events")), [], [F.count("*").alias("n")], "1 minute")
    return out.select(F.col("window.start").alias("start"), "n")
