"""Readers of timed text, annotations, captions, change series, segmentations and logs.

All read with explicit schemas and give the engine's canonical columns (program_id, seq, start_sec,
end_sec, ...); the program is the file's name without its suffix unless a column names it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

_TIMED = "array<struct<start_sec:double,end_sec:double,start:double,end:double,text:string,speaker:string>>"


def _program() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("program_id")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """program_id and the whole text of every JSON file."""
    return spark.read.text(path, wholetext=True).select(_program(), F.col("value").alias("doc"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """program_id, i (in file order) and value of every line."""
    return spark.read.text(path).select(_program(), F.monotonically_increasing_id().alias("i"), "value")


def _timed_rows(docs: DataFrame) -> DataFrame:
    """program_id, seq and the raw fields of a list of timed texts, bare or under `segments`."""
    bare = F.from_json("doc", _TIMED)
    held = F.from_json("doc", f"struct<segments:{_TIMED}>")["segments"]
    rows = F.when(F.ltrim("doc").startswith("["), bare).otherwise(held)
    return docs.select("program_id", F.posexplode(rows).alias("seq", "x")).select("program_id", F.col("seq").cast("long").alias("seq"), "x.*")


def _not_blank(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(S.strip("text"), F.lit("")) != "").withColumn("text", S.strip("text"))


def captions_from(docs: DataFrame, lag_sec: float = 4.5) -> DataFrame:
    """Captions moved forward by their display lag; every one lasts a tenth of a second at least. docs: program_id, doc."""
    raw = _timed_rows(docs)
    s = F.coalesce("start_sec", "start", F.lit(0.0))
    e = F.coalesce("end_sec", "end", s)
    start = F.greatest(F.lit(0.0), s - lag_sec)
    out = raw.select("program_id", "seq", F.bround(start, 2).alias("start_sec"), F.bround(F.greatest(start + 0.1, e - lag_sec), 2).alias("end_sec"), "text", "speaker")
    return _not_blank(out).withColumn("source", F.lit("caption"))


def read_captions(spark: SparkSession, path: str, lag_sec: float = 4.5) -> DataFrame:
    return captions_from(_documents(spark, path), lag_sec)


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    return asr_from(_documents(spark, path))


def asr_from(docs: DataFrame) -> DataFrame:
    """Recognised speech as it is; `start` and `end` come before the longer names."""
    s = F.coalesce("start", "start_sec", F.lit(0.0))
    out = _timed_rows(docs).select("program_id", "seq", F.bround(s, 2).alias("start_sec"), F.bround(F.coalesce("end", "end_sec", s), 2).alias("end_sec"), "text", "speaker")
    return _not_blank(out).withColumn("source", F.lit("asr"))


def asr_documents(spark: SparkSession, path: str) -> DataFrame:
    return asr_documents_from(_documents(spark, path))


def asr_documents_from(docs: DataFrame) -> DataFrame:
    """program_id, model, duration_sec: of bare lists the last end is the duration."""
    head = F.from_json("doc", "struct<model:string,duration_sec:double,duration:double>")
    known = docs.select("program_id", head["model"].alias("model"), F.coalesce(head["duration_sec"], head["duration"]).alias("__d"))
    last = asr_from(docs).groupBy("program_id").agg(F.max_by("end_sec", "seq").alias("__last"))
    return known.join(last, "program_id", "left").select("program_id", "model", F.coalesce("__d", "__last").alias("duration_sec"))


def normalised_entries(captions: DataFrame) -> DataFrame:
    """Captions with compatibility forms resolved, blank ones dropped."""
    return _not_blank(captions.withColumn("text", S.nfkc("text")))


#: The fields of a frame's visual annotation.
ANNOTATION = """struct<frame_id:string,frame_index:int,timestamp_sec:double,visual_summary:string,primary_onscreen_text:string,ocr_texts:array<string>,
    shot_type:string,likely_presentation_form:string,sponsor_presentation:string,non_editorial_kind:string,is_probably_editorial:boolean,
    domain_hints:array<string>,evidence:array<string>,warnings:array<string>>"""


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Frame annotations, nested under `annotation` or flat; malformed files fail the read."""
    return annotations_from(_documents(spark, path))


def annotations_from(docs: DataFrame) -> DataFrame:
    """Annotations of JSON documents (program_id, doc); a record's own frame_id goes before the annotation's."""
    item = f"array<struct<annotation:{ANNOTATION},{ANNOTATION.strip()[len('struct<'):-1]},image_path:string,span_start_sec:double,span_end_sec:double>>"
    options = {"mode": "FAILFAST"}
    rows = F.when(F.ltrim("doc").startswith("["), F.from_json("doc", item, options)).otherwise(F.from_json("doc", f"struct<annotations:{item}>", options)["annotations"])
    each = docs.select("program_id", F.posexplode(rows).alias("seq", "x"))
    names = [f.split(":")[0].strip() for f in ANNOTATION.strip()[len("struct<") : -1].split(",") if ":" in f]
    pick = lambda n: F.coalesce(F.col(f"x.annotation.{n}"), F.col(f"x.{n}"))
    index, at = F.coalesce(pick("frame_index"), F.col("seq")), F.coalesce(pick("timestamp_sec"), F.lit(0.0))
    own = [pick(n).alias(n) for n in names if n not in ("frame_id", "frame_index", "timestamp_sec")]
    own = [F.coalesce(F.nullif("x.frame_id", F.lit("")), F.col("x.annotation.frame_id")).alias("frame_id"), *own, F.coalesce("x.image_path", F.lit("")).alias("image_path")]
    return each.select("program_id", F.col("seq").cast("long").alias("seq"), index.alias("frame_index"), at.alias("timestamp_sec"), F.coalesce("x.span_start_sec", at).alias("start_sec"), F.coalesce("x.span_end_sec", at).alias("end_sec"), *own)


def read_boundaries(spark: SparkSession, path: str, field: str = "boundaries_sec") -> DataFrame:
    return boundaries_from(_documents(spark, path), field)


def boundaries_from(docs: DataFrame, field: str = "boundaries_sec") -> DataFrame:
    """Distinct rounded times of a document's list, in order of seq."""
    times = S.boundary_list(F.from_json("doc", f"struct<{field}:array<double>>")[field])
    return docs.select("program_id", F.posexplode(times).alias("seq", "time_sec")).withColumn("seq", F.col("seq").cast("long"))


#: The form of a caption file's dialogue line and of a position tag.
DIALOGUE = r"^Dialogue:\s*\d+,([\d:.]+),([\d:.]+),(\w+),[^,]*,\d+,\d+,\d+,[^,]*,(.*)$"
POSITION = r"\\pos\((\d+),(\d+)\)"


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    return dialogues_from(_lines(spark, path))


def dialogues_from(lines: DataFrame) -> DataFrame:
    """Caption rows of subtitle files: times, style, raw text, vertical position, text, speaker; empty ones go.

    Rows of equal times stay apart. seq follows the order in the file.
    """
    # each explode keeps what it makes: filters over a projection would repeat its expressions, parsing a line ten times
    once = lambda df, *made: df.select("program_id", "__i", F.explode(F.array(F.struct(*made))).alias("x")).select("program_id", "__i", "x.*")
    fields = F.split(F.regexp_replace("value", DIALOGUE + r"\R?", "\x01$1\x01$2\x01$3\x01$4"), "\x01", 5)
    part = lambda k: F.get("p", F.lit(k))
    y = F.regexp_extract("value", POSITION, 2)
    found = once(lines.where(F.startswith("value", F.lit("Dialogue:"))).withColumnRenamed("i", "__i"), fields.alias("p"), "value").where(part(0) == "")
    rows = once(found, S.caption_time(part(1)).alias("start_sec"), S.caption_time(part(2)).alias("end_sec"), part(3).alias("style"), part(4).alias("raw"), F.when(y != "", y.cast("int")).otherwise(0).alias("y"), S.without_tags(part(4)).alias("__t"))
    own = [c for c in rows.columns if c not in ("program_id", "__i", "__t")]
    spoken = once(rows.where("__t <> ''"), *own, S.speaker("__t").alias("speaker"), S.without_speaker("__t").alias("text")).where("text <> ''")
    w = Window.partitionBy("program_id").orderBy("__i")
    return spoken.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).drop("__i").withColumn("source", F.lit("caption"))


def service_ids(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return service_ids_from(files.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("program_id"), "content"))


def service_ids_from(files: DataFrame) -> DataFrame:
    """program_id, service_id of recording notes (program_id, content) in code page 932."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("cp932", "replace"))

    found = F.regexp_extract(decode("content"), SERVICE_ID, 1)
    return files.select("program_id", F.when(found != "", found.cast("int")).alias("service_id"))


#: The form of a silence filter's log line and of a recording note's service number.
SILENCE_END = r"silence_end:\s*([\d.]+)"
SERVICE_ID = r"ServiceID:(\d+)"


def read_silence_ends(spark: SparkSession, path: str, container_start: float = 0.0) -> DataFrame:
    """Distinct ends of silence in a media tool's log, less the container's start if that is over a second."""
    return silence_ends_from(_lines(spark, path), container_start)


def silence_ends_from(lines: DataFrame, container_start: float = 0.0) -> DataFrame:
    """Distinct ends of silence; with a container start of over a second they count from there, and earlier ones go."""
    zero = container_start if container_start > 1.0 else 0.0
    found = F.explode(F.regexp_extract_all("value", F.lit(SILENCE_END), F.lit(1)))
    each = lines.select("program_id", found.alias("t")).withColumn("t", F.col("t").cast("double"))
    return each.where(F.col("t") >= zero).select("program_id", F.bround(F.col("t") - zero, 3).alias("time_sec")).distinct()


def scene_frames(scenes: DataFrame, media_duration: float, most: int | None = None, offset: float = 0.0) -> DataFrame:
    """One frame in the middle of each scene (of the first `most` ones), with its time in the source."""
    some = scenes if most is None else scenes.where(F.col("seq") < most)
    at = S.mid_frame_time("start_sec", "end_sec", F.lit(media_duration))
    return some.select("program_id", F.concat(S.numbered("scene_", "seq", 4), F.lit("_mid")).alias("frame_id"), F.col("seq").alias("frame_index"), S.round2(at).alias("timestamp_sec"), (at + offset).alias("source_sec"))


def sampled_frames(programs: DataFrame, fps: float, start: float = 0.0) -> DataFrame:
    """Frames at a fixed rate; each stands for the middle of its interval."""
    n = F.floor(F.col("duration_sec") * fps).cast("int")
    return programs.where(n > 0).select("program_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq")).select("program_id", F.col("seq").cast("long").alias("seq"), (F.lit(start) + (F.col("seq") + 0.5) / fps).alias("timestamp_sec"))


def interval_frames(programs: DataFrame, interval: float, most: int | None = None) -> DataFrame:
    """Frames every interval seconds before the program's end, the first after five seconds or half the program; one at least."""
    first = F.least(F.lit(5.0), F.col("duration_sec") / 2.0)
    n = F.ceil((F.col("duration_sec") - first) / interval).cast("int") - 1
    n = n if most is None else F.least(n, F.lit(most - 1))
    return programs.select("program_id", first.alias("__f"), F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).alias("seq")).select("program_id", F.col("seq").cast("long").alias("seq"), S.round2(F.col("__f") + F.col("seq") * interval).alias("timestamp_sec"))


_TOPICS = "array<struct<topic_id:string,start_sec:double,end_sec:double,domain:string,label:string,notes:string>>"


def read_segmentations(spark: SparkSession, path: str) -> DataFrame:
    return segmentations_from(_documents(spark, path))


def segmentations_from(docs: DataFrame) -> DataFrame:
    """Topics of true or predicted segmentations: one row a topic with its program's duration."""
    x = F.from_json("doc", f"struct<program_id:string,duration_sec:double,condition:string,topics:{_TOPICS}>")
    docs = docs.select(x.alias("x"), F.col("program_id").alias("file"))
    each = docs.select(F.coalesce("x.program_id", "file").alias("program_id"), "x.duration_sec", "x.condition", F.posexplode_outer("x.topics").alias("seq", "t"))
    return each.select("program_id", F.col("seq").cast("long").alias("seq"), "duration_sec", "condition", "t.*")


def read_end_boundaries(spark: SparkSession, path: str) -> DataFrame:
    b = "array<struct<boundary_id:string,direction:string,left_topic_id:string,right_topic_id:string,recording_time_sec:double,logical_time_sec:double,presentation_type:string,uncertainty_sec:double,confidence:string,notes:string>>"
    x = F.from_json("doc", f"struct<program_id:string,boundaries:{b}>")
    return _documents(spark, path).select(F.coalesce(x["program_id"], "program_id").alias("program_id"), F.explode(x["boundaries"]).alias("b")).select("program_id", "b.*")


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """program_id and chapters, a map from HH:MM:SS to title."""
    return _documents(spark, path).select("program_id", F.from_json("doc", "map<string,string>").alias("chapters"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return split_from(_documents(spark, path))


def split_from(docs: DataFrame) -> DataFrame:
    """part and program_id of a manifest of disjoint parts; parts that share a program raise."""
    part = "struct<program_ids:array<string>>"
    docs = docs.select(F.from_json("doc", f"struct<development:{part},evaluation:{part}>").alias("x"))
    each = lambda n: docs.select(F.lit(n).alias("part"), F.explode(f"x.{n}.program_ids").alias("program_id"))
    a, b = each("development"), each("evaluation")
    if a.select("program_id").intersect(b.select("program_id")).take(1):
        raise ValueError("the parts share programs")
    return a.union(b)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of metrics with a header."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
