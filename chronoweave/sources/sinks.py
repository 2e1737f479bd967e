"""What a run leaves behind: tables, documents, flat files and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators.joins import KEY


def document(df: DataFrame, name: str, fields: list[str], order: list[str], key: str = KEY) -> DataFrame:
    """One row a program with its rows as an ordered array of structs."""
    rest = [f for f in fields if f not in order]
    rows = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return df.groupBy(key).agg(F.transform(rows, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def json_documents(df: DataFrame, key: str = KEY) -> DataFrame:
    """program_id and the row as one JSON text."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row; null fields stay."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    json_lines(df).write.mode(mode).text(path)


def json_schema(schema: T.DataType) -> dict:
    """The strict JSON schema of a struct type: all fields required, no others; nullable ones may be null."""
    plain = {"string": "string", "double": "number", "float": "number", "boolean": "boolean", "integer": "integer", "long": "integer", "short": "integer"}
    if isinstance(schema, T.StructType):
        fields = {f.name: json_schema(f.dataType) if not f.nullable else {"anyOf": [json_schema(f.dataType), {"type": "null"}]} for f in schema.fields}
        return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    if isinstance(schema, T.ArrayType):
        return {"type": "array", "items": json_schema(schema.elementType)}
    return {"type": plain[schema.typeName()]}


def response_format(name: str, schema: T.StructType) -> dict:
    return {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": json_schema(schema)}}


def validated(topics: DataFrame, key: str = KEY) -> DataFrame:
    """topics, where a missing id or time, or a span that doesn't go forward, fails the job."""
    ok = F.col(key).isNotNull() & F.col("topic_id").isNotNull() & (F.col("start_sec") >= 0) & (F.col("end_sec") >= F.col("start_sec"))
    say = F.concat(F.lit("invalid topic: "), F.to_json(F.struct(key, "topic_id", "start_sec", "end_sec")))
    return topics.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(say).cast("boolean")))


def write_metadata(topics: DataFrame, path: str, mode: str = "error") -> None:
    """Validate, then write one JSON document a program."""
    checked = validated(topics)
    json_documents(document(checked, "topics", [c for c in checked.columns if c != KEY], ["start_sec"])).select("json").write.mode(mode).text(path)


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns only, with lists, maps and structs as JSON texts."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in columns))


def write_csv(df: DataFrame, columns: list[str], path: str, mode: str = "error") -> None:
    flat(df, columns).write.mode(mode).csv(path, header=True)


def evidence_document(windows: DataFrame, non_editorial: DataFrame, sources: dict[str, str], key: str = KEY) -> DataFrame:
    """Windows, non-editorial spans and source paths of each program."""
    w = document(windows, "windows", [c for c in windows.columns if c != key], ["start_sec"], key)
    n = document(non_editorial, "non_editorial_intervals", ["start_sec", "end_sec", "kind"], ["start_sec", "end_sec"], key)
    paths = F.create_map(*(F.lit(x) for kv in sources.items() for x in kv)) if sources else F.create_map().cast("map<string,string>")
    return w.join(n, key, "left").withColumn("sources", paths)


def text_stage(primary: DataFrame, units: DataFrame, cues: DataFrame) -> dict[str, DataFrame]:
    """The three tables of the text stage."""
    subtitles = primary.select(KEY, S.numbered("sub", "seq", 6).alias("subtitle_id"), "start_sec", "end_sec", "text")
    return {"subtitles": subtitles, "text_units": units, "cues": cues}


def cm_rows(non_editorial: DataFrame, key: str = KEY) -> DataFrame:
    return non_editorial.select(key, S.numbered("cm_", "seq", 6).alias("cm_id"), S.round2("start_sec").alias("start_sec"), S.round2("end_sec").alias("end_sec"), "kind")


def non_editorial_segments(spans: DataFrame, key: str = KEY) -> DataFrame:
    """Numbered segments with what their kind is called."""
    names = F.create_map(*(F.lit(x) for kv in S.KIND_SUMMARY.items() for x in kv))
    return spans.select(key, S.numbered("ne", "seq", 3).alias("segment_id"), S.round2("start_sec").alias("start_sec"), S.round2("end_sec").alias("end_sec"), "kind", F.element_at(names, F.col("kind")).alias("summary"))


def scene_sources(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("source").isin("hash", "manual"))


def frame_manifest(frames: DataFrame, scenes: DataFrame, files: DataFrame, sizes: DataFrame) -> DataFrame:
    """Frames with their scene (by the scenes' lists, else by the frame's name), checksum and size.

    scenes: key, scene_id, frame_ids. files: path, content. sizes: path, width, height.
    """
    of = scenes.select(KEY, "scene_id", F.explode("frame_ids").alias("frame_id"))
    content = files.select("path", F.sha2("content", 256).alias("sha256"))
    out = frames.join(of, [KEY, "frame_id"], "left").join(content, "path", "left").join(sizes, "path", "left")
    return out.withColumns({"scene_id": F.coalesce("scene_id", S.scene_of_frame("frame_id")), "topic_ids": F.array().cast("array<string>")})


def research_rows(topics: DataFrame, scenes: DataFrame, segments: DataFrame, key: str = KEY) -> DataFrame:
    """Topics, scenes and non-editorial segments in one table, told apart by level."""
    a = topics.select(key, F.lit("topic").alias("level"), F.col("topic_id").alias("item_id"), "start_sec", "end_sec", "domain", "title")
    b = scenes.select(key, F.lit("scene").alias("level"), F.col("scene_id").alias("item_id"), "start_sec", "end_sec")
    c = segments.select(key, F.lit("non_editorial").alias("level"), F.col("segment_id").alias("item_id"), "start_sec", "end_sec", F.col("kind").alias("title"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def search_documents(topics: DataFrame, key: str = KEY, short: int = 600, long: int = 1000) -> DataFrame:
    """Topics as search documents with excerpts of their first eight evidence texts."""
    text = F.array_join(F.slice("evidence", 1, 8), " ")
    return topics.select(key, "topic_id", "title", "summary", "domain", "start_sec", "end_sec", S.truncate_text(text, short).alias("excerpt"), S.truncate_text(text, long).alias("body"))


def config_hash(parameters: Column) -> Column:
    """The first 16 digits of the SHA-256 of a row of parameters as JSON."""
    return S.short_hash(F.to_json(parameters), 16)


def run_manifest(programs: DataFrame, parameters: dict[str, str]) -> DataFrame:
    struct = F.struct(*(F.lit(v).alias(k) for k, v in sorted(parameters.items())))
    return programs.select(KEY, F.to_json(struct).alias("parameters"), config_hash(struct).alias("config_hash"))


def stage_counts(stages: dict[str, DataFrame], key: str = KEY) -> DataFrame:
    """One row a program with the number of rows of each stage."""
    each = [df.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    out = each[0]
    for df in each[1:]:
        out = out.union(df)
    return out.groupBy(key).pivot("stage", list(stages)).agg(F.first("n")).na.fill(0)
