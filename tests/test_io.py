"""Readers over files, resolvers, sinks, plug-ins and streams."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import models
from chronoweave.operators import folds
from chronoweave.sources import readers, resolve, sinks
from chronoweave.streaming import variants


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_captions_bare_or_held(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"start_sec": 10, "end_sec": 12, "text": " x "}, {"start_sec": 1, "text": "　"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"segments": [{"start": 2.0, "end": 3.0, "text": "y"}]}))
    assert rows(readers.read_captions(spark, str(tmp_path)), "program_id", "start_sec", "end_sec", "text") == [("a", 5.5, 7.5, "x"), ("b", 0.0, 0.1, "y")]
    assert rows(readers.asr_documents(spark, str(tmp_path)), "program_id", "duration_sec") == [("a", 12.0), ("b", 3.0)]


def test_dialogues(spark, tmp_path):
    (tmp_path / "p.ass").write_text("[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,nsz,,0,0,0,,{\\pos(5,9)}（司会） はい\nDialogue: 0,0:00:03.00,0:00:04.00,nsz,,0,0,0,,{\\x}\n")
    assert rows(readers.read_dialogues(spark, str(tmp_path)), "seq", "start_sec", "end_sec", "speaker", "text", "y") == [(0, 1.0, 2.5, "司会", "はい", 9)]


def test_annotations_nested_or_flat(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"annotation": {"frame_id": "f", "ocr_texts": ["t"]}, "span_start_sec": 1.0, "span_end_sec": 2.0}, {"frame_id": "g", "timestamp_sec": 7.0}]))
    assert rows(readers.read_annotations(spark, str(tmp_path)), "frame_id", "frame_index", "start_sec", "end_sec") == [("f", 0, 1.0, 2.0), ("g", 1, 7.0, 7.0)]


def test_notes_in_another_code_page(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes("番組 ServiceID:1024".encode("cp932"))
    assert rows(readers.service_ids(spark, str(tmp_path)), "program_id", "service_id") == [("p", 1024)]


def test_frames_at_intervals_end_before_the_program(spark):
    p = spark.createDataFrame([("a", 25.0), ("b", 0.0), ("c", 4.0)], "program_id string, duration_sec double")
    assert rows(readers.interval_frames(p, 10.0), "program_id", "timestamp_sec") == [("a", 5.0), ("a", 15.0), ("b", 0.0), ("c", 2.0)]
    assert rows(readers.interval_frames(p, 10.0, 1), "program_id", "timestamp_sec") == [("a", 5.0), ("b", 0.0), ("c", 2.0)]


def test_splits_must_not_meet(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"development": {"program_ids": ["a"]}, "evaluation": {"program_ids": ["b", "a"]}}))
    with pytest.raises(ValueError):
        readers.read_split(spark, str(tmp_path))


def test_first_available(spark):
    warnings = []

    def broken():
        raise OSError("gone")

    df = spark.range(1)
    assert resolve.first_available(broken, lambda: None, lambda: df, warnings=warnings) is df and len(warnings) == 1
    assert resolve.first_available(broken, required=False) is None
    with pytest.raises(OSError):
        resolve.first_available(broken)


def test_tables_are_used_again_only_with_equal_parameters(spark, tmp_path):
    path, mark = str(tmp_path / "t"), resolve.fingerprint({"gap": 5})
    assert resolve.table_if_current(spark, path, mark) is None
    resolve.keep_with(spark.range(3), path, mark)
    assert resolve.table_if_current(spark, path, mark).count() == 3
    assert resolve.table_if_current(spark, path, resolve.fingerprint({"gap": 6})) is None


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\0\0\xff\xc0\x00\x11\x08" + (20).to_bytes(2, "big") + (30).to_bytes(2, "big") + b"\0" * 12
    df = spark.createDataFrame([("a", png), ("b", jpeg), ("c", b"x")], "path string, content binary")
    assert rows(resolve.image_sizes(df).na.fill(0), "path", "width", "height") == [("a", 640, 480), ("b", 30, 20), ("c", 0, 0)]


def test_plugins(spark):
    class Twice(resolve.MediaPlugin):
        schema = "program_id string, n long"

        def run(self, batches):
            for pdf in batches:
                yield pd.DataFrame({"program_id": pdf["program_id"], "n": 2})

    programs = spark.createDataFrame([("p", "x")], "program_id string, path string")
    assert rows(resolve.Plugins(probe=Twice()).extract("probe", programs), "n") == [(2,)]
    assert resolve.Plugins().extract("speech", programs) is None


def test_documents_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, [1, 2], "x"), ("p", 0, [3], "y")], "program_id string, seq long, ids array<int>, junk string")
    doc = json.loads(sinks.json_documents(sinks.document(df, "rows", ["ids", "seq"], ["seq"])).first()["json"])
    assert doc == {"program_id": "p", "rows": [{"ids": [3], "seq": 0}, {"ids": [1, 2], "seq": 1}]}
    sinks.write_csv(df, ["seq", "ids"], str(tmp_path / "c"))
    assert rows(spark.read.csv(str(tmp_path / "c"), header=True), "seq", "ids") == [("0", "[3]"), ("1", "[1,2]")]


def test_models_fall_back(spark):
    b = spark.createDataFrame([("p", 0, 0, 0.0, 1.0, "Ａ", ""), ("p", 1, 1, 1.0, 2.0, "b", "")], "program_id string, batch int, seq long, start_sec double, end_sec double, text string, context string")
    assert rows(models.refine(b, lambda texts, context: [t.upper() for t in texts] if texts != ["b"] else []), "text", "fallback") == [("A", False), ("b", True)]
    chunks = spark.createDataFrame([("p", 0, 0.0, 10.0, "x")], "program_id string, chunk int, start_sec double, end_sec double, text string")
    assert rows(models.boundary_hints(chunks, lambda t: [(5.0, "a", "high"), (50.0, "b", "low")]), "time_sec") == [(5.0,)]
    assert models.glossary(chunks, lambda t: 1 / 0).first()["terms"] == []


def test_streams(spark, tmp_path):
    ts = [f"2024-01-01 00:00:{s:02d}" for s in (0, 10, 12, 40, 41)]
    df = spark.createDataFrame([("p", t, x) for t, x in zip(ts, "aabba")], "program_id string, t string, text string").select("program_id", F.col("t").cast("timestamp").alias("ts"), "text")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    variants.run_once(variants.thinned(stream(), 11.0), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert [r[0].second for r in rows(spark.read.parquet(str(tmp_path / "o1")), "ts")] == [0, 12, 40]
    variants.run_once(variants.without_repeats(stream()), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert [r[1] for r in rows(spark.read.parquet(str(tmp_path / "o2")), "ts", "text")] == ["a", "b", "a"]
    counted = variants.tumbling(variants.corrected(stream(), 4.5), [F.col("program_id")], [F.count("*").alias("n")], "30 seconds").select("window.start", "n")
    variants.run_once(counted, str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "o3")).count() >= 0
    assert rows(variants.sessions(df, [F.col("program_id")], [F.count("*").alias("n")], 10.0), "n") == [(2,), (3,)]


def test_keyed_state_gives_what_the_folds_give(spark, tmp_path):
    rng = random.Random(3)
    rows_ = [(f"p{k % 3}", k, float(60 * k + rng.randrange(50)), rng.randrange(4), rng.choice([2, 5, 9, 40])) for k in range(90)]
    df = spark.createDataFrame(rows_, "program_id string, seq long, time_sec double, rank int, tokens long").withColumn("ts", F.timestamp_seconds("time_sec"))
    path, streamed = str(tmp_path / "in"), spark.readStream.schema(df.schema)
    ends = spark.createDataFrame([(f"p{k}", 90, 1e6, 0, 1) for k in range(3)], "program_id string, seq long, time_sec double, rank int, tokens long").withColumn("ts", F.timestamp_seconds("time_sec"))
    for part in (df.where("seq < 47"), df.where("seq >= 47"), ends):
        part.coalesce(1).write.mode("append").parquet(path)
        for name, gap, inclusive in (("stitch", 180.0, True), ("spaced", 200.0, False)):
            variants.run_once(variants.strongest(streamed.parquet(path), gap, inclusive), str(tmp_path / name), str(tmp_path / f"c-{name}"))
        variants.run_once(variants.packed(streamed.parquet(path), 20), str(tmp_path / "packed"), str(tmp_path / "c-packed"))
    for name, gap, inclusive in (("stitch", 180.0, True), ("spaced", 200.0, False)):
        want = rows(folds.keep_strongest(df, gap, inclusive), "program_id", "time_sec")
        got = spark.read.parquet(str(tmp_path / name)).where(F.unix_seconds("ts") < 900000).withColumn("time_sec", F.unix_seconds("ts").cast("double"))
        assert rows(got, "program_id", "time_sec") == want and 3 < len(want) < 90
    got = spark.read.parquet(str(tmp_path / "packed")).where(F.unix_seconds("ts") < 900000)
    batches = lambda d: sorted(r[0] for r in d.groupBy("program_id", "batch").agg(F.concat_ws("/", "program_id", F.count("*"), F.sum("tokens")).alias("x")).select("x").collect())
    assert batches(got) == batches(folds.pack(df, 20).join(df.select("program_id", "seq", "tokens"), ["program_id", "seq"]))


def test_a_dialogue_line_is_parsed_once(spark):
    head = "Dialogue: 0,0:00:01.00,0:00:02.50,"
    lines = [head + "nsz,,0,0,0,,{\\pos(10,20)}（A） hi", head + "nsz,,0,0,0,,x\r", head + "nsz,,0,0,0,,x\ry", head + "nsz,,0,0,0,,（A）", "\x01a\x01b\x01c\x01d", head + "nsz,,0,0,0,,a\x01b\x01c",
             "Dialogue:\x01a\x01b\x01c\x01d", None, head + "nsz,,0,0,0,\\pos(3,4),$1 \\1 {\\an8}z", head + "n z,,0,0,0,,x"]
    out = readers.dialogues_from(spark.createDataFrame([("p", i, v) for i, v in enumerate(lines)], "program_id string, i long, value string"))
    assert [tuple(r) for r in out.select("seq", "text", "speaker", "y", "start_sec", "end_sec").orderBy("seq").collect()] == [
        (0, "hi", "A", 20, 1.0, 2.5), (1, "x", None, 0, 1.0, 2.5), (2, "a\x01b\x01c", None, 0, 1.0, 2.5), (3, "4),$1 \\1 z", None, 4, 1.0, 2.5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(readers.DIALOGUE[:20]) == 1
