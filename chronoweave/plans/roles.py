"""The engine's streams as the driver's tables play them, in Spark and as SQL for DuckDB.

A program is a day of events: a segment begins at its event's time and lasts `value` seconds. Times are
whole centiseconds, so both engines compute with the same doubles. Errors and signups play non-editorial
spans; clicks and purchases play points; runs of one label among odd and even event ids play predicted
and true topics. Turns of conversations and documents play texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "user_id")
    micros = (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long") * 1_000_000 + (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")
    cs = F.expr("div(us + 5000, 10000)")
    out = e.withColumn("us", micros).withColumn("cs", cs)
    return out.select(
        F.date_format("ts", "yyyy-MM-dd").alias("program_id"), F.col("event_id").alias("seq"), (F.col("cs") / 100.0).alias("start_sec"),
        ((F.col("cs") + F.round(F.col("value") * 100).cast("long")) / 100.0).alias("end_sec"), F.col("event_type").alias("label"), "value", "user_id",
    )


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("program_id").distinct().withColumn("duration_sec", F.lit(DAY))


def non_editorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where(F.col("label").isin("error", "signup"))
    return s.select("program_id", "seq", "start_sec", "end_sec", F.when(F.col("label") == "error", "commercial").otherwise("program_promo").alias("kind"))


def points(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return segments(spark, sf_dir).where(F.col("label") == label).select("program_id", "seq", F.col("start_sec").alias("time_sec"), "value")


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with a rank from their value: 1 low, 2 medium, 3 high."""
    return points(spark, sf_dir, "click").withColumn("rank", F.when(F.col("value") < 30, 1).when(F.col("value") < 90, 2).otherwise(3)).drop("value")


def topics(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Runs of one label among the event ids of this parity; each ends where the next begins."""
    s = segments(spark, sf_dir).where(F.col("seq") % 2 == parity)
    w = Window.partitionBy("program_id").orderBy("start_sec", "seq")
    starts = s.withColumn("__b", F.lag("label").over(w)).where(F.col("__b").isNull() | (F.col("__b") != F.col("label")))
    return starts.select("program_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), "start_sec", F.coalesce(F.lead("start_sec").over(w), F.lit(DAY)).alias("end_sec"), "label")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous ranges of a program, cut at the starts of purchases."""
    cuts = points(spark, sf_dir, "purchase").select("program_id", "time_sec").union(programs(spark, sf_dir).select("program_id", F.explode(F.array(F.lit(0.0), "duration_sec"))))
    w = Window.partitionBy("program_id").orderBy("time_sec")
    spans = cuts.distinct().select("program_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("time_sec").alias("start_sec"), F.lead("time_sec").over(w).alias("end_sec"))
    return spans.where(F.col("end_sec").isNotNull())


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").cast("string").alias("program_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), "role")


#: The same streams as common table expressions, in order of dependence.
_SQL = {
    "seg": """seg AS (
        SELECT program_id, seq, cs / 100.0::DOUBLE AS start_sec, (cs + CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE AS end_sec, label, value, user_id
        FROM (SELECT strftime(ts, '%Y-%m-%d') AS program_id, event_id AS seq, event_type AS label, value, user_id,
                (epoch_us(ts) - epoch_us(date_trunc('day', ts)) + 5000) // 10000 AS cs FROM events))""",
    "prog": "prog AS (SELECT DISTINCT program_id, 86400.0::DOUBLE AS duration_sec FROM seg)",
    "ne": "ne AS (SELECT program_id, seq, start_sec, end_sec, CASE WHEN label = 'error' THEN 'commercial' ELSE 'program_promo' END AS kind FROM seg WHERE label IN ('error', 'signup'))",
    "click": "click AS (SELECT program_id, seq, start_sec AS time_sec, value FROM seg WHERE label = 'click')",
    "buy": "buy AS (SELECT program_id, seq, start_sec AS time_sec, value FROM seg WHERE label = 'purchase')",
    "hint": "hint AS (SELECT program_id, seq, time_sec, CASE WHEN value < 30 THEN 1 WHEN value < 90 THEN 2 ELSE 3 END AS rank FROM click)",
    "top": """top AS (
        SELECT parity, program_id, row_number() OVER w - 1 AS seq, start_sec, coalesce(lead(start_sec) OVER w, 86400.0::DOUBLE) AS end_sec, label
        FROM (SELECT *, seq % 2 AS parity, lag(label) OVER (PARTITION BY program_id, seq % 2 ORDER BY start_sec, seq) AS before FROM seg)
        WHERE before IS NULL OR before <> label WINDOW w AS (PARTITION BY program_id, parity ORDER BY start_sec, seq))""",
    "pred": "pred AS (SELECT program_id, seq, start_sec, end_sec, label FROM top WHERE parity = 1)",
    "truth": "truth AS (SELECT program_id, seq, start_sec, end_sec, label FROM top WHERE parity = 0)",
    "rng": """rng AS (
        SELECT * FROM (SELECT program_id, row_number() OVER w - 1 AS seq, time_sec AS start_sec, lead(time_sec) OVER w AS end_sec
            FROM (SELECT program_id, time_sec FROM buy UNION SELECT program_id, 0.0::DOUBLE FROM prog UNION SELECT program_id, 86400.0::DOUBLE FROM prog)
            WINDOW w AS (PARTITION BY program_id ORDER BY time_sec))
        WHERE end_sec IS NOT NULL)""",
    "turn": "turn AS (SELECT CAST(conv_id AS VARCHAR) AS program_id, turn AS seq, coalesce(text, '') AS text, role FROM conversations)",
}


def sql(body: str, *more: str, recursive: bool = False) -> str:
    """body after the expressions above that it needs and its own ones."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*_SQL.values(), *more]) + "\n" + body
