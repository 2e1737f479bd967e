"""A corpus-cleaning pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, extra columns included.

language    documents whose language can't be told (no letters, or too far from every centroid) go
lines       repeated and nearly repeated lines go from the texts; every document stays
near_dups   of each group of near-duplicates the document with the smallest id stays
benchmark   documents that hold a passage of the benchmark go
packing     what is left is packed into sequences of tokens

Null and letterless texts go with the first stage. Rows with a null id stay in near_dups and benchmark; rows that
share an id are one document there and stay or go together. Extra columns go along to the last stage; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate, language, line_dedup, near_duplicates, packing
from chronoweave.llm.shared import crc_mod, free_name, keep
from chronoweave.session import ready


#: Percent of shared shingles from which documents are near-duplicates here; op2_near_duplicates takes 85.
NEAR = 80


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held))
    return language.predict(docs, model, prefix="__lang_id_").where(~F.col("__lang_id_rejected")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs, prefix="__line_dedup_")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = free_name(docs, "__gone")
    gone = near_duplicates.near_duplicates(docs, percent=NEAR).where(~F.col("kept")).select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(dropped), "left_anti")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", drop_unknown_language),
    ("lines", drop_repeated_lines),
    ("near_dups", drop_near_duplicates),
    ("benchmark", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Banding and graph search can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each but the last is kept in the shared folder."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
