"""Tables kept in the folder that all executors share, and small Spark helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one is set in local mode; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, tag: str, codec: str = "snappy", shelf: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts lineage and survives lost executors.

    shelf takes the path, for discard() once nothing reads the table any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoweave/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    if shelf is not None:
        shelf.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_ids(task: int, buckets: int) -> Iterator[int]:
    """Numbers of a task that all fall into one of the buckets (by Spark's hash of a long), other ones for each task."""
    rotate = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    word = lambda x: rotate(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    step = lambda h, k: rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    at = task << 36
    while True:
        x = np.arange(at, at + 64 * buckets, dtype=np.int64)
        h = step(step(np.full(len(x), 42, np.uint32), word(x.astype(np.uint32))), word((x >> 32).astype(np.uint32))) ^ np.uint32(8)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        h = (h ^ h >> np.uint32(16)).view(np.int32)
        yield from x[h % buckets == task % buckets].tolist()
        at += 64 * buckets


def keep_bucketed(df: DataFrame, tag: str, column: str, buckets: int, shelf: list[str] | None = None) -> DataFrame:
    """As keep(), in buckets of a column, so that joins by that column don't shuffle the table again.

    A task that numbers its rows by bucket_ids() writes one file, so nothing is shuffled for this. The catalogue's
    entry is only needed to write the table and goes at once; the files stay until discard().
    """
    spark, name = df.sparkSession, f"chronoweave_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/chronoweave/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    if shelf is not None:
        shelf.append(path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def discard(spark: SparkSession, shelf: list[str]) -> None:
    """Delete the kept tables on the shelf."""
    jvm = spark.sparkContext._jvm
    while shelf:
        path = jvm.org.apache.hadoop.fs.Path(shelf.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until df has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text"):
    """The text column as a non-null string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
