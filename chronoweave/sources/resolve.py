"""Which prepared data a run uses: explicit files, earlier results, or a pluggable extractor."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def first_available(*options: Callable[[], DataFrame | None], required: bool = True, warnings: list[str] | None = None) -> DataFrame | None:
    """The first option that gives a table. An option that raises is passed over with a warning.

    Without any, the last error is raised again where the data are required; else the result is None.
    """
    error: Exception | None = None
    for option in options:
        try:
            found = option()
        except Exception as e:  # noqa: BLE001 - extractors are foreign code
            error = e
            if warnings is not None:
                warnings.append(f"{getattr(option, '__name__', 'option')}: {e}")
            continue
        if found is not None:
            return found
    if required:
        raise error or LookupError("no source gave any data")
    return None


def table_if_current(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """An earlier result under path, if it was made with the same parameters."""
    try:
        found = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    made = found.select("fingerprint").first() if "fingerprint" in found.columns else None
    return found.drop("fingerprint") if made and made[0] == fingerprint else None


def keep_with(df: DataFrame, path: str, fingerprint: str) -> DataFrame:
    df.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).drop("fingerprint")


def fingerprint(parameters: dict) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def unfinished(work: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Batches that no checkpoint holds in full: keyed by `by`, compared by their number of items n."""
    return work.join(done.select(*by, F.col("n").alias("__n")), by, "left").where(F.col("__n").isNull() | (F.col("__n") != F.col("n"))).drop("__n")


class MediaPlugin(ABC):
    """Foreign code that decodes media or calls a model: maps batches of rows to batches of rows.

    schema is the DDL of what it gives. Plug-ins run in mapInPandas, so a lost executor's rows are
    computed again; they must give equal rows for equal input.
    """

    schema: str

    @abstractmethod
    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...

    def over(self, df: DataFrame) -> DataFrame:
        return df.mapInPandas(self.run, self.schema)


@dataclass
class Plugins:
    """The extractors of a run. Each takes a table of programs (program_id, path); None means not installed."""

    probe: MediaPlugin | None = None
    captions: MediaPlugin | None = None
    speech: MediaPlugin | None = None
    shots: MediaPlugin | None = None
    frames: MediaPlugin | None = None
    screen_text: MediaPlugin | None = None
    faces: MediaPlugin | None = None
    installed: dict[str, MediaPlugin] = field(default_factory=dict)

    def extract(self, name: str, programs: DataFrame) -> DataFrame | None:
        plugin = getattr(self, name, None) or self.installed.get(name)
        return None if plugin is None else plugin.over(programs)


def probe_rates(probed: DataFrame) -> DataFrame:
    """Probe rows (r_frame_rate as num/den) with fps."""
    return probed.withColumn("fps", S.frame_rate("r_frame_rate"))


def image_sizes(files: DataFrame) -> DataFrame:
    """path, width and height of JPEG and PNG bytes (columns path, content), read from their headers."""

    def size(b: bytes) -> tuple[int, int] | None:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
        i = 2
        while b[:2] == b"\xff\xd8" and i + 9 < len(b):
            marker, length = b[i + 1], int.from_bytes(b[i + 2 : i + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[i + 7 : i + 9], "big"), int.from_bytes(b[i + 5 : i + 7], "big")
            i += 2 + length
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [size(bytes(b)) or (None, None) for b in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "width": pd.array([f[0] for f in found], "Int32"), "height": pd.array([f[1] for f in found], "Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int")
