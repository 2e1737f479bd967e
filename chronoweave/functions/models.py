"""Points where hosted models plug in, with deterministic defaults that need none.

A model is a Python callable; it runs in workers over batches or groups. A batch that a model fails on,
or answers with the wrong number of items, keeps its input.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import KEY


def estimate_tokens(text: str) -> int:
    """Tokens of a text without a vocabulary: one for four ASCII letters or for any other character."""
    plain = len(re.findall(r"[\x21-\x7e]", text))
    return -(-plain // 4) + sum(1 for c in text if ord(c) > 126 and not c.isspace())


def token_counts(df: DataFrame, count: Callable[[str], int] = estimate_tokens, text: str = "text", name: str = "tokens") -> DataFrame:
    @F.pandas_udf("long")
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda x: 0 if x is None else count(x)).astype("int64")

    return df.withColumn(name, tokens(F.col(text)))


def split_by_tokens(text: str, limit: int, count: Callable[[str], int] = estimate_tokens) -> list[str]:
    """The text whole if it has at most limit tokens, else its lines in order, as many in a piece as fit; a longer line is alone."""
    if count(text) <= limit:
        return [text]
    pieces, lines, used = [], [], 0
    for line in text.split("\n"):
        n = count(line + "\n")
        if lines and used + n > limit:
            pieces.append("\n".join(lines))
            lines, used = [], 0
        lines.append(line)
        used += n
    return [*pieces, "\n".join(lines)]


def token_pieces(df: DataFrame, limit: int, count: Callable[[str], int] = estimate_tokens, text: str = "text", name: str = "pieces") -> DataFrame:
    """df with the pieces of each text, as from split_by_tokens(); null has none."""

    @F.pandas_udf("array<string>")
    def pieces(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else split_by_tokens(x, limit, count))

    return df.withColumn(name, pieces(F.col(text)))


#: Columns of a finaliser's topics.
TOPICS = "start_sec double, end_sec double, title string, summary string, domain string"


def synthesise(payloads: DataFrame, model: Callable[[dict], list[dict] | None], key: str = KEY) -> DataFrame:
    """key, seq and TOPICS of the topics that a model makes of each program's payload (a JSON text).

    A model that gives None for a program has refused, which fails the job.
    """
    names = [f.split()[0] for f in TOPICS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for program, payload in zip(pdf[key], pdf["payload"]):
                topics = model(json.loads(payload))
                if topics is None:
                    raise RuntimeError(f"no metadata for {program}")
                rows += [(program, i, *(t.get(n) for n in names)) for i, t in enumerate(topics)]
            yield pd.DataFrame(rows, columns=[key, "seq", *names])

    return payloads.select(key, "payload").mapInPandas(run, f"{key} string, seq long, {TOPICS}")


def refine(batches: DataFrame, model: Callable[[list[str], str], list[str]] | None = None, key: str = KEY) -> DataFrame:
    """Texts as the model rewrites them, a batch at a time, with the times of the rows they came from.

    batches: key, batch, seq, start_sec, end_sec, text, context. fallback marks batches that keep their input.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        given = [unicodedata.normalize("NFKC", t or "") for t in pdf["text"]]
        try:
            got = list(model(given, pdf["context"].iloc[0] or "")) if model else given
        except Exception:  # noqa: BLE001 - a failed call keeps the batch
            got = None
        ok = got is not None and len(got) == len(given)
        return pdf[[key, "batch", "seq", "start_sec", "end_sec"]].assign(text=got if ok else given, fallback=not ok)

    return batches.groupBy(key, "batch").applyInPandas(run, f"{key} string, batch int, seq long, start_sec double, end_sec double, text string, fallback boolean")


def glossary(chunks: DataFrame, model: Callable[[str], list[str]] | None = None, key: str = KEY) -> DataFrame:
    """key, chunk, terms of each chunk's text; a failed chunk has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def terms(text: str) -> list[str]:
            try:
                return list(model(text)) if model else sorted(set(re.findall(r"[A-Z][A-Za-z]{2,}|[ァ-ヶー]{3,}", text)))
            except Exception:  # noqa: BLE001
                return []

        for pdf in batches:
            yield pdf[[key, "chunk"]].assign(terms=[terms(t or "") for t in pdf["text"]])

    return chunks.select(key, "chunk", "text").mapInPandas(run, f"{key} string, chunk int, terms array<string>")


def boundary_hints(chunks: DataFrame, model: Callable[[str], list[tuple[float, str, str]]] | None = None, key: str = KEY) -> DataFrame:
    """key, chunk, time_sec, title, confidence of boundaries inside each chunk's span; others are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    found = model(r.text or "") if model else []
                except Exception:  # noqa: BLE001
                    found = []
                rows += [(getattr(r, key), r.chunk, float(t), title, sure) for t, title, sure in found if r.start_sec <= t <= r.end_sec]
            yield pd.DataFrame(rows, columns=[key, "chunk", "time_sec", "title", "confidence"])

    return chunks.select(key, "chunk", "start_sec", "end_sec", "text").mapInPandas(run, f"{key} string, chunk int, time_sec double, title string, confidence string")


#: What an annotation says where no annotator is installed.
BLANK_ANNOTATION = {
    "visual_summary": "",
    "primary_onscreen_text": None,
    "ocr_texts": [],
    "shot_type": "other",
    "presentation": "other_editorial",
    "sponsor_presentation": "none",
    "non_editorial_kind": "none",
    "is_probably_editorial": True,
    "domain_hints": [],
}
_ANNOTATED = "visual_summary string, primary_onscreen_text string, ocr_texts array<string>, shot_type string, presentation string, sponsor_presentation string, non_editorial_kind string, is_probably_editorial boolean, domain_hints array<string>"


def annotate(frames: DataFrame, model: Callable[[bytes], dict] | None = None, key: str = KEY, budgets: tuple[int, ...] = (4096, 16384)) -> DataFrame:
    """Frames (key, frame_id, frame_index, timestamp_sec, content) with their annotation; identity stays the input's.

    A model that runs out of its token budget (ValueError) is asked again with the next larger one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(content) -> dict:
            if model is None:
                return BLANK_ANNOTATION
            for budget in budgets:
                try:
                    return {**BLANK_ANNOTATION, **model(bytes(content), budget)}
                except ValueError:
                    continue
            raise ValueError("no budget was enough")

        for pdf in batches:
            found = pd.DataFrame([one(c) for c in pdf["content"]], columns=list(BLANK_ANNOTATION))
            ids = pdf[[key, "frame_id", "frame_index", "timestamp_sec"]].reset_index(drop=True)
            yield pd.concat([ids, found], axis=1)

    return frames.mapInPandas(run, f"{key} string, frame_id string, frame_index int, timestamp_sec double, {_ANNOTATED}")


def fused_or_fallback(fused: Callable[[], DataFrame], captions: DataFrame | None, asr: DataFrame | None, warnings: list[str]) -> DataFrame | None:
    """Fused rows that aren't blank; None with a warning where a side is missing or the fusion fails."""
    if captions is None or asr is None:
        warnings.append("fusion needs captions and speech")
        return None
    try:
        return fused().where("trim(text) <> ''")
    except Exception as e:  # noqa: BLE001
        warnings.append(f"fusion failed: {e}")
        return None
