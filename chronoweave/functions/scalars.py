"""Scalar expressions over columns: time spans, text, ordered lists, keys and formats.

Rounding to two places uses bround (half to even). Spans touch without overlapping: an overlap is a
strictly positive length. Text functions treat all Unicode white space alike.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Col = Column | str


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# Spans


def span_overlap(a0: Col, a1: Col, b0: Col, b1: Col) -> Column:
    """Seconds that two spans share, never negative."""
    return F.greatest(F.lit(0.0), F.least(_c(a1), _c(b1)) - F.greatest(_c(a0), _c(b0)))


def spans_meet(a0: Col, a1: Col, b0: Col, b1: Col) -> Column:
    return F.least(_c(a1), _c(b1)) > F.greatest(_c(a0), _c(b0))


def spans_touch(a0: Col, a1: Col, b0: Col, b1: Col, margin: float = 0.0) -> Column:
    """Closed overlap with a margin on b: ends that only touch count."""
    return (_c(a1) >= _c(b0) - F.lit(margin)) & (_c(a0) <= _c(b1) + F.lit(margin))


def clamp(x: Col, low: Col, high: Col) -> Column:
    return F.greatest(_c(low), F.least(_c(x), _c(high)))


def round2(x: Col) -> Column:
    return F.bround(_c(x), 2)


def mid_frame_time(start: Col, end: Col, media_duration: Col | None = None, inset: float = 0.25, tail: float = 0.5) -> Column:
    """Time of a scene's representative frame: its middle, off the edges where it lasts over a second."""
    s, e = _c(start), _c(end)
    # in decimals, so that a half-way case of the middle is one in both, and rounds to even
    mid = ((s.cast("decimal(24,6)") + e.cast("decimal(24,6)")) / 2).cast("double")
    t = F.when(e - s > 1.0, F.greatest(s + inset, F.least(mid, e - inset))).otherwise(mid)
    t = F.least(t, e)
    if media_duration is not None:
        t = F.least(t, F.greatest(F.lit(0.0), _c(media_duration) - tail))
    return F.greatest(t, s)


def logical_duration(start: Col, end: Col, source: Col) -> Column:
    """Length of the logical window, or of the source where both ends are missing; null where the window is invalid."""
    s, e, d = _c(start), _c(end), _c(source)
    ok = s.isNotNull() & e.isNotNull() & (s >= 0) & (s < e) & (e <= d + 1.0)
    return F.when(s.isNull() & e.isNull(), d).when(ok, e - s)


# Text


def squash(text: Col) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(text), "(?U)\\s+", " "), "^ | $", "")


def strip(text: Col) -> Column:
    return F.regexp_replace(_c(text), "(?U)^\\s+|\\s+$", "")


def truncate_text(text: Col, limit: int) -> Column:
    """Squashed text, cut to limit - 1 characters and three dots where it is longer than limit."""
    t = squash(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("..."))).otherwise(t)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _compat(text: Column, unicode_form: bool) -> Column:
    return nfkc(text) if unicode_form else text


def compact(text: Col, unicode_form: bool = True) -> Column:
    """NFKC, no white space, lower case. unicode_form=False leaves NFKC away, for ASCII text."""
    return F.lower(F.regexp_replace(_compat(_c(text), unicode_form), "(?U)\\s+", ""))


def joined(texts: Col, unicode_form: bool = True) -> Column:
    """The non-empty texts of a list, joined by spaces and compacted piece by piece."""
    raw = F.array_join(F.transform(_c(texts), lambda x: F.regexp_replace(x, "(?U)\\s+", "")), " ")
    return F.regexp_replace(F.regexp_replace(F.lower(_compat(raw, unicode_form)), " {2,}", " "), "^ | $", "")


def text_distance(a: Col, b: Col) -> Column:
    """Edit distance over the longer length, 0 for two empty texts."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def clock(seconds: Col) -> Column:
    """m:ss, or h:mm:ss from an hour on, of the rounded seconds."""
    s = F.bround(_c(seconds), 0).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def timeline_line(seconds: Col, text: Col, unicode_form: bool = True) -> Column:
    """[m:ss] text, with seconds cut off and minutes not wrapped into hours."""
    s = F.floor(_c(seconds)).cast("long")
    stamp = F.concat(F.lit("["), F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"), F.lit("] "))
    return F.concat(stamp, _compat(_c(text), unicode_form))


def caption_time(text: Col) -> Column:
    """h:mm:ss.cc as seconds."""
    p = F.split(_c(text), ":")
    return F.get(p, F.lit(0)).try_cast("int") * 3600 + F.get(p, F.lit(1)).try_cast("int") * 60 + F.get(p, F.lit(2)).try_cast("double")


def without_tags(text: Col) -> Column:
    """Caption text without its override blocks."""
    return strip(F.regexp_replace(_c(text), r"\{\\[^}]*\}", ""))


def speaker(text: Col) -> Column:
    """The name in full-width brackets that leads a caption, or null."""
    found = F.regexp_extract(_c(text), "^（([^）]{1,12})）", 1)
    return F.when(found != "", found)


def without_speaker(text: Col) -> Column:
    return F.when(speaker(text).isNull(), _c(text)).otherwise(strip(F.regexp_replace(_c(text), "(?U)^（[^）]{1,12}）\\s*", "")))


def sections(*titled: tuple[str, Column]) -> Column:
    """Non-empty sections under their titles, with an empty line between."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(strip(body), F.lit("")) != "", F.concat(F.lit(title + "\n"), body)) for title, body in titled))


# Lists


def dedupe(values: Col, limit: int | None = None) -> Column:
    """First occurrences of the stripped, non-empty values, at most limit of them (one at least)."""
    kept = F.array_distinct(F.filter(F.transform(F.filter(_c(values), lambda x: x.isNotNull()), strip), lambda x: x != ""))
    return kept if limit is None else F.slice(kept, 1, max(1, limit))


def merge_lists(lists: Col, limit: int = 300) -> Column:
    """The lists end to end in compatibility form, as dedupe() leaves them."""
    end = "\x01"  # no form joins across a control character
    return dedupe(F.split(nfkc(F.array_join(F.flatten(_c(lists)), end)), end), limit)


def ordered(value: Column, *order: Col) -> Column:
    """An aggregate: values in the order of the keys, nulls left out."""
    keys = [_c(o).alias(f"k{i}") for i, o in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*keys, value.alias("v")))))
    return F.transform(rows, lambda x: x["v"])


def boundary_list(times: Col) -> Column:
    """Rounded, distinct, sorted times; a null list becomes an empty one."""
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(_c(times), lambda t: F.bround(t, 2)))), F.array().cast("array<double>"))


# Categories

#: What each kind of non-editorial interval is called.
KIND_SUMMARY = {
    "commercial": "CM/ad interval",
    "program_promo": "program promotion interval",
    "sponsor": "sponsor interval",
    "opening_or_ending": "opening/ending interval",
    "other_non_editorial": "other non-editorial interval",
    "ambiguous": "ambiguous non-editorial interval",
}

#: Expressions that announce a new topic, a break, or the end of a break; and discourse markers.
TOPIC_CUES = [
    r"続いて(は|の)",
    r"では次",
    r"次は",
    r"はこちらです",
    r"こんばんは。",
    r"さんです。",
    r"気象情報",
    r"マーケットを確認",
    r"特集",
    r"(ＷＢＳ|WBS)\s*(Ｑｕｉｃｋ|Quick)",
]
BREAK_CUE = r"(コマーシャル|CMの後|このあとは|この後)"
RESUME_CUE = r"(ニュースを続けます|引き続き|ここからは)"
DISCOURSE_MARKERS = r"(一方|また|さて|では)"

#: Type, strength and confidence of the cues, strongest claim first.
CUE_TYPES = {
    "break": ("cm_transition", "strong", 0.78),
    "resume": ("resume_after_cm", "medium", 0.58),
    "topic": ("topic_transition", "medium", 0.62),
    "weak": ("weak_discourse", "weak", 0.30),
}


def any_of(patterns: list[str]) -> str:
    return "|".join(patterns)


def cue(text: Col, break_: str = BREAK_CUE, resume: str = RESUME_CUE, topic: str | None = None) -> Column:
    """struct(cue_type, strength, confidence) of the first kind whose pattern the text holds."""
    t = _c(text)
    as_struct = lambda k: F.struct(*(F.lit(v).alias(n) for v, n in zip(CUE_TYPES[k], ("cue_type", "strength", "confidence"))))
    return (
        F.when(t.rlike(break_), as_struct("break")).when(t.rlike(resume), as_struct("resume"))
        .when(t.rlike(topic or any_of(TOPIC_CUES)), as_struct("topic")).otherwise(as_struct("weak"))
    )


def confidence_rank(name: Col) -> Column:
    n = _c(name)
    return F.when(n == "low", 1).when(n == "medium", 2).when(n == "high", 3).otherwise(0)


def is_non_editorial(kind: Col, editorial: Col, sponsor: Col) -> Column:
    k = _c(kind)
    return ((k != "none") & ~_c(editorial)) | k.isin("commercial", "program_promo", "opening_or_ending", "other_non_editorial") | (_c(sponsor) == "fullscreen_sponsor_credit")


def resolved_kind(kind: Col, sponsor: Col) -> Column:
    k = _c(kind)
    return F.when((k == "none") & (_c(sponsor) == "fullscreen_sponsor_credit"), "sponsor").when(k == "none", "ambiguous").otherwise(k)


def boundary_type(cue_type: Col) -> Column:
    return F.when(_c(cue_type).isin("topic_transition", "resume_after_cm", "breaking_news"), "topic").otherwise("unknown")


# Ids and digests


def numbered(prefix: str, index: Col, width: int) -> Column:
    """prefix and the zero-padded index; an index of more digits keeps them all."""
    i = _c(index).cast("string")
    return F.concat(F.lit(prefix), F.lpad(i, F.greatest(F.length(i), F.lit(width)), "0"))


def scene_of_frame(frame_id: Col) -> Column:
    found = F.regexp_extract(_c(frame_id), "^(scene_.*)_[^_]*$", 1)
    return F.when(found != "", found)


def short_hash(value: Col, length: int = 16) -> Column:
    return F.substring(F.sha2(_c(value), 256), 1, length)


def frame_rate(ratio: Col) -> Column:
    """num/den as a number, 0 where it isn't one."""
    p = F.split(_c(ratio), "/")
    n, d = F.try_to_number(F.get(p, F.lit(0)), F.lit("999999999")), F.try_to_number(F.get(p, F.lit(1)), F.lit("999999999"))
    return F.coalesce(F.try_divide(n.cast("double"), F.coalesce(d.cast("double"), F.when(F.size(p) == 1, 1.0))), F.lit(0.0))
