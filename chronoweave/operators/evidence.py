"""Evidence windows, topic classification and the deterministic topic finaliser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import folds, intervals
from .joins import KEY, overlap_join, points_in_spans

#: Entries and characters of each list of an evidence window.
WINDOW_LISTS = {
    "captions": (12, 180),
    "asr": (12, 180),
    "primary": (12, 180),
    "ocr": (20, 120),
    "telop": (8, 160),
    "visual": (8, 180),
    "presentation": (6, None),
    "domain": (6, None),
    "non_editorial": (6, None),
}

#: Keywords of each domain; a keyword that is listed twice counts twice.
DOMAIN_KEYWORDS = {
    "weather": ["天気", "気象", "気温", "降水", "予報", "台風", "梅雨", "猛暑", "週間天気"],
    "sport": ["スポーツ", "試合", "選手", "野球", "サッカー", "大谷", "得点", "優勝", "リーグ"],
    "arts_culture_entertainment_media": ["芸能", "映画", "音楽", "俳優", "タレント", "舞台", "アニメ", "ライブ"],
    "economy_business_finance": ["経済", "企業", "市場", "株価", "為替", "日経平均", "決算", "金利", "物価", "日銀", "商品", "サービス", "店舗", "投資", "半導体", "ナフサ", "円安", "決算"],
    "politics": ["首相", "政府", "国会", "大臣", "選挙", "政権", "与党", "野党", "法案", "政策"],
    "crime_law_justice": ["逮捕", "容疑者", "警察", "事件", "裁判", "判決", "起訴", "捜査", "詐欺"],
    "disaster_accident_emergency": ["地震", "津波", "火災", "事故", "避難", "被害", "救助", "大雨", "洪水", "噴火"],
    "health": ["医療", "病院", "感染", "患者", "ワクチン", "健康", "薬", "医師"],
    "science_technology": ["科学", "技術", "AI", "人工知能", "宇宙", "ロボット", "研究", "実証実験"],
    "environment": ["環境", "脱炭素", "温暖化", "再生可能", "汚染", "気候変動"],
    "education": ["学校", "教育", "大学", "受験", "授業", "生徒", "学生"],
    "conflict_war_peace": ["戦争", "停戦", "攻撃", "軍", "ミサイル", "ウクライナ", "ガザ", "紛争"],
    "labour": ["労働", "賃上げ", "雇用", "就職", "労組", "ストライキ", "人手不足"],
    "lifestyle_leisure": ["旅行", "観光", "グルメ", "暮らし", "レジャー", "家計", "消費者"],
    "society": ["社会", "地域", "交通", "鉄道", "自治体", "住民", "制度", "問題"],
}


def grid(programs: DataFrame, width: float = 60.0, key: str = KEY) -> DataFrame:
    """Cuts at 0, every width seconds and the end of each program."""
    n = F.ceil(F.col("duration_sec") / width).cast("int")
    times = F.array_append(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.bround(k * F.lit(width), 2)), F.bround("duration_sec", 2))
    return programs.select(key, F.explode(times).alias("time_sec")).distinct()


def evidence_spans(programs: DataFrame, width: float = 60.0, non_editorial: DataFrame | None = None, cues: DataFrame | None = None, extra: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Spans between the grid's cuts, the edges of non-editorial spans, cue times and extra times."""
    cuts = grid(programs, width, key)
    if non_editorial is not None:
        edges = non_editorial.join(programs, key).select(key, F.explode(F.array(F.bround(F.greatest(F.lit(0.0), F.col("start_sec")), 2), F.bround(F.least("duration_sec", "end_sec"), 2))).alias("time_sec"))
        cuts = cuts.union(edges)
    if cues is not None:
        cuts = cuts.union(cues.select(key, F.bround("time_sec", 2)))
    if extra is not None:
        inside = extra.join(programs, key).where((F.col("time_sec") > 0) & (F.col("time_sec") < F.col("duration_sec")))
        cuts = cuts.union(inside.select(key, F.bround("time_sec", 2)))
    return intervals.cuts_to_spans(cuts, key)


def collect_in(spans: DataFrame, items: DataFrame, value: Column, name: str, limit: int, chars: int | None = None, key: str = KEY) -> DataFrame:
    """(key, seq, name): for each span the ordered, distinct values of the items that overlap it, at most limit.

    value is an expression over item columns, which have r_ before their names.
    """
    met = overlap_join(spans.select(key, "seq", "start_sec", "end_sec"), items, key=key)
    text = S.truncate_text(value, chars) if chars else value
    return met.groupBy(key, F.col("l_seq").alias("seq")).agg(S.dedupe(S.ordered(text, "r_seq"), limit).alias(name))


def evidence_windows(spans: DataFrame, captions: DataFrame | None = None, asr: DataFrame | None = None, primary: DataFrame | None = None, frames: DataFrame | None = None, non_editorial: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """One row a span with a list for each stream that overlaps it; spans without evidence go, ids keep their number.

    Streams have seq, start_sec, end_sec and text; frames have frame_id, ocr_texts, telop, visual,
    presentation and domain_hints; non_editorial has kind. Where captions exist, a window with captions
    or primary text leaves its recognised speech out.
    """
    empty = F.array().cast("array<string>")
    out = spans
    streams = {"captions": captions, "asr": asr, "primary": primary}
    for name, df in streams.items():
        limit, chars = WINDOW_LISTS[name]
        out = out.join(collect_in(spans, df, F.col("r_text"), name, limit, chars, key), [key, "seq"], "left") if df is not None else out.withColumn(name, empty)
    if frames is not None:
        met = overlap_join(spans.select(key, "seq", "start_sec", "end_sec"), frames, key=key)
        cut = lambda name: WINDOW_LISTS[name]
        flat = lambda c, n: F.flatten(S.ordered(F.transform(c, lambda t: S.truncate_text(t, n)) if n else c, "r_seq"))
        lists = met.groupBy(key, F.col("l_seq").alias("seq")).agg(
            S.dedupe(S.ordered(F.col("r_frame_id"), "r_seq")).alias("frame_ids"),
            S.dedupe(flat(F.col("r_ocr_texts"), cut("ocr")[1]), cut("ocr")[0]).alias("ocr"),
            S.dedupe(S.ordered(S.truncate_text(F.coalesce("r_telop", F.lit("")), cut("telop")[1]), "r_seq"), cut("telop")[0]).alias("telop"),
            S.dedupe(S.ordered(S.truncate_text("r_visual", cut("visual")[1]), "r_seq"), cut("visual")[0]).alias("visual"),
            S.dedupe(S.ordered(F.col("r_presentation"), "r_seq"), cut("presentation")[0]).alias("presentation"),
            S.dedupe(flat(F.col("r_domain_hints"), None), cut("domain")[0]).alias("domain"),
        )
        out = out.join(lists, [key, "seq"], "left")
    else:
        out = out.withColumns(dict.fromkeys(("frame_ids", "ocr", "telop", "visual", "presentation", "domain"), empty))
    if non_editorial is not None:
        out = out.join(collect_in(spans, non_editorial, F.col("r_kind"), "non_editorial", WINDOW_LISTS["non_editorial"][0], key=key), [key, "seq"], "left")
    else:
        out = out.withColumn("non_editorial", empty)
    names = [*streams, "frame_ids", "ocr", "telop", "visual", "presentation", "domain", "non_editorial"]
    out = out.withColumns({n: F.coalesce(n, empty) for n in names})
    if captions is not None:
        has = captions.select(key).distinct().withColumn("__has", F.lit(True))
        covered = F.coalesce("__has", F.lit(False)) & ((F.size("captions") > 0) | (F.size("primary") > 0))
        out = out.join(has, key, "left").withColumn("asr", F.when(covered, empty).otherwise(F.col("asr"))).drop("__has")
    some = sum((F.size(n) for n in ("captions", "asr", "primary", "frame_ids", "non_editorial")), F.lit(0)) > 0
    return out.where(some).withColumn("window_id", S.numbered("w", "seq", 4))


def first_windows(windows: DataFrame, most: int = 200, key: str = KEY) -> DataFrame:
    """The first `most` windows of each program, and how many are omitted."""
    w = Window.partitionBy(key)
    numbered = windows.withColumns({"__r": F.row_number().over(w.orderBy("seq")), "omitted": F.greatest(F.count("*").over(w) - most, F.lit(0))})
    return numbered.where(F.col("__r") <= most).drop("__r")


#: What a finaliser is told: always, of fused or of separate texts (second place), and where there are hints (last place).
RULES = ("Give structured metadata of the given schema only.", "Visual labels are evidence of what is seen; no topic begins or ends on them alone.", "Non-editorial spans stay segments and are in no topic.", "Use times of evidence, not the edges of windows.")
FUSED_RULE, SEPARATE_RULE = "The primary text is corrected and canonical; captions and speech support it.", "Where captions exist their wording is canonical; speech gives times and fills gaps."
HINT_RULE = "Take the boundary hints unless evidence is clearly against them."


def finaliser_payload(programs: DataFrame, windows: DataFrame, segments: DataFrame, hints: DataFrame | None = None, fused: bool = False, most: int = 200, warnings: tuple[str, ...] = (), key: str = KEY) -> DataFrame:
    """key, payload: a JSON text a program with its fields, rules, hints, segments, first windows and warnings."""
    rows = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", F.struct(*(c for c in df.columns if c not in (key, "seq"))).alias("x")))).alias(name))
    some = first_windows(windows, most, key)
    omitted = some.groupBy(key).agg(F.first("omitted").alias("omitted"))
    out = programs.join(rows(some.drop("omitted"), "w"), key, "left").join(omitted, key, "left").join(rows(segments, "s"), key, "left")
    out = out.join(rows(hints, "h"), key, "left") if hints is not None else out.withColumn("h", F.lit(None))
    listed = lambda name: F.transform(name, lambda r: r["x"]) if name != "h" or hints is not None else F.array()
    base = F.array(F.lit(RULES[0]), F.lit(FUSED_RULE if fused else SEPARATE_RULE), *map(F.lit, RULES[1:]))
    rules = F.when(F.col("h").isNotNull(), F.concat(base, F.array(F.lit(HINT_RULE)))).otherwise(base)
    payload = F.to_json(F.struct(
        F.struct(*programs.columns).alias("program"), rules.alias("rules"), F.coalesce(listed("h"), F.array()).alias("hints") if hints is not None else F.array().cast("array<string>").alias("hints"),
        listed("s").alias("segments"), listed("w").alias("windows"), F.coalesce("omitted", F.lit(0)).alias("omitted"), F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"),
    ))
    return out.select(key, payload.alias("payload"))


def visual_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates that hints may snap to: those that neither text cues nor non-editorial spans made."""
    return candidates.where(~F.col("source").isin("cue", "cm_detector"))


def editorial_spans(programs: DataFrame, non_editorial: DataFrame, cues: DataFrame, key: str = KEY) -> DataFrame:
    """Spans between 0, the end, cue times and the edges of non-editorial spans, without those whose middle lies in one.

    A non-editorial span of no length cuts too.
    """
    edges = F.explode(F.array(*(S.clamp(c, F.lit(0.0), "duration_sec") for c in ("start_sec", "end_sec"))))
    cuts = (
        programs.select(key, F.explode(F.array(F.lit(0.0), "duration_sec")).alias("time_sec"))
        .union(cues.select(key, "time_sec")).union(non_editorial.join(programs, key).select(key, edges))
    )
    spans = intervals.cuts_to_spans(cuts, key).withColumn("__mid", (F.col("start_sec") + F.col("end_sec")) / 2.0)
    left = points_in_spans(spans, non_editorial.select(key, "start_sec", "end_sec"), "left_anti", time="__mid", key=key).drop("__mid")
    w = Window.partitionBy(key).orderBy("start_sec")
    return left.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def keyword_scores(texts: DataFrame, keywords: dict[str, list[str]], by: list[str], text: str = "text") -> DataFrame:
    """by..., domain, n, place: how many of a domain's keywords the text holds, and the domain's rank by (n, name)."""
    lower = F.lower(F.col(text))
    count = lambda words: sum((F.contains(lower, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    each = F.filter(F.array(*(F.struct(F.lit(d).alias("domain"), count(w).alias("n")) for d, w in keywords.items())), lambda x: x["n"] > 0)
    ranked = F.array_sort(F.transform(each, lambda x: F.struct((-x["n"]).alias("m"), x["domain"].alias("domain"), x["n"].alias("n"))))
    return texts.select(*by, F.posexplode(ranked).alias("place", "r")).select(*by, "r.domain", "r.n", "place")


def classify(text: Column, hints: Column, keywords: dict[str, list[str]], fallback: str = "society") -> Column:
    """struct(domain, alternatives, confidence, note) by keyword counts, then by hints, then the fallback."""
    lower = F.lower(text)
    count = lambda words: sum((F.contains(lower, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    each = F.filter(F.array(*(F.struct((-count(w)).alias("m"), F.lit(d).alias("domain")) for d, w in keywords.items())), lambda x: x["m"] < 0)
    ranked = F.transform(F.array_sort(each), lambda x: x["domain"])
    hints = S.dedupe(hints)
    made = lambda d, a, c, n: F.struct(d.alias("domain"), a.alias("alternatives"), F.lit(c).alias("confidence"), F.lit(n).cast("string").alias("note"))
    first = F.get(ranked, F.lit(0))
    others = F.filter(S.dedupe(F.concat(F.slice(ranked, 2, 1000), hints), 3), lambda x: x != first)
    hint = F.get(hints, F.lit(0))
    return (
        F.when(F.size(ranked) > 0, made(first, others, 0.74, None))
        .when((F.size(hints) > 0) & (S.strip(text) != ""), made(hint, F.filter(F.slice(hints, 2, 3), lambda x: x != hint), 0.50, "domain used visual hints because text evidence was weak"))
        .otherwise(made(F.lit(fallback), F.array().cast("array<string>"), 0.34, "domain fell back to society because text evidence was ambiguous"))
    )


def evidence_texts(primary: Column, captions: Column, asr: Column, frames: Column | None = None, limit: int | None = 24) -> Column:
    """Labelled texts of a span: the first 8 of the best stream, then of the first 8 frames."""
    labelled = lambda label, texts, n: F.transform(F.slice(texts, 1, 8), lambda t: F.concat(F.lit(label + ": "), S.truncate_text(t, n)))
    values = F.when(F.size(primary) > 0, labelled("primary", primary, 180)).when(F.size(captions) > 0, labelled("caption", captions, 180)).otherwise(labelled("asr", asr, 180))
    if frames is not None:
        def of(f):
            ocr = F.transform(F.slice(f["ocr_texts"], 1, 5), lambda t: F.concat(F.lit("ocr: "), S.truncate_text(t, 120)))
            telop = F.when(F.coalesce(f["telop"], F.lit("")) != "", F.array(F.concat(F.lit("telop: "), S.truncate_text(f["telop"], 160)))).otherwise(F.array().cast("array<string>"))
            return F.concat(ocr, telop, F.array(F.concat(F.lit("visual: "), S.truncate_text(f["visual"], 180))))

        values = F.concat(values, F.flatten(F.transform(F.slice(frames, 1, 8), of)))
    return S.dedupe(values, limit)


def title(telops: Column, texts: Column, fallback: Column) -> Column:
    """The first screen text, or else the first spoken text, or else the fallback."""
    first = lambda a: F.get(F.filter(a, lambda x: S.strip(F.coalesce(x, F.lit(""))) != ""), F.lit(0))
    return F.coalesce(S.truncate_text(first(telops), 60), S.truncate_text(first(texts), 60), fallback)


def summary(primary: Column, captions: Column, visuals: Column) -> Column:
    """The first eight texts run together, or else the first three visual summaries."""
    run = lambda a: S.strip(F.array_join(F.slice(a, 1, 8), ""))
    some = lambda x: F.when(x != "", S.truncate_text(x, 240))
    return F.coalesce(some(run(primary)), some(run(captions)), some(S.strip(F.array_join(F.slice(visuals, 1, 3), "。"))), F.lit("Editorial segment with limited text evidence."))


def heuristic_topics(programs: DataFrame, primary: DataFrame, non_editorial: DataFrame, cue_pattern: str, keywords: dict[str, list[str]], min_topic_sec: float = 60.0, key: str = KEY) -> DataFrame:
    """Topics without a model: cue boundaries, editorial spans, overlapping text, domain by keywords.

    programs: key, duration_sec. primary: key, seq, start_sec, end_sec, text. non_editorial: key, start_sec,
    end_sec. Topic ids count spans, those without text too.
    """
    cues = primary.where(F.col("text").rlike(cue_pattern)).join(programs, key).select(key, "seq", F.col("start_sec").alias("time_sec"), "duration_sec")
    kept = folds.thin(cues, min_topic_sec, duration="duration_sec", key=key)
    spans = editorial_spans(programs, non_editorial, kept, key)
    met = overlap_join(spans, primary.select(key, "seq", "start_sec", "end_sec", "text"), key=key)
    none = F.array().cast("array<string>")
    texts = met.groupBy(key, F.col("l_seq").alias("seq")).agg(F.first("l_start_sec").alias("start_sec"), F.first("l_end_sec").alias("end_sec"), S.ordered(F.col("r_text"), "r_seq").alias("texts"))
    evidence = texts.withColumn("evidence", evidence_texts(F.col("texts"), none, none))
    found = evidence.withColumn("c", classify(F.array_join(evidence_texts(F.col("texts"), none, none, limit=None), "\n"), none, keywords))
    return found.select(
        key, S.numbered("t", "seq", 3).alias("topic_id"), S.round2("start_sec").alias("start_sec"), S.round2("end_sec").alias("end_sec"), "c.domain", "c.alternatives", "c.confidence",
        title(none, F.col("texts"), S.numbered("Editorial topic ", "seq", 3)).alias("title"), summary(F.col("texts"), none, none).alias("summary"), "evidence", "c.note",
    )


def finalise(topics: DataFrame, segments: DataFrame, deterministic: DataFrame, programs: DataFrame, share: float = 0.7, key: str = KEY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, segments, warnings): clip both, add deterministic segments that nothing overlaps, drop covered topics."""
    clipped = lambda df: intervals.clip(df.join(programs, key), F.lit(0.0), F.col("duration_sec")).drop("duration_sec")
    t, s = clipped(topics), clipped(segments)
    merged = folds.add_disjoint(s.select(key, "seq", "start_sec", "end_sec"), deterministic.select(key, "seq", "start_sec", "end_sec"), key=key)
    judged = intervals.coverage(t, merged.select(key, "start_sec", "end_sec"), key)
    label = F.concat(F.col("topic_id"), F.lit("["), S.clock("start_sec"), F.lit("-"), S.clock("end_sec"), F.lit("]("), F.bround(F.col("coverage") * 100, 0).cast("int").cast("string"), F.lit("% non-editorial)"))
    removed = judged.where(~intervals.below(share)).groupBy(key).agg(F.count("*").alias("n"), F.array_join(S.ordered(label, "seq"), ", ").alias("removed"))
    return judged.where(intervals.below(share)), merged, removed


def boundary_candidates(scenes: DataFrame, cues: DataFrame, screen_changes: DataFrame, non_editorial: DataFrame, key: str = KEY) -> DataFrame:
    """One stream of scored candidate times: scene cuts, cues, screen-text changes, edges of non-editorial spans.

    scenes: boundary_id, time_sec, boundary_type, score. cues: cue_id, start_sec, cue_type, confidence, text.
    screen_changes: seq, time_sec. non_editorial: seq, start_sec, end_sec, kind.
    """
    names = [key, "boundary_id", "time_sec", "boundary_type", "source", "score", "reasons"]
    a = scenes.withColumns({"source": F.lit("scene_detector"), "reasons": F.array(F.lit("shot cut"))}).select(*names)
    b = cues.select(key, F.concat(F.lit("b_"), "cue_id"), S.round2("start_sec"), S.boundary_type("cue_type"), F.lit("cue"), F.col("confidence"), F.array("text"))
    c = screen_changes.select(key, S.numbered("b_ocr_", "seq", 6), "time_sec", F.lit("scene"), F.lit("ocr_text_change"), F.lit(0.55), F.array(F.lit("RapidOCR text change candidate")))
    edges = F.explode(F.array(*(F.struct(F.lit(e).alias("edge"), F.col(f"{e}_sec").alias("t")) for e in ("start", "end")))).alias("x")
    d = non_editorial.select(key, "seq", "kind", edges)
    d = d.select(key, F.concat(S.numbered("b_cm_", "seq", 6), F.lit("_"), "x.edge"), S.round2("x.t"), F.concat(F.lit("cm_"), "x.edge"), F.lit("cm_detector"), F.lit(0.86), F.array("kind"))
    return in_order(a.union(b).union(c).union(d), "time_sec", "boundary_id", key=key)


def in_order(df: DataFrame, *columns: str, key: str = KEY) -> DataFrame:
    """Rows sorted within partitions that hold whole programs, as they are to be written."""
    return df.repartition(key).sortWithinPartitions(key, *columns)


def cue_rows(primary: DataFrame, break_: str = S.BREAK_CUE, resume: str = S.RESUME_CUE, topic: str | None = None, markers: str = S.DISCOURSE_MARKERS, key: str = KEY) -> DataFrame:
    """Classified cues in order; weak ones only with a discourse marker; ids count what is left."""
    found = primary.withColumn("c", S.cue("text", break_, resume, topic)).where((F.col("c.cue_type") != "weak_discourse") | F.col("text").rlike(markers))
    w = Window.partitionBy(key).orderBy("seq")
    return found.select(key, "seq", S.numbered("cue", F.row_number().over(w) - 1, 5).alias("cue_id"), "start_sec", "end_sec", S.truncate_text("text", 180).alias("text"), "c.cue_type", "c.strength", "c.confidence")


def text_units(primary: DataFrame, captions_present: Column, fused: Column, key: str = KEY) -> DataFrame:
    """Numbered text units with their provenance and confidence; every unit lasts a tenth of a second at least."""
    w = Window.partitionBy(key).orderBy("seq")
    source = F.when(F.col("source").isin("fused", "caption"), "subtitle").when(F.col("source") == "asr", "asr").otherwise("none")
    sure = F.when(fused & (source == "subtitle"), 0.86).when(source == "subtitle", 0.78).when(source == "asr", 0.55).otherwise(0.0)
    return primary.select(key, S.numbered("tu", F.row_number().over(w) - 1, 6).alias("unit_id"), "start_sec", F.greatest(F.col("end_sec"), F.col("start_sec") + 0.1).alias("end_sec"), "text", source.alias("provenance"), sure.alias("confidence"))


def best_source(streams: DataFrame, order: tuple[str, ...] = ("fused", "caption", "asr"), key: str = KEY) -> DataFrame:
    """Of several streams (column source) the rows of each program's first one in the order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    best = streams.where(place > 0).groupBy(key).agg(F.min(place).alias("__best"))
    return streams.join(best, key).where(place == F.col("__best")).drop("__best")
