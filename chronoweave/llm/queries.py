"""One query for each corpus operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, language_model, line_dedup, near_duplicates, neighbours, packing, repeats, secrets, warc
from .shared import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best passage for each benchmark item that it leaks."""
    return decontaminate.passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's ids and where it lies in the packed sequences."""
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives says, after writing and reading them."""
    found = warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).where(F.col("kind") == "record")
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every embedding whose id is divisible by 20."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from the rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held))
    return language.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without strings of 100 bytes that occurred before."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with those that the ownership counts add."""
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document; learned from the rows that aren't held out."""
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return language_model.score(_table(spark, sf_dir, "documents").select("doc_id", "text", held))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted and a digest of what is left of it."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_neighbours": op5_neighbours,
    "op6_language": op6_language,
    "op7_repeats": op7_repeats,
    "op8_secrets": op8_secrets,
    "op9_language_model": op9_language_model,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [CAST(len(w) AS VARCHAR) || ' ' || array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: '5 ' || array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
        ),
        each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b USING (x) GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
        SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(min(r.v), s.doc_id) AS component_id, coalesce(min(r.v), s.doc_id) = s.doc_id AS kept
        FROM s LEFT JOIN reach r ON s.doc_id = r.u GROUP BY s.doc_id, s.s
    """,
    "op7_repeats": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM b WHERE n >= 100)),
        first AS (SELECT x, min(doc_id * 100000000 + p) AS f FROM s GROUP BY x HAVING count(*) > 1),
        gone AS (SELECT doc_id, p FROM s JOIN first USING (x) WHERE doc_id * 100000000 + p > f),
        isl AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM gone)),
        spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM isl GROUP BY doc_id, k),
        parts AS (
            SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS z FROM spans
            UNION ALL SELECT b.doc_id, 0, coalesce((SELECT min(a) FROM spans WHERE spans.doc_id = b.doc_id), 1000000000) FROM b
        ),
        kept AS (SELECT b.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (least(z, n) - a)), '' ORDER BY a) AS h FROM b JOIN parts USING (doc_id) GROUP BY 1),
        cut AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
        SELECT b.doc_id, b.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
        FROM b JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
            SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
                array_to_string(list_transform(string_split(sha1(html), ''), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', x) - 1)::INTEGER + 1, 4)), '') AS bits
            FROM p
        )
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(5), lambda j: substr(bits, (5 * i + j + 1)::INTEGER, 1)::INTEGER * (16 >> j::INTEGER)))::INTEGER + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d
    """,
    "op10_line_dedup": """
        WITH ln AS (
            SELECT doc_id, i - 1 AS line, raw, list_filter(regexp_split_to_array(lower(raw), '[ \\t\\x0b\\x0c\\r]+'), lambda x: x <> '') AS w
            FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
        ),
        d AS (SELECT w, any_value(len(w)) AS n, min(doc_id * 1000000 + line) AS first FROM ln WHERE len(w) > 0 GROUP BY w),
        e AS (SELECT *, list_reverse(w) AS r FROM d WHERE n >= 7),
        pairs AS (
            SELECT a.first, a.n AS n, b.n AS m, least(a.n, b.n) AS k, a.w AS x, b.w AS y, a.r AS xr, b.r AS yr
            FROM e a JOIN (SELECT *, unnest([n - 1, n, n + 1]) AS near FROM e) b ON a.n = b.near AND b.first < a.first AND greatest(a.n, b.n) >= 8
        ),
        gone AS (
            SELECT DISTINCT first FROM (
                SELECT first, n, m, k, coalesce(list_position(list_transform(range(1, k + 1), lambda i: x[i] = y[i]), false) - 1, k) AS head,
                    coalesce(list_position(list_transform(range(1, k + 1), lambda i: xr[i] = yr[i]), false) - 1, k) AS tail FROM pairs)
            WHERE head + tail >= k - (n = m)::INT
        ),
        kept AS (
            SELECT ln.doc_id, ln.line, ln.raw, NOT coalesce(d.first < ln.doc_id * 1000000 + ln.line OR g.first IS NOT NULL, false) AS stays
            FROM ln LEFT JOIN d ON ln.w = d.w LEFT JOIN gone g ON d.first = g.first
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE stays), '')) AS kept_sha256
        FROM kept GROUP BY doc_id
    """,
}
