"""Line de-duplication by a deletion-neighbourhood join, in DataFrame functions only.

A line's words are its runs of characters outside 0x20 and 0x09-0x0D, lower-cased. A line goes if
an earlier one (smaller doc_id, then smaller line number) has the same words or, where the longer of the
two has at least min_words words, is one word edit away: one word replaced, inserted or deleted. Lines
are judged on the input, so an earlier line counts even if it goes itself. Every line with a word is judged;
blank ones always stay.

Equal lines become one first. Lines that share neither their first nor their last words with a line of about
their length can't be one edit apart and drop out next: of two such lines, an edit leaves one end alone. Each
remaining line emits all its variants within the bound as hashed keys: itself, and itself without
each of its words. Equal keys meet in an aggregation that keeps the earliest line of the key, so no
group is expanded into pairs; the edit distance to that line is then verified on the words.

Null texts count as empty and stay null. A row is known by its id and a hash of its text: rows with a null id
come last in the order, rows that share an id come in order of that hash, and rows equal in both count as one
document. Extra columns pass through, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, free_name, keep, shuffle_partitions

#: Fewest words of the longer of two lines that are compared under the edit bound of one word.
MIN_WORDS = 8
_LAST = (1 << 63) - 1
#: What tells rows apart, and what tells lines apart.
ROW = ["doc_id", "row"]
PLACE = [*ROW, "line"]


def rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row and t, the text, of every row that has one."""
    t = F.col(text_col).cast("string")
    return docs.where(t.isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(t).alias("row"), t.alias("t"))


def lines(texts: DataFrame) -> DataFrame:
    """PLACE and s, its words with one space between, of every line of rows()."""
    low = F.lower("t")
    odd = [F.contains(low, F.lit(c)) for c in ("\t", "\x0b", "\x0c", "\r")]
    clean = F.when(odd[0] | odd[1] | odd[2] | odd[3], F.regexp_replace(low, "[\\x09\\x0B-\\x0D]", " ")).otherwise(low)
    return texts.select(*ROW, F.posexplode(F.split(clean, "\n", -1)).alias("line", "raw")).select(*PLACE, _squeeze(F.col("raw")).alias("s"))


def _squeeze(line: Column) -> Column:
    """Single spaces only, none at the ends."""
    line = F.btrim(line)
    return F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, "\\x20{2,}", " ")).otherwise(line)


def _count(s: Column) -> Column:
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """PLACE of the lines that go."""
    parts, shelf = shuffle_partitions(docs.sparkSession), []
    s, least = F.col("s"), min_words - 1
    source = rows(docs, id_col, text_col)
    every = lines(source).where(s != "").withColumn("n", _count(s))
    every = keep(every.select(*PLACE, "n", F.xxhash64(s).alias("h"), F.xxhash64(s, F.lit(1)).alias("g"), *_ends(s, least)), "lines")
    place = F.struct(*PLACE)
    first = every.groupBy("h", "g", "n").agg(F.min(place).alias("first"), F.count("*").alias("times"), *(F.min(k).alias(k) for k in ENDS))
    first = keep(first, "distinct-lines", shelf=shelf)

    # Lines that could have a neighbour: some other line of about this length has one of its ends.
    # (The same filter on both sides of a join lets its two branches share one shuffle.)
    ended = first.where(F.col("n") >= least).select("h", "g", F.posexplode(F.array(*ENDS)).alias("which", "k")).where(F.col("k").isNotNull()).repartition(parts, "k")
    met = ended.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("k")
    sides = ended.join(met, "k").groupBy("h", "g").agg(F.max(F.col("which") % 2 == 0).alias("head"), F.max(F.col("which") % 2 == 1).alias("tail"))
    near = keep(sides.join(first.select("h", "g", "first"), ["h", "g"]), "near-lines", shelf=shelf)

    # Their words, fetched again at each line's first place.
    asked = near.select("h", "g", "head", "tail", "first.*")
    there = source.hint("merge").join(asked.select(*ROW).distinct(), ROW, "left_semi")
    fetched = (
        lines(there).join(asked, PLACE).where(F.xxhash64("s") == F.col("h"))
        .select(place.alias("place"), "head", "tail", F.split("s", " ").alias("words"))
    )
    fetched = keep(fetched, "line-words", "zstd", shelf)

    # A key of a deletion carries its position where a word is replaced (both lines lack the word there),
    # and none where a word is inserted or deleted (the variant is the other line whole).
    # Lines that share their first words only can be one edit apart only beyond them, and so for the last.
    source = fetched.where(F.col("place").isNotNull())
    n = F.size("words")
    each = source.select("place", "head", "tail", _end_length(n - 1).alias("end"), n.alias("n"), F.posexplode(_variants()).alias("at", "key"))
    each = each.where((F.col("head") & (F.col("at") >= F.col("end"))) | (F.col("tail") & (F.col("at") < F.col("n") - F.col("end"))))
    replaced = each.select("place", F.xxhash64("key", "at").alias("key"), F.lit(True).alias("whole"), F.lit(True).alias("part"))
    dropped = each.select("place", F.xxhash64("key", F.lit(-1)).alias("key"), F.lit(False).alias("whole"), F.lit(True).alias("part"))
    itself = source.select("place", F.xxhash64(_whole(), F.lit(-1)).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("part"))
    keyed = replaced.union(dropped).union(itself).repartition(parts, "key")
    earliest = (
        keyed.groupBy("key").agg(F.count("*").alias("c"), F.min(F.when(F.col("whole"), F.col("place"))).alias("whole_first"), F.min(F.when(F.col("part"), F.col("place"))).alias("part_first"))
        .where(F.col("c") > 1)
    )
    met = (
        keyed.join(earliest, "key")
        .withColumn("other", F.when(F.col("part") & ~F.col("whole"), F.col("whole_first")).otherwise(F.col("part_first")))
        .where(F.col("other") < F.col("place")).select("place", "other").distinct()
    )
    a, b = fetched.select("place", F.col("words").alias("x")), fetched.select(F.col("place").alias("other"), F.col("words").alias("y"))
    long = F.greatest(F.size("x"), F.size("y")) >= min_words
    verified = met.join(a, "place").join(b, "other").where(long & within_one("x", "y")).select("place").distinct()
    gone = near.join(verified, near["first"] == verified["place"], "left_semi").select("h", "g", F.lit(True).alias("gone"))

    # Lines that stand once and stay are left out; kept, so that a line of very many documents can be split.
    judged = first.join(gone, ["h", "g"], "left").where((F.col("times") > 1) | F.col("gone"))
    verdict = keep(judged.select("h", "g", "n", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "line-verdicts")
    discard(docs.sparkSession, shelf)
    later = every.select(*PLACE, "h", "g", "n").join(verdict, ["h", "g", "n"])
    return later.where(F.col("gone") | (place != F.col("first"))).select(*PLACE).distinct()


ENDS = ("k0", "k1", "k2", "k3")


def _end_length(n: Column) -> Column:
    """How many first or last words of a line of n words make its key: half of the rest, rounded down to quarters of a power of two."""
    m = F.floor((n - 1) / F.lit(2)).cast("int")
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(m + 0.5)) - 2), F.lit(1.0))
    return (F.floor(m / step) * step).cast("int")


def _ends(s: Column, least: int) -> list[Column]:
    """Keys of a line's first and last words; where a shorter line's would have another length, keys of that one too."""
    n = F.col("n")
    own, shorter = _end_length(n), _end_length(n - 1)
    cut = lambda length, which: F.xxhash64(F.call_function("substring_index", s, F.lit(" "), length if which == 0 else -length), length, F.lit(which))
    more = (n > least) & (own != shorter)
    return [*(F.when(n >= least, cut(own, w)).alias(ENDS[w]) for w in (0, 1)), *(F.when(more, cut(shorter, w)).alias(ENDS[2 + w]) for w in (0, 1))]


def _whole() -> Column:
    """The exclusive-or of the hashes of all words with their positions."""
    return F.expr("aggregate(transform(words, (w, i) -> xxhash64(w, i)), 0L, (acc, x) -> acc ^ x)")


def _variants() -> Column:
    """For each word, what _whole() gives for the line without it.

    Words before it keep their positions, those after it move up by one: running exclusive-ors of both
    kinds of hashes give each variant in one step. Words go by pieces of 256, as appending copies a list.
    """
    piece = """aggregate(
            transform(slice(words, c * 256 + 1, 256), (w, i) -> named_struct('a', xxhash64(w, c * 256 + i), 'b', xxhash64(w, c * 256 + i - 1))),
            named_struct('before', acc.before, 'after', acc.after, 'keys', cast(array() as array<bigint>)),
            (p, x) -> named_struct('before', p.before ^ x.a, 'after', p.after ^ x.b, 'keys', array_append(p.keys, p.before ^ p.after ^ x.b)))"""
    return F.expr(
        f"""aggregate(
            sequence(0, cast((size(words) - 1) div 256 as int)),
            named_struct('before', 0L, 'after', aggregate(transform(words, (w, i) -> xxhash64(w, i - 1)), 0L, (o, x) -> o ^ x), 'keys', cast(array() as array<array<bigint>>)),
            (acc, c) -> aggregate(array({piece}), acc, (o, r) -> named_struct('before', r.before, 'after', r.after, 'keys', array_append(o.keys, r.keys))),
            acc -> flatten(acc.keys))"""
    )


def within_one(x: str, y: str) -> Column:
    """Whether the word lists x and y are equal or one word edit apart."""
    a, b = F.col(x), F.col(y)
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    same = F.zip_with(F.slice(a, 1, short), F.slice(b, 1, short), lambda p, q: p == q)
    head = F.coalesce(F.expr(f"array_position(zip_with({x}, {y}, (p, q) -> coalesce(p = q, false)), false)") - 1, F.lit(0)).cast("int")
    head = F.when(F.exists(same, lambda s: ~s), head).otherwise(short)
    tail = lambda c, size, skip: F.slice(c, head + skip + 1, F.greatest(size - head - skip, F.lit(0)))
    one = F.lit(1)
    none = F.lit(0)
    return (F.abs(n - m) <= 1) & F.when(n == m, tail(a, n, one) == tail(b, m, one)).when(n > m, tail(a, n, one) == tail(b, m, none)).otherwise(tail(a, n, none) == tail(b, m, one))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """docs with removed lines taken out of the text, and n_lines and n_removed, named with the prefix; columns of these names are replaced.

    Every row stays, with an empty text where all its lines go.
    """
    base = docs.drop(prefix + "n_lines", prefix + "n_removed")
    names, (at, row, lost) = base.columns, (free_name(base, c) for c in ("__id", "__row", "__gone"))
    gone = removed(docs, id_col, text_col, min_words).groupBy(*ROW).agg(F.sort_array(F.collect_list("line")).alias(lost))
    gone = gone.select(F.col("doc_id").alias(at), F.col("row").alias(row), lost)
    base = base.withColumns({at: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), row: F.xxhash64(F.col(text_col).cast("string"))})
    met = base.join(gone, [at, row], "left")
    raw = F.split(F.col(text_col).cast("string"), "\n", -1)
    marks = F.map_from_arrays(F.col(lost), F.transform(lost, lambda x: F.lit(True)))
    left = F.array_join(F.filter(raw, lambda x, i: F.element_at(marks, i).isNull()), "\n")
    none = F.col(lost).isNull() | F.col(text_col).isNull()
    text = F.when(none, F.col(text_col).cast("string")).otherwise(left)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(raw)).cast("long")
    return met.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in names),
        n_lines.alias(prefix + "n_lines"), F.when(none, 0).otherwise(F.size(lost)).cast("long").alias(prefix + "n_removed"),
    )
