"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles. One pass makes every set's registers and their band
keys; documents that share a band key, directly or through others, form a candidate cluster. Within a
cluster the joint likelihood estimate drops pairs that are far below the threshold, the rest are
confirmed on full sets, and only links that join two parts are kept. Equal sets are one node throughout,
so groups of exact copies cost no pairs; clusters over BLOCK documents are confirmed in pairs of blocks.

Documents without words have an empty set and stay alone. Rows with a null id have a null component and
are kept. Rows that share an id are one document: what is linked to one of their texts is linked to all. Null texts
count as empty. Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .shared import keep, shuffle_partitions, text_of
from .tokens import U64, Words, mix, shingles, texts

#: Linked if PERCENT * union <= 100 * intersection. Registers, bands and the floor of estimates that are confirmed follow from it.
PERCENT, BLOCK = 85, 600


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for t in texts(column):
        h, off = shingles(Words(t))
        for i in range(t.n):
            yield np.unique(h[off[i] : off[i + 1]])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n, k1 and k2 (together the set's identity) and band keys of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands = [], [], []
            for s in _sets(batch.column("t")):
                n.append(len(s))
                keys.append((s.sum(dtype=U64), mix(s ^ U64(0x5BF03635)).sum(dtype=U64)) if len(s) else (U64(0), U64(0)))
                bands.append(sketch.band_keys(sketch.registers(s, sketch.size_for(percent))) if len(s) else np.zeros(0, np.int64))
            k = np.array(keys, dtype=U64).reshape(-1, 2).view(np.int64)
            off = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), lists], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return keep(source.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>"), "sketches")


def forest(sets: list[np.ndarray], ids: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links that connect what all confirmed links among these sets connect.

    A search from each unvisited set looks only at sets not yet visited, so a group of mutual copies
    takes one step, and no pair is confirmed twice.
    """
    if len(sets) < 2:
        return
    regs, floor = np.stack([sketch.registers(s, sketch.size_for(percent)) for s in sets]), sketch.floor_for(percent)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    words, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(words), dtype=bool)
    rest = np.arange(len(sets))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            small, large = np.minimum(size[rest], size[x]), np.maximum(size[rest], size[x])
            near = np.flatnonzero(100 * small >= percent * large)
            near = near[sketch.at_least(regs[rest[near]], regs[x], size[rest[near]], size[x], floor)] if len(near) else near
            if not len(near):
                continue
            cand = rest[near]
            mark[inverse[off[x] : off[x + 1]]] = True
            pieces = [inverse[off[c] : off[c + 1]] for c in cand]
            both = np.add.reduceat(mark[np.concatenate(pieces)].astype(np.int64), np.cumsum([0, *map(len, pieces[:-1])]))
            mark[inverse[off[x] : off[x + 1]]] = False
            hit = 100 * both >= percent * (size[x] + size[cand] - both)
            for c in cand[hit]:
                yield int(ids[x]), int(ids[c])
            queue += cand[hit].tolist()
            rest = np.delete(rest, near[hit])


def links(docs: DataFrame, made: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(u, v): enough confirmed links between documents with different sets to connect all that are linked."""
    spark = docs.sparkSession
    nodes = made.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    banded = nodes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    clusters = components(banded.join(shared, "band").where("id != least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct())
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") < 3, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        clusters.join(sizes, "component").withColumn("mine", mine).withColumn("other", F.explode(others))
        .select("id", "component", F.when(F.col("blocks") < 3, 0).otherwise(F.least("mine", "other")).alias("g"), F.when(F.col("blocks") < 3, 0).otherwise(F.greatest("mine", "other")).alias("h"))
    )
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def confirmed(group):
            pairs = list(forest([s for _, s in group], np.array([i for i, _ in group]), percent))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

        key, group = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("component", "g", "h")))
            for k, i, s in zip(keys, batch.column("id").to_pylist(), _sets(batch.column("t"))):
                if k != key:
                    if len(group) > 1:
                        yield confirmed(group)
                    key, group = k, []
                if len(s):
                    group.append((i, s))
        if len(group) > 1:
            yield confirmed(group)

    gathered = dealt.hint("merge").join(source, "id").repartition(shuffle_partitions(spark), "component", "g", "h").sortWithinPartitions("component", "g", "h", "id")
    return gathered.mapInArrow(run, "u long, v long")


def same_id(made: DataFrame) -> DataFrame:
    """(u, v): links between the sets of ids that come with several."""
    rows = made.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "k1", "k2")
    either = F.struct("k1", "k2")
    again = rows.groupBy("doc_id").agg(F.min(either).alias("a"), F.max(either).alias("b")).where("a != b").select("doc_id")
    of = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")).join(rows.join(again, "doc_id", "left_semi"), ["k1", "k2"]).select("doc_id", "id")
    return of.join(of.groupBy("doc_id").agg(F.min("id").alias("v")), "doc_id").where("id != v").select(F.col("id").alias("u"), "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    made = sketches(docs, id_col, text_col, percent)
    found = components(links(docs, made, id_col, text_col, percent, block).union(same_id(made)))
    nodes = made.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    # kept, so that the join below has two plain shuffles and a group of very many copies can be split
    label = keep(nodes.join(found, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component")), "components")
    out = made.select("doc_id", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2").join(label, ["k1", "k2"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
