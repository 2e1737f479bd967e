"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Vectors are made distinct, dealt to shards by hash, and each shard builds a graph of its own: greedy
searches propose neighbours, relaxed distance pruning keeps diverse edges. A query's beam search walks
the graph of every shard, and the shards' finds are merged. Nearness is the largest inner product; for
the graph, vectors are lengthened to one norm so that it is also the smallest Euclidean distance.

Rows with a null id, or whose vector is null, zero or holds null or non-finite components, take no
part. Rows that repeat an id are candidates each; as queries, equal ones are one and others share one list. Repeated vectors are one node that carries its k + 1 smallest ids, which is all that a result of
k rows can show. Vectors of different lengths never meet. Extra columns don't matter. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

#: Distinct vectors in a shard; queries in a block; blocks that a task searches one shard for.
SHARD, QUERY_BLOCK, BLOCKS_A_TASK = 4096, 1024, 64


class Graph:
    """A directed graph over the rows of x with at most `degree` edges from each."""

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, slack: float = 1.2, starts: int = 16, seed: int = 7):
        self.x, self.degree, self.beam = np.ascontiguousarray(x, dtype=np.float32), degree, beam
        n = len(x)
        rng = np.random.default_rng(seed)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        centre = int(np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1)))
        self.starts = np.unique(np.concatenate([[centre], rng.choice(n, min(n, starts), replace=False)]))
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        if n > 1:
            for j in range(min(degree // 2, n - 1)):
                self.edges[:, j] = (np.arange(n) + rng.integers(1, n, n)) % n
            for a in (1.0, slack):
                order = rng.permutation(n)
                for lo in range(0, n, 256):
                    self._insert(order[lo : lo + 256], a)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the beam's nodes (-1 for none) and squared distances less |q|^2, nearest first."""
        n, m = len(self.x), len(q)
        beam = min(beam, n)
        seen = np.zeros((m, n), dtype=bool)
        seen[:, self.starts] = True
        width = max(beam, len(self.starts))
        ids = np.full((m, width), -1, dtype=np.int64)
        dist = np.full((m, width), np.inf, dtype=np.float32)
        ids[:, : len(self.starts)] = self.starts
        dist[:, : len(self.starts)] = self.sq[self.starts] - 2 * (q @ self.x[self.starts].T)
        done = np.zeros((m, width), dtype=bool)
        live = np.arange(m)
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
            best = open_.argmin(axis=1)
            go = open_[np.arange(len(live)), best] < np.inf
            live, best = live[go], best[go]
            if not len(live):
                break
            done[live, best] = True
            near = self.edges[ids[live, best]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            rows, cols = np.nonzero(fresh)
            seen[live[rows], near[rows, cols]] = True
            d = np.full(near.shape, np.inf, dtype=np.float32)
            picked = near[rows, cols]
            d[rows, cols] = self.sq[picked] - 2 * np.einsum("ij,ij->i", self.x[picked], q[live[rows]])
            all_d = np.concatenate([dist[live], d], axis=1)
            all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, dtype=bool)], axis=1)
            top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            r = np.arange(len(live))[:, None]
            pad = width - beam
            put = lambda a, fill: np.concatenate([a[r, top], np.full((len(live), pad), fill, dtype=a.dtype)], axis=1) if pad else a[r, top]
            dist[live], ids[live], done[live] = put(all_d, np.inf), put(all_i, -1), put(all_done, True)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        r = np.arange(m)[:, None]
        return ids[r, order], dist[r, order]

    def _insert(self, points: np.ndarray, slack: float) -> None:
        found, _ = self.search(self.x[points], self.beam)
        chosen = self._prune(points, np.concatenate([found, self.edges[points]], axis=1), slack)
        self.edges[points] = chosen
        back = pd.DataFrame({"to": chosen.ravel(), "of": np.repeat(points, self.degree)})
        back = back[back["to"] >= 0].sort_values("to", kind="stable")
        nodes, first, count = np.unique(back["to"].to_numpy(), return_index=True, return_counts=True)
        of = back["of"].to_numpy()
        for lo in range(0, len(nodes), 512):
            some, f, c = nodes[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
            more = np.full((len(some), int(c.max())), -1, dtype=np.int64)
            at = np.arange(more.shape[1])[None, :] < c[:, None]
            more[at] = np.concatenate([of[a : a + k] for a, k in zip(f, c)])
            self.edges[some] = self._prune(some, np.concatenate([self.edges[some], more], axis=1), slack)

    def _prune(self, points: np.ndarray, cand: np.ndarray, slack: float) -> np.ndarray:
        """Keep the nearest candidate, drop those that it is nearer to by the slack than the point is, repeat."""
        cand = np.sort(np.where(cand == points[:, None], -1, cand).astype(np.int64), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        v = self.x[cand]
        to_point = self.sq[cand] + self.sq[points][:, None] - 2 * np.einsum("bcd,bd->bc", v, self.x[points])
        to_point = np.where(cand < 0, np.inf, np.maximum(to_point, 0)).astype(np.float32)
        gram = v @ v.transpose(0, 2, 1)
        out = np.full((len(points), self.degree), -1, dtype=np.int32)
        alive, r = to_point.copy(), np.arange(len(points))
        for j in range(self.degree):
            best = alive.argmin(axis=1)
            ok = alive[r, best] < np.inf
            if not ok.any():
                break
            out[ok, j] = cand[r, best][ok]
            sq = self.sq[cand]
            between = np.maximum(sq + sq[r, best][:, None] - 2 * gram[r, best], 0)
            alive[ok] = np.where((slack * slack * between <= to_point)[ok], np.inf, alive[ok])
            alive[r[ok], best[ok]] = np.inf
        return out


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The rows that take part, as vec_id long, v array<double>, dim int."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return (
        df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(vec_col).alias("dim"))
    )


def build_index(vectors: DataFrame, k: int = 20, shard_size: int = SHARD, degree: int = 32, beam: int = 64) -> DataFrame:
    """One row a shard: (shard, dim, n, x, edges, starts, ids, id_off), kept in the shared folder.

    vectors as from usable(). A shard holds about shard_size distinct vectors, so it fits one task.
    """
    first = Window.partitionBy("v").orderBy("vec_id")
    nodes = (
        vectors.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
        .groupBy("v", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    nodes = keep(nodes, "ann-nodes")
    sizes = nodes.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    shards, norm = max(1, -(-sizes["n"] // shard_size)), float(sizes["norm"] or 1.0)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([i[0] for i in pdf["ids"]], kind="stable")]
        x = np.stack(pdf["v"].to_numpy())
        longer = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))[:, None]
        g = Graph(np.concatenate([x, longer], axis=1), degree, beam)
        off = np.cumsum([0, *(len(i) for i in pdf["ids"])])
        return pd.DataFrame({
            "shard": [key[0]], "dim": [key[1]], "n": [len(x)], "x": [_pack(x)], "longer": [_pack(longer)], "edges": [_pack(g.edges)],
            "starts": [_pack(g.starts.astype(np.int64))], "ids": [_pack(np.concatenate(list(pdf["ids"])).astype(np.int64))], "id_off": [_pack(off.astype(np.int64))],
        })

    schema = "shard int, dim int, n int, x binary, longer binary, edges binary, starts binary, ids binary, id_off binary"
    return keep(dealt.groupBy("shard", "dim").applyInPandas(build, schema), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = 96, degree: int = 32, block_size: int = QUERY_BLOCK, blocks_a_task: int = BLOCKS_A_TASK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest finds, its own row left out.

    queries: vec_id, v, dim. Blocks of queries are dealt to the shards, where one task holds a shard's graph while
    up to blocks_a_task blocks pass by; only for more blocks is the shard sent again. Every query visits every
    shard, so the work is the number of queries times that of shards, whatever the number of machines.
    """
    spark = queries.sparkSession
    last = index.agg(F.max("shard")).first()[0]
    n = queries.count()
    if last is None or not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = -(-n // block_size)
    parts = -(-blocks // blocks_a_task)
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block")
    packed = queries.select("vec_id", "v", "dim", block).groupBy("block", "dim").agg(F.collect_set(F.struct("vec_id", "v")).alias("qs"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = index.select("*", each(parts).alias("part"), F.lit(0).alias("block"), F.lit(False).alias("asks"))
    asked = packed.select("dim", "qs", "block", (F.col("block") % parts).alias("part"), each(last + 1).alias("shard"), F.lit(True).alias("asks"))
    met = graphs.unionByName(asked, allowMissingColumns=True).repartition(min(20_000, (last + 1) * parts), "shard", "part").sortWithinPartitions("shard", "part", "dim", "asks", "block")

    def opened(one: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
        get = lambda c, t: np.frombuffer(one[c], dtype=t)
        g, m = Graph.__new__(Graph), one["n"]
        x = get("x", np.float64).reshape(m, one["dim"])
        g.x = np.concatenate([x, get("longer", np.float64).reshape(m, 1)], axis=1).astype(np.float32)
        g.sq = np.einsum("ij,ij->i", g.x, g.x)
        g.edges, g.starts, g.degree, g.beam = get("edges", np.int32).reshape(m, degree), get("starts", np.int64), degree, beam
        return g, x, get("ids", np.int64), get("id_off", np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                this = tuple(one[c].as_py() for c in ("shard", "part", "dim"))
                if not one["asks"].as_py():
                    held, key = opened({c: x.as_py() for c, x in one.items() if c != "qs"}), this
                elif key == this:
                    # a block of vectors of a length that the shard lacks finds no graph
                    qs = one["qs"].values
                    ids, flat = qs.field("vec_id").to_numpy(), qs.field("v").flatten().to_numpy().reshape(-1, this[2])
                    for lo in range(0, len(ids), 256):
                        yield answers(held, ids[lo : lo + 256], flat[lo : lo + 256])

    def answers(held: tuple, query: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        g, x, ids, off = held
        found, _ = g.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), beam)
        out = {"query_id": [], "vec_id": [], "score": []}
        for i, own in enumerate(query.tolist()):
            near = found[i][found[i] >= 0]
            vid = np.concatenate([ids[off[j] : off[j + 1]] for j in near]) if len(near) else np.zeros(0, np.int64)
            score = np.repeat(x[near] @ q[i], off[near + 1] - off[near])
            top = np.lexsort((vid, -score))
            top = top[vid[top] != own][:k]
            out["query_id"] += [own] * len(top)
            out["vec_id"] += vid[top].tolist()
            out["score"] += score[top].tolist()
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_size: int = SHARD, beam: int = 96) -> DataFrame:
    """The k nearest other rows of every row whose id is divisible by `every`, against all rows."""
    vectors = usable(df, id_col, vec_col)
    index = build_index(vectors, k, shard_size)
    return search(index, vectors.where(F.col("vec_id") % every == 0), k, beam)
