"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, keep


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool, shelf: list[str]) -> DataFrame:
    """Hang neighbours on the smallest one: larger neighbours of every node, or the node and its smaller ones.

    The minimum is aggregated before it is joined back, so a node with very many links isn't gathered anywhere; it
    is kept, so that the join has two plain shuffles and such a node's links can be split.
    """
    directed = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = keep(least, "least", shelf=shelf)
    met = directed.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node with a link to another; component is the smallest id that it reaches.

    edges: u, v (long). Self-links and repeats don't matter.
    """
    before, now_kept = [], []
    edges = keep(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", shelf=before)
    state = None
    for _ in range(rounds):
        stars: list[str] = []
        edges = keep(_star(_star(edges, True, stars), False, stars), "links", shelf=now_kept)
        discard(edges.sparkSession, before + stars)
        before.clear()
        before, now_kept = now_kept, before
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("s")).first()
        if state == (now["n"], now["s"]):
            break
        state = (now["n"], now["s"])
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
