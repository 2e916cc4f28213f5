"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch


def _saved_edges(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The distinct edges, written, and a print of the whole set from the same job."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    edges = edges.distinct().observe(
        seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")
    )
    edges = scratch.save(edges, name)
    got = seen.get
    return edges, (got["n"], got["x"], got["s"])


def _star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``u, v, m``: each edge with the smallest node among u and u's partners. The minima are
    written first, so that a node with very many edges is a plain, splittable join key."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return edges.join(scratch.save(least, name), "u")


def components(edges: DataFrame, out: Scratch, name: str = "components") -> DataFrame:
    """``node, root`` of every node in ``edges(u, v)``, saved in ``out``; the root is the
    smallest node.

    Loops and nulls are left out, repeated edges count once. Each round joins edges with one
    minimum per node; the edges end as stars around the roots. No node's partners are ever
    gathered.
    """
    with Scratch(edges.sparkSession) as scratch:
        edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges, state = _saved_edges(edges, scratch, f"{name}-e")
        while state[0]:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _star(both, scratch, f"{name}-large").where("v > u")
            large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges, _ = _saved_edges(large, scratch, f"{name}-e")
            # u > v holds for every edge: v is one of u's smaller partners.
            small = _star(edges, scratch, f"{name}-small")
            small = small.select(
                F.inline(
                    F.array(
                        F.struct("u", F.col("m").alias("v")),
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    )
                )
            ).where("u <> v")
            edges, now = _saved_edges(small, scratch, f"{name}-e")
            if now == state:
                break
            state = now
        member = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        every = member.unionByName(member.select(F.col("root").alias("node"), "root")).distinct()
        return out.save(every, name)
