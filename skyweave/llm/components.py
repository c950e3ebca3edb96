"""Connected components of a link table, by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.common import discard, materialize, salted_join


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every vertex of `links` (a, b) but the smallest of each component, which is its name.

    Each round replaces links by links to smaller vertices, keeping components; it ends when none changes, after about
    log(vertices) rounds. Vertices with very many links are reduced to partial minimums, and their links are joined in
    slices of bounded size. Self-links and repeated links are allowed; an empty table gives an empty one.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "links")
        discard(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free hash of the links, to see whether a round changed any."""
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return r.n, r.h
