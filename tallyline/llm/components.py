"""Connected components by alternating stars; no node's neighbours are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v) with the larger (large) or smaller neighbours of each node moved to its smallest neighbour."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node: the smallest node it reaches.  ``links``: columns a, b (integers)."""
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        edges = durable(_star(durable(_star(edges, True)), False))
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of ``roots`` after more ``links`` (a, b).

    Links are moved to the roots of their ends, so only components that they join are walked; a root is the smallest
    node of its component, and so is the smallest of joined roots.
    """
    found = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    moved = links.select("a", "b").join(found("a"), "a", "left").join(found("b"), "b", "left")
    merged = durable(components(moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    led = merged.select(F.col("node").alias("root"), F.col("root").alias("__to"))
    known = roots.join(led, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
    return known.unionByName(merged.join(roots, "node", "left_anti"))
