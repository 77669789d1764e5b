"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelvec.session import stage


def _least(links: DataFrame) -> DataFrame:
    """(u, least neighbour or itself). A minimum is combined before the shuffle, whatever the degree."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the node's least neighbour."""
    links = _both(edges)
    return links.join(_least(links), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the least of them."""
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(links)
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for all nodes of the undirected ``edges`` (a, b); component is the least id reached.

    Both steps are joins with a combined minimum, so a node with very many links is
    no single task's work: adaptive execution splits its join partition. Each step is
    written to the shared folder, which cuts the lineage. Loops and repeated links are
    allowed; no edges give no rows; nodes without links do not appear.
    """
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
    links = stage(links, "components")
    before = None
    while (now := _state(links)) != before:
        before = now
        step = _large_star(links).where("u <> v").distinct()
        links = stage(_small_star(step).where("u <> v").distinct(), "components")
    found = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return found.union(roots)
