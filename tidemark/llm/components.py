"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: A node of fewer links never lands alone in a task.
HUB_LINKS = 1 << 16


def _hooked(links: DataFrame, least: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``links`` (a, b) with m of their node a; the links of hubs stay where they are."""
    if hubs is None:
        return links.join(least, "a")
    tagged = links.join(F.broadcast(hubs.withColumnRenamed("m", "hub__")), "a", "left")
    known = tagged.where("hub__ is not null").select("a", "b", F.col("hub__").alias("m"))
    return known.union(tagged.where("hub__ is null").select("a", "b").join(least, "a").select("a", "b", "m"))


def _least(links: DataFrame, n: int, hub_links: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(a, m): the smallest b of each a; and those of the hubs, at most 10,000, if there can be any."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hub_links = max(hub_links, n // 10_000)
    if n <= hub_links:
        return least.select("a", "m"), None
    least = scratch.save(least)
    return least.where(F.col("n") <= hub_links).select("a", "m"), least.where(F.col("n") > hub_links).select("a", "m")


def _large_star(edges: DataFrame, n: int, hub_links: int, scratch: Scratch) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, hubs = _least(both, 2 * n, hub_links, scratch)
    hooked = _hooked(both, least, hubs).where(F.col("b") > F.col("a"))
    return hooked.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int, hub_links: int, scratch: Scratch) -> DataFrame:
    least, hubs = _least(edges, n, hub_links, scratch)
    hooked = _hooked(edges, least, hubs).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    mins = least if hubs is None else least.union(hubs)
    return hooked.union(mins.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, hub_links: int = HUB_LINKS) -> DataFrame:
    """(node long, component long) for every node of ``edges`` (a long, b long).

    component is the smallest node that links reach. Self-links and rows with nulls are ignored; an empty
    table gives an empty result. Each round is written to the scratch folder, so lineage stays short. A node of
    over ``hub_links`` links, or a ten-thousandth of all, gets its minimum by a broadcast of at most 10,000 rows.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        large = _large_star(edges, before[0], hub_links, scratch)
        large = scratch.save(large) if 2 * before[0] > hub_links else large
        after_edges = scratch.save(_small_star(large, before[0], hub_links, scratch))
        after = mark(after_edges)
        scratch.drop(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
