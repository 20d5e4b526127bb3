"""Connected components by alternating star steps, with the smallest node as the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.shared import cut_lineage

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``: longs); ``root`` is the smallest reachable.

    Each round moves every link to the smallest neighbour of its larger end, then of its smaller
    end, and writes the links to the shared folder. Rounds grow with the logarithm of the longest
    path. Minima are pre-aggregated before they are shuffled, and no neighbourhood is gathered.
    """
    edges = cut_lineage(_ordered(links.select("a", "b")))
    before = None
    for _ in range(MOST_ROUNDS):
        edges = cut_lineage(_small_star(_large_star(edges)))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links with the smaller end first."""
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _ordered(edges.join(smallest, edges["a"] == smallest["u"]).select(F.col("m").alias("a"), F.col("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    smallest = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(smallest, "b").select(F.col("a").alias("x"), F.col("m"))
    kept = smallest.select(F.col("b").alias("x"), F.col("m"))
    return _ordered(moved.union(kept).select(F.col("m").alias("a"), F.col("x").alias("b")))
