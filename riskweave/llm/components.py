"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").hint("merge").join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.hint("merge").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int | None]:
    found = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(found)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v; not null) but the roots themselves.

    The root is the smallest node of the component. Each round leaves at most as many edges as
    before, is written to the shared folder, and only two numbers about it reach the driver.
    Hub nodes are joined, never gathered, and no table is broadcast, however small its file. An
    empty link table gives an empty result; repeated links and links of a node to itself change
    nothing.
    """
    edges = store(links.select("u", "v").where("u <> v").distinct(), "links")
    seen = _state(edges)
    while seen[0]:
        edges = store(_small_star(_large_star(edges)), "stars")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
