"""Connected components of links, by alternating stars.

Every round joins each node's links with the smallest neighbour: larger neighbours move to it,
then smaller ones. Rounds end when no link changes, after about log^2(nodes) of them at worst;
links stay in the cluster, and a node with very many links is only one side of a join that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import kept


def _sides(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _state(links: DataFrame) -> tuple[int, int | None]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node of `links` (a, b)."""
    now = kept(_sides(links), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(first, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(moved.unionByName(first.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
