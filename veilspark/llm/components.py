"""Connected components of a graph of links, in DataFrames.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): in
the end every node is linked to the smallest node of its component. Each step is written to the shared
folder, so lineage stays short, and only a count and a checksum of the links come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stage


def _with_least(links: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Each directed link (u, v) with least, the smallest of u and its neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("least"))
    return links.join(least, "u").withColumn("least", F.least("u", "least"))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (u long, v long) -> (node, component), one row for each node that has a link to another one.

    component is the smallest node that can be reached. Null ends and links of a node to itself are left out;
    repeated links do no harm; no links give no rows.
    """
    edges = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "links")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = stage(large.filter("u <> v").distinct(), "large")
        # Here u > v holds for every link, so v are u's smaller neighbours.
        small = _with_least(large, large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        edges = stage(small.filter("u <> v").distinct(), "small")
        was, state = state, tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if state == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
