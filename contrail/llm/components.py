"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum (partially aggregated before the shuffle, so a
node with very many links is cheap) and a join back; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import landed


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the least of the node and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v")


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour smaller than a node, and the node, moves to the least of them."""
    low = e.groupBy("v").agg(F.min("u").alias("m"))
    down = e.join(low, "v").filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return down.union(low.select(F.col("m").alias("u"), "v"))


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node with a link.

    ``links`` has two integer columns; null ends, loops and repeats are
    ignored. The number of rounds is logarithmic in a component's size."""
    a, b = links.columns
    e = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v"))).distinct()
    mark, before = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")], None
    e = landed(e, "links")
    while (now := e.agg(*mark).first()) != before:
        before = now
        if not now["n"]:
            break
        e = landed(_small_star(_large_star(e).distinct()).distinct(), "links")
    own = e.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(own)
