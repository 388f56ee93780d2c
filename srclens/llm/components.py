"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.llm.common import written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours to the least node of its neighbourhood.

    A large star moves the larger neighbours of each node, a small star the node
    itself and its smaller ones.  Neighbourhoods are only summed up, never gathered.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("low")).withColumn(
        "low", F.least("at", "low"))
    moved = both.join(least, both["u"] == least["at"])
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            moved.select("u", F.col("low").alias("v")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of an edge is connected to.

    ``edges``: two columns of longs; direction, loops, nulls and repeats do not matter.
    The number of rounds grows with the logarithm of the longest chain; each round
    is written to the shared folder, and only three numbers reach the driver.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = e.where("u = v").select(F.col("u").alias("node"))
    e = written(e.where("u > v").distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary")))).first()
        if now == before or not now[0]:
            break
        before = now
        e = written(_stars(_stars(e, small=False), small=True))
    least = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = nodes.distinct().join(least.unionByName(roots), "node", "left_anti").select(
        "node", F.col("node").alias("component"))
    return least.unionByName(roots).unionByName(alone)
