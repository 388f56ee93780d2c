"""Vectors in blocks: a stated query set against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 16384
QUERIES_PER_BLOCK = 1024


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors without null, NaN or infinite components, one per id.

    Of rows that share an id the smallest vector counts; rows without an id are left out.
    """
    v = F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def grid(rows: DataFrame, every: int):
    """Cogroup of row blocks and query blocks; each task holds one of each.

    Queries are the rows whose id is divisible by ``every``.  Rows are dealt to
    blocks by a hash of the id, so equal vectors do not meet in one block.
    """
    is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    n, q = rows.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks, query_blocks = -(-n // ROWS_PER_BLOCK) or 1, -(-q // QUERIES_PER_BLOCK) or 1
    place, dim = F.xxhash64("vec_id"), F.size("v").alias("dim")
    left = rows.select(
        dim, F.pmod(place, F.lit(row_blocks)).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "v")
    right = rows.where(is_query).select(
        dim, F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"),
        F.pmod(place, F.lit(query_blocks)).cast("int").alias("qb"), "vec_id", "v")
    keys = ("dim", "rb", "qb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def block(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors as a matrix."""
    ids = t.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = t.column("v").combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0)
    matrix = values.reshape(len(ids), -1) if values.size else np.zeros((len(ids), 0))
    return ids[order], matrix[order]


def best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of all blocks' rows (query_id, vec_id, score)."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
