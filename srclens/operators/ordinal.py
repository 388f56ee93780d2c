"""The place of every file in the input: a running number without a single task that sorts.

Keys are cut by range, sorted within each part and numbered there; a part's files
come after as many as all parts before it hold.  Only these counts, one per part,
pass the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.session import shared_folder

_WITHIN = (1 << 33) - 1  # the lower bits of a running id count rows within a part


def ordinals(rows: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``ordinal``, from 1, in the given order (nulls first).

    Written to the shared folder once, so that sampling the ranges again cannot move
    a row; rows equal in ``order`` get neighbouring numbers.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    where = shared_folder(spark)
    placed.write.parquet(where)
    stored = spark.read.schema(placed.schema).parquet(where)
    part = F.shiftright("_at", 33)
    counts = {r["part"]: r["count"] for r in stored.groupBy(part.alias("part")).count().collect()}
    many = [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]
    before = F.lit([0, *accumulate(many)][:-1] or [0]).cast("array<long>")  # one number per part
    ordinal = F.get(before, part.cast("int")) + F.col("_at").bitwiseAND(F.lit(_WITHIN)) + 1
    return stored.withColumn("ordinal", ordinal).drop("_at")


def with_ordinal(files: DataFrame, *order: Column | str, key: str = "file_id") -> DataFrame:
    """``files`` with ``ordinal``: their place by ``order``, or by ``key`` alone.

    Only keys and what orders them are sorted; the numbers are joined to the files.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = files.select(F.col(key), *[c.alias(f"_by_{i}") for i, c in enumerate(columns)])
    numbered = ordinals(keys, *[f"_by_{i}" for i in range(len(columns))], key).select(key, "ordinal")
    return files.join(numbered, key)
