"""Best-fit packing with several capacities.

Pieces of documents are dealt to shards by a hash, so a shard is bounded and no
source or length is hot.  Within a shard pieces go, longest first, to the open
sequence that fits best under every capacity at once: tokens, documents, and
attention cost (the sum of squared lengths).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm import tokens
from srclens.llm.common import bounded_batches, table, text_bytes, written

CONTEXT = 2048
PER_SHARD = 20_000


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, how much each counts, and how a sequence is chosen.

    ``norm`` takes the sequence whose weighted residual is smallest after the piece
    is in; ``dot`` the one whose residual points most in the direction of the piece.
    All three count in the choice by default, but tokens alone bind: a sequence of
    n tokens has at most n documents and costs at most n squared.
    """

    tokens: int = CONTEXT
    documents: int = CONTEXT
    attention: float = float(CONTEXT) ** 2
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def demand(self, lengths: np.ndarray) -> np.ndarray:
        """Demands of pieces as parts of each capacity's unit: tokens, documents, cost."""
        n = lengths.astype(float)
        return np.column_stack([n, np.ones_like(n), n * n])


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; pieces must fit an empty sequence."""
    limit = np.array([cap.tokens, cap.documents, cap.attention], float)
    demand = cap.demand(lengths)
    if len(lengths) and (demand > limit).any():
        raise ValueError("a piece is larger than an empty sequence")
    scale, weight = 1 / limit, np.array(cap.weights)
    order = np.argsort(-lengths, kind="stable")
    least = demand.min(axis=0) if len(lengths) else limit
    left = np.zeros((1024, 3))
    number = np.zeros(1024, np.int64)  # of each open sequence
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = used = 0
    for i in order:
        d = demand[i]
        r = left[:used]
        fits = np.flatnonzero((r[:, 0] >= d[0]) & (r[:, 1] >= d[1]) & (r[:, 2] >= d[2]))
        if len(fits):
            if cap.rule == "dot":
                b = fits[np.argmax((r[fits] * scale * scale) @ (weight * d))]
            else:
                b = fits[np.argmin((((r[fits] - d) * scale) ** 2) @ weight)]
        else:
            if used == len(left):
                left, number = np.concatenate([left, left]), np.concatenate([number, number])
            left[used], number[used] = limit, opened
            b, used, opened = used, used + 1, opened + 1
        sequence[i] = number[b]
        offset[i] = cap.tokens - left[b, 0]
        left[b] -= d
        if (left[b] < least).any():  # full for every piece: its place goes to the last open one
            used -= 1
            left[b], number[b] = left[used], number[used]
    return sequence, offset


def pack(pieces: DataFrame, cap: Capacity = Capacity(), per_shard: int = PER_SHARD) -> DataFrame:
    """``pieces`` (a column ``length`` and any others) with sequence_id and offset.

    Sequences are gapless from offset 0.  Pieces are dealt to shards by a hash of
    the whole row; equal rows meet in one shard and are packed like any others.
    Input columns of the two new names are replaced, any others are kept.
    """
    shards = -(-pieces.count() // per_shard) or 1
    pieces = pieces.drop("sequence_id", "offset")
    # Names of our own inside: the input's may clash or hold dots.
    columns = [f"c{i}" for i in range(len(pieces.columns))]
    length = columns[pieces.columns.index("length")]
    plain = pieces.toDF(*columns)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Not the order the rows came in: the same rows give the same sequences after a retry.
        rows = rows.sort_values(columns, kind="stable", ignore_index=True)
        sequence, offset = best_fit(rows[length].to_numpy(np.int64), cap)
        rows["sequence_id"] = (rows.pop("shard").to_numpy(np.int64) << 32) + sequence
        rows["offset"] = offset
        return rows

    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", sequence_id long, offset long"
    packed = plain.withColumn("shard", F.pmod(F.xxhash64(*columns), F.lit(shards))).groupBy("shard").applyInPandas(run, schema)
    return packed.toDF(*pieces.columns, "sequence_id", "offset")


def cut(docs: DataFrame, longest: int = CONTEXT, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Pieces of at most ``longest`` ids of each document's ids followed by id 0.

    A null text is empty: its only id is 0.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        end = np.zeros(1, "<u4")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, bounds in encode(*text_bytes(batch.column(1))):
                out = []
                for k in range(len(bounds) - 1):
                    own = np.concatenate([ids[bounds[k]:bounds[k + 1]], end]).astype("<u4", copy=False)
                    for p, at in enumerate(range(0, len(own), longest)):
                        part = own[at:at + longest]
                        out.append((keys[first + k], p, at, len(part), zlib.crc32(part)))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def op10_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(cut(table(spark, sf_dir, "documents"))))


QUERIES = {"op10_vector_best_fit": op10_vector_best_fit}
ORACLES: dict[str, str] = {}
