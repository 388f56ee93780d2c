"""Nearest neighbours by a block matrix join.

Vectors are normalised and quantised to int8 with one scale each.  A tile is the
product of two int8 blocks; with the known quantisation errors it bounds every
cosine from both sides.  Pairs whose upper bound does not reach the k-th best
lower bound are dropped for good; the survivors are recomputed in double
precision from the original vectors and kept in a heap per query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import table
from srclens.llm.vectors import best, block, grid, usable

NEAREST = 5
EVERY = 50
TILE = 4096
EXACT_DIMS = 1024  # 1024 products of int8 stay exact in the float32 that the multiplier uses
SLACK = 1e-5  # rounding of the bounds themselves


def _length(v: np.ndarray) -> np.ndarray:
    """Euclidean lengths, summed component by component."""
    total = np.zeros(len(v))
    for d in range(v.shape[1]):
        total += v[:, d] * v[:, d]
    return np.sqrt(total)


class Quantised:
    """int8 codes, a scale per vector, and the lengths of code and error."""

    def __init__(self, v: np.ndarray) -> None:
        # Divided by the largest component first: squares neither overflow nor vanish.
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        self.scale = np.abs(unit).max(axis=1, keepdims=True) / 127
        self.codes = np.rint(unit / self.scale).astype(np.int8)
        coded = self.codes * self.scale
        self.error = np.linalg.norm(unit - coded, axis=1)
        self.size = np.linalg.norm(coded, axis=1)

    def tile(self, rows: slice, other: Quantised) -> np.ndarray:
        """Products of all codes of ``other`` with those of some rows, scaled."""
        out = 0.0
        for d in range(0, self.codes.shape[1], EXACT_DIMS):
            part = slice(d, d + EXACT_DIMS)
            out = out + other.codes[:, part].astype(np.float32) @ self.codes[rows, part].astype(np.float32).T
        return out * (other.scale * self.scale[rows].T)


def search_block(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of one block for each query of one block."""
    ids, v = block(rows)
    asked, w = block(queries)
    heaps: list[list[tuple[float, int]]] = [[] for _ in asked]
    if len(ids) and len(asked):
        left, right = Quantised(v), Quantised(w)
        row_length, query_length = _length(v), _length(w)
        floor = np.full(len(asked), -np.inf)
        for start in range(0, len(ids), TILE):
            rows_here = slice(start, start + TILE)
            near = left.tile(rows_here, right)
            slack = right.error[:, None] + right.size[:, None] * left.error[None, rows_here] + SLACK
            own = asked[:, None] == ids[None, rows_here]
            low = np.where(own, -np.inf, near - slack)
            if low.shape[1] > k:
                floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(~own & (near + slack >= floor[:, None]))
            total = np.zeros(len(i))
            for d in range(v.shape[1]):
                total += w[i, d] * v[start + j, d]
            scores = total / (query_length[i] * row_length[start + j])
            for q, c, s in zip(i.tolist(), ids[start + j].tolist(), scores.tolist()):
                entry = (s, -c)
                if len(heaps[q]) < k:
                    heapq.heappush(heaps[q], entry)
                elif entry > heaps[q][0]:
                    heapq.heapreplace(heaps[q], entry)
    out = [(int(a), -c, s) for a, heap in zip(asked, heaps) for s, c in heap]
    columns = list(zip(*out)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """Query_id, rank, vec_id, score of each query's k largest cosines; exact.

    Rows whose id is divisible by ``every`` are queries; candidates are all other
    rows of the same dimension.  Vectors null, zero or holding null or non-finite
    components take no part, nor do those whose squares sum to zero or infinity in
    double precision; rows with one id count once.  No rows: no result rows.
    """
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = usable(vectors).where((squares > 0) & (squares < float("inf")))
    found = grid(rows, every).applyInArrow(
        lambda r, q: search_block(r, q, k), "query_id long, vec_id long, score double")
    return best(found, k)


def op9_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_block_matrix_join": op9_block_matrix_join}

ORACLES = {"op9_block_matrix_join": f"""
WITH v AS (
    SELECT vec_id, w, sqrt(list_inner_product(w, w)) AS length
    FROM (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    WHERE list_inner_product(w, w) > 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w) / (q.length * c.length) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % {EVERY} = 0
), r AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {NEAREST}
"""}
