"""Exact top-k search with a bit-sliced index.

Each attribute of a block of rows is a stack of bitmaps, one per binary digit.
A query's weighted sum is computed for all rows at once by adding shifted stacks
with carry-save adders on bitmaps; the k best rows are read off the sum's slices
from the most significant one downward, and rows that tie at the boundary are
resolved by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import table
from srclens.llm.vectors import best, block, grid, usable

SCALE = 1024
TOP = 10
EVERY = 100
LONG = 2**63 - 1


def quantised(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as integers: longs, or Python's where one would not fit."""
    with np.errstate(over="ignore"):
        found = np.floor(v * scale)
    if np.abs(found).max(initial=0) < 2.0**61:
        return found.astype(np.int64)
    whole = [int(f) if np.isfinite(f) else int(x) * scale for f, x in zip(found.ravel().tolist(), v.ravel().tolist())]
    return np.array(whole, object).reshape(v.shape)


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans -> rows of 64-bit words, the first row in the lowest bit."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    padded = np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, -packed.shape[-1] % 8)])
    return np.ascontiguousarray(padded).view(np.uint64)


class Index:
    """Slices of a block: for each attribute and digit a bitmap and its complement."""

    def __init__(self, x: np.ndarray) -> None:
        self.n, self.dim = x.shape
        self.digits = max(1, int(np.abs(x).max(initial=0)).bit_length() + 1)
        self.offset = 1 << (self.digits - 1)
        shifted = (x + self.offset).T  # never negative
        parts = [((shifted >> d) & (1 << 60) - 1).astype(np.int64) for d in range(0, self.digits, 60)]
        slices = np.stack([_bitmap((parts[d // 60] >> d % 60) & 1) for d in range(self.digits)], axis=1)
        self.slices = np.stack([slices, ~slices])  # sign, attribute, digit, word
        self.all = _bitmap(np.ones(self.n, np.uint8))

    def sums(self, q: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of a non-negative sum for each row, and what to subtract to get the score."""
        size, sign = np.abs(q), (q < 0).astype(np.intp)
        width = int(size.max(initial=0)).bit_length()
        chosen = [np.flatnonzero((size >> j) & 1) for j in range(width)]
        out, carried = [], []
        w = 0
        while w < width + self.digits - 1 or carried:
            parts = [self.slices[sign[chosen[j]], chosen[j], w - j]
                     for j in range(max(0, w - self.digits + 1), min(width, w + 1))]
            x = np.concatenate(parts + carried) if parts or carried else np.zeros((0, len(self.all)), np.uint64)
            carried = []
            while len(x) > 1:
                m = len(x) // 3
                if m:  # full adders: three bitmaps of this weight -> one, and one of the next
                    a, b, c = x[:m], x[m:2 * m], x[2 * m:3 * m]
                    half = a ^ b
                    carried.append((a & b) | (c & half))
                    x = np.concatenate([half ^ c, x[3 * m:]])
                else:
                    carried.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
            out.append(x[0] if len(x) else np.zeros_like(self.all))
            w += 1
        over = (1 << self.digits) - 1 - self.offset
        less = sum(size[q >= 0].tolist()) * self.offset + sum(size[q < 0].tolist()) * over
        return np.array(out).reshape(-1, len(self.all)), less

    def top(self, q: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, list[int]]:
        """Places and scores of the k best rows, one place left out; ties go to the first place."""
        slices, less = self.sums(q)
        sure, open_ = np.zeros_like(self.all), self.all.copy()
        if without is not None:
            open_[without // 64] &= ~np.uint64(1 << (without % 64))
        for s in slices[::-1]:
            ones = open_ & s
            more = int(np.bitwise_count(sure | ones).sum())
            if more <= k:
                sure, open_ = sure | ones, open_ & ~s
                if more == k:
                    open_ = np.zeros_like(open_)
                    break
            else:
                open_ = ones
        places = self._places(sure)
        places = np.concatenate([places, self._places(open_)[:max(0, k - len(places))]])
        word, bit = places // 64, (places % 64).astype(np.uint64)
        total = [0] * len(places)
        for d, s in enumerate(slices):
            for i, one in enumerate(((s[word] >> bit) & np.uint64(1)).tolist()):
                total[i] += one << d
        return places, [t - less for t in total]

    def _places(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(rows: pa.Table, queries: pa.Table, k: int, scale: int) -> pa.Table:
    """The k best rows of one block for each query of one block; a score below all longs is null."""
    ids, v = block(rows)
    asked, w = block(queries)
    out: list[tuple] = []
    if len(ids) and len(asked):
        index = Index(quantised(v, scale))
        at = np.searchsorted(ids, asked)
        for i, q in enumerate(quantised(w, scale)):
            own = int(at[i]) if at[i] < len(ids) and ids[at[i]] == asked[i] else None
            places, scores = index.top(q, k, own)
            if max(scores, default=0) > LONG:
                raise OverflowError(f"score {max(scores)} of query {asked[i]} does not fit a long")
            out += [(int(asked[i]), int(ids[p]), s if s >= -LONG - 1 else None) for p, s in zip(places, scores)]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = EVERY, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """Query_id, rank, vec_id, score of each query's k largest integer inner products.

    Rows whose id is divisible by ``every`` are queries; candidates are all other
    rows of the same dimension.  Vectors null or holding null or non-finite
    components take no part; rows with one id count once (``vectors.usable``);
    a score among the k largest that does not fit a long is an error.  No rows: no
    result rows.
    """
    found = grid(usable(vectors), every).applyInArrow(
        lambda rows, queries: search_block(rows, queries, k, scale), "query_id long, vec_id long, score long")
    low = F.raise_error(F.lit("a score does not fit a long")).cast("long")  # nulls are last: no better rows
    return best(found, k).withColumn("score", F.coalesce("score", low))


def op4_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_bit_sliced_top_k": op4_bit_sliced_top_k}

ORACLES = {"op4_bit_sliced_top_k": f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % {EVERY} = 0
), r AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""}
