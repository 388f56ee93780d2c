"""Bit-sliced index and block join against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from srclens.llm import bit_sliced, block_join, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, v string"
NAN, INF = float("nan"), float("inf")


def rows_of(seed, n, dim=6, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if levels:
        x = (np.round(x * levels) / levels).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0, 0.5, 1, "x") for i, v in enumerate(x)]
    odd = [(n, None), (n + 1, [NAN] * dim), (n + 2, [INF] + [0.0] * (dim - 1)), (n + 3, [None] * dim),
           (n + 4, [0.0] * dim), (None, [1.0] * dim), (n + 6, rows[0][1]), (n + 7, rows[0][1])]
    return rows + [(i, v, 0, 0.5, 1, "x") for i, v in odd] + [rows[1]]


def clean(rows, zero):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v)):
            out[i] = v
    return out


def brute(rows, every, k, measure, zero):
    known, out = clean(rows, zero), []
    for q in sorted(x for x in known if x % every == 0):
        scored = sorted((-measure(known[q], v), c) for c, v in known.items() if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return out


def inner(a, b):
    return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b))


def dot(x, y):
    total = 0.0
    for p, q in zip(x, y):  # plain sums: sum() compensates
        total += p * q
    return total


def cosine(a, b):
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def got(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("levels", [None, 1])
def test_bit_sliced(spark, monkeypatch, levels):
    monkeypatch.setattr(vectors, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 10)
    rows = rows_of(1, 300, levels=levels)
    assert got(bit_sliced.top_k(spark.createDataFrame(rows, SCHEMA), 10)) == brute(rows, 10, 10, inner, True)


@pytest.mark.parametrize("large", [20000.5, 1e15, 3e30])
def test_bit_sliced_large_components(spark, large):
    """Components are not held at a limit; scores that no query returns may exceed a long."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in v], 0, 0.5, 1, "x") for i, v in enumerate(rng.normal(size=(60, 4)))]
    for i in range(0, 60, 10):  # most queries do not see the large component
        rows[i][1][3] = 0.0
    for i, x in ((3, large), (4, large), (5, 0.9 * large), (7, -17000.0), (8, -30000.0), (10, -0.5)):
        rows[i][1][3] = float(np.float32(x))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(bit_sliced.top_k(df, 10)) == brute(rows, 10, 10, inner, True)


def test_bit_sliced_score_beyond_a_long(spark):
    for other in (1e15, -1e15):
        rows = [(0, [1e15], 0, 0.5, 1, "x"), (7, [other], 0, 0.5, 1, "x")]
        with pytest.raises(Exception, match="not fit a long"):
            bit_sliced.top_k(spark.createDataFrame(rows, SCHEMA), 10).collect()


@pytest.mark.parametrize("levels", [None, 1])
def test_block_join(spark, monkeypatch, levels):
    monkeypatch.setattr(vectors, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 10)
    rows = rows_of(2, 300, levels=levels)
    assert got(block_join.nearest(spark.createDataFrame(rows, SCHEMA), 10)) == brute(rows, 10, 5, cosine, False)


@pytest.mark.parametrize("search", [bit_sliced.top_k, block_join.nearest])
def test_few_and_no_rows(spark, search):
    assert got(search(spark.createDataFrame([], SCHEMA))) == []
    one = [(0, [1.0, 2.0], 0, 0.5, 1, "x")]
    assert got(search(spark.createDataFrame(one, SCHEMA))) == []
    found = got(search(spark.createDataFrame([*one, (7, [1.0, 2.0], 0, 0.5, 1, "x"), (8, [1.0], 0, 0.5, 1, "x")], SCHEMA)))
    assert [r[:3] for r in found] == [(0, 1, 7)]


def test_index_sums():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-2000, 2000, (130, 9)), rng.integers(-700, 700, 9)
    slices, less = bit_sliced.Index(x).sums(q)
    bits = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
    assert ((bits << np.arange(len(bits))[:, None]).sum(0) - less).tolist() == (x @ q).tolist()


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 1500)), rng.normal(size=(40, 1500))
    left, right = block_join.Quantised(a), block_join.Quantised(b)
    near = left.tile(slice(0, 50), right)
    true = (b / np.linalg.norm(b, axis=1)[:, None]) @ (a / np.linalg.norm(a, axis=1)[:, None]).T
    slack = right.error[:, None] + right.size[:, None] * left.error[None] + block_join.SLACK
    assert (np.abs(near - true) <= slack).all()
