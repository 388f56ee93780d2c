"""Near-duplicate vectors by the inverted multi-index against brute force."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from srclens.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, copies long, rep string, v int, cell long, own string, p int"
NAN, INF = float("nan"), float("inf")


def near_rows(seed, n=400, dim=16, labels=3):
    """Random vectors, noisy copies just above and below the limit, chains, exact and scaled copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dim))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, .02, .05, .1, .15, .2, .3)] + [base * 3])
    x = np.concatenate([x, np.repeat(base[:1], 40, axis=0), base[:1] + rng.normal(size=(60, dim)) * .08]).astype(np.float32)
    group = np.concatenate([np.tile(rng.integers(0, labels, len(base)), 8), np.repeat(0, 100)])
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), [float(c) for c in v], int(g)) for i, v, g in zip(ids, x, group)]
    top = max(ids) + 1
    odd = [None, [], [NAN] * dim, [INF] + [0.0] * (dim - 1), [None] * dim, [0.0] * dim, [1.0], [2.0], [1.0, 0.0], [3e38] * dim]
    rows += [(int(top + k), v, 0) for k, v in enumerate(odd)]
    rows += [(int(top + 100), rows[0][1], None), (None, rows[0][1], 0), rows[3], (rows[4][0], None, 0), (rows[5][0], rows[5][1], None)]
    return [(*r, 7, "x", 1, 2, "y", 3) for r in rows]


def brute(rows, least):
    known, ids = {}, set()
    for i, v, label, *_ in rows:
        if i is None:
            continue
        ids.add(i)
        if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            known[i] = min(known.get(i, (label, v)), (label, v))
    names = sorted(known)
    linked = {i: set() for i in ids}
    for p, a in enumerate(names):
        for b in names[p + 1:]:
            (la, x), (lb, y) = known[a], known[b]
            if la == lb and len(x) == len(y):
                x, y = np.array(x), np.array(y)
                if (x @ y) / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= least:
                    linked[a].add(b)
                    linked[b].add(a)
    root, out = {}, []
    for i in sorted(ids):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += linked[j]
        out.append((i, len(linked[i]), root[i], root[i] == i))
    return out


def got(df):
    return [tuple(r) for r in df.orderBy("vec_id").collect()]


@pytest.mark.parametrize("recall", [1, multi_index.RECALL])
def test_against_brute_force(spark, monkeypatch, recall):
    monkeypatch.setattr(multi_index, "ROWS_PER_CELL", 4)
    rows = near_rows(1)
    assert got(multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=recall)) == brute(rows, 0.98)


@pytest.mark.parametrize("per_cell", [20, 10_000])
def test_hot_cells_in_small_blocks(spark, monkeypatch, per_cell):
    monkeypatch.setattr(multi_index, "ROWS_PER_CELL", per_cell)
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    rows = near_rows(2, labels=1)
    largest, dealt = [], multi_index._tasks

    def counted(*args):
        out = dealt(*args)
        largest.append(out.groupBy("label", "dim", "cell", "i", "j").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(multi_index, "_tasks", counted)
    assert got(multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 0.98)
    assert largest[0] <= 4 * 16  # two blocks, dealt by a hash


def test_tiles(monkeypatch):
    monkeypatch.setattr(multi_index, "TILE", 5)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 4))[rng.integers(0, 30, 90)] + rng.normal(size=(90, 4)) * .12
    t = pa.table({"rep": np.arange(90) * 2, "copies": rng.integers(1, 4, 90), "v": x.tolist()})
    links = multi_index.Links(t, 0.98)
    left, right = np.arange(50), np.arange(50, 90)
    links.compare(left, left, same=True)
    links.compare(left, right, same=False)
    near = multi_index.unit(x) @ multi_index.unit(x).T >= 0.98
    near[50:, 50:] = False
    np.fill_diagonal(near, False)
    assert links.links.tolist() == (near @ links.copies).tolist()
    root = np.arange(90)
    for _ in range(90):
        root = np.minimum(root, np.where(near, root[None, :], 90).min(1))
    has = near.any(1)
    assert (links._find(np.arange(90))[has] == root[has]).all() and links.result().num_rows == has.sum()


@pytest.mark.parametrize("least", [0.5, 0.9, -1.0])
def test_other_limits(spark, monkeypatch, least):
    monkeypatch.setattr(multi_index, "ROWS_PER_CELL", 8)
    rows = near_rows(3, n=160)
    assert got(multi_index.near_duplicates(spark.createDataFrame(rows, SCHEMA), least, 1)) == brute(rows, least)


def test_few_and_no_rows(spark):
    assert got(multi_index.near_duplicates(spark.createDataFrame([], SCHEMA))) == []
    one = spark.createDataFrame([(5, [1.0, 2.0], 1, 1, "", 1, 1, "", 1)], SCHEMA)
    assert got(multi_index.near_duplicates(one)) == [(5, 0, 5, True)]
    nothing = spark.createDataFrame([(5, None, 1, 1, "", 1, 1, "", 1), (6, [1.0], None, 1, "", 1, 1, "", 1)], SCHEMA)
    assert got(multi_index.near_duplicates(nothing)) == [(5, 0, 5, True), (6, 0, 6, True)]


def test_visits_ascend_and_recall_one_misses_nothing():
    """Partners at the very limit, in any direction: a visit from the earlier cell reaches every one."""
    rng = np.random.default_rng(4)
    x = multi_index.unit(rng.normal(size=(500, 8)))
    books = multi_index.Codebooks(x, 12)
    y = x + rng.normal(size=x.shape) * 0.1
    keep = (multi_index.unit(y) * x).sum(1) >= 0.98
    x, y = x[keep], multi_index.unit(y[keep])
    far = multi_index.reach(8, 0.98, 1)
    own, row, cell = books.cells(x, far)
    own_y, row_y, cell_y = books.cells(y, far)
    met = own == own_y
    met[row[cell == own_y[row]]] = True
    met[row_y[cell_y == own[row_y]]] = True
    assert keep.sum() > 100 and met.all()
    few = books.cells(x, multi_index.reach(8, 0.98, 0.9))
    assert 0 < len(few[1]) < len(row)
