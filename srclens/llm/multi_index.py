"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are halved; each half has a codebook of its own, and a cell is a pair
of codewords.  A vector is filed in the cell of its two nearest codewords and
visits further cells in the order of how far beyond their borders it lies, a
multi-sequence traversal of the product grid that ends when the target recall is
reached.  All pairs that meet in a cell are verified in double precision, in
tiles; only counts and the least linked vector of each row leave a tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import table, written
from srclens.llm.components import components

LEAST = 0.98
RECALL = 1 - 1e-6
SAMPLE_PER_CODEWORD = 64  # rows that the codebooks are fitted on, of a sample taken by a hash
ROWS_PER_CELL = 512
MOST_CODEWORDS = 1024
BLOCK = 4096  # rows of a cell on each side of a task
TILE = 512
STEPS = 10
SLACK = 1e-9  # cosines this near to the limit are computed again as the plain sum


def reach(dims: int, least: float, recall: float) -> float:
    """How far beyond a cell's border a vector looks for its partners.

    Partners are at most r = sqrt(2 - 2 least) apart.  With recall 1 that is the
    reach, and no pair is missed.  Else the displacement of a partner is taken to have
    no preferred direction: along one direction its deviation is r / sqrt(dims).
    """
    r = math.sqrt(max(2 - 2 * least, 0)) + 1e-6
    if recall >= 1:
        return r
    return min(r, r / math.sqrt(max(dims, 1)) * NormalDist().inv_cdf(1 - (1 - recall) / 2))


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; divided by the largest component first, so squares stay finite."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ words.T) + (words * words).sum(1)[None, :]


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` codewords of some rows, by Lloyd's steps from evenly spread distinct rows."""
    start = np.unique(x, axis=0)
    rng = np.random.default_rng(len(start))
    words = start[np.sort(rng.permutation(len(start))[:size])]
    for _ in range(STEPS):
        near = _squares(x, words).argmin(1)
        n = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return np.unique(words, axis=0)


def margins(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest codeword, and its squared distance to the border of every other one."""
    d = _squares(x, words)
    near = d.argmin(1)
    apart = np.sqrt(np.maximum(_squares(words, words), 1e-300))
    out = np.maximum(d - d[np.arange(len(x)), near][:, None], 0) / (2 * apart[near])
    out[np.arange(len(x)), near] = 0
    return near, out * out


class Codebooks:
    """The codebooks of both halves for vectors of one dimension."""

    def __init__(self, v: np.ndarray, size: int) -> None:
        v, self.half = unit(v), v.shape[1] // 2
        self.words = codebook(v[:, :self.half], size), codebook(v[:, self.half:], size)

    def cells(self, v: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, and (row, cell) of the later cells it visits.

        The traversal walks both lists of borders in ascending order; a cell is
        visited while the sum of its two squared distances is within ``far``.  Of two
        cells that a pair lies in only the earlier one's row visits, so no pair meets twice.
        """
        v = unit(v)
        near, left = margins(v[:, :self.half], self.words[0])
        near2, right = margins(v[:, self.half:], self.words[1])
        width = len(self.words[1])
        own = near * width + near2
        a, b = np.argsort(left, axis=1, kind="stable"), np.argsort(right, axis=1, kind="stable")
        left, right = np.take_along_axis(left, a, 1), np.take_along_axis(right, b, 1)
        rows, cells = [], []
        for s in range(left.shape[1]):
            rest = far * far - left[:, s]
            live = np.flatnonzero(rest >= 0)
            if not len(live):
                break
            n = (right[live] <= rest[live, None]).sum(1)
            row = np.repeat(live, n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            cell = a[row, s] * width + b[row, place]
            later = cell > own[row]
            rows.append(row[later])
            cells.append(cell[later])
        return own, np.concatenate(rows or [own[:0]]), np.concatenate(cells or [own[:0]])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v), one row per id: label and v are null where the vector links with nothing."""
    v = F.col("embedding").cast("array<double>")
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & v.isNotNull() & whole & (squares > 0) & (squares < float("inf"))
    return (vectors.where(F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id"))
            .agg(F.min(F.when(good, F.struct(F.col("label").alias("label"), v.alias("v")))).alias("x"))
            .select("vec_id", "x.label", "x.v"))


def _fit(texts: DataFrame, n: int) -> dict[int, Codebooks]:
    """Codebooks by dimension, from a sample of at most some 130,000 rows in expectation."""
    size = min(max(math.ceil(math.sqrt(n / ROWS_PER_CELL)), 1), MOST_CODEWORDS)
    every = max(n // (SAMPLE_PER_CODEWORD * size), 1)
    sample = texts.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("rep", "v").orderBy("rep").toArrow()
    lengths = sample.column("v").combine_chunks().value_lengths().to_numpy()
    return {int(d): Codebooks(_matrix(sample.column("v").filter(pa.array(lengths == d))), size)
            for d in np.unique(lengths) if d > 1}


def _filed(texts: DataFrame, books: dict[int, Codebooks], least: float, recall: float, vectors: bool) -> DataFrame:
    """A row for each vector in its own cell and in each further cell it visits.

    Vectors of a dimension outside the sample share one cell.
    """
    fields = [f for f in ("rep", "label", "v", "copies") if vectors or f in ("rep", "label")]
    kinds = dict(texts.dtypes)
    schema = ", ".join(f"{f} {kinds[f]}" for f in fields) + ", dim int, cell long, own boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column("v").value_lengths().to_numpy()
            for d in np.unique(lengths):
                batch = whole.filter(pa.array(lengths == d))
                for start in range(0, len(batch), 2048):
                    part = batch.slice(start, 2048)
                    own, row, cell = np.zeros(len(part), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if d in books:
                        own, row, cell = books[d].cells(_matrix(part.column("v")), reach(int(d), least, recall))
                    take = pa.array(np.concatenate([np.arange(len(part)), row]))
                    columns = [part.column(f).take(take) for f in fields]
                    columns += [pa.array(np.full(len(take), d, np.int32)), pa.array(np.concatenate([own, cell])),
                                pa.array(np.arange(len(take)) < len(part))]
                    yield pa.RecordBatch.from_arrays(columns, [*fields, "dim", "cell", "own"])

    return texts.select(*{f: 0 for f in [*fields, "v"]}).mapInArrow(run, schema)


def _large(filed: DataFrame) -> DataFrame:
    """Cells with more than a block of own or visiting rows: how many blocks of each they need."""
    n, m = F.count_if("own"), F.count_if(~F.col("own"))
    need = lambda rows: F.greatest(F.ceil(rows / BLOCK).cast("int"), F.lit(1))
    return filed.groupBy("label", "dim", "cell").agg(n.alias("n"), m.alias("m")).where(
        (F.col("n") > BLOCK) | (F.col("m") > BLOCK)).select(
        "label", "dim", "cell", need(F.col("n")).alias("p"), need(F.col("m")).alias("q"))


def _tasks(filed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of each cell dealt to pairs of blocks: own rows against own and visiting rows.

    ``sizes`` names the blocks of cells that hold more than a block of rows.
    """
    x = filed.join(sizes, ["label", "dim", "cell"], "left").withColumns({
        "p": F.coalesce("p", F.lit(1)), "q": F.coalesce("q", F.lit(1))})
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("p")).otherwise(F.col("q"))).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda t: F.struct(
        F.least("block", t).alias("i"), F.greatest("block", t).alias("j"), (F.col("block") <= t).alias("is_left")))
    # The first block of visiting rows meets own block i in task (i, i), later ones in (i, p + c - 1).
    visiting = F.when(F.col("q") > 1, F.transform(F.sequence(F.lit(1), F.col("q") - 1), lambda c: F.struct(
        F.col("block").alias("i"), (F.col("p") + c - 1).cast("int").alias("j"), F.lit(True).alias("is_left"))))
    visits = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(
        i.alias("i"), F.when(F.col("block") == 0, i).otherwise(F.col("p") + F.col("block") - 1).cast("int").alias("j"),
        F.lit(False).alias("is_left")))
    at = F.when(F.col("own"), F.concat(other, F.coalesce(visiting, F.array().cast(
        "array<struct<i:int,j:int,is_left:boolean>>")))).otherwise(visits)
    return (x.withColumn("block", block).withColumn("at", F.explode(at))
            .select("label", "dim", "cell", "at.i", "at.j", "at.is_left", "own", "rep", "copies", "v"))


class Links:
    """Counts of links and the least vector each row is connected to, tile by tile."""

    def __init__(self, t: pa.Table, least: float) -> None:
        self.rep, self.copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        self.v, self.least = _matrix(t.column("v")), least
        self.unit = unit(self.v)
        total = np.zeros(len(self.v))
        for d in range(self.v.shape[1]):
            total += self.v[:, d] * self.v[:, d]
        self.length = np.sqrt(total)
        self.links, self.root = np.zeros(len(self.v), np.int64), np.arange(len(self.v))

    def _tile(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        near = self.unit[rows] @ self.unit[others].T
        out = near >= self.least
        i, j = np.nonzero(np.abs(near - self.least) <= SLACK)
        total = np.zeros(len(i))
        for d in range(self.v.shape[1]):
            total += self.v[rows[i], d] * self.v[others[j], d]
        out[i, j] = total / (self.length[rows[i]] * self.length[others[j]]) >= self.least
        return out & (self.rep[rows][:, None] != self.rep[others][None, :])

    def _find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if np.array_equal(up, x):
                return x
            x = up

    def _hook(self, linked: np.ndarray, rows: np.ndarray, others: np.ndarray) -> None:
        """Join the components of all links of a tile: each round hooks the greater root to the least one seen."""
        some = np.flatnonzero(linked.any(1))
        linked, rows = linked[some], rows[some]
        while len(rows):
            a, b = self._find(rows), self._find(others)
            low = np.minimum(np.where(linked, b[None, :], len(self.root)).min(1), a)
            before = self.root.copy()
            np.minimum.at(self.root, a, low)
            back = np.where(linked, low[:, None], len(self.root)).min(0)
            np.minimum.at(self.root, b, np.minimum(back, b))
            if np.array_equal(before, self.root):
                return

    def compare(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Verify all pairs of two sets of rows, or within one."""
        for s in range(0, len(left), TILE):
            for t in range(s if same else 0, len(right), TILE):
                rows, others = left[s:s + TILE], right[t:t + TILE]
                linked = self._tile(rows, others)
                if not linked.any():
                    continue
                self.links[rows] += linked @ self.copies[others]
                if not same or s != t:
                    self.links[others] += self.copies[rows] @ linked
                self._hook(linked, rows, others)

    def result(self) -> pa.Table:
        has = np.flatnonzero(self.links > 0)
        low = self.rep[self._find(has)]
        return pa.table([pa.array(self.rep[has]), pa.array(low), pa.array(self.links[has])], names=["rep", "low", "links"])


def near_duplicates(vectors: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector (vec_id, embedding, label).

    Linked are vectors of one label and dimension whose cosine is at least ``least``.
    Null labels, and vectors null, empty, zero, holding null or non-finite components
    or whose squares sum to zero or infinity, link with nothing.  Rows that share an id
    count once, with their smallest usable (label, vector); rows without an id are left
    out; other columns are not read; no rows give no rows.  Equal vectors are compared
    once and counted as often as they occur.  Links found are verified in double
    precision; see ``reach`` for which pairs are looked at.
    """
    rows = written(usable(vectors))
    good = rows.where(F.col("v").isNotNull())
    texts = written(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    books = _fit(texts, texts.count())
    sizes = written(_large(_filed(texts, books, least, recall, vectors=False)))

    def verify(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[3].as_py(), key[4].as_py()
        t = t.sort_by([("rep", "ascending")])
        side = t.column("is_left").to_numpy()
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        links = Links(t, least)
        if i == j:
            links.compare(left, left, same=True)
        links.compare(left, right, same=False)
        return links.result()

    found = written(_tasks(_filed(texts, books, least, recall, vectors=True), sizes)
                    .groupBy("label", "dim", "cell", "i", "j").applyInArrow(verify, "rep long, low long, links long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # Members of a class of equal vectors reach what their representative reaches.
    root = components(found.select("rep", "low")).select(F.col("node").alias("rep"), "component")
    classes = texts.join(links, "rep", "left").join(root, "rep", "left").select(
        "label", "v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    member = good.join(classes, ["label", "v"]).select(
        "vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(F.col("v").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op12_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_inverted_multi_index": op12_inverted_multi_index}

ORACLES = {"op12_inverted_multi_index": f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, w, sqrt(list_inner_product(w, w)) AS length
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS w FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    WHERE list_inner_product(w, w) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.w) = len(b.w) AND list_inner_product(a.w, b.w) / (a.length * b.length) >= {LEAST}
), reached AS (
    SELECT vec_id, vec_id AS root FROM embeddings
    UNION
    SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.vec_id
), least AS (
    SELECT vec_id, min(root) AS component_id FROM reached GROUP BY vec_id
), counted AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT least.vec_id, coalesce(n, 0) AS n_links, component_id, least.vec_id = component_id AS kept
FROM least LEFT JOIN counted ON a = least.vec_id
"""}
