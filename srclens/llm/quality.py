"""Quality classifier: a regularised quadratic discriminant.

Each text gives a row of counts (bytes of each kind, words, word lengths,
repeated neighbours).  Shares of those, drawn towards the corpus mean for short
texts, on a logit scale are the features.  Class means and covariances are sums
over all labelled training rows, so only moments reach the driver; each class
covariance is shrunk towards the pooled one and that towards a multiple of the
identity.  The score compares the Mahalanobis log-densities of the two classes,
computed with the inverse Cholesky factors kept in the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import Words, bounded_batches, fold, groups, table, text_bytes, written

KINDS = ("lower", "upper", "digit", "blank", "newline", "stop", "call", "bar", "symbol")
COUNTS = ("n_bytes", *KINDS, "words", "letters2", "repeats", "near_repeats", "lines", "line_repeats")
PULL = 60.0  # a text counts as if it had so many more bytes (or words) of the mean kind
TO_POOLED, TO_SPHERE = 0.05, 0.05  # fewest errors on the training rows
FOLDS, HELD_OUT = 3, 1


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("symbol"), np.uint8)
    kind[128:] = KINDS.index("lower")  # letters beyond ASCII
    for name, chars in (("blank", " \t\v\f\r"), ("newline", "\n"), ("stop", ".,;:'\"-()"), ("call", "!?"),
                        ("bar", "|"), ("digit", "0123456789")):
        kind[[ord(c) for c in chars]] = KINDS.index(name)
    kind[ord("a"):ord("z") + 1] = KINDS.index("lower")
    kind[ord("A"):ord("Z") + 1] = KINDS.index("upper")
    return kind


KIND = _kinds()


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``COUNTS`` for each text; an empty text is all zeros."""
    parts = [_counts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in groups(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, width = len(offsets) - 1, len(KINDS)
    sizes = np.diff(offsets)
    key = np.repeat(np.arange(0, n * width, width), sizes) + KIND[data]
    kinds = np.bincount(key, minlength=n * width).reshape(n, width)
    w = Words(data, offsets)
    of = np.repeat(np.arange(n), w.counts)

    def per_text(values, texts=of):
        return np.bincount(texts, values, n).astype(np.int64)

    def equal(lag, h=w.hashes, texts=of):
        out = np.zeros(len(h))
        out[lag:] = (h[lag:] == h[:-lag]) & (texts[lag:] == texts[:-lag])
        return out

    long_words = (w.ends - w.starts).astype(float)
    lines = Lines(data, offsets)
    return np.column_stack([
        sizes, kinds, w.counts, per_text(long_words**2), per_text(equal(1)),
        per_text(np.maximum(equal(2), equal(3))), lines.counts,
        per_text(equal(1, lines.hashes, lines.of), lines.of)])


class Lines:
    """Sentences and lines: pieces between line feeds or full stops, hashed whole."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        from srclens.llm.common import prefix_sums, substrings
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = (data == ord("\n")) | (data == ord("."))
        stops = np.unique(np.concatenate([np.flatnonzero(cut) + 1, offsets]))
        starts, ends = stops[:-1], stops[1:]
        lead = np.zeros(len(starts), np.int64)
        if len(starts):  # a blank after the last stop does not count
            lead = ((data[starts] == 32) | (data[starts] == 10)) & (ends - starts > 1)
        starts = starts + lead
        keep = ends - starts > 1
        self.hashes = substrings(prefix_sums(data), starts[keep], ends[keep])
        self.of = np.searchsorted(offsets, starts[keep], "right") - 1
        self.counts = np.bincount(self.of, minlength=len(offsets) - 1)


#: (count, of what) pairs whose shares are features.
SHARES = (*((k, "n_bytes") for k in KINDS), ("words", "n_bytes"), ("repeats", "words"), ("near_repeats", "words"),
          ("line_repeats", "lines"))
N_FEATURES = len(SHARES) + 2


def features(c: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Transformed statistics of rows of counts; ``mean``: the corpus shares of ``SHARES``, and of letters2."""
    c = c.astype(float)
    col = {name: c[:, i] for i, name in enumerate(COUNTS)}
    out = []
    for (name, of), m in zip(SHARES, mean):
        p = (col[name] + PULL * m) / (col[of] + PULL)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        out.append(np.log(p / (1 - p)))
    out.append(np.log1p(col["words"]))
    out.append(np.log((col["letters2"] + PULL * mean[-1]) / (col["words"] + PULL)))
    return np.column_stack(out)


def corpus_shares(totals: dict[str, float]) -> np.ndarray:
    """Shares over all documents, kept off zero."""
    out = [(totals[a] + 1) / (totals[b] + 1000) for a, b in SHARES]
    return np.array([*np.minimum(out, 0.99), (totals["letters2"] + 25_000) / (totals["words"] + 1000)])


@dataclass
class Model:
    mean: np.ndarray  # corpus shares
    centres: np.ndarray  # class, feature
    factors: np.ndarray  # class, inverse Cholesky factor
    offsets: np.ndarray  # class, log prior - log determinant / 2

    def score(self, c: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of counts."""
        x = features(c, self.mean)
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1)
                   for m, f, o in zip(self.centres, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(mean: np.ndarray, n: np.ndarray, sums: np.ndarray, products: np.ndarray,
        to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Model:
    """The model from the moments of two classes; a class without rows equals the pooled one."""
    d, total = sums.shape[1], n.sum()
    if not total:
        eye = np.eye(d)
        return Model(mean, np.zeros((2, d)), np.stack([eye, eye]), np.zeros(2))
    centre = sums.sum(0) / total
    centres = np.stack([s / k if k else centre for s, k in zip(sums, n)])
    scatter = [p - k * np.outer(m, m) for p, k, m in zip(products, n, centres)]
    pooled = sum(scatter) / max(total - 2, 1)
    out = []
    for k, s in zip(n, scatter):
        own = s / (k - 1) if k > d else pooled
        cov = (1 - to_pooled) * own + to_pooled * pooled
        out.append((1 - to_sphere) * cov + (to_sphere * np.trace(cov) / d + 1e-9) * np.eye(d))
    lower = [np.linalg.cholesky(c) for c in out]
    prior = np.log((n + 1) / (total + 2))
    return Model(mean, centres, np.stack([np.linalg.inv(c) for c in lower]),
                 np.array([p - np.log(np.diag(c)).sum() for p, c in zip(prior, lower)]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = counts(*text_bytes(b.column(1)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c[:, i], pa.int64()) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])


def count_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, counts): a row for each document."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted, schema)


def _moments(mean: np.ndarray) -> Callable:
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and class: rows, sums and products; one row each."""
        n, s, p = np.zeros(2), np.zeros((2, N_FEATURES)), np.zeros((2, N_FEATURES, N_FEATURES))
        for b in batches:
            x = features(np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))]), mean)
            y = b.column(len(COUNTS)).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(0)
                p[k] += own.T @ own
        flat = [np.concatenate([[n[k]], s[k], p[k].ravel()]) for k in (0, 1)]
        size = len(flat[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()),
             pa.array(np.concatenate(flat))], ["y", "place", "value"])
    return moments


def train(counted: DataFrame, labels: DataFrame, label: str = "quality", held_out: Column | None = None) -> Model:
    """Learn from the labelled rows of ``counted`` for which ``held_out`` is not true.

    Labels other than 0 and 1 and null ids take no part; a label repeated for a
    document counts once.  All labelled rows are used; the driver gets two rows
    of moments.  Rows of a fold are decided by the id alone, so labels of held-out
    documents are never read.
    """
    aside = fold(F.col("doc_id"), FOLDS) == HELD_OUT if held_out is None else held_out
    totals = counted.agg(*(F.sum(c).cast("double").alias(c) for c in COUNTS)).first().asDict()
    mean = corpus_shares({k: v or 0.0 for k, v in totals.items()})
    marked = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(~aside).distinct()
    rows = counted.join(marked, "doc_id").select(*COUNTS, "y").mapInArrow(
        _moments(mean), "y int, place int, value double")
    size = 1 + N_FEATURES + N_FEATURES**2
    flat = np.zeros((2, size))
    for r in rows.groupBy("y", "place").agg(F.sum("value").alias("value")).collect():
        flat[r.y, r.place] = r.value
    products = flat[:, 1 + N_FEATURES:].reshape(2, N_FEATURES, N_FEATURES)
    return fit(mean, flat[:, 0], flat[:, 1:1 + N_FEATURES], products)


def score_counts(counted: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of counts."""
    def run(batches):
        for b in batches:
            c = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))])
            s = model.score(c)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return counted.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents predicted to be of class 1, columns unchanged; no shuffle."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = model.score(counts(*text_bytes(b.column(place).cast(pa.string())))) >= 0.5
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = written(count_documents(table(spark, sf_dir, "documents")))
    model = train(counted, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return score_counts(counted, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op6_quadratic_quality": op6_quadratic_quality}
ORACLES: dict[str, str] = {}
