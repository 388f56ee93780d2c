"""Language-model scores by context-tree weighting.

A text is its lower-cased words, parted by a blank and ended by a line feed.  Each
byte is eight binary decisions; each decision has a tree of contexts, the bytes
before it, up to ``DEPTH``.  A node estimates its decisions by Krichevsky and
Trofimov's rule, and the prediction mixes the estimates of all depths with the
weights that the training bytes give them.

Blocks of documents ask for the byte strings (context and byte) and words that occur
in them, with their counts; the questions are dealt by a hash of the key, summed up,
and answered, so a task holds the distinct keys of one block or of one part and
never the whole model.  Keys travel as compressed arrays, a row per block and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import Words, bounded_batches, fold, groups, mixed, table, text_bytes, unpacked, written

DEPTH = 5
BLOCK_BYTES = 8 << 20
TREE_ROWS = 100_000
FOLDS, HELD_OUT = 5, 1
END = 10
LN2 = np.log(2.0)

GRAM, WORD, DOCS = 0, 1, 2  # kinds of counted keys


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words parted by a blank and ended by a line feed, and the bounds of each text."""
    w = Words(data, offsets)
    sizes = w.ends - w.starts
    n = len(offsets) - 1
    empty = w.counts == 0
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])[w.bounds] + np.concatenate([[0], np.cumsum(empty)])
    out = np.full(ends[-1], 32, np.uint8)
    before = np.cumsum(np.concatenate([[0], empty]))[:-1]  # lone ends of the texts before
    first = np.cumsum(sizes + 1) - sizes - 1 + np.repeat(before, w.counts)
    shift = np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    source = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - w.starts, sizes)
    out[np.arange(sizes.sum()) + shift] = w.data[source]
    out[ends[1:] - 1] = END
    return out, ends


def grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each byte itself and the ``DEPTH`` bytes before it, as a number; line feeds before a text."""
    n = len(data)
    key = data.astype(np.int64)
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    for d in range(1, DEPTH + 1):
        earlier = np.full(n, END, np.int64)
        earlier[d:] = data[:-d]
        earlier[place < d] = END
        key |= earlier << (8 * d)
    return key


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by Stirling's series beyond 10."""
    x = np.asarray(x, float).copy()
    down = np.zeros_like(x)
    while (low := x < 10).any():
        down[low] -= np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return down + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (
        1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_kt(n: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n[:, 0] zeros and n[:, 1] ones."""
    return log_gamma(n + 0.5).sum(1) - np.log(np.pi) - log_gamma(n.sum(1) + 1)


class Level:
    """The nodes of one depth among some keys: context and decision, with their counts."""

    def __init__(self, ids: np.ndarray, bit: np.ndarray, count: np.ndarray) -> None:
        self.ids, self.of = np.unique(ids, return_inverse=True)
        self.n = np.column_stack([
            np.bincount(self.of, np.where(bit == b, count, 0), len(self.ids)) for b in (0, 1)])
        self.own = log_kt(self.n)
        self.mixed = self.own

    def mix(self, below: np.ndarray) -> None:
        """Weigh the own estimate against the product of the children's, ``below`` in logs."""
        self.mixed = np.logaddexp(self.own, below) - LN2
        self.stay = np.exp(self.own - LN2 - self.mixed)

    def predict(self) -> np.ndarray:
        return (self.n + 0.5) / (self.n.sum(1) + 1)[:, None]


def decisions(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row per key, 8): the decision's node 1..255 and its bit."""
    symbol = (key & 255)[:, None]
    t = np.arange(8)
    return (1 << t) | (symbol >> (8 - t)), (symbol >> (7 - t)) & 1


def levels(key: np.ndarray, count: np.ndarray, top: int) -> dict[int, Level]:
    """Depths ``DEPTH`` to ``top`` of the trees of some keys, mixed from the deepest up.

    All keys of a context of ``top`` bytes must be there.
    """
    node, bit = (x.ravel() for x in decisions(key))
    count = np.repeat(count, 8)
    out: dict[int, Level] = {}
    for d in range(DEPTH, top - 1, -1):
        context = np.repeat((key >> 8) & ((1 << (8 * d)) - 1), 8)
        out[d] = Level((context << 8) | node, bit, count)
        if d < DEPTH:
            deeper = out[d + 1]
            parent = np.zeros(len(deeper.ids), np.int64)
            parent[deeper.of] = out[d].of
            out[d].mix(np.bincount(parent, deeper.mixed, len(out[d].ids)))
    return out


class Top:
    """Depths 1 and 0: at most 256 contexts and one, of 255 decisions each."""

    def __init__(self, rows: list) -> None:
        """``rows``: context of one byte and decision, zeros, ones, ln of the children's product."""
        n, below = np.zeros((256, 256, 2)), np.zeros((256, 256))
        for context, node, zeros, ones, product in rows:
            n[context, node], below[context, node] = (zeros, ones), product
        own = log_kt(n.reshape(-1, 2)).reshape(256, 256)
        mixed = np.logaddexp(own, below) - LN2
        stay = np.exp(own - LN2 - mixed)
        n0 = n.sum(0)
        own0 = log_kt(n0)
        stay0 = np.exp(own0 - LN2 - (np.logaddexp(own0, mixed.sum(0)) - LN2))
        kt0 = (n0 + 0.5) / (n0.sum(1) + 1)[:, None]
        kt1 = (n + 0.5) / (n.sum(2) + 1)[:, :, None]
        #: What depths 0 and 1 say, and the weight left for deeper ones.
        self.said = (stay0[:, None] * kt0)[None] + ((1 - stay0) * stay)[:, :, None] * kt1
        self.left = (1 - stay0) * (1 - stay)


def log10_probability(key: np.ndarray, count: np.ndarray, top: Top) -> np.ndarray:
    """log10 of each byte's probability after its context, with the model frozen."""
    tree = levels(key, count, 2)
    node, bit = decisions(key)
    context = ((key >> 8) & 255)[:, None]
    said, left = top.said[context, node, bit], top.left[context, node]
    for d in range(2, DEPTH + 1):
        level = tree[d]
        p = level.predict()[level.of, bit.ravel()].reshape(bit.shape)
        stay = level.stay[level.of].reshape(bit.shape) if d < DEPTH else 1.0
        said = said + left * stay * p
        left = left * (1 - stay)
    return np.log10(said).sum(1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)),
             pa.array([press(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary())],
            ["block", "doc_id", "trained", "packed"])


def _texts(rows) -> tuple[np.ndarray, np.ndarray]:
    raw = [unpacked(x) for x in rows.column("packed").to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _sum_by(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(of, np.concatenate(counts), len(key)).astype(np.int64)


def _shrunk(values: np.ndarray, rising: bool = False) -> bytes:
    """Values as compressed bytes, of which the like ones stand together; rising: their differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _grown(packed: bytes, dtype, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(unpacked(packed), np.uint8)
    size = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if rising else values


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _asker(parts: int):
    def ask(rows):
        """The distinct keys of a block by part, with their counts in its training documents."""
        data, offsets = _texts(rows)
        trained = rows.column("trained").to_numpy(zero_copy_only=False).astype(bool)
        held = {GRAM: ([], []), WORD: ([], [])}
        for a, b in groups(offsets):
            own, places = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            w = Words(own, places)
            text, bounds = canonical(own, places)
            for kind, key, sizes in ((GRAM, grams(text, bounds), np.diff(bounds)),
                                     (WORD, w.hashes.view(np.int64), w.counts)):
                learnt = np.repeat(trained[a:b], sizes)
                for part, n in ((key[learnt], 1), (key[~learnt], 0)):
                    k, many = np.unique(part, return_counts=True)
                    held[kind][0].append(k)
                    held[kind][1].append(many * n)
        block = rows.column("block")[0].as_py()
        out = [(block, DOCS, 0, _shrunk(np.zeros(1, np.int64), True), _shrunk(np.array([trained.sum()], np.int64)))]
        for kind, found in held.items():
            key, n = _sum_by(*found)
            part = part_of(key, parts)
            order = np.argsort(part, kind="stable")
            key, n = key[order], n[order]
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out += [(block, kind, p, _shrunk(key[x:y], True), _shrunk(n[x:y]))
                    for p, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if y > x]
        kinds = (pa.int32(), pa.int8(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["block", "kind", "part", "keys", "counts"])
    return ask


def _sum_up(rows):
    """All blocks' questions of one kind and part: the distinct keys and their counts."""
    key, n = _sum_by([_grown(k, np.int64, True) for k in rows.column("keys").to_pylist()],
                     [_grown(c, np.int64) for c in rows.column("counts").to_pylist()])
    return pa.table({"kind": np.full(len(key), rows.column("kind")[0].as_py(), np.int8), "key": key, "n": n})


def _answer(asked, values):
    """The values of each block's keys of one part, in the order of the keys."""
    names = ["block", "kind", "keys", "found"]
    out = []
    own = {}
    kind = values.column("kind").to_numpy()
    for k in (GRAM, WORD):
        key, value = (values.column(c).to_numpy()[kind == k] for c in ("key", "value"))
        order = np.argsort(key)
        own[k] = key[order], value[order]
    for block, k, keys in zip(*(asked.column(c).to_pylist() for c in ("block", "kind", "keys"))):
        key, value = own[k]
        out.append((block, k, keys, _shrunk(value[np.searchsorted(key, _grown(keys, np.int64, True))])))
    kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=names)


def _top_rows(batch):
    """Nodes of two context bytes, summed up for each node of one."""
    level = levels(batch.column("key").to_numpy(), batch.column("n").to_numpy(), 2)[2]
    one, of = np.unique(level.ids & 0xFFFF, return_inverse=True)
    return pa.table({
        "context": (one >> 8).astype(np.int32), "node": (one & 255).astype(np.int32),
        **{c: np.bincount(of, v, len(one)) for c, v in zip(("zeros", "ones", "product"), (*level.n.T, level.mixed))}})


def score_texts(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row.

    ``docs``: doc_id, text; the model learns from the rows for which ``train`` is
    true and scores all, in whole.  A null or blank text is its end alone.  The
    base is the word model of add-half counts over the training tokens.
    ``bits_per_byte`` is the code length per byte of the words, parted by blanks, and the end.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("trained"),
        text.cast("binary").alias("text")).mapInArrow(
        _packed, "block int, doc_id long, trained boolean, packed binary")
    asked = written(rows.groupBy("block").applyInArrow(
        _asker(blocks), "block int, kind byte, part int, keys binary, counts binary"))
    counted = written(asked.groupBy("kind", "part").applyInArrow(_sum_up, "kind byte, key long, n long"))

    facts = counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.count("*").alias("all"))
    by_kind = {r.kind: r for r in facts.collect()}
    ends = int(by_kind[DOCS].n) if DOCS in by_kind else 0
    known_words = by_kind.get(WORD)
    tokens = (int(known_words.n) if known_words else 0) + ends
    vocabulary = (int(known_words.v) if known_words else 0) + (ends > 0)

    # Trees of two context bytes each are whole in one part; what is above them is bounded.
    parts = -(-(by_kind[GRAM].all if GRAM in by_kind else 0) // TREE_ROWS) or 1
    two_bytes = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    gram = counted.where(F.col("kind") == GRAM).select("key", "n")
    trees = gram.groupBy(F.pmod(F.xxhash64(two_bytes), F.lit(parts)))
    top = Top([tuple(r) for r in trees.applyInArrow(
        _top_rows, "context int, node int, zeros double, ones double, product double").groupBy("context", "node").agg(
        *(F.sum(c).alias(c) for c in ("zeros", "ones", "product"))).collect()])

    def probabilities(rows):
        key = rows.column("key").to_numpy()
        return pa.table({"kind": np.full(len(key), GRAM, np.int8), "part": part_of(key, blocks), "key": key,
                         "value": log10_probability(key, rows.column("n").to_numpy(), top)})

    def words(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), WORD, np.int8)), pa.array(part_of(key, blocks)), b.column(0), b.column(1)],
                ["kind", "part", "key", "value"])

    valued = "kind byte, part int, key long, value double"
    values = trees.applyInArrow(probabilities, valued).unionByName(
        counted.where(F.col("kind") == WORD).select("key", F.col("n").cast("double")).mapInArrow(words, valued))
    answers = asked.where(F.col("kind") != DOCS).select("part", "block", "kind", "keys").groupBy("part").cogroup(
        values.groupBy("part")).applyInArrow(_answer, "block int, kind byte, keys binary, found binary")

    def word_log(c):
        return np.log10((c + 0.5) / (tokens + 0.5 * (vocabulary + 1)))

    def score(rows, found):
        data, offsets = _texts(rows)
        own = {}
        for kind in (GRAM, WORD):
            mine = found.filter(pa.array(found.column("kind").to_numpy() == kind))
            key = np.concatenate([np.zeros(0, np.int64)] + [_grown(x, np.int64, True) for x in mine.column("keys").to_pylist()])
            value = np.concatenate([np.zeros(0)] + [_grown(x, np.float64) for x in mine.column("found").to_pylist()])
            order = np.argsort(key)
            own[kind] = key[order], value[order]
        out = []
        for a, b in groups(offsets):
            part, places = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            w = Words(part, places)
            text, bounds = canonical(part, places)
            n = b - a
            each, of = np.unique(grams(text, bounds), return_inverse=True)
            log_p = own[GRAM][1][np.searchsorted(own[GRAM][0], each)][of]
            count = np.zeros(0)
            if len(w.hashes):
                each, of = np.unique(w.hashes.view(np.int64), return_inverse=True)
                count = own[WORD][1][np.searchsorted(own[WORD][0], each)][of]
            word = np.repeat(np.arange(n), w.counts)
            out.append((np.bincount(np.repeat(np.arange(n), np.diff(bounds)), log_p, n),
                        np.bincount(word, word_log(count), n) + word_log(ends),
                        np.bincount(word, count > 0, n).astype(np.int64) + (ends > 0),
                        w.counts + 1, np.diff(bounds)))
        score, base, known, n_tokens, size = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0),) * 5
        return pa.table({
            "doc_id": rows.column("doc_id"), "trained": rows.column("trained"), "n_tokens": n_tokens.astype(np.int64),
            "n_known": known.astype(np.int64), "train_tokens": np.full(len(score), tokens, np.int64),
            "base_score": base.astype(float), "score": score.astype(float),
            "bits_per_byte": -score / np.log10(2.0) / np.maximum(size, 1)})

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double, bits_per_byte double")


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return score_texts(table(spark, sf_dir, "documents"), ~F.coalesce(held, F.lit(False))).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "bits_per_byte")


QUERIES = {"op7_context_tree_weighting": op7_context_tree_weighting}
ORACLES: dict[str, str] = {}
