from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from srclens.llm import context_tree as ct
from srclens.llm.common import table

SCHEMA = "doc_id long, text string, key string, n string, value string"
DOCS = [(i, t) for i, t in enumerate([
    "The cat sat on the mat.", "the mat\tsat  on The cat", "", None, " \n", "a", "the the the", "Ünï cödé the cat",
    "zzz unseen qqq", "the cat sat", "the cat sat", "x" * 300, "mat on cat the sat " * 20])]


def words(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def held_out(d):
    return zlib.crc32(str(d).encode()) % 5 == 1


def sequence(text):
    return b" ".join(words(text)) + b"\n"


class Brute:
    """Context-tree weighting written down directly, one tree per decision."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        for t in texts:
            for path, bit in self.bits(t):
                for key in path:
                    self.n[key][bit] += 1
        self.children = defaultdict(set)
        for node, context in list(self.n):
            if context:
                self.children[node, context[1:]].add(context)
        self.memo = {}

    @staticmethod
    def bits(seq):
        padded = b"\n" * ct.DEPTH + seq
        for i in range(ct.DEPTH, len(padded)):
            for t in range(8):
                node = (1 << t) | (padded[i] >> (8 - t))
                yield [(node, padded[i - d:i]) for d in range(ct.DEPTH + 1)], (padded[i] >> (7 - t)) & 1

    def own(self, key):
        a, b = self.n.get(key, (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - 2 * math.lgamma(.5) - math.lgamma(a + b + 1)

    def mixed(self, key):
        if key not in self.memo:
            own = self.own(key)
            if len(key[1]) < ct.DEPTH:
                below = sum(self.mixed((key[0], c)) for c in self.children.get(key, ()))
                own = np.logaddexp(own, below) - math.log(2)
            self.memo[key] = own
        return self.memo[key]

    def log10(self, seq):
        total = 0.0
        for path, bit in self.bits(seq):
            p = None
            for key in reversed(path):
                a, b = self.n.get(key, (0, 0))
                kt = ((a, b)[bit] + .5) / (a + b + 1)
                if p is None:
                    p = kt
                else:
                    w = math.exp(self.own(key) - math.log(2) - self.mixed(key))
                    p = w * kt + (1 - w) * p
            total += math.log10(p)
        return total


def expected(docs):
    train = [t for d, t in docs if not held_out(d)]
    counts = Counter(w for t in train for w in words(t))
    ends, n, v = len(train), sum(counts.values()) + len(train), len(counts) + (len(train) > 0)
    model = Brute([sequence(t) for t in train])
    log = lambda c: math.log10((c + .5) / (n + .5 * (v + 1)))
    return {d: (held_out(d), len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + (ends > 0), n,
                sum(log(counts[w]) for w in words(t)) + log(ends), model.log10(sequence(t))) for d, t in docs}


def got(df):
    return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()}


def same(a, b):
    assert set(a) == set(b)
    for d in a:
        assert a[d][:4] == b[d][:4]
        assert a[d][4:] == pytest.approx(b[d][4:], rel=1e-9, abs=1e-9)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "k", "n", "v") for d, t in docs], SCHEMA)
    held = ct.fold(ct.F.col("doc_id"), 5) == 1
    return got(ct.score_texts(df, ~held).withColumn("held_out", ~ct.F.col("trained")))


@pytest.mark.parametrize("block,rows", [(ct.BLOCK_BYTES, ct.TREE_ROWS), (200, 50)])
def test_brute_force(spark, monkeypatch, block, rows):
    monkeypatch.setattr(ct, "BLOCK_BYTES", block)
    monkeypatch.setattr(ct, "TREE_ROWS", rows)
    same(run(spark, DOCS), expected(DOCS))


def test_nothing_to_learn_from(spark):
    docs = [d for d in DOCS if held_out(d[0])]
    assert docs
    same(run(spark, docs), expected(docs))


def test_no_rows(spark):
    assert run(spark, []) == {}


def test_null_id_and_repeats(spark):
    df = spark.createDataFrame([(None, "the cat"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = ct.score_texts(df, ct.F.lit(None).cast("boolean")).collect()
    assert len(rows) == 3 and all(not r.trained and r.train_tokens == 0 and r.base_score == 0 for r in rows)


def test_held_out_texts_are_better_than_the_base(spark):
    rows = ct.op7_context_tree_weighting(spark, "/root/testdata/sf0.1").where("held_out").toPandas()
    assert rows.score.sum() > 0.97 * rows.base_score.sum()
    assert (rows.score > rows.base_score).mean() > 0.8
    assert table(spark, "/root/testdata/sf0.1", "documents").count() > len(rows) > 1000


@pytest.mark.xfail(strict=True, reason="on so little text the score is -322239 against -317962, better for 0.428 of the documents")
def test_held_out_texts_of_a_small_corpus(spark):
    rows = ct.op7_context_tree_weighting(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    print(f"score {rows.score.sum():.0f}, base {rows.base_score.sum():.0f}, better {(rows.score > rows.base_score).mean():.3f}")
    assert table(spark, "/root/testdata/sf0.01", "documents").count() > len(rows) > 100
    assert rows.score.sum() > rows.base_score.sum()
    assert (rows.score > rows.base_score).mean() > 0.9


def test_probabilities_sum_to_one():
    context = np.int64(0x6162636465) << 8
    key = np.concatenate([context + np.arange(256), (np.int64(0x7A61626465) << 8) + np.array([1, 5])])
    count = np.concatenate([np.arange(256) % 7, [3, 0]])
    level = ct.levels(key, count, 2)[2]
    rows = [(int(i >> 8) & 255, int(i & 255), *n, m) for i, n, m in zip(level.ids, level.n, level.mixed)]
    p = 10 ** ct.log10_probability(key, count, ct.Top(rows))[:256]
    assert p.sum() == pytest.approx(1)


def test_canonical():
    texts = [b" The  cat\t", b"", b"\n", b"x"]
    out, ends = ct.canonical(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [out[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [b"the cat\n", b"\n", b"\n", b"x\n"]
