from __future__ import annotations

import zlib

import numpy as np
import pytest

from srclens.llm import quality
from srclens.llm.common import table, written

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score double, n_bytes string, predicted string"


@pytest.fixture(scope="module")
def model(spark):
    counted = quality.count_documents(table(spark, SF, "documents"))
    return quality.train(counted, table(spark, SF, "labels"))


def test_held_out_accuracy(spark):
    rows = quality.op6_quadratic_quality(spark, SF)
    assert rows.count() == table(spark, SF, "documents").count()
    known = rows.join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    good = known[known.quality == 1]
    assert len(known) > 50 and (known.predicted == known.quality).mean() > 0.97
    assert (good.predicted == 1).mean() > 0.98
    assert ((rows.toPandas().score.between(0, 1))).all()


def test_folds(spark):
    got = quality.op6_quadratic_quality(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_labels_do_not_count(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    counted = written(quality.count_documents(docs))
    flipped = labels.withColumn("quality", quality.F.expr(
        "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1 THEN 1 - quality ELSE quality END"))
    a, b = quality.train(counted, labels), quality.train(counted, flipped)
    assert np.allclose(a.factors, b.factors) and np.allclose(a.centres, b.centres)


def test_odd_rows(spark, model):
    rows = [(1, "", 0.1, "a", "b"), (2, None, 0.1, "a", "b"), (None, "word " * 400_000, 0.1, "a", "b"),
            (3, "### $$$ " * 30, 0.1, "a", "b"), (4, "word", 0.1, "a", "b"), (4, "word", 0.1, "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.score_counts(quality.count_documents(docs), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_no_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "some words here", 0.1, "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    counted = quality.count_documents(docs)
    assert quality.score_counts(counted, quality.train(counted, none)).first().predicted == 1
    empty = quality.count_documents(docs.limit(0))
    assert quality.score_counts(empty, quality.train(empty, none)).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.score_counts(counted, quality.train(counted, one)).first().predicted == 1


def brute_counts(text):
    out = dict.fromkeys(quality.COUNTS, 0)
    raw = text.encode()
    out["n_bytes"] = len(raw)
    for b in raw:
        c = chr(b)
        kind = ("lower" if b >= 128 or c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else
                "newline" if c == "\n" else "blank" if c in " \t\v\f\r" else "stop" if c in ".,;:'\"-()" else
                "call" if c in "!?" else "bar" if c == "|" else "symbol")
        out[kind] += 1
    words = raw.lower().split()
    out["words"] = len(words)
    out["letters2"] = sum(len(w) ** 2 for w in words)
    out["repeats"] = sum(a == b for a, b in zip(words, words[1:]))
    out["near_repeats"] = sum(w in (words[i - 2:i - 1] + (words[i - 3:i - 2] if i > 2 else []))
                              for i, w in enumerate(words) if i > 1)
    return out


def test_counts():
    texts = ["The the  a b a b\n\nX! |é# 1,2", "", "one", "a a b c a", "\n", "q" * 50]
    raw = [t.encode() for t in texts]
    got = quality.counts(np.frombuffer(b"".join(raw), np.uint8),
                         np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    for t, row in zip(texts, got):
        want = brute_counts(t)
        for name, v in zip(quality.COUNTS, row):
            if "line" not in name or name == "newline":
                assert v == want[name], (t, name)


def test_density():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(500, quality.N_FEATURES)), rng.normal(2, 3, size=(400, quality.N_FEATURES))
    n, s, p = np.array([500.0, 400.0]), np.stack([a.sum(0), b.sum(0)]), np.stack([a.T @ a, b.T @ b])
    m = quality.fit(np.zeros(1), n, s, p, 0.0, 0.0)
    x = rng.normal(1, 2, size=quality.N_FEATURES)
    for k, own in enumerate((a, b)):
        d = x - own.mean(0)
        cov = np.cov(own.T)
        want = np.log(n[k] + 1) - np.log(902) - 0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1]
        got = m.offsets[k] - 0.5 * (((x - m.centres[k]) @ m.factors[k].T) ** 2).sum()
        assert abs(got - want) < 1e-5
