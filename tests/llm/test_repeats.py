from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from srclens.llm import repeats
from srclens.llm.common import table

SCHEMA = "doc_id long, text string, n_chars long, spans string, packed string, text_key string"


def brute_runs(texts, least=200):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - least + 1):
            seen[t[i:i + least]] += 1
    out = []
    for t in texts:
        runs = []
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + least
                else:
                    runs.append([i, i + least])
        out.append([tuple(r) for r in runs])
    return out


def expected(docs):
    raw = [(t or "").encode() for _, t in docs]
    rows = []
    for (d, _), t, runs in zip(docs, raw, brute_runs(raw)):
        kept = repeats.without(t, runs)
        rows.append((d, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["thé", "an", "ör", "ti", "bl", "ng"]) + str(rng.randrange(99)) for _ in range(n))
    passage, near = words(70), words(150)
    docs = [words(rng.randrange(0, 120)) for _ in range(30)]
    docs += [words(20) + passage + words(20) for _ in range(40)]
    docs += [near[:i * 20] + "!" + near[i * 20:] for i in range(1, 20)]
    docs += [near, near, "a" * 900, "ab" * 300, "a" * 199, "a" * 200, "", None, "x" + "a" * 200, words(60) * 3]
    docs += [passage[:205], passage[5:180], words(4000)]
    return list(enumerate(docs))


@pytest.mark.parametrize("shard", [repeats.SHARD_BYTES, 4000])
def test_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "s", "p", "k") for d, t in docs], SCHEMA)
    assert sorted(map(tuple, repeats.digests(df).collect()), key=str) == expected(docs)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, repeats.op8_suffix_array_repeats(spark, sf).collect()), key=str) == expected(docs)


@pytest.mark.parametrize("length", [60, 150, 600])
def test_hot_anchor(spark, monkeypatch, tmp_path, length):
    """A passage in many contexts: no group is far above the shard size, and no repeat is lost."""
    rng = random.Random(length)
    words = lambda n: " ".join(str(rng.randrange(10 ** 6)) for _ in range(n))
    passage = words(120)[:length]
    near = [words(30) for _ in range(12)]
    texts = [words(35) + passage + words(35) for _ in range(300)]
    texts += [rng.choice(near) + passage + rng.choice(near) for _ in range(100)]
    texts += [near[0][-k:] + passage + near[1][:60 - k] for k in range(60)] + [passage * 4]
    docs = list(enumerate(texts))
    finder = repeats._shard_finder

    def measured(least):
        find = finder(least)

        def run(rows):
            size = sum(map(len, rows.column("bytes").to_pylist()))
            (tmp_path / f"{rows.column('anchor')[0].as_py()}-{size}").touch()
            return find(rows)
        return run

    monkeypatch.setattr(repeats, "SHARD_BYTES", 20000)
    monkeypatch.setattr(repeats, "_shard_finder", measured)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, repeats.digests(df).collect()), key=str) == expected(docs)
    sizes = [int(f.name.split("-")[-1]) for f in tmp_path.iterdir()]
    assert sizes and max(sizes) <= 2 * 20000


def periodic(seed=7):
    """Texts with long passages of short periods between other words."""
    rng = random.Random(seed)
    words = lambda n: " ".join(str(rng.randrange(10 ** 6)) for _ in range(n))
    ends = [words(30) for _ in range(3)]
    docs = [words(rng.randrange(1, 40)) + unit * (rng.randrange(300, 900) // len(unit)) + rng.choice([words(40), *ends])
            for unit in ("a", "in ", "this ", " En in", "sixteen letters ", "more than sixteen letters ") for _ in range(12)]
    return docs + ["in " * 2000, "0" * 32 + words(60), words(60) + "0" * 32, "b" * 200, "c" * 199, "d" * 201, ends[0]]


@pytest.mark.parametrize("shard", [repeats.SHARD_BYTES, 4000])
def test_periodic_passages(spark, monkeypatch, shard):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    docs = list(enumerate(periodic()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, repeats.digests(df).collect()), key=str) == expected(docs)


def window_rows(texts):
    data = b"".join(texts)
    offsets = np.cumsum([0, *map(len, texts)])
    return list(zip(*(c.tolist() for c in repeats.joined_runs(*repeats.anchors(np.frombuffer(data, np.uint8), offsets)))))


@pytest.mark.parametrize("unit", [b"a", b"in ", b"this ", b"sixteen letters "])
def test_periodic_rows(unit):
    """The rows of a passage of a short period do not grow with its length (before: one a period)."""
    rng = random.Random(5)
    head, tail = (bytes(rng.randrange(33, 127) for _ in range(300)) for _ in range(2))
    short, long = (len(window_rows([head + unit * n + tail])) for n in (40 + 400 // len(unit), 40 + 40000 // len(unit)))
    assert long <= short + 2 and long <= 40


def test_each_string_in_one_window():
    """Windows of equal anchors hold every string once, at its place, whatever stands around it."""
    texts = [t.encode() for t in periodic()]
    data, offsets = b"".join(texts), np.cumsum([0, *map(len, texts)])
    found, anchor = defaultdict(int), {}
    for text, at, h, _, before, after in zip(*(c.tolist() for c in repeats.anchors(np.frombuffer(data, np.uint8), offsets))):
        for i in range(at - before, at + after - 200 + 1):
            found[text, i] += 1
            assert anchor.setdefault(texts[text][i:i + 200], (h, at - i)) == (h, at - i)
    assert found == {(k, i): 1 for k, t in enumerate(texts) for i in range(len(t) - 199)}


def test_repeated_rows(spark):
    docs = [(1, "q" * 50 + str(list(range(100)))), (1, "q" * 50 + str(list(range(100)))), (None, "z" * 150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, repeats.digests(df).collect()), key=str) == expected(docs)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeats.digests(df).count() == 0 and repeats.remove_repeats(df).count() == 0


def test_remove(spark):
    docs = corpus(4)
    df = spark.createDataFrame([(d, t, -1, "s", "p", "k") for d, t in docs], SCHEMA)
    out = repeats.remove_repeats(df)
    assert out.schema == df.schema
    got = {r.doc_id: r for r in out.collect()}
    raw = [(t or "").encode() for _, t in docs]
    for (d, t), b, runs in zip(docs, raw, brute_runs(raw)):
        want = repeats.without(b, repeats.whole_characters(b, runs)).decode()
        assert (got[d].text or "") == want and (got[d].text is None) == (t is None)
        assert got[d].n_chars == (-1 if (t or "") == want else len(want))
        assert (got[d].spans, got[d].packed, got[d].text_key) == ("s", "p", "k")
