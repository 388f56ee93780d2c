from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from srclens.llm import chosen_path as cp
from srclens.llm.common import table
from srclens.llm.components import components

SCHEMA = "doc_id long, text string, rid string, n string, bucket string, class_id string"


def shingles(text):
    words = [w.lower() for w in (text or "").split()]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """{doc: (class, links)} by comparing sets that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    by_token, links = defaultdict(list), defaultdict(set)
    for d, s in sets.items():
        for t in s or {()}:
            by_token[t].append(d)
    seen = set()
    for same in by_token.values():
        for i, a in enumerate(same):
            for b in same[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a], sets[b]
                    if not x or 5 * len(x & y) >= 4 * len(x | y):
                        links[a].add(b)
                        links[b].add(a)
    out = {}
    for d in sorted(sets):
        if d not in out:
            group, todo = {d}, [d]
            while todo:
                for e in links[todo.pop()] - group:
                    group.add(e)
                    todo.append(e)
            out |= {e: min(group) for e in group}
    return {d: (out[d], len(links[d])) for d in sets}


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(200)]
    texts = [edited(rng, base, rng.randrange(0, 5)) for _ in range(90)]  # one large group of near copies
    texts += [[word() for _ in range(150)] + passage for _ in range(80)]  # a shared passage
    for _ in range(25):
        one = [word() for _ in range(rng.randrange(3, 120))]
        texts += [one, edited(rng, one, 1), edited(rng, one, 3), [w.upper() for w in one]]
    texts += [["a", "b"], ["A", "b"], ["a"], [], [], ["x"] * 5000]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return docs + [(len(docs), None), (len(docs) + 1, "  \n"), (len(docs) + 2, "a\tb")]


@pytest.mark.parametrize("small,block", [(32, 512), (4, 16)])
def test_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(cp, "SMALL", small)
    monkeypatch.setattr(cp, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in docs], SCHEMA)
    assert got(cp.near_duplicates(df)) == brute(docs)


def test_whole_table(spark):
    docs = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    assert got(cp.op5_chosen_path_join(spark, "/root/testdata/sf0.01")) == brute(docs)


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " end"), (3, "other words here"), (3, "something else"), (None, text)]
    out = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in cp.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [("1", "1", 2), ("1", "1", 2), ("2", "1", 2), ("3", "3", 0), ("3", "3", 0), ("None", "None", 0)]


def test_keep_one(spark):
    docs = corpus(2)
    df = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in docs] + [(None, "x", "", "", "", "")], SCHEMA)
    kept = cp.keep_one(df)
    assert kept.columns == df.columns
    want = {c for c, _ in brute(docs).values()} | {None}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_keep_one_of_shared_ids(spark):
    """Both texts of an id stay when they stand for two classes; copies and near copies go."""
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(4, text), (4, other), (4, other), (5, text), (6, other + " end"), (7, "alone"), (8, text), (8, "only here"),
            (9, None), (9, "more")]
    kept = cp.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [
        (4, text), (4, other), (7, "alone"), (8, "only here"), (9, None), (9, "more")]))


def test_no_rows(spark):
    assert got(cp.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))) == {}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 100), (7, 7), (200, 200), (None, 3)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**{i: 0 for i in range(51)}, 90: 90, 100: 90, 200: 200}


def test_common():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40))) for _ in range(20)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    i, j = rng.integers(0, 20, 100), rng.integers(0, 20, 100)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert cp.common(np.concatenate(sets), bounds, i, j, most=64).tolist() == want
