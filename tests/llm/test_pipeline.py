from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from srclens.llm import chosen_path, mixing, quality, repeats
from srclens.llm.common import table, written
from test_chosen_path import brute as brute_classes
from test_packing import plain_ids
from test_repeats import brute_runs
from srclens.llm.repeats import whole_characters, without

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality(spark, stages):
    before, after = stages[0]
    assert after.columns == COLUMNS
    kept = set(texts(after))
    counted = written(quality.count_documents(before))
    model = quality.train(counted, table(spark, SF, "labels"))
    assert kept == {r.doc_id for r in quality.score_counts(counted, model).where("predicted = 1").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.99 * len(good)
    assert not any(d in kept for d, q in labels.items() if q == 0)


def test_near_duplicates(stages):
    before, after = stages[1]
    assert after.columns == COLUMNS
    old, new = texts(before), texts(after)
    assert set(new) == {c for c, _ in brute_classes(list(old.items())).values()}
    assert all(old[d] == t for d, t in new.items())


def test_repeats(stages):
    before, after = stages[2]
    assert after.columns == COLUMNS
    old, new = texts(before), texts(after)
    raw = [t.encode() for t in old.values()]
    want = {d: without(t, whole_characters(t, r)).decode() for d, t, r in zip(old, raw, brute_runs(raw))}
    assert new == want and new != old
    assert all(r.n_chars == len(r.text) for r in after.collect())


def water_fill(tree, budget):
    """tree: {path: (weights along the path, supply)}."""
    def down(prefix, amount):
        here = defaultdict(lambda: [0, 0.0])
        for path, (weights, supply) in tree.items():
            if path[:len(prefix)] == prefix and len(path) > len(prefix):
                child = here[path[:len(prefix) + 1]]
                child[0] += supply
                child[1] = weights[len(prefix)]
        if not here:
            return {prefix: amount}
        given, open_ = {}, dict(here)
        while open_:
            rate = (amount - sum(given.values())) / sum(w for _, w in open_.values())
            full = [p for p, (s, w) in open_.items() if s <= rate * w]
            if not full:
                given |= {p: rate * w for p, (_, w) in open_.items()}
                break
            for p in full:
                given[p] = open_.pop(p)[0]
        return {k: v for p, a in given.items() for k, v in down(p, a).items()}
    return down((), min(budget, sum(s for _, s in tree.values())))


def test_mix(stages):
    before, after = stages[3]
    assert after.columns == COLUMNS
    rows = before.collect()
    words = {r.doc_id: len(r.text.split()) for r in rows}
    tree, leaf = {}, {}
    for r in rows:
        domain = f"domain{int(r.source[3:]) % 4}"
        weights = ({"domain0": 4, "domain1": 3, "domain2": 2}.get(domain, 1), 2 if r.lang == "en" else 1, 1)
        leaf[r.doc_id] = (domain, r.lang, r.source)
        tree[leaf[r.doc_id]] = (weights, tree.get(leaf[r.doc_id], (0, 0))[1] + words[r.doc_id])
    target = water_fill(tree, int(sum(words.values()) * 0.9))
    taken = defaultdict(int)
    old = texts(before)
    cut = 0
    for d, t in texts(after).items():
        n = len(t.split())
        taken[leaf[d]] += n
        if t != old[d]:
            cut += 1
            assert t == " ".join(old[d].split()[:n])
    assert cut <= len(tree)
    for path, amount in target.items():
        assert abs(taken[path] - amount) <= 1


def test_packing(stages):
    before, after = stages[4]
    old = texts(before)
    length = defaultdict(int)
    by_sequence = defaultdict(list)
    for r in after.collect():
        length[r.doc_id] += r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    ids = plain_ids(list(old.values()))
    assert length == {d: len(i) + 1 for d, i in zip(old, ids)}
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by_sequence) <= 1.05 * -(-sum(length.values()) // 2048) + 1


def test_empty_and_odd_rows(spark, tmp_path):
    folder = str(tmp_path / "sf")
    table(spark, SF, "labels").write.parquet(f"{folder}/labels.parquet")
    schema = table(spark, SF, "documents").schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).count() == 0
    odd = str(tmp_path / "odd")
    table(spark, SF, "labels").write.parquet(f"{odd}/labels.parquet")
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (None, "some plain words", "en", None, 16),
            (3, "word " * 30_000, "en", "src1", 1), (3, "word " * 30_000, "en", "src1", 1),
            (4, "It is a plain text of a few words.", "en", "odd", 5), (4, "It is another plain text.", "xx", "", 5)]
    docs = spark.createDataFrame(rows, schema)
    for c in ("tokens", "epoch", "rid", "spans", "score", "domain", "packed"):
        docs = docs.withColumn(c, docs["lang"])
    docs.write.parquet(f"{odd}/documents.parquet")
    for _, stage in pipeline.STAGES[:4]:
        assert stage(spark, docs, odd).columns == docs.columns
    assert pipeline.run(spark, odd).count() > 0


@pytest.mark.parametrize("stage", [mixing.mix_documents, chosen_path.keep_one, repeats.remove_repeats])
def test_clashing_columns_change_nothing(spark, stage):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    odd = docs
    for c in ("domain", "__rid", "kept_id", "kept_rid", "several", "__key", "__spans", "spans", "row", "doc", "mix_0", "taken", "rid"):
        odd = odd.withColumn(c, docs["doc_id"])
    found = stage(odd)
    assert found.columns == odd.columns
    rows = found.collect()
    assert all(r["domain"] == r["__rid"] == r["__key"] == r["row"] == r.doc_id for r in rows)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(tuple(r) for r in stage(docs).collect())


def test_mixture_repeats_epochs(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", 10 if i % 2 else 90) for i in range(20)], "doc_id long, source string, w long")
    out = mixing.mixture(docs, ["source"], [mixing.F.lit(1)], mixing.F.lit(600), mixing.F.col("w"), mixing.F.col("doc_id")).collect()
    taken = defaultdict(int)
    for r in out:
        taken[r.source, r.epoch] += r.taken
    # s1 has 100 tokens, 300 in three epochs: its shortage goes to s0.
    assert {k: v for k, v in taken.items() if k[0] == "s1"} == {("s1", 0): 100, ("s1", 1): 100, ("s1", 2): 100}
    assert sum(v for k, v in taken.items() if k[0] == "s0") == 300
