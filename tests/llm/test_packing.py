from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from srclens.llm import packing, tokens
from srclens.llm.packing import Capacity, best_fit

SCHEMA = "doc_id long, text string, length string, piece string"
TEXTS = ["", None, "  \n ", "Thing, it's 12.5% <|endoftext|> of Éléphants ÷ × naïve", "x" * 9000 + " " + "ab1 " * 3000,
         "é ́a ≠ ΟΔΟΣ. İstanbul x y don't'll 'S <b>hi</b> \x1c a\x0bb", "the the", "the the"]


def plain_ids(texts):
    t = tokens.encoder().tokenizer
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def split(texts):
    raw = [(x or "").encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return [ids[b:c].tolist() for _, ids, bounds in tokens.encoder().encode(data, offsets)
            for b, c in zip(bounds, bounds[1:])]


def test_ids_equal_whole_texts():
    assert split(TEXTS) == plain_ids(TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(
    st.characters(codec="utf-8"), st.sampled_from("abzAZ019'<>|.,= \t\ń̸ÉéßŒ÷×ΣςİK")), max_size=20), max_size=5))
def test_ids_of_any_text(texts):
    assert split(texts) == plain_ids(texts)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 3)
    assert split(TEXTS) == plain_ids(TEXTS)


def check(rows, texts, most=2048):
    want = [[*ids, 0] for ids in plain_ids(texts)]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        at = 0
        for p, r in enumerate(pieces):
            part = want[d][at:at + most]
            assert (r.piece, r.start, r.length) == (p, at, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += len(part)
        assert at == len(want[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most


@pytest.mark.parametrize("shard", [3, 1000])
def test_pack(spark, shard):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA)
    check(packing.pack(packing.cut(docs), per_shard=shard).collect(), TEXTS)


def test_no_rows_and_repeats(spark):
    assert packing.pack(packing.cut(spark.createDataFrame([], SCHEMA))).count() == 0
    same = spark.createDataFrame([(1, "a b c", "", "")] * 5 + [(None, "a", "", "")], SCHEMA)
    rows = packing.pack(packing.cut(same)).collect()
    assert len(rows) == 6 and len({(r.sequence_id, r.offset) for r in rows}) == 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(1, 8),
       st.sampled_from([64.0**2, 4500.0, 9000.0]))
def test_every_capacity_holds(lengths, rule, documents, attention):
    cap = Capacity(64, documents, attention, (1.0, 0.5, 0.5), rule)
    n = np.array(lengths, np.int64)
    sequence, offset = best_fit(n, cap)
    for s in set(sequence.tolist()):
        own = n[sequence == s]
        assert own.sum() <= 64 and len(own) <= documents and (own**2).sum() <= attention
        assert sorted(offset[sequence == s].tolist()) == (np.cumsum(own[np.argsort(offset[sequence == s])])
                                                          - own[np.argsort(offset[sequence == s])]).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=50), st.sampled_from(["norm", "dot"]))
def test_each_piece_goes_where_the_weights_say(lengths, rule):
    """Replays the choices: the sequence taken has the best weighted score of all that fit."""
    cap = Capacity(64, 5, 3000.0 + 64**2, (1.0, 2.0, 0.5), rule)
    n = np.array(lengths, np.int64)
    sequence, _ = best_fit(n, cap)
    limit, left = (64, 5, cap.attention), {}
    for i in np.argsort(-n, kind="stable"):
        d = (int(n[i]), 1, int(n[i]) ** 2)
        score = {}
        for s, r in left.items():
            if all(x >= y for x, y in zip(r, d)):
                score[s] = (-sum(w * x * y / m**2 for w, x, y, m in zip(cap.weights, r, d, limit)) if rule == "dot"
                            else sum(w * ((x - y) / m) ** 2 for w, x, y, m in zip(cap.weights, r, d, limit)))
        own = int(sequence[i])
        if score:
            assert score[own] <= min(score.values()) + 1e-9
        else:
            assert own not in left
        left[own] = tuple(x - y for x, y in zip(left.get(own, limit), d))


def test_all_capacities_count_in_the_choice():
    n = np.random.default_rng(6).integers(1, 2049, 2000)
    by_all, by_tokens = (best_fit(n, Capacity(weights=w))[0] for w in (Capacity().weights, (1.0, 0.0, 0.0)))
    assert min(Capacity().weights) > 0 and (by_all != by_tokens).any()
    assert by_all.max() <= by_tokens.max()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA)
    plain = packing.cut(docs)
    odd = plain
    for name in ("shard", "_Shard", "sequence_id", "offset", "a.b"):
        odd = odd.withColumn(name, plain["doc_id"])
    rows = packing.pack(odd, per_shard=1000)
    assert rows.columns == [*plain.columns, "shard", "_Shard", "a.b", "sequence_id", "offset"]
    found = rows.collect()
    check(found, TEXTS)
    assert all(r.shard == r.doc_id == r["a.b"] for r in found)


def test_sequences_are_few():
    n = np.random.default_rng(5).integers(1, 2049, 5000)
    sequence, _ = best_fit(n, Capacity())
    assert sequence.max() + 1 <= 1.02 * n.sum() / 2048


def test_too_large():
    with pytest.raises(ValueError, match="larger"):
        best_fit(np.array([65]), Capacity(64))
