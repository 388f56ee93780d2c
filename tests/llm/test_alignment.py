"""Alignment by pointer jumping against a plain alignment of whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from srclens.llm import alignment

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(tokenizers, texts):
    """Whole texts, no units: groups end where both tokenizers have an end."""
    a, b = tokenizers
    stand_in = {chr(v): v for v in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [v for v in range(256) if v not in stand_in.values()]
    stand_in |= {chr(256 + k): v for k, v in enumerate(rest)}
    rows, docs = [], Counter()
    for text in texts:
        row = {"groups": [], "links": Counter()}
        if text:
            whole = (" " + text).encode()
            left = [(i, bytes(stand_in[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            right = []
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right):
                ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
                    group = [t for t, _ in left[i:p]], [t for t, _ in right[j:q]]
                    row["groups"].append(group)
                    row["links"].update((x, y) for x in group[0] for y in group[1])
                    i, j = p, q
                docs.update(set(row["links"]))
        rows.append(row)
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for row in rows:
        g, links = row["groups"], row["links"]
        name = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()),
                    sum(n for p, n in links.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in links.items()),
                    hashlib.sha256(name.encode()).hexdigest() if g else ""))
    return out


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:]) for r in df.collect())


def expected(tokenizers, rows):
    return sorted(((i is None, i or 0), x) for (i, *_), x in zip(rows, plain(tokenizers, [r[1] for r in rows])))


ODD = [None, "", " ", "  ", "\n", "\n\n a", " \n", "a  b", "a  b", "a   b", "x   y", "x　 y", "\u0085 z", "”  q“ r",
       "▁", "a ▁b", "<|endoftext|> end", "<s> </s><unk> x", "don't we'll 's", "émigré ça naïve", "日本語 の テキスト。 です", "Привет, мир 123",
       "🙂 👩‍👩‍👧 z", "tab\tand\x0bvt\x0cff\r\ncr", "a" * 3000, "long " * 3000, "x\x00y \x00", "é e", "﻿ bom", "def f(x):\n    return x  # ok\n\n\n"]


def test_odd_texts(spark, tokenizers):
    rows = [(i, t, "x", 1, "p") for i, t in enumerate([*ODD, *ODD[12:20]])] + [(None, "null id", "x", 2, "q"), (3, "again", None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, pair int, pairs string")
    assert got(alignment.align(df)) == expected(tokenizers, rows)


def test_random_texts_in_small_blocks(spark, tokenizers, monkeypatch):
    rng = random.Random(5)
    parts = ["a", "ab", "the", " ", "  ", "\n", " ", "é", "ß", "7", "2024", ".", "...", "“", "ing", "s", "'s", "\t", " ", "ж", "語"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(alignment.align(df, block_bytes=500)) == expected(tokenizers, rows)


def test_units_forgotten(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_KEPT", 50)
    known = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(30)]
    want = plain(tokenizers, texts)
    for k, text in enumerate(texts):
        row = alignment._block(known, 0, [k], [text.encode()]).to_pylist()[0]
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups_sha256"]) == (*want[k][:4], want[k][6])


def test_jump():
    # A: 0-2 2-5 5-6 6-9, B: 0-1 1-3 3-6 6-9
    assert alignment.jump(np.array([2, 5, 6, 9]), np.array([1, 3, 6, 9])).tolist() == [6, 6, 6, 9, 6, 6, 6, 9]
    n = np.arange(1, 2000)
    ends = alignment.jump(2 * n, np.append(2 * n - 1, 2 * n[-1]))
    assert set(ends.tolist()) == {2 * 1999}


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(alignment.op11_pointer_jumping(spark, SF)) == expected(tokenizers, rows)
