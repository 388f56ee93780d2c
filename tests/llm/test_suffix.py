from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from srclens.llm import suffix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(values):
    t = np.array([*values, 0], np.uint16)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffix.suffix_array(t).tolist() == want


def test_long_runs_and_repeats():
    for values in ([1] * 500, [1, 2] * 300, [2, 1, 1, 3] * 200, list(range(250)) * 4, list(range(250, 0, -1)) * 3):
        t = np.array([*values, 0], np.uint16)
        assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute(texts, least):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            seen.setdefault(t[i:i + least], []).append((k, i))
    many = {p for places in seen.values() if len(places) > 1 for p in places}
    return [(k, i) in many for k, t in enumerate(texts) for i in range(len(t))]


def check(texts, least):
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    assert suffix.repeated(data, bounds, least).tolist() == brute(texts, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=6), st.integers(1, 12))
def test_repeated(texts, least):
    check(texts, least)


def test_repeated_long():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 255, 3000).astype(np.uint8).tobytes()
    texts = [base, base[500:900] + base[100:400], b"\x00" * 700, base[:250] + b"\xff" * 300, b"", base[1000:1199]]
    check(texts, 200)
