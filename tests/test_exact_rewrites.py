"""Rules whose predicate is written for speed, against the plain pattern on random texts."""

from __future__ import annotations

import random
import re
import time

import pytest
from helpers import counts_by_rule, files_of
from srclens.operators.catalog import only
from srclens.operators.rules import calls
from srclens.operators.scan import issues, with_rule_counts

TRIM = b" \t\n\r\x00\x0b"

# Pieces that random texts are made of, per theme.
THEMES = {
    "calls": ["f", "if", "(", ")", ",", " ", "a1", "é", "for", "\n"],
    "functions": ["function ", "function f(", "f", "(", ")", " ", "{", ":", " int", "\n"],
    "switches": ["switch", "(", ")", " ", "a", "\n"],
    "properties": ["public ", "private ", "int ", "readonly ", "$", "$a", "b", " ", ";", "\n"],
    "space": [" ", "    ", "\t", "x", "0", "\r", "\x0c", "\n", "\x0b"],
    "names": ["namespace", "use", " ", ";", "A", "B", "\n", "\n\n", "é", "  "],
    "members": ["public ", "private ", "protected ", "static ", "function ", "f", "$x", "$", ";", " =", "\n"],
    "words": ["ASYNC", "Promise", "curl_exec", "CURL_CLOSE", "curl_multi_", "(", "async", "\n", "É", "x"],
    "braces": ["class ", "trait", " A", "{", "}", " ", "function f", "()", "\n", "//"],
    "strpos": ["strpos", "(", ")", ",", " ", "  ", "$a", "'b'", " !== ", "false", " === ", "0", "\n"],
    "substr": ["substr", "(", ")", ",", " ", "$a", "-strlen", "-strlen(", " === ", "$b", "\n", "))"],
    "whole calls": ["strpos( $a , $b ) !== false", "strpos($a,  ) === 0", "strpos( , x)!==  false", "substr($a, -strlen( $b )) === $b",
                    "substr( , -strlen( )) === ", "substr($a,-strlen($b ) )===$bc", " ", "strpos(", "substr(", "\n"],
    "quotes": ["\"", "$", "\\", "a", " ", "\n"],
    "constructors": ["function __construct", "function  __construct (", "(", ")", "$", "$a", " ", ",", "\n"],
    "ends": ["namespace ", "namespace A", ";", " ", "\n", "\n\n", "A", " \n \n"],
    "long": ["x" * 60, "é" * 30, " ", "\t", "\n"],
}


# The plain patterns of three rules.
STRPOS = rb"strpos\s*\(\s*([^,]+),\s*([^)]+)\s*\)\s*"
SUBSTR = rb"substr\s*\(\s*([^,]+),\s*-strlen\s*\(\s*([^)]+)\s*\)\s*\)\s*===\s*\2"


def plain(text: bytes) -> dict[int, int]:
    lines = text.split(b"\n")

    def count(test):
        return sum(1 for line in lines if test(line))

    def blank(line):
        return line.strip(TRIM) in (b"", b"0")

    def indent(line):
        return re.match(rb"\s*", line).group()

    def call(line):
        m = re.search(rb"(\w+)\s*\([^)]*,\s*[^)]*,\s*[^)]*\)", line)
        return bool(m) and m.group(1) not in (b"if", b"for", b"while", b"foreach", b"switch")

    def n(pattern):
        return len(re.findall(pattern, text))

    gate = re.search(rb"(?:public|private|protected)\s+(?:static\s+)?\$\w+"
                     rb"|(?:public|private|protected)\s+(?:static\s+)?function", text)
    uses = re.findall(rb"use\s+([^;]+);", text)
    too_long = count(lambda l: len(l.rstrip(TRIM)) > 120)
    return {
        6: too_long, 26: too_long,
        7: count(lambda l: re.search(rb"\s+\Z", l)),
        8: int(bool(re.search(rb"namespace\s+[^;]+;(?!\s*\n\s*\n)", text))),
        9: int(not re.search(rb"namespace\s+([^;]+);", text)),
        12: int(len(uses) > 1 and sorted(uses) != uses),
        13: int(bool(gate) and n(rb"public\s+") + n(rb"private\s+") + n(rb"protected\s+")
                < n(rb"(?:function\s+\w+|\$\w+\s*[=;])")),
        17: count(lambda l: re.search(rb"function\s+\w+\s*\([^)]*\)\s*{", l)
                  and not re.search(rb"function\s+\w+\s*\([^)]*\)\s*:\s*\w+", l)),
        21: count(lambda l: re.search(rb"\s+\Z", l) and not blank(l)),
        25: count(lambda l: re.search(rb'"[^"\\$]*"', l) and not re.search(rb'"[^"]*\$[^"]*"', l)),
        27: count(lambda l: b"\t" in indent(l)),
        28: count(lambda l: indent(l) and b"\t" not in indent(l) and len(indent(l)) % 4 and not blank(l)),
        30: count(lambda l: re.search(rb"^(class|interface|trait)\s+\w+.*\{\Z", l.strip(TRIM))),
        31: count(lambda l: re.search(rb"function\s+\w+.*\{\Z", l.strip(TRIM))),
        34: count(lambda l: re.search(STRPOS + rb"!==\s*false", l)),
        35: count(lambda l: re.search(STRPOS + rb"===\s*0", l)),
        36: count(lambda l: re.search(SUBSTR, l)),
        37: count(lambda l: re.search(rb"switch\s*\(\s*([^)]+)\s*\)", l)),
        38: count(lambda l: b"readonly" not in l and re.search(
            rb"(private|protected|public)\s+([^$]*\$(\w+))\s*;", l)),
        42: count(lambda l: re.search(rb"(?i)(curl_multi_|curl_exec.*curl_close|async|promise)", l)),
        45: count(lambda l: re.search(rb"function\s+__construct\s*\([^)]*\$(\w+)[^)]*\)", l)),
        46: count(call),
    }


@pytest.fixture(params=["as lines are", "all long"])
def form(request, monkeypatch):
    """Rules 34 to 36 have one form for short lines and one for long ones."""
    if request.param == "all long":
        monkeypatch.setattr(calls, "SHORT", -1)


def test_random_texts(spark, form):
    rng = random.Random(7)
    texts = []
    for pieces in THEMES.values():
        texts += ["".join(rng.choices(pieces, k=rng.randint(0, 24))) for _ in range(700)]
    mixed = [p for pieces in THEMES.values() for p in pieces]
    texts += ["".join(rng.choices(mixed, k=rng.randint(5, 60))) for _ in range(700)]
    found = counts_by_rule(spark, texts)
    hit = dict.fromkeys(plain(b""), 0)
    for text, counts in zip(texts, found):
        expected = plain(text.encode())
        assert {k: counts[k] for k in expected} == expected, repr(text)
        for k, v in expected.items():
            hit[k] += bool(v)
    assert all(hit.values()), hit


def test_captures(spark, form):
    """The previews of rules 34 to 36 have what the plain patterns capture, trimmed."""
    rng = random.Random(8)
    pieces = THEMES["strpos"][:-1] + THEMES["substr"][:-2] + 4 * THEMES["whole calls"][:-1]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(1500)]
    rows = issues(files_of(spark, texts), only(34, 35, 36)).where("before_code IS NOT NULL").select(
        "file_id", "rule", "before_code").collect()
    found = sorted((r.file_id, r.before_code) for r in rows)
    expected = []
    for i, text in enumerate(texts):
        for pattern, shown in ((STRPOS + rb"!==\s*false", "strpos({}, {}) !== false"),
                               (STRPOS + rb"===\s*0", "strpos({}, {}) === 0"),
                               (SUBSTR, "substr({0}, -strlen({1})) === {1}")):
            m = re.search(pattern, text.encode())
            if m:
                expected.append((i, shown.format(*(g.strip(TRIM).decode() for g in m.groups()))))
    assert found == sorted(expected) and len(found) > 300


HOSTILE = ["namespace ", "\"$", "strpos( ", "strpos(a, ", "substr(a,-strlen( ", "function __construct( $"]
CALLS = ["strpos($a,", "substr($a,-strlen($b", "substr($a,-strlen("]
UNCLOSED = ["strpos( ", "strpos(a, ", "substr(a ", "substr(a,-strlen( ", "substr(a,-strlen(", "function __construct( ",
            "function __construct( $"]


def test_long_hostile_lines_take_linear_time(spark):
    """Lines on which backtracking patterns would need hours, with several ends."""
    tail = ") { , ; $a } use x;"
    starts = ["switch( a", "public ", "function f(", "word, word (x ", "curl_exec ", "use ", "namespace ",
              "\"", " ", "f(", "public $a "]
    found = counts_by_rule(spark, [s * (200_000 // len(s)) + tail for s in starts])
    assert found[0][37] == 1 and found[3][46] == 1 and found[4][42] == 0
    for end in ("", " ) !== x", tail):
        texts = [s * (100_000 // len(s)) + end for s in HOSTILE]
        texts += [c + " " * 200_000 + end for c in CALLS]
        began = time.time()
        with_rule_counts(files_of(spark, texts), only(8, 25, 34, 35, 36, 45)).drop("body").collect()
        assert time.time() - began < 10 * len(texts), end


def test_unclosed_calls_take_a_second(spark):
    """200 KB of one unclosed call, with and without an end that is almost a hit."""
    def run(texts):
        began = time.time()
        rows = with_rule_counts(files_of(spark, texts), only(34, 35, 36, 45)).drop("body").collect()
        return time.time() - began, rows

    run(["strpos("])
    for call in UNCLOSED:
        for end in ("", "x, y", "x) !== false", "$b )) === $c", "a) , $b)", "a))=== substr(a,-strlen(b"):
            took, _ = run([call * (200_000 // len(call)) + end])
            assert took < 3, (call, end, took)  # a second, and the time to plan on a busy machine
