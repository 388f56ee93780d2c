"""One hit and one near miss per rule, and the quirks."""

from __future__ import annotations

import pytest

from helpers import counts_by_rule, files_of, lines_of
from srclens.operators.catalog import DEFAULT_PACKS, all_rules, only, register_pack
from srclens.operators.rules.base import LINE, Rule, RulePack, match
from srclens.operators.scan import issues

OPEN = "<?php\n"
# rule, text that hits, text that does not
SAMPLES = [
    (1, "\n<?php", "<?php"),
    (1, "﻿<?php", "<?php "),
    (2, "<?xml version", "<?= $x ?><?php"),
    (3, "﻿<?php", "<?php ﻿"),
    (4, "$p = blueprint();", "ech prin"),
    (5, "\tvar $a;", "    \tvar"),
    (6, "é" * 61, "x" * 120 + "     "),
    (6, "x" * 121, "x" * 120),
    (7, "   ", "clean"),
    (7, "a\r\nb", "a\nb"),
    (8, "namespace A;\nuse B;", "namespace A;\n\nuse B;"),
    (8, "namespace A;", "namespace A;  \n \n"),
    (9, "<?php", "namespace A;"),
    (9, "namespace A", "x namespace\tA\\B;"),
    (11, "<?php", "// declare ( strict_types = 1 )"),
    (12, "use B;\nuse A;", "use A;\nuse B;"),
    (12, "use z; because Of x;", "use A;"),
    (13, "private $a;\nvar $b;", "var $b;"),
    (13, "public function a() {}\nfunction b() {}", "public function a() {}"),
    (15, "echo $x;", 'echo "x";'),
    (15, "print  $x;", "echo $1;"),
    (16, "$this->a", "A::b"),
    (17, "function f() {", "function f(): int {"),
    (17, "function f(int $a){", "function f()\n{"),
    (18, "function f($a)", "function f(int $a)"),
    (18, "function f( $a, int $b)", "function ($a)"),
    (19, "create_function (", "createFunction("),
    (20, "foreach ($a as $b)", "each_item("),
    (21, "$a = 1; ", "     "),
    (21, "$a = 1;\t", "0 "),
    (22, "\t", " \t"),
    (24, "is_array($a)", "[] array"),
    (25, '"abc"', '"a $b"'),
    (25, "<a href=\"x\">", "'abc'"),
    (26, "x" * 121, "x" * 120),
    (27, " \tx", "    x"),
    (27, "\t", "x\t"),
    (28, " * doc", "    code"),
    (28, "     five", "   "),
    (29, "x ", " "),
    (30, "  class A {", "final class A {"),
    (30, "interface B extends C {", "class A"),
    (31, "function f() {", "function f() { // c"),
    (32, "return $x;", "private $x;"),
    (33, "array_keys($a) === range(0, 1)", "array_keys($a) == range(0, 1)"),
    (34, "strpos($a, 'b') !== false", "strpos($a, 'b') != false"),
    (35, "strpos($a, 'b') === 0", "strpos($a, 'b') == 0"),
    (36, "substr($a, -strlen($b)) === $b", "substr($a, -strlen($b)) === $c"),
    (37, "switch ($a)", "match ($a)"),
    (38, "private int $a;", "private readonly int $a;"),
    (38, "public $a ;", "public $a = 1;"),
    (39, "@param int|string $a", "@param int $a"),
    (40, "@param int|null $a", "@param null|int $a"),
    (41, "const MAX_SIZE = 'x'", "const A1 = 'x'"),
    (41, 'const A = "x"', "const A = 1"),
    (42, "// ASYNC", "curl_exec($c);"),
    (42, "Curl_Exec($c); curl_close($c)", "curl_close($c); curl_exec($c)"),
    (43, "array($o, 'm')", "array($o, $m)"),
    (43, "array(C::class, \"m\")", "[$o, 'm']"),
    (44, "call_user_func(array($o, 'm'))", "call_user_func(array($o, $m))"),
    (45, "function __construct($a)", "function __construct(\n$a)"),
    (46, "f(1, 2, 3)", "if (g(1, 2, 3))"),
    (46, "x f (,,)", "f(1, 2)"),
    (47, "list($a) = $b", "[$a] = $b"),
    (47, "array_is_list($a)", "list_of($a)"),
    (48, "// first-class callable", "readonly class A"),
]


def test_samples(spark):
    hits = counts_by_rule(spark, [s[1] for s in SAMPLES])
    misses = counts_by_rule(spark, [s[2] for s in SAMPLES])
    wrong = [("no hit", s) for s, n in zip(SAMPLES, hits) if n[s[0]] < 1]
    wrong += [("hit", s) for s, n in zip(SAMPLES, misses) if n[s[0]] != 0]
    assert not wrong


def test_every_reachable_rule_has_a_sample():
    sampled = {s[0] for s in SAMPLES}
    file_and_fallback = {10, 23, 49}
    assert {r.number for r in all_rules()} == sampled | file_and_fallback


def test_class_name_is_compared_with_the_stored_name(spark):
    text = "<?php\nnamespace A;\n\nclass Foo {}"
    assert lines_of(spark, 10, text, "bar.php") == [1]
    assert lines_of(spark, 10, text, "dir/Foo.php") == []
    assert lines_of(spark, 10, "<?php class Foo {}", "bar.php") == []
    assert lines_of(spark, 10, "namespace A;", "bar.php") == []


def test_unreachable_rule_never_fires(spark):
    assert lines_of(spark, 23, "$a=1;\n$b =2;\n$c= 3;") == []


def test_fallback_only_without_other_hints(spark):
    none, some = counts_by_rule(spark, ["<?php\n", "list($a) = $b;"])
    assert (none[49], some[49], some[47]) == (1, 0, 1)


def test_empty_file_has_one_empty_line(spark):
    (counts,) = counts_by_rule(spark, [""])
    assert {k for k, v in counts.items() if v} == {1, 9, 11, 49}


def test_crlf_fires_on_every_line_but_the_last(spark):
    text = "a\r\nb\r\nc"
    for rule in (7, 21, 29):
        assert lines_of(spark, rule, text) == [1, 2]
    assert lines_of(spark, 6, "x" * 120 + "\r\n") == []


def test_bytes_that_are_not_utf8(spark):
    files = files_of(spark, {"A.php": b"<?php\n$\xff = strpos(\x85\xe9, 'x') !== false;" + b"\xff" * 121})
    rows = {r.rule: r for r in issues(files).collect()}
    assert rows["PSR-2.line_length"].message == "Ligne trop longue (152 caractères)"
    assert rows["PHP-8.4.str_contains"].after_code == "str_contains(��, 'x')"


def test_captures_are_utf8_and_trimmed(spark):
    files = files_of(spark, ["if (strpos( $é , 'ü' ) === 0) {}"])
    (row,) = issues(files, only(35)).collect()
    assert row.before_code == "strpos($é, 'ü') === 0"
    assert row.after_code == "str_starts_with($é, 'ü')"


def test_studly_enum_case(spark):
    files = files_of(spark, ["const MAX_UPLOAD__SIZE = 'a';"])
    (row,) = issues(files, only(41)).collect()
    assert "case MaxUploadSize = 'a';" in row.after_code


def test_unreadable_file_gives_one_failure_row(spark):
    (row,) = issues(files_of(spark, {"a.php": None})).collect()
    assert (row.rule, row.severity, row.line, row.seq) == ("ANALYSIS_ERROR", "error", 0, 1)
    assert row.suggestion is None


def test_report_order(spark):
    """Standards, three static passes, style, layout, migration; by line within a pass."""
    text = (
        "<?php\n"
        "namespace A;\n"
        "\tclass B {\n"
        "    function f($a) {\n"
        "        echo $a; \n"
        "        foreach ($a->b as $c) { list($x) = $c; }\n"
    )
    rows = issues(files_of(spark, {"C.php": text})).orderBy("seq").collect()
    assert [(r.rule, r.line) for r in rows] == [
        ("PSR-1.side_effects", 1),
        ("PSR-2.indentation", 3), ("PSR-2.trailing_whitespace", 5), ("PSR-2.blank_lines", 1),
        ("PSR-4.class_name", 1), ("PSR-12.declare_strict", 1),
        ("PHPStan.undefined_variable", 5), ("PHPStan.null_safety", 6),
        ("PHPStan.missing_return_type", 4), ("PHPStan.missing_param_type", 4),
        ("PHPStan.deprecated_function", 6),
        ("CS-Fixer.indentation", 3), ("CS-Fixer.trailing_whitespace", 5),
        ("CodeSniffer.PSR12.indentation", 3), ("CodeSniffer.PSR12.class_brace", 3),
        ("CodeSniffer.PSR12.method_brace", 4), ("CodeSniffer.PSR12.trailing_whitespace", 5),
        ("CodeSniffer.PSR12.visibility", 5), ("CodeSniffer.PSR12.visibility", 6),
        ("PHP-8.4.readonly_class", 3), ("PHP-8.4.array_destructuring", 6),
    ]


def test_user_pack(spark):
    todo = Rule(100, 20, LINE, "info", "team.todo", "À faire", "Terminez", match(r"TODO"), ("TODO",))
    packs = register_pack(RulePack("team", (todo,)), DEFAULT_PACKS)
    rows = issues(files_of(spark, ["<?php\n// TODO x"]), packs).collect()
    assert [(r.rule, r.line) for r in rows if r.rule.startswith("team")] == [("team.todo", 2)]
    with pytest.raises(ValueError):
        register_pack(RulePack("again", (todo,)), packs)
