"""Rules 1-13: the four graded standards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srclens.functions.text import SPACE_CHARS, byte_view, ends_in_space, has, rtrimmed, rx
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules.base import FILE, LINE, FileText, Rule, RulePack

MODIFIERS = ("public", "private", "protected")


def has_namespace(f: FileText) -> Column:
    # Every match ends in ';', so looking up to the last one is enough and keeps
    # the search linear on texts with a long tail.
    return has(f.head, "namespace") & F.rlike(f.head, rx(r"namespace\s+([^;]+);"))


def class_name(f: FileText) -> Column:
    return F.regexp_extract(f.body, "(?d)" + fixed.CAPTURE_PATTERNS[10], 1)


def too_long(line: Column) -> Column:
    # octet_length is free and never below the byte count, so short lines stop here.
    limit = fixed.MAX_LINE_BYTES
    return (F.octet_length(line) > limit) & (trimmed_length(line) > limit)


def trimmed_length(line: Column) -> Column:
    return F.length(F.when(ends_in_space(line) | F.endswith(line, F.lit("\x00")),
                           rtrimmed(line)).otherwise(line))


def any_too_long(body: Column) -> Column:
    return F.octet_length(body) > fixed.MAX_LINE_BYTES


def any_tab(body: Column) -> Column:
    return has(body, "\t")


def starts_with_tab(line: Column) -> Column:
    return F.startswith(line, F.lit("\t"))


def any_space_before_end(body: Column) -> Column:
    """Whitespace right before some line end."""
    test = ends_in_space(body)
    for ch in SPACE_CHARS:
        if ch != "\n":
            test = test | has(body, ch + "\n")
    return test


def line_bytes(line: Column) -> list[Column]:
    return [trimmed_length(line).cast("string")]


def _missing_blank_line(f: FileText) -> Column:
    """A namespace declaration whose ';' is not followed by a blank line.

    Declarations that end in one ';' share what follows it, so the text is judged
    piece by piece.
    """
    pieces = F.split(f.body, ";", -1)
    bare = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, q: (
        q.isNotNull() & has(p, "namespace") & F.rlike(p, rx(r"namespace\s[\s\S]"))
        & ~F.coalesce(F.rlike(q, rx(r"^\s*\n\s*\n")), F.lit(False))))
    return has_namespace(f) & F.exists(bare, lambda hit: hit)


def _wrong_class_name(f: FileText) -> Column:
    name = class_name(f)
    return has(f.body, "class") & has_namespace(f) & (name != "") & (name != f.stem)


def _unsorted_imports(f: FileText) -> Column:
    uses = F.regexp_extract_all(f.head, rx(r"use\s+([^;]+);"), F.lit(1))
    return has(f.head, "use") & (F.size(uses) > 1) & (F.sort_array(uses) != uses)


def _missing_visibility(f: FileText) -> Column:
    # One pattern per leading word: a literal start is found far faster than an
    # alternation, and no two of these patterns can overlap in a text.
    def count(pattern: str) -> Column:
        return F.regexp_count(f.body, rx(pattern))

    gate = F.lit(False)
    for word in MODIFIERS:
        gate = gate | (has(f.body, word) & F.rlike(
            f.body, rx(word + r"\s+(?:static\s+)?(?:\$\w|function)")))
    declared = sum((count(word + r"\s+") for word in MODIFIERS), F.lit(0))
    members = count(r"function\s+\w+") + count(r"\$\w+\s*[=;]")
    return gate & (declared < members)


def _rule(number, step, level, when, **more) -> Rule:
    severity, rule, message, suggestion = fixed.TEXTS[number]
    return Rule(number, step, level, severity, rule, message, suggestion, when, **more)


PACK = RulePack("psr", (
    _rule(1, 1, FILE, lambda f: ~F.startswith(f.body, F.lit("<?php"))),
    _rule(2, 1, FILE, lambda f: has(f.body, "<?") & F.rlike(f.body, rx(r"<\?(?!php|=)"))),
    _rule(3, 1, FILE, lambda f: F.startswith(f.body, F.lit("ï»¿"))),
    _rule(4, 1, FILE, lambda f: has(f.body, "echo") | has(f.body, "print")),
    _rule(5, 2, LINE, starts_with_tab, in_file=any_tab),
    _rule(6, 2, LINE, too_long, captures=line_bytes, in_file=any_too_long),
    _rule(7, 2, LINE, ends_in_space, in_file=any_space_before_end),
    _rule(8, 3, FILE, _missing_blank_line),
    _rule(9, 4, FILE, lambda f: ~has_namespace(f)),
    _rule(10, 4, FILE, _wrong_class_name,
          captures=lambda f: [class_name(f), byte_view(f.stem)]),
    _rule(11, 5, FILE,
          lambda f: ~F.rlike(f.body, rx(r"declare\s*\(\s*strict_types\s*=\s*1\s*\)"))),
    _rule(12, 5, FILE, _unsorted_imports),
    _rule(13, 5, FILE, _missing_visibility),
))
