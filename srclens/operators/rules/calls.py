"""Calls with two arguments, found in time linear in the line.

A byte view has no character above U+00FF, so characters beyond it are free as
marks.  Calls whose first arguments end at the same comma share that comma, and
commas before the same ')' share that ')'.  So each comma gets, once, the argument
of the first call in front of it, each piece between two ')' is judged once, and
no call has to look for its delimiters itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from srclens.functions.text import SPACE_CHARS, has, rx, trimmed, up_to_last
from srclens.operators.rules.base import across

# A marked comma is MARK, the argument with PAREN for ')', END.
MARK, END, PAREN = "Ā", "ā", "Ă"
# In front of a second argument that opens with -strlen( : OPEN, the first argument, CLOSE.
OPEN, CLOSE = "ă", "Ą"
MARKED = rf"{MARK}([^{END}]*+){END}"
LENGTH = r"(\s*+-strlen\s*+\()"
SPACES = "".join(SPACE_CHARS)

#: Lines up to this length are matched by the plain pattern, which then looks at most
#: at the square of it; both forms give the same hits and captures.
SHORT = 400


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def short_or_long(short, long):
    """(predicate, captures) of two forms of a rule, chosen by the length of the line."""
    def when(line: Column) -> Column:
        return F.when(F.length(line) <= SHORT, short[0](line)).otherwise(long[0](line))

    def captures(line: Column) -> Column:
        return F.when(F.length(line) <= SHORT, F.array(*short[1](line))).otherwise(long[1](line))

    return when, captures


def _marked(line: Column, call: str) -> Column:
    """The line with every comma marked that ends the first argument of a ``call``."""
    def close(piece: Column) -> Column:
        return bound(F.regexp_extract(piece, rf"(?d){call}\s*+\((.+)", 1), lambda argument: F.when(
            argument == "", F.concat(piece, F.lit(","))).otherwise(F.concat(
                piece, F.lit(MARK), F.replace(argument, F.lit(")"), F.lit(PAREN)), F.lit(END))))

    tail = F.substring_index(line, ",", -1)
    front = F.split(up_to_last(line, ","), ",", -1)  # its last piece is empty
    return F.concat(F.array_join(F.transform(F.slice(front, F.lit(1), F.size(front) - 1), close), ""), tail)


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, ",")


def _shown(argument: Column) -> Column:
    """The argument without leading blanks (all blank: its last blank), trimmed."""
    return F.when(F.rlike(argument, rx(r"\S")), trimmed(F.ltrim(argument, F.lit(SPACES)))).otherwise(
        trimmed(F.substring(argument, -1, 1)))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def two_arguments(call: str, after: str):
    """Predicate and captures of ``call(a, b)`` followed by ``after``.

    ``a`` ends at the next comma and ``b`` at the next ')' behind it; both are not
    empty.  Of several calls the leftmost counts.
    """
    def when(line: Column) -> Column:
        return across(_marked(line, call), r"\)", f"{END}.", after)

    def captures(line: Column) -> Column:
        def piece(pieces: Column) -> Column:
            return _first(F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, q: F.when(
                F.coalesce(F.rlike(q, rx("^" + after)), F.lit(False)) & F.rlike(p, rx(f"{END}.")), p)))

        def shown(found: Column) -> Column:
            a, b = (F.regexp_extract(found, rf"(?d){MARKED}(.+)", i) for i in (1, 2))
            return F.transform(F.array(F.replace(a, F.lit(PAREN), F.lit(")")), _unmarked(b)), _shown)

        return bound(bound(F.split(_marked(line, call), r"\)", -1), piece), shown)

    return when, captures


def _own_end(piece: Column, rest: Column) -> Column:
    """(a, b) of the first ``call(a, -strlen(b)) === b``, null without one.

    ``piece`` ends in b, ``rest`` is what follows ===.  A b that ``rest`` starts
    with is no longer than ``rest``, so only the end of ``piece`` is looked at.
    """
    split = F.regexp_replace(piece, MARKED + LENGTH, f",$2{OPEN}$1{CLOSE}")
    parts = F.split(_unmarked(split), OPEN, -1)

    def judge(parts: Column) -> Column:
        arguments = F.transform(parts, lambda p: F.replace(F.substring_index(p, CLOSE, 1), F.lit(PAREN), F.lit(")")))
        texts = F.array_join(F.transform(parts, lambda p: F.substring_index(p, CLOSE, -1)), OPEN)
        after = F.ltrim(rest, F.lit(SPACES))
        blank = F.substring(rest, F.lit(1), F.length(rest) - F.length(after))

        def inner(text: Column) -> Column:
            whole = F.rtrim(text, F.lit(SPACES))
            # A -strlen( has eight characters, so marks at most double a b.
            room = 2 * F.length(after) + F.length(rest) + 2
            near = F.substring(whole, F.greatest(F.length(whole) - room, F.lit(0)) + 1, F.length(whole))
            return bound(F.split(near, OPEN, -1), lambda ends: F.transform(
                F.sequence(F.lit(2), F.greatest(F.size(ends), F.lit(2))), lambda i: bound(
                    F.ltrim(F.array_join(F.slice(ends, i, F.size(ends)), ""), F.lit(SPACES)), lambda b: F.when(
                        (b != "") & (i <= F.size(ends)) & F.startswith(after, b),
                        F.struct(F.get(arguments, F.size(parts) - F.size(ends) + i - 1).alias("a"), b.alias("b"))))))

        def empty(last: Column) -> Column:
            """An all blank b: the last of its blanks that also follows ===."""
            seen = F.array(*(F.when(has(last, c) & has(blank, c), F.struct(
                (-F.length(F.substring_index(last, c, -1))).alias("place"), F.lit(c).alias("b"))) for c in SPACE_CHARS))
            best = F.array_max(seen)
            return F.when((F.trim(last, F.lit(SPACES)) == "") & best.isNotNull(), F.struct(
                F.element_at(arguments, -1).alias("a"), best["b"].alias("b")))

        last = F.substring_index(F.element_at(parts, -1), CLOSE, -1)
        return F.coalesce(_first(bound(texts, inner)), F.when(F.size(parts) > 1, empty(last)))

    return bound(parts, judge)


def own_end(call: str):
    """Predicate and captures of ``call(a, -strlen(b)) === b``."""
    def found(line: Column) -> Column:
        def each(pieces: Column) -> Column:
            def judge(p: Column, i: Column) -> Column:
                middle, rest = F.get(pieces, i + 1), F.get(pieces, i + 2)
                fits = (F.rlike(rest, rx(r"^\s*+===")) & (F.trim(middle, F.lit(SPACES)) == "")
                        & F.rlike(p, rx(END + LENGTH)))
                return F.when(F.coalesce(fits, F.lit(False)), _own_end(
                    p, F.regexp_replace(_unmarked(rest), r"^\s*+===", "")))

            return _first(F.transform(pieces, judge))

        return bound(F.split(_marked(line, call), r"\)", -1), each)

    return (lambda line: found(line).isNotNull()), (
        lambda line: bound(found(line), lambda f: F.array(_shown(f["a"]), trimmed(f["b"]))))
