"""Rules 33-49: migration hints with before/after previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srclens.functions.text import has, rx, studly, trimmed, up_to_last
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules.base import FALLBACK, LINE, Rule, RulePack, across, groups, match
from srclens.operators.rules.calls import own_end, short_or_long, two_arguments

P = fixed.CAPTURE_PATTERNS

# For lines of ordinary length (``short_or_long``).  Arguments with their blanks taken
# once: text up to the delimiter without leading blanks or, where all is blank, its last blank.
_FIRST = r"(?:\s*+([^,\s][^,]*+)|\s*(\s))"
_SECOND = r"(?:\s*+([^)\s][^)]*+)|\s*(\s))"
STRPOS = rf"strpos\s*+\({_FIRST},{_SECOND}\)\s*+"
SUBSTR = rf"substr\s*+\({_FIRST},\s*+-strlen\s*+\("
SUBSTR_ENDS = (
    SUBSTR + r"\s*+([^)\s]++(?:\s++[^)\s]++)*+)\s*+\)\s*+\)\s*+===\s*+\3",
    SUBSTR + r"\s*(\s)\s*\)\s*+\)\s*+===\s*\3",
)


def _two_arguments(pattern: str):
    """Trimmed arguments; each is in one of two groups, the other one is empty."""
    def captures(line: Column) -> list[Column]:
        a, b, c, d = groups(pattern, 4)(line)
        return [trimmed(F.concat(a, b)), trimmed(F.concat(c, d))]

    return captures


def _ends_with(line: Column) -> Column:
    return F.rlike(line, rx(SUBSTR_ENDS[0])) | F.rlike(line, rx(SUBSTR_ENDS[1]))


def _ends_with_arguments(line: Column) -> list[Column]:
    plain, blank = (groups(p, 3)(line) for p in SUBSTR_ENDS)
    at, other = (F.regexp_instr(line, rx(p)) for p in SUBSTR_ENDS)
    found = (at > 0) & ((other == 0) | (at < other))  # the one further left
    return [trimmed(F.when(found, F.concat(plain[0], plain[1])).otherwise(F.concat(blank[0], blank[1]))),
            trimmed(F.when(found, plain[2]).otherwise(blank[2]))]


NOT_FALSE, ZERO = r"!==\s*+false", r"===\s*+0"
CONTAINS, STARTS = (
    short_or_long((match(STRPOS + tail), _two_arguments(STRPOS + tail)), two_arguments("strpos", r"\s*+" + tail))
    for tail in (NOT_FALSE, ZERO))
ENDS = short_or_long((_ends_with, _ends_with_arguments), own_end("substr"))


def _many_arguments(line: Column) -> Column:
    """The first call with two or more commas before its ')' is no control structure.

    Calls that lie between the same two ')' share the closing one, so such a piece
    qualifies if a call opens before its last but one comma, and the first of the
    calls is the match.  Each character is looked at a fixed number of times.
    """
    def first_call(piece: Column) -> Column:
        tail = F.substring_index(piece, ",", -2)
        front = F.substring(piece, F.lit(1), F.length(piece) - F.length(tail))
        return F.regexp_extract(front, r"(?<!\w)(\w++)\s*+\(", 1)

    pieces = F.split(up_to_last(line, ")"), r"\)", -1)
    calls = F.filter(F.transform(pieces, first_call), lambda name: name != "")
    return ~F.coalesce(F.get(calls, F.lit(0)), F.lit("")).isin("", *fixed.NOT_FUNCTIONS)


def _constructor_parameter(line: Column) -> Column:
    """A constructor opens before the last variable in front of a ')'."""
    def declares(piece: Column) -> Column:
        front = F.regexp_extract(piece, r"(?d)^(.*)\$\w", 1)
        return F.rlike(front, rx(r"function\s++__construct\s*+\("))

    return F.exists(F.split(up_to_last(line, ")"), r"\)", -1), declares)


def _switch(line: Column) -> Column:
    return F.rlike(up_to_last(line, ")"), rx(r"switch\s*\(\s*[^)]++\)"))


def _plain_property(line: Column) -> Column:
    modifier = has(line, "public") | has(line, "private") | has(line, "protected")
    return modifier & ~has(line, "readonly") & across(
        line, r"\$", r"(?:private|protected|public)\s", r"\w+\s*;")


def _async_word(line: Column) -> Column:
    """async, promise, curl_multi_ or curl_exec..curl_close, in any case."""
    return _in_lower_case(line, lambda low: (
        has(low, "async") | has(low, "promise") | has(low, "curl_multi_")
        | (has(low, "curl_exec") & has(_after_first(low, "curl_exec"), "curl_close"))))


def _after_first(text: Column, literal: str) -> Column:
    return F.substring(text, F.instr(text, literal) + len(literal), F.length(text))


def any_async_word(body: Column) -> Column:
    return _in_lower_case(body, lambda low: has(low, "async") | has(low, "promise") | has(low, "curl_"))


def _in_lower_case(text: Column, test) -> Column:
    """``test`` of the lower-cased text, which is made only once."""
    return F.exists(F.array(F.lower(text)), test)


def _trimmed_groups(pattern: str, count: int):
    return lambda line: [trimmed(c) for c in groups(pattern, count)(line)]


def _union_param(line: Column) -> Column:
    return has(F.regexp_extract(line, "(?d)" + P[39], 1), "|")


def _const_captures(line: Column) -> list[Column]:
    name, value = groups(P[41], 2)(line)
    return [name, value, studly(name)]


def _rule(number, when, *needs, level=LINE, captures=None, in_file=None) -> Rule:
    key, message, suggestion, before, after, explanation = fixed.MIGRATION_TEXTS[number]
    return Rule(
        number, 12 if level == FALLBACK else 11, level, "info",
        f"PHP-{fixed.PHP_VERSION}.{key}", message, suggestion, when, needs, captures, in_file,
        fixed.MIGRATION, fixed.PHP_VERSION, before, after, explanation,
    )


PACK = RulePack("migration", (
    _rule(33, match(P[33]), "array_keys", "===", "(", captures=groups(P[33], 1)),
    _rule(34, CONTAINS[0], "strpos", "!==", "(", captures=CONTAINS[1]),
    _rule(35, STARTS[0], "strpos", "===", "(", captures=STARTS[1]),
    _rule(36, ENDS[0], "substr", "-strlen", "(", captures=ENDS[1]),
    _rule(37, _switch, "switch", "(", captures=_trimmed_groups(P[37], 1)),
    _rule(38, _plain_property, "$", ";",
          captures=groups(P[38], 2)),
    _rule(39, _union_param, "@param", "|", captures=groups(P[39], 2)),
    _rule(40, match(P[40]), "@param", "|null", captures=groups(P[40], 2)),
    _rule(41, match(P[41]), "const", "=", captures=_const_captures),
    _rule(42, _async_word, in_file=any_async_word),
    _rule(43, match(P[43]), "array", "(", captures=groups(P[43], 2)),
    _rule(44, match(P[44]), "call_user_func", "(", captures=groups(P[44], 2)),
    _rule(45, _constructor_parameter, "__construct", "$", "("),
    _rule(46, _many_arguments, ",", "(", ")"),
    _rule(47, match(r"list\s*\("), "list", "("),
    _rule(48, lambda l: F.rlike(l, rx(P[48])) & ~F.rlike(l, rx(r"readonly\s+class")),
          "class", captures=groups(P[48], 1)),
    # Stands in when no other rule of the pack hits the file.
    _rule(49, lambda f: F.lit(True), level=FALLBACK),
))
