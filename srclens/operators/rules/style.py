"""Rules 21-25: style fixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srclens.functions.text import ends_in_space, has, is_blank, trimmed
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules.base import LINE, Rule, RulePack, match, match_without
from srclens.operators.rules.psr import any_space_before_end, any_tab, starts_with_tab


def trailing_space_after_code(line):
    return ends_in_space(line) & ~is_blank(trimmed(line))


def _quoted_without_variable(line: Column) -> Column:
    """Some text between two quotes is plain, and none has a '$'.

    No match of either pattern reaches beyond the next quote, so the pieces between
    neighbouring quotes decide.
    """
    pieces = F.split(line, '"', -1)
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    plain = F.exists(inner, lambda p: ~has(p, "$") & ~has(p, "\\"))
    return plain & ~F.exists(inner, lambda p: has(p, "$"))


def _rule(number, when, *needs, **more) -> Rule:
    severity, rule, message, suggestion = fixed.TEXTS[number]
    return Rule(number, 9, LINE, severity, rule, message, suggestion, when, needs, **more)


PACK = RulePack("style", (
    _rule(21, trailing_space_after_code, in_file=any_space_before_end),
    _rule(22, starts_with_tab, in_file=any_tab),
    # The second pattern matches wherever the first does: the rule never fires.
    _rule(23, match_without(r"\$\w+=[^=]", r"\$\w+\s*=\s*"), "$", "=", reachable=False),
    _rule(24, match(r"array\s*\("), "array", "("),
    _rule(25, _quoted_without_variable, '"'),
))
