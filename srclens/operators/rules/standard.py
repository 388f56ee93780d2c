"""Rules 26-32: line checks of the layout standard."""

from __future__ import annotations

from pyspark.sql import functions as F

from srclens.functions.text import is_blank, rx, trimmed
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules.base import LINE, Rule, RulePack, match_without
from srclens.operators.rules.psr import any_space_before_end, any_tab, any_too_long, line_bytes, too_long
from srclens.operators.rules.style import trailing_space_after_code


def _odd_indent(line):
    # A leading run of whitespace without tabs whose length is not a multiple of 4.
    # Lines of code start with a space; the other indent characters are rare.
    indented = F.startswith(line, F.lit(" ")) | F.rlike(line, rx(r"^[\x0B\f\r]"))
    odd = F.rlike(line, rx(r"^(?:[ \x0B\f\r]{4})*+[ \x0B\f\r]{1,3}(?!\s)"))
    return indented & odd & ~is_blank(trimmed(line))


def _opening_brace_after(pattern):
    # The cheap last-character test comes first; '.*' then never backtracks far.
    def when(line):
        t = trimmed(line)
        return F.endswith(t, F.lit("{")) & F.rlike(t, rx(pattern))

    return when


def _rule(number, when, *needs, **more) -> Rule:
    severity, rule, message, suggestion = fixed.TEXTS[number]
    return Rule(number, 10, LINE, severity, rule, message, suggestion, when, needs, **more)


PACK = RulePack("standard", (
    _rule(26, too_long, captures=line_bytes, in_file=any_too_long),
    _rule(27, lambda l: F.rlike(l, rx(r"^\s*\t")), "\t", in_file=any_tab),
    _rule(28, _odd_indent),
    _rule(29, trailing_space_after_code, in_file=any_space_before_end),
    _rule(30, _opening_brace_after(r"^(class|interface|trait)\s+\w+.*\{$"), "{"),
    _rule(31, _opening_brace_after(r"function\s+\w+.*\{$"), "function", "{"),
    _rule(32, lambda l: F.rlike(l, rx(r"\$\w+\s*;"))
          & ~F.rlike(l, rx(r"(public|private|protected)\s+")), "$", ";"),
))
