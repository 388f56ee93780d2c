"""Rules 15-20: simple static checks, three passes over the lines."""

from __future__ import annotations

from srclens.functions.text import has
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules.base import LINE, Rule, RulePack, across, match, match_without


def _rule(number, step, when, *needs) -> Rule:
    severity, rule, message, suggestion = fixed.TEXTS[number]
    return Rule(number, step, LINE, severity, rule, message, suggestion, when, needs)


def _shows_variable(line):
    shown = has(line, "echo") | has(line, "print")
    return shown & match(r"(?:echo|print)\s+\$\w+")(line) & match(r"\$[a-zA-Z_]")(line)


def _no_return_type(line):
    function = r"function\s+\w+\s*\("
    return across(line, r"\)", function, r"\s*\{") & ~across(line, r"\)", function, r"\s*:\s*\w")


PACK = RulePack("static", (
    # 'echo $1' does not count on its own: the line also needs a well-formed
    # variable name somewhere.
    _rule(15, 6, _shows_variable, "$"),
    _rule(16, 6, match(r"\$\w+->\w+"), "->", "$"),
    _rule(17, 7, _no_return_type, "function", "{", "(", ")"),
    _rule(18, 7, match_without(r"function\s+\w+\s*\(\s*\$\w+",
                               r"function\s+\w+\s*\(\s*\w+\s+\$\w+"), "function", "$", "("),
    _rule(19, 8, match(r"create_function\s*\("), "create_function", "("),
    _rule(20, 8, match(r"each\s*\("), "each", "("),
))
