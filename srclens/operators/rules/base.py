"""What a rule is: a number, a place in the report order, texts and Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from srclens.functions.text import has, rx

FILE, LINE, FALLBACK = "file", "line", "fallback"


@dataclass(frozen=True)
class FileText:
    """What file rules look at: the whole byte view, the part up to the last
    ';', and the file name without extension."""

    body: Column
    head: Column
    stem: Column


Predicate = Callable[..., Column]
Captures = Callable[..., list[Column] | Column]  # the Columns, or one array of them


@dataclass(frozen=True)
class Rule:
    """One check.

    ``when`` maps the byte view of a line (for file rules a ``FileText``) to a
    boolean Column.  ``needs`` are literals that every hit on a line contains;
    they are tested first because a byte search is far cheaper than a regex.
    ``in_file`` is a test of the whole text that holds whenever any line hits;
    without it the longest needed literal serves.  Rules with the same
    ``in_file`` function share its result.
    ``step`` is the place of the pass the rule belongs to: issues of a file are
    ordered by (step, line, number).  A fallback rule fires once for a file in
    which no other rule of its pack hits.
    """

    number: int
    step: int
    level: str
    severity: str
    rule: str
    message: str
    suggestion: str
    when: Predicate
    needs: tuple[str, ...] = ()
    captures: Captures | None = None
    in_file: Predicate | None = None
    category: str | None = None
    php_version: str | None = None
    before_code: str | None = None
    after_code: str | None = None
    explanation: str | None = None
    reachable: bool = True

    def hits(self, text) -> Column:
        """Predicate behind its literal pre-tests."""
        test = self.when(text)
        if self.level == LINE:
            for literal in reversed(self.needs):
                test = has(text, literal) & test
        return test

    @property
    def gate(self) -> str | None:
        """Name of the column with the ``in_file`` test, which rules may share."""
        return f"_gate_{self.in_file.__name__}" if self.in_file else None

    def possible(self, body: Column) -> Column | None:
        """Cheap test of the whole text: false means that no line can hit."""
        if self.in_file is not None:
            return F.col(self.gate)
        literal = max(self.needs, key=len, default="")
        return has(body, literal) if len(literal) > 1 else None

    @property
    def query_name(self) -> str:
        key = self.rule.split(".")[-1].lower()
        return f"r{self.number:02d}_{key}"


@dataclass(frozen=True)
class RulePack:
    """Rules of one analyzer, in report order."""

    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def match(pattern: str) -> Predicate:
    return lambda text: F.rlike(text, rx(pattern))


def match_without(pattern: str, unwanted: str) -> Predicate:
    return lambda text: F.rlike(text, rx(pattern)) & ~F.rlike(text, rx(unwanted))


def across(text: Column, separator: str, before: str, after: str) -> Column:
    """Whether ``before`` occurs in a piece and the next piece starts with ``after``.

    For patterns like ``x[^)]*\\)y``: all starts in front of one separator share it,
    so pieces can be judged one by one, in time linear in the text.
    """
    pieces = F.split(text, separator, -1)
    fits = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, q: (
        F.coalesce(F.rlike(q, rx("^" + after)), F.lit(False)) & F.rlike(p, rx(before))))
    return F.exists(fits, lambda fit: fit)


def groups(pattern: str, count: int) -> Captures:
    """The first ``count`` groups of the first match."""
    return lambda text: [
        F.regexp_extract(text, "(?d)" + pattern, i + 1) for i in range(count)
    ]


def split_template(template: str | None) -> tuple[list[str], list[int]] | None:
    """'a <1> b' -> text pieces and the capture that follows each (0 = none)."""
    if template is None:
        return None
    pieces = re.split(r"<(\d)>", template)
    slots = [int(s) for s in pieces[1::2]] + [0]
    return pieces[0::2], slots
