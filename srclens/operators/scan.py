"""The rule scan: files in, hits per file, issues out.

A file is one row, so everything that concerns one file is computed where that
row is: the text is split into lines inside the row, and a rule is a filter
over those lines.  Three questions can be asked - does any rule hit (stops
early), how often does each rule hit, and where - and issue rows, metrics,
status, compliance and nested reports are projections of the answers: no
shuffle anywhere on the way.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions.text import file_stem, to_utf8, up_to_last
from srclens.operators.catalog import DEFAULT_PACKS, all_rules, evaluated
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules.base import FALLBACK, FILE, LINE, FileText, Rule, RulePack, split_template

HIT_TYPE = "struct<step:int,line:int,number:int,captures:array<string>>"
ISSUE_COLUMNS = (
    "severity", "message", "line", "rule", "suggestion", "category", "php_version",
    "diff", "before_code", "after_code", "explanation",
)


def split_lines(text: Column) -> Column:
    """Cut at LF only; CR stays on its line and an empty tail is a line."""
    return F.split(text, "\n", -1)


def scan_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``file_id, line_no, line`` (byte view)."""
    return files.select("file_id", F.posexplode(split_lines(F.col("body"))).alias("pos", "line")).select(
        "file_id", (F.col("pos") + 1).alias("line_no"), "line")


SCRATCH = ("_lines", "_head", "_stem")


def prepared(files: DataFrame, packs: tuple[RulePack, ...]) -> DataFrame:
    """Adds what rules look at: the lines, shared tests of the whole text, and for
    file rules the head and the stem.

    What only one rule reads is merged into that rule's expression by the optimizer.
    """
    rules = all_rules(packs)
    body = F.col("body")
    added = {}
    if any(r.level == LINE for r in rules):
        added = {"_lines": split_lines(body), **{r.gate: r.in_file(body) for r in rules if r.gate}}
    if any(r.level == FILE for r in rules):
        added |= {"_head": _up_to_last_semicolon(body), "_stem": file_stem(F.col("stored_name"))}
    return files.withColumns(added) if added else files


def _without_scratch(df: DataFrame, packs: tuple[RulePack, ...], *more: str) -> DataFrame:
    return df.drop(*SCRATCH, *{r.gate for r in all_rules(packs) if r.gate}, *more)


def _up_to_last_semicolon(body: Column) -> Column:
    """Where the patterns that end in ';' can match at all."""
    wanted = F.contains(body, F.lit("namespace")) | F.contains(body, F.lit("use"))
    return F.when(wanted, up_to_last(body, ";")).when(body.isNotNull(), "")


def _file_text() -> FileText:
    return FileText(F.col("body"), F.col("_head"), F.col("_stem"))


def _if_possible(rule: Rule, value: Column, otherwise: Column) -> Column:
    """``value`` unless a cheap look at the whole text rules the rule out."""
    possible = rule.possible(F.col("body"))
    return value if possible is None else F.when(possible, value).otherwise(otherwise)


# ------------------------------------------------------------------ any, count, hits


# Columns are descriptions that any DataFrame can use, so each rule's are made once.


@lru_cache(maxsize=None)
def _any(rule: Rule) -> Column:
    if rule.level == FILE:
        return rule.hits(_file_text())
    if rule.level == LINE:
        return _if_possible(rule, F.exists(F.col("_lines"), rule.hits), F.lit(False))
    raise ValueError("fallback rules need the hits of their pack")


def any_hit(rules: list[Rule]) -> Column:
    """Whether any of the rules hits (stops at the first that does).

    To be used on a ``prepared`` DataFrame.  File rules come first: they are cheap.
    """
    test = F.lit(False)
    for rule in sorted(rules, key=lambda r: r.level != FILE):
        test = test | _any(rule)
    return test


@lru_cache(maxsize=None)
def _count(rule: Rule) -> Column:
    if rule.level == FILE:
        return F.when(rule.hits(_file_text()), 1).otherwise(0)
    matching = F.size(F.filter(F.col("_lines"), rule.hits))
    return _if_possible(rule, matching, F.lit(0))


def count_name(number: int) -> str:
    return f"n{number}"


def with_rule_counts(files: DataFrame, packs: tuple[RulePack, ...] = DEFAULT_PACKS) -> DataFrame:
    """``files`` plus one count column per rule (``n1``, ``n2``, ...).

    Counts are null for a file whose body is null.  Columns that nobody reads
    are pruned, and with them the work for their rules.
    """
    readable = F.col("body").isNotNull()
    counts = {count_name(r.number): F.when(readable, _count(r) if r in evaluated(p) else F.lit(0))
              for p in packs for r in p.rules if r.level != FALLBACK}
    out = _without_scratch(prepared(files, packs).withColumns(counts), packs)
    fallbacks = {}
    for pack in packs:
        others = [F.col(count_name(r.number)) for r in pack.rules if r.level != FALLBACK]
        for rule in pack.rules:
            if rule.level == FALLBACK:
                none = sum(others, F.lit(0)) == 0
                fallbacks[count_name(rule.number)] = F.when(none, 1).when(readable, 0)
    return out.withColumns(fallbacks) if fallbacks else out


def _hit(rule: Rule, line_no: Column, text) -> Column:
    if rule.captures is None:
        captures = F.lit(None).cast("array<string>")
    else:
        found = rule.captures(text)
        captures = F.transform(found if isinstance(found, Column) else F.array(*found), to_utf8)
    return F.struct(
        F.lit(rule.step).alias("step"), line_no.alias("line"),
        F.lit(rule.number).alias("number"), captures.alias("captures"))


@lru_cache(maxsize=None)
def _hits(rule: Rule) -> Column:
    none = F.array().cast(f"array<{HIT_TYPE}>")
    if rule.level == FILE:
        text = _file_text()
        return F.when(rule.hits(text), F.array(_hit(rule, F.lit(1), text))).otherwise(none)
    found = F.array_compact(F.transform(F.col("_lines"), lambda line, pos: F.when(
        rule.hits(line), _hit(rule, pos + 1, line))))
    return _if_possible(rule, found, none)


def with_hits(files: DataFrame, packs: tuple[RulePack, ...] = DEFAULT_PACKS) -> DataFrame:
    """``files`` plus ``hits``: one struct (step, line, number, captures) per issue.

    ``hits`` is null for a file whose body is null.
    """
    files = prepared(files, packs)
    found = {}
    for pack in packs:
        arrays = [_hits(r) for r in evaluated(pack) if r.level != FALLBACK]
        found[f"_hits_{pack.name}"] = F.concat(*arrays) if arrays else F.array().cast(f"array<{HIT_TYPE}>")
    out = files.withColumns(found)
    parts = []
    for pack in packs:
        column = F.col(f"_hits_{pack.name}")
        parts.append(column)
        stand_ins = [_hit(r, F.lit(1), None) for r in pack.rules if r.level == FALLBACK]
        if stand_ins:
            parts.append(F.when(F.size(column) == 0, F.array(*stand_ins)).otherwise(
                F.array().cast(f"array<{HIT_TYPE}>")))
    out = out.withColumn("hits", F.when(F.col("body").isNotNull(), F.concat(*parts)))
    return _without_scratch(out, packs, *found)


# ---------------------------------------------------------------- issue texts

FAILURE_NUMBER = 0
UNREADABLE = "contenu illisible"


def failure_hit(reason: Column) -> Column:
    """The single hit of a file that could not be read (line 0)."""
    return F.struct(
        F.lit(0).alias("step"), F.lit(0).alias("line"), F.lit(FAILURE_NUMBER).alias("number"),
        F.array(reason).alias("captures")).cast(HIT_TYPE)


def ordered_hits(hits: Column, reason: Column | None = None) -> Column:
    """Hits in report order; an unreadable file gets its failure row instead."""
    reason = F.lit(UNREADABLE) if reason is None else F.coalesce(reason, F.lit(UNREADABLE))
    return F.when(hits.isNull(), F.array(failure_hit(reason))).otherwise(F.sort_array(hits))


TEXT_FIELDS = ("severity", "rule", "message", "suggestion", "category", "php_version",
               "before_code", "after_code", "explanation")
TEMPLATES = ("message", "before_code", "after_code")


def _texts(packs: tuple[RulePack, ...]) -> dict[int, dict[str, str | None]]:
    severity, name, message = fixed.ANALYSIS_ERROR
    failure = {"severity": severity, "rule": name, "message": message + "<1>"}
    table = {FAILURE_NUMBER: {f: failure.get(f) for f in TEXT_FIELDS}}
    for rule in all_rules(packs):
        table[rule.number] = {f: getattr(rule, f) for f in TEXT_FIELDS}
    return table


def _text_table(texts: dict[int, dict[str, str | None]]) -> Column:
    """The texts as one constant array, indexed by rule number.

    Its size is the number of rules; the optimizer folds it to a literal.
    Templates are also there cut up, as pieces and the capture after each piece.
    """
    rows = []
    for number in range(max(texts) + 1):
        row = dict(texts.get(number, {}))
        for f in TEMPLATES:
            row[f"{f}_pieces"], row[f"{f}_slots"] = split_template(row.get(f)) or (None, None)
        rows.append(row)
    fields = [f"{f}:string" for f in TEXT_FIELDS]
    fields += [f"{f}_pieces:array<string>,{f}_slots:array<int>" for f in TEMPLATES]
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{','.join(fields)}>>")


@lru_cache(maxsize=64)
def _issue_columns(packs: tuple[RulePack, ...]) -> tuple[Column, ...]:
    """The issue columns over a column named ``hit``."""
    return tuple(_issue_fields(F.col("hit"), packs).values())


@lru_cache(maxsize=64)
def rendered_issues(packs: tuple[RulePack, ...]) -> Column:
    """The array column ``hits`` with every hit turned into an issue struct."""
    return F.transform(F.col("hits"), lambda h: F.struct(*_issue_fields(h, packs).values()))


def _issue_fields(hit: Column, packs: tuple[RulePack, ...]) -> dict[str, Column]:
    """Every issue column as an expression over one hit."""
    captures = hit["captures"]
    text = F.get(_text_table(_texts(packs)), hit["number"])

    def filled(field: str) -> Column:
        def with_capture(piece: Column, slot: Column) -> Column:
            return F.concat(piece, F.coalesce(F.get(captures, slot - 1), F.lit("")))

        pieces = F.zip_with(text[f"{field}_pieces"], text[f"{field}_slots"], with_capture)
        return F.when(captures.isNull(), text[field]).otherwise(F.array_join(pieces, ""))

    fields = {f: filled(f) if f in TEMPLATES else text[f] for f in TEXT_FIELDS}
    fields["line"] = hit["line"].cast("long")
    fields["diff"] = F.lit(None).cast("string")
    return {name: fields[name].alias(name) for name in ISSUE_COLUMNS}


def kept_columns(files: DataFrame) -> tuple[str, ...]:
    """What issue rows carry of their file: its id, and its place in the input where it has one."""
    return tuple(c for c in ("file_id", "ordinal") if c in files.columns)


def issues_of(scanned: DataFrame, packs: tuple[RulePack, ...] = DEFAULT_PACKS, *keep: str,
              failures: bool = True) -> DataFrame:
    """Issue rows of files that carry their ``hits`` (from ``with_hits`` or a stored scan).

    Without ``failures`` unreadable files give no row.
    """
    keep = keep or kept_columns(scanned)
    reason = F.col("error") if failures and "error" in scanned.columns else None
    # Exploding an expression (not the bare column) keeps the optimizer from
    # adding a size filter below, which would evaluate every rule a second time.
    ordered = ordered_hits(F.col("hits"), reason) if failures else F.sort_array("hits")
    hits = scanned.select(*keep, F.posexplode(ordered).alias("pos", "hit"))
    return hits.select(*keep, (F.col("pos") + 1).alias("seq"), *_issue_columns(packs))


def issue_fields(packs: tuple[RulePack, ...]) -> tuple[Column, ...]:
    """The issue columns over a column named ``hit``."""
    return _issue_columns(packs)


def issues(files: DataFrame, packs: tuple[RulePack, ...] = DEFAULT_PACKS, *keep: str,
           failures: bool = True) -> DataFrame:
    """The flat issue table: one row per issue, ``seq`` is the report order within a file."""
    return issues_of(with_hits(files, packs), packs, *keep, failures=failures)


def issue_rows(files: DataFrame, packs: tuple[RulePack, ...] = DEFAULT_PACKS, *keep: str,
               failures: bool = True) -> DataFrame:
    """The issues as a stream of rows: ``step`` and ``number`` with the issue columns.

    The report order within a file is (step, line, number).
    """
    keep = keep or kept_columns(files)
    hits = hit_rows(files, packs, *keep, failures=failures)
    return hits.select(*keep, "hit.step", "hit.number", *_issue_columns(packs))


LINES_MARK = -1  # the number of a row that is no hit: its line is how many lines there are


def hit_rows(files: DataFrame, packs: tuple[RulePack, ...], *keep: str, failures: bool = True,
             mark_lines: bool = False) -> DataFrame:
    """Columns to keep and ``hit``, one row per hit.

    The lines are exploded before they are judged, so a row holds at most one hit
    per rule and memory does not grow with the hits of a file, whatever its size.
    """
    reason = F.lit(UNREADABLE)
    if "error" in files.columns:
        reason = F.coalesce(F.col("error"), reason)
    ready = prepared(files, packs)
    rules = [r for p in packs for r in evaluated(p)]
    text = _file_text()
    whole = [F.when(r.hits(text), _hit(r, F.lit(1), text)) for r in rules if r.level == FILE]
    if mark_lines:
        whole.append(F.struct(F.lit(LINES_MARK).alias("step"), F.size("_lines").alias("line"),
                              F.lit(LINES_MARK).alias("number"), F.lit(None).cast("array<string>").alias("captures")))
    for pack in packs:
        others = [r for r in evaluated(pack) if r.level != FALLBACK]
        whole += [F.when(~any_hit(others), _hit(r, F.lit(1), None)) for r in pack.rules if r.level == FALLBACK]
    none = F.array().cast(f"array<{HIT_TYPE}>")
    of_file = F.when(F.col("body").isNotNull(), F.array_compact(F.array(*whole)) if whole else none).otherwise(
        F.array(failure_hit(reason)) if failures else none)
    line_rules = [r for r in rules if r.level == LINE]
    gates = {r: r.possible(F.col("body")) for r in line_rules}
    ready = ready.select(
        *keep, *[F.coalesce(g, F.lit(False)).alias(f"_may_{r.number}") for r, g in gates.items() if g is not None],
        of_file.alias("_of_file"), *(["_lines"] if line_rules else []))
    # The hits of the file travel as the first element, not beside every line.
    first = F.array(F.struct(F.lit(None).cast("string").alias("line"), F.col("_of_file").alias("hits")))
    pieces = first
    if line_rules:
        lines = F.transform(F.col("_lines"), lambda x: F.struct(x.alias("line"), F.lit(None).cast(f"array<{HIT_TYPE}>").alias("hits")))
        pieces = F.coalesce(F.concat(first, lines), first)
    may = [f"_may_{r.number}" for r, g in gates.items() if g is not None]
    rows = ready.select(*keep, *may, F.posexplode(pieces).alias("pos", "piece")).select(
        *keep, *may, "pos", F.col("piece.line").alias("line"), F.col("piece.hits").alias("hits"))

    def one(rule: Rule) -> Column:
        test = rule.hits(F.col("line"))
        if gates[rule] is not None:
            test = F.col(f"_may_{rule.number}") & test
        return F.when(test, _hit(rule, F.col("pos"), F.col("line")))

    found = F.array_compact(F.array(*[one(r) for r in line_rules])) if line_rules else none
    return rows.select(*keep, F.explode(F.when(F.col("pos") == 0, F.col("hits")).otherwise(found)).alias("hit"))


def failed_files(files: DataFrame, packs: tuple[RulePack, ...] = DEFAULT_PACKS) -> DataFrame:
    """Failure rows of unreadable files: one for the file, one per analyzer that reports its own."""
    reason = F.coalesce(F.col("error"), F.lit(UNREADABLE)) if "error" in files.columns else F.lit(UNREADABLE)
    severity, rule, message = fixed.ANALYSIS_ERROR

    def row(analyzer, sev, name, line, text, suggestion):
        text = F.concat(F.lit(text), reason) if text.endswith(": ") else F.lit(text)
        return F.struct(
            F.lit(analyzer).alias("analyzer"), F.lit(sev).alias("severity"), text.alias("message"),
            F.lit(line).cast("long").alias("line"), F.lit(name).alias("rule"),
            F.lit(suggestion).cast("string").alias("suggestion"))

    rows = [row("run", severity, rule, 0, message, None)]
    for pack in packs:
        if pack.name in fixed.ANALYZER_ERRORS:
            sev, name, line, text, suggestion = fixed.ANALYZER_ERRORS[pack.name]
            rows.append(row(pack.name, sev, name, line, text, suggestion))
    return files.where(F.col("body").isNull()).select(
        "file_id", "original_name", F.explode(F.array(*rows)).alias("r")
    ).select("file_id", "original_name", "r.*")
