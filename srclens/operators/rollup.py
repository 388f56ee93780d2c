"""Roll-ups of issues per file and per run.

Per-file roll-ups add up the rule counts that a file's row carries, so they
need no shuffle, and counts nobody asks for are pruned away.  Run-wide roll-ups
are plain aggregates over those rows: partial sums per task, one final row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.operators.catalog import DEFAULT_PACKS, all_rules, only, rule_catalog
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.rules.base import Rule, RulePack
from srclens.operators.scan import any_hit, count_name, prepared, with_rule_counts

Packs = tuple[RulePack, ...]
Total = Callable[[list[int]], Column]
METRICS = ("total_issues", "errors", "warnings", "info", "migration_suggestions")
MEDIUM_ABOVE, HIGH_ABOVE = 5, 20


def numbers_where(packs: Packs, test) -> list[int]:
    return [r.number for r in all_rules(packs) if test(r)]


def total_of(numbers: list[int]) -> Column:
    """Hits of some rules, from the count columns of ``with_rule_counts``."""
    if not numbers:
        return F.lit(0).cast("long")
    return F.expr("CAST(" + " + ".join(map(count_name, numbers)) + " AS BIGINT)")


def total_in_hits(numbers: list[int]) -> Column:
    """The same from the ``hits`` of a (stored) scan; null for an unreadable file."""
    if not numbers:
        return F.lit(0).cast("long")
    listed = ", ".join(map(str, numbers))
    return F.expr("IF(hits IS NOT NULL, "
                  f"CAST(size(filter(hits.number, x -> x IN ({listed}))) AS BIGINT), NULL)")


def total_in_map(numbers: list[int]) -> Column:
    """The same from a map ``counts`` of rule number to hits; null for an unreadable file."""
    if not numbers:
        return F.lit(0).cast("long")
    listed = ", ".join(map(str, numbers))
    return F.expr(f"IF(counts IS NOT NULL, aggregate(map_values(map_filter(counts, (k, v) -> k IN ({listed}))), "
                  "CAST(0 AS BIGINT), (a, v) -> a + v), NULL)")


def _severity(packs: Packs, severity: str) -> list[int]:
    return numbers_where(packs, lambda r: r.severity == severity)


def metric_columns(packs: Packs, total: Total = total_of) -> dict[str, Column]:
    """Issue counts; ``info`` includes the migration issues."""
    return {
        "total_issues": total(numbers_where(packs, lambda r: True)),
        "errors": total(_severity(packs, "error")),
        "warnings": total(_severity(packs, "warning")),
        "info": total(_severity(packs, "info")),
        "migration_suggestions": total(
            numbers_where(packs, lambda r: r.category == fixed.MIGRATION)),
    }


def status_of(failed: Column, errors: Column, warnings: Column) -> Column:
    """error, else warning, else success; an unreadable file is an error."""
    return F.when(failed | errors, "error").when(warnings, "warning").otherwise("success")


def file_metrics(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """``file_id`` and the five counts; null counts for an unreadable file."""
    return file_overview(files, packs).select("file_id", *METRICS)


def file_status(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """``file_id, status``: looks for a first error, then for a first warning, and stops there."""
    by = {s: [r for r in all_rules(packs) if r.severity == s] for s in ("error", "warning")}
    graded = only(*[r.number for rules in by.values() for r in rules], packs=packs)
    return prepared(files, graded).select(
        "file_id", status_of(F.col("body").isNull(), any_hit(by["error"]), any_hit(by["warning"]))
        .alias("status"))


def file_overview(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Name, status and metrics of every file in one pass; null counts for an unreadable file."""
    return overview_of(with_rule_counts(files, packs), packs)


def overview_of(found: DataFrame, packs: Packs = DEFAULT_PACKS, total: Total = total_of) -> DataFrame:
    """The overview of files that carry their rule counts (or, with ``total_in_hits``, their hits)."""
    metrics = metric_columns(packs, total)
    own = [c for c in ("file_id", "ordinal", "original_name") if c in found.columns]
    totals = found.select(*own, *[c.alias(n) for n, c in metrics.items()])
    status = status_of(F.col("total_issues").isNull(), F.col("errors") > 0, F.col("warnings") > 0)
    return totals.select(*own, status.alias("status"), *METRICS)


def run_summary_of(statuses: DataFrame) -> DataFrame:
    """Roll per-file statuses up to one row."""
    status = F.col("status")
    return statuses.agg(
        F.count_if(status == "success").alias("compliant"),
        F.count_if(status == "warning").alias("warnings"),
        F.count_if(status == "error").alias("errors"),
        F.count(F.lit(1)).alias("total_files"),
    )


def run_summary(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    return run_summary_of(file_status(files, packs))


def _standard_rules(packs: Packs) -> dict[str, list[Rule]]:
    graded = [r for p in packs if p.name == "psr" for r in p.rules]
    return {s: [r for r in graded if r.rule.startswith(s + ".")] for s in fixed.STANDARDS}


def compliance_array(packs: Packs, readable: Column, total: Total = total_of) -> Column:
    """One entry per standard, issues or not; empty for an unreadable file."""
    entries = []
    for standard, rules in _standard_rules(packs).items():
        count = total([r.number for r in rules])
        entries.append(F.struct(
            F.lit(standard).alias("standard"), (count == 0).alias("compliant"),
            count.alias("issues_count")))
    all_of = F.array(*entries)
    return F.when(readable, all_of).otherwise(F.slice(all_of, 1, 0))


def psr_compliance(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """``file_id, standard, compliant, issues_count``: four rows per readable file."""
    graded = tuple(p for p in packs if p.name == "psr")
    rows = compliance_array(graded, F.col("body").isNotNull())
    return with_rule_counts(files, graded).select("file_id", F.explode(rows).alias("c")).select(
        "file_id", "c.*")


def _counter(rules: list[Rule], key, total: Total) -> Column:
    """MAP key -> count without the keys that do not occur."""
    by_key: dict[str, list[int]] = {}
    for r in rules:
        if key(r) is not None:
            by_key.setdefault(key(r), []).append(r.number)
    entries = [F.struct(F.lit(k).alias("key"), total(v).alias("value")) for k, v in by_key.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))


def migration_columns(packs: Packs, total: Total = total_of) -> dict[str, Column]:
    rules = [r for p in packs if p.name == "migration" for r in p.rules]
    suggestions = total([r.number for r in rules])
    complexity = (F.when(suggestions > HIGH_ABOVE, "high").when(suggestions > MEDIUM_ABOVE, "medium")
                  .otherwise("low"))
    return {
        "total_suggestions": suggestions,
        "by_category": _counter(rules, lambda r: r.category or "general", total),
        "php_versions": _counter(rules, lambda r: r.php_version, total),
        "complexity": complexity,
    }


def migration_summary(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Suggestion count, counters and complexity grade of every readable file."""
    hints = tuple(p for p in packs if p.name == "migration")
    summary = F.struct(*[c.alias(name) for name, c in migration_columns(hints).items()])
    # No row for an unreadable file; a where on the body would decode every text twice.
    readable = F.explode(F.when(F.col("body").isNotNull(), F.array(summary)))
    return with_rule_counts(files, hints).select("file_id", readable.alias("s")).select(
        "file_id", "s.*")


def display_class(category: Column, severity: Column) -> Column:
    """What a reader filters by: migration takes precedence over severity."""
    return F.when(category == fixed.MIGRATION, fixed.MIGRATION).otherwise(severity)


def class_numbers(packs: Packs) -> dict[str, list[int]]:
    """Rule numbers by display class."""
    out: dict[str, list[int]] = {"error": [], "warning": [], "info": [], fixed.MIGRATION: []}
    for r in all_rules(packs):
        name = fixed.MIGRATION if r.category == fixed.MIGRATION else r.severity
        out[name].append(r.number)
    return out


def display_totals(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Run-wide counts in the four disjoint display classes."""
    by_class = class_numbers(packs)

    def total(name: str) -> Column:
        counted = total_of(by_class[name])
        if name == "error":  # the failure row of an unreadable file is an error
            counted = F.when(F.col("body").isNull(), 1).otherwise(counted)
        return F.coalesce(F.sum(counted), F.lit(0))

    return with_rule_counts(files, packs).agg(
        total("error").alias("errors"), total("warning").alias("warnings"),
        total("info").alias("info"), total(fixed.MIGRATION).alias("migration"))


def rule_counts(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Hits of every rule of the catalog, zero included.

    One aggregate with a sum per rule (a single row of partial sums per task),
    turned into rows afterwards.
    """
    rules = all_rules(packs)
    sums = with_rule_counts(files, packs).agg(*[
        F.coalesce(F.sum(count_name(r.number)), F.lit(0)).alias(count_name(r.number)) for r in rules])
    rows = F.array(*[
        F.struct(F.lit(r.number).alias("number"), F.col(count_name(r.number)).alias("hits"))
        for r in rules])
    catalog = F.broadcast(rule_catalog(files.sparkSession, packs))  # one row per rule
    return (
        sums.select(F.explode(rows).alias("r")).select("r.*").join(catalog, "number")
        .select("number", "analyzer", "rule", "severity", "reachable", "hits")
    )
