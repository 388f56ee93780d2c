"""Selections over issues: by display class, by severity, and files with something to show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.operators.catalog import DEFAULT_PACKS, only
from srclens.operators.rollup import Packs, class_numbers, display_class, total_of
from srclens.operators.rules import fixed_values as fixed
from srclens.operators.scan import with_rule_counts

CLASSES = ("error", "warning", "info", "migration")


def filter_display(issue_rows: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """Issues whose display class is switched on."""
    shown = display_class(F.col("category"), F.col("severity"))
    return issue_rows.where(shown.isin(*active))


def filter_severity(issue_rows: DataFrame, severity: str) -> DataFrame:
    return issue_rows.where(F.col("severity") == severity)


def migration_only(issue_rows: DataFrame) -> DataFrame:
    return issue_rows.where(F.col("category") == fixed.MIGRATION)


def visible_files(files: DataFrame, active: tuple[str, ...], packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Files with at least one shown issue, and how many of each class are shown.

    Counting happens inside the file's row: no join back to the issue table.
    Unreadable files show their failure row while errors are on.
    """
    by_class = class_numbers(packs)
    wanted = only(*[n for c in active for n in by_class[c]], packs=packs)
    unreadable = F.col("body").isNull()
    counts = []
    for c in CLASSES:
        shown = total_of(by_class[c] if c in active else [])
        failed = 1 if c == "error" and "error" in active else 0
        counts.append(F.when(unreadable, F.lit(failed).cast("long")).otherwise(shown).alias(f"{c}_shown"))

    def visible(row):
        test = row[f"{CLASSES[0]}_shown"] > 0
        for c in CLASSES[1:]:
            test = test | (row[f"{c}_shown"] > 0)
        return test

    # Selecting inside the row (instead of a where) keeps the optimizer from
    # evaluating the rules twice, once for the filter and once for the output.
    shown = F.explode(F.filter(F.array(F.struct(*counts)), visible))
    return with_rule_counts(files, wanted).select(
        "file_id", "original_name", shown.alias("s")).select("file_id", "original_name", "s.*")
