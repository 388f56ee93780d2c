"""Nested reports: one row per file (several parts for a file with very many issues)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens import schemas
from srclens.operators.catalog import DEFAULT_PACKS
from srclens.operators.rollup import (
    Packs, Total, compliance_array, metric_columns, migration_columns, status_of, total_in_hits,
)
from srclens.operators.scan import ordered_hits, rendered_issues, with_hits

# A file of the largest accepted size can have millions of issues, more than one
# row can hold as text.  Such a file gets several rows; no issue is left out.
ISSUES_PER_PART = 10_000


def file_reports(files: DataFrame, packs: Packs = DEFAULT_PACKS,
                 per_part: int = ISSUES_PER_PART) -> DataFrame:
    """Nested reports of ``files``; see ``reports_of``."""
    return reports_of(with_hits(files, packs), packs, per_part)


def report_heads(found: DataFrame, packs: Packs, readable: Column, total: Total) -> DataFrame:
    """What every part of a file's report repeats: name, path, status, compliance, migration, metrics."""
    own = [c for c in ("file_id", "ordinal") if c in found.columns]

    def if_readable(columns) -> Column:
        return F.when(readable, F.struct(*[c.alias(k) for k, c in columns.items()]))

    metrics = metric_columns(packs, total)
    return found.select(
        *own, F.col("original_name").alias("name"), "path",
        status_of(~readable, metrics["errors"] > 0, metrics["warnings"] > 0).alias("status"),
        compliance_array(packs, readable, total).alias("psr_compliance"),
        if_readable(migration_columns(packs, total)).alias("migration_summary"),
        if_readable(metrics).alias("metrics"), *(c for c in ("parts", "ordered") if c in found.columns))


def reports_of(scanned: DataFrame, packs: Packs = DEFAULT_PACKS,
               per_part: int = ISSUES_PER_PART) -> DataFrame:
    """``file_id, part, parts`` and the fields of a file report.

    Built inside the file's row: no grouping, no shuffle, and memory for all hits of a
    file; ``assembly`` has no such row.  Files that carry their ``ordinal`` keep it; sort
    by it (else by ``file_id``) and ``part`` to present a report.
    """
    own = [c for c in ("file_id", "ordinal") if c in scanned.columns]
    reason = F.col("error") if "error" in scanned.columns else None
    hits, readable = F.col("hits"), F.col("hits").isNotNull()
    ordered = ordered_hits(hits, reason)
    heads = report_heads(scanned.withColumns({
        "parts": F.greatest(F.ceil(F.size(ordered) / F.lit(per_part)), F.lit(1)).cast("int"),
        "ordered": ordered}), packs, readable, total_in_hits)
    cut = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.slice(F.col("ordered"), i * per_part + 1, F.lit(per_part)))
    parts = heads.select(
        *own, "parts", "name", "path", "status", "psr_compliance", "migration_summary",
        "metrics", F.posexplode(cut).alias("part", "hits"))
    return parts.select(
        *own, "part", "parts", "name", "path", "status", rendered_issues(packs).alias("issues"),
        "psr_compliance", "migration_summary", "metrics")


def report_json(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """File reports as JSON text (fields without a value are left out)."""
    return as_json(file_reports(files, packs))


def as_json(reports: DataFrame) -> DataFrame:
    fields = [F.col(f) for f in schemas.FILE_REPORT.fieldNames()]
    own = [c for c in ("file_id", "ordinal") if c in reports.columns]
    return reports.select(*own, "part", "parts", F.to_json(F.struct(*fields)).alias("report"))
