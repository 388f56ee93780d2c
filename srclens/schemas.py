"""Fixed schemas of the tables this library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

COUNTER = T.MapType(T.StringType(), T.LongType())

ISSUE = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("rule", T.StringType()),
    T.StructField("suggestion", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("php_version", T.StringType()),
    T.StructField("diff", T.StringType()),
    T.StructField("before_code", T.StringType()),
    T.StructField("after_code", T.StringType()),
    T.StructField("explanation", T.StringType()),
])

COMPLIANCE = T.StructType([
    T.StructField("standard", T.StringType()),
    T.StructField("compliant", T.BooleanType()),
    T.StructField("issues_count", T.LongType()),
])

MIGRATION_SUMMARY = T.StructType([
    T.StructField("total_suggestions", T.LongType()),
    T.StructField("by_category", COUNTER),
    T.StructField("php_versions", COUNTER),
    T.StructField("complexity", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("total_issues", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("warnings", T.LongType()),
    T.StructField("info", T.LongType()),
    T.StructField("migration_suggestions", T.LongType()),
])

FILE_REPORT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("issues", T.ArrayType(ISSUE)),
    T.StructField("psr_compliance", T.ArrayType(COMPLIANCE)),
    T.StructField("migration_summary", MIGRATION_SUMMARY),
    T.StructField("metrics", METRICS),
])

RUN_SUMMARY = T.StructType([
    T.StructField("compliant", T.LongType()),
    T.StructField("warnings", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("total_files", T.LongType()),
])

# One stored run report, as JSON (older reports lack some of the fields).
RUN_REPORT = T.StructType([
    T.StructField("summary", RUN_SUMMARY),
    T.StructField("files", T.ArrayType(FILE_REPORT)),
])
