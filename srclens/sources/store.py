"""The report store: Parquet tables and JSON, partitioned by report id.

Layout below the store's root::

    scan/report_id=.../*.parquet       one row per file with its hits
    issues/report_id=.../*.parquet     flat issue rows
    files/report_id=.../*.parquet      one row per file: status, metrics
    rules/report_id=.../*.parquet      one row per rule: its hits, and the files it hits
    summary/report_id=.../*.parquet    one row per run
    json/report_id=.../*.json          nested file reports

A report id names the run, so writing the same run again replaces its folders and
nothing else, whatever it holds now: a retry is harmless.  The summary is written
last; a run without one is not there.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srclens import schemas
from srclens.functions.text import base_name, report_id
from srclens.operators.assembly import Assembly
from srclens.operators.catalog import DEFAULT_PACKS, all_rules, rule_catalog
from srclens.operators.ordinal import ordinals
from srclens.operators.report import reports_of
from srclens.operators.rollup import Packs, Total, overview_of, run_summary_of, total_in_hits, total_in_map
from srclens.operators.scan import issues_of, with_hits
from srclens.session import shared_folder
from srclens.sources import tree

TABLES = ("scan", "issues", "files", "rules", "summary")

# Outcome codes of a lookup and of a purge.
MISSING_REPORT_ID = "MISSING_REPORT_ID"
REPORT_NOT_FOUND = "REPORT_NOT_FOUND"
INVALID_TARGET = "INVALID_TARGET"
DIRECTORY_NOT_FOUND = "DIRECTORY_NOT_FOUND"
PURGE_TARGETS = ("uploads", "reports")

RUN_ID = re.compile(r"[\w.-]+")


class StoreError(ValueError):
    """A request the store refuses; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def new_report_id(spark: SparkSession, unix_time: int, *parts: str) -> str:
    """The id of a run from its parameters (the same parameters give the same id)."""
    row = spark.range(1).select(report_id(F.lit(unix_time), *[F.lit(p) for p in parts]).alias("id"))
    return row.first()["id"]


def _folder(root: str, table: str, run: str) -> str:
    return f"{root.rstrip('/')}/{table}/report_id={run}"


def _write(df: DataFrame, root: str, table: str, run: str, fmt: str = "parquet") -> None:
    """Replace the run's own folder, also by no rows at all."""
    df.write.mode("overwrite").format(fmt).save(_folder(root, table, run))


def _read(spark: SparkSession, root: str, table: str, run: str) -> DataFrame:
    """The run's own folder; no other run is listed."""
    rows = spark.read.option("basePath", f"{root.rstrip('/')}/{table}").parquet(_folder(root, table, run))
    return rows.where(F.col("report_id") == run)


LARGE_TEXT = 1 << 20  # characters; the hits of a longer text are not held in one row


def save_report(files: DataFrame, root: str, run: str, packs: Packs = DEFAULT_PACKS,
                nested: bool = True, large: int = LARGE_TEXT) -> None:
    """Scan ``files`` once and store the run ``run``; its summary is written last.

    The texts are read a single time: the scan itself (file and hits) is stored
    first, and every other table is a projection of the stored scan.  Texts of more than
    ``large`` characters are stored with it instead of their hits and go through
    ``assembly``, chunk by chunk.  A run of no files or no issues is stored like any other.
    """
    if not RUN_ID.fullmatch(run):
        raise StoreError(MISSING_REPORT_ID, run)
    spark = files.sparkSession
    is_large = F.coalesce(F.length("body") > large, F.lit(False))
    parted = files.withColumn("is_large", is_large).withColumns({
        "large_body": F.when(F.col("is_large"), F.col("body")), "body": F.when(~F.col("is_large"), F.col("body"))})
    more = [c for c in ("ordinal", "stored_name", "error") if c in files.columns]
    scanned = with_hits(parted, packs).select("file_id", "original_name", "path", *more, "hits", "is_large", "large_body")
    _write(scanned, root, "scan", run)
    scanned = spark.read.schema(scanned.schema).parquet(_folder(root, "scan", run))
    small, rest = scanned.where("NOT is_large"), scanned.where("is_large")
    tables = {"issues": issues_of(small, packs), "files": overview_of(small, packs, total_in_hits)}
    if nested:
        tables["json"] = reports_of(small, packs)
    sums = [_rule_sums(small, packs, total_in_hits)]
    if not rest.isEmpty():
        made = Assembly(rest.withColumnRenamed("large_body", "body"), packs)
        sums.append(_rule_sums(made.counted, packs, total_in_map))
        tables["issues"] = tables["issues"].unionByName(made.issues())
        tables["files"] = tables["files"].unionByName(made.overview())
        if nested:
            tables["json"] = tables["json"].unionByName(made.reports())
    tables["rules"] = _merged(reduce(DataFrame.unionByName, sums))
    for table, rows in tables.items():
        _write(rows, root, table, run, "json" if table == "json" else "parquet")
    stored = spark.read.schema(tables["files"].schema).parquet(_folder(root, "files", run))
    _write(run_summary_of(stored), root, "summary", run)


def _rule_sums(found: DataFrame, packs: Packs, total: Total) -> DataFrame:
    """``number, hits, files`` of every rule: one row of partial sums a task, turned into rows."""
    numbers = [r.number for r in all_rules(packs)]
    sums = found.agg(*[c for n in numbers for c in (
        F.coalesce(F.sum(total([n])), F.lit(0)).alias(f"hits_{n}"), F.count_if(total([n]) > 0).alias(f"files_{n}"))])
    rows = F.array(*[F.struct(F.lit(n).alias("number"), F.col(f"hits_{n}").alias("hits"), F.col(f"files_{n}").alias("files"))
                     for n in numbers])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def _merged(sums: DataFrame, *more: Column) -> DataFrame:
    return sums.groupBy("number").agg(F.sum("hits").alias("hits"), F.sum("files").alias("files"), *more)


def rule_statistics(spark: SparkSession, root: str, runs: list[str] | None = None, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """How often each rule of the catalog hits in stored runs (all, or those named), zero included.

    ``number, analyzer, rule, severity, reachable, hits, files, runs``: merged from the sums
    that each run has stored; no text and no issue is read.  Runs without a summary do
    not count.  A rule that a run's packs did not have is zero there.
    """
    top = root.rstrip("/")
    try:
        sums = spark.read.schema("number INT, hits LONG, files LONG, report_id STRING").parquet(f"{top}/rules")
        whole = spark.read.schema("total_files LONG, report_id STRING").parquet(f"{top}/summary")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise StoreError(REPORT_NOT_FOUND, root) from e
        raise
    if runs is not None:
        sums, whole = (x.where(F.col("report_id").isin(*runs)) for x in (sums, whole))
    sums = sums.join(whole.select("report_id"), "report_id", "left_semi")
    merged = _merged(sums, F.count("*").alias("runs"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hits", "files", "runs")]
    return rule_catalog(spark, packs).join(merged, "number", "left").select(
        "number", "analyzer", "rule", "severity", "reachable", *zero)


def lookup_report(spark: SparkSession, root: str, run: str | None, table: str = "issues") -> DataFrame:
    """Rows of one stored run; only its folder is listed and read."""
    if not run:
        raise StoreError(MISSING_REPORT_ID)
    if not RUN_ID.fullmatch(run):
        raise StoreError(REPORT_NOT_FOUND, run)
    try:
        return _read(spark, root, table, run)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise StoreError(REPORT_NOT_FOUND, run) from e
        raise


def require_report(spark: SparkSession, root: str, run: str | None, table: str = "summary") -> DataFrame:
    """Like ``lookup_report`` for a run that is whole: its summary, written last, is there."""
    lookup_report(spark, root, run, "summary")
    return lookup_report(spark, root, run, table)


def read_nested(spark: SparkSession, root: str, run: str) -> DataFrame:
    """Stored nested file reports of one run, with the fixed schema."""
    if not run:
        raise StoreError(MISSING_REPORT_ID)
    schema = T.StructType([
        T.StructField("file_id", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("part", T.IntegerType()),
        T.StructField("parts", T.IntegerType()), *schemas.FILE_REPORT.fields,
        T.StructField("report_id", T.StringType())])
    try:
        return spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/json").json(_folder(root, "json", run))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise StoreError(REPORT_NOT_FOUND, run) from e
        raise


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """Run reports stored as one JSON document per file, any generation.

    The id comes from the file name; fields an older report lacks are null, and
    an empty counter written as ``[]`` reads as an empty map.
    """
    text = spark.read.text(path, wholetext=True)
    fixed_counters = F.regexp_replace(
        F.col("value"), r'("(?:by_category|php_versions)"\s*:\s*)\[\s*\]', "$1{}")
    return text.select(
        F.regexp_replace(base_name(F.col("_metadata.file_name")), r"\.json$", "").alias("report_id"),
        F.from_json(fixed_counters, schemas.RUN_REPORT).alias("r"),
    ).select("report_id", "r.summary", "r.files")


def run_file_issues(runs: DataFrame) -> DataFrame:
    """Issues of stored run reports as flat rows."""
    return (
        runs.select("report_id", F.posexplode("files").alias("file_no", "f"))
        .select("report_id", "file_no", F.col("f.name").alias("name"),
                F.posexplode("f.issues").alias("pos", "i"))
        .select("report_id", "file_no", "name", (F.col("pos") + 1).alias("seq"), "i.*"))


# ------------------------------------------------------------------------ purge


def purge_plan(listing: DataFrame, target: str) -> DataFrame:
    """Files a purge of ``target`` removes: the regular files directly below it.

    ``listing`` has ``path`` (relative to the store) and ``size``.  Files in
    sub-directories and hidden files stay.  Nothing is deleted here.
    """
    if target not in PURGE_TARGETS:
        raise StoreError(INVALID_TARGET, target)
    return listing.where(_direct_child(F.col("path"), target)).select(
        F.lit(target).alias("target"), "path", "size")


def _direct_child(path: Column, target: str) -> Column:
    return F.rlike(path, F.lit(rf"^{target}/[^./][^/]*$"))


def purge_summary(plan: DataFrame, target: str | None = None) -> DataFrame:
    """Counts of a purge plan per target; with ``target`` one row, also when it is empty."""
    files, size = F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    if target is None:
        return plan.groupBy("target").agg(files, size)
    return plan.agg(files, size).select(F.lit(target).alias("target"), "files", "bytes")


def purge_directory(spark: SparkSession, directory: str, target: str) -> DataFrame:
    """The purge plan of a real directory (``<directory>/<target>``)."""
    if target not in PURGE_TARGETS:
        raise StoreError(INVALID_TARGET, target)
    where = f"{directory.rstrip('/')}/{target}"
    if not _exists(spark, where):
        raise StoreError(DIRECTORY_NOT_FOUND, where)
    if tree.reachable(where):
        listed = tree.list_directory(spark, where)
    else:  # a store that only Spark reaches: a plain listing, made by the driver
        listed = spark.createDataFrame(_regular_files(spark, where), "path STRING, length LONG")
    name = base_name(F.col("path"))
    return listed.where(~F.startswith(name, F.lit("."))).select(
        F.lit(target).alias("target"), F.concat(F.lit(f"{target}/"), name).alias("path"), F.col("length").alias("size"))


def _exists(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _regular_files(spark: SparkSession, where: str) -> list[tuple[str, int]]:
    """Names and sizes of the files directly in a directory, empty ones and any name included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.getLen()) for s in system.listStatus(path) if s.isFile()]


def purge_store(spark: SparkSession, root: str, table: str, execute: bool = False) -> DataFrame:
    """How many rows and runs a purge of a report table removes (one row).

    With ``execute`` the table is then overwritten by an empty one; without it
    nothing changes.
    """
    if table not in (*TABLES, "json"):
        raise StoreError(INVALID_TARGET, table)
    fmt = "json" if table == "json" else "parquet"
    folder = f"{root.rstrip('/')}/{table}"
    try:
        current = spark.read.schema("report_id STRING").format(fmt).load(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise StoreError(DIRECTORY_NOT_FOUND, folder) from e
        raise
    runs = current.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    counted = runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("runs"))
    if not execute:
        return counted
    before = spark.createDataFrame(counted.collect(), counted.schema)  # a single row
    (current.withColumn("nothing", F.lit(0)).limit(0).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy("report_id").format(fmt).save(folder))
    return before


# -------------------------------------------------------------------- retention


def runs_of(spark: SparkSession, root: str) -> DataFrame:
    """``report_id, unix_time, total_files`` of the whole runs of a store, from their summaries."""
    try:
        rows = spark.read.schema("total_files LONG, report_id STRING").parquet(f"{root.rstrip('/')}/summary")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise StoreError(DIRECTORY_NOT_FOUND, root) from e
        raise
    unix_time = F.regexp_extract("report_id", r"^report_(\d+)_", 1)
    return rows.select("report_id", F.when(unix_time != "", unix_time).cast("long").alias("unix_time"), "total_files")


def retention_plan(spark: SparkSession, root: str, now: int, max_age: int | None = None,
                   keep_last: int | None = None) -> DataFrame:
    """``report_id, unix_time, total_files, place, remove``: which runs a retention takes away.

    A run goes when it is older than ``max_age`` seconds and not among the ``keep_last``
    newest; with one of the two given, that one decides, with none nothing goes.  ``place``
    is 1 for the newest; a run whose id has no time is the oldest of all.  Nothing is
    deleted here.
    """
    placed = ordinals(runs_of(spark, root), F.col("unix_time").desc_nulls_last(), "report_id")
    tests = []
    if max_age is not None:
        tests.append(F.coalesce(F.col("unix_time") < now - max_age, F.lit(True)))
    if keep_last is not None:
        tests.append(F.col("ordinal") > keep_last)
    remove = reduce(Column.__and__, tests) if tests else F.lit(False)
    return placed.select("report_id", "unix_time", "total_files", F.col("ordinal").alias("place"), remove.alias("remove"))


def retention_summary(plan: DataFrame) -> DataFrame:
    """One row: runs and files that go, and that stay."""
    gone = F.col("remove")
    return plan.agg(
        F.count_if(gone).alias("runs_removed"), F.coalesce(F.sum(F.when(gone, F.col("total_files"))), F.lit(0)).alias("files_removed"),
        F.count_if(~gone).alias("runs_kept"), F.coalesce(F.sum(F.when(~gone, F.col("total_files"))), F.lit(0)).alias("files_kept"))


def apply_retention(plan: DataFrame, root: str) -> DataFrame:
    """Remove the folders of the plan's runs, in tasks: ``report_id, table, error`` of each.

    Summaries go first: a run that is half removed is not there for a reader, and the
    rest of it is removed when the plan is applied again.  Other runs are not touched.
    """
    spark, top = plan.sparkSession, root.rstrip("/")
    if not tree.reachable(top):
        raise StoreError(INVALID_TARGET, f"{top} cannot be reached by tasks")
    place = tree.Place(top)
    going = plan.where("remove").select("report_id")
    done = []
    for tables in (["summary"], [t for t in (*TABLES, "json") if t != "summary"]):
        named = going.select("report_id", F.explode(F.array(*map(F.lit, tables))).alias("table"))
        path = F.concat(F.lit(place.spelled(place.inner) + "/"), "table", F.lit("/report_id="), "report_id")
        where = shared_folder(spark)
        tree.remove_directories(named.select(path.alias("path"))).write.parquet(where)  # carried out here, once
        done.append(spark.read.schema("path STRING, error STRING").parquet(where))
    parts = F.split("path", "/")
    return done[0].unionByName(done[1]).select(
        F.regexp_replace(F.element_at(parts, -1), "^report_id=", "").alias("report_id"), F.element_at(parts, -2).alias("table"), "error")
