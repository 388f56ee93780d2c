"""The gate, names, sizes and the findings normaliser."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from srclens.functions import text
from srclens.operators import gate, normalize

UPLOAD = "upload_id LONG, batch_id LONG, status INT, original_name STRING, size LONG, mime_type STRING, unix_time LONG"
MB5 = 5 * 1024 * 1024


def uploads(spark, rows):
    return spark.createDataFrame([(i, *r, "text/x", 17) for i, r in enumerate(rows)], UPLOAD)


def test_first_failing_check_wins(spark):
    rows = [
        (1, 0, "a.php", 1), (1, 0, "A.B.PHP", MB5), (1, 0, "a.php", MB5 + 1), (1, 0, "a.inc", MB5 + 1),
        (1, 0, "php", 1), (1, 0, None, 1), (1, 0, "0", 1), (1, 3, None, 1), (1, 5, "a.php", 1),
        (1, 1, "a.php", 1), (1, 0, "a.php", None), (1, 0, "x.php/readme", 1),
    ]
    found = [r.error for r in gate.validate_files(uploads(spark, rows)).orderBy("upload_id").collect()]
    assert found == [
        None, None, gate.TOO_BIG, gate.BAD_EXTENSION, gate.BAD_EXTENSION, gate.NAME_MISSING,
        gate.NAME_MISSING, "Téléchargement partiel", gate.UNKNOWN_TRANSFER_ERROR,
        "Fichier trop volumineux", None, gate.BAD_EXTENSION]


def test_one_bad_file_fails_its_batch(spark):
    up = uploads(spark, [(1, 0, "a.php", 1), (1, 0, "b.txt", 1), (2, 0, "c.php", 1)])
    out = {r.batch_id: r for r in gate.gate_batch(up, "batch_id").collect()}
    assert (out[1].success, out[1].error_code, out[1].accepted, out[1].rejected) == (
        False, "UPLOAD_VALIDATION_FAILED", 1, 1)
    assert (out[2].success, out[2].error_code) == (True, None)
    assert [r.upload_id for r in gate.accepted_files(up, "strict", "batch_id").collect()] == [2]
    assert sorted(r.upload_id for r in gate.accepted_files(up, "per_row").collect()) == [0, 2]
    assert gate.accepted_files(up, "strict").count() == 0
    assert gate.accepted_files(up.where("upload_id <> 1"), "strict").count() == 2
    with pytest.raises(ValueError):
        gate.accepted_files(up, "other")


def test_null_batch_is_a_batch(spark):
    up = uploads(spark, [(None, 0, "a.php", 1), (None, 0, "b.txt", 1), (2, 0, "c.php", 1)])
    assert [r.upload_id for r in gate.accepted_files(up, "strict", "batch_id").collect()] == [2]


def test_no_files(spark):
    (row,) = gate.gate_batch(uploads(spark, [])).collect()
    assert (row.success, row.error_code, row.total_files) == (False, "NO_FILES", 0)


def test_hot_batch_is_exact(spark):
    """A third of all rows in one batch, with skew handling forced on."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        up = spark.range(30_000).select(
            F.col("id").alias("upload_id"),
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500 + 100).alias("batch_id"),
            F.lit(0).alias("status"),
            F.when(F.col("id") % 1000 == 1, "a.txt").otherwise("a.php").alias("original_name"),
            F.lit(1).cast("long").alias("size"))
        kept = gate.accepted_files(up, "strict", "batch_id").agg(F.count("*"), F.sum("upload_id")).first()
        bad = {i % 500 + 100 for i in range(30_000) if i % 1000 == 1 and i % 3}
        bad |= {7 for i in range(30_000) if i % 1000 == 1 and i % 3 == 0}
        keep = [i for i in range(30_000) if (7 if i % 3 == 0 else i % 500 + 100) not in bad and i % 1000 != 1]
        assert (kept[0], kept[1]) == (len(keep), sum(keep) if keep else None)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sizes(spark):
    sizes = [0, 1, 1023, 1024, 1152, 1536, 1029, 1048575, 1048576, 5242880, 1073741824, 1610612736]
    df = spark.createDataFrame([(s,) for s in sizes], "size LONG")
    assert [r[0] for r in df.select(text.human_size(F.col("size"))).collect()] == [
        "0 Bytes", "1 Bytes", "1023 Bytes", "1 KB", "1.13 KB", "1.5 KB", "1 KB", "1024 KB", "1 MB",
        "5 MB", "1 GB", "1.5 GB"]


def test_paths_and_names(spark):
    names = ["a/b/c.tar.php", "noext", ".php", "dir.x/name", "a.", "a/b/"]
    df = spark.createDataFrame([(n,) for n in names], "p STRING")
    p = F.col("p")
    rows = df.select(text.base_name(p), text.file_stem(p), text.extension(p)).collect()
    assert [tuple(r) for r in rows] == [
        ("c.tar.php", "c.tar", "php"), ("noext", "noext", ""), (".php", "", "php"),
        ("name", "name", ""), ("a.", "a", ""), ("b", "b", "")]


def test_report_time(spark):
    df = spark.createDataFrame([("report_1758484330_14e7",), ("other",)], "id STRING")
    rows = df.select(F.unix_timestamp(text.report_time(F.col("id")))).collect()
    assert [r[0] for r in rows] == [1758484330, None]


def test_escape_and_studly(spark):
    df = spark.createDataFrame([("<a href=\"x\">&amp;</a>", "MAX__FILE_SIZE")], "h STRING, n STRING")
    row = df.select(text.escape_html(F.col("h")), text.studly(F.col("n"))).first()
    assert tuple(row) == ('&lt;a href="x"&gt;&amp;amp;&lt;/a&gt;', "MaxFileSize")


def test_fixer_findings(spark):
    df = spark.createDataFrame([(1, "ordered_imports"), (2, "other"), (3, None)], "finding_id LONG, fixer STRING")
    rows = normalize.normalize_fixer(df).orderBy("finding_id").collect()
    assert [(r.severity, r.enabled) for r in rows] == [("warning", True), ("info", False), ("info", False)]
    assert rows[1].message == "Problème de formatage détecté par other"
    rules = normalize.fixer_rules(spark)
    assert rules.where("enabled").count() == 68
    options = {r.name: json.loads(r.options) for r in rules.where("options IS NOT NULL").collect()}
    assert options["concat_space"] == {"spacing": "one"}
    assert options["blank_line_before_statement"] == {"statements": ["return"]}
    assert options["class_attributes_separation"] == {"elements": {"method": "one"}}
    assert len(options) == 5


def test_stored_names_differ(spark):
    rows = [(i, b, "a/index.php", 10, 7) for i in (1, 2) for b in ("x", "y", None)]
    up = spark.createDataFrame(rows, "upload_id LONG, batch_id STRING, original_name STRING, size LONG, unix_time LONG")
    up = up.selectExpr("*", "0 AS status", "'text/x' AS mime_type")
    names = lambda: sorted(r.stored_name for r in gate.manifest(up, "per_row", "batch_id").collect())
    assert len(set(names())) == 6 and names() == names()


def test_gate_of_no_files(spark):
    up = spark.createDataFrame([], "upload_id LONG, original_name STRING, size LONG, status INT")
    row = gate.gate_batch(up).first()
    assert (row.success, row.error_code, row.total_files) == (False, "NO_FILES", 0)


def test_static_findings(spark):
    df = spark.createDataFrame(
        [(1, "Undefined variable: $x", True), (2, "Undefined variable: $x", None), (3, "should be x", False),
         (4, "odd", False), (5, "expects other type", False), (6, None, False)],
        "finding_id LONG, message STRING, ignorable BOOLEAN")
    rows = normalize.normalize_static(df).orderBy("finding_id").collect()
    assert [r.severity for r in rows] == ["warning", "error", "warning", "error", "error", "error"]
    assert rows[3].suggestion is None and rows[4].suggestion.startswith("Vérifiez les types")


def test_diff(spark):
    diff = "--- Original\n+++ New\n@@\n-old \n+ new\n ctx\n-\n+  "
    df = spark.createDataFrame([(1, diff)], "finding_id LONG, diff STRING")
    rows = normalize.normalize_diff(df).orderBy("line_no").collect()
    assert [(r.line_no, r.rule, r.suggestion) for r in rows] == [
        (4, "deprecated_code", "Moderniser selon PHP 8.4: old"),
        (5, "modernization", "Code moderne: new"),
        (8, "modernization", "Code moderne: ")]
