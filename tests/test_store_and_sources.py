"""Files on disk, streams of files, stored reports of several generations, purge."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helpers import files_of
from srclens.operators.catalog import DEFAULT_PACKS
from srclens.operators.report import file_reports, report_json
from srclens.operators.rollup import file_overview, file_status, rule_counts, run_summary
from srclens.operators.scan import issues
from srclens.sources import store
from srclens.sources.corpus import all_files, from_binary, from_table, list_files, read_files, stream_files, with_missing
from srclens.streaming import lint_stream

TEXTS = {
    "Good.php": "<?php\n\ndeclare(strict_types=1);\n\nnamespace A;\n\nclass Good\n{\n}\n",
    "bad.php": "<?php\necho $x; \n\tvar $a;\n",
    "utf.php": "<?php\n// é\n$s = strpos($é, 'ü') !== false;\n",
    "empty.php": "",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "UPPER.PHP").write_bytes(b"<?php\n$\xff = 1;\n")
    (sub / "notes.txt").write_text("<?php")
    (sub / "big.php").write_bytes(b"x" * (5 * 1024 * 1024 + 1))
    return tmp_path


def test_read_by_source(spark, tree):
    (tree / "_b.php").write_text("<?php")
    (tree / ".c.php").write_text("<?php")
    (tree / "__tests__").mkdir()
    (tree / "__tests__" / "a.php").write_text("<?php")
    files = read_files(spark, str(tree), in_tasks=False)
    rows = {r.original_name: r for r in files.collect()}
    sizes = {**{n: len(t.encode()) for n, t in TEXTS.items()}, "UPPER.PHP": 14, "big.php": 5 * 1024 * 1024 + 1,
             "_b.php": 5, ".c.php": 5, "a.php": 5}
    assert {n: r.size for n, r in rows.items()} == sizes
    assert rows["empty.php"].body == "" and rows["big.php"].body is None
    assert {n for n, r in rows.items() if r.error} == {"big.php", "_b.php", ".c.php", "a.php"}
    assert rows["big.php"].error == "Fichier trop volumineux (maximum 5MB)"
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,5242880)" in plan and "GreaterThan(length,5242880)" in plan
    assert run_summary(files).first().total_files == all_files(spark, str(tree), "*.[pP][hH][pP]").count() == 9
    failed = {r.file_id.rsplit("/", 1)[1]: r.message for r in issues(files).where("rule = 'ANALYSIS_ERROR'").collect()}
    assert set(failed) == {"big.php", "_b.php", ".c.php", "a.php"} and failed["big.php"].endswith("(maximum 5MB)")


def test_manifest_brings_back_empty_and_missing_files(spark, tree):
    def entry(name, size):
        return (name, name, f"file:{tree}/{name}", size, "text/x")

    manifest = spark.createDataFrame(
        [entry("Good.php", 9), entry("empty.php", 0), entry("gone.php", 5)],
        "original_name STRING, stored_name STRING, path STRING, size LONG, mime_type STRING")
    files = with_missing(read_files(spark, str(tree)), list_files(spark, str(tree)), manifest)
    by_name = {r.original_name: r for r in file_overview(files).collect()}
    assert len(by_name) == 7
    assert by_name["empty.php"].total_issues == 4 and by_name["empty.php"].status == "error"
    assert by_name["gone.php"].total_issues is None and by_name["gone.php"].status == "error"
    plan = list_files(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_file_and_table_sources_agree(spark, tree):
    rows = spark.createDataFrame(list(TEXTS.items()), "name STRING, text STRING")
    table = from_table(rows, F.col("name"), F.col("text"), F.col("name"))
    cols = ["stored_name", "seq", "rule", "line", "message", "after_code"]
    one = issues(table, DEFAULT_PACKS, "stored_name").select(*cols).collect()
    two = issues(read_files(spark, str(tree)), DEFAULT_PACKS, "stored_name").where(
        F.col("stored_name").isin(*TEXTS)).select(*cols).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and one


def test_stream_equals_batch(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    for name, rows_of, batch in (
            ("issues", lint_stream.issue_stream, issues), ("files", lint_stream.overview_stream, file_overview)):
        rows = rows_of(stream_files(spark, str(tree)))
        write = lambda: lint_stream.write_stream(
            rows, str(out / name), str(out / f"{name}-state"), available_now=True).awaitTermination()
        write()
        expected = batch(read_files(spark, str(tree)).where("size > 0"))  # a stream has no empty files
        got = spark.read.schema(rows.schema).parquet(str(out / name))
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
        write()  # nothing new has landed: nothing is added
        assert spark.read.parquet(str(out / name)).count() == expected.count()


def test_large_rows_of_a_table_stay(spark):
    rows = spark.createDataFrame([("a/x.php", 3, bytearray(b"abc")), ("a/y.php", 9, bytearray(b"<?php 123"))],
                                 "path STRING, length LONG, content BINARY").selectExpr(
        "path", "current_timestamp() AS modificationTime", "length", "content")
    found = {r.original_name: (r.body, r.error) for r in from_binary(rows, 5).collect()}
    assert found == {"x.php": ("abc", None), "y.php": (None, "Fichier trop volumineux (maximum 5MB)")}


def test_new_files_are_picked_up_once(spark, tmp_path):
    landing, out = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    rows = lint_stream.overview_stream(stream_files(spark, str(landing)))
    for n, name in enumerate(["a.php", "b.php"], start=1):
        (landing / name).write_text(TEXTS["bad.php"])
        lint_stream.write_stream(rows, str(out), str(tmp_path / "state"), available_now=True).awaitTermination()
        assert spark.read.parquet(str(out)).count() == n


def test_batch_summaries(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    files = stream_files(spark, str(landing))
    for name in ("a.php", "b.php"):
        (landing / name).write_text(TEXTS["bad.php"])
        for _ in range(2):  # the second time nothing has landed
            lint_stream.write_batch_summaries(files, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    rows = {r.batch_id: r.total_files for r in spark.read.parquet(out).collect()}
    assert rows == {0: 1, 1: 1}


def test_running_summary(spark, tree):
    summary = lint_stream.summary_stream(stream_files(spark, str(tree)))
    query = (summary.writeStream.format("memory").queryName("running_summary")
             .outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.table("running_summary").collect() == run_summary(
        read_files(spark, str(tree)).where("size > 0")).collect()


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    files = files_of(spark, {**TEXTS, "gone.php": None})
    run = store.new_report_id(spark, 1758484330, "test")
    assert run == store.new_report_id(spark, 1758484330, "test") and run.startswith("report_1758484330_")
    store.save_report(files, root, run)
    store.save_report(files, root, run)  # a retry replaces, it does not add
    store.save_report(files_of(spark, ["<?php"]), root, "report_2_other")
    got = store.lookup_report(spark, root, run).drop("report_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, issues(files).collect()))
    overview = store.lookup_report(spark, root, run, "files").drop("report_id")
    assert sorted(map(str, overview.collect())) == sorted(map(str, file_overview(files).collect()))
    (summary,) = store.require_report(spark, root, run).drop("report_id").collect()
    assert summary == run_summary(files).first()
    plan = store.lookup_report(spark, root, run)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_id" in plan
    nested = {r.name: r for r in store.read_nested(spark, root, run).collect()}
    assert len(nested) == 5
    expected = {r.name: r for r in file_reports(files).collect()}
    for name, r in nested.items():
        assert r.issues == expected[name].issues and r.metrics == expected[name].metrics
        assert r.migration_summary == expected[name].migration_summary
    assert nested["gone.php"].metrics is None and nested["gone.php"].psr_compliance == []
    for bad, code in ((None, "MISSING_REPORT_ID"), ("", "MISSING_REPORT_ID"), ("none", "REPORT_NOT_FOUND")):
        with pytest.raises(store.StoreError) as e:
            store.require_report(spark, root, bad)
        assert e.value.code == code
    plan_only = store.purge_store(spark, root, "issues").first()
    assert plan_only.runs == 2 and store.lookup_report(spark, root, run).count() > 0
    purged = store.purge_store(spark, root, "issues", execute=True).first()
    assert purged == plan_only


def test_status_equals_metrics(spark):
    files = files_of(spark, {**TEXTS, "gone.php": None})
    fast = {r.file_id: r.status for r in file_status(files).collect()}
    full = {r.file_id: r.status for r in file_overview(files).collect()}
    assert fast == full
    total = rule_counts(files).agg(F.sum("hits")).first()[0]
    assert total == issues(files, failures=False).count()


def test_many_issues_are_split_into_parts(spark):
    files = files_of(spark, {"tabs.php": "\t\n" * 50, "small.php": "<?php"})
    whole = {r.name: r for r in file_reports(files).collect()}
    parts = file_reports(files, per_part=30).orderBy("name", "part").collect()
    tabs = [p for p in parts if p.name == "tabs.php"]
    assert len(tabs) == tabs[0].parts > 5
    assert sum((p.issues for p in tabs), []) == whole["tabs.php"].issues
    assert all(len(p.issues) <= 30 for p in parts)


def test_json_leaves_out_missing_fields(spark):
    (row,) = report_json(files_of(spark, {"bad.php": TEXTS["bad.php"]})).collect()
    doc = json.loads(row.report)
    assert list(doc) == ["name", "path", "status", "issues", "psr_compliance", "migration_summary", "metrics"]
    assert list(doc["issues"][0]) == ["severity", "message", "line", "rule", "suggestion"]


def test_older_reports(spark, tmp_path):
    old = {"summary": {"compliant": 0, "warnings": 0, "errors": 1, "total_files": 1},
           "files": [{"name": "a.php", "path": "/x/a.php", "status": "error",
                      "issues": [{"severity": "error", "message": "m", "line": 0, "rule": "ANALYSIS_ERROR"}],
                      "psr_compliance": []}]}
    new = {"summary": {"compliant": 1, "warnings": 0, "errors": 0, "total_files": 1},
           "files": [{"name": "b.php", "path": "/x/b.php", "status": "success", "issues": [],
                      "psr_compliance": [{"standard": "PSR-1", "compliant": True, "issues_count": 0}],
                      "migration_summary": {"total_suggestions": 1, "by_category": [],
                                            "php_versions": {"8.4": 1}, "complexity": "low"},
                      "metrics": {"total_issues": 0, "errors": 0, "warnings": 0, "info": 0,
                                  "migration_suggestions": 0}}]}
    (tmp_path / "report_1_old.json").write_text(json.dumps(old, indent=4))
    (tmp_path / "report_2_new.json").write_text(json.dumps(new, indent=4))
    runs = store.read_run_files(spark, str(tmp_path))
    by_id = {r.report_id: r for r in runs.collect()}
    first, second = by_id["report_1_old"].files[0], by_id["report_2_new"].files[0]
    assert first.metrics is None and first.issues[0].suggestion is None
    assert second.migration_summary.by_category == {} and second.migration_summary.php_versions == {"8.4": 1}
    (row,) = store.run_file_issues(runs).collect()
    assert (row.report_id, row.rule) == ("report_1_old", "ANALYSIS_ERROR")


def test_purge_directory(spark, tmp_path):
    uploads = tmp_path / "uploads"
    (uploads / "sub").mkdir(parents=True)
    for name in ("a.php", "b.php", ".hidden", "sub/c.php"):
        (uploads / name).write_text("x")
    plan = store.purge_directory(spark, str(tmp_path), "uploads")
    assert sorted(r.path for r in plan.collect()) == ["uploads/a.php", "uploads/b.php"]
    assert store.purge_summary(plan).first().files == 2
    assert (uploads / "a.php").exists()
    for target, code in (("other", "INVALID_TARGET"), ("reports", "DIRECTORY_NOT_FOUND")):
        with pytest.raises(store.StoreError) as e:
            store.purge_directory(spark, str(tmp_path), target)
        assert e.value.code == code


def test_purge_takes_every_regular_file(spark, tmp_path):
    uploads = tmp_path / "uploads"
    uploads.mkdir()
    assert store.purge_summary(store.purge_directory(spark, str(tmp_path), "uploads"), "uploads").first() == ("uploads", 0, 0)
    for name, text in (("_a.php", "xy"), ("empty.php", ""), ("b.php", "z")):
        (uploads / name).write_text(text)
    plan = store.purge_directory(spark, str(tmp_path), "uploads")
    assert sorted(r.path for r in plan.collect()) == ["uploads/_a.php", "uploads/b.php", "uploads/empty.php"]
    assert store.purge_summary(plan, "uploads").first() == ("uploads", 3, 3)


def test_retry_without_issues_leaves_none(spark, tmp_path):
    root = str(tmp_path / "store")
    clean = "<?php\n\ndeclare(strict_types=1);\n\nnamespace A;\n\nreturn [];\n"
    bad, good = files_of(spark, ["<?php\necho 1;"]), files_of(spark, [clean])
    packs = tuple(p for p in DEFAULT_PACKS if p.name == "psr")
    store.save_report(bad, root, "report_1_x", packs, nested=False)
    assert store.require_report(spark, root, "report_1_x", "issues").count()
    store.save_report(good, root, "report_1_x", packs, nested=False)
    assert store.require_report(spark, root, "report_1_x", "issues").count() == 0
    assert store.require_report(spark, root, "report_1_x", "files").first().status == "success"


def test_run_of_no_files(spark, tmp_path):
    root = str(tmp_path / "store")
    store.save_report(files_of(spark, ["x"]).limit(0), root, "report_1_none")
    assert store.require_report(spark, root, "report_1_none").first().total_files == 0
    assert store.require_report(spark, root, "report_1_none", "issues").count() == 0


def test_runs_that_are_not_there(spark, tmp_path):
    root = str(tmp_path / "store")

    def code(run):
        with pytest.raises(store.StoreError) as e:
            store.require_report(spark, root, run)
        return e.value.code

    assert code("report_1_x") == "REPORT_NOT_FOUND"  # a new store
    store.save_report(files_of(spark, ["x"]), root, "report_1_x")
    assert code("report_2_y") == code("../report_1_x") == "REPORT_NOT_FOUND" and code("") == "MISSING_REPORT_ID"
    for table in (*store.TABLES, "json"):
        store.purge_store(spark, root, table, execute=True)
    assert code("report_1_x") == "REPORT_NOT_FOUND"  # a purged one
    assert store.purge_store(spark, root, "files").first() == (0, 0)
