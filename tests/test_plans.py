"""The shape of the plans: what must not be in them."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import files_of
from srclens.operators import filters, gate, report, rollup, scan
from srclens.sources.corpus import from_table


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "t")
    spark.range(8, numPartitions=2).select(
        "id", F.concat(F.lit("<?php\n$a = "), "id").alias("text"), F.lit("x").alias("unused")
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    return from_table(rows, F.col("id"), F.col("text"), F.lit("A.php"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PER_FILE = {
    "issues": scan.issues,
    "overview": rollup.file_overview,
    "status": rollup.file_status,
    "compliance": rollup.psr_compliance,
    "migration": rollup.migration_summary,
    "visible": lambda f: filters.visible_files(f, ("error",)),
    "reports": report.report_json,
    "failed": scan.failed_files,
}


@pytest.mark.parametrize("name", sorted(PER_FILE))
def test_per_file_work_never_shuffles(corpus, name):
    plan = plan_of(PER_FILE[name](corpus))
    for word in ("Exchange", "Join", "Window", "Sort ", "PythonUDF", "CartesianProduct"):
        assert word not in plan
    assert "unused" not in plan


@pytest.mark.parametrize("name", ["issues", "overview", "visible", "compliance"])
def test_rules_are_evaluated_once(corpus, name):
    """No filter below that repeats the rule predicates."""
    plan = plan_of(PER_FILE[name](corpus))
    marker = "(?d)create_function" if name in ("issues", "overview") else "strict_types"
    assert plan.count(marker) == 1


def test_status_skips_info_rules(corpus):
    assert "@param" not in plan_of(rollup.file_status(corpus))


def test_run_summary_shuffles_one_row_per_task(corpus):
    plan = plan_of(rollup.run_summary(corpus))
    assert plan.count("Exchange SinglePartition") == 1 and "hashpartitioning" not in plan


def test_texts_are_folded_to_a_literal(corpus):
    assert "from_json" not in plan_of(scan.issues(corpus)).lower()


def test_lookups_need_no_join(spark):
    up = spark.createDataFrame([(1, 0, "a.php", 1)], "upload_id LONG, status INT, original_name STRING, size LONG")
    assert "Join" not in plan_of(gate.validate_files(up))


def test_issue_rows_are_the_issues(spark):
    texts = ["<?php\necho $x; \n\tvar $a;\n", "", None, "<?php\n" + "\t \n" * 50, "<?php\nnamespace A;\nuse B;\nclass C {\n"]
    files = files_of(spark, texts)
    shown = scan.ISSUE_COLUMNS
    rows = scan.issue_rows(files)
    assert sorted(map(str, rows.select("file_id", *shown).collect())) == sorted(
        map(str, scan.issues(files).select("file_id", *shown).collect()))
    order = Window.partitionBy("file_id").orderBy("step", "line", "number")
    numbered = rows.withColumn("seq", F.row_number().over(order)).select("file_id", "seq", "rule", "line")
    assert sorted(map(str, numbered.collect())) == sorted(
        map(str, scan.issues(files).select("file_id", "seq", "rule", "line").collect()))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "sort_array" not in plan
    none = scan.issue_rows(files, failures=False).where("rule = 'ANALYSIS_ERROR'")
    assert none.count() == 0
