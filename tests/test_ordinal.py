"""The running number of the input against a plain sort."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from helpers import files_of
from srclens.operators.catalog import only
from srclens.operators.ordinal import ordinals, with_ordinal
from srclens.operators.report import file_reports, report_json
from srclens.operators.rollup import file_overview
from srclens.operators.scan import issue_rows, issues
from srclens.sources import store

FEW = only(1, 5, 13, 37)


def test_against_sorted(spark):
    rng = random.Random(1)
    keys = [(rng.choice([None, *range(300)]), i) for i in range(5000)] + [(7, 9000 + i) for i in range(3000)]  # a hot key
    rng.shuffle(keys)
    df = spark.createDataFrame(keys, "a LONG, b LONG").repartition(7)
    got = {r.ordinal: (r.a, r.b) for r in ordinals(df, "a", "b", parts=13).collect()}
    want = sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert [got[i + 1] for i in range(len(keys))] == want
    down = {r.ordinal: r.b for r in ordinals(df, F.col("b").desc()).collect()}
    assert [down[i + 1] for i in range(len(keys))] == sorted((b for _, b in keys), reverse=True)


def test_few_and_no_rows(spark):
    empty = spark.createDataFrame([], "a LONG")
    assert ordinals(empty, "a").columns == ["a", "ordinal"] and ordinals(empty, "a").count() == 0
    same = spark.createDataFrame([(1,)] * 5, "a LONG")
    assert sorted(r.ordinal for r in ordinals(same, "a", parts=3).collect()) == [1, 2, 3, 4, 5]


def test_no_window_over_all_rows(spark):
    plan = ordinals(spark.range(1000), F.col("id").desc())._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_carried_to_issues_and_reports(spark, tmp_path):
    files = files_of(spark, {f"f{i}.php": "<?php\necho 1;\n\tvar $a;\n" if i % 2 else None for i in range(20)})
    names = [f"f{i}.php" for i in range(20)]
    place = {n: i + 1 for i, n in enumerate(sorted(names))}
    numbered = with_ordinal(files, "original_name")
    by_id = {i: place[n] for i, n in enumerate(names)}
    for rows in (issues(numbered, FEW), issue_rows(numbered, FEW), file_overview(numbered, FEW), file_reports(numbered, FEW),
                 report_json(numbered, FEW)):
        found = rows.select("file_id", "ordinal").distinct().collect()
        assert {r.file_id: r.ordinal for r in found} == by_id
    assert "ordinal" not in issues(files, FEW).columns + file_overview(files, FEW).columns
    store.save_report(numbered, str(tmp_path), "report_1_x", FEW)
    for table in ("issues", "files"):
        rows = store.require_report(spark, str(tmp_path), "report_1_x", table)
        assert {r.file_id: r.ordinal for r in rows.collect()} == by_id
    nested = store.read_nested(spark, str(tmp_path), "report_1_x").orderBy("ordinal", "part").collect()
    assert [r.name for r in nested] == sorted(names)
