"""Statistics merged over stored runs, and retention that leaves every other run readable."""

from __future__ import annotations

import pytest

from helpers import files_of
from srclens.operators.catalog import only
from srclens.operators.rollup import rule_counts
from srclens.sources import store

FEW = only(1, 5, 13, 37)


def saved(spark, root, n=4, texts=("<?php\n\tvar $a;\n", "x\n\t\n\t\n", None)):
    names = [f"report_{1000 * (i + 1)}_x" for i in range(n)]
    for i, name in enumerate(names):
        store.save_report(files_of(spark, list(texts) * (i + 1)), root, name, FEW, nested=False)
    return names


def test_statistics_equal_the_scan(spark, tmp_path):
    root = str(tmp_path)
    names = saved(spark, root, 3)
    store.save_report(files_of(spark, ["\t\n" * 900]), root, "report_9_large", FEW, nested=False, large=100)
    counts = lambda *sizes: {
        r.number: r.hits for r in rule_counts(files_of(spark, ["<?php\n\tvar $a;\n", "x\n\t\n\t\n", None] * sum(sizes)), FEW).collect()}
    shown = lambda runs: {r.number: r.hits for r in store.rule_statistics(spark, root, runs, FEW).collect()}
    assert shown(names) == counts(1, 2, 3) and shown(names[1:2]) == counts(2)
    assert shown(["report_9_large"]) == {r.number: r.hits for r in rule_counts(files_of(spark, ["\t\n" * 900]), FEW).collect()}
    whole = {r.number: r for r in store.rule_statistics(spark, root, packs=FEW).collect()}
    assert {r.runs for r in whole.values()} == {4} and whole[5].files == 2 * 6 + 1
    assert {r.hits for r in store.rule_statistics(spark, root, [], FEW).collect()} == {0}
    plan = store.rule_statistics(spark, root, names, FEW)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "hits#" in plan and "PartitionFilters" in plan
    # A run without its summary, written last, does not count.
    (tmp_path / "summary" / "report_id=report_1000_x").rename(tmp_path / "gone")
    assert shown(names) == counts(2, 3)


def test_statistics_of_no_store(spark, tmp_path):
    with pytest.raises(store.StoreError):
        store.rule_statistics(spark, str(tmp_path))


@pytest.mark.parametrize("max_age, keep_last, gone", [
    (None, None, set()), (2500, None, {1000, 2000}), (None, 1, {1000, 2000, 3000}), (2500, 3, {1000}),
    (2500, 4, set()), (0, 0, {1000, 2000, 3000, 4000}), (10**6, 0, set())])
def test_plan(spark, tmp_path_factory, max_age, keep_last, gone, runs=[]):
    if not runs:
        runs.append(str(tmp_path_factory.mktemp("store")))
        saved(spark, runs[0], texts=("<?php\n",))
    plan = store.retention_plan(spark, runs[0], 5000, max_age, keep_last).collect()
    assert {r.unix_time for r in plan if r.remove} == gone
    assert sorted((r.place, r.unix_time, r.total_files) for r in plan) == [(1, 4000, 4), (2, 3000, 3), (3, 2000, 2), (4, 1000, 1)]


def test_purge_leaves_other_runs(spark, tmp_path):
    root = str(tmp_path)
    names = saved(spark, root, 3)
    store.save_report(files_of(spark, ["x"]), root, "nightly", FEW, nested=False)  # no time: the oldest
    plan = store.retention_plan(spark, root, 5000, max_age=2500)
    assert store.retention_summary(plan).first().asDict() == {
        "runs_removed": 3, "files_removed": 3 + 6 + 1, "runs_kept": 1, "files_kept": 9}
    before = {t: sorted(map(str, store.require_report(spark, root, names[2], t).collect())) for t in store.TABLES}
    result = store.apply_retention(plan, root).collect()
    assert {(r.report_id, r.table) for r in result} == {
        (n, t) for n in (*names[:2], "nightly") for t in (*store.TABLES, "json")}
    assert all(r.error is None for r in result)
    for name in (*names[:2], "nightly"):
        with pytest.raises(store.StoreError):
            store.require_report(spark, root, name)
    assert {t: sorted(map(str, store.require_report(spark, root, names[2], t).collect())) for t in store.TABLES} == before
    assert not (tmp_path / "issues" / f"report_id={names[0]}").exists()
    assert [r.report_id for r in store.runs_of(spark, root).collect()] == [names[2]]
