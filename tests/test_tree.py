"""Trees listed and read in tasks: nothing is lost, and a failing file is a row."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from srclens.operators.rollup import file_status, run_summary
from srclens.operators.scan import issues
from srclens.sources import store, tree
from srclens.sources.corpus import from_read, from_table, read_files

TEXTS = {
    "a.php": "<?php\necho $x; \n", "empty.php": "", "_hidden.php": "<?php\n\tvar $a;\n", ".dot.php": "<?php\n",
    "sub/UPPER.PHP": "<?php\n$ÿ = 1;\n", "__tests__/b c.php": "<?php", "sub/deep/er/z.php": "<?php\n$a=1;\n",
    "sub/notes.txt": "<?php", ".git/x.php": "<?php",
}


@pytest.fixture
def corpus(tmp_path):
    for name, text in TEXTS.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text.encode())
    (tmp_path / "big.php").write_bytes(b"x" * 3000)
    (tmp_path / "loop").symlink_to(tmp_path)
    return tmp_path


def test_every_file_is_listed(spark, corpus):
    rows = tree.list_tree(spark, str(corpus)).collect()
    names = {r.path.removeprefix(f"file:{corpus}/"): r.length for r in rows}
    assert names == {**{n: len(t.encode()) for n, t in TEXTS.items()}, "big.php": 3000}
    assert all(r.error is None and r.modificationTime for r in rows)
    assert tree.list_tree(spark, f"file:{corpus}", "*.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        tree.list_tree(spark, str(corpus / "nowhere"))


def test_read_files(spark, corpus):
    files = read_files(spark, str(corpus), max_bytes=2000)
    rows = {r.path.removeprefix(f"file:{corpus}/"): r for r in files.collect()}
    assert set(rows) == {n for n in TEXTS if n != "sub/notes.txt"} | {"big.php"}
    assert {n for n, r in rows.items() if r.error} == {"big.php"} and rows["big.php"].body is None
    assert rows["big.php"].size == 3000 and rows["empty.php"].body == ""
    table = spark.createDataFrame([(f"file:{corpus}/{n}", n.rsplit("/", 1)[-1], t) for n, t in TEXTS.items() if n != "sub/notes.txt"],
                                  "path STRING, name STRING, text STRING")
    expected = issues(from_table(table, F.col("path"), F.col("text"), F.col("name")))
    got = issues(files).where("rule <> 'ANALYSIS_ERROR'")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_vanished_and_damaged_files_are_rows(spark, corpus, monkeypatch):
    listing = tree.list_tree(spark, str(corpus), "*.php")
    before = listing.count()
    (corpus / "a.php").unlink()
    (corpus / "_hidden.php").unlink()
    (corpus / "_hidden.php").mkdir()  # no file any more
    (corpus / "empty.php").write_text("y" * 2500)  # grown beyond the limit
    files = from_read(tree.read_listed(listing, 2000))
    rows = {r.path.removeprefix(f"file:{corpus}/"): r for r in files.collect()}
    assert len(rows) == before
    assert rows["a.php"].error == tree.GONE and rows["_hidden.php"].error.startswith(tree.UNREADABLE_FILE)
    assert rows["empty.php"].error == rows["big.php"].error == "Fichier trop volumineux (maximum 5MB)"
    failed = {r.file_id.rsplit("/", 1)[1]: r for r in issues(files).where("rule = 'ANALYSIS_ERROR'").collect()}
    assert set(failed) == {"a.php", "_hidden.php", "empty.php", "big.php"}
    assert failed["a.php"].message.endswith(tree.GONE) and failed["a.php"].line == 0
    assert run_summary(files).first().total_files == before
    assert {r.status for r in file_status(files).where(F.col("file_id").endswith("/a.php")).collect()} == {"error"}


def test_directory_that_cannot_be_listed(spark, corpus):
    level = spark.createDataFrame([(f"file:{corpus}/sub",), (f"file:{corpus}/gone",)], "path STRING")
    rows = {r.path.removeprefix(f"file:{corpus}/"): r for r in tree.list_directories(level).collect()}
    assert rows["gone"].error == tree.GONE and rows["gone"].is_dir
    assert rows["sub/deep"].is_dir and rows["sub/notes.txt"].length == 5


def test_many_files_are_listed_in_tasks(spark, tmp_path):
    """100,000 files in 100 directories: the driver sees counts of directories only."""
    names = spark.range(100_000).select(
        F.concat(F.lit("d"), (F.col("id") % 100).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".php")).alias("path"),
        F.when(F.col("id") % 1000 == 0, b"<?php\n").alias("content"))
    assert tree.land_files(names.repartition(8), str(tmp_path)).agg(F.sum("length")).first()[0] == 600
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    listing = tree.list_tree(spark, str(tmp_path))
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 7  # 100 directories at 16 a task
    row = listing.agg(F.count("*"), F.count_distinct("path"), F.sum("length")).first()
    assert tuple(row) == (100_000, 100_000, 600)


def test_hadoop_spelling(spark, tmp_path):
    (tmp_path / "a b%20c.php").write_text("<?php")
    (row,) = tree.list_tree(spark, str(tmp_path)).collect()
    (by_source,) = spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()
    assert row.path == by_source.path
    assert tree.read_listed(tree.list_tree(spark, str(tmp_path))).first().content == b"<?php"


def test_remove_files(spark, corpus):
    paths = spark.createDataFrame([(f"file:{corpus}/a.php",), (f"file:{corpus}/gone.php",), (f"file:{corpus}/sub",)], "path STRING")
    rows = {r.path.rsplit("/", 1)[1]: r.error for r in tree.remove_files(paths).collect()}
    assert rows["a.php"] is None and rows["gone.php"] is None and rows["sub"] and not os.path.exists(corpus / "a.php")


def test_no_files(spark, tmp_path):
    assert tree.list_tree(spark, str(tmp_path)).count() == 0
    assert read_files(spark, str(tmp_path)).count() == 0
    assert not tree.reachable("viewfs://store/in")
    (tmp_path / "uploads").mkdir()
    assert store.purge_summary(store.purge_directory(spark, str(tmp_path), "uploads"), "uploads").first() == ("uploads", 0, 0)
