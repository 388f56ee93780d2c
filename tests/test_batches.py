"""Batches are all there or not at all, and a stream of files loses none."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from helpers import files_of
from srclens.operators.catalog import DEFAULT_PACKS, only
from srclens.operators.rollup import file_overview, migration_summary, psr_compliance, run_summary
from srclens.operators.scan import issues
from srclens.sources.corpus import read_files
from srclens.streaming.batches import REPORT_TABLES, BatchStore, FileStream, write_batch_reports

TEXTS = {"a.php": "<?php\necho $x; \n\tvar $a;\n", "b.php": "<?php\n\ndeclare(strict_types=1);\n", "empty.php": "", "gone.php": None}


def shown(df, *drop):
    return sorted(map(str, df.drop("batch_id", *drop).select(*sorted(c for c in df.columns if c not in ("batch_id", *drop))).collect()))


FEW = only(1, 5, 13, 37)  # quick to compile


def expected(files, packs=DEFAULT_PACKS):
    return {"issues": issues(files, packs), "files": file_overview(files, packs), "compliance": psr_compliance(files, packs),
            "migration": migration_summary(files, packs), "summary": run_summary(files, packs)}


def test_all_reports_of_a_batch(spark, tmp_path):
    store, files = BatchStore(spark, str(tmp_path)), files_of(spark, TEXTS)
    assert store.commits().count() == 0 and store.held().count() == 0
    assert store.write(files, "s-0") and not store.write(files, "s-0")
    for table, rows in expected(files).items():
        assert shown(store.read(table)) == shown(rows), table
    assert [tuple(r) for r in store.commits().collect()] == [("s-0", 4)]
    with pytest.raises(ValueError):
        store.read("other")


@pytest.mark.parametrize("dies_at", ["scan", "files", "summary", "commits"])
def test_batch_killed_midway(spark, tmp_path, monkeypatch, dies_at):
    """Nothing of a killed batch is seen; run again there is one copy of each table."""
    store, files = BatchStore(spark, str(tmp_path), FEW), files_of(spark, TEXTS)
    store.write(files_of(spark, {"old.php": "<?php\n"}), "s-0")
    put = BatchStore._put

    def dying(self, rows, table, batch_id):
        if table == dies_at:
            put(self, rows.limit(1), table, batch_id) if table != "commits" else None
            raise RuntimeError("killed")
        return put(self, rows, table, batch_id)

    monkeypatch.setattr(BatchStore, "_put", dying)
    with pytest.raises(RuntimeError):
        store.write(files, "s-1")
    monkeypatch.setattr(BatchStore, "_put", put)
    for table in REPORT_TABLES:
        assert {r.batch_id for r in store.read(table).select("batch_id").distinct().collect()} <= {"s-0"}
    assert store.held().count() == 1
    store.write(files, "s-1")
    for table, rows in expected(files, FEW).items():
        assert shown(store.read(table).where("batch_id = 's-1'")) == shown(rows), table


def test_stream_killed_midway_and_restarted(spark, tmp_path, monkeypatch):
    landing = tmp_path / "in"
    landing.mkdir()
    for name, text in TEXTS.items():
        if text:
            (landing / name).write_text(text)
    from srclens.sources.corpus import stream_files
    store = BatchStore(spark, str(tmp_path / "out"), FEW)
    put = BatchStore._put

    def dying(self, rows, table, batch_id):
        if table == "migration":
            raise RuntimeError("killed")
        return put(self, rows, table, batch_id)

    run = lambda: write_batch_reports(stream_files(spark, str(landing)), store, str(tmp_path / "state"), True)
    monkeypatch.setattr(BatchStore, "_put", dying)
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    assert store.commits().count() == 0
    monkeypatch.setattr(BatchStore, "_put", put)
    for _ in range(2):
        run().awaitTermination()
    files = read_files(spark, str(landing))
    for table, rows in expected(files, FEW).items():
        assert shown(store.read(table)) == shown(rows), table


def test_every_file_lands_exactly_once(spark, tmp_path):
    landing = tmp_path / "in"
    (landing / "__tests__").mkdir(parents=True)

    def land(*names, text="<?php\necho 1;\n"):
        for name in names:
            (landing / name).write_text(text)

    store = BatchStore(spark, str(tmp_path / "out"), FEW)
    make = lambda lag=3600: FileStream(spark, str(landing), store, str(tmp_path / "state"), max_bytes=1000, lag=lag)
    kinds = lambda: {r.original_name: r.batch_id for r in store.read("files").collect()}
    land("a.php", "_a.php", ".b.php", "__tests__/t.php")
    land("empty.php", "_empty.php", text="")
    land("big.php", text="x" * 2000)
    land("notes.txt")
    make().start(available_now=True).awaitTermination()
    assert kinds() == {"a.php": "s-0", "big.php": "s-0"}
    assert make().reconcile() == 5 and make().reconcile() == 0
    assert kinds() == {"a.php": "s-0", "big.php": "s-0", **{
        n: "r-0" for n in ("_a.php", ".b.php", "t.php", "empty.php", "_empty.php")}}
    # After a restart only what is new lands; an empty file that is filled later is known already.
    land("c.php", "_c.php")
    land("empty.php", text="<?php\n")
    (landing / "a.php").unlink()
    make().start(available_now=True).awaitTermination()
    assert make().reconcile() == 1 and make().reconcile() == 0
    assert kinds() == {"a.php": "s-0", "big.php": "s-0", "c.php": "s-1", "_c.php": "r-1", **{
        n: "r-0" for n in ("_a.php", ".b.php", "t.php", "empty.php", "_empty.php")}}
    assert store.read("files").count() == 9
    # What the stream has not brought within the lag is taken too, and then left out by the stream.
    land("late.php")
    assert make(lag=0).reconcile() == 1
    make().start(available_now=True).awaitTermination()
    rows = store.read("files").where("original_name = 'late.php'").collect()
    assert [r.batch_id for r in rows] == ["r-2"]
    failed = store.read("issues").where("rule = 'ANALYSIS_ERROR'").collect()
    assert [r.file_id.rsplit("/", 1)[1] for r in failed] == ["big.php"]


def test_reconciling_killed_midway(spark, tmp_path, monkeypatch):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "_x.php").write_text("<?php")
    store = BatchStore(spark, str(tmp_path / "out"), FEW)
    stream = FileStream(spark, str(landing), store, str(tmp_path / "state"))
    put = BatchStore._put
    monkeypatch.setattr(BatchStore, "_put", lambda self, rows, table, b: put(self, rows, table, b) if table != "summary" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stream.reconcile()
    monkeypatch.setattr(BatchStore, "_put", put)
    (landing / "empty.php").write_text("")
    assert stream.reconcile() == 2
    assert store.read("files").count() == 2 and {r.batch_id for r in store.commits().collect()} == {"r-0"}


def test_file_gone_before_it_is_read(spark, tmp_path, monkeypatch):
    """A name the stream saw, gone when a task opens it: one failure row, and the stream ends well."""
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.php").write_text("<?php")
    (landing / "b.php").write_text("<?php")
    store = BatchStore(spark, str(tmp_path / "out"), FEW)
    stream = FileStream(spark, str(landing), store, str(tmp_path / "state"))
    write = FileStream._write

    def late(self, listing, batch_id):
        listing = spark.createDataFrame(listing.collect(), listing.schema)
        (landing / "b.php").unlink()
        return write(self, listing, batch_id)

    monkeypatch.setattr(FileStream, "_write", late)
    stream.start(available_now=True).awaitTermination()
    rows = {r.original_name: r.total_issues for r in store.read("files").collect()}
    assert set(rows) == {"a.php", "b.php"} and rows["b.php"] is None and rows["a.php"] == 0
    assert store.read("issues").where(F.col("rule") == "ANALYSIS_ERROR").count() == 1


def test_stream_gives_the_driver_no_names(spark, tmp_path, monkeypatch):
    """The source reads tables of names: its log has few entries, however many files land; nothing of a listing stays."""
    from srclens.streaming import batches
    folders = []
    monkeypatch.setattr(batches, "shared_folder", lambda s: folders.append(str(tmp_path / f"listing{len(folders)}")) or folders[-1])
    landing = tmp_path / "in"
    store = BatchStore(spark, str(tmp_path / "out"), FEW)
    for wave in range(2):
        for d in range(3):
            (landing / f"d{d}").mkdir(parents=True, exist_ok=True)
            for i in range(40):
                (landing / f"d{d}" / f"w{wave}_{i}.php").write_text("<?php\necho 1;\n")
        FileStream(spark, str(landing), store, str(tmp_path / "state")).start(available_now=True).awaitTermination()
        log = (tmp_path / "state" / "sources" / "0" / str(wave)).read_text().splitlines()[1:]
        assert 1 <= len(log) <= 4 and not any(".php" in entry for entry in log)
    assert {r.batch_id: r["count"] for r in store.read("files").groupBy("batch_id").count().collect()} == {"s-0": 120, "s-1": 120}
    assert store.read("files").select("file_id").distinct().count() == 240
    assert len(folders) == 2 and not any((tmp_path / f).exists() for f in folders)


def test_running_stream_notices_later_files(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    store = BatchStore(spark, str(tmp_path / "out"), FEW)
    query = FileStream(spark, str(landing), store, str(tmp_path / "state")).start(interval="1 second")
    try:
        (landing / "later.php").write_text("<?php\n")
        until = time.monotonic() + 60
        while not store.held().count() and time.monotonic() < until:
            assert query.isActive
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r.batch_id for r in store.read("files").collect()] == ["s-0"]
