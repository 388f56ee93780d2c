"""Reports by chunks and ranges against those built inside a file's row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from helpers import files_of
from srclens.operators import assembly
from srclens.operators.assembly import Assembly, chunked
from srclens.operators.ordinal import with_ordinal
from srclens.operators.report import file_reports
from srclens.operators.rollup import file_overview
from srclens.operators.scan import issues
from srclens.sources import store


def texts(seed, n=40):
    rng = random.Random(seed)
    pieces = ["<?php\n", "\t\n", "echo $x; \n", "\n", "  $a=1;\n", "é" * 70 + "\n", "use B\\C;\nuse A\\B;\n", "list($a, $b) = $c;\n",
              "$s = strpos($a, 'b') !== false;\n", "class a {\n", "var $x;", "\r\n", "// " + "x" * 200 + "\n", "function f($a) {\n"]
    out = {f"f{i}.php": "".join(rng.choices(pieces, k=rng.randrange(60))) for i in range(n)}
    return out | {"empty.php": "", "none.php": None, "feed.php": "\n", "long.php": "x" * 500, "end.php": "a\n" * 50,
                  "clean.php": "<?php\n\ndeclare(strict_types=1);\n\nnamespace A;\n\nreturn [];\n"}


def test_chunks_hold_all_lines(spark):
    files = files_of(spark, texts(1))
    body = {r.file_id: r.body for r in files.select("file_id", "body").collect()}
    for size in (1, 7, 50, 10_000):
        rows = chunked(files, size).select("file_id", "chunk", "body").orderBy("file_id", "chunk").collect()
        lines = {}
        for r in rows:
            assert r.body.rfind("\n", 0, max(len(r.body) - 1, 0)) < size + 200 + 70  # lines that begin within a chunk
            lines.setdefault(r.file_id, []).extend(r.body.split("\n"))
        assert lines == {i: b.split("\n") for i, b in body.items() if b is not None}


def shown(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_equal_to_reports_in_a_row(spark):
    files = files_of(spark, texts(2)).withColumn("error", F.when(F.col("body").isNull(), "gone"))
    for given in (files, with_ordinal(files, "original_name")):
        made = Assembly(given, chunk=300)
        assert shown(made.issues()) == shown(issues(given))
        assert shown(made.overview()) == shown(file_overview(given))
        mine, theirs = made.reports(per_part=7), file_reports(given, per_part=7)
        assert mine.columns == theirs.columns
        assert shown(mine) == shown(theirs)
        assert mine.agg(F.max(F.size("issues"))).first()[0] <= 7


def test_no_files(spark):
    made = Assembly(files_of(spark, ["x"]).limit(0))
    assert made.issues().count() == made.overview().count() == made.reports().count() == 0


def test_row_of_a_large_file_stays_small(spark):
    """2 MiB of tab-only lines: no row of the found hits or of the parts holds many of them."""
    files = files_of(spark, {"tabs.php": ("\t" * 40 + "\n") * 51_000})
    made = Assembly(files, chunk=1 << 18)
    row = made.overview().first()
    assert row.total_issues > 200_000
    parts = made.reports().select("part", "parts", F.size("issues").alias("n")).collect()
    assert len(parts) == parts[0].parts == -(-row.total_issues // 10_000)
    assert max(p.n for p in parts) == 10_000 and sum(p.n for p in parts) == row.total_issues
    seqs = made.hits().agg(F.count("*"), F.count_distinct("seq"), F.max("seq")).first()
    assert tuple(seqs) == (row.total_issues,) * 3


def test_store_with_large_texts(spark, tmp_path):
    """Texts over the limit go by chunks, the others in their row; the tables hold both alike."""
    files = files_of(spark, texts(3, 12))
    store.save_report(files, str(tmp_path), "report_1_x", large=400)
    read = lambda table: store.require_report(spark, str(tmp_path), "report_1_x", table).drop("report_id")
    assert read("scan").where("is_large").count() > 3 and read("scan").where("is_large AND hits IS NOT NULL").count() == 0
    assert shown(read("issues")) == shown(issues(files))
    assert shown(read("files")) == shown(file_overview(files))
    nested = {r.file_id: r for r in store.read_nested(spark, str(tmp_path), "report_1_x").collect()}
    for r in file_reports(files).collect():
        assert (nested[str(r.file_id)].issues, nested[str(r.file_id)].metrics) == (r.issues, r.metrics)


def test_short_texts_are_scanned_once(spark, monkeypatch):
    """Short texts of one chunk reach no second pass by file rules, and the exploded form none of them."""
    seen = []
    plain = assembly.hit_rows

    def watched(files, packs, *keep, **more):
        seen.append((keep, {r.file_id for r in files.select("file_id").collect()}))
        return plain(files, packs, *keep, **more)

    monkeypatch.setattr(assembly, "hit_rows", watched)
    files = files_of(spark, texts(4, 20))
    length = {r.file_id: r.n for r in files.select("file_id", F.length("body").alias("n")).collect()}
    for chunk, in_row in ((300, 1 << 16), (300, 100), (1 << 20, 200)):
        seen.clear()
        monkeypatch.setattr(assembly, "IN_ROW", in_row)
        made = Assembly(files, chunk=chunk)
        long = {i for i, n in length.items() if n is not None and n > min(chunk, in_row)}
        assert seen[0] == (("file_id",), long) and 0 < len(long) < len(length)
        assert [k for k, _ in seen[1:]] == ([] if chunk <= in_row else [("file_id", "chunk")])
        assert shown(made.issues()) == shown(issues(files))
        assert shown(made.overview()) == shown(file_overview(files))
