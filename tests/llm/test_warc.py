from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest

from srclens.llm import warc

LONG, OTHER = "x" * 1200 + "\r\n\r\nWARC/1.1\r\n\r\n", "é" * 700 + "\r\n"
PAGES = [(1, "http://a", LONG), (2, "http://b\r\nX: y", LONG), (9, None, LONG), (9, None, LONG), (3, "u", "short"),
         (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", OTHER), (8, "u", OTHER), (None, "u", OTHER),
         (10, "u", "\r\n" * 800), (11, "u", "\r\n" * 800), (12, "u", "y" * 3_000_000)]
SCHEMA = "page_id long, url string, html string"


def run(spark, rows, folder, schema=SCHEMA):
    warc.write_archives(spark.createDataFrame(rows, schema), str(folder))
    return warc.read_archives(spark, str(folder))


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        last = max(-1 if p is None else p for p in same)
        again = len(data) >= 1000 and page != last
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response",
                    last if again else None))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark, tmp_path):
    got = run(spark, PAGES, tmp_path / "a").select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(PAGES)


def test_archive_bytes(spark, tmp_path):
    run(spark, PAGES[:4], tmp_path / "a")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "a").glob("*.gz")))
    assert data.count(b"WARC-Type: revisit") == 2 and data.count(LONG.encode()) == 2
    assert b"\r\nX: y" not in data


def test_no_rows(spark, tmp_path):
    assert run(spark, [], tmp_path / "a").count() == 0


def test_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "h", "d", 5), (2, "u", None, "e", 6)]
    schema = SCHEMA + ", payload_digest string, refers_to long"
    assert {r.page_id for r in run(spark, rows, tmp_path / "a", schema).collect()} == {1, 2}


def test_damage_is_found():
    import pyarrow as pa
    pieces = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n"
              b"WARC-Payload-Digest: sha1:00\r\nContent-Length: 3", b"abc"]
    batch = pa.record_batch([pa.array(pieces, pa.binary())], names=["value"])
    with pytest.raises(ValueError, match="damaged"):
        list(warc._records(iter([batch])))
