"""Revisit resolution over WARC archives.

Headers (id, length, digest) are shuffled by payload digest, never the payloads.
Among records with equal payloads of at least ``least`` bytes the one with the
largest id is the response; the others become revisit records that name it.
The archives are written by Spark's text writer: a record is one row, and the
line separator is the blank line pair that ends a WARC record, so any file
system Spark knows can hold them, and a lost task is simply written again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import table, written
from srclens.session import shared_folder

LEAST = 1000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, uri string"


def decisions(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """For each (id, digest) that is a revisit, the id of its response.

    ``headers``: page_id, payload_bytes, payload_digest.  A digest group is only
    ever summed up (largest id, partial sums first); the join back carries bare headers.
    """
    long_ones = headers.where(F.col("payload_bytes") >= least)
    originals = long_ones.groupBy("payload_digest").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where(
        (F.col("copies") > 1) & F.col("refers_to").isNotNull())
    return (long_ones.join(originals.drop("copies"), "payload_digest")
            .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("page_id", "payload_digest", "refers_to").distinct())


def _line(text) -> F.Column:
    """A header value: line breaks and other controls would end the header."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", " ")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into gzipped archives.

    A null html is an empty payload.  Rows equal in id and payload are the same
    record and get the same type; a null id sorts before all others.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), _line(F.col("url")).alias("url"), payload.alias("html"),
        F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"))
    # Written first: the planner then knows its size and broadcasts it only below its limit.
    revisits = written(decisions(rows.select("page_id", "payload_digest", "payload_bytes"), least))
    d = revisits.toDF("d_page", "d_digest", "refers_to")
    rows = rows.join(
        d, F.col("page_id").eqNullSafe(F.col("d_page")) & (F.col("payload_digest") == F.col("d_digest")), "left")
    again = F.col("refers_to").isNotNull()
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), number,
        F.lit(">\r\nWARC-Date: "), F.lit(date),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: <urn:page:"),
                               F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.when(again, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(END), F.when(again, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.text(folder, compression="gzip", lineSep=END)


def _page(uri: str | None) -> int | None:
    number = uri[len("<urn:page:"):-1] if uri else "null"
    return None if number == "null" else int(number)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a stream of pieces, cut by Content-Length; payloads are hashed, not kept."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string())])
    end = END.encode()
    held, head, want = b"", None, 0
    for batch in batches:
        out = []
        pieces = [held] if held else []
        size = len(held)
        for piece in batch.column(0).to_pylist():
            pieces += (piece, end)
            size += len(piece) + len(end)
            if size < want:  # a long payload goes on
                continue
            data, at = b"".join(pieces), 0
            while True:
                if head is None:
                    stop = data.find(end, at)
                    if stop < 0:
                        break
                    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
                    head = dict(x.split(": ", 1) for x in lines[1:])
                    at, want = stop + len(end), int(head["Content-Length"]) + len(end)
                if len(data) - at < want:
                    break
                payload = data[at:at + want - len(end)]
                found, named = None, head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response":
                    found = hashlib.sha1(payload).hexdigest()
                    if found != named:
                        raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                out.append((_page(head["WARC-Record-ID"]), head["WARC-Type"],
                            None if found is None else len(payload), named,
                            _page(head.get("WARC-Refers-To")), head.get("WARC-Target-URI")))
                at, head, want = at + want, None, 0
            pieces, size = [data[at:]] if at < len(data) else [], len(data) - at
        held = b"".join(pieces)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)
    if held or head is not None:
        raise ValueError("an archive ends inside a record")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives; a revisit has the length of its response.

    Files are streamed in pieces (a gzip file is never split), so memory is bounded
    by the longest record.
    """
    pieces = spark.read.text(folder, lineSep=END).select(F.col("value").cast("binary").alias("value"))
    records = written(pieces.mapInArrow(_records, HEADERS))
    responses = records.where("record_type = 'response'")
    lengths = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("known_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(
        lengths, ["refers_to", "payload_digest"], "left").withColumnRenamed("known_bytes", "payload_bytes")
    return responses.unionByName(revisits)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through written and reread archives."""
    folder = shared_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc_revisits": op3_warc_revisits}

ORACLES = {"op3_warc_revisits": f"""
WITH r AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), o AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM r
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> last_id THEN last_id END AS refers_to
FROM o
"""}
