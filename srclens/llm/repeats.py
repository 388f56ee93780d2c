"""Removal of repeated byte strings with suffix arrays in shards.

A string of ``LEAST`` bytes that stands in two places has the same anchor in
both: the first 32-byte substring with the least hash among those inside it, where
those of a short period come last: they stand in every period.  So only windows
around anchors that stand in several places can hold repeats.  Windows
with one anchor meet in one shard, equal windows as one; there a suffix array
(``suffix``) finds every string that starts in two places.  A window that stands in
several places is repeated whole, so only those that stand once are searched.

Anchors, windows and spans are rows; a passage in a third of all documents is one
window for its inner anchors, summed up before it is shuffled, and equal windows of
one text that touch are one row.  An anchor with more
distinct windows than a shard should hold is split by what lies around it (``_parted``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import (
    bounded_batches, groups, mixed, packed_texts, plain_names, prefix_sums, substrings, table, text_bytes, text_key,
    unpacked, written)
from srclens.llm.suffix import repeated

LEAST = 200
ANCHOR = 32
SHARD_BYTES = 2 << 20
PIECE = "many boolean, text_key long, start long, before int, bytes binary, low int, high int"
HELD = "anchor long, window long, many boolean, text_key long, start long, before int, bytes binary"


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` successive values, from the least and greatest of blocks."""
    n = len(a) - width + 1
    blocks = np.pad(a, (0, -len(a) % width), mode="edge").reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1:width - 1 + n])


def _periodic(data: np.ndarray) -> np.ndarray:
    """True where the ``ANCHOR`` bytes from a place on have a period of at most half their length."""
    n, half = len(data) - ANCHOR + 1, ANCHOR // 2
    out = np.zeros(n, bool)
    for period in range(1, half + 1):
        same, k = data[:-period] == data[period:], 1
        while k < half:
            same = same[:-k] & same[k:]
            k *= 2
        out |= same[:n] & same[half - period:half - period + n]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, least: int = LEAST):
    """For the texts of a group: text and place of each anchor, its hash, the window's hash and reach.

    The window is what the strings that have this anchor cover, from ``before`` bytes before
    the anchor to ``after`` bytes from its start on; a string is in one window.
    """
    n, span = len(data), least - ANCHOR + 1
    sizes = np.diff(offsets)
    if n < least or not (sizes >= least).any():
        return (np.zeros(0, np.int64),) * 6
    sums = prefix_sums(data)
    places = np.arange(n - ANCHOR + 1)
    h = substrings(sums, places, places + ANCHOR)
    rank = (h >> np.uint64(33)) | (_periodic(data).astype(np.uint64) << np.uint64(31))
    least_at = _sliding((rank << np.uint64(32)) | places.astype(np.uint64), span, np.minimum)
    starts = np.flatnonzero((np.repeat(offsets[1:], sizes) - np.arange(n) >= least)[:len(least_at)])
    at = (least_at[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    low, high = starts[first], starts[np.append(first[1:], len(at)) - 1] + least
    at = at[first]
    text = np.searchsorted(offsets, at, "right") - 1
    window = mixed(substrings(sums, low, high) + (at - low).astype(np.uint64))
    return text, at - offsets[text], h[at].view(np.int64), window.view(np.int64), at - low, high - at


def joined_runs(text: np.ndarray, at: np.ndarray, h: np.ndarray, w: np.ndarray, before: np.ndarray, after: np.ndarray):
    """Equal windows of one text that touch, as one row: the input columns, of the first of each run, and the last place.

    In a passage of a short period the strings have an anchor in every period, all with
    equal windows: one row covers them, however long the passage is.
    """
    by = np.lexsort((at, w, h, text))
    text, at, h, w, before, after = (c[by] for c in (text, at, h, w, before, after))
    new = np.ones(len(at), bool)
    new[1:] = ((text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])
               | (at[1:] - before[1:] > at[:-1] + after[:-1]))
    first = np.flatnonzero(new)
    last = at[np.append(first[1:], len(at)) - 1] if len(at) else at
    return (*(c[first] for c in (text, at, h, w, before, after)), last)


def _anchor_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in groups(offsets):
                own, places = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                text, at, h, w, before, after, last = joined_runs(*anchors(own, places, least))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text_key(own, places)[text]), pa.array(at, pa.int64()), pa.array(h), pa.array(w),
                     pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(last, pa.int64())],
                    ["text_key", "place", "anchor", "window", "before", "after", "last"])
    return run


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the windows asked for of each text."""
    names = ["anchor", "window", "many", "text_key", "start", "before", "bytes", "hot"]
    for batch in batches:
        out = []
        for key, packed, asked in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = unpacked(packed)
            for w in asked:
                start = w["place"] - w["before"]
                out.append((w["anchor"], w["window"], w["many"], key, start, w["before"],
                            text[start:w["place"] + w["after"]], w["hot"]))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names)


def _halves(least: int):
    """The strings of each piece in two halves, by how far before the anchor they start (low <= bytes < high).

    A half reaches as far as its strings do.  Its core is what they all hold, so that
    equal strings have equal cores; a half of one string is its core.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("bytes"))
            for x, y in groups(offsets):
                own, places = data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x]
                rows, raw, sums = batch.slice(x, y - x), own.tobytes(), prefix_sums(own)
                start, before, low, high = (
                    rows.column(c).to_numpy().astype(np.int64) for c in ("start", "before", "low", "high"))
                at = places[:-1] + before
                after = places[1:] - at
                for a, b in ((low, (low + high) // 2), ((low + high) // 2, high)):
                    k = np.flatnonzero(np.maximum(a, least - after) <= np.minimum(b - 1, before))
                    a, b, p, reach = a[k], b[k], at[k], np.minimum(before[k], b[k] - 1)
                    stop = p + np.minimum(after[k], least - a)
                    core = mixed(substrings(sums, p - a, p - b + 1 + least) + (a * 2 * least + b).astype(np.uint64))
                    piece = mixed(substrings(sums, p - reach, stop) + reach.astype(np.uint64))
                    cut = [raw[i:j] for i, j in zip((p - reach).tolist(), stop.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c).take(pa.array(k)) for c in ("many", "text_key")),
                         pa.array(start[k] + before[k] - reach), pa.array(reach, pa.int32()), pa.array(cut, pa.binary()),
                         pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                         pa.array(core.view(np.int64)), pa.array(piece.view(np.int64))],
                        ["many", "text_key", "start", "before", "bytes", "low", "high", "core", "piece"])
    return run


def _parted(windows: DataFrame, least: int, limit: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Windows of anchors too large for a shard: pieces to sort, spans that need no sorting, bytes to sort.

    All windows of one anchor are aligned by it.  Level by level the strings through it
    are halved, and the halves meet by their cores.  A piece that stands twice is repeated
    whole in each place and goes on as one row; one that stands once goes on under its own
    place.  A core with one distinct piece, or with repeated pieces only, is settled; one
    with few distinct pieces is a group of a shard, and the others are halved again.  At the
    last level a piece is one string and equals its core, so every group gets small enough.
    """
    pieces = windows.withColumns({"low": F.lit(0), "high": F.lit(least - ANCHOR + 1)})
    sort, whole, size = [], [], 0
    while True:
        rows = written(pieces.select("many", "text_key", "start", "before", "bytes", "low", "high").mapInArrow(
            _halves(least), PIECE + ", core long, piece long"))
        kinds = written(rows.groupBy("core", "piece").agg(
            ((F.count("*") > 1) | F.max("many")).alias("many"),
            F.min(F.struct("text_key", "start", "before", "bytes", "low", "high")).alias("one")))
        whole.append(rows.where("NOT many").join(kinds.where("many").select("core", "piece"), ["core", "piece"], "leftsemi").select(
            "text_key", F.col("start").alias("a"), (F.col("start") + F.octet_length("bytes")).alias("b")))
        cores = written(kinds.groupBy("core").agg(
            F.count("*").alias("pieces"), F.min("many").alias("settled"), F.sum(F.octet_length("one.bytes")).alias("size")).where(
            "pieces > 1 AND NOT settled").select("core", "size", (F.col("size") > limit).alias("split")))
        live = kinds.join(cores.select("core", "split"), "core")
        sort.append(live.where("NOT split").select(
            F.col("core").alias("anchor"), F.col("piece").alias("window"), "many", "one.text_key", "one.start", "one.before", "one.bytes"))
        found = {r.split: r.size for r in cores.groupBy("split").agg(F.sum("size").alias("size")).collect()}
        size += found.get(False, 0)
        if True not in found:
            return sort, whole, size
        pieces = live.where("split").select("many", "one.*")


def _shard_finder(least: int):
    def find(rows):
        """What repeats of each window of a shard that stands once: (text_key, a, b), one run each."""
        rows = rows.sort_by([("text_key", "ascending"), ("start", "ascending"), ("window", "ascending")])
        keys, starts = rows.column("text_key").to_pylist(), rows.column("start").to_pylist()
        raw = rows.column("bytes").to_pylist()
        # Overlapping windows of one text become one stretch: each place stands once.
        parts, bounds, at, size, last = [], [0], [], 0, (None, 0)
        for key, start, window in zip(keys, starts, raw):
            if last[0] == key and start <= last[1]:
                new = window[last[1] - start:]
            else:
                if size:
                    bounds.append(size)
                new = window
            at.append(size + len(new) - len(window) if len(new) or last[0] != key else size - (last[1] - start))
            parts.append(new)
            size += len(new)
            last = (key, max(last[1] if last[0] == key else 0, start + len(window)))
        bounds.append(size)
        flagged = np.flatnonzero(repeated(np.frombuffer(b"".join(parts), np.uint8), np.array(bounds, np.int64), least))
        once = np.flatnonzero(~rows.column("many").to_numpy())
        at, start = np.array(at, np.int64)[once], np.array(starts, np.int64)[once]
        first = np.searchsorted(flagged, at)
        stop = np.searchsorted(flagged, at + np.fromiter(map(len, raw), np.int64, len(raw))[once] - least + 1)
        hit = stop > first
        at, start, first, stop = at[hit], start[hit], first[hit], stop[hit]
        # Two strings of a window overlap, as it is shorter than both together: they are one run.
        return pa.table([rows.column("text_key").take(pa.array(once[hit])), pa.array(start + flagged[first] - at),
                         pa.array(start + flagged[stop - 1] + least - at)], names=["text_key", "a", "b"])
    return find


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(text_key, spans): for each distinct text with repeats, places (a, b) that cover them; they may overlap."""
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string").cast("binary").alias("text")
    rows = written(docs.select(text).where(F.octet_length("text") >= least).mapInArrow(
        _anchor_rows(least),
        "text_key long, place long, anchor long, window long, before int, after int, last long"))
    run = F.col("last") > F.col("place")  # stands several times by itself
    shared = written(rows.groupBy("anchor").agg(
        (F.count("*") + F.count_if(run)).alias("n"), F.min("window").alias("w0"), F.max("window").alias("w1")).where("n > 1").select(
        "anchor", "n", (F.col("w0") != F.col("w1")).alias("differ")))
    members = written(rows.join(shared.drop("n"), "anchor"))

    # A window that stands in several places is repeated whole, and so is each one of an anchor
    # whose windows are all equal.  Only windows that stand once are searched, among all of their
    # anchor; each has its own place, so that what is found needs no join with places.
    span = ("text_key", (F.col("place") - F.col("before")).alias("a"), (F.col("last") + F.col("after")).alias("b"))
    mixed_members = members.where("differ")
    windows = written(mixed_members.groupBy("anchor", "window").agg(
        ((F.count("*") > 1) | F.max(run)).alias("many"), F.first("text_key").alias("text_key"), F.first("place").alias("place"),
        F.first("before").alias("before"), F.first("after").alias("after")))
    spans = [members.where("NOT differ").select(*span),
             mixed_members.join(windows.where("many").select("anchor", "window"), ["anchor", "window"], "leftsemi").select(*span)]
    windows = windows.join(windows.where("NOT many").select("anchor").distinct(), "anchor", "leftsemi")
    # Anchors too large for their share of a shard; as each has many bytes, they are few.
    limit = SHARD_BYTES // 4
    places = shared.where(F.col("differ") & (F.col("n") * (2 * least - ANCHOR) > limit)).select("anchor")
    hot = written(windows.join(F.broadcast(places), "anchor").groupBy("anchor").agg(
        F.sum(F.col("before") + F.col("after")).alias("size")).where(F.col("size") > limit).select(
        "anchor", F.lit(True).alias("hot")))
    windows = written(windows.join(F.broadcast(hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    keyed = packed_texts(docs.where(F.octet_length(F.col("text").cast("string")) >= least), F.lit(0))
    asked = windows.groupBy("text_key").agg(F.collect_list(F.struct(
        "anchor", "window", "many", "place", "before", "after", "hot")).alias("asked"))
    total = windows.where("NOT hot").agg(F.sum(F.col("before") + F.col("after"))).first()[0] or 0
    once = keyed.select("text_key", "packed").dropDuplicates(["text_key"])  # copies are dropped before the shuffle, too
    cut = once.join(asked, "text_key").select("text_key", "packed", "asked").mapInArrow(
        _cut_windows, HELD + ", hot boolean")
    sort = []
    if hot.first() is not None:
        cut = written(cut)
        sort, whole, more = _parted(cut.where("hot").drop("hot"), least, limit)
        spans += whole
        total += more
    shards = -(-total // SHARD_BYTES) or 1
    rest = reduce(DataFrame.unionByName, sort, cut.where("NOT hot").drop("hot"))
    spans.append(rest.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards))).applyInArrow(
        _shard_finder(least), "text_key long, a long, b long"))
    return reduce(DataFrame.unionByName, spans).groupBy("text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for s in sorted((x["a"], x["b"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to character bounds, so that what remains is still UTF-8."""
    out = []
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text).

    Every byte covered by a string of ``least`` bytes that also starts elsewhere, in
    this or another row, is removed; a null text is empty; equal rows each count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for doc, packed, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text, runs = unpacked(packed), merged(spans)
                kept = without(text, runs)
                out.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    keyed = packed_texts(docs, F.col("doc_id"))
    spans = written(repeated_spans(docs, least))
    return keyed.join(spans, "text_key", "left").select("row", "packed", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without repeated strings, cut at whole characters; n_chars follows the text.

    Columns and rows stay; a text all of which is repeated becomes empty, and a
    null text stays null.  Other columns, of any name, travel beside the text.
    """
    names = docs.columns
    docs = plain_names(docs, ("doc_id", "text", "n_chars"))
    place, schema = docs.columns.index("text"), docs.schema
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_key(*text_bytes(batch.column(place).cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "__key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:len(schema)]
            texts = columns[place].to_pylist()
            changed = []
            for text, spans in zip(texts, batch.column(len(schema)).to_pylist()):
                if spans and text is not None:
                    raw = text.encode()
                    text = without(raw, whole_characters(raw, merged(spans))).decode()
                changed.append(text)
            columns[place] = pa.array(changed, columns[place].type)
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array([o if a is b or a == b else len(b) for o, a, b in zip(old, texts, changed)],
                                            columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:len(schema)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spans = written(repeated_spans(docs, least)).withColumnRenamed("text_key", "__key").withColumnRenamed(
        "spans", "__spans")
    keyed = docs.mapInArrow(keys, fields + ", `__key` bigint").join(spans, "__key", "left")
    return keyed.select(*(F.col(f"`{c}`") for c in docs.columns), "__spans").mapInArrow(run, schema).toDF(*names)


def op8_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_array_repeats": op8_suffix_array_repeats}
ORACLES = {"op8_suffix_array_repeats": """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), k AS (
    SELECT r, i, hash(substr(h, 2 * i + 1, 400)) AS m
    FROM (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)
), f AS (
    SELECT r, i FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)
), cut AS (
    SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM f)
), runs AS (
    SELECT r, min(i) AS a, max(i) + 200 AS b FROM cut GROUP BY r, run
), kept AS (
    SELECT r, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY start) AS k
    FROM (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS start, a FROM (
              SELECT r, a, b FROM runs UNION ALL SELECT r, length(h) // 2, NULL FROM d))
    JOIN d USING (r) GROUP BY r
), n AS (
    SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM runs GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN n USING (r)
"""}
