"""What the operators share: tables in the shared folder, folds, Arrow views."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same rows, written once to the folder all executors share and read again.

    Cuts the lineage: a lost executor costs no more than the stage that reads.
    """
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of a few MB, unless the session says otherwise.

    Spark's own limit counts rows, and ten thousand long texts are no small batch.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def plain_names(docs: DataFrame, keep: Iterable[str]) -> DataFrame:
    """``docs`` with columns c0, c1, ... but for those in ``keep``.

    For operators that add columns: the input's own names may clash with them.
    """
    keep = set(keep)
    return docs.toDF(*(n if n in keep else f"c{i}" for i, n in enumerate(docs.columns)))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    found = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return found, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_CODES = byte_codes(7)
_PLACES = byte_codes(11)[:64] | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, kept between calls up to a few MB."""
    if len(_powers[0]) < n:
        both = [np.full(n, b, np.uint64) for b in (_BASE, _BACK)]
        for p in both:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        if n > 1 << 23:
            return both[0], both[1]
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """Sums of code * base**place before each place; see ``substrings``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def substrings(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string [start, end), wherever it stands."""
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mixed(h + (ends - starts).astype(np.uint64))


def groups(offsets: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together (a longer text stands alone)."""
    out, start = [], 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(offsets) - 1)
        out.append((start, stop))
        start = stop
    return out


class Words:
    """The words of some texts: maximal runs of bytes other than ASCII white space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        self.data = LOWER[data] if lower else data
        first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        first[offsets] = True
        last[offsets] = True
        blank = BLANK[data]
        before = np.concatenate([[True], blank[:-1]]) if len(data) else blank
        after = np.concatenate([blank[1:], [True]]) if len(data) else blank
        self.starts = np.flatnonzero(~blank & (before | first[:-1]))
        self.ends = np.flatnonzero(~blank & (after | last[1:])) + 1
        self.sums = prefix_sums(self.data)
        self.hashes = substrings(self.sums, self.starts, self.ends)
        self.counts = np.diff(np.searchsorted(self.starts, offsets))  # words of each text
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n successive words and the bounds of each text; a shorter text is one shingle."""
        full = np.maximum(self.counts - n + 1, 0)
        many = np.where(self.counts > 0, np.maximum(full, 1), 0)
        bounds = np.concatenate([[0], np.cumsum(many)])
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], many)
        stop = np.repeat(self.bounds[1:], many)
        out = np.zeros(len(at), np.uint64)
        for i in range(n):
            word = self.hashes[np.minimum(at + i, max(len(self.hashes) - 1, 0))] if len(at) else out
            out += np.where(at + i < stop, word, np.uint64(1)) * _PLACES[i % len(_PLACES)]
        return mixed(out), bounds


def text_key(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each whole text."""
    found = [substrings(prefix_sums(data[offsets[a]:offsets[b]]), offsets[a:b] - offsets[a], offsets[a + 1:b + 1] - offsets[a])
             for a, b in groups(offsets)]
    return np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(text_key(data, offsets)),
             pa.array([press(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary())],
            ["row", "text_key", "packed"])


def packed_texts(docs: DataFrame, row: Column) -> DataFrame:
    """(row, text_key, packed): texts as compressed bytes, a third of their size in a shuffle."""
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string").cast("binary")
    return docs.select(row.cast("long").alias("row"), text.alias("text")).mapInArrow(
        _pack, "row long, text_key long, packed binary")


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)
