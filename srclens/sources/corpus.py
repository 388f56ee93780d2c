"""Sources: directories of files, or any table with a key and a text column.

Both give the same ``files`` DataFrame, one row per file::

    file_id, original_name, stored_name, path, size, mime_type, modified, body

``body`` is the byte view of the content, null where it could not be read.  The
file sources add ``error``, the reason for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.functions.text import base_name, byte_view
from srclens.operators.gate import MAX_FILE_BYTES, TOO_BIG
from srclens.sources import tree

PHP_GLOB = "*.[pP][hH][pP]"
HIDDEN_NAME = "nom caché, non lu par la source"
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Metadata of the files below ``path``; the contents are not read."""
    return _binary(spark.read, path, glob, recursive).select("path", "modificationTime", "length")


def _binary(reader, path: str, glob: str | None, recursive: bool) -> DataFrame:
    reader = reader.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def all_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, modificationTime, length`` of every regular file of a tree, whatever its name or size.

    Spark's file source lists neither empty files nor names that begin with ``_`` or
    ``.``; this listing by the file system has them.  It is made by the driver.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    wanted = jvm.org.apache.hadoop.fs.GlobFilter(glob) if glob else None
    rows, found = [], system.listFiles(root, True)
    while found.hasNext():
        status = found.next()
        if wanted is None or wanted.accept(status.getPath()):
            rows.append((status.getPath().toString(), status.getModificationTime(), status.getLen()))
    listed = spark.createDataFrame(rows, "path STRING, millis LONG, length LONG")
    return listed.select("path", F.timestamp_millis("millis").alias("modificationTime"), "length")


def read_files(spark: SparkSession, path: str, glob: str | None = PHP_GLOB,
               max_bytes: int | None = MAX_FILE_BYTES, in_tasks: bool | None = None) -> DataFrame:
    """A corpus from a directory tree: a row for every file, none left out.

    The tree is listed and its files are opened in tasks (``tree``): hidden names and
    empty files are read like any other.  ``error`` says why a file has no body: it is
    larger than ``max_bytes`` and was not opened, it is gone since it was listed, or
    it cannot be read.  A store that only Spark reaches (``in_tasks`` False; found out
    when not given) is read by ``read_by_source`` instead.
    """
    if in_tasks is None:
        in_tasks = tree.reachable(path)
    if not in_tasks:
        return read_by_source(spark, path, glob, max_bytes)
    return from_read(tree.read_listed(tree.list_tree(spark, path, glob), max_bytes))


def read_by_source(spark: SparkSession, path: str, glob: str | None = PHP_GLOB,
                   max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """The same by Spark's file source, listed by the driver.

    Files over ``max_bytes`` are found by a predicate on ``length`` and not opened.
    Names that begin with ``_`` or ``.`` have a reason, as the source does not open
    them; a file that vanishes after the listing ends the job.
    """
    read = from_binary(_binary(spark.read, path, glob, True), max_bytes)
    left_out = all_files(spark, path, glob).join(list_files(spark, path, glob).select("path"), "path", "left_anti")
    empty = F.col("length") == 0
    rows = _file_columns(left_out, F.when(empty, ""), F.when(~empty, HIDDEN_NAME))
    return read.unionByName(rows)


def from_read(rows: DataFrame) -> DataFrame:
    """A corpus from ``tree.read_listed``: rows without content keep their reason."""
    return _file_columns(rows, byte_view(F.col("content")), F.col("error"))


def stream_files(spark: SparkSession, path: str, glob: str | None = PHP_GLOB,
                 max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """The same corpus as a stream of newly landed files.

    The file source of a stream does not see empty files and hidden names;
    ``streaming.batches.FileStream`` brings them in.
    """
    reader = spark.readStream.schema(BINARY_FILE)
    return from_binary(_binary(reader, path, glob, True), max_bytes)


def from_binary(binary: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """A corpus from rows ``path, modificationTime, length, content``.

    A row longer than ``max_bytes`` stays, without a body and with the gate's error;
    the two halves are told apart by ``length`` alone, so its content is not read.
    """
    none = F.lit(None).cast("string")
    if max_bytes is None:
        return _file_columns(binary, byte_view(F.col("content")), none)
    fits = F.col("length") <= max_bytes
    small = _file_columns(binary.where(fits), byte_view(F.col("content")), none)
    return small.unionByName(_file_columns(binary.where(~fits), none, F.lit(TOO_BIG)))


def _file_columns(rows: DataFrame, body: Column, error: Column) -> DataFrame:
    name = base_name(F.col("path"))
    return rows.select(
        F.col("path").alias("file_id"), name.alias("original_name"), name.alias("stored_name"),
        "path", F.col("length").alias("size"), F.lit(None).cast("string").alias("mime_type"),
        F.col("modificationTime").alias("modified"), body.alias("body"), error.alias("error"))


def with_missing(files: DataFrame, listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` plus a row for every manifest entry that the file source did not give.

    The file source leaves out empty files, and a file may be gone or unreadable
    by the time of the scan.  An entry of size 0 becomes an empty text, any other
    one an unreadable file (null body).  ``listed`` is the listing (``path``);
    only paths are joined, never contents.  ``manifest`` has ``original_name,
    stored_name, path, size, mime_type`` with paths as the file source spells them.
    """
    known = listed.select("path").unionByName(files.select("path"))
    missing = manifest.join(known, "path", "left_anti")
    rows = missing.select(
        F.col("path").alias("file_id"), "original_name", "stored_name", "path", "size", "mime_type",
        F.lit(None).cast("timestamp").alias("modified"), F.when(F.col("size") == 0, "").alias("body"))
    return files.unionByName(rows, allowMissingColumns=True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores when the table comes in fewer splits than there are cores.

    Scanning is compute-bound, so a table in one small file would otherwise keep
    one core busy.  A table with enough splits is left alone: no shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def from_table(df: DataFrame, key: Column, text: Column, original_name: Column,
               stored_name: Column | None = None, path: Column | None = None) -> DataFrame:
    """A corpus from a table: one file per row, the whole text as its content."""
    stored = original_name if stored_name is None else stored_name
    return df.select(
        key.alias("file_id"), original_name.alias("original_name"), stored.alias("stored_name"),
        (stored if path is None else path).alias("path"),
        F.octet_length(text).cast("long").alias("size"),
        F.lit(None).cast("string").alias("mime_type"),
        F.lit(None).cast("timestamp").alias("modified"), byte_view(text).alias("body"))
