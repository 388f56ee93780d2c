"""Reports by batch, with a commit marker, and a file stream that loses nothing.

Layout below the store's root::

    scan/batch_id=.../*.parquet         files with their hits (one scan of the texts)
    issues/batch_id=.../*.parquet       flat issue rows
    files/batch_id=.../*.parquet        status and metrics of each file
    compliance/batch_id=.../*.parquet   each file and standard
    migration/batch_id=.../*.parquet    migration summary of each file
    summary/batch_id=.../*.parquet      one row
    commits/batch_id=.../*.parquet      one row, written last

Readers join with the commits, so a batch that was killed midway is not seen; run
again it replaces its own folders, and once committed it is not written again.
"""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from srclens.operators.catalog import DEFAULT_PACKS
from srclens.operators.gate import MAX_FILE_BYTES
from srclens.operators.rollup import (
    Packs, compliance_array, migration_columns, overview_of, run_summary_of, total_in_hits,
)
from srclens.operators.scan import issues_of, with_hits
from srclens.session import shared_folder
from srclens.sources import tree
from srclens.sources.corpus import PHP_GLOB, from_read

REPORT_TABLES = ("issues", "files", "compliance", "migration", "summary")
STREAM, RECONCILED = "s", "r"
NAMES = "path STRING, modificationTime TIMESTAMP, length LONG"


def _compliance(scanned: DataFrame, packs: Packs) -> DataFrame:
    graded = tuple(p for p in packs if p.name == "psr")
    rows = compliance_array(graded, F.col("hits").isNotNull(), total_in_hits)
    return scanned.select("file_id", F.explode(rows).alias("c")).select("file_id", "c.*")


def _migration(scanned: DataFrame, packs: Packs) -> DataFrame:
    hints = tuple(p for p in packs if p.name == "migration")
    summary = F.struct(*[c.alias(n) for n, c in migration_columns(hints, total_in_hits).items()])
    return scanned.where(F.col("hits").isNotNull()).select("file_id", summary.alias("s")).select("file_id", "s.*")


class BatchStore:
    """Report tables of batches.  One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, packs: Packs = DEFAULT_PACKS) -> None:
        self.spark, self.root, self.packs = spark, root.rstrip("/"), packs

    def _folder(self, table: str, batch_id: str) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def _put(self, rows: DataFrame, table: str, batch_id: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._folder(table, batch_id))
        return self.spark.read.schema(rows.schema).parquet(self._folder(table, batch_id))

    def committed(self, batch_id: str) -> bool:
        try:
            return not self.spark.read.schema("files LONG").parquet(self._folder("commits", batch_id)).isEmpty()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    def write(self, files: DataFrame, batch_id: str) -> bool:
        """All reports of a batch; False if it is there already.  The texts are read once."""
        if self.committed(batch_id):
            return False
        keep = ("file_id", "original_name", "path", *(c for c in ("size", "ordinal", "error") if c in files.columns), "hits")
        scanned = self._put(with_hits(files, self.packs).select(*keep), "scan", batch_id)
        self._put(issues_of(scanned, self.packs), "issues", batch_id)
        overview = self._put(overview_of(scanned, self.packs, total_in_hits), "files", batch_id)
        self._put(_compliance(scanned, self.packs), "compliance", batch_id)
        self._put(_migration(scanned, self.packs), "migration", batch_id)
        summary = self._put(run_summary_of(overview), "summary", batch_id)
        # One row in one file, which appears by a rename: the batch is there or it is not.
        self._put(summary.select(F.col("total_files").alias("files")).coalesce(1), "commits", batch_id)
        return True

    def _table(self, table: str) -> DataFrame | None:
        try:
            found = self.spark.read.option("mergeSchema", "false").parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        schema = T.StructType([*[f for f in found.schema if f.name != "batch_id"], T.StructField("batch_id", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def commits(self) -> DataFrame:
        """``batch_id, files`` of the committed batches."""
        found = self._table("commits")
        if found is None:
            return self.spark.createDataFrame([], "batch_id STRING, files LONG")
        return found.select("batch_id", "files")

    def read(self, table: str) -> DataFrame:
        """Rows of a table, of committed batches only."""
        if table not in REPORT_TABLES:
            raise ValueError(f"no such table: {table}")
        rows = self._table(table)
        if rows is None:
            raise FileNotFoundError(f"{self.root}/{table}")
        return rows.join(self.commits().select("batch_id"), "batch_id", "left_semi")

    def held(self, kind: str | None = None) -> DataFrame:
        """``file_id`` of every file in a committed batch (of one kind)."""
        if self._table("files") is None:
            return self.spark.createDataFrame([], "file_id STRING")
        rows = self.read("files")
        if kind:
            rows = rows.where(F.startswith("batch_id", F.lit(f"{kind}-")))
        return rows.select(F.col("file_id").cast("string"))


def write_batch_reports(files: DataFrame, store: BatchStore, checkpoint: str, available_now: bool = False,
                        interval: str = "1 minute") -> StreamingQuery:
    """All reports of each micro-batch of a stream of files, under its batch id."""
    def one(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, f"{STREAM}-{batch_id}")

    return _started(files, one, checkpoint, available_now, interval)


def _started(rows: DataFrame, one, checkpoint: str, available_now: bool, interval: str) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


class FileStream:
    """Reports of every file that lands in a tree, each file exactly once.

    Spark's file source holds every name on the driver.  Here the tree is listed in
    tasks, names not seen before are appended to Parquet tables below the checkpoint,
    and the stream reads those: the driver knows a few tables a listing, no names.
    Micro-batches open the files in tasks (``tree.read_listed``), so a file that is
    gone, damaged or too large is a row.  ``reconcile`` lists the tree and takes what
    no batch holds: empty files and hidden names, which the stream leaves to it, at
    once, and any other file once it is older than ``lag`` seconds.  A micro-batch
    leaves out what another batch took.  A file is known by its path.  All run under
    locks, in one driver.
    """

    def __init__(self, spark: SparkSession, path: str, store: BatchStore, checkpoint: str, glob: str | None = PHP_GLOB,
                 max_bytes: int | None = MAX_FILE_BYTES, lag: int = 3600) -> None:
        self.spark, self.path, self.store, self.checkpoint = spark, path, store, checkpoint
        self.glob, self.max_bytes, self.lag = glob, max_bytes, lag
        self.names = f"{checkpoint.rstrip('/')}/names"
        self._lock, self._noticing = threading.Lock(), threading.Lock()

    def _write(self, listing: DataFrame, batch_id: str) -> bool:
        return self.store.write(from_read(tree.read_listed(listing, self.max_bytes)), batch_id)

    def _micro_batch(self, names: DataFrame, number: int) -> None:
        with self._lock:
            batch_id = f"{STREAM}-{number}"
            if not self.store.committed(batch_id):
                taken = self.store.held().withColumnRenamed("file_id", "path")
                self._write(names.join(taken, "path", "left_anti"), batch_id)

    def _left_to_reconciling(self) -> Column:
        """Whether a listed file is none of the stream's: empty, unreadable, or hidden by its name or a directory's."""
        name = F.regexp_replace("path", "^.*/", "")
        below = F.regexp_replace("path", "/[^/]*$", "")
        root = tree.Place(self.path)
        hidden = F.rlike(F.substring(below, len(root.spelled(root.inner)) + 1, 1 << 30), F.lit(r"/[_.]"))
        return (F.col("length") == 0) | name.startswith("_") | name.startswith(".") | F.col("error").isNotNull() | hidden

    def notice(self) -> None:
        """List the tree in tasks and append the names that were not there before to the table the stream reads."""
        with self._noticing:
            # A hidden folder: it makes the table, and the stream sees nothing in it.
            self.spark.createDataFrame([], NAMES).write.mode("ignore").parquet(f"{self.names}/_empty")
            folder = shared_folder(self.spark)
            listed = tree.list_tree(self.spark, self.path, self.glob, folder).where(~self._left_to_reconciling())
            seen = self.spark.read.schema(NAMES).parquet(self.names).select("path")
            fresh = listed.select("path", "modificationTime", "length").join(seen, "path", "left_anti")
            if not fresh.isEmpty():  # a table without rows would be a batch
                fresh.write.mode("append").parquet(self.names)
            tree.remove_directories(self.spark.createDataFrame([(folder,)], "path STRING")).collect()

    def _keep_noticing(self, query: StreamingQuery, seconds: float) -> None:
        try:
            while not query.awaitTermination(seconds):
                self.notice()
        except BaseException:
            query.stop()
            raise

    def start(self, available_now: bool = False, interval: str = "1 minute") -> StreamingQuery:
        """Micro-batches of newly landed names; their contents are read in ``read_listed``."""
        self.notice()
        names = self.spark.readStream.schema(NAMES).parquet(self.names)
        query = _started(names, self._micro_batch, self.checkpoint, available_now, interval)
        if not available_now:
            seconds = self.spark.range(1).select(F.expr(
                f"unix_millis(timestamp_seconds(0) + INTERVAL '{interval}') / 1000")).first()[0]
            threading.Thread(target=self._keep_noticing, args=(query, float(seconds)), daemon=True).start()
        return query

    def reconcile(self) -> int:
        """Take the files that no batch holds; how many there were.  Paths are joined, never contents."""
        with self._lock:
            done = self.store.commits().where(F.startswith("batch_id", F.lit(f"{RECONCILED}-"))).count()
            held = self.store.held().withColumnRenamed("file_id", "path")
            old = F.unix_timestamp("modificationTime") <= F.unix_timestamp() - self.lag
            left = tree.list_tree(self.spark, self.path, self.glob).where(self._left_to_reconciling() | old).join(held, "path", "left_anti")
            batch_id = f"{RECONCILED}-{done}"
            if left.isEmpty():
                return 0
            self._write(left, batch_id)
            return self.store.commits().where(F.col("batch_id") == batch_id).first()["files"]
