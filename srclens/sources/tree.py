"""File trees listed and read in tasks.

Spark's own file source lists on the driver, leaves out empty files and names that
begin with ``_`` or ``.``, and ends the job when a file is gone.  Here a listing is a
DataFrame: the directories of each level are dealt to tasks, which list them, and
the driver only learns how many there are.  Files are opened in tasks as well; one
that is gone or damaged is a row with a reason, and the job goes on.

Tasks reach files through ``pyarrow.fs``: local and mounted folders, ``s3a``, ``gs``,
``abfss`` and ``hdfs``.  For a store that only Spark reaches see ``corpus.read_files``.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.operators.gate import MAX_FILE_BYTES, TOO_BIG
from srclens.session import shared_folder

GONE = "fichier disparu avant la lecture"
UNREADABLE_FILE = "fichier illisible"

DIRECTORIES_PER_TASK = 16
BYTES_PER_TASK = 64 << 20
FILES_PER_TASK = 2000
BATCH_BYTES = 4 << 20
BATCH_ROWS = 10_000
SAME_SCHEME = {"s3a": "s3", "s3n": "s3"}

LISTED = "path STRING, modificationTime TIMESTAMP, length LONG, is_dir BOOLEAN, error STRING"
READ = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY, error STRING"
_MOMENT = pa.timestamp("us", tz="UTC")


class Place:
    """The file system of a location, and how paths in it are spelled for Spark."""

    def __init__(self, uri: str) -> None:
        scheme, colon, rest = uri.partition(":")
        if not colon or "/" in scheme:
            scheme, rest = "file", os.path.abspath(uri)
        if scheme == "file":
            self.system, self.inner, self.shown = fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
            return
        authority, _, path = rest.lstrip("/").partition("/")
        self.system, root = fs.FileSystem.from_uri(f"{SAME_SCHEME.get(scheme, scheme)}://{authority}")
        self.inner = f"{root.rstrip('/')}/{path}".rstrip("/")
        self.shown = f"{scheme}://{authority}"
        self._root = root.rstrip("/")

    def spelled(self, inner: str) -> str:
        if self.shown == "file:":
            return self.shown + inner
        return self.shown + inner.removeprefix(self._root)


def reachable(uri: str) -> bool:
    """Whether tasks can open files of this location themselves."""
    try:
        Place(uri)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def _reason(problem: BaseException) -> str:
    if isinstance(problem, FileNotFoundError):
        return GONE
    return f"{UNREADABLE_FILE} ({type(problem).__name__})"


def _entries(directory: str, glob: str | None) -> Iterator[tuple]:
    """What lies directly in a directory; links to directories are not followed."""
    try:
        place = Place(directory)
        found = place.system.get_file_info(fs.FileSelector(place.inner, recursive=False))
    except (OSError, pa.ArrowException) as problem:
        yield directory, None, None, True, _reason(problem)
        return
    for info in found:
        is_dir = info.type == fs.FileType.Directory
        if is_dir:
            if not (place.shown == "file:" and os.path.islink(info.path)):
                yield place.spelled(info.path), info.mtime, None, True, None
        elif info.type == fs.FileType.File and (glob is None or fnmatch.fnmatchcase(info.base_name, glob)):
            yield place.spelled(info.path), info.mtime, info.size, False, None


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_LISTED = pa.schema([("path", pa.string()), ("modificationTime", _MOMENT), ("length", pa.int64()),
                     ("is_dir", pa.bool_()), ("error", pa.string())])
_READ = pa.schema([("path", pa.string()), ("modificationTime", _MOMENT), ("length", pa.int64()),
                   ("content", pa.binary()), ("error", pa.string())])


def list_directories(directories: DataFrame, glob: str | None = None) -> DataFrame:
    """Entries of each directory (column ``path``): ``path, modificationTime, length, is_dir, error``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for directory in batch.column("path").to_pylist():
                yield from _batches(_entries(directory, glob), _LISTED)

    return directories.select("path").mapInArrow(run, LISTED)


def list_tree(spark: SparkSession, root: str, glob: str | None = None, folder: str | None = None) -> DataFrame:
    """``path, modificationTime, length, error`` of every regular file below ``root``.

    Empty files and names that begin with ``_`` or ``.`` are files like any other.
    Level by level the directories are listed in tasks and the level is written to the
    shared folder; one directory's entries are held by one task.  A directory that
    cannot be listed is a row with a reason, a root that cannot is an error.  A caller
    that names the new ``folder`` can remove it.
    """
    folder, level, found = folder or shared_folder(spark), 0, []
    todo, many = spark.createDataFrame([(root,)], "path STRING"), 1
    while many:
        tasks = max(-(-many // DIRECTORIES_PER_TASK), 1)
        where = f"{folder}/level={level}"
        list_directories(todo.repartition(min(tasks, 10_000), "path"), glob).write.parquet(where)
        rows = spark.read.schema(LISTED).parquet(where)
        if level == 0:
            failed = rows.where("is_dir AND error IS NOT NULL").first()
            if failed:
                raise FileNotFoundError(f"{root}: {failed['error']}")
        found.append(rows)
        todo = rows.where("is_dir AND error IS NULL").select("path")
        many, level = todo.count(), level + 1
    every = spark.read.schema(LISTED + ", level INT").parquet(folder)
    return every.where("NOT is_dir OR error IS NOT NULL").select("path", "modificationTime", "length", "error")


def list_directory(spark: SparkSession, directory: str) -> DataFrame:
    """``path, modificationTime, length`` of the regular files directly in a directory, listed by a task."""
    rows = list_directories(spark.createDataFrame([(directory,)], "path STRING").coalesce(1))
    return rows.where("NOT is_dir").select("path", "modificationTime", "length")


def _contents(rows: Iterable[tuple], max_bytes: int | None) -> Iterator[tuple]:
    places: dict[str, Place] = {}
    for path, moment, length in rows:
        try:
            top = path[:path.find("/", path.find("://") + 3)] if "://" in path else "file:"
            place = places.get(top)
            if place is None:
                place = places[top] = Place(top if "://" in top else "file:/")
            inner = path.removeprefix("file:") if place.shown == "file:" else place._root + path.removeprefix(place.shown)
            with place.system.open_input_stream(inner) as file:
                # One byte more than allowed tells a file that has grown since it was listed.
                content = file.read() if max_bytes is None else file.read(max_bytes + 1)
            if max_bytes is not None and len(content) > max_bytes:
                yield path, moment, length, None, TOO_BIG
            else:
                yield path, moment, len(content), content, None
        except (OSError, pa.ArrowException) as problem:
            yield path, moment, length, None, _reason(problem)


def read_listed(listing: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """``path, modificationTime, length, content, error``: a row for every row of a listing.

    Files are opened in tasks, dealt by a hash of the path to about equal bytes.  One
    that is larger than ``max_bytes`` is not opened; one that is gone, has grown too
    large or cannot be read has no content and a reason.
    """
    if "error" not in listing.columns:
        listing = listing.withColumn("error", F.lit(None).cast("string"))
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    good = listing.where(F.col("error").isNull() & fits)
    files, size = good.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(-(-size // BYTES_PER_TASK), -(-files // FILES_PER_TASK), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            yield from _batches(_contents(rows, max_bytes), _READ)

    opened = good.select("path", "modificationTime", "length").repartition(tasks, "path").mapInArrow(run, READ)
    closed = listing.where(~(F.col("error").isNull() & F.coalesce(fits, F.lit(False)))).select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"),
        F.coalesce("error", F.lit(TOO_BIG)).alias("error"))
    return opened.unionByName(closed)


def land_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``files`` (path below ``root``, content) as files, in tasks: ``path, length`` of each.

    A retry writes the same bytes again.  Two rows with one path are one file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Place(root)
        made: set[str] = set()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                inner = f"{place.inner}/{path}"
                folder = inner.rsplit("/", 1)[0]
                if folder not in made:
                    place.system.create_dir(folder, recursive=True)
                    made.add(folder)
                with place.system.open_output_stream(inner) as out:
                    out.write(content or b"")
                rows.append((place.spelled(inner), len(content or b"")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64()))],
                                                 ["path", "length"])

    return files.select("path", "content").mapInArrow(run, "path STRING, length LONG")


def remove_files(paths: DataFrame) -> DataFrame:
    """Delete files (column ``path``) in tasks: ``path, error`` of each; one that is gone is no error."""
    def one(path: str) -> str | None:
        try:
            place = Place(path)
            place.system.delete_file(place.inner)
        except FileNotFoundError:
            return None
        except (OSError, pa.ArrowException) as problem:
            return _reason(problem)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([one(n) for n in names], pa.string())], ["path", "error"])

    return paths.select("path").mapInArrow(run, "path STRING, error STRING")


def remove_directories(paths: DataFrame) -> DataFrame:
    """Delete directories (column ``path``) with all they hold, in tasks: ``path, error`` of each."""
    def one(path: str) -> str | None:
        try:
            place = Place(path)
            place.system.delete_dir(place.inner)
        except FileNotFoundError:
            return None
        except (OSError, pa.ArrowException) as problem:
            return _reason(problem)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([one(n) for n in names], pa.string())], ["path", "error"])

    return paths.select("path").mapInArrow(run, "path STRING, error STRING")
