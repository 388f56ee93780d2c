"""The scan over a stream of newly landed files.

A file is a row and never spans micro-batches, so issues, metrics and status
are narrow projections of the stream, as are compliance and migration summaries:
no state, no watermark.  Only the running summary keeps state, a single row of
four counters; summaries of single batches need none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from srclens.operators.catalog import DEFAULT_PACKS
from srclens.operators.rollup import Packs, file_overview, migration_summary, psr_compliance, run_summary
from srclens.operators.scan import issues


def issue_stream(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Issues of every newly landed file."""
    return issues(files, packs)


def overview_stream(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Status and metrics of every newly landed file."""
    return file_overview(files, packs)


def compliance_stream(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Compliance with each standard of every newly landed file."""
    return psr_compliance(files, packs)


def migration_stream(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """Migration summary of every newly landed file."""
    return migration_summary(files, packs)


def write_batch_summaries(files: DataFrame, out: str, checkpoint: str, available_now: bool = False,
                          interval: str = "1 minute", packs: Packs = DEFAULT_PACKS) -> StreamingQuery:
    """The run summary of each micro-batch, in the folder of its batch id.

    A batch that is run again after a failure replaces its own folder.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        run_summary(batch, packs).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def summary_stream(files: DataFrame, packs: Packs = DEFAULT_PACKS) -> DataFrame:
    """The run summary so far (for a sink in complete mode)."""
    return run_summary(files, packs)


def write_stream(rows: DataFrame, out: str, checkpoint: str, available_now: bool = False,
                 interval: str = "1 minute") -> StreamingQuery:
    """Append to a Parquet table; the checkpoint makes each file count exactly once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=interval)
    return writer.start()
