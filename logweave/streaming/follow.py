"""Following a change log with Structured Streaming, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import not_committed
from ..operators.progress import counters
from ..sources.snapshots import ChangeTable


def stream(spark: SparkSession, folder: str, files_per_batch: int = 1, bytes_per_batch: int | None = None) -> DataFrame:
    """The log files of a folder as a stream. The schema is read from the files there are. bytes_per_batch: batches by
    size, whatever number of files a part of the log has."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    reader = reader.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Handles all that is there, batch by batch, and stops; a later call goes on from the checkpoint."""
    query = source.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()


def replicate(source: DataFrame, table: ChangeTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, compact_every: int = 50) -> None:
    """Applies the stream to the table. The table's folders, not only the checkpoint, say which batches
    are done; a batch that comes again after a failure changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        table.apply(number, prepare(batch))
        if number % compact_every == compact_every - 1:
            table.compact()

    drain(source, checkpoint, handle)


def split_bad(batch: DataFrame, good: str) -> tuple[DataFrame, DataFrame]:
    """Rows to apply, and rows for the quarantine when errors are to be skipped."""
    fine = F.coalesce(F.expr(good), F.lit(False))
    return batch.where(fine), batch.where(~fine)


def without_committed(batch: DataFrame, cursors: ChangeTable, number: int) -> DataFrame:
    """The records of a batch after the cursor of their table, each once; the cursors (table_id, commit_seq) go on to the
    batch's last records. Log files have to come in order, apart from repeats. State is a row for each table, however
    long the log is; a batch that comes again after a failure gives the same records."""
    if not cursors.has(number):
        if number % 50 == 49:  # only what is before this batch
            cursors.compact()
        cursors.apply(number, batch.groupBy("table_id").agg(F.max("commit_seq").alias("commit_seq"), F.lit(number).alias("batch")))
    kept = cursors.versions().where(F.col("batch") < number).groupBy("table_id").agg(F.max("commit_seq").alias("cursor_seq"))
    return not_committed(batch, kept).dropDuplicates(["commit_seq"])


def running_latest(source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Latest row per key as streaming state, in update mode."""
    return source.groupBy(*keys).agg(F.max_by(F.struct("commit_seq", *values), "commit_seq").alias("r")).select(*keys, "r.*")


def counted(handle: Callable[[DataFrame, int], None], kept: ChangeTable, *keys: str) -> Callable[[DataFrame, int], None]:
    """``handle``, after which the batch's counters by ``keys`` are put down in ``kept`` (keys: batch and ``keys``). A batch that
    comes again, also after a restart, counts once; one whose handling fails doesn't count until it is done."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        handle(batch, number)
        kept.apply(number, counters(batch, *keys).withColumn("batch", F.lit(number).cast("long")))
        batch.unpersist()

    return run


def counter_totals(kept: ChangeTable, *keys: str) -> DataFrame | None:
    """``keys, n, first_seq, last_seq`` over all batches that were handled."""
    rows = kept.read()
    return None if rows is None else rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
