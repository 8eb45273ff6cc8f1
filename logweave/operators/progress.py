"""Aggregates over the log and over progress rows: cursors, lag, counters, states; and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import BLOCK

# Ids of the outer states of a job.
STATES = {0: "DBFullSync", 1: "DBTablesIncrementalSync", 3: "DBIncrementalSync", 500: "TableFullSync", 501: "TableIncrementalSync"}


def start_cursor(cursors: DataFrame) -> DataFrame:
    return cursors.agg(F.min("cursor_seq").alias("start_seq"))


def advance(cursors: DataFrame, records: DataFrame) -> DataFrame:
    """``table_id, cursor_seq``: the greater of the old cursor and the last record of the table."""
    seen = records.groupBy("table_id").agg(F.max("commit_seq").alias("seen"))
    return cursors.join(seen, "table_id", "full_outer").select("table_id", F.greatest("cursor_seq", "seen").alias("cursor_seq"))


def catchup_point(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """First position at which no table's cursor is ahead any more."""
    last = F.broadcast(cursors.agg(F.max("cursor_seq").alias("last")))
    return log.join(last, F.col("commit_seq") >= F.col("last")).agg(F.min("commit_seq").alias("catchup_seq"))


def lag_of(log: DataFrame, cursors: DataFrame, *keys: str) -> DataFrame:
    """``keys, lag``: records after the cursor; keys without such records have lag 0. The log meets the
    cursors, which Spark broadcasts if they are small, and is counted before it is shuffled."""
    after = log.select(*keys, "commit_seq").join(cursors, list(keys)).where("commit_seq > cursor_seq").groupBy(*keys).agg(F.count("*").alias("lag"))
    return cursors.select(*keys).join(after, list(keys), "left").select(*keys, F.coalesce("lag", F.lit(0)).cast("long").alias("lag"))


def counters(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.min("commit_seq").alias("first_seq"), F.max("commit_seq").alias("last_seq"))


def touched_partitions(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy("table_id", "partition_id").agg(F.max("version").alias("version"), F.count("*").alias("n"))


def latest_progress(progress: DataFrame) -> DataFrame:
    """``job, commit_seq, state``: of the last row persisted by each job."""
    row = F.max(F.struct("persisted_at", "commit_seq", "sync_state")).alias("r")
    names = F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.lit(v))])
    return progress.groupBy("job").agg(row).select("job", F.col("r.commit_seq").alias("commit_seq"), names[F.col("r.sync_state").cast("int")].alias("state"))


def full_sync_events(progress: DataFrame, block: int = BLOCK) -> DataFrame:
    """Progress rows at which a full sync began: its start differs from the row before. A job's history is compared block
    by block of positions; the first row of a block meets the end of the block before, so no task has a whole history."""
    of_block = F.floor(F.col("commit_seq") / F.lit(block))
    value = F.struct("full_sync_start_at")
    rows = progress.withColumn("__block", of_block)
    inside = rows.withColumn("__before", F.lag(value).over(Window.partitionBy("job", "__block").orderBy("commit_seq")))
    ends = rows.groupBy("job", "__block").agg(F.max_by(value, "commit_seq").alias("__end"))
    ends = ends.select("job", "__block", F.lag("__end").over(Window.partitionBy("job").orderBy("__block")).alias("__end"))
    before = F.coalesce("__before", "__end")["full_sync_start_at"]
    return inside.join(ends, ["job", "__block"]).where(before.isNotNull() & (before != F.col("full_sync_start_at"))).drop("__block", "__before", "__end")


# Record types.
_NO_EFFECT = ("BARRIER", "ALTER_DATABASE_PROPERTY", "MODIFY_TABLE_PROPERTY")
_DDL = ("ADD_PARTITION", "DROP_PARTITION", "CREATE_TABLE", "DROP_TABLE", "TRUNCATE_TABLE", "RENAME_TABLE", "RENAME_COLUMN", "MODIFY_COMMENT", "MODIFY_TABLE_ADD_OR_DROP_COLUMNS")


def action(kind: Column, job_type: Column, job_state: Column, strict: Column, temp_name: Column) -> Column:
    """What a record calls for.  An ALTER_JOB that hasn't finished calls for nothing; a finished schema change
    for a partial sync that replaces the table, any other finished one (a rollup) for a full sync.
    Partitions are replaced by a partial sync only for a strict range and without temporary names."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    alter = F.when(~flag(job_state == "FINISHED"), "IGNORE").when(job_type == "SCHEMA_CHANGE", "PARTIAL_SYNC_REPLACE").otherwise("FULL_SYNC")
    replace = F.when(flag(strict) & ~flag(temp_name), "PARTIAL_SYNC").otherwise("FULL_SYNC")
    return (
        F.when(kind == "UPSERT", "APPLY_ROWS").when(kind.isin(*_NO_EFFECT), "IGNORE").when(kind == "DUMMY", "FULL_SYNC")
        .when(kind == "ALTER_JOB", alter).when(kind == "REPLACE_PARTITIONS", replace).when(kind.isin(*_DDL), "APPLY_DDL").otherwise("ERROR"))


def to_resync(failures: DataFrame, forced: DataFrame) -> DataFrame:
    """``table_id, since_seq, reason``: tables that need a new snapshot, because an apply failed for a
    cause of category "meta" (failures: table_id, commit_seq, category) or by request (forced: table_id,
    commit_seq). Other failures are tried again and ask for none; a panic stops the job."""
    why = failures.where("category = 'meta'").select("table_id", "commit_seq", F.lit("meta error").alias("reason"))
    asked = forced.select("table_id", "commit_seq", F.lit("forced").alias("reason"))
    return why.unionByName(asked).groupBy("table_id").agg(F.min("commit_seq").alias("since_seq"), F.min_by("reason", F.struct("commit_seq", "reason")).alias("reason"))


def behind(cursors: DataFrame, oldest_seq: int) -> DataFrame:
    """``table_id, since_seq, reason``: tables whose next record may be gone, as the log now begins at ``oldest_seq``."""
    return cursors.where(F.col("cursor_seq") < oldest_seq - 1).select("table_id", F.col("cursor_seq").alias("since_seq"), F.lit("log trimmed").alias("reason"))
