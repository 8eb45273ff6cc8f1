"""Filters over log records. Small sides (cursors, tombstones) are left to Spark to broadcast:
it does so when their size, known after the scan or the aggregate, is below its threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import as_of

IGNORED = ("ALTER_DATABASE_PROPERTY", "MODIFY_TABLE_PROPERTY", "BARRIER")


def not_committed(records: DataFrame, cursors: DataFrame) -> DataFrame:
    """Records after their table's cursor; tables without a cursor pass."""
    out = records.join(cursors.select("table_id", "cursor_seq"), "table_id", "left")
    return out.where(F.col("cursor_seq").isNull() | (F.col("commit_seq") > F.col("cursor_seq"))).drop("cursor_seq")


def without(records: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Records whose keys are not among the tombstones."""
    return records.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def without_temporary(partitions: DataFrame) -> DataFrame:
    return partitions.where(~F.col("is_temp"))


def without_shadows(indexes: DataFrame, alter: DataFrame) -> DataFrame:
    """Uses of indexes (index_id, commit_seq) that are no active shadow then.  ``alter`` has alter jobs
    (shadow_index, commit_seq, job_type, job_state): a PENDING one makes the shadow active, a CANCELLED
    one or a finished schema change ends that; a finished rollup does not."""
    ends = (F.col("job_state") == "CANCELLED") | (F.col("job_state") == "FINISHED") & (F.col("job_type") == "SCHEMA_CHANGE")
    state = F.when(F.col("job_state") == "PENDING", True).when(ends, False)
    sets = alter.select(F.col("shadow_index").alias("index_id"), "commit_seq", state.alias("__set"))
    return as_of(indexes, ["index_id"], "commit_seq", "__set", "__active", sets=sets).where(~F.coalesce("__active", F.lit(False))).drop("__active")


def without_unfinished(log: DataFrame, state: str = "job_state") -> DataFrame:
    """Records but the alter jobs that haven't finished; a job of unknown state counts as one."""
    return log.where((F.col("type") != "ALTER_JOB") | F.coalesce(F.col(state) == "FINISHED", F.lit(False)))


def without_ignored(log: DataFrame) -> DataFrame:
    return log.where(~F.col("type").isin(*IGNORED))


def version_reached(partitions: DataFrame, visible: DataFrame, *keys: str) -> DataFrame:
    """``served``: the replica's visible version has reached the record's; no replica counts as not."""
    return partitions.join(visible.select(*keys, "visible_version"), list(keys), "left").withColumn("served", F.coalesce(F.col("visible_version") >= F.col("version"), F.lit(False)))


def has_word(text: str, word: str):
    """Condition: the lower-cased text has the word among its tokens."""
    return F.array_contains(F.split(F.lower(text), "[^a-z0-9]+"), word.lower())
