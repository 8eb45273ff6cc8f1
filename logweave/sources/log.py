"""Reading a change log: records after a cursor, of a table, and where a cursor stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(log: DataFrame, cursor: int | Column) -> DataFrame:
    """Records after ``cursor``. The comparison reaches the Parquet scan; order is commit_seq."""
    return log.where(F.col("commit_seq") > cursor)


def of_table(log: DataFrame, table_id: int) -> DataFrame:
    """Records of one table; a log with a list of ids (table_ids) is searched there."""
    if "table_ids" in log.columns:
        return log.where(F.array_contains("table_ids", table_id))
    return log.where(F.col("table_id") == table_id)


def window_status(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """``cursor_seq, status``: TOO_OLD if the log was trimmed after the cursor, TOO_NEW if nothing
    follows it, else OK. The log is reduced to one row before it meets the cursors."""
    bounds = log.agg(F.min("commit_seq").alias("lo"), F.max("commit_seq").alias("hi"))
    status = F.when(F.col("lo").isNull(), "NOT_FOUND").when(F.col("cursor_seq") < F.col("lo") - 1, "TOO_OLD").when(F.col("cursor_seq") >= F.col("hi"), "TOO_NEW").otherwise("OK")
    return cursors.join(F.broadcast(bounds)).select("cursor_seq", status.alias("status"))


def tombstones(log: DataFrame) -> DataFrame:
    """``table_id, dropped_seq`` of tables whose last CREATE_TABLE or DROP_TABLE is a drop."""
    last = live_state(log)
    return last.where("NOT live").select("table_id", F.col("at_seq").alias("dropped_seq"))


def live_state(log: DataFrame) -> DataFrame:
    """``table_id, at_seq, live``; a table without such records is live. One partial aggregate."""
    change = F.col("type").isin("CREATE_TABLE", "DROP_TABLE")
    last = F.max(F.when(change, F.struct("commit_seq", "type"))).alias("last")
    return log.groupBy("table_id").agg(last).select("table_id", F.col("last.commit_seq").alias("at_seq"), F.coalesce(F.col("last.type") != "DROP_TABLE", F.lit(True)).alias("live"))


def snapshot_cursors(info: DataFrame) -> DataFrame:
    """``table_id, cursor_seq`` from JSON snapshot infos with a table_commit_seq_map."""
    parsed = F.from_json("info", "table_commit_seq_map map<string,bigint>")["table_commit_seq_map"]
    return info.select(F.explode(parsed).alias("id", "cursor_seq")).select(F.col("id").cast("bigint").alias("table_id"), "cursor_seq")


def inventory(rows: DataFrame, keys: tuple[str, ...] = ("table_id", "part_day")) -> DataFrame:
    """Rows, first and last commit (the visible version) of each partition."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("commit_seq").alias("first_seq"), F.max("commit_seq").alias("visible_version"))
