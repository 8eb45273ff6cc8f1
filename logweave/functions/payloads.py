"""Decoding of JSON payloads, one schema and one set of mandatory fields per record type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTITION = "partitionId:bigint,version:bigint,isTempPartition:boolean"
# The schema of each type's payload. Fields that a payload has besides are ignored.
SCHEMAS = {
    "UPSERT": f"commitSeq bigint, txnId bigint, label string, tableRecords map<string,struct<partitionRecords:array<struct<{_PARTITION}>>,indexIds:array<bigint>>>",
    "ADD_PARTITION": "sql string, tableId bigint, isTemp boolean, distributionInfo string, di string",
    "CREATE_TABLE": "sql string, tableId bigint",
    "DROP_PARTITION": "sql string, tableId bigint",
    "DROP_TABLE": "tableId bigint, tableName string",
    "ALTER_JOB": "type string, tableId bigint, tableName string, jobState string, iim map<string,bigint>",
    "MODIFY_TABLE_ADD_OR_DROP_COLUMNS": "rawSql string, tableId bigint",
    "RENAME_COLUMN": "tableId bigint, colName string, newColName string",
    "MODIFY_COMMENT": "tblId bigint, type string, tblComment string, colToComment map<string,string>",
    "RENAME_TABLE": "tb bigint, nT string, oT string, nR string, oR string, nP string, oP string",
    "REPLACE_PARTITIONS": "tblId bigint, tblName string, partitions array<string>, tempPartitions array<string>, strictRange boolean, useTempName boolean",
    "TRUNCATE_TABLE": "tblId bigint, isEntireTable boolean, rawSql string",
}
_blank = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
_zero = lambda c: F.coalesce(F.col(c) == 0, F.lit(True))
#: Rules (reason, condition under which the record is refused), in the order they are asked.
RULES = {
    "UPSERT": [("no commitSeq", lambda: _zero("p.commitSeq")), ("no tableRecords", lambda: F.coalesce(F.size("p.tableRecords") <= 0, F.lit(True)))],
    "ADD_PARTITION": [("no sql", lambda: _blank("p.sql")), ("no tableId", lambda: _zero("p.tableId"))],
    "CREATE_TABLE": [("no sql", lambda: _blank("p.sql")), ("no tableId", lambda: _zero("p.tableId"))],
    "DROP_PARTITION": [("no sql", lambda: _blank("p.sql")), ("no tableId", lambda: _zero("p.tableId"))],
    "DROP_TABLE": [("no tableId", lambda: _zero("p.tableId"))],
    "ALTER_JOB": [("no tableId", lambda: _zero("p.tableId")), ("no tableName", lambda: _blank("p.tableName"))],
    "MODIFY_TABLE_ADD_OR_DROP_COLUMNS": [("no rawSql", lambda: _blank("p.rawSql")), ("no tableId", lambda: _zero("p.tableId"))],
    "RENAME_COLUMN": [("no tableId", lambda: _zero("p.tableId"))],
    "MODIFY_COMMENT": [("no tblId", lambda: _zero("p.tblId")), ("unknown type", lambda: ~F.coalesce(F.col("p.type").isin("COLUMN", "TABLE"), F.lit(False)))],
    "RENAME_TABLE": [("no tb", lambda: _zero("p.tb"))],
    "REPLACE_PARTITIONS": [("no tempPartitions", lambda: F.coalesce(F.size("p.tempPartitions") <= 0, F.lit(True))), ("no tblId", lambda: _zero("p.tblId")), ("no tblName", lambda: _blank("p.tblName"))],
    "TRUNCATE_TABLE": [("no tblId", lambda: _zero("p.tblId"))],
}


def reason(kind: str) -> Column:
    """The first broken rule of a parsed payload ``p``, or null."""
    rules = RULES[kind]
    out = F.when(F.col("p").isNull(), "no payload")
    for text, broken in rules:
        out = out.when(broken(), text)
    return out


def parsed(records: DataFrame, kind: str, data: str = "data") -> DataFrame:
    """``records`` with the payload ``p`` and the ``reason`` it is refused for, if any. The payload is a row of a generator, so
    that no filter or projection on its fields parses the text once more."""
    return records.select("*", F.explode(F.array(F.from_json(data, SCHEMAS[kind]))).alias("p")).withColumn("reason", reason(kind))


def accepted(records: DataFrame, kind: str) -> DataFrame:
    return parsed(records, kind).where("reason IS NULL").drop("reason")


def quarantined(records: DataFrame, kind: str) -> DataFrame:
    return parsed(records, kind).where("reason IS NOT NULL").drop("p")


def upsert_partitions(records: DataFrame) -> DataFrame:
    """``commit_seq, table_id, partition_id, version, is_temp``: a row per partition of an upsert."""
    by_table = accepted(records, "UPSERT").select("commit_seq", F.explode("p.tableRecords").alias("id", "r"))
    return by_table.select("commit_seq", F.col("id").cast("bigint").alias("table_id"), F.inline("r.partitionRecords")).withColumnsRenamed(
        {"partitionId": "partition_id", "isTempPartition": "is_temp"})


def upsert_indexes(records: DataFrame) -> DataFrame:
    """``commit_seq, table_id, index_id``: a row per index of an upsert."""
    by_table = accepted(records, "UPSERT").select("commit_seq", F.explode("p.tableRecords").alias("id", "r"))
    return by_table.select("commit_seq", F.col("id").cast("bigint").alias("table_id"), F.explode("r.indexIds").alias("index_id"))


def shadow_indexes(records: DataFrame) -> DataFrame:
    """``commit_seq, table_id, job_type, job_state, shadow_index, origin_index``: a row per shadow of an
    alter job; a job without shadows has none."""
    jobs = accepted(records, "ALTER_JOB").select(
        "commit_seq", F.col("p.tableId").alias("table_id"), F.col("p.type").alias("job_type"), F.col("p.jobState").alias("job_state"), F.explode("p.iim").alias("id", "origin_index"))
    return jobs.withColumn("shadow_index", F.col("id").cast("bigint")).drop("id")


def comments(records: DataFrame) -> DataFrame:
    """``commit_seq, table_id, column, comment``: a row per commented column, or one with a null column for
    the table's own comment."""
    p = accepted(records, "MODIFY_COMMENT").select("commit_seq", F.col("p.tblId").alias("table_id"), "p.type", "p.tblComment", "p.colToComment")
    of_columns = p.where("type = 'COLUMN'").select("commit_seq", "table_id", F.explode("colToComment").alias("column", "comment"))
    return of_columns.unionByName(p.where("type = 'TABLE'").select("commit_seq", "table_id", F.lit(None).cast("string").alias("column"), F.col("tblComment").alias("comment")))


def rename_kind() -> Column:
    """What a RENAME_TABLE payload renames; partition before rollup before table."""
    named = lambda a, b: ~_blank(f"p.{a}") & ~_blank(f"p.{b}")
    return F.when(named("nP", "oP"), "PARTITION").when(named("nR", "oR"), "ROLLUP").when(named("nT", "oT"), "TABLE")


def clause_partitions(sql: Column) -> Column:
    """Names in the parentheses of a PARTITIONS clause."""
    return F.filter(F.transform(F.split(F.regexp_extract(sql, r"\((.*)\)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
