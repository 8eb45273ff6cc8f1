"""Inputs of the registered queries, derived from the star-schema tables.

The change log is ``events`` read as one record per event; the other inputs derive from it.  Each
input is an SQL text that Spark and the oracle both accept, so a query and its oracle start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

LOG = """
SELECT commit_seq, ts, CASE
    WHEN commit_seq % 97 = 0 THEN 'DROP_PARTITION' WHEN commit_seq % 101 = 0 THEN 'TRUNCATE_TABLE'
    WHEN commit_seq % 103 = 0 THEN 'RENAME_TABLE' WHEN commit_seq % 107 = 0 THEN 'REPLACE_PARTITIONS'
    WHEN commit_seq % 109 = 0 THEN 'ALTER_JOB' WHEN commit_seq % 113 = 0 THEN 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS'
    WHEN commit_seq % 127 = 0 THEN 'BARRIER' WHEN commit_seq % 131 = 0 THEN 'ADD_PARTITION'
    WHEN commit_seq % 137 = 0 THEN 'DROP_TABLE' WHEN commit_seq % 139 = 0 THEN 'CREATE_TABLE'
    WHEN commit_seq % 149 = 0 THEN 'DUMMY' ELSE 'UPSERT' END AS type,
  table_id, part_day, k, v, event_type, props
FROM (SELECT event_id + 1 AS commit_seq, ts, 100 + user_id % 10 AS table_id, CAST(extract(day FROM ts) AS BIGINT) AS part_day,
        user_id AS k, CAST(round(value * 100) AS BIGINT) AS v, event_type, props FROM events) e
"""
ROWS = f"""
SELECT commit_seq, table_id, part_day, k, v, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op,
  (commit_seq * 7919) % 10007 AS seq, CASE WHEN v % 3 = 0 THEN NULL ELSE v END AS v_nullable
FROM ({LOG}) l WHERE type = 'UPSERT'
"""
PAYLOAD = f"""
SELECT commit_seq, table_id, '{{"commitSeq":' || commit_seq || ',"txnId":' || (commit_seq + 7) || ',"label":"l' || commit_seq
  || '","tableRecords":{{"' || table_id || '":{{"partitionRecords":[{{"partitionId":' || (table_id * 100 + part_day)
  || ',"version":' || commit_seq || ',"isTempPartition":' || CASE WHEN commit_seq % 11 = 0 THEN 'true' ELSE 'false' END
  || '}}],"indexIds":[' || (table_id * 10) || ',' || (table_id * 10 + 9) || ']}}}}}}' AS data
FROM ({LOG}) l WHERE type = 'UPSERT'
"""
CURSORS = f"""
SELECT table_id, CAST(floor(m * (30 + (table_id - 100) * 3) / 100) AS BIGINT) AS cursor_seq
FROM (SELECT table_id, max(max(commit_seq)) OVER () AS m FROM ({LOG}) l GROUP BY table_id) t
"""
PARTS = f"SELECT DISTINCT table_id, part_day, '[' || part_day || ', ' || (part_day + 1) || ')' AS part_range FROM ({LOG}) l"
ALTER = f"""
SELECT commit_seq, table_id, table_id * 10 + 9 AS shadow_index, CASE WHEN commit_seq % 5 = 0 THEN 'ROLLUP' ELSE 'SCHEMA_CHANGE' END AS job_type, CASE CAST(floor(commit_seq / 109) AS BIGINT) % 4
  WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FINISHED' WHEN 2 THEN 'PENDING' ELSE 'CANCELLED' END AS job_state
FROM ({LOG}) l WHERE type = 'ALTER_JOB'
"""
SOURCE = "SELECT o_orderkey AS k, o_orderstatus AS st, CAST(extract(year FROM o_orderdate) AS BIGINT) AS p, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"
REPLICA = f"""
SELECT k, st, p, CASE WHEN k % 70 = 1 THEN cents + 1 ELSE cents END AS cents FROM ({SOURCE}) s WHERE k % 50 <> 0
UNION ALL SELECT k + 10000000, st, p, cents FROM ({SOURCE}) s WHERE k % 90 = 2
"""
VIEWS = """
SELECT CAST(c_custkey AS BIGINT) AS rec, 'v_' || c_custkey AS name, 'CREATE VIEW v_' || c_custkey || ' AS SELECT * FROM `internal`.`src`.`t_'
  || (100 + c_custkey % 10) || '`' AS sql_text FROM customer
"""
PROGRESS = f"""
SELECT 'job_' || (k % 5) AS job, commit_seq, ts AS persisted_at, commit_seq - commit_seq % 1000 AS full_sync_start_at,
  CASE commit_seq % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 500 ELSE 501 END AS sync_state
FROM ({LOG}) l
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture as a DataFrame over the tables of ``sf_dir``; only the tables it names are read."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql}
    # Named arguments keep the session free of views.
    for name in used:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    escaped = sql
    return spark.sql(_braced(escaped, used), **used)


def _braced(sql: str, used: dict) -> str:
    """The text with literal braces doubled, as the formatter of ``spark.sql`` wants them."""
    out = sql.replace("{", "{{").replace("}", "}}")
    for name in used:
        out = out.replace(f"{{{{{name}}}}}", f"{{{name}}}")
    return out
