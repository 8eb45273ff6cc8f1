"""Queries over the log: reading, decoding, filtering, mapping, aggregating, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clauses
from ..functions import payloads as P
from ..operators import filters, mapping, progress
from ..sources import log as L
from . import fixtures as X
from .fixtures import frame

QUERIES: dict = {}
SQL: dict[str, str] = {}
MIDDLE = f"(SELECT CAST(floor(max(commit_seq) / 2) AS BIGINT) FROM ({X.LOG}) m)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def log(s, d):
    return frame(s, d, X.LOG)


def middle(s, d) -> int:
    return log(s, d).agg(F.floor(F.max("commit_seq") / 2)).first()[0] or 0


@query("log_since", f"SELECT commit_seq, type, table_id FROM ({X.LOG}) l WHERE commit_seq > {MIDDLE}")
def _(s, d):
    return L.since(log(s, d), middle(s, d)).select("commit_seq", "type", "table_id")


@query("log_scope_table", f"SELECT commit_seq, type, k, v FROM ({X.LOG}) l WHERE table_id = 103")
def _(s, d):
    return L.of_table(log(s, d), 103).select("commit_seq", "type", "k", "v")


_STATUS = f"SELECT CAST(m.m + o AS BIGINT) AS cursor_seq FROM (SELECT max(commit_seq) AS m FROM ({X.LOG}) l) m, (VALUES (-1000000000), (0), (10), (-50)) v(o)"


@query("log_window_status", f"""WITH w AS (SELECT min(commit_seq) AS lo, max(commit_seq) AS hi FROM ({X.LOG}) l WHERE commit_seq > 100)
SELECT cursor_seq, CASE WHEN cursor_seq < lo - 1 THEN 'TOO_OLD' WHEN cursor_seq >= hi THEN 'TOO_NEW' ELSE 'OK' END AS status FROM ({_STATUS}) c, w""")
def _(s, d):
    return L.window_status(log(s, d).where("commit_seq > 100"), frame(s, d, _STATUS))


@query("snapshot_cursors", f"SELECT table_id, cursor_seq FROM ({X.CURSORS}) c")
def _(s, d):
    entry = F.concat(F.lit('"'), "table_id", F.lit('":'), "cursor_seq")
    info = frame(s, d, X.CURSORS).agg(F.concat(F.lit('{"table_commit_seq_map":{'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("info"))
    return L.snapshot_cursors(info)


@query("partition_inventory", f"SELECT table_id, part_day, count(*) AS n, min(commit_seq) AS first_seq, max(commit_seq) AS visible_version FROM ({X.ROWS}) r GROUP BY ALL")
def _(s, d):
    return L.inventory(frame(s, d, X.ROWS))


_LAST = f"SELECT table_id, max(CASE WHEN type IN ('CREATE_TABLE', 'DROP_TABLE') THEN commit_seq END) AS at_seq FROM ({X.LOG}) l GROUP BY table_id"


@query("tombstones", f"SELECT l.table_id, commit_seq AS dropped_seq FROM ({X.LOG}) l JOIN ({_LAST}) t ON l.table_id = t.table_id AND commit_seq = at_seq WHERE type = 'DROP_TABLE'")
def _(s, d):
    return L.tombstones(log(s, d))


@query("live_tables", f"SELECT t.table_id, at_seq, coalesce(type <> 'DROP_TABLE', true) AS live FROM ({_LAST}) t LEFT JOIN ({X.LOG}) l ON l.table_id = t.table_id AND commit_seq = at_seq")
def _(s, d):
    return L.live_state(log(s, d))


# --- decoding -------------------------------------------------------------------------------


@query("decode_upsert", f"SELECT commit_seq, table_id, table_id * 100 + part_day AS partition_id, commit_seq AS version, commit_seq % 11 = 0 AS is_temp FROM ({X.LOG}) l WHERE type = 'UPSERT'")
def _(s, d):
    return P.upsert_partitions(frame(s, d, X.PAYLOAD))


#: query -> (record type of the payload, log type the text is built from, JSON text, decoded columns, the same by SQL)
_DECODE = {
    "decode_add_partition": ("ADD_PARTITION", "ADD_PARTITION", """'{"tableId":' || table_id || ',"sql":"ADD PARTITION p' || part_day || '","' || CASE WHEN commit_seq % 2 = 0 THEN 'di' ELSE 'distributionInfo' END || '":"HASH"}'""",
        {"table_id": "p.tableId", "sql_text": "p.sql", "distribution": "coalesce(p.distributionInfo, p.di)"}, {"table_id": "table_id", "sql_text": "'ADD PARTITION p' || part_day", "distribution": "'HASH'"}),
    "decode_create_table": ("CREATE_TABLE", "CREATE_TABLE", """'{"tableId":' || table_id || ',"sql":"' || CASE WHEN commit_seq % 2 = 0 THEN 'CREATE VIEW v' ELSE 'CREATE TABLE t' END || table_id || '"}'""",
        {"table_id": "p.tableId", "is_view": r"p.sql RLIKE '(?i)^CREATE\\s+VIEW'"}, {"table_id": "table_id", "is_view": "commit_seq % 2 = 0"}),
    "decode_rename_column": ("RENAME_COLUMN", "MODIFY_TABLE_ADD_OR_DROP_COLUMNS", """'{"tableId":' || table_id || ',"colName":"a","newColName":"b' || k || '"}'""",
        {"table_id": "p.tableId", "old_name": "p.colName", "new_name": "p.newColName"}, {"table_id": "table_id", "old_name": "'a'", "new_name": "'b' || k"}),
    "decode_rename_table": ("RENAME_TABLE", "RENAME_TABLE", """'{"tb":' || table_id || CASE commit_seq % 3 WHEN 0 THEN ',"nT":"x","oT":"y"}' WHEN 1 THEN ',"nR":"x","oR":"y"}' ELSE ',"nP":"x","oP":"y"}' END""",
        {"table_id": "p.tb", "kind": None}, {"table_id": "table_id", "kind": "CASE commit_seq % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'ROLLUP' ELSE 'PARTITION' END"}),
    "decode_truncate": ("TRUNCATE_TABLE", "TRUNCATE_TABLE", """'{"tblId":' || table_id || ',"isEntireTable":' || CASE WHEN commit_seq % 2 = 0 THEN 'true' ELSE 'false' END || ',"rawSql":"' || CASE WHEN commit_seq % 2 = 0 THEN '' ELSE 'PARTITIONS (p1, p' || part_day || ')' END || '"}'""",
        {"table_id": "p.tblId", "entire": "p.isEntireTable", "parts": None}, {"table_id": "table_id", "entire": "commit_seq % 2 = 0", "parts": "CASE WHEN commit_seq % 2 = 0 THEN '' ELSE 'p1|p' || part_day END"}),
}
_DERIVED = {("decode_rename_table", "kind"): P.rename_kind, ("decode_truncate", "parts"): lambda: F.array_join(P.clause_partitions(F.col("p.rawSql")), "|")}


def _payload(kind: str, text: str) -> str:
    return f"SELECT commit_seq, {text} AS data FROM ({X.LOG}) l WHERE type = '{kind}'"


def _decode(name: str):
    kind, of, text, columns, same = _DECODE[name]

    @query(name, f"SELECT commit_seq, {', '.join(f'{e} AS {c}' for c, e in same.items())} FROM ({X.LOG}) l WHERE type = '{of}'")
    def run(s, d):
        got = P.accepted(frame(s, d, _payload(of, text)), kind)
        return got.select("commit_seq", *[(F.expr(e) if e else _DERIVED[name, c]()).alias(c) for c, e in columns.items()])


for _name in _DECODE:
    _decode(_name)

_DROP_PARTITION = """'{"tableId":' || table_id || ',"sql":"' || CASE commit_seq % 4 WHEN 0 THEN 'DROP PARTITION p' || part_day WHEN 1 THEN 'ALTER TABLE t DROP PARTITION IF EXISTS `p ' || part_day || '`'
  WHEN 2 THEN 'DROP PARTITION p' || part_day || ' FORCE' ELSE 'DROP TEMPORARY PARTITION p' || part_day || ', DROP PARTITION IF EXISTS q' END || '"}'"""


@query("decode_drop_partition", f"""SELECT commit_seq, table_id, CASE commit_seq % 4 WHEN 1 THEN 'p ' ELSE 'p' END || part_day AS partition_name, commit_seq % 4 = 1 AS if_exists, commit_seq % 4 = 2 AS force, commit_seq % 4 = 3 AS temporary
FROM ({X.LOG}) l WHERE type = 'DROP_PARTITION' UNION ALL SELECT commit_seq, table_id, 'q', true, false, false FROM ({X.LOG}) l WHERE type = 'DROP_PARTITION' AND commit_seq % 4 = 3""")
def _(s, d):
    got = P.accepted(frame(s, d, _payload("DROP_PARTITION", _DROP_PARTITION)), "DROP_PARTITION").select("commit_seq", F.col("p.tableId").alias("table_id"), F.col("p.sql").alias("sql_text"))
    return clauses.partition_changes(got, F.col("sql_text")).select("commit_seq", "table_id", F.col("partition").alias("partition_name"), "if_exists", "force", "temporary")


_COLUMNS_TEXT = """'{"tableId":' || table_id || ',"rawSql":"ALTER TABLE `db`.`t` ' || CASE commit_seq % 4 WHEN 0 THEN 'ADD COLUMN (`a' || k || '` int NULL DEFAULT \\\\"0\\\\" COMMENT \\\\"\\\\", `b` decimal(10, 3) SUM DEFAULT \\\\"1\\\\")'
  WHEN 1 THEN 'ADD COLUMN `a' || k || '` INT KEY DEFAULT \\\\"0\\\\" FIRST' WHEN 2 THEN 'ADD COLUMN `a' || k || '` varchar(20) AFTER `x, y`, DROP COLUMN `b`' ELSE 'MODIFY COLUMN a' || k || ' BIGINT' END || '"}'"""


@query("decode_columns", f"""WITH l AS (SELECT commit_seq, table_id, k, commit_seq % 4 AS m FROM ({X.LOG}) x WHERE type = 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS')
SELECT commit_seq, table_id, CASE m WHEN 3 THEN 'MODIFY' ELSE 'ADD' END AS change, 'a' || k AS "column", CASE m WHEN 2 THEN 'VARCHAR(20)' WHEN 3 THEN 'BIGINT' ELSE 'INT' END AS type, m = 1 AS is_key, NULL AS aggregate,
  CASE WHEN m < 2 THEN '0' END AS "default", CASE WHEN m = 0 THEN '' END AS comment, m = 1 AS first, CASE WHEN m = 2 THEN 'x, y' END AS after FROM l
UNION ALL SELECT commit_seq, table_id, CASE m WHEN 0 THEN 'ADD' ELSE 'DROP' END, 'b', CASE m WHEN 0 THEN 'DECIMAL(10,3)' END, false, CASE m WHEN 0 THEN 'SUM' END, CASE m WHEN 0 THEN '1' END, NULL, false, NULL FROM l WHERE m IN (0, 2)""")
def _(s, d):
    got = P.accepted(frame(s, d, _payload("MODIFY_TABLE_ADD_OR_DROP_COLUMNS", _COLUMNS_TEXT)), "MODIFY_TABLE_ADD_OR_DROP_COLUMNS").select("commit_seq", F.col("p.tableId").alias("table_id"), F.col("p.rawSql").alias("raw_sql"))
    return clauses.column_changes(got, F.col("raw_sql")).drop("raw_sql", "place")


_ALTER_JOB = """'{"type":"' || CASE WHEN commit_seq % 5 = 0 THEN 'ROLLUP' ELSE 'SCHEMA_CHANGE' END || '","tableId":' || table_id || ',"tableName":"t' || table_id || '","jobState":"' || CASE WHEN commit_seq % 2 = 0 THEN 'FINISHED' ELSE 'PENDING' END
  || '","iim":{"' || (table_id * 10 + 9) || '":' || table_id || ',"' || (table_id * 10 + 8) || '":' || (table_id + 1) || '}}'"""


@query("decode_alter_job", f"""SELECT commit_seq, table_id, CASE WHEN commit_seq % 5 = 0 THEN 'ROLLUP' ELSE 'SCHEMA_CHANGE' END AS job_type, commit_seq % 2 = 0 AS finished, table_id * 10 + 9 - i AS shadow_index, table_id + i AS origin_index
FROM ({X.LOG}) l, (VALUES (0), (1)) v(i) WHERE type = 'ALTER_JOB'""")
def _(s, d):
    got = P.shadow_indexes(frame(s, d, _payload("ALTER_JOB", _ALTER_JOB)))
    return got.select("commit_seq", "table_id", "job_type", (F.col("job_state") == "FINISHED").alias("finished"), "shadow_index", "origin_index")


_COMMENT = """'{"tblId":' || table_id || ',"type":"' || CASE commit_seq % 3 WHEN 0 THEN 'COLUMN' WHEN 1 THEN 'TABLE' ELSE 'INDEX' END || '","colToComment":{"c":"n' || k || '","d":"m' || k || '"},"tblComment":"t' || k || '"}'"""


@query("decode_comment", f"""SELECT commit_seq, table_id, c AS "column", p || k AS comment FROM ({X.LOG}) l, (VALUES (0, 'c', 'n'), (0, 'd', 'm'), (1, NULL, 't')) v(i, c, p) WHERE type = 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS' AND commit_seq % 3 = i""")
def _(s, d):
    return P.comments(frame(s, d, _payload("MODIFY_TABLE_ADD_OR_DROP_COLUMNS", _COMMENT)))


_REPLACE = """'{"tblId":' || table_id || ',"tblName":"t","strictRange":true,"partitions":["p' || part_day || '","q"],"tempPartitions":["tp' || part_day || '","tq"]}'"""


@query("decode_replace_partition", f"""SELECT commit_seq, table_id, 'p' || part_day AS partition_name, 'tp' || part_day AS temp_name FROM ({X.LOG}) l WHERE type = 'REPLACE_PARTITIONS'
UNION ALL SELECT commit_seq, table_id, 'q', 'tq' FROM ({X.LOG}) l WHERE type = 'REPLACE_PARTITIONS'""")
def _(s, d):
    got = P.accepted(frame(s, d, _payload("REPLACE_PARTITIONS", _REPLACE)), "REPLACE_PARTITIONS")
    return got.select("commit_seq", F.col("p.tblId").alias("table_id"), F.inline(F.arrays_zip("p.partitions", "p.tempPartitions"))).toDF("commit_seq", "table_id", "partition_name", "temp_name")


_DROP = """'{"tableId":' || table_id || ',"tableName":"' || CASE WHEN commit_seq % 2 = 0 THEN 't_' || table_id ELSE '' END || '"}'"""
_NAMES = f"SELECT commit_seq, table_id, type, CASE WHEN type = 'RENAME_TABLE' THEN 't_' || table_id || '_' || commit_seq WHEN commit_seq = min(commit_seq) OVER (PARTITION BY table_id) THEN 't_' || table_id END AS new_name FROM ({X.LOG}) l"
#: The same rows for Spark: the first position of each table comes from an aggregate and no table is a window's partition.
_NAMED = f"""SELECT l.commit_seq, l.table_id, type, CASE WHEN type = 'RENAME_TABLE' THEN 't_' || l.table_id || '_' || l.commit_seq WHEN l.commit_seq = first_seq THEN 't_' || l.table_id END AS new_name
FROM ({X.LOG}) l JOIN (SELECT table_id, min(commit_seq) AS first_seq FROM ({X.LOG}) f GROUP BY table_id) f ON l.table_id IS NOT DISTINCT FROM f.table_id"""
_ASOF = f"SELECT commit_seq, table_id, type, new_name, last_value(new_name IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY commit_seq ROWS UNBOUNDED PRECEDING) AS name FROM ({_NAMES}) n"


@query("decode_drop_table", f"SELECT commit_seq, table_id, CASE WHEN commit_seq % 2 = 0 THEN 't_' || table_id ELSE name END AS table_name FROM ({_ASOF}) a WHERE type = 'DROP_TABLE'")
def _(s, d):
    got = P.accepted(frame(s, d, _payload("DROP_TABLE", _DROP)), "DROP_TABLE").select("commit_seq", F.nullif("p.tableName", F.lit("")).alias("own"))
    names = mapping.name_asof(frame(s, d, _NAMED)).where("type = 'DROP_TABLE'")
    return got.join(names, "commit_seq").select("commit_seq", "table_id", F.coalesce("own", "name").alias("table_name"))


#: Payloads with one rule broken each: record type, payload, the reason to be given.
_BROKEN = (
    ("UPSERT", '{"commitSeq":0,"tableRecords":{"1":{"indexIds":[1]}}}', "no commitSeq"), ("UPSERT", '{"commitSeq":5,"tableRecords":{}}', "no tableRecords"), ("UPSERT", '{"commitSeq":5}', "no tableRecords"),
    ("ADD_PARTITION", '{"tableId":5,"sql":""}', "no sql"), ("ADD_PARTITION", '{"sql":"x"}', "no tableId"), ("CREATE_TABLE", '{"tableId":5}', "no sql"), ("CREATE_TABLE", '{"tableId":0,"sql":"x"}', "no tableId"),
    ("DROP_PARTITION", '{"tableId":5}', "no sql"), ("DROP_PARTITION", '{"sql":"x"}', "no tableId"), ("DROP_TABLE", '{"tableName":"x"}', "no tableId"), ("ALTER_JOB", '{"tableName":"x"}', "no tableId"), ("ALTER_JOB", '{"tableId":5,"tableName":""}', "no tableName"),
    ("MODIFY_TABLE_ADD_OR_DROP_COLUMNS", '{"tableId":5}', "no rawSql"), ("MODIFY_TABLE_ADD_OR_DROP_COLUMNS", '{"rawSql":"x"}', "no tableId"), ("RENAME_COLUMN", '{"colName":"x"}', "no tableId"),
    ("MODIFY_COMMENT", '{"type":"TABLE"}', "no tblId"), ("MODIFY_COMMENT", '{"tblId":5,"type":"INDEX"}', "unknown type"), ("RENAME_TABLE", '{"nT":"x","oT":"y"}', "no tb"),
    ("REPLACE_PARTITIONS", '{"tblId":5,"tblName":"x","tempPartitions":[]}', "no tempPartitions"), ("REPLACE_PARTITIONS", '{"tblName":"x","tempPartitions":["p"]}', "no tblId"), ("REPLACE_PARTITIONS", '{"tblId":5,"tempPartitions":["p"]}', "no tblName"),
    ("TRUNCATE_TABLE", '{"rawSql":"x"}', "no tblId"))
_SEVERAL = f"SELECT commit_seq, commit_seq % {len(_BROKEN)} AS i FROM ({X.LOG}) l"


@query("decode_errors", " UNION ALL ".join(f"SELECT '{k}' AS type, '{why}' AS reason, count(*) AS n FROM ({_SEVERAL}) l WHERE i = {i} HAVING count(*) > 0" for i, (k, _, why) in enumerate(_BROKEN)).join(("SELECT type, reason, sum(n)::BIGINT AS n FROM (", ") t GROUP BY ALL")))
def _(s, d):
    """Every mandatory field of every record type is missing once."""
    records = frame(s, d, _SEVERAL).select("commit_seq", F.element_at(F.array(*[F.struct(F.lit(k).alias("type"), F.lit(data).alias("data")) for k, data, _ in _BROKEN]), (F.col("i") + 1).cast("int")).alias("r")).select("commit_seq", "r.*")
    out = None
    for kind in dict.fromkeys(k for k, *_ in _BROKEN):
        one = P.quarantined(records.where(F.col("type") == kind), kind).select("type", "reason")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("type", "reason").agg(F.count("*").alias("n"))


@query("variant_path", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return frame(s, d, "SELECT props FROM events").select(F.variant_get(F.parse_json("props"), "$.k", "int").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# --- filters --------------------------------------------------------------------------------

_CUR = f"SELECT * FROM ({X.CURSORS}) c WHERE table_id <> 109"


def _committed(name: str, condition: str):
    @query(name, f"SELECT l.commit_seq, l.table_id, l.type FROM ({X.LOG}) l LEFT JOIN ({_CUR}) c ON l.table_id = c.table_id WHERE {condition} AND (cursor_seq IS NULL OR commit_seq > cursor_seq)")
    def run(s, d):
        return filters.not_committed(log(s, d).where(condition), frame(s, d, _CUR)).select("commit_seq", "table_id", "type")


_committed("filter_committed_ddl", "type <> 'UPSERT'")


@query("filter_committed_upsert", f"SELECT l.commit_seq, l.table_id, l.table_id * 100 + part_day AS partition_id FROM ({X.LOG}) l LEFT JOIN ({_CUR}) c ON l.table_id = c.table_id WHERE type = 'UPSERT' AND (cursor_seq IS NULL OR commit_seq > cursor_seq)")
def _(s, d):
    return filters.not_committed(P.upsert_partitions(frame(s, d, X.PAYLOAD)), frame(s, d, _CUR)).select("commit_seq", "table_id", "partition_id")


@query("filter_dropped_tables", f"SELECT commit_seq, table_id, k FROM ({X.ROWS}) r WHERE table_id NOT IN (SELECT table_id FROM ({SQL['tombstones']}) t)")
def _(s, d):
    return filters.without(frame(s, d, X.ROWS), L.tombstones(log(s, d)), "table_id").select("commit_seq", "table_id", "k")


@query("filter_dropped_partitions", f"SELECT commit_seq, table_id, part_day FROM ({X.ROWS}) r WHERE NOT EXISTS (SELECT 1 FROM ({X.LOG}) l WHERE type = 'DROP_PARTITION' AND l.table_id = r.table_id AND l.part_day = r.part_day)")
def _(s, d):
    return filters.without(frame(s, d, X.ROWS), log(s, d).where("type = 'DROP_PARTITION'"), "table_id", "part_day").select("commit_seq", "table_id", "part_day")


@query("filter_dropped_indexes", f"""SELECT commit_seq, table_id, table_id * 10 AS index_id FROM ({X.LOG}) l WHERE type = 'UPSERT' AND table_id % 2 = 1
UNION ALL SELECT commit_seq, table_id, table_id * 10 + 9 FROM ({X.LOG}) l WHERE type = 'UPSERT'""")
def _(s, d):
    gone = log(s, d).where("table_id % 2 = 0").select((F.col("table_id") * 10).alias("index_id"))
    return filters.without(P.upsert_indexes(frame(s, d, X.PAYLOAD)), gone, "index_id").select("commit_seq", "table_id", "index_id")


@query("filter_temp_partitions", f"SELECT commit_seq, table_id * 100 + part_day AS partition_id FROM ({X.LOG}) l WHERE type = 'UPSERT' AND commit_seq % 11 <> 0")
def _(s, d):
    return filters.without_temporary(P.upsert_partitions(frame(s, d, X.PAYLOAD))).select("commit_seq", "partition_id")


@query("filter_shadow_indexes", f"""WITH a AS ({X.ALTER}), i AS (
  SELECT shadow_index, commit_seq AS from_seq, (SELECT min(b.commit_seq) FROM a b WHERE b.shadow_index = a.shadow_index AND b.commit_seq > a.commit_seq AND (b.job_state = 'CANCELLED' OR (b.job_state = 'FINISHED' AND b.job_type = 'SCHEMA_CHANGE'))) AS to_seq
  FROM a WHERE job_state = 'PENDING'
), u AS (SELECT commit_seq, table_id * 10 AS index_id FROM ({X.LOG}) l WHERE type = 'UPSERT' UNION ALL SELECT commit_seq, table_id * 10 + 9 FROM ({X.LOG}) l WHERE type = 'UPSERT')
SELECT commit_seq, index_id FROM u WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.shadow_index = u.index_id AND u.commit_seq >= from_seq AND (to_seq IS NULL OR u.commit_seq < to_seq))""")
def _(s, d):
    return filters.without_shadows(P.upsert_indexes(frame(s, d, X.PAYLOAD)), frame(s, d, X.ALTER)).select("commit_seq", "index_id")


@query("filter_ignored", f"SELECT type, count(*) AS n FROM ({X.LOG}) l WHERE type <> 'BARRIER' GROUP BY type")
def _(s, d):
    return filters.without_ignored(log(s, d)).groupBy("type").agg(F.count("*").alias("n"))


_JOBS = f"SELECT l.commit_seq, l.type, job_type, job_state FROM ({X.LOG}) l LEFT JOIN ({X.ALTER}) a ON a.commit_seq = l.commit_seq"


@query("filter_unfinished_alter", f"SELECT type, count(*) AS n FROM ({_JOBS}) j WHERE type <> 'ALTER_JOB' OR job_state = 'FINISHED' GROUP BY type")
def _(s, d):
    jobs = log(s, d).select("commit_seq", "type").join(frame(s, d, X.ALTER).select("commit_seq", "job_state"), "commit_seq", "left")
    return filters.without_unfinished(jobs).groupBy("type").agg(F.count("*").alias("n"))


@query("filter_version_reached", f"""SELECT r.commit_seq, r.table_id, coalesce(visible_version >= r.commit_seq, false) AS served FROM ({X.ROWS}) r
LEFT JOIN (SELECT table_id, part_day, max(commit_seq) AS visible_version FROM ({X.ROWS}) v WHERE commit_seq <= {MIDDLE} GROUP BY ALL) v ON v.table_id = r.table_id AND v.part_day = r.part_day""")
def _(s, d):
    rows = frame(s, d, X.ROWS)
    visible = L.inventory(rows.where(F.col("commit_seq") <= middle(s, d)))
    return filters.version_reached(rows.withColumn("version", F.col("commit_seq")), visible, "table_id", "part_day").select("commit_seq", "table_id", "served")


@query("text_match", "SELECT doc_id, n_chars FROM documents WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'the')")
def _(s, d):
    return frame(s, d, "SELECT doc_id, n_chars, text FROM documents").where(filters.has_word("text", "the")).select("doc_id", "n_chars")


# --- mapping --------------------------------------------------------------------------------


@query("map_tables", f"""SELECT table_id AS src_id, 't_' || table_id AS name, CASE WHEN table_id % 7 <> 0 THEN table_id + 1000 END AS dst_id,
  CASE WHEN table_id % 7 = 0 THEN 'no target table' END AS problem FROM (SELECT DISTINCT table_id FROM ({X.LOG}) l) t""")
def _(s, d):
    ids = log(s, d).select("table_id").distinct().withColumn("name", F.concat(F.lit("t_"), "table_id"))
    return mapping.tables_by_name(ids, ids.where("table_id % 7 <> 0").withColumn("table_id", F.col("table_id") + 1000))


@query("map_partitions", f"SELECT table_id, part_range, CASE WHEN (table_id + part_day) % 29 = 0 THEN 'TARGET' ELSE 'NONE' END AS missing FROM ({X.PARTS}) p")
def _(s, d):
    parts = frame(s, d, X.PARTS)
    return mapping.partitions_by_range(parts, parts.where("(table_id + part_day) % 29 <> 0"), "table_id", "part_range")


@query("map_indexes", f"""SELECT table_id * 10 AS src_index, (table_id + 1000) * 10 AS dst_index, 'alias_' || table_id AS name FROM (SELECT DISTINCT table_id FROM ({X.LOG}) l) t
UNION ALL SELECT table_id * 10 + 9, CASE WHEN table_id % 3 <> 0 THEN (table_id + 1000) * 10 + 9 END, 'rollup' FROM (SELECT DISTINCT table_id FROM ({X.LOG}) l) t""")
def _(s, d):
    ids = log(s, d).select("table_id").distinct()
    own = F.concat(F.lit("t_"), "table_id")
    alias = F.concat(F.lit("alias_"), "table_id")
    both = lambda base, off: F.inline(F.array(F.struct(base.alias("index_name"), ((F.col("table_id") + off) * 10).alias("index_id")), F.struct(F.lit("rollup").alias("index_name"), ((F.col("table_id") + off) * 10 + 9).alias("index_id"))))
    source = ids.select(F.col("table_id").alias("dst_table"), own.alias("own"), alias.alias("alias"), both(own, 0))
    target = ids.select(F.col("table_id").alias("dst_table"), both(alias, 1000)).where("index_name <> 'rollup' OR dst_table % 3 <> 0")
    return mapping.indexes_by_name(source, target, F.col("own"), F.col("alias")).select("src_index", "dst_index", "name")


@query("table_name_asof", f"SELECT commit_seq, table_id, name FROM ({_ASOF}) a")
def _(s, d):
    return mapping.name_asof(frame(s, d, _NAMED)).select("commit_seq", "table_id", "name")


_RENAMES = f"""SELECT CASE commit_seq % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'ROLLUP' ELSE 'PARTITION' END AS kind, CASE commit_seq % 3 WHEN 0 THEN table_id WHEN 1 THEN table_id * 10 ELSE table_id * 100 + part_day END AS id, commit_seq,
  CASE WHEN commit_seq % 5 = 0 THEN 'same' ELSE 'n_' || commit_seq END AS new_name FROM ({X.LOG}) l WHERE type = 'RENAME_TABLE'"""
_OBJECTS = f"SELECT DISTINCT 'TABLE' AS kind, table_id AS id, 'o_' || table_id AS name FROM ({X.LOG}) l UNION ALL SELECT DISTINCT 'PARTITION', table_id * 100 + part_day, 'o_' || part_day FROM ({X.LOG}) l"


@query("rename_history", f"SELECT r.kind, r.id, commit_seq, coalesce(lag(new_name) OVER (PARTITION BY r.kind, r.id ORDER BY commit_seq), name) AS old_name, new_name FROM ({_RENAMES}) r LEFT JOIN ({_OBJECTS}) o ON o.kind = r.kind AND o.id = r.id")
def _(s, d):
    return mapping.renames(frame(s, d, _RENAMES), frame(s, d, _OBJECTS))


@query("rename_objects", f"""WITH l AS (SELECT kind, id, arg_max(new_name, commit_seq) AS new_name FROM ({_RENAMES}) r GROUP BY ALL),
b AS (SELECT coalesce(o.kind, l.kind) AS kind, coalesce(o.id, l.id) AS id, coalesce(new_name, name) AS name, o.id IS NULL AS unknown FROM ({_OBJECTS}) o FULL JOIN l ON o.kind = l.kind AND o.id = l.id)
SELECT kind, id, name, CASE WHEN unknown THEN 'unknown object' WHEN (SELECT count(*) FROM b c WHERE c.kind = b.kind AND c.name = b.name AND NOT c.unknown) > 1 THEN 'name is taken' END AS problem FROM b""")
def _(s, d):
    return mapping.renamed(frame(s, d, _OBJECTS), frame(s, d, _RENAMES))


_LAYOUT = f"""WITH b AS (SELECT table_id, part_day, count(DISTINCT k % 4) AS src_buckets, count(DISTINCT CASE WHEN table_id % 2 = 0 THEN k % 4 ELSE k % 3 END) AS dst_buckets FROM ({X.ROWS}) r GROUP BY ALL)
SELECT * FROM b WHERE src_buckets <> dst_buckets"""


@query("layout_mismatch", _LAYOUT)
def _(s, d):
    rows = frame(s, d, X.ROWS)
    return mapping.layout_mismatch(rows.withColumn("bucket", F.expr("k % 4")), rows.withColumn("bucket", F.expr("CASE WHEN table_id % 2 = 0 THEN k % 4 ELSE k % 3 END")), "table_id", "part_day")


@query("view_dependencies", "SELECT 'v_' || c_custkey AS view, 't_' || (100 + c_custkey % 10) AS table_name FROM customer WHERE c_custkey % 10 <> 3")
def _(s, d):
    tables = frame(s, d, "SELECT DISTINCT 't_' || (100 + c_custkey % 10) AS table_name FROM customer").where("table_name <> 't_103'")
    return mapping.views_of(frame(s, d, X.VIEWS), tables)


# --- aggregates and triage --------------------------------------------------------------------


@query("start_cursor", f"SELECT min(cursor_seq) AS start_seq FROM ({X.CURSORS}) c")
def _(s, d):
    return progress.start_cursor(frame(s, d, X.CURSORS))


@query("advance_cursors", f"SELECT c.table_id, greatest(cursor_seq, coalesce(seen, cursor_seq)) AS cursor_seq FROM ({X.CURSORS}) c LEFT JOIN (SELECT table_id, max(commit_seq) AS seen FROM ({X.ROWS}) r WHERE commit_seq <= {MIDDLE} GROUP BY table_id) s ON s.table_id = c.table_id")
def _(s, d):
    return progress.advance(frame(s, d, X.CURSORS), frame(s, d, X.ROWS).where(F.col("commit_seq") <= middle(s, d)))


@query("catchup_point", f"SELECT min(commit_seq) AS catchup_seq FROM ({X.LOG}) l WHERE commit_seq >= (SELECT max(cursor_seq) FROM ({X.CURSORS}) c)")
def _(s, d):
    return progress.catchup_point(log(s, d), frame(s, d, X.CURSORS))


@query("lag", f"SELECT c.table_id, count(CASE WHEN commit_seq > cursor_seq THEN 1 END) AS lag FROM ({X.CURSORS}) c LEFT JOIN ({X.LOG}) l ON l.table_id = c.table_id GROUP BY c.table_id")
def _(s, d):
    return progress.lag_of(log(s, d), frame(s, d, X.CURSORS), "table_id")


@query("log_counters", f"SELECT table_id, type, count(*) AS n, min(commit_seq) AS first_seq, max(commit_seq) AS last_seq FROM ({X.LOG}) l GROUP BY ALL")
def _(s, d):
    return progress.counters(log(s, d), "table_id", "type")


@query("touched_partitions", f"SELECT table_id, table_id * 100 + part_day AS partition_id, max(commit_seq) AS version, count(*) AS n FROM ({X.LOG}) l WHERE type = 'UPSERT' GROUP BY ALL")
def _(s, d):
    return progress.touched_partitions(P.upsert_partitions(frame(s, d, X.PAYLOAD)))


_STATE = "CASE sync_state " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in progress.STATES.items()) + " END"


@query("job_progress", f"SELECT job, commit_seq, {_STATE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY persisted_at DESC, commit_seq DESC) AS place FROM ({X.PROGRESS}) p) r WHERE place = 1")
def _(s, d):
    return progress.latest_progress(frame(s, d, X.PROGRESS))


@query("full_sync_events", f"SELECT job, commit_seq, full_sync_start_at FROM (SELECT *, lag(full_sync_start_at) OVER (PARTITION BY job ORDER BY commit_seq) AS b FROM ({X.PROGRESS}) p) r WHERE b <> full_sync_start_at")
def _(s, d):
    return progress.full_sync_events(frame(s, d, X.PROGRESS)).select("job", "commit_seq", "full_sync_start_at")


_KINDS = f"SELECT commit_seq, CASE WHEN type = 'CREATE_TABLE' AND commit_seq % 2 = 0 THEN 'MODIFY_PARTITIONS' ELSE type END AS type, job_type, job_state, commit_seq % 2 = 0 AS strict_range, commit_seq % 3 = 0 AS temp_name FROM ({_JOBS}) j"


@query("triage", f"""SELECT type, action, count(*) AS n FROM (SELECT type, CASE
  WHEN type = 'ALTER_JOB' AND job_state IN ('PENDING', 'CANCELLED') THEN 'IGNORE' WHEN type = 'ALTER_JOB' AND job_type = 'ROLLUP' THEN 'FULL_SYNC' WHEN type = 'ALTER_JOB' THEN 'PARTIAL_SYNC_REPLACE'
  WHEN type = 'REPLACE_PARTITIONS' AND (NOT strict_range OR temp_name) THEN 'FULL_SYNC' WHEN type = 'REPLACE_PARTITIONS' THEN 'PARTIAL_SYNC' WHEN type = 'DUMMY' THEN 'FULL_SYNC'
  WHEN type = 'UPSERT' THEN 'APPLY_ROWS' WHEN type = 'BARRIER' THEN 'IGNORE' WHEN type = 'MODIFY_PARTITIONS' THEN 'ERROR' ELSE 'APPLY_DDL' END AS action FROM ({_KINDS}) j) t GROUP BY ALL""")
def _(s, d):
    jobs = log(s, d).select("commit_seq", "type").join(frame(s, d, X.ALTER).select("commit_seq", "job_type", "job_state"), "commit_seq", "left")
    kind = F.expr("IF(type = 'CREATE_TABLE' AND commit_seq % 2 = 0, 'MODIFY_PARTITIONS', type)")
    acts = progress.action(F.col("type"), F.col("job_type"), F.col("job_state"), F.expr("commit_seq % 2 = 0"), F.expr("commit_seq % 3 = 0"))
    return jobs.withColumn("type", kind).select("type", acts.alias("action")).groupBy("type", "action").agg(F.count("*").alias("n"))


_FAILED = f"SELECT table_id, commit_seq, CASE commit_seq % 50 WHEN 0 THEN 'meta' WHEN 1 THEN 'rpc' ELSE 'be' END AS category FROM ({X.LOG}) l WHERE type = 'UPSERT' AND table_id <> 105"


@query("resync_list", f"""SELECT table_id, min(commit_seq) AS since_seq, arg_min(reason, commit_seq) AS reason FROM (
SELECT table_id, commit_seq, 'meta error' AS reason FROM ({_FAILED}) f WHERE category = 'meta' UNION ALL SELECT table_id, commit_seq, 'forced' FROM ({X.LOG}) l WHERE type = 'DUMMY') t GROUP BY table_id""")
def _(s, d):
    return progress.to_resync(frame(s, d, _FAILED), log(s, d).where("type = 'DUMMY'"))
