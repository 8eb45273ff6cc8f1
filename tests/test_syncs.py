"""Syncs that records start: delivered again, out of order, of renamed partitions, without rows, and after a trimmed log."""

from pyspark.sql import functions as F

from logweave.operators.progress import behind
from logweave.streaming.syncs import SyncingReplica

SCHEMA = "commit_seq long, type string, table_id long, part string, k long, v long, op string, data string"
ROWS = "table_id long, scope string, part string, k long, commit_seq long, v long, data string"


def up(seq, table, part, k, v, op="U"):
    return (seq, "UPSERT", table, part, k, v, op, None)


def ddl(seq, kind, data, table=1, part=None):
    return (seq, kind, table, part, None, None, None, data)


def replace(seq, *parts):
    named = ",".join(f'"{p}"' for p in parts)
    return ddl(seq, "REPLACE_PARTITIONS", f'{{"tblId":1,"tblName":"t","partitions":[{named}],"tempPartitions":["x"],"strictRange":true,"useTempName":false}}')


def replica(spark, folder, at, rows):
    """The source's copy has ``rows`` (scope, part, k, v) at position ``at``; what is asked for is written down."""
    asked = []

    def copy(wanted):
        asked.append(sorted((r.table_id, r.scope, r.called_seq) for r in wanted.collect()))
        have = spark.createDataFrame([(1, scope, part, k, at, v, None) for scope, part, k, v in rows], ROWS)
        return have.join(wanted.select("table_id", "scope"), ["table_id", "scope"]), wanted.select("table_id").distinct().withColumn("cursor_seq", F.lit(at).cast("long"))

    return SyncingReplica(spark, f"file://{folder}", copy), asked


def state(r):
    return sorted((x.table_id, x.part, x.k, x.v) for x in r.read().collect())


def test_a_partition_is_copied_by_the_name_it_bore(spark, tmp_path):
    log = spark.createDataFrame([
        up(1, 1, "p1", 1, 1), up(2, 1, "p2", 2, 2), up(3, 2, "p1", 9, 9), ddl(4, "RENAME_TABLE", '{"tb":1,"nP":"q1","oP":"p1"}'), replace(5, "q1"), up(6, 1, "p1", 3, 3),
        up(7, 1, "p2", 4, 4), up(8, 1, "p1", 7, 70), up(9, 1, "p1", 8, 0, "D"), ddl(10, "DROP_PARTITION", '{"tableId":1,"sql":"DROP PARTITION p2"}')], SCHEMA)
    want = [(1, "p1", 7, 70), (2, "p1", 9, 9)]
    for name, parts in (("one", [F.lit(True)]), ("late", [F.col("commit_seq") > 5, F.col("commit_seq") <= 5])):
        r, asked = replica(spark, tmp_path / name, 7, [("q1", "p1", 7, 7), ("q1", "p1", 8, 8)])
        for number, part in enumerate(parts):
            r.apply(number, log.where(part))
            r.apply(number, log.where(part))
        assert state(r) == want
        assert [a for a in asked] == [[(1, "q1", 5)]]


def test_a_table_copied_without_rows_is_empty_then_goes_on(spark, tmp_path):
    r, asked = replica(spark, tmp_path, 6, [])
    r.apply(0, spark.createDataFrame([up(1, 1, "p1", 1, 1), up(2, 2, "p1", 2, 2), ddl(3, "DUMMY", None), up(4, 1, "p1", 4, 4)], SCHEMA))
    assert state(r) == [(2, "p1", 2, 2)]
    r.apply(1, spark.createDataFrame([up(7, 1, "p1", 7, 7), up(6, 1, "p1", 1, 6)], SCHEMA))
    assert state(r) == [(1, "p1", 7, 7), (2, "p1", 2, 2)]
    r.apply(2, spark.createDataFrame([ddl(8, "TRUNCATE_TABLE", '{"tblId":1,"isEntireTable":true}')], SCHEMA))
    assert state(r) == [(2, "p1", 2, 2)] and asked == [[(1, "", 3)]]


def test_a_trimmed_log_sends_a_table_back_to_a_copy(spark, tmp_path):
    r, asked = replica(spark, tmp_path, 40, [("", "p1", 1, 5)])
    r.apply(0, spark.createDataFrame([up(1, 1, "p1", 1, 1), up(2, 2, "p1", 2, 2)], SCHEMA))
    gone = behind(spark.createDataFrame([(1, 1), (2, 29)], "table_id long, cursor_seq long"), 30)
    assert [(x.table_id, x.reason) for x in gone.collect()] == [(1, "log trimmed")]
    wanted = gone.select("table_id", F.lit("").alias("scope"), F.lit(30).cast("long").alias("commit_seq"))
    assert r.resync(-1, wanted) and not r.resync(-1, wanted)
    r.apply(1, spark.createDataFrame([up(35, 1, "p1", 1, 4), up(41, 2, "p1", 2, 3)], SCHEMA))
    assert state(r) == [(1, "p1", 1, 5), (2, "p1", 2, 3)] and asked == [[(1, "", 30)]]
