"""Log replay on texts as sources write them, and in orders that a cluster delivers."""

from pyspark.sql import functions as F

from logweave.sources.snapshots import ChangeTable
from logweave.streaming.replay import Replica

SCHEMA = "commit_seq long, type string, table_id long, part string, k long, v long, op string, data string"


def row(seq, part, k, v=0):
    return (seq, "UPSERT", 1, part, k, v, "U", None)


def ddl(seq, kind, data, part=None):
    return (seq, kind, 1, part, None, None, None, data)


def test_partitions_are_cut_by_the_name_they_bore(spark, tmp_path):
    rows = [
        row(1, "10", 1), row(2, "20", 2), ddl(0, "ADD_PARTITION", '{"tableId":1,"sql":"ADD PARTITION p1 VALUES LESS THAN (5)"}', "10"), ddl(3, "RENAME_TABLE", '{"tb":1,"nP":"q1","oP":"p1"}'),
        row(4, "10", 3), ddl(5, "ADD_PARTITION", '{"tableId":1,"sql":"ALTER TABLE t ADD PARTITION IF NOT EXISTS `p1` VALUES LESS THAN (9)"}', "30"), row(6, "30", 4),
        ddl(7, "DROP_PARTITION", '{"tableId":1,"sql":"ALTER TABLE t DROP PARTITION IF EXISTS q1 FORCE"}'), row(8, "30", 5), row(9, "10", 6),
        ddl(10, "RENAME_TABLE", '{"tb":1,"nP":"r1","oP":"p1"}'), ddl(11, "TRUNCATE_TABLE", '{"tblId":1,"isEntireTable":false,"rawSql":"PARTITIONS (`r1`, p9)"}'), row(12, "30", 7), ddl(13, "DROP_PARTITION", '{"tableId":1,"sql":"DROP TEMPORARY PARTITION r1"}')]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, parts in (("one", [F.lit(True)]), ("late", [F.col("commit_seq") > 6, F.col("commit_seq") <= 6])):
        replica = Replica(spark, f"file://{tmp_path}/{name}")
        for number, part in enumerate(parts):
            replica.apply(number, df.where(part))
        assert sorted((r.part, r.k) for r in replica.read().collect()) == [("10", 6), ("20", 2), ("30", 7)]


def test_bad_records_are_refused(spark, tmp_path):
    bad = [("REPLACE_PARTITIONS", '{"tblId":1,"tblName":"t","strictRange":true,"tempPartitions":[]}'), ("ALTER_JOB", "no json"), ("ADD_PARTITION", '{"tableId":1}'), ("CREATE_TABLE", None), ("NEW_KIND", "{}")]
    good = [("REPLACE_PARTITIONS", '{"tblId":1,"tblName":"t","strictRange":true,"tempPartitions":["x"]}'), ("DUMMY", None), ("BARRIER", None)]
    replica = Replica(spark, f"file://{tmp_path}/r")
    replica.apply(0, spark.createDataFrame([ddl(i, *x) for i, x in enumerate(bad + good)], SCHEMA))
    assert [r.commit_seq for r in replica.refused.read().orderBy("commit_seq").collect()] == [0, 1, 2, 3, 4]
    assert sorted((r.commit_seq, r.action) for r in replica.syncs.read().collect()) == [(5, "PARTIAL_SYNC"), (6, "FULL_SYNC")]


def test_late_batches_are_kept(spark, tmp_path):
    df = lambda k: spark.createDataFrame([(k, k, "U")], "k long, commit_seq long, op string")
    table = ChangeTable(spark, f"file://{tmp_path}/t", ["k"])
    for batch in (3, -1, 5):
        assert table.apply(batch, df(batch + 10))
    table.compact()
    assert table.has(-1) and table.has(3) and not table.has(0) and not table.has(4)
    assert table.apply(0, df(10)) and table.apply(1, df(11)) and table.apply(4, df(14))
    table.compact()
    table.compact()
    assert table.apply(2, df(12)) and not table.apply(0, df(99)) and not table.apply(2, df(99))
    table.compact()
    table.compact()
    assert sorted(r.k for r in table.read().collect()) == [9, 10, 11, 12, 13, 14, 15] and not table.apply(-1, df(99))
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1


def test_versions_of_columns(spark):
    from logweave.operators.evolution import in_last_schema, schema_versions

    first = spark.createDataFrame([(1, 0, "k", "INT"), (1, 1, "a", "INT")], "table_id long, place int, column string, type string")
    changes = spark.createDataFrame([(1, 10, 0, "DROP", "a", None, None, None), (1, 20, 0, "ADD", "a", None, "STRING", "new"), (1, 30, -1, "RENAME", "k", "key", None, None), (2, 5, 0, "ADD", "x", None, "INT", None)],
                                    "table_id long, commit_seq long, place int, change string, column string, new_name string, type string, default string")
    rows = spark.createDataFrame([(1, 1, '{"k":1,"a":5}'), (1, 15, '{"k":2}'), (1, 20, '{"k":3,"a":"s"}'), (1, 31, '{"key":4,"a":null}'), (2, 1, "{}"), (3, 1, None)], "table_id long, commit_seq long, data string")
    got = {(r.table_id, r.commit_seq): r.row and [(c.name, c.value) for c in r.row] for r in in_last_schema(rows, schema_versions(first, changes)).collect()}
    assert got == {(1, 1): [("key", "1"), ("a", "new")], (1, 15): [("key", "2"), ("a", "new")], (1, 20): [("key", "3"), ("a", "s")], (1, 31): [("key", "4"), ("a", None)], (2, 1): [("x", None)], (3, 1): None}
