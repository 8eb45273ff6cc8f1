"""Clauses of DDL texts."""

import pytest

from logweave.functions import clauses as C
from pyspark.sql import functions as F

LIST = 'ALTER TABLE `db`.`t_431e` ADD COLUMN (`last_key` int NULL DEFAULT "0" COMMENT "", `last_value` decimal(10, 3) SUM NULL DEFAULT "0" COMMENT "a, (b) DROP COLUMN `c`")'


def of(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sql string")
    return [r.asDict() for r in f(df, F.col("sql")).drop("sql").orderBy("i", "place").collect()]


def test_columns(spark):
    texts = [LIST, "ALTER TABLE t ADD COLUMN `first` INT KEY DEFAULT \"0\" FIRST", "ALTER TABLE t ADD COLUMN `a` int, DROP COLUMN `b`, MODIFY COLUMN c VARCHAR(20) DEFAULT 'it\\'s' AFTER `a b`",
             "alter table x.y.z drop column if exists `v`;", "ALTER TABLE t ADD COLUMN m MAP<STRING, INT> COMMENT 'x'", "ALTER TABLE t ADD PARTITION p VALUES LESS THAN (5)", "", "ALTER TABLE t ORDER BY (a, b)", "ALTER TABLE t ADD COLUMN n INT DEFAULT NULL"]
    got = [(r["i"], r["change"], r["column"], r["type"], r["is_key"], r["aggregate"], r["default"], r["comment"], r["first"], r["after"]) for r in of(spark, C.column_changes, *texts)]
    assert got == [
        (0, "ADD", "last_key", "INT", False, None, "0", "", False, None), (0, "ADD", "last_value", "DECIMAL(10,3)", False, "SUM", "0", "a, (b) DROP COLUMN `c`", False, None),
        (1, "ADD", "first", "INT", True, None, "0", None, True, None), (2, "ADD", "a", "INT", False, None, None, None, False, None), (2, "DROP", "b", None, False, None, None, None, False, None),
        (2, "MODIFY", "c", "VARCHAR(20)", False, None, "it's", None, False, "a b"), (3, "DROP", "v", None, False, None, None, None, False, None),
        (4, "ADD", "m", "MAP<STRING,INT>", False, None, None, "x", False, None), (8, "ADD", "n", "INT", False, None, None, None, False, None)]


def test_partitions(spark):
    texts = ["DROP PARTITION IF EXISTS p_9", "ALTER TABLE t DROP PARTITION p_1 FORCE", "ALTER TABLE t ADD TEMPORARY PARTITION `tp 3` VALUES [(\"1\"), (\"2\"))", "DROP TEMPORARY PARTITION x, DROP PARTITION IF EXISTS `IF`", "DROP COLUMN partition", "ADD PARTITION p IN"]
    got = [(r["i"], r["change"], r["partition"], r["temporary"], r["if_exists"], r["force"], r["bounds"]) for r in of(spark, C.partition_changes, *texts)]
    assert got == [
        (0, "DROP", "p_9", False, True, False, None), (1, "DROP", "p_1", False, False, True, None), (2, "ADD", "tp 3", True, False, False, '[ ( "1" ) , ( "2" ) )'),
        (3, "DROP", "x", True, False, False, None), (3, "DROP", "IF", False, True, False, None), (5, "ADD", "p", False, False, False, None)]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 3_000])
def test_long_lists(spark, n):
    text = "ALTER TABLE t ADD COLUMN (" + ", ".join(f"`c{i}` VARCHAR(20) DEFAULT \"{i}\"" for i in range(n)) + ")"
    got = of(spark, C.column_changes, text)
    assert [(r["column"], r["default"], r["type"]) for r in got] == [(f"c{i}", str(i), "VARCHAR(20)") for i in range(n)]


def test_listed_names(spark):
    df = spark.createDataFrame([("PARTITIONS (p1, `p,2` )",), ("PARTITION(`ONE`, `THREE`)",), ("x",), (None,)], "s string")
    assert [r.n for r in df.select(C.listed_names(F.col("s")).alias("n")).collect()] == [["p1", "p,2"], ["ONE", "THREE"], [], []]
