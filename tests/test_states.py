"""Sketches kept as states, and diffs narrowed by checksums."""

from pyspark.sql import functions as F

from logweave.operators import verify
from logweave.plans import table_queries as t

SF = "/root/testdata/sf0.001"


def test_sketches_of_many_batches_are_near(spark):
    rows = t.rows(spark, SF)
    for r in t.batched_states(spark, SF).collect():
        own = rows.where(F.col("table_id") == r.table_id)
        exact, v = own.select("k").distinct().count(), sorted(x.v for x in own.select("v").collect())
        assert abs(r.hll - exact) <= 0.1 * exact + 2 and r.n_keys == exact
        assert 0.4 <= sum(x <= r.middle_v for x in v) / len(v) <= 0.6
        break


def test_texts_of_rows_are_told_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), ("-", "1:x"), (None, None), ("", ""), ("1:a", "b"), ("1", "a|1:b")]
    got = [r.t for r in spark.createDataFrame(rows, "x string, y string").select(verify.row_text(["x", "y"]).alias("t")).collect()]
    assert len(set(got)) == len(rows)


def test_narrowed_diff_is_the_whole_diff(spark):
    a = spark.range(5_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("p"), F.expr("IF(id % 11 = 0, NULL, id * 3)").alias("v"))
    changed = F.expr("CASE WHEN k IN (22, 1001) THEN coalesce(v, 0) + 1 ELSE v END")
    b = a.where("k != 77").withColumn("v", changed).withColumn("p", F.expr("IF(k = 500, 9L, p)")).unionByName(spark.createDataFrame([(9_999, 1, None)], a.schema))
    want = sorted(map(tuple, verify.diff_rows(a, b, "k").collect()))
    assert want == [(22, "CHANGED"), (77, "MISSING"), (500, "CHANGED"), (1001, "CHANGED"), (9999, "EXTRA")]
    assert sorted(map(tuple, verify.narrowed_diff(a, b, "p", "k").collect())) == want
    assert verify.narrowed_diff(a, a, "p", "k").count() == 0
    few = verify.differing(a.withColumn("__range", F.pmod(F.xxhash64("k"), F.lit(1024))), b.withColumn("__range", F.pmod(F.xxhash64("k"), F.lit(1024))), "__range")
    assert few.count() <= 5
