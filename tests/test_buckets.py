"""Bucketed layouts: the source's number is taken over, tables of one layout join where they lie."""

import re

from pyspark.sql import functions as F

from logweave.operators.routing import distribution_sql
from logweave.plans import flow_queries as q
from logweave.sources import buckets as B
from logweave.sources.snapshots import Names

SF = "/root/testdata/sf0.001"


def test_one_layout_joins_without_an_exchange(spark):
    source, target = q.bucketed_pair(spark, SF)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = source.join(target.select("k", F.col("cents").alias("c")), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and len(re.findall("SelectedBucketsCount: 12 out of 12", plan)) == 2
        assert joined.count() == source.join(target, "k", "left_semi").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_layout_is_followed_once_and_readers_can_end(spark, tmp_path):
    names = Names(spark, "test_buckets")
    hot = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    B.write_bucketed(hot, "test_buckets.t_3", f"file://{tmp_path}/3", B.Layout(("k",), 3))
    names.point({"t": "test_buckets.t_3"})
    begun, new = names.read("t"), B.Layout(("k", "v"), 5)
    assert B.layout_of(spark, "test_buckets.t_3") == B.Layout(("k",), 3)
    assert B.follow_layout(spark, names, "t", "test_buckets.t_5", f"file://{tmp_path}/5", new) and B.layout_of(spark, "test_buckets.t_5") == new
    assert not B.follow_layout(spark, names, "t", "test_buckets.t_6", f"file://{tmp_path}/6", new)
    want = sorted(map(tuple, hot.collect()))
    assert sorted(map(tuple, begun.collect())) == want == sorted(map(tuple, names.read("t").collect()))
    B.write_bucketed(hot.limit(0), "test_buckets.none", f"file://{tmp_path}/none", new)
    assert spark.table("test_buckets.none").count() == 0
    B.write_bucketed(hot, "test_buckets.dealt", f"file://{tmp_path}/dealt", B.Layout((), 4))
    sizes = [r["count"] for r in spark.table("test_buckets.dealt").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 8 and B.layout_of(spark, "test_buckets.dealt").buckets == 0


def test_distribution_texts(spark):
    cases = [
        ("ALTER TABLE t ADD PARTITION `buckets` VALUES IN ('distributed by')", ["a", "b"], "ALTER TABLE t ADD PARTITION `buckets` VALUES IN ('distributed by') DISTRIBUTED BY HASH(a,b) BUCKETS 9"),
        ("ADD PARTITION p DISTRIBUTED BY HASH(a) Buckets 3;;", ["a"], "ADD PARTITION p DISTRIBUTED BY HASH(a) Buckets 3"), ("ADD PARTITION p\nDISTRIBUTED BY RANDOM\nBUCKETS  AUTO ;", [], "ADD PARTITION p\nDISTRIBUTED BY RANDOM BUCKETS 9"),
        ("ADD PARTITION p", [], "ADD PARTITION p DISTRIBUTED BY RANDOM BUCKETS 9"), (None, [], None)]
    rows = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "i int, t string, c array<string>")
    got = {r.i: r.s for r in rows.select("i", distribution_sql(F.col("t"), F.col("c"), F.lit(9)).alias("s")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}
