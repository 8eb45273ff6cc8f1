"""What a replay's cost depends on: the size of a batch, not its number of files; rows that aren't cached; names bound in one pass."""

from logweave.streaming import follow, replay
from pyspark.sql import functions as F

SCHEMA = "commit_seq long, type string, table_id long, part string, k long, v long, op string, data string"


def test_batches_go_by_size(spark, tmp_path):
    spark.range(1_000).repartition(9).write.parquet(f"file://{tmp_path}/log")
    seen = []
    follow.drain(follow.stream(spark, f"file://{tmp_path}/log", bytes_per_batch=2**30), f"file://{tmp_path}/checkpoint", lambda b, n: seen.append(b.count()))
    assert seen == [1_000]


def test_rows_of_a_batch_are_not_cached(spark, tmp_path):
    df, cached = spark.createDataFrame([(1, "UPSERT", 1, "p1", 1, 5, "U", None), (2, "DUMMY", 1, None, None, None, None, None), (3, "NEW_KIND", 1, None, None, None, None, "{}")], SCHEMA), []

    class Watched(replay.Replica):
        def carry_out(self, batch, called):
            cached.append(df.storageLevel.useMemory)

    watched = Watched(spark, f"file://{tmp_path}/r")
    watched.apply(0, df)
    assert cached == [False]
    assert [(r.part, r.k, r.v) for r in watched.read().collect()] == [("p1", 1, 5)]
    assert [r.commit_seq for r in watched.refused.read().collect()] == [3] and [r.commit_seq for r in watched.syncs.read().collect()] == [2]


def test_names_are_bound_in_one_pass(spark):
    chain = [(1, i, f"n{i % 7}", None, f"n{(i - 1) % 7}") for i in range(1, 400)] + [(1, 50, "x", "id9", None), (1, 60, "y", None, "x"), (2, 1, "a", "b", None)]
    got = replay._bound_names(spark.createDataFrame(chain, "table_id long, commit_seq long, name string, id string, old string"))
    now, want = {}, [(2, "a", 1, "b")]
    for _, at, name, own, old in sorted((r for r in chain if r[0] == 1), key=lambda r: r[1:3]):
        now[name] = own or now.get(old, old)
        want.append((1, name, at, now[name]))
    assert sorted(map(tuple, got.select("table_id", "part", "commit_seq", "id").collect())) == sorted(want)
    assert "array_append" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_last_of_scopes(spark):
    from logweave.plans.flow_queries import _last_of_scopes

    rows = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p1"), (3, "p1")], "table_id long, part string")
    records = spark.createDataFrame([(1, "", 5), (1, "p1", 9), (1, "p2", 3), (2, "p1", 4), (2, "p9", 8)], "table_id long, part string, commit_seq long")
    got = _last_of_scopes(rows, records, "last")
    assert sorted(map(str, got.select("table_id", "part", "last").collect())) == sorted(map(str, rows.withColumn("last", F.expr("CASE WHEN table_id = 1 AND part = 'p1' THEN 9L WHEN table_id = 1 THEN 5L WHEN table_id = 2 THEN 4L END")).collect()))
