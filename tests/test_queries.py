"""Every registered query against its SQL, and the plans of some."""

import importlib.util

import __spark_entry__ as entry
import pytest
from oracle import difference, duck
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert difference(df, con, sql) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_buckets_are_even(spark):
    """Every row is in a bucket, and none has twice its share."""
    from logweave.operators.routing import bucket
    from logweave.plans import table_queries as t

    assert sum(r.n for r in t.QUERIES["bucket_sizes"](spark, SF).collect()) == t.rows(spark, SF).count()
    sizes = [r["count"] for r in spark.range(10_000).groupBy(bucket(["id"], 16).alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * 10_000 / 16


def test_thousands_of_ranges(spark):
    from logweave.operators.routing import by_range

    bounds = [(f"p{i}", 10 * i if i else None, 10 * (i + 1)) for i in range(3_000)]
    got = by_range(spark.range(-10, 30_010, 5), "id", bounds).collect()
    assert all(r.part == (None if r.id >= 30_000 else f"p{max(0, r.id // 10)}") for r in got)
    assert by_range(spark.range(1), "id", []).first().part is None


def test_as_of_blocks(spark):
    """Any block length gives the same values."""
    from logweave.operators.asof import as_of

    rows = [(k, i, "v%d" % i if i % 7 == k else None) for k in range(2) for i in range(0, 60, 1 + k)]
    df = spark.createDataFrame(rows, "key long, at long, v string")
    want = []
    for k, i, _ in rows:
        want.append((k, i, next((v for kk, j, v in reversed(rows) if kk == k and j <= i and v), None)))
    for block in (1, 5, 1_000):
        assert sorted(map(tuple, as_of(df, ["key"], "at", "v", "got", block).select("key", "at", "got").collect())) == sorted(want)


def test_as_of_rows_carry_one_value(spark):
    """What is set near a record or before its block is never gathered into arrays beside the record."""
    from logweave.operators.asof import as_of

    df = spark.createDataFrame([(1, -3, "a"), (1, 2, "b"), (1, 2, "c"), (1, 2, None), (1, 900, None), (2, 1, None), (1, None, None), (None, 5, "x")], "key long, at long, v string")
    got = as_of(df, ["key"], "at", "v", "got", 5)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r.at, r.got) for r in got.where("key = 1 AND at IS NOT NULL").collect())
    assert rows == [(-3, "a"), (2, "c"), (2, "c"), (2, "c"), (900, "c")]
    apart = as_of(df.drop("v"), ["key"], "at", "v", "got", 5, sets=df)
    assert sorted(map(str, apart.collect())) == sorted(map(str, got.select("key", "at", "got").collect()))


def test_payloads_are_parsed_once(spark):
    from logweave.functions import payloads as P

    df = P.accepted(spark.createDataFrame([(1, '{"tableId":5,"sql":"x"}'), (2, '{"sql":"x"}'), (3, None), (4, "no json")], "commit_seq long, data string"), "ADD_PARTITION")
    assert [r.commit_seq for r in df.collect()] == [1]
    assert df.select("p.sql", "p.tableId")._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_comments_stay_on_columns(spark, tmp_path):
    from logweave.operators.evolution import with_comments

    with_comments(spark.range(3).selectExpr("id AS a", "id AS `b.c`"), {"b.c": "it's b"}).write.parquet(f"{tmp_path}/t")
    assert [f.metadata.get("comment") for f in spark.read.parquet(f"{tmp_path}/t").schema] == [None, "it's b"]


def test_sketches_are_near(spark):
    from logweave.plans import table_queries as t

    rows = t.rows(spark, SF)
    exact = {r.table_id: r.n for r in rows.groupBy("table_id").agg(F.count_distinct("k").alias("n")).collect()}
    for r in t.QUERIES["fold_hll"](spark, SF).collect():
        assert abs(r.n_distinct - exact[r.table_id]) <= 0.1 * exact[r.table_id] + 2
    for r in t.QUERIES["fold_quantile"](spark, SF).collect():
        v = [x.v for x in rows.where(F.col("table_id") == r.table_id).select("v").collect()]
        assert 0.4 <= sum(x <= r.quantile for x in v) / len(v) <= 0.6


def test_cursor_reaches_the_scan(spark, tmp_path):
    from logweave.plans.log_queries import log
    from logweave.sources.log import since

    path = str(tmp_path / "log")
    log(spark, SF).select("commit_seq", "type", "k").write.parquet(path)
    plan = since(spark.read.parquet(path), 500).select("type")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(commit_seq,500)" in plan and "k#" not in plan.split("ReadSchema")[1]


def test_any_split_and_order_of_the_log_gives_the_same_table(spark, tmp_path):
    from logweave.operators.folds import latest
    from logweave.plans.flow_queries import _rows
    from logweave.sources.snapshots import ChangeTable

    keys, rows = ["table_id", "k"], _rows(spark, SF)
    want = sorted(map(str, latest(rows, keys, ["commit_seq"], F.expr("op = 'D'")).select(*keys, "commit_seq", "v").collect()))
    for number, cuts in enumerate(([300], [10, 11, 700])):
        table = ChangeTable(spark, f"file://{tmp_path}/t{number}", keys)
        parts = list(zip([-1, *cuts], [*cuts, 10**9]))
        for batch, (lo, hi) in enumerate(reversed(parts) if number else parts):
            part = rows.where(F.col("commit_seq").between(lo + 1, hi))
            assert table.apply(batch, part)
            assert not table.apply(batch, part)
            if batch == 1:
                table.compact()
                table.compact()
        got = table.read().select(*keys, "commit_seq", "v")
        assert sorted(map(str, got.collect())) == want


def test_rollback_and_unfinished_batches(spark, tmp_path):
    from logweave.sources.snapshots import ChangeTable

    table = ChangeTable(spark, f"file://{tmp_path}/t", ["k"])
    assert table.read() is None
    rows = spark.createDataFrame([(1, 5, "U"), (2, 6, "U"), (1, 4, "D")], "k long, commit_seq long, op string")
    table.apply(0, rows.limit(1))
    table.apply(1, rows)
    assert table.read().count() == 2
    table.rollback(0)
    assert table.read().count() == 1 and table.apply(1, rows)
    rows.write.parquet(f"{tmp_path}/t/batch-2")
    (tmp_path / "t" / "batch-2" / "_SUCCESS").unlink()
    assert not table.has(2) and table.read().count() == 2
    table.compact()
    with pytest.raises(ValueError):
        table.rollback(0)
    assert table.has(0) and table.has(1) and table.apply(2, spark.createDataFrame([(2, 7, "D")], "k long, commit_seq long, op string"))
    assert [r.k for r in table.read().collect()] == [1]


def test_names_always_stand_for_a_table(spark, tmp_path):
    from logweave.sources.snapshots import Names

    names = Names(spark, "test_names")
    for n in ("a", "b"):
        spark.range(1 + (n == "b")).write.parquet(f"{tmp_path}/{n}")
        names.point({n: f"file://{tmp_path}/{n}"})
    begun = names.read("a")
    assert names.replace("a", "b", swap=True) and names.read("a").count() == 2 and names.read("b").count() == 1
    assert names.replace("a", "b") and not names.replace("a", "b") and names.read("a").count() == 1 and set(names.now()) == {"a"}
    names.point({"a": f"file://{tmp_path}/b"})
    assert begun.count() == 1 and Names(spark, "test_names").read("a").count() == 2


@pytest.mark.parametrize("broken", ["__missing__", "corpus_pipeline", "logweave.llm.registry"])
def test_llm_is_optional(monkeypatch, broken):
    """Without the subpackage, or if it can't be imported, the other queries stay."""
    load = entry.importlib.import_module

    def refuse(name):
        if name == broken or broken == "__missing__":
            raise ImportError(name)
        return load(name)

    monkeypatch.setattr(entry.importlib, "import_module", refuse)
    left = set(entry.queries())
    assert NAMES and set(NAMES) <= left and "pipeline" not in left
    assert ("op3_exact_dedup" in entry.oracle_sql()) == (broken == "corpus_pipeline" and importlib.util.find_spec("logweave.llm") is not None)
