"""Queries over tables: folds, routing, schema evolution, partition replay, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evolution, folds, routing, verify
from ..sources import snapshots
from . import fixtures as X
from .fixtures import frame
from .log_queries import MIDDLE, log, middle

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYS = ["table_id", "k"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rows(s, d):
    return frame(s, d, X.ROWS)


# --- folds ------------------------------------------------------------------------------------


@query("fold_duplicate", f"SELECT commit_seq, table_id, k, v FROM ({X.ROWS}) r")
def _(s, d):
    r, c = rows(s, d).select("commit_seq", "table_id", "k", "v"), middle(s, d)
    return folds.append(r.where(F.col("commit_seq") <= c), r.where(F.col("commit_seq") > c))


def unique_sql(source: str = X.ROWS, order: str = "commit_seq DESC", where: str = "true") -> str:
    return f"""SELECT table_id, k, commit_seq, v FROM (SELECT *, row_number() OVER (PARTITION BY table_id, k ORDER BY {order}) AS place
FROM ({source}) r WHERE {where}) u WHERE place = 1 AND op <> 'D'"""


def unique(r, order=("commit_seq",)):
    return folds.latest(r.select("table_id", "k", "commit_seq", "v", "op", "seq"), KEYS, list(order), F.expr("op = 'D'")).select("table_id", "k", "commit_seq", "v")


@query("fold_unique", unique_sql())
def _(s, d):
    return unique(rows(s, d))


@query("fold_unique_seq", unique_sql(order="seq DESC, commit_seq DESC"))
def _(s, d):
    return unique(rows(s, d), ("seq", "commit_seq"))


_AGG = f"SELECT table_id, k, sum(v)::BIGINT AS sum_v, max(v) AS max_v, min(v) AS min_v, arg_max(v, commit_seq) AS last_v FROM ({X.ROWS}) r GROUP BY ALL"
_FUNCTIONS = {"sum_v": ("SUM", "v"), "max_v": ("MAX", "v"), "min_v": ("MIN", "v"), "last_v": ("REPLACE", "v")}


@query("fold_aggregate", _AGG)
def _(s, d):
    return folds.aggregated(rows(s, d), KEYS, _FUNCTIONS)


@query("fold_replace_if_not_null", f"SELECT table_id, k, arg_max(v_nullable, commit_seq) FILTER (WHERE v_nullable IS NOT NULL) AS last_v FROM ({X.ROWS}) r GROUP BY ALL")
def _(s, d):
    return folds.aggregated(rows(s, d), KEYS, {"last_v": ("REPLACE_IF_NOT_NULL", "v_nullable")})


@query("merge_aggregate", _AGG)
def _(s, d):
    r, c = rows(s, d), middle(s, d)
    state = lambda part: folds.aggregated(part, KEYS, _FUNCTIONS | {"last_seq": ("MAX", "commit_seq")})
    both = state(r.where(F.col("commit_seq") <= c)).unionByName(state(r.where(F.col("commit_seq") > c)))
    return folds.merged(both, KEYS, {n: f for n, (f, _) in _FUNCTIONS.items()})


_STATES = {"n_keys": ("BITMAP_UNION", "k"), "sum_v": ("SUM", "v"), "last_v": ("REPLACE_IF_NOT_NULL", "v_nullable"), "newest_v": ("REPLACE", "v"), "max_v": ("MAX", "v"), "hll": ("HLL_UNION", "k"), "middle_v": ("QUANTILE_UNION", "v")}


def batched_states(s, d, n: int = 4):
    """The states of n batches, merged one after the other as they come."""
    r, kept = rows(s, d), None
    for batch in range(n):
        new = folds.states(r.where(F.col("commit_seq") % n == batch), ["table_id"], _STATES)
        kept = new if kept is None else folds.merged_states(kept.unionByName(new), ["table_id"], _STATES)
    return folds.from_states(kept, ["table_id"], _STATES)


@query("merge_states", f"""SELECT table_id, count(DISTINCT k) AS n_keys, sum(v)::BIGINT AS sum_v, arg_max(v_nullable, commit_seq) FILTER (WHERE v_nullable IS NOT NULL) AS last_v, arg_max(v, commit_seq) AS newest_v, max(v) AS max_v
FROM ({X.ROWS}) r GROUP BY table_id""")
def _(s, d):
    return batched_states(s, d).drop("hll", "middle_v")


@query("fold_bitmap", f"SELECT table_id, count(DISTINCT k) AS n_distinct FROM ({X.ROWS}) r GROUP BY ALL")
def _(s, d):
    return folds.distinct_bitmap(rows(s, d), ["table_id"], "k")


@query("fold_hll")
def _(s, d):
    return folds.distinct_sketch(rows(s, d), ["table_id"], "k", F.expr("commit_seq % 4"))


@query("fold_quantile")
def _(s, d):
    return folds.quantile_sketch(rows(s, d), ["table_id"], "v", F.expr("commit_seq % 4"))


@query("bucket_sizes")
def _(s, d):
    return rows(s, d).groupBy(routing.bucket(["table_id", "k"], 16).alias("bucket")).agg(F.count("*").alias("n"))


@query("delete_predicate", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_quantity >= 40 OR (l_linenumber <> 1 AND l_discount = 0.05))")
def _(s, d):
    lines = frame(s, d, "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, l_discount FROM lineitem")
    gone = F.expr("l_returnflag = 'R' OR l_quantity >= 40 OR (l_linenumber <> 1 AND l_discount = 0.05D)")
    return folds.without_matching(lines, gone).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("quantity"))


def _cut(name: str, kind: str, keys: list[str]):
    same = " AND ".join(f"c.{k} = r.{k}" for k in keys)

    @query(name, f"SELECT commit_seq, r.table_id, r.part_day, k, v FROM ({X.ROWS}) r WHERE NOT EXISTS (SELECT 1 FROM ({X.LOG}) c WHERE c.type = '{kind}' AND {same} AND c.commit_seq >= r.commit_seq)")
    def run(s, d):
        return folds.cut(rows(s, d), log(s, d), kind, keys).select("commit_seq", "table_id", "part_day", "k", "v")


_cut("drop_partition", "DROP_PARTITION", ["table_id", "part_day"])
_cut("truncate_partitions", "TRUNCATE_TABLE", ["table_id", "part_day"])
_cut("truncate_table", "TRUNCATE_TABLE", ["table_id"])

# --- routing ------------------------------------------------------------------------------------


@query("auto_partition", "SELECT CAST(ts AS DATE) AS part, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return frame(s, d, "SELECT ts FROM events").groupBy(routing.day_of("ts").alias("part")).agg(F.count("*").alias("n"))


_YEARS = [("p1", None, 1995), ("p2", 1995, 1996), ("p3", 1996, 1998)]
_LINES = "SELECT CAST(extract(year FROM l_shipdate) AS BIGINT) AS y, l_orderkey FROM lineitem"


@query("range_route", f"SELECT CASE WHEN y < 1995 THEN 'p1' WHEN y < 1996 THEN 'p2' WHEN y < 1998 THEN 'p3' END AS part, count(*) AS n FROM ({_LINES}) l GROUP BY ALL")
def _(s, d):
    return routing.by_range(frame(s, d, _LINES), "y", _YEARS).groupBy("part").agg(F.count("*").alias("n"))


_LISTS = "SELECT 'done' AS part, 'F' AS st UNION ALL SELECT 'open', 'O'"


@query("list_route", f"SELECT part, count(*) AS n FROM ({X.SOURCE}) s LEFT JOIN ({_LISTS}) l ON l.st = s.st GROUP BY ALL")
def _(s, d):
    lists = frame(s, d, _LISTS).groupBy("part").agg(F.collect_list("st").alias("values"))
    return routing.by_list(frame(s, d, X.SOURCE), "st", lists).groupBy("part").agg(F.count("*").alias("n"))


@query("list_bounds", "SELECT o_orderstatus AS st, 'p_' || o_orderstatus AS part, count(*) AS n FROM orders GROUP BY ALL")
def _(s, d):
    orders = frame(s, d, X.SOURCE)
    bounds = orders.select("st").distinct().select(F.concat(F.lit("p_"), "st").alias("part"), F.array("st").alias("values"))
    return routing.by_list(orders, "st", bounds).groupBy("st", "part").agg(F.count("*").alias("n"))


@query("partition_bounds", "SELECT 'p' || y AS part, lag(y + 1) OVER (ORDER BY y) AS lo, y + 1 AS hi FROM (SELECT DISTINCT y FROM (" + _LINES + ") l) t")
def _(s, d):
    years = frame(s, d, _LINES).select("y").distinct()
    return routing.range_bounds(years.select(F.concat(F.lit("p"), "y").alias("part"), (F.col("y") + 1).alias("hi")))


_ADD = f"""SELECT commit_seq, commit_seq % 4 = 3 AS is_temp, 'ALTER TABLE t ADD ' || CASE commit_seq % 4 WHEN 0 THEN 'PARTITION p VALUES [(), ()) ("version_info" = "1")' WHEN 1 THEN 'PARTITION p VALUES IN ((("a", "b")))'
  WHEN 2 THEN 'PARTITION p VALUES LESS THAN ("5")' ELSE CASE WHEN commit_seq % 8 = 3 THEN 'TEMPORARY ' ELSE '' END || 'PARTITION p VALUES [("1"), ("2"))' END AS sql_text FROM ({X.LOG}) l"""


@query("add_partition_sql", f"""SELECT commit_seq, 'ALTER TABLE t ADD ' || CASE commit_seq % 4 WHEN 0 THEN 'PARTITION p ' WHEN 1 THEN 'PARTITION p VALUES IN (("a", "b"))' WHEN 2 THEN 'PARTITION p VALUES LESS THAN ("5")'
  ELSE 'TEMPORARY PARTITION p VALUES [("1"), ("2"))' END AS sql_text FROM ({X.LOG}) l""")
def _(s, d):
    return frame(s, d, _ADD).select("commit_seq", routing.add_partition_sql(F.col("sql_text"), F.col("is_temp")).alias("sql_text"))


_DIST = f"""SELECT commit_seq, commit_seq % 3 = 1 AS is_random, CAST(commit_seq % 50 + 1 AS BIGINT) AS n_buckets, 'ALTER TABLE t ADD PARTITION p VALUES LESS THAN ("buckets 5")' || CASE commit_seq % 5 WHEN 0 THEN ';'
  WHEN 1 THEN ' DISTRIBUTED BY HASH(`k`) BUCKETS AUTO;' WHEN 2 THEN ' distributed by random buckets 7 ; ' WHEN 3 THEN ' DISTRIBUTED BY HASH(k)' ELSE ' BUCKETS auto' END AS sql_text FROM ({X.LOG}) l"""


@query("distribution_sql", f"""SELECT commit_seq, 'ALTER TABLE t ADD PARTITION p VALUES LESS THAN ("buckets 5")' || CASE commit_seq % 5 WHEN 1 THEN ' DISTRIBUTED BY HASH(`k`) BUCKETS ' || n_buckets
  WHEN 2 THEN ' distributed by random buckets 7' WHEN 3 THEN ' DISTRIBUTED BY HASH(k) BUCKETS ' || n_buckets
  ELSE CASE WHEN is_random THEN ' DISTRIBUTED BY RANDOM' ELSE ' DISTRIBUTED BY HASH(k,v)' END || ' BUCKETS ' || n_buckets END AS sql_text FROM ({_DIST}) d""")
def _(s, d):
    columns = F.when(F.col("is_random"), F.array().cast("array<string>")).otherwise(F.array(F.lit("k"), F.lit("v")))
    return frame(s, d, _DIST).select("commit_seq", routing.distribution_sql(F.col("sql_text"), columns, F.col("n_buckets")).alias("sql_text"))


@query("rollup", "SELECT l_partkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS sum_quantity, max(CAST(l_quantity AS BIGINT)) AS max_quantity FROM lineitem GROUP BY ALL")
def _(s, d):
    base = frame(s, d, "SELECT l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem")
    table = folds.aggregated(base, ["l_partkey", "l_suppkey"], {"sum_quantity": ("SUM", "q"), "max_quantity": ("MAX", "q")})
    return folds.merged(table, ["l_partkey"], {"sum_quantity": "SUM", "max_quantity": "MAX"})


# --- schema evolution -----------------------------------------------------------------------------

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey FROM customer"


def customer(s, d):
    return frame(s, d, _CUSTOMER)


@query("add_column", "SELECT c_custkey, 'x' AS added, c_name, c_nationkey FROM customer")
def _(s, d):
    return evolution.add_columns(customer(s, d), {"added": ("string", "x")}, after="c_custkey")


@query("add_many_columns", "SELECT CAST(1 AS BIGINT) AS a, CAST(NULL AS VARCHAR) AS b, c_custkey, c_name, c_nationkey FROM customer")
def _(s, d):
    return evolution.add_columns(customer(s, d), {"a": ("bigint", 1), "b": ("string", None)}, first=True)


@query("add_agg_column", f"SELECT table_id, k, sum(v)::BIGINT AS sum_v, sum(CASE WHEN commit_seq > {MIDDLE} THEN seq ELSE 0 END)::BIGINT AS sum_new FROM ({X.ROWS}) r GROUP BY ALL")
def _(s, d):
    r, c = rows(s, d), middle(s, d)
    old = evolution.add_columns(r.where(F.col("commit_seq") <= c).select("table_id", "k", "v"), {"w": ("bigint", 0)})
    new = r.where(F.col("commit_seq") > c).select("table_id", "k", "v", F.col("seq").alias("w"))
    return folds.aggregated(old.unionByName(new), KEYS, {"sum_v": ("SUM", "v"), "sum_new": ("SUM", "w")})


@query("drop_column", "SELECT c_custkey, c_nationkey FROM customer")
def _(s, d):
    return customer(s, d).drop("c_name")


@query("modify_type", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, try_cast(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number FROM customer WHERE try_cast(regexp_extract(c_name, '[0-9]+') AS BIGINT) IS NOT NULL")
def _(s, d):
    named = customer(s, d).select("c_custkey", F.regexp_extract("c_name", "[0-9]+", 0).alias("number"))
    fits, _ = evolution.modify_type(named, "number", "bigint")
    return evolution.modify_type(fits, "c_custkey", "string")[0]


@query("reorder_columns", "SELECT c_nationkey, c_custkey, c_name FROM customer")
def _(s, d):
    return customer(s, d).select("c_nationkey", "c_custkey", "c_name")


@query("rename_column", "SELECT c_custkey, c_name AS full_name, c_nationkey FROM customer")
def _(s, d):
    return customer(s, d).withColumnRenamed("c_name", "full_name")


_COMMENTS = f"SELECT commit_seq, table_id, CASE WHEN commit_seq % 3 = 0 THEN NULL ELSE 'c' || commit_seq % 4 END AS column, 'it''s ' || k AS comment FROM ({X.LOG}) l WHERE type = 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS'"
_COMMENTS_DUCK = _COMMENTS.replace(" AS column,", ' AS "column",')


@query("latest_comments", f'SELECT table_id, "column", arg_max(comment, commit_seq) AS comment FROM ({_COMMENTS_DUCK}) c GROUP BY ALL')
def _(s, d):
    return evolution.latest_comments(frame(s, d, _COMMENTS))


_DDL = f"SELECT commit_seq, table_id, 'ALTER TABLE `src`.`t_' || table_id || '` ADD COLUMN c' || commit_seq || ' INT DEFAULT \"\"' AS sql_text FROM ({X.LOG}) l WHERE type = 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS'"


@query("rewrite_ddl", f"SELECT commit_seq, 'ALTER TABLE `alias_' || table_id || '` ADD COLUMN c' || commit_seq || ' INT DEFAULT NULL' AS sql_text FROM ({X.LOG}) l WHERE type = 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS'")
def _(s, d):
    name = lambda p: F.concat(F.lit(p), "table_id")
    return frame(s, d, _DDL).select("commit_seq", evolution.rewrite_ddl(F.col("sql_text"), "src", name("t_"), name("alias_")).alias("sql_text"))


@query("rewrite_views", f"SELECT rec, replace(sql_text, '`src`.', '`dst`.') AS sql_text FROM ({X.VIEWS}) v")
def _(s, d):
    return frame(s, d, X.VIEWS).select("rec", evolution.rewrite_view(F.col("sql_text"), "src", "dst").alias("sql_text"))


@query("schema_versions", f"SELECT commit_seq, k, CASE WHEN commit_seq <= {MIDDLE} THEN 7 ELSE seq END AS w FROM ({X.ROWS}) r")
def _(s, d):
    r, c = rows(s, d), middle(s, d)
    return evolution.read_with_defaults(r.where(F.col("commit_seq") <= c).select("commit_seq", "k"), r.where(F.col("commit_seq") > c).select("commit_seq", "k", F.col("seq").alias("w")), {"w": 7})


_COLUMNS = f"SELECT DISTINCT 't_' || table_id AS table_name, 'c' || part_day AS col, CASE WHEN part_day % 2 = 0 THEN 'int' ELSE 'string' END AS type, part_day AS place, part_day < 3 AS is_key, table_id + part_day AS h FROM ({X.LOG}) l"


@query("schema_diff", f"""SELECT table_name, col AS "column", CASE WHEN h % 7 = 0 THEN 'only in source' WHEN h % 11 = 0 AND type <> 'bigint' THEN 'type' WHEN h % 13 = 0 THEN 'key' ELSE 'place' END AS difference
FROM ({_COLUMNS}) c WHERE h % 7 = 0 OR h % 11 = 0 OR h % 13 = 0 OR h % 5 = 0""")
def _(s, d):
    c = frame(s, d, _COLUMNS).withColumnRenamed("col", "column")
    target = c.where("h % 7 <> 0").select("table_name", "column", F.expr("IF(h % 11 = 0, 'bigint', type)").alias("type"), F.expr("IF(h % 5 = 0, place + 1, place)").alias("place"), F.expr("IF(h % 13 = 0, NOT is_key, is_key)").alias("is_key"))
    return evolution.schema_diff(c.drop("h"), target)


_TARGETS = f"SELECT DISTINCT 't_' || table_id AS name, CASE WHEN table_id % 4 = 0 THEN 'VIEW' ELSE 'TABLE' END AS kind, table_id FROM ({X.LOG}) l"


@query("restore_clean_tables", f"SELECT name FROM ({_TARGETS}) t WHERE kind = 'TABLE' AND table_id % 3 = 0")
def _(s, d):
    t = frame(s, d, _TARGETS)
    return snapshots.tables_to_clean(t, t.where("table_id % 3 <> 0"))


@query("existing_target", f"""SELECT table_id, CASE WHEN table_id % 2 = 1 THEN 'CREATE' WHEN table_id % 3 = 0 THEN 'REFUSE' WHEN h > 0 THEN 'REBUILD_AND_SWAP' ELSE 'OVERWRITE' END AS decision
FROM (SELECT table_id, count(CASE WHEN (table_id + part_day) % 11 = 0 AND table_id % 4 = 0 THEN 1 END) AS h FROM ({X.PARTS}) p GROUP BY ALL) t""")
def _(s, d):
    """A target that exists is refused unless allowed; with an equal schema it is overwritten.  Here
    tables of even number have a target, and those of multiples of 4 may have columns of another type."""
    source = frame(s, d, X.PARTS).select(F.col("table_id").alias("table_name"), F.expr("'c' || part_day").alias("column"), F.lit("int").alias("type"), F.col("part_day").alias("place"), F.lit(False).alias("is_key")).distinct()
    changed = F.expr("IF((table_name + place) % 11 = 0 AND table_name % 4 = 0, 'bigint', type)")
    target = source.where("table_name % 2 = 0").withColumn("type", changed)
    allowed = source.where("table_name % 3 <> 0").select("table_name")
    return evolution.existing_target(source, target, allowed).withColumnRenamed("table_name", "table_id")


# --- verification -----------------------------------------------------------------------------------

_A, _B = f"({X.SOURCE}) a", f"({X.REPLICA}) b"


def both(s, d):
    return frame(s, d, X.SOURCE), frame(s, d, X.REPLICA)


@query("compare_counts", f"""SELECT coalesce(a.p, b.p) AS p, coalesce(a.n, 0) AS src_n, coalesce(b.n, 0) AS dst_n FROM (SELECT p, count(*) AS n FROM {_A} GROUP BY p) a
FULL JOIN (SELECT p, count(*) AS n FROM {_B} GROUP BY p) b ON a.p = b.p WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(s, d):
    return verify.compare_counts(*both(s, d), "p")


@query("diff_rows", f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'MISSING' WHEN a.k IS NULL THEN 'EXTRA' ELSE 'CHANGED' END AS difference
FROM {_A} FULL JOIN {_B} ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR (a.st, a.p, a.cents) IS DISTINCT FROM (b.st, b.p, b.cents)""")
def _(s, d):
    return verify.diff_rows(*both(s, d), "k")


@query("diff_multiset", f"""SELECT st, p, cents, sum(n)::BIGINT AS surplus FROM (SELECT st, p, cents, 1 AS n FROM {_A} UNION ALL SELECT st, p, cents, -1 FROM {_B}) t GROUP BY ALL HAVING sum(n) <> 0""")
def _(s, d):
    a, b = both(s, d)
    return verify.diff_multiset(a.drop("k"), b.drop("k"))


@query("checksum_partitions", f"SELECT p, count(*) AS n, sum(CAST('0x' || substr(md5(length(cents::VARCHAR) || ':' || cents || '|' || length(k::VARCHAR) || ':' || k || '|' || length(p::VARCHAR) || ':' || p || '|' || length(st) || ':' || st), 1, 8) AS BIGINT))::BIGINT AS checksum FROM {_A} GROUP BY p")
def _(s, d):
    return verify.checksum(frame(s, d, X.SOURCE), "p")


@query("checksum_differences", f"""SELECT coalesce(a.p, b.p) AS p FROM (SELECT p, count(*) AS n, list(x ORDER BY x) AS l FROM (SELECT p, k || ',' || st || ',' || cents AS x FROM {_A}) t GROUP BY p) a
FULL JOIN (SELECT p, count(*) AS n, list(x ORDER BY x) AS l FROM (SELECT p, k || ',' || st || ',' || cents AS x FROM {_B}) t GROUP BY p) b ON a.p = b.p WHERE a.l IS DISTINCT FROM b.l""")
def _(s, d):
    return verify.differing(*both(s, d), "p")


@query("diff_narrowed", SQL["diff_rows"])
def _(s, d):
    return verify.narrowed_diff(*both(s, d), "p", "k")


@query("missing_partitions", f"SELECT table_id, part_range, 'TARGET' AS missing_in FROM ({X.PARTS}) p WHERE (table_id + part_day) % 29 = 0")
def _(s, d):
    parts = frame(s, d, X.PARTS)
    return verify.missing_partitions(parts, parts.where("(table_id + part_day) % 29 <> 0"), "table_id", "part_range")
