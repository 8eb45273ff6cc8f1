"""Queries that write, swap and stream: each works in a new shared folder and returns what it reads back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import payloads as P
from ..operators import filters
from ..operators.evolution import as_table
from ..operators.folds import latest
from ..sources import buckets as B
from ..sources import log as L
from ..sources import snapshots as S
from ..sources.folders import new_folder
from ..sources.view_texts import TargetViews
from ..sources.views import View, apply_with_views
from ..streaming import follow
from ..streaming.replay import Replica
from ..streaming.shadows import index_turns, stream_without_shadows
from ..streaming.syncs import SyncingReplica
from . import fixtures as X
from .fixtures import frame
from .log_queries import MIDDLE, log, middle
from .log_queries import SQL as LOG_SQL
from .table_queries import KEYS, rows, unique_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SUM = "SELECT st, count(*) AS n, sum(cents)::BIGINT AS cents FROM ({0}) s GROUP BY st"


def summary(df):
    return df.groupBy("st").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def database(folder: str) -> str:
    """A name in the catalogue as new as the folder."""
    return folder.rpartition("/")[2].replace("-", "_")


@query("snapshot_full", _SUM.format(X.SOURCE))
def _(s, d):
    folder = new_folder(s, "snapshot")
    S.snapshot(frame(s, d, X.SOURCE), folder)
    return summary(s.read.parquet(folder))


@query("snapshot_partial", f"SELECT p, count(*) AS n FROM ({X.SOURCE}) s WHERE p IN (1996, 1998) GROUP BY p")
def _(s, d):
    folder = new_folder(s, "snapshot")
    S.snapshot(frame(s, d, X.SOURCE), folder, where=F.col("p").isin(1996, 1998))
    return s.read.parquet(folder).groupBy("p").agg(F.count("*").alias("n"))


@query("restore_full", _SUM.format(X.SOURCE))
def _(s, d):
    folder = new_folder(s, "restore")
    S.snapshot(frame(s, d, X.REPLICA), f"{folder}/target")
    S.snapshot(frame(s, d, X.SOURCE), f"{folder}/snapshot")
    S.restore(s, f"{folder}/snapshot", f"{folder}/target")
    return summary(s.read.parquet(f"{folder}/target"))


@query("restore_alias", "SELECT 'alias_orders' AS name, st, count(*) AS n FROM (" + X.SOURCE + ") s GROUP BY st")
def _(s, d):
    folder = new_folder(s, "alias")
    S.snapshot(frame(s, d, X.SOURCE), f"{folder}/orders")
    S.restore(s, f"{folder}/orders", f"{folder}/alias_orders")
    return s.read.parquet(f"{folder}/alias_orders").groupBy("st").agg(F.count("*").alias("n")).withColumn("name", F.lit("alias_orders"))


@query("restore_atomic", f"SELECT 'before' AS seen, count(*) AS n FROM ({X.REPLICA}) r UNION ALL SELECT 'staged', count(*) FROM ({X.REPLICA}) r UNION ALL SELECT 'after', count(*) FROM ({X.SOURCE}) s")
def _(s, d):
    """The name stands for the old rows until the staged folder is complete and put in its place."""
    folder = new_folder(s, "atomic")
    names, out = S.Names(s, database(folder)), None
    for seen, rows in (("before", X.REPLICA), ("staged", X.SOURCE), ("after", None)):
        if rows:
            S.snapshot(frame(s, d, rows), f"{folder}/{seen}")
        if seen != "staged":
            names.point({"orders": f"{folder}/{'before' if rows else 'staged'}"})
        one = names.read("orders").agg(F.lit(seen).alias("seen"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("restore_clean_partitions", f"SELECT 'clean' AS mode, p, count(*) AS n FROM ({X.SOURCE}) s WHERE p <> 1997 GROUP BY p UNION ALL SELECT 'keep', p, count(*) FROM ({X.SOURCE}) s GROUP BY p")
def _(s, d):
    folder, source = new_folder(s, "clean"), frame(s, d, X.SOURCE)
    S.snapshot(source.where("p <> 1997"), f"{folder}/snapshot", ("p",))
    out = []
    for mode, clean in (("clean", True), ("keep", False)):
        S.snapshot(source, f"{folder}/{mode}", ("p",))
        S.restore(s, f"{folder}/snapshot", f"{folder}/{mode}", ("p",), clean)
        out.append(s.read.parquet(f"{folder}/{mode}").groupBy(F.col("p").cast("bigint").alias("p")).agg(F.count("*").alias("n")).withColumn("mode", F.lit(mode)))
    return out[0].unionByName(out[1])


@query("replace_table", f"""SELECT 'swap' AS mode, 'to' AS name, count(*) AS n FROM ({X.SOURCE}) s UNION ALL SELECT 'swap', 'from', count(*) FROM ({X.REPLICA}) r
UNION ALL SELECT 'drop', 'to', count(*) FROM ({X.SOURCE}) s""")
def _(s, d):
    folder, out = new_folder(s, "replace"), None
    for mode in ("swap", "drop"):
        names = S.Names(s, f"{database(folder)}_{mode}")
        for name, rows in (("to", X.REPLICA), ("from", X.SOURCE)):
            S.snapshot(frame(s, d, rows), f"{folder}/{mode}/{name}")
            names.point({name: f"{folder}/{mode}/{name}"})
        names.replace("to", "from", swap=mode == "swap")
        if mode == "drop":
            names.replace("to", "from")  # again: nothing happens
        for name in sorted(names.now()):
            one = names.read(name).agg(F.lit(mode).alias("mode"), F.lit(name).alias("name"), F.count("*").alias("n"))
            out = one if out is None else out.unionByName(one)
    return out


def bucketed_pair(s, d):
    """Source and target, laid out alike after the target has taken the source's number of buckets."""
    folder, of = new_folder(s, "buckets"), B.Layout(("k",), 12)
    names = S.Names(s, database(folder))
    table = lambda name: f"{names.database}.{name}"
    B.write_bucketed(frame(s, d, X.SOURCE), table("source_12"), f"{folder}/source", of)
    B.write_bucketed(frame(s, d, X.REPLICA), table("target_4"), f"{folder}/target_4", B.Layout(("k",), 4))
    names.point({"source": table("source_12"), "target": table("target_4")})
    B.follow_layout(s, names, "target", table("target_12"), f"{folder}/target_12", B.layout_of(s, table("target_4")).like(of))
    return names.read("source"), names.read("target")


@query("bucketed_join", f"SELECT s.st, count(*) AS n, count(CASE WHEN s.cents <> r.cents THEN 1 END) AS n_differ FROM ({X.SOURCE}) s JOIN ({X.REPLICA}) r ON s.k = r.k GROUP BY s.st")
def _(s, d):
    """Two tables of one layout: the join moves no row of either."""
    source, target = bucketed_pair(s, d)
    both = source.join(target.select("k", F.col("cents").alias("of_target")), "k")
    return both.groupBy("st").agg(F.count("*").alias("n"), F.count(F.when(F.col("cents") != F.col("of_target"), 1)).alias("n_differ"))


@query("views_recreated", f"""SELECT 'v_year' AS view, p, count(*) AS n, sum(cents * 2)::BIGINT AS total FROM ({X.SOURCE}) s GROUP BY p
UNION ALL SELECT 'v_late', p, count(*), sum(cents * 2)::BIGINT FROM ({X.SOURCE}) s WHERE p >= 1996 GROUP BY p""")
def _(s, d):
    """A table gets a column by a swap; a view of it and a view of that view are created anew around the swap."""
    folder = new_folder(s, "views")
    names, views = S.Names(s, database(folder)), TargetViews(s, database(folder), "src")
    S.snapshot(frame(s, d, X.REPLICA), f"{folder}/old")
    S.snapshot(frame(s, d, X.SOURCE).withColumn("twice", F.col("cents") * 2), f"{folder}/new")
    names.point({"orders": f"{folder}/old", "staged": f"{folder}/new"})
    views.create("v_year", "CREATE VIEW `v_year` AS SELECT * FROM `internal`.`src`.`orders`")
    views.create("v_late", "CREATE VIEW `v_late` COMMENT 'late' AS SELECT * FROM `internal`.`src`.`v_year` WHERE p >= 1996;")
    views.around(["orders"], lambda: names.replace("orders", "staged"))
    of = lambda view: s.table(f"{names.database}.{view}").groupBy("p").agg(F.count("*").alias("n"), F.sum("twice").alias("total")).withColumn("view", F.lit(view))
    return of("v_year").unionByName(of("v_late"))


def _overwritten(s, d):
    folder = new_folder(s, "overwrite")
    S.snapshot(frame(s, d, X.REPLICA), folder, ("p",))
    S.overwrite_partitions(frame(s, d, X.SOURCE).where("p = 1998"), folder, "p")
    return s.read.parquet(folder).select("k", "st", F.col("p").cast("bigint").alias("p"), "cents")


_OVER = f"SELECT k, st, p, cents FROM ({X.REPLICA}) r WHERE p <> 1998 UNION ALL SELECT k, st, p, cents FROM ({X.SOURCE}) s WHERE p = 1998"


@query("replace_partition", _OVER)
def _(s, d):
    return _overwritten(s, d)


@query("insert_overwrite", f"SELECT p, count(*) AS n, sum(cents)::BIGINT AS cents FROM ({_OVER}) o GROUP BY p")
def _(s, d):
    return _overwritten(s, d).groupBy("p").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def _refreshed(s, d, define):
    """A view of the replica whose partition 1998 is refreshed after the base has changed there."""
    folder = new_folder(s, "view")
    S.snapshot(frame(s, d, X.REPLICA), f"{folder}/base", ("p",))
    S.refresh_view(s.read.parquet(f"{folder}/base"), define, f"{folder}/view", "p")
    S.overwrite_partitions(frame(s, d, X.SOURCE).where("p = 1998"), f"{folder}/base", "p")
    S.refresh_view(s.read.parquet(f"{folder}/base"), define, f"{folder}/view", "p", touched=[1998])
    return s.read.parquet(f"{folder}/view").withColumn("p", F.col("p").cast("bigint"))


@query("materialized_view", f"SELECT k, p, cents FROM ({_OVER}) o WHERE st <> 'P'")
def _(s, d):
    return _refreshed(s, d, lambda base: base.where("st <> 'P'").select("k", "p", "cents"))


@query("agg_view", f"SELECT p, st, count(*) AS n, sum(cents)::BIGINT AS cents FROM ({_OVER}) o GROUP BY p, st")
def _(s, d):
    return _refreshed(s, d, lambda base: base.groupBy("p", "st").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")))


def _viewed(s, d, *definition):
    """A view kept through the four quarters of the log, the second one delivered twice."""
    folder, r, c = new_folder(s, "views"), rows(s, d).select("commit_seq", "table_id", "part_day", "k", "v", "v_nullable", "op"), middle(s, d)
    base = _table(s, folder)
    view = View(base, f"{folder}/view", *definition)
    for number, (low, high) in ((0, (-1, c // 2)), (1, (c // 2, c)), (1, (c // 2, c)), (2, (c, 3 * c // 2)), (3, (3 * c // 2, 4 * c))):
        apply_with_views(base, [view], number, r.where((F.col("commit_seq") > low) & (F.col("commit_seq") <= high)))
    return view.read()


_LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, k ORDER BY commit_seq DESC) AS place FROM ({X.ROWS}) r) t WHERE place = 1 AND op <> 'D'"


@query("delta_agg_view", f"SELECT part_day, count(*) AS n_rows, sum(v_nullable)::BIGINT AS total, count(v_nullable) AS n, min(v) AS low, max(v) AS high FROM ({_LAST}) l GROUP BY part_day")
def _(s, d):
    """Keys move from day to day, so days lose their least and greatest values, and some all rows."""
    return _viewed(s, d, {"part_day": F.col("part_day")}, {"total": ("SUM", "v_nullable"), "n": ("COUNT", "v_nullable"), "low": ("MIN", "v"), "high": ("MAX", "v")})


@query("delta_rollup", f"SELECT table_id, v_nullable IS NULL AS unknown, count(*) AS n_rows, sum(v)::BIGINT AS total, max(commit_seq) AS last_seq FROM ({_LAST}) l GROUP BY ALL")
def _(s, d):
    return _viewed(s, d, {"table_id": F.col("table_id"), "unknown": F.col("v_nullable").isNull()}, {"total": ("SUM", "v"), "last_seq": ("MAX", "commit_seq")})


@query("delta_plain_view", f"SELECT k % 50 AS k50, v_nullable % 10 AS v10, count(*) AS n_rows FROM ({_LAST}) l WHERE part_day > 10 GROUP BY ALL")
def _(s, d):
    """Rows that the view can't tell apart are counted, so one of them may go."""
    return _viewed(s, d, {"k50": F.col("k") % 50, "v10": F.col("v_nullable") % 10}, {}, F.col("part_day") > 10)


# --- following the log --------------------------------------------------------------------------------


def _rows(s, d):
    return rows(s, d).select("commit_seq", "table_id", "part_day", "k", "v", "op")


def _table(s, folder):
    return S.ChangeTable(s, f"{folder}/table", KEYS)


def _state(table):
    return table.read().select("table_id", "k", "commit_seq", "v")


def _files(df, folder, n=3):
    """The log as files in commit order."""
    df.repartitionByRange(n, "commit_seq").sortWithinPartitions("commit_seq").write.parquet(f"{folder}/log")
    return f"{folder}/log"


FOLD = unique_sql()


@query("ingest_batch", FOLD)
def _(s, d):
    folder, r, c = new_folder(s, "ingest"), _rows(s, d), middle(s, d)
    table = _table(s, folder)
    table.apply(0, r.where(F.col("commit_seq") <= c))
    table.apply(1, r)
    return _state(table)


@query("apply_idempotent", FOLD)
def _(s, d):
    folder, r, c = new_folder(s, "idempotent"), _rows(s, d), middle(s, d)
    table = _table(s, folder)
    for batch, part in ((0, r.where(F.col("commit_seq") <= c)), (0, r.where(F.col("commit_seq") <= c)), (1, r), (1, r), (2, r)):
        table.apply(batch, part)
        table.compact()
    return _state(table)


@query("rollback_batch", unique_sql(where=f"commit_seq <= {MIDDLE}"))
def _(s, d):
    """The later half is applied and taken back."""
    folder, r, c = new_folder(s, "rollback"), _rows(s, d), middle(s, d)
    table = _table(s, folder)
    table.apply(0, r.where(F.col("commit_seq") <= c))
    table.apply(1, r.where(F.col("commit_seq") > c))
    table.rollback(0)
    return _state(table)


@query("flow_out_of_order", f"SELECT table_id, commit_seq AS k, commit_seq, v FROM ({X.ROWS}) r WHERE op <> 'D'")
def _(s, d):
    """Each row has a key of its own, and the files come in the reverse of the log's order."""
    folder, r = new_folder(s, "reverse"), _rows(s, d).withColumn("k", F.col("commit_seq"))
    path, table, c = f"{folder}/log", _table(s, folder), middle(s, d)
    for low, high in ((3 * c // 2, 4 * c), (c, 3 * c // 2), (c // 2, c), (-1, c // 2)):
        r.where((F.col("commit_seq") > low) & (F.col("commit_seq") <= high)).write.mode("append").parquet(path)
    follow.replicate(follow.stream(s, path), table, f"{folder}/checkpoint", compact_every=3)
    return _state(table)


@query("log_stream_counts", f"SELECT type, count(*) AS n FROM ({X.LOG}) l GROUP BY type")
def _(s, d):
    folder = new_folder(s, "counts")
    path = _files(log(s, d).select("commit_seq", "type"), folder)

    def handle(batch, number):
        batch.groupBy("type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    follow.drain(follow.stream(s, path), f"{folder}/checkpoint", handle)
    return s.read.parquet(f"{folder}/out").groupBy("type").agg(F.sum("n").alias("n"))


@query("flow_incremental", FOLD)
def _(s, d):
    folder = new_folder(s, "incremental")
    path, table = _files(_rows(s, d), folder), _table(s, folder)
    follow.replicate(follow.stream(s, path), table, f"{folder}/checkpoint")
    return _state(table)


@query("resume", FOLD)
def _(s, d):
    """Half of the log, a stop, then the rest from the checkpoint."""
    folder, r, c = new_folder(s, "resume"), _rows(s, d), middle(s, d)
    path, table = f"{folder}/log", _table(s, folder)
    for part in (F.col("commit_seq") <= c, F.col("commit_seq") > c):
        r.where(part).write.mode("append").parquet(path)
        follow.replicate(follow.stream(s, path), table, f"{folder}/checkpoint")
    return _state(table)


@query("flow_full_sync", FOLD)
def _(s, d):
    """Snapshot of the folded table at the middle, restored, then the log after its cursor."""
    folder, r, c = new_folder(s, "full"), _rows(s, d), middle(s, d)
    S.snapshot(latest(r.where(F.col("commit_seq") <= c), KEYS, ["commit_seq"], F.expr("op = 'D'")), f"{folder}/snapshot")
    table = _table(s, folder)
    table.apply(-1, s.read.parquet(f"{folder}/snapshot"))
    follow.replicate(follow.stream(s, _files(L.since(r, c), folder)), table, f"{folder}/checkpoint")
    return _state(table)


@query("flow_db_catchup", FOLD)
def _(s, d):
    """Tables restored at cursors of their own; the log from the least cursor on, per table filtered."""
    folder, r, cursors = new_folder(s, "catchup"), _rows(s, d), frame(s, d, X.CURSORS)
    known = r.join(cursors, "table_id").where("commit_seq <= cursor_seq").drop("cursor_seq")
    S.snapshot(latest(known, KEYS, ["commit_seq"], F.expr("op = 'D'")), f"{folder}/snapshot")
    table = _table(s, folder)
    table.apply(-1, s.read.parquet(f"{folder}/snapshot"))
    start = cursors.agg(F.min("cursor_seq")).first()[0] or -1
    follow.replicate(follow.stream(s, _files(L.since(r, start), folder)), table, f"{folder}/checkpoint", lambda batch: filters.not_committed(batch, cursors))
    return _state(table)


@query("flow_partial_sync", FOLD)
def _(s, d):
    """Table 103 is lost midway, copied anew at its cursor under an alias, swapped in, and goes on."""
    folder, r, c = new_folder(s, "partial"), _rows(s, d), middle(s, d)
    names, of = S.Names(s, database(folder)), F.col("table_id") == 103
    tables = {"others": _table(s, f"{folder}/others"), "t_103": _table(s, f"{folder}/old"), "alias": _table(s, f"{folder}/alias")}
    tables["others"].apply(-1, r.where((F.col("commit_seq") <= c) & ~of))
    tables["t_103"].apply(-1, r.where((F.col("commit_seq") <= c // 2) & of))
    tables["alias"].apply(-1, latest(r.where(of & (F.col("commit_seq") <= c + 100)), KEYS, ["commit_seq"], F.expr("op = 'D'")))
    names.point({n: f"{t.folder}/batch--1" for n, t in tables.items()})
    names.replace("t_103", "alias")
    now = {n: S.ChangeTable(s, path.rpartition("/")[0], KEYS) for n, path in names.now().items()}
    # The others go on from the middle, the new copy after its own cursor: what it has is not applied again.
    rest = _files(r.where(F.col("commit_seq") > c), folder)
    follow.replicate(follow.stream(s, rest), now["others"], f"{folder}/checkpoint", lambda b: b.where(~of))
    follow.replicate(follow.stream(s, rest), now["t_103"], f"{folder}/checkpoint103", lambda b: b.where(of & (F.col("commit_seq") > c + 100)))
    return _state(now["others"]).unionByName(_state(now["t_103"]))


@query("skip_errors", f"SELECT 'quarantine' AS place, count(*) AS n FROM ({X.ROWS}) r WHERE v % 5 = 0 UNION ALL SELECT 'table', count(*) FROM ({unique_sql(where='v % 5 <> 0')}) u")
def _(s, d):
    folder = new_folder(s, "skip")
    path, table = _files(_rows(s, d), folder), _table(s, folder)

    def handle(batch, number):
        good, bad = follow.split_bad(batch, "v % 5 <> 0")
        bad.write.mode("overwrite").parquet(f"{folder}/quarantine/batch={number}")
        table.apply(number, good)

    follow.drain(follow.stream(s, path), f"{folder}/checkpoint", handle)
    count = lambda df, name: df.agg(F.lit(name).alias("place"), F.count("*").alias("n"))
    return count(s.read.parquet(f"{folder}/quarantine"), "quarantine").unionByName(count(table.read(), "table"))


@query("stream_latest", f"SELECT table_id, k, max(commit_seq) AS commit_seq, arg_max(v, commit_seq) AS v FROM ({X.ROWS}) r GROUP BY ALL")
def _(s, d):
    folder = new_folder(s, "latest")
    path = _files(_rows(s, d), folder)
    state = follow.running_latest(follow.stream(s, path), KEYS, ["v"])
    follow.drain(state, f"{folder}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), mode="update")
    return s.read.parquet(f"{folder}/out").groupBy(*KEYS).agg(F.max_by(F.struct("commit_seq", "v"), "commit_seq").alias("r")).select(*KEYS, "r.*")


@query("stream_dedup", f"SELECT commit_seq, type, table_id FROM ({X.LOG}) l")
def _(s, d):
    """Each half of the log is delivered twice, the second time in the next batch; then the stream starts again."""
    folder, part, c = new_folder(s, "dedup"), log(s, d).select("commit_seq", "ts", "type", "table_id"), middle(s, d)
    cursors = S.ChangeTable(s, f"{folder}/cursors", ["table_id"], deleted="false")

    def handle(batch, number):
        follow.without_committed(batch, cursors, number).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for half in (F.col("commit_seq") <= c, F.col("commit_seq") > c):
        for _ in range(2):
            part.where(half).repartitionByRange(2, "commit_seq").write.mode("append").parquet(f"{folder}/log")
            follow.drain(follow.stream(s, f"{folder}/log", 2), f"{folder}/checkpoint", handle)
    return s.read.parquet(f"{folder}/out").select("commit_seq", "type", "table_id")


@query("stream_counters", f"SELECT table_id, CASE WHEN v % 5 = 0 THEN 'refused' ELSE 'handled' END AS category, count(*) AS n, min(commit_seq) AS first_seq, max(commit_seq) AS last_seq FROM ({X.ROWS}) r GROUP BY ALL")
def _(s, d):
    """Counters of a stream that skips bad rows: a failure in the second batch, then a restart."""
    folder = new_folder(s, "counters")
    path, table = _files(_rows(s, d).withColumn("category", F.expr("CASE WHEN v % 5 = 0 THEN 'refused' ELSE 'handled' END")), folder), _table(s, folder)
    kept = S.ChangeTable(s, f"{folder}/counters", ["batch", "table_id", "category"], order="last_seq", deleted="false")

    def failing(batch, number):
        table.apply(number, batch.where("category = 'handled'"))
        if number == 1:
            raise RuntimeError("the second batch fails")

    def whole(batch, number):
        table.apply(number, batch.where("category = 'handled'"))

    try:
        follow.drain(follow.stream(s, path), f"{folder}/checkpoint", follow.counted(failing, kept, "table_id", "category"))
    except StreamingQueryException:
        follow.drain(follow.stream(s, path), f"{folder}/checkpoint", follow.counted(whole, kept, "table_id", "category"))
    return follow.counter_totals(kept, "table_id", "category")


# As many files as an option can name.
_ALL_FILES = 2**31 - 1


@query("stream_shadow_indexes", LOG_SQL["filter_shadow_indexes"])
def _(s, d):
    """Uses and alter jobs as one stream in three parts of the log, the second delivered twice; each part after a restart."""
    folder, c = new_folder(s, "shadows"), middle(s, d)
    uses = P.upsert_indexes(frame(s, d, X.PAYLOAD)).select("index_id", "commit_seq", F.lit(None).cast("string").alias("turn"))
    records = uses.unionByName(index_turns(frame(s, d, X.ALTER)))
    for low, high in ((-1, c // 2), (c // 2, c), (c // 2, c), (c, 4 * c)):
        records.where((F.col("commit_seq") > low) & (F.col("commit_seq") <= high)).write.mode("append").parquet(f"{folder}/log")
        kept = stream_without_shadows(follow.stream(s, f"{folder}/log", _ALL_FILES))  # a part's files are one batch: they have no order
        follow.drain(kept, f"{folder}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    return s.read.parquet(f"{folder}/out").select("commit_seq", "index_id")


# --- the mixed log ------------------------------------------------------------------------------------

_RECORDS = f"""SELECT commit_seq, CASE WHEN type <> 'BARRIER' THEN type WHEN commit_seq % 2 = 0 THEN 'RENAME_COLUMN' ELSE 'MODIFY_COMMENT' END AS type, table_id, 'p' || part_day AS part, k, v,
  CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, CASE type
  WHEN 'BARRIER' THEN CASE WHEN commit_seq % 2 = 0 THEN '{{"tableId":' || table_id || ',"colName":"c' || k % 4 || '","newColName":"d' || k % 4 || '"}}' ELSE '{{"tblId":' || table_id || ',"type":"COLUMN","colToComment":{{"c' || k % 4 || '":"n' || commit_seq || '"}}}}' END
  WHEN 'TRUNCATE_TABLE' THEN '{{"tblId":' || table_id || ',"isEntireTable":' || CASE WHEN commit_seq % 2 = 0 THEN 'true' ELSE 'false' END || ',"rawSql":"PARTITIONS (p1, p' || part_day || ')"}}'
  WHEN 'DROP_PARTITION' THEN CASE WHEN commit_seq % 10 = 0 THEN '{{"tableId":5}}' ELSE '{{"tableId":' || table_id || ',"sql":"ALTER TABLE t DROP PARTITION ' || CASE WHEN commit_seq % 3 = 0 THEN 'IF EXISTS ' ELSE '' END || 'p' || part_day || '"}}' END
  WHEN 'DROP_TABLE' THEN '{{"tableId":' || table_id || '}}' WHEN 'RENAME_TABLE' THEN '{{"tb":' || table_id || CASE WHEN commit_seq % 3 = 0 THEN ',"nR":"r' ELSE ',"nT":"t' END || commit_seq || CASE WHEN commit_seq % 3 = 0 THEN '","oR":"r"}}' ELSE '","oT":"t"}}' END
  WHEN 'ADD_PARTITION' THEN '{{"tableId":' || table_id || ',"sql":"ADD PARTITION p' || part_day || ' VALUES LESS THAN (5)"}}' WHEN 'CREATE_TABLE' THEN '{{"tableId":' || table_id || ',"sql":"CREATE TABLE t"}}'
  WHEN 'ALTER_JOB' THEN '{{"tableId":' || table_id || ',"tableName":"' || CASE WHEN commit_seq % 7 = 0 THEN '' ELSE 't' END || '","type":"' || CASE WHEN commit_seq % 4 = 0 THEN 'ROLLUP' ELSE 'SCHEMA_CHANGE' END || '","jobState":"' || CASE WHEN commit_seq % 3 = 0 THEN 'PENDING' ELSE 'FINISHED' END || '"}}'
  WHEN 'REPLACE_PARTITIONS' THEN '{{"tblId":' || table_id || ',"tblName":"t","partitions":["p1"],"tempPartitions":' || CASE WHEN commit_seq % 5 = 0 THEN '[]' ELSE '["t1"]' END || ',"strictRange":' || CASE WHEN commit_seq % 2 = 0 THEN 'true' ELSE 'false' END || ',"useTempName":false}}'
  WHEN 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS' THEN '{{"tableId":' || table_id || ',"rawSql":"ALTER TABLE t ' || CASE commit_seq % 3 WHEN 0 THEN 'DROP COLUMN c' || k % 4
    WHEN 1 THEN 'ADD COLUMN `c' || k % 4 || '` INT DEFAULT ' || commit_seq || ', DROP COLUMN `e`' ELSE 'ADD COLUMN (`c' || k % 4 || '` INT KEY DEFAULT ' || commit_seq || ', `e` VARCHAR(9) DEFAULT 1)' END || '"}}' END AS data
FROM ({X.LOG}) l"""


def _replayed(s, d):
    return _replay(s, frame(s, d, _RECORDS), middle(s, d))


# Bytes of log files in one batch of a replay: the cost of a batch's tables is small beside its records.
_BATCH = 2**30


def _replay(s, records, c, make=Replica):
    """The log in four parts, the later ones first, followed in batches by size."""
    folder = new_folder(s, "replay")
    for low, high in ((3 * c // 2, 4 * c), (c, 3 * c // 2), (c // 2, c), (-1, c // 2)):
        records.where((F.col("commit_seq") > low) & (F.col("commit_seq") <= high)).write.mode("append").parquet(f"{folder}/log")
    replica = make(s, f"{folder}/replica")
    follow.drain(follow.stream(s, f"{folder}/log", bytes_per_batch=_BATCH), f"{folder}/checkpoint", lambda batch, number: replica.apply(number, batch))
    return replica


@query("replay_rows", f"""WITH l AS ({X.LOG}), cuts AS (
  SELECT table_id, '' AS part, commit_seq FROM l WHERE type = 'DROP_TABLE' OR (type = 'TRUNCATE_TABLE' AND commit_seq % 2 = 0)
  UNION ALL SELECT table_id, 'p' || part_day, commit_seq FROM l WHERE (type = 'DROP_PARTITION' AND commit_seq % 10 <> 0) OR (type = 'TRUNCATE_TABLE' AND commit_seq % 2 = 1)
  UNION ALL SELECT table_id, 'p1', commit_seq FROM l WHERE type = 'TRUNCATE_TABLE' AND commit_seq % 2 = 1
), r AS (SELECT table_id, 'p' || part_day AS part, k, commit_seq, v, event_type, row_number() OVER (PARTITION BY table_id, part_day, k ORDER BY commit_seq DESC) AS place FROM l WHERE type = 'UPSERT')
SELECT table_id, part, k, commit_seq, v, (SELECT 't' || max(commit_seq) FROM l WHERE type = 'RENAME_TABLE' AND commit_seq % 3 <> 0 AND l.table_id = r.table_id) AS name
FROM r WHERE place = 1 AND event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.table_id = r.table_id AND c.part IN ('', r.part) AND c.commit_seq >= r.commit_seq)""")
def _(s, d):
    return _replayed(s, d).read()


@query("replay_columns", f"""WITH l AS ({X.LOG}), e AS (
  SELECT table_id, 'c' || k % 4 AS col, commit_seq, commit_seq % 3 = 0 AS dropped, CAST(commit_seq AS VARCHAR) AS def FROM l WHERE type = 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS'
  UNION ALL SELECT table_id, 'e', commit_seq, commit_seq % 3 = 1, '1' FROM l WHERE type = 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS' AND commit_seq % 3 > 0
  UNION ALL SELECT table_id, 'c' || k % 4, commit_seq, true, NULL FROM l WHERE type = 'BARRIER' AND commit_seq % 2 = 0 UNION ALL SELECT table_id, 'd' || k % 4, commit_seq, false, NULL FROM l WHERE type = 'BARRIER' AND commit_seq % 2 = 0)
SELECT table_id, col AS "column", def AS "default" FROM (SELECT *, row_number() OVER (PARTITION BY table_id, col ORDER BY commit_seq DESC) AS place FROM e) t WHERE place = 1 AND NOT dropped""")
def _(s, d):
    return _replayed(s, d).columns.read().select("table_id", "column", "default")


@query("replay_comments", f"SELECT table_id, 'c' || k % 4 AS \"column\", 'n' || max(commit_seq) AS comment FROM ({X.LOG}) l WHERE type = 'BARRIER' AND commit_seq % 2 = 1 GROUP BY ALL")
def _(s, d):
    return _replayed(s, d).comments.read().select("table_id", "column", "comment")


@query("replay_syncs", f"""SELECT table_id, action, max(commit_seq) AS commit_seq FROM (SELECT table_id, commit_seq, CASE WHEN (type = 'ALTER_JOB' AND commit_seq % 7 = 0) OR (type = 'REPLACE_PARTITIONS' AND commit_seq % 5 = 0) THEN NULL
  WHEN type = 'DUMMY' OR (type = 'ALTER_JOB' AND commit_seq % 3 <> 0 AND commit_seq % 4 = 0) OR (type = 'REPLACE_PARTITIONS' AND commit_seq % 2 = 1) THEN 'FULL_SYNC'
  WHEN type = 'ALTER_JOB' AND commit_seq % 3 <> 0 THEN 'PARTIAL_SYNC_REPLACE' WHEN type = 'REPLACE_PARTITIONS' THEN 'PARTIAL_SYNC' END AS action FROM ({X.LOG}) l) t WHERE action IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, 'refused', commit_seq FROM ({X.LOG}) l WHERE (type = 'DROP_PARTITION' AND commit_seq % 10 = 0) OR (type = 'ALTER_JOB' AND commit_seq % 7 = 0) OR (type = 'REPLACE_PARTITIONS' AND commit_seq % 5 = 0)""")
def _(s, d):
    replica = _replayed(s, d)
    refused = replica.refused.read().select(F.lit(None).cast("bigint").alias("table_id"), F.lit("refused").alias("action"), "commit_seq")
    return replica.syncs.read().select("table_id", "action", "commit_seq").unionByName(refused)


#: Each sync record stands for a change of the source that the log doesn't carry: it adds its position to the values of
#: the rows that its table or partition p1 has then. A copy shows it; the log's own rows don't.
_CUTS = f"""SELECT table_id, '' AS part, commit_seq FROM ({X.LOG}) l WHERE type = 'DROP_TABLE' OR (type = 'TRUNCATE_TABLE' AND commit_seq % 2 = 0)
  UNION ALL SELECT table_id, 'p' || part_day, commit_seq FROM ({X.LOG}) l WHERE (type = 'DROP_PARTITION' AND commit_seq % 10 <> 0) OR (type = 'TRUNCATE_TABLE' AND commit_seq % 2 = 1)
  UNION ALL SELECT table_id, 'p1', commit_seq FROM ({X.LOG}) l WHERE type = 'TRUNCATE_TABLE' AND commit_seq % 2 = 1"""
_SILENT = f"""SELECT table_id, CASE WHEN type = 'REPLACE_PARTITIONS' AND commit_seq % 2 = 0 THEN 'p1' ELSE '' END AS part, commit_seq FROM ({X.LOG}) l
  WHERE type = 'DUMMY' OR (type = 'ALTER_JOB' AND commit_seq % 7 <> 0 AND commit_seq % 3 <> 0) OR (type = 'REPLACE_PARTITIONS' AND commit_seq % 5 <> 0)"""


def _last_of_scopes(rows, records, name):
    """``rows`` with the last position of ``records`` (table_id, part or empty, commit_seq) on their table or partition."""
    last = records.groupBy("table_id", "part").agg(F.max("commit_seq").alias("at"))
    whole, parts = last.where("part = ''").select("table_id", F.col("at").alias("of_table")), last.where("part != ''")
    return rows.join(whole, "table_id", "left").join(parts, ["table_id", "part"], "left").withColumn(name, F.greatest("of_table", "at")).drop("of_table", "at")


def _source_copy(s, d):
    """The source's rows of the wanted scopes, 50 records after the last record that called for a copy of their table."""
    r = frame(s, d, X.ROWS).select("table_id", F.concat(F.lit("p"), F.col("part_day")).alias("part"), "k", "commit_seq", "v", "op")
    cuts, silent = frame(s, d, _CUTS), frame(s, d, _SILENT)

    def copy(wanted):
        positions = wanted.groupBy("table_id").agg((F.max("called_seq") + 50).alias("cursor_seq"))
        then = lambda df: df.join(positions, "table_id").where("commit_seq <= cursor_seq").drop("cursor_seq")
        now = latest(then(r), ["table_id", "part", "k"], ["commit_seq"], F.expr("op = 'D'"))
        now = _last_of_scopes(_last_of_scopes(now, then(cuts), "cut"), then(silent), "told").where("cut IS NULL OR cut <= commit_seq")
        changed = now.withColumn("v", F.col("v") + F.when(F.col("told") > F.col("commit_seq"), F.col("told")).otherwise(0)).select("table_id", "part", "k", "commit_seq", "v")
        rows = changed.join(wanted.select("table_id", "scope"), "table_id").where("scope IN ('', part)")
        return rows.withColumn("data", F.lit(None).cast("string")), positions

    return copy


@query("flow_record_syncs", f"""WITH cuts AS ({_CUTS}), silent AS ({_SILENT}), r AS (SELECT table_id, 'p' || part_day AS part, k, commit_seq, v, op, row_number() OVER (PARTITION BY table_id, part_day, k ORDER BY commit_seq DESC) AS place FROM ({X.ROWS}) l)
SELECT r.table_id, r.part, r.k, r.commit_seq, r.v + coalesce(max(s.commit_seq), 0) AS v FROM r LEFT JOIN silent s ON s.table_id = r.table_id AND s.part IN ('', r.part) AND s.commit_seq > r.commit_seq
WHERE place = 1 AND op <> 'D' AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.table_id = r.table_id AND c.part IN ('', r.part) AND c.commit_seq > r.commit_seq) GROUP BY r.table_id, r.part, r.k, r.commit_seq, r.v""")
def _(s, d):
    """One stream whose schema changes, rollups, replaced partitions and unknown changes start syncs of their table or partition."""
    copy = _source_copy(s, d)
    return _replay(s, frame(s, d, _RECORDS), middle(s, d), lambda spark, folder: SyncingReplica(spark, folder, copy)).read().drop("name")


#: Partitions renamed there and back, and cut by names: the name in force decides whether a cut meets a partition.
_RENAMED = f"""SELECT *, 'p' || part_day AS part, count(CASE WHEN type = 'RENAME_TABLE' THEN 1 END) OVER (PARTITION BY table_id, part_day ORDER BY commit_seq) % 2 AS odd
FROM ({X.LOG}) l WHERE type IN ('UPSERT', 'RENAME_TABLE', 'DROP_PARTITION')"""
_RENAMED_RECORDS = f"""SELECT commit_seq, type, table_id, part, k, v, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, CASE type
  WHEN 'RENAME_TABLE' THEN CASE WHEN odd = 1 THEN '{{"tb":' || table_id || ',"nP":"q' || part_day || '","oP":"p' || part_day || '"}}' ELSE '{{"tb":' || table_id || ',"nP":"p' || part_day || '","oP":"q' || part_day || '"}}' END
  WHEN 'DROP_PARTITION' THEN '{{"tableId":' || table_id || ',"sql":"DROP PARTITION IF EXISTS ' || CASE WHEN odd = 1 THEN 'q' ELSE 'p' END || part_day || '"}}' END AS data FROM ({_RENAMED}) r"""


@query("replay_renamed_partitions", f"""WITH l AS ({X.LOG}), r AS (SELECT table_id, part_day, k, commit_seq, v, event_type, row_number() OVER (PARTITION BY table_id, part_day, k ORDER BY commit_seq DESC) AS place FROM l WHERE type = 'UPSERT')
SELECT table_id, 'p' || part_day AS part, k, commit_seq, v FROM r WHERE place = 1 AND event_type <> 'error'
AND NOT EXISTS (SELECT 1 FROM l WHERE type = 'DROP_PARTITION' AND l.table_id = r.table_id AND l.part_day = r.part_day AND l.commit_seq > r.commit_seq)""")
def _(s, d):
    return _replay(s, frame(s, d, _RENAMED_RECORDS), middle(s, d)).read().drop("name")


#: Seven changes of the columns of each table, at positions of its own; payloads name their columns as at their commit.
_PHASED = f"SELECT r.*, CAST(greatest(0, least(7, floor(8.0 * (commit_seq - table_id + 100) / m))) AS BIGINT) AS phase FROM ({X.ROWS}) r, (SELECT CAST(max(commit_seq) - max(commit_seq) % 8 AS BIGINT) AS m FROM ({X.LOG}) l) x"
_EVOLVED = f"""SELECT commit_seq, 'UPSERT' AS type, table_id, 'p' || part_day AS part, k, v, op, '{{"' || CASE WHEN phase < 2 THEN 'v' WHEN phase < 7 THEN 'w' ELSE 'z' END || '":' || v || CASE WHEN phase >= 1 THEN ',"a":' || k ELSE '' END
  || CASE WHEN phase IN (3, 4) THEN ',"b":"old"' WHEN phase >= 6 THEN ',"b":"n' || k % 10 || '"' ELSE '' END || CASE WHEN phase >= 3 THEN ',"c":' || seq ELSE '' END || CASE WHEN phase = 7 THEN ',"v":1' ELSE '' END || '}}' AS data FROM ({_PHASED}) p
UNION ALL SELECT CAST(m / 8 * i AS BIGINT) + table_id - 100 AS commit_seq, CASE WHEN i IN (2, 7) AND j = 0 THEN 'RENAME_COLUMN' ELSE 'MODIFY_TABLE_ADD_OR_DROP_COLUMNS' END AS type, table_id, NULL, NULL, NULL, NULL, CASE
  WHEN i = 1 THEN '{{"tableId":' || table_id || ',"rawSql":"ADD COLUMN `a` INT DEFAULT 7"}}' WHEN i = 2 THEN '{{"tableId":' || table_id || ',"colName":"v","newColName":"w"}}'
  WHEN i = 3 THEN '{{"tableId":' || table_id || ',"rawSql":"ADD COLUMN (`b` VARCHAR(5) DEFAULT x, `c` INT)"}}' WHEN i = 4 THEN '{{"tableId":' || table_id || ',"rawSql":"MODIFY COLUMN `a` BIGINT"}}'
  WHEN i = 5 THEN '{{"tableId":' || table_id || ',"rawSql":"DROP COLUMN `b`"}}' WHEN i = 6 THEN '{{"tableId":' || table_id || ',"rawSql":"ADD COLUMN `b` VARCHAR(9) DEFAULT y AFTER `a`"}}'
  WHEN j = 0 THEN '{{"tableId":' || table_id || ',"colName":"w","newColName":"z"}}' ELSE '{{"tableId":' || table_id || ',"rawSql":"ADD COLUMN `v` INT DEFAULT 0"}}' END
FROM (SELECT DISTINCT table_id, m FROM ({X.LOG}) l, (SELECT CAST(max(commit_seq) - max(commit_seq) % 8 AS BIGINT) AS m FROM ({X.LOG}) l) x) t, (VALUES (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (7, 1)) c(i, j)"""
_EVOLVED_SQL = f"""SELECT table_id, part_day, k, commit_seq, v, phase, seq FROM (SELECT *, row_number() OVER (PARTITION BY table_id, part_day, k ORDER BY commit_seq DESC) AS place FROM ({_PHASED}) p) q WHERE place = 1 AND op <> 'D'"""


def _evolved(s, d):
    records = frame(s, d, _EVOLVED)
    first = records.select("table_id").distinct().select("table_id", F.lit(0).alias("place"), F.lit("v").alias("column"), F.lit("BIGINT").alias("type"))
    return _replay(s, records, middle(s, d)).read_evolved(first)


@query("replay_schema", f"""SELECT table_id, k, commit_seq, name, type, CASE name WHEN 'z' THEN CAST(v AS VARCHAR) WHEN 'a' THEN CASE WHEN phase >= 1 THEN CAST(k AS VARCHAR) ELSE '7' END WHEN 'c' THEN CASE WHEN phase >= 3 THEN CAST(seq AS VARCHAR) END
  WHEN 'b' THEN CASE WHEN phase >= 6 THEN 'n' || k % 10 ELSE 'y' END ELSE CASE WHEN phase = 7 THEN '1' ELSE '0' END END AS value
FROM ({_EVOLVED_SQL}) r, (VALUES ('z', 'BIGINT'), ('a', 'BIGINT'), ('c', 'INT'), ('b', 'VARCHAR(9)'), ('v', 'INT')) c(name, type)""")
def _(s, d):
    return _evolved(s, d).select("table_id", "k", "commit_seq", F.inline("row"))


@query("replay_table", f"SELECT part_day, k, v AS z, CASE WHEN phase >= 1 THEN k ELSE 7 END AS a, CASE WHEN phase >= 3 THEN CAST(seq AS INTEGER) END AS c, CASE WHEN phase >= 6 THEN 'n' || k % 10 ELSE 'y' END AS b, CAST(CASE WHEN phase = 7 THEN 1 ELSE 0 END AS INTEGER) AS v FROM ({_EVOLVED_SQL}) r WHERE table_id = 103")
def _(s, d):
    """One table under the names and types of its last version."""
    rows = _evolved(s, d).where("table_id = 103").withColumn("part_day", F.substring("part", 2, 9).cast("bigint"))
    columns = [("z", "bigint"), ("a", "bigint"), ("c", "int"), ("b", "string"), ("v", "int")]
    return as_table(rows, columns, "part_day", "k")
