"""Replaying a mixed log: one record stream in, a whole target out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clauses
from ..functions import payloads as P
from ..operators.asof import as_of
from ..operators.evolution import in_last_schema, schema_versions
from ..operators.progress import action
from ..sources.snapshots import ChangeTable

_TRIAGE = "type string, jobState string, strictRange boolean, useTempName boolean, partitions array<string>"
#: Record types whose payloads are checked and decoded here: all but row changes, which come as rows.
_KINDS = tuple(kind for kind in P.RULES if kind != "UPSERT")


class Replica:
    """Tables kept by a log of records (commit_seq, type, table_id, part, k, v, op, data).

    ``part`` is the identity of a partition, which no rename changes: of a row change the one it is in, of
    an ADD_PARTITION the one it makes.  Until a record says otherwise a partition's name is its identity.
    Each batch is split by what its records call for.  Row changes, cuts (truncations, dropped
    partitions and tables), names of tables and partitions, columns and their history, comments, tables to
    be synced anew and refused records are kept as ChangeTables, so a batch may repeat and batches may come
    in any order: a cut holds for the rows before its position, and a name stands for what bore it then.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        table = lambda name, *keys, gone="false": ChangeTable(spark, f"{folder}/{name}", [*keys], deleted=gone)
        self.rows = table("rows", "table_id", "part", "k", gone="op = 'D'")
        self.cuts = table("cuts", "table_id", "part", "commit_seq")
        self.names = table("names", "table_id")
        self.partitions = table("partitions", "table_id", "commit_seq", "name")
        self.columns = table("columns", "table_id", "column", gone="dropped")
        self.history = table("history", "table_id", "commit_seq", "place")
        self.comments = table("comments", "table_id", "column")
        self.syncs = table("syncs", "table_id", "action")
        self.refused = table("refused", "commit_seq", "reason")

    def apply(self, batch: int, records: DataFrame) -> None:
        rows = records.where("type = 'UPSERT'").select("table_id", "part", "k", "commit_seq", "v", "op", "data")
        records = records.where(~F.col("type").eqNullSafe("UPSERT")).persist()  # few beside the rows, which are read once; most kept tables read them
        parsed = {kind: P.parsed(records.where(F.col("type") == kind).select("commit_seq", "part", "data"), kind) for kind in _KINDS}
        good = {kind: d.where("reason IS NULL") for kind, d in parsed.items()}
        t = F.from_json("data", _TRIAGE)
        acted = records.withColumn("t", t).withColumn("action", action(F.col("type"), F.col("t.type"), F.col("t.jobState"), F.col("t.strictRange"), F.col("t.useTempName")))
        changes = _column_changes(good).persist()
        refused = acted.where("action = 'ERROR'").select("commit_seq", F.lit("unknown type").alias("reason"))
        for d in parsed.values():
            refused = refused.unionByName(d.where("reason IS NOT NULL").select("commit_seq", "reason"))
        refused = refused.persist()

        self.rows.apply(batch, rows)
        self.cuts.apply(batch, _cuts(good))
        self.names.apply(batch, good["RENAME_TABLE"].where(P.rename_kind() == "TABLE").select(F.col("p.tb").alias("table_id"), "commit_seq", F.col("p.nT").alias("name")))
        self.partitions.apply(batch, _partition_names(good))
        self.history.apply(batch, changes)
        self.columns.apply(batch, _last_of_columns(changes))
        self.comments.apply(batch, P.comments(records.where("type = 'MODIFY_COMMENT'").select("commit_seq", "data")).withColumn("column", F.coalesce("column", F.lit(""))))
        self.refused.apply(batch, refused)
        called = acted.where("action IN ('PARTIAL_SYNC', 'PARTIAL_SYNC_REPLACE', 'FULL_SYNC')").select("table_id", "action", "commit_seq", F.when(F.col("action") == "PARTIAL_SYNC", F.col("t.partitions")).alias("partitions"))
        called = called.join(refused.select("commit_seq"), "commit_seq", "left_anti")
        self.syncs.apply(batch, called.drop("partitions"))
        self.carry_out(batch, called)
        refused.unpersist()
        changes.unpersist()
        records.unpersist()

    def carry_out(self, batch: int, called: DataFrame) -> None:
        """Does what the records (table_id, action, commit_seq, partitions) call for: here it is only kept in ``syncs``."""

    def cut_partitions(self) -> DataFrame:
        """``table_id, part, cut_seq``: the last cut of each partition, found by the name that it had then; an empty
        part stands for the whole table."""
        cuts = as_of(self.cuts.read(), ["table_id", "part"], "commit_seq", "id", "bound", sets=_bound_names(self.partitions.read()))
        return cuts.groupBy("table_id", F.coalesce("bound", "part").alias("part")).agg(F.max("commit_seq").alias("cut_seq"))

    def _kept(self) -> DataFrame | None:
        rows = self.rows.read()
        if rows is None:
            return None
        return self._uncut(rows.withColumn("at", F.col("commit_seq"))).where("at > cut_seq")

    def _uncut(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``cut_seq``: the last cut of their partition or table, or -1."""
        cut = self.cut_partitions()
        whole = cut.where("part = ''").select("table_id", F.col("cut_seq").alias("table_cut"))
        rows = rows.join(whole, "table_id", "left").join(cut.where("part != ''"), ["table_id", "part"], "left")
        return rows.withColumn("cut_seq", F.greatest(F.coalesce("table_cut", F.lit(-1)), F.coalesce("cut_seq", F.lit(-1)))).drop("table_cut")

    def read(self) -> DataFrame | None:
        """``table_id, part, k, commit_seq, v, name`` of the rows in force; name is null for a table
        that was never renamed."""
        rows = self._kept()
        if rows is None:
            return None
        return rows.join(self.names.read().select("table_id", "name"), "table_id", "left").select("table_id", "part", "k", "commit_seq", "v", "name")

    def versions(self, first: DataFrame) -> DataFrame:
        """Versions of the tables' columns, see schema_versions; first: their columns at the start."""
        return schema_versions(first, self.history.read())

    def read_evolved(self, first: DataFrame) -> DataFrame | None:
        """``table_id, part, k, commit_seq, row``: the rows in force under the last columns of their tables."""
        rows = self._kept()
        if rows is None:
            return None
        rows = rows.withColumnRenamed("commit_seq", "written").withColumnRenamed("at", "commit_seq")
        return in_last_schema(rows, self.versions(first)).select("table_id", "part", "k", F.col("written").alias("commit_seq"), "row")


def _cuts(good: dict[str, DataFrame]) -> DataFrame:
    """``table_id, part, commit_seq``; part is a name, and an empty one stands for the whole table."""
    truncated = good["TRUNCATE_TABLE"].select(
        F.col("p.tblId").alias("table_id"), "commit_seq", F.explode(F.when(F.col("p.isEntireTable"), F.array(F.lit(""))).otherwise(clauses.listed_names(F.col("p.rawSql")))).alias("part"))
    dropped = good["DROP_PARTITION"].select(F.col("p.tableId").alias("table_id"), "commit_seq", F.col("p.sql").alias("sql"))
    parts = clauses.partition_changes(dropped, F.col("sql")).where("change = 'DROP' AND NOT temporary").select("table_id", "commit_seq", F.col("partition").alias("part"))
    tables = good["DROP_TABLE"].select(F.col("p.tableId").alias("table_id"), "commit_seq", F.lit("").alias("part"))
    return truncated.unionByName(parts).unionByName(tables)


def _partition_names(good: dict[str, DataFrame]) -> DataFrame:
    """``table_id, commit_seq, name, id, old``: names that partitions get. An added one brings its identity, a
    renamed one has it by its old name."""
    added = good["ADD_PARTITION"].select(F.col("p.tableId").alias("table_id"), "commit_seq", F.col("part").alias("id"), F.col("p.sql").alias("sql"))
    added = clauses.partition_changes(added, F.col("sql")).where("change = 'ADD' AND NOT temporary AND id IS NOT NULL").select("table_id", "commit_seq", F.col("partition").alias("name"), "id", F.lit(None).cast("string").alias("old"))
    renamed = good["RENAME_TABLE"].where(P.rename_kind() == "PARTITION")
    return added.unionByName(renamed.select(F.col("p.tb").alias("table_id"), "commit_seq", F.col("p.nP").alias("name"), F.lit(None).cast("string").alias("id"), F.col("p.oP").alias("old")))


def _bound_names(names: DataFrame) -> DataFrame:
    """``table_id, part, commit_seq, id``: from this position on the name ``part`` stands for the partition ``id``. Where
    partitions of a table were renamed, the names of that table, not its rows, are gone through in order, each once."""
    renamed = names.where("old IS NOT NULL").select("table_id").distinct()
    plain = names.join(renamed, "table_id", "left_anti").select("table_id", F.col("name").alias("part"), "commit_seq", "id")
    told = names.join(renamed, "table_id").select("table_id", "commit_seq", "name", "id", "old")
    return plain.unionByName(told.groupBy("table_id").applyInPandas(_bound_in_order, "table_id long, part string, commit_seq long, id string"))


def _bound_in_order(events: pd.DataFrame) -> pd.DataFrame:
    events = events.sort_values(["commit_seq", "name"])
    now: dict[str, str] = {}
    bound = []
    for name, own, old in zip(events["name"], events["id"], events["old"]):
        now[name] = own if own is not None else now.get(old, old)
        bound.append(now[name])
    return pd.DataFrame({"table_id": events["table_id"], "part": events["name"], "commit_seq": events["commit_seq"], "id": pd.Series(bound, index=events.index, dtype=object)})


def _column_changes(good: dict[str, DataFrame]) -> DataFrame:
    """``table_id, commit_seq, place, change, column, new_name, type, default``: every column that a record adds, drops,
    modifies or renames."""
    texts = good["MODIFY_TABLE_ADD_OR_DROP_COLUMNS"].select(F.col("p.tableId").alias("table_id"), "commit_seq", F.col("p.rawSql").alias("sql"))
    null = F.lit(None).cast("string")
    altered = clauses.column_changes(texts, F.col("sql")).select("table_id", "commit_seq", "place", "change", "column", null.alias("new_name"), "type", "default")
    return altered.unionByName(good["RENAME_COLUMN"].select(
        F.col("p.tableId").alias("table_id"), "commit_seq", F.lit(-1).alias("place"), F.lit("RENAME").alias("change"), F.col("p.colName").alias("column"), F.col("p.newColName").alias("new_name"), null.alias("type"), null.alias("default")))


def _last_of_columns(changes: DataFrame) -> DataFrame:
    """``table_id, column, commit_seq, dropped, default``: what each record leaves of a column; a renamed column is one
    that goes and one that comes."""
    state = lambda name, gone, default: F.struct(F.col(name).alias("column"), F.lit(gone).alias("dropped"), default.alias("default"))
    null = F.lit(None).cast("string")
    told = F.when(F.col("change") == "RENAME", F.array(state("column", True, null), state("new_name", False, null))).when(F.col("change") == "DROP", F.array(state("column", True, null))).otherwise(F.array(state("column", False, F.col("default"))))
    each = changes.select("table_id", "commit_seq", "place", F.inline(told))
    return each.groupBy("table_id", "commit_seq", "column").agg(F.max_by(F.struct("dropped", "default"), "place").alias("s")).select("table_id", "column", "commit_seq", "s.*")
