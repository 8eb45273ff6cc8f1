"""A replica that carries out the syncs that records call for, while its other tables go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import as_of
from ..operators.folds import latest
from ..sources.snapshots import ChangeTable
from .replay import Replica, _bound_names

#: wanted (table_id, scope, called_seq) -> rows (table_id, scope, part, k, commit_seq, v, data), positions (table_id, cursor_seq)
Copy = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class SyncingReplica(Replica):
    """A Replica that copies a table or some of its partitions anew where a record calls for it.

    ``copy`` is asked once a batch for all scopes that its records want: ``scope`` is a partition's name, or empty
    for a whole table, ``called_seq`` the record's position.  It returns the rows of these scopes as they are at a
    position of each table that is not before ``called_seq``.  Copies and their positions are one folder,
    written at once: readers see a table as it was, then as its copy, and never a part of it.  A batch that
    comes again finds its folder and copies nothing.

    From its copy on, a scope has the copied rows and what the log says after the copy's position: rows and
    cuts before it are skipped, so the record that called for the sync has no other effect, and batches may come in any
    order.  A partition is what bore the scope's name at the record.  Other tables and partitions don't wait.
    """

    def __init__(self, spark: SparkSession, folder: str, copy: Copy) -> None:
        super().__init__(spark, folder)
        self.copy = copy
        self.copied = ChangeTable(spark, f"{folder}/copied", ["table_id", "scope", "mark", "part", "k"], order="cursor_seq", deleted="false")

    def carry_out(self, batch: int, called: DataFrame) -> None:
        scopes = F.when(F.size("partitions") > 0, F.col("partitions")).otherwise(F.array(F.lit("")))
        self.resync(batch, called.select("table_id", "commit_seq", F.explode(scopes).alias("scope")))

    def resync(self, batch: int, wanted: DataFrame) -> bool:
        """Copies the scopes ``table_id, scope, commit_seq``. Also for tables that errors or a trimmed log send back to a
        copy (``to_resync``, ``behind``), under a batch number that no batch of the log has."""
        if self.copied.has(batch):
            return False
        wanted = wanted.groupBy("table_id", "scope").agg(F.max("commit_seq").alias("called_seq")).persist()
        mark = wanted.select("table_id", "scope", F.lit(True).alias("mark"), F.col("scope").alias("part"), F.lit(None).cast("long").alias("k"), "called_seq")
        mark = mark.withColumns({"commit_seq": F.lit(None).cast("long"), "v": F.lit(None).cast("long"), "data": F.lit(None).cast("string")})
        if wanted.isEmpty():
            out = mark.withColumn("cursor_seq", F.lit(0).cast("long"))
        else:
            rows, positions = self.copy(wanted)
            rows = rows.select("table_id", "scope", F.lit(False).alias("mark"), "part", "k", F.lit(None).cast("long").alias("called_seq"), "commit_seq", "v", "data")
            out = mark.unionByName(rows).join(positions, "table_id")
        done = self.copied.apply(batch, out)
        wanted.unpersist()
        return done

    def _kept(self) -> DataFrame | None:
        log = self.rows.changes()
        if log is None:
            return None
        copies = self.copied.read()
        marks = copies.where("mark").select("table_id", F.col("scope").alias("part"), F.col("called_seq").alias("commit_seq"), "cursor_seq")
        marks = as_of(marks, ["table_id", "part"], "commit_seq", "id", "bound", sets=_bound_names(self.partitions.read()))
        marks = marks.groupBy("table_id", F.coalesce("bound", "part").alias("part")).agg(F.max("cursor_seq").alias("synced_seq"))
        whole = marks.where("part = ''").select("table_id", F.col("synced_seq").alias("table_synced"))
        log = log.withColumns({"at": F.col("commit_seq"), "copied": F.lit(False)})
        copies = copies.where("NOT mark").select("table_id", "part", "k", "commit_seq", "v", F.lit("U").alias("op"), "data", F.col("cursor_seq").alias("at"), F.lit(True).alias("copied"))
        rows = log.unionByName(copies).join(whole, "table_id", "left").join(marks.where("part != ''"), ["table_id", "part"], "left")
        since = F.greatest(F.coalesce("table_synced", F.lit(-1)), F.coalesce("synced_seq", F.lit(-1)))
        rows = rows.where(F.when(F.col("copied"), F.col("at") == since).otherwise(F.col("at") > since)).drop("table_synced", "synced_seq")
        rows = self._uncut(latest(rows, ["table_id", "part", "k"], ["at"], F.expr("op = 'D'")))
        return rows.where("at > cut_seq OR copied AND at = cut_seq")
