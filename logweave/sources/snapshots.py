"""Snapshots, restores and tables that a log is applied to: plain Parquet folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import alike, latest
from .folders import children, delete, exists, new_folder


def _by_partition(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of a partition come together, so that files don't multiply; large partitions are split over
    several tasks, small ones share one."""
    return rows.hint("rebalance", *map(F.col, columns)) if columns else rows


def snapshot(rows: DataFrame, folder: str, partition_by: tuple[str, ...] = (), where: Column | None = None) -> None:
    """Writes the rows, or those of some partitions: the predicate prunes partitions of the source."""
    rows = rows if where is None else rows.where(where)
    _by_partition(rows, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(folder)


def restore(spark: SparkSession, folder: str, target: str, partition_by: tuple[str, ...] = (), clean: bool = True) -> None:
    """Writes a snapshot over a target folder. clean: partitions that the snapshot lacks go, else
    they stay (dynamic partition overwrite)."""
    writer = _by_partition(spark.read.parquet(folder), partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", "static" if clean else "dynamic").parquet(target)


def overwrite_partitions(rows: DataFrame, target: str, *partition_by: str) -> None:
    """Replaces the partitions that ``rows`` has; the others stay."""
    _by_partition(rows, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(target)


def refresh_view(base: DataFrame, define, folder: str, partition: str, touched: list | None = None) -> None:
    """Writes the view ``define(base)``, which has the base's partition column and takes no rows across
    partitions. With ``touched``, values of that column, only these partitions are read and written anew;
    a partition without rows any more stays as it was."""
    if touched is None:
        snapshot(define(base), folder, (partition,))
    else:
        overwrite_partitions(define(base.where(F.col(partition).isin(touched))), folder, partition)


class Names:
    """Which folder or table each name stands for: a view of Spark's catalogue for each name.

    A change of a name is one statement, so a reader finds the old or the new rows behind it and never
    none.  No folder is deleted here: who has begun to read the old one can end.  Names live as long as
    the catalogue, those of a metastore beyond the session.
    """

    def __init__(self, spark: SparkSession, database: str) -> None:
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{new_folder(spark, 'names')}'")

    def _view(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def now(self) -> dict[str, str]:
        names = [r.viewName for r in self.spark.sql(f"SHOW VIEWS IN `{self.database}`").collect() if not r.isTemporary]
        said = {n: {p.key: p.value for p in self.spark.sql(f"SHOW TBLPROPERTIES {self._view(n)}").collect()} for n in names}
        return {n: p["stands_for"] for n, p in said.items() if "stands_for" in p}

    def point(self, changes: dict[str, str | None]) -> None:
        """Names to folders (paths) or tables of the catalogue; None takes the name away. One statement a name, in
        the given order."""
        for name, of in changes.items():
            if of is None:
                self.spark.sql(f"DROP VIEW IF EXISTS {self._view(name)}")
            else:
                rows = f"parquet.`{of}`" if "/" in of else of
                self.spark.sql(f"CREATE OR REPLACE VIEW {self._view(name)} TBLPROPERTIES ('stands_for' = '{of}') AS SELECT * FROM {rows}")

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._view(name))

    def replace(self, target: str, staged: str, swap: bool = False) -> bool:
        """The table ``staged`` takes the place of ``target``, in one statement. With swap the staged name then
        stands for the old one, else it goes. Idempotent: without a staged table nothing happens."""
        named = self.now()
        if staged not in named:
            return False
        self.point({target: named[staged], staged: named.get(target) if swap else None})
        return True


def tables_to_clean(target_tables: DataFrame, snapshot_tables: DataFrame) -> DataFrame:
    """Target tables, never views, that the snapshot lacks."""
    return target_tables.where("kind = 'TABLE'").join(snapshot_tables.select("name"), "name", "left_anti").select("name")


class ChangeTable:
    """A keyed table kept as the changes of each batch, one Parquet folder a batch.

    A batch's folder has the last change of each of its keys, delete marks too, and reading folds the
    folders.  So a change counts by its position in the log, whatever batch brings it and whichever batch
    comes first; applying a batch costs what the batch costs.  A folder counts once its write is
    complete, and a batch that has one is not applied again, so delivery may repeat.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str = "commit_seq", deleted: str = "op = 'D'") -> None:
        self.spark, self.folder, self.keys, self.order, self.deleted = spark, folder, keys, order, deleted

    def _complete(self) -> tuple[dict[tuple[int, int], str], dict[int, str]]:
        """Complete folders: bases by the range of batches that they hold, and batches."""
        bases, batches = {}, {}
        for path in children(self.spark, self.folder):
            name = re.fullmatch(r"(base|batch)-(-?\d+)(?:\.\.(-?\d+))?", path.rpartition("/")[2])
            if name and exists(self.spark, f"{path}/_SUCCESS"):
                if name[1] == "base":
                    bases[int(name[2]), int(name[3])] = path
                else:
                    batches[int(name[2])] = path
        return bases, batches

    def _folders(self) -> tuple[tuple[int, int] | None, list[str]]:
        """(range of the base in force, folders to read)."""
        bases, batches = self._complete()
        held = max(bases, key=lambda r: r[1] - r[0], default=None)
        others = [p for n, p in batches.items() if held is None or not held[0] <= n <= held[1]]
        return held, others if held is None else [bases[held], *others]

    def has(self, batch: int) -> bool:
        held, _ = self._folders()
        return (held is not None and held[0] <= batch <= held[1]) or exists(self.spark, f"{self.folder}/batch-{batch}/_SUCCESS")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        if self.has(batch):
            return False
        latest(changes, self.keys, [self.order]).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def versions(self) -> DataFrame | None:
        """All changes that are kept, several of a key where several batches had it."""
        _, folders = self._folders()
        return self.spark.read.parquet(*folders) if folders else None

    def changes(self, among: DataFrame | None = None) -> DataFrame | None:
        """The last change of each key, delete marks too. among: only of these keys; others are not shuffled."""
        rows = self.versions()
        if rows is None:
            return None
        return latest(rows if among is None else alike(rows, among, self.keys), self.keys, [self.order])

    def read(self) -> DataFrame | None:
        folded = self.changes()
        return None if folded is None else folded.where(~F.expr(self.deleted))

    def rollback(self, batch: int) -> None:
        """Takes back all batches after ``batch``; they may then be applied anew."""
        held, _ = self._folders()
        if held is not None and batch < held[1]:
            raise ValueError(f"batches up to {held[1]} are compacted")
        for n, path in self._complete()[1].items():
            if n > batch:
                delete(self.spark, path)

    def compact(self) -> None:
        """A base of the batches that follow one another without a gap, from the first one on; its name says
        which, so a batch that comes late is still new. Batches after a gap stay as they are. Delete marks
        stay in the base, as older changes may still come. What the base replaces goes at the next call, so
        readers that have begun can end."""
        bases, batches = self._complete()
        held = max(bases, key=lambda r: r[1] - r[0], default=None)
        if held is not None:
            for r, path in bases.items():
                if r != held:
                    delete(self.spark, path)
            for n, path in batches.items():
                if held[0] <= n <= held[1]:
                    delete(self.spark, path)
        if held is None and not batches:
            return
        low, high = held or (min(batches), min(batches))
        while low - 1 in batches:
            low -= 1
        while high + 1 in batches:
            high += 1
        if held != (low, high):
            paths = [*([bases[held]] if held else []), *[p for n, p in batches.items() if low <= n <= high and not (held and held[0] <= n <= held[1])]]
            latest(self.spark.read.parquet(*paths), self.keys, [self.order]).write.mode("overwrite").parquet(f"{self.folder}/base-{low}..{high}")
