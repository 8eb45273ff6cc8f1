"""Rollups and views of a keyed table, kept by what each batch takes away and brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import alike, latest
from .snapshots import ChangeTable


def moved(base: ChangeTable, changes: DataFrame) -> DataFrame:
    """The base's columns and ``sign``: -1 for rows that the changes take away, 1 for those that they bring. A change
    older than what its key has moves nothing. Of the base only the changed keys are shuffled."""
    new = latest(changes, base.keys, [base.order])
    old = base.changes(among=new)
    signed = lambda rows, sign: rows.where(~F.expr(base.deleted)).withColumn("sign", F.lit(sign))
    if old is None:
        return signed(new, 1)
    now = latest(old.unionByName(new), base.keys, [base.order])
    return signed(old, -1).unionByName(signed(now, 1))


class View:
    """Groups of a ChangeTable's rows with SUM, COUNT, MIN and MAX, in step with it batch by batch.

    by: names and expressions of the groups; without functions a view of plain rows, each with how often it
    occurs (``n_rows``).  functions: output -> (function, column).  A batch costs what its groups cost: sums and counts
    are added up with their signs, and a least or greatest value is looked for anew only where the group lost the
    row that had it and got none as good.  Groups that lose all rows go.  Null groups are groups.  Sums should be of
    whole numbers or decimals, as sums of floating numbers depend on the order.
    """

    def __init__(self, base: ChangeTable, folder: str, by: dict[str, Column], functions: dict[str, tuple[str, str]] | None = None, where: Column | None = None) -> None:
        self.base, self.by, self.functions, self.where = base, by, functions or {}, where
        self.kept = ChangeTable(base.spark, folder, list(by), order="step", deleted="n_rows = 0")

    def _grouped(self, rows: DataFrame) -> DataFrame:
        """The rows that the view takes, with the names of their groups and the columns that it needs, renamed."""
        rows = rows if self.where is None else rows.where(self.where)
        extra = [F.col(c) for c in ("sign",) if c in rows.columns]
        return rows.select(*[e.alias(name) for name, e in self.by.items()], *[F.col(c).alias(f"__{name}") for name, (_, c) in self.functions.items()], *extra)

    def _difference(self, rows: DataFrame) -> DataFrame:
        """What a batch does to each group."""
        comes, sign = F.col("sign") > 0, F.col("sign").cast("long")
        out = [F.sum(sign).alias("n_rows")]
        for name, (f, _) in self.functions.items():
            c = F.col(f"__{name}")
            if f in ("SUM", "COUNT"):
                out.append(F.sum(F.when(c.isNotNull(), sign).otherwise(0)).alias(f"{name}__n"))
            if f == "SUM":
                out.append(F.coalesce(F.sum(F.when(comes, c).otherwise(-c)), F.lit(0)).alias(name))
            if f in ("MIN", "MAX"):
                best = F.min if f == "MIN" else F.max
                out += [best(F.when(comes, c)).alias(f"{name}__in"), best(F.when(~comes, c)).alias(f"{name}__out")]
        return rows.groupBy(*self.by).agg(*out)

    def _best(self) -> list[str]:
        return [name for name, (f, _) in self.functions.items() if f in ("MIN", "MAX")]

    def refresh(self, batch: int, moves: DataFrame, changed: DataFrame) -> bool:
        """Takes the moves of a batch; changed: its keys. The base must not have the batch yet."""
        if self.kept.has(batch):
            return False
        grouped = self._grouped(moves)
        change = self._difference(grouped)
        names = list(self.by)
        old = self.kept.changes(among=change)
        types = dict(change.dtypes)
        if old is None:
            state = change.select(*names, "n_rows", *[F.col(c) for c in types if c.endswith("__n")], *[F.col(f"{n}__in" if n in self._best() else n).alias(n) for n, (f, _) in self.functions.items() if f != "COUNT"])
        else:
            o, d = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"d.{c}"))
            same = F.lit(True)
            for name in names:
                same = same & d(name).eqNullSafe(o(name))
            added = lambda c: (d(c) + F.coalesce(o(c), F.lit(0))).cast(types[c]).alias(c)
            columns, stale = [*[d(n).alias(n) for n in names], added("n_rows")], F.lit(False)
            columns += [added(c) for c in types if c.endswith("__n")]
            for name, (f, _) in self.functions.items():
                if f == "SUM":
                    columns.append(added(name))
                if f in ("MIN", "MAX"):
                    came, went = d(f"{name}__in"), d(f"{name}__out")
                    lost, made_up = (went <= o(name), came <= o(name)) if f == "MIN" else (went >= o(name), came >= o(name))
                    stale = stale | (F.coalesce(lost, F.lit(False)) & ~F.coalesce(made_up, F.lit(False)))
                    columns.append((F.least if f == "MIN" else F.greatest)(came, o(name)).alias(name))
            state = change.alias("d").join(old.alias("o"), same, "left").select(*columns, stale.alias("__stale"))
            joined = state.persist()
            state = self._looked_up(joined, grouped, changed) if self._best() else joined.drop("__stale")
        self.kept.apply(batch, state.withColumn("step", F.lit(batch).cast("long")))
        if old is not None:
            joined.unpersist()
        return True

    def _looked_up(self, state: DataFrame, grouped: DataFrame, changed: DataFrame) -> DataFrame:
        """The states, with least and greatest values of the stale groups from their rows, and from no other's: those
        that the batch leaves alone and those that it brings."""
        names, best = list(self.by), self._best()
        stale = state.where("__stale AND n_rows > 0").select(*names)
        ever = self.base.versions()
        met = ever if self.where is None else ever.where(self.where)
        met = met.select(*self.base.keys, *[e.alias(f"__by_{n}") for n, e in self.by.items()])
        same = F.lit(True)
        for n in names:
            same = same & F.col(f"m.__by_{n}").eqNullSafe(F.col(f"s.{n}"))
        members = met.alias("m").join(stale.alias("s"), same, "left_semi").select(*self.base.keys).distinct()
        left = self.base.changes(among=members).where(~F.expr(self.base.deleted))
        untouched = F.lit(True)
        for c in self.base.keys:
            untouched = untouched & F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}"))
        left = self._grouped(left.alias("l").join(changed.alias("c"), untouched, "left_anti"))
        rows = alike(left.unionByName(grouped.where("sign > 0").drop("sign")), stale, names)
        found = rows.groupBy(*names).agg(*[(F.min if self.functions[n][0] == "MIN" else F.max)(f"__{n}").alias(f"__best_{n}") for n in best])
        same = F.lit(True)
        for n in names:
            same = same & F.col(f"t.{n}").eqNullSafe(F.col(f"b.{n}"))
        kept = [c for c in state.columns if c not in (*best, "__stale")]
        return state.alias("t").join(found.alias("b"), same, "left").select(*[F.col(f"t.{c}").alias(c) for c in kept], *[F.when(F.col("t.__stale"), F.col(f"b.__best_{n}")).otherwise(F.col(f"t.{n}")).alias(n) for n in best])

    def read(self) -> DataFrame | None:
        """The groups, ``n_rows`` and the functions' values; a sum over nulls alone is null."""
        rows = self.kept.read()
        if rows is None:
            return None
        value = {"SUM": lambda n: F.when(F.col(f"{n}__n") > 0, F.col(n)), "COUNT": lambda n: F.col(f"{n}__n")}
        return rows.select(*self.by, "n_rows", *[value.get(f, F.col)(n).alias(n) for n, (f, _) in self.functions.items()])


def apply_with_views(base: ChangeTable, views: list[View], batch: int, changes: DataFrame) -> None:
    """A batch for the table and its views, which take it first: so a batch that failed midway and comes again is
    finished and counted once. Batches come in the order of their numbers; the changes in them may be in any order."""
    changed = changes.select(*base.keys).distinct()
    if not all(view.kept.has(batch) for view in views):
        moves = moved(base, changes).persist()
        for view in views:
            view.refresh(batch, moves, changed)
        moves.unpersist()
    base.apply(batch, changes)
