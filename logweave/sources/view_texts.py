"""Views of a target's catalogue that come from a source's CREATE VIEW texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evolution import rewrite_view
from ..operators.mapping import views_of

_HEAD = r"(?is)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:`[^`]*`|[^\s`.(]+)(?:\s*\.\s*(?:`[^`]*`|[^\s`.(]+))*"


class TargetViews:
    """Views of ``database`` by the texts that records bring, which name objects of the database ``source``.

    A view keeps its columns as they were when it was created.  So a table that is replaced by one with other
    columns is replaced inside ``around``: the views that read it, through other views too, go before and
    are created anew after, each after those that it reads.
    """

    def __init__(self, spark: SparkSession, database: str, source: str, catalog: str = "internal") -> None:
        self.spark, self.database, self.source, self.catalog = spark, database, source, catalog

    def _qualified(self) -> str:
        """A name of the source's database, quoted with it; other quoted names may be aliases."""
        return f"`{self.source}`\\.`[^`.]+`(?![.`])"

    def create(self, name: str, sql_text: str) -> None:
        """As a record says; a view of that name that is there is replaced."""
        named = rewrite_view(F.lit(sql_text), self.source, self.database)
        body = re.sub(_HEAD, "", self.spark.range(1).select(named).first()[0], count=1).replace(f"`{self.catalog}`.`{self.database}`.", f"`{self.database}`.")
        self.spark.sql(f"CREATE OR REPLACE VIEW `{self.database}`.`{name}` {body.rstrip().rstrip(';')}")
        kept = sql_text.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"ALTER VIEW `{self.database}`.`{name}` SET TBLPROPERTIES ('source_text' = '{kept}')")

    def texts(self) -> DataFrame:
        """``name, sql_text`` of the views that ``create`` made."""
        names = [r.viewName for r in self.spark.sql(f"SHOW VIEWS IN `{self.database}`").collect() if not r.isTemporary]
        said = {n: {p.key: p.value for p in self.spark.sql(f"SHOW TBLPROPERTIES `{self.database}`.`{n}`").collect()} for n in names}
        return self.spark.createDataFrame([(n, p["source_text"]) for n, p in said.items() if "source_text" in p], "name string, sql_text string")

    def reading(self, *tables: str) -> list[tuple[str, str]]:
        """(name, text) of the views that read one of the tables, each after those that it reads itself."""
        texts = self.texts()
        text_of = {r.name: r.sql_text for r in texts.collect()}
        every = self.spark.createDataFrame([(n,) for n in {*text_of, *tables}], "table_name string")
        reads: dict[str, set[str]] = {}
        qualified = F.regexp_extract_all("sql_text", F.lit(self._qualified()), F.lit(0))
        for r in views_of(texts.withColumn("sql_text", F.array_join(qualified, " ")), every).collect():
            if r.view != r.table_name:  # its own name in the head
                reads.setdefault(r.view, set()).add(r.table_name)
        found, order = set(tables), []
        while new := sorted(v for v in reads if v not in found and reads[v] & found):
            found.update(new)
        left = found - set(tables)
        while left:
            ready = sorted(v for v in left if not reads[v] & left)
            if not ready:
                raise ValueError(f"views read one another: {sorted(left)}")
            order += ready
            left -= set(ready)
        return [(v, text_of[v]) for v in order]

    def around(self, tables: list[str], change: Callable[[], None]) -> list[str]:
        """Runs ``change``, which replaces or drops the tables; the names of the views that were created anew. Views stay
        away if ``change`` fails or a table is gone after it, as they would have nothing to read."""
        views = self.reading(*tables)
        for name, _ in reversed(views):
            self.spark.sql(f"DROP VIEW IF EXISTS `{self.database}`.`{name}`")
        change()
        gone, made = {t for t in tables if not self.spark.catalog.tableExists(f"`{self.database}`.`{t}`")}, []
        for name, text in views:
            if gone & {x.split("`")[-2] for x in re.findall(self._qualified(), text)}:
                gone.add(name)
            else:
                self.create(name, text)
                made.append(name)
        return made
