"""Tables distributed like their source: Spark's bucketed tables, built anew where the source's number changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .snapshots import Names


@dataclass(frozen=True)
class Layout:
    """HASH of columns, or RANDOM without any, into a number of buckets."""

    columns: tuple[str, ...]
    buckets: int

    def like(self, source: Layout) -> Layout:
        """This layout with the source's real number, as AUTO is taken."""
        return Layout(self.columns, source.buckets)


def write_bucketed(rows: DataFrame, table: str, folder: str, layout: Layout) -> None:
    """A table of the catalogue over ``folder``.

    HASH: rows of a bucket come together, and a bucket far larger than the others is written by several tasks, as
    several files of that bucket.  RANDOM: rows are dealt evenly.
    """
    if layout.columns:
        writer = rows.hint("rebalance", layout.buckets, *layout.columns).write.bucketBy(layout.buckets, *layout.columns)
    else:
        writer = rows.repartition(layout.buckets).write
    writer.mode("errorifexists").option("path", folder).saveAsTable(table)


def layout_of(spark: SparkSession, table: str) -> Layout:
    """The layout that the catalogue states; 0 buckets: none stated, as of RANDOM ones."""
    said = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    columns = said.get("Bucket Columns", "[]").strip("[]").replace("`", "")
    return Layout(tuple(c.strip() for c in columns.split(",") if c.strip()), int(said.get("Num Buckets", 0)))


def follow_layout(spark: SparkSession, names: Names, name: str, new_table: str, folder: str, layout: Layout) -> bool:
    """Builds the table behind ``name`` anew as ``new_table`` where it isn't laid out so; the name then stands for it.

    The old table stays for its readers.  False: nothing had to be done.
    """
    if layout_of(spark, names.now()[name]) == layout:
        return False
    write_bucketed(names.read(name), new_table, folder, layout)
    names.point({name: new_table})
    return True
