"""Mapping of source objects to target objects: tables by name, partitions by range, indexes by
name under an alias; names as of a log position; views of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import as_of


def tables_by_name(source: DataFrame, target: DataFrame) -> DataFrame:
    """``src_id, name, dst_id, problem``: source tables without a name are skipped, ones that the
    target lacks are named as a problem."""
    t = target.select("name", F.col("table_id").alias("dst_id"))
    out = source.where("name IS NOT NULL").select(F.col("table_id").alias("src_id"), "name").join(t, "name", "left")
    return out.withColumn("problem", F.when(F.col("dst_id").isNull(), "no target table"))


def partitions_by_range(source: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """``keys, missing``: SOURCE, TARGET or NONE."""
    a, b = source.select(*keys).withColumn("in_source", F.lit(1)), target.select(*keys).withColumn("in_target", F.lit(1))
    missing = F.when(F.col("in_source").isNull(), "SOURCE").when(F.col("in_target").isNull(), "TARGET").otherwise("NONE")
    return a.join(b, list(keys), "full_outer").select(*keys, missing.alias("missing"))


def indexes_by_name(source: DataFrame, target: DataFrame, source_table: Column, target_table: Column) -> DataFrame:
    """``src_index, dst_index, name``: the base index bears its table's name on either side."""
    name = F.when(F.col("index_name") == source_table, target_table).otherwise(F.col("index_name"))
    t = target.select("dst_table", F.col("index_name").alias("name"), F.col("index_id").alias("dst_index"))
    return source.select("dst_table", name.alias("name"), F.col("index_id").alias("src_index")).join(t, ["dst_table", "name"], "left")


def name_asof(names: DataFrame) -> DataFrame:
    """``names`` (table_id, commit_seq, new_name or null) with the name valid at each position."""
    return as_of(names, ["table_id"], "commit_seq", "new_name", "name")


def renames(records: DataFrame, first: DataFrame) -> DataFrame:
    """``kind, id, commit_seq, old_name, new_name``: the history of each table, partition and rollup, from
    rename records (kind, id, commit_seq, old_name, new_name) and the names at the start (kind, id,
    name).  The old name is the one in force, whatever the record says."""
    start = first.select("kind", "id", F.lit(-1).cast("long").alias("commit_seq"), F.col("name").alias("new_name"))
    w = Window.partitionBy("kind", "id").orderBy("commit_seq")
    all_names = records.select("kind", "id", "commit_seq", "new_name").unionByName(start)
    return all_names.withColumn("old_name", F.lag("new_name").over(w)).where("commit_seq >= 0").select("kind", "id", "commit_seq", "old_name", "new_name")


def renamed(objects: DataFrame, records: DataFrame) -> DataFrame:
    """``objects`` (kind, id, name) under their last names. Renaming an object that is unknown, or to a name
    that another one of its kind has, is a ``problem``."""
    last = records.groupBy("kind", "id").agg(F.max_by("new_name", "commit_seq").alias("new_name"))
    both = objects.join(last, ["kind", "id"], "full_outer")
    out = both.select("kind", "id", F.coalesce("new_name", "name").alias("name"), F.col("name").isNull().alias("unknown"))
    taken = out.where("NOT unknown").groupBy("kind", "name").agg(F.count("*").alias("n"))
    problem = F.when(F.col("unknown"), "unknown object").when(F.col("n") > 1, "name is taken")
    return out.join(taken, ["kind", "name"], "left").select("kind", "id", "name", problem.alias("problem"))


def layout_mismatch(source: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Partitions whose numbers of buckets differ; ones without buckets on a side are skipped."""
    count = lambda d, c: d.groupBy(*keys).agg(F.count_distinct("bucket").alias(c))
    both = count(source, "src_buckets").join(count(target, "dst_buckets"), list(keys), "full_outer")
    return both.where("src_buckets > 0 AND dst_buckets > 0 AND src_buckets != dst_buckets")


def views_of(views: DataFrame, tables: DataFrame) -> DataFrame:
    """``view, table_name``: tables that a view's text names, quoted, as its last name part. The
    names are taken out of the text, so this is an equi-join and no comparison of all pairs."""
    named = views.select(F.col("name").alias("view"), F.explode(F.array_distinct(F.regexp_extract_all("sql_text", F.lit("`([^`.]+)`(?![.`])"), F.lit(1)))).alias("table_name"))
    return named.join(tables.select("table_name").distinct(), "table_name").select("view", "table_name")
