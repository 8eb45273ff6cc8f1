"""Schema evolution as projections; none of them moves rows between partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_columns(df: DataFrame, columns: dict[str, tuple[str, object]], after: str | None = None, first: bool = False) -> DataFrame:
    """``columns``: name -> (type, default); placed first, after a column, or last."""
    new = [F.lit(v).cast(t).alias(n) for n, (t, v) in columns.items()]
    old = [F.col(c) for c in df.columns]
    at = 0 if first else df.columns.index(after) + 1 if after else len(old)
    return df.select(*old[:at], *new, *old[at:])


def modify_type(df: DataFrame, column: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the new type, rows that can't be cast)."""
    new = F.col(column).try_cast(kind)
    fits = F.col(column).isNull() | new.isNotNull()
    return df.where(fits).withColumn(column, new), df.where(~fits)


def read_with_defaults(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows of two schema versions as one table: columns that the old version lacks get their default."""
    for name, value in defaults.items():
        if name not in old.columns:
            old = old.withColumn(name, F.lit(value).cast(new.schema[name].dataType))
    return old.unionByName(new)


_COLUMNS = "array<struct<id:string,name:string,type:string,default:string>>"


def schema_versions(first: DataFrame, changes: DataFrame) -> DataFrame:
    """``table_id, commit_seq, columns``: the columns of each table from each of its changes on; -1 is the start.

    first: table_id, place, column, type.  changes: table_id, commit_seq, place, change (ADD, DROP,
    MODIFY, RENAME), column, new_name, type, default.  A column keeps its id through renames and
    changes of type; one that is added under the name of a dropped one is another.  The changes of one
    table, some for each statement that alters it, are folded in one row.
    """
    start = first.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("place", "column", "type"))).alias("c"))
    start = start.select("table_id", F.transform("c", lambda x: F.struct(x["column"].alias("id"), x["column"].alias("name"), x["type"].alias("type"), F.lit(None).cast("string").alias("default"))).alias("columns"))
    told = changes.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("commit_seq", "place", "change", "column", "new_name", "type", "default"))).alias("changes"))

    def changed(columns: Column, x: Column) -> Column:
        others = F.filter(columns, lambda c: c["name"] != x["column"])
        added = F.struct(F.concat_ws(".", x["commit_seq"], x["place"]).alias("id"), x["column"].alias("name"), x["type"].alias("type"), x["default"].alias("default"))
        renamed = F.transform(columns, lambda c: F.when(c["name"] == x["column"], F.struct(c["id"], x["new_name"].alias("name"), c["type"], c["default"])).otherwise(c))
        modified = F.transform(columns, lambda c: F.when(c["name"] == x["column"], F.struct(c["id"], c["name"], x["type"].alias("type"), c["default"])).otherwise(c))
        return F.when(x["change"] == "ADD", F.concat(others, F.array(added))).when(x["change"] == "DROP", others).when(x["change"] == "RENAME", renamed).otherwise(modified).cast(_COLUMNS)

    def step(acc: Column, x: Column) -> Column:
        now = changed(acc["now"], x)
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(F.struct(x["commit_seq"].alias("commit_seq"), x["place"].alias("place"), now.alias("columns")))).alias("all"))

    both = start.join(told, "table_id", "full_outer")
    now = F.coalesce("columns", F.array().cast(_COLUMNS)).cast(_COLUMNS)
    zero = F.struct(now.alias("now"), F.array(F.struct(F.lit(-1).cast("long").alias("commit_seq"), F.lit(-1).alias("place"), now.alias("columns"))).alias("all"))
    kind = f"struct<now:{_COLUMNS},all:array<struct<commit_seq:bigint,place:int,columns:{_COLUMNS}>>>"
    folded = F.aggregate(F.coalesce("changes", F.expr("array()").cast(told.schema["changes"].dataType)), zero.cast(kind), lambda acc, x: step(acc, x).cast(kind), lambda acc: acc["all"])
    each = both.select("table_id", F.inline(folded))
    return each.groupBy("table_id", "commit_seq").agg(F.max_by("columns", "place").alias("columns"))  # one statement, one version


def in_last_schema(rows: DataFrame, versions: DataFrame, payload: str = "data") -> DataFrame:
    """``rows`` (table_id, commit_seq, JSON payload) with ``row``, an array of name, type, value (text): the columns of
    the table's last version. A payload names its columns as the version in force at its commit does; a
    column that came later has its default."""
    told = versions.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("commit_seq", "columns"))).alias("__all"))  # as few as the statements that alter it
    held = rows.join(told, "table_id", "left").withColumn("__values", F.from_json(payload, "map<string,string>"))
    then = F.try_element_at(F.filter("__all", lambda x: x["commit_seq"] <= F.col("commit_seq")), F.lit(-1))["columns"]
    held = held.withColumn("__then", then).withColumn("__last", F.try_element_at("__all", F.lit(-1))["columns"])

    def value(c: Column) -> Column:
        then = F.get(F.filter("__then", lambda t: t["id"] == c["id"]), 0)
        return F.struct(c["name"].alias("name"), c["type"].alias("type"), F.when(then.isNull(), c["default"]).otherwise(F.col("__values")[then["name"]]).alias("value"))

    return held.withColumn("row", F.transform("__last", value)).drop("__all", "__values", "__then", "__last")


def as_table(rows: DataFrame, columns: list[tuple[str, str]], *keys: str) -> DataFrame:
    """The rows of one table under its columns (name, type), from ``row`` of in_last_schema; a value that a type
    can't hold is null."""
    named = F.map_from_entries(F.transform("row", lambda x: F.struct(x["name"], x["value"])))
    return rows.withColumn("__named", named).select(*keys, *[F.col("__named")[n].try_cast(t).alias(n) for n, t in columns])


def latest_comments(records: DataFrame) -> DataFrame:
    """``table_id, column, comment`` of the last record per column (column null: the table)."""
    return records.groupBy("table_id", "column").agg(F.max_by("comment", "commit_seq").alias("comment"))


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """``df`` with comments on its columns, as a table written from it keeps them; others stay."""
    fields = [f.metadata | {"comment": comments[f.name]} if f.name in comments else f.metadata for f in df.schema]
    return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=m) for f, m in zip(df.schema, fields)])


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """``table_name, column, difference`` of two column catalogues (table_name, column, type, place, is_key)."""
    a = source.select("table_name", "column", F.struct("type", "place", "is_key").alias("a"))
    b = target.select("table_name", "column", F.struct("type", "place", "is_key").alias("b"))
    kind = F.when(F.col("a").isNull(), "only in target").when(F.col("b").isNull(), "only in source").when(F.col("a.type") != F.col("b.type"), "type").when(
        F.col("a.is_key") != F.col("b.is_key"), "key").when(F.col("a.place") != F.col("b.place"), "place")
    return a.join(b, ["table_name", "column"], "full_outer").select("table_name", "column", kind.alias("difference")).where("difference IS NOT NULL")


def existing_target(source: DataFrame, target: DataFrame, allowed: DataFrame) -> DataFrame:
    """``table_name, decision`` of each table of ``source``; source and target are column catalogues as in
    schema_diff, allowed has the names of the tables whose target may exist.

    Without a target: CREATE; not allowed: REFUSE; with an equal schema: OVERWRITE, else REBUILD_AND_SWAP.
    """
    there = target.select("table_name").distinct().withColumn("there", F.lit(True))
    may = allowed.select("table_name").distinct().withColumn("may", F.lit(True))
    differs = schema_diff(source, target).groupBy("table_name").agg(F.count("*").alias("differences"))
    tables = source.select("table_name").distinct()
    for side in (there, may, differs):
        tables = tables.join(side, "table_name", "left")
    decision = F.when(F.col("there").isNull(), "CREATE").when(F.col("may").isNull(), "REFUSE").when(F.col("differences") > 0, "REBUILD_AND_SWAP").otherwise("OVERWRITE")
    return tables.select("table_name", decision.alias("decision"))


def rewrite_view(sql: Column, source_db: str, target_db: str) -> Column:
    """View text with the target database in both styles of qualified names."""
    return F.regexp_replace(F.regexp_replace(sql, f"`internal`\\.`{source_db}`\\.", f"`internal`.`{target_db}`."), f"([^.])`{source_db}`\\.", f"$1`{target_db}`.")


def rewrite_ddl(sql: Column, source_db: str, table: Column, alias: Column) -> Column:
    """Column DDL without the database prefix and with the alias for the table; a bare
    DEFAULT "" of a dropped value becomes DEFAULT NULL."""
    bare = F.regexp_replace(sql, f"`{source_db}`\\.", "")
    return F.replace(F.replace(bare, F.concat(F.lit("`"), table, F.lit("`")), F.concat(F.lit("`"), alias, F.lit("`"))), F.lit("DEFAULT \"\""), F.lit("DEFAULT NULL"))
