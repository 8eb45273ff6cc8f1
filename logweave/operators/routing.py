"""Routing of rows into partitions and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clauses import tokens


def range_bounds(uppers: DataFrame) -> DataFrame:
    """``part, lo, hi`` from LESS THAN bounds (part, hi): the lower bound is the bound before."""
    return uppers.select("part", F.lag("hi").over(Window.orderBy("hi")).alias("lo"), "hi")


def by_range(rows: DataFrame, value: str, bounds: list[tuple[str, int | None, int]]) -> DataFrame:
    """``rows`` with ``part``: bounds are [lo, hi), a lower None is open; null part: outside every
    range. The bounds are table metadata, so they become one expression and nothing is joined."""
    part = None
    for name, lo, hi in bounds:  # one flat CASE: thousands of bounds nest no deeper than one
        inside = F.col(value) < hi if lo is None else (F.col(value) >= lo) & (F.col(value) < hi)
        part = F.when(inside, name) if part is None else part.when(inside, name)
    return rows.withColumn("part", F.lit(None).cast("string") if part is None else part)


def by_list(rows: DataFrame, value: str, lists: DataFrame) -> DataFrame:
    """``rows`` with ``part`` from (part, values); null part: in no list."""
    flat = lists.select("part", F.explode("values").alias(value))
    return rows.join(flat, value, "left")


def bucket(columns: list[str], n: int) -> Column:
    return F.pmod(F.hash(*columns), F.lit(n))


def day_of(ts: str) -> Column:
    """Partition of an auto-partitioned table."""
    return F.to_date(F.date_trunc("day", ts))


def add_partition_sql(sql: Column, temporary: Column) -> Column:
    """The text of an ADD PARTITION as a target takes it, put together anew from its parts: what is added, and its
    bounds. Bounds of a range that name no value go, with the properties after them; a list is written with
    two parentheses around its values; a temporary partition is said to be one."""
    part = lambda pattern, group: F.regexp_extract(sql, pattern, group)
    head, bounds = part(r"(?s)^(.*?\bPARTITION\s+(?:`[^`]*`|\S+)\s+)(.*)$", 1), part(r"(?s)^(.*?\bPARTITION\s+(?:`[^`]*`|\S+)\s+)(.*)$", 2)
    named = F.when(temporary & ~head.rlike(r"\bTEMPORARY\s+PARTITION\b"), F.regexp_replace(head, r"\bPARTITION\b", "TEMPORARY PARTITION")).otherwise(head)
    of_range, values = bounds.rlike(r"^VALUES\s*\["), F.regexp_extract(bounds, r"(?s)^VALUES\s+IN\s*\(+(.*?)\)+\s*$", 1)
    empty = of_range & ~F.regexp_extract(bounds, r"(?s)^VALUES\s*\[(.*?\).*?\))\)", 1).rlike(r"[^\s(),]")
    said = F.when(empty, F.lit("")).when(bounds.rlike(r"^VALUES\s+IN\s*\(\("), F.concat(F.lit("VALUES IN (("), values, F.lit("))"))).otherwise(bounds)
    return F.when(head == "", sql).otherwise(F.concat(named, said))


def distribution_sql(sql: Column, columns: Column, buckets: Column) -> Column:
    """The text of an ADD PARTITION with the source's distribution: one that states a number of buckets stays as it is;
    AUTO becomes the source's number; a text without DISTRIBUTED BY gets HASH of the columns, or RANDOM if there
    are none. Words in quotes say nothing."""
    text = F.regexp_replace(sql, r"[\s;]+$", "")
    words = F.transform(tokens(text), F.upper)
    after = lambda word: F.get(words, F.array_position(words, word).cast("int"))
    has_number, auto = F.array_contains(words, "BUCKETS") & (after("BUCKETS") != "AUTO"), F.array_contains(words, "BUCKETS")
    cut = F.when(auto, F.regexp_replace(text, r"(?is)\s*\bBUCKETS\s+AUTO\b[^\"'`]*$", "")).otherwise(text)
    by = F.when(F.array_contains(words, "DISTRIBUTED"), F.lit("")).when(F.size(columns) > 0, F.concat(F.lit(" DISTRIBUTED BY HASH("), F.array_join(columns, ","), F.lit(")"))).otherwise(F.lit(" DISTRIBUTED BY RANDOM"))
    return F.when(F.coalesce(has_number, F.lit(False)), text).otherwise(F.concat(cut, by, F.lit(" BUCKETS "), buckets.cast("string")))
