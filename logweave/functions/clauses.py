"""Clauses of DDL texts: a text becomes tokens, tokens become clauses, a clause says what it changes.

Quoted names and strings are one token each, so commas, parentheses and key words in them mean nothing.
Places are running sums over the tokens, so a text of thousands of columns takes time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = r"""`[^`]*`|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[(),;<>\[\]]|[^\s`"'(),;<>\[\]]+"""
_HEAD = r"(?is)^\s*ALTER\s+TABLE\s+(?:`[^`]*`|[^\s`.]+)(?:\s*\.\s*(?:`[^`]*`|[^\s`.]+))*\s*"
#: Tokens that one running sum covers at a time.
_BLOCK = 64
# Words that end the type of a column, and aggregate functions of value columns.
AGGREGATES = ("SUM", "MAX", "MIN", "REPLACE", "REPLACE_IF_NOT_NULL", "HLL_UNION", "BITMAP_UNION", "QUANTILE_UNION")
_ENDS_TYPE = ("KEY", *AGGREGATES, "NOT", "NULL", "DEFAULT", "COMMENT", "FIRST", "AFTER", "AUTO_INCREMENT", "ON", "TO", "PROPERTIES")


def tokens(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0))


def body(sql: Column) -> Column:
    """The text after ALTER TABLE and the table's name."""
    return F.regexp_replace(sql, _HEAD, "")


def unquoted(token: Column) -> Column:
    quoted = token.rlike("""(?s)^(?:`.*`|".*"|'.*')$""")
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(quoted & token.startswith("`"), inner).when(quoted, F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(token)


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often and in whatever loops ``of`` names it."""
    return F.get(F.transform(F.array(value), of), 0)


def _running(steps: Column) -> Column:
    """The sum of the steps up to each, itself included: sums of blocks, then inside each block."""
    empty = F.array().cast("array<int>")

    def sums(xs: Column, before: Column) -> Column:
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
        return F.aggregate(xs, F.struct(before.alias("at"), empty.alias("out")), add)["out"]

    def cut(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)))

    def joined(blocks: Column) -> Column:
        of_blocks = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
        starts = F.concat(F.array(F.lit(0)), F.slice(of_blocks, F.lit(1), F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, starts, sums))

    return _bound(steps, lambda s: F.when(F.size(s) > 0, _bound(cut(s), joined)).otherwise(empty))


def _split(parts: Column) -> Column:
    """Tokens between the commas that no bracket holds; a half-open range, `[...)`, counts as one."""

    def cut(t: Column) -> Column:
        depth = _running(F.transform(t, lambda x: F.when(x.isin("(", "<", "["), 1).when(x.isin(")", ">", "]"), -1).otherwise(0)))
        marked = F.transform(F.arrays_zip(t.alias("t"), depth.alias("d")), lambda p, i: F.when((p["t"] == ",") & (p["d"] == 0), i))
        between = lambda commas: F.zip_with(commas, F.concat(F.slice(commas, F.lit(2), F.size(commas)), F.array(F.size(t))), lambda a, b: F.slice(t, a + 2, b - a - 1))
        return F.filter(_bound(F.concat(F.array(F.lit(-1)), F.filter(marked, lambda i: i.isNotNull())), between), lambda c: F.size(c) > 0)

    return _bound(parts, cut)


def _upper(parts: Column) -> Column:
    return F.transform(parts, F.upper)


def _without(parts: Column, *words: str) -> Column:
    """The tokens without these words where they come first."""
    is_words = F.lit(True)
    for i, w in enumerate(words):
        is_words = is_words & (F.upper(F.get(parts, i)) == w)
    return F.when(F.coalesce(is_words, F.lit(False)), F.slice(parts, F.lit(len(words) + 1), F.size(parts))).otherwise(parts)


def clauses(records: DataFrame, sql: Column) -> DataFrame:
    """``records`` with ``clause`` (tokens) and ``place`` (from 0): one row for each clause of ALTER TABLE, and one
    for each column of an ADD COLUMN list. Texts without a clause have no row."""
    whole = F.filter(tokens(body(sql)), lambda t: t != ";")
    one = records.select("*", F.posexplode(_split(whole)).alias("__at", "__clause"))
    rest = _without(_without(F.col("__clause"), "ADD"), "COLUMN")
    is_list = F.coalesce((F.upper(F.get("__clause", F.lit(0))) == "ADD") & (F.get(rest, F.lit(0)) == "("), F.lit(False))
    one = one.withColumn("__rest", F.when(is_list, rest))
    depth = _running(F.transform("__rest", lambda t: F.when(t == "(", 1).when(t == ")", -1).otherwise(0)))
    inner = F.slice("__rest", F.lit(2), F.array_position(depth, 0).cast("int") - 2)  # up to the parenthesis that closes the first
    listed = F.transform(_split(inner), lambda c: F.concat(F.array(F.lit("ADD"), F.lit("COLUMN")), c))
    each = F.when(F.col("__rest").isNotNull(), listed).otherwise(F.array("__clause"))
    out = one.select("*", F.posexplode(each).alias("__in", "clause"))
    return out.withColumn("place", F.col("__at") * 10_000 + F.col("__in")).drop("__at", "__clause", "__rest", "__in")


def _following(parts: Column, word: str) -> Column:
    at = F.array_position(_upper(parts), word).cast("int")
    return F.when(at > 0, F.get(parts, at))


def column_changes(records: DataFrame, sql: Column) -> DataFrame:
    """``records`` with ``place, change`` (ADD, DROP, MODIFY), ``column, type, is_key, aggregate, default, comment, first,
    after``: a row for each column that a text adds, drops or modifies, in the text's order."""
    c = F.col("clause")
    change = F.upper(F.get(c, F.lit(0)))
    spec = _without(_without(_without(F.slice(c, F.lit(2), F.size(c)), "COLUMN"), "IF", "EXISTS"), "IF", "NOT", "EXISTS")
    rows = clauses(records, sql).withColumn("change", change).where("change IN ('ADD', 'DROP', 'MODIFY')").withColumn("__s", spec)
    other = F.upper(F.get("__s", F.lit(0))).isin("PARTITION", "TEMPORARY", "ROLLUP", "INDEX", "ROW", "CONSTRAINT") & (F.size("__s") > 1)
    rows = rows.where(~F.coalesce(other, F.lit(True)))
    ends = F.filter(F.transform("__s", lambda t, i: F.when((i > 0) & F.upper(t).isin(*_ENDS_TYPE), i)), lambda i: i.isNotNull())
    kind = F.array_join(F.slice("__s", F.lit(2), F.coalesce(F.get(ends, 0), F.size("__s")) - 1), "")
    upper = _upper(F.col("__s"))
    default = _following(F.col("__s"), "DEFAULT")
    return rows.select(
        *[x for x in records.columns], "place", "change", unquoted(F.get("__s", F.lit(0))).alias("column"), F.when(F.col("change") != "DROP", F.upper(kind)).alias("type"),
        F.array_contains(upper, "KEY").alias("is_key"), F.get(F.filter(upper, lambda t: t.isin(*AGGREGATES)), 0).alias("aggregate"),
        F.when(F.upper(default) != "NULL", unquoted(default)).alias("default"), unquoted(_following(F.col("__s"), "COMMENT")).alias("comment"),
        F.coalesce(F.upper(F.element_at("__s", -1)) == "FIRST", F.lit(False)).alias("first"), unquoted(_following(F.col("__s"), "AFTER")).alias("after"))


def partition_changes(records: DataFrame, sql: Column) -> DataFrame:
    """``records`` with ``place, change`` (ADD, DROP), ``partition, temporary, if_exists, force, bounds``: a row for each
    partition that a text adds or drops. bounds is the text after VALUES as tokens joined by spaces."""
    c = F.col("clause")
    rows = clauses(records, sql).withColumn("change", F.upper(F.get(c, F.lit(0)))).where("change IN ('ADD', 'DROP')")
    rest = _without(F.slice(c, F.lit(2), F.size(c)), "TEMPORARY")
    rows = rows.withColumn("__s", rest).where(F.coalesce(F.upper(F.get("__s", F.lit(0))) == "PARTITION", F.lit(False)))
    named = _without(_without(F.slice("__s", F.lit(2), F.size("__s")), "IF", "EXISTS"), "IF", "NOT", "EXISTS")
    upper, at = _upper(c), F.array_position(_upper(named), "VALUES").cast("int")
    return rows.select(
        *records.columns, "place", "change", unquoted(F.get(named, 0)).alias("partition"), F.coalesce(F.get(upper, 1) == "TEMPORARY", F.lit(False)).alias("temporary"),
        F.coalesce(F.array_contains(upper, "EXISTS"), F.lit(False)).alias("if_exists"), F.coalesce(F.element_at(upper, -1) == "FORCE", F.lit(False)).alias("force"),
        F.when(at > 0, F.array_join(F.slice(named, at + 1, F.size(named)), " ")).alias("bounds")).where("partition IS NOT NULL")


def listed_names(sql: Column) -> Column:
    """Names in the first parentheses of a text, such as a PARTITIONS clause."""
    t = tokens(sql)
    first = F.array_position(t, "(").cast("int")
    inner = F.slice(t, first + 1, F.greatest(F.array_position(F.slice(t, first + 1, F.size(t)), ")").cast("int") - 1, F.lit(0)))
    return F.when(first > 0, F.transform(F.filter(inner, lambda x: x != ","), unquoted)).otherwise(F.array().cast("array<string>"))
