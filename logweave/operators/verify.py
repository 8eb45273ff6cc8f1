"""Proofs that two tables agree, from cheap to detailed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_counts(source: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """``keys, src_n, dst_n`` of partitions whose counts differ."""
    count = lambda d, c: d.groupBy(*keys).agg(F.count("*").alias(c))
    both = count(source, "src_n").join(count(target, "dst_n"), list(keys), "full_outer").na.fill(0, ["src_n", "dst_n"])
    return both.where("src_n != dst_n")


def diff_rows(source: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """``keys, difference``: MISSING, EXTRA or CHANGED, by one full outer join on the key."""
    row = lambda d, c: d.select(*keys, F.struct(*[x for x in sorted(d.columns) if x not in keys]).alias(c))
    kind = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").when(~F.col("a").eqNullSafe(F.col("b")), "CHANGED")
    return row(source, "a").join(row(target, "b"), list(keys), "full_outer").select(*keys, kind.alias("difference")).where("difference IS NOT NULL")


def diff_multiset(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows with the surplus of the source (positive) or target (negative): counts both sides in
    one aggregate instead of expanding repeated rows."""
    both = source.withColumn("__n", F.lit(1)).unionByName(target.withColumn("__n", F.lit(-1)))
    return both.groupBy(*source.columns).agg(F.sum("__n").cast("bigint").alias("surplus")).where("surplus != 0")


def row_text(columns: list[str]) -> Column:
    """The values as one text that no other row has: each with its length before it, a null as a dash."""
    sized = lambda c: F.coalesce(F.concat_ws(":", F.length(F.col(c).cast("string")), F.col(c).cast("string")), F.lit("-"))
    told = lambda c: F.when(F.col(c).isNull(), "-").otherwise(sized(c))
    return F.concat_ws("|", *[told(c) for c in sorted(columns)])


def checksum(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, checksum``: sum of the first 32 bits of each row's MD5, independent of order."""
    part = F.conv(F.substring(F.md5(row_text(rows.columns)), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(part).alias("checksum"))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, total, mixed``: two sums of 64-bit hashes of the rows, one of which can't overflow and one that doesn't add."""
    h = F.xxhash64(row_text([c for c in rows.columns if c != "__range"]))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("total"), F.bit_xor(h).alias("mixed"))


def differing(source: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """``keys`` of the groups of rows that aren't equal on both sides; each side is aggregated before they meet."""
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    side = lambda d, name: _sums(d, *keys).select(*keys, F.struct("n", "total", "mixed").alias(name))
    both = side(source, "a").join(side(target, "b"), list(keys), "full_outer")
    return both.where(~(same("n") & same("total") & same("mixed"))).select(*keys)


def narrowed_diff(source: DataFrame, target: DataFrame, partition: str, *keys: str, ranges: int = 1_024, differ: DataFrame | None = None) -> DataFrame:
    """As diff_rows, by a tree of checksums: of partitions, then of ranges of keys in partitions that differ; only
    rows of ranges that differ are joined.  A key has a row on either side, in whatever partition.
    differ: the ranges (__range) that differ, if they are known."""
    dealt = lambda d: d.withColumn("__range", F.pmod(F.xxhash64(*keys), F.lit(ranges)))
    a, b = dealt(source), dealt(target)
    if differ is None:
        parts = differing(source, target, partition)
        of_parts = lambda d: d.join(parts, d[partition].eqNullSafe(parts[partition]), "left_semi")
        differ = differing(of_parts(a), of_parts(b), partition, "__range").select("__range").distinct()
    left = lambda d: d.join(differ, "__range", "left_semi").drop("__range")
    return diff_rows(left(a), left(b), *keys)


def missing_partitions(source: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Partitions that one side lacks, with that side's name."""
    a, b = source.select(*keys).distinct(), target.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("missing_in", F.lit("TARGET")).unionByName(b.join(a, list(keys), "left_anti").withColumn("missing_in", F.lit("SOURCE")))
