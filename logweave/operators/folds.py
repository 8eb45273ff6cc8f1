"""Folding row changes into keyed tables.

Latest-row folds use max_by with a struct as order: partial aggregation keeps one row per key and
task, so a hot key costs no more than any other; there is no window over a key's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Duplicate model: all rows are kept."""
    return base.unionByName(changes)


def latest(changes: DataFrame, keys: list[str], order: list[str], deleted: Column | None = None) -> DataFrame:
    """Unique model: the row with the greatest ``order`` per key; keys whose last row is a delete
    mark are gone."""
    values = [c for c in changes.columns if c not in keys]
    out = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row")).select(*keys, "row.*")
    return out if deleted is None else out.where(~deleted)


def alike(rows: DataFrame, few: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that agree with a row of ``few`` in the columns; nulls agree with nulls."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    return rows.alias("r").join(few.select(*columns).alias("f"), same, "left_semi")


def aggregated(changes: DataFrame, keys: list[str], functions: dict[str, tuple[str, str]], order: str = "commit_seq") -> DataFrame:
    """Aggregate model. functions: output column -> (function, input column); functions are SUM, MAX, MIN,
    REPLACE, REPLACE_IF_NOT_NULL, HLL_UNION, QUANTILE_UNION."""
    build = {
        "SUM": F.sum, "MAX": F.max, "MIN": F.min,
        "REPLACE": lambda c: F.max_by(c, order),
        "REPLACE_IF_NOT_NULL": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))),
        "HLL_UNION": F.hll_sketch_agg, "QUANTILE_UNION": F.kll_sketch_agg_bigint,
    }
    return changes.groupBy(*keys).agg(*[build[f](c).alias(name) for name, (f, c) in functions.items()])


def merged(states: DataFrame, keys: list[str], functions: dict[str, str], order: str = "last_seq") -> DataFrame:
    """Merges states of an aggregate table: each state is partial over its own changes, so every
    change counts once. functions: column -> function."""
    build = {"SUM": F.sum, "MAX": F.max, "MIN": F.min, "REPLACE": lambda c: F.max_by(c, order)}
    return states.groupBy(*keys).agg(*[build[f](c).alias(c) for c, f in functions.items()])


def _bitmaps(bits: DataFrame, keys: list[str], name: str) -> DataFrame:
    return bits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias(name))


def states(changes: DataFrame, keys: list[str], functions: dict[str, tuple[str, str]], order: str = "commit_seq") -> DataFrame:
    """The state of each key of an aggregate table after some changes; functions as in ``aggregated``, and
    BITMAP_UNION over whole numbers. A replaced value is kept with its position, a bitmap as its parts by number, a
    sketch as binary."""
    at = lambda c: F.struct(F.col(order).alias("at"), F.col(c).alias("value"))
    build = {
        "SUM": F.sum, "MAX": F.max, "MIN": F.min, "REPLACE": lambda c: F.max(at(c)), "REPLACE_IF_NOT_NULL": lambda c: F.max(F.when(F.col(c).isNotNull(), at(c))),
        "HLL_UNION": F.hll_sketch_agg, "QUANTILE_UNION": F.kll_sketch_agg_bigint,
    }
    out = changes.groupBy(*keys).agg(F.count("*").alias("n_changes"), *[build[f](c).alias(name) for name, (f, c) in functions.items() if f != "BITMAP_UNION"])
    for name, (f, c) in functions.items():
        if f == "BITMAP_UNION":
            bits = changes.where(F.col(c).isNotNull()).groupBy(*keys, F.bitmap_bucket_number(c).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("bits"))
            out = out.join(_bitmaps(bits, keys, name), keys, "left")
    return out


def merged_states(parts: DataFrame, keys: list[str], functions: dict[str, tuple[str, str]]) -> DataFrame:
    """One state of each key from several, each over changes of its own."""
    build = {"SUM": F.sum, "MAX": F.max, "MIN": F.min, "REPLACE": F.max, "REPLACE_IF_NOT_NULL": F.max, "HLL_UNION": F.hll_union_agg, "QUANTILE_UNION": F.kll_merge_agg_bigint}
    out = parts.groupBy(*keys).agg(F.sum("n_changes").alias("n_changes"), *[build[f](name).alias(name) for name, (f, _) in functions.items() if f != "BITMAP_UNION"])
    for name, (f, _) in functions.items():
        if f == "BITMAP_UNION":
            bits = parts.select(*keys, F.explode(name).alias("bucket", "bits")).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            out = out.join(_bitmaps(bits, keys, name), keys, "left")
    return out


def from_states(parts: DataFrame, keys: list[str], functions: dict[str, tuple[str, str]], rank: float = 0.5) -> DataFrame:
    """The values of an aggregate table from its states: counts of bitmaps and sketches, the quantile of a rank."""
    count = lambda name: F.coalesce(F.aggregate(F.map_values(name), F.lit(0).cast("long"), lambda a, b: a + F.bitmap_count(b)), F.lit(0).cast("long"))
    build = {
        "REPLACE": lambda c: F.col(c)["value"], "REPLACE_IF_NOT_NULL": lambda c: F.col(c)["value"], "BITMAP_UNION": count, "HLL_UNION": F.hll_sketch_estimate,
        "QUANTILE_UNION": lambda c: F.kll_sketch_get_quantile_bigint(c, F.lit(rank)),
    }
    return parts.select(*keys, *[build.get(f, F.col)(name).alias(name) for name, (f, _) in functions.items()])


def distinct_bitmap(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact distinct counts by bitmaps: one per key and bucket, then united and counted."""
    bits = rows.groupBy(*keys, F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    return bits.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"))


def distinct_sketch(rows: DataFrame, keys: list[str], value: str, batch: Column) -> DataFrame:
    """Approximate distinct counts: a sketch per batch, sketches united."""
    sketches = rows.groupBy(*keys, batch.alias("batch")).agg(F.hll_sketch_agg(value).alias("sketch"))
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def quantile_sketch(rows: DataFrame, keys: list[str], value: str, batch: Column, rank: float = 0.5) -> DataFrame:
    """Approximate quantiles: a sketch per batch, sketches merged."""
    sketches = rows.groupBy(*keys, batch.alias("batch")).agg(F.kll_sketch_agg_bigint(value).alias("sketch"))
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch")).select(*keys, F.kll_sketch_get_quantile_bigint("sketch", F.lit(rank)).alias("quantile"))


def without_matching(rows: DataFrame, predicate: Column) -> DataFrame:
    """Delete by predicate: a row for which it is null stays."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def cut(rows: DataFrame, log: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Rows written after the last record of ``kind`` on their keys: truncations and dropped
    partitions inside a batch take effect without splitting it."""
    last = log.where(F.col("type") == kind).groupBy(*keys).agg(F.max("commit_seq").alias("cut_seq"))
    return rows.join(last, keys, "left").where("cut_seq IS NULL OR commit_seq > cut_seq").drop("cut_seq")
