"""Values in force at a position of the log, without one task for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of the log that one block spans.
BLOCK = 100_000


def as_of(records: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK, sets: DataFrame | None = None) -> DataFrame:
    """``records`` with ``out``: the last value of the key that isn't null, at or before each position.

    sets: the rows (keys, order, value) that set values, where they are known apart from the records;
    else they are taken from ``records``.  Positions are whole numbers, values can be ordered.  What is set
    and what reads it are sorted inside a block of positions of each key, so no row carries more than its
    value and a key with most of the records is spread over its blocks.  The last value before a
    block comes from one row for each key and block.  Keys must not be null.
    """
    known = F.col(order).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    start = F.col(order) - F.pmod(F.col(order), F.lit(block))
    told = F.when(known & F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("value")))
    place = [F.col(order).alias("__at"), start.alias("__block")]
    marks = (records if sets is None else sets).select(*keys, *place, told.alias("__set")).where("__set IS NOT NULL")
    null = F.lit(None).cast(marks.schema["__set"].dataType)
    rows = records.select("*", *place, (told if sets is None else null).alias("__set"), F.lit(True).alias("__record"))
    blocks = rows.select(*keys, "__block").distinct().withColumn("__set", null).unionByName(marks.drop("__at"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocks.groupBy(*keys, "__block").agg(F.max("__set").alias("__set")).withColumn("__set", F.max("__set").over(before))
    carried = ends.where("__set IS NOT NULL").select(*keys, F.col("__block").alias("__at"), "__block", "__set")
    both = rows.unionByName(carried if sets is None else marks.unionByName(carried), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "__block").orderBy("__at")  # rows of one position see one another
    return both.withColumn("__set", F.max("__set").over(so_far)).where("__record").withColumn(out, F.col("__set.value")).drop("__at", "__block", "__set", "__record")
