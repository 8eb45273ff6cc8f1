"""Shared helpers: table reading, scratch tables in the shared folder, row identity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete, shared_folder

#: The separators of words: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
#: Bytes of an Arrow batch while a table is written: an executor holds several batches of texts or sets at a time.
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Name of the row identity in what operators return.
UID = "__row_uid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written once to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        conf, before = self.spark.conf, self.spark.conf.get(ARROW, None)
        conf.set(ARROW, ARROW_BYTES)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            conf.unset(ARROW) if before is None else conf.set(ARROW, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))
            self.names.discard(name)

    def only(self, *names: str) -> None:
        """Drops all tables but those that the result reads."""
        self.drop(*(self.names - {*names}))


def with_uid(docs: DataFrame) -> DataFrame:
    """Number the rows, for a frame that is then used once."""
    return docs.withColumn(UID, F.monotonically_increasing_id())


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``__row_uid, row``: the rows with numbers, written once.  Numbers given anew can differ, after a
    shuffle or when files are dealt to fewer executors; these stay.  As the columns are inside ``row``, no
    name can clash."""
    return scratch.keep(docs.select(F.monotonically_increasing_id().alias(UID), F.struct("*").alias("row")), "numbered")


def strip_blanks(text) -> F.Column:
    """The text without separators, as UTF-8 bytes; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "").cast("binary")


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
