"""A corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes the rows that the stage before it kept.  All but the last return the columns of
``documents``, whatever their names; the last returns the packed pieces.

Null and empty texts have no words: the quality rules reject them, so no later stage of a run sees one
(alone, exact dedup makes them one group, near-dedup keeps each, mixing never takes them, and packing
gives each a piece with the end id).  Rows without an id or a source are treated like others; null is a
source of its own.  Of repeated rows exact dedup keeps one.  Texts of any length are read whole and cut
by packing alone.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm.common import Scratch, table
from logweave.llm.exact_dedup import drop_exact_copies
from logweave.llm.mixing import take_mix
from logweave.llm.near_dedup import drop_near_copies
from logweave.llm.packing import pack, tokenize
from logweave.llm.quality_rules import keep_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(spark, docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(tokenize(docs))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Fitted log ratios, signatures and draws by hash are beyond SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again. A stage's table goes
    once the next one has its own."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.only(name)
    return docs
