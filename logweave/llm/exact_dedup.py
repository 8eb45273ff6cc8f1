"""Exact dedup by distributed MSD radix partitioning.

Every round splits each group of documents by its next bytes.  A document leaves once it is
alone in its group or its bytes have ended; only groups that still agree go on.  The digit is
wider in later rounds (times eight), so a text of n bytes takes about log8(n) rounds.  Equality
follows from the bytes alone: no digest takes part in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, Scratch, numbered, strip_blanks, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = 32, growth: int = 8, uid_col: str | None = None) -> DataFrame:
    """One row per input row: the row's group of equal texts and the row that stays.

    Texts are equal when identical without separators (space, tab to carriage return).  Null text
    counts as empty, and all empty texts are one group.  The row with the most code points in the
    original text stays, then the smallest id (null ids last), then one of the rows that repeat
    it.  Texts of any length are compared whole, longer ones in more rounds.  An empty table gives an empty
    result; columns besides id and text are not read, so they can't clash.  uid_col: the column that numbers
    the rows, if they have numbers.

    Output: ``__row_uid, doc_id, keep_id, group_size, kept, text_sha256``.

    A hot group costs no more than its bytes: group sizes are partial sums, and the join that
    hands out group numbers is an equi-join that adaptive execution splits when skewed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = strip_blanks(F.col(text_col))
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    state = docs.select(uid.alias(UID), F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("points"), norm.alias("rest"), F.lit(-1).cast("long").alias("gid"))
    state = state.withColumn("text_sha256", F.sha2("rest", 256))
    digit, done, number = first_digit, [], 0
    while True:
        ended = F.octet_length("rest") <= digit
        cut = state.withColumns({"digit": F.substring("rest", 1, digit), "ended": ended, "rest": F.when(~ended, F.expr(f"substring(rest, {digit + 1})"))})
        groups = cut.groupBy("gid", "digit", "ended").agg(F.count("*").alias("n")).where("n > 1")
        groups = scratch.keep(groups.withColumn("new_gid", F.monotonically_increasing_id()).drop("n"), f"groups{number}")
        # Always a sort-merge join: the plan, and so the disk it needs, is the same at every size.
        split = cut.join(groups.hint("merge"), ["gid", "digit", "ended"], "left")
        goes_on = F.col("new_gid").isNotNull() & ~F.col("ended")
        split = split.select(
            UID, "doc_id", "points", "text_sha256", F.col("new_gid").alias("gid"), goes_on.alias("goes_on"),
            F.when(goes_on, F.col("rest")).alias("rest"))
        split = scratch.keep(split, f"split{number}")
        done.append(split.where("NOT goes_on").select(
            UID, "doc_id", "points", "text_sha256", F.when(F.col("gid").isNotNull(), F.struct(F.lit(number).alias("round"), "gid")).alias("group")))
        state = split.where("goes_on").select(UID, "doc_id", "points", "rest", "gid", "text_sha256")
        if state.isEmpty():
            break
        scratch.drop(f"groups{number}")
        digit, number = digit * growth, number + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = scratch.keep(rows, "rows")
    scratch.only("rows")
    order = F.struct("points", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"), F.bitwise_not(UID))
    groups = rows.where("group IS NOT NULL").groupBy("group").agg(
        F.count("*").alias("group_size"), F.max_by(F.struct(F.col("doc_id").alias("keep_id"), F.col(UID).alias("keep_uid")), order).alias("best"))
    groups = scratch.keep(groups, "best")  # as a table, so that the rows of a large group can be split in the join
    shared = rows.where("group IS NOT NULL").join(groups, "group")
    alone = rows.where("group IS NULL").select(
        UID, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(shared.select(
        UID, "doc_id", F.col("best.keep_id").alias("keep_id"), "group_size", (F.col(UID) == F.col("best.keep_uid")).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = numbered(docs, Scratch(docs.sparkSession, "exact-rows"))
    stay = exact_dedup(rows.select(UID, "row.doc_id", "row.text"), uid_col=UID).where("kept").select(UID)
    return rows.join(stay, UID, "left_semi").select("row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop(UID)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
    row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS place
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
