"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets a fractional number of copies; the whole part is certain.  The fractions are
rounded in pairs: word mass moves at random between two documents until one of them is integral,
and the mass of both together never changes.  Buckets round locally and hand on one residual
each; residuals are combined in a reduction tree, so a source's words miss its target by at most
one document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, Scratch, n_words, numbered, table

#: Weights of the sources in code-point order, repeating; a source's target stops at MAX_COPIES times its size.
WEIGHTS, MAX_COPIES = (5.0, 2.0, 1.0), 3
#: Rows that one bucket rounds, and residuals that one node of the tree combines.
BUCKET_ROWS, FAN_IN = 1_000, 1_000
SEED = 20_240_501
_EPS = 1e-12
_OUT = "__row_uid long, source_key string, node long, size long, draw double, h long, p double"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Targets from (source_key, source, source_size, source_rows), one row per source.

    Shares are level * weight, capped at max_copies * size; the level is where the shares add up
    to all words.  In the order of cap / weight the first k sources are capped, and the level of
    the rest follows from two running sums over the table of sources (never over documents).
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    whole, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "heavy": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    # The level if this source and all after it are not capped; the first at which that holds is the right one.
    fits = F.when(F.col("left") <= F.col("heavy") * (F.col("cap") / F.col("weight")), F.col("left") / F.col("heavy"))
    level = F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.col("cap") / F.col("weight"), "source_key"))).over(whole)
    return ranked.withColumn("target", F.least("cap", level * F.col("weight"))).select("source_key", "source_size", "source_rows", "target")


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pair each fraction with the residual so far until one of the two is integral. Large documents come
    first, so what is left over sits on a small one."""
    pdf = pdf.sort_values(["size", "h", "draw", UID], ascending=[False, True, True, True], kind="stable")
    size, p, draw = pdf["size"].tolist(), pdf["p"].tolist(), pdf["draw"].tolist()
    held = -1
    for j in range(len(p)):
        if not _EPS < p[j] < 1 - _EPS:
            p[j] = float(round(p[j]))
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min(size[i] * (1 - p[i]), size[j] * p[j])  # words that can move from j to i
        down = min(size[j] * (1 - p[j]), size[i] * p[i])
        moved = up if draw[j] * (up + down) < down else -down
        p[i] += moved / size[i]
        p[j] -= moved / size[j]
        for x in (i, j):
            if not _EPS < p[x] < 1 - _EPS:
                p[x] = float(round(p[x]))
        held = next((x for x in (i, j) if 0 < p[x] < 1), -1)
    return pdf.assign(p=p)


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, bucket_rows: int = BUCKET_ROWS, seed: int = SEED, uid_col: str | None = None) -> DataFrame:
    """One row per input row: ``__row_uid, doc_id, size, source_size, target, copies, taken``.

    A text's size is its words; null and empty texts have size 0 and are never copied.  Null is a
    source of its own, the last one.  Draws are hashes of id and text, so reruns agree; rows that
    repeat another draw alike, and which of them is taken makes no difference.  An empty table
    gives an empty result.  Texts of any length count whole.  Only doc_id, text and source are read, so other
    columns can't clash.  uid_col: the column that numbers the rows, if they have numbers.  A hot source is dealt over as many buckets as it has bucket_rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    rows = docs.select(
        uid.alias(UID), "doc_id", "source", key.alias("source_key"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"))
    rows = scratch.keep(rows, "rows")
    sizes = rows.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("source_rows"))
    targets = scratch.keep(source_targets(sizes, weights, max_copies), "targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Copies within rounding of a whole number are whole: the cap is reached exactly.
    copies = F.when(F.abs(copies - F.round(copies)) < 1e-9, F.round(copies)).otherwise(copies)
    dealt = rows.join(targets, "source_key").withColumn("whole", F.floor(copies)).withColumn("p", copies - F.col("whole"))
    buckets = F.ceil(F.col("source_rows") / F.lit(bucket_rows))
    open_rows = dealt.where("size > 0 AND p > 0").select(
        UID, "source_key", F.pmod(F.col("h"), buckets).alias("node"), "size",
        (F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("draw"), "h", "p")
    settled, level = [], 0
    top = targets.agg(F.max(F.ceil(F.col("source_rows") / F.lit(bucket_rows)))).first()[0] or 1
    while True:
        done = scratch.keep(open_rows.groupBy("source_key", "node").applyInPandas(_round, _OUT), f"level{level}")
        settled.append(done.where("p = 0 OR p = 1").select(UID, F.col("p").cast("long").alias("extra")))
        open_rows = done.where("p > 0 AND p < 1")
        if top <= 1:
            break
        top, level = -(-top // FAN_IN), level + 1
        open_rows = open_rows.withColumn("node", F.floor(F.col("node") / F.lit(FAN_IN)))
    settled.append(open_rows.select(UID, (F.pmod(F.xxhash64("h", F.lit(seed + 2)), F.lit(1 << 52)) / F.lit(float(1 << 52)) < F.col("p")).cast("long").alias("extra")))
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    taken = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("long")
    return dealt.join(extra, UID, "left").withColumn("copies", taken).select(
        UID, "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = numbered(docs, Scratch(docs.sparkSession, "mix-rows"))
    copies = mix(rows.select(UID, "row.doc_id", "row.text", "row.source"), uid_col=UID).where("copies > 0").select(UID, "copies")
    return rows.join(copies, UID).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
