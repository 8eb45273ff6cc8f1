"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Patterns find candidates with their places.  Hashes of the candidates' values are counted over the
whole corpus by distinct repositories and owners: a value that many owners have is a copied
example, one that few have looks live.  Base spans always stay; of the further candidates, those
that look live are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, Scratch, table, with_uid

#: kind, pattern, group that holds the secret, least length of that group. Base kinds in their order.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs: the same spans as of all runs, without the short ones
)
#: Further kinds that the ownership count decides on. A pem block goes up to its END line; if none
#: follows before another BEGIN, it is the header alone.
MORE = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?>(?s:.*?)(?=-----(?:BEGIN|END) ))-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    ("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{28,}", 0, 28),
)
#: A value that more owners than this have is a copied example.
MAX_OWNERS = 2
#: Places are summed within blocks of so many matches.
BLOCK = 512
#: Distinct characters that a value that looks live has at least.
MIN_CHARACTERS = 8


def _before(lengths: Column) -> Column:
    """Of each length the sum of those before it. An array grown by one copies itself, so sums run within
    blocks, and over the blocks."""

    def running(xs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    with_sums = F.transform(blocks, lambda x: F.struct(x.alias("x"), F.aggregate(x, zero, lambda a, b: a + b).alias("sum")))
    of_blocks = lambda b: F.zip_with(b, running(F.transform(b, lambda x: x["sum"]), zero), lambda x, start: running(x["x"], start))
    return F.when(F.size(lengths) > 0, F.flatten(F.get(F.transform(F.array(with_sums), of_blocks), 0))).otherwise(F.array().cast("array<bigint>"))


def parts_of(text: Column, pattern: str, group: int) -> Column:
    """array<struct<m, v, gap>>: each leftmost non-overlapping match, its group, and the text before it
    since the match before: what split() returns lies between matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    return F.when(text.rlike(pattern), F.transform(parts, lambda x: F.struct(x["v"].alias("v"), F.length(x["m"]).cast("long").alias("m"), F.length(x["gap"]).cast("long").alias("gap"))))


def spans_of(parts: Column, kind: str, least: int) -> Column:
    """array<struct<kind, start, end, value>> in code points, from parts_of. Matches whose group is shorter
    than ``least`` consume their text and are dropped."""
    placed = F.arrays_zip(parts.alias("p"), _before(F.transform(parts, lambda x: x["m"] + x["gap"])).alias("at"))
    fits = F.filter(placed, lambda x: F.length(x["p"]["v"]) >= least)

    def span(x):
        start = x["at"] + x["p"]["gap"]
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["p"]["m"]).alias("end"), x["p"]["v"].alias("value"))

    return F.transform(fits, span)


def _secret_of(x: Column) -> Column:
    """What is hashed and counted: of a pem block its body without white space, of others the value."""
    body = F.regexp_replace(F.regexp_replace(x["value"], r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----", ""), r"\s", "")
    return F.when((x["kind"] == "pem") & (body != ""), body).otherwise(x["value"])


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in the listed order, comma-joined."""
    order = [k for k, *_ in BASE + MORE]
    place = F.array(*map(F.lit, order))
    keyed = F.transform(spans, lambda x: F.struct(x["start"], F.array_position(place, x["kind"]).alias("k"), x["end"], x["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per input row: ``__row_uid, doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_live, n_copied, findings``.

    Null text counts as empty and has no spans; texts of any length are read whole, in time that grows little
    faster than their matches; of spans with one start the listed order of kinds decides; other columns than the
    named ones are not read, so they can't clash; null owners are one owner.  Rows that repeat a text
    have the same spans.  findings lists every candidate with the numbers of owners and repositories of
    its value and whether it looks live.  An empty table gives an empty result.  Counts are partial aggregates
    over (hash, owner, repository), so a value that a third of all rows hold is one row per task.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_uid(docs.select(F.col("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text.alias("text")))
    any_kind = "|".join(f"(?:{p})" for _, p, *_ in BASE + MORE)
    parts = {k: F.when(F.col("maybe"), parts_of(F.col("text"), p, g)) for k, p, g, _ in BASE + MORE}
    found = rows.withColumn("maybe", F.col("text").rlike(any_kind)).withColumns(parts)
    found = found.withColumns({k: F.when(F.col(k).isNotNull(), spans_of(F.col(k), k, n)) for k, _, _, n in BASE + MORE})
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    listed = lambda kinds: F.concat(*[F.coalesce(F.col(k), empty) for k, *_ in kinds])
    hashed = lambda a: F.transform(a, lambda x: F.struct(x["kind"], x["start"], x["end"], F.xxhash64(_secret_of(x)).alias("h"), F.size(F.array_distinct(F.split(x["value"], ""))).alias("chars")))
    found = scratch.keep(found.select(UID, "doc_id", "owner", "repo", hashed(listed(BASE)).alias("base"), hashed(listed(MORE)).alias("more")), "found")
    each = found.where("size(base) + size(more) > 0").select(UID, "owner", "repo", F.inline(F.concat("base", "more")))
    owned = each.select("h", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    by_owner = owned.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    counts = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    counts = scratch.keep(counts, "counts")  # as a table, so that the rows of a frequent value can be split in the join
    looks = (F.col("owners") <= max_owners) & (F.col("chars") >= MIN_CHARACTERS)
    # A finding of a further kind needs no look at its characters if its pattern names what it is.
    looks = F.when(F.col("kind").isin("pem", "vendor", "jwt"), F.col("owners") <= max_owners).otherwise(looks)
    base_kinds = [k for k, *_ in BASE]
    # A further span stays out of the result if it meets a base span: one that begins before it ends and ends
    # after it begins. A pem block is more than a base span in or across a part of it: one has to cover it.
    is_base = F.col("kind").isin(base_kinds)
    until = Window.partitionBy(UID).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(UID).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached, next_start = F.max(F.when(is_base, F.col("end"))).over(until), F.min(F.when(is_base, F.col("start"))).over(onward)
    met = F.when(F.col("kind") == "pem", reached >= F.col("end")).otherwise((reached > F.col("start")) | (next_start < F.col("end")))
    judged = each.join(counts, "h").withColumn("live", looks).withColumn("extra", ~is_base & F.col("live") & ~F.coalesce(met, F.lit(False)))
    judged = judged.select(UID, F.struct("kind", "start", "end", "owners", "repos", "live", "extra").alias("f"))
    judged = judged.groupBy(UID).agg(F.sort_array(F.collect_list("f")).alias("findings"))
    full = found.join(judged, UID, "left")
    findings = F.coalesce("findings", F.array().cast("array<struct<kind:string,start:bigint,end:bigint,owners:bigint,repos:bigint,live:boolean,extra:boolean>>"))
    extra = F.filter(findings, lambda x: x["extra"])
    plain = lambda a: F.transform(a, lambda x: F.struct(x["kind"], x["start"], x["end"]))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return full.select(
        UID, "doc_id", *[count(k) for k in base_kinds], F.sha2(_joined(plain(F.col("base"))), 256).alias("base_sha256"),
        _joined(F.concat(plain(F.col("base")), plain(extra))).alias("spans"),
        F.size(F.filter(findings, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(findings, lambda x: x["owners"] > max_owners)).cast("long").alias("n_copied"), findings.alias("findings"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop(UID, "findings")
