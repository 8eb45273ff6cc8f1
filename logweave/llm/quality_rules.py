"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over trusted text, one over the whole
raw corpus.  A document's verdict is its mean log ratio per n-gram against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Parameters of the model: n-gram length in bytes, hash buckets, additive smoothing.
NGRAM, BUCKET_BITS, SMOOTH = 4, 16, 0.5
#: Rows of trusted text that the target multinomial is fitted on at most.
TRUSTED_ROWS = 20_000
#: A document below this mean log ratio is rejected. Clean text lies about zero or above, as raw
#: text holds it and junk; text that trusted documents lack lies well below.
MIN_RATIO = -0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def hashed_ngrams(data: bytes) -> np.ndarray:
    """Bucket of each byte n-gram of a text; a shorter text has none."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    n = len(b) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    code = np.zeros(n, dtype=np.uint32)
    for i in range(NGRAM):
        code += b[i : i + n] * _FACTORS[i]
        code ^= code >> np.uint32(13)
    return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _count(batches):
    """Raw and trusted n-gram counts of a task, as one row per bucket."""
    size = 1 << BUCKET_BITS
    raw, good = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for batch in batches:
        for text, trusted in zip(batch.column(0), batch.column(1)):
            value = text.as_py()
            if value:
                got = np.bincount(hashed_ngrams(value.encode()), minlength=size)
                raw += got
                if trusted.as_py():
                    good += got
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, text_col: str = "text") -> np.ndarray:
    """The log ratio of each bucket. ``trusted_ids`` has at most TRUSTED_ROWS ids, so broadcasting
    them is bounded; the counts come from every row of ``docs``."""
    trusted = trusted_ids.select(F.col("doc_id").alias("__id")).distinct().withColumn("__good", F.lit(True))
    marked = docs.join(F.broadcast(trusted), docs["doc_id"] == F.col("__id"), "left").select(
        F.col(text_col).alias("text"), F.coalesce("__good", F.lit(False)).alias("good"))
    counts = marked.mapInArrow(_count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good"))
    size = 1 << BUCKET_BITS
    raw, good = np.zeros(size), np.zeros(size)
    for bucket, r, g in counts.collect():  # one row per bucket: a fixed bound
        raw[bucket], good[bucket] = r, g
    if not good.any():
        return np.zeros(size)
    return np.log((good + SMOOTH) / (good.sum() + SMOOTH * size)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * size))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    v = len(seen)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # numbers of pairs are below the number of words, so the next product stays within 62 bits: a text has less than 2**31 bytes
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    hit = np.zeros(len(words), dtype=bool)
    for i in range(3):
        hit[i : i + n] |= twice
    return int(hit.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    blanks = sum(data.count(c) for c in b" \t\n\x0b\x0c\r")
    return len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with a struct column ``__rules``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, ratio.

    Null text has no words and so fails the base rules; so does an empty text.  A text shorter than
    an n-gram has ratio 0.  Texts of any length are judged whole.  An empty table gives an empty result.  A
    column ``__rules`` is replaced.  Without trusted rows every ratio is 0.  Repeated rows are judged alike.
    Each row is judged from its own whole text and the fixed model; no row is moved.
    """
    weights = log_ratios(docs, trusted_ids, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        w, rows = shared.value, []
        for text in texts:
            text = text or ""
            counts = base_counts(text)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
            grams = hashed_ngrams(text.encode())
            ratio = float(w[grams].mean()) if len(grams) else 0.0
            rows.append((*counts, failed, not failed and ratio >= min_ratio, ratio))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"])

    return docs.withColumn("__rules", judge(F.col(text_col)))


def trusted_documents(spark, sf_dir: str, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled good: a bounded sample in the order of a hash of the id."""
    labels = table(spark, sf_dir, "labels").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass, with the columns of ``docs``, whatever their names."""
    judged = quality_rules(docs.select(F.struct("*").alias("row"), "doc_id", "text"), trusted_documents(spark, sf_dir))
    return judged.where("__rules.kept").select("row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, trusted_documents(spark, sf_dir)).select("doc_id", "__rules.*")
