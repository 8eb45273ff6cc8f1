"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A text is
compressed block by block with each; the difference of the sizes per byte of the text goes
through a logistic curve fitted on labelled rows that the dictionaries haven't seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Labelled rows of each class that the model is fitted on at most, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 2_000, 20_000
#: Bytes compressed at once: small, so that the dictionary and not the text itself explains them.
BLOCK, DICT_BYTES, LEVEL = 512, 64 * 1024, 3


@dataclass
class CompressionModel:
    """Dictionaries and the calibrated curve; picklable."""

    good: bytes
    bad: bytes
    weights: tuple[float, float] = (0.0, 0.0)
    scale: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def _compressors(self):
        if self._pair is None:
            pair = []
            for data in (self.good, self.bad):
                kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                words = zstandard.ZstdCompressionDict(data, dict_type=kind)
                words.precompute_compress(level=LEVEL)
                pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._pair = pair
        return self._pair

    def difference(self, text: str | None) -> float:
        """Sizes of the whole text, bad minus good, per byte of it; 0 for an empty one."""
        data = (text or "").encode()
        if not data:
            return 0.0
        good, bad = self._compressors()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        g, b = sum(len(good.compress(x)) for x in blocks), sum(len(bad.compress(x)) for x in blocks)
        return (b - g) / len(data)

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.weights[1] * (self.difference(text) - self.scale[0]) / self.scale[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _dictionary(texts: list[str]) -> bytes:
    blocks = [d[i : i + BLOCK] for d in (t.encode() for t in texts) for i in range(0, len(d), BLOCK)]
    # Every so-maniest block, so that all sampled texts count.
    blocks = blocks[:: max(1, len(blocks) * BLOCK // (100 * DICT_BYTES))]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself serves
        return b"".join(blocks)[:DICT_BYTES] or b"\n" * 8


def fit(rows: list[tuple[str, int]]) -> CompressionModel:
    """Dictionaries from the even rows of each class, the curve from the odd ones. With one class
    or none every score is 0.5."""
    by = {k: [t for t, q in rows if q == k] for k in (0, 1)}
    model = CompressionModel(_dictionary(by[1][::2]), _dictionary(by[0][::2]))
    held = [(model.difference(t), k) for k in (0, 1) for t in by[k][1::2]]
    y = np.array([k for _, k in held], dtype=float)
    if len(set(y.tolist())) < 2:
        return model
    x = np.array([d for d, _ in held])
    mean, sd = float(x.mean()), float(x.std()) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.zeros(2)
    for _ in range(50):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights, model.scale = tuple(w.tolist()), (mean, sd)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` texts of each class in the order of a hash of the id: a bounded sample."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    marks = marks.where("crc32(CAST(doc_id AS STRING)) % 3 != 1")
    picked = [marks.where(F.col("__quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "__id")
    got = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).where(F.length("text").between(1, chars))
    got = got.groupBy("doc_id", "__quality").agg(F.max("text").alias("text")).select("text", "__quality", F.xxhash64("doc_id").alias("h"), "doc_id").collect()
    return [(r[0], r[1]) for r in sorted(got, key=lambda r: (r[2], r[3]))]


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``. Null counts as empty; a text's score depends on its bytes alone, so
    rows that repeat a text score alike.  Texts of any length are compressed whole, an empty table gives an
    empty result, and a column ``score`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", run(F.col(text_col)))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 3 = 1"), F.lit(False))
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
