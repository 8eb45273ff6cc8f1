import re
import zlib

import pytest
from pyspark.sql import functions as F

from logweave.llm import quality_classifier as qc
from logweave.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_rules_are_brute_force(spark, docs, edge):
    for df in (docs, edge):
        ids = df.select("doc_id").where("doc_id IS NOT NULL").distinct().limit(20)
        rows = qr.quality_rules(df, ids).select("text", "__rules.*").collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
            assert r.kept == (not r.base_failed and r.ratio >= qr.MIN_RATIO)


def test_ratio_is_the_mean_log_ratio(docs):
    import numpy as np

    ids = docs.where("doc_id % 2 = 0").select("doc_id")
    rows = docs.select("doc_id", "text").collect()
    size = 1 << qr.BUCKET_BITS
    raw = sum(np.bincount(qr.hashed_ngrams(r.text.encode()), minlength=size) for r in rows)
    good = sum(np.bincount(qr.hashed_ngrams(r.text.encode()), minlength=size) for r in rows if r.doc_id % 2 == 0)
    w = np.log((good + 0.5) / (good.sum() + 0.5 * size)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * size))
    for r in qr.quality_rules(docs, ids).select("text", "__rules.ratio").collect():
        assert r.ratio == pytest.approx(w[qr.hashed_ngrams(r.text.encode())].mean(), abs=1e-9)


def test_rules_reject_junk_and_keep_clean(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = qr.quality_rules(docs, qr.trusted_documents(spark, sf)).where("NOT __rules.base_failed").join(labels, "doc_id")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("__rules.kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.995 and share[0] < 0.4


def test_rules_without_trusted_rows_or_rows(edge, empty):
    none = edge.select("doc_id").where("false")
    assert {r.ratio for r in qr.quality_rules(edge, none).select("__rules.ratio").collect()} == {0.0}
    assert qr.quality_rules(empty, none).count() == 0


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = qc.op1_quality_classifier(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.96
    mean = sum(r.score for r in rows) / len(rows)
    assert abs(mean - sum(r.quality for r in rows) / len(rows)) < 0.1


def test_classifier_edge_cases(spark, edge, empty):
    model = qc.fit([])
    assert {r.score for r in qc.score_quality(edge, model).collect()} == {0.5}
    assert qc.score_quality(empty, model).count() == 0
    labels = spark.createDataFrame([(2, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = qc.fit(qc.labelled_sample(edge, labels))
    scored = qc.score_quality(edge, model).select("text", "score").collect()
    assert len(scored) == edge.count() and all(0 <= r.score <= 1 for r in scored)


def test_score_is_the_size_difference_alone():
    """Of equal differences per byte the scores are equal, and the score rises with the difference."""
    good, bad = [f"the river runs {w} and slow past the old mill {w}" for w in "abcdefghij"], [f"BUY {w} now!!! cheap $$$ {w} click" for w in "abcdefghij"]
    model = qc.fit([(t, 1) for t in good * 40] + [(t, 0) for t in bad * 40])
    texts = [*good, *bad, "", None, "ü" * 2_000, good[0] * 100]
    sizes = [model._compressors()[i] for i in (0, 1)]

    def difference(text):
        data = (text or "").encode()
        size = lambda z: sum(len(z.compress(data[i : i + qc.BLOCK])) for i in range(0, len(data), qc.BLOCK))
        return (size(sizes[1]) - size(sizes[0])) / len(data) if data else 0.0

    pairs = sorted((difference(t), model.score(t)) for t in texts)
    assert all(a[1] <= b[1] if a[0] < b[0] else a[1] == b[1] for a, b in zip(pairs, pairs[1:]))
    assert all(model.score(t) > 0.5 for t in good) and all(model.score(t) < 0.5 for t in bad)
