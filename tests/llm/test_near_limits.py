"""The near-dedup stage links at 0.80, op7 at 0.85, and the match limits follow."""

import random
from math import comb

from test_dedup import brute_near, near_result, pairs_of

import corpus_pipeline
from logweave.llm import near_dedup as nd


def tail(k, p):
    return sum(comb(nd.K, i) * p**i * (1 - p) ** (nd.K - i) for i in range(k))


def test_match_limits_follow_percent():
    assert [nd.matches_at(p) for p in (85, 80, 70, 60)] == [27, 24, 18, 13]
    for p in (95, 85, 80, 70, 60):
        assert tail(nd.matches_at(p), p / 100) < 1e-6 <= tail(nd.matches_at(p) + 1, p / 100)


def test_stage_links_at_80(spark, tmp_path, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(60):
        base = [word() for _ in range(200)]
        rows.append((2 * i, " ".join(base), "en", f"s{i % 3}", 0))
        # The end differs: similarity 0.81.
        rows.append((2 * i + 1, " ".join(base[:180] + [word() for _ in range(20)]), "en", f"s{i % 3}", 0))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    df = spark.read.parquet(path)
    out = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [2 * i for i in range(60)]
    assert nd.op7_near_dedup(spark, str(tmp_path)).where("kept").count() == 120
    for d in (df, docs):
        assert near_result(nd.near_dedup(d, 80)) == brute_near(pairs_of(d), 80)
