"""Collocations against plain counting, and the filters by themselves."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from logweave.llm import collocations as C

SPLIT = re.compile(r"[.,;:!?\x0A-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, least=30):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in SPLIT.split((text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, ws), a in often.items():
        for m in range(2, len(ws)):
            gone |= {(lang, ws[i : i + m]) for i in range(len(ws) - m + 1) if 100 * a >= 80 * f[lang, ws[i : i + m]]}
    out = []
    for lang in n:
        found = []
        for (other, ws), a in often.items():
            if other == lang and (lang, ws) not in gone:
                score, _, l, r = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
                found.append((-score, -a, " ".join(ws).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(seed, rows=400):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "Éa", "éa", "cc", "New", "york", "city", "x\x00y", " ", "ß"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " ; "]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "de", None, "und"]), rng.choice([None, "", " ", "New York City", text(), text(), text()])) for _ in range(rows)]


@pytest.mark.parametrize("options", [{}, {"wide": True}, {"block_bytes": 300, "merge_grams": 50, "fan_in": 2}, {"block_bytes": 500, "merge_grams": 100, "fan_in": 8, "wide": True}])
def test_phrases_are_brute_force(spark, options):
    rows = made(len(options))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = C.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_top_and_edge_cases(spark, edge, empty):
    rows = made(9)
    df = spark.createDataFrame([(*r, 7) for r in rows], "lang string, text string, ids long")
    assert sorted(map(tuple, C.collocations(df, top=3, min_count=5).collect())) == brute(rows, 3, 5)
    assert sorted(map(tuple, C.collocations(edge).collect())) == brute([(r.lang, r.text) for r in edge.collect()])
    assert C.collocations(empty).count() == 0


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_filters_lose_nothing(n, wide):
    rng = np.random.default_rng(n)
    top = 1 << min(31, C.word_bits(n, wide))
    columns = [np.concatenate([rng.integers(0, top, 3_000), [0, top - 1]]).astype(np.uint64) for _ in range(n)]
    hi, lo = C.permuted(columns, wide)
    assert all((a == b).all() for a, b in zip(columns, C.unpermuted(hi, lo, n)))
    counts = rng.integers(1, 1 << 40, len(hi))
    keys = C.folded(hi, lo, counts)
    for bits in (0, 1, 5, 12):
        parts = [C.from_filter(data, prefix, bits) for prefix, data in C._split(*keys, bits)]
        for i, x in enumerate(keys):
            assert x is None or (np.concatenate([p[i] for p in parts]) == x).all()
    assert len(np.unique(hi >> np.uint64(56))) > 200  # keys are spread


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a = 9_000_000_000_000_000_000
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(a).alias("l"), F.lit(a + 7).alias("r"))
    got = row.select(F.expr(f"(CAST({C.SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").alias("s")).first().s
    assert got == C.SCALE * a // (2 * a + 7)
