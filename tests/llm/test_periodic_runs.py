"""Periodic runs against every period of every stretch, tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from logweave.llm.periodic_runs import find_runs, op12_periodic_runs, periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words, min_words=6, min_periods=4):
    """Maximal stretches of each period, least period first."""
    n, found = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def ids(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def test_runs_are_brute_force():
    rng = random.Random(3)
    for _ in range(1_500):
        words = []
        while len(words) < rng.randint(0, 90):
            part = [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(1, 9))]
            words += (part * rng.randint(1, 7))[: rng.randint(1, 60)]
        assert find_runs(ids(words)) == brute(words), words
        assert find_runs(ids(words), 3, 3) == brute(words, 3, 3), words


def test_known_runs():
    assert find_runs(ids("a a a a a".split())) == []  # five words
    assert find_runs(ids("x a a a a a a y".split())) == [(1, 6, 1)]
    assert find_runs(ids("a b a b a b a".split())) == []  # less than four periods
    assert find_runs(ids("a b a b a b a b a".split())) == [(0, 9, 2)]
    fib = ["a", "b"]
    for _ in range(12):
        fib.append(fib[-1] + fib[-2])
    assert find_runs(ids(fib[-1])) == brute(fib[-1])
    long = ids(["w"] * 300_000 + list(range(1_000)) * 5)
    assert find_runs(long) == [(0, 300_000, 1), (300_000, 5_000, 1_000)]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 or not words:
        return words
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = find_runs(ids(words)) if len(words) > 3_000 else brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("which", ["docs", "edge", "empty"])
def test_op12_is_brute_force(spark, which, request, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr("logweave.llm.periodic_runs.table", lambda *_: df)
    got = op12_periodic_runs(spark, SF)
    assert got.columns[:5] == ["doc_id", "n_runs", "start", "length", "period"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(r.doc_id, r.text)) for r in df.collect())


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b " * 9, "x"), (2, None, "y")], "doc_id long, text string, __runs string")
    got = {r.doc_id: r["__runs"] for r in periodic_runs(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 18, 2)] and got[1].collapsed == "a b" and got[2].n_words == 0 and got[2].collapsed == ""
