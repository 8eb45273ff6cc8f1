"""Secrets: counts by brute force, many matches in one text."""

import time
from collections import defaultdict

from logweave.llm import secrets


def test_ownership_is_brute_force(spark, tmp_path):
    """Values by 1 to 5 owners and repositories, one value often in a text."""
    value = lambda n: f"tok{n}aB3" + "xyz"[n % 3] * 4 + "q1W2e3R4" * 3
    rows = [(100 * n + i, f"a {value(n)} b {value(n)} token={value(n)}", f"o{i}" if i else None) for n in range(6) for i in range(n)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    owners = {n: n for n in range(6)}
    got = {r.doc_id: r for r in secrets.scan(spark.read.parquet(path)).collect()}
    for doc_id, text, _ in rows:
        n, r = doc_id // 100, got[doc_id]
        live = owners[n] <= secrets.MAX_OWNERS
        assert r.n_assign == 1 and len(r.findings) == 4  # opaque three times, one of them inside the assignment
        assert {f.owners for f in r.findings} == {n} and {f.repos for f in r.findings} == {n} and all(f.live == live for f in r.findings)
        assert (r.n_live, r.n_copied) == ((4, 0) if live else (0, 4))
        spans = [f"opaque:{i}:{i + len(value(n))}" for i in (2, 5 + len(value(n)))]
        at = text.index("token=")
        assert r.spans == ",".join([*(spans if live else []), f"assign:{at}:{len(text)}"])


def test_extra_spans_meet_no_base_span(spark, docs, edge):
    for df in (docs, edge):
        for r in secrets.scan(df).collect():
            by = defaultdict(list)
            for f in r.findings:
                by[f.kind in ("assign", "access", "hex")].append(f)
            for x in by[False]:
                over = [b for b in by[True] if (b.start <= x.start and x.end <= b.end if x.kind == "pem" else b.start < x.end and x.start < b.end)]
                assert x.extra == (x.live and not over)


def test_many_matches_in_one_text(spark, tmp_path):
    text = "".join(f"token={i:06d} " for i in range(100_000))
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, text, "a"), (2, "token=123456", "b")], "doc_id long, text string, source string").write.parquet(path)
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan(spark.read.parquet(path)).drop("findings").collect()}
    assert got[1].n_assign == 100_000 and got[1].spans.startswith("assign:0:12,assign:13:25,") and got[1].spans.endswith(f"assign:{13 * 99_999}:{13 * 99_999 + 12}")
    assert got[2].spans == "assign:0:12" and time.time() - began < 90
