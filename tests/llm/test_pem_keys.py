"""Private keys are told apart by their bodies, not by their header."""

from logweave.llm import secrets

HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def test_keys_of_many_owners_are_different(spark, tmp_path):
    body = lambda i: f"MIIE{i}abcDEF/\n{'Zq' * 10}{i}=="
    texts = [f"key {HEAD}\n{body(i)}\n{END} end" for i in range(4)]
    copied = [f"{HEAD}\r\nMIIcopied\r\n{END}", f"{HEAD} MIIcopied {END}", f"{HEAD}\nMII\ncopied\n{END}"]
    alone = f"{HEAD}\nno end {HEAD}\nMIIother\n{END}"
    dashes = f"{HEAD}\n" + "-a--b-" * 5_000 + f"\n{END}"
    rows = [(i, t, f"o{i}") for i, t in enumerate([*texts, *copied, alone, dashes])]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    got = {r.doc_id: r for r in secrets.scan(spark.read.parquet(path)).collect()}
    pems = lambda r: [(f.start, f.end, f.owners, f.live) for f in r.findings if f.kind == "pem"]
    for i in range(4):
        at = (4, len(texts[i]) - 4)
        assert pems(got[i]) == [(*at, 1, True)] and f"pem:{at[0]}:{at[1]}" in got[i].spans and got[i].n_copied == 0
    for i in range(4, 7):
        assert pems(got[i]) == [(0, len(rows[i][1]), 3, False)] and "pem" not in got[i].spans
    assert [p[:2] for p in pems(got[8])] == [(0, len(dashes))]
    assert [p[:2] for p in pems(got[7])] == [(0, len(HEAD)), (len(HEAD) + 8, len(alone))]
