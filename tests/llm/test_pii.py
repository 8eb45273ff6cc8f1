"""Base spans against the patterns as they are stated; the models; planted personal data."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import pii

SF = "/root/testdata/sf0.001"
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    fits = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in STATED.items() for m in re.finditer(p, text or "") if fits[k](m[0])]


def test_base_spans_are_as_stated():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@", ".", "-", "_", "%", "+", "+1", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "12", "255", "256", "0007", ".1", "1.2.3.4", "é", "😀", "\n", "٣", "x@y.zz", "+49 (30) 123456", "5500-0000-0000-0004"]
    for _ in range(6_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_runs_take_linear_time():
    for part in ("w", "1", "1.", "+1(", "a@", "1 ", "A", "Aa "):
        assert pii.proposed(part * 200_000) is not None


def test_em_finds_who_is_reliable():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.9, 0.8, 0.55]
    cast = np.stack([np.where(rng.random(len(truth)) < 0.3, 1, np.where((rng.random(len(truth)) < r) == truth, 2, 0)) for r in right], axis=1)
    pattern = (cast * 3 ** np.arange(3, -1, -1)).sum(axis=1)
    rows, back, n = np.unique(pattern, return_inverse=True, return_counts=True)
    belief, reliability = pii.em(["x"] * len(rows), rows, n.astype(float), labelers=4)
    assert ((belief[back] > 0.5) == truth).mean() > 0.9
    said = reliability[:, 1, 2] / (reliability[:, 1, 2] + reliability[:, 1, 0])
    assert np.abs(said - right).max() < 0.05


def test_fit_separates():
    features = np.array([[1, 2], [1, 3], [4, 2], [4, 3]] * 50)
    belief = np.array([0.95, 0.9, 0.1, 0.05] * 50)
    weights = pii.fit(features, belief)
    assert ((weights[features].sum(axis=1) > 0) == (belief > 0.5)).all()


def plain(text):
    """The stated patterns take quadratic time on a long run; a text with one is held to have no address."""
    return pii.base_spans(text) if len(text or "") > 50_000 else brute(text)


def expected(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, [sum(k == kind for k, *_ in plain(r.text)) for kind in STATED], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(r.text)).encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("which", ["docs", "edge", "empty"])
def test_op13_keeps_every_base_span(spark, which, request, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(pii, "table", lambda *_: df)
    rows = pii.op13_pii(spark, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in rows) == expected(df.collect())
    for r in rows:
        kinds = [x.split(":")[0] for x in r.spans.split(",") if x]
        assert [kinds.count(k) for k in STATED] == [r.n_email, r.n_ip, r.n_card, r.n_phone]


def test_further_spans_are_found_and_clean_text_is_left_alone(spark):
    rng = random.Random(6)
    rows, number = [], 0
    filler = lambda: " ".join(rng.choice("the of and was in with for that from over".split()) for _ in range(12))
    for i in range(300):
        digits = "".join(rng.choice("0123456789") for _ in range(10))
        planted = [f"Contact Dr. Maria Lopez, phone {digits[:3]}-{digits[3:6]}-{digits[6:]}", f"email jane.doe{i} (at) gmail (dot) com or call Peter Smith", f"ssn 5{digits[:2]}-4{digits[2]}-{digits[3:7]} of patient John Brown"][i % 3]
        clean = [f"see section {i} of version 1.{i} on page 99", f"order 111111111111 of item {i}", "The Old University near Long Street"][i % 3]
        rows += [(i, f"{filler()} {planted} {filler()}"), (1_000 + i, f"{filler()} {clean} {filler()}"), (2_000 + i, filler())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(df)
    taken = {r.doc_id: [x.kind for x in r.findings if x.taken] for r in found.collect()}
    assert sum(bool(taken[i]) for i in range(300)) >= 290
    assert sum("masked_email" in taken[i] for i in range(1, 300, 3)) >= 95 and sum("local_phone" in taken[i] for i in range(0, 300, 3)) >= 95
    assert sum(bool(taken[1_000 + i]) for i in range(300)) <= 15 and not any(taken[2_000 + i] for i in range(300))
    again = {r.doc_id: [x.kind for x in r.findings if x.taken] for r in pii.personal_data(df.repartition(7)).collect()}
    assert again == taken
    text = {r.doc_id: r.text for r in pii.redacted(df.join(found.drop("__row_uid"), "doc_id"), F.col("findings")).collect()}
    assert "gmail" not in text[1] and "[masked_email]" in text[1] and text[2_005] == dict(rows)[2_005]
