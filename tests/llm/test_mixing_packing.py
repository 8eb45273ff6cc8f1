import re
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.llm import mixing, packing


def brute_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight, capped, the excess shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in order}
        capped |= set(over)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_mix_meets_targets(which, request):
    df = request.getfixturevalue(which)
    got = mixing.mix(df, bucket_rows=5)
    assert got.count() == df.count()
    per = defaultdict(int)
    for r in df.collect():
        per[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(per)
    rows = got.collect()
    by_target = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        key = (round(r.target, 3), r.source_size)
        by_target[key][0] += r.taken
        by_target[key][1] = max(by_target[key][1], r.size)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert {k for k in by_target} == {(round(want[s], 3), per[s]) for s in per}
    merged = defaultdict(float)
    for s in per:
        merged[(round(want[s], 3), per[s])] += want[s]
    for key, (taken, largest, _) in by_target.items():
        assert abs(taken - merged[key]) <= largest * sum(1 for s in per if (round(want[s], 3), per[s]) == key) + 1e-6


def test_mix_reruns_agree_and_is_unbiased(spark, docs):
    one, two = (sorted(map(str, mixing.mix(docs, seed=5).drop("__row_uid").collect())) for _ in range(2))
    assert one == two
    copies = F.col("copies") - F.floor(F.col("target") / F.col("source_size"))
    draws = [mixing.mix(docs, seed=s).where("size > 0").select(F.avg(copies), F.avg(F.col("target") / F.col("source_size") - F.floor(F.col("target") / F.col("source_size")))).first() for s in range(8)]
    assert abs(sum(d[0] for d in draws) / 8 - draws[0][1]) < 0.05


def test_take_mix_repeats_rows(edge, empty):
    out = mixing.take_mix(edge)
    assert out.columns == edge.columns
    assert out.count() == mixing.mix(edge).agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def check_packing(pieces, most):
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return bins


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_packing_round_trip(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(packing.tokenize(df)).collect()
    want = []
    for r in df.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    bins = check_packing(rows, 4096)
    assert len(bins) <= 1.05 * sum(w[3] for w in want) / 4096 + 2


@pytest.mark.parametrize("kind", ["any", "short", "over half"])
def test_packing_levels(spark, tmp_path, kind):
    """150 buckets lose little against one bucket."""
    import random

    rng = random.Random(1)
    low, high = {"any": (1, 4095), "short": (20, 700), "over half": (2040, 2300)}[kind]
    rows = [(i, 0, 0, rng.randint(low, high), i) for i in range(6_000)]
    path = str(tmp_path / "pieces")
    spark.createDataFrame(rows, packing._PIECES).write.parquet(path)
    pieces = spark.read.parquet(path)
    many, one = (packing.pack(pieces, bucket_items=n).collect() for n in (40, 10_000))
    assert sorted(r.doc_id for r in many) == list(range(6_000))
    a, b = len(check_packing(many, 4096)), len(check_packing(one, 4096))
    assert a <= 1.06 * b
    assert b <= 1.01 * sum(r[3] for r in rows) / 4096 + 1 or kind == "over half"


def test_bins_that_go_on():
    assert packing._goes_on([(4096, 9), (3000, 5)], 4096) == 0  # none is up to half full
    assert packing._goes_on([(3000, 2), (2000, 1), (3500, 400), (1000, 2)], 4096) == 3000  # the next have too many pieces
    assert packing._goes_on([(3000, 2), (2000, 1), (4060, 400), (4050, 5)], 4096) == 4050  # the next are nearly full
    assert packing._goes_on([(1000, 50), (3000, 2)], 4096) == 2048
    assert packing._goes_on([], 4096) == 0


def test_token_ids_are_those_of_whole_texts():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, tokenizer = random.Random(2), Tokenizer.from_file(packing.tokenizer_path())
    parts = ["don't", "IT'S", "x''s", "<|endoftext|>", "<|", "a<|startoftext|>b", "naïve", "e\u0301", "\u0130", "ß", "١٢", "42nd", "a_b", "__", "\x7f", "\x00", "\u200b", "\u00a0", "\u2028", "\x1c", "😀", "'", "'ll", "’s", "K", "ﬁ", "日本語", "Ÿ", "Ǆ", "Ⱥ", "ȷ", "÷", "Ĳ", "ŉ", "Éa", "ñ'S", " ", "\t", "\n", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(3_000)]
    ids, ends = packing.token_ids(pa.array(texts), packing.tokenizer_path())
    at = 0
    for text, end in zip(texts, ends):
        assert ids[at:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        at = end


def test_packing_empty(empty):
    assert packing.pack(packing.tokenize(empty)).count() == 0


def test_packing_is_the_same_for_any_layout(spark, tmp_path):
    """Files in any number and order, and rows that repeat a piece, give the same bins."""
    import random

    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randint(1, 4095), i) for i in range(2_000)] + [(None, 0, 0, 700, 5)] * 2_500
    results = []
    for n in (1, 3, 8):
        rng.shuffle(rows)
        path = str(tmp_path / f"pieces{n}")
        spark.createDataFrame(rows, packing._PIECES).repartition(n).write.parquet(path)
        got = packing.pack(spark.read.parquet(path), bucket_items=40).collect()
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in rows)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length, repr(r.doc_id)))
        results.append(sorted(sorted(b) for b in bins.values()))
        check_packing(got, 4096)
    assert results[0] == results[1] == results[2]
