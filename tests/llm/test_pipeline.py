"""The corpus pipeline, each stage on its own input, against brute force."""

import re
from collections import defaultdict

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_near, norm, shingle_set
from test_mixing_packing import brute_targets, check_packing

from logweave.llm import packing
from logweave.llm import quality_rules as qr

SF = "/root/testdata/sf0.001"


def linked_groups(texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    groups = defaultdict(list)
    for line, (i, t) in zip(sorted(brute_near(rows, 80), key=lambda s: int(s[1 : s.index(",")])), rows):
        groups[line.split(", ")[2]].append(t)
    return list(groups.values())


def key(row):
    return str(tuple(row))


def test_stages_are_brute_force(spark, tmp_path):
    """Rows twice, near copies and junk beside the corpus itself; each stage's output is written and read."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("n_chars > 600 AND doc_id IS NOT NULL").limit(12)
    near = some.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.concat(F.lit("Word "), "text")})
    junk = some.limit(3).withColumns({"doc_id": F.col("doc_id") + 2_000_000, "text": F.lit("same words " * 80)})
    data = docs.unionByName(some).unionByName(near).unionByName(junk)
    data.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now = {None: spark.read.parquet(f"{tmp_path}/documents.parquet")}
    for before, (name, stage) in zip([None, *[n for n, _ in cp.STAGES]], cp.STAGES):
        stage(spark, now[before], str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        now[name] = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "packing":
            assert now[name].columns == docs.columns
    rows = {n: d.collect() for n, d in now.items()}

    judged = qr.quality_rules(now[None], qr.trusted_documents(spark, str(tmp_path)))
    assert sorted(map(key, rows["quality_rules"])) == sorted(key(r) for r in judged.where("__rules.kept").drop("__rules").collect())
    assert not any(r.text.startswith("same words") for r in rows["quality_rules"])

    best = {}
    for r in rows["quality_rules"]:
        rank = (-len(r.text), r.doc_id)
        best[norm(r.text)] = min(best.get(norm(r.text), rank), rank)
    assert sorted((-len(r.text), r.doc_id) for r in rows["exact_dedup"]) == sorted(best.values())

    groups = linked_groups([r.text for r in rows["exact_dedup"]])
    ids = {r.text: r.doc_id for r in rows["exact_dedup"]}
    assert sorted(r.doc_id for r in rows["near_dedup"]) == sorted(min(ids[t] for t in g) for g in groups)
    assert not any(1_000_000 <= r.doc_id < 2_000_000 for r in rows["near_dedup"])

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, copies, largest = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows["near_dedup"]:
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in rows["mixing"]:
        taken[r.source] += words(r.text)
        copies[r.doc_id] += 1
    targets = brute_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= largest[s] + 1e-6 for s in sizes) and max(copies.values()) <= 3
    assert {key(r) for r in rows["mixing"]} <= {key(r) for r in rows["near_dedup"]}

    pieces = packing.tokenize(now["mixing"]).collect()
    plain = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(plain, pieces)) == sorted(map(plain, rows["packing"]))
    assert len(check_packing(rows["packing"], 4096)) <= 1.1 * sum(r.length for r in pieces) / 4096 + 2


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_stages_take_edge_cases(spark, which, request, tmp_path):
    """Nulls, repeats, very long texts, clashing names and no rows: each stage keeps the columns and its rule."""
    docs = request.getfixturevalue(which)
    clash = docs.withColumns({"__row_uid": F.lit(1), "__rules": F.lit(2), "row": F.lit(3), "copies": F.lit(4), "size": F.lit(5)})
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.schema(clash.schema).parquet(f"{tmp_path}/documents.parquet")
    texts = [r.text for r in docs.collect()]
    want = {"quality_rules": None, "exact_dedup": len({norm(t) for t in texts}), "near_dedup": len(linked_groups(texts)) if texts else 0, "mixing": None}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        n = out.count()
        assert want[name] is None or n == want[name]
    assert cp.packing(spark, docs, str(tmp_path)).count() >= len(texts)


def test_run_is_its_stages(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert shingle_set("") == frozenset()
