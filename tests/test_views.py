"""Views kept by deltas equal views computed anew."""

import random

from pyspark.sql import functions as F

from logweave.sources.snapshots import ChangeTable
from logweave.sources.views import View, apply_with_views

SCHEMA = "k long, commit_seq long, g string, v long, op string"


def views_of(base, folder):
    return [
        View(base, f"{folder}/groups", {"g": F.col("g")}, {"total": ("SUM", "v"), "n": ("COUNT", "v"), "low": ("MIN", "v"), "high": ("MAX", "v")}),
        View(base, f"{folder}/plain", {"g": F.col("g"), "odd": F.col("v") % 2}, where=F.col("v") > 3)]


def test_views_follow_upserts_and_deletes(spark, tmp_path):
    rng, seq, now = random.Random(3), 0, {}
    base = ChangeTable(spark, f"file://{tmp_path}/base", ["k"])
    views = views_of(base, f"file://{tmp_path}/views")
    for batch in range(5):
        rows = []
        for _ in range(40):
            seq += 1
            late = rng.random() < 0.2  # older than what the key has, perhaps
            rows.append((rng.randrange(15), seq - 30 if late else seq, rng.choice(["a", "b", None, f"g{batch}"]), rng.choice([None, *range(9)]), "D" if rng.random() < 0.3 else "U"))
        rows = list({r[1]: r for r in rows}.values())
        for r in rows:
            if r[0] not in now or r[1] > now[r[0]][1]:
                now[r[0]] = r
        changes = spark.createDataFrame(rows, SCHEMA)
        apply_with_views(base, views, batch, changes)
        if batch == 2:  # comes again
            apply_with_views(base, views, batch, changes)
        groups, plain = {}, {}
        for r in now.values():
            if r[4] != "D":
                groups.setdefault(r[2], []).append(r[3])
                if r[3] is not None and r[3] > 3:
                    plain[r[2], r[3] % 2] = plain.get((r[2], r[3] % 2), 0) + 1
        real = lambda vs: [v for v in vs if v is not None]
        want = {g: (len(vs), sum(real(vs)) if real(vs) else None, len(real(vs)), min(real(vs), default=None), max(real(vs), default=None)) for g, vs in groups.items()}
        assert {r.g: (r.n_rows, r.total, r.n, r.low, r.high) for r in views[0].read().collect()} == want
        assert {(r.g, r.odd): r.n_rows for r in views[1].read().collect()} == plain


def test_a_batch_that_failed_midway_counts_once(spark, tmp_path):
    base = ChangeTable(spark, f"file://{tmp_path}/base", ["k"])
    views = views_of(base, f"file://{tmp_path}/views")
    one = spark.createDataFrame([(1, 1, "a", 5, "U"), (2, 2, "a", 7, "U")], SCHEMA)
    views[0].refresh(0, one.withColumn("sign", F.lit(1)), one.select("k"))  # and the task ends here
    apply_with_views(base, views, 0, one)
    apply_with_views(base, views, 1, spark.createDataFrame([(1, 3, "a", 5, "D"), (2, 4, None, None, "U")], SCHEMA))
    assert [tuple(r) for r in views[0].read().collect()] == [(None, 1, None, 0, None, None)]
    assert views[1].read().collect() == []
    apply_with_views(base, views, 2, spark.createDataFrame([], SCHEMA))
    assert [tuple(r) for r in views[0].read().collect()] == [(None, 1, None, 0, None, None)]
