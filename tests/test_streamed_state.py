"""The stateful shadow filter: order inside a batch, repeats, indexes that go."""

from logweave.streaming import follow
from logweave.streaming.shadows import stream_without_shadows

SCHEMA = "index_id long, commit_seq long, turn string"


def test_shadow_state(spark, tmp_path):
    batches = [
        [(1, 5, None), (1, 3, "ON"), (1, 2, None), (2, 4, None), (None, 4, None), (1, 3, None)],  # a use at the position of ON meets a shadow
        [(1, 5, None), (1, 7, "OFF"), (1, 6, None), (1, 7, None), (2, 4, None)],  # some delivered again
        [(1, 8, "ON"), (2, 9, "GONE"), (1, 10, None), (2, 8, None)],
        [(1, 12, "GONE"), (1, 11, None), (3, 13, None)]]
    log, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        kept = stream_without_shadows(follow.stream(spark, log))
        follow.drain(kept, f"file://{tmp_path}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    assert sorted((r.index_id, r.commit_seq) for r in spark.read.parquet(out).collect()) == [(1, 2), (1, 7), (2, 4), (2, 8), (3, 13)]
