"""The shadow-index filter as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Fixed value: the state store that stateful processors need.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_USE = 0
_TURNS = {"ON": 1, "OFF": 2, "GONE": 3}


class _Shadow(StatefulProcessor):
    """State of an index: the place (position; a change of state before a use) of the last record, and whether the
    index is an active shadow then. It ends when the index goes. The records of a micro-batch come as columns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("shadow", "seq long, is_use boolean, active boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(r["commit_seq"].to_numpy("int64"), r["turn"].map(_TURNS).fillna(_TURNS["OFF"]).where(r["turn"].notna(), _USE).to_numpy("int8")) for r in rows]
        seqs, turns = (np.concatenate(c) for c in zip(*parts))
        last, last_is_use, active = self.state.get() if self.state.exists() else (-1, False, False)
        order = np.lexsort((turns == _USE, seqs))
        seqs, turns = seqs[order], turns[order]
        uses = turns == _USE
        new = (seqs > last) | (seqs == last) & uses & (not last_is_use)
        new[1:] &= (seqs[1:] != seqs[:-1]) | (uses[1:] != uses[:-1])  # delivered again
        seqs, turns, uses = seqs[new], turns[new], uses[new]
        if not len(seqs):
            return
        turned = np.maximum.accumulate(np.where(uses, -1, np.arange(len(seqs))))  # place of the last turn so far
        on = np.where(turned < 0, active, turns[turned] == _TURNS["ON"])
        if turned[-1] >= 0 and turns[turned[-1]] == _TURNS["GONE"]:
            self.state.clear()
        else:
            self.state.update((int(seqs[-1]), bool(uses[-1]), bool(on[-1])))
        kept = seqs[uses & ~on]
        yield pd.DataFrame({"index_id": np.full(len(kept), key[0], dtype="int64"), "commit_seq": kept})

    def close(self) -> None:
        pass


def index_turns(alter: DataFrame) -> DataFrame:
    """``index_id, commit_seq, turn`` of alter jobs (shadow_index, commit_seq, job_type, job_state): ON where a shadow
    begins, OFF where it ends, by the rule of ``without_shadows``."""
    ends = (F.col("job_state") == "CANCELLED") | (F.col("job_state") == "FINISHED") & (F.col("job_type") == "SCHEMA_CHANGE")
    return alter.select(F.col("shadow_index").alias("index_id"), "commit_seq", F.when(F.col("job_state") == "PENDING", "ON").when(ends, "OFF").alias("turn")).where("turn IS NOT NULL")


def stream_without_shadows(records: DataFrame) -> DataFrame:
    """Uses ``index_id, commit_seq`` of indexes that are no active shadow then, as a stream in append mode.

    records: a stream of ``index_id, commit_seq, turn``, where turn is null for a use, else ON, OFF or GONE (the index
    is dropped).  Micro-batches come in the order of the log, apart from repeats; inside one the order doesn't
    matter.  Records that are delivered again change nothing, until their index is gone.  State is one small
    row for each live index, and a task holds one index's records of one micro-batch.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return records.where("index_id IS NOT NULL AND commit_seq IS NOT NULL").groupBy("index_id").transformWithStateInPandas(_Shadow(), "index_id long, commit_seq long", "Append", "None")
