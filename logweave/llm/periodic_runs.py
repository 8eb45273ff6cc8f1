"""Periodic runs of words by a dictionary of basic factors.

The words of a text become numbers.  For each power of two, equal factors of that length get equal
names, made from the names of their two halves; a factor that occurs once is left out, as are all
longer ones that hold it.  An occurrence and its successor within twice the length propose their
distance as a period, and neighbours that propose the same distance form one progression.  Each
progression is extended word by word to a run of that period, and runs are told apart by their ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table

#: A run has at least so many words, and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
_RUNS = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])


def _reach(ids: np.ndarray, at: int, d: int, step: int) -> int:
    """How many words from ``at`` on, by ``step``, equal the word ``d`` after them. Blocks double, so the
    cost follows the answer."""
    n, done, block = len(ids) - d, 0, 16
    while True:
        room = n - at if step > 0 else at + 1
        size = min(block, room)
        if size <= 0:
            return done
        low = at if step > 0 else at - size + 1
        differ = np.flatnonzero(ids[low : low + size] != ids[low + d : low + size + d])
        if len(differ):
            return done + int(differ[0] if step > 0 else size - 1 - differ[-1])
        done, at, block = done + size, at + step * size, 2 * block


def _progressions(ids: np.ndarray, longest: int):
    """(first, last, distance, length): neighbouring places whose factors of this length come again
    after the same distance, of at most twice the length; lengths up to ``longest``."""
    names, length = ids, 1
    while True:
        held = np.flatnonzero(names >= 0)
        order = held[np.argsort(names[held], kind="stable")]
        after, named = order[1:] - order[:-1], names[order]
        same = (named[1:] == named[:-1]) & (after <= 2 * length)
        place, distance = order[:-1][same], after[same]
        by_place = np.argsort(place)
        place, distance = place[by_place], distance[by_place]
        if len(place):
            new = np.flatnonzero((np.diff(place) != 1) | (np.diff(distance) != 0)) + 1
            for low, high in zip([0, *new.tolist()], [*new.tolist(), len(place)]):
                yield int(place[low]), int(place[high - 1]), int(distance[low]), length
        if 2 * length > longest:
            return
        # Names of the factors of twice the length; those that occur once get none.
        left, right = names[:-length], names[length:]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        if not len(both):
            return
        _, inverse, count = np.unique(left[both].astype(np.int64) * len(ids) + right[both], return_inverse=True, return_counts=True)
        names = np.full(len(left), -1, dtype=np.int64)
        names[both] = np.where(count[inverse] > 1, inverse, -1)
        length *= 2


def find_runs(ids: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period.

    ``ids`` are numbers below len(ids), equal for equal words.  A run of period q has a factor of a
    length from q to below 2q, whose successor comes after q places, so q is proposed there.  A
    stretch found for a multiple of its period q has the ends of the run of q, so of one stretch the
    least period counts.  That needs three periods at least.
    """
    if min_periods < 3:
        raise ValueError("runs of less than three periods aren't found this way")
    n = len(ids)
    ends: dict[tuple[int, int], int] = {}
    reached: dict[int, int] = {}  # by period and level, the end of the last stretch: what lies in it is known
    known: set[tuple[int, int, int]] = set()
    level = 0
    if n < max(min_words, min_periods):
        return []
    for first, last, d, length in _progressions(ids, n // 2):
        if length != level:
            level, reached = length, {}
        if d * min_periods > n or reached.get(d, -1) >= last + d + length:
            continue
        low = first - _reach(ids, first - 1, d, -1)
        high = last + length + _reach(ids, last + length, d, 1) + d
        reached[d] = high
        if high - low >= max(min_words, min_periods * d) and (low, high, d) not in known:
            known.add((low, high, d))
            ends[low, high] = min(d, ends.get((low, high), d))
    return sorted((low, high - low, d) for (low, high), d in ends.items())


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """The columns of ``docs`` but the text, and a struct ``__runs``: n_words, runs (start, length, period by
    start, then period), collapsed (the words joined by a space, without those that a run repeats after
    its first period).

    Null and empty texts have no words, no runs and an empty collapsed text.  Texts of any length are
    read whole.  Of runs that share words each drops its own repeats.  Rows that repeat a text have the
    same runs.  A column ``__runs`` is replaced.  An empty table gives an empty result.  Each row is
    judged by itself: nothing is shuffled.
    """
    others = [c for c in docs.columns if c not in (text_col, "__runs")]

    def judge(batches):
        for batch in batches:
            rows = []
            for text in batch.column(len(others)):
                words = (text.as_py() or "").encode().split()
                runs = find_runs(_numbers(words), min_words, min_periods)
                kept = words
                if runs:
                    drop = np.zeros(len(words) + 1, dtype=np.int64)
                    for start, length, period in runs:
                        drop[start + period] += 1
                        drop[start + length] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                rows.append({"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": b" ".join(kept).decode()})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, _ARROW)], [*others, "__runs"])

    kept = [f"`{c}`" for c in others]
    schema = docs.select(*kept, F.lit(None).cast(_RUNS).alias("__runs")).schema
    return docs.select(*kept, F.col(text_col)).mapInArrow(judge, schema)


def _repeating(text: Column, doc_id: Column) -> Column:
    """The text of one row in ten, by its id, with its words from one on replaced by repeats; a row
    without an id stays as it is."""
    h = F.crc32(doc_id.cast("string"))

    def of(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w)), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    changed = F.get(F.transform(F.array(words), lambda x: F.when(F.size(x) > 0, of(x))), 0)
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _repeating(F.col("text"), F.col("doc_id")).alias("text"))
    runs = F.col("__runs.runs")
    # Greatest length, then smallest start, then period.
    best = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = periodic_runs(docs).withColumn("b", best)
    return got.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("b.start").alias("start"), (-F.col("b.less")).alias("length"), F.col("b.period").alias("period"),
        F.floor(-F.col("b.less") * 1000 / F.col("b.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("__runs.collapsed"), 256).alias("collapsed_sha256"))
