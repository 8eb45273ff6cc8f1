"""The stateful shadow filter takes the records of a micro-batch as columns: against records one by one, with repeats."""

import random

import pandas as pd
from logweave.streaming.shadows import _Shadow


class _Value:
    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def _one_by_one(state, rows):
    (seq, use, active), gone, out = state or (-1, False, False), False, []
    for at, turn in sorted(rows, key=lambda r: (r[0], r[1] is None)):
        if (at, turn is None) <= (seq, use):
            continue
        seq, use = at, turn is None
        if not use:
            active, gone = turn == "ON", turn == "GONE"
        elif not active:
            out.append(at)
    return None if gone else (seq, use, active), out


def test_columns_are_records_one_by_one():
    rng = random.Random(7)
    for _ in range(300):
        kept, want = _Value(), None
        shadow = _Shadow()
        shadow.init(kept)
        for number in range(4):
            turns = {at: rng.choice(["ON", "OFF", "GONE"]) for at in range(number * 5, number * 5 + 8)}
            rows = [(at, rng.choice([None, None, turns[at]])) for at in rng.choices(list(turns), k=rng.randint(1, 12))]
            frames = [pd.DataFrame(part, columns=["commit_seq", "turn"]).astype({"turn": object}) for part in (rows[:5], rows[5:]) if part]
            got = [int(x) for d in shadow.handleInputRows((1,), iter(frames), None) for x in d["commit_seq"]]
            before, (want, out) = want, _one_by_one(want, rows)
            assert got == out and kept.value == (want if out or want != before else before)
