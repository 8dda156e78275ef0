"""How the stream's state keeps a user's rows: as one entry while they are few, then by bucket."""

import numpy as np
import pandas as pd
import pytest

from txrisk.options import FeatureOptions
from txrisk.streaming import history as H


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Entries(dict):
    def getValue(self, key):
        return self.get(key)

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Entries()


def rows_of(n):
    draw = np.random.default_rng(3)
    ts = np.sort(draw.integers(0, 12 * 86_400, n)) * 1_000_000  # ties, and replays of an id and amount
    return pd.DataFrame({
        "transaction_id": [f"t{i % (n - n // 10)}" for i in range(n)], "user_id": "u", "merchant_id": [f"m{i % 9}" for i in range(n)],
        "country": [f"C{i % 4}" for i in range(n)], "amount": [float(i % (n - n // 10) % 50) for i in range(n)], "ts_us": ts, "label": draw.integers(0, 2, n)})


def answered(rows, cuts):
    user = H.HistoryProcessor(FeatureOptions(), list(rows.columns), ["ts_us", "transaction_id"], 3600, 7 * 86_400, None)
    user.init(Handle())
    out = [next(user.handleInputRows(("u",), iter([part]), None)) for part in (rows.iloc[a:b].reset_index(drop=True) for a, b in zip([0, *cuts], [*cuts, len(rows)]))]
    return user, pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("n, entries", [(60, 1), (2000, 100)])
def test_rows_as_one_entry_or_by_bucket(monkeypatch, n, entries):
    rows = rows_of(n)
    cuts = [n // 5, n // 2, n // 2 + 1]
    user, found = answered(rows, cuts)
    assert len(user.rows) == 1 if entries == 1 else len(user.rows) >= entries
    monkeypatch.setattr(H, "TOGETHER", -1)
    by_bucket, want = answered(rows, cuts)
    assert len(by_bucket.rows) > 1
    pd.testing.assert_frame_equal(found, want)
