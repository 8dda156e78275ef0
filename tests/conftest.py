import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from txrisk.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
HOUR, DAY = 3600, 86400
T0 = 1_700_000_000


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tx(spark):
    """Transactions from (seconds after T0, overrides) pairs; ids follow the order of the list."""
    def build(rows, **common):
        data = []
        for i, (seconds, own) in enumerate(rows):
            base = dict(transaction_id=f"t{i:04d}", user_id="u1", merchant_id="m1", amount=100.0, country="US",
                        card_present=True, merchant_category="retail", label=0, currency="USD", device_fingerprint=None)
            base.update(common)
            base.update(own)
            base["ts_us"] = round((T0 + seconds) * 1_000_000)
            base["timestamp"] = base["ts_us"] / 1e6
            data.append(tuple(base[c] for c in TX_COLS))
        return spark.createDataFrame(data, TX_SCHEMA)
    return build


TX_SCHEMA = ("transaction_id string, user_id string, merchant_id string, amount double, currency string, timestamp double, "
             "ts_us bigint, merchant_category string, country string, card_present boolean, device_fingerprint string, label int")
TX_COLS = [c.split()[0] for c in TX_SCHEMA.split(", ")]


def values(df, column, order="transaction_id"):
    return [r[column] for r in df.orderBy(order).collect()]
