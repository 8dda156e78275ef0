import math

import pytest
from pyspark.sql import functions as F

from conftest import DAY, HOUR, SF, T0, values
from txrisk.operators import features
from txrisk.operators.history import history_features
from txrisk.options import FeatureOptions
from txrisk.schemas import FEATURE_VECTOR
from txrisk.sources import adapters

PLAIN = FeatureOptions()
SPLIT = FeatureOptions(hot_rows=0, slice_rows=1)

SAME = {"transaction_id": "r", "amount": 5.0}
RESETS = [(0, {"country": "US"}), (1, {"country": "FR", "amount": 30.0}), (8 * DAY, {"country": "NG"}),
          (39 * DAY, {"country": "NG", "amount": 7.0}), (39 * DAY + 5, {"amount": 9.0})]

# one user per case: (rows as (seconds, own values), column, expected values in time order)
CASES = {
    "window is closed on both ends": ([(0, {}), (HOUR, {}), (HOUR + 0.000001, {})], "tx_count_1h", [1, 2, 2]),
    "sixth event counts six": ([(i, {}) for i in range(6)], "tx_count_1h", [1, 2, 3, 4, 5, 6]),
    "sums accumulate": ([(i, {}) for i in range(5)], "tx_sum_1h", [100.0, 200.0, 300.0, 400.0, 500.0]),
    "a day is the long window": ([(0, {}), (DAY, {}), (DAY + 1, {})], "tx_count_24h", [1, 2, 2]),
    "first event has z 0": ([(0, {"amount": 50.0})], "amount_zscore", [0.0]),
    "first event has no chargebacks": ([(0, {"label": 1})], "user_chargeback_rate", [0.0]),
    "deviation is at least one": (
        [(i, {"amount": a}) for i, a in enumerate([10.0, 10.0, 10.0, 10.5])], "amount_zscore", [0.0, 0.0, 0.0, 0.5]),
    "population deviation": (
        [(i, {"amount": a}) for i, a in enumerate([10.0, 20.0, 30.0, 50.0])], "amount_zscore",
        [0.0, 10.0, 3.0, 30 / math.sqrt(200 / 3)]),
    "rate excludes the row itself": (
        [(0, {"label": 1}), (1, {"label": 0}), (2, {"label": None})], "user_chargeback_rate", [0.0, 1.0, 0.5]),
    "missing flag counts as legit": (
        [(0, {"label": None}), (1, {"label": 1}), (2, {})], "user_chargeback_rate", [0.0, 0.0, 0.5]),
    "missing flag stays missing": ([(0, {"label": None}), (1, {"label": 1}), (2, {})], "label", [None, 1, 0]),
    "merchants reset after an idle day": (
        [(0, {"merchant_id": "m1"}), (10, {"merchant_id": "m2"}), (10 + 25 * HOUR, {"merchant_id": "m3"})],
        "unique_merchants_24h", {"ttl": [1, 2, 1], "sliding": [1, 2, 1]}),
    "a gap of exactly the expiry is no reset": (
        [(0, {"merchant_id": "m1"}), (DAY, {"merchant_id": "m2"}), (2 * DAY + 0.000001, {"merchant_id": "m3"})],
        "unique_merchants_24h", {"ttl": [1, 2, 1], "sliding": [1, 2, 1]}),
    "expiry is renewed by every event": (
        [(i * 20 * HOUR, {"merchant_id": f"m{i}"}) for i in range(4)],
        "unique_merchants_24h", {"ttl": [1, 2, 3, 4], "sliding": [1, 2, 2, 2]}),
    "seen before the gap is new again": (
        [(0, {"merchant_id": "a"}), (1, {"merchant_id": "b"}), (2 * DAY, {"merchant_id": "b"}),
         (2 * DAY + 1, {"merchant_id": "a"}), (2 * DAY + 2, {"merchant_id": "a"})],
        "unique_merchants_24h", [1, 2, 1, 2, 2]),
    "five merchants": ([(i, {"merchant_id": f"m{i}"}) for i in range(5)], "unique_merchants_24h", [1, 2, 3, 4, 5]),
    "countries reset after a week": (RESETS, "unique_countries_7d", [1, 2, 1, 1, 2]),
    "moments reset after a month": (RESETS, "prior_count", [0, 1, 2, 0, 1]),
    "z is 0 again after a month": (RESETS[2:], "amount_zscore", [0.0, 0.0, 2.0]),
    "ties count in order of id": ([(0, {}), (0, {})], "tx_count_1h", [1, 2]),
    "replays count once": (
        [(0, SAME), (60, SAME), (120, {"transaction_id": "r", "amount": 6.0}), (HOUR + 30, {"transaction_id": "s"})],
        "tx_count_1h", [1, 1, 2, 3]),
    "replays add once": (
        [(0, SAME), (60, SAME), (120, {"transaction_id": "r", "amount": 6.0}), (HOUR + 30, {"transaction_id": "s"})],
        "tx_sum_1h", [5.0, 5.0, 11.0, 111.0]),
    "replays are part of the moments": ([(0, SAME), (60, SAME), (120, {})], "prior_count", [0, 1, 2]),
    "replay at the same instant": ([(0, SAME), (0, SAME), (1, {})], "tx_count_1h", [1, 1, 2]),
    "a late row sees its own window": ([(0, {}), (1800, {}), (2 * HOUR, {})], "tx_count_1h", [1, 2, 1]),
    "amounts with many decimals": ([(0, {"amount": 0.1234567}), (1, {"amount": 0.2})], "tx_sum_1h", [0.1234567, 0.3234567]),
    "amounts that differ past the sixth decimal": ([(0, {"transaction_id": "f", "amount": 0.1}), (1, {"transaction_id": "f", "amount": 0.10000001})], "tx_count_1h", [1, 2]),
    "tiny and huge amounts": ([(0, {"amount": 1e-7}), (1, {"amount": 3e15}), (HOUR + 1, {"amount": 2.0})], "tx_sum_1h", [1e-7, 3e15, 3e15 + 2.0]),
}


@pytest.fixture(scope="module")
def answers(make_tx):
    """Per (split, mode): the rows of each case's user in time order."""
    parts = [make_tx(rows, user_id=name) for name, (rows, _, _) in CASES.items()]
    tx = parts[0]
    for part in parts[1:]:
        tx = tx.union(part)
    tx = tx.coalesce(2).persist()
    out = {}
    for split in (False, True):
        for mode in ("ttl", "sliding"):
            opts = FeatureOptions(distinct_mode=mode, hot_rows=0, slice_rows=1) if split else FeatureOptions(distinct_mode=mode)
            rows = features.with_amount_stats(features.history_features(tx, opts)).collect()
            for name in CASES:
                out[split, mode, name] = sorted((r for r in rows if r.user_id == name), key=lambda r: (r.ts_us, r.transaction_id))
    return out


@pytest.mark.parametrize("split", [False, True], ids=["plain", "split"])
@pytest.mark.parametrize("mode", ["ttl", "sliding"])
@pytest.mark.parametrize("name", list(CASES))
def test_case(answers, split, mode, name):
    _, column, expected = CASES[name]
    if isinstance(expected, dict):
        expected = expected[mode]
    got = [r[column] for r in answers[split, mode, name]]
    assert got == [pytest.approx(e) if isinstance(e, float) else e for e in expected]


def test_arrival_decides_ties(make_tx):
    tx = make_tx([(0, {}), (0, {})]).withColumn("arrival", F.when(F.col("transaction_id") == "t0000", 2).otherwise(1))
    for opts in (PLAIN, SPLIT):
        assert values(features.velocity_features(tx, opts, arrival="arrival"), "tx_count_1h") == [2, 1]


def test_calendar_and_log(make_tx):
    row = features.with_calendar(make_tx([(0, {"amount": 99.0})])).first()
    # 2023-11-14 22:13:20 UTC, a Tuesday
    assert (row.hour_of_day, row.day_of_week, row.is_weekend) == (22, 1, False)
    assert row.amount_log == pytest.approx(math.log1p(99.0))
    before_epoch = features.with_calendar(make_tx([(-T0 - 1, {})])).first()
    assert (before_epoch.hour_of_day, before_epoch.day_of_week) == (23, 2)


def test_merchant_rate_lookup(spark, make_tx):
    rates = spark.createDataFrame([("evil", 0.85)], "merchant_id string, fraud_rate double")
    tx = make_tx([(0, {"merchant_id": "evil"}), (1, {"merchant_id": "unknown"})])
    assert values(features.with_merchant_rate(tx, rates), "merchant_fraud_rate_30d") == [0.85, 0.0]


def test_rates_leave_out_merchants_without_recent_rows(make_tx):
    late = (adapters.RATES_UNTIL_US - T0 * 1_000_000) // 1_000_000
    tx = make_tx([(late - 3600, {"merchant_id": "recent", "label": 1}), (late - 31 * 86400, {"merchant_id": "old", "label": 1}),
                  (late + 60, {"merchant_id": "new", "label": 1})])
    rates = adapters.known_merchant_rates(tx)
    assert [(r.merchant_id, r.fraud_rate) for r in rates.collect()] == [("recent", 1.0)]
    assert values(features.with_merchant_rate(tx, rates), "merchant_fraud_rate_30d") == [1.0, 0.0, 0.0]


def test_vector_has_the_fixed_columns(make_tx):
    v = features.feature_vector(make_tx([(0, {"card_present": False})]))
    assert v.columns == FEATURE_VECTOR.names
    assert v.first().card_present is False


def test_merchant_rates_window(spark, make_tx):
    tx = make_tx([(0, {"label": 1}), (DAY, {"label": 0}), (40 * DAY, {"label": 1}), (40 * DAY + 1, {"label": None})])
    assert features.merchant_rates(tx).first().fraud_rate == pytest.approx(2 / 3)
    assert features.merchant_rates(tx, until_us=(T0 + 40 * DAY) * 1_000_000).count() == 0
    assert features.merchant_rates(tx, until_us=(T0 + 31 * DAY) * 1_000_000).first().fraud_rate == 0.0


@pytest.mark.parametrize("mode, hot, rows", [("ttl", 110, 7), ("sliding", 0, 1)])
def test_split_users_get_the_same_features(spark, mode, hot, rows):
    tx = adapters.transactions(adapters.read_events(spark, SF))
    # replay some rows, and leave idle gaps of every kind
    copies = tx.withColumn("ts_us", F.col("ts_us") + 1_200_000_000)
    shifted = tx.unionByName(copies).withColumn("ts_us", F.when(
        F.col("ts_us") > 1_705_000_000_000_000, F.col("ts_us") + F.lit(33 * DAY * 1_000_000)).otherwise(F.col("ts_us")))
    plain = features.feature_vector(shifted, opts=FeatureOptions(distinct_mode=mode))
    split = features.feature_vector(shifted, opts=FeatureOptions(distinct_mode=mode, hot_rows=hot, slice_rows=rows))
    key = ["transaction_id", "timestamp"]
    a = plain.toPandas().sort_values(key).reset_index(drop=True)
    b = split.toPandas().sort_values(key).reset_index(drop=True)
    assert a.equals(b)


def test_ordinary_users_take_one_shuffle(spark):
    tx = adapters.transactions(adapters.read_events(spark, SF))
    plan = features.feature_vector(tx)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tasks_hold_a_bounded_number_of_rows(spark):
    """The partitions of the history grow in number with the rows, also where users are split."""
    tx = spark.range(4_000).select(
        F.col("id").cast("string").alias("transaction_id"), F.concat(F.lit("u"), F.col("id") % 40).alias("user_id"),
        F.concat(F.lit("m"), F.col("id") % 7).alias("merchant_id"), F.lit("C1").alias("country"), F.lit(1.5).alias("amount"),
        (F.col("id") * 60_000_000).alias("ts_us"), F.lit(0).alias("label"))
    whole = {r.transaction_id: r for r in history_features(tx, FeatureOptions()).collect()}
    for opts in (FeatureOptions(task_rows=100), FeatureOptions(task_rows=100, hot_rows=50, slice_rows=10)):
        found = history_features(tx, opts)
        assert found.rdd.getNumPartitions() >= 40
        assert {r.transaction_id: r for r in found.collect()} == whole
