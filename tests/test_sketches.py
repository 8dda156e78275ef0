import random

import pytest
from pyspark.sql import functions as F

from conftest import DAY, HOUR
from txrisk.operators import features, metrics, sketches
from txrisk.options import FeatureOptions

HLL = FeatureOptions(distinct_mode="hll")


def test_few_members_are_exact(make_tx):
    """Slices of an hour and a day: the window is the row's slice up to the row and the slices before it."""
    rng = random.Random(2)
    rows = [(rng.randint(0, 9 * DAY), {"merchant_id": rng.choice("abcdefgh"), "country": rng.choice(["A", "B", "C", None])}) for _ in range(150)]
    got = features.distinct_features(make_tx(rows), HLL).collect()
    mine = sorted(got, key=lambda r: (r.ts_us, r.transaction_id))
    for i, r in enumerate(mine):
        seen = mine[:i + 1]
        hour, day = r.ts_us // (HOUR * 10**6), r.ts_us // (DAY * 10**6)
        merchants = {p.merchant_id for p in seen if p.ts_us // (HOUR * 10**6) > hour - 24}
        countries = {p.country for p in seen if p.ts_us // (DAY * 10**6) > day - 7} - {None}
        assert (r.unique_merchants_24h, r.unique_countries_7d) == (len(merchants), len(countries))


def test_many_members_are_within_the_bound(spark):
    tx = spark.range(60_000).select(
        F.lit("u").alias("user_id"), F.col("id").cast("string").alias("transaction_id"), F.expr("id * 20000000 div 60").alias("ts_us"),
        (F.col("id") * 7919 % 20_011).cast("string").alias("merchant_id"))
    got = sketches.with_distinct_estimate(tx, "n", "merchant_id", 86400, 3600).filter("transaction_id % 997 = 0").collect()
    for r in got:
        exact = min(int(r.transaction_id) + 1, 20_011)
        assert abs(r.n - exact) <= 3 * 1.04 / 64 * exact + 1


def test_sketches_of_parts_merge(spark):
    rng = random.Random(5)
    rows = [(i % 3, rng.lognormvariate(2, 1) if i % 50 else None, i % 10 != 0) for i in range(20_000)]
    log = spark.createDataFrame(rows, "day int, latency_ms double, ok boolean")
    parts = [sketches.latency_sketches(log.filter(F.col("day") == d), [], F.col("day")) for d in range(3)]
    merged = sketches.merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), [])
    errors = sketches.quantile_errors(log, merged, []).collect()
    assert len(errors) == 4 and all(r.rank_error <= sketches.RANK_ERROR for r in errors)
    exact, about = metrics.latency_summary(log, []).first(), sketches.sketch_summary(merged, []).first()
    assert exact.__fields__ == about.__fields__
    assert (about.requests_ok, about.errors, about.max_ms, about.mean_ms) == (exact.requests_ok, exact.errors, exact.max_ms, exact.mean_ms)


def test_empty_and_null_latencies(spark):
    none = spark.createDataFrame([(1, None, True)], "day int, latency_ms double, ok boolean")
    r = sketches.sketch_summary(sketches.merged_sketches(sketches.latency_sketches(none, ["day"], F.lit(0)), ["day"]), ["day"]).first()
    assert (r.requests_ok, r.p50_ms, r.mean_ms) == (1, None, None)
    assert sketches.latency_sketches(none.limit(0), ["day"], F.lit(0)).count() == 0


def test_summary_file(spark, tmp_path):
    log = spark.createDataFrame([(float(i), True) for i in range(100)], "latency_ms double, ok boolean")
    metrics.write_summary(metrics.latency_summary(log, []), str(tmp_path / "s"))
    lines = spark.read.text(str(tmp_path / "s")).collect()
    assert [x.value for x in lines] == ['{"requests_ok":100,"errors":0,"mean_ms":49.5,"p50_ms":49.5,"p95_ms":94.05,"p99_ms":98.01,'
                                       '"p99_9_ms":98.9,"max_ms":99.0,"pass_p99_le_50ms":false}']
    assert spark.read.json(str(tmp_path / "s")).first().p95_ms == pytest.approx(94.05)
