import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import DAY, HOUR, SF, values
from test_training import SMALL
from txrisk.operators import features, ingest, training
from txrisk.options import FeatureOptions, MonitorOptions
from txrisk.sources import adapters, tables
from txrisk.streaming import queries as Q
from txrisk.streaming import reports as R
from txrisk.streaming.history import history_stream


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    Q.use_rocksdb(spark)


def put(df, folder):
    """One more input file; files are read in order of their time."""
    df.coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(1.1)


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


@pytest.fixture(scope="module")
def pipeline(spark, tmp_path_factory):
    """Messages in two files through the feature query, which is stopped and restarted in between."""
    d = tmp_path_factory.mktemp("live")
    raw = adapters.raw_messages(adapters.read_events(spark, SF))
    rates = adapters.known_merchant_rates(adapters.transactions(adapters.read_events(spark, SF)))
    for part in ("offset < 600", "offset >= 600"):
        put(raw.filter(part), d / "in")
        stream = Q.feature_stream(tables.message_stream(spark, str(d / "in")), rates)
        run(Q.write_features(stream, str(d / "features"), str(d / "ck_features")))
    return d, raw, rates


def test_stream_equals_batch_across_a_restart(spark, pipeline):
    d, raw, rates = pipeline
    got = spark.read.parquet(str(d / "features")).toPandas().sort_values("transaction_id").reset_index(drop=True)
    batch = features.feature_vector(ingest.good_transactions(ingest.parse_messages(raw)), rates)
    want = batch.toPandas().sort_values("transaction_id").reset_index(drop=True)
    assert got.equals(want)


def test_dead_letters_and_counters(spark, pipeline):
    d, raw, _ = pipeline
    q = run(Q.write_dead_letters(tables.message_stream(spark, str(d / "in"), 10), str(d / "dlq"), str(d / "ck_dlq")))
    letters = spark.read.parquet(str(d / "dlq"))
    want = ingest.dead_letters(ingest.parse_messages(raw))
    assert values(letters, "offset", "offset") == values(want, "offset", "offset")
    seen = [p.observedMetrics["ingest"] for p in q.recentProgress if "ingest" in p.observedMetrics]
    assert sum(m.messages for m in seen) == 1000
    assert sum(m.failed_deserialize + m.failed_transform for m in seen) == letters.count()


def test_scoring_and_reports(spark, pipeline, tmp_path):
    d, _, _ = pipeline
    runs, models = str(tmp_path / "runs"), str(tmp_path / "models")
    vectors = spark.read.parquet(str(d / "features"))
    version = training.train(vectors, runs, models, SMALL)
    stream = Q.read_features(spark, str(d / "features"))
    run(Q.write_predictions(stream, runs, "fraud-detector", str(d / "predictions"), str(d / "ck_predictions")))
    stored = Q.read_predictions(spark, str(d / "predictions"))
    assert stored.count() == vectors.count()
    assert {r.model_version for r in stored.select("model_version").distinct().collect()} == {version}

    vectors.write.parquet(str(d / "reference.parquet"))
    baseline = tables.read_baseline(spark, str(d / "reference.parquet"))
    reports = str(d / "reports")
    run(Q.write_reports(Q.read_features(spark, str(d / "features")), baseline, str(d / "predictions"), reports, str(d / "ck_reports"),
                        MonitorOptions(drift_share=0.5, report_interval_s=0)))
    report = R.read_reports(spark, reports).first()
    assert (report.buffer_size, report.prediction_misses, report.n_columns, report.n_drifted) == (vectors.count(), 0, 15, 0)
    assert (report.drift_share_threshold, report.dataset_drift) == (0.5, False)
    assert R.read_reports(spark, reports, "data_quality").count() == 30
    quality = {r.frame: r for r in R.read_reports(spark, reports, "classification_quality").collect()}
    assert quality["reference"].roc_auc == 1.0 and quality["current"].rows == vectors.count()


def test_scoring_without_a_champion_fails(spark, pipeline, tmp_path):
    d, _, _ = pipeline
    spark.createDataFrame([], training.MODEL_RUN).write.parquet(str(tmp_path / "runs"))
    q = Q.write_predictions(Q.read_features(spark, str(d / "features")), str(tmp_path / "runs"), "fraud-detector",
                            str(tmp_path / "out"), str(tmp_path / "ck"))
    with pytest.raises(Exception, match="Model not loaded"):
        q.awaitTermination()


def test_corrupt_feature_events_are_dropped(spark):
    raw = spark.createDataFrame([(b"{",), (b'{"transaction_id":"a"}',)], "value binary")
    assert values(Q.usable_events(raw), "transaction_id") == ["a"]


# per user: (rows as (seconds, own values), column, values in order of arrival)
CASES = {
    "late row": ([(0, {}), (2 * HOUR, {}), (1800, {})], "tx_count_1h", [1, 1, 2]),
    "late row does not revise": ([(0, {}), (2 * HOUR, {}), (1800, {}), (2 * HOUR + 1, {})], "tx_count_24h", [1, 2, 2, 4]),
    "late row is no new session": (
        [(0, {"merchant_id": "a"}), (30 * HOUR, {"merchant_id": "b"}), (2 * HOUR, {"merchant_id": "c"})],
        "unique_merchants_24h", [1, 1, 2]),
    "moments take rows as they arrive": ([(100, {"amount": 1.0}), (0, {"amount": 2.0}), (200, {})], "prior_sum", [0.0, 1.0, 3.0]),
    "ties": ([(0, {}), (0, {})], "tx_count_1h", [1, 2]),
    "replay": ([(0, {"transaction_id": "r"}), (60, {"transaction_id": "r"}), (90, {})], "tx_count_1h", [1, 1, 2]),
    "replay after the window": ([(0, {"transaction_id": "r"}), (2 * HOUR, {"transaction_id": "r"}), (2 * HOUR + 1, {})], "tx_count_24h", [1, 1, 2]),
    "idle day": ([(0, {"merchant_id": "a"}), (10, {"merchant_id": "b"}), (10 + 25 * HOUR, {"merchant_id": "c"})], "unique_merchants_24h", [1, 2, 1]),
    "idle month": ([(0, {}), (1, {"label": 1}), (40 * DAY, {}), (40 * DAY + 1, {})], "prior_count", [0, 1, 0, 1]),
    "old buckets are dropped": ([(i * DAY, {}) for i in range(12)], "tx_count_24h", [1] + [2] * 11),
    "edge": ([(0, {}), (HOUR, {}), (HOUR + 0.000001, {})], "tx_count_1h", [1, 2, 2]),
}


@pytest.mark.parametrize("bucket_s", [60, 3600])
def test_stream_state(spark, make_tx, tmp_path, bucket_s):
    """Each user's rows arrive one after the other, the last ones in a second micro-batch."""
    parts = [make_tx(rows, user_id=name).withColumn("offset", F.monotonically_increasing_id()) for name, (rows, _, _) in CASES.items()]
    for first in (True, False):
        for part in parts:
            n = part.count()
            part = part.orderBy("offset").coalesce(1).withColumn("offset", F.monotonically_increasing_id())
            part.filter((F.col("offset") < n - 1) if first else (F.col("offset") == n - 1)).coalesce(1).write.mode("append").parquet(
                str(tmp_path / ("a" if first else "b")))
    for sub in ("a", "b"):
        put(spark.read.parquet(str(tmp_path / sub)), tmp_path / "in")
        tx = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run(Q._to_files(history_stream(tx, FeatureOptions(), ("offset",), bucket_s), str(tmp_path / "out"), str(tmp_path / "ck"), {}))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    for name, (_, column, expected) in CASES.items():
        mine = sorted((r for r in rows if r.user_id == name), key=lambda r: r.offset)
        assert [r[column] for r in mine] == expected, name


def disordered(make_tx, seed, n=120):
    """One user's rows in an order of arrival that is not that of time, with replays and repeated times."""
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 60, 1800, 6 * HOUR, 26 * HOUR]) if rng.random() < 0.8 else -rng.choice([30, HOUR, 30 * HOUR])
        own = {"merchant_id": rng.choice("abcd"), "country": rng.choice("XYZ"), "amount": rng.choice([1.1, 2.25, 1e13, 0.1]), "label": rng.choice([0, 1, None])}
        if rng.random() < 0.15 and rows:
            own["transaction_id"], own["amount"] = f"t{rng.randrange(i):04d}", rng.choice([1.1, 2.25])
        rows.append((at, own))
    return make_tx(rows).withColumn("offset", F.monotonically_increasing_id()).coalesce(1)


def in_turn(rows, retention=7 * DAY):
    """The windows row by row, as the rows arrive."""
    out, held, last = [], {}, None
    for r in rows:
        last = r.ts_us if last is None else max(last, r.ts_us)
        held[(r.transaction_id, r.amount)] = r.ts_us
        own = [(a, t) for (_, a), t in held.items() if t > last - retention * 10**6]
        out.append([sum(r.ts_us - w * 10**6 <= t <= r.ts_us for _, t in own) for w in (HOUR, DAY)]
                   + [sum(a for a, t in own if r.ts_us - w * 10**6 <= t <= r.ts_us) for w in (HOUR, DAY)])
    return out


@pytest.mark.parametrize("seed, batches", [(1, 1), (3, 3)])
def test_disordered_rows_against_a_plain_loop(spark, make_tx, tmp_path, seed, batches):
    tx = disordered(make_tx, seed)
    n = tx.count()
    for i in range(batches):
        lo, hi = n * i // batches, n * (i + 1) // batches
        put(tx.filter(F.col("offset").between(lo, hi - 1)), tmp_path / "in")
        stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run(Q._to_files(history_stream(stream, FeatureOptions(), ("offset",), 3600), str(tmp_path / "out"), str(tmp_path / "ck"), {}))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("offset").collect()
    want = in_turn(tx.orderBy("offset").collect())
    for r, (n1, n24, u1, u24) in zip(got, want):
        assert (r.tx_count_1h, r.tx_count_24h) == (n1, n24)
        assert r.tx_sum_1h == pytest.approx(u1) and r.tx_sum_24h == pytest.approx(u24)


def test_a_stream_starts_from_a_table(spark, make_tx, tmp_path):
    """Past rows as initial state, the later ones from the stream: the same rows as the batch."""
    rng = random.Random(8)
    tx = make_tx([(3 * i * 700, {"user_id": rng.choice("uvw"), "merchant_id": rng.choice("abcdef"), "amount": rng.randint(1, 999) / 100})
                  for i in range(150)]).withColumn("offset", F.col("ts_us")).coalesce(1)
    cut = tx.approxQuantile("ts_us", [0.6], 0.0)[0]
    late, past = tx.filter(F.col("ts_us") > cut), tx.filter(F.col("ts_us") <= cut)
    put(late, tmp_path / "in")
    stream = spark.readStream.schema(tx.schema).parquet(str(tmp_path / "in"))
    run(Q._to_files(history_stream(stream, order=("offset",), past=past), str(tmp_path / "out"), str(tmp_path / "ck"), {}))
    names = ["transaction_id", "tx_count_1h", "tx_sum_24h", "unique_merchants_24h", "unique_countries_7d", "prior_count", "prior_sum"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*names).orderBy("transaction_id").collect()
    want = features.history_features(tx).filter(F.col("ts_us") > cut).select(*names).orderBy("transaction_id").collect()
    assert got == want and len(got) == 60


def test_many_members_of_one_user(spark, make_tx, tmp_path):
    """More merchants and transactions than one part of a hashed map holds, in three micro-batches."""
    tx = make_tx([(i * 40, {"merchant_id": f"m{i * 7 % 1900}"}) for i in range(2400)]).withColumn("offset", F.col("ts_us")).coalesce(1)
    for i in range(3):
        put(tx.filter(F.substring("transaction_id", 2, 4).cast("int").between(800 * i, 800 * i + 799)), tmp_path / "in")
        stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run(Q._to_files(history_stream(stream, order=("offset",)), str(tmp_path / "out"), str(tmp_path / "ck"), {}))
    names = ["transaction_id", "tx_count_24h", "unique_merchants_24h", "prior_count"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*names).orderBy("transaction_id").collect()
    assert got == features.history_features(tx).select(*names).orderBy("transaction_id").collect()


def test_repeated_ids_can_be_dropped(spark, make_tx, tmp_path):
    tx = make_tx([(0, {"transaction_id": "a"}), (60, {"transaction_id": "a"}), (70, {"transaction_id": "b"})])
    tx.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tx.schema).parquet(str(tmp_path / "in"))
    run(Q._to_files(Q.without_replays(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"), {}))
    assert values(spark.read.parquet(str(tmp_path / "out")), "transaction_id") == ["a", "b"]


def test_topic_options():
    assert tables.topic_sink("t")["kafka.compression.type"] == "snappy"


def test_monitor_limits():
    assert tables.monitor_limits(None) == {}
    assert tables.monitor_limits(MonitorOptions()) == {
        "minOffsetsPerTrigger": "100", "maxTriggerDelay": "300s", "maxOffsetsPerTrigger": "2000"}
