"""Tables that are published together, the report queue, and what survives a stop in between."""

from datetime import datetime, timedelta, timezone
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF, values
from test_streaming import put, run
from txrisk.operators import drift, features, ingest, scoring
from txrisk.options import MonitorOptions
from txrisk.plans import catalog
from txrisk.schemas import FEATURE_VECTOR, PREDICTION
from txrisk.sources import adapters, tables
from txrisk.streaming import batches, counters
from txrisk.streaming import queries as Q
from txrisk.streaming import reports as R
from txrisk.streaming import routing

NOW = datetime(2024, 6, 1, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    Q.use_rocksdb(spark)


@pytest.fixture(scope="module")
def raw(spark):
    return adapters.raw_messages(adapters.read_events(spark, SF))


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    features.feature_vector(adapters.transactions(adapters.read_events(spark, SF))).write.parquet(path)
    return spark.read.parquet(path)


def failing_after(monkeypatch, table):
    """The next write after that of `table` fails, as if the driver had died there."""
    write = tables.write_batch
    seen = []

    def cut(df, path, batch_id):
        if seen:
            raise RuntimeError("killed")
        write(df, path, batch_id)
        if path.endswith(table):
            seen.append(path)

    monkeypatch.setattr(batches, "write_batch", cut)


@pytest.mark.parametrize("table", ["good", "counters"])
def test_a_killed_batch_leaves_no_half(spark, raw, tmp_path, monkeypatch, table):
    d = {n: str(tmp_path / n) for n in ("in", "out", "ck")}
    put(raw.filter("offset < 600"), d["in"])
    run(routing.route_messages(tables.message_stream(spark, d["in"]), d["out"], d["ck"]))
    put(raw.filter("offset >= 600"), d["in"])
    with monkeypatch.context() as m:
        failing_after(m, table)
        with pytest.raises(Exception, match="killed"):
            routing.route_messages(tables.message_stream(spark, d["in"]), d["out"], d["ck"]).awaitTermination()
    early = ingest.parse_messages(raw.filter("offset < 600"))
    every = ingest.parse_messages(raw)
    for parsed in (early, every):
        got = {t: routing.read_routed(spark, d["out"], t) for t in routing.TABLES}
        assert values(got["good"], "offset", "offset") == values(ingest.good_transactions(parsed), "offset", "offset")
        assert values(got["dead_letters"], "offset", "offset") == values(ingest.dead_letters(parsed), "offset", "offset")
        sums = got["counters"].groupBy("stage").agg(F.sum("messages").alias("messages"))
        assert {tuple(r) for r in sums.collect()} == {tuple(r) for r in ingest.stage_counts(parsed).collect()}
        if parsed is early:
            run(routing.route_messages(tables.message_stream(spark, d["in"]), d["out"], d["ck"]))


def test_a_published_batch_is_not_written_again(spark, raw, tmp_path):
    """The checkpoint is behind: the batch comes again, after its mark."""
    d = {n: str(tmp_path / n) for n in ("in", "out", "ck", "ck2")}
    put(raw, d["in"])
    for ck in ("ck", "ck2"):
        run(routing.route_messages(tables.message_stream(spark, d["in"]), d["out"], d[ck]))
        instants = values(routing.read_routed(spark, d["out"], "dead_letters").select("ts_utc").distinct(), "ts_utc", "ts_utc")
        assert len(instants) == 1 and (ck == "ck" or instants == first)
        first = instants
    assert routing.read_routed(spark, d["out"], "counters").agg(F.sum("messages")).first()[0] == 1000


def test_nothing_published_is_an_empty_table(spark, tmp_path):
    assert routing.read_routed(spark, str(tmp_path / "none"), "good").count() == 0


# --- report queue -------------------------------------------------------------------------------

@pytest.fixture
def queue(spark, vectors, tmp_path):
    """A queue over feature rows with more ids than the table has, and a store without predictions."""
    folder = str(tmp_path / "reports")
    R.store_baseline(drift.baseline_with_prediction(vectors), folder)
    many = vectors.crossJoin(spark.range(5).withColumnRenamed("id", "copy")).withColumn(
        "transaction_id", F.concat("transaction_id", F.lit("_"), "copy")).select(*FEATURE_VECTOR.names)
    return folder, many.orderBy("timestamp", "transaction_id"), spark.createDataFrame([], PREDICTION)


def test_thresholds(spark, queue):
    folder, many, store = queue
    opts = MonitorOptions()
    start = R.queue_state(spark, folder).last_report
    R.append_features(many.limit(99), 0, folder)
    assert R.write_due_reports(spark, folder, store, start + timedelta(seconds=301), opts) == 0
    R.append_features(many.offset(99).limit(1), 1, folder)
    assert R.write_due_reports(spark, folder, store, start + timedelta(seconds=299), opts) == 0
    assert R.write_due_reports(spark, folder, store, start + timedelta(seconds=301), opts) == 1
    assert R.write_due_reports(spark, folder, store, start + timedelta(seconds=700), opts) == 0
    report = R.read_reports(spark, folder).first()
    assert (report.buffer_size, report.prediction_misses, report.rows_waiting) == (100, 100, 0)


def test_many_rows_at_once(spark, queue):
    folder, many, store = queue
    R.append_features(many.limit(4500), 0, folder)
    state = R.queue_state(spark, folder)
    assert state.slices(state.last_report, MonitorOptions()) == [(0, 2000), (2000, 4000)]
    assert R.write_due_reports(spark, folder, store, state.last_report, MonitorOptions()) == 2
    left = R.queue_state(spark, folder)
    assert (left.rows - left.read, left.reports) == (500, 2)
    # the slices are those of the batch operator
    rows = many.limit(4500).withColumns({"source": F.lit("s"), "at": F.floor(F.col("timestamp") * 1e6).cast("bigint")})
    want = {r.transaction_id: r.report_id for r in drift.report_slices(rows, "source", "at", "transaction_id").collect()}
    got = {r.transaction_id: r.place // 2000 for r in R.queued(spark, folder).collect()}
    assert got == want


def test_batches_queue_up_in_order(spark, queue):
    folder, many, _ = queue
    for batch_id, (skip, n) in enumerate([(0, 7), (7, 0), (7, 5)]):
        R.append_features(many.offset(skip).limit(n), batch_id, folder)
        R.append_features(many.offset(skip).limit(n), batch_id, folder)
    assert values(R.queued(spark, folder), "transaction_id", "place") == values(many.limit(12), "transaction_id", "timestamp")


def test_a_failed_report_is_made_again(spark, queue, monkeypatch):
    folder, many, store = queue
    opts = MonitorOptions(batch_size=80)
    R.append_features(many.limit(120), 0, folder)
    with monkeypatch.context() as m:
        failing_after(m, "/drift_reports")
        with pytest.raises(RuntimeError, match="killed"):
            R.write_due_reports(spark, folder, store, NOW, opts)
    state = R.queue_state(spark, folder)
    assert (state.reports, state.read) == (0, 0)
    R.append_features(many.offset(120).limit(40), 1, folder)
    assert R.write_due_reports(spark, folder, store, NOW, opts) == 2
    reports = R.read_reports(spark, folder).orderBy("report_id").collect()
    assert [(r.report_id, r.buffer_size) for r in reports] == [(0, 80), (1, 80)]
    assert R.read_reports(spark, folder, "drift_columns").count() == 2 * 15


def test_reports_do_not_scan_the_baseline(spark, queue, vectors):
    folder, many, store = queue
    R.append_features(many.limit(60), 0, folder)
    R.write_due_reports(spark, folder, store, NOW, MonitorOptions(batch_size=60))
    direct = drift.drift_columns(vectors, many.limit(60))
    got = R.read_reports(spark, folder, "drift_columns")
    columns = ["column", "method", "drifted", "n_ref", "n_cur"]
    assert {tuple(r) for r in got.select(*columns).collect()} == {tuple(r) for r in direct.select(*columns).collect()}
    assert values(got.select("column", F.round("score", 9).alias("s")), "s", "column") == values(direct.select("column", F.round("score", 9).alias("s")), "s", "column")
    stored = R._baseline(spark, folder)[0]
    assert all("/baseline/profile/" in f for f in drift.drift_columns(stored, stored).inputFiles())


def test_feature_messages_to_report(spark, vectors, tmp_path):
    """100 feature messages and three corrupt ones."""
    d = {n: str(tmp_path / n) for n in ("in", "reports", "ck")}
    R.store_baseline(drift.baseline_with_prediction(vectors), d["reports"])
    good = ingest.feature_messages(vectors.limit(100)).select(F.col("value").cast("binary").alias("value"))
    bad = spark.createDataFrame([(b"{",), (b"",), (b'{"amount": "x',)], "value binary")
    put(good.unionByName(bad), d["in"])
    stream = spark.readStream.schema("value binary").parquet(d["in"])
    run(R.buffer_feature_messages(stream, d["reports"], d["ck"]))
    store = vectors.limit(40).select("transaction_id", F.lit(0.5).alias("probability"), F.lit("REVIEW").alias("decision"),
                                     F.lit("v").alias("model_version"), F.lit(NOW).alias("scored_at"))
    assert R.write_due_reports(spark, d["reports"], store, NOW, MonitorOptions(batch_size=100)) == 1
    report = R.read_reports(spark, d["reports"]).first()
    assert (report.buffer_size, report.corrupt_events, report.prediction_misses) == (100, 3, 60)
    # the next report counts only what came since
    put(good, d["in"])
    run(R.buffer_feature_messages(spark.readStream.schema("value binary").parquet(d["in"]), d["reports"], d["ck"]))
    R.write_due_reports(spark, d["reports"], store, NOW, MonitorOptions(batch_size=100))
    assert values(R.read_reports(spark, d["reports"]), "corrupt_events", "report_id") == [3, 0]


def test_clock(spark, queue, tmp_path):
    """Reports are made without new rows."""
    folder, many, store = queue
    R.append_features(many.limit(150), 0, folder)
    q = R.report_clock(spark, folder, many, lambda now: store, str(tmp_path / "ck"), MonitorOptions(report_interval_s=1), every="1 second")
    try:
        for _ in range(60):
            if R.queue_state(spark, folder).reports:
                break
            time.sleep(1)
        assert q.exception() is None
    finally:
        q.stop()
    assert R.queue_state(spark, folder).read == 150


# --- store, counters, predictions in time ---------------------------------------------------------

def test_a_retry_in_a_later_hour_stores_once(spark, vectors, tmp_path, monkeypatch):
    """The batch fails after its predictions are written, and is tried again an hour later."""
    d = {n: str(tmp_path / n) for n in ("in", "p", "ck")}
    put(vectors, d["in"])
    monkeypatch.setattr(scoring, "load_champion", lambda *a: (object(), "v", ""))
    monkeypatch.setattr(scoring, "score", lambda rows, *a: rows.select(
        "transaction_id", F.lit(0.1).alias("probability"), F.lit("APPROVE").alias("decision"), F.lit("v").alias("model_version")))
    hour = [0]

    class Clock(datetime):
        @classmethod
        def now(cls, tz=None):
            return datetime.now(tz) + timedelta(hours=hour[0])

    monkeypatch.setattr(batches, "datetime", Clock)
    write = tables.write_batch

    def fail_on_rejects(df, path, batch_id):
        if path.endswith("_rejects") and hour[0] == 0:
            raise RuntimeError("killed")
        write(df, path, batch_id)

    monkeypatch.setattr(Q, "write_batch", fail_on_rejects)
    with pytest.raises(Exception, match="killed"):
        Q.write_predictions(Q.read_features(spark, d["in"]), "", "m", d["p"], d["ck"]).awaitTermination()
    hour[0] = 1
    run(Q.write_predictions(Q.read_features(spark, d["in"]), "", "m", d["p"], d["ck"]))
    stored = Q.read_predictions(spark, d["p"])
    assert stored.count() == vectors.count() == stored.select("transaction_id").distinct().count()


def test_counters_survive_a_restart(spark, raw, tmp_path):
    d = {n: str(tmp_path / n) for n in ("in", "out", "ck", "log")}
    log = counters.CounterLog(spark, d["log"])
    spark.streams.addListener(log)
    try:
        for part in ("offset < 600", "offset >= 600"):
            put(raw.filter(part), d["in"])
            run(Q.write_dead_letters(tables.message_stream(spark, d["in"]), d["out"], d["ck"]))
        want = {r.stage: r.messages for r in ingest.stage_counts(ingest.parse_messages(raw)).collect()}
        for _ in range(60):
            try:
                got = {r.metric: r.total for r in counters.counter_totals(counters.read_counters(spark, d["log"])).collect()}
            except Exception:
                got = {}
            if got.get("messages") == 1000:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    assert got == {"messages": 1000, "processed": want["processed"], "failed_deserialize": want["deserialize"], "failed_transform": want["transform"]}
    rows = counters.read_counters(spark, d["log"])
    assert rows.select("query_id").distinct().count() == 1 and rows.select("batch_id").distinct().count() == 2


def test_predictions_join_on_a_stream(spark, tmp_path):
    """Equal to the batch join once both sides end; a prediction that is too old, too late or of another id is a miss."""
    d = {n: tmp_path / n for n in ("f", "p", "out", "ck")}
    t = 1_700_000_000
    cases = {"early": [-30], "in time": [60], "at the wait": [300], "too late": [301], "at the end of life": [300 - 3600], "expired": [299 - 3600],
             "two": [10, 200], "none": []}
    end = [("end", t + 100_000)]
    rows = [(name, "u", float(s), 0) for name, s in [*[(c, t) for c in cases], *end]]
    feats = spark.createDataFrame(rows, "transaction_id string, user_id string, timestamp double, label int")
    preds = [(n, 0.1 * (i + 1), "APPROVE", "v", datetime.fromtimestamp(t + s, timezone.utc)) for n, ss in cases.items() for i, s in enumerate(ss)]
    store = spark.createDataFrame([*preds, ("end", 0.5, "APPROVE", "v", datetime.fromtimestamp(t + 100_000, timezone.utc))], PREDICTION)
    wide = feats.withColumns({f.name: F.lit(None).cast(f.dataType) for f in FEATURE_VECTOR.fields if f.name not in feats.columns}).select(*FEATURE_VECTOR.names)

    def step():
        both = Q.match_predictions(Q.read_features(spark, str(d["f"])), Q.read_prediction_stream(spark, str(d["p"])), 300)
        run(both.writeStream.format("parquet").option("path", str(d["out"])).option("checkpointLocation", str(d["ck"])).trigger(availableNow=True).start())

    put(wide.filter("transaction_id <> 'end'"), d["f"])
    put(store.filter("transaction_id <> 'end'"), d["p"])
    step()
    # a later pair moves the watermarks, and one more batch lets the misses out
    for _ in range(2):
        put(wide.filter("transaction_id = 'end'"), d["f"])
        put(store.filter("transaction_id = 'end'"), d["p"])
        step()
    got = scoring.latest_of_matches(spark.read.parquet(str(d["out"])).filter("transaction_id <> 'end'"), ["transaction_id"])
    event_time = F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint"))
    want = scoring.join_predictions_in_time(feats.filter("transaction_id <> 'end'"), store, event_time, ["transaction_id"], 300)
    found = {r.transaction_id: (round(r.prediction, 6), r.prediction_missing) for r in got.collect()}
    assert found == {r.transaction_id: (round(r.prediction, 6), r.prediction_missing) for r in want.collect()}
    assert {n for n, (_, missing) in found.items() if missing} == {"too late", "expired", "none"}
    assert found["two"] == (0.2, False)


def test_files_of_messages_grow_in_number(spark):
    """A task that writes messages gets a bounded number of them."""
    own, folder, files = catalog._messages(spark, SF, 100)
    written = own.read.parquet(f"{folder}/messages")
    assert files == 10 and len(written.inputFiles()) == 10
    assert written.count() == 1000 and written.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 200
