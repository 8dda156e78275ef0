"""The live pipeline as streaming queries: features, dead letters, decisions, drift reports.

Each query owns a checkpoint, which holds its offsets and its state together.
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from txrisk.operators import features, ingest, scoring
from txrisk.options import US, FeatureOptions, MonitorOptions, ScoringOptions, StreamOptions
from txrisk.schemas import FEATURE_VECTOR, PREDICTION
from txrisk.sources.tables import topic_sink, write_batch
from txrisk.streaming import reports
from txrisk.streaming.batches import fixed_instant
from txrisk.streaming.history import history_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store of the history, whose timers fire with micro-batches that have data: batches without any
    would run for ever where a query is to end with its input."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def feature_stream(raw: DataFrame, rates: DataFrame | None = None, opts: FeatureOptions = FeatureOptions(),
                   order: tuple[str, ...] = ("offset",)) -> DataFrame:
    """Feature vectors of the good messages of a stream."""
    tx = ingest.good_transactions(ingest.parse_messages(raw))
    history = history_stream(tx, opts, order)
    return features.to_feature_vector(features.with_merchant_rate(
        features.with_calendar(features.with_amount_stats(history)), rates))


def with_counters(parsed: DataFrame, name: str = "ingest") -> DataFrame:
    """Live counters of a parse, reported with each micro-batch's progress."""
    return parsed.observe(
        name,
        F.count(F.lit(1)).alias("messages"),
        F.count(F.when(F.col("stage").isNull(), 1)).alias("processed"),
        F.count(F.when(F.col("stage") == "deserialize", 1)).alias("failed_deserialize"),
        F.count(F.when(F.col("stage") == "transform", 1)).alias("failed_transform"),
    )


def write_features(vectors: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return _to_files(vectors, path, checkpoint, trigger)


def write_dead_letters(raw: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Failed messages of a stream as dead letters, with the outcome counters."""
    return _to_files(ingest.dead_letters(with_counters(ingest.parse_messages(raw))), path, checkpoint, trigger)


def _to_files(df: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def publish(messages: DataFrame, topic: str, checkpoint: str, opts: StreamOptions = StreamOptions(), **trigger) -> StreamingQuery:
    """(key, value) rows of a stream to a topic, such as feature messages or dead-letter messages."""
    return (
        messages.writeStream.format("kafka").options(**topic_sink(topic, opts)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def without_replays(tx: DataFrame, within: str) -> DataFrame:
    """Drop repeated transaction ids that come within a delay of each other in event time."""
    timed = tx.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", within)
    return timed.dropDuplicatesWithinWatermark(["transaction_id"]).drop("event_time")


def read_features(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The feature table as a stream."""
    return spark.readStream.schema(FEATURE_VECTOR).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_predictions(vectors: DataFrame, runs_path: str, model_name: str, path: str, checkpoint: str,
                      opts: ScoringOptions = ScoringOptions(), **trigger) -> StreamingQuery:
    """Score feature rows with the champion of the moment and store the predictions.

    The champion is looked up for every micro-batch. Without one the batch fails and is tried again,
    as does a batch whose predictions cannot be stored. Rows that cannot be scored go to `<path>_rejects` with their
    reason, so rows in = predictions + rejects. All predictions of a batch have one instant, that of
    its first try, and lie in the folder of its hour, so a try in a later hour replaces them.
    """
    def score_batch(batch: DataFrame, batch_id: int) -> None:
        model, version, serve = scoring.load_champion(batch.sparkSession, runs_path, model_name)
        instant = fixed_instant(batch.sparkSession, f"{path}_batches", batch_id)
        checked = scoring.with_reject_reason(batch).persist()
        try:
            scored = scoring.score(scoring.valid_rows(checked), model, version, opts, serve)
            write_batch(scoring.to_predictions(scored, F.lit(instant)), f"{path}/scored_hour={int(instant.timestamp()) // 3600}", batch_id)
            write_batch(scoring.rejected_rows(checked, F.lit(instant)), f"{path}_rejects", batch_id)
        finally:
            checked.unpersist()

    return (
        vectors.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_predictions(spark: SparkSession, path: str, as_of: datetime | None = None,
                     lifetime_s: int = ScoringOptions.prediction_lifetime_s) -> DataFrame:
    """The stored predictions; with `as_of` only the hours that may hold one that is alive then are read."""
    stored = spark.read.schema(T.StructType([*PREDICTION.fields, T.StructField("scored_hour", T.LongType())])).option("basePath", path).parquet(path)
    if as_of is not None:
        now = int(as_of.timestamp())
        stored = stored.filter(F.col("scored_hour").between((now - lifetime_s) // 3600, now // 3600))
    return stored.select(*PREDICTION.names)


def write_reports(vectors: DataFrame, baseline: DataFrame, predictions_path: str, reports_path: str, checkpoint: str,
                  opts: MonitorOptions = MonitorOptions(), lifetime_s: int = ScoringOptions.prediction_lifetime_s, **trigger) -> StreamingQuery:
    """Feature rows into the report queue, and after each micro-batch the reports that are then due.

    A queue that must be looked at while no rows arrive takes `reports.buffer_feature_messages` and `reports.report_clock`.
    """
    reports.store_baseline(baseline, reports_path)

    def report(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, datetime.now(timezone.utc)
        reports.append_features(batch, batch_id, reports_path)
        reports.write_due_reports(spark, reports_path, read_predictions(spark, predictions_path, now, lifetime_s), now, opts, lifetime_s)

    return (
        vectors.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def match_predictions(vectors: DataFrame, predictions: DataFrame, wait_s: int, lifetime_s: int = ScoringOptions.prediction_lifetime_s,
                      late: str = "10 minutes") -> DataFrame:
    """Feature rows of a stream with the predictions of another one that are alive `wait_s` after the event, one row each;
    without any once no such prediction can come. (transaction_id, user_id, event_time, label, stored_probability, scored_at)

    Both sides are kept for as long as a partner may come: the lifetime, the wait and `late`. `scoring.latest_of_matches` then
    leaves one row per transaction.
    """
    rows = vectors.select("transaction_id", "user_id", F.timestamp_micros(F.floor(F.col("timestamp") * US).cast("bigint")).alias("event_time"), "label")
    store = predictions.select(F.col("transaction_id").alias("scored_id"), F.col("probability").alias("stored_probability"), "scored_at")
    rows, store = rows.withWatermark("event_time", late), store.withWatermark("scored_at", late)
    on = (F.col("transaction_id") == F.col("scored_id")) & scoring.scored_by(F.col("event_time"), wait_s, lifetime_s)
    return rows.join(store, on, "left_outer").drop("scored_id")


def read_prediction_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The stored predictions as a stream."""
    return spark.readStream.schema(PREDICTION).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def usable_events(raw: DataFrame) -> DataFrame:
    """Feature events of a topic without the corrupt ones, which are counted and dropped."""
    parsed = ingest.parse_feature_events(raw).observe(
        "monitor", F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("is_corrupt"), 1)).alias("corrupt"))
    return parsed.filter(~F.col("is_corrupt")).drop("is_corrupt")
