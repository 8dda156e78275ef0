"""Drift reports over a durable buffer of feature rows.

Feature rows get places in a queue, in order of arrival. A report takes `batch_size` rows as soon as so many wait, or what
waits if that is `buffer_threshold` rows or more and the last report is `report_interval_s` old. How far the queue is read
stands in the marks of the published reports: a report that fails is made again, and no row is in two.
"""

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from txrisk.operators import drift, ingest, scoring
from txrisk.options import US, MonitorOptions, ScoringOptions
from txrisk.schemas import CATEGORICAL_FEATURES, FEATURE_VECTOR, NUMERICAL_FEATURES
from txrisk.streaming.batches import is_published, marks, publish, published

QUEUED = T.StructType([*FEATURE_VECTOR.fields, T.StructField("place", T.LongType())])
APPENDED = T.StructType([T.StructField(n, T.LongType()) for n in ("first_place", "rows", "corrupt")])
REPORTED = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("first_place", "last_place", "corrupt_upto")], T.StructField("reported_at", T.TimestampType())])


def append_features(batch: DataFrame, batch_id: int, folder: str, corrupt: int = 0) -> None:
    """Put the feature rows of a micro-batch at the end of the queue; a batch that is already there is left alone.

    Rows of a batch are placed by their time, ties by their id.
    """
    spark, queue = batch.sparkSession, f"{folder}/queue"
    if is_published(spark, queue, batch_id):
        return
    known = marks(spark, queue, APPENDED)
    first = 0 if known is None else known.agg(F.max(F.col("first_place") + F.col("rows"))).first()[0] or 0
    rows = batch.select(*FEATURE_VECTOR.names)
    arrived = F.coalesce(F.floor(F.col("timestamp") * US), F.lit(0)).cast("bigint")
    ranked = drift.arrival_rank(rows.withColumns({"arrival_us": arrived, "queue": F.lit(0)}), "queue", "arrival_us", "transaction_id")
    placed = ranked.withColumn("place", F.col("rank") + first).select(*QUEUED.names).persist()
    try:
        size = placed.count()
        publish(spark, queue, batch_id, {"rows": placed}, {"first_place": first, "rows": size, "corrupt": corrupt}, APPENDED)
    finally:
        placed.unpersist()


def queued(spark: SparkSession, folder: str) -> DataFrame:
    """All feature rows that ever were in the queue, with their `place`."""
    return published(spark, f"{folder}/queue", "rows", QUEUED)


@dataclass(frozen=True)
class Queue:
    """Rows appended and corrupt events seen so far; the place up to which reports have read, their number and last instant."""

    rows: int
    corrupt: int
    read: int
    corrupt_reported: int
    reports: int
    last_report: datetime

    def slices(self, now: datetime, opts: MonitorOptions) -> list[tuple[int, int]]:
        """The places [first, last) of the reports that are due."""
        full = (self.rows - self.read) // opts.batch_size
        due = [(self.read + i * opts.batch_size, self.read + (i + 1) * opts.batch_size) for i in range(full)]
        waits = self.rows - self.read
        if not due and waits >= max(opts.buffer_threshold, 1) and (now - self.last_report).total_seconds() >= opts.report_interval_s:
            due.append((self.read, self.rows))
        return due


def queue_state(spark: SparkSession, folder: str) -> Queue:
    """What the marks say; the time before the first report counts from when the baseline was stored."""
    added, made = marks(spark, f"{folder}/queue", APPENDED), marks(spark, folder, REPORTED)
    start = marks(spark, f"{folder}/baseline").first().published_at.astimezone(timezone.utc)
    rows, corrupt = (0, 0) if added is None else added.agg(F.max(F.col("first_place") + F.col("rows")), F.sum("corrupt")).first()
    read, upto, reports, last = (0, 0, 0, None) if made is None else made.agg(
        F.max("last_place"), F.max("corrupt_upto"), F.count("*"), F.max("reported_at")).first()
    return Queue(rows or 0, corrupt or 0, read or 0, upto or 0, reports, start if last is None else last.astimezone(timezone.utc))


def store_baseline(baseline: DataFrame, folder: str) -> None:
    """Scan the baseline once: its profile and its own quality, from which all reports are made."""
    spark = baseline.sparkSession
    if is_published(spark, f"{folder}/baseline", 0):
        return
    publish(spark, f"{folder}/baseline", 0, {
        "profile": drift.profile(baseline).rows,
        "classification_quality": drift.quality_of(baseline.select(F.lit("reference").alias("frame"), "label", "prediction"))})


def _baseline(spark: SparkSession, folder: str) -> tuple[drift.Profile, DataFrame]:
    parts = [spark.read.parquet(f"{folder}/baseline/{t}/batch_id=0") for t in ("profile", "classification_quality")]
    return drift.Profile(parts[0]), parts[1]


def write_due_reports(spark: SparkSession, folder: str, predictions: DataFrame, now: datetime, opts: MonitorOptions = MonitorOptions(),
                      lifetime_s: int = ScoringOptions.prediction_lifetime_s) -> int:
    """Make the reports that are due at `now` and return their number. A report's tables: drift_reports (one row),
    drift_columns, classification_quality and data_quality. The baseline is not read again, only its stored profile."""
    state = queue_state(spark, folder)
    profile, quality = _baseline(spark, folder)
    instant = F.lit(now)
    for number, (first, last) in enumerate(state.slices(now, opts), state.reports):
        rows = queued(spark, folder).filter(F.col("place").between(first, last - 1))
        joined = scoring.join_predictions(rows, predictions, instant, lifetime_s).persist()
        try:
            size = joined.agg(F.count("*").alias("rows"), F.sum(F.col("prediction_missing").cast("bigint")).alias("missing")).first()
            current = drift.profile(joined, keep=True)
            columns = drift.drift_columns(profile, current).persist()
            corrupt = state.corrupt - state.corrupt_reported if number == state.reports else 0
            verdict = drift.dataset_drift(columns, opts.drift_share).select(
                instant.alias("reported_at"), F.lit(size.rows).alias("buffer_size"), F.lit(size.missing).alias("prediction_misses"),
                F.lit(corrupt).cast("bigint").alias("corrupt_events"), F.lit(state.rows - last).cast("bigint").alias("rows_waiting"), "*")
            own = drift.quality_of(joined.select(F.lit("current").alias("frame"), "label", "prediction"))
            frames = [drift.data_quality(p.rows.withColumn("frame", F.lit(n)), ["frame"], profiled=True)
                      for n, p in (("reference", profile), ("current", current))]
            publish(spark, folder, number, {
                "drift_columns": columns, "drift_reports": verdict, "classification_quality": quality.unionByName(own),
                "data_quality": frames[0].unionByName(frames[1])},
                {"first_place": first, "last_place": last, "corrupt_upto": state.corrupt, "reported_at": now}, REPORTED)
            columns.unpersist()
        finally:
            joined.unpersist()
    return len(state.slices(now, opts))


def read_reports(spark: SparkSession, folder: str, table: str = "drift_reports") -> DataFrame:
    """A table of the published reports, with `report_id`."""
    done = marks(spark, folder)
    rows = spark.read.option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}")
    return rows.join(done.select("batch_id"), "batch_id", "left_semi").withColumnRenamed("batch_id", "report_id")


def buffer_feature_messages(raw: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Feature messages (`value`) of a topic into the queue; corrupt ones are counted for the next report and dropped."""
    def append(batch: DataFrame, batch_id: int) -> None:
        parsed = ingest.parse_feature_events(batch).persist()
        try:
            corrupt = parsed.filter("is_corrupt").count()
            append_features(parsed.filter("not is_corrupt"), batch_id, folder, corrupt)
        finally:
            parsed.unpersist()

    return (
        raw.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def report_clock(spark: SparkSession, folder: str, baseline: DataFrame, predictions, checkpoint: str, opts: MonitorOptions = MonitorOptions(),
                 lifetime_s: int = ScoringOptions.prediction_lifetime_s, every: str = "10 seconds") -> StreamingQuery:
    """Look at the queue at fixed times and make the reports that are due, also while no rows arrive.

    `predictions` is a function from an instant to the store's rows. One clock, or one `write_reports`, may run on a folder.
    """
    store_baseline(baseline, folder)

    def look(batch: DataFrame, batch_id: int) -> None:
        now = datetime.now(timezone.utc)
        write_due_reports(spark, folder, predictions(now), now, opts, lifetime_s)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
