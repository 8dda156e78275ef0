"""File and topic sources and sinks."""

from pyspark.sql import DataFrame, SparkSession

from txrisk.operators.drift import baseline_with_prediction
from txrisk.options import MonitorOptions, StreamOptions
from txrisk.schemas import RAW_MESSAGE


def read_training(spark: SparkSession, folder: str) -> DataFrame:
    """All `features_*.parquet` files of a folder as one table; none at all is an error."""
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/features_*.parquet")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The monitoring baseline; a missing file raises instead of silencing the reports."""
    return baseline_with_prediction(spark.read.parquet(path))


def read_topic(spark: SparkSession, topic: str, opts: StreamOptions = StreamOptions(),
               monitor: MonitorOptions | None = None) -> DataFrame:
    """A topic as a stream of bounded micro-batches; for the monitor, batches wait for its thresholds."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", opts.bootstrap_servers)
        .option("subscribe", topic)
        .option("startingOffsets", opts.starting_offsets)
    )
    for name, value in ({"maxOffsetsPerTrigger": str(opts.rows_per_trigger)} | monitor_limits(monitor)).items():
        reader = reader.option(name, value)
    return reader.load()


def monitor_limits(monitor: MonitorOptions | None) -> dict[str, str]:
    """Report trigger: enough rows after the interval, and never more than a report's batch."""
    if monitor is None:
        return {}
    return {
        "minOffsetsPerTrigger": str(monitor.buffer_threshold),
        "maxTriggerDelay": f"{monitor.report_interval_s}s",
        "maxOffsetsPerTrigger": str(monitor.batch_size),
    }


def message_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files with the columns of a topic as a stream."""
    return (
        spark.readStream.schema(RAW_MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def topic_sink(topic: str, opts: StreamOptions = StreamOptions()) -> dict[str, str]:
    """Options of a topic as a sink."""
    return {
        "kafka.bootstrap.servers": opts.bootstrap_servers,
        "kafka.linger.ms": str(opts.linger_ms),
        "kafka.compression.type": opts.compression,
        "topic": topic,
    }


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch to its own folder, so that a replayed batch replaces its first try."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
