"""Live counters as rows: what a query observes of each micro-batch, kept in an append-only table."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

COUNTERS = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("batch_at", T.TimestampType()),
    T.StructField("name", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("input_rows", T.LongType()), T.StructField("batch_ms", T.LongType())])


class CounterLog(StreamingQueryListener):
    """Write the observed metrics of each finished micro-batch to `path`.

    A query keeps its id over restarts, and a batch that is run again has its number again: its rows then replace those of the
    first run, so that sums count every batch once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.id), p.batchId, name, metric, float(value), p.numInputRows, int(p.durationMs.get("triggerExecution", 0)), p.timestamp)
                for name, observed in p.observedMetrics.items() for metric, value in observed.asDict().items() if isinstance(value, (int, float))]
        if not rows:
            return
        fields = "query_id string, batch_id long, name string, metric string, value double, input_rows long, batch_ms long, at string"
        table = self.spark.createDataFrame(rows, fields).withColumn("batch_at", F.to_timestamp("at"))
        table.select(*[c for c in COUNTERS.names if c not in ("query_id", "batch_id")]).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/query_id={p.id}/batch_id={p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row per query, micro-batch and metric."""
    return spark.read.schema(COUNTERS).option("basePath", path).parquet(path)


def counter_totals(counters: DataFrame) -> DataFrame:
    """(name, metric, total) over all queries and batches."""
    return counters.groupBy("name", "metric").agg(F.sum("value").cast("bigint").alias("total"))
