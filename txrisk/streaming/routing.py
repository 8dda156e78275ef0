"""Raw messages routed in one pass: good transactions, dead letters and counters of a micro-batch come out together."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from txrisk.operators import ingest
from txrisk.schemas import TRANSACTION
from txrisk.streaming.batches import fixed_instant, is_published, publish, published

GOOD = T.StructType([*TRANSACTION.fields, T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())])
LETTER = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("error", "message_key")], T.StructField("offset", T.LongType()),
    T.StructField("original_payload", T.StringType()), T.StructField("partition", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("source_topic", "stage", "ts_utc", "original_payload_base64")]])
COUNTER = T.StructType([T.StructField("stage", T.StringType()), T.StructField("messages", T.LongType())])
TABLES = {"good": GOOD, "dead_letters": LETTER, "counters": COUNTER}


def route_messages(raw: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Parse each message of a stream once; the batch's tables `good`, `dead_letters` and `counters` are seen together or
    not at all (`read_routed`), also after a stop between two of them. All letters of a batch have one instant."""
    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_published(spark, path, batch_id):
            return
        instant = fixed_instant(spark, path, batch_id)
        parsed = ingest.parse_messages(batch).persist()
        try:
            publish(spark, path, batch_id, {
                "good": ingest.good_transactions(parsed),
                "dead_letters": ingest.dead_letters(parsed, F.lit(instant)),
                "counters": ingest.stage_counts(parsed)})
        finally:
            parsed.unpersist()

    return (
        raw.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_routed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """`good`, `dead_letters` or `counters` of the published batches."""
    return published(spark, path, table, TABLES[table]).drop("batch_id")
