"""Views of an `events` table (event_id, ts, user_id, event_type, value, props) as the inputs of
the risk operators: typed transactions, raw messages, merchant rates, predictions, request log."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from txrisk.functions import scalar as S
from txrisk.operators.features import merchant_rates

#: The instant as of which merchant rates are known: 2024-01-16.
RATES_UNTIL_US = 1_705_363_200_000_000


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _utc(events: DataFrame) -> Column:
    """`ts` as an instant; a time without zone is meant in UTC, whatever the session's zone is."""
    instant = F.col("ts").cast("timestamp")
    if events.schema["ts"].dataType == T.TimestampNTZType():
        return F.from_utc_timestamp(instant, F.current_timezone())
    return instant


def transactions(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    ts_us = F.unix_micros(_utc(events))
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"),
        F.concat(F.lit("merchant_"), k).alias("merchant_id"),
        F.col("value").alias("amount"),
        F.lit("USD").alias("currency"),
        (ts_us / 1e6).alias("timestamp"),
        ts_us.alias("ts_us"),
        F.col("event_type").alias("merchant_category"),
        F.concat(F.lit("C"), F.pmod(k, F.lit(8))).alias("country"),
        (F.col("event_id") % 3 != 0).alias("card_present"),
        F.lit(None).cast("string").alias("device_fingerprint"),
        ((F.col("event_type") == "error") & (F.col("value") >= 50)).cast("int").alias("label"),
    )


def raw_messages(events: DataFrame) -> DataFrame:
    """The same transactions as topic messages: tiny amounts come cut in half, large ones without
    their amount."""
    tx = transactions(events).withColumn("event_id", F.col("transaction_id").cast("bigint"))
    truncated = F.col("amount") < 1
    no_amount = F.col("amount") >= 200
    text = F.to_json(F.struct(
        "transaction_id", "user_id", "merchant_id",
        F.when(~no_amount, F.col("amount")).alias("amount"),
        "currency", "timestamp", "merchant_category", "country", "card_present",
        F.col("label").alias("_is_fraud"),
    ))
    half = F.expr("substring(text, 1, cast(length(text) / 2 as int))")
    return tx.withColumn("text", text).select(
        F.col("user_id").cast("binary").alias("key"),
        F.when(truncated, half).otherwise(F.col("text")).cast("binary").alias("value"),
        F.lit("transactions.raw").alias("topic"),
        (F.col("event_id") % 6).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.timestamp_micros("ts_us").alias("timestamp"),
    )


def known_merchant_rates(tx: DataFrame) -> DataFrame:
    """The rates as of RATES_UNTIL_US; merchants without a transaction in the 30 days before take the lookup's default."""
    return merchant_rates(tx, until_us=RATES_UNTIL_US)


def predictions(events: DataFrame) -> DataFrame:
    """A prediction five minutes after each event; views are not scored."""
    p = (F.col("event_id") * 37 % 1000) / 1000
    return events.filter(F.col("event_type") != "view").select(
        F.col("event_id").cast("string").alias("transaction_id"),
        p.alias("probability"),
        S.decision(p).alias("decision"),
        F.lit("v1").alias("model_version"),
        (_utc(events) + F.expr("interval 5 minutes")).alias("scored_at"),
    )


def request_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("ok"),
    )
