"""Feature vectors: history features, the merchant lookup and the scalar features of a row."""

from pyspark.sql import DataFrame, functions as F

from txrisk.functions import scalar as S
from txrisk.operators.history import history_features
from txrisk.options import US, FeatureOptions
from txrisk.schemas import FEATURE_VECTOR


def velocity_features(tx: DataFrame, opts: FeatureOptions = FeatureOptions(), arrival: str | None = None) -> DataFrame:
    """Counts and sums over [ts - window, ts], the row itself included; replays count once."""
    return history_features(tx, opts, ("velocity",), arrival)


def distinct_features(tx: DataFrame, opts: FeatureOptions = FeatureOptions(), arrival: str | None = None) -> DataFrame:
    """Distinct merchants and countries: since the last idle gap (`ttl`) or in the window (`sliding`)."""
    return history_features(tx, opts, ("distinct",), arrival)


def user_moments(tx: DataFrame, opts: FeatureOptions = FeatureOptions(), arrival: str | None = None) -> DataFrame:
    """Count, sum, sum of squares and frauds before the row, since the user's last long idle gap."""
    return history_features(tx, opts, ("moments",), arrival)


def with_amount_stats(moments: DataFrame) -> DataFrame:
    """`amount_zscore` and `user_chargeback_rate` from the prior moments.

    The deviation is the population one, never below 1; without history the mean is the amount.
    """
    n = F.col("prior_count")
    mean = F.when(n > 0, F.col("prior_sum") / n).otherwise(F.col("amount"))
    square = F.col("prior_sumsq") / n
    std = F.when(n > 0, F.greatest(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), F.lit(1.0))).otherwise(1.0)
    return moments.withColumns({
        "amount_zscore": (F.col("amount") - mean) / std,
        "user_chargeback_rate": F.when(n > 0, F.col("prior_fraud") / n).otherwise(0.0),
    })


def merchant_rates(tx: DataFrame, until_us: int | None = None, window_s: int = 30 * 86400) -> DataFrame:
    """Fraud rate by merchant over the window before a cut-off; unlabelled rows are left out."""
    rows = tx.filter(F.col("label").isNotNull())
    if until_us is not None:
        rows = rows.filter((F.col("ts_us") < until_us) & (F.col("ts_us") >= until_us - window_s * US))
    return rows.groupBy("merchant_id").agg((F.sum("label") / F.count("*")).alias("fraud_rate"))


def with_merchant_rate(tx: DataFrame, rates: DataFrame | None) -> DataFrame:
    """`merchant_fraud_rate_30d` by lookup; merchants without a rate get 0."""
    if rates is None:
        return tx.withColumn("merchant_fraud_rate_30d", F.lit(0.0))
    unique = rates.groupBy("merchant_id").agg(F.max("fraud_rate").alias("fraud_rate"))
    # adaptive execution broadcasts the rates if they are small, and else splits the partitions of hot merchants
    joined = tx.join(unique, "merchant_id", "left")
    return joined.withColumn("merchant_fraud_rate_30d", F.coalesce("fraud_rate", F.lit(0.0))).drop("fraud_rate")


def with_calendar(tx: DataFrame) -> DataFrame:
    ts = F.col("ts_us")
    return tx.withColumns({
        "amount_log": S.amount_log(F.col("amount")),
        "hour_of_day": S.hour_of_day(ts),
        "day_of_week": S.day_of_week(ts),
        "is_weekend": S.is_weekend(ts),
    })


def feature_vector(tx: DataFrame, rates: DataFrame | None = None, opts: FeatureOptions = FeatureOptions(),
                   arrival: str | None = None) -> DataFrame:
    """The 20 columns of a feature event, in their fixed order."""
    return to_feature_vector(with_merchant_rate(
        with_calendar(with_amount_stats(history_features(tx, opts, arrival=arrival))), rates))


def to_feature_vector(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_VECTOR.fields])
