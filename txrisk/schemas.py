"""Fixed schemas and column lists. Nothing in the library infers a schema."""

from pyspark.sql import types as T

# The model input, in the order the model expects it.
FEATURE_COLS = [
    "amount", "amount_log", "amount_zscore", "tx_count_1h", "tx_count_24h",
    "tx_sum_1h", "tx_sum_24h", "unique_merchants_24h", "unique_countries_7d",
    "hour_of_day", "day_of_week", "is_weekend", "card_present",
    "merchant_fraud_rate_30d", "user_chargeback_rate",
]
CATEGORICAL_FEATURES = ["is_weekend", "card_present", "day_of_week"]
NUMERICAL_FEATURES = [c for c in FEATURE_COLS if c not in CATEGORICAL_FEATURES]

# Fields a raw transaction must carry, in the order they are looked up.
REQUIRED_FIELDS = [
    "user_id", "transaction_id", "timestamp", "amount",
    "merchant_id", "country", "card_present", "merchant_category",
]

# Bucket bounds of the latency histogram, in seconds.
FEATURE_LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 1.0, 5.0]

RAW_MESSAGE = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

TRANSACTION = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("card_present", T.BooleanType()),
    T.StructField("device_fingerprint", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

FEATURE_VECTOR = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("amount_log", T.DoubleType()),
    T.StructField("amount_zscore", T.DoubleType()),
    T.StructField("tx_count_1h", T.IntegerType()),
    T.StructField("tx_count_24h", T.IntegerType()),
    T.StructField("tx_sum_1h", T.DoubleType()),
    T.StructField("tx_sum_24h", T.DoubleType()),
    T.StructField("unique_merchants_24h", T.IntegerType()),
    T.StructField("unique_countries_7d", T.IntegerType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("is_weekend", T.BooleanType()),
    T.StructField("card_present", T.BooleanType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("merchant_fraud_rate_30d", T.DoubleType()),
    T.StructField("user_chargeback_rate", T.DoubleType()),
    T.StructField("label", T.IntegerType()),
])

PREDICTION = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("decision", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("scored_at", T.TimestampType()),
])

MODEL_RUN = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("serve", T.StringType()),
    T.StructField("gate_metric", T.DoubleType()),
    T.StructField("train_size", T.LongType()),
    T.StructField("val_size", T.LongType()),
    T.StructField("test_size", T.LongType()),
    T.StructField("fraud_rate", T.DoubleType()),
    T.StructField("scale_pos_weight", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])
