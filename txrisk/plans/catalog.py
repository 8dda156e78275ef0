"""The registered queries, each beside the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txrisk.functions import scalar as S
from txrisk.operators import boosting, drift, features, ingest, metrics, scoring, sketches, training
from txrisk.options import FeatureOptions, TrainingOptions
from txrisk.schemas import FEATURE_COLS, FEATURE_VECTOR
from txrisk.session import shared_folder
from txrisk.sources import adapters as A, tables
from txrisk.streaming import queries as live, reports, routing

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TX = """
tx AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'user_' || user_id AS user_id,
         'merchant_' || k AS merchant_id, value AS amount, 'USD' AS currency,
         epoch_us(ts) / 1e6 AS "timestamp", epoch_us(ts) AS ts_us, event_type AS merchant_category,
         'C' || (k % 8) AS country,
         event_id % 3 <> 0 AS card_present, k, event_id, ts,
         CAST(event_type = 'error' AND value >= 50 AS INTEGER) AS label,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events))
"""

VELOCITY_SQL = """
velocity AS (
  SELECT transaction_id,
         count(*) OVER h AS tx_count_1h, count(*) OVER d AS tx_count_24h,
         sum(cents) OVER h / 100.0 AS tx_sum_1h, sum(cents) OVER d / 100.0 AS tx_sum_24h
  FROM tx
  WINDOW h AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW),
         d AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
"""

SESSIONS_SQL = """
gaps AS (
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) AS gap FROM tx),
sessions AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400000000 THEN 1 ELSE 0 END) OVER u AS s1,
         sum(CASE WHEN gap IS NULL OR gap > 604800000000 THEN 1 ELSE 0 END) OVER u AS s7,
         sum(CASE WHEN gap IS NULL OR gap > 2592000000000 THEN 1 ELSE 0 END) OVER u AS s30
  FROM gaps WINDOW u AS (PARTITION BY user_id ORDER BY ts_us))
"""

DISTINCT_SQL = """
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, s1, merchant_id ORDER BY ts_us) = 1 AS new_m,
         row_number() OVER (PARTITION BY user_id, s7, country ORDER BY ts_us) = 1 AS new_c
  FROM sessions),
distinct_ttl AS (
  SELECT transaction_id,
         sum(CAST(new_m AS INTEGER)) OVER (PARTITION BY user_id, s1 ORDER BY ts_us) AS unique_merchants_24h,
         sum(CAST(new_c AS INTEGER)) OVER (PARTITION BY user_id, s7 ORDER BY ts_us) AS unique_countries_7d
  FROM firsts)
"""

MOMENTS_SQL = """
moments AS (
  SELECT transaction_id, amount, count(*) OVER p AS n, coalesce(sum(cents) OVER p, 0) AS s,
         coalesce(sum(cents * cents) OVER p, 0) AS ss, coalesce(sum(label) OVER p, 0) AS f
  FROM sessions
  WINDOW p AS (PARTITION BY user_id, s30 ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stats AS (
  SELECT transaction_id, n, s, ss, f,
         CASE WHEN n = 0 THEN 0.0 ELSE (amount - s / 100.0 / n)
           / greatest(sqrt(greatest(ss / 10000.0 / n - (s / 100.0 / n) * (s / 100.0 / n), 0.0)), 1.0) END AS z,
         CASE WHEN n = 0 THEN 0.0 ELSE CAST(f AS DOUBLE) / n END AS chargeback
  FROM moments)
"""

RATES_SQL = """
rates AS (
  SELECT merchant_id, CAST(sum(label) AS DOUBLE) / count(*) AS fraud_rate FROM tx
  WHERE ts_us < 1705363200000000 AND ts_us >= 1705363200000000 - 30 * 86400000000 GROUP BY 1)
"""

FEATURES_SQL = f"""
WITH {TX}, {VELOCITY_SQL}, {SESSIONS_SQL}, {DISTINCT_SQL}, {MOMENTS_SQL}, {RATES_SQL}
SELECT tx.transaction_id, tx.user_id, tx."timestamp", tx.amount, round(ln(1 + tx.amount), 6) AS amount_log,
       round(z, 6) AS amount_zscore,
       CAST(tx_count_1h AS INTEGER) AS tx_count_1h, CAST(tx_count_24h AS INTEGER) AS tx_count_24h,
       CAST(tx_sum_1h AS DOUBLE) AS tx_sum_1h, CAST(tx_sum_24h AS DOUBLE) AS tx_sum_24h,
       CAST(unique_merchants_24h AS INTEGER) AS unique_merchants_24h,
       CAST(unique_countries_7d AS INTEGER) AS unique_countries_7d,
       CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       isodow(ts) >= 6 AS is_weekend, card_present, merchant_category,
       round(coalesce(fraud_rate, 0.0), 6) AS merchant_fraud_rate_30d,
       round(chargeback, 6) AS user_chargeback_rate, tx.label
FROM tx JOIN velocity USING (transaction_id) JOIN distinct_ttl USING (transaction_id)
JOIN stats USING (transaction_id) LEFT JOIN rates USING (merchant_id)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def _tx(spark: SparkSession, sf: str) -> DataFrame:
    return A.transactions(A.read_events(spark, sf))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- features ---------------------------------------------------------------------------------

@query(f"""WITH {TX} SELECT transaction_id, user_id, merchant_id, amount, currency, "timestamp", ts_us,
    merchant_category, country, card_present, label FROM tx""")
def transactions(spark, sf):
    return _tx(spark, sf).drop("device_fingerprint")


@query(f"""WITH {TX}, {VELOCITY_SQL} SELECT transaction_id, CAST(tx_count_1h AS INTEGER) AS tx_count_1h,
    CAST(tx_count_24h AS INTEGER) AS tx_count_24h, CAST(tx_sum_1h AS DOUBLE) AS tx_sum_1h,
    CAST(tx_sum_24h AS DOUBLE) AS tx_sum_24h FROM velocity""")
def velocity_features(spark, sf):
    return features.velocity_features(_tx(spark, sf)).select(
        "transaction_id", "tx_count_1h", "tx_count_24h", "tx_sum_1h", "tx_sum_24h")


@query(f"""WITH {TX}, replayed AS (
      SELECT user_id, transaction_id, cents, ts_us, 0 AS copy FROM tx
      UNION ALL SELECT user_id, transaction_id, cents, ts_us + 1800000000, 1 FROM tx),
    pairs AS (
      SELECT DISTINCT a.transaction_id, a.copy, b.transaction_id AS other, b.cents,
             max(CASE WHEN b.ts_us >= a.ts_us - 3600000000 THEN 1 ELSE 0 END)
               OVER (PARTITION BY a.transaction_id, a.copy, b.transaction_id, b.cents) AS in_hour
      FROM replayed a JOIN replayed b ON a.user_id = b.user_id
        AND b.ts_us BETWEEN a.ts_us - 86400000000 AND a.ts_us)
    SELECT transaction_id, CAST(copy AS INTEGER) AS copy,
           CAST(sum(in_hour) AS INTEGER) AS tx_count_1h, CAST(count(*) AS INTEGER) AS tx_count_24h,
           CAST(sum(cents * in_hour) / 100.0 AS DOUBLE) AS tx_sum_1h,
           CAST(sum(cents) / 100.0 AS DOUBLE) AS tx_sum_24h
    FROM pairs GROUP BY 1, 2""")
def replay_collapse(spark, sf):
    tx = _tx(spark, sf).select("transaction_id", "user_id", "amount", "ts_us")
    copies = F.explode(F.array(F.lit(0), F.lit(1)))
    replayed = tx.withColumn("copy", copies).withColumn("ts_us", F.col("ts_us") + F.col("copy") * F.lit(1_800_000_000))
    return features.velocity_features(replayed).select(
        "transaction_id", "copy", "tx_count_1h", "tx_count_24h", "tx_sum_1h", "tx_sum_24h")


@query(f"""WITH {TX}, {SESSIONS_SQL}, {DISTINCT_SQL} SELECT transaction_id,
    CAST(unique_merchants_24h AS INTEGER) AS unique_merchants_24h,
    CAST(unique_countries_7d AS INTEGER) AS unique_countries_7d FROM distinct_ttl""")
def distinct_ttl(spark, sf):
    return features.distinct_features(_tx(spark, sf)).select(
        "transaction_id", "unique_merchants_24h", "unique_countries_7d")


@query(f"""WITH {TX} SELECT a.transaction_id,
      CAST(count(DISTINCT CASE WHEN b.ts_us >= a.ts_us - 86400000000 THEN b.merchant_id END) AS INTEGER) AS unique_merchants_24h,
      CAST(count(DISTINCT b.country) AS INTEGER) AS unique_countries_7d
    FROM tx a JOIN tx b ON a.user_id = b.user_id AND b.ts_us BETWEEN a.ts_us - 604800000000 AND a.ts_us
    GROUP BY 1""")
def distinct_sliding(spark, sf):
    return features.distinct_features(_tx(spark, sf), FeatureOptions(distinct_mode="sliding")).select(
        "transaction_id", "unique_merchants_24h", "unique_countries_7d")


@query(f"""WITH {TX}, {SESSIONS_SQL}, {MOMENTS_SQL} SELECT transaction_id, CAST(n AS BIGINT) AS prior_count,
    CAST(s / 100.0 AS DOUBLE) AS prior_sum, CAST(round(ss / 10000.0, 4) AS DOUBLE) AS prior_sumsq,
    CAST(f AS BIGINT) AS prior_fraud FROM moments""")
def user_moments(spark, sf):
    m = features.user_moments(_tx(spark, sf))
    return m.select("transaction_id", "prior_count",
                    "prior_sum", F.round("prior_sumsq", 4).alias("prior_sumsq"), "prior_fraud")


@query(f"""WITH {TX}, {SESSIONS_SQL}, {MOMENTS_SQL} SELECT transaction_id, round(z, 6) AS amount_zscore FROM stats""")
def amount_zscore(spark, sf):
    z = features.with_amount_stats(features.user_moments(_tx(spark, sf)))
    return _rounded(z.select("transaction_id", "amount_zscore"), "amount_zscore")


@query(f"""WITH {TX}, {SESSIONS_SQL}, {MOMENTS_SQL}
    SELECT transaction_id, round(chargeback, 6) AS user_chargeback_rate FROM stats""")
def chargeback_rate(spark, sf):
    r = features.with_amount_stats(features.user_moments(_tx(spark, sf)))
    return _rounded(r.select("transaction_id", "user_chargeback_rate"), "user_chargeback_rate")


@query(f"""WITH {TX}, cut AS (SELECT 1706313600000000 AS until_us)
    SELECT merchant_id, round(CAST(sum(label) AS DOUBLE) / count(*), 6) AS fraud_rate FROM tx, cut
    WHERE ts_us < until_us AND ts_us >= until_us - 30 * 86400000000 GROUP BY 1""")
def merchant_rates(spark, sf):
    """Rates as of 2024-01-27, over the 30 days before."""
    return _rounded(features.merchant_rates(_tx(spark, sf), until_us=1_706_313_600_000_000), "fraud_rate")


@query(f"""WITH {TX}, {RATES_SQL} SELECT transaction_id, merchant_id,
    round(coalesce(fraud_rate, 0.0), 6) AS merchant_fraud_rate_30d FROM tx LEFT JOIN rates USING (merchant_id)""")
def merchant_rate_join(spark, sf):
    tx = _tx(spark, sf)
    joined = features.with_merchant_rate(tx, A.known_merchant_rates(tx))
    return _rounded(joined.select("transaction_id", "merchant_id", "merchant_fraud_rate_30d"), "merchant_fraud_rate_30d")


@query(f"""WITH {TX} SELECT transaction_id, round(ln(1 + amount), 6) AS amount_log,
    CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
    isodow(ts) >= 6 AS is_weekend FROM tx""")
def calendar_features(spark, sf):
    return _rounded(features.with_calendar(_tx(spark, sf)).select(
        "transaction_id", "amount_log", "hour_of_day", "day_of_week", "is_weekend"), "amount_log")


def _vector(spark, sf, opts=FeatureOptions()):
    tx = _tx(spark, sf)
    return features.feature_vector(tx, A.known_merchant_rates(tx), opts)


ROUNDED = ("amount_log", "amount_zscore", "merchant_fraud_rate_30d", "user_chargeback_rate")


@query(FEATURES_SQL)
def feature_vector(spark, sf):
    return _rounded(_vector(spark, sf), *ROUNDED)


@query(FEATURES_SQL)
def feature_vector_split_users(spark, sf):
    """The same vectors with every user of more than 60 rows cut into slices of at most 10 rows."""
    return _rounded(_vector(spark, sf, FeatureOptions(hot_rows=60, slice_rows=10)), *ROUNDED)


# --- ingest -----------------------------------------------------------------------------------

def _parsed(spark, sf):
    return ingest.parse_messages(A.raw_messages(A.read_events(spark, sf)))


STAGE_SQL = """staged AS (
  SELECT *, CASE WHEN amount < 1 THEN 'deserialize' WHEN amount >= 200 THEN 'transform' END AS stage FROM tx)"""


@query(f"""WITH {TX}, {STAGE_SQL} SELECT transaction_id, user_id, merchant_id, amount, currency, "timestamp", ts_us,
    merchant_category, country, card_present, label, CAST(event_id % 6 AS INTEGER) AS "partition",
    event_id AS "offset" FROM staged WHERE stage IS NULL""")
def parse_ok(spark, sf):
    return ingest.good_transactions(_parsed(spark, sf)).drop("device_fingerprint")


@query(f"""WITH {TX}, {STAGE_SQL} SELECT CASE stage WHEN 'deserialize' THEN 'payload is not JSON' ELSE '''amount''' END AS error,
    user_id AS message_key, event_id AS "offset", CAST(event_id % 6 AS INTEGER) AS "partition",
    'transactions.raw' AS source_topic, stage FROM staged WHERE stage IS NOT NULL""")
def dead_letters(spark, sf):
    return ingest.dead_letters(_parsed(spark, sf)).select(
        "error", "message_key", "offset", "partition", "source_topic", "stage")


@query(f"""WITH {TX}, {STAGE_SQL} SELECT coalesce(stage, 'processed') AS stage, count(*) AS messages FROM staged GROUP BY 1""")
def dlq_stage_counts(spark, sf):
    return ingest.stage_counts(_parsed(spark, sf))


@query(f"""WITH {TX}, {STAGE_SQL} SELECT stage IS NOT NULL AS is_corrupt, count(*) AS messages,
    CAST(sum(CASE WHEN stage IS NULL THEN cents ELSE 0 END) AS BIGINT) AS cents FROM (
      SELECT CASE WHEN amount < 1 THEN 'x' END AS stage, cents FROM tx) GROUP BY 1""")
def feature_event_parse(spark, sf):
    """The monitor's lenient parse over feature messages of which some are cut in half."""
    events = A.read_events(spark, sf)
    tx = A.transactions(events)
    msgs = ingest.feature_messages(features.to_feature_vector(_with_missing_features(tx)))
    cut = F.get_json_object("value", "$.amount").cast("double") < 1
    half = F.expr("substring(value, 1, cast(length(value) / 2 as int))")
    raw = msgs.withColumn("value", F.when(cut, half).otherwise(F.col("value")))
    parsed = ingest.parse_feature_events(raw)
    return parsed.groupBy("is_corrupt").agg(
        F.count("*").alias("messages"),
        F.sum(F.when(~F.col("is_corrupt"), F.round(F.col("amount") * 100).cast("bigint")).otherwise(0)).alias("cents"))


def _with_missing_features(df: DataFrame) -> DataFrame:
    """Add the feature columns a frame lacks as NULL."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in FEATURE_VECTOR.fields if f.name not in df.columns})


@query(f"""WITH {TX}, {STAGE_SQL}, good AS (SELECT * FROM staged WHERE stage IS NULL)
    SELECT transaction_id, CAST(count(*) OVER h AS INTEGER) AS tx_count_1h, CAST(count(*) OVER d AS INTEGER) AS tx_count_24h,
           CAST(sum(cents) OVER d / 100.0 AS DOUBLE) AS tx_sum_24h
    FROM good
    WINDOW h AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW),
           d AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def messages_to_velocity(spark, sf):
    """From raw messages to features: failed messages take no part in a user's history."""
    good = ingest.good_transactions(_parsed(spark, sf))
    return features.velocity_features(good).select("transaction_id", "tx_count_1h", "tx_count_24h", "tx_sum_24h")


# --- scoring ----------------------------------------------------------------------------------

def _raw_scores(spark, sf):
    """Model outputs in the shapes a model may return; some are outside [0, 1]."""
    e = A.read_events(spark, sf)
    p = F.col("value") / 400
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.when(F.col("event_type") == "click", F.array(1 - p, p)).otherwise(F.array(p)).alias("flat"),
        F.array(F.array(1 - p, p)).alias("matrix"),
    )


@query("""WITH s AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, event_type, value / 400 AS p FROM events),
    q AS (SELECT transaction_id, least(greatest(p, 0), 1) AS from_matrix,
            CASE WHEN event_type <> 'click' THEN least(greatest(p, 0), 1)
                 WHEN p BETWEEN 0 AND 1 THEN p ELSE least(greatest(1 - p, 0), 1) END AS from_flat FROM s)
    SELECT transaction_id, round(from_flat, 6) AS from_flat, round(from_matrix, 6) AS from_matrix FROM q""")
def probability_extraction(spark, sf):
    return _rounded(_raw_scores(spark, sf).select(
        "transaction_id", S.probability_of(F.col("flat")).alias("from_flat"),
        S.probability_of_matrix(F.col("matrix")).alias("from_matrix")), "from_flat", "from_matrix")


@query("""SELECT CAST(event_id AS VARCHAR) AS transaction_id, (event_id * 37 % 1000) / 1000.0 AS probability,
    (event_id * 37 % 1000) / 1000.0 AS fraud_probability,
    CASE WHEN event_id * 37 % 1000 < 400 THEN 'APPROVE' WHEN event_id * 37 % 1000 < 750 THEN 'REVIEW' ELSE 'BLOCK' END AS decision
    FROM events""")
def decisions(spark, sf):
    e = A.read_events(spark, sf)
    rows = e.select(F.col("event_id").cast("string").alias("transaction_id"), (F.col("event_id") * 37 % 1000 / 1000).alias("p"))
    return scoring.with_decision(rows, F.col("p")).select("transaction_id", "probability", "fraud_probability", "decision")


@query("""SELECT CASE WHEN value < 160 THEN 'APPROVE' WHEN value < 300 THEN 'REVIEW' ELSE 'BLOCK' END AS decision,
    count(*) AS requests FROM events GROUP BY 1""")
def decision_counts(spark, sf):
    rows = A.read_events(spark, sf).withColumn("p", F.col("value") / 400)
    return scoring.decision_counts(scoring.with_decision(rows, F.col("p")))


@query("""SELECT CASE event_type WHEN 'error' THEN 'amount is missing' WHEN 'view' THEN 'tx_count_1h is missing' END AS reject_reason,
    count(*) AS requests FROM events WHERE event_type IN ('error', 'view') GROUP BY 1""")
def scoring_rejects(spark, sf):
    """Requests as JSON text; `error` events lack the amount, `view` events send an ill-typed count."""
    e = A.read_events(spark, sf)
    kind = F.col("event_type")
    full = {c: F.lit(1) for c in FEATURE_COLS}
    full |= {f.name: F.lit(0.5) for f in FEATURE_VECTOR.fields if f.name in full and f.dataType == T.DoubleType()}
    full |= {"is_weekend": F.lit(True), "card_present": F.lit(True),
             "amount": F.when(kind != "error", F.col("value")),
             "tx_count_1h": F.when(kind == "view", F.lit("many")).otherwise(F.lit("1"))}
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("transaction_id"), *[v.alias(k) for k, v in full.items()]))
    unquoted = F.regexp_replace(body, '"tx_count_1h":"1"', '"tx_count_1h":1')
    return scoring.reject_counts(scoring.with_reject_reason(scoring.parse_requests(e.select(unquoted.alias("value")))))


# --- metrics ----------------------------------------------------------------------------------

def _scored(spark, sf):
    """Two candidates' probabilities beside the label."""
    e = A.read_events(spark, sf)
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        ((F.col("event_type") == "error") & (F.col("value") >= 50)).cast("int").alias("label"),
        (F.col("event_id") * 37 % 1000 / 1000).alias("boosted"),
        (F.col("value") / (F.col("value") + 50)).alias("leafwise"),
    )


VOTE_SQL = """
voted AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(event_type = 'error' AND value >= 50 AS INTEGER) AS label,
         (event_id * 37 % 1000) / 1000.0::DOUBLE AS boosted, value / (value + 50) AS leafwise,
         ((event_id * 37 % 1000) / 1000.0::DOUBLE + value / (value + 50)) / 2 AS ensemble FROM events),
long AS (
  SELECT 'boosted' AS candidate, label, boosted AS p FROM voted
  UNION ALL SELECT 'leafwise', label, leafwise FROM voted
  UNION ALL SELECT 'ensemble', label, ensemble FROM voted)
"""


def quality_sql(source: str, key: str) -> str:
    """Metrics by mid-ranks and by cumulative counts over distinct scores, from (key, label, p) rows."""
    return f"""
per_score AS (
  SELECT {key}, p, sum(label) AS pos, count(*) AS n FROM {source} WHERE label IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2),
cum AS (
  SELECT *, sum(pos) OVER w AS cpos, sum(n) OVER w AS cn FROM per_score
  WINDOW w AS (PARTITION BY {key} ORDER BY p DESC)),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY p) - n + (n + 1) / 2.0::DOUBLE AS mid FROM per_score),
auc AS (
  SELECT {key}, (sum(mid * pos) - sum(pos) * (sum(pos) + 1) / 2.0::DOUBLE) / (sum(pos) * (sum(n) - sum(pos)))::DOUBLE AS roc_auc
  FROM ranked GROUP BY 1),
ap AS (SELECT {key}, sum(pos * cpos / cn::DOUBLE) / sum(pos) AS pr_auc FROM cum GROUP BY 1),
agg AS (
  SELECT {key}, count(*) AS rows, sum(label) AS positives,
         sum(CASE WHEN p > 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN p > 0.5 AND label = 0 THEN 1 ELSE 0 END) AS fp,
         avg((p - label) * (p - label)) AS brier,
         avg(CASE WHEN label = 1 THEN -ln(greatest(p, 2.220446049250313e-16))
                  ELSE -ln(1 - least(p, 1 - 2.220446049250313e-16)) END) AS loss
  FROM {source} WHERE label IS NOT NULL AND p IS NOT NULL GROUP BY 1)
SELECT {key}, CAST(rows AS BIGINT) AS rows, CAST(positives AS BIGINT) AS positives, round(roc_auc, 6) AS roc_auc,
       round(pr_auc, 6) AS pr_auc,
       round(CASE WHEN tp + positives + fp > 0 THEN 2.0::DOUBLE * tp / (tp + positives + fp) ELSE 0 END, 6) AS f1,
       round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN positives > 0 THEN tp::DOUBLE / positives ELSE 0 END, 6) AS recall,
       round(brier, 6) AS brier_score_loss, round(loss, 6) AS log_loss,
       round((tp + rows - positives - fp)::DOUBLE / rows, 6) AS accuracy
FROM agg JOIN auc USING ({key}) JOIN ap USING ({key})"""


QUALITY_COLS = ["rows", "positives", "roc_auc", "pr_auc", "f1", "precision", "recall", "brier_score_loss", "log_loss", "accuracy"]


@query(f"WITH {VOTE_SQL}, {quality_sql('long', 'candidate')}")
def quality_metrics(spark, sf):
    m = training.evaluate_candidates(training.soft_vote(_scored(spark, sf)))
    return _rounded(m.select("candidate", *QUALITY_COLS), *QUALITY_COLS[2:])


@query("""WITH bounds AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]) AS b,
                               unnest(['1', '5', '10', '25', '50', '100', '250']) AS le),
    cells AS (SELECT event_type AS endpoint, le, sum(CASE WHEN value <= b THEN 1 ELSE 0 END) AS observations
              FROM events, bounds GROUP BY 1, 2)
    SELECT endpoint, le, CAST(observations AS BIGINT) AS observations FROM cells
    UNION ALL SELECT event_type, '+Inf', count(*) FROM events GROUP BY 1""")
def latency_histogram(spark, sf):
    log = A.request_log(A.read_events(spark, sf))
    return metrics.latency_histogram(log, ["endpoint"], "latency_ms", [1, 5, 10, 25, 50, 100, 250])


SUMMARY_SQL = """
  CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS requests_ok,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(avg(value), 2) AS mean_ms,
  round(quantile_cont(value, 0.5), 2) AS p50_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms,
  round(quantile_cont(value, 0.99), 2) AS p99_ms, round(quantile_cont(value, 0.999), 2) AS p99_9_ms,
  round(max(value), 2) AS max_ms, quantile_cont(value, 0.99) <= 50.0 AS pass_p99_le_50ms FROM events"""


@query(f"SELECT {SUMMARY_SQL}")
def latency_summary(spark, sf):
    return metrics.latency_summary(A.request_log(A.read_events(spark, sf)), [])


@query(f"SELECT event_type AS endpoint, {SUMMARY_SQL} GROUP BY 1")
def latency_summary_by_endpoint(spark, sf):
    return metrics.latency_summary(A.request_log(A.read_events(spark, sf)), ["endpoint"])


# --- training ---------------------------------------------------------------------------------

@query(f"""WITH {TX} SELECT count(*) AS rows, round(avg(label), 6) AS fraud_rate FROM tx""")
def training_stats(spark, sf):
    return _rounded(training.training_stats(_tx(spark, sf)), "fraud_rate")


SPLIT_SQL = """
split AS (
  SELECT transaction_id, label, CASE WHEN (r - 1) * 10 < 8 * n THEN 'train' WHEN (r - 1) * 10 < 9 * n THEN 'val' ELSE 'test' END AS part
  FROM (SELECT transaction_id, label, count(*) OVER (PARTITION BY label) AS n,
               row_number() OVER (PARTITION BY label ORDER BY md5('42:' || transaction_id), transaction_id) AS r FROM tx))
"""


@query(f"WITH {TX}, {SPLIT_SQL} SELECT transaction_id, label, part FROM split")
def stratified_split(spark, sf):
    return training.stratified_split(_tx(spark, sf)).select("transaction_id", "label", "part")


@query(f"""WITH {TX}, {SPLIT_SQL} SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives,
    round(sum(1 - label)::DOUBLE / greatest(sum(label), 1), 6) AS scale_pos_weight FROM split WHERE part = 'train'""")
def class_weight(spark, sf):
    split = training.stratified_split(_tx(spark, sf))
    return _rounded(training.class_weight(split.filter("part = 'train'")), "scale_pos_weight")


@query(f"WITH {VOTE_SQL} SELECT transaction_id, round(ensemble, 6) AS ensemble FROM voted")
def soft_vote(spark, sf):
    return _rounded(training.soft_vote(_scored(spark, sf)).select("transaction_id", "ensemble"), "ensemble")


@query(f"""WITH {TX}, runs AS (
      SELECT merchant_id AS model_name, strftime(ts, '%Y-%m-%d') AS run_id,
             CASE WHEN count(*) > 2 THEN sum(cents)::DOUBLE / count(*) / 20000 END AS gate_metric FROM tx GROUP BY 1, 2),
    flagged AS (
      SELECT *, row_number() OVER w = 1 OR coalesce(gate_metric, 0) >
          max(coalesce(gate_metric, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS promoted
      FROM runs WINDOW w AS (PARTITION BY model_name ORDER BY run_id))
    SELECT model_name, run_id, gate_metric, promoted,
           CASE WHEN run_id = max(CASE WHEN promoted THEN run_id END) OVER (PARTITION BY model_name)
                THEN 'Production' ELSE 'Archived' END AS stage FROM flagged""")
def promotion_history(spark, sf):
    """A model per merchant with a run per day; days of few transactions have no metric."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_us") / 86_400_000_000).cast("int")).cast("string")
    runs = _tx(spark, sf).groupBy(F.col("merchant_id").alias("model_name"), day.alias("run_id")).agg(
        F.when(F.count("*") > 2, F.sum(F.round(F.col("amount") * 100).cast("bigint")) / F.count("*") / 20000).alias("gate_metric"))
    runs = runs.withColumn("created_at", F.to_timestamp("run_id", "yyyy-MM-dd"))
    return training.promotion_history(runs).drop("created_at")


# --- monitoring -------------------------------------------------------------------------------

@query(f"""WITH {TX}, p AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, (event_id * 37 % 1000) / 1000.0 AS probability,
      ts + INTERVAL 5 MINUTE AS scored_at FROM events WHERE event_type <> 'view'),
    alive AS (SELECT * FROM p WHERE scored_at <= TIMESTAMP '2024-01-20 00:00:00'
      AND TIMESTAMP '2024-01-20 00:00:00' <= scored_at + INTERVAL 7 DAY)
    SELECT transaction_id, CAST(coalesce(probability, 0.0) AS DOUBLE) AS prediction, probability IS NULL AS prediction_missing
    FROM tx LEFT JOIN alive USING (transaction_id)""")
def prediction_join(spark, sf):
    """The store as seen on 2024-01-20 with a lifetime of seven days."""
    e = A.read_events(spark, sf)
    as_of = F.timestamp_seconds(F.lit(1_705_708_800))
    joined = scoring.join_predictions(A.transactions(e), A.predictions(e), as_of, 7 * 86400)
    return joined.select("transaction_id", "prediction", "prediction_missing")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows,
    CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS prediction_misses FROM events GROUP BY 1""")
def prediction_misses(spark, sf):
    """Rows without a stored prediction per day, over a store that keeps everything."""
    e = A.read_events(spark, sf)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_us") / 86_400_000_000).cast("int")).cast("string")
    joined = scoring.join_predictions(A.transactions(e), A.predictions(e), F.timestamp_seconds(F.lit(1_706_745_600)), 60 * 86400)
    return joined.groupBy(day.alias("day")).agg(
        F.count("*").alias("rows"), F.sum(F.col("prediction_missing").cast("bigint")).alias("prediction_misses"))


@query(f"""WITH {TX} SELECT transaction_id, CAST((row_number() OVER (ORDER BY ts_us, transaction_id) - 1) // 2000 AS BIGINT) AS report_id FROM tx""")
def report_slices(spark, sf):
    tx = _tx(spark, sf).withColumn("source", F.lit("transactions.features"))
    return drift.report_slices(tx, "source", "ts_us", "transaction_id").select("transaction_id", "report_id")


DRIFT_NUM = ["amount", "amount_log", "doubled", "hour_of_day"]
DRIFT_CAT = ["card_present", "merchant_category", "day_of_week"]

FRAMES_SQL = f"""WITH {TX}, frames AS (
  SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END AS frame, amount,
         ln(1 + amount) AS amount_log, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN amount ELSE amount * 2 END AS doubled,
         CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(card_present AS VARCHAR) AS card_present, merchant_category,
         CAST(isodow(ts) - 1 AS VARCHAR) AS day_of_week, label,
         CASE WHEN merchant_category <> 'view' THEN (event_id * 37 % 1000) / 1000.0::DOUBLE ELSE 0.0 END AS prediction
  FROM tx),
num AS (
  {" UNION ALL ".join(f"SELECT frame, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM frames" for c in DRIFT_NUM)}),
cat AS (
  {" UNION ALL ".join(f"SELECT frame, '{c}' AS col, {c} AS v FROM frames" for c in DRIFT_CAT)})"""


def _frames(spark, sf):
    """Baseline before 2024-01-16 and current rows from then on; `doubled` is shifted on purpose."""
    e = A.read_events(spark, sf)
    tx = features.with_calendar(A.transactions(e))
    id_ = F.col("transaction_id").cast("bigint")
    scored = F.col("merchant_category") != "view"
    tx = tx.withColumn("prediction", F.when(scored, id_ * 37 % 1000 / 1000).otherwise(0.0))
    cut = 1_705_363_200_000_000
    return (tx.filter(F.col("ts_us") < cut).withColumn("doubled", F.col("amount")),
            tx.filter(F.col("ts_us") >= cut).withColumn("doubled", F.col("amount") * 2))


DISTANCE_NUM_SQL = """
hist AS (
  SELECT col, v, sum(CASE frame WHEN 'reference' THEN 1 ELSE 0 END) AS r, sum(CASE frame WHEN 'current' THEN 1 ELSE 0 END) AS c
  FROM num GROUP BY 1, 2),
cdf AS (
  SELECT *, lead(v) OVER w - v AS step, sum(r) OVER w / (sum(r) OVER (PARTITION BY col))::DOUBLE AS fr,
         sum(c) OVER w / (sum(c) OVER (PARTITION BY col))::DOUBLE AS fc
  FROM hist WINDOW w AS (PARTITION BY col ORDER BY v)),
w1 AS (
  SELECT col, sum(abs(fr - fc) * coalesce(step, 0)) AS w, max(abs(fr - fc)) AS ks, sum(r) AS n_ref, sum(c) AS n_cur,
         count(*) AS n_values FROM cdf GROUP BY 1),
sd AS (SELECT col, stddev_pop(v) AS sd FROM num WHERE frame = 'reference' GROUP BY 1),
js_num AS (
  SELECT col, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END
                              + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END), 0) / 2) AS js
  FROM (SELECT col, r / (sum(r) OVER (PARTITION BY col))::DOUBLE AS p, c / (sum(c) OVER (PARTITION BY col))::DOUBLE AS q FROM hist)
  GROUP BY 1)"""

DISTANCE_CAT_SQL = """
hist_cat AS (
  SELECT col, v, sum(CASE frame WHEN 'reference' THEN 1 ELSE 0 END) AS r, sum(CASE frame WHEN 'current' THEN 1 ELSE 0 END) AS c
  FROM cat GROUP BY 1, 2),
shares AS (
  SELECT *, sum(r) OVER t AS tr, sum(c) OVER t AS tc FROM hist_cat WINDOW t AS (PARTITION BY col)),
js_cat AS (
  SELECT col, max(tr) AS n_ref, max(tc) AS n_cur, count(*) AS n_values,
         sqrt(greatest(sum(CASE WHEN r > 0 THEN r / tr::DOUBLE * ln(2 * (r / tr::DOUBLE) / (r / tr::DOUBLE + c / tc::DOUBLE)) ELSE 0 END
                         + CASE WHEN c > 0 THEN c / tc::DOUBLE * ln(2 * (c / tc::DOUBLE) / (r / tr::DOUBLE + c / tc::DOUBLE)) ELSE 0 END), 0) / 2) AS js,
         sum(CASE WHEN r > 0 THEN (c - r * tc / tr::DOUBLE) * (c - r * tc / tr::DOUBLE) / (r * tc / tr::DOUBLE) ELSE 'inf'::DOUBLE END) AS chi
  FROM shares GROUP BY 1)"""


@query(f"""{FRAMES_SQL}, {DISTANCE_NUM_SQL} SELECT col AS "column", CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
    n_values, round(w / greatest(sd, 0.001), 6) AS wasserstein, round(ks, 6) AS ks, round(js, 6) AS jensen_shannon
    FROM w1 JOIN sd USING (col) JOIN js_num USING (col)""")
def drift_numeric(spark, sf):
    d = drift.numeric_distances(*_frames(spark, sf), DRIFT_NUM)
    return _rounded(d.select("column", "n_ref", "n_cur", "n_values", "wasserstein", "ks", "jensen_shannon"),
                    "wasserstein", "ks", "jensen_shannon")


@query(f"""{FRAMES_SQL}, {DISTANCE_CAT_SQL} SELECT col AS "column", CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
    n_values, round(js, 6) AS jensen_shannon, round(chi, 6) AS chi_square FROM js_cat""")
def drift_categorical(spark, sf):
    d = drift.categorical_distances(*_frames(spark, sf), DRIFT_CAT)
    return _rounded(d.select("column", "n_ref", "n_cur", "n_values", "jensen_shannon", "chi_square"),
                    "jensen_shannon", "chi_square")


@query(f"""{FRAMES_SQL}, {DISTANCE_NUM_SQL}, lambdas AS (
      SELECT *, (sqrt(n_ref * n_cur / (n_ref + n_cur)::DOUBLE) + 0.12 + 0.11 / sqrt(n_ref * n_cur / (n_ref + n_cur)::DOUBLE)) * ks AS x FROM w1),
    terms AS (SELECT col, x, 2 * (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * i * i * x * x) AS term FROM lambdas, range(1, 101) t(i))
    SELECT col AS "column", round(CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(sum(term), 0.0), 1.0) END, 6) AS p_value,
           CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(sum(term), 0.0), 1.0) END < 0.05 AS drifted
    FROM terms GROUP BY col, x""")
def drift_p_values(spark, sf):
    """The KS test of each numerical column, whatever the size of the baseline."""
    d = drift.numeric_distances(*_frames(spark, sf), DRIFT_NUM)
    p = drift.ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_cur"))
    return d.select("column", F.round(p, 6).alias("p_value"), (p < drift.P_VALUE_THRESHOLD).alias("drifted"))


COLUMNS_SQL = f"""{FRAMES_SQL}, {DISTANCE_NUM_SQL}, {DISTANCE_CAT_SQL}, scored AS (
    SELECT col, 'num' AS kind, 'wasserstein' AS method,
           w / greatest(sd, 0.001) AS score FROM w1 JOIN sd USING (col)
    UNION ALL SELECT col, 'cat', 'jensen_shannon', js FROM js_cat)"""


@query(f"""{COLUMNS_SQL} SELECT col AS "column", kind, method, round(score, 6) AS score, 0.1::DOUBLE AS threshold,
    score >= 0.1 AS drifted FROM scored""")
def drift_columns(spark, sf):
    d = drift.drift_columns(*_frames(spark, sf), DRIFT_NUM, DRIFT_CAT)
    return _rounded(d.select("column", "kind", "method", "score", "threshold", "drifted"), "score")


@query(f"""{COLUMNS_SQL} SELECT count(*) AS n_columns, CAST(sum(CASE WHEN score >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_drifted,
    round(avg(CASE WHEN score >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share_of_drifted_columns, 0.3::DOUBLE AS drift_share_threshold,
    avg(CASE WHEN score >= 0.1 THEN 1.0 ELSE 0.0 END) >= 0.3 AS dataset_drift FROM scored""")
def dataset_drift(spark, sf):
    columns = drift.drift_columns(*_frames(spark, sf), DRIFT_NUM, DRIFT_CAT)
    return _rounded(drift.dataset_drift(columns), "share_of_drifted_columns")


@query(f"""{FRAMES_SQL}, counted AS (SELECT frame, col, v, count(*) AS n FROM num GROUP BY 1, 2, 3),
    modes AS (SELECT frame, col, first(v ORDER BY n DESC, v) AS mode, max(n) AS mode_n FROM counted GROUP BY 1, 2),
    counted_cat AS (SELECT frame, col, v, count(*) AS n FROM cat GROUP BY 1, 2, 3),
    modes_cat AS (SELECT frame, col, first(v ORDER BY n DESC, v DESC) AS mode, max(n) AS mode_n, count(*) AS dv, sum(n) AS rows
                  FROM counted_cat GROUP BY 1, 2)
    SELECT frame, col AS "column", 'num' AS kind, count(*) AS rows, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values,
           round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
           round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max, any_value(mode_n) AS most_common_rows,
           CAST(NULL AS VARCHAR) AS most_common
    FROM num JOIN modes USING (frame, col) GROUP BY 1, 2
    UNION ALL
    SELECT frame, col, 'cat', CAST(rows AS BIGINT), 0, dv, NULL, NULL, NULL, NULL, NULL, NULL, NULL, mode_n, mode FROM modes_cat""")
def data_quality(spark, sf):
    ref, cur = _frames(spark, sf)
    both = ref.withColumn("frame", F.lit("reference")).unionByName(cur.withColumn("frame", F.lit("current")))
    q = drift.data_quality(both, ["frame"], DRIFT_NUM, DRIFT_CAT)
    # doubles print differently in the two engines, so the mode's text is compared for categories only
    q = q.withColumn("most_common", F.when(F.col("kind") == "cat", F.col("most_common")))
    return _rounded(q, "mean", "std", "min", "p25", "p50", "p75", "max")


@query(f"""{FRAMES_SQL}, frame_scores AS (SELECT frame, label, prediction AS p FROM frames), {quality_sql('frame_scores', 'frame')}""")
def classification_quality(spark, sf):
    m = drift.classification_quality(*_frames(spark, sf))
    return _rounded(m.select("frame", *QUALITY_COLS), *QUALITY_COLS[2:])


# --- sizes, gaps and faults that the events themselves do not have -----------------------------

@query(f"""WITH {TX}, {SESSIONS_SQL}, {MOMENTS_SQL}, {VELOCITY_SQL}
    SELECT transaction_id, CAST(tx_count_24h AS INTEGER) AS tx_count_24h, round(CAST(tx_sum_24h AS DOUBLE), 2) AS tx_sum_24h,
           CAST(n AS BIGINT) AS prior_count, round(s / 100.0, 2) AS prior_sum
    FROM velocity JOIN moments USING (transaction_id)""")
def large_amounts(spark, sf):
    """Amounts times 10^10, many of them beyond the exact sums; results are scaled back."""
    tx = _tx(spark, sf).withColumn("amount", F.col("amount") * 1e10)
    out = features.history_features(tx, groups=("velocity", "moments"))
    return out.select("transaction_id", "tx_count_24h", F.round(F.col("tx_sum_24h") / 1e10, 2).alias("tx_sum_24h"), "prior_count",
                      F.round(F.col("prior_sum") / 1e10, 2).alias("prior_sum"))


@query(f"""WITH {TX}, replayed AS (
      SELECT user_id, transaction_id, copy, cents * 1000000 + CASE WHEN copy = 2 THEN 1 ELSE 0 END AS tiny, ts_us + copy * 60000000 AS ts_us
      FROM tx, (SELECT unnest([0, 1, 2]) AS copy)),
    pairs AS (
      SELECT DISTINCT a.transaction_id, a.copy, b.transaction_id AS other, b.tiny
      FROM replayed a JOIN replayed b ON a.user_id = b.user_id AND b.ts_us BETWEEN a.ts_us - 86400000000 AND a.ts_us)
    SELECT transaction_id, CAST(copy AS INTEGER) AS copy, CAST(count(*) AS INTEGER) AS tx_count_24h,
           round(CAST(sum(tiny) AS DOUBLE) / 1e8, 8) AS tx_sum_24h FROM pairs GROUP BY 1, 2""")
def fine_amounts(spark, sf):
    """Each row comes again a minute later, and once more with an amount that differs in the eighth decimal."""
    tx = _tx(spark, sf).select("transaction_id", "user_id", "amount", "ts_us").withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    tx = tx.withColumns({"amount": F.when(F.col("copy") == 2, F.round(F.col("amount") + 1e-8, 8)).otherwise(F.col("amount")),
                         "ts_us": F.col("ts_us") + F.col("copy") * F.lit(60_000_000)})
    out = features.velocity_features(tx)
    return out.select("transaction_id", "copy", "tx_count_24h", F.round("tx_sum_24h", 8).alias("tx_sum_24h"))


STRETCHED = TX.replace("epoch_us(ts) AS ts_us", "1704067200000000 + (epoch_us(ts) - 1704067200000000) * 60 AS ts_us")


@query(f"""WITH {STRETCHED}, {SESSIONS_SQL}, {DISTINCT_SQL}, {MOMENTS_SQL}
    SELECT transaction_id, CAST(unique_countries_7d AS INTEGER) AS unique_countries_7d, CAST(n AS BIGINT) AS prior_count,
           CAST(f AS BIGINT) AS prior_fraud FROM distinct_ttl JOIN moments USING (transaction_id)""")
def idle_resets(spark, sf):
    """Times stretched sixtyfold, so that gaps of more than a week and a month end sessions."""
    start = F.lit(1_704_067_200_000_000)
    tx = _tx(spark, sf).withColumn("ts_us", start + (F.col("ts_us") - start) * 60)
    return features.history_features(tx, groups=("distinct", "moments")).select(
        "transaction_id", "unique_countries_7d", "prior_count", "prior_fraud")


@query(f"""WITH {TX}, {STAGE_SQL} SELECT transaction_id, CAST(event_id AS VARCHAR) || 'u' AS user_id, amount FROM staged WHERE stage IS NULL""")
def duplicate_keys(spark, sf):
    """Records whose first amount is out of range: the last value of a key counts, also where ids begin with digits."""
    raw = A.raw_messages(A.read_events(spark, sf))
    text = F.regexp_replace(F.col("value").cast("string"), F.lit('"user_id":"[^"]*"'), F.concat(F.lit('"user_id":"'), F.col("offset"), F.lit('u"')))
    raw = raw.withColumn("value", F.concat(F.lit('{"amount":-5,'), F.substring(text, F.lit(2), F.length(text))).cast("binary"))
    whole = raw.filter(F.col("value").cast("string").rlike('"amount":[0-9].*}$'))
    return ingest.good_transactions(ingest.parse_messages(whole)).select("transaction_id", "user_id", "amount")


@query("""SELECT error, 'transform' AS stage, count(*) AS messages FROM (
      SELECT CASE event_type WHEN 'click' THEN 'amount has the wrong type' WHEN 'view' THEN 'card_present has the wrong type'
             WHEN 'error' THEN 'amount is out of range' ELSE '''country''' END AS error FROM events) GROUP BY 1, 2""")
def typed_failures(spark, sf):
    """Text as amount, a number as flag, an amount below the domain, a missing country."""
    kind = F.col("merchant_category")
    tx = _tx(spark, sf)
    text = F.to_json(F.struct(
        "transaction_id", "user_id", "merchant_id", F.when(kind == "error", F.lit(-3.0)).otherwise(F.col("amount")).alias("amount"), "timestamp",
        "merchant_category", F.when(kind.isin("click", "view", "error"), F.col("country")).alias("country"), "card_present"))
    text = F.when(kind == "click", F.regexp_replace(text, '"amount":([0-9.E-]+)', '"amount":"$1"')).when(
        kind == "view", F.regexp_replace(text, '"card_present":(true|false)', '"card_present":1')).otherwise(text)
    raw = tx.select(F.col("user_id").cast("binary").alias("key"), text.cast("binary").alias("value"), F.lit("transactions.raw").alias("topic"),
                    F.lit(0).alias("partition"), F.col("transaction_id").cast("bigint").alias("offset"))
    return ingest.dead_letters(ingest.parse_messages(raw)).groupBy("error", "stage").agg(F.count("*").alias("messages"))


@query(f"""WITH {TX}, {STAGE_SQL} SELECT event_id AS "offset", '2024-02-03T04:05:06.000007+00:00' AS ts_utc, user_id AS message_key,
    stage, CAST(NULL AS VARCHAR) AS original_payload_base64 FROM staged WHERE stage IS NOT NULL""")
def dead_letter_json(spark, sf):
    """Dead letters as topic messages and back, at a fixed instant."""
    letters = ingest.dead_letters(_parsed(spark, sf), F.to_timestamp(F.lit("2024-02-03T04:05:06.000007Z")))
    fields = "offset bigint, ts_utc string, message_key string, stage string, original_payload_base64 string"
    return ingest.dead_letter_messages(letters).select(F.from_json("value", fields).alias("v")).select("v.*")


@query(f"""WITH {TX} SELECT transaction_id, CASE WHEN event_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
    CASE WHEN event_id % 3 = 0 THEN 1706745600.0::DOUBLE ELSE "timestamp" END AS "timestamp" FROM tx""")
def defaults(spark, sf):
    """Missing currencies and times take their defaults."""
    odd, third = F.col("transaction_id").cast("bigint") % 2 == 1, F.col("transaction_id").cast("bigint") % 3 == 0
    tx = _tx(spark, sf).withColumns({"currency": F.when(odd, "EUR"), "timestamp": F.when(~third, F.col("timestamp"))})
    return ingest.with_defaults(tx, F.to_timestamp(F.lit("2024-02-01T00:00:00Z"))).select("transaction_id", "currency", "timestamp")


@query("""SELECT CAST(event_id AS VARCHAR) AS transaction_id, round((event_id * 7919 % 1000003) / 1000003.0::DOUBLE, 4) AS fraud_probability
    FROM events""")
def decision_rounding(spark, sf):
    rows = A.read_events(spark, sf).select(F.col("event_id").cast("string").alias("transaction_id"), (F.col("event_id") * 7919 % 1000003 / 1000003).alias("p"))
    return scoring.with_decision(rows, F.col("p")).select("transaction_id", "fraud_probability")


@query(f"""WITH v AS ({FEATURES_SQL}) SELECT transaction_id, CAST(tx_count_1h AS DOUBLE) AS tx_count_1h, CAST(is_weekend AS DOUBLE) AS is_weekend,
    CAST(card_present AS DOUBLE) AS card_present, CAST(day_of_week AS DOUBLE) AS day_of_week, tx_sum_24h FROM v""")
def model_input(spark, sf):
    return scoring.model_input(_vector(spark, sf)).select("transaction_id", "tx_count_1h", "is_weekend", "card_present", "day_of_week", "tx_sum_24h")


@query("""SELECT CASE WHEN event_type = 'error' THEN 'validation' ELSE 'model_unavailable' END AS error, count(*) AS requests
    FROM events GROUP BY 1""")
def scoring_errors(spark, sf):
    """Without a model: rows without an amount are invalid, all others are refused."""
    e = A.read_events(spark, sf)
    full = {c: F.lit(1) for c in FEATURE_COLS} | {"amount": F.when(F.col("event_type") != "error", F.col("value"))}
    rows = e.select(F.col("event_id").cast("string").alias("transaction_id"), *[v.alias(k) for k, v in full.items()])
    return scoring.error_counts(scoring.with_reject_reason(rows), model_available=False)


@query(f"""{COLUMNS_SQL} SELECT col AS "column", CASE WHEN col = 'doubled' THEN NULL ELSE round(score, 6) END AS score,
    CASE WHEN col = 'doubled' THEN true ELSE score >= 0.1 END AS drifted, CASE WHEN col = 'doubled' THEN 0 ELSE n_cur END AS n_cur
    FROM scored JOIN (SELECT col, CAST(n_cur AS BIGINT) AS n_cur FROM w1 UNION ALL SELECT col, CAST(n_cur AS BIGINT) FROM js_cat) USING (col)""")
def drift_missing_column(spark, sf):
    """A column that is empty in the current frame stays in the report, as drifted."""
    ref, cur = _frames(spark, sf)
    d = drift.drift_columns(ref, cur.withColumn("doubled", F.lit(None).cast("double")), DRIFT_NUM, DRIFT_CAT)
    return _rounded(d.select("column", "score", "drifted", "n_cur"), "score")


@query("""WITH n AS (SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS r, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS c
      FROM events GROUP BY 1),
    chi AS (SELECT sum((c - r * tc / tr) * (c - r * tc / tr) / (r * tc / tr)) / 2 AS h FROM n, (SELECT sum(r)::DOUBLE AS tr, sum(c)::DOUBLE AS tc FROM n))
    SELECT 'merchant_category' AS "column", 'chi_square' AS method, round(exp(-h) * (1 + h), 6) AS score FROM chi""")
def drift_chi_square(spark, sf):
    """Five categories, so four degrees of freedom, for which the tail has a short form."""
    d = drift.drift_columns(*_frames(spark, sf), [], ["merchant_category"], method="p_value")
    return _rounded(d.select("column", "method", "score"), "score")


@query(f"""{FRAMES_SQL} SELECT frame, count(*) AS rows, round(avg(CAST(label AS DOUBLE)), 6) AS prediction FROM frames GROUP BY 1""")
def baseline_quality(spark, sf):
    """Frames without predictions take the labels."""
    ref, cur = _frames(spark, sf)
    both = [drift.baseline_with_prediction(f.drop("prediction")).withColumn("frame", F.lit(n)) for n, f in (("reference", ref), ("current", cur))]
    out = both[0].unionByName(both[1]).groupBy("frame").agg(F.count("*").alias("rows"), F.avg("prediction").alias("prediction"))
    return _rounded(out, "prediction")


# --- sketches, boosting and staged scores --------------------------------------------------------

@query(f"""WITH {TX}, sliced AS (SELECT *, ts_us // 3600000000 AS hour_slice, ts_us // 86400000000 AS day_slice FROM tx)
    SELECT a.transaction_id, CAST(count(DISTINCT CASE WHEN b.hour_slice > a.hour_slice - 24 THEN b.merchant_id END) AS INTEGER) AS unique_merchants_24h,
           CAST(count(DISTINCT b.country) AS INTEGER) AS unique_countries_7d
    FROM sliced a JOIN sliced b ON a.user_id = b.user_id AND b.day_slice > a.day_slice - 7 AND (b.ts_us, b.transaction_id) <= (a.ts_us, a.transaction_id)
    GROUP BY 1""")
def distinct_hll(spark, sf):
    """Merged sketches per hour and day; below 400 members a sketch's estimate is the exact count."""
    return features.distinct_features(_tx(spark, sf), FeatureOptions(distinct_mode="hll")).select(
        "transaction_id", "unique_merchants_24h", "unique_countries_7d")


@query("""SELECT event_type AS endpoint, quantile, count(*) AS observations, true AS within_bound
    FROM events, (SELECT unnest(['p50', 'p95', 'p99', 'p99_9']) AS quantile) GROUP BY 1, 2""")
def latency_sketch_errors(spark, sf):
    """Sketches per endpoint and day, merged over the days, against the true ranks of their quantiles."""
    e = A.read_events(spark, sf)
    log = A.request_log(e).join(e.select(F.col("event_id").alias("request_id"), F.to_date("ts").alias("day")), "request_id")
    merged = sketches.merged_sketches(sketches.latency_sketches(log, ["endpoint"], F.col("day")), ["endpoint"])
    found = sketches.quantile_errors(log, merged, ["endpoint"])
    return found.select("endpoint", "quantile", "observations", (F.col("rank_error") <= sketches.RANK_ERROR).alias("within_bound"))


@query(f"SELECT {SUMMARY_SQL}")
def latency_report(spark, sf):
    """The summary written as JSON and read again."""
    summary = metrics.latency_summary(A.request_log(A.read_events(spark, sf)), [])
    return metrics.summary_json(summary).select(F.from_json("value", summary.schema).alias("v")).select("v.*")


STAGED_SQL = """
staged AS (
  SELECT CAST(round AS INTEGER) AS round, CAST(event_type = 'error' AND value >= 50 AS INTEGER) AS label,
         (event_id * (37 + (round % 4) * 2) % 1009) / 1009.0::DOUBLE AS p FROM events, range(1, 9) t(round))
"""


@query(f"""WITH {STAGED_SQL}, precision_of AS ({quality_sql("staged", "round").replace("per_score AS", "WITH per_score AS", 1)}),
    best AS (
      SELECT round, pr_auc, -(max({{'a': pr_auc, 'b': -round}}) OVER (ORDER BY round)).b AS best_round FROM precision_of)
    SELECT round, pr_auc, best_round, round - best_round AS stale, max(round - best_round >= 3) OVER (ORDER BY round) AS stopped FROM best""")
def early_stopping(spark, sf):
    """Average precision after each of eight rounds of staged scores, and when three stale rounds end a fit."""
    e = A.read_events(spark, sf)
    label = ((F.col("event_type") == "error") & (F.col("value") >= 50)).cast("int")
    staged = e.select(label.alias("label"), "event_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("round")).withColumn(
        "probability", F.col("event_id") * (37 + F.col("round") % 4 * 2) % 1009 / 1009)
    rounded = _rounded(boosting.staged_precision(staged), "pr_auc")
    return boosting.with_staleness(rounded, 3).select("round", "pr_auc", "best_round", "stale", "stopped")


SPLIT_FEATURES = ["amount", "hour_of_day", "k"]

_GAIN = """round((gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) / 2, 6)"""


def _level_sql(level: str, rows: str) -> str:
    """Best cut per node of (node, f, bin, g, h) rows: ties go to the first feature, then to the lowest bin."""
    return f"""
{level}_hist AS (SELECT node, f, bin, sum(g) / 1048576 AS g, sum(h) / 1048576 AS h FROM {rows} GROUP BY 1, 2, 3),
{level}_cuts AS (
  SELECT node, f, bin, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER w AS g, sum(h) OVER w AS h FROM {level}_hist
  WINDOW w AS (PARTITION BY node, f), u AS (PARTITION BY node, f ORDER BY bin)),
{level} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) AS place FROM (
    SELECT node, f, bin, {_GAIN} AS gain FROM {level}_cuts WHERE hl >= 10 AND h - hl >= 10) WHERE gain > 0) WHERE place = 1)"""


@query(f"""WITH {TX}, base AS (SELECT avg(label::DOUBLE) AS p FROM tx),
    long AS (
      SELECT event_id, label, 0 AS f, amount::DOUBLE AS v FROM tx UNION ALL SELECT event_id, label, 1, hour(ts)::DOUBLE FROM tx
      UNION ALL SELECT event_id, label, 2, k::DOUBLE FROM tx),
    steps AS (
      SELECT f, v, n, CAST(sum(n) OVER (PARTITION BY f ORDER BY v) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY f) AS BIGINT) AS total
      FROM (SELECT f, v, count(*) AS n FROM long GROUP BY 1, 2)),
    edges AS (
      SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS bin FROM steps
      WHERE upto * 16 // total > (upto - n) * 16 // total AND upto < total),
    counted AS (
      SELECT l.event_id, l.f, l.label, (SELECT count(*) FROM edges e WHERE e.f = l.f AND e.v < l.v) AS bin FROM long l),
    root_rows AS (
      SELECT 0 AS node, event_id, f, bin, round((p - label) * 1048576) AS g, round(p * (1 - p) * 1048576) AS h FROM counted, base),
    {_level_sql("root", "root_rows")},
    sides AS (SELECT r.event_id, 1 + CAST(r.bin > t.bin AS INTEGER) AS node FROM root_rows r JOIN root t ON r.f = t.f),
    child_rows AS (SELECT s.node, r.f, r.bin, r.g, r.h FROM root_rows r JOIN sides s USING (event_id)),
    {_level_sql("children", "child_rows")}
    SELECT CAST(node AS INTEGER) AS node, ['amount', 'hour_of_day', 'k'][f + 1] AS feature, round(e.v, 6) AS threshold, gain
    FROM (SELECT node, f, bin, gain FROM root UNION ALL SELECT node, f, bin, gain FROM children) JOIN edges e USING (f, bin)""")
def boosted_splits(spark, sf):
    """The first tree of a fit, two levels deep."""
    tx = features.with_calendar(_tx(spark, sf)).withColumn("k", F.regexp_extract("merchant_id", r"(\d+)$", 1).cast("double"))
    rows = tx.withColumns({"weight": F.lit(1.0), "is_val": F.lit(False)})
    opts = TrainingOptions(depth=2, bins=16, subsample=1.0, column_sample=1.0, rounds=1, leaves=4)
    return boosting.first_splits(rows, SPLIT_FEATURES, opts)


# --- live queries over the events as files, run to their end ------------------------------------

#: Messages of a file, and files of a micro-batch at most; few messages are put into four files.
FILE_ROWS, BATCH_FILES = 1 << 18, 8


def _messages(spark, sf, file_rows: int = FILE_ROWS) -> tuple[SparkSession, str, int]:
    """The raw messages as a folder of files, a session of its own for the settings of a stream, and the number of files,
    which grows with the messages."""
    own = spark.newSession()
    live.use_rocksdb(own)
    folder = shared_folder(own, "live")
    events = A.read_events(own, sf)
    files = max(4, -(-events.count() // file_rows))
    A.raw_messages(events).repartitionByRange(files, "offset").write.parquet(f"{folder}/messages")
    return own, folder, files


def _routed(spark, sf, table: str) -> DataFrame:
    own, folder, files = _messages(spark, sf)
    messages = tables.message_stream(own, f"{folder}/messages", min(files // 4, BATCH_FILES))
    routing.route_messages(messages, f"{folder}/routed", f"{folder}/checkpoint").awaitTermination()
    return routing.read_routed(own, f"{folder}/routed", table)


@query(SQL["parse_ok"])
def routed_transactions(spark, sf):
    """The good rows that a routing stream has published."""
    return _routed(spark, sf, "good").drop("device_fingerprint")


@query(SQL["dead_letters"])
def routed_dead_letters(spark, sf):
    return _routed(spark, sf, "dead_letters").select("error", "message_key", "offset", "partition", "source_topic", "stage")


@query(f"""WITH {TX}, {STAGE_SQL}, {SESSIONS_SQL.replace("FROM tx)", "FROM staged WHERE stage IS NULL)", 1)}, {DISTINCT_SQL}, {MOMENTS_SQL}
    SELECT t.transaction_id, CAST(count(*) OVER h AS INTEGER) AS tx_count_1h, CAST(count(*) OVER d AS INTEGER) AS tx_count_24h,
           CAST(sum(cents) OVER d / 100.0 AS DOUBLE) AS tx_sum_24h, CAST(unique_merchants_24h AS INTEGER) AS unique_merchants_24h,
           CAST(unique_countries_7d AS INTEGER) AS unique_countries_7d, round(z, 6) AS amount_zscore, round(chargeback, 6) AS user_chargeback_rate
    FROM staged t JOIN distinct_ttl USING (transaction_id) JOIN stats USING (transaction_id) WHERE stage IS NULL
    WINDOW h AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW),
           d AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def stream_features(spark, sf):
    """The feature stream's output table, taken in order of time as messages of a user arrive."""
    own, folder, files = _messages(spark, sf)
    stream = live.feature_stream(tables.message_stream(own, f"{folder}/messages", files), order=("ts_us", "transaction_id"))
    live.write_features(stream, f"{folder}/features", f"{folder}/checkpoint").awaitTermination()
    out = own.read.parquet(f"{folder}/features")
    return _rounded(out.select("transaction_id", "tx_count_1h", "tx_count_24h", "tx_sum_24h", "unique_merchants_24h", "unique_countries_7d",
                               "amount_zscore", "user_chargeback_rate"), "amount_zscore", "user_chargeback_rate")


@query(SQL["report_slices"])
def queued_slices(spark, sf):
    """Feature rows that came in three micro-batches, by the report that their place in the queue puts them in."""
    folder = shared_folder(spark, "queue")
    rows = _with_missing_features(_tx(spark, sf)).select(*FEATURE_VECTOR.names)
    days = [1_704_067_200 + 86_400 * d for d in (0, 8, 20, 400)]
    for batch_id, (first, last) in enumerate(zip(days, days[1:])):
        reports.append_features(rows.filter((F.col("timestamp") >= first) & (F.col("timestamp") < last)), batch_id, folder)
    return reports.queued(spark, folder).select("transaction_id", F.floor(F.col("place") / 2000).alias("report_id"))


@query(f"""WITH {TX}, {SPLIT_SQL}
    SELECT 'fraud-detector' AS model_name, count(*) FILTER (WHERE part = 'train') AS train_size, count(*) FILTER (WHERE part = 'val') AS val_size,
           count(*) FILTER (WHERE part = 'test') AS test_size, round(avg(label), 6) AS fraud_rate,
           round((count(*) FILTER (WHERE part = 'train' AND label = 0))::DOUBLE / greatest(count(*) FILTER (WHERE part = 'train' AND label = 1), 1), 6) AS scale_pos_weight,
           true AS metrics_in_range, true AS champion FROM split""")
def run_record(spark, sf):
    """The stored record of a training run of one round, and whether it is the champion that a scorer loads."""
    folder = shared_folder(spark, "runs")
    tx = _tx(spark, sf)
    training.train(features.feature_vector(tx), f"{folder}/runs", f"{folder}/models", TrainingOptions(rounds=1, depth=2, leaves=3, chunk=1))
    _, version, _ = scoring.load_champion(spark, f"{folder}/runs", "fraud-detector")
    run = training.read_runs(spark, f"{folder}/runs")
    in_range = F.forall(F.map_values(F.map_filter("metrics", lambda k, v: ~k.endswith("_rounds"))), lambda v: v.between(0, 1))
    return _rounded(run.select("model_name", "train_size", "val_size", "test_size", "fraud_rate", "scale_pos_weight",
                               in_range.alias("metrics_in_range"), (F.col("run_id") == version).alias("champion")), "fraud_rate", "scale_pos_weight")
