"""Mergeable sketches: approximate distinct counts per user and time slice, and latency quantiles per interval.

A sketch is kept per slice or interval and merged for what is asked: neither the members of a window nor old latencies are
looked at again.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.options import US, FeatureOptions

#: log2 of the buckets of a distinct-count sketch: a relative deviation of 1.04 / 64 at most, far less below 400 members.
DISTINCT_LG = 12
#: Size of a quantile sketch; the bound of a quantile's rank error at this size, of one sketch or of merged ones.
QUANTILE_K = 1000
RANK_ERROR = 0.01
# The quantiles of a latency summary.
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}


def slice_sketches(tx: DataFrame, member: str, slice_s: int, lg: int = DISTINCT_LG) -> DataFrame:
    """(user_id, slice, sketch): the members of a user in each time slice; partial sketches are merged before the shuffle."""
    return tx.groupBy("user_id", _slice(slice_s).alias("slice")).agg(F.hll_sketch_agg(member, lg).alias("sketch"))


def _slice(slice_s: int) -> Column:
    return F.floor(F.col("ts_us") / (slice_s * US))


def with_distinct_estimate(tx: DataFrame, name: str, member: str, window_s: int, slice_s: int, order: str = "transaction_id",
                           lg: int = DISTINCT_LG) -> DataFrame:
    """Add `name`: about how many members a user had in the row's slice up to the row, and in the window_s / slice_s - 1
    slices before. Null members do not count; ties in time are in the order of `order`.

    The slices before come as one merged sketch per (user, slice). Only the rows of one slice meet in a window.
    """
    sliced = tx.withColumn("slice", _slice(slice_s))
    back = max(window_s // slice_s - 1, 0)
    before = Window.partitionBy("user_id").orderBy("slice").rangeBetween(-back, -1)
    prior = slice_sketches(tx, member, slice_s, lg)
    prior = prior.select("user_id", "slice", (F.hll_union_agg("sketch").over(before) if back else F.lit(None).cast("binary")).alias("prior"))
    upto = Window.partitionBy("user_id", "slice").orderBy("ts_us", order).rowsBetween(Window.unboundedPreceding, 0)
    running = sliced.withColumn("running", F.hll_sketch_agg(member, lg).over(upto))
    estimate = F.hll_sketch_estimate(F.coalesce(F.hll_union("running", "prior"), F.col("running")))
    return running.join(prior, ["user_id", "slice"], "left").withColumn(name, estimate.cast("int")).drop("slice", "prior", "running")


def with_distinct_estimates(tx: DataFrame, opts: FeatureOptions = FeatureOptions(), order: str = "transaction_id") -> DataFrame:
    """Merchants by hours of a day, countries by days of a week."""
    merchants = with_distinct_estimate(tx, "unique_merchants_24h", "merchant_id", opts.merchant_ttl_s, 3600, order)
    return with_distinct_estimate(merchants, "unique_countries_7d", "country", opts.country_ttl_s, 86400, order)


def latency_sketches(log: DataFrame, keys: list[str], interval: Column, latency: str = "latency_ms", ok: str = "ok",
                     k: int = QUANTILE_K) -> DataFrame:
    """Per group and `interval`: requests, requests without failure, observations, their sum and maximum, and a quantile
    sketch (NULL without observations). To be kept; rows of several tables add up in `merged_sketches`."""
    value = F.col(latency)
    return log.groupBy(*keys, interval.alias("interval")).agg(
        F.count("*").alias("requests"), F.sum(F.when(F.col(ok), 1).otherwise(0)).alias("requests_ok"), F.count(value).alias("observations"),
        F.sum(value).alias("total"), F.max(value).alias("max"), F.kll_sketch_agg_double(value.cast("double"), k).alias("sketch"))


def merged_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of several intervals as one per group."""
    return parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("requests", "requests_ok", "observations", "total")], F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(F.col("observations") > 0, F.col("sketch"))).alias("sketch"))


def sketch_summary(merged: DataFrame, keys: list[str], target_ms: float = 50.0) -> DataFrame:
    """The columns of a latency summary from merged sketches; a quantile's rank is off by RANK_ERROR at most."""
    some = F.col("observations") > 0
    quantiles = {name: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(q))) for name, q in QUANTILES.items()}
    rows = merged.withColumns({**quantiles, "mean": F.when(some, F.col("total") / F.col("observations"))})
    return rows.select(
        *keys, "requests_ok", (F.col("requests") - F.col("requests_ok")).alias("errors"),
        *[F.round(c, 2).alias(f"{c}_ms") for c in ("mean", *QUANTILES, "max")], (F.col("p99") <= target_ms).alias(f"pass_p99_le_{target_ms:g}ms"))


def quantile_errors(log: DataFrame, merged: DataFrame, keys: list[str], latency: str = "latency_ms") -> DataFrame:
    """Per group and quantile: how far the estimate's true rank is from the asked one, as a share of the observations.

    An estimate that occurs several times covers a range of ranks; the distance is to the nearer end, 0 inside.
    """
    cells = [F.struct(F.lit(n).alias("quantile"), F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("estimate"))
             for n, q in QUANTILES.items()]
    # one row per group and quantile meets the latencies of its group
    asked = merged.filter("observations > 0").select(*keys, F.lit(0).alias("whole"), "observations", F.inline(F.array(*cells)))
    value = F.col(latency)
    counted = log.filter(value.isNotNull()).withColumn("whole", F.lit(0)).join(asked, [*keys, "whole"]).groupBy(*keys, "quantile", "q", "observations").agg(
        F.sum(F.when(value < F.col("estimate"), 1).otherwise(0)).alias("below"),
        F.sum(F.when(value <= F.col("estimate"), 1).otherwise(0)).alias("upto"))
    low, high = F.col("below") / F.col("observations"), F.col("upto") / F.col("observations")
    return counted.select(*keys, "quantile", "observations", F.greatest(F.lit(0.0), low - F.col("q"), F.col("q") - high).alias("rank_error"))
