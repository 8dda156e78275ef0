"""Model quality and operational metrics as tables."""

from pyspark.sql import DataFrame, functions as F

from txrisk.operators.prefix import exact_quantiles, running_totals
from txrisk.schemas import FEATURE_LATENCY_BOUNDS


def quality_metrics(scored: DataFrame, keys: list[str], label: str = "label", p: str = "probability",
                    threshold: float = 0.5) -> DataFrame:
    """ROC AUC, average precision, F1, precision, recall, Brier score and more per group of `keys`.

    Rows are first combined per distinct score; the prefix sums then run over score slices. AUC and
    average precision are NULL when a group has only one class. Rows without a label or a score
    are left out and counted.
    """
    usable = F.col(label).isNotNull() & F.col(p).isNotNull() & ~F.isnan(p)
    # unusable rows end up in groups without a score that add nothing to the sums
    per_score = (
        scored.select(*keys, F.when(usable, -F.col(p)).alias("down"), F.when(usable, F.col(label)).alias("y"),
                      F.col(label).isNull().alias("no_label"))
        .groupBy(*keys, "down", "no_label")
        .agg(F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("pos"), F.count("down").alias("n"),
             (F.count("*") - F.count("down")).alias("left"))
    )
    s, pos, n = -F.col("down"), F.col("pos"), F.col("n")
    neg = n - pos
    wide = "decimal(19,0)"
    ordered = neg.cast(wide) * (2 * F.col("pos_upto") - pos).cast(wide)
    eps = 2.220446049250313e-16
    safe = F.least(F.greatest(s, F.lit(eps)), F.lit(1 - eps))
    above = s > threshold
    sums = running_totals(per_score, keys, "down", ["pos", "n", "left"]).groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum("pos").alias("positives"),
        F.sum(ordered).alias("ordered"),
        F.sum(F.when(n > 0, pos * F.col("pos_upto") / F.col("n_upto"))).alias("ap"),
        F.sum(F.when(above, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(above, neg).otherwise(0)).alias("fp"),
        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("brier"),
        F.sum(-pos * F.log(safe) - neg * F.log(1 - safe)).alias("loss"),
        F.sum(F.when(F.col("no_label"), F.col("left")).otherwise(0)).alias("rows_unlabelled"),
        F.sum(F.when(~F.col("no_label"), F.col("left")).otherwise(0)).alias("rows_unscored"),
    )
    rows, positives, tp, fp = F.col("rows"), F.col("positives"), F.col("tp"), F.col("fp")
    negatives = rows - positives
    fn, tn = positives - tp, negatives - fp
    two_classes = (positives > 0) & (negatives > 0)

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    return sums.select(
        *keys, "rows", "positives",
        F.when(two_classes, F.col("ordered").cast("double") / 2 / positives / negatives).alias("roc_auc"),
        F.when(two_classes, F.col("ap") / positives).alias("pr_auc"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, positives).alias("recall"),
        F.when(rows > 0, F.col("brier") / rows).alias("brier_score_loss"),
        F.when(rows > 0, F.col("loss") / rows).alias("log_loss"),
        F.when(rows > 0, (tp + tn) / rows).alias("accuracy"),
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        "rows_unlabelled", "rows_unscored",
    )


def latency_histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[float] = FEATURE_LATENCY_BOUNDS) -> DataFrame:
    """Cumulative bucket counts: per group one row per upper bound `le`, the last one +Inf."""
    per_bound = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(*per_bound, F.count("*").alias("all"))
    cells = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("observations")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("observations")))
    return wide.select(*keys, F.inline(F.array(*cells)))


def latency_summary(log: DataFrame, keys: list[str], latency: str = "latency_ms", ok: str = "ok",
                    target_ms: float = 50.0) -> DataFrame:
    """Counts, mean, p50, p95, p99, p99.9 and max; failed requests are part of the latencies.

    Requests without a latency count as requests only.

    Percentiles interpolate linearly and are exact: they come from prefix sums over the distinct
    latencies, so no task holds a group's values.
    """
    value = F.col(latency)
    per_value = log.groupBy(*keys, value.alias("value")).agg(
        F.count(value).alias("n"), F.count("*").alias("n_all"), F.sum(F.when(F.col(ok), 1).otherwise(0)).alias("n_ok"))
    quantiles = exact_quantiles("value", "n", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p99_9": 0.999})
    agg = running_totals(per_value, keys, "value", ["n", "n_ok"]).groupBy(*keys).agg(
        F.sum("n_ok").alias("requests_ok"),
        (F.sum("n_all") - F.sum("n_ok")).alias("errors"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        *[v.alias(k) for k, v in quantiles.items()],
        F.max("value").alias("max"),
    )
    return agg.select(
        *keys, "requests_ok", "errors",
        *[F.round(c, 2).alias(f"{c}_ms") for c in ("mean", "p50", "p95", "p99", "p99_9", "max")],
        (F.col("p99") <= target_ms).alias(f"pass_p99_le_{target_ms:g}ms"),
    )


def summary_json(summary: DataFrame) -> DataFrame:
    """(value): each row of a latency summary as a JSON object, with nulls."""
    return summary.select(F.to_json(F.struct(*summary.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary, which has one row per group, as a folder with one file of JSON lines."""
    summary_json(summary).coalesce(1).write.mode("overwrite").text(path)
