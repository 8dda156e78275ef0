"""Drift, data quality and classification quality of a current frame against a baseline.

Everything numeric is derived from one histogram per column (distinct value, count), which is
combined before the shuffle; ordered statistics run over value slices.
"""

from dataclasses import dataclass
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from txrisk.operators.metrics import quality_metrics
from txrisk.operators.prefix import exact_quantiles, global_rank, running_totals, slice_of, slice_widths, within_limit
from txrisk.schemas import CATEGORICAL_FEATURES, NUMERICAL_FEATURES
from txrisk.session import checkpointed

# The thresholds of each test.
DISTANCE_THRESHOLD = 0.1
P_VALUE_THRESHOLD = 0.05


def baseline_with_prediction(baseline: DataFrame) -> DataFrame:
    """A baseline without predictions is judged by its labels."""
    if "prediction" in baseline.columns:
        return baseline
    return baseline.withColumn("prediction", F.col("label").cast("double"))


@dataclass(frozen=True)
class Profile:
    """The histograms of a frame: (column, number, text, n), one row per distinct value; profiles of parts add up."""

    rows: DataFrame

    def merged(self, *others: "Profile") -> "Profile":
        """The profile of all the frames together."""
        both = self.rows
        for other in others:
            both = both.unionByName(other.rows)
        return Profile(both.groupBy("column", "number", "text").agg(F.sum("n").alias("n")))


def profile(df: DataFrame, numerical: list[str] = NUMERICAL_FEATURES, categorical: list[str] = CATEGORICAL_FEATURES,
            keep: bool = False) -> Profile:
    """One scan of a frame; every drift score and the data quality can be taken from it. `keep` fixes it for several uses."""
    none = F.lit(None)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("number"), none.cast("string").alias("text")) for c in numerical]
    cells += [F.struct(F.lit(c).alias("column"), none.cast("double").alias("number"), F.col(c).cast("string").alias("text")) for c in categorical]
    rows = df.select(F.inline(F.array(*cells))).groupBy("column", "number", "text").agg(F.count("*").alias("n"))
    return Profile(checkpointed(rows) if keep else rows)


def _long(frame: DataFrame | Profile, columns: list[str], kind: str) -> DataFrame:
    """(column, value, n) of a frame's cells, or of its profile."""
    if isinstance(frame, Profile):
        value = F.col("number") if kind == "double" else F.col("text")
        return frame.rows.filter(F.col("column").isin(columns)).select("column", value.alias("value"), "n")
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value"), F.lit(1).cast("bigint").alias("n")) for c in columns]
    return frame.select(F.inline(F.array(*cells)))


def _histogram(baseline: DataFrame | Profile, current: DataFrame | Profile, columns: list[str], kind: str) -> DataFrame:
    """(column, value, n_ref, n_cur) of both frames, for numbers also left_ref and left_cur.

    Nulls and numbers that are not finite share the row of value NULL, which counts nothing but what was left out: the numbers
    that are not finite.
    """
    both = _long(baseline, columns, kind).withColumn("ref", F.lit(True)).unionByName(
        _long(current, columns, kind).withColumn("ref", F.lit(False)))
    zero = F.lit(0).cast("bigint")
    if kind == "string":
        clean, left = F.col("value"), {}
    else:
        clean = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
        odd = F.col("value").isNotNull() & F.col("clean").isNull()
        left = {"left_ref": odd & F.col("ref"), "left_cur": odd & ~F.col("ref")}
    present = F.col("clean").isNotNull()
    counted = {"n_ref": present & F.col("ref"), "n_cur": present & ~F.col("ref"), **left}
    return both.withColumn("clean", clean).groupBy("column", F.col("clean").alias("value")).agg(
        *[F.sum(F.when(c, F.col("n")).otherwise(zero)).alias(name) for name, c in counted.items()])


def _every_column(found: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each asked column, also where a frame has no rows at all."""
    names = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return names.join(found, "column", "left").na.fill(0, ["n_ref", "n_cur", "left_ref", "left_cur"])


def numeric_distances(baseline: DataFrame | Profile, current: DataFrame | Profile, columns: list[str] = NUMERICAL_FEATURES) -> DataFrame:
    """Per column: Wasserstein-1 distance over the baseline deviation, KS statistic, Jensen-Shannon distance.

    Each frame may be given as its profile. Distances are NULL where a frame has no value.
    """
    hist = _histogram(baseline, current, columns, "double").withColumn("sum_ref", F.coalesce(F.col("n_ref") * F.col("value"), F.lit(0.0)))
    # what was left out runs along, so that both uses of the histogram ask for the same columns and share one scan
    run = running_totals(hist, ["column"], "value", ["n_ref", "n_cur", "sum_ref", "left_ref", "left_cur"])
    n_ref, n_cur = (F.nullif(F.col(f"{n}_total"), F.lit(0)) for n in ("n_ref", "n_cur"))
    below = F.abs((F.col("n_ref_upto") - F.col("n_ref")) / n_ref - (F.col("n_cur_upto") - F.col("n_cur")) / n_cur)
    off = F.col("value") - F.col("sum_ref_total") / n_ref
    # the row of value NULL comes first and counts nothing
    is_first = F.col("value").isNotNull() & F.col("prev_value").isNull()
    agg = run.groupBy("column").agg(
        F.max("n_ref_total").alias("n_ref"), F.max("n_cur_total").alias("n_cur"),
        F.max("left_ref_upto").alias("left_ref"), F.max("left_cur_upto").alias("left_cur"),
        F.count("value").alias("n_values"),
        F.sum(F.coalesce(below * (F.col("value") - F.col("prev_value")), F.lit(0.0))).alias("w"),
        F.sqrt(F.sum(F.col("n_ref") * off * off) / F.max(n_ref)).alias("std"),
        F.max(F.abs(F.col("n_ref_upto") / n_ref - F.col("n_cur_upto") / n_cur)).alias("ks"),
        F.sum(_js_share(F.col("n_ref") / n_ref, F.col("n_cur") / n_cur)).alias("js"),
        F.sum(F.when(F.col("value").isNotNull(), _chi_share(F.col("n_ref"), F.col("n_cur"), n_ref, n_cur))).alias("chi_square"),
        F.min(F.when(is_first, F.col("n_ref") / n_ref)).alias("first_ref"),
        F.min(F.when(is_first, F.col("n_cur") / n_cur)).alias("first_cur"),
    )
    return _every_column(_where_both(agg, {
        "wasserstein": F.col("w") / F.greatest("std", F.lit(0.001)), "ks": F.col("ks"),
        "jensen_shannon": F.sqrt(F.greatest("js", F.lit(0.0)) / 2)}), columns)


def _where_both(agg: DataFrame, scores: dict[str, Column]) -> DataFrame:
    full = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    own = {"n_values": F.col("n_values"), **scores, **{c: F.col(c) for c in ("chi_square", "first_ref", "first_cur")}}
    return agg.select("column", "n_ref", "n_cur", "left_ref", "left_cur", *[F.when(full, v).alias(k) for k, v in own.items()])


def categorical_distances(baseline: DataFrame | Profile, current: DataFrame | Profile,
                          columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Per column: Jensen-Shannon distance (natural log) and the chi-square statistic; frames may be given as profiles."""
    hist = _histogram(baseline, current, columns, "string")
    totals = hist.groupBy("column").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    t_ref, t_cur = F.nullif("t_ref", F.lit(0)), F.nullif("t_cur", F.lit(0))
    agg = hist.join(totals, "column").groupBy("column").agg(
        F.max("t_ref").alias("n_ref"), F.max("t_cur").alias("n_cur"),
        F.lit(0).cast("bigint").alias("left_ref"), F.lit(0).cast("bigint").alias("left_cur"),
        F.count("value").alias("n_values"),
        F.sum(_js_share(F.col("n_ref") / t_ref, F.col("n_cur") / t_cur)).alias("js"),
        F.sum(F.when(F.col("value").isNotNull(), _chi_share(F.col("n_ref"), F.col("n_cur"), t_ref, t_cur))).alias("chi_square"),
        F.min_by(F.col("n_ref") / t_ref, "value").alias("first_ref"),
        F.min_by(F.col("n_cur") / t_cur, "value").alias("first_cur"),
    )
    return _every_column(_where_both(agg, {"jensen_shannon": F.sqrt(F.greatest("js", F.lit(0.0)) / 2)}), columns)


def _js_share(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)


def _chi_share(n_ref: Column, n_cur: Column, t_ref: Column, t_cur: Column) -> Column:
    expected = n_ref * t_cur / t_ref
    return F.when(n_ref > 0, (n_cur - expected) * (n_cur - expected) / F.when(n_ref > 0, expected)).otherwise(
        float("inf"))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample KS statistic (Stephens' correction)."""
    en = F.sqrt(n / (n + m) * m)
    x = (en + 0.12 + 0.11 / en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or its continued fraction, in log space."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - math.exp(scale + math.log(total)))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h, i, change = d, 0, 0.0
    while abs(change - 1) > 1e-14 and i < 1_000_000:
        i += 1
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        change = d * c
        h *= change
    return math.exp(scale + math.log(h))


@pandas_udf(T.DoubleType())
def chi_square_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series([gamma_tail(k / 2, v / 2) if pd.notna(v) and pd.notna(k) else None for v, k in zip(x, dof)], dtype="float64")


@pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal distribution."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else None).astype("float64")


# The tests of each method, for numbers and for categories.
METHODS = {"distance": ("wasserstein", "jensen_shannon"), "p_value": ("ks", "chi_square"), "z": ("ks", "z")}


def drift_columns(baseline: DataFrame | Profile, current: DataFrame | Profile, numerical: list[str] = NUMERICAL_FEATURES,
                  categorical: list[str] = CATEGORICAL_FEATURES, method: str = "distance") -> DataFrame:
    """One row per asked column: the test used, its score, its threshold and whether the column drifted.

    `method` names the tests, whatever the frames hold: `distance` takes Wasserstein and Jensen-Shannon distances,
    `p_value` KS and chi-square tests, `z` KS and a z-test of the share of the first of two categories. A column with values in one
    frame only has drifted, without a score; one without values in either has not. Numbers that are not finite are
    left out and counted. Each frame may be given as its profile.
    """
    by_kind = dict(zip(("num", "cat"), METHODS[method]))
    parts = []
    if numerical:
        parts.append(numeric_distances(baseline, current, numerical).withColumn("kind", F.lit("num")))
    if categorical:
        parts.append(categorical_distances(baseline, current, categorical).withColumn("kind", F.lit("cat")))
    if not parts:
        spark = (baseline.rows if isinstance(baseline, Profile) else baseline).sparkSession
        return spark.createDataFrame([], "column string, kind string, method string, score double, threshold double, "
                                                     "drifted boolean, n_ref bigint, n_cur bigint, left_ref bigint, left_cur bigint")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    for name in ("wasserstein", "ks"):
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast("double"))
    pooled = (F.col("first_ref") * F.col("n_ref") + F.col("first_cur") * F.col("n_cur")) / (F.col("n_ref") + F.col("n_cur"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_ref") + 1 / F.col("n_cur")))
    z = F.when(spread > 0, (F.col("first_ref") - F.col("first_cur")) / spread).otherwise(0.0)
    scored = both.withColumn("method", F.when(F.col("kind") == "num", by_kind["num"]).otherwise(by_kind["cat"])).withColumns({
        "chi_p": chi_square_p_value("chi_square", F.greatest(F.col("n_values") - 1, F.lit(1)).cast("double")),
        "z_p": normal_p_value(z),
    })
    full = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    score = (
        F.when(F.col("method") == "wasserstein", F.col("wasserstein"))
        .when(F.col("method") == "jensen_shannon", F.col("jensen_shannon"))
        .when(F.col("method") == "ks", ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_cur")))
        .when(F.col("method") == "chi_square", F.col("chi_p"))
        .otherwise(F.col("z_p"))
    )
    distance = F.col("method").isin("wasserstein", "jensen_shannon")
    drifted = F.when(distance, F.col("score") >= DISTANCE_THRESHOLD).otherwise(F.col("score") < P_VALUE_THRESHOLD)
    return scored.withColumn("score", F.when(full, score)).select(
        "column", "kind", "method", "score",
        F.when(distance, DISTANCE_THRESHOLD).otherwise(P_VALUE_THRESHOLD).alias("threshold"),
        F.when(full, drifted).otherwise((F.col("n_ref") > 0) | (F.col("n_cur") > 0)).alias("drifted"),
        "n_ref", "n_cur", "left_ref", "left_cur",
    )


def dataset_drift(columns: DataFrame, share: float = 0.3) -> DataFrame:
    """One row: number and share of drifted columns, the share threshold and the verdict."""
    return columns.agg(
        F.count("*").alias("n_columns"),
        F.sum(F.col("drifted").cast("bigint")).alias("n_drifted"),
        F.avg(F.col("drifted").cast("double")).alias("share_of_drifted_columns"),
    ).select("*", F.lit(share).alias("drift_share_threshold"),
             (F.col("share_of_drifted_columns") >= share).alias("dataset_drift"))


def data_quality(frames: DataFrame, keys: list[str], numerical: list[str] = NUMERICAL_FEATURES,
                 categorical: list[str] = CATEGORICAL_FEATURES, profiled: bool = False) -> DataFrame:
    """Per group and column: rows, nulls, distinct values, mean, deviation, quartiles, mode.

    `profiled`: `frames` holds the rows of profiles, with the keys beside them.
    """
    def long(columns: list[str], kind: str) -> DataFrame:
        if profiled:
            value = F.col("number") if kind == "double" else F.col("text")
            cells = frames.filter(F.col("column").isin(columns)).select(*keys, "column", value.alias("value"), F.col("n").alias("times"))
        else:
            own = [F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value"), F.lit(1).alias("times")) for c in columns]
            cells = frames.select(*keys, F.inline(F.array(*own)))
        value = F.when(~F.isnan("value"), F.col("value")) if kind == "double" else F.col("value")
        return cells.groupBy(*keys, "column", value.alias("value")).agg(
            F.sum(F.when(F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("n_value"), F.sum("times").alias("n"))

    by = [*keys, "column"]
    if not numerical and not categorical:
        raise ValueError("data_quality needs a column")
    cat = None
    if categorical:
        cat = long(categorical, "string").groupBy(*by).agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
            F.count("value").alias("distinct_values"),
            F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("n", "value"))).alias("most_common"),
            F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("most_common_rows"),
        ).withColumn("kind", F.lit("cat"))
    if not numerical:
        return cat
    # missing values form a group that adds nothing to the sums over values
    hist = long(numerical, "double").withColumns({
        "n_value": F.when(F.col("value").isNull(), 0).otherwise(F.col("n_value")).cast("bigint"),
        "nv": F.coalesce(F.col("n_value") * F.col("value"), F.lit(0.0)),
    })
    run = running_totals(hist, by, "value", ["n_value", "nv", "n"])
    mean = F.when(F.col("n_value_total") > 0, F.col("nv_total") / F.col("n_value_total"))
    off = F.col("value") - mean
    present = F.col("value").isNotNull()
    num = run.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.max(mean).alias("mean"),
        F.sqrt(F.sum(F.col("n_value") * off * off / F.col("n_value_total"))).alias("std"),
        F.min("value").alias("min"),
        *[v.alias(k) for k, v in exact_quantiles("value", "n_value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).items()],
        F.max("value").alias("max"),
        F.max_by(F.col("value").cast("string"), F.when(present, F.struct("n", -F.col("value")))).alias("most_common"),
        F.max(F.when(present, F.col("n"))).alias("most_common_rows"),
    ).withColumn("kind", F.lit("num"))
    return num if cat is None else num.unionByName(cat, allowMissingColumns=True)


def classification_quality(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Quality of the stored predictions in both frames."""
    both = baseline.select(F.lit("reference").alias("frame"), "label", "prediction").unionByName(
        current.select(F.lit("current").alias("frame"), "label", "prediction"))
    return quality_of(both)


def quality_of(frames: DataFrame) -> DataFrame:
    """Quality metrics per `frame` of rows with `label` and `prediction`."""
    return quality_metrics(frames, ["frame"], p="prediction")


# Widths of arrival slices to choose from, in micros.
HOUR_US = 3_600_000_000
ARRIVAL_WIDTHS = [HOUR_US, 60_000_000, 1_000_000, 1_000]


def arrival_rank(features: DataFrame, source: str, arrival_us: str, tie: str,
                 slice_rows: int = 2_000_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """`rank`: the place (from 0) of each row of a source in arrival order.

    Rows are ranked in slices of an hour of arrival; hours of more than `slice_rows` rows are cut
    finer.
    """
    hour = F.floor(F.col(arrival_us) / HOUR_US)
    rows = features.withColumn("arrival_hour", hour)
    fine = slice_widths(rows, [source, "arrival_hour"], arrival_us, ARRIVAL_WIDTHS, slice_rows, slice_rows, broadcast_rows)
    if fine is None:
        rows = rows.withColumn("width", F.lit(HOUR_US))
    else:
        fine = F.broadcast(fine) if within_limit(fine, broadcast_rows) else fine
        rows = rows.join(fine, [source, "arrival_hour"], "left").withColumn("width", F.coalesce("width", F.lit(HOUR_US)))
    ranked = global_rank(rows, [source], [arrival_us, tie], slice_of(arrival_us) * F.col("width"))
    return ranked.drop("arrival_hour", "width")


def report_slices(features: DataFrame, source: str, arrival_us: str, tie: str, batch_size: int = 2000,
                  slice_rows: int = 2_000_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """`report_id`: consecutive runs of `batch_size` rows of a source, in arrival order."""
    ranked = arrival_rank(features, source, arrival_us, tie, slice_rows, broadcast_rows)
    return ranked.withColumn("report_id", F.floor(F.col("rank") / batch_size)).drop("rank")
