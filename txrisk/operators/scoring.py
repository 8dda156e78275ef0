"""Scoring rows with the champion model, decisions and the prediction store."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txrisk.functions import scalar as S
from txrisk.options import ScoringOptions
from txrisk.schemas import FEATURE_COLS, FEATURE_VECTOR

REQUEST_COLS = ["transaction_id", *FEATURE_COLS]


class ModelUnavailable(RuntimeError):
    """There is no champion to score with."""


def parse_requests(requests: DataFrame, value: str = "value") -> DataFrame:
    """Scoring requests as JSON text into typed columns; an ill-typed field becomes NULL."""
    types = {f.name: f.dataType.simpleString() for f in FEATURE_VECTOR.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in REQUEST_COLS)
    # the generator keeps later filters above the parse, so that a request is read once
    return requests.select(F.inline(F.array(F.from_json(F.col(value), schema))))


def with_reject_reason(rows: DataFrame) -> DataFrame:
    """`reject_reason`: the first required field that is missing, NULL for a valid row."""
    return rows.withColumn("reject_reason", F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in REQUEST_COLS]))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason is null").drop("reject_reason")


def rejected_rows(checked: DataFrame, at: Column | None = None) -> DataFrame:
    """(transaction_id, reject_reason, rejected_at) of the rows that cannot be scored."""
    return checked.filter("reject_reason is not null").select(
        "transaction_id", "reject_reason", (F.current_timestamp() if at is None else at).alias("rejected_at"))


def model_input(rows: DataFrame) -> DataFrame:
    """The 15 model columns in their fixed order, as doubles, after the id."""
    return rows.select("transaction_id", *[F.col(c).cast("double").alias(c) for c in FEATURE_COLS])


def with_decision(rows: DataFrame, probability: Column, opts: ScoringOptions = ScoringOptions()) -> DataFrame:
    """Stored probability (unrounded), reported probability (4 digits) and the decision."""
    return rows.withColumn("probability", S.clip_probability(probability)).withColumns({
        "fraud_probability": F.round("probability", 4),
        "decision": S.decision(F.col("probability"), opts.review_threshold, opts.block_threshold),
    })


def score(rows: DataFrame, model: PipelineModel | None, version: str, opts: ScoringOptions = ScoringOptions(),
          serve: str = "ensemble") -> DataFrame:
    """(transaction_id, fraud_probability, probability, decision, model_version) per row.

    The model adds the class probabilities of its candidates; `serve` names the one to use, or
    `ensemble` for their mean.
    """
    if model is None:
        raise ModelUnavailable("Model not loaded")
    out = model.transform(rows)
    parts = {c.removeprefix("probability_"): F.col(c) if kind == "double" else F.get(vector_to_array(c), F.lit(1))
             for c, kind in out.dtypes if c.startswith("probability_")}
    if serve == "ensemble":
        p = sum(parts.values(), F.lit(0.0)) / len(parts)
    else:
        p = parts[serve]
    return with_decision(out, p, opts).select(
        "transaction_id", "fraud_probability", "probability", "decision", F.lit(version).alias("model_version"))


_LOADED: dict[str, PipelineModel] = {}


def load_champion(spark: SparkSession, runs_path: str, model_name: str) -> tuple[PipelineModel | None, str, str]:
    """The current champion's model, version and served candidate; loaded once per version."""
    from txrisk.operators.training import champion, read_runs

    rows = champion(read_runs(spark, runs_path)).filter(F.col("model_name") == model_name).collect()
    if not rows:
        return None, "unavailable", ""
    run = rows[0]
    if run.run_id not in _LOADED:
        _LOADED.clear()
        _LOADED[run.run_id] = PipelineModel.load(run.model_path)
    return _LOADED[run.run_id], run.run_id, run.serve


def to_predictions(scored: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows for the append-only prediction table."""
    return scored.select("transaction_id", "probability", "decision", "model_version",
                         (F.current_timestamp() if at is None else at).alias("scored_at"))


def latest_predictions(predictions: DataFrame, as_of: Column, lifetime_s: int = 3600) -> DataFrame:
    """The prediction a reader sees at `as_of`: the latest per id that has not expired."""
    alive = (F.col("scored_at") <= as_of) & (as_of <= F.col("scored_at") + F.make_dt_interval(secs=F.lit(lifetime_s)))
    latest = F.max_by(F.struct("probability", "decision"), F.struct("scored_at", "probability"))
    return predictions.filter(alive).groupBy("transaction_id").agg(latest.alias("p")).select(
        "transaction_id", F.col("p.probability").alias("stored_probability"), F.col("p.decision").alias("stored_decision"))


def join_predictions(features: DataFrame, predictions: DataFrame, as_of: Column, lifetime_s: int = 3600) -> DataFrame:
    """`prediction` (0.0 where the store has none) and `prediction_missing`."""
    found = latest_predictions(predictions, as_of, lifetime_s)
    joined = features.join(found, "transaction_id", "left")
    return joined.withColumns({
        "prediction": F.coalesce("stored_probability", F.lit(0.0)),
        "prediction_missing": F.col("stored_probability").isNull(),
    }).drop("stored_probability", "stored_decision")


def scored_by(event_time: Column, wait_s: int, lifetime_s: int) -> Column:
    """Whether a prediction is alive `wait_s` after an event: scored by then, and not longer ago than its lifetime."""
    # literal intervals, from which a stream can tell how long a partner may come
    first, last = (F.expr(f"interval {s} seconds") for s in (wait_s - lifetime_s, wait_s))
    return (F.col("scored_at") >= event_time + first) & (F.col("scored_at") <= event_time + last)


def latest_of_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per `keys` from (keys, stored_probability, scored_at): the latest prediction, 0.0 where none matched."""
    latest = F.max_by("stored_probability", F.when(F.col("stored_probability").isNotNull(), F.struct("scored_at", "stored_probability")))
    return matches.groupBy(*keys).agg(latest.alias("found")).select(
        *keys, F.coalesce("found", F.lit(0.0)).alias("prediction"), F.col("found").isNull().alias("prediction_missing"))


def join_predictions_in_time(features: DataFrame, predictions: DataFrame, event_time: Column, keys: list[str], wait_s: int,
                             lifetime_s: int = 3600) -> DataFrame:
    """`prediction` and `prediction_missing` for each row as seen `wait_s` after its event time; a replay of a row (equal
    `keys`) counts once."""
    store = predictions.select(F.col("transaction_id").alias("scored_id"), F.col("probability").alias("stored_probability"), "scored_at")
    on = (F.col("transaction_id") == F.col("scored_id")) & scored_by(event_time, wait_s, lifetime_s)
    return latest_of_matches(features.join(store, on, "left"), keys)


def decision_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("decision").agg(F.count("*").alias("requests"))


def error_counts(checked: DataFrame, model_available: bool = True) -> DataFrame:
    """Requests that get no decision, by type: `validation`, and `model_unavailable` for valid ones without a model."""
    kind = F.when(F.col("reject_reason").isNotNull(), "validation")
    if not model_available:
        kind = kind.otherwise("model_unavailable")
    return checked.select(kind.alias("error")).filter("error is not null").groupBy("error").agg(F.count("*").alias("requests"))


def reject_counts(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("requests"))
