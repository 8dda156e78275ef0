from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import values
from txrisk.functions import scalar as S
from txrisk.operators import scoring
from txrisk.options import FeatureOptions, ScoringOptions
from txrisk.schemas import FEATURE_COLS, PREDICTION

NAN = float("nan")


def test_decisions(spark):
    df = spark.createDataFrame([(f"{i}", p) for i, p in enumerate([0.05, 0.3999, 0.4, 0.55, 0.7499, 0.75, 0.92, 1.2, -0.5, NAN, None])],
                               "transaction_id string, p double")
    got = scoring.with_decision(df, F.col("p")).withColumn("n", F.col("transaction_id").cast("int")).orderBy("n").collect()
    assert [r.decision for r in got] == ["APPROVE", "APPROVE", "REVIEW", "REVIEW", "REVIEW", "BLOCK", "BLOCK", "BLOCK", "APPROVE", "BLOCK", None]
    assert [r.probability for r in got[7:9]] == [1.0, 0.0]


def test_decision_uses_the_unrounded_probability(spark):
    df = spark.createDataFrame([("a", 0.39999)], "transaction_id string, p double")
    r = scoring.with_decision(df, F.col("p")).first()
    assert (r.decision, r.fraud_probability, r.probability) == ("APPROVE", 0.4, 0.39999)
    assert scoring.with_decision(df, F.col("p"), ScoringOptions(0.1, 0.2)).first().decision == "BLOCK"


@pytest.mark.parametrize("output, expected", [
    ([0.3], 0.3), ([0.2, 0.8], 0.8), ([0.2, 1.8], 0.2), ([0.1, 0.2, 0.3], 0.1), ([1.7], 1.0), ([-3.0, 0.5], 0.0), ([], None)])
def test_probability_of_a_flat_output(spark, output, expected):
    df = spark.createDataFrame([(output,)], "o array<double>")
    assert df.select(S.probability_of(F.col("o"))).first()[0] == expected


@pytest.mark.parametrize("output, expected", [([[0.3, 0.7], [1.0, 0.0]], 0.7), ([[0.4]], 0.4), ([[]], None), ([], None)])
def test_probability_of_a_matrix(spark, output, expected):
    df = spark.createDataFrame([(output,)], "o array<array<double>>")
    assert df.select(S.probability_of_matrix(F.col("o"))).first()[0] == expected


def test_nan_is_not_clipped(spark):
    df = spark.createDataFrame([([NAN],)], "o array<double>")
    assert str(df.select(S.probability_of(F.col("o"))).first()[0]) == "nan"


def test_requests_are_validated(spark):
    full = {c: 1 for c in FEATURE_COLS} | {"is_weekend": True, "card_present": False, "transaction_id": "x"}
    import json
    bodies = [json.dumps(full), json.dumps({k: v for k, v in full.items() if k != "amount_zscore"}), json.dumps(full | {"tx_count_1h": "many"})]
    checked = scoring.with_reject_reason(scoring.parse_requests(spark.createDataFrame([(b,) for b in bodies], "value string")))
    assert scoring.valid_rows(checked).count() == 1
    assert {r.reject_reason: r.requests for r in scoring.reject_counts(checked).collect()} == {
        "amount_zscore is missing": 1, "tx_count_1h is missing": 1}
    assert scoring.model_input(scoring.valid_rows(checked)).columns == ["transaction_id", *FEATURE_COLS]


def test_no_model_refuses_to_score(spark):
    with pytest.raises(scoring.ModelUnavailable, match="Model not loaded"):
        scoring.score(spark.range(1), None, "unavailable")


def test_prediction_store(spark):
    t = datetime(2024, 1, 1, 12)
    rows = [("a", 0.9, "BLOCK", "v1", t), ("a", 0.2, "APPROVE", "v2", t + timedelta(minutes=5)),
            ("b", 0.5, "REVIEW", "v1", t - timedelta(hours=2)), ("c", 0.6, "REVIEW", "v1", t + timedelta(hours=2)),
            ("d", 0.7, "REVIEW", "v1", t - timedelta(minutes=30))]
    store = spark.createDataFrame(rows, PREDICTION)
    features = spark.createDataFrame([(x,) for x in "abcde"], "transaction_id string")
    as_of = F.lit("2024-01-01 12:30:00").cast("timestamp")
    got = scoring.join_predictions(features, store, as_of, 3600)
    assert values(got, "prediction") == [0.2, 0.0, 0.0, 0.7, 0.0]
    assert values(got, "prediction_missing") == [False, True, True, False, True]
