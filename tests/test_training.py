from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF
from txrisk.operators import features, scoring, training
from txrisk.options import TrainingOptions
from txrisk.schemas import FEATURE_COLS
from txrisk.sources import adapters, tables

SMALL = TrainingOptions(rounds=4, depth=3, leaves=5, chunk=2)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("train")
    v = features.feature_vector(adapters.transactions(adapters.read_events(spark, SF)))
    half = F.col("transaction_id").cast("int") < 500
    v.filter(half).write.parquet(str(folder / "features_a.parquet"))
    v.filter(~half).write.parquet(str(folder / "features_b.parquet"))
    return tables.read_training(spark, str(folder))


def test_training_scan_reads_all_files(spark, vectors, tmp_path):
    stats = training.training_stats(vectors).first()
    assert stats.rows == 1000 and stats.fraud_rate == pytest.approx(0.079)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_training(spark, str(tmp_path))


def test_split_is_exact_and_repeatable(vectors):
    split = training.stratified_split(vectors)
    counts = {(r.part, r.label): r.n for r in split.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    assert counts == {("train", 1): 64, ("val", 1): 8, ("test", 1): 7, ("train", 0): 737, ("val", 0): 92, ("test", 0): 92}
    again = training.stratified_split(vectors.repartition(7))
    assert split.select("transaction_id", "part").exceptAll(again.select("transaction_id", "part")).count() == 0
    other = training.stratified_split(vectors, TrainingOptions(seed=1))
    assert split.select("transaction_id", "part").exceptAll(other.select("transaction_id", "part")).count() > 0


def test_copies_of_an_id_stay_together(spark):
    rows = [(f"a{i}", 0) for i in range(50)] + [("hot", 0)] * 30 + [("only", 1)] + [(None, None)] * 3
    split = training.stratified_split(spark.createDataFrame(rows, "transaction_id string, label int")).collect()
    assert len(split) == len(rows)
    assert len({r.part for r in split if r.transaction_id == "hot"}) == 1
    assert {r.part for r in split if r.transaction_id == "only"} == {"train"}
    assert sum(r.part == "train" for r in split if r.label == 0) >= 64


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 11, 199])
def test_split_shares(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("transaction_id"), F.lit(1).alias("label"))
    got = [r.part for r in training.stratified_split(df).collect()]
    want = ["train" if 10 * i < 8 * n else "val" if 10 * i < 9 * n else "test" for i in range(n)]
    assert sorted(got) == sorted(want)


def test_class_weight(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert training.class_weight(df).first().scale_pos_weight == 3.0
    assert training.class_weight(df.filter("label = 0")).first().scale_pos_weight == 6.0


def test_promotion(spark):
    t = datetime(2024, 1, 1)
    rows = [("m", str(i), t + timedelta(days=i), x) for i, x in enumerate([0.80, 0.80, 0.85, None, 0.84])] + [("n", "z", t, None)]
    runs = spark.createDataFrame(rows, "model_name string, run_id string, created_at timestamp, gate_metric double")
    got = training.promotion_history(runs).filter("model_name = 'm'").orderBy("run_id").collect()
    assert [r.promoted for r in got] == [True, False, True, False, False]
    assert [r.stage for r in got] == ["Archived", "Archived", "Production", "Archived", "Archived"]
    assert {(r.model_name, r.run_id) for r in training.champion(runs).collect()} == {("m", "2"), ("n", "z")}


def test_train_evaluate_promote_and_score(spark, vectors, tmp_path):
    runs_path, models_path = str(tmp_path / "runs"), str(tmp_path / "models")
    run_id = training.train(vectors, runs_path, models_path, SMALL)
    run = training.read_runs(spark, runs_path).first()
    assert (run.run_id, run.train_size, run.val_size, run.test_size) == (run_id, 801, 100, 99)
    assert run.features == FEATURE_COLS and run.scale_pos_weight == pytest.approx(737 / 64)
    assert set(run.metrics) == {f"{c}_{m}" for c in ("boosted", "leafwise", "ensemble") for m in training.METRICS} | {"boosted_rounds", "leafwise_rounds"}
    assert 1 <= run.metrics["boosted_rounds"] <= 4
    assert run.gate_metric == run.metrics["ensemble_pr_auc"] > 0.079
    # the same training again is no better and does not replace the champion
    training.train(vectors, runs_path, models_path, SMALL)
    model, version, serve = scoring.load_champion(spark, runs_path, "fraud-detector")
    assert (version, serve) == (run_id, "ensemble")
    scored = scoring.score(vectors, model, version).collect()
    assert len(scored) == 1000
    assert all(0 <= r.fraud_probability <= 1 and r.model_version == run_id for r in scored)
    single = {r.transaction_id: r.probability for r in scoring.score(vectors, model, version, serve="boosted").collect()}
    other = {r.transaction_id: r.probability for r in scoring.score(vectors, model, version, serve="leafwise").collect()}
    assert all(r.probability == pytest.approx((single[r.transaction_id] + other[r.transaction_id]) / 2) for r in scored)


def test_no_runs_means_no_model(spark, tmp_path):
    runs = spark.createDataFrame([], training.MODEL_RUN)
    runs.write.parquet(str(tmp_path / "runs"))
    assert scoring.load_champion(spark, str(tmp_path / "runs"), "fraud-detector")[0] is None
