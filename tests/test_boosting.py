import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF
from txrisk.operators import boosting, features, training
from txrisk.operators.metrics import quality_metrics
from txrisk.options import TrainingOptions
from txrisk.sources import adapters

WHOLE = TrainingOptions(subsample=1.0, column_sample=1.0, min_rows_per_leaf=1, bins=8, depth=3, leaves=4, rounds=3, rate=0.3, chunk=2)


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, z = rng.randint(0, 20), rng.choice([0.5, 1.5, None])
        y = int(x > 12 and (z or 0) > 1) if rng.random() > 0.1 else rng.randint(0, 1)
        rows.append((f"t{i}", float(x), z, y, 2.0 if y else 1.0, i % 5 == 0))
    return spark.createDataFrame(rows, "transaction_id string, x double, z double, label int, weight double, is_val boolean")


def plain_splits(rows, columns, edges, opts):
    """Leaf-wise growth of one tree on lists: the best leaf is split first."""
    pos = sum(r.weight * r.label for r in rows)
    rate = pos / sum(r.weight for r in rows)

    def place(r, c):
        return 0 if r[c] is None else sum(e < r[c] for e in edges[c])

    def best(part):
        found = []
        for f, c in enumerate(columns):
            for cut in range(len(edges[c])):
                def sums(side):
                    return (sum(r.weight * (rate - r.label) for r in side), sum(r.weight * rate * (1 - rate) for r in side))
                (g, h), (gl, hl) = sums(part), sums([r for r in part if place(r, c) <= cut])
                if hl >= opts.min_rows_per_leaf and h - hl >= opts.min_rows_per_leaf:
                    gain = (gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)) / 2
                    found.append((round(gain, 4), -f, -cut))
        return max((x for x in found if x[0] > 0), default=None)

    open_, splits = {0: rows}, {}
    while len(splits) + 1 < opts.leaves:
        options = {n: best(part) for n, part in open_.items() if n < 2 ** opts.depth - 1}
        options = {n: b for n, b in options.items() if b}
        if not options:
            break
        node = max(options, key=lambda n: (options[n][0], -n))
        gain, f, cut = options[node]
        c, part = columns[-f], open_.pop(node)
        splits[node] = (c, edges[c][-cut], gain)
        open_[2 * node + 1] = [r for r in part if place(r, c) <= -cut]
        open_[2 * node + 2] = [r for r in part if place(r, c) > -cut]
    return splits


@pytest.mark.parametrize("leaves", [2, 4, 8])
def test_a_tree_against_plain_growth(spark, leaves):
    rows = table(spark)
    opts = TrainingOptions(**{**WHOLE.__dict__, "leaves": leaves})
    train = rows.filter("not is_val")
    edges = boosting.bin_edges(train, ["x", "z"], opts.bins)
    got = {r.node: (r.feature, r.threshold, round(r.gain, 4)) for r in boosting.first_splits(rows, ["x", "z"], opts).collect()}
    want = plain_splits(train.collect(), ["x", "z"], edges, opts)
    assert got.keys() == want.keys() and len(got) <= leaves - 1
    for node, (c, t, gain) in want.items():
        assert got[node][:2] == (c, t) and got[node][2] == pytest.approx(gain, abs=2e-4)


def test_edges_are_quantiles(spark):
    rows = spark.createDataFrame([(float(i // 3), 7.0) for i in range(60)], "x double, same double")
    edges = boosting.bin_edges(rows, ["x", "same"], 4)
    assert edges == {"x": [4.0, 9.0, 14.0], "same": []}


def test_fits_are_repeatable(spark):
    rows = table(spark)
    a, history = boosting.fit(rows, 4, WHOLE, ["x", "z"])
    b, again = boosting.fit(rows.repartition(5), 4, WHOLE, ["x", "z"])
    assert a.getOrDefault("model") == b.getOrDefault("model") and history == again
    assert [r for r, _ in history] == [1, 2, 3]


def test_staged_scores_are_those_of_the_model(spark):
    """The model of the best round gives the average precision that the fit saw in that round."""
    rows = table(spark)
    model, history = boosting.fit(rows, 4, WHOLE, ["x", "z"])
    scored = model.transform(rows.filter("is_val"))
    best = max(history, key=lambda r: (r[1], -r[0]))
    assert model.trees() == best[0]
    assert quality_metrics(scored, []).first().pr_auc == pytest.approx(best[1])


def test_patience_ends_the_fit(spark):
    """Labels of the validation part that no feature tells: nothing improves for long."""
    rows = table(spark).withColumn("label", F.when(F.col("is_val"), F.abs(F.xxhash64("transaction_id")) % 2).otherwise(F.col("label")).cast("int"))
    opts = TrainingOptions(**{**WHOLE.__dict__, "rounds": 40, "patience": 3, "depth": 2, "chunk": 4})
    model, history = boosting.fit(rows, 4, opts, ["x", "z"])
    best = max(history, key=lambda r: (r[1], -r[0]))[0] if len(history) == 40 else None
    stale = next((r for r, _ in history if r - max(history[:r], key=lambda x: (x[1], -x[0]))[0] >= 3), None)
    if stale is None:
        assert len(history) == 40 and model.trees() == best
    else:
        assert model.trees() == max(history[:stale], key=lambda x: (x[1], -x[0]))[0] == stale - 3
        assert stale <= len(history) < stale + 4


def test_staleness(spark):
    rows = spark.createDataFrame(list(enumerate([0.2, 0.5, 0.5, None, 0.4, 0.9], 1)), "round int, pr_auc double")
    got = boosting.with_staleness(rows, 3).orderBy("round").collect()
    assert [(r.best_round, r.stale, r.stopped) for r in got] == [
        (1, 0, False), (2, 0, False), (2, 1, False), (2, 2, False), (2, 3, True), (6, 0, True)]


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = table(spark)
    model, _ = boosting.fit(rows, 4, WHOLE, ["x", "z"])
    PipelineModel(stages=[model]).save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (m.transform(rows).select("transaction_id", "probability").orderBy("transaction_id").collect() for m in (model, again))
    assert a == b and all(0 < r.probability < 1 for r in a)


def test_without_positives(spark):
    rows = table(spark).withColumn("label", F.lit(0))
    model, history = boosting.fit(rows, 4, WHOLE, ["x", "z"])
    assert all(v is None for _, v in history)
    assert all(r.probability < 0.01 for r in model.transform(rows).select("probability").collect())


def test_candidates_beat_a_forest(spark):
    """Feature vectors of the larger table: both candidates against MLlib's forest of 10 trees of the same depth."""
    v = features.feature_vector(adapters.transactions(adapters.read_events(spark, SF.replace("0.001", "0.01"))))
    opts = TrainingOptions(rounds=6, depth=3, leaves=6, rate=0.4, chunk=6)
    split = training.stratified_split(v, opts).persist()
    model, staged = training.fit_candidates(split, 5.0, opts)
    test = split.filter("part = 'test'")
    voted = training.soft_vote(training.candidate_probabilities(model, test))
    got = {r.candidate: r.pr_auc for r in training.evaluate_candidates(voted).collect()}
    columns = [F.col(c).cast("double").alias(c) for c in training.FEATURE_COLS]
    assembler = VectorAssembler(inputCols=training.FEATURE_COLS, outputCol="features")

    def assembled(part):
        return assembler.transform(split.filter(part).select(*columns, F.col("label").cast("double").alias("label")))

    forest = RandomForestClassifier(numTrees=10, maxDepth=3, seed=1).fit(assembled("part = 'train'"))
    scored = forest.transform(assembled("part = 'test'")).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    want = quality_metrics(scored, []).first().pr_auc
    assert math.isfinite(want) and min(got.values()) >= want - 0.02
    for name, stage in zip(training.CANDIDATES, model.stages):
        assert stage.trees() == max(staged[name], key=lambda r: (r[1], -r[0]))[0]
