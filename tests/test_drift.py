import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from txrisk.operators import drift


def frame(spark, xs, **cats):
    rows = [(float(x) if x is not None else None, *[v[i] for v in cats.values()]) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "x double" + "".join(f", {c} string" for c in cats))


def wasserstein(a, b):
    points = sorted(set(a) | set(b))
    return sum(abs(sum(v <= lo for v in a) / len(a) - sum(v <= lo for v in b) / len(b)) * (hi - lo) for lo, hi in zip(points, points[1:]))


def test_distances_against_brute_force(spark):
    rng = random.Random(1)
    a = [round(rng.gauss(0, 3), 2) for _ in range(200)]
    b = [round(rng.gauss(1, 2), 2) for _ in range(150)]
    r = drift.numeric_distances(frame(spark, a), frame(spark, b), ["x"]).first()
    assert (r.n_ref, r.n_cur) == (200, 150)
    assert r.wasserstein == pytest.approx(wasserstein(a, b) / statistics.pstdev(a))
    assert r.ks == pytest.approx(max(abs(sum(v <= p for v in a) / 200 - sum(v <= p for v in b) / 150) for p in a + b))


def test_identical_frames_do_not_drift(spark):
    xs, c = list(range(50)), ["a", "b"] * 25
    f = frame(spark, xs, c=c)
    for method in ("distance", "p_value", "z"):
        columns = drift.drift_columns(f, f, ["x"], ["c"], method)
        assert [r.drifted for r in columns.collect()] == [False, False]
        verdict = drift.dataset_drift(columns).first()
        assert (verdict.n_drifted, verdict.share_of_drifted_columns, verdict.dataset_drift) == (0, 0.0, False)


def test_shifted_frames_drift(spark):
    ref = frame(spark, range(100), c=["a"] * 50 + ["b"] * 50)
    cur = frame(spark, range(60, 160), c=["a"] * 95 + ["b"] * 5)
    for method, names in (("distance", {"wasserstein", "jensen_shannon"}), ("p_value", {"ks", "chi_square"}), ("z", {"ks", "z"})):
        rows = drift.drift_columns(ref, cur, ["x"], ["c"], method).collect()
        assert {r.method for r in rows} == names and all(r.drifted for r in rows)
    assert drift.dataset_drift(drift.drift_columns(ref, cur, ["x"], ["c"])).first().dataset_drift


def test_method_does_not_depend_on_the_frames(spark):
    few = frame(spark, [i % 3 for i in range(12)], c=["a", "b"] * 6)
    many = frame(spark, [i % 700 for i in range(1400)], c=["a", "b", "c", "d"] * 350)
    for ref, cur in ((few, many), (many, few)):
        assert {r.column: r.method for r in drift.drift_columns(ref, cur, ["x"], ["c"]).collect()} == {"x": "wasserstein", "c": "jensen_shannon"}


def test_columns_without_values_stay(spark):
    ref = frame(spark, [1, 2, 3], c=["a", "b", "a"])
    cur = frame(spark, [None, None, float("inf")], c=[None, None, None])
    rows = {r.column: r for r in drift.drift_columns(ref, cur, ["x"], ["c"]).collect()}
    assert (rows["x"].drifted, rows["x"].score, rows["x"].n_cur, rows["x"].left_cur) == (True, None, 0, 1)
    assert (rows["c"].drifted, rows["c"].score) == (True, None)
    assert drift.dataset_drift(drift.drift_columns(ref, cur, ["x"], ["c"])).first().n_columns == 2
    assert not any(r.drifted for r in drift.drift_columns(cur.limit(0), cur.limit(0), ["x"], ["c"]).collect())


def test_empty_column_lists(spark):
    f = frame(spark, [1, 2], c=["a", "b"])
    assert [r.column for r in drift.drift_columns(f, f, [], ["c"]).collect()] == ["c"]
    assert [r.column for r in drift.drift_columns(f, f, ["x"], []).collect()] == ["x"]
    assert drift.drift_columns(f, f, [], []).count() == 0
    assert [r.column for r in drift.data_quality(f, [], [], ["c"]).collect()] == ["c"]


@pytest.mark.parametrize("dof", [1, 2, 3, 10, 1489, 2000, 100_000])
def test_chi_square_tail_near_its_mean(dof):
    # Wilson and Hilferty's cube root is within 1e-3 of the tail there
    for x in (dof, dof * 1.05):
        z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
        assert drift.gamma_tail(dof / 2, x / 2) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=1e-2 if dof < 3 else 2e-3)
    assert drift.gamma_tail(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)


def test_p_values(spark):
    df = spark.createDataFrame([(3.841458820694124, 1.0), (5.991464547107979, 2.0), (12.591587243743977, 6.0), (11.070497693516351, 5.0), (math.inf, 3.0), (0.0, 4.0)], "x double, k double")
    got = [r[0] for r in df.select(drift.chi_square_p_value("x", "k")).collect()]
    assert got == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.0, 1.0])
    assert df.select(drift.normal_p_value(F.lit(1.959963984540054))).first()[0] == pytest.approx(0.05)
    ks = df.select(drift.ks_p_value(F.lit(1.3580986 / 1e3), F.lit(2e6), F.lit(2e6))).first()[0]
    assert ks == pytest.approx(0.05, rel=1e-3)


def test_unseen_category(spark):
    ref = frame(spark, [1, 1], c=["a", "a"])
    cur = frame(spark, [1, 1], c=["a", "b"])
    r = drift.categorical_distances(ref, cur, ["c"]).first()
    assert r.chi_square == math.inf
    assert r.jensen_shannon == pytest.approx(math.sqrt((math.log(4 / 3) + 0.5 * math.log(2 / 3) + 0.5 * math.log(2)) / 2))


def test_missing_values(spark):
    ref = frame(spark, [1, 2, None, float("nan")], c=["a", None, "a", "b"])
    r = drift.numeric_distances(ref, ref, ["x"]).first()
    assert r.n_ref == 2
    empty = {r.column: r for r in drift.data_quality(frame(spark, [None, None]), [], ["x"], ["x"]).collect() if r.kind == "num"}["x"]
    assert (empty.rows, empty.nulls, empty.distinct_values, empty.mean, empty.p50, empty.most_common) == (2, 2, 0, None, None, None)
    q = {r.column: r for r in drift.data_quality(ref, [], ["x"], ["c"]).collect()}
    assert (q["x"].rows, q["x"].nulls, q["x"].distinct_values, q["x"].mean, q["x"].std, q["x"].p50) == (4, 2, 2, 1.5, 0.5, 1.5)
    assert (q["c"].rows, q["c"].nulls, q["c"].distinct_values, q["c"].most_common, q["c"].most_common_rows) == (4, 1, 2, "a", 2)


def test_profiles_give_the_same_reports(spark):
    """Profiles of parts, merged, against the frames themselves."""
    rng = random.Random(4)
    odd = [None, float("nan"), float("inf"), -0.0]
    ref = frame(spark, [rng.choice([rng.randint(0, 30), *odd]) for _ in range(300)], c=[rng.choice(["a", "b", None]) for _ in range(300)])
    cur = frame(spark, [rng.choice([rng.randint(5, 40), *odd]) for _ in range(200)], c=[rng.choice(["a", "d", None]) for _ in range(200)])
    halves = ref.randomSplit([0.5, 0.5], 1)
    profiled = drift.profile(halves[0], ["x"], ["c"]).merged(drift.profile(halves[1], ["x"], ["c"])), drift.profile(cur, ["x"], ["c"], keep=True)
    for method in drift.METHODS:
        want = drift.drift_columns(ref, cur, ["x"], ["c"], method).toPandas().round(9).sort_values("column")
        got = drift.drift_columns(*profiled, ["x"], ["c"], method).toPandas().round(9).sort_values("column")
        assert got.equals(want)
    want = drift.data_quality(ref, [], ["x"], ["c"]).toPandas().round(9).sort_values("column").reset_index(drop=True)
    got = drift.data_quality(profiled[0].rows, [], ["x"], ["c"], profiled=True).toPandas().round(9).sort_values("column").reset_index(drop=True)
    assert got.equals(want)


def test_each_frame_is_scanned_once_per_kind(spark, tmp_path):
    for name in ("ref", "cur"):
        frame(spark, range(20), c=["a", "b"] * 10).write.parquet(str(tmp_path / name))
    frames = [spark.read.parquet(str(tmp_path / name)) for name in ("ref", "cur")]
    columns = drift.drift_columns(*frames, ["x"], ["c"])
    columns.collect()
    plan = columns._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") <= 2 * 2
    kept = [drift.profile(f, ["x"], ["c"], keep=True) for f in frames]
    assert "FileScan" not in drift.drift_columns(*kept, ["x"], ["c"])._jdf.queryExecution().executedPlan().toString()


def test_report_slices(spark):
    df = spark.range(100).select(F.lit("s").alias("source"), (F.col("id") * 61_000_000 % 1_000_000_007).alias("at"), "id")
    for slice_rows in (10**6, 40, 1):
        got = drift.report_slices(df, "source", "at", "id", batch_size=30, slice_rows=slice_rows).orderBy("at").collect()
        assert [r.report_id for r in got] == [i // 30 for i in range(100)]


def test_baseline_prediction(spark):
    df = spark.createDataFrame([(1,), (0,)], "label int")
    assert [r.prediction for r in drift.baseline_with_prediction(df).collect()] == [1.0, 0.0]
    kept = df.withColumn("prediction", F.lit(0.3))
    assert drift.baseline_with_prediction(kept).first().prediction == 0.3


def test_classification_quality(spark):
    ref = spark.createDataFrame([(1, 1.0), (0, 0.0)], "label int, prediction double")
    cur = spark.createDataFrame([(1, 0.2), (0, 0.6), (None, 0.5)], "label int, prediction double")
    got = {r.frame: r for r in drift.classification_quality(ref, cur).collect()}
    assert got["reference"].roc_auc == 1.0 and got["current"].roc_auc == 0.0
    assert got["current"].rows_unlabelled == 1
