import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from txrisk.functions import scalar as S
from txrisk.operators import metrics, prefix


def quality(spark, rows, keys=(), **kw):
    df = spark.createDataFrame(rows, "g string, label int, probability double")
    return {tuple(r[k] for k in keys): r for r in metrics.quality_metrics(df, list(keys), **kw).collect()}


def test_textbook_values(spark):
    rows = [("a", 0, 0.1), ("a", 0, 0.4), ("a", 1, 0.35), ("a", 1, 0.8)]
    r = quality(spark, rows)[()]
    assert r.pr_auc == pytest.approx(0.8333333333)
    assert r.roc_auc == pytest.approx(0.75)
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 0, 2, 1)
    assert (r.precision, r.recall, r.accuracy) == (1.0, 0.5, 0.75)
    assert r.f1 == pytest.approx(2 / 3)
    assert r.brier_score_loss == pytest.approx((0.01 + 0.16 + 0.4225 + 0.04) / 4)


def test_edge_groups(spark):
    rows = [
        ("ties", 0, 0.5), ("ties", 1, 0.5),
        ("one class", 0, 0.2), ("one class", 0, 0.9),
        ("nothing", None, 0.5), ("nothing", 1, None),
        ("gaps", None, 0.5), ("gaps", 1, None), ("gaps", 1, float("nan")), ("gaps", 1, 0.9), ("gaps", 0, 0.1),
    ]
    r = quality(spark, rows, ["g"])
    assert r[("ties",)].roc_auc == 0.5 and r[("ties",)].pr_auc == 0.5
    # the threshold is strict
    assert (r[("ties",)].tp, r[("ties",)].f1) == (0, 0.0)
    assert r[("one class",)].roc_auc is None and r[("one class",)].pr_auc is None
    nothing = r[("nothing",)]
    assert (nothing.rows, nothing.rows_unlabelled, nothing.rows_unscored, nothing.roc_auc, nothing.log_loss) == (0, 1, 1, None, None)
    gaps = r[("gaps",)]
    assert (gaps.rows, gaps.rows_unlabelled, gaps.rows_unscored) == (2, 1, 2)
    assert gaps.roc_auc == 1.0


def test_metrics_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(g, int(rng.random() < 0.3), round(rng.random() ** 4, d)) for g, d in (("a", 2), ("b", 12)) for _ in range(300)]
    got = quality(spark, rows, ["g"])
    for g in "ab":
        pts = [(p, y) for k, y, p in rows if k == g]
        pos, neg = [p for p, y in pts if y], [p for p, y in pts if not y]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        ap, prev = 0.0, 0.0
        for t in sorted({p for p, _ in pts}, reverse=True):
            tp, n = sum(p >= t for p in pos), sum(p >= t for p, _ in pts)
            ap, prev = ap + (tp / len(pos) - prev) * tp / n, tp / len(pos)
        assert got[(g,)].roc_auc == pytest.approx(auc)
        assert got[(g,)].pr_auc == pytest.approx(ap)


def test_value_slice_grows_with_the_value(spark):
    rng = random.Random(3)
    vs = sorted({rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(2000)} | {0.0, 1.0, 2.0, 0.5, math.nextafter(1, 0), math.nextafter(2, 0)})
    df = spark.createDataFrame([(v,) for v in vs], "v double").select("v", S.value_slice(F.col("v")).alias("s"))
    slices = [r.s for r in df.orderBy("v").collect()]
    assert slices == sorted(slices) and len(set(slices)) > 1000


def test_running_totals_cross_slices(spark):
    rng = random.Random(5)
    rows = [(k, float(v), rng.randint(1, 9)) for k in "xy" for v in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    got = prefix.running_totals(df, ["k"], "v", ["n"], slice_by=F.floor(F.col("v") / 100)).collect()
    for r in got:
        mine = sorted((v, n) for k, v, n in rows if k == r.k)
        earlier = [v for v, _ in mine if v < r.v]
        assert r.n_upto == sum(n for v, n in mine if v <= r.v)
        assert r.n_total == sum(n for _, n in mine)
        assert r.prev_v == (max(earlier) if earlier else None)


def test_latency_summary(spark):
    log = spark.createDataFrame([(i, float(i), i % 10 != 0) for i in range(100)], "request_id int, latency_ms double, ok boolean")
    r = metrics.latency_summary(log, []).first()
    assert (r.requests_ok, r.errors) == (90, 10)
    assert (r.mean_ms, r.p50_ms, r.p95_ms, r.p99_ms, r.p99_9_ms, r.max_ms) == (49.5, 49.5, 94.05, 98.01, 98.9, 99.0)
    assert r["pass_p99_le_50ms"] is False
    assert metrics.latency_summary(log.filter("latency_ms < 40"), []).first()["pass_p99_le_50ms"] is True


def test_quantiles_with_repeated_values(spark):
    rng = random.Random(11)
    xs = [float(rng.choice([0, 1, 1, 1, 5, 9, 100])) for _ in range(77)]
    r = metrics.latency_summary(spark.createDataFrame([(x, True) for x in xs], "latency_ms double, ok boolean"), []).first()
    assert r.p50_ms == statistics.median(xs)


def test_latency_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 7.0), ("b", 2.0), ("a", None)], "g string, x double")
    got = {(r.g, r.le): r.observations for r in metrics.latency_histogram(df, ["g"], "x", [1, 5]).collect()}
    assert got == {("a", "1"): 2, ("a", "5"): 2, ("a", "+Inf"): 3, ("b", "1"): 0, ("b", "5"): 1, ("b", "+Inf"): 1}
