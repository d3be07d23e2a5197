"""Rows in = rows out with NULL keys; NULL predictions are counted."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import drift as D
from quarry.operators import evaluate as E
from quarry.operators import quantiles as QN
from quarry.operators import rangeq as RQ
from quarry.operators import series as SR
from quarry.operators import split as SP


def test_stratified_split_keeps_rows_without_label(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("label"))
    out = SP.stratified_split(df, "id", "label", 0.2, 1)
    assert out.count() == 100
    assert {(r.label, r.n) for r in out.where("is_test").groupBy("label").agg(
        F.count("*").alias("n")).collect()} == {(None, 4), (0, 8), (1, 8)}


def test_quantiles_of_a_null_group(spark):
    df = spark.range(50).select(F.when(F.col("id") < 25, "a").alias("k"), F.col("id").cast("double").alias("v"))
    got = {(r.k, r.q) for r in QN.exact_quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {("a", 12.0), (None, 37.0)}


def test_null_predictions(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", None), (None, "a"), ("c", None)]
    df = spark.createDataFrame(rows, "y string, p string")
    assert {(r.actual, r.predicted): r.n for r in E.confusion_matrix(df, "y", "p").collect()} == {
        ("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 1}
    m = E.classification_metrics(df, "y", "p").first()
    assert m.rows_unscored == 3 and m.samples_evaluated == 3 and abs(m.accuracy - 2 / 3) < 1e-12
    rep = {r.row: r for r in E.classification_report(df, "y", "p").collect()}
    assert rep["unscored"].support == 3 and "c" not in rep and None not in rep
    assert abs(rep["macro avg"].recall - 0.75) < 1e-12
    nan = spark.createDataFrame([(1.0, 1.0), (0.0, float("nan"))], "y double, p double")
    assert E.classification_metrics(nan, "y", "p").first().rows_unscored == 1


@pytest.mark.parametrize("n1,n2", [(2, 3), (3, 5), (4, 6), (5, 5), (1, 7)])
def test_exact_law_is_the_share_of_all_orders(n1, n2):
    """Every order of n1 + n2 values is equally likely: count those whose D
    is as large."""
    stats = []
    for chosen in itertools.combinations(range(n1 + n2), n1):
        x = y = 0
        worst = 0
        for i in range(n1 + n2):
            x, y = (x + 1, y) if i in chosen else (x, y + 1)
            worst = max(worst, abs(x * n2 - y * n1))
        stats.append(worst)
    for d in sorted(set(stats)):
        want = np.mean([s >= d for s in stats])
        assert abs(D.exact_unequal(n1, n2, d / (n1 * n2)) - want) < 1e-12
    assert D.exact_unequal(n1, n2, 0.0) == 1.0


def test_exact_law_far_out_and_against_the_limit():
    one = D.exact_unequal(60, 80, 1.0)  # only the two extreme orders
    assert math.isclose(one, 2 / math.comb(140, 60), rel_tol=1e-9)
    n1, n2, d = 4000, 5000, 0.03
    lam = math.sqrt(n1 * n2 / (n1 + n2)) * d
    limit = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 50))
    assert abs(D.exact_unequal(n1, n2, d) - limit) < 0.01


def test_pvalue_methods(spark):
    stats = spark.createDataFrame([(100, 120, 0.2), (100, 100, 0.2), (20_000, 30_000, 0.01)],
                                  "n_ref long, n_cur long, ks_d double")
    got = {(r.n_ref, r.n_cur): (r.p_method, r.p_value) for r in D.ks_pvalue(stats, "auto").collect()}
    assert got[100, 120][0] == got[100, 100][0] == "exact" and got[20_000, 30_000][0] == "asymptotic"
    assert abs(got[100, 120][1] - D.exact_unequal(100, 120, 0.2)) < 1e-12
    assert abs(got[100, 100][1] - D.exact_unequal(100, 100, 0.2)) < 1e-9
    only = D.ks_pvalue(stats.limit(1), "exact").first()
    assert abs(only.p_value - got[100, 120][1]) < 1e-12


def at(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts"))


def test_a_series_that_stops_becomes_absent(spark):
    rows = [("a", 1000, 1.0), ("a", 1013, 2.0), (None, 1040, 5.0), ("a", 1300, 9.0)]
    df = at(spark, rows, "k string, ts long, v double")
    got = {(r.k, r.bin): r.v for r in RQ.instant_grid(
        df, ["k"], "v", F.timestamp_seconds(F.lit(1300)), lookback_s=300, step_s=10, stale_s=60,
        chunk_bins=7).collect()}
    want = {}
    for step in range(101, 131):
        for k in ("a", None):
            seen = [(t, v) for kk, t, v in rows if kk == k and step * 10 - 60 < t <= step * 10]
            if seen:
                want[k, step] = max(seen)[1]
    assert got == want and ("a", 108) not in got and got["a", 107] == 2.0


def extrapolated(samples, t, span):
    seen = [(s, v) for s, v in samples if t - span < s <= t]
    if len(seen) < 2:
        return None
    rise = sum(v if v < p else v - p for (_, p), (_, v) in zip(seen, seen[1:]))
    sampled = seen[-1][0] - seen[0][0]
    mean = sampled / (len(seen) - 1)
    start, end = seen[0][0] - (t - span), t - seen[-1][0]
    start = mean / 2 if start >= 1.1 * mean else start
    end = mean / 2 if end >= 1.1 * mean else end
    if rise > 0:
        start = min(start, sampled * seen[0][1] / rise)
    return rise * (sampled + start + end) / sampled / span


def test_extrapolated_rate_by_hand(spark):
    """Gaps, a reset, a counter near zero, and a series without a label."""
    a = [(1000 + 15 * i, 10.0 + 3 * i) for i in range(12)] + [(1200, 2.0), (1215, 7.0), (1290, 20.0)]
    b = [(1010, 0.5), (1070, 9.5), (1130, 9.5)]
    rows = [("a", s, v) for s, v in a] + [(None, s, v) for s, v in b]
    df = at(spark, rows, "k string, ts long, value double")
    got = {(r.k, r.bin): r.rate for r in RQ.rate_extrapolated(
        df, ["k"], F.timestamp_seconds(F.lit(1300)), lookback_s=300, range_s=120, step_s=10,
        chunk_bins=13).collect()}
    want = {(k, s): extrapolated(x, 10 * s, 120) for k, x in (("a", a), (None, b))
            for s in range(101, 131)}
    want = {k: v for k, v in want.items() if v is not None}
    assert set(got) == set(want) and len(got) > 30
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_stale_gauge(spark):
    df = at(spark, [("a", 100, 1.0), ("b", 390, 2.0)], "k string, ts long, v double")
    got = SR.gauge_last(df, ["k"], "v", as_of=F.timestamp_seconds(F.lit(401)), stale_s=300).collect()
    assert [(r.k, r.v) for r in got] == [("b", 2.0)]
