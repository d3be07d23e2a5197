"""KS statistic / p-value against brute force on the seeded drift pair (FIXTURES A3)."""
import math

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import drift as D


def _ks_numpy(a, b):
    xs = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


def _pair(spark, n=1000, seed=42):
    rng = np.random.default_rng(seed)
    ref = np.c_[rng.normal(0, 1, n), rng.normal(5, 2, n), rng.uniform(0, 10, n)]
    cur = np.c_[rng.normal(0.5, 1.2, n), rng.normal(5, 2, n), rng.uniform(2, 12, n)]
    cols = "feature1 double, feature2 double, feature3 double"
    return (spark.createDataFrame([tuple(map(float, r)) for r in ref], cols),
            spark.createDataFrame([tuple(map(float, r)) for r in cur], cols), ref, cur)


def test_ks_statistic_matches_brute_force(spark):
    r, c, ref, cur = _pair(spark)
    got = {x.feature: x.ks_d for x in D.ks_statistic(r, c).collect()}
    for i, f in enumerate(["feature1", "feature2", "feature3"]):
        assert abs(got[f] - _ks_numpy(ref[:, i], cur[:, i])) < 1e-12


def _exact(n, h):
    total = 0.0
    j = 1
    while n - j * h >= 0:
        total += (-1) ** (j - 1) * math.comb(2 * n, n - j * h) / math.comb(2 * n, n)
        j += 1
    return 2 * total


def test_exact_pvalue_formula(spark):
    df = spark.createDataFrame([(5, 5, 3 / 5), (1000, 1000, 74 / 1000)],
                               "n_ref long, n_cur long, ks_d double")
    got = [r.p_value for r in D.ks_pvalue(df, "exact").orderBy("n_ref").collect()]
    assert abs(got[0] - 0.35714285714) < 1e-9
    assert abs(got[1] - _exact(1000, 74)) < 1e-9
    assert abs(got[1] - 0.0083531) < 1e-6


def test_exact_pvalue_against_integers(spark):
    cases = [(n, h) for n in (1, 2, 7, 12, 30, 333, 4000) for h in {1, 2, max(1, n // 3), n}]
    df = spark.createDataFrame([(n, n, h / n) for n, h in cases] + [(5, 6, 0.5)],
                               "n_ref long, n_cur long, ks_d double")
    rows = D.ks_pvalue(df, "exact").collect()
    got = {(r.n_ref, round(r.ks_d * r.n_ref)): r.p_value for r in rows if r.n_ref == r.n_cur}
    for n, h in cases:
        assert abs(got[(n, h)] - min(1, max(0, _exact(n, h)))) < 1e-9, (n, h)
    assert [round(r.p_value, 6) for r in rows if r.n_ref != r.n_cur] == [
        round(D.exact_unequal(5, 6, 0.5), 6)]


def test_asymptotic_is_the_same_law_at_every_size(spark):
    """The alternating series summed far out, on both sides of lambda = 1; and
    one changed value among many is no drift."""
    cases = [(2_000, 0.01), (2_000, 0.0299), (2_000, 0.0305), (10**7, 4e-4), (10**12, 1e-12)]
    df = spark.createDataFrame([(n, n, d) for n, d in cases], "n_ref long, n_cur long, ks_d double")
    for r in D.ks_pvalue(df).collect():
        m = r.n_ref / 2
        lam = (math.sqrt(m) + 0.12 + 0.11 / math.sqrt(m)) * r.ks_d
        j = np.arange(1, 2_000_001, dtype=float)
        p = 2 * math.fsum(np.where(j % 2 == 1, 1, -1) * np.exp(-2 * (j * lam) ** 2))
        assert abs(r.p_value - (p if lam > 1e-3 else 1)) < 1e-9
    ref = spark.range(200_000).selectExpr("cast(id as double) x")
    rep = D.drift_report(ref, ref.selectExpr("if(x = 0, -1, x) x"), "m").first()
    assert rep.drift_score > 0.999 and rep.recommendation == "No action needed"


def test_drift_report_detects_shift(spark):
    r, c, _, _ = _pair(spark)
    rep = D.drift_report(r, c.withColumn("extra", F.lit("x")), "m").first()
    # verdict is on the MEAN p-value: two shifted features, one unchanged
    assert rep.features_with_drift == "feature1,feature3"
    assert rep.drift_detected == (rep.drift_score < 0.05)
    assert rep.recommendation == ("Retrain model" if rep.drift_detected else "No action needed")
    strict = D.drift_report(r.drop("feature2"), c.drop("feature2"), "m").first()
    assert strict.drift_detected is True and strict.recommendation == "Retrain model"


def test_drift_report_no_shared_feature(spark):
    a = spark.createDataFrame([(1.0,)], "x double")
    b = spark.createDataFrame([(1.0,)], "y double")
    rep = D.drift_report(a, b, "m").first()
    assert rep.drift_detected is False and rep.drift_score is None


def test_performance_drop(spark):
    hist = spark.createDataFrame([("m", "accuracy", 0.9, 1), ("m", "accuracy", 0.95, 2)],
                                 "model_name string, metric string, value double, ts int")
    cur = spark.createDataFrame([("m", "accuracy", 0.85), ("new", "accuracy", 0.1)],
                                "model_name string, metric string, value double")
    got = {r.model_name: r.dropped for r in D.performance_drop(hist, cur).collect()}
    assert got == {"m": True, "new": False}
