"""Property-based checks: exact quantiles and KS statistics
against numpy brute force on random small tables with many ties, histogram
buckets monotone with +Inf = count."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import drift as D
from quarry.operators import series as SR
from quarry.operators.quantiles import exact_quantiles

values = st.lists(st.integers(min_value=-5, max_value=5).map(lambda x: x / 2.0),
                  min_size=1, max_size=40)


@settings(max_examples=6, deadline=None)
@given(xs=values, p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantile_matches_numpy(spark, xs, p):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = exact_quantiles(df, [], "v", [p]).first().q
    assert abs(got - float(np.percentile(xs, p * 100))) < 1e-9


@settings(max_examples=5, deadline=None)
@given(a=values, b=values)
def test_ks_matches_brute_force(spark, a, b):
    ra = spark.createDataFrame([(x,) for x in a], "f double")
    rb = spark.createDataFrame([(x,) for x in b], "f double")
    got = D.ks_statistic(ra, rb).first().ks_d
    grid = sorted(set(a) | set(b))
    fa = [sum(x <= g for x in a) / len(a) for g in grid]
    fb = [sum(x <= g for x in b) / len(b) for g in grid]
    assert abs(got - max(abs(u - w) for u, w in zip(fa, fb))) < 1e-12


@settings(max_examples=4, deadline=None)
@given(xs=st.lists(st.floats(min_value=0, max_value=20, allow_nan=False), min_size=1, max_size=30))
def test_histogram_monotone(spark, xs):
    df = spark.createDataFrame([("m", x) for x in xs], "k string, v double")
    rows = sorted(SR.histogram(df, ["k"], "v").collect(), key=lambda r: r.le_value)
    counts = [r.bucket_count for r in rows]
    assert counts == sorted(counts) and counts[-1] == len(xs)
