"""Counters with resets, histograms, quantiles, relabelling."""
import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import rangeq as RQ
from quarry.operators import series as SR


def test_counter_reset_rate(spark):
    # cumulative samples 0, 5, 9, 2 (reset), 6 -> increases 5, 4, 2, 4
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([0, 5, 9, 2, 6])],
                               "k string, bin long, value double")
    d = RQ.counter_deltas(df, ["k"]).orderBy("bin").collect()
    assert [r.delta for r in d] == [0.0, 5.0, 4.0, 2.0, 4.0]
    rate = RQ.rate_samples(df, ["k"], range_s=300, step_s=10).orderBy("bin").collect()
    assert abs(rate[-1].rate - 15.0 / 300) < 1e-12


def test_chunks_give_the_same_rates(spark):
    """Chunks of a few bins against one chunk, with gaps longer than a chunk."""
    import random
    rng = random.Random(3)
    bins = sorted(rng.sample(range(5000, 7000), 300) + [40, 41])
    ev = spark.createDataFrame([(k, b * 10 + 1, "success" if b % 3 else "error", 0.02 * (b % 5))
                                for b in bins for k in ("x", "y")[:1 + b % 2] for _ in range(b % 4)],
                               "k string, s long, status string, v double").withColumn(
        "ts", F.timestamp_seconds("s"))
    samples = spark.createDataFrame([("x", b, float(b % 50)) for b in bins],
                                    "k string, bin long, value double")
    for f in (lambda c: RQ.rate_events(ev, ["k"], chunk_bins=c),
              lambda c: RQ.success_ratio(ev, ["k"], chunk_bins=c),
              lambda c: RQ.bucket_rate(ev, ["k"], "v", chunk_bins=c),
              lambda c: RQ.rate_samples(samples, ["k"], chunk_bins=c),
              lambda c: RQ.counter_deltas(samples, ["k"], chunk_bins=c)):
        assert sorted(map(str, f(31).collect())) == sorted(map(str, f(10**6).collect()))


def test_histogram_inf_equals_count(spark):
    df = spark.createDataFrame([("m", v) for v in [0.001, 0.02, 0.3, 20.0]], "k string, v double")
    h = {r.le: r.bucket_count for r in SR.histogram(df, ["k"], "v").collect()}
    assert h["+Inf"] == 4 and h["0.005"] == 1 and h["0.025"] == 2 and h["10.0"] == 3


def test_histogram_quantile_interpolates(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("m", t, v) for v in [0.004] * 50 + [0.02] * 50]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    wide = RQ.bucket_rate(df, ["k"], "v")
    q = RQ.histogram_quantile(wide, ["k"], 0.75).first().quantile
    # rank 75 of 100 falls in (0.01, 0.025] holding 50 -> 0.01 + 0.015 * 25/50
    assert abs(q - 0.0175) < 1e-12
    q0 = RQ.histogram_quantile(wide, ["k"], 0.25).first().quantile
    assert abs(q0 - 0.0025) < 1e-12


def test_relabel(spark):
    df = spark.createDataFrame([("/predict/housing",), ("/health",)], "endpoint string")
    got = [r.model for r in SR.relabel(df, "endpoint", "model", "/predict/(.*)", "${1}").collect()]
    assert got == ["housing", None]


def test_request_pairs_unmatched(spark):
    t = dt.datetime(2024, 1, 1)
    starts = spark.createDataFrame([(1, t), (2, t)], "request_id long, ts timestamp")
    ends = spark.createDataFrame([(1, t + dt.timedelta(seconds=2)), (3, t)], "request_id long, ts timestamp")
    got = {r.request_id: (r.duration_s, r.state) for r in SR.request_pairs(starts, ends).collect()}
    assert got == {1: (2.0, "closed"), 2: (None, "open"), 3: (0.0, "unmatched_end")}
