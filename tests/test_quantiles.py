"""Exact quantiles and the two-level prefix sum against numpy brute force."""
import numpy as np
from pyspark.sql import functions as F

from quarry.operators.prefix import running_totals
from quarry.operators.quantiles import column_quantiles, exact_quantiles


def _skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    vals = rng.normal(size=n)
    vals[: n // 3] = 0.25  # one value holds a third of the rows
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "k string, v double"), rows


def test_exact_quantiles_match_numpy(spark):
    df, rows = _skewed(spark)
    got = {(r.k, r.p): r.q for r in exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]).collect()}
    for k in ("a", "b"):
        xs = np.array([v for kk, v in rows if kk == k])
        for p in (0.0, 0.25, 0.5, 0.75, 0.95, 1.0):
            assert abs(got[(k, p)] - np.percentile(xs, p * 100)) < 1e-9


def test_running_totals_independent_of_partitions(spark):
    df = spark.range(0, 500).select((F.col("id") % 7).alias("g"), F.col("id").alias("o"),
                                    (F.col("id") % 5).alias("w"))
    a = running_totals(df, ["g"], "o", ["w"], ["c"], num_partitions=3)
    b = running_totals(df, ["g"], "o", ["w"], ["c"], num_partitions=11)
    ra = {(r.g, r.o): r.c for r in a.collect()}
    rb = {(r.g, r.o): r.c for r in b.collect()}
    assert ra == rb
    for g in range(7):
        acc = 0
        for o in range(500):
            if o % 7 == g:
                acc += o % 5
                assert ra[(g, o)] == acc


def test_bracketed_columns_match_numpy(spark):
    from quarry.operators.quantiles import column_profile, column_quantiles
    rng = np.random.default_rng(3)
    n = 40_000
    cols = {"a": rng.normal(size=n), "b": rng.integers(0, 7, n).astype(float),
            "c": np.where(rng.random(n) < .4, 1.5, rng.exponential(size=n))}
    df = spark.createDataFrame([(*map(float, r), None, float("nan")) for r in zip(*cols.values())],
                               "a double, b double, c double, d double, e double")
    df = df.unionByName(spark.createDataFrame([(None, float("nan"), None, None, None)], df.schema))
    probs, names = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0], ["q0", "q1", "q2", "q3", "q4", "q5"]
    got = {r.feature: r for r in column_quantiles(df, list("abcde"), probs, names).collect()}
    assert set(got) == {"a", "b", "c"}  # a column without values has no row
    for k, x in cols.items():
        for p, name in zip(probs, names):
            assert abs(got[k][name] - np.percentile(x, p * 100)) < 1e-9, (k, p)
    prof = {r.feature: r for r in column_profile(df, list("abcde"), [0.5], ["m"]).collect()}
    assert abs(prof["a"].std - cols["a"].std(ddof=1)) < 1e-9 and prof["b"]["count"] == n


def test_approximate_quantiles_close(spark):
    from quarry.operators.quantiles import column_quantiles
    df, rows = _skewed(spark, n=2000)
    ex = {r.feature: r.q50 for r in column_quantiles(df, ["v"], [0.5], ["q50"]).collect()}
    ap = {r.feature: r.q50 for r in column_quantiles(df, ["v"], [0.5], ["q50"], 10000).collect()}
    xs = sorted(v for _, v in rows)
    # rank error of the sketch is at most n / accuracy
    lo, hi = xs[int(len(xs) * 0.5) - 1], xs[min(len(xs) - 1, int(len(xs) * 0.5) + 1)]
    assert lo <= ap["v"] <= hi and lo <= ex["v"] <= hi


def test_column_quantiles_of_few_values(spark):
    """Columns of 1 to 40 values, the rest NULL: no quartile may be lost."""
    rng = np.random.default_rng(5)
    xs = {f"c{n}": rng.normal(size=n) for n in range(1, 41)}
    rows = [tuple(float(x[i]) if i < len(x) else None for x in xs.values()) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in xs))
    probs = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r["feature"]: r for r in column_quantiles(df, list(xs), probs, names).collect()}
    for c, x in xs.items():
        for p, name in zip(probs, names):
            assert abs(got[c][name] - np.percentile(x, p * 100)) < 1e-9, (c, p)
