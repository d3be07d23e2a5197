"""Two-sample drift tests (DRF1-4).

KS statistic: both tables are unpivoted to (feature, value), reduced to
per-value counts of each side (a value holding a third of the rows becomes
one row), and the two empirical CDFs are running sums from the two-level
prefix sum, so no task ever holds a whole feature column.
D = max |F_ref - F_cur| over the distinct values.

p-value, by the caller's choice of law (the same at every size):

* `asymptotic`: the limiting Kolmogorov distribution at Stephens' corrected
  lambda = (sqrt(m) + 0.12 + 0.11 / sqrt(m)) D, m = n1 n2 / (n1 + n2): the
  alternating series from lambda = 1 on, its theta-function dual below, where
  the alternating one does not converge in few terms.
* `exact`, unequal sizes: lattice paths that leave the band (`exact_unequal`).
* `exact`, equal sample sizes n:
      p = 2 * sum_{j>=1} (-1)^(j-1) C(2n, n - j h) / C(2n, n),   h = round(D n)
  with the ratio of binomials in closed form, so a term costs the same at any
  n; terms below 1e-17 of the first are not written out (about sqrt(40 n) / h).
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.prefix import running_totals
from quarry.operators.quantiles import feature_name, unpivot_ids

#: Terms after which either series has converged to double precision.
SERIES_TERMS = 8
#: Rows a side up to which method `auto` takes the exact law.
EXACT_ROWS = 10_000
LN_FACTORIALS = [math.lgamma(i + 1) for i in range(10)]


def shared_numeric_features(ref: DataFrame, cur: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric columns present in both tables, and shared columns skipped
    because they are not numeric in both."""
    rt = {f.name: f.dataType for f in ref.schema.fields}
    ct = {f.name: f.dataType for f in cur.schema.fields}
    shared = [c for c in ref.columns if c in ct]
    num = [c for c in shared
           if isinstance(rt[c], T.NumericType) and isinstance(ct[c], T.NumericType)]
    return num, [c for c in shared if c not in num]


def _long(df: DataFrame, cols: Sequence[str], is_ref: bool) -> DataFrame:
    return unpivot_ids(df, cols).where(
        F.col("value").isNotNull() & ~F.isnan("value")).withColumn("is_ref", F.lit(is_ref))


def ks_statistic(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """DRF1: (feature, n_ref, n_cur, ks_d) per shared numeric feature."""
    feats = list(features) if features is not None else shared_numeric_features(ref, cur)[0]
    both = _long(ref, feats, True).unionByName(_long(cur, feats, False))
    counts = both.groupBy("fid", "value").agg(
        F.count_if(F.col("is_ref")).alias("c_ref"),
        F.count_if(~F.col("is_ref")).alias("c_cur"))
    cum = running_totals(counts, ["fid"], "value", ["c_ref", "c_cur"], ["cum_ref", "cum_cur"])
    sizes = cum.groupBy("fid").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    gap = F.abs(F.col("cum_ref") / F.col("n_ref") - F.col("cum_cur") / F.col("n_cur"))
    return cum.join(sizes, "fid").groupBy("fid", "n_ref", "n_cur").agg(
        F.max(gap).alias("ks_d")).select(feature_name("fid", feats).alias("feature"),
                                         "n_ref", "n_cur", "ks_d")


def _stirling_rest(x: Column) -> Column:
    """ln x! - ((x + 1/2) ln x - x + ln(2 pi) / 2), for x >= 10."""
    return (F.lit(1 / 12) - (F.lit(1 / 360) - F.lit(1 / 1260) / (x * x)) / (x * x)) / x


def _ln_factorial(x: Column) -> Column:
    small = F.get(F.array(*[F.lit(v) for v in LN_FACTORIALS]), x.cast("int"))
    safe = F.greatest(x, F.lit(1.0))
    large = (safe + 0.5) * F.ln(safe) - safe + F.lit(0.5 * math.log(2 * math.pi)) \
        + _stirling_rest(safe)
    return F.when(x < 10, small).otherwise(large)


def _ln_ratio(n: Column, k: Column) -> Column:
    """ln C(2n, n - k) / C(2n, n); away from k = n the large terms cancel in
    closed form, so the result is exact for any n."""
    near = F.greatest(n - k, F.lit(1.0))
    apart = -((n + k + 0.5) * F.log1p(k / n) + (n - k + 0.5) * F.log1p(-k / n)) \
        + 2 * _stirling_rest(n) - _stirling_rest(near) - _stirling_rest(n + k)
    return F.when(n - k >= 10, apart).otherwise(
        2 * _ln_factorial(n) - _ln_factorial(n - k) - _ln_factorial(n + k))


def _exact_equal_n(n: Column, d: Column) -> Column:
    n = n.cast("double")
    h = F.round(d * n)
    step = F.greatest(h, F.lit(1.0))
    terms = F.least(F.floor(n / step), F.ceil(F.sqrt(40 * n) / step) + 1).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), lambda j:
                       F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(_ln_ratio(n, j * step)))
    p = 2.0 * F.aggregate(each, F.lit(0.0), lambda a, t: a + t)
    return F.when(h <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def exact_unequal(n1: int, n2: int, d: float) -> float:
    """P(D >= d) of samples of n1 and n2 rows under one continuous law.

    A sample pair is a lattice path from (0, 0) to (n1, n2), all equally
    likely.  f(x, y), the share of the paths to (x, y) that have left the band
    |x / n1 - y / n2| < d, is 1 outside the band and the mean of its two
    neighbours before it, weighted by x and y, inside: sums of positive terms
    in [0, 1], so small values keep their digits.  One diagonal x + y is
    computed at a time, only within the band."""
    g = math.gcd(n1, n2)
    a, b = n1 // g, n2 // g
    limit = round(d * a * b * g)  # leaves at |x b - y a| >= limit
    if limit <= 0:
        return 1.0
    f, low = np.zeros(1), 0  # f of the band's x on the last diagonal, from `low` on
    for s in range(1, n1 + n2 + 1):
        # x b - (s - x) a in (-limit, limit), 0 <= x <= n1 and s - x <= n2
        first = max(0, s - n2, -((limit - 1 - s * a) // (a + b)))
        last = min(n1, s, (limit - 1 + s * a) // (a + b))
        if last < first:
            return 1.0
        x = np.arange(first, last + 1)
        held = np.concatenate([np.ones(1), f, np.ones(1)])  # 1 beyond the band

        def before(at: np.ndarray) -> np.ndarray:
            return held[np.clip(at - low + 1, 0, len(f) + 1)]

        f, low = (before(x - 1) * x + before(x) * (s - x)) / s, first
    return float(min(1.0, f[n1 - low]))


@F.pandas_udf(T.DoubleType())
def _exact_unequal(n1: pd.Series, n2: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(z) or not x or not y else exact_unequal(int(x), int(y), z)
                      for x, y, z in zip(n1, n2, d)], dtype="float64")


def _asymptotic(n1: Column, n2: Column, d: Column) -> Column:
    m = n1.cast("double") * n2 / (n1 + n2)
    lam = (F.sqrt(m) + 0.12 + 0.11 / F.sqrt(m)) * d
    at = F.greatest(lam, F.lit(1e-9))

    def total(term) -> Column:
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), term),
                           F.lit(0.0), lambda a, t: a + t)

    large = 2.0 * total(lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0)
                        * F.exp(-2.0 * j * j * at * at))
    dual = 1.0 - F.lit(math.sqrt(2 * math.pi)) / at * total(
        lambda k: F.exp(-F.pow(2 * k - 1, 2) * F.lit(math.pi ** 2 / 8) / (at * at)))
    return F.least(F.greatest(F.when(lam < 1, dual).otherwise(large), F.lit(0.0)), F.lit(1.0))


def ks_pvalue(stats: DataFrame, method: str = "asymptotic") -> DataFrame:
    """DRF2: adds `p_value` and `p_method` to `ks_statistic` rows.

    exact: a closed sum for equal sizes, lattice paths for unequal ones (some
    n1 + n2 steps over a band of d times the sizes).  auto: exact up to
    `EXACT_ROWS` rows a side, else asymptotic; `p_method` says which."""
    n1, n2, d = F.col("n_ref"), F.col("n_cur"), F.col("ks_d")
    small = F.greatest(n1, n2) <= EXACT_ROWS if method == "auto" else F.lit(True)
    # a Python function is called on every row: others than its own are NULL
    counted = [F.when(small & (n1 != n2), c) for c in (n1, n2, d)]
    exact = F.when(n1 == n2, _exact_equal_n(n1, d)).otherwise(_exact_unequal(*counted))
    if method == "auto":
        return stats.withColumns({
            "p_value": F.when(small, exact).otherwise(_asymptotic(n1, n2, d)),
            "p_method": F.when(small, "exact").otherwise("asymptotic")})
    if method == "exact":
        p = exact
    elif method == "asymptotic":
        p = _asymptotic(n1, n2, d)
    else:
        raise ValueError(f"unknown method {method!r}")
    return stats.withColumns({"p_value": p, "p_method": F.lit(method)})


def drift_report(ref: DataFrame, cur: DataFrame, model_name: str,
                 threshold: float = 0.05) -> DataFrame:
    """DRF3: one verdict row: mean p over features, detected when below the
    threshold, features with p below it, recommendation text.  No shared
    numeric feature -> score NULL and not detected."""
    feats, skipped = shared_numeric_features(ref, cur)
    if not feats:  # nothing to compare: score undefined, not detected
        return ref.sparkSession.createDataFrame(
            [(model_name, False, None, "", "No action needed", ",".join(skipped), float(threshold))],
            "model_name string, drift_detected boolean, drift_score double, "
            "features_with_drift string, recommendation string, skipped_features string, "
            "threshold double")
    per = ks_pvalue(ks_statistic(ref, cur, feats))
    t = F.lit(float(threshold))
    score = F.avg("p_value")
    detected = F.coalesce(score < t, F.lit(False))
    return per.agg(
        score.alias("drift_score"),
        detected.alias("drift_detected"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("p_value") < t, F.col("feature")))),
                     ",").alias("features_with_drift"),
        F.when(detected, F.lit("Retrain model")).otherwise(F.lit("No action needed"))
        .alias("recommendation"),
    ).select(F.lit(model_name).alias("model_name"), "drift_detected", "drift_score",
             "features_with_drift", "recommendation",
             F.lit(",".join(skipped)).alias("skipped_features"),
             F.lit(float(threshold)).alias("threshold"))


# fixed values: default performance-drop thresholds (absolute difference)
DEFAULT_DROP = {"r2_score": 0.1, "accuracy": 0.05}


def performance_drop(history: DataFrame, current: DataFrame,
                     thresholds: DataFrame | None = None) -> DataFrame:
    """DRF4: latest historical score per (model, metric) vs the current score;
    drop = history - current > threshold (per-model override, else the
    metric default); a model without history -> false.

    history: (model_name, metric, value, ts); current: (model_name, metric,
    value); thresholds: optional (model_name, threshold)."""
    last = history.groupBy("model_name", "metric").agg(
        F.max_by("value", "ts").alias("historical"))
    out = current.join(last, ["model_name", "metric"], "left")
    default = F.when(F.col("metric") == "r2_score", F.lit(DEFAULT_DROP["r2_score"])) \
        .when(F.col("metric") == "accuracy", F.lit(DEFAULT_DROP["accuracy"]))
    if thresholds is not None:
        out = out.join(thresholds, "model_name", "left")
        thr = F.coalesce(F.col("threshold"), default)
    else:
        thr = default
    return out.select(
        "model_name", "metric", F.col("value").alias("current"), "historical",
        thr.alias("threshold"),
        F.coalesce((F.col("historical") - F.col("value")) > thr, F.lit(False)).alias("dropped"),
    )
