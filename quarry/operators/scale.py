"""Feature scaling (SCL1-2): fit on one table, apply to any table.

Fitted parameters are a small long table (feature, center, scale) — one row
per feature — that can be stored with a model; applying collects those rows
(bounded by the feature count) and projects with literals.
Standard scaling uses the population std (ddof=0); robust scaling uses the
exact median and IQR; a zero spread scales by 1.  NaN is missing: left out of
the fit and NULL in the result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import nan_to_null, zero_spread_to_one
from quarry.operators.quantiles import column_quantiles


def fit_scaler(train: DataFrame, cols: Sequence[str], method: str = "standard",
               approx_accuracy: int | None = None) -> DataFrame:
    cols = list(cols)
    if method == "standard":
        wide = train.agg(*[
            F.struct(F.lit(c).alias("feature"), F.avg(nan_to_null(F.col(c).cast("double"))).alias("center"),
                     F.stddev_pop(nan_to_null(F.col(c).cast("double"))).alias("scale")).alias(c)
            for c in cols
        ])
        params = wide.unpivot([], cols, "_k", "s").select("s.*")
    elif method == "robust":
        q = column_quantiles(train, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                             approx_accuracy)
        params = q.select("feature", F.col("median").alias("center"),
                          (F.col("q3") - F.col("q1")).alias("scale"))
    else:
        raise ValueError(f"unknown scaler {method!r}")
    return params.select("feature", "center", zero_spread_to_one("scale").alias("scale"),
                         F.lit(method).alias("method"))


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """x -> (x - center) / scale for the fitted features `cols`."""
    cols = [c for c in cols if c in df.columns]
    fitted = {r["feature"]: (r["center"], r["scale"])
              for r in params.where(F.col("feature").isin(cols)).collect()}
    return df.withColumns({
        c: (nan_to_null(F.col(c).cast("double")) - F.lit(fitted[c][0]).cast("double"))
        / F.lit(fitted[c][1]).cast("double")
        for c in cols if c in fitted
    })
