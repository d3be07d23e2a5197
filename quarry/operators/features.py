"""Feature operators (PRJ, MAP, ARI, OUT, STD, BIN).

Table-level statistics (ratio means, quartile bounds, mean/std) follow the
estimator / transformer pattern: one distributed aggregate *fits* them, the
result — one value per column, so its size is bounded by the schema, not the
data — comes back as a single row, and *applying* them is a plain projection
with literals (no join, no per-row subquery, nothing re-fitted when the
output is read twice).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import (bucket_right_closed, clip, euclidean_norm, nan_to_null,
                                      safe_div)
from quarry.operators.quantiles import column_quantiles


# --- projections -----------------------------------------------------------

def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ1: rename by map, unmapped names kept."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns and k != v})


def split_target(df: DataFrame, target: str | None = None,
                 exclude: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """PRJ2: (features, target name); target = named column if present else the
    last column; features are every other column not excluded."""
    t = target if target in df.columns else df.columns[-1]
    feats = [c for c in df.columns if c != t and c not in exclude]
    return df.select(*feats), t


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """PRJ3: numeric columns only (plus `keep`)."""
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, T.NumericType) and f.name not in keep]
    return df.select(*keep, *num)


def to_double(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PRJ4: integer features to double."""
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType,
                                               T.ByteType))]
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# --- dictionary lookups ----------------------------------------------------

def _literal_map(mapping: Mapping) -> Column:
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def map_values(c: Column | str, mapping: Mapping) -> Column:
    """MAP1: code -> label; unknown code -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(_literal_map(mapping), c)


def map_values_table(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str,
                     name: str) -> DataFrame:
    """MAP1 for large dictionaries: left join on the code (Spark picks a
    broadcast only when AQE measures the mapping side as small)."""
    m = mapping.select(F.col(key).alias("_map_key"), F.col(value).alias(name))
    return df.join(m, df[col] == m["_map_key"], "left").drop("_map_key")


def map_with_fallback(c: Column | str, mapping: Mapping[int, str], prefix: str = "class_") -> Column:
    """MAP2: code -> label, else `class_{code}`.  A number is cut to its integer
    (models emit 1.0 for class 1); text that is no integer is kept."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    as_int = F.when(number, c.cast("string").try_cast("double").try_cast("int")).otherwise(
        c.cast("string").try_cast("int"))
    return F.coalesce(F.try_element_at(_literal_map(mapping), as_int),
                      F.when(as_int.isNotNull(), F.concat(F.lit(prefix), as_int.cast("string"))),
                      c.cast("string"))


# --- arithmetic ------------------------------------------------------------

def products(df: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """ARI1: name = a * b."""
    return df.withColumns({n: F.col(a) * F.col(b) for a, b, n in specs})


def squares(df: DataFrame, specs: Sequence[tuple[str, str]]) -> DataFrame:
    """ARI3: name = c ** 2."""
    return df.withColumns({n: F.pow(F.col(c), 2) for c, n in specs})


def norms(df: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """ARI4: name = sqrt(a**2 + b**2)."""
    return df.withColumns({n: euclidean_norm(a, b) for a, b, n in specs})


def raw_ratios(df: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """name = a / b with x/0 and 0/0 as NULL (not yet filled)."""
    return df.withColumns({n: safe_div(a, b) for a, b, n in specs})


def safe_ratios(df: DataFrame, specs: Sequence[tuple[str, str, str]],
                stats: Column | None = None) -> DataFrame:
    """ARI2: name = a / b; +-inf and NaN (x/0, 0/0) become the mean of the
    finite ratios of the whole table.  `stats` (from `table_stats`) lets a
    chain fit every statistic in one pass."""
    if not specs:
        return df
    raw = raw_ratios(df, specs)
    if stats is None:
        stats = table_stats(raw, [n for _, _, n in specs])
    return raw.withColumns({n: F.coalesce(F.col(n), stats[n]) for _, _, n in specs})


def fill_ratios(df: DataFrame, names: Sequence[str], stats: Column) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), stats[n]) for n in names})


def _lit(v) -> Column:
    return F.lit(v).cast("double")


def table_stats(df: DataFrame, mean_cols: Sequence[str] = (),
                moment_cols: Sequence[str] = ()) -> Column:
    """Fit every whole-table statistic a chain needs in ONE aggregate pass:
    field `c` = avg(c) for mean_cols, field `z_c` = struct(m, s) (mean, sample
    std) for moment_cols, NaN left out.  Returned as a struct of literals."""
    row = df.agg(
        *[F.avg(nan_to_null(c)).alias(c) for c in mean_cols],
        *[F.avg(nan_to_null(c)).alias(f"m_{c}") for c in moment_cols],
        *[F.stddev_samp(nan_to_null(c)).alias(f"s_{c}") for c in moment_cols],
    ).first()
    return F.struct(
        *[_lit(row[c]).alias(c) for c in mean_cols],
        *[F.struct(_lit(row[f"m_{c}"]).alias("m"), _lit(row[f"s_{c}"]).alias("s")).alias(f"z_{c}")
          for c in moment_cols],
    )


# --- table-level fitted transforms -----------------------------------------

def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5,
               approx_accuracy: int | None = None) -> DataFrame:
    """(feature, q1, q3, lower, upper) per column; exact quartiles unless the
    caller accepts approximate ones (`approx_accuracy`)."""
    q = column_quantiles(df, cols, [0.25, 0.75], ["q1", "q3"], approx_accuracy)
    iqr = F.col("q3") - F.col("q1")
    return q.select("feature", "q1", "q3", (F.col("q1") - k * iqr).alias("lower"),
                    (F.col("q3") + k * iqr).alias("upper"))


def iqr_clip(df: DataFrame, cols: Sequence[str], k: float = 1.5,
             approx_accuracy: int | None = None) -> DataFrame:
    """OUT1: cap every column to [Q1 - k IQR, Q3 + k IQR]; rows kept, NULL kept."""
    if not cols:
        return df
    return clip_with(df, iqr_bounds(df, cols, k, approx_accuracy), cols)


def clip_with(df: DataFrame, bounds_df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Apply fitted (feature, lower, upper) bounds: two numbers per column."""
    bounds = {row["feature"]: (row["lower"], row["upper"]) for row in bounds_df.collect()}
    return df.withColumns({
        c: clip(F.col(c).cast("double"), *[None if v is None else _lit(v) for v in bounds.get(c, (None, None))])
        for c in cols
    })


def zscores(df: DataFrame, cols: Sequence[str], suffix: str = "_zscore",
            fit_on: DataFrame | None = None, stats: Column | None = None) -> DataFrame:
    """STD1: (x - mean) / sample std over the whole table (or `fit_on`);
    zero or undefined spread gives NULL."""
    if stats is None:
        stats = table_stats(fit_on if fit_on is not None else df, moment_cols=cols)
    return df.withColumns({
        f"{c}{suffix}": F.try_divide(nan_to_null(c) - stats[f"z_{c}"]["m"], stats[f"z_{c}"]["s"])
        for c in cols
    })


def bucketize(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str],
              name: str) -> DataFrame:
    """BIN1: right-closed bins (lo, hi]; outside every bin -> NULL."""
    return df.withColumn(name, bucket_right_closed(col, edges, labels))
