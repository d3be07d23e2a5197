"""Table profiling (AGG1-7).

Moments come from one wide aggregate over all columns (partial aggregation,
no row shuffle); exact quartiles come from the rank-based quantile operator,
so no single task ever holds a whole column.  `df.summary()` is not used:
its percentiles are approximate.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import is_missing, nan_to_null
from quarry.operators.quantiles import column_profile, column_quantiles


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """PRJ3: names of numeric columns (boolean excluded)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG1: describe() per numeric column: count, mean, std, min, 25/50/75 %, max."""
    cols = list(cols or numeric_columns(df))
    # one pass over the table: moments and quartiles both come from the
    # frozen (value, count) ranges of every column
    prof = column_profile(df, cols, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    return prof.select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG2 / VAL1: NULL (and NaN for floating columns) count per column, long."""
    cols = list(cols or df.columns)
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    wide = df.agg(*[
        F.count_if(is_missing(c) if c in floating else F.col(c).isNull()).alias(c)
        for c in cols
    ])
    return wide.unpivot([], cols, "column_name", "missing")


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG3: value counts, NULL dropped."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """AGG4: mean, median, std, min, max of the target in one row."""
    t = nan_to_null(F.col(target).cast("double"))
    base = df.agg(
        F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"),
        F.min(t).alias("min"), F.max(t).alias("max"),
    )
    med = column_quantiles(df.select(t.alias("v")), ["v"], [0.5], ["median"])
    return base.select("mean", med.select("median").scalar().alias("median"),
                       "std", "min", "max")


def shape_types(df: DataFrame) -> DataFrame:
    """AGG5: column list with types and ordinal, plus the row count."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "ordinal int, column_name string, data_type string",
    )
    n_rows = df.select(F.count(F.lit(1))).scalar()
    return meta.select("ordinal", "column_name", "data_type", n_rows.alias("n_rows"),
                       F.lit(len(df.columns)).alias("n_columns"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """AGG6: distinct values of one column."""
    return df.select(col).distinct()


def multi_category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG3 for several columns in one pass: (name, label, count)."""
    arr = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("label"))
                    for c in cols])
    return df.select(F.inline(arr)).where(F.col("label").isNotNull()) \
        .groupBy("name", "label").agg(F.count(F.lit(1)).alias("count"))


def profile_report(df: DataFrame, dataset: str, target: str | None = None,
                   categorical: Sequence[str] = ()) -> DataFrame:
    """AGG7: the whole profile bundle as long rows
    (section, name, stat, value, label, dataset) from three passes over the
    table: one wide aggregate (row count, missing counts, moments), one
    exact-quantile pass over every numeric column (the target's median is
    its p50), one grouped count over all categorical columns."""
    spark = df.sparkSession
    num = numeric_columns(df)
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(is_missing(c) if c in floating else F.col(c).isNull()).alias(f"_miss_{i}")
          for i, c in enumerate(df.columns)],
        *[F.struct(F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"),
                   F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                   F.max(v).alias("max")).alias(f"_mom_{i}")
          for i, v in enumerate(nan_to_null(F.col(c).cast("double")) for c in num)],
    )
    none = F.lit(None).cast("string")

    def rec(section, name, stat, value):
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"),
                        F.lit(stat).alias("stat"), value.cast("double").alias("value"),
                        none.alias("label"))

    # every row derived from the one-row aggregate comes out of ONE projection,
    # so the table is scanned once for all of them
    recs = [rec("shape", "table", "rows", F.col("_rows"))]
    recs += [rec("missing", c, "missing", F.col(f"_miss_{i}")) for i, c in enumerate(df.columns)]
    recs += [rec("numeric", c, st, F.col(f"_mom_{i}.{st}"))
             for i, c in enumerate(num) for st in ("count", "mean", "std", "min", "max")]
    has_target = target is not None and target in num
    if has_target:
        ti = num.index(target)
        recs += [rec("target", target, st, F.col(f"_mom_{ti}.{st}"))
                 for st in ("mean", "std", "min", "max")]
    from_wide = wide.select(F.inline(F.array(*recs)))
    q = column_quantiles(df, num, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    qrec = lambda section, stat, col: F.struct(
        F.lit(section).alias("section"), F.col("feature").alias("name"), F.lit(stat).alias("stat"),
        F.col(col).alias("value"), none.alias("label"))
    qrecs = [qrec("numeric", n, n) for n in ("p25", "p50", "p75")]
    if has_target:
        qrecs.append(F.when(F.col("feature") == target, qrec("target", "median", "p50")))
    quart = q.select(F.inline(F.array_compact(F.array(*qrecs))))
    meta = spark.createDataFrame(
        [("columns", f.name, "ordinal", float(i), f.dataType.simpleString())
         for i, f in enumerate(df.schema.fields)],
        "section string, name string, stat string, value double, label string")
    parts = [meta, from_wide, quart]
    if categorical:
        parts.append(multi_category_counts(df, categorical).select(
            F.lit("categories").alias("section"), "name", F.lit("count").alias("stat"),
            F.col("count").cast("double").alias("value"), "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("dataset", F.lit(dataset))
