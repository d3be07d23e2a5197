"""Exact quantiles (linear interpolation, the pandas / `percentile` /
`quantile_cont` definition) computed from ranks, never from one task holding
a whole column.

Rows are first reduced to (key, value, count) — a value that holds a third of
the table becomes one row — and range-partitioned by (key, value) into frozen
blocks (see prefix.py).  Block totals give every block its rank interval, so
a requested rank k is located in its block from a table of #blocks rows; only
the blocks that hold a requested rank are read again and ranked inside (a
selection, not a full prefix sum over the data).

Columns of a wide table (`column_quantiles`, `column_profile`) need not be
ranked whole: a mergeable sketch of every column brackets each requested rank
between two values a few ten-thousandths of the rows apart, one aggregate
counts the rows below each bracket, and only the values inside the brackets
are ranked.  A bracket that the counts show to miss a rank it needs (columns of
few values) is widened and counted again.  The table is scanned three times,
twice more for each widening, and never exploded or written.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.joins import null_safe_join
from quarry.functions.numeric import nan_to_null
from quarry.operators.prefix import PID, block_offsets, frozen_ranges, local_running


def exact_quantiles(
    long_df: DataFrame,
    key_cols: Sequence[str],
    value_col: str,
    probs: Sequence[float],
) -> DataFrame:
    """(key..., p, q) for every key and every p in `probs`; NULL values are
    ignored, a key with no values gets no rows."""
    key_cols = list(key_cols)
    if not key_cols:  # one global key keeps the rank join an equi-join
        return exact_quantiles(long_df.withColumn("_all", F.lit(0)), ["_all"], value_col,
                               probs).drop("_all")
    return quantiles_from_ranges(value_ranges(long_df, key_cols, value_col), key_cols, probs)


def value_ranges(long_df: DataFrame, key_cols: Sequence[str], value_col: str) -> DataFrame:
    """(key..., _v, _cnt, pid): distinct values with their counts, range
    partitioned and frozen — the shared input of exact quantiles and exact
    moments."""
    v = F.col(value_col).cast("double")
    counts = (
        long_df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*key_cols, v.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    return frozen_ranges(counts, list(key_cols), "_v")


def quantiles_from_ranges(ranged: DataFrame, key_cols: Sequence[str],
                          probs: Sequence[float]) -> DataFrame:
    key_cols = list(key_cols)
    sizes = block_offsets(ranged, key_cols, ["_cnt"]).groupBy(*key_cols).agg(
        F.sum("_tot_0").alias("_n"))
    targets = (
        sizes.select(*key_cols, "_n",
                     F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
        .withColumn("_h", (F.col("_n") - 1) * F.col("p"))
        .withColumn("_klo", F.floor("_h"))
        .withColumn("_khi", F.ceil("_h"))
    )
    return values_at_ranks(ranged, key_cols, targets)


def values_at_ranks(ranged: DataFrame, key_cols: Sequence[str], targets: DataFrame) -> DataFrame:
    """(key..., p, q): the value at rank _h (from 0) of each target (key..., p,
    _h, _klo, _khi), between its neighbours _klo and _khi."""
    key_cols = list(key_cols)
    blocks = block_offsets(ranged, key_cols, ["_cnt"])          # #blocks rows
    # blocks whose rank interval [off, off + tot) holds a requested rank
    inside = lambda k: (F.col("_off_0") <= F.col(k)) & (
        F.col(k) < F.col("_off_0") + F.col("_tot_0"))
    hit_blocks = null_safe_join(blocks, targets.select(*key_cols, "_klo", "_khi"), key_cols).where(
        inside("_klo") | inside("_khi")).select(PID, *key_cols, "_off_0").distinct()
    cum = local_running(null_safe_join(ranged, hit_blocks, [PID, *key_cols]), key_cols, "_v", ["_cnt"],
                        ["_cum"], [*key_cols, "_v", "_cnt"])
    lo_start = F.col("_cum") - F.col("_cnt")
    hits = null_safe_join(cum, targets, key_cols).where(
        (lo_start <= F.col("_khi")) & (F.col("_klo") < F.col("_cum"))
    )
    covers = lambda k: (lo_start <= F.col(k)) & (F.col(k) < F.col("_cum"))
    picked = hits.groupBy(*key_cols, "p", "_h", "_klo").agg(
        F.min(F.when(covers("_klo"), F.col("_v"))).alias("_vlo"),
        F.min(F.when(covers("_khi"), F.col("_v"))).alias("_vhi"),
    )
    frac = F.col("_h") - F.col("_klo")
    return picked.select(
        *key_cols, "p",
        (F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))).alias("q"),
    )


def quantiles_wide(long_df: DataFrame, key_cols: Sequence[str], value_col: str,
                   probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Same as `exact_quantiles`, one column per probability."""
    q = exact_quantiles(long_df, key_cols, value_col, probs)
    return q.groupBy(*key_cols).agg(
        *[F.first(F.when(F.col("p") == float(p), F.col("q")), ignorenulls=True).alias(n)
          for p, n in zip(probs, names)]
    )


def unpivot_numeric(df: DataFrame, cols: Sequence[str], key: str = "feature",
                    value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Long (feature, value) form of numeric columns, cast to double."""
    cast = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return cast.unpivot(list(keep), list(cols), key, value)


def unpivot_ids(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long (fid, value) form with a small integer feature id instead of the
    name: hashing and shuffling an int key is cheaper than a string key
    for every one of the rows x columns long rows."""
    arr = F.array(*[F.struct(F.lit(i).alias("fid"), F.col(c).cast("double").alias("value"))
                    for i, c in enumerate(cols)])
    return df.select(*keep, F.inline(arr))


def feature_name(fid: Column | str, cols: Sequence[str]) -> Column:
    fid = F.col(fid) if isinstance(fid, str) else fid
    return F.element_at(F.array(*[F.lit(c) for c in cols]), fid + 1)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     names: Sequence[str], approx_accuracy: int | None = None) -> DataFrame:
    """(feature, <one column per probability>) for numeric columns.

    Exact by default.  A caller that accepts a rank error of n / accuracy can
    pass `approx_accuracy`: then one wide `percentile_approx` aggregate (a
    bounded sketch per column, merged map-side) answers in a single pass."""
    if approx_accuracy:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(map(float, probs)),
                                           approx_accuracy).alias(f"_q{i}")
                       for i, c in enumerate(cols)])
        recs = [F.struct(F.lit(c).alias("feature"),
                         *[F.col(f"_q{i}")[j].alias(n) for j, n in enumerate(names)])
                for i, c in enumerate(cols)]
        return row.select(F.inline(F.array(*recs)))
    q = _wide(_bracketed(df, cols, probs), ["fid"], probs, names)
    return q.select(feature_name("fid", cols).alias("feature"), *names)


#: Sketch accuracy of the brackets: rows / ACCURACY bounds a sketch's rank error.
ACCURACY = 10_000


def _brackets(df: DataFrame, v: Sequence[Column], probs: Sequence[float]) -> list[tuple]:
    """(column, prob, key, low, high, values, values below low) of each
    quantile: low to high hold the two values it lies between.  A bracket that
    the counts show to miss one is widened, by two ranks at least."""
    reach = {(i, j): 2 / ACCURACY for i in range(len(v)) for j in range(len(probs))}
    held: dict[tuple[int, int], tuple] = {}
    while reach:
        ends = {i: [(j, min(1.0, max(0.0, probs[j] + s * d))) for (c, j), d in reach.items()
                    if c == i for s in (-1, 1)] for i, _ in reach}
        told = df.agg(*[F.count(v[i]).alias(f"n{i}") for i in ends],
                      *[F.percentile_approx(v[i], [e for _, e in x], ACCURACY).alias(f"q{i}")
                        for i, x in ends.items()]).first()
        spans = [(i, x[k][0], told[f"q{i}"][k], told[f"q{i}"][k + 1])
                 for i, x in ends.items() if told[f"n{i}"] for k in range(0, len(x), 2)]
        if not spans:
            break
        at = df.agg(*[F.count_if(v[i] < F.lit(lo)).alias(f"b{i}_{j}") for i, j, lo, _ in spans],
                    *[F.count_if(v[i] <= F.lit(hi)).alias(f"u{i}_{j}")
                      for i, j, _, hi in spans]).first()
        wider = {}
        for i, j, lo, hi in spans:
            n, below, upto, d = told[f"n{i}"], at[f"b{i}_{j}"], at[f"u{i}_{j}"], reach[i, j]
            h = (n - 1) * probs[j]
            if d >= 1 or (below <= math.floor(h) and math.ceil(h) < upto):
                held[i, j] = (lo, hi, n, below)
            else:
                wider[i, j] = max(2 * d, 2 / n)
        reach = wider
    return [(i, j, k, *held[i, j]) for k, (i, j) in enumerate(sorted(held))]


def _bracketed(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(fid, p, q): exact quantiles of wide columns by bracket selection."""
    spark = df.sparkSession
    v = [nan_to_null(F.col(c).cast("double")) for c in cols]
    kept = _brackets(df, v, probs)
    schema = "fid int, p double, q double"
    if not kept:
        return spark.createDataFrame([], schema)
    inside = F.array_compact(F.array(*[
        F.when((v[i] >= F.lit(lo)) & (v[i] <= F.lit(hi)),
               F.struct(F.lit(k).alias("kid"), v[i].alias("value")))
        for i, _, k, lo, hi, _, _ in kept]))
    ranged = value_ranges(df.select(F.inline(inside)), ["kid"], "value")
    targets = []
    for i, j, k, _, _, n, below in kept:
        h = (n - 1) * probs[j]
        targets.append((k, i, float(probs[j]), h - below, math.floor(h) - below,
                        math.ceil(h) - below))
    wanted = spark.createDataFrame(targets, "kid int, fid int, p double, _h double, _klo long, "
                                            "_khi long")
    got = values_at_ranks(ranged, ["kid"], wanted.drop("fid"))
    return got.join(wanted.select("kid", "fid"), "kid").select("fid", "p", "q")


def _wide(q: DataFrame, key_cols: Sequence[str], probs: Sequence[float],
          names: Sequence[str]) -> DataFrame:
    return q.groupBy(*key_cols).agg(
        *[F.first(F.when(F.col("p") == float(p), F.col("q")), ignorenulls=True).alias(n)
          for p, n in zip(probs, names)])


def column_profile(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   names: Sequence[str]) -> DataFrame:
    """(feature, count, mean, std, min, max, <quantiles>) for numeric columns:
    the moments are one wide aggregate, the quantiles bracket selection."""
    def moments(i: int, c: str) -> Column:
        x = nan_to_null(F.col(c).cast("double"))
        return F.struct(F.lit(i).alias("fid"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                        F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                        F.max(x).alias("max")).alias(f"_m{i}")

    wide = df.agg(*[moments(i, c) for i, c in enumerate(cols)])
    rows = wide.select(F.inline(F.array(*[F.col(f"_m{i}") for i in range(len(cols))])))
    q = _wide(_bracketed(df, cols, probs), ["fid"], probs, names)
    return rows.where("count > 0").join(q, "fid").select(
        feature_name("fid", cols).alias("feature"), "count", "mean", "std", "min", "max", *names)
