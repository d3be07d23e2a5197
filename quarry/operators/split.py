"""Reproducible splits (SPL1-2) decided by a hash of (seed, key).

A row's side depends only on its key and the seed, never on partitioning or
row order, so reruns with any partition count give the same rows (unlike
`randomSplit`).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.joins import null_safe_join
from quarry.operators.prefix import running_totals


def key_hash(key: str, seed: int) -> Column:
    """md5 of 'seed:key' as lowercase hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def hash_unit(key: str, seed: int) -> Column:
    """First 32 bits of the key hash as an integer in [0, 2^32)."""
    return F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """SPL1: adds boolean `is_test`; expected test share = test_size."""
    return df.withColumn("is_test", hash_unit(key, seed) < F.lit(int(test_size * 2 ** 32)))


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """SPL2: exact quota per stratum: the round(test_size * n_label) rows with
    the smallest key hash in each label go to test.  Rows without a label are
    a stratum of their own.

    Ranks come from the two-level prefix count, so a stratum holding a third
    of the table is still spread over many tasks.
    """
    h = df.withColumn("_h", F.concat(
        key_hash(key, seed), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    ranked = running_totals(h.withColumn("_one", F.lit(1)), [label], "_h", ["_one"], ["_rank"])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    quota = F.round(F.col("_n") * F.lit(float(test_size))).cast("long")
    return (
        null_safe_join(ranked, sizes, [label])
        .withColumn("is_test", F.col("_rank") <= quota)
        .drop("_h", "_one", "_rank", "_n")
    )
