"""Running totals over an ordered column without a single-task window.

`Window.partitionBy(g).orderBy(v)` sends each group g to one task; for a
feature column with billions of distinct values that is one task holding the
whole column.  The two-level form here keeps every task bounded:

1. range-partition the (already aggregated) rows by (group, value) and tag
   each row with its partition id; the table is checkpointed into the shared
   checkpoint folder so the id is frozen (range bounds come from sampling and
   would differ on recomputation);
2. total the weights per (partition, group): at most #partitions + #groups
   rows;
3. an exclusive prefix over those totals gives each (partition, group) an
   offset;
4. a window partitioned by (partition, group) adds the local running sum.

Input rows must be unique on (group cols, order col): aggregate first.  Rows
whose group is NULL are a group of their own.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.joins import null_safe_join
from quarry.session import freeze

PID = "_range_pid"


def frozen_ranges(df: DataFrame, group_cols: Sequence[str], order_col: str,
                  num_partitions: int | None = None) -> DataFrame:
    """Range-partition by (group, order), tag each row with its partition id
    and freeze the result with a reliable checkpoint (shared folder)."""
    keys = [*[F.col(c) for c in group_cols], F.col(order_col)]
    # without an explicit count the range exchange uses the session's shuffle
    # partitions and AQE may merge small ranges (ids stay in key order)
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    return ranged.withColumn(PID, F.spark_partition_id()).transform(freeze)


def block_offsets(ranged: DataFrame, group_cols: Sequence[str],
                  weight_cols: Sequence[str]) -> DataFrame:
    """(pid, group..., _tot_i, _off_i): weight total of every (partition,
    group) block and the exclusive prefix of the blocks before it — at most
    #partitions + #groups rows."""
    totals = ranged.groupBy(PID, *group_cols).agg(
        *[F.sum(w).alias(f"_tot_{i}") for i, w in enumerate(weight_cols)]
    )
    before = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return totals.select(
        PID, *group_cols, *[f"_tot_{i}" for i in range(len(weight_cols))],
        *[F.coalesce(F.sum(f"_tot_{i}").over(before), F.lit(0)).alias(f"_off_{i}")
          for i in range(len(weight_cols))],
    )


def local_running(blocks_rows: DataFrame, group_cols: Sequence[str], order_col: str,
                  weight_cols: Sequence[str], out_cols: Sequence[str],
                  keep: Sequence[str]) -> DataFrame:
    """offset + running sum inside each (partition, group) block."""
    local = Window.partitionBy(PID, *group_cols).orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return blocks_rows.select(
        *keep,
        *[(F.col(f"_off_{i}") + F.sum(w).over(local)).alias(o)
          for i, (w, o) in enumerate(zip(weight_cols, out_cols))],
    )


def running_totals(
    df: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    weight_cols: Sequence[str],
    out_cols: Sequence[str],
    num_partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums `out_cols[i]` of `weight_cols[i]` ordered by
    `order_col` within `group_cols`."""
    group_cols = list(group_cols)
    ranged = frozen_ranges(df, group_cols, order_col, num_partitions)
    offsets = block_offsets(ranged, group_cols, weight_cols).drop(
        *[f"_tot_{i}" for i in range(len(weight_cols))])
    joined = null_safe_join(ranged, offsets, [PID, *group_cols])
    return local_running(joined, group_cols, order_col, weight_cols, out_cols, df.columns)
