"""Analytics over the serving log (one row per scored request).

Every statistic is a single aggregate pass (`count_if`, conditional `avg`),
so one scan answers what the reference asked with three queries.  The
trailing window is `ts > as_of - hours`; `as_of` defaults to the newest log
row, taken as a scalar subquery so the plan stays lazy and the bound is
pushed to the scan as a runtime filter.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import as_wall_clock


def as_of_value(log: DataFrame, as_of=None, ts_col: str = "ts", resolve: bool = True) -> Column:
    """`as_of` literal if given, otherwise the newest ts of the log.

    With `resolve` the newest ts is fetched first (one aggregate over the ts
    column, one number back) and used as a literal: time predicates built on
    it then reach the parquet scan (row-group skipping) and the event_date
    partition filter prunes statically.  Without it, a lazy scalar subquery
    is used (evaluated at run time, not pushed down)."""
    if as_of is None:
        if resolve:
            micros = log.select(F.unix_micros(F.max(ts_col))).first()[0]
            if micros is not None:
                return F.timestamp_micros(F.lit(micros))
        return log.select(F.max(ts_col)).scalar()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.lit(as_of).cast("timestamp")
    if isinstance(as_of, _dt.datetime):
        return F.lit(as_of)
    raise TypeError("as_of must be None, str, datetime or Column")


def trailing(log: DataFrame, hours: float = 24, as_of=None, ts_col: str = "ts") -> DataFrame:
    """Rows with ts in (as_of - hours, as_of].  A log stored partitioned by
    `event_date` also gets a partition predicate, so only the days inside the
    window are listed and read."""
    end = as_of_value(log, as_of, ts_col)
    bound = end - F.make_interval(secs=F.lit(float(hours) * 3600.0))
    out = log.where((F.col(ts_col) > bound) & (F.col(ts_col) <= end))
    if "event_date" in log.columns:
        out = out.where(F.col("event_date") >= F.to_date(bound))
    return out


def _stats_columns() -> list[Column]:
    ok = F.col("status") == "success"
    total = F.count(F.lit(1))
    success = F.count_if(ok)
    err = F.when(total > 0, (total - success) * 100.0 / total).otherwise(F.lit(0.0))
    avg_ms = F.coalesce(F.avg(F.when(ok, F.col("processing_time_ms"))), F.lit(0.0))
    return [
        total.alias("total_predictions"),
        success.alias("successful_predictions"),
        F.round(err, 2).alias("error_rate_percent"),
        F.round(avg_ms, 2).alias("avg_processing_time_ms"),
    ]


def prediction_stats(log: DataFrame, model_name: str | None = None, hours: float = 24,
                     as_of=None) -> DataFrame:
    """LOG1: one row of trailing-window statistics, optional model filter."""
    w = trailing(log, hours, as_of)
    if model_name is not None:
        w = w.where(F.col("model_name") == model_name)
    return w.agg(*_stats_columns()).withColumn("time_window_hours", F.lit(float(hours)))


def prediction_stats_rollup(log: DataFrame, hours: float = 24, as_of=None) -> DataFrame:
    """LOG2: overall row plus one row per model from a single ROLLUP pass."""
    w = trailing(log, hours, as_of)
    return (
        w.rollup("model_name")
        .agg(F.grouping_id().alias("grouping_level"), *_stats_columns())
        .withColumn("scope", F.when(F.col("grouping_level") == 1, F.lit("overall"))
                    .otherwise(F.lit("model")))
    )


def recent_predictions(log: DataFrame, limit: int = 10) -> DataFrame:
    """LOG3: newest N rows (TakeOrderedAndProject; id breaks timestamp ties)."""
    return (
        log.orderBy(F.col("ts").desc(), F.col("id").desc())
        .limit(limit)
        .select(
            "id",
            as_wall_clock("ts").alias("ts"),
            "model_name",
            F.round(F.col("prediction_value").try_cast("double"), 4).alias("prediction"),
            F.round("confidence", 4).alias("confidence"),
            F.round("processing_time_ms", 4).alias("processing_time_ms"),
            "status",
        )
    )


def metric_fanout(log: DataFrame) -> DataFrame:
    """LOG6: every logged request emits processing_time_ms and request_count
    metric rows, plus error_count on failure (long metric table)."""
    err = F.col("status") == "error"
    rows = F.array_compact(F.array(
        F.struct(F.lit("processing_time_ms").alias("metric_name"),
                 F.col("processing_time_ms").alias("metric_value")),
        F.struct(F.lit("request_count").alias("metric_name"),
                 F.lit(1.0).alias("metric_value")),
        F.when(err, F.struct(F.lit("error_count").alias("metric_name"),
                             F.lit(1.0).alias("metric_value"))),
    ))
    return (
        log.select("id", "ts", "model_name", F.explode(rows).alias("m"))
        .select(F.col("id").alias("request_id"), "ts", "m.metric_name", "m.metric_value",
                "model_name")
    )


def metric_window_avg(metrics: DataFrame, metric_name: str | None = None, hours: float = 24,
                      as_of=None) -> DataFrame:
    """LOG4: metric name -> rounded average and count in a trailing window."""
    w = trailing(metrics, hours, as_of)
    if metric_name is not None:
        w = w.where(F.col("metric_name") == metric_name)
    return w.groupBy("metric_name").agg(
        F.round(F.avg("metric_value"), 2).alias("average"),
        F.count(F.lit(1)).alias("count"),
    )


def model_totals(log: DataFrame) -> DataFrame:
    """LOG5: all-time count and average latency per model (every status)."""
    return log.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("processing_time_ms"), 2).alias("avg_processing_time_ms"),
    )


def request_outcomes(requests: DataFrame) -> DataFrame:
    """LOG7: outcome row for each request event (start, end, error text).

    elapsed ms = (end - start) * 1000, status from presence of an error, the
    response is empty on error.
    """
    elapsed = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000.0
    failed = F.col("error").isNotNull()
    return requests.select(
        "request_id",
        "model_name",
        F.round(elapsed, 3).alias("processing_time_ms"),
        F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.col("error").alias("error_message"),
        F.when(failed, F.lit("{}")).otherwise(F.col("response")).alias("response_data"),
    )


def request_events(log: DataFrame) -> DataFrame:
    """Request start/end events implied by the log: end = ts + ms."""
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("processing_time_ms") * 1000).cast("long"))
    return log.select(
        F.col("id").alias("request_id"),
        "model_name",
        F.col("ts").alias("start_ts"),
        end.alias("end_ts"),
        F.col("error_message").alias("error"),
        F.col("response_data").alias("response"),
    )


def request_json_fields(log: DataFrame) -> DataFrame:
    """JSN1: pull fields back out of the JSON request/response text."""
    return log.select(
        "id",
        F.get_json_object("request_data", "$.k").cast("long").alias("request_k"),
        F.round(F.get_json_object("response_data", "$.prediction").cast("double"), 4)
        .alias("prediction"),
        F.round(F.get_json_object("response_data", "$.confidence").cast("double"), 4)
        .alias("confidence"),
    )


def encode_json(df: DataFrame, cols: list[str], name: str = "json") -> DataFrame:
    """JSN1 (encode side): a record's columns as one JSON text column."""
    return df.withColumn(name, F.to_json(F.struct(*cols)))
