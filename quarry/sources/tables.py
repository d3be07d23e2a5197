"""Loaders for the parquet tables and the stand-in views built from them.

Timestamps in the provided parquet files load as TIMESTAMP_NTZ; event-time
operators (watermarks, unix_seconds, window) need TIMESTAMP, so every NTZ
column is cast at read.  Output columns that carry time are cast back to NTZ
(`as_wall_clock`) so results compare equal to wall-clock readers.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_utc

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    ensure_utc(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    casts = {
        f.name: F.col(f.name).cast("timestamp")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def as_wall_clock(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# Stand-in tables
# ---------------------------------------------------------------------------

def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving log P (one row per scored request) derived from `events`.

    Columns: id, ts, model_name, endpoint, method, request_data,
    response_data, prediction_value, confidence, processing_time_ms, status,
    error_message, event_date.
    """
    ev = read_table(spark, sf_dir, "events")
    return prediction_log_from_events(ev)


def prediction_log_from_events(ev: DataFrame) -> DataFrame:
    model = F.when(F.col("user_id") % 2 == 0, F.lit("housing")).otherwise(F.lit("iris"))
    ok = F.col("event_type") != "error"
    k = F.get_json_object("props", "$.k").cast("double")
    conf = k / 100.0
    response = F.when(
        ok, F.to_json(F.struct(F.col("value").alias("prediction"), conf.alias("confidence")))
    ).otherwise(F.lit(None).cast("string"))
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        model.alias("model_name"),
        F.concat(F.lit("/predict/"), model).alias("endpoint"),
        F.lit("POST").alias("method"),
        F.col("props").alias("request_data"),
        response.alias("response_data"),
        F.when(ok, F.col("value").cast("string")).alias("prediction_value"),
        conf.alias("confidence"),
        F.col("value").alias("processing_time_ms"),
        F.when(ok, F.lit("success")).otherwise(F.lit("error")).alias("status"),
        F.when(~ok, F.lit("prediction failed")).alias("error_message"),
        F.to_date("ts").alias("event_date"),
    )


def regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression table H: lineitem, target l_extendedprice."""
    return read_table(spark, sf_dir, "lineitem")


def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class table C: embeddings (vec_id, embedding array<float>, label 0..9)."""
    return read_table(spark, sf_dir, "embeddings")
