"""Serving-log queries (LOG1-7, JSN1) over the stand-in log P."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import servelog as S
from quarry.plans.catalog import register
from quarry.plans.sqlparts import AS_OF, P_CTE
from quarry.sources.tables import prediction_log

_STATS_SQL = """count(*) AS total_predictions,
       count(*) FILTER (WHERE status = 'success') AS successful_predictions,
       round(CASE WHEN count(*) > 0
                  THEN (count(*) - count(*) FILTER (WHERE status = 'success')) * 100.0 / count(*)
                  ELSE 0.0 END, 2) AS error_rate_percent,
       round(coalesce(avg(CASE WHEN status = 'success' THEN processing_time_ms END), 0.0), 2)
         AS avg_processing_time_ms"""


@register("serving_stats", f"""
WITH {P_CTE}
SELECT {_STATS_SQL}, CAST(24.0 AS DOUBLE) AS time_window_hours
FROM P WHERE ts > {AS_OF} - INTERVAL 24 HOURS""")
def serving_stats(spark, sf_dir):
    return S.prediction_stats(prediction_log(spark, sf_dir), hours=24)


@register("serving_stats_model", f"""
WITH {P_CTE}
SELECT {_STATS_SQL}, CAST(6.0 AS DOUBLE) AS time_window_hours
FROM P WHERE ts > {AS_OF} - INTERVAL 6 HOURS AND model_name = 'iris'""")
def serving_stats_model(spark, sf_dir):
    return S.prediction_stats(prediction_log(spark, sf_dir), model_name="iris", hours=6)


@register("serving_stats_rollup", f"""
WITH {P_CTE}
SELECT model_name, CAST(grouping(model_name) AS BIGINT) AS grouping_level, {_STATS_SQL},
       CASE WHEN grouping(model_name) = 1 THEN 'overall' ELSE 'model' END AS scope
FROM P WHERE ts > {AS_OF} - INTERVAL 24 HOURS
GROUP BY ROLLUP (model_name)""")
def serving_stats_rollup(spark, sf_dir):
    return S.prediction_stats_rollup(prediction_log(spark, sf_dir), hours=24)


@register("recent_predictions", f"""
WITH {P_CTE}
SELECT id, ts, model_name, round(prediction_double, 4) AS prediction,
       round(confidence, 4) AS confidence, round(processing_time_ms, 4) AS processing_time_ms,
       status
FROM P ORDER BY ts DESC, id DESC LIMIT 10""")
def recent_predictions(spark, sf_dir):
    return S.recent_predictions(prediction_log(spark, sf_dir), limit=10)


_FANOUT_SQL = f"""WITH {P_CTE},
M AS (
  SELECT id AS request_id, ts, 'processing_time_ms' AS metric_name,
         processing_time_ms AS metric_value, model_name FROM P
  UNION ALL
  SELECT id, ts, 'request_count', 1.0, model_name FROM P
  UNION ALL
  SELECT id, ts, 'error_count', 1.0, model_name FROM P WHERE status = 'error')"""


@register("metric_fanout", _FANOUT_SQL + """
SELECT request_id, ts, metric_name, round(metric_value, 4) AS metric_value, model_name FROM M""")
def metric_fanout(spark, sf_dir):
    m = S.metric_fanout(prediction_log(spark, sf_dir))
    return m.select("request_id", S.as_wall_clock("ts").alias("ts"), "metric_name",
                    F.round("metric_value", 4).alias("metric_value"), "model_name")


@register("metric_window_avg", _FANOUT_SQL + f"""
SELECT metric_name, round(avg(metric_value), 2) AS average, count(*) AS count
FROM M WHERE ts > {AS_OF} - INTERVAL 24 HOURS
GROUP BY metric_name""")
def metric_window_avg(spark, sf_dir):
    m = S.metric_fanout(prediction_log(spark, sf_dir))
    return S.metric_window_avg(m, hours=24)


@register("model_totals", f"""
WITH {P_CTE}
SELECT model_name, count(*) AS total, round(avg(processing_time_ms), 2) AS avg_processing_time_ms
FROM P GROUP BY model_name""")
def model_totals(spark, sf_dir):
    return S.model_totals(prediction_log(spark, sf_dir))


@register("request_outcomes", f"""
WITH {P_CTE}
SELECT id AS request_id, model_name,
       round((epoch_us(ts + to_microseconds(CAST(trunc(processing_time_ms * 1000) AS BIGINT)))
              - epoch_us(ts)) / 1000.0, 3) AS processing_time_ms,
       status, error_message,
       CASE WHEN status = 'error' THEN '{{}}' ELSE 'ok' END AS response_data
FROM P""")
def request_outcomes(spark, sf_dir):
    ev = S.request_events(prediction_log(spark, sf_dir))
    out = S.request_outcomes(ev)
    # the response JSON text is engine-formatted; compare its presence only
    return out.withColumn(
        "response_data",
        F.when(F.col("response_data") == "{}", F.lit("{}")).otherwise(F.lit("ok")),
    )


@register("request_json_fields", f"""
WITH {P_CTE}
SELECT id, CAST(json_extract_string(request_data, '$.k') AS BIGINT) AS request_k,
       round(prediction_double, 4) AS prediction,
       CASE WHEN status = 'success' THEN round(confidence, 4) END AS confidence
FROM P""")
def request_json_fields(spark, sf_dir):
    return S.request_json_fields(prediction_log(spark, sf_dir))
