"""Shared SQL fragments for the DuckDB oracle texts."""

# Serving log P derived from `events`, same rules as sources.tables.prediction_log.
P_CTE = """P AS (
  SELECT event_id AS id,
         ts,
         CASE WHEN user_id % 2 = 0 THEN 'housing' ELSE 'iris' END AS model_name,
         '/predict/' || CASE WHEN user_id % 2 = 0 THEN 'housing' ELSE 'iris' END AS endpoint,
         props AS request_data,
         CASE WHEN event_type <> 'error' THEN value END AS prediction_double,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS confidence,
         value AS processing_time_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' THEN 'prediction failed' END AS error_message
  FROM events)"""

AS_OF = "(SELECT max(ts) FROM events)"
