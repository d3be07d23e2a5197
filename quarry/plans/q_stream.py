"""Streaming queries (STR1-7): each runs a Structured Streaming job with
`Trigger.AvailableNow` over event files staged from the `events` table, then
reads the sink back.  Oracles are the batch twins (closed windows only).

Staging the files is the test harness only: in production the stream reads
the folder the serving log lands in, and the sinks are the shared tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.functions.numeric import r
from quarry.operators import rangeq as RQ
from quarry.operators import train as TR
from quarry.operators.series import DEFAULT_BUCKETS
from quarry.plans.catalog import register
from quarry.plans.sqlparts import P_CTE
from quarry.session import scratch_path
from quarry.sources.tables import prediction_log, read_table
from quarry.streaming import streams as ST


def _staged(spark, sf_dir, copies: int = 1):
    base = scratch_path(spark, "stream")
    ev = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for _ in range(copies):  # at-least-once delivery: the same files again
        n = ST.stage_event_days(ev, f"{base}/files")
    # several micro-batches a run: state and watermark are carried between them
    return base, ST.event_stream(spark, f"{base}/files", files_per_batch=n)


def _closed(df, spark, sf_dir, end_col="window_end"):
    as_of = read_table(spark, sf_dir, "events").select(F.max("ts")).scalar()
    return df.where(F.col(end_col).cast("timestamp") <= as_of - F.expr("INTERVAL 10 MINUTES"))


_WINDOWS_SQL = f"""WITH {P_CTE},
W AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS window_start, P.*
      FROM P, range(0, 5) t(k))"""


def _sliding_sql() -> str:
    buckets = ", ".join(f"count(*) FILTER (WHERE processing_time_ms / 1000.0 <= {float(b)!r}) AS b{i}"
                        for i, b in enumerate(DEFAULT_BUCKETS))
    return f"""{_WINDOWS_SQL}
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, model_name, count(*) AS n,
       count(*) FILTER (WHERE status = 'error') AS errors,
       round(count(*) FILTER (WHERE status = 'error') / count(*), 6) AS error_share,
       round(avg(processing_time_ms), 6) AS avg_ms, {buckets}
FROM W GROUP BY window_start, model_name
HAVING window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


@register("stream_rate_5m", _sliding_sql())
def stream_rate_5m(spark, sf_dir):
    """STR2 + STR3: sliding 5-minute windows every minute per model."""
    base, s = _staged(spark, sf_dir)
    ST.run_available_now(ST.sliding_stats(ST.log_stream(s)), f"{base}/out", f"{base}/ck")
    out = spark.read.parquet(f"{base}/out")
    out = _closed(out, spark, sf_dir)
    return out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "model_name", "n",
        "errors", r("error_share", 6).alias("error_share"), r("avg_ms", 6).alias("avg_ms"),
        *[f"b{i}" for i in range(len(DEFAULT_BUCKETS))])


def _stream_quantile_sql() -> str:
    from quarry.plans.q_series import hq_sql_from
    buckets = ", ".join(f"count(*) FILTER (WHERE processing_time_ms / 1000.0 <= {float(b)!r}) AS b{i}"
                        for i, b in enumerate(DEFAULT_BUCKETS))
    prefix = f"""{_WINDOWS_SQL},
W AS (SELECT model_name, window_start AS bin, {buckets}, count(*) AS b_inf FROM W0
      GROUP BY window_start, model_name
      HAVING window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""
    sql = hq_sql_from(prefix.replace("W AS (SELECT time_bucket", "W0 AS (SELECT time_bucket"),
                      "a.bin + INTERVAL 5 MINUTE")
    return sql.replace("SELECT a.model_name, a.bin,", "SELECT a.model_name, a.bin AS window_start,")\
              .replace(" AS step_ts,", " AS window_end,")


@register("stream_window_quantiles", _stream_quantile_sql())
def stream_window_quantiles(spark, sf_dir):
    """STR3: p50 / p95 latency per sliding window, from the bucket counts the
    windowed stream aggregated (quantiles computed downstream of the sink)."""
    base, s = _staged(spark, sf_dir)
    ST.run_available_now(ST.sliding_stats(ST.log_stream(s)), f"{base}/out", f"{base}/ck")
    wide = _closed(spark.read.parquet(f"{base}/out"), spark, sf_dir).withColumn("b_inf", F.col("n"))
    q = RQ.histogram_quantile(wide, ["model_name"], [0.5, 0.95], names=["p50", "p95"],
                              keep=["window_start", "window_end"])
    return q.select("model_name", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                    r("p50", 6).alias("p50"), r("p95", 6).alias("p95"))


@register("stream_counters", f"""WITH {P_CTE},
T AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS window_start, model_name, status FROM P)
SELECT window_start, model_name, status, count(*) AS n FROM T
WHERE window_start + INTERVAL 10 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
GROUP BY window_start, model_name, status""")
def stream_counters(spark, sf_dir):
    """STR5: tumbling 10-second counter snapshots."""
    base, s = _staged(spark, sf_dir)
    ST.run_available_now(ST.tumbling_counts(ST.log_stream(s)), f"{base}/out", f"{base}/ck")
    out = spark.read.parquet(f"{base}/out").withColumn(
        "window_end", F.col("window_start") + F.expr("INTERVAL 10 SECONDS"))
    out = _closed(out, spark, sf_dir)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      "model_name", "status", "n")


_END_TS = "(ts + to_microseconds(CAST(trunc(processing_time_ms * 1000) AS BIGINT)))"


@register("stream_pairs", f"""WITH {P_CTE}
SELECT id AS request_id, ts AS start_ts, {_END_TS} AS end_ts,
       round((epoch_us({_END_TS}) - epoch_us(ts)) / 1e6, 6) AS duration_s
FROM P WHERE status = 'success'""")
def stream_pairs(spark, sf_dir):
    """STR4: start and end event streams joined by request id within an
    event-time bound (errors never end, their starts expire)."""
    base, s = _staged(spark, sf_dir)
    log = ST.log_stream(s, watermark=False)
    starts = log.select(F.col("id").alias("request_id"), "ts")
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("processing_time_ms") * 1000).cast("long"))
    ends = log.where(F.col("status") == "success").select(F.col("id").alias("request_id"),
                                                          end.alias("ts"))
    ST.run_available_now(ST.pair_stream(starts, ends), f"{base}/out", f"{base}/ck")
    out = spark.read.parquet(f"{base}/out")
    return out.select("request_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"),
                      F.col("end_ts").cast("timestamp_ntz").alias("end_ts"),
                      r("duration_s", 6).alias("duration_s"))


@register("stream_pairs_expiry", f"""WITH {P_CTE}
SELECT id AS request_id, ts AS start_ts, {_END_TS} AS end_ts,
       round((epoch_us({_END_TS}) - epoch_us(ts)) / 1e6, 6) AS duration_s, 'closed' AS state
FROM P WHERE status = 'success'
UNION ALL
SELECT id, ts, NULL, NULL, 'expired' FROM P
WHERE status = 'error'
  AND ts + INTERVAL 60 SECOND < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_pairs_expiry(spark, sf_dir):
    """STR4 (stateful form): errors never send an end event, so their starts
    expire one minute (event time) after they began, once the watermark has
    passed that point; starts still waiting at the end stay in state."""
    base, s = _staged(spark, sf_dir)
    log = ST.log_stream(s, watermark=False)
    starts = log.select(F.col("id").alias("request_id"), "ts")
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("processing_time_ms") * 1000).cast("long"))
    ends = log.where(F.col("status") == "success").select(F.col("id").alias("request_id"),
                                                          end.alias("ts"))
    ST.run_available_now(ST.pair_with_expiry(starts, ends), f"{base}/out", f"{base}/ck")
    out = spark.read.parquet(f"{base}/out")
    return out.select("request_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"),
                      F.col("end_ts").cast("timestamp_ntz").alias("end_ts"),
                      r("duration_s", 6).alias("duration_s"), "state")


LOG_RULES = [R.bounds("processing_time_ms", gt=0, le=300),
             R.bounds("confidence", ge=0.0, le=1.0, required=False)]


@register("stream_ingest", f"""WITH {P_CTE}
SELECT id, CASE WHEN processing_time_ms IS NULL OR isnan(processing_time_ms)
                     OR NOT (processing_time_ms > 0 AND processing_time_ms <= 300)
                THEN 'quarantine' ELSE 'valid' END AS route
FROM P""")
def stream_ingest(spark, sf_dir):
    """STR1: rule check per micro-batch, valid rows and quarantined rows
    written to two tables."""
    base, s = _staged(spark, sf_dir)
    ST.ingest(ST.log_stream(s), LOG_RULES, f"{base}/valid", f"{base}/quarantine", f"{base}/ck")
    ok = spark.read.parquet(f"{base}/valid").select("id", F.lit("valid").alias("route"))
    bad = spark.read.parquet(f"{base}/quarantine").select("id", F.lit("quarantine").alias("route"))
    return ok.unionByName(bad)


@register("stream_dedupe", "SELECT event_id AS id, ts FROM events")
def stream_dedupe(spark, sf_dir):
    """STR7: every file delivered twice; duplicates dropped within the
    watermark."""
    base, s = _staged(spark, sf_dir, copies=2)
    d = ST.dedupe(ST.log_stream(s)).select("id", "ts")
    ST.run_available_now(d, f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out").select(
        "id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("stream_score", f"""WITH {P_CTE}
SELECT id, round(regr_intercept(processing_time_ms, confidence) OVER ()
                 + regr_slope(processing_time_ms, confidence) OVER () * confidence, 4) AS prediction
FROM P""")
def stream_score(spark, sf_dir):
    """STR6: a pipeline fitted on the batch log scores the log stream."""
    model = TR.linear_regression("processing_time_ms", ["confidence"]).fit(
        prediction_log(spark, sf_dir))
    base, s = _staged(spark, sf_dir)
    scored = ST.score_stream(model, ST.log_stream(s)).select("id", "prediction")
    ST.run_available_now(scored, f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out").select("id", r("prediction", 4).alias("prediction"))


def _two_runs(spark, sf_dir, make):
    """The stream over the first half of the days, then, from its checkpoint,
    over the rest; several micro-batches each."""
    base = scratch_path(spark, "stream")
    ev = read_table(spark, sf_dir, "events")
    half = F.lit("2024-01-16").cast("timestamp")
    for part in (ev.where(F.col("ts") < half), ev.where(F.col("ts") >= half)):
        n = ST.stage_event_days(part.withColumn("ts", F.col("ts").cast("timestamp_ntz")), f"{base}/files")
        ST.run_available_now(make(ST.event_stream(spark, f"{base}/files", files_per_batch=n)),
                             f"{base}/out", f"{base}/ck", state=True)
    return spark.read.parquet(f"{base}/out")


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@register("stream_scrape_samples", f"""WITH {P_CTE},
B AS (SELECT model_name, status, time_bucket(INTERVAL 10 SECOND, ts) AS window_start, count(*) AS inc
      FROM P GROUP BY ALL),
S AS (SELECT model_name, status, window_start, CAST(sum(inc) OVER (
        PARTITION BY model_name, status ORDER BY window_start) AS BIGINT) AS value FROM B)
SELECT * FROM S WHERE window_start + INTERVAL 10 SECOND <= {_CLOSED}""")
def stream_scrape_samples(spark, sf_dir):
    """TS16, STR5: cumulative counter values on a stream that is stopped and
    started again, equal to `scrape_samples`."""
    out = _two_runs(spark, sf_dir, lambda s: ST.scrape_stream(ST.log_stream(s), ["model_name", "status"]))
    return _closed(out, spark, sf_dir).select(
        "model_name", "status", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "value")


@register("stream_increases", f"""WITH {P_CTE},
B AS (SELECT model_name, time_bucket(INTERVAL 10 SECOND, ts) AS window_start,
        arg_max(id % 1000, (ts, id)) AS value FROM P GROUP BY ALL),
D AS (SELECT *, lag(value) OVER (PARTITION BY model_name ORDER BY window_start) AS prev FROM B)
SELECT model_name, window_start, value::DOUBLE AS value,
       CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END::DOUBLE AS delta
FROM D WHERE window_start + INTERVAL 10 SECOND <= {_CLOSED}""")
def stream_increases(spark, sf_dir):
    """TS10 on a stream: increases of a counter that starts anew every 1,000
    events, over a restart of the stream."""
    def make(s):
        log = ST.log_stream(s)
        return ST.increase_stream(log.select("model_name", "ts", (F.col("id") % 1000).alias("value")),
                                  ["model_name"])

    return _closed(_two_runs(spark, sf_dir, make), spark, sf_dir).select(
        "model_name", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "value", "delta")


@register("stream_inflight", f"""WITH {P_CTE},
E AS (SELECT endpoint, ts, id AS request_id, 1 AS delta FROM P
      UNION ALL SELECT endpoint, {_END_TS}, id, -1 FROM P),
A AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY endpoint ORDER BY ts, delta, request_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS active FROM E)
SELECT * FROM A WHERE time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND <= {_CLOSED}""")
def stream_inflight(spark, sf_dir):
    """TS8 on a stream: requests in flight after every start and end, equal to
    `inflight`; ends come with their starts, minutes before their time."""
    def make(s):
        log = ST.log_stream(s, watermark=False)
        end = F.timestamp_micros(F.unix_micros("ts") + (F.col("processing_time_ms") * 1000).cast("long"))
        both = log.select("endpoint", F.col("id").alias("request_id"), F.explode(F.array(
            F.struct(F.col("ts").alias("ts"), F.lit(1).alias("delta")),
            F.struct(end.alias("ts"), F.lit(-1).alias("delta")))).alias("e")).select(
            "endpoint", "request_id", "e.ts", "e.delta").withWatermark("ts", ST.WATERMARK)
        return ST.inflight_stream(both, ["endpoint"])

    out = _two_runs(spark, sf_dir, make)
    closed = out.withColumn("window_end", F.window("ts", "10 seconds")["end"])
    return _closed(closed, spark, sf_dir).select(
        "endpoint", F.col("ts").cast("timestamp_ntz").alias("ts"), "request_id", "delta", "active")
