"""Metric-series and range queries (TS1-16, LBL1) over the serving log P."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.numeric import r
from quarry.operators import rangeq as RQ
from quarry.operators import series as SR
from quarry.operators.servelog import as_of_value, request_events
from quarry.plans.catalog import register
from quarry.plans.sqlparts import AS_OF, P_CTE
from quarry.sources.tables import prediction_log, read_table

REQ_LABELS = ["endpoint", "method", "status"]
BIN = "CAST(floor(epoch_us(ts) / 10000000.0) AS BIGINT)"
P_SQL = P_CTE.replace("AS endpoint,", "AS endpoint, 'POST' AS method,")


def _log(spark, sf_dir):
    return prediction_log(spark, sf_dir)


@register("counter_requests", f"""WITH {P_SQL}
SELECT endpoint, method, status, count(*) AS value FROM P GROUP BY ALL""")
def counter_requests(spark, sf_dir):
    return SR.counter(_log(spark, sf_dir), REQ_LABELS)


@register("counter_predictions", f"""WITH {P_SQL}
SELECT model_name, status, count(*) AS value FROM P GROUP BY ALL""")
def counter_predictions(spark, sf_dir):
    return SR.counter(_log(spark, sf_dir), ["model_name", "status"])


@register("counter_errors", f"""WITH {P_SQL}
SELECT endpoint, error_message AS error_type, count(*) AS value FROM P
WHERE status = 'error' GROUP BY ALL""")
def counter_errors(spark, sf_dir):
    errs = _log(spark, sf_dir).where(F.col("status") == "error") \
        .withColumnRenamed("error_message", "error_type")
    return SR.counter(errs, ["endpoint", "error_type"])


@register("counter_business", f"""WITH {P_SQL}
SELECT e.event_type AS metric_name, P.model_name, round(sum(e.value), 4) AS value
FROM events e JOIN P ON e.event_id = P.id GROUP BY ALL""")
def counter_business(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric_name"), "value",
        F.when(F.col("user_id") % 2 == 0, F.lit("housing")).otherwise(F.lit("iris")).alias("model_name"))
    return SR.counter(ev, ["metric_name", "model_name"], weight="value").withColumn(
        "value", r("value", 4))


def _hist_sql() -> str:
    rows = [f"SELECT model_name, '{SR.le_label(b)}' AS le, count(*) FILTER (WHERE v <= {float(b)!r}) "
            f"AS bucket_count, round(sum(v), 6) AS obs_sum, count(v) AS obs_count FROM H GROUP BY model_name"
            for b in SR.DEFAULT_BUCKETS]
    rows.append("SELECT model_name, '+Inf', count(v), round(sum(v), 6), count(v) FROM H GROUP BY model_name")
    return (f"WITH {P_SQL}, H AS (SELECT model_name, processing_time_ms / 1000.0 AS v FROM P)\n"
            + "\nUNION ALL\n".join(rows))


@register("histogram_buckets", _hist_sql())
def histogram_buckets(spark, sf_dir):
    p = _log(spark, sf_dir).withColumn("v", F.col("processing_time_ms") / 1000.0)
    h = SR.histogram(p, ["model_name"], "v")
    return h.select("model_name", "le", "bucket_count", r("obs_sum", 6).alias("obs_sum"), "obs_count")


def _family_sql(source: str, labels: list[str]) -> str:
    by = ", ".join(labels)
    rows = [f"SELECT {by}, '{le}' AS le, count(*) FILTER (WHERE v <= {bound}) AS bucket_count, "
            f"round(sum(v), 6) AS obs_sum, count(v) AS obs_count FROM H GROUP BY {by}"
            for le, bound in [*((SR.le_label(b), repr(float(b))) for b in SR.DEFAULT_BUCKETS),
                              ("+Inf", "'inf'::DOUBLE")]]
    return f"WITH {source}\n" + "\nUNION ALL\n".join(rows)


def _family(df, labels):
    return SR.histogram(df, labels, "v").select(
        *labels, "le", "bucket_count", r("obs_sum", 6).alias("obs_sum"), "obs_count")


@register("histogram_request_time", _family_sql(
    f"""{P_SQL}, H AS (SELECT endpoint, 'POST' AS method, processing_time_ms / 1000.0 AS v FROM P)""",
    ["endpoint", "method"]))
def histogram_request_time(spark, sf_dir):
    """TS6: request time by endpoint and method."""
    return _family(_log(spark, sf_dir).withColumn("v", F.col("processing_time_ms") / 1000.0),
                   ["endpoint", "method"])


@register("histogram_confidence", _family_sql(
    f"""{P_SQL}, H AS (SELECT model_name, confidence AS v FROM P)""", ["model_name"]))
def histogram_confidence(spark, sf_dir):
    """TS6: prediction confidence by model."""
    return _family(_log(spark, sf_dir).withColumn("v", F.col("confidence")), ["model_name"])


@register("gauge_last", f"""WITH {P_SQL}
SELECT model_name, round(arg_max(confidence, (ts, id)), 6) AS confidence, max(ts) AS last_ts
FROM P GROUP BY model_name""")
def gauge_last(spark, sf_dir):
    g = SR.gauge_last(_log(spark, sf_dir), ["model_name"], "confidence", tiebreak="id")
    return g.select("model_name", r("confidence", 6).alias("confidence"),
                    F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@register("instant_values", f"""WITH {P_SQL}
SELECT model_name, round(arg_max(confidence, (ts, id)), 6) AS confidence, max(ts) AS last_ts
FROM P WHERE ts <= {AS_OF} - INTERVAL 12 HOURS GROUP BY model_name""")
def instant_values(spark, sf_dir):
    log = _log(spark, sf_dir)
    at = as_of_value(log) - F.make_interval(hours=F.lit(12))
    g = SR.gauge_last(log, ["model_name"], "confidence", tiebreak="id", as_of=at)
    return g.select("model_name", r("confidence", 6).alias("confidence"),
                    F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


_END_TS = "(ts + to_microseconds(CAST(trunc(processing_time_ms * 1000) AS BIGINT)))"


@register("inflight", f"""WITH {P_SQL},
E AS (SELECT endpoint, ts, id AS request_id, 1 AS delta FROM P
      UNION ALL SELECT endpoint, {_END_TS}, id, -1 FROM P)
SELECT endpoint, ts, request_id, delta,
       CAST(sum(delta) OVER (PARTITION BY endpoint ORDER BY ts, delta, request_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS active
FROM E""")
def inflight(spark, sf_dir):
    ev = request_events(_log(spark, sf_dir)).withColumn(
        "endpoint", F.concat(F.lit("/predict/"), F.col("model_name")))
    starts = ev.select("endpoint", F.col("start_ts").alias("ts"), "request_id")
    ends = ev.select("endpoint", F.col("end_ts").alias("ts"), "request_id")
    out = SR.inflight(starts, ends, ["endpoint"])
    return out.select("endpoint", F.col("ts").cast("timestamp_ntz").alias("ts"), "request_id",
                      "delta", F.col("active").cast("long").alias("active"))


@register("request_pairs", f"""WITH {P_SQL}
SELECT id AS request_id, ts AS start_ts,
       CASE WHEN status = 'success' THEN {_END_TS} END AS end_ts,
       CASE WHEN status = 'success'
            THEN round((epoch_us({_END_TS}) - epoch_us(ts)) / 1e6, 6) END AS duration_s,
       CASE WHEN status = 'success' THEN 'closed' ELSE 'open' END AS state
FROM P""")
def request_pairs(spark, sf_dir):
    ev = request_events(_log(spark, sf_dir))
    # one scan: every request yields its start event and, when it finished
    # without error, its end event
    both = ev.select("request_id", F.explode(F.array_compact(F.array(
        F.struct(F.lit("start").alias("kind"), F.col("start_ts").alias("ts")),
        F.when(F.col("error").isNull(),
               F.struct(F.lit("end").alias("kind"), F.col("end_ts").alias("ts"))))))
        .alias("e")).select("request_id", "e.kind", "e.ts")
    p = SR.request_pairs_events(both)
    return p.select("request_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"),
                    F.col("end_ts").cast("timestamp_ntz").alias("end_ts"),
                    r("duration_s", 6).alias("duration_s"), "state")


@register("scrape_samples", f"""WITH {P_SQL},
B AS (SELECT model_name, status, {BIN} AS bin, count(*) AS inc FROM P GROUP BY ALL)
SELECT model_name, status, bin, make_timestamp((bin + 1) * 10000000) AS sample_ts,
       CAST(sum(inc) OVER (PARTITION BY model_name, status ORDER BY bin
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value
FROM B""")
def scrape_samples(spark, sf_dir):
    s = SR.scrape_samples(_log(spark, sf_dir), ["model_name", "status"])
    return s.withColumn("value", F.col("value").cast("long"))


@register("rate_5m", f"""WITH {P_SQL},
B AS (SELECT endpoint, method, status, {BIN} AS bin, count(*) AS inc FROM P GROUP BY ALL)
SELECT endpoint, method, status, bin, make_timestamp((bin + 1) * 10000000) AS step_ts,
       round(sum(inc) OVER (PARTITION BY endpoint, method, status ORDER BY bin
                            RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) / 300.0, 6) AS rate
FROM B""")
def rate_5m(spark, sf_dir):
    rt = RQ.rate_events(_log(spark, sf_dir), REQ_LABELS)
    return rt.withColumn("rate", r("rate", 6))


@register("rate_samples_reset", f"""WITH {P_SQL},
B AS (SELECT model_name, {BIN} AS bin, count(*) AS inc FROM P GROUP BY ALL),
S AS (SELECT model_name, bin,
             sum(inc) OVER (PARTITION BY model_name, bin // 8640 ORDER BY bin
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
      FROM B),
D AS (SELECT model_name, bin, value,
             CASE WHEN lag(value) OVER w IS NULL THEN 0.0
                  WHEN value < lag(value) OVER w THEN CAST(value AS DOUBLE)
                  ELSE CAST(value - lag(value) OVER w AS DOUBLE) END AS delta
      FROM S WINDOW w AS (PARTITION BY model_name ORDER BY bin))
SELECT model_name, bin, CAST(value AS BIGINT) AS value,
       round(sum(delta) OVER (PARTITION BY model_name ORDER BY bin
                              RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) / 300.0, 6) AS rate
FROM D""")
def rate_samples_reset(spark, sf_dir):
    """Counter samples that restart every day (a process restart at midnight),
    read back as a reset-aware rate."""
    b = SR.binned(_log(spark, sf_dir), ["model_name"])
    day = F.floor(F.col("bin") / 8640)
    w = Window.partitionBy("model_name", day).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    samples = b.select("model_name", "bin", F.sum("inc").over(w).alias("value"))
    rt = RQ.rate_samples(samples, ["model_name"])
    return rt.select("model_name", "bin", F.col("value").cast("long").alias("value"),
                     r("rate", 6).alias("rate"))


@register("success_ratio", f"""WITH {P_SQL},
B AS (SELECT model_name, {BIN} AS bin, count(*) FILTER (WHERE status = 'success') AS ok,
             count(*) AS n FROM P GROUP BY ALL)
SELECT model_name, bin, make_timestamp((bin + 1) * 10000000) AS step_ts,
       round(CAST(sum(ok) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 6) AS ratio
FROM B WINDOW w AS (PARTITION BY model_name ORDER BY bin RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def success_ratio(spark, sf_dir):
    s = RQ.success_ratio(_log(spark, sf_dir), ["model_name"])
    return s.withColumn("ratio", r("ratio", 6))


def _bucket_cte(value_sql: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE v <= {float(b)!r}) AS b{i}"
                     for i, b in enumerate(SR.DEFAULT_BUCKETS))
    wcols = ", ".join(f"sum(b{i}) OVER w / 300.0 AS b{i}" for i in range(len(SR.DEFAULT_BUCKETS)))
    return (f"WITH {P_SQL},\nB AS (SELECT model_name, {BIN} AS bin, {cols}, count(v) AS b_inf "
            f"FROM (SELECT *, {value_sql} AS v FROM P) GROUP BY ALL),\n"
            f"W AS (SELECT model_name, bin, {wcols}, sum(b_inf) OVER w / 300.0 AS b_inf FROM B "
            f"WINDOW w AS (PARTITION BY model_name ORDER BY bin RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))")


def _bucket_long_sql() -> str:
    parts = [f"SELECT model_name, bin, '{SR.le_label(b)}' AS le, b{i} AS rate FROM W"
             for i, b in enumerate(SR.DEFAULT_BUCKETS)]
    parts.append("SELECT model_name, bin, '+Inf', b_inf FROM W")
    return "L AS (" + "\nUNION ALL\n".join(parts) + ")"


@register("bucket_rate", _bucket_cte("confidence") + ",\n" + _bucket_long_sql() + """
SELECT model_name, bin, make_timestamp((bin + 1) * 10000000) AS step_ts, le, round(rate, 6) AS rate FROM L""")
def bucket_rate(spark, sf_dir):
    wide = RQ.bucket_rate(_log(spark, sf_dir), ["model_name"], "confidence")
    return RQ.bucket_rate_long(wide, ["model_name"]).withColumn("rate", r("rate", 6))


def hq_sql_from(prefix: str, step_ts_sql: str) -> str:
    """Histogram-quantile oracle over a CTE chain `prefix` that ends with
    W(model_name, bin, b0.., b_inf); p50 and p95 per (model_name, bin)."""
    bounds = [float(b) for b in SR.DEFAULT_BUCKETS]
    parts = [f"SELECT model_name, bin, {i} AS k, {b!r} AS le, b{i} AS c, b_inf AS total FROM W"
             for i, b in enumerate(bounds)]
    parts.append(f"SELECT model_name, bin, {len(bounds)}, 'inf'::DOUBLE, b_inf, b_inf FROM W")
    qs = []
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        qs.append(f"""{name} AS (
  SELECT model_name, bin, min(k) FILTER (WHERE c >= {q} * total) AS k, max(total) AS total FROM L
  GROUP BY model_name, bin),
{name}v AS (
  SELECT x.model_name, x.bin,
    CASE WHEN x.total IS NULL OR x.total <= 0 THEN NULL
         WHEN x.k = {len(bounds)} THEN {bounds[-1]!r}
         ELSE coalesce(lp.le, 0.0) + (h.le - coalesce(lp.le, 0.0))
              * ({q} * x.total - coalesce(lp.c, 0.0)) / (h.c - coalesce(lp.c, 0.0)) END AS v
  FROM {name} x JOIN L h ON h.model_name = x.model_name AND h.bin = x.bin AND h.k = x.k
  LEFT JOIN L lp ON lp.model_name = x.model_name AND lp.bin = x.bin AND lp.k = x.k - 1)""")
    return (prefix + ",\nL AS (" + "\nUNION ALL\n".join(parts)
            + "),\n" + ",\n".join(qs) + f"""
SELECT a.model_name, a.bin, {step_ts_sql} AS step_ts,
       round(a.v, 6) AS p50, round(b.v, 6) AS p95
FROM p50v a JOIN p95v b ON a.model_name = b.model_name AND a.bin = b.bin""")


def _hq_sql() -> str:
    return hq_sql_from(_bucket_cte("processing_time_ms / 1000.0"),
                       "make_timestamp((a.bin + 1) * 10000000)")


@register("histogram_quantile", _hq_sql())
def histogram_quantile(spark, sf_dir):
    p = _log(spark, sf_dir).withColumn("v", F.col("processing_time_ms") / 1000.0)
    wide = RQ.bucket_rate(p, ["model_name"], "v")
    q = RQ.histogram_quantile(wide, ["model_name"], [0.5, 0.95], names=["p50", "p95"])
    return q.select("model_name", "bin", "step_ts", r("p50", 6).alias("p50"), r("p95", 6).alias("p95"))


@register("range_grid", f"""WITH {P_SQL},
A AS (SELECT CAST(floor(epoch_us({AS_OF}) / 10000000.0) AS BIGINT) AS end_bin,
             CAST(floor(epoch_us({AS_OF} - INTERVAL 3600 SECONDS) / 10000000.0) AS BIGINT) AS start_bin),
B AS (SELECT model_name, {BIN} AS bin, count(*) AS inc FROM P, A
      WHERE {BIN} > A.start_bin - 30 GROUP BY ALL),
G AS (SELECT s.model_name, g.bin FROM (SELECT DISTINCT model_name FROM B) s,
        A, range(A.start_bin - 29, A.end_bin + 1) g(bin)),
D AS (SELECT G.model_name, G.bin, coalesce(B.inc, 0) AS inc FROM G LEFT JOIN B USING (model_name, bin)),
R AS (SELECT model_name, bin, sum(inc) OVER (PARTITION BY model_name ORDER BY bin
        RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) / 300.0 AS rate FROM D)
SELECT model_name, bin, make_timestamp((bin + 1) * 10000000) AS step_ts, round(rate, 6) AS rate
FROM R, A WHERE bin > A.start_bin""")
def range_grid(spark, sf_dir):
    log = _log(spark, sf_dir)
    g = RQ.range_grid(log, ["model_name"], as_of_value(log))
    return g.withColumn("rate", r("rate", 6))


@register("relabel", f"""WITH {P_SQL}
SELECT DISTINCT endpoint, method, status,
       CASE WHEN regexp_full_match(endpoint, '/predict/(h.*)')
            THEN regexp_replace(endpoint, '^(?:/predict/(h.*))$', '\\1') END AS model
FROM P""")
def relabel(spark, sf_dir):
    series = _log(spark, sf_dir).select(*REQ_LABELS).distinct()
    return SR.relabel(series, "endpoint", "model", "/predict/(h.*)", "${1}")


@register("series_long", f"""WITH {P_SQL}
SELECT 'ml_api_requests_total' AS metric,
       'endpoint=' || endpoint || ',method=' || method || ',status=' || status AS series,
       CAST(count(*) AS DOUBLE) AS value
FROM P GROUP BY ALL
UNION ALL
SELECT 'ml_model_predictions_total',
       CASE WHEN regexp_full_match(endpoint, '/predict/(.*)')
            THEN 'model=' || regexp_replace(endpoint, '^(?:/predict/(.*))$', '\\1') || ',' ELSE '' END
       || 'model_name=' || model_name || ',status=' || status,
       CAST(count(*) AS DOUBLE)
FROM P GROUP BY ALL""")
def series_long(spark, sf_dir):
    """Long series form (metric, labels map, ts, value): request counter and
    a relabelled prediction counter, counted per canonical label set."""
    log = _log(spark, sf_dir)
    req = SR.to_series(log, "ml_api_requests_total", REQ_LABELS, F.lit(1.0))
    pred = SR.to_series(log, "ml_model_predictions_total", ["model_name", "status", "endpoint"],
                        F.lit(1.0))
    pred = SR.relabel_map(pred, "endpoint", "model", "/predict/(.*)", "${1}")
    pred = pred.withColumn("labels", F.map_filter("labels", lambda k, v: k != F.lit("endpoint")))
    return SR.series_counter(req.unionByName(pred))


# --- NULL labels: a series of their own -------------------------------------------

_NULLED = f"{P_SQL}, N AS (SELECT * REPLACE (NULLIF(model_name, 'iris') AS model_name) FROM P)"


def _nulled(spark, sf_dir):
    """The log with the label of half its series missing."""
    return _log(spark, sf_dir).withColumn(
        "model_name", F.when(F.col("model_name") != "iris", F.col("model_name")))


@register("scrape_samples_null_label", f"""WITH {_NULLED},
B AS (SELECT model_name, {BIN} AS bin, count(*) AS inc FROM N GROUP BY ALL)
SELECT model_name, bin, make_timestamp((bin + 1) * 10000000) AS sample_ts,
       CAST(sum(inc) OVER (PARTITION BY model_name ORDER BY bin
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value
FROM B""")
def scrape_samples_null_label(spark, sf_dir):
    """TS16: samples of a series whose label is NULL."""
    s = SR.scrape_samples(_nulled(spark, sf_dir), ["model_name"])
    return s.withColumn("value", F.col("value").cast("long"))


@register("inflight_null_label", f"""WITH {_NULLED},
E AS (SELECT model_name, ts, id AS request_id, 1 AS delta FROM N
      UNION ALL SELECT model_name, {_END_TS}, id, -1 FROM N)
SELECT model_name, ts, request_id, delta,
       CAST(sum(delta) OVER (PARTITION BY model_name ORDER BY ts, delta, request_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS active
FROM E""")
def inflight_null_label(spark, sf_dir):
    """TS8: requests in flight of a series whose label is NULL."""
    log = _nulled(spark, sf_dir)
    ev = request_events(_log(spark, sf_dir)).join(
        log.select(F.col("id").alias("request_id"), F.col("model_name").alias("label")), "request_id")
    starts = ev.select(F.col("label").alias("model_name"), F.col("start_ts").alias("ts"), "request_id")
    ends = ev.select(F.col("label").alias("model_name"), F.col("end_ts").alias("ts"), "request_id")
    out = SR.inflight(starts, ends, ["model_name"])
    return out.select("model_name", F.col("ts").cast("timestamp_ntz").alias("ts"), "request_id",
                      "delta", F.col("active").cast("long").alias("active"))


@register("range_grid_null_label", f"""WITH {_NULLED},
A AS (SELECT CAST(floor(epoch_us({AS_OF}) / 10000000.0) AS BIGINT) AS end_bin,
             CAST(floor(epoch_us({AS_OF} - INTERVAL 3600 SECONDS) / 10000000.0) AS BIGINT) AS start_bin),
B AS (SELECT model_name, {BIN} AS bin, count(*) AS inc FROM N, A
      WHERE {BIN} > A.start_bin - 30 GROUP BY ALL),
G AS (SELECT s.model_name, g.bin FROM (SELECT DISTINCT model_name FROM B) s,
        A, range(A.start_bin - 29, A.end_bin + 1) g(bin)),
D AS (SELECT G.model_name, G.bin, coalesce(B.inc, 0) AS inc FROM G
      LEFT JOIN B ON B.model_name IS NOT DISTINCT FROM G.model_name AND B.bin = G.bin),
R AS (SELECT model_name, bin, sum(inc) OVER (PARTITION BY model_name ORDER BY bin
        RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) / 300.0 AS rate FROM D)
SELECT model_name, bin, make_timestamp((bin + 1) * 10000000) AS step_ts, round(rate, 6) AS rate
FROM R, A WHERE bin > A.start_bin""")
def range_grid_null_label(spark, sf_dir):
    """TS15: rates of a series whose label is NULL."""
    log = _nulled(spark, sf_dir)
    g = RQ.range_grid(log, ["model_name"], as_of_value(log))
    return g.withColumn("rate", r("rate", 6))


# --- staleness and extrapolation -----------------------------------------------------

_GRID = """A AS (SELECT epoch_us({as_of}) // {us} AS last_bin, epoch_us({as_of}) // {us} - {steps} + 1 AS first_bin),
G AS (SELECT s.*, g.bin, make_timestamp(g.bin * {us}) AS t
      FROM (SELECT DISTINCT {labels} FROM S) s, A, range(A.first_bin, A.last_bin + 1) g(bin))"""


@register("instant_grid", f"""WITH {P_SQL},
S AS (SELECT model_name, status, ts, arg_max(confidence, id) AS confidence FROM P GROUP BY ALL),
{_GRID.format(as_of=AS_OF, us=10000000, steps=8640, labels="model_name, status")}
SELECT G.model_name, G.status, G.bin, G.t AS step_ts, round(S.confidence, 6) AS confidence, S.ts AS sample_ts
FROM G ASOF JOIN S ON S.model_name = G.model_name AND S.status = G.status AND G.t >= S.ts
WHERE S.ts > G.t - INTERVAL 300 SECONDS""")
def instant_grid(spark, sf_dir):
    """TS14, TS15: the gauge at every 10-second step of a day; a series
    without a sample in five minutes is absent."""
    log = _log(spark, sf_dir)
    g = RQ.instant_grid(log, ["model_name", "status"], "confidence", as_of_value(log),
                        lookback_s=86_400, tiebreak="id")
    return g.select("model_name", "status", "bin", "step_ts", r("confidence", 6).alias("confidence"),
                    F.col("sample_ts").cast("timestamp_ntz").alias("sample_ts"))


@register("instant_values_stale", f"""WITH {P_SQL}
SELECT model_name, status, round(arg_max(confidence, (ts, id)), 6) AS confidence, max(ts) AS last_ts
FROM P WHERE ts > {AS_OF} - INTERVAL 300 SECONDS GROUP BY model_name, status""")
def instant_values_stale(spark, sf_dir):
    """TS14: last values at the end of the log; a stale series is absent."""
    log = _log(spark, sf_dir)
    g = SR.gauge_last(log, ["model_name", "status"], "confidence", tiebreak="id",
                      as_of=as_of_value(log), stale_s=300)
    return g.select("model_name", "status", r("confidence", 6).alias("confidence"),
                    F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


_MINUTE = "CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT)"


@register("rate_extrapolated", f"""WITH {P_SQL},
B AS (SELECT model_name, {_MINUTE} AS bin, count(*) AS inc FROM P GROUP BY ALL),
S AS (SELECT model_name, make_timestamp((bin + 1) * 60000000) AS ts,
        sum(inc) OVER (PARTITION BY model_name, bin // 360 ORDER BY bin) AS value FROM B),
{_GRID.format(as_of=AS_OF, us=60000000, steps=2880, labels="model_name")},
J AS (SELECT G.model_name, G.bin, G.t, S.ts, S.value, lag(S.value) OVER (
        PARTITION BY G.model_name, G.bin ORDER BY S.ts) AS prev
      FROM G JOIN S ON S.model_name = G.model_name AND S.ts > G.t - INTERVAL 3600 SECONDS AND S.ts <= G.t),
X AS (SELECT model_name, bin, t, count(*) - 1 AS m, arg_min(value, ts) AS fv,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS sampled,
        3600 - (epoch_us(t) - epoch_us(min(ts))) / 1e6 AS d0, (epoch_us(t) - epoch_us(max(ts))) / 1e6 AS d1,
        sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END)::DOUBLE AS rise
      FROM J GROUP BY model_name, bin, t HAVING count(*) >= 2),
Y AS (SELECT *, CASE WHEN d0 >= 1.1 * sampled / m THEN sampled / m / 2 ELSE d0 END AS s0,
        CASE WHEN d1 >= 1.1 * sampled / m THEN sampled / m / 2 ELSE d1 END AS s1 FROM X)
SELECT model_name, bin, t AS step_ts, round(rise * (sampled + s1 + CASE WHEN rise > 0
         THEN least(s0, sampled * fv / rise) ELSE s0 END) / sampled / 3600, 8) AS rate FROM Y""")
def rate_extrapolated(spark, sf_dir):
    """TS10: rates as dashboards evaluate them, over counters that are scraped
    every minute and start anew every six hours."""
    log = _log(spark, sf_dir)
    life = F.floor(SR.bin_index("ts", 60) / 360).cast("long")
    s = SR.scrape_samples(log.withColumn("life", life), ["model_name", "life"], 60)
    samples = s.select("model_name", F.col("sample_ts").cast("timestamp").alias("ts"), "value")
    out = RQ.rate_extrapolated(samples, ["model_name"], as_of_value(log), lookback_s=172_800,
                               range_s=3600, step_s=60)
    return out.withColumn("rate", r("rate", 8))
