"""Labelled metric series (TS1-9, LBL1) as aggregates over event tables.

A counter is a grouped count (or weighted sum) of events; its running value
is a running sum over *time bins* of the series, never over raw events, so
a series holding a third of all events is still reduced map-side first.
Histograms are one pass of `count_if(v <= le)` per bucket; gauges are
`max_by(value, (ts, id))`.  Concurrency (+1/-1 events) uses the two-level
prefix sum because one endpoint can carry most of the traffic.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.prefix import running_totals

# fixed values: default histogram bucket upper bounds of the metrics client
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0,
                   7.5, 10.0)


def le_label(b: float) -> str:
    return repr(float(b))


def counter(events: DataFrame, labels: Sequence[str], weight: str | None = None,
            name: str = "value") -> DataFrame:
    """TS1-5: counter value per label set (count, or sum of `weight`)."""
    v = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return events.groupBy(*labels).agg(v.alias(name))


def bin_index(ts: Column | str, seconds: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def bin_end(bin_col: Column | str, seconds: int) -> Column:
    b = F.col(bin_col) if isinstance(bin_col, str) else bin_col
    return F.timestamp_micros((b + 1) * F.lit(seconds * 1_000_000)).cast("timestamp_ntz")


def binned(events: DataFrame, labels: Sequence[str], seconds: int = 10,
           weight: str | None = None) -> DataFrame:
    """Per (labels, bin) increments: the scrape-interval pre-aggregation."""
    v = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return events.groupBy(*labels, bin_index("ts", seconds).alias("bin")).agg(v.alias("inc"))


def scrape_samples(events: DataFrame, labels: Sequence[str], seconds: int = 10,
                   weight: str | None = None) -> DataFrame:
    """TS16: cumulative counter value sampled at the end of every bin that saw
    an event (labels, bin, sample_ts, value)."""
    b = binned(events, labels, seconds, weight)
    # running sum over a series' whole history: two-level prefix sum, so a
    # long-lived busy series is not one task
    run = running_totals(b, labels, "bin", ["inc"], ["value"])
    return run.select(*labels, "bin", bin_end("bin", seconds).alias("sample_ts"), "value")


def histogram(events: DataFrame, labels: Sequence[str], value: str,
              buckets: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    """TS6: cumulative bucket counts in long form (labels, le, bucket_count)
    plus `sum` and `count` of the observations."""
    v = F.col(value)
    aggs = [F.count_if(v <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(v).alias("b_inf"), F.sum(v).alias("obs_sum"), F.count(v).alias("obs_count")]
    wide = events.groupBy(*labels).agg(*aggs)
    pairs = [F.struct(F.lit(le_label(b)).alias("le"), F.lit(float(b)).alias("le_value"),
                      F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.lit(float("inf")).alias("le_value"),
                          F.col("b_inf").alias("bucket_count")))
    return wide.select(*labels, "obs_sum", "obs_count", F.explode(F.array(*pairs)).alias("h")) \
        .select(*labels, "h.le", "h.le_value", "h.bucket_count", "obs_sum", "obs_count")


def gauge_last(samples: DataFrame, labels: Sequence[str], value: str, ts: str = "ts",
               tiebreak: str | None = None, as_of=None, stale_s: int | None = None) -> DataFrame:
    """TS7 / TS14: last value per label set (optionally at or before as_of;
    with `stale_s`, a series without a sample in the seconds before as_of is
    absent)."""
    if as_of is not None:
        samples = samples.where(F.col(ts) <= as_of)
        if stale_s is not None:
            samples = samples.where(F.col(ts) > as_of - F.make_interval(secs=F.lit(float(stale_s))))
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return samples.groupBy(*labels).agg(F.max_by(F.col(value), order).alias(value),
                                        F.max(ts).alias("last_ts"))


def inflight(starts: DataFrame, ends: DataFrame, labels: Sequence[str]) -> DataFrame:
    """TS8: in-flight gauge: +1 at each start, -1 at each end; value after
    every event.  Events at the same instant apply ends first."""
    ev = starts.select(*labels, "ts", "request_id", F.lit(1).alias("delta")).unionByName(
        ends.select(*labels, "ts", "request_id", F.lit(-1).alias("delta")))
    ev = ev.withColumn("_ord", F.struct("ts", "delta", "request_id"))
    out = running_totals(ev, labels, "_ord", ["delta"], ["active"])
    return out.drop("_ord")


def request_pairs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """TS9 from separate start and end tables (request_id, ts)."""
    ev = starts.select("request_id", "ts", F.lit("start").alias("kind")).unionByName(
        ends.select("request_id", "ts", F.lit("end").alias("kind")))
    return request_pairs_events(ev)


def request_pairs_events(events: DataFrame) -> DataFrame:
    """TS9: pair start and end events (request_id, kind, ts) by request id
    (one shuffle on the id).  duration_s = end - start; an end without a
    start gives 0; a start without an end stays open (duration NULL)."""
    is_start = F.col("kind") == "start"
    g = events.groupBy("request_id").agg(
        F.min(F.when(is_start, F.col("ts"))).alias("start_ts"),
        F.max(F.when(~is_start, F.col("ts"))).alias("end_ts"))
    dur = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6
    return g.select(
        "request_id", "start_ts", "end_ts",
        F.when(F.col("start_ts").isNull(), F.lit(0.0)).otherwise(dur).alias("duration_s"),
        F.when(F.col("end_ts").isNull(), F.lit("open"))
        .when(F.col("start_ts").isNull(), F.lit("unmatched_end"))
        .otherwise(F.lit("closed")).alias("state"),
    )


# --- long series form: (metric, labels map<string,string>, ts, value) -------------

def to_series(df: DataFrame, metric: str, label_cols: Sequence[str], value: Column | str,
              ts: str = "ts") -> DataFrame:
    """Rows of one metric family in the long series form."""
    kv = []
    for c in label_cols:
        kv += [F.lit(c), F.col(c).cast("string")]
    v = F.col(value) if isinstance(value, str) else value
    return df.select(F.lit(metric).alias("metric"), F.create_map(*kv).alias("labels"),
                     F.col(ts).alias("ts"), v.cast("double").alias("value"))


def label_key(labels: Column | str = "labels") -> Column:
    """Canonical text of a label map (sorted k=v pairs) — a map cannot be a
    grouping key, its canonical text can."""
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def series_counter(series: DataFrame) -> DataFrame:
    """TS1-5 on the long form: value per (metric, label set)."""
    return series.groupBy("metric", label_key().alias("series")).agg(
        F.sum("value").alias("value"))


def relabel_map(series: DataFrame, source: str, target: str, regex: str,
                replacement: str) -> DataFrame:
    """LBL1 on the label map: full match of labels[source] writes
    labels[target] (map_concat, last key wins); no match leaves the map."""
    anchored = f"^(?:{regex})$"
    repl = replacement.replace("${", "$").replace("}", "")
    src = F.element_at("labels", F.lit(source))
    new = F.map_concat(
        F.map_filter("labels", lambda k, v: k != F.lit(target)),
        F.create_map(F.lit(target), F.regexp_replace(src, F.lit(anchored), F.lit(repl))))
    return series.withColumn("labels", F.when(src.rlike(anchored), new).otherwise(F.col("labels")))


def relabel(df: DataFrame, source: str, target: str, regex: str, replacement: str) -> DataFrame:
    """LBL1: when `source` fully matches `regex`, write the expanded
    replacement to `target`; otherwise `target` keeps its value (or NULL).
    `${1}` style groups are accepted."""
    anchored = f"^(?:{regex})$"
    repl = replacement.replace("${", "$").replace("}", "")
    src = F.col(source)
    new = F.regexp_replace(src, F.lit(anchored), F.lit(repl))
    keep = F.col(target) if target in df.columns else F.lit(None).cast("string")
    return df.withColumn(target, F.when(src.rlike(anchored), new).otherwise(keep))
