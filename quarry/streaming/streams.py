"""Structured Streaming twins of the batch operators (STR1-7).

The serving log arrives as files; every stream uses event time with a
10-minute watermark (rows later than that are dropped: our rule, the source
system defines none).  Aggregations run in append mode, so a window is
emitted once the watermark passes its end; the batch twin of each stream is
the same operator restricted to closed windows.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quarry.functions.rules import Rule
from quarry.operators import validate as V
from quarry.operators.series import DEFAULT_BUCKETS
from quarry.operators.train import score
from quarry.sources.tables import prediction_log_from_events

EVENTS_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
                 "props string")
WATERMARK = "10 minutes"
#: State store of operators that keep state of their own.
CARRIED_STATE = {"spark.sql.streaming.stateStore.providerClass":
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stage_event_files(events: DataFrame, path: str) -> str:
    """Lay an events table down as day-partitioned files (the arrival unit
    of the log); Spark derives the files from the given table.  Rows are
    range-partitioned on time first, so a busy day is spread over several
    tasks instead of one."""
    (events.withColumn("event_day", F.to_date("ts")).repartitionByRange("ts")
     .write.mode("overwrite").partitionBy("event_day").parquet(path))
    return path


def stage_event_days(events: DataFrame, path: str, days_per_batch: int = 8) -> int:
    """Lay an events table down in order of arrival: one file a day, so many
    days at a time.  A stream that reads as many files a trigger gets several
    micro-batches in event-time order."""
    days = events.withColumn("event_day", F.to_date("ts"))
    every = sorted(r[0] for r in days.select("event_day").distinct().collect())  # one a day
    for i in range(0, len(every), days_per_batch):
        (days.where(F.col("event_day").isin(every[i:i + days_per_batch])).repartition("event_day")
         .write.mode("append").partitionBy("event_day").parquet(path))
    return days_per_batch


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """File source over staged event files; ts cast to event-time TIMESTAMP."""
    raw = (spark.readStream.schema(EVENTS_SCHEMA + ", event_day date")
           .option("maxFilesPerTrigger", files_per_batch).parquet(path))
    return raw.drop("event_day").withColumn("ts", F.col("ts").cast("timestamp"))


def log_stream(events: DataFrame, watermark: bool = True) -> DataFrame:
    """STR1 source side: the serving-log projection works on streams as is."""
    log = prediction_log_from_events(events)
    return log.withWatermark("ts", WATERMARK) if watermark else log


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet", state: bool = False) -> None:
    """Process everything available, then stop (exactly-once file sink).
    `state`: the query has an operator with state of its own, which only the
    disk-backed state store keeps; the setting holds for this start alone."""
    conf, before = df.sparkSession.conf, {}
    if state:
        before = {k: conf.get(k, None) for k in CARRIED_STATE}
        for k, v in CARRIED_STATE.items():
            conf.set(k, v)
    try:
        q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(sink))
        q.awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def ingest(log: DataFrame, rules: Sequence[Rule], valid_path: str, quarantine_path: str,
           checkpoint: str) -> None:
    """STR1: continuous ingest with rule check and quarantine: a file-sink
    stream for each side, with its own filter and checkpoint.  A sink commits
    a batch once, so a batch that is run again adds no rows."""
    part = ["event_date"] if "event_date" in log.columns else []
    sides = zip(V.route(V.apply_rules(log, rules)), (valid_path, quarantine_path),
                ("valid", "quarantine"))
    started = [rows.writeStream.format("parquet").option("path", path)
               .option("checkpointLocation", f"{checkpoint}/{name}").partitionBy(*part)
               .outputMode("append").trigger(availableNow=True).start()
               for rows, path, name in sides]
    for q in started:
        q.awaitTermination()


def sliding_stats(log: DataFrame, length: str = "5 minutes", slide: str = "1 minute",
                  buckets: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    """STR2 + STR3: per model and sliding window: count, errors, error share,
    mean latency, and cumulative latency-histogram buckets (seconds)."""
    v = F.col("processing_time_ms") / 1000.0
    return log.groupBy(F.window("ts", length, slide).alias("w"), "model_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.avg("processing_time_ms").alias("avg_ms"),
        *[F.count_if(v <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(buckets)],
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "model_name", "n", "errors", (F.col("errors") / F.col("n")).alias("error_share"),
             "avg_ms", *[f"b{i}" for i in range(len(buckets))])


def tumbling_counts(log: DataFrame, length: str = "10 seconds") -> DataFrame:
    """STR5: tumbling counter snapshot per (model, status)."""
    return log.groupBy(F.window("ts", length).alias("w"), "model_name", "status").agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "model_name", "status", "n")


# --- counters and gauges that go on ---------------------------------------------

#: Rows of a series that go back to Spark at once.
TOLD_ROWS = 50_000


def _carried(rows: DataFrame, labels: Sequence[str], order: Sequence[str], step, out: str,
             state: str) -> DataFrame:
    """Rows of closed windows (labels and plain columns) in time order (`order`),
    one series at a time, with a state that is kept between micro-batches and
    over restarts.  Windows close in time order, so sorting those of one batch is
    enough; the state is a few numbers a series.  A task holds the plain columns
    of one series of a batch as arrays (its labels once), nothing nested.

    step(window rows as a DataFrame, state tuple or None) -> (rows, new state).
    The query must be started with `CARRIED_STATE` (`run_available_now` with
    state=True does so)."""
    names = list(labels)

    class Carried(StatefulProcessor):
        def init(self, handle) -> None:
            self.held = handle.getValueState("held", state)

        def handleInputRows(self, key, batches, timerValues):
            parts, series = [], None
            for b in batches:
                if series is None:
                    series = {c: b[c].iloc[0] for c in names}
                parts.append(b.drop(columns=names))
            pdf = pd.concat(parts, ignore_index=True)
            parts.clear()
            pdf = pdf.iloc[np.lexsort([pdf[c].to_numpy() for c in reversed(order)])].reset_index(drop=True)
            found, now = step(pdf, tuple(self.held.get()) if self.held.exists() else None)
            self.held.update(now)
            for a in range(0, len(found), TOLD_ROWS):
                yield found.iloc[a:a + TOLD_ROWS].assign(**series)[told]

        def close(self) -> None:
            pass

    told = [c.split()[0] for c in out.split(", ")]
    return rows.groupBy(*names).transformWithStateInPandas(Carried(), out, "append", "none")


def scrape_stream(log: DataFrame, labels: Sequence[str], seconds: int = 10) -> DataFrame:
    """TS16 / STR5: the counter's value at the end of every bin that saw an
    event: windowed counts, then a running total that the state carries."""
    counted = log.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *labels).agg(
        F.count(F.lit(1)).alias("inc")).select(
        *labels, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "inc")

    def step(pdf: pd.DataFrame, held: tuple | None):
        value = pdf["inc"].cumsum() + (held[0] if held else 0)
        return pdf.assign(value=value).drop(columns="inc"), (int(value.iloc[-1]),)

    out = "".join(f"{c} string, " for c in labels)
    return _carried(counted, labels, ["window_start"], step,
                    f"{out}window_start timestamp, window_end timestamp, value long", "total long")


def increase_stream(samples: DataFrame, labels: Sequence[str], value: str = "value",
                    seconds: int = 10) -> DataFrame:
    """TS10's increases on a stream of cumulative samples (labels, ts, value):
    the last sample of every bin against the last one before, which the state
    carries; a drop is a reset, so the increase is the new value itself."""
    last = samples.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *labels).agg(
        F.max_by(value, "ts").cast("double").alias("value")).select(
        *labels, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "value")

    def step(pdf: pd.DataFrame, held: tuple | None):
        v = pdf["value"]
        before = v.shift(fill_value=held[0] if held else v.iloc[0])
        return pdf.assign(delta=(v - before).where(v >= before, v)), (float(v.iloc[-1]),)

    out = "".join(f"{c} string, " for c in labels)
    return _carried(last, labels, ["window_start"], step, f"{out}window_start timestamp, window_end timestamp, "
                    "value double, delta double", "last double")


def inflight_stream(events: DataFrame, labels: Sequence[str], seconds: int = 10) -> DataFrame:
    """TS8 on a stream of +1 / -1 events (labels, ts, request_id, delta) in any
    order within the watermark: events wait in their bin until it is closed,
    then the gauge after each of them is told; the state carries its value.
    Events at the same instant apply ends first."""
    waiting = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *labels).agg(
        F.array_sort(F.collect_list(F.struct("ts", "delta", "request_id"))).alias("events")).select(
        *labels, F.unix_micros("w.start").alias("bin"), F.posexplode("events").alias("place", "e"))
    # numbers that are never null: an event takes a few bytes of the task's Python
    flat = waiting.select(
        *labels, "bin", "place", F.unix_micros("e.ts").alias("at"), F.col("e.delta").alias("delta"),
        F.coalesce("e.request_id", F.lit(0)).cast("long").alias("request_id"),
        F.col("e.request_id").isNotNull().alias("named"))

    def step(pdf: pd.DataFrame, held: tuple | None):
        pdf = pdf.drop(columns=["bin", "place"])
        pdf["active"] = np.cumsum(pdf["delta"].to_numpy(), dtype=np.int64) + (held[0] if held else 0)
        return pdf, (int(pdf["active"].iloc[-1]),)

    out = "".join(f"{c} string, " for c in labels)
    told = _carried(flat, labels, ["bin", "place"], step,
                    f"{out}at long, request_id long, named boolean, delta int, active long", "active long")
    return told.select(*labels, F.timestamp_micros("at").alias("ts"),
                       F.when(F.col("named"), F.col("request_id")).alias("request_id"), "delta", "active")


def pair_stream(starts: DataFrame, ends: DataFrame, max_gap: str = "1 hour") -> DataFrame:
    """STR4: start/end pairing as a stream-stream join bounded in event time;
    starts without an end inside `max_gap` expire from state."""
    s = starts.select(F.col("request_id").alias("s_id"), F.col("ts").alias("start_ts")) \
        .withWatermark("start_ts", WATERMARK)
    e = ends.select(F.col("request_id").alias("e_id"), F.col("ts").alias("end_ts")) \
        .withWatermark("end_ts", WATERMARK)
    cond = (F.col("s_id") == F.col("e_id")) & (F.col("end_ts") >= F.col("start_ts")) & \
        (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {max_gap}"))
    j = s.join(e, cond, "inner")
    return j.select(F.col("s_id").alias("request_id"), "start_ts", "end_ts",
                    ((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6).alias("duration_s"))


def pair_with_expiry(starts: DataFrame, ends: DataFrame, timeout: str = "60 seconds") -> DataFrame:
    """STR4 with explicit expiry: a full outer stream-stream join by request
    id, bounded in event time.  A pair is `closed` whichever side arrives
    first; once the watermark has passed its bound, a start without an end is
    `expired` and an end without a start `unmatched_end` (duration 0)."""
    s = starts.select(F.col("request_id").alias("s_id"), F.col("ts").alias("start_ts")) \
        .withWatermark("start_ts", WATERMARK)
    e = ends.select(F.col("request_id").alias("e_id"), F.col("ts").alias("end_ts")) \
        .withWatermark("end_ts", WATERMARK)
    cond = (F.col("s_id") == F.col("e_id")) & (F.col("end_ts") >= F.col("start_ts")) & \
        (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {timeout}"))
    state = F.when(F.col("e_id").isNull(), "expired").when(
        F.col("s_id").isNull(), "unmatched_end").otherwise("closed")
    seconds = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6
    return s.join(e, cond, "full_outer").select(
        F.coalesce("s_id", "e_id").alias("request_id"), "start_ts", "end_ts",
        F.when(F.col("s_id").isNull(), F.lit(0.0)).otherwise(seconds).alias("duration_s"),
        state.alias("state"))


def dedupe(log: DataFrame, key: str = "id") -> DataFrame:
    """STR7: drop repeated request ids delivered again within the watermark."""
    return log.dropDuplicatesWithinWatermark([key])


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    """STR6: a fitted pipeline scores a stream exactly as a batch: features are
    checked, every row comes back, NULL where a feature is missing."""
    return score(model, stream)
