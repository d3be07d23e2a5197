"""Retraining jobs with tracked state (RTR1-3, TS4).

Job state is an append-only `job_events` table — one row per transition
(started -> running -> completed | failed) — and the current state of a job
is `max_by(event, ts)` per job id, a partial aggregate rather than a window.
"""
from __future__ import annotations

import datetime as _dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import freeze
from quarry.functions.rules import RETRAIN_MODEL_NAMES, RETRAIN_TRIGGERS
from quarry.operators import split as SP
from quarry.operators import train as TR

JOB_EVENTS_SCHEMA = ("job_id string, model_name string, trigger_type string, status string, "
                     "ts timestamp, duration double, error string, estimated_minutes int")

# fixed values: registry aliases, estimated durations (minutes)
MODEL_ALIASES = {"CaliforniaHousingBestModel": "housing", "IrisBestModel": "iris"}
ESTIMATED_MINUTES = {"housing": 5, "iris": 3}
DEFAULT_ESTIMATE = 10
REGISTERED_NAMES = {"housing": "CaliforniaHousingBestModel", "iris": "IrisBestModel"}
TERMINAL = ("completed", "failed")


def normalized_model(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    expr = c
    for alias, base in MODEL_ALIASES.items():
        expr = F.when(c == alias, F.lit(base)).otherwise(expr)
    return expr


def estimated_minutes(model: Column) -> Column:
    out = F.lit(DEFAULT_ESTIMATE)
    for m, v in ESTIMATED_MINUTES.items():
        out = F.when(model == m, F.lit(v)).otherwise(out)
    return out


def job_id_expr(model: Column, ts: Column, suffix: Column) -> Column:
    """`{model}_{yyyyMMdd_HHmmss}_{suffix}` (the suffix keeps ids unique
    within one second)."""
    return F.concat_ws("_", model, F.date_format(ts, "yyyyMMdd_HHmmss"), suffix.cast("string"))


def events_from_requests(requests: DataFrame, duration_s: Column, failed: Column,
                         error_text: Column) -> DataFrame:
    """RTR2 as a table transform: each accepted request (valid name and
    trigger) becomes a job with started / running / terminal events."""
    ok = F.col("model_name").isin(list(RETRAIN_MODEL_NAMES)) & \
        F.col("trigger_type").isin(list(RETRAIN_TRIGGERS))
    base = requests.where(ok).select(
        normalized_model("model_name").alias("model_name"), "trigger_type", "ts",
        "request_id", duration_s.alias("_dur"), failed.alias("_failed"), error_text.alias("_err"))
    base = base.withColumn("job_id", job_id_expr(F.col("model_name"), F.col("ts"),
                                                 F.col("request_id")))
    ev = F.array(
        F.struct(F.lit("started").alias("status"), F.col("ts").alias("ts"),
                 F.lit(0.0).alias("duration"), F.lit(None).cast("string").alias("error")),
        F.struct(F.lit("running").alias("status"),
                 F.timestamp_micros(F.unix_micros("ts") + 1).alias("ts"),
                 F.lit(0.0).alias("duration"), F.lit(None).cast("string").alias("error")),
        F.struct(F.when(F.col("_failed"), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
                 F.timestamp_micros(F.unix_micros("ts") + 1 + (F.col("_dur") * 1e6).cast("long"))
                 .alias("ts"),
                 F.col("_dur").alias("duration"),
                 F.when(F.col("_failed"), F.col("_err")).alias("error")),
    )
    return base.select("job_id", "model_name", "trigger_type", F.explode(ev).alias("e")).select(
        "job_id", "model_name", "trigger_type", "e.status", "e.ts", "e.duration", "e.error",
        estimated_minutes(F.col("model_name")).alias("estimated_minutes"))


def latest_state(job_events: DataFrame) -> DataFrame:
    """RTR3: current state per job (latest event; duration defaults to 0)."""
    last = F.max_by(F.struct("status", "ts", "duration", "error"), F.col("ts"))
    # job attributes fixed at submission travel as grouping keys
    keys = [c for c in ("job_id", "model_name", "trigger_type", "estimated_minutes")
            if c in job_events.columns]
    return job_events.groupBy(*keys).agg(
        last.alias("s"), F.min("ts").alias("start_time")).select(
        *keys, "s.status", "start_time",
        F.col("s.ts").alias("last_update"), F.coalesce("s.duration", F.lit(0.0)).alias("duration"),
        "s.error")


def retraining_counter(job_events: DataFrame) -> DataFrame:
    """TS4: retrainings per (model, trigger), each job counted once at its
    terminal event."""
    return job_events.where(F.col("status").isin(*TERMINAL)).groupBy(
        "model_name", "trigger_type").agg(F.count(F.lit(1)).alias("value"))


# ---------------------------------------------------------------------------
# RTR1: a retraining job run
# ---------------------------------------------------------------------------

def _event(spark: SparkSession, job_id: str, model: str, trigger: str, status: str,
           duration: float = 0.0, error: str | None = None) -> DataFrame:
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    est = ESTIMATED_MINUTES.get(model, DEFAULT_ESTIMATE)
    return spark.createDataFrame([(job_id, model, trigger, status, now, duration, error, est)],
                                 JOB_EVENTS_SCHEMA)


def retrain(spark: SparkSession, registry, events_path: str, model_name: str, trigger_type: str,
            load_data: Callable[[], DataFrame], label: str, key: str, kind: str,
            candidates: list[TR.Candidate], test_size: float = 0.2, seed: int = 42,
            params: dict | None = None, history_path: str | None = None) -> str:
    """RTR1: started event -> load data -> split -> fit candidates -> pick
    best -> log runs -> register -> append the best score to the performance
    history (`history_path`, the input of DRF4) -> terminal event (completed
    or failed with the error text).  Returns the job id."""
    model = MODEL_ALIASES.get(model_name, model_name)
    if model not in ESTIMATED_MINUTES:
        raise ValueError(f"unknown model {model_name!r}")
    if trigger_type not in RETRAIN_TRIGGERS:
        raise ValueError(f"unknown trigger {trigger_type!r}")
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    job_id = f"{model}_{stamp}_{uuid.uuid4().hex[:8]}"
    _event(spark, job_id, model, trigger_type, "started").write.mode("append").parquet(events_path)
    t0 = time.time()
    try:
        _event(spark, job_id, model, trigger_type, "running").write.mode("append").parquet(events_path)
        # frozen once: every candidate fit and scoring pass reads it
        data = SP.hash_split(load_data(), key, test_size, seed).transform(freeze)
        train = data.where(~F.col("is_test"))
        test = data.where(F.col("is_test"))
        res = TR.train_candidates(train, test, label, kind, candidates, params)
        if not res.models:
            raise RuntimeError(f"every candidate failed: {res.failures}")
        metric, higher = ("rmse", False) if kind == "regression" else ("accuracy", True)
        best = TR.pick_best(res.scores, metric, higher)
        for run_id, m in res.models.items():
            rows = res.scores.where(F.col("run_id") == run_id)
            registry.log_run(run_id, res.names[run_id], model,
                             {"trigger": trigger_type, "seed": seed, **(params or {})},
                             rows.select("metric", "value"), m)
        registry.register(REGISTERED_NAMES[model], best)
        if history_path:
            best.select(F.lit(model).alias("model_name"), "metric", F.col("score").alias("value"),
                        F.lit(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
                        .cast("timestamp").alias("ts")).write.mode("append").parquet(history_path)
        _event(spark, job_id, model, trigger_type, "completed",
               duration=time.time() - t0).write.mode("append").parquet(events_path)
    except Exception as e:  # noqa: BLE001  the failure is recorded as job state
        _event(spark, job_id, model, trigger_type, "failed", duration=time.time() - t0,
               error=f"{type(e).__name__}: {e}").write.mode("append").parquet(events_path)
    return job_id
