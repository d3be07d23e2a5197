"""Run records and model registry as append-only tables (SNK5, SRC3).

Layout under one root folder (shared storage):
  runs/            long table (run_id, run_name, experiment, kind, key, value, start_time)
  model_versions/  (name, version, run_id, model_path, score, registered_at)
  models/<run_id>  saved PipelineModel
A registration asks for `coalesce(max(version), 0) + 1` of its name; readers
number the rows (`Registry.versions`), so no two models share a version.
"""
from __future__ import annotations

import datetime as _dt
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.session import freeze

RUNS_SCHEMA = ("run_id string, run_name string, experiment string, kind string, key string, "
               "value double, text string, start_time timestamp")
VERSIONS_SCHEMA = ("name string, version long, run_id string, model_path string, score double, "
                   "registered_at timestamp")


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- paths ---------------------------------------------------------------
    def _p(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._p(name))
        except AnalysisException as e:  # only an absent table is an empty one
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS_SCHEMA)

    def versions(self) -> DataFrame:
        """Registered versions.  Rows are only ever added, so two writers may
        have asked for one number: the order of numbers, times and run ids
        decides, and the later one and those after it move up."""
        asked = self._read("model_versions", VERSIONS_SCHEMA)
        order = Window.partitionBy("name").orderBy("version", "registered_at", "run_id")
        return asked.withColumn("version", F.row_number().over(order).cast("long"))

    def model_path(self, run_id: str) -> str:
        return self._p(os.path.join("models", run_id))

    # --- writes ----------------------------------------------------------------
    def log_run(self, run_id: str, run_name: str, experiment: str, params: dict,
                metrics: DataFrame | None, model: PipelineModel | None,
                start_time: _dt.datetime | None = None) -> None:
        """Append params (one row each) and metrics rows (metric, value) of one
        run; save the fitted model under models/<run_id>."""
        t = start_time or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        prow = [(run_id, run_name, experiment, "param", str(k), None, str(v), t)
                for k, v in params.items()]
        out = self.spark.createDataFrame(prow, RUNS_SCHEMA)
        if metrics is not None:
            out = out.unionByName(metrics.select(
                F.lit(run_id).alias("run_id"), F.lit(run_name).alias("run_name"),
                F.lit(experiment).alias("experiment"), F.lit("metric").alias("kind"),
                F.col("metric").alias("key"), F.col("value").cast("double").alias("value"),
                F.lit(None).cast("string").alias("text"), F.lit(t).alias("start_time")))
        out.write.mode("append").parquet(self._p("runs"))
        if model is not None:
            model.write().overwrite().save(self.model_path(run_id))

    def register(self, name: str, best: DataFrame) -> DataFrame:
        """Register the best run (one row: run_id, score) as the next version
        of `name`; no row -> nothing registered.  Returns the new rows."""
        nxt = self.versions().where(F.col("name") == name).select(
            (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("v")).scalar()
        new = best.select(
            F.lit(name).alias("name"), nxt.cast("long").alias("version"), "run_id",
            F.concat(F.lit(self._p("models") + "/"), F.col("run_id")).alias("model_path"),
            F.col("score").cast("double").alias("score"),
            F.current_timestamp().alias("registered_at"))
        rows = freeze(new)
        rows.write.mode("append").parquet(self._p("model_versions"))
        return rows

    # --- lookups (SRC3) --------------------------------------------------------
    def latest_versions(self) -> DataFrame:
        """Latest registered version per name."""
        return self.versions().groupBy("name").agg(
            F.max("version").alias("version"),
            F.max_by("model_path", "version").alias("model_path"),
            F.max_by("run_id", "version").alias("run_id"))

    def recent_runs(self, prefix: str, n: int = 10) -> DataFrame:
        """Newest `n` runs whose name contains `prefix` (case-insensitive)."""
        runs = self.runs().groupBy("run_id", "run_name").agg(F.min("start_time").alias("start_time"))
        return runs.where(F.lower("run_name").contains(prefix.lower())) \
            .orderBy(F.desc("start_time"), F.desc("run_id")).limit(n)

    def latest_model_path(self, name: str, run_prefix: str) -> DataFrame:
        """Registry 'latest' for `name`, else the newest recent run matching
        the prefix: one row (source, run_id, model_path)."""
        reg = self.latest_versions().where(F.col("name") == name).select(
            F.lit("registry").alias("source"), "run_id", "model_path", F.lit(0).alias("_rank"))
        runs = self.recent_runs(run_prefix).limit(1).select(
            F.lit("runs").alias("source"), "run_id",
            F.concat(F.lit(self._p("models") + "/"), F.col("run_id")).alias("model_path"),
            F.lit(1).alias("_rank"))
        both = reg.unionByName(runs)
        return both.orderBy("_rank").limit(1).drop("_rank")

    def load(self, model_path: str) -> PipelineModel:
        return PipelineModel.load(model_path)
