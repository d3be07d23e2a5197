"""DRF3 as a job over two files: read the reference and current tables,
run the drift report; a failure yields the fixed error verdict row."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import drift as D
from quarry.sources import files as IO

REPORT_SCHEMA = ("model_name string, drift_detected boolean, drift_score double, "
                 "features_with_drift string, recommendation string, skipped_features string, "
                 "threshold double")

# fixed values: verdict reported when the check itself fails
ERROR_VERDICT = (False, 0.0, "", "Error in drift detection")


def drift_job(spark: SparkSession, reference_path: str, current_path: str, schema,
              model_name: str, threshold: float = 0.05) -> DataFrame:
    try:
        ref = IO.read_csv(spark, reference_path, schema)
        cur = IO.read_csv(spark, current_path, schema)
        rep = D.drift_report(ref, cur, model_name, threshold)
        rep.first()  # surface read / parse errors here, not in the caller
        return rep
    except Exception:  # noqa: BLE001  the failure is the verdict
        detected, score, feats, text = ERROR_VERDICT
        return spark.createDataFrame(
            [(model_name, detected, score, feats, text, "", float(threshold))], REPORT_SCHEMA)
