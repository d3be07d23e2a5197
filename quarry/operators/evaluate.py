"""Regression and classification metrics (EVL1-7).

Regression metrics are one aggregate pass.  Classification metrics start
from the (actual, predicted) count table — at most classes^2 rows after a
map-side partial count — and everything else (per-class precision / recall /
F1, weighted and macro averages, the zero-filled confusion matrix) is derived
from that small table.  Undefined ratios (no predictions or no support for a
class) are 0, as in the usual reporting convention.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import nan_to_null
from quarry.session import freeze as frozen


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """EVL1-2: rmse, mae, r2_score, mape (%), samples_evaluated over the rows
    that have both sides; `rows_unpaired` counts the others (NULL or NaN on a
    side).  Paired rows with y = 0 have no defined percentage error and are
    counted in `mape_undefined` instead."""
    actual, predicted = nan_to_null(F.col(y).cast("double")), nan_to_null(F.col(yhat).cast("double"))
    e = actual - predicted
    paired = e.isNotNull()
    ape = F.abs(F.try_divide(e, actual))
    n = F.count(e)
    spread = F.var_pop(F.when(paired, actual)) * n
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), spread)).alias("r2_score"),
        (F.avg(ape) * 100.0).alias("mape"),
        F.count_if(paired & ape.isNull()).alias("mape_undefined"),
        n.alias("samples_evaluated"),
        F.count_if(~paired).alias("rows_unpaired"),
    )


def label_text(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Label columns in one canonical text form: numbers are compared as
    numbers (1, 1.0 and 1L are the same label), text as text; a numeric side
    against a text side is an error, not a mismatch of every row."""
    numeric = [isinstance(df.schema[c].dataType, T.NumericType) for c in cols]
    if any(numeric) and not all(numeric):
        raise TypeError(f"labels of different types: {[df.schema[c].simpleString() for c in cols]}")

    def text(c: str) -> Column:
        d = nan_to_null(F.col(c).cast("double"))
        whole = (d == F.floor(d)) & (F.abs(d) < 2.0 ** 53)
        return F.when(whole, d.try_cast("long").cast("string")).otherwise(
            F.when(d.isNotNull(), F.col(c).cast("string")))

    return [text(c) if n else F.col(c).cast("string") for c, n in zip(cols, numeric)]


def pair_counts(df: DataFrame, y: str, yhat: str, freeze: bool = True) -> DataFrame:
    """(actual, predicted, n) for every observed pair, labels as canonical
    strings (`label_text`).

    The table has at most classes^2 rows; with `freeze` it is checkpointed
    (reliable, shared folder) so the several metrics derived from it do not
    each re-scan the scored table."""
    actual, predicted = label_text(df, [y, yhat])
    counts = df.groupBy(actual.alias("actual"), predicted.alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    if freeze:
        counts = counts.transform(frozen)
    return counts


def scored_pairs(counts: DataFrame) -> DataFrame:
    """Pairs with both labels: what every metric below is taken from."""
    return counts.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())


def unscored(counts: DataFrame) -> DataFrame:
    """One row: rows_unscored, the rows without a label or a prediction (NULL
    or NaN)."""
    return counts.agg(F.coalesce(F.sum(F.when(
        F.col("actual").isNull() | F.col("predicted").isNull(), F.col("n"))), F.lit(0)).alias(
        "rows_unscored"))


def per_class(counts: DataFrame) -> DataFrame:
    """(label, tp, support, predicted_n, precision, recall, f1) over the union
    of actual and predicted labels."""
    sides = counts.select(F.col("actual").alias("label"), "n",
                          F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                          .otherwise(F.lit(0)).alias("tp"),
                          F.lit(0).cast("long").alias("pred_n")) \
        .unionByName(counts.select(F.col("predicted").alias("label"),
                                   F.lit(0).cast("long").alias("n"),
                                   F.lit(0).cast("long").alias("tp"),
                                   F.col("n").alias("pred_n")))
    c = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("n").alias("support"),
                                   F.sum("pred_n").alias("predicted_n"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted_n")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    return c.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                      F.col("precision") + F.col("recall")), F.lit(0.0)))


def classification_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """EVL3: accuracy and support-weighted precision / recall / F1 over the
    scored rows; `rows_unscored` counts the others."""
    counts = pair_counts(df, y, yhat)
    pc = per_class(scored_pairs(counts))
    tot = F.sum("support")
    return pc.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_score"),
        tot.alias("samples_evaluated"),
    ).withColumn("rows_unscored", unscored(counts).scalar())


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """EVL4: (actual, predicted, n) for every pair of the sorted label union,
    zeros filled; rows = actual; unscored rows are left out.  The label union is a bounded array (one
    entry per class) shared through a scalar subquery, so no join of labels
    with labels is needed."""
    counts = scored_pairs(pair_counts(df, y, yhat))
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).agg(
        F.array_sort(F.collect_set("label"))).scalar()  # one entry a class
    by_actual = counts.groupBy("actual").agg(
        F.map_from_entries(F.collect_list(F.struct("predicted", "n"))).alias("row"))
    all_actual = counts.select(F.explode(labels).alias("actual")).distinct()
    rows = all_actual.join(by_actual, "actual", "left")
    return rows.select("actual", F.posexplode(labels).alias("pos", "predicted"), "row").select(
        "actual", "predicted",
        F.coalesce(F.try_element_at(F.col("row"), F.col("predicted")), F.lit(0)).cast("long")
        .alias("n"))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """EVL5: per-class rows plus 'accuracy', 'macro avg' and 'weighted avg'
    rows: (row, precision, recall, f1_score, support), and an 'unscored' row
    with their number if there are rows without a label or a prediction."""
    counts = pair_counts(df, y, yhat)
    pc = per_class(scored_pairs(counts))
    cls = pc.select(F.col("label").alias("row"), "precision", "recall",
                    F.col("f1").alias("f1_score"), "support")
    tot = F.sum("support")
    acc = pc.agg((F.sum("tp") / tot).alias("a"), tot.alias("s")).select(
        F.lit("accuracy").alias("row"), F.col("a").alias("precision"), F.col("a").alias("recall"),
        F.col("a").alias("f1_score"), F.col("s").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1_score"),
                   tot.alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("row"),
                      (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_score"),
                      tot.alias("support"))
    none = F.lit(None).cast("double")
    left_out = unscored(counts).where("rows_unscored > 0").select(
        F.lit("unscored").alias("row"), none.alias("precision"), none.alias("recall"),
        none.alias("f1_score"), F.col("rows_unscored").alias("support"))
    return cls.unionByName(acc).unionByName(macro).unionByName(weighted).unionByName(left_out)


def long_metrics(wide: DataFrame, model_name: str, metrics: Sequence[str]) -> DataFrame:
    """Wide one-row metrics -> (model_name, metric, value) rows."""
    cast = wide.select(*[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot([], list(metrics), "metric", "value").select(
        F.lit(model_name).alias("model_name"), "metric", "value")


def evaluate_all(jobs: Sequence[tuple[str, str, DataFrame | None, str, str]]) -> DataFrame:
    """EVL6: jobs of (model_name, kind, scored table or None, y, yhat);
    kind 'regression' or 'classification'; a missing table is skipped.
    Returns the union of long metric rows."""
    parts = []
    for name, kind, df, y, yhat in jobs:
        if df is None:
            continue
        if kind == "regression":
            parts.append(long_metrics(regression_metrics(df, y, yhat), name,
                                      ["rmse", "mae", "r2_score", "mape", "samples_evaluated"]))
        elif kind == "classification":
            parts.append(long_metrics(classification_metrics(df, y, yhat), name,
                                      ["accuracy", "precision", "recall", "f1_score",
                                       "samples_evaluated"]))
        else:
            raise ValueError(f"unknown model kind {kind!r}")
    if not parts:
        raise ValueError("no model could be evaluated")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate_registered(registry, name: str, run_prefix: str, df: DataFrame, kind: str, label: str,
                        evaluated_at) -> DataFrame:
    """EVL2 / EVL6 from the registry: the latest registered model of `name`
    (else the newest run with the prefix) is loaded, scores the table, and its
    metrics come back with the time the caller states; no model gives no rows."""
    from quarry.operators import train as TR

    row = registry.latest_model_path(name, run_prefix).first()
    if row is None:
        return df.sparkSession.createDataFrame([], "model_name string, metric string, value double, "
                                                   "evaluated_at timestamp")
    scored = TR.score(PipelineModel.load(row["model_path"]), df)
    return evaluate_all([(name, kind, scored, label, "prediction")]).withColumn(
        "evaluated_at", F.lit(evaluated_at).cast("timestamp"))


def model_comparison(metrics: DataFrame) -> DataFrame:
    """EVL7: one primary metric per model (r2_score for regression,
    accuracy for classification)."""
    return metrics.where(F.col("metric").isin("r2_score", "accuracy")).select(
        "model_name", F.col("metric").alias("primary_metric"), F.col("value").alias("score"))
