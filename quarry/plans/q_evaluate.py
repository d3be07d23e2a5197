"""Evaluation queries (EVL1-7).

Scored tables: H (lineitem) with a fitted unit-price rule as the regression
prediction; `labels` (quality as actual, toxic as predicted); orders with a
price rule predicting the order status (status 'P' is never predicted).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import r
from quarry.operators import evaluate as E
from quarry.plans.catalog import register
from quarry.sources.tables import read_table, regression_table


def scored_lineitem(spark, sf_dir):
    h = regression_table(spark, sf_dir)
    unit = h.select(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).scalar()
    return h.withColumn("predicted_price", F.col("l_quantity") * unit)


def scored_orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.withColumn("predicted_status",
                        F.when(F.col("o_totalprice") > 250000, F.lit("F")).otherwise(F.lit("O")))


_SCORED_H = """SH AS (SELECT l_extendedprice AS y,
  l_quantity * (SELECT avg(l_extendedprice / l_quantity) FROM lineitem) AS yhat FROM lineitem)"""
_SCORED_O = """SO AS (SELECT o_orderstatus AS y,
  CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END AS yhat FROM orders)"""
_SCORED_L = "SL AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS yhat FROM labels)"


def _per_class_sql(src: str) -> str:
    return f"""PC_{src} AS (
  SELECT label, sum(tp) AS tp, sum(sup) AS support, sum(pn) AS predicted_n FROM (
    SELECT y AS label, CASE WHEN y = yhat THEN 1 ELSE 0 END AS tp, 1 AS sup, 0 AS pn FROM {src}
    UNION ALL SELECT yhat, 0, 0, 1 FROM {src}) GROUP BY label),
PM_{src} AS (
  SELECT label, tp, support, predicted_n,
    coalesce(CASE WHEN predicted_n > 0 THEN tp / predicted_n END, 0.0) AS precision,
    coalesce(CASE WHEN support > 0 THEN tp / support END, 0.0) AS recall FROM PC_{src}),
PF_{src} AS (SELECT *, CASE WHEN precision + recall > 0
                 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM PM_{src})"""


def _cls_metrics_sql(src: str) -> str:
    return f"""SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall,
  round(sum(f1 * support) / sum(support), 6) AS f1_score,
  CAST(sum(support) AS BIGINT) AS samples_evaluated FROM PF_{src}"""


_REG_SQL = """SELECT round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse,
  round(avg(abs(y - yhat)), 4) AS mae,
  round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2_score,
  round(avg(abs(CASE WHEN y <> 0 THEN (y - yhat) / y END)) * 100, 6) AS mape,
  count(*) FILTER (WHERE y = 0) AS mape_undefined,
  count(*) AS samples_evaluated,
  (SELECT count(*) FROM SH WHERE y IS NULL OR yhat IS NULL) AS rows_unpaired
FROM (SELECT * FROM SH WHERE y IS NOT NULL AND yhat IS NOT NULL)"""


def _round_reg(df):
    return df.select(r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"),
                     r("r2_score", 6).alias("r2_score"), r("mape", 6).alias("mape"),
                     "mape_undefined", "samples_evaluated", "rows_unpaired")


def _round_cls(df):
    return df.select(*[r(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1_score"]],
                     F.col("samples_evaluated").cast("long").alias("samples_evaluated"))


@register("regression_metrics", f"WITH {_SCORED_H}\n{_REG_SQL}")
def regression_metrics(spark, sf_dir):
    return _round_reg(E.regression_metrics(scored_lineitem(spark, sf_dir), "l_extendedprice",
                                           "predicted_price"))


@register("classification_metrics", f"WITH {_SCORED_L}, {_per_class_sql('SL')}\n{_cls_metrics_sql('SL')}")
def classification_metrics(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    return _round_cls(E.classification_metrics(lab, "quality", "toxic"))


@register("classification_metrics_multi",
          f"WITH {_SCORED_O}, {_per_class_sql('SO')}\n{_cls_metrics_sql('SO')}")
def classification_metrics_multi(spark, sf_dir):
    return _round_cls(E.classification_metrics(scored_orders(spark, sf_dir), "o_orderstatus",
                                               "predicted_status"))


@register("confusion_matrix", f"""WITH {_SCORED_O},
L AS (SELECT y AS label FROM SO UNION SELECT yhat FROM SO),
C AS (SELECT y, yhat, count(*) AS n FROM SO GROUP BY ALL)
SELECT a.label AS actual, p.label AS predicted, coalesce(C.n, 0) AS n
FROM L a, L p LEFT JOIN C ON C.y = a.label AND C.yhat = p.label""")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(scored_orders(spark, sf_dir), "o_orderstatus", "predicted_status")


@register("classification_report", f"""WITH {_SCORED_O}, {_per_class_sql('SO')}
SELECT label AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM PF_SO
UNION ALL
SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
       round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM PF_SO
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM PF_SO
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM PF_SO""")
def classification_report(spark, sf_dir):
    rep = E.classification_report(scored_orders(spark, sf_dir), "o_orderstatus", "predicted_status")
    return rep.select("row", *[r(c, 6).alias(c) for c in ["precision", "recall", "f1_score"]],
                      F.col("support").cast("long").alias("support"))


_UNSCORED = """SN AS (SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 7 <> 0 THEN
  CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END END AS yhat FROM orders),
SO AS (SELECT * FROM SN WHERE y IS NOT NULL AND yhat IS NOT NULL)"""


def _partly_scored(spark, sf_dir):
    """Scored orders of which a seventh has no prediction."""
    return scored_orders(spark, sf_dir).withColumn("predicted_status", F.when(
        F.col("o_orderkey") % 7 != 0, F.col("predicted_status")))


@register("confusion_matrix_unscored", f"""WITH {_UNSCORED},
L AS (SELECT y AS label FROM SO UNION SELECT yhat FROM SO),
C AS (SELECT y, yhat, count(*) AS n FROM SO GROUP BY ALL)
SELECT a.label AS actual, p.label AS predicted, coalesce(C.n, 0) AS n
FROM L a, L p LEFT JOIN C ON C.y = a.label AND C.yhat = p.label""")
def confusion_matrix_unscored(spark, sf_dir):
    """EVL4 over rows of which some have no prediction."""
    return E.confusion_matrix(_partly_scored(spark, sf_dir), "o_orderstatus", "predicted_status")


@register("classification_report_unscored", f"""WITH {_UNSCORED}, {_per_class_sql('SO')}
SELECT label AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM PF_SO
UNION ALL
SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
       round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM PF_SO
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM PF_SO
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM PF_SO
UNION ALL
SELECT 'unscored', NULL, NULL, NULL, count(*) FROM SN WHERE y IS NULL OR yhat IS NULL""")
def classification_report_unscored(spark, sf_dir):
    """EVL5 over rows of which some have no prediction: they are counted in a
    row of their own and enter no average."""
    rep = E.classification_report(_partly_scored(spark, sf_dir), "o_orderstatus", "predicted_status")
    return rep.select("row", *[r(c, 6).alias(c) for c in ["precision", "recall", "f1_score"]],
                      F.col("support").cast("long").alias("support"))


@register("classification_metrics_unscored", f"""WITH {_UNSCORED}, {_per_class_sql('SO')},
M AS ({_cls_metrics_sql('SO')})
SELECT M.*, (SELECT count(*) FROM SN WHERE y IS NULL OR yhat IS NULL) AS rows_unscored FROM M""")
def classification_metrics_unscored(spark, sf_dir):
    """EVL3: unscored rows are reported, not counted as wrong."""
    m = E.classification_metrics(_partly_scored(spark, sf_dir), "o_orderstatus", "predicted_status")
    return m.select(*[r(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1_score"]],
                    F.col("samples_evaluated").cast("long").alias("samples_evaluated"),
                    F.col("rows_unscored").cast("long").alias("rows_unscored"))


def _all_jobs(spark, sf_dir):
    return [
        ("housing", "regression", scored_lineitem(spark, sf_dir), "l_extendedprice",
         "predicted_price"),
        ("quality", "classification", read_table(spark, sf_dir, "labels"), "quality", "toxic"),
        ("order_status", "classification", scored_orders(spark, sf_dir), "o_orderstatus",
         "predicted_status"),
    ]


def _evaluate_all_sql() -> str:
    def cls(name, src):
        return (f"SELECT '{name}' AS model_name, metric, value FROM ("
                f"UNPIVOT ({_cls_metrics_sql(src).replace('CAST(sum(support) AS BIGINT)', 'CAST(sum(support) AS DOUBLE)')}) "
                f"ON accuracy, precision, recall, f1_score, samples_evaluated INTO NAME metric VALUE value)")
    reg = (f"SELECT 'housing' AS model_name, metric, value FROM (UNPIVOT ("
           f"SELECT rmse, mae, r2_score, mape, CAST(samples_evaluated AS DOUBLE) AS samples_evaluated "
           f"FROM ({_REG_SQL})) ON rmse, mae, r2_score, mape, samples_evaluated "
           f"INTO NAME metric VALUE value)")
    return (f"WITH {_SCORED_H}, {_SCORED_L}, {_SCORED_O}, {_per_class_sql('SL')}, {_per_class_sql('SO')},\n"
            f"M AS ({reg}\nUNION ALL\n{cls('quality', 'SL')}\nUNION ALL\n{cls('order_status', 'SO')})")


def _rounded_all(spark, sf_dir):
    """EVL6 over the three scored tables; values rounded per metric."""
    m = E.evaluate_all(_all_jobs(spark, sf_dir))
    four = F.col("metric").isin("rmse", "mae")
    return m.withColumn("value", F.when(four, F.round("value", 4)).otherwise(F.round("value", 6)))


@register("evaluate_all", _evaluate_all_sql() + "\nSELECT model_name, metric, value FROM M")
def evaluate_all(spark, sf_dir):
    return _rounded_all(spark, sf_dir)


@register("model_comparison", _evaluate_all_sql() + """
SELECT model_name, metric AS primary_metric, value AS score FROM M
WHERE metric IN ('r2_score', 'accuracy')""")
def model_comparison(spark, sf_dir):
    return E.model_comparison(_rounded_all(spark, sf_dir))
