"""Drift queries (DRF1-4).

Reference / current tables: lineitem shipped before / from 1998-01-01
(unequal sizes), and every event against the same events with latency
inflated by 5 % and user ids shifted by 3 (equal sizes, so the exact p-value
law applies).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.session import freeze
from quarry.functions.numeric import r
from quarry.operators import drift as D
from quarry.plans.catalog import register
from quarry.plans.sqlparts import P_CTE
from quarry.sources.tables import prediction_log, read_table, regression_table

H_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUT = "1998-01-01"


def h_halves(spark, sf_dir):
    h = regression_table(spark, sf_dir)
    ship = F.col("l_shipdate")
    cols = H_FEATURES + ["l_returnflag"]
    return (h.where(ship < F.lit(CUT).cast("timestamp")).select(*cols),
            h.where(ship >= F.lit(CUT).cast("timestamp")).select(*cols))


def event_shift(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("value", "user_id")
    cur = ev.select((F.col("value") * 1.05).alias("value"), (F.col("user_id") + 3).alias("user_id"))
    return ev, cur


def _ks_sql(ref_sql: str, cur_sql: str, feats: list[str]) -> str:
    unp = lambda src, side: "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, '{side}' AS side FROM ({src}) "
        f"WHERE {f} IS NOT NULL" for f in feats)
    return f"""L AS ({unp(ref_sql, 'ref')}
UNION ALL
{unp(cur_sql, 'cur')}),
C AS (SELECT feature, value, count(*) FILTER (WHERE side = 'ref') AS c_ref,
             count(*) FILTER (WHERE side = 'cur') AS c_cur FROM L GROUP BY feature, value),
R AS (SELECT feature,
        sum(c_ref) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS cr,
        sum(c_cur) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS cc,
        sum(c_ref) OVER (PARTITION BY feature) AS n_ref,
        sum(c_cur) OVER (PARTITION BY feature) AS n_cur FROM C),
S AS (SELECT feature, CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur,
             max(abs(cr / n_ref - cc / n_cur)) AS ks_d FROM R GROUP BY feature)"""


_H_REF = f"SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'"
_H_CUR = f"SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}'"
_E_REF = "SELECT value, user_id FROM events"
_E_CUR = "SELECT value * 1.05 AS value, user_id + 3 AS user_id FROM events"

def _p_sql(method: str) -> str:
    """PV: p-values.  exact: logs of the binomial ratios summed factor by
    factor; asymptotic: the alternating series, and its dual below lambda 1."""
    if method == "exact":
        return """P AS (SELECT S.*, CAST(round(ks_d * n_ref) AS BIGINT) AS h FROM S),
X AS (SELECT P.feature, j.j,
        (SELECT exp(sum(ln((P.n_ref - i.i) / (P.n_ref + 1.0 + i.i)))) FROM range(0, j.j * P.h) i(i)) AS ratio
      FROM P, range(1, CAST(floor(P.n_ref / greatest(P.h, 1)) AS BIGINT) + 1) j(j)
      WHERE P.n_ref = P.n_cur AND P.h > 0),
EX AS (SELECT feature, least(greatest(2 * sum(CASE WHEN j % 2 = 1 THEN ratio ELSE -ratio END), 0), 1) AS p
       FROM X GROUP BY feature),
PV AS (SELECT P.feature, P.n_ref, P.n_cur, P.ks_d, 'exact' AS p_method,
         CASE WHEN P.n_ref = P.n_cur THEN coalesce(EX.p, 1.0) END AS p_value
       FROM P LEFT JOIN EX USING (feature))"""
    return """L1 AS (SELECT *, n_ref * n_cur / (n_ref + n_cur) AS m FROM S),
L2 AS (SELECT *, (sqrt(m) + 0.12 + 0.11 / sqrt(m)) * ks_d AS lam FROM L1),
PV AS (SELECT feature, n_ref, n_cur, ks_d, 'asymptotic' AS p_method,
         least(greatest(CASE WHEN lam <= 0 THEN 1.0 WHEN lam < 1 THEN 1 - sqrt(2 * pi()) / lam *
             list_sum([exp(-1.0 * (2 * k - 1) * (2 * k - 1) * pi() * pi() / (8 * lam * lam)) for k in range(1, 31)])
           ELSE 2 * list_sum([CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * lam * lam)
                              for j in range(1, 101)]) END, 0), 1) AS p_value FROM L2)"""


@register("ks_statistic", "WITH " + _ks_sql(_H_REF, _H_CUR, H_FEATURES) +
          "\nSELECT feature, n_ref, n_cur, round(ks_d, 8) AS ks_d FROM S")
def ks_statistic(spark, sf_dir):
    ref, cur = h_halves(spark, sf_dir)
    return D.ks_statistic(ref, cur, H_FEATURES).withColumn("ks_d", r("ks_d", 8))


@register("ks_pvalue", "WITH " + _ks_sql(_E_REF, _E_CUR, ["value", "user_id"]) + ",\n" + _p_sql("exact") +
          "\nSELECT feature, n_ref, n_cur, round(ks_d, 8) AS ks_d, round(p_value, 6) AS p_value, "
          "p_method FROM PV")
def ks_pvalue(spark, sf_dir):
    ref, cur = event_shift(spark, sf_dir)
    p = D.ks_pvalue(D.ks_statistic(ref, cur), "exact")
    return p.select("feature", "n_ref", "n_cur", r("ks_d", 8).alias("ks_d"),
                    r("p_value", 6).alias("p_value"), "p_method")


@register("ks_pvalue_unequal", "WITH " + _ks_sql(_H_REF, _H_CUR, H_FEATURES) + ",\n" + _p_sql("asymptotic") +
          "\nSELECT feature, n_ref, n_cur, round(ks_d, 8) AS ks_d, round(p_value, 6) AS p_value, "
          "p_method FROM PV")
def ks_pvalue_unequal(spark, sf_dir):
    ref, cur = h_halves(spark, sf_dir)
    p = D.ks_pvalue(D.ks_statistic(ref, cur, H_FEATURES))
    return p.select("feature", "n_ref", "n_cur", r("ks_d", 8).alias("ks_d"),
                    r("p_value", 6).alias("p_value"), "p_method")


_CUST = "SELECT c_acctbal, c_nationkey FROM customer WHERE c_mktsegment = '{}'"


@register("ks_pvalue_exact_unequal", "WITH RECURSIVE " + _ks_sql(
    _CUST.format("BUILDING"), _CUST.format("MACHINERY"), ["c_acctbal", "c_nationkey"]) + """,
Z AS (SELECT *, n_cur // gcd(n_ref, n_cur) AS b, n_ref // gcd(n_ref, n_cur) AS a FROM S),
K AS (SELECT *, CAST(round(ks_d * n_ref * b) AS BIGINT) AS h FROM Z),
W AS (SELECT feature, 0::BIGINT AS s, MAP {0::BIGINT: 0.0::DOUBLE} AS f FROM K WHERE h > 0
  UNION ALL
  SELECT W.feature, W.s + 1, map_from_entries([{k: x, v: (
      coalesce(W.f[x - 1], 1.0) * x + coalesce(W.f[x], 1.0) * (W.s + 1 - x)) / (W.s + 1)}
    for x in range(greatest(0, W.s + 1 - K.n_cur), least(K.n_ref, W.s + 1) + 1)
    if abs(x * K.b - (W.s + 1 - x) * K.a) < K.h])
  FROM W JOIN K USING (feature) WHERE W.s < K.n_ref + K.n_cur)
SELECT K.feature, K.n_ref, K.n_cur, round(K.ks_d, 8) AS ks_d,
  round(coalesce(W.f[K.n_ref], 1.0), 8) AS p_value, 'exact' AS p_method
FROM K LEFT JOIN W ON W.feature = K.feature AND W.s = K.n_ref + K.n_cur""")
def ks_pvalue_exact_unequal(spark, sf_dir):
    """DRF2: exact law for samples of unequal sizes, two customer segments."""
    c = read_table(spark, sf_dir, "customer")
    ref, cur = (c.where(F.col("c_mktsegment") == s).select("c_acctbal", "c_nationkey")
                for s in ("BUILDING", "MACHINERY"))
    p = D.ks_pvalue(D.ks_statistic(ref, cur), "auto")
    return p.select("feature", "n_ref", "n_cur", r("ks_d", 8).alias("ks_d"),
                    r("p_value", 8).alias("p_value"), "p_method")


@register("drift_report", "WITH " + _ks_sql(_H_REF, _H_CUR, H_FEATURES) + ",\n" + _p_sql("asymptotic") + """
SELECT 'housing' AS model_name, coalesce(avg(p_value) < 0.05, false) AS drift_detected,
       round(avg(p_value), 6) AS drift_score,
       coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE p_value < 0.05)), ','), '')
         AS features_with_drift,
       CASE WHEN coalesce(avg(p_value) < 0.05, false) THEN 'Retrain model' ELSE 'No action needed' END
         AS recommendation,
       'l_returnflag' AS skipped_features, CAST(0.05 AS DOUBLE) AS threshold
FROM PV""")
def drift_report(spark, sf_dir):
    ref, cur = h_halves(spark, sf_dir)
    rep = D.drift_report(ref, cur, "housing", 0.05)
    return rep.withColumn("drift_score", r("drift_score", 6))


_Q_REF = "SELECT l_extendedprice FROM lineitem"
_Q_CUR = """SELECT CASE WHEN l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem)
THEN l_extendedprice + 1000 ELSE l_extendedprice END AS l_extendedprice FROM lineitem"""


@register("drift_near_identical", "WITH " + _ks_sql(_Q_REF, _Q_CUR, ["l_extendedprice"]) + ",\n"
          + _p_sql("asymptotic") + """
SELECT n_ref, n_cur, round(p_value, 6) AS p_value, p_value < 0.05 AS drift_detected,
       CASE WHEN p_value < 0.05 THEN 'Retrain model' ELSE 'No action needed' END AS recommendation
FROM PV""")
def drift_near_identical(spark, sf_dir):
    """DRF2-3: a table against itself with only its largest value changed."""
    ref = regression_table(spark, sf_dir).select("l_extendedprice")
    top = ref.select(F.max("l_extendedprice")).scalar()
    cur = ref.select(F.when(F.col("l_extendedprice") == top, F.col("l_extendedprice") + 1000)
                     .otherwise(F.col("l_extendedprice")).alias("l_extendedprice"))
    p = D.ks_pvalue(D.ks_statistic(ref, cur))
    verdict = D.drift_report(ref, cur, "housing").withColumn("feature", F.lit("l_extendedprice"))
    return p.join(verdict, "feature").select("n_ref", "n_cur", r("p_value", 6).alias("p_value"),
                                  "drift_detected", "recommendation")


@register("gauge_drift", "WITH " + _ks_sql(_H_REF, _H_CUR, H_FEATURES) + ",\n" + _p_sql("asymptotic") + """
SELECT 'model_drift_score' AS metric, 'housing' AS model_name, round(avg(p_value), 6) AS value FROM PV
UNION ALL
SELECT 'model_drift_detected', 'housing', CASE WHEN avg(p_value) < 0.05 THEN 1.0 ELSE 0.0 END FROM PV""")
def gauge_drift(spark, sf_dir):
    """TS7: drift score and drift flag of a model as gauges, fed by DRF3."""
    ref, cur = h_halves(spark, sf_dir)
    rep = D.drift_report(ref, cur, "housing", 0.05).select(
        "model_name", r("drift_score", 6).alias("model_drift_score"),
        F.col("drift_detected").cast("double").alias("model_drift_detected"))
    return rep.unpivot(["model_name"], ["model_drift_score", "model_drift_detected"], "metric",
                       "value").select("metric", "model_name", "value")


def _daily_success(spark, sf_dir):
    log = prediction_log(spark, sf_dir)
    return log.groupBy("model_name", F.to_date("ts").alias("day")).agg(
        (F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("value"))


@register("performance_drop", f"""WITH {P_CTE},
DS AS (SELECT model_name, CAST(ts AS DATE) AS day,
              count(*) FILTER (WHERE status = 'success') / count(*) AS value FROM P GROUP BY ALL),
LAST AS (SELECT max(day) AS d FROM DS),
H AS (SELECT model_name, arg_max(value, day) AS historical FROM DS, LAST WHERE day < LAST.d GROUP BY model_name),
C AS (SELECT model_name, value AS current FROM DS, LAST WHERE day = LAST.d)
SELECT C.model_name, 'accuracy' AS metric, round(current, 6) AS current, round(historical, 6) AS historical,
       CAST(0.05 AS DOUBLE) AS threshold, coalesce(historical - current > 0.05, false) AS dropped
FROM C LEFT JOIN H USING (model_name)""")
def performance_drop(spark, sf_dir):
    """History = daily success share per model before the last day; current =
    the last day's share."""
    # days x models rows: frozen once, read three times
    ds = _daily_success(spark, sf_dir).withColumn("metric", F.lit("accuracy")).transform(freeze)
    last = ds.select(F.max("day")).scalar()
    hist = ds.where(F.col("day") < last).select("model_name", "metric", "value",
                                                 F.col("day").alias("ts"))
    cur = ds.where(F.col("day") == last).select("model_name", "metric", "value")
    out = D.performance_drop(hist, cur)
    return out.select("model_name", "metric", r("current", 6).alias("current"),
                      r("historical", 6).alias("historical"), "threshold", "dropped")


H_CSV_SCHEMA = ("l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string")


@register("drift_job_csv", "WITH " + _ks_sql(_H_REF, _H_CUR, H_FEATURES) + ",\n" + _p_sql("asymptotic") + """
SELECT 'housing' AS model_name, coalesce(avg(p_value) < 0.05, false) AS drift_detected,
       round(avg(p_value), 6) AS drift_score,
       coalesce(array_to_string(list_sort(list(feature) FILTER (WHERE p_value < 0.05)), ','), '')
         AS features_with_drift,
       CASE WHEN coalesce(avg(p_value) < 0.05, false) THEN 'Retrain model' ELSE 'No action needed' END
         AS recommendation,
       'l_returnflag' AS skipped_features, CAST(0.05 AS DOUBLE) AS threshold
FROM PV
UNION ALL
SELECT 'missing', false, 0.0, '', 'Error in drift detection', '', CAST(0.05 AS DOUBLE)""")
def drift_job_csv(spark, sf_dir):
    """DRF3 served as a job over two CSV files (written from the lineitem
    halves); a second run against a missing file returns the error verdict."""
    from quarry.plans.drift_job import drift_job
    from quarry.session import scratch_path
    ref, cur = h_halves(spark, sf_dir)
    root = scratch_path(spark, "drift")
    ref.write.mode("overwrite").option("header", True).csv(f"{root}/reference")
    cur.write.mode("overwrite").option("header", True).csv(f"{root}/current")
    ok = drift_job(spark, f"{root}/reference", f"{root}/current", H_CSV_SCHEMA, "housing")
    bad = drift_job(spark, f"{root}/reference", f"{root}/absent", H_CSV_SCHEMA, "missing")
    return ok.withColumn("drift_score", r("drift_score", 6)).unionByName(bad)
