"""Split and scaling queries (SPL1-2, SCL1-2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import r
from quarry.operators import scale as SC
from quarry.operators import split as SP
from quarry.plans.catalog import register
from quarry.sources.tables import class_table, read_table

_TEST_CUT = int(0.2 * 2 ** 32)
_HASH_SQL = ("CAST(('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT)")
_SPLIT_SQL = f"SELECT o_orderkey, {_HASH_SQL.format(k='o_orderkey')} < {_TEST_CUT} AS is_test FROM orders"


@register("hash_split", _SPLIT_SQL)
def hash_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return SP.hash_split(o, "o_orderkey", 0.2, 42).select("o_orderkey", "is_test")


@register("stratified_split", """
SELECT vec_id, label,
       row_number() OVER (PARTITION BY label
                          ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)) || ':' || CAST(vec_id AS VARCHAR))
       <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test
FROM embeddings""")
def stratified_split(spark, sf_dir):
    c = class_table(spark, sf_dir)
    return SP.stratified_split(c, "vec_id", "label", 0.2, 42).select("vec_id", "label", "is_test")


@register("stratified_split_null_label", """
WITH E AS (SELECT vec_id, NULLIF(label, 3) AS label FROM embeddings)
SELECT vec_id, label,
       row_number() OVER (PARTITION BY label
                          ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)) || ':' || CAST(vec_id AS VARCHAR))
       <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test
FROM E""")
def stratified_split_null_label(spark, sf_dir):
    """SPL2: rows without a label are a stratum; none is lost."""
    c = class_table(spark, sf_dir).withColumn("label", F.when(F.col("label") != 3, F.col("label")))
    return SP.stratified_split(c, "vec_id", "label", 0.2, 42).select("vec_id", "label", "is_test")


SCALE_COLS = ["o_totalprice", "o_custkey"]


def _scaled(spark, sf_dir, method):
    o = SP.hash_split(read_table(spark, sf_dir, "orders"), "o_orderkey", 0.2, 42)
    params = SC.fit_scaler(o.where(~F.col("is_test")), SCALE_COLS, method)
    out = SC.apply_scaler(o, params, SCALE_COLS)
    return out.select("o_orderkey", "is_test", *[r(c, 6).alias(c) for c in SCALE_COLS])


def _scale_sql(center: str, scale: str) -> str:
    fit = ", ".join(f"{center.format(c=c)} AS {c}_c, "
                    f"CASE WHEN {scale.format(c=c)} = 0 OR {scale.format(c=c)} IS NULL THEN 1.0 "
                    f"ELSE {scale.format(c=c)} END AS {c}_s" for c in SCALE_COLS)
    sel = ", ".join(f"0.0 + round((CAST({c} AS DOUBLE) - {c}_c) / {c}_s, 6) AS {c}" for c in SCALE_COLS)
    return f"""WITH S AS ({_SPLIT_SQL.replace('SELECT o_orderkey,', 'SELECT *,')}),
FIT AS (SELECT {fit} FROM S WHERE NOT is_test)
SELECT o_orderkey, is_test, {sel} FROM S, FIT"""


@register("standard_scale", _scale_sql("avg(CAST({c} AS DOUBLE))", "stddev_pop(CAST({c} AS DOUBLE))"))
def standard_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@register("robust_scale", _scale_sql(
    "quantile_cont(CAST({c} AS DOUBLE), 0.5)",
    "(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25))"))
def robust_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@register("scaler_params", f"""
WITH S AS ({_SPLIT_SQL.replace('SELECT o_orderkey,', 'SELECT *,')})
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 4) AS center, "
    f"round(stddev_pop(CAST({c} AS DOUBLE)), 4) AS scale, 'standard' AS method "
    f"FROM S WHERE NOT is_test" for c in SCALE_COLS))
def scaler_params(spark, sf_dir):
    o = SP.hash_split(read_table(spark, sf_dir, "orders"), "o_orderkey", 0.2, 42)
    p = SC.fit_scaler(o.where(~F.col("is_test")), SCALE_COLS, "standard")
    return p.select("feature", r("center", 4).alias("center"), r("scale", 4).alias("scale"),
                    "method")
