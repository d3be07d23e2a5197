"""Profiling queries (AGG1-7) over the regression table H (lineitem) and orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import r
from quarry.operators import profile as P
from quarry.plans.catalog import register
from quarry.sources.tables import read_table, regression_table

H_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax"]
H_ALL = H_NUMERIC + ["l_returnflag", "l_linestatus", "l_shipdate"]


def _summary_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({x}), 4) AS mean, "
            f"round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, "
            f"round(quantile_cont({x}, 0.25), 4) AS p25, round(quantile_cont({x}, 0.5), 4) AS p50, "
            f"round(quantile_cont({x}, 0.75), 4) AS p75, round(max({x}), 4) AS max FROM {table}")
    return "\nUNION ALL\n".join(parts)


def _round_all(df, skip=()):
    return df.select(*[c if c in skip or t not in ("double", "float") else r(c, 4).alias(c)
                       for c, t in df.dtypes])


@register("numeric_summary", _summary_sql("lineitem", H_NUMERIC))
def numeric_summary(spark, sf_dir):
    return _round_all(P.numeric_summary(regression_table(spark, sf_dir), H_NUMERIC))


@register("missing_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL"
    + (f" OR isnan({c})" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else "")
    + f") AS missing FROM lineitem" for c in H_ALL))
def missing_counts(spark, sf_dir):
    return P.missing_counts(regression_table(spark, sf_dir), H_ALL)


@register("category_counts", """
SELECT o_orderpriority, count(*) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def category_counts(spark, sf_dir):
    return P.category_counts(read_table(spark, sf_dir, "orders"), "o_orderpriority")


@register("target_summary", """
SELECT round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median,
       round(stddev_samp(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min,
       round(max(l_extendedprice), 4) AS max
FROM lineitem""")
def target_summary(spark, sf_dir):
    return _round_all(P.target_summary(regression_table(spark, sf_dir), "l_extendedprice"))


@register("shape_types", """
SELECT CAST(c.ordinal AS INTEGER) AS ordinal, c.column_name, c.data_type,
       (SELECT count(*) FROM orders) AS n_rows, CAST(6 AS INTEGER) AS n_columns
FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'),
             (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp'),
             (5, 'o_orderpriority', 'string')) c(ordinal, column_name, data_type)""")
def shape_types(spark, sf_dir):
    return P.shape_types(read_table(spark, sf_dir, "orders"))


@register("distinct_values", "SELECT DISTINCT o_orderstatus FROM orders")
def distinct_values(spark, sf_dir):
    return P.distinct_values(read_table(spark, sf_dir, "orders"), "o_orderstatus")


#: Columns of the profiled table with their types.
_COLUMNS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
            "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}


def _report_sql() -> str:
    def row(section, name, stat, value, label="NULL"):
        return (f"SELECT '{section}' AS section, '{name}' AS name, '{stat}' AS stat, "
                f"round(CAST({value} AS DOUBLE), 4) AS value, {label} AS label FROM lineitem")

    stats = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
             "max": "max({c})", "p25": "quantile_cont({c}, 0.25)", "p50": "quantile_cont({c}, 0.5)",
             "p75": "quantile_cont({c}, 0.75)"}
    rows = [f"SELECT 'columns', '{c}', 'ordinal', {i}::DOUBLE, '{t}'" for i, (c, t) in enumerate(_COLUMNS.items())]
    rows.append(row("shape", "table", "rows", "count(*)"))
    rows += [row("missing", c, "missing", f"count(*) FILTER ({c} IS NULL)") for c in _COLUMNS]
    rows += [row("numeric", c, k, v.format(c=f"CAST({c} AS DOUBLE)")) for c, t in _COLUMNS.items()
             if t in ("bigint", "int", "double") for k, v in stats.items()]
    target = "l_extendedprice"
    rows += [row("target", target, n, stats[k].format(c=target)) for n, k in (
        ("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"), ("median", "p50"))]
    rows += [row("categories", c, "count", "count(*)", c) + f" WHERE {c} IS NOT NULL GROUP BY {c}"
             for c in ("l_returnflag", "l_linestatus")]
    union = "\nUNION ALL\n".join(rows)
    return f"SELECT *, 'lineitem' AS dataset FROM (\n{union}) t(section, name, stat, value, label)"


@register("profile_report", _report_sql())
def profile_report(spark, sf_dir):
    rep = P.profile_report(regression_table(spark, sf_dir), "lineitem",
                           target="l_extendedprice", categorical=["l_returnflag", "l_linestatus"])
    return rep.withColumn("value", F.round("value", 4))
