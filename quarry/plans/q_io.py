"""Source / sink queries (SRC1-2, SNK1-4, FPR1): every write goes to a fresh
folder under the shared checkpoint directory and is read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import r
from quarry.functions import rules as R
from quarry.operators import servelog as S
from quarry.operators import validate as V
from quarry.plans.catalog import register
from quarry.plans.q_evaluate import _evaluate_all_sql, _rounded_all
from quarry.plans.sqlparts import P_CTE
from quarry.session import scratch_path
from quarry.sources import files as IO
from quarry.sources.tables import prediction_log, read_table

NATION_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"


@register("named_dataset", "SELECT vec_id, label FROM embeddings")
def named_dataset(spark, sf_dir):
    catalog = {"iris": (f"{sf_dir}/embeddings.parquet", "parquet"),
               "housing": (f"{sf_dir}/lineitem.parquet", "parquet")}
    return IO.load_dataset(spark, "iris", catalog).select("vec_id", "label")


@register("csv_roundtrip", """
SELECT n_nationkey, n_name, n_regionkey, 'raw' AS copy FROM nation
UNION ALL SELECT n_nationkey, upper(n_name), n_regionkey, 'processed' FROM nation""")
def csv_roundtrip(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation")
    processed = nation.withColumn("n_name", F.upper("n_name"))
    raw_p, proc_p = IO.save_pair(nation, processed, "nation", scratch_path(spark, "csv"), "csv")
    return IO.read_csv(spark, raw_p, NATION_SCHEMA).withColumn("copy", F.lit("raw")).unionByName(
        IO.read_csv(spark, proc_p, NATION_SCHEMA).withColumn("copy", F.lit("processed")))


@register("csv_or_default", """
SELECT n_nationkey, n_name, n_regionkey, 'default' AS source FROM nation
UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'csv' FROM nation""")
def csv_or_default(spark, sf_dir):
    """SRC2 (retraining input): a missing path falls back to the default
    dataset; an existing CSV path is read with the declared schema."""
    nation = read_table(spark, sf_dir, "nation")
    root = scratch_path(spark, "input")
    nation.write.mode("overwrite").option("header", True).csv(f"{root}/nation_csv")
    default = lambda: read_table(spark, sf_dir, "nation")
    missing = IO.read_or_default(spark, f"{root}/does_not_exist", NATION_SCHEMA, default)
    present = IO.read_or_default(spark, f"{root}/nation_csv", NATION_SCHEMA, default)
    return missing.withColumn("source", F.lit("default")).unionByName(
        present.withColumn("source", F.lit("csv")))


@register("log_append_readback", f"""WITH {P_CTE}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, model_name, status, count(*) AS n,
       round(sum(processing_time_ms), 4) AS total_ms
FROM P GROUP BY ALL""")
def log_append_readback(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    IO.append_log(prediction_log(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("event_date").cast("string").alias("event_date"), "model_name",
                        "status").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("processing_time_ms"), 4).alias("total_ms"))


@register("metric_append_readback", f"""WITH {P_CTE},
M AS (SELECT 'processing_time_ms' AS metric_name, processing_time_ms AS v FROM P
      UNION ALL SELECT 'request_count', 1.0 FROM P
      UNION ALL SELECT 'error_count', 1.0 FROM P WHERE status = 'error')
SELECT metric_name, count(*) AS n, round(avg(v), 2) AS average FROM M GROUP BY ALL""")
def metric_append_readback(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    IO.append_log(S.metric_fanout(prediction_log(spark, sf_dir)), path)
    back = spark.read.parquet(path)
    return back.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"),
                                           F.round(F.avg("metric_value"), 2).alias("average"))


@register("json_report", _evaluate_all_sql() + "\nSELECT model_name, metric, value FROM M")
def json_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    IO.write_json_report(_rounded_all(spark, sf_dir), path)
    return spark.read.schema("model_name string, metric string, value double").json(path)


_FP_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_FP_ROW = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
                      for c in _FP_COLUMNS)


@register("dataset_fingerprint", f"""
SELECT 'lineitem' AS dataset,
  CAST(sum(CAST(('0x' || substr(md5(t), 1, 16)) AS UBIGINT)) AS VARCHAR) || '-' ||
  CAST(sum(CAST(('0x' || substr(md5(t), 17, 16)) AS UBIGINT)) AS VARCHAR) AS hash_sum,
  count(*) AS n_rows, CAST(sum(length(t)) AS VARCHAR) AS n_chars
FROM (SELECT {_FP_ROW} AS t FROM lineitem)""")
def dataset_fingerprint(spark, sf_dir):
    return IO.dataset_fingerprint(read_table(spark, sf_dir, "lineitem").select(*_FP_COLUMNS),
                                  "lineitem")


@register("fingerprint_change", "SELECT true AS changed")
def fingerprint_change(spark, sf_dir):
    """FPR1 compare: lineitem and lineitem with one price changed differ."""
    h = read_table(spark, sf_dir, "lineitem")
    top = h.select(F.max("l_extendedprice")).scalar()
    other = h.withColumn("l_extendedprice", F.when(
        F.col("l_extendedprice") == top, top + 0.01).otherwise(F.col("l_extendedprice")))
    return IO.fingerprint_changed(IO.dataset_fingerprint(h, "lineitem"),
                                  IO.dataset_fingerprint(other, "lineitem"))


# --- malformed records --------------------------------------------------------------

ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string"
ORDER_RULES = [R.bounds("o_totalprice", gt=0, le=400_000), R.bounds("o_custkey", ge=1)]
_ORDER_RULES_SQL = """list_filter([
  CASE WHEN price IS NULL OR NOT (price > 0 AND price <= 400000) THEN 'o_totalprice_range' END,
  CASE WHEN cust IS NULL OR NOT (cust >= 1) THEN 'o_custkey_range' END], lambda x: x IS NOT NULL)"""


def _order_lines(spark, sf_dir):
    """Orders as CSV lines, some of them damaged: a price that is no number, a
    field too few, a key that is no whole number, a missing price."""
    o, k = read_table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.when(k % 53 == 0, F.lit("n/a!")).when(k % 59 == 0, F.lit("NA")).otherwise(
        F.col("o_totalprice").cast("string"))
    cust = F.when(k % 61 == 0, F.lit("1.5x")).otherwise(F.col("o_custkey").cast("string"))
    cells = [k.cast("string"), cust, price, F.col("o_orderstatus")]
    return o.select(F.when(k % 47 == 0, F.concat_ws(",", *cells[:3])).otherwise(
        F.concat_ws(",", *cells)).alias("value"))


_ORDER_CELLS = f"""D AS (SELECT *, o_orderkey AS k FROM orders),
C AS (SELECT k, k % 47 = 0 AS broken,
        CASE WHEN k % 61 = 0 THEN NULL ELSE o_custkey END AS cust, k % 61 = 0 AS bad_cust,
        CASE WHEN k % 53 = 0 OR k % 59 = 0 THEN NULL ELSE o_totalprice END AS price, k % 53 = 0 AS bad_price
      FROM D),
E AS (SELECT *, CASE WHEN broken THEN ['record: not 4 fields'] ELSE list_filter([
        CASE WHEN bad_cust THEN 'o_custkey: not bigint' END,
        CASE WHEN bad_price THEN 'o_totalprice: not double' END], lambda x: x IS NOT NULL) END AS errors FROM C),
V AS (SELECT *, CASE WHEN len(errors) > 0 THEN errors ELSE {_ORDER_RULES_SQL} END AS violations FROM E)"""


@register("csv_malformed", f"""WITH {_ORDER_CELLS}
SELECT CASE WHEN len(violations) > 0 THEN 'quarantine' ELSE 'valid' END AS route,
       array_to_string(violations, '; ') AS reasons, count(*) AS n,
       CAST(sum(CASE WHEN broken THEN 0 ELSE k END) AS BIGINT) AS key_sum
FROM V GROUP BY 1, 2""")
def csv_malformed(spark, sf_dir):
    """SRC2, VAL10: a CSV with damaged records; good ones are kept, bad ones
    lie in quarantine with their text and all their reasons; written twice
    under one batch id."""
    root = scratch_path(spark, "malformed")
    lines = _order_lines(spark, sf_dir)
    head = "o_orderkey,o_custkey,o_totalprice,o_orderstatus"
    lines.select(F.col("value").alias(head)).write.option("header", True).option("quote", "").csv(f"{root}/in")
    parsed = IO.read_csv_checked(spark, f"{root}/in", ORDER_SCHEMA)
    for _ in range(2):
        V.write_routed(parsed, ORDER_RULES, f"{root}/valid", f"{root}/bad", batch_id="b1")
    sides = [spark.read.parquet(f"{root}/{p}").withColumn("route", F.lit(n))
             for p, n in (("valid", "valid"), ("bad", "quarantine"))]
    both = sides[0].unionByName(sides[1])
    return both.groupBy("route", F.array_join("violations", "; ").alias("reasons")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("key_sum"))


@register("json_malformed", """
WITH E AS (SELECT event_id AS id, props, event_id % 41 = 0 AS broken, event_id % 43 = 0 AS text_k FROM events)
SELECT id, CASE WHEN NOT broken AND NOT text_k THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN broken THEN 'record: not a JSON object' WHEN text_k THEN 'k: not bigint' ELSE '' END AS reasons
FROM E""")
def json_malformed(spark, sf_dir):
    """JSN1: request records of which some are cut off and some hold a word
    where a number belongs."""
    props = F.col("props")
    damaged = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(
        F.col("event_id") % 41 == 0, F.expr("substring(props, 1, length(props) - 2)")).when(
        F.col("event_id") % 43 == 0, F.lit('{"k": "many"}')).otherwise(props).alias("request"))
    parsed = IO.parse_json_checked(damaged, "request", "k long", keep=["id"])
    return parsed.select("id", "k", F.array_join(IO.ERRORS, "; ").alias("reasons"))
