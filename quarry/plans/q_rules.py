"""Validation queries (VAL1-10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.operators import validate as V
from quarry.plans.catalog import register
from quarry.sources.tables import class_table, prediction_log, read_table, regression_table

# --- VAL1-5 on customer -----------------------------------------------------

CUST_REQUIRED = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_phone"]
CUST_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _table_checks_sql() -> str:
    rows = []
    for c in CUST_COLS:
        miss = f"{c} IS NULL" + (f" OR isnan({c})" if c == "c_acctbal" else "")
        rows.append(f"SELECT 'missing' AS \"check\", '{c}' AS column_name, 'error' AS severity, "
                    f"count(*) FILTER (WHERE {miss}) AS failures FROM customer")
    rows.append("SELECT 'infinite', 'c_acctbal', 'error', "
                "count(*) FILTER (WHERE abs(c_acctbal) = 'inf'::DOUBLE) FROM customer")
    for c in CUST_REQUIRED:
        rows.append(f"SELECT 'required_column', '{c}', 'error', "
                    f"CAST({0 if c in CUST_COLS else 1} AS BIGINT)")
    segs = ", ".join(f"'{s}'" for s in CUST_SEGMENTS)
    rows.append(f"SELECT 'target_values', 'c_mktsegment', 'error', "
                f"count(*) FILTER (WHERE c_mktsegment NOT IN ({segs})) FROM customer")
    rows.append("SELECT 'above_limit', 'c_acctbal', 'warn', "
                "count(*) FILTER (WHERE c_acctbal > 9000) FROM customer")
    rows.append("SELECT 'negative', 'c_acctbal', 'warn', "
                "count(*) FILTER (WHERE c_acctbal < 0) FROM customer")
    return ("SELECT *, failures = 0 AS passed FROM (\n" + "\nUNION ALL\n".join(rows) + ")")


@register("table_checks", _table_checks_sql())
def table_checks(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer")
    return V.table_checks(cust, required_columns=CUST_REQUIRED, target="c_mktsegment",
                          allowed_targets=CUST_SEGMENTS, warn_above={"c_acctbal": 9000.0},
                          warn_negative=["c_acctbal"])


# --- row rules ------------------------------------------------------------------

def _sql_ids(rules, severity="error") -> str:
    parts = [f"CASE WHEN {r.violated_when.replace('`', chr(34))} THEN '{r.rule_id}' END"
             for r in rules if r.severity == severity]
    if not parts:
        return "''"
    return f"concat_ws(',', {', '.join(parts)})"


def _joined(df):
    return df.withColumns({"violations": F.array_join("violations", ","),
                           "warnings": F.array_join("warnings", ",")})


H_RULES = [
    R.bounds("l_quantity", gt=0, le=50),
    R.bounds("l_discount", ge=0, le=0.1),
    R.bounds("l_tax", ge=0, le=0.08),
    R.limit("l_quantity", "<", 2, "quantity_below_2"),
    R.limit("l_extendedprice", ">", 100000, "price_above_100000"),
    R.limit("l_discount", ">", 0.09, "discount_above_0.09", severity="warn"),
]


@register("row_rules", f"""
SELECT l_orderkey, l_linenumber, {_sql_ids(H_RULES)} AS violations,
       {_sql_ids(H_RULES, 'warn')} AS warnings
FROM lineitem""")
def row_rules(spark, sf_dir):
    h = regression_table(spark, sf_dir)
    return _joined(V.apply_rules(h, H_RULES)).select("l_orderkey", "l_linenumber", "violations",
                                                      "warnings")


#: Stand-ins for the request fields, in ranges that break every rule somewhere.
REQUEST_FIELDS = {
    "MedInc": "l_extendedprice / 1800 - 1", "HouseAge": "l_quantity * 2.2 - 3",
    "AveRooms": "l_quantity / 2", "AveBedrms": "l_discount * 105",
    "Population": "l_partkey * 6.0", "AveOccup": "l_tax * 700",
    "Latitude": "31 + l_quantity / 4", "Longitude": "-126 + l_quantity / 4"}
_REQUEST_SQL = ", ".join(f"{e} AS {c}" for c, e in REQUEST_FIELDS.items())


@register("request_rules", f"""
SELECT l_orderkey, l_linenumber, {_sql_ids(R.regression_request_rules())} AS violations
FROM (SELECT l_orderkey, l_linenumber, {_REQUEST_SQL} FROM lineitem)""")
def request_rules(spark, sf_dir):
    """VAL6: the fixed rules of regression requests, custom limits included."""
    h = regression_table(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", *[F.expr(e).alias(c) for c, e in REQUEST_FIELDS.items()])
    return _joined(V.apply_rules(h, R.regression_request_rules())).select(
        "l_orderkey", "l_linenumber", "violations")


PART_RULES = [
    R.bounds("p_size", ge=1, le=40),
    R.bounds("p_retailprice", gt=900, le=990),
    R.Rule("brand_format", "p_brand", "NOT (p_brand LIKE 'Brand#%')"),
]


@register("quarantine", f"""
SELECT p_partkey, p_size, p_retailprice, violations FROM (
  SELECT p_partkey, p_size, p_retailprice, {_sql_ids(PART_RULES)} AS violations FROM part)
WHERE violations <> ''""")
def quarantine(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    _, bad = V.route(V.apply_rules(part, PART_RULES))
    return _joined(bad).select("p_partkey", "p_size", "p_retailprice", "violations")


def class_requests(spark, sf_dir):
    """3-class request records: the first four embedding dimensions of C
    stand in for the four measurements (scaled to centimetres)."""
    c = class_table(spark, sf_dir)
    names = R.CLASS_FEATURES
    return c.select("vec_id", *[(F.col("embedding")[i].cast("double") * 10 + 4).alias(n)
                                for i, n in enumerate(names)])


_CLASS_SQL_COLS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 10 + 4 AS {n}"
                            for i, n in enumerate(R.CLASS_FEATURES))


@register("cross_field_rules", f"""
SELECT vec_id, {_sql_ids(R.class_request_rules())} AS violations
FROM (SELECT vec_id, {_CLASS_SQL_COLS} FROM embeddings)""")
def cross_field_rules(spark, sf_dir):
    checked = V.apply_rules(class_requests(spark, sf_dir), R.class_request_rules())
    return _joined(checked).select("vec_id", "violations")


# job requests derived from events: one request per event
_MODEL_CYCLE = list(R.RETRAIN_MODEL_NAMES) + ["forecast"]
_TRIGGER_CYCLE = list(R.RETRAIN_TRIGGERS) + ["nightly"]


def job_requests(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    models = F.array(*[F.lit(m) for m in _MODEL_CYCLE])
    trig = F.array(*[F.lit(t) for t in _TRIGGER_CYCLE])
    return ev.select(
        F.col("event_id").alias("request_id"), "ts",
        F.element_at(models, (F.col("user_id") % len(_MODEL_CYCLE) + 1).cast("int")).alias("model_name"),
        F.element_at(trig, (F.col("event_id") % len(_TRIGGER_CYCLE) + 1).cast("int")).alias("trigger_type"),
        "event_type", "value",
    )


def _job_requests_sql() -> str:
    m = ", ".join(f"'{x}'" for x in _MODEL_CYCLE)
    t = ", ".join(f"'{x}'" for x in _TRIGGER_CYCLE)
    return (f"SELECT event_id AS request_id, ts, [{m}][user_id % {len(_MODEL_CYCLE)} + 1] AS model_name, "
            f"[{t}][event_id % {len(_TRIGGER_CYCLE)} + 1] AS trigger_type, event_type, value FROM events")


@register("enum_rules", f"""
SELECT request_id, model_name, trigger_type, {_sql_ids(R.retrain_request_rules())} AS violations
FROM ({_job_requests_sql()})""")
def enum_rules(spark, sf_dir):
    checked = V.apply_rules(job_requests(spark, sf_dir), R.retrain_request_rules())
    return _joined(checked).select("request_id", "model_name", "trigger_type", "violations")


_METRIC_CYCLE = ["confidence", "accuracy", "precision", "recall", "f1_score", "threshold",
                 "rmse", "mae"]


def metric_records(spark, sf_dir):
    """Metric records derived from events: name by cycle, value (v - 20) / 100."""
    ev = read_table(spark, sf_dir, "events")
    names = F.array(*[F.lit(m) for m in _METRIC_CYCLE])
    return ev.select(
        F.col("event_id").alias("id"),
        F.element_at(names, (F.col("event_id") % len(_METRIC_CYCLE) + 1).cast("int")).alias("metric_name"),
        ((F.col("value") - 20) / 100).alias("metric_value"),
    )


@register("metric_rules", f"""
SELECT id, metric_name, {_sql_ids(R.metric_record_rules())} AS violations
FROM (SELECT event_id AS id,
             [{', '.join(repr(m) for m in _METRIC_CYCLE)}][event_id % {len(_METRIC_CYCLE)} + 1] AS metric_name,
             (value - 20) / 100 AS metric_value FROM events)""")
def metric_rules(spark, sf_dir):
    checked = V.apply_rules(metric_records(spark, sf_dir), R.metric_record_rules())
    return _joined(checked).select("id", "metric_name", "violations")


@register("confidence_rules", f"""
WITH P AS (SELECT event_id AS id,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS confidence FROM events)
SELECT id, {_sql_ids([R.bounds('confidence', ge=0.0, le=1.0, required=False)])} AS violations FROM P""")
def confidence_rules(spark, sf_dir):
    """VAL9 on the serving log: optional confidence within [0, 1]."""
    log = prediction_log(spark, sf_dir)
    rules = [R.bounds("confidence", ge=0.0, le=1.0, required=False)]
    return _joined(V.apply_rules(log, rules)).select("id", "violations")
