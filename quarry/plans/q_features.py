"""Feature queries (PRJ, MAP, ARI, OUT, STD, BIN, PIP1-3)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import r
from quarry.operators import features as X
from quarry.plans import prepare as PP
from quarry.plans.catalog import register
from quarry.session import scratch_path
from quarry.sources.tables import as_wall_clock, class_table, read_table, regression_table

H_RENAME = {"l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount",
            "l_tax": "tax"}


@register("rename_select", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS quantity,
       l_discount AS discount, l_tax AS tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem""")
def rename_select(spark, sf_dir):
    h = X.rename(regression_table(spark, sf_dir), H_RENAME)
    feats, _ = X.split_target(h, "price")
    return feats.withColumn("l_shipdate", as_wall_clock("l_shipdate"))


@register("numeric_features", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part""")
def numeric_features(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return X.to_double(X.numeric_only(part, keep=["p_partkey"]), ["p_size"])


_SPECIES_SQL = ("CASE label WHEN 0 THEN 'setosa' WHEN 1 THEN 'versicolor' "
                "WHEN 2 THEN 'virginica' END")


@register("label_map", f"SELECT vec_id, label, {_SPECIES_SQL} AS species FROM embeddings")
def label_map(spark, sf_dir):
    c = class_table(spark, sf_dir)
    return c.select("vec_id", "label", X.map_values("label", PP.SPECIES).alias("species"))


@register("label_map_fallback", f"""
SELECT vec_id, label, coalesce({_SPECIES_SQL}, 'class_' || CAST(label AS VARCHAR)) AS species
FROM embeddings""")
def label_map_fallback(spark, sf_dir):
    c = class_table(spark, sf_dir)
    return c.select("vec_id", "label", X.map_with_fallback("label", PP.SPECIES).alias("species"))


@register("products", """
SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS gross,
       round(l_discount * l_tax, 6) AS discount_tax
FROM lineitem""")
def products(spark, sf_dir):
    h = X.products(regression_table(spark, sf_dir),
                   [("l_quantity", "l_extendedprice", "gross"), ("l_discount", "l_tax", "discount_tax")])
    return h.select("l_orderkey", "l_linenumber", r("gross", 4).alias("gross"),
                    r("discount_tax", 6).alias("discount_tax"))


@register("safe_ratio", """
WITH R AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS price_per_discount,
         CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS tax_per_discount
  FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round(coalesce(price_per_discount, (SELECT avg(price_per_discount) FROM R)), 4)
         AS price_per_discount,
       round(coalesce(tax_per_discount, (SELECT avg(tax_per_discount) FROM R)), 6)
         AS tax_per_discount
FROM R""")
def safe_ratio(spark, sf_dir):
    h = X.safe_ratios(regression_table(spark, sf_dir),
                      [("l_extendedprice", "l_discount", "price_per_discount"),
                       ("l_tax", "l_discount", "tax_per_discount")])
    return h.select("l_orderkey", "l_linenumber", r("price_per_discount", 4).alias("price_per_discount"),
                    r("tax_per_discount", 6).alias("tax_per_discount"))


@register("square_norm", """
SELECT l_orderkey, l_linenumber, round(pow(l_quantity, 2), 4) AS quantity_squared,
       round(sqrt(l_discount * l_discount + l_tax * l_tax), 6) AS discount_tax_norm
FROM lineitem""")
def square_norm(spark, sf_dir):
    h = X.squares(regression_table(spark, sf_dir), [("l_quantity", "quantity_squared")])
    h = X.norms(h, [("l_discount", "l_tax", "discount_tax_norm")])
    return h.select("l_orderkey", "l_linenumber", r("quantity_squared", 4).alias("quantity_squared"),
                    r("discount_tax_norm", 6).alias("discount_tax_norm"))


CLIP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _clip_sql(table: str, cols: list[str], key_cols: str) -> str:
    b = ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi"
        for c in cols)
    sel = ", ".join(f"0.0 + round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {c}_lo), {c}_hi) END, 6) AS {c}"
                    for c in cols)
    return f"WITH B AS (SELECT {b} FROM {table})\nSELECT {key_cols}, {sel} FROM {table}, B"


@register("iqr_clip", _clip_sql("orders", ["o_totalprice"], "o_orderkey"))
def iqr_clip(spark, sf_dir):
    o = X.iqr_clip(read_table(spark, sf_dir, "orders"), ["o_totalprice"])
    return o.select("o_orderkey", r("o_totalprice", 6).alias("o_totalprice"))


@register("iqr_clip_multi", _clip_sql("lineitem", CLIP_COLS, "l_orderkey, l_linenumber"))
def iqr_clip_multi(spark, sf_dir):
    h = X.iqr_clip(regression_table(spark, sf_dir), CLIP_COLS)
    return h.select("l_orderkey", "l_linenumber", *[r(c, 6).alias(c) for c in CLIP_COLS])


@register("zscore", """
SELECT l_orderkey, l_linenumber,
  0.0 + round((l_quantity - (SELECT avg(l_quantity) FROM lineitem))
        / (SELECT stddev_samp(l_quantity) FROM lineitem), 6) AS l_quantity_zscore,
  0.0 + round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))
        / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 6) AS l_extendedprice_zscore
FROM lineitem""")
def zscore(spark, sf_dir):
    h = X.zscores(regression_table(spark, sf_dir), ["l_quantity", "l_extendedprice"])
    return h.select("l_orderkey", "l_linenumber",
                    r("l_quantity_zscore", 6).alias("l_quantity_zscore"),
                    r("l_extendedprice_zscore", 6).alias("l_extendedprice_zscore"))


@register("bucketize", """
SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN 'Low'
                        WHEN o_totalprice > 100000 AND o_totalprice <= 200000 THEN 'Medium'
                        WHEN o_totalprice > 200000 AND o_totalprice <= 300000 THEN 'High'
                        WHEN o_totalprice > 300000 THEN 'Very High' END AS price_category
FROM orders""")
def bucketize(spark, sf_dir):
    o = X.bucketize(read_table(spark, sf_dir, "orders"), "o_totalprice", PP.PRICE_EDGES,
                    PP.PRICE_LABELS, "price_category")
    return o.select("o_orderkey", "price_category")


# --- composite chains on the stand-in tables --------------------------------

def class_raw(spark, sf_dir):
    """C in the raw 3-class layout: four measurement columns + target."""
    c = class_table(spark, sf_dir)
    raw = list(PP.CLASS_RENAME)[:4]
    return c.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n)
                                for i, n in enumerate(raw)],
                    F.col("label").alias("target"))


_CLASS_OUT = ["sepal_area", "petal_area", "sepal_petal_ratio", "sepal_length_zscore",
              "petal_length_zscore"]


@register("class_prepare", f"""
WITH C AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS sl, CAST(embedding[2] AS DOUBLE) AS sw,
         CAST(embedding[3] AS DOUBLE) AS pl, CAST(embedding[4] AS DOUBLE) AS pw, label AS target
  FROM embeddings),
A AS (SELECT *, sl * sw AS sepal_area, pl * pw AS petal_area,
             CASE WHEN pl * pw <> 0 THEN (sl * sw) / (pl * pw) END AS raw_ratio FROM C)
SELECT vec_id, target, {_SPECIES_SQL.replace('label', 'target')} AS species,
       0.0 + round(sepal_area, 6) AS sepal_area, 0.0 + round(petal_area, 6) AS petal_area,
       0.0 + round(coalesce(raw_ratio, (SELECT avg(raw_ratio) FROM A)), 4) AS sepal_petal_ratio,
       0.0 + round((sl - (SELECT avg(sl) FROM A)) / (SELECT stddev_samp(sl) FROM A), 6) AS sepal_length_zscore,
       0.0 + round((pl - (SELECT avg(pl) FROM A)) / (SELECT stddev_samp(pl) FROM A), 6) AS petal_length_zscore
FROM A""")
def class_prepare(spark, sf_dir):
    out = PP.class_chain(class_raw(spark, sf_dir))
    digits = {"sepal_petal_ratio": 4}
    return out.select("vec_id", "target", "species",
                      *[r(c, digits.get(c, 6)).alias(c) for c in _CLASS_OUT])


# stand-in spec: lineitem in the regression layout
H_SPEC = PP.RegressionSpec(
    clip_cols=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    products=(("l_quantity", "l_discount", "discounted_units"),),
    ratios=(("l_extendedprice", "l_discount", "price_per_discount"),
            ("l_tax", "l_discount", "tax_per_discount")),
    squares=(("l_quantity", "quantity_squared"),),
    norms=(("l_discount", "l_tax", "discount_tax_norm"),),
    interactions=(("l_discount", "l_tax", "discount_tax_interaction"),),
    zscore_cols=("l_quantity", "l_extendedprice"),
    bucket_col="l_extendedprice",
    bucket_edges=(0, 25000, 50000, 75000, float("inf")),
    bucket_labels=tuple(PP.PRICE_LABELS),
    bucket_name="price_category",
    target="l_extendedprice",
)

_REG_OUT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "discounted_units",
            "price_per_discount", "tax_per_discount", "quantity_squared", "discount_tax_norm",
            "discount_tax_interaction", "l_quantity_zscore", "l_extendedprice_zscore"]


def _regression_sql() -> str:
    cols = list(H_SPEC.clip_cols)
    b = ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi"
        for c in cols)
    k = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {c}_lo), {c}_hi) END AS {c}"
                  for c in cols)
    return f"""WITH B AS (SELECT {b} FROM lineitem),
K AS (SELECT l_orderkey, l_linenumber, {k} FROM lineitem, B),
R AS (SELECT *, l_quantity * l_discount AS discounted_units,
             CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS rp,
             CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS rt FROM K)
SELECT l_orderkey, l_linenumber,
  0.0 + round(l_quantity, 6) AS l_quantity, 0.0 + round(l_extendedprice, 6) AS l_extendedprice,
  0.0 + round(l_discount, 6) AS l_discount, 0.0 + round(l_tax, 6) AS l_tax,
  0.0 + round(discounted_units, 6) AS discounted_units,
  0.0 + round(coalesce(rp, (SELECT avg(rp) FROM R)), 6) AS price_per_discount,
  0.0 + round(coalesce(rt, (SELECT avg(rt) FROM R)), 6) AS tax_per_discount,
  0.0 + round(pow(l_quantity, 2), 6) AS quantity_squared,
  0.0 + round(sqrt(l_discount * l_discount + l_tax * l_tax), 6) AS discount_tax_norm,
  0.0 + round(l_discount * l_tax, 6) AS discount_tax_interaction,
  0.0 + round((l_quantity - (SELECT avg(l_quantity) FROM R)) / (SELECT stddev_samp(l_quantity) FROM R), 6)
    AS l_quantity_zscore,
  0.0 + round((l_extendedprice - (SELECT avg(l_extendedprice) FROM R))
        / (SELECT stddev_samp(l_extendedprice) FROM R), 6) AS l_extendedprice_zscore,
  CASE WHEN l_extendedprice > 0 AND l_extendedprice <= 25000 THEN 'Low'
       WHEN l_extendedprice > 25000 AND l_extendedprice <= 50000 THEN 'Medium'
       WHEN l_extendedprice > 50000 AND l_extendedprice <= 75000 THEN 'High'
       WHEN l_extendedprice > 75000 THEN 'Very High' END AS price_category
FROM R"""


@register("regression_prepare", _regression_sql())
def regression_prepare(spark, sf_dir):
    out = PP.regression_chain(regression_table(spark, sf_dir), H_SPEC)
    return out.select("l_orderkey", "l_linenumber", *[r(c, 6).alias(c) for c in _REG_OUT],
                      "price_category")


@register("prepare_saved", """
SELECT 'raw' AS copy, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS total FROM lineitem
UNION ALL
SELECT 'processed', count(*), NULL FROM lineitem""")
def prepare_saved(spark, sf_dir):
    """PIP3: load by name, prepare, save the raw / processed pair, read both back."""
    spec = H_SPEC
    _, (raw, done) = PP.prepare_named(
        spark, "lineitem", {"lineitem": (f"{sf_dir.rstrip('/')}/lineitem.parquet", "parquet")},
        scratch_path(spark, "prepare"), kind="regression", key="l_orderkey",
        target="l_extendedprice", regression_spec=spec, required_columns=list(H_RENAME))
    read = spark.read.parquet
    total = F.round(F.sum("l_extendedprice"), 2)
    return read(raw).agg(F.lit("raw").alias("copy"), F.count("*").alias("n_rows"),
                         total.alias("total")).unionByName(
        read(done).agg(F.lit("processed").alias("copy"), F.count("*").alias("n_rows"),
                       F.lit(None).cast("double").alias("total")))


def _prepare_sql() -> str:
    rows = _regression_sql().replace("SELECT l_orderkey, l_linenumber,",
                                     "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,")
    stats = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
             "p25": "quantile_cont({c}, 0.25)", "p50": "quantile_cont({c}, 0.5)",
             "p75": "quantile_cont({c}, 0.75)", "max": "max({c})"}
    each = "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, " + ", ".join(
            f"0.0 + round(CAST({s.format(c=f'CAST({f} AS DOUBLE)')} AS DOUBLE), 4) AS {n}" for n, s in stats.items())
        + " FROM F" for f in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_REG_OUT])
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey)"
    return f"""WITH F AS ({rows}),
T AS (SELECT count(*) FILTER (('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT < {int(0.2 * 2 ** 32)})
        AS test_rows, count(*) AS n FROM lineitem),
E AS ({each})
SELECT E.*, T.test_rows, T.n - T.test_rows AS train_rows FROM E, T"""


@register("prepare_report", _prepare_sql())
def prepare_report(spark, sf_dir):
    """PIP3: validate -> preprocess -> profile -> split -> scale on H; the
    processed table's profile plus train/test scaled row counts."""
    h = regression_table(spark, sf_dir).withColumn(
        "row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    prep = PP.prepare(h, "regression", key="row_key", target="l_extendedprice",
                      regression_spec=H_SPEC, required_columns=list(H_RENAME))
    summ = prep.summary.select("feature", *[r(F.col(c).cast("double"), 4).alias(c)
                                            for c in ["count", "mean", "std", "min", "p25",
                                                      "p50", "p75", "max"]])
    return summ.withColumn("test_rows", prep.test.select(F.count(F.lit(1))).scalar()) \
               .withColumn("train_rows", prep.train.select(F.count(F.lit(1))).scalar())

