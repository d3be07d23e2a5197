"""NULL / NaN / ANSI traps on hand-made rows."""
from pyspark.sql import functions as F

from quarry.functions.numeric import bucket_right_closed, clip, nan_to_null, safe_div
from quarry.operators import features as X

# fixed values in the tests below: bin edges and their labels


def test_safe_div_and_ratio_fill(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (4.0, 2.0), (6.0, 3.0), (None, 1.0)],
                               "a double, b double")
    out = X.safe_ratios(df, [("a", "b", "r")]).orderBy(F.col("a").asc_nulls_first()).collect()
    # x/0, 0/0 and NULL inputs all take the mean of the finite ratios (2.0)
    assert [row.r for row in out] == [2.0, 2.0, 2.0, 2.0, 2.0]
    assert df.select(safe_div("a", "b").alias("q")).where("q IS NULL").count() == 3


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.5,), (5.0,)], "x double")
    got = [r.c for r in df.select(clip("x", 1.0, 2.0).alias("c")).collect()]
    assert got == [None, 1.0, 2.0]


def test_bucket_right_closed(spark):
    edges, labels = [0, 100000, 200000, 300000, float("inf")], ["Low", "Medium", "High", "Very High"]
    df = spark.createDataFrame([(0.0,), (100000.0,), (100001.0,), (-5.0,), (1e9,)], "v double")
    got = [r.b for r in df.select(bucket_right_closed("v", edges, labels).alias("b")).collect()]
    assert got == [None, "Low", "Medium", None, "Very High"]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert [r.v for r in df.select(nan_to_null("v").alias("v")).collect()] == [None, 1.0]


def test_zscore_zero_spread_is_null(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert all(r.v_zscore is None for r in X.zscores(df, ["v"]).collect())


def test_map_fallback(spark):
    df = spark.createDataFrame([("1",), ("7",), ("abc",)], "p string")
    got = [r.s for r in df.select(X.map_with_fallback("p", {0: "setosa", 1: "versicolor"}).alias("s")).collect()]
    assert got == ["versicolor", "class_7", "abc"]
