"""Request rule sets on the reference's valid / invalid examples (FIXTURES A1, A2)."""
from quarry.functions import rules as R
from quarry.operators import validate as V

# fixed values: the field names and the valid / invalid example records
REG_COLS = "MedInc double, HouseAge double, AveRooms double, AveBedrms double, Population double, " \
           "AveOccup double, Latitude double, Longitude double"


def test_regression_request_rules(spark):
    df = spark.createDataFrame([
        (8.3252, 41.0, 6.984127, 1.023810, 322.0, 2.555556, 37.88, -122.23),
        (100.0, 150.0, 0.5, 0.1, 50000.0, 100.0, 50.0, -100.0),
    ], REG_COLS)
    out = V.apply_rules(df, R.regression_request_rules()).collect()
    assert out[0].violations == []
    bad = set(out[1].violations)
    # every field breaks a rule
    for f in ["MedInc", "HouseAge", "AveRooms", "AveBedrms", "Population", "AveOccup",
              "Latitude", "Longitude"]:
        assert any(v.startswith(f) for v in bad), f


def test_class_request_rules_and_cross_field(spark):
    cols = "sepal_length double, sepal_width double, petal_length double, petal_width double"
    df = spark.createDataFrame([(5.1, 3.5, 1.4, 0.2), (15.0, 20.0, 0.1, 25.0), (3.0, 4.0, 1.0, 0.5)], cols)
    rows = V.apply_rules(df, R.class_request_rules()).collect()
    assert rows[0].violations == []
    assert set(rows[1].violations) >= {"sepal_length_range", "sepal_width_range", "petal_width_range"}
    assert "petal_length_range" not in rows[1].violations
    assert rows[2].violations == ["sepal_length_lt_width"]
    no_cross = V.apply_rules(df, R.class_request_rules(), include_cross_field=False).collect()
    assert no_cross[2].violations == []


def test_missing_and_wrong_type_field(spark):
    df = spark.createDataFrame([(None, 41.0)], "MedInc double, HouseAge double")
    rows = V.apply_rules(df, [R.bounds("MedInc", gt=0)]).collect()
    assert rows[0].violations == ["MedInc_range"]


def test_table_checks_nan_inf(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (float("inf"), None)], "x double, t string")
    res = {(r.check, r.column_name): r.failures for r in V.table_checks(df, ["x", "y"], "t", ["a"]).collect()}
    assert res[("missing", "x")] == 1 and res[("missing", "t")] == 1
    assert res[("infinite", "x")] == 1
    assert res[("required_column", "y")] == 1 and res[("required_column", "x")] == 0
    assert res[("target_values", "t")] == 1
    assert V.table_is_valid(V.table_checks(df)).first().valid is False
