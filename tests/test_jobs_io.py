"""Job state, registry versions, fingerprints, routed writes, trailing windows."""
import datetime as dt

from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.operators import jobs as J
from quarry.operators import servelog as S
from quarry.operators import train as TR
from quarry.operators import validate as V
from quarry.sources import files as IO
from quarry.sources.registry import Registry


def test_events_from_requests_and_latest_state(spark):
    t = dt.datetime(2024, 1, 1, 10, 0, 0)
    req = spark.createDataFrame([
        (1, t, "CaliforniaHousingBestModel", "manual", 2.5, False),
        (2, t, "iris", "data_drift", 1.0, True),
        (3, t, "forecast", "manual", 1.0, False),       # unknown model: rejected
        (4, t, "housing", "nightly", 1.0, False),        # unknown trigger: rejected
    ], "request_id long, ts timestamp, model_name string, trigger_type string, d double, f boolean")
    ev = J.events_from_requests(req, F.col("d"), F.col("f"), F.lit("boom"))
    assert ev.count() == 6
    st = {r.model_name: r for r in J.latest_state(ev).collect()}
    assert st["housing"].status == "completed" and st["housing"].duration == 2.5
    assert st["iris"].status == "failed" and st["iris"].error == "boom"
    assert st["housing"].job_id.startswith("housing_20240101_100000_")
    cnt = {(r.model_name, r.trigger_type): r.value for r in J.retraining_counter(ev).collect()}
    assert cnt == {("housing", "manual"): 1, ("iris", "data_drift"): 1}


def test_registry_versions_increment(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "reg"))
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    model = TR.linear_regression("y", ["x"]).fit(df)
    scores = spark.createDataFrame([("r1", "lin", 0, "rmse", 0.0)],
                                   "run_id string, run_name string, candidate_order int, metric string, value double")
    reg.log_run("r1", "lin", "exp", {"a": 1}, scores.select("metric", "value"), model)
    best = TR.pick_best(scores, "rmse", False)
    reg.register("M", best)
    reg.register("M", best)
    v = reg.latest_versions().first()
    assert v.version == 2 and v.run_id == "r1"
    assert reg.latest_model_path("M", "LIN").first().source == "registry"
    assert reg.recent_runs("LIN").count() == 1
    assert reg.load(v.model_path).transform(df).count() == 20


def test_fingerprint_order_independent(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = a.orderBy(F.desc("k")).repartition(3)
    fa, fb = IO.dataset_fingerprint(a, "t").first(), IO.dataset_fingerprint(b, "t").first()
    assert (fa.hash_sum, fa.n_rows, fa.n_chars) == (fb.hash_sum, fb.n_rows, fb.n_chars)
    fx = IO.dataset_fingerprint(a.withColumn("v", F.lit("y")), "t")
    assert IO.fingerprint_changed(IO.dataset_fingerprint(a, "t"), fx).first().changed


def test_write_routed(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0)], "id int, x double")
    V.write_routed(df, [R.bounds("x", gt=0)], str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]


def test_trailing_window_is_strict(spark):
    t = dt.datetime(2024, 1, 2, 0, 0, 0)
    log = spark.createDataFrame([
        (1, t, "m", "success", 10.0), (2, t - dt.timedelta(hours=24), "m", "success", 99.0),
        (3, t - dt.timedelta(hours=1), "m", "error", 5.0)],
        "id long, ts timestamp, model_name string, status string, processing_time_ms double")
    row = S.prediction_stats(log, hours=24).first()
    assert (row.total_predictions, row.successful_predictions) == (2, 1)
    assert row.error_rate_percent == 50.0 and row.avg_processing_time_ms == 10.0
    empty = S.prediction_stats(log, hours=24, as_of="2023-01-01 00:00:00").first()
    assert empty.total_predictions == 0 and empty.error_rate_percent == 0.0


def test_prepare_fit_on_train(spark):
    from quarry.plans import prepare as PP
    from quarry.plans.q_features import H_SPEC
    from quarry.sources.tables import regression_table
    from constants import SF
    h = regression_table(spark, SF).withColumn(
        "row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    a = PP.prepare(h, "regression", "row_key", "l_extendedprice", regression_spec=H_SPEC)
    b = PP.prepare(h, "regression", "row_key", "l_extendedprice", regression_spec=H_SPEC,
                   fit_on="train")
    assert a.train.count() == b.train.count() and a.test.count() == b.test.count()
    assert a.train.count() + a.test.count() == h.count()
    # train-fitted z-scores have mean 0 on the train side
    m = b.processed.where(~F.col("is_test")).agg(F.avg("l_quantity_zscore")).first()[0]
    assert abs(m) < 1e-9


def test_score_checks_features(spark):
    import pytest
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    model = TR.linear_regression("y", ["x"]).fit(df)
    with pytest.raises(ValueError):
        TR.score(model, df.drop("x"))


def test_profile_report_sections(spark):
    from quarry.operators import profile as P
    from quarry.sources.tables import read_table
    from constants import SF
    o = read_table(spark, SF, "orders")
    rows = P.profile_report(o, "orders", target="o_totalprice",
                            categorical=["o_orderstatus"]).collect()
    by = {(r.section, r.name, r.stat): r.value for r in rows}
    n = o.count()
    assert by[("shape", "table", "rows")] == n
    assert by[("target", "o_totalprice", "median")] == by[("numeric", "o_totalprice", "p50")]
    assert sum(r.value for r in rows if r.section == "categories") == n
    assert by[("numeric", "o_totalprice", "count")] == n


def test_a_routed_batch_that_is_written_again_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0)], "id int, x double")
    ok, bad = str(tmp_path / "ok"), str(tmp_path / "bad")
    for batch in ("b1", "b1", "b2"):
        assert V.write_routed(df, [R.bounds("x", gt=0)], ok, bad, batch_id=batch) == batch
    assert spark.read.parquet(ok).count() == spark.read.parquet(bad).count() == 2
    assert V.write_routed(df, [R.bounds("x", gt=0)], ok, bad) != V.write_routed(df, [], ok, bad)


def test_malformed_csv_records_are_routed_with_reasons(spark, tmp_path):
    from quarry.sources import files as IO

    (tmp_path / "in.csv").write_text(
        'a,b,c\n1,2.5,x\nNA,NaN,y\n7,abc,"z, w"\n8\n9,1.0,q,extra\nx,y,z\n10,,\n')
    got = IO.read_csv_checked(spark, str(tmp_path / "in.csv"), "a int, b double, c string")
    rows = {(r.a, r.c): r for r in got.collect()}
    assert got.count() == 7 and rows[1, "x"].parse_errors == [] and rows[1, "x"].raw_record is None
    assert rows[None, "y"].parse_errors == [] and rows[10, None].b is None
    assert rows[7, "z, w"].parse_errors == ["b: not double"]
    broken = [r for r in rows.values() if r.parse_errors == ["record: not 3 fields"]]
    assert sorted(r.parse_errors for r in got.where("size(parse_errors) > 0").collect()) == [
        ["a: not int", "b: not double"], ["b: not double"], ["record: not 3 fields"], ["record: not 3 fields"]]
    assert len(broken) == 1 and got.where("raw_record = '9,1.0,q,extra'").count() == 1
    assert got.select("a").count() == 7  # whatever is read of them
    checked = V.check_records(got, [R.bounds("a", ge=2)])
    assert {tuple(r.violations) for r in checked.collect()} == {
        ("a_range",), (), ("b: not double",), ("record: not 3 fields",), ("a: not int", "b: not double")}


def test_malformed_json_records(spark):
    from quarry.sources import files as IO

    texts = ['{"k": 1, "s": "x"}', '{"k": "many"}', '{"k": 2', None, '{}', '[1]', '{"k": null, "s": 3}', ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r for r in IO.parse_json_checked(df, "t", "k long, s string", keep=["id"]).collect()}
    assert (got[0].k, got[0].s, got[0].parse_errors) == (1, "x", [])
    assert got[1].parse_errors == ["k: not bigint"] and got[1].raw_record == '{"k": "many"}'
    assert got[2].parse_errors == got[5].parse_errors == got[7].parse_errors == ["record: not a JSON object"]
    assert got[3].parse_errors == got[4].parse_errors == got[6].parse_errors == []
    assert got[6].s == "3" and len(got) == len(texts)


def test_two_writers_of_one_version_get_two(spark, tmp_path):
    from quarry.sources.registry import VERSIONS_SCHEMA, Registry

    reg = Registry(spark, str(tmp_path))
    t = dt.datetime(2024, 1, 1)
    asked = [("m", 1, "r1", "p1", 0.5, t), ("m", 2, "r2", "p2", 0.6, t),
             ("m", 2, "r3", "p3", 0.7, t + dt.timedelta(seconds=1)), ("n", 1, "r4", "p4", 0.1, t)]
    for row in asked:  # two of them read the same table before they wrote
        spark.createDataFrame([row], VERSIONS_SCHEMA).write.mode("append").parquet(str(tmp_path / "model_versions"))
    assert {(r.name, r.version, r.run_id) for r in reg.versions().collect()} == {
        ("m", 1, "r1"), ("m", 2, "r2"), ("m", 3, "r3"), ("n", 1, "r4")}
    assert {(r.name, r.run_id) for r in reg.latest_versions().collect()} == {("m", "r3"), ("n", "r4")}
    best = spark.createDataFrame([("r5", 0.9)], "run_id string, score double")
    assert reg.register("m", best).first().version == 4


def test_prepare_stages_once_and_fits_once(spark):
    """The processed table is read back from files by column, and the scaler's
    parameters are values, so neither side fits them again."""
    from quarry.plans import prepare as PP
    spec = PP.RegressionSpec(clip_cols=["a"], products=[], ratios=[], squares=[("a", "a2")], norms=[],
                             interactions=[], zscore_cols=["a"], bucket_col="a", bucket_edges=[0, 50, 1000],
                             bucket_labels=["low", "high"], target="y")
    df = spark.range(200).selectExpr("id", "cast(id as double) a", "cast(id % 7 as double) y")
    prep = PP.prepare(df, "regression", key="id", target="y", regression_spec=spec)
    assert prep.processed.inputFiles() and prep.processed.count() == 200
    assert prep.train.count() + prep.test.count() == 200
    assert {r.feature for r in prep.scaler_params.collect()} == {"a", "a2", "a_zscore"}
