"""NULL, NaN and label types: no row lost, no bound made of NaN, no label lost
to its type."""
import math

import pytest
from pyspark.sql import functions as F

from quarry import session as S
from quarry.operators import evaluate as E
from quarry.operators import features as X
from quarry.operators import profile as P
from quarry.operators import scale as SC
from quarry.operators import train as TR

NAN = float("nan")


@pytest.fixture(scope="module")
def column(spark):
    return spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (NAN,)], "x double")


def test_nan_is_missing_everywhere(column):
    clipped = [r.x for r in X.iqr_clip(column, ["x"]).orderBy("x").collect()]
    assert clipped == [None, 1.0, 2.0, 3.0, 4.0]
    z = [r.x_zscore for r in X.zscores(column, ["x"]).collect()]
    assert z[-1] is None and all(math.isfinite(v) for v in z[:-1])
    p = SC.fit_scaler(column, ["x"]).first()
    assert p.center == 2.5 and abs(p.scale - math.sqrt(1.25)) < 1e-12
    scaled = [r.x for r in SC.apply_scaler(column, SC.fit_scaler(column, ["x"]), ["x"]).collect()]
    assert scaled[-1] is None and None not in scaled[:-1]
    t = P.target_summary(column, "x").first()
    n = P.numeric_summary(column, ["x"]).first()
    assert (t["mean"], t["median"], t["max"]) == (n["mean"], n["p50"], n["max"]) == (2.5, 2.5, 4.0)


def test_label_map_takes_model_output(spark):
    names = {0: "setosa", 1: "versicolor"}
    df = spark.createDataFrame([(1.0, 7, "1", "x"), (0.0, 0, "1.5", None), (NAN, None, "-3", "0")],
                               "d double, i int, s string, t string")
    got = df.select(*[X.map_with_fallback(c, names).alias(c) for c in "dist"]).collect()
    assert [r.d for r in got] == ["versicolor", "setosa", "NaN"]
    assert [r.i for r in got] == ["class_7", "setosa", None]
    assert [r.s for r in got] == ["versicolor", "1.5", "class_-3"]
    assert [r.t for r in got] == ["x", None, "setosa"]


def test_labels_compare_as_numbers(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 0), (2.5, 2)], "y double, p int")
    assert abs(E.classification_metrics(df.limit(2), "y", "p").first().accuracy - 1.0) < 1e-12
    assert E.confusion_matrix(df.limit(2), "y", "p").count() == 4
    assert abs(E.classification_metrics(df, "y", "p").first().accuracy - 2 / 3) < 1e-12
    with pytest.raises(TypeError):
        E.pair_counts(df.withColumn("p", F.lit("a")), "y", "p")


def test_regression_metrics_leave_unpaired_rows_out(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0), (10.0, None), (NAN, 1.0)],
                               "y double, p double")
    m = E.regression_metrics(df, "y", "p").first()
    assert (m.samples_evaluated, m.rows_unpaired, m.mape_undefined) == (3, 2, 0)
    assert abs(m.r2_score - 0.5) < 1e-12


def test_scoring_keeps_every_row(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)] + [(None, 1.0), (NAN, 1.0),
                                                                          (5.0, None)],
                               "x double, y double")
    for make in (TR.linear_regression, TR.decision_tree_regressor):
        model = TR.fit(make("y", ["x"]), df, "y")
        rows = TR.score(model, df).collect()
        assert len(rows) == 23 and sum(r.prediction is None for r in rows) == 2
        assert abs(next(r.prediction for r in rows if r.x == 5.0) - 10.0) < 1e-6
    with pytest.raises(ValueError):
        TR.score(model, df.drop("x"))


def test_candidates_that_fail_anywhere_are_reported(spark):
    df = spark.createDataFrame([(float(i), float(i % 2), None if i == 3 else 1.0 * i)
                                for i in range(40)], "x double, y double, z double")
    good = TR.Candidate("tree", lambda: TR.random_forest_classifier("y", ["x", "z"], numTrees=5))
    sized = TR.Candidate("logistic", lambda n: TR.logistic_regression("y", ["x"], n_rows=n))
    bad = TR.Candidate("bad", lambda: TR.linear_regression("y", ["absent"]))
    res = TR.train_candidates(df, df, "y", "classification", [bad, good, sized])
    assert set(res.failures) == {"bad"} and set(res.names.values()) == {"tree", "logistic"}
    assert TR.pick_best(res.scores, "accuracy", True).first().run_name in ("tree", "logistic")


def test_one_checkpoint_folder(spark):
    assert S.checkpoint_dir(spark) == S.checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    a, b = S.scratch_path(spark, "t"), S.scratch_path(spark, "t")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    kept = S.stage(spark.range(5), "t")
    assert kept.count() == 5 and S.freeze(kept).count() == 5


def test_staged_tables_can_be_removed(spark):
    with S.staged_paths() as outer:
        a = S.stage(spark.range(3), "t")
        with S.staged_paths() as inner:
            S.stage(spark.range(4), "t")
        b = S.stage(a.where("id > 0"), "t")
    S.stage(spark.range(5), "t")
    assert len(outer) == 3 and inner == outer[1:2]
    S.remove_staged(spark, outer[:2])
    assert b.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(outer[0])


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Conf(dict):
        def get(self, k, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        S.checkpoint_dir(Session())
