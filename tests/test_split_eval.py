"""Split properties and evaluation metrics."""
import numpy as np
from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.operators import split as SP
from quarry.sources.tables import read_table
from constants import SF


def test_hash_split_is_partition_independent(spark):
    o = read_table(spark, SF, "orders")
    a = SP.hash_split(o.repartition(3), "o_orderkey").where("is_test").select("o_orderkey")
    b = SP.hash_split(o.repartition(17), "o_orderkey").where("is_test").select("o_orderkey")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    tagged = SP.hash_split(o, "o_orderkey")
    assert tagged.count() == o.count()  # disjoint + complete


def test_stratified_quota(spark):
    c = read_table(spark, SF, "embeddings")
    s = SP.stratified_split(c, "vec_id", "label", 0.2)
    per = s.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    for r in per:
        assert r.t == int(np.floor(r.n * 0.2 + 0.5))


def test_confusion_matrix_and_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 2), (1, 0)], "y int, p int")
    cm = E.confusion_matrix(df, "y", "p").collect()
    assert len(cm) == 9 and sum(r.n for r in cm) == 5
    df2 = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "y int, p int")
    pc = {r.label: r for r in E.per_class(E.pair_counts(df2, "y", "p")).collect()}
    assert pc["1"].precision == 0.0 and pc["1"].f1 == 0.0
    m = E.classification_metrics(df2, "y", "p").first()
    assert abs(m.accuracy - 1 / 3) < 1e-12


def test_regression_metrics_numpy(spark):
    y = np.array([1.0, 2.0, 0.0, 4.0])
    p = np.array([1.5, 1.0, 0.5, 4.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    m = E.regression_metrics(df, "y", "p").first()
    assert abs(m.rmse - np.sqrt(np.mean((y - p) ** 2))) < 1e-12
    assert abs(m.r2_score - (1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))) < 1e-12
    assert m.mape_undefined == 1


def test_forests_grow_as_deep_as_the_tree(spark):
    """A checkerboard needs many levels; trees of full depth learn it."""
    from quarry.operators import train as TR

    rows = [(float(a), float(b), float((a + b) % 2)) for a in range(16) for b in range(16)] * 4
    df = spark.createDataFrame(rows, "a double, b double, y double")
    for make in (TR.random_forest_classifier, TR.random_forest_regressor):
        model = make("y", ["a", "b"], numTrees=3).fit(df)
        scored = model.transform(df)
        assert scored.where(F.abs(F.col("y") - F.col("prediction")) < 0.5).count() > 0.97 * len(rows)


def test_passes_read_equal_rows_once(spark):
    """Fits that pass over their rows again and again get rows with equal
    features and label once, with their number; the fit is the same."""
    from quarry.operators import train as TR

    df = spark.range(4000).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"),
                                  (F.col("id") % 10 + 2 * (F.col("id") % 4) > 7).cast("double").alias("label"))
    pipe = TR.logistic_regression("label", ["a", "b"], n_rows=4000)
    same, rows = TR._for_passes(pipe, df, ["a", "b"], "label")
    assert rows.count() == 20 and rows.agg(F.sum("rows_alike")).first()[0] == 4000
    assert rows.rdd.getNumPartitions() == 1 and not pipe.getStages()[-1].isSet("weightCol")
    got, want = TR.fit(pipe, df, "label").stages[-1], pipe.fit(df).stages[-1]
    assert np.allclose(got.coefficientMatrix.toArray(), want.coefficientMatrix.toArray(), rtol=1e-3)
    svc = TR.fit(TR.linear_svc_ovr("label", ["a", "b"]), df, "label")
    assert TR.score(svc, df).where("label = prediction").count() > 3800
    # few equal rows: none are merged
    assert TR._for_passes(pipe, df.withColumn("a", F.rand(1)), ["a", "b"], "label")[1].columns == ["a", "b", "label"]
