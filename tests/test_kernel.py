"""Radial support-vector classifier: kernel, probabilities, several classes."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import kernel as K
from quarry.operators import train as TR


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    z = K.fourier_map(x, *K.fourier_weights(3, 20_000, 0.3, 5))
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.05
    again = K.fourier_weights(3, 20_000, 0.3, 5)
    assert (K.fourier_map(x, *again) == z).all()


def points(spark, n=900):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (n, 2))
    ring = np.digitize(np.hypot(*x.T), [0.8, 1.6]).astype(float) * 2 + 1  # labels 1, 3, 5
    return spark.createDataFrame([(i, *map(float, p), float(y)) for i, (p, y) in enumerate(zip(x, ring))],
                                 "id int, a double, b double, label double")


def test_rings_are_learned_with_probabilities_and_saved(spark, tmp_path):
    df = points(spark)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    model = TR.fit(TR.kernel_svc("label", ["a", "b"], C=10.0, components=128), train, "label")
    rows = model.transform(test).select("id", "label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r.label == r.prediction for r in rows]) > 0.9
    p = np.array([r.p for r in rows])
    assert p.shape[1] == 3 and np.abs(p.sum(1) - 1).max() < 1e-9
    place = np.array([[1.0, 3.0, 5.0].index(r.label) for r in rows])
    assert p[np.arange(len(p)), place].mean() > 0.7
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert [tuple(r) for r in loaded.transform(test).select("id", "prediction").collect()] == [
        (r.id, r.prediction) for r in rows]
    missing = test.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    scored = TR.score(model, missing)
    assert scored.count() == test.count() and scored.where("prediction is null").count() == missing.where(
        "a is null").count()


def test_one_class_is_an_error(spark):
    df = points(spark, 20).withColumn("label", F.lit(1.0))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), K.KernelSVC()])
    with pytest.raises(ValueError):
        pipe.fit(df)
