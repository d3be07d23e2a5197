"""Support-vector classifier with a radial kernel and probabilities (ML6).

The kernel exp(-gamma |x - y|^2) is approximated by random Fourier features:
z(x) = sqrt(2 / D) cos(x W + b), with the columns of W drawn from a normal law
of variance 2 gamma, gives z(x) . z(y) close to it.  A linear support-vector
machine per class (one, if there are two) is then an ordinary distributed fit
over z, whatever the number of rows; nothing of the size of rows x rows exists.

Probabilities are Platt's: margins of each fold under machines fitted on the
other folds are turned into probabilities by a logistic fit, and those of the
classes are scaled to sum to one.  Folds go by a hash of the features.

The model is its seed, gamma and one coefficient row a class, so it is saved
with its parameters.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.forest import MAX_CLASSES
from quarry.session import stage


def fourier_weights(dims: int, components: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(W, b) of the feature map; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2 * gamma), (dims, components)), rng.uniform(0, 2 * np.pi, components)


def fourier_map(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / w.shape[1]) * np.cos(x @ w + b)


class _KernelParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0: one over features times variance",
                  TypeConverters.toFloat)
    C = Param(Params._dummy(), "C", "weight of the loss", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "random features", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds of each fit", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "folds of the probability fit", TypeConverters.toInt)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "class probabilities", TypeConverters.toString)
    dims = Param(Params._dummy(), "dims", "features of a fitted model", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "labels of a fitted model", TypeConverters.toListFloat)
    coefficients = Param(Params._dummy(), "coefficients", "rows of the machines, each with its intercept",
                         TypeConverters.toListFloat)
    platt = Param(Params._dummy(), "platt", "slope and offset of each machine", TypeConverters.toListFloat)

    def _defaults(self) -> None:
        self._setDefault(gamma=0.0, C=1.0, components=256, maxIter=50, folds=3, seed=42,
                         probabilityCol="probability")


class KernelSVC(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Rows must have a whole feature vector and label."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", gamma=0.0, C=1.0, components=256, maxIter=50, folds=3,
                 seed=42):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "KernelSVCModel":
        get = self.getOrDefault
        rows = df.select(vector_to_array(get("featuresCol")).alias("x"),
                         F.col(get("labelCol")).cast("double").alias("y"))
        found = rows.select("y").distinct().limit(MAX_CLASSES + 1).collect()
        if not 2 <= len(found) <= MAX_CLASSES:
            raise ValueError(f"{len(found)} classes; 2 to {MAX_CLASSES} are needed")
        classes = sorted(r["y"] for r in found)
        n, dims, mean, square = rows.agg(
            F.count("*"), F.max(F.size("x")),
            F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")),
            F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x"))).first()
        spread = max(square - mean * mean, 1e-12)
        gamma = get("gamma") or 1.0 / (dims * spread)
        w, b = fourier_weights(dims, get("components"), gamma, get("seed"))

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(fourier_map(np.stack(x.to_numpy()), w, b))) if len(x) else x

        fold = F.pmod(F.xxhash64("x"), F.lit(get("folds")))
        table = stage(rows.select(mapped("x").alias("z"), "y", fold.alias("fold")), "kernel").withColumn(
            "features", array_to_vector("z"))
        machines, sigmoids = [], []
        for c in classes[1:] if len(classes) == 2 else classes:
            own = table.select("features", "fold", (F.col("y") == c).cast("double").alias("label"))

            def fit(part: DataFrame, rows_: int):
                return LinearSVC(maxIter=get("maxIter"), regParam=1.0 / (get("C") * max(1, rows_)),
                                 standardization=False).fit(part)

            margins = None
            for f in range(get("folds")):
                held = fit(own.where(F.col("fold") != f), n * (get("folds") - 1) // get("folds")).transform(
                    own.where(F.col("fold") == f)).select(
                    vector_to_array("rawPrediction")[1].alias("m"), "label")
                margins = held if margins is None else margins.unionByName(held)
            margins = stage(margins, "margins").withColumn("features", array_to_vector(F.array("m")))
            told = LogisticRegression(maxIter=50).fit(margins)
            sigmoids += [float(told.coefficients[0]), float(told.intercept)]
            machine = fit(own, n)
            machines += [*map(float, machine.coefficients.toArray()), float(machine.intercept)]
        model = self._copyValues(KernelSVCModel())
        model._set(gamma=float(gamma), dims=dims, classes=classes, coefficients=machines, platt=sigmoids)
        return model


class KernelSVCModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the class of the largest margin (ties to the smaller label) and
    the class probabilities."""

    def __init__(self):
        super().__init__()
        self._defaults()

    def told(self) -> Column:
        get = self.getOrDefault
        classes, d = np.array(get("classes")), get("components")
        w, b = fourier_weights(get("dims"), d, get("gamma"), get("seed"))
        rows = np.array(get("coefficients")).reshape(-1, d + 1)
        slope, offset = np.array(get("platt")).reshape(-1, 2).T

        @F.pandas_udf("prediction double, probability array<double>")
        def tell(x: pd.Series) -> pd.DataFrame:
            if not len(x):
                return pd.DataFrame({"prediction": [], "probability": []})
            m = fourier_map(np.stack(x.to_numpy()), w, b) @ rows[:, :-1].T + rows[:, -1]
            p = 1 / (1 + np.exp(-np.clip(m * slope + offset, -500, 500)))
            if len(classes) == 2:
                m, p = np.concatenate([-m, m], 1), np.concatenate([1 - p, p], 1)
            p = np.maximum(p, 1e-12)
            return pd.DataFrame({"prediction": classes[m.argmax(1)],
                                 "probability": list(p / p.sum(1, keepdims=True))})

        return tell(vector_to_array(get("featuresCol")))

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        return df.withColumn("_told", self.told()).withColumn(
            get("predictionCol"), F.col("_told.prediction")).withColumn(
            get("probabilityCol"), array_to_vector("_told.probability")).drop("_told")
