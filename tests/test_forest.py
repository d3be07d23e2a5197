"""Trees of full depth against an exact tree grown by hand."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quarry.operators import forest as FO


def exact(x, y, w, classes):
    """The tree that tries every midpoint of every feature, one node at a time."""
    def worth(rows):
        if classes:
            c = np.bincount(y[rows].astype(int), w[rows], classes)
            return (c ** 2).sum() / c.sum()
        return (w[rows] * y[rows]).sum() ** 2 / w[rows].sum()

    def value(rows):
        if classes:
            c = np.bincount(y[rows].astype(int), w[rows], classes)
            return c / c.sum()
        return np.array([(w[rows] * y[rows]).sum() / w[rows].sum()])

    def grow(rows):
        best = None
        if y[rows].min() < y[rows].max():
            for f in range(x.shape[1]):
                seen = np.unique(x[rows, f])
                for lo, hi in zip(seen, seen[1:]):
                    t = lo + (hi - lo) / 2
                    a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                    gain = worth(a) + worth(b) - worth(rows)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, f, t, a, b
        if best is None:
            return value(rows)
        return best[1], best[2], grow(best[3]), grow(best[4])

    return grow(np.arange(len(x)))


def ask(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


@pytest.mark.parametrize("classes", [0, 3])
def test_grow_tree_is_exact(classes):
    rng = np.random.default_rng(classes)
    for n in (1, 2, 7, 60):
        x = rng.integers(0, 9, (n, 3)).astype(float)
        y = rng.integers(0, 3, n).astype(float) if classes else rng.normal(size=n).round(3)
        w = rng.integers(1, 4, n)
        got = FO.grow_tree(x, y, w, classes, 3, None, rng)
        want = exact(x, y, w, classes)
        leaf = FO.tree_leaves(got, x)
        value = got["value"].reshape(-1, max(1, classes))[leaf]
        assert np.allclose(value, [ask(want, r) for r in x])
        other = rng.uniform(-1, 10, (200, 3))
        value = got["value"].reshape(-1, max(1, classes))[FO.tree_leaves(got, other)]
        assert np.mean(np.isclose(value, [ask(want, r) for r in other]).all(1)) > 0.9  # equal gains


def frame(spark, n=3000):
    return spark.range(n).select(
        F.col("id"), (F.xxhash64("id") % 500 / 50.0).alias("a"), (F.xxhash64("id", F.lit(1)) % 400 / 40.0)
        .alias("b")).withColumn("y", F.when(F.col("a") > 2.5, F.col("b") * 3).otherwise(F.col("a") * F.col("a"))
                                ).withColumn("label", F.when(F.hypot("a", "b") < 7.0, 5.0).otherwise(6.0))


def fitted(df, **params):
    est = FO.DeepForest(**params)
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), est]).fit(df)


@pytest.mark.parametrize("task_rows", [100_000, 900])
def test_one_tree_learns_its_rows(spark, task_rows):
    """Full depth: every row's own label comes back where features are
    distinct, with and without levels that Spark grows."""
    df = frame(spark).dropDuplicates(["a", "b"])
    reg = fitted(df, numTrees=1, labelCol="y", taskRows=task_rows)
    worst = reg.transform(df).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert worst < 1e-9
    cls = fitted(df, numTrees=1, kind="classification", labelCol="label", taskRows=task_rows)
    assert cls.transform(df).where("label != prediction").count() == 0
    if task_rows == 900:
        assert reg.stages[-1].splits.count() >= 3
        new = frame(spark, 3500).where("id >= 3000")
        rmse = reg.transform(new).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]
        assert rmse < 2.5  # the label's spread is above 10


def test_forest_beats_its_trees_and_is_saved(spark, tmp_path):
    df = frame(spark)
    noisy = df.withColumn("label", F.when(F.col("id") % 7 == 0, F.lit(6.0)).otherwise(F.col("label")))
    test = frame(spark, 4000).where("id >= 3000")

    def accuracy(model):
        return model.transform(test).agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]

    one = fitted(noisy, numTrees=1, kind="classification")
    many = fitted(noisy, numTrees=20, kind="classification", featureSubsetStrategy="sqrt", taskRows=1500,
                  treesAtOnce=12)
    assert accuracy(many) > max(0.9, accuracy(one))
    again = fitted(noisy.repartition(1), numTrees=3, kind="classification")
    assert again.stages[-1].subtrees.count() == 3
    many.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    a, b = (m.transform(test).select("id", "prediction", "probability") for m in (many, loaded))
    assert a.exceptAll(b).count() == 0 and a.count() == 1000
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in a.collect())


def test_unsplittable_large_nodes_are_leaves(spark):
    """Rows of one feature vector, more than a task takes, are one leaf with
    their mean; so is a large pure node."""
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, 1.0).otherwise(F.col("id").cast("double")).alias("a"),
        F.lit(0.0).alias("b"), (F.col("id") % 4).cast("double").alias("y"))
    model = fitted(df, numTrees=1, labelCol="y", taskRows=300)
    got = {r.a: r.prediction for r in model.transform(df.where("a < 1510")).collect()}
    assert got[1.0] == 1.5 and got[1503.0] == 3.0


def test_depth_and_empty(spark):
    df = frame(spark)
    model = fitted(df, numTrees=1, labelCol="y", maxDepth=2, taskRows=1000)
    assert model.transform(df).select("prediction").distinct().count() <= 4
    with pytest.raises(ValueError):
        fitted(df.limit(0), numTrees=1, labelCol="y")


def test_task_takes_narrow_rows_whole(spark):
    """A tree of few features is finished by one task beyond TASK_ROWS rows: no
    level is grown by shuffles, and every row's own label still comes back."""
    df = spark.range(FO.TASK_ROWS + 20_000).select(
        F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        F.floor(F.col("id") / 100).cast("double").alias("y"))
    model = fitted(df, numTrees=1, labelCol="y").stages[-1]
    assert model.splits.isEmpty() and model.subtrees.count() == 1
    worst = FO.forest_scores(df.withColumn("x", F.array("a", "b")), F.col("x"), model.subtrees, model.splits,
                             1, 1).agg(F.max(F.abs(F.col("value")[0] - F.floor(F.col("x")[0] / 100)))).first()[0]
    assert worst < 1e-9


def test_sums_in_place_equal_sorted_sums():
    rng = np.random.default_rng(5)
    node, code, stats = rng.integers(0, 6, 400), rng.integers(0, 9, 400), rng.integers(1, 9, (400, 2))
    for a, b in zip(FO._value_sums(node, 6, code, 9, stats), FO._value_sums(node, 6, code, 9000, stats)):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("seed", [42, -7, 1 << 40])
def test_bag_weights_are_those_of_spark(spark, seed):
    rows = spark.range(3000).select(F.col("id").alias("row"), F.explode(F.array(F.lit(0), F.lit(7))).alias("tree"))
    want = rows.select("tree", "row", FO._weight(seed, True).alias("w")).orderBy("tree", "row").collect()
    got = np.concatenate(list(FO.bag_weights(seed, [0, 7], np.arange(3000))))
    assert got.tolist() == [r.w for r in want]


def alike(spark):
    """3,000 rows of 60 vectors; labels differ inside one."""
    return spark.range(3000).select(
        "id", (F.col("id") % 12).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        (F.xxhash64("id") % 100 / 8.0 + F.col("id") % 12).alias("y"),
        (F.pmod(F.xxhash64("id"), F.lit(3)) + 4.0).alias("label"))


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_equal_vectors_are_one_row_of_the_same_forest(spark, kind):
    """More rows than a task takes, but few vectors: each tree is grown by one
    task, and is the tree that its single rows give."""
    n = 0 if kind == "regression" else 3
    table = alike(spark).select(F.col("id").alias("row"), (F.col("label") - 4 if n else F.col("y")).alias("y"),
                                F.array("a", "b").alias("x"))
    subtrees, splits = FO._grow_batch(table, 3000, 60 * max(1, n), range(3), 2, [4.0, 5.0, 6.0] if n else None,
                                      1, 42, True, None, 3000 - 1)
    assert splits.isEmpty() and subtrees.count() == 3
    rows = table.orderBy("row").toPandas()
    x, y, want = np.stack(rows["x"]), rows["y"].to_numpy(), 0
    for t, w in enumerate(FO.bag_weights(42, range(3), rows["row"].to_numpy())):
        drawn = w > 0
        tree = FO.grow_tree(x[drawn], y[drawn], w[drawn], n, 1, None, np.random.default_rng([42, t, 0]))
        want = want + tree["value"].reshape(-1, max(1, n))[FO.tree_leaves(tree, x)] / 3
    told = {tuple(r.x): r.value for r in FO.forest_scores(
        table, F.col("x"), subtrees, splits, 3, max(1, n)).collect()}
    assert len(told) == 60 and np.allclose([told[tuple(v)] for v in x], want, atol=1e-12)


def test_equal_vectors_of_large_nodes(spark):
    """With more vectors than a task takes, levels grow on the vectors' sums."""
    df = alike(spark)
    model = fitted(df, numTrees=1, labelCol="y", taskRows=20)
    assert model.stages[-1].splits.count() >= 3
    want = df.groupBy("a", "b").agg(F.avg("y").alias("mean"))
    worst = model.transform(df).join(want, ["a", "b"]).agg(F.max(F.abs(F.col("mean") - F.col("prediction")))).first()[0]
    assert worst < 1e-9
    cls = fitted(df, numTrees=1, kind="classification", taskRows=20)
    share = df.groupBy("a", "b").pivot("label", [4.0, 5.0, 6.0]).count().fillna(0)
    for r in cls.transform(share).collect():
        counts = np.array([r["4.0"], r["5.0"], r["6.0"]])
        assert np.allclose(r.probability.toArray(), counts / counts.sum())
