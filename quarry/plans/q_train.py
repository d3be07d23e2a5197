"""Training, registry and retraining-job queries (ML1-8, SNK5, SRC3, RTR1-3, TS4)."""
from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.functions.numeric import r
from quarry.operators import jobs as J
from quarry.operators import split as SP
from quarry.operators import train as TR
from quarry.operators.series import DEFAULT_BUCKETS, histogram, le_label
from quarry.plans.catalog import register
from quarry.plans.q_rules import _job_requests_sql, job_requests
from quarry.session import freeze, scratch_path
from quarry.sources.registry import Registry
from quarry.sources.tables import class_table, read_table, regression_table

H_FEATURES = ["l_quantity", "l_discount", "l_tax"]
H_LABEL = "l_extendedprice"


def _h(spark, sf_dir):
    return regression_table(spark, sf_dir).withColumn(
        "row_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@register("linreg_coefficients", """
SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem""")
def linreg_coefficients(spark, sf_dir):
    """ML1 with one feature equals the closed-form least-squares line."""
    model = TR.linear_regression(H_LABEL, ["l_quantity"]).fit(regression_table(spark, sf_dir))
    lr = model.stages[-1]
    return spark.createDataFrame([(float(lr.intercept), float(lr.coefficients[0]))],
                                 "intercept double, slope double").select(
        r("intercept", 4).alias("intercept"), r("slope", 4).alias("slope"))


@register("batch_score", """
SELECT l_orderkey, l_linenumber,
  round(regr_intercept(l_extendedprice, l_quantity) OVER () +
        regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity, 2) AS prediction
FROM lineitem""")
def batch_score(spark, sf_dir):
    """ML8: fit, then score the whole table with the fitted pipeline."""
    h = regression_table(spark, sf_dir)
    model = TR.linear_regression(H_LABEL, ["l_quantity"]).fit(h)
    return TR.score(model, h).select("l_orderkey", "l_linenumber",
                                     r("prediction", 2).alias("prediction"))


def regression_candidates(label=H_LABEL):
    return [
        TR.Candidate("LinearRegression", lambda: TR.linear_regression(label, H_FEATURES)),
        TR.Candidate("DecisionTreeRegressor",
                     lambda: TR.decision_tree_regressor(label, H_FEATURES)),
        TR.Candidate("RandomForestRegressor",
                     lambda: TR.random_forest_regressor(label, H_FEATURES, numTrees=100)),
    ]


def class_candidates(features=None):
    return [
        TR.Candidate("LogisticRegression",
                     lambda n: TR.logistic_regression("label", features, n_rows=n)),
        TR.Candidate("RandomForestClassifier",
                     lambda: TR.random_forest_classifier("label", features, numTrees=100)),
        TR.Candidate("LinearSVC", lambda: TR.linear_svc_ovr("label", features)),
    ]


@register("candidate_scores")
def candidate_scores(spark, sf_dir):
    """ML1-7: train regression candidates on H and 3-class-style candidates on
    C (64-d embeddings), score the test split, flag the best run."""
    # the split is read by every candidate fit and scoring pass: freeze the
    # needed columns once instead of re-scanning and re-hashing the source
    h = SP.hash_split(_h(spark, sf_dir), "row_key", 0.2, 42).select(
        *H_FEATURES, H_LABEL, "is_test").transform(freeze)
    reg = TR.train_candidates(h.where(~F.col("is_test")), h.where(F.col("is_test")), H_LABEL,
                              "regression", regression_candidates())
    c = TR.with_vector(class_table(spark, sf_dir), "embedding").withColumn(
        "label", F.col("label").cast("double"))
    c = SP.stratified_split(c, "vec_id", "label", 0.2, 42)
    ctrain = c.where(~F.col("is_test")).transform(freeze)
    cls = TR.train_candidates(ctrain, c.where(F.col("is_test")), "label", "classification",
                              class_candidates())
    best_r = TR.pick_best(reg.scores, "rmse", False).select("run_id")
    best_c = TR.pick_best(cls.scores, "accuracy", True).select("run_id")
    best = best_r.unionByName(best_c).withColumn("is_best", F.lit(True))
    scores = reg.scores.withColumn("kind", F.lit("regression")).unionByName(
        cls.scores.withColumn("kind", F.lit("classification")))
    return scores.join(best, "run_id", "left").select(
        "kind", "run_name", "metric", r("value", 4).alias("value"),
        F.coalesce("is_best", F.lit(False)).alias("is_best"))


_RULE = "CASE WHEN l_quantity > 35 THEN 2 WHEN l_quantity > 15 THEN 1 ELSE 0 END"


@register("candidate_checks", """
SELECT kind, run_name, false AS failed, true AS metric_is_count, true AS beats_baseline,
       true AS best_is_extreme
FROM (VALUES ('regression', 'LinearRegression'), ('regression', 'DecisionTreeRegressor'),
             ('regression', 'RandomForestRegressor'), ('classification', 'LogisticRegression'),
             ('classification', 'RandomForestClassifier'), ('classification', 'LinearSVC'))
     t(kind, run_name)""")
def candidate_checks(spark, sf_dir):
    """ML2-7 held against plain counts: on a label that is a fixed rule over the
    features, each candidate fits, its metric is what a count over its scored
    rows gives, it beats the constant prediction, and the best run has the
    extreme score."""
    h = SP.hash_split(_h(spark, sf_dir), "row_key", 0.2, 42).select(
        *H_FEATURES, F.expr("l_quantity * (1 - l_discount)").alias("net"),
        F.expr(_RULE).cast("double").alias("label"), "is_test")
    h = freeze(h)
    train, test = h.where(~F.col("is_test")), h.where("is_test")
    rows = []
    for kind, label, cands in (
            ("regression", "net", regression_candidates("net")),
            ("classification", "label", class_candidates(H_FEATURES))):
        res = TR.train_candidates(train, test, label, kind, cands)
        metric, up = ("rmse", False) if kind == "regression" else ("accuracy", True)
        told = {x["run_id"]: x["value"] for x in res.scores.where(
            F.col("metric") == metric).collect()}
        best = TR.pick_best(res.scores, metric, up).first()["score"]
        extreme = best == (max if up else min)(told.values())
        if kind == "regression":
            base = test.agg(F.stddev_pop(label)).first()[0]
        else:
            base = test.groupBy(label).count().agg(F.max("count")).first()[0] / test.count()
        for run_id, model in res.models.items():
            scored = TR.score(model, test)
            if kind == "regression":
                counted = scored.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("prediction"), 2))))
            else:
                counted = scored.agg(F.avg((F.col(label) == F.col("prediction")).cast("double")))
            value = told[run_id]
            rows.append((kind, res.names[run_id], False,
                         abs(value - counted.first()[0]) < 1e-9 * max(1.0, abs(value)),
                         value > base if up else value < base, extreme))
        rows += [(kind, n, True, False, False, extreme) for n in res.failures]
    return spark.createDataFrame(rows, "kind string, run_name string, failed boolean, "
                                       "metric_is_count boolean, beats_baseline boolean, "
                                       "best_is_extreme boolean")


@register("kernel_svc_checks", """
SELECT n, 'kernel' AS best, true AS above_ninety, true AS linear_below, true AS sums_to_one,
       true AS probability_beats_share, true AS same_when_loaded
FROM (SELECT count(*) AS n FROM part)""")
def kernel_svc_checks(spark, sf_dir):
    """ML6: a label that is no linear rule of the features (inside a ring of
    size and price) is learned by the kernel machine and not by the linear
    one; probabilities sum to one and beat the label's share; the saved model
    answers alike."""
    p = read_table(spark, sf_dir, "part").select(
        "p_partkey", ((F.col("p_size") - 25) / 15.0).alias("a"),
        ((F.col("p_retailprice") - 950) / 30.0).alias("b"))
    p = SP.hash_split(p.withColumn("label", (F.hypot("a", "b") < 1.2).cast("double")), "p_partkey", 0.3, 42)
    p = freeze(p.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    train, test = p.where("not is_test"), p.where("is_test")
    made = {"kernel": TR.kernel_svc("label", ["a", "b"], C=10.0), "linear": TR.linear_svc_ovr("label", ["a", "b"])}
    models = {k: TR.fit(v, train, "label") for k, v in made.items()}
    right = {k: TR.score(m, test).agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
             for k, m in models.items()}
    path = scratch_path(spark, "kernel")
    models["kernel"].write().overwrite().save(path)
    told = [m.transform(test).select("p_partkey", "label", vector_to_array("probability").alias("q"))
            for m in (models["kernel"], PipelineModel.load(path))]
    share = train.agg(F.avg("label")).first()[0]
    sums, brier, plain = told[0].agg(
        F.max(F.abs(F.aggregate("q", F.lit(0.0), lambda s, v: s + v) - 1)),
        F.avg(F.pow(F.col("q")[1] - F.col("label"), 2)), F.avg(F.pow(F.lit(share) - F.col("label"), 2))).first()
    n = read_table(spark, sf_dir, "part").count()
    return spark.createDataFrame([(n, max(right, key=right.get), right["kernel"] > 0.9, right["linear"] < 0.9,
                                   sums < 1e-9, brier < plain / 2, told[0].exceptAll(told[1]).isEmpty())],
                                 "n long, best string, above_ninety boolean, linear_below boolean, "
                                 "sums_to_one boolean, probability_beats_share boolean, "
                                 "same_when_loaded boolean")


@register("evaluate_registered", """
SELECT 'IrisBestModel' AS model_name, 'accuracy' AS metric, true AS same_as_history,
       false AS dropped, (SELECT count(*) FROM lineitem) AS samples_evaluated""")
def evaluate_registered(spark, sf_dir):
    """RTR1 -> SNK5 -> SRC3 -> EVL6 -> DRF4: retrain (from the given file, which
    is absent, else the default table), load the registered model, evaluate it
    on the table and hold the score against the performance history."""
    from quarry.operators import drift as D
    from quarry.operators import evaluate as E
    from quarry.sources import files as IO

    root = scratch_path(spark, "evaluate")
    reg, history = Registry(spark, f"{root}/registry"), f"{root}/history"
    table = freeze(_h(spark, sf_dir).select(
        *H_FEATURES, F.expr(_RULE).cast("double").alias("label"), "row_key"))
    load = lambda: IO.read_or_default(spark, f"{root}/absent.csv", table.schema, lambda: table)
    cands = [TR.Candidate("DecisionForest", lambda: TR.random_forest_classifier(
        "label", H_FEATURES, numTrees=100))]
    J.retrain(spark, reg, f"{root}/events", "iris", "performance_drop", load, "label", "row_key",
              "classification", cands, history_path=history)
    now = E.evaluate_registered(reg, "IrisBestModel", "iris", table, "classification", "label",
                                "2024-01-31 00:00:00")
    current = now.where("metric = 'accuracy'").withColumn("model_name", F.lit("iris"))
    past = spark.read.parquet(history)
    drop = D.performance_drop(past, current)
    n = now.where("metric = 'samples_evaluated'").select("value").scalar()
    return drop.select(F.lit("IrisBestModel").alias("model_name"), "metric",
                       (F.abs(F.col("current") - F.col("historical")) < 0.02).alias("same_as_history"),
                       "dropped", n.cast("long").alias("samples_evaluated"))


@register("latest_model", """
SELECT 'CaliforniaHousingBestModel' AS name, CAST(1 AS BIGINT) AS version, 'registry' AS source""")
def latest_model(spark, sf_dir):
    """SNK5 + SRC3: log two candidate runs, register the best, look up the
    latest model by registry name and by run-name prefix."""
    reg = Registry(spark, scratch_path(spark, "registry"))
    h = SP.hash_split(_h(spark, sf_dir), "row_key", 0.2, 42).select(
        *H_FEATURES, H_LABEL, "is_test").transform(freeze)
    cands = [TR.Candidate("LinearRegression_qty", lambda: TR.linear_regression(H_LABEL, ["l_quantity"])),
             TR.Candidate("LinearRegression_all", lambda: TR.linear_regression(H_LABEL, H_FEATURES))]
    res = TR.train_candidates(h.where(~F.col("is_test")), h.where(F.col("is_test")), H_LABEL,
                              "regression", cands)
    for run_id, m in res.models.items():
        rows = res.scores.where(F.col("run_id") == run_id)
        name = res.names[run_id]
        reg.log_run(run_id, name, "housing", {"model": name, "random_state": 42},
                    rows.select("metric", "value"), m)
    reg.register("CaliforniaHousingBestModel", TR.pick_best(res.scores, "rmse", False))
    by_name = reg.latest_versions().select("name", "version", "run_id")
    by_runs = reg.latest_model_path("CaliforniaHousingBestModel", "linearregression")
    return by_name.join(by_runs.select("run_id", "source"), "run_id", "left").select(
        "name", "version", F.coalesce("source", F.lit("runs")).alias("source"))


def derived_job_events(spark, sf_dir):
    """Job events implied by the request table: an accepted request runs for
    `value` seconds and fails when its event is an error."""
    req = job_requests(spark, sf_dir)
    return J.events_from_requests(req, F.col("value"), F.col("event_type") == "error",
                                  F.lit("training failed"))


_JOBS_SQL = f"""JR AS ({_job_requests_sql()}),
OK AS (SELECT CASE model_name WHEN 'CaliforniaHousingBestModel' THEN 'housing'
                              WHEN 'IrisBestModel' THEN 'iris' ELSE model_name END AS model_name,
              trigger_type, ts, request_id, value AS dur, event_type = 'error' AS failed
       FROM JR WHERE model_name IN ('housing', 'iris', 'CaliforniaHousingBestModel', 'IrisBestModel')
         AND trigger_type IN ('manual', 'scheduled', 'performance_drop', 'data_drift'))"""


@register("job_latest_state", f"""WITH {_JOBS_SQL}
SELECT model_name || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || CAST(request_id AS VARCHAR) AS job_id,
       model_name, trigger_type, CASE WHEN failed THEN 'failed' ELSE 'completed' END AS status,
       ts AS start_time,
       make_timestamp(epoch_us(ts) + 1 + CAST(trunc(dur * 1e6) AS BIGINT)) AS last_update,
       round(dur, 6) AS duration, CASE WHEN failed THEN 'training failed' END AS error,
       CASE model_name WHEN 'housing' THEN 5 WHEN 'iris' THEN 3 ELSE 10 END AS estimated_minutes
FROM OK""")
def job_latest_state(spark, sf_dir):
    st = J.latest_state(derived_job_events(spark, sf_dir))
    return st.select(
        "job_id", "model_name", "trigger_type", "status",
        F.col("start_time").cast("timestamp_ntz").alias("start_time"),
        F.col("last_update").cast("timestamp_ntz").alias("last_update"),
        r("duration", 6).alias("duration"), "error", "estimated_minutes")


@register("histogram_retraining", f"""WITH {_JOBS_SQL},
B AS (SELECT * FROM (VALUES {", ".join(f"('{le_label(b)}', {float(b)!r})" for b in DEFAULT_BUCKETS)},
      ('+Inf', 'inf'::DOUBLE)) t(le, bound))
SELECT model_name, le, count(*) FILTER (WHERE dur <= bound) AS bucket_count,
       round(sum(dur), 6) AS obs_sum, count(dur) AS obs_count FROM OK, B GROUP BY model_name, le""")
def histogram_retraining(spark, sf_dir):
    """TS6: retraining time by model, each job once at its terminal event."""
    done = derived_job_events(spark, sf_dir).where(F.col("status").isin(*J.TERMINAL))
    return histogram(done, ["model_name"], "duration").select(
        "model_name", "le", "bucket_count", r("obs_sum", 6).alias("obs_sum"), "obs_count")


@register("counter_retrainings", f"""WITH {_JOBS_SQL}
SELECT model_name, trigger_type, count(*) AS value FROM OK GROUP BY ALL""")
def counter_retrainings(spark, sf_dir):
    return J.retraining_counter(derived_job_events(spark, sf_dir))


@register("retrain_jobs", """
SELECT * FROM (VALUES ('housing', 'manual', 'completed', true), ('iris', 'data_drift', 'completed', true))
     t(model_name, trigger_type, status, no_error)""")
def retrain_jobs(spark, sf_dir):
    """RTR1-3: run one retraining job for each model on the stand-in tables
    and report the latest state of every job."""
    root = scratch_path(spark, "retrain")
    reg = Registry(spark, f"{root}/registry")
    events = f"{root}/job_events"
    history = f"{root}/history"
    J.retrain(spark, reg, events, "housing", "manual", lambda: _h(spark, sf_dir), H_LABEL,
              "row_key", "regression", regression_candidates(), history_path=history)
    c = TR.with_vector(class_table(spark, sf_dir), "embedding").withColumn(
        "label", F.col("label").cast("double"))
    J.retrain(spark, reg, events, "IrisBestModel", "data_drift", lambda: c, "label", "vec_id",
              "classification", class_candidates(), history_path=history)
    st = J.latest_state(spark.read.parquet(events))
    return st.select("model_name", "trigger_type", "status",
                     F.col("error").isNull().alias("no_error"))
