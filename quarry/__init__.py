"""quarry: model-data analytics as Spark DataFrame jobs.

Layout
  sources/    table loaders, file sources and sinks, model registry tables
  functions/  column-expression helpers (null/NaN-safe arithmetic, rule sets)
  operators/  DataFrame -> DataFrame operators (validation, features, splits,
              scaling, profiling, serving-log analytics, metric series,
              range queries, drift, evaluation, training, job state)
  plans/      composed jobs and the query catalogue used by __spark_entry__
  streaming/  Structured Streaming twins of the batch operators
"""
