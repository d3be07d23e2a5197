"""Table checks and row rules (VAL1-10).

* `table_checks`: every whole-table check (missing, infinite, contract,
  warn-only bounds) in ONE aggregate pass, reported as long rows.
* `apply_rules`: one projection adding `violations` (error rules) and
  `warnings` (warn rules) as arrays of rule ids.
* `route`: valid / quarantine split of a rule-checked table, and a sink that
  writes both sides from one frozen pass.
"""
from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import freeze
from quarry.sources.files import ERRORS
from quarry.functions.numeric import is_infinite, is_missing
from quarry.functions.rules import Rule


def _ids(rules: Sequence[Rule]) -> Column:
    if not rules:
        return F.array().cast("array<string>")
    arr = F.array(*[F.when(F.expr(r.violated_when), F.lit(r.rule_id)) for r in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def apply_rules(df: DataFrame, rules: Sequence[Rule], include_cross_field: bool = True) -> DataFrame:
    """VAL6-9: add `violations` and `warnings` (array<string> of rule ids)."""
    active = [r for r in rules if include_cross_field or not r.cross_field]
    errors = [r for r in active if r.severity == "error"]
    warns = [r for r in active if r.severity != "error"]
    return df.withColumns({"violations": _ids(errors), "warnings": _ids(warns)})


def route(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VAL10: (accepted, quarantined) from a table carrying `violations`."""
    bad = F.size("violations") > 0
    return checked.where(~bad), checked.where(bad)


def check_records(parsed: DataFrame, rules: Sequence[Rule],
                  include_cross_field: bool = True) -> DataFrame:
    """VAL10 for parsed records: a record that couldn't be parsed has its parse
    errors as `violations` (the rules saw none of it), any other the ids of
    the rules that it breaks."""
    checked = apply_rules(parsed, rules, include_cross_field)
    broken = F.size(ERRORS) > 0
    return checked.withColumns({
        "violations": F.when(broken, F.col(ERRORS)).otherwise(F.col("violations")),
        "warnings": F.when(broken, F.array().cast("array<string>")).otherwise(F.col("warnings"))}).drop(ERRORS)


def write_routed(df: DataFrame, rules: Sequence[Rule], valid_path: str, quarantine_path: str,
                 fmt: str = "parquet", batch_id: str | None = None) -> str:
    """VAL10 sink: one rule pass, frozen by a reliable checkpoint, then the two
    filtered writes read the frozen rows instead of recomputing the source.

    Both sides are folders of batches (`batch_id=...`); a batch that is
    written again under its id takes its own place, so a rerun, also one after
    a failure between the two writes, adds no row.  Returns the batch's id."""
    batch_id = batch_id or uuid.uuid4().hex
    checked = (check_records if ERRORS in df.columns else apply_rules)(df, rules).transform(freeze)
    for rows, path in zip(route(checked), (valid_path, quarantine_path)):
        rows.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}")
    return batch_id


def table_checks(
    df: DataFrame,
    required_columns: Sequence[str] = (),
    target: str | None = None,
    allowed_targets: Sequence | None = None,
    warn_above: Mapping[str, float] | None = None,
    warn_negative: Sequence[str] = (),
) -> DataFrame:
    """VAL1-5 as long rows (check, column_name, severity, failures, passed).

    missing   — NULL/NaN count per column (error)
    infinite  — +-inf count per numeric column (error)
    contract  — required column absent (error, schema only) and target values
                outside the allowed set (error)
    above     — values above a warn limit (warn)
    negative  — negative values (warn)
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    floating = [c for c, t in fields.items() if isinstance(t, (T.DoubleType, T.FloatType))]
    checks: list[tuple[str, str, str, Column]] = []
    for c in df.columns:
        pred = is_missing(c) if c in floating else F.col(c).isNull()
        checks.append(("missing", c, "error", F.count_if(pred)))
    for c in floating:
        checks.append(("infinite", c, "error", F.count_if(is_infinite(c))))
    for c in required_columns:
        checks.append(("required_column", c, "error", F.lit(0 if c in fields else 1).cast("long")))
    if target is not None and allowed_targets is not None and target in fields:
        checks.append(("target_values", target, "error",
                       F.count_if(~F.col(target).isin(list(allowed_targets)))))
    for c, x in (warn_above or {}).items():
        if c in fields:
            checks.append(("above_limit", c, "warn", F.count_if(F.col(c) > F.lit(x))))
    for c in warn_negative:
        if c in fields:
            checks.append(("negative", c, "warn", F.count_if(F.col(c) < 0)))
    wide = df.agg(*[
        F.struct(F.lit(k).alias("check"), F.lit(c).alias("column_name"),
                 F.lit(s).alias("severity"), v.cast("long").alias("failures")).alias(f"c{i}")
        for i, (k, c, s, v) in enumerate(checks)
    ])
    long = wide.unpivot([], [f"c{i}" for i in range(len(checks))], "_k", "s").select("s.*")
    return long.withColumn("passed", F.col("failures") == 0)


def table_is_valid(checks: DataFrame) -> DataFrame:
    """One row: valid = no failing error-severity check."""
    return checks.agg(
        (F.count_if((F.col("severity") == "error") & ~F.col("passed")) == 0).alias("valid"),
        F.count_if((F.col("severity") == "warn") & ~F.col("passed")).alias("warnings"),
    )
