"""Declarative row rules.

A rule is an id, the column it guards, a SQL predicate that is TRUE when the
row *violates* it, a severity and a cross-field flag.  Predicates are SQL
text so one rule set drives both the Spark plan (`F.expr`) and any SQL
engine.  Applying a rule set is one projection: an array of the ids of the
violated rules, compacted.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    column: str | None
    violated_when: str
    severity: str = "error"  # "error" rejects the row, "warn" only reports
    cross_field: bool = False


def _q(c: str) -> str:
    return f"`{c}`"


def bounds(column: str, gt=None, ge=None, lt=None, le=None, required: bool = True,
           rule_id: str | None = None) -> Rule:
    """Range rule in the style of a typed field constraint (gt/ge/lt/le).
    A missing value (NULL or NaN) violates a required field."""
    c = _q(column)
    ok = []
    if gt is not None:
        ok.append(f"{c} > {gt!r}")
    if ge is not None:
        ok.append(f"{c} >= {ge!r}")
    if lt is not None:
        ok.append(f"{c} < {lt!r}")
    if le is not None:
        ok.append(f"{c} <= {le!r}")
    cond = " AND ".join(ok) or "TRUE"
    missing = f"{c} IS NULL OR isnan({c})" if required else "FALSE"
    viol = f"({missing}) OR NOT ({cond})" if required else f"{c} IS NOT NULL AND NOT ({cond})"
    return Rule(rule_id or f"{column}_range", column, viol)


def limit(column: str, op: str, value, rule_id: str, severity: str = "error") -> Rule:
    """Custom one-sided limit: violated when `column op value` holds."""
    return Rule(rule_id, column, f"{_q(column)} {op} {value!r}", severity)


def not_less_than(a: str, b: str, rule_id: str) -> Rule:
    """Cross-field rule a >= b (violated when a < b)."""
    return Rule(rule_id, a, f"{_q(a)} < {_q(b)}", "error", cross_field=True)


def one_of(column: str, allowed: Sequence[str], rule_id: str | None = None) -> Rule:
    vals = ", ".join("'" + str(v).replace("'", "''") + "'" for v in allowed)
    c = _q(column)
    return Rule(rule_id or f"{column}_enum", column, f"{c} IS NULL OR {c} NOT IN ({vals})")


# ---------------------------------------------------------------------------
# Fixed rule sets of the served request records (values must equal the
# reference service's request constraints).
# ---------------------------------------------------------------------------

def regression_request_rules(cross_field: bool = True) -> list[Rule]:
    # fixed values: field bounds
    rules = [
        bounds("MedInc", gt=0),
        bounds("HouseAge", ge=0, le=100),
        bounds("AveRooms", gt=0, le=20),
        bounds("AveBedrms", gt=0, le=10),
        bounds("Population", gt=0, le=10000),
        bounds("AveOccup", gt=0, le=50),
        bounds("Latitude", ge=32.0, le=42.0),
        bounds("Longitude", ge=-125.0, le=-114.0),
        # fixed values: custom limits
        limit("MedInc", ">", 50, "MedInc_too_high"),
        limit("AveRooms", "<", 1, "AveRooms_below_1"),
        limit("AveBedrms", "<", 0.5, "AveBedrms_below_half"),
    ]
    if cross_field:
        rules.append(Rule("coordinates_box", "Latitude",
                          "NOT (`Latitude` BETWEEN 32 AND 42 AND `Longitude` BETWEEN -125 AND -114)",
                          cross_field=True))
    return rules


CLASS_FEATURES = ("sepal_length", "sepal_width", "petal_length", "petal_width")


def class_request_rules(cross_field: bool = True) -> list[Rule]:
    # fixed values: every measurement in (0, 10]; length >= width for both pairs
    rules = [bounds(c, gt=0, le=10) for c in CLASS_FEATURES]
    if cross_field:
        rules += [
            not_less_than("sepal_length", "sepal_width", "sepal_length_lt_width"),
            not_less_than("petal_length", "petal_width", "petal_length_lt_width"),
        ]
    return rules


# fixed values: accepted names of retraining requests
RETRAIN_MODEL_NAMES = ("housing", "iris", "CaliforniaHousingBestModel", "IrisBestModel")
RETRAIN_TRIGGERS = ("manual", "scheduled", "performance_drop", "data_drift")


def retrain_request_rules() -> list[Rule]:
    return [one_of("model_name", RETRAIN_MODEL_NAMES, "model_name_enum"),
            one_of("trigger_type", RETRAIN_TRIGGERS, "trigger_type_enum")]


# fixed values: metric record constraints
UNIT_INTERVAL_METRICS = ("confidence", "accuracy", "precision", "recall", "f1_score", "threshold")
NON_NEGATIVE_METRICS = ("rmse", "mae")


def metric_record_rules(name_col: str = "metric_name", value_col: str = "metric_value") -> list[Rule]:
    unit = ", ".join(f"'{m}'" for m in UNIT_INTERVAL_METRICS)
    nonneg = ", ".join(f"'{m}'" for m in NON_NEGATIVE_METRICS)
    n, v = _q(name_col), _q(value_col)
    return [
        Rule("unit_interval", value_col,
             f"{n} IN ({unit}) AND {v} IS NOT NULL AND NOT ({v} BETWEEN 0 AND 1)"),
        Rule("non_negative", value_col, f"{n} IN ({nonneg}) AND {v} IS NOT NULL AND {v} < 0"),
    ]
