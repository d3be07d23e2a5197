"""Composite feature chains (PIP1, PIP2) and the prepare job (PIP3).

Both chains are `df.transform` sequences of the feature operators; the order
matters for the regression chain: clipping runs first, so every later ratio,
z-score and bin sees clipped values (coordinates are never clipped).
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import features as X
from quarry.operators import profile as P
from quarry.operators import scale as SC
from quarry.operators import split as SP
from quarry.operators import validate as V
from quarry.session import stage
from quarry.sources import files as IO

# fixed values: 3-class raw names -> short names, class codes -> species
CLASS_RENAME = {
    "sepal length (cm)": "sepal_length",
    "sepal width (cm)": "sepal_width",
    "petal length (cm)": "petal_length",
    "petal width (cm)": "petal_width",
    "target": "target",
}
SPECIES = {0: "setosa", 1: "versicolor", 2: "virginica"}

# fixed values: price bins (right-closed) and their labels
PRICE_EDGES = [0, 100000, 200000, 300000, float("inf")]
PRICE_LABELS = ["Low", "Medium", "High", "Very High"]


# fixed values: the column names of both specs, in and out
@dataclass
class ClassSpec:
    rename: dict = field(default_factory=lambda: dict(CLASS_RENAME))
    label_col: str = "target"
    label_map: dict = field(default_factory=lambda: dict(SPECIES))
    label_name: str = "species"
    area_pairs: Sequence[tuple[str, str, str]] = (
        ("sepal_length", "sepal_width", "sepal_area"),
        ("petal_length", "petal_width", "petal_area"),
    )
    ratio: tuple[str, str, str] = ("sepal_area", "petal_area", "sepal_petal_ratio")
    zscore_cols: Sequence[str] = ("sepal_length", "petal_length")


@dataclass
class RegressionSpec:
    clip_cols: Sequence[str] = ("MedInc", "HouseAge", "AveRooms", "AveBedrms", "Population",
                                "AveOccup", "MedHouseVal")
    products: Sequence[tuple[str, str, str]] = (
        ("AveRooms", "Population", "total_rooms"),
        ("AveBedrms", "Population", "total_bedrooms"),
    )
    ratios: Sequence[tuple[str, str, str]] = (
        ("AveRooms", "AveBedrms", "room_to_bedroom_ratio"),
        ("MedInc", "AveOccup", "income_per_person"),
    )
    squares: Sequence[tuple[str, str]] = (("HouseAge", "house_age_squared"),)
    norms: Sequence[tuple[str, str, str]] = (("Latitude", "Longitude", "distance_from_coast"),)
    interactions: Sequence[tuple[str, str, str]] = (
        ("Latitude", "Longitude", "lat_long_interaction"),
    )
    zscore_cols: Sequence[str] = ("MedInc", "HouseAge", "AveRooms", "AveBedrms")
    bucket_col: str = "MedHouseVal"
    bucket_edges: Sequence[float] = tuple(PRICE_EDGES)
    bucket_labels: Sequence[str] = tuple(PRICE_LABELS)
    bucket_name: str = "price_category"
    target: str = "MedHouseVal"


def class_chain(df: DataFrame, spec: ClassSpec | None = None) -> DataFrame:
    """PIP1: rename -> label map -> areas -> safe ratio -> z-scores."""
    s = spec or ClassSpec()
    out = X.rename(df, s.rename)
    out = out.withColumn(s.label_name, X.map_values(s.label_col, s.label_map))
    out = X.products(out, s.area_pairs)
    out = X.raw_ratios(out, [s.ratio])
    stats = X.table_stats(out, [s.ratio[2]], s.zscore_cols)
    out = X.fill_ratios(out, [s.ratio[2]], stats)
    return X.zscores(out, s.zscore_cols, stats=stats)


def regression_chain(df: DataFrame, spec: RegressionSpec | None = None) -> DataFrame:
    """PIP2: clip -> products -> ratios -> square -> norm -> interaction ->
    z-scores -> bins."""
    s = spec or RegressionSpec()
    out = X.iqr_clip(df, list(s.clip_cols))
    out = X.products(out, s.products)
    out = X.raw_ratios(out, s.ratios)
    out = X.squares(out, s.squares)
    out = X.norms(out, s.norms)
    out = X.products(out, s.interactions)
    # every later statistic is fitted on the clipped table in ONE pass
    ratio_names = [n for _, _, n in s.ratios]
    stats = X.table_stats(out, ratio_names, s.zscore_cols)
    out = X.fill_ratios(out, ratio_names, stats)
    out = X.zscores(out, s.zscore_cols, stats=stats)
    return X.bucketize(out, s.bucket_col, s.bucket_edges, s.bucket_labels, s.bucket_name)


def chain_fitted_on(tagged: DataFrame, chain, kind: str, class_spec, regression_spec) -> DataFrame:
    """Fit the chain's statistics on the rows with is_test = false and apply
    them to every row of `tagged`."""
    train = tagged.where(~F.col("is_test"))
    if kind == "class":
        s = class_spec or ClassSpec()
        out = X.rename(tagged, s.rename)
        out = out.withColumn(s.label_name, X.map_values(s.label_col, s.label_map))
        out = X.raw_ratios(X.products(out, s.area_pairs), [s.ratio])
        fit = X.raw_ratios(X.products(X.rename(train, s.rename), s.area_pairs), [s.ratio])
        stats = X.table_stats(fit, [s.ratio[2]], s.zscore_cols)
        return X.zscores(X.fill_ratios(out, [s.ratio[2]], stats), s.zscore_cols, stats=stats)
    s = regression_spec or RegressionSpec()
    bounds = X.iqr_bounds(train, list(s.clip_cols))
    out = X.clip_with(tagged, bounds, list(s.clip_cols))
    out = X.products(out, s.products)
    out = X.raw_ratios(out, s.ratios)
    out = X.squares(out, s.squares)
    out = X.norms(out, s.norms)
    out = X.products(out, s.interactions)
    ratio_names = [n for _, _, n in s.ratios]
    stats = X.table_stats(out.where(~F.col("is_test")), ratio_names, s.zscore_cols)
    out = X.fill_ratios(out, ratio_names, stats)
    out = X.zscores(out, s.zscore_cols, stats=stats)
    return X.bucketize(out, s.bucket_col, s.bucket_edges, s.bucket_labels, s.bucket_name)


# ---------------------------------------------------------------------------
# PIP3: the prepare job
# ---------------------------------------------------------------------------

@dataclass
class Prepared:
    checks: DataFrame
    processed: DataFrame | None
    summary: DataFrame | None
    train: DataFrame | None
    test: DataFrame | None
    scaler_params: DataFrame | None


def prepare(df: DataFrame, kind: str, key: str, target: str,
            test_size: float = 0.2, seed: int = 42, scaler: str = "standard",
            class_spec: ClassSpec | None = None,
            regression_spec: RegressionSpec | None = None,
            required_columns: Sequence[str] = (),
            allowed_targets: Sequence | None = None, fit_on: str = "all") -> Prepared:
    """validate -> (stop if invalid) -> preprocess -> checkpoint -> profile ->
    split -> scale.  `kind` is "class" or "regression"; anything else is an
    error.  Only the validity verdict is collected (one boolean).

    fit_on="all" fits the chain's statistics (clip bounds, ratio means,
    z-scores) on every row before the split, as the source pipeline did;
    fit_on="train" fits them on the training side only and applies them to
    both sides (no test-set leakage)."""
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    if kind not in ("class", "regression"):
        raise ValueError(f"unknown dataset kind {kind!r}")
    checks = V.table_checks(df, required_columns=required_columns, target=target,
                            allowed_targets=allowed_targets)
    valid = V.table_is_valid(checks).first()["valid"]
    if not valid:
        return Prepared(checks, None, None, None, None, None)
    chain = (lambda d: class_chain(d, class_spec)) if kind == "class" else \
        (lambda d: regression_chain(d, regression_spec))
    strat = (class_spec or ClassSpec()).label_col if kind == "class" else None
    if fit_on == "train":
        # split the raw rows first; the chain is fitted on the train side
        raw = (SP.stratified_split(df, key, strat, test_size, seed) if strat
               else SP.hash_split(df, key, test_size, seed))
        processed = chain_fitted_on(raw, chain, kind, class_spec, regression_spec)
    else:
        processed = chain(df)
    # reused by profile, split, scale and save: written once as Parquet (a
    # checkpoint would compute the chain twice), so each pass reads its columns
    processed = stage(processed, "processed")
    summary = P.numeric_summary(processed.drop("is_test") if "is_test" in processed.columns
                                else processed)
    if "is_test" in processed.columns:
        tagged = processed
    elif strat is not None:
        tagged = SP.stratified_split(processed, key, strat, test_size, seed)
    else:
        tagged = SP.hash_split(processed, key, test_size, seed)
    train = tagged.where(~F.col("is_test")).drop("is_test")
    test = tagged.where(F.col("is_test")).drop("is_test")
    feats = [c for c in P.numeric_columns(processed) if c not in (key, target)]
    # one row a feature, fitted once for both sides
    params = SC.fit_scaler(train, feats, scaler)
    params = params.sparkSession.createDataFrame(params.collect(), params.schema)
    return Prepared(checks, processed, summary, SC.apply_scaler(train, params, feats),
                    SC.apply_scaler(test, params, feats), params)


def prepare_named(spark, name: str, catalog, root: str, **options) -> tuple[Prepared, tuple | None]:
    """PIP3 end to end: the named dataset is loaded (an unknown name is an
    error), prepared and, if valid, saved as a raw / processed pair under
    `root`.  Returns the preparation and the two paths."""
    raw = IO.load_dataset(spark, name, catalog)
    prep = prepare(raw, **options)
    saved = None if prep.processed is None else IO.save_pair(raw, prep.processed, name, root)
    return prep, saved


__all__ = ["prepare_named", "class_chain", "regression_chain", "prepare", "chain_fitted_on", "ClassSpec",
           "RegressionSpec"]
