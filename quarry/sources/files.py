"""File sources and sinks (SRC1-2, SNK1-4, FPR1).

Every reader passes a declared schema (no inference: a column holding "NA"
would otherwise be typed as string); every writer writes directories, so the
work is split across tasks.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def load_dataset(spark: SparkSession, name: str, catalog: Mapping[str, tuple[str, str]]) -> DataFrame:
    """SRC1: dataset name -> table; catalog maps name -> (path, format).
    An unknown name is an error."""
    key = name.lower()
    if key not in catalog:
        raise ValueError(f"Unknown dataset: {name}")
    path, fmt = catalog[key]
    return spark.read.format(fmt).load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC2: header CSV with a declared schema; 'NA' reads as NULL and 'NaN'
    as NaN."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", "NA")
            .option("nanValue", "NaN").option("mode", "FAILFAST").csv(path))


RAW, ERRORS = "raw_record", "parse_errors"


def _typed(text: Column, kind: T.DataType, missing: str | None) -> tuple[Column, Column]:
    """(the text as a value of the type, whether it isn't one)."""
    given = text if missing is None else F.nullif(text, F.lit(missing))
    value = given.cast("string") if isinstance(kind, T.StringType) else F.trim(given).try_cast(kind)
    return value, given.isNotNull() & value.isNull()


def _checked(rows: DataFrame, cells: Mapping[str, Column], fields: list[T.StructField], raw: Column,
             broken: Column, reason: str, missing: str | None = None,
             keep: Sequence[str] = ()) -> DataFrame:
    """Kept and typed columns, `parse_errors` (why the record is bad; empty: it
    is good) and `raw_record` (its text, of bad records only)."""
    typed = {f.name: _typed(cells[f.name], f.dataType, missing) for f in fields}
    wrong = F.filter(F.array(F.when(broken, F.lit(reason)), *[
        F.when(~broken & bad, F.lit(f"{f.name}: not {f.dataType.simpleString()}"))
        for f, (_, bad) in zip(fields, typed.values())]), lambda e: e.isNotNull())
    out = rows.select(*keep, *[F.when(~broken, v).alias(n) for n, (v, _) in typed.items()],
                      wrong.alias(ERRORS), raw.alias(RAW))
    return out.withColumn(RAW, F.when(F.size(ERRORS) > 0, F.col(RAW)))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC2 for input that may be malformed: every record comes back, with its
    errors.  Fields are read as text and cast one by one, so an error names
    its column; a record of too few or too many fields is one error.  'NA'
    reads as NULL.  Pass the result to `validate.apply_rules` and
    `validate.route`."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields],
                         T.StructField("_broken", T.StringType())])
    # without pruning, so that a record's width is checked whatever is read of it
    rows = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_broken").option("columnPruning", False).csv(path))
    told = F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("NA")) for f in fields])
    return _checked(rows, {f.name: F.col(f.name) for f in fields}, fields,
                    F.coalesce("_broken", told), F.col("_broken").isNotNull(),
                    f"record: not {len(fields)} fields", "NA")


def parse_json_checked(df: DataFrame, column: str, schema: T.StructType | str,
                       keep: Sequence[str] = ()) -> DataFrame:
    """JSN1 for records that may be malformed: flat JSON objects in a text
    column become typed columns beside `keep`, errors as in
    `read_csv_checked`.  Fields that are absent or null, and all fields of a
    NULL text, are NULL."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    rows = df.withColumn("_cells", F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"}))
    cells = {f.name: F.try_element_at(F.col("_cells"), F.lit(f.name)) for f in fields}
    broken = F.col("_cells").isNull() & F.col(column).isNotNull()
    return _checked(rows, cells, fields, F.col(column), broken, "record: not a JSON object", keep=keep)


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(1).count()
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def read_or_default(spark: SparkSession, path: str | None, schema, default) -> DataFrame:
    """SRC2 (retraining input): the given CSV path if it exists, else the
    default dataset (a callable returning a DataFrame)."""
    if path and path_exists(spark, path):
        return read_csv(spark, path, schema)
    return default()


def save_pair(raw: DataFrame, processed: DataFrame, name: str, root: str,
              fmt: str = "parquet") -> tuple[str, str]:
    """SNK1: overwrite {name}_raw and {name}_processed under root."""
    out = []
    for df, suffix in ((raw, "raw"), (processed, "processed")):
        path = f"{root.rstrip('/')}/{name}_{suffix}"
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        w.save(path)
        out.append(path)
    return out[0], out[1]


def append_log(rows: DataFrame, path: str, partition_col: str = "event_date") -> None:
    """SNK2 / SNK3: append rows to a log table partitioned by day, so
    trailing-window readers prune partitions."""
    if partition_col not in rows.columns:
        rows = rows.withColumn(partition_col, F.to_date("ts"))
    rows.write.mode("append").partitionBy(partition_col).parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """SNK4: report rows as JSON lines (one object per row)."""
    report.write.mode("overwrite").json(path)


def dataset_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """FPR1: order-independent content fingerprint of a table: per-row md5 of
    the values, each with its length before it (NULL as '-'), so no two rows
    share a text; both 64-bit halves of the digest are summed over the rows;
    plus the row count and the total text length.  Equal tables give equal
    fingerprints regardless of partitioning or row order.  Sums are exact
    decimals reported as text."""
    row = F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
                     for c in (F.col(x).cast("string") for x in df.columns)])

    def half(start: int) -> Column:
        return F.sum(F.conv(F.substring(F.md5(row), start, 16), 16, 10).cast("decimal(38,0)"))

    return df.agg(
        F.lit(name).alias("dataset"),
        F.concat_ws("-", half(1).cast("string"), half(17).cast("string")).alias("hash_sum"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.length(row).cast("decimal(38,0)")).cast("string").alias("n_chars"),
    )


def fingerprint_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compare two fingerprints: one row with `changed`."""
    x = a.select(F.struct("hash_sum", "n_rows", "n_chars").alias("fa"))
    y = b.select(F.struct("hash_sum", "n_rows", "n_chars").alias("fb"))
    return x.select((F.col("fa") != y.select("fb").scalar()).alias("changed"))
