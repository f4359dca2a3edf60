"""Delimited and Parquet tables, schema checks, optional inputs, result and report sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column names accepted in threshold files, in order of preference.
MODEL_ALIASES = ("model", "model_name", "estimator", "clf")
THRESHOLD_ALIASES = ("threshold", "thr", "best_threshold", "value")
NAME_ALIASES = ("threshold_name", "thr_name", "name", "rule", "method", "selector", "type")


def scan_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Read a headered CSV or a Parquet table. Without a schema, CSV types are inferred.

    Inference reads the text twice, so give the schema for large inputs.
    """
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    """``df`` itself, or an error naming every missing column. Runs no job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def resolve_alias(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column of ``df``."""
    return next((c for c in candidates if c in df.columns), None)


def canonical_thresholds(df: DataFrame) -> DataFrame | None:
    """``model, threshold_name, threshold`` under their standard names.

    ``None`` when the model or the threshold column cannot be found. A missing name
    column gives null names.
    """
    df = trim_headers(df)
    model, thr = resolve_alias(df, MODEL_ALIASES), resolve_alias(df, THRESHOLD_ALIASES)
    name = resolve_alias(df, NAME_ALIASES)
    if model is None or thr is None:
        return None
    return df.select(
        F.col(model).cast("string").alias("model"),
        (F.col(name).cast("string") if name else F.lit(None).cast("string")).alias("threshold_name"),
        F.col(thr).alias("threshold"),
    )


def optional_source(
    spark: SparkSession, path: str | None, schema: T.StructType | str | None = None
) -> DataFrame | None:
    """The table, or ``None`` when no path is given or nothing is there."""
    if not path:
        return None
    try:
        return scan_table(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_table(df: DataFrame, path: str) -> str:
    """Write CSV or Parquet by extension, as many part files as the frame has partitions."""
    writer = df.write.mode("overwrite")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """Write nested columns as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path
