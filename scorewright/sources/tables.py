"""Readers: CSV, Parquet, rule files and name mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scorewright.functions.numeric import nan_to_null

# Encodings tried in turn for rule files.
ENCODINGS = ["utf-8", "gbk", "utf-8-sig"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV; types are inferred (an extra pass) only when no schema is given."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", False)
    if schema is None:
        return nan_to_null(reader.option("inferSchema", True).csv(path))
    return nan_to_null(reader.csv(path, schema=schema))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def describe_columns(df: DataFrame) -> DataFrame:
    """(position, column, dtype) from the schema alone; no rows are read."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def read_rule_file(spark: SparkSession, path: str) -> DataFrame:
    """Rule CSV with lower-cased headers; a file that does not decode as UTF-8 is read as GBK.

    Spark 4 reads GBK only with ``spark.sql.legacy.javaCharsets``, which is switched
    on for the session when it is needed.
    """
    for enc in ENCODINGS:
        if enc == "gbk":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        df = spark.read.option("header", True).option("encoding", "UTF-8" if enc == "utf-8-sig" else enc).csv(path)
        df = df.toDF(*[c.strip().lstrip("﻿").lower() for c in df.columns])
        broken = df.where(" OR ".join(f"`{c}` LIKE '%�%'" for c in df.columns) or "false")
        if not any("�" in c for c in df.columns) and broken.isEmpty():
            return df
    raise ValueError(f"{path} is neither UTF-8 nor GBK")


def read_name_mapping(spark: SparkSession, path: str, key: str = "feature_code", value: str = "feature_name") -> dict[str, str]:
    """code -> name; one entry per feature, so it is as small as the schema it renames."""
    rows = spark.read.option("header", True).csv(path).select(key, value).dropna().collect()
    return {r[0]: r[1] for r in rows}
