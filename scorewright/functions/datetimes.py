"""Datetime features and parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Supported features, default features and accepted date formats.
DATETIME_FEATURES = [
    "year", "month", "day", "dayofweek", "hour", "minute", "quarter",
    "is_weekend", "is_month_start", "is_month_end", "days_since",
]
DEFAULT_DATETIME_FEATURES = ["year", "month", "dayofweek", "hour", "days_since"]
TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy", "dd/MM/yyyy",
]
MIN_VALID_SHARE = 0.9


def datetime_feature(c: Column, name: str, reference: Column | None = None) -> Column:
    day = F.to_date(c)
    table = {
        "year": lambda: F.year(c), "month": lambda: F.month(c), "day": lambda: F.dayofmonth(c),
        "dayofweek": lambda: F.weekday(c), "hour": lambda: F.hour(c), "minute": lambda: F.minute(c),
        "quarter": lambda: F.quarter(c),
        "is_weekend": lambda: F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0)),
        "is_month_start": lambda: F.coalesce((F.dayofmonth(c) == 1).cast("int"), F.lit(0)),
        "is_month_end": lambda: F.coalesce((day == F.last_day(day)).cast("int"), F.lit(0)),
        "days_since": lambda: F.floor((F.unix_micros(reference) - F.unix_micros(c)) / F.lit(86_400_000_000)),
    }
    return table[name]()


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Session-zone timestamp of a date, timestamp or timestamp_ntz column."""
    return F.col(f"`{name}`").cast("timestamp")


def add_datetime_features(
    df: DataFrame, columns: Sequence[str], features: Sequence[str] = tuple(DEFAULT_DATETIME_FEATURES),
    reference: str | None = None, drop_original: bool = True,
) -> DataFrame:
    """Adds ``{column}_dt_{feature}``; ``days_since`` counts whole days to the column maximum or ``reference``."""
    unknown = set(features) - set(DATETIME_FEATURES)
    if unknown:
        raise ValueError(f"unsupported datetime features: {sorted(unknown)}")
    ref: dict[str, Column] = {}
    if "days_since" in features:
        if reference:
            ref = {c: F.lit(reference).cast("timestamp") for c in columns}
        else:
            top = df.agg(*[F.max(as_timestamp(df, c)).cast("string").alias(c) for c in columns]).first()
            ref = {c: F.lit(top[c]).cast("timestamp") for c in columns}
    new = [
        datetime_feature(as_timestamp(df, c), f, ref.get(c)).cast("long").alias(f"{c}_dt_{f}")
        for c in columns for f in features
    ]
    out = df.select("*", *new)
    return out.drop(*columns) if drop_original else out


def is_datetime(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def parse_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """First format that reads more than 90% of each text or number column, decided in one scan.

    Numbers are tried as YYYYMMDD, then YYYYMM; ``numeric`` means sortable as is.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if all(is_datetime(types[c]) for c in columns):
        return dict.fromkeys(columns, "datetime")
    aggs, tried = [F.count(F.lit(1)).alias("n")], {}
    for i, c in enumerate(columns):
        if is_datetime(types[c]):
            continue
        text = isinstance(types[c], T.StringType)
        tried[c] = TIME_FORMATS if text else ["yyyyMMdd", "yyyyMM"]
        for j, fmt in enumerate(tried[c]):
            aggs.append(F.count(parse_time(F.col(f"`{c}`"), fmt, text)).alias(f"p{i}_{j}"))
        if text:
            aggs.append(F.count(F.col(f"`{c}`").try_cast("timestamp")).alias(f"g{i}"))
    row = df.agg(*aggs).first()
    out: dict[str, str | None] = {}
    for i, c in enumerate(columns):
        if is_datetime(types[c]):
            out[c] = "datetime"
            continue
        n = row["n"] or 1
        hit = next((f for j, f in enumerate(tried[c]) if row[f"p{i}_{j}"] / n > MIN_VALID_SHARE), None)
        if hit is None and isinstance(types[c], T.StringType):
            hit = "inferred" if row[f"g{i}"] / n > MIN_VALID_SHARE else None
        elif hit is None:
            hit = "numeric"
        out[c] = hit
    return out


def parse_time(c: Column, fmt: str, text: bool = True) -> Column:
    if fmt == "datetime":
        return c.cast("timestamp")
    if fmt == "inferred":
        return c.try_cast("timestamp")
    if text:
        return F.try_to_timestamp(c, F.lit(fmt))
    digits = c.cast("long")
    low, high, scale = (19000101, 21001231, 1) if fmt == "yyyyMMdd" else (190001, 210012, 100)
    day = digits * scale + (0 if scale == 1 else 1)
    ok = (digits >= low) & (digits <= high)
    return F.when(ok, F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd")))


def order_value(df: DataFrame, column: str, fmt: str | None) -> Column:
    """Number that sorts rows by time: microseconds since the epoch, or the number itself."""
    if fmt is None:
        raise ValueError(f"cannot read {column} as a time")
    if fmt == "numeric":
        return F.col(f"`{column}`").cast("double")
    text = isinstance(df.schema[column].dataType, T.StringType)
    return F.unix_micros(parse_time(F.col(f"`{column}`"), fmt, text).cast("timestamp"))
