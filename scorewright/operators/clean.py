"""Column cleaning, sentinels, one-hot encoding and the combined preprocessing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.datetimes import DEFAULT_DATETIME_FEATURES, add_datetime_features
from scorewright.functions.numeric import distinct_estimate, nan_to_null, numeric_columns
from scorewright.functions.texts import add_text_features
from scorewright.operators.columns import categorical_report, datetime_columns, long_text_columns, named_id
from scorewright.operators.profile import constant_columns, missing_report

# Numbers that stand for "missing".
SENTINELS = [-9999, -999, -99999, -998, -9998, -99998]


def rename_features(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_constant(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    cols = [c for c in df.columns if c not in exclude]
    gone = [r["column"] for r in constant_columns(df, cols).where("is_constant").collect()]
    return df.drop(*gone), gone


def drop_high_missing(df: DataFrame, limit: float = 0.9, exclude: Sequence[str] = (), strict: bool = False) -> tuple[DataFrame, list[str]]:
    """Drops columns missing in at least ``limit`` of the rows; ``strict`` compares the 4-digit rate with >."""
    cols = [c for c in df.columns if c not in exclude]
    rate = F.round("missing_rate", 4) > limit if strict else F.col("missing_rate") >= limit
    gone = [r["variable"] for r in missing_report(df, cols).where(rate).collect()]
    return df.drop(*gone), gone


def clean_columns(
    df: DataFrame, exclude: Sequence[str] = (), id_cols: Sequence[str] = (), extra: Sequence[str] = (), auto_id: bool = False,
    constant: bool = True, missing_limit: float | None = None,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Drops id, extra, constant and (optionally) mostly missing columns; reports what went."""
    gone: dict[str, list[str]] = {"id": [], "extra": [c for c in extra if c in df.columns], "constant": [], "missing": []}
    gone["id"] = [c for c in df.columns if c not in exclude and (c in id_cols or (auto_id and named_id(c)))]
    out = df.drop(*gone["id"], *gone["extra"])
    if constant:
        out, gone["constant"] = drop_constant(out, exclude)
    if missing_limit is not None:
        out, gone["missing"] = drop_high_missing(out, missing_limit, exclude)
    return out, gone


def sentinels_to_null(df: DataFrame, cols: Sequence[str] | None = None, values: Sequence[float] = tuple(SENTINELS)) -> DataFrame:
    cols = set(numeric_columns(df) if cols is None else cols)
    return df.select(*[
        F.when(~F.coalesce(F.col(f"`{c}`").isin(list(values)), F.lit(False)), F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`")
        for c in df.columns
    ])


def sentinel_counts(df: DataFrame, cols: Sequence[str] | None = None, values: Sequence[float] = tuple(SENTINELS)) -> DataFrame:
    cols = list(numeric_columns(df) if cols is None else cols)
    wide = df.agg(*[F.count(F.when(F.col(f"`{c}`").isin(list(values)), 1)).alias(c) for c in cols])
    return wide.unpivot([], [f"`{c}`" for c in cols], "column", "n_replaced")


def listwise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    feats = numeric_columns(df, list(exclude))
    if not feats:
        raise ValueError("no numeric feature left")
    return feats


# ---------------------------------------------------------------- one-hot


def categories(df: DataFrame, columns: Sequence[str], max_categories: int = 50) -> dict[str, list[str]]:
    """Sorted values of columns with at most ``max_categories`` of them, as text."""
    cols = list(columns)
    if not cols:
        return {}
    est = df.agg(*[distinct_estimate(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    near = [c for i, c in enumerate(cols) if est[f"d{i}"] <= 2 * max_categories]
    if not near:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"v{i}") for i, c in enumerate(near)]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(near) if len(row[f"v{i}"]) <= max_categories}


def one_hot(df: DataFrame, columns: Sequence[str], max_categories: int = 50, drop_original: bool = True) -> tuple[DataFrame, dict[str, list[str]]]:
    """Adds ``{column}_is_{value}`` 0/1 columns in one projection; returns the mapping."""
    values = categories(df, columns, max_categories)
    new = [
        F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_is_{v}")
        for c, vs in values.items() for v in vs
    ]
    out = df.select("*", *new)
    mapping = {c: [f"{c}_is_{v}" for v in vs] for c, vs in values.items()}
    return (out.drop(*values) if drop_original else out), mapping


# ---------------------------------------------------------------- combined


def preprocess(
    df: DataFrame, exclude: Sequence[str] = (), id_cols: Sequence[str] = (), auto_id: bool = False, missing_limit: float | None = None,
    datetime_features: Sequence[str] = tuple(DEFAULT_DATETIME_FEATURES), keywords: Mapping[str, Sequence[str]] | None = None,
    max_categories: int = 20, force_categorical: Sequence[str] = (), force_numeric: Sequence[str] = (), sentinels: bool = True,
) -> tuple[DataFrame, dict]:
    """Clean, then derive datetime, text and one-hot features; ``info`` lists every decision."""
    info: dict = {}
    out = nan_to_null(df)
    if sentinels:
        out = sentinels_to_null(out, [c for c in numeric_columns(out) if c not in exclude])
    out, info["dropped"] = clean_columns(out, exclude, id_cols, auto_id=auto_id, missing_limit=missing_limit)
    info["datetime"] = datetime_columns(out, exclude)
    out = add_datetime_features(out, info["datetime"], datetime_features) if info["datetime"] else out
    info["text"] = long_text_columns(out, exclude)
    out = add_text_features(out, info["text"], keywords=keywords) if info["text"] else out
    report = categorical_report(out, exclude, max_categories, force_categorical, force_numeric)
    derived = ("_dt_", "_txt_")
    cats = [r["column"] for r in report.where("is_categorical").collect() if not any(m in r["column"] for m in derived)]
    out, info["one_hot"] = one_hot(out, cats, max_categories)
    return out, info
