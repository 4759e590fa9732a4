"""Detection of column kinds from names, types and the profile."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.datetimes import is_datetime, parse_formats
from scorewright.operators.binning import small_domains
from scorewright.operators.profile import profile, value_counts

# Name patterns that decide a column's kind.
ID_PATTERNS = [
    "id", "uuid", "guid", "pk", "fk", "_id", "idx", "serial_no", "serial_num", "seq_no", "seq_num",
    "bianhao", "xulie", "liushui", "xuhao",
]
ID_NAMES = ["no", "num", "index", "key", "code", "serial", "seq", "number"]
TIME_PATTERNS = [
    "datetime", "timestamp", "created_at", "updated_at", "modified_at", "created_time", "updated_time",
    "create_time", "update_time", "_date", "date_", "_time", "time_", "riqi", "shijian",
]
TIME_NAMES = [
    "date", "time", "dt", "ts", "year", "month", "day", "hour", "minute", "created", "updated", "modified", "expired",
]
NOT_TIME_WORDS = [
    "cnt", "count", "num", "ratio", "rate", "amt", "amount", "score", "flag", "type", "status", "level", "idx", "index",
]
SAMPLE_PATTERNS = [
    "sample_type", "sampletype", "sample", "set_type", "settype", "data_type", "datatype", "dataset", "data_set",
    "train_test", "traintest", "split", "fold", "is_train", "is_test", "is_oot", "is_valid", "is_validation",
]
SAMPLE_VALUES = [
    "train", "test", "oot", "valid", "validation", "dev", "eval", "training", "testing", "holdout", "out_of_time",
    "训练", "测试", "验证", "样本外",
]
TIME_CANDIDATE_WORDS = [
    "date", "time", "dt", "month", "year", "period", "day", "日期", "时间", "月份", "年份", "期数", "apply_date",
    "loan_date", "create_time", "update_time", "obs_date", "observation_date",
]
COUNT_WORDS = [
    "cnt", "count", "num", "times", "days", "months", "overdue", "delinq", "past_due", "balance", "amount", "amt",
    "sum", "total", "avg", "ratio", "rate", "pct", "percent",
]


def _bounded(name: str, patterns: Sequence[str]) -> bool:
    """A pattern makes up whole parts of the name, parts being what underscores and digits divide."""
    between = r"[_\d]"
    parts = re.compile(rf"(?:\A|{between})(?:{'|'.join(map(re.escape, patterns))})(?:{between}|\Z)")
    return parts.search(name.lower()) is not None


def named_id(name: str) -> bool:
    return name.lower() in ID_NAMES or _bounded(name, ID_PATTERNS)


def named_time(name: str) -> bool:
    return name.lower() in TIME_NAMES or _bounded(name, TIME_PATTERNS)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Date and timestamp columns, and text columns whose every value reads as a time."""
    out = [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in exclude]
    texts = [c for c in text_columns(df) if c not in exclude]
    if texts:
        aggs = []
        for i, c in enumerate(texts):
            x = F.col(f"`{c}`")
            aggs += [F.count(x).alias(f"n{i}"), F.count(x.try_cast("timestamp")).alias(f"t{i}")]
        row = df.agg(*aggs).first()
        out += [c for i, c in enumerate(texts) if row[f"n{i}"] and row[f"n{i}"] == row[f"t{i}"]]
    return [c for c in df.columns if c in out]


def long_text_columns(df: DataFrame, exclude: Sequence[str] = (), min_unique: float = 0.5, min_length: float = 20.0) -> list[str]:
    cols = [c for c in text_columns(df) if c not in exclude]
    if not cols:
        return []
    return [
        r["column"] for r in profile(df, cols, "approx", lambda c, d, n: abs(d - min_unique * n) <= 0.05 * n).collect()
        if r["n"] and r["n_distinct"] / r["n"] >= min_unique and (r["avg_length"] or 0) >= min_length
    ]


# Integer columns that count as codes. Bounds of distinct values, lowest value, highest value (above which
# the test fails) and density (distinct values per step of the range), and whether names of counts are let off.
INF = float("inf")
CODE_TESTS = [
    ("binary", (2, 2), (0, INF), 2.5, INF, False),
    ("small_range", (0, 15), (1, INF), 20, INF, False),
    ("small_range_from_zero", (0, 10), (0, 0), 15, INF, True),
    ("sparse_encoding", (0, 15), (-INF, INF), 1000, 0.3, True),
    ("medium_sparse", (11, 50), (1, INF), 100, 0.5, True),
]


def integer_kind(name: str, n_unique: int, low: float, high: float) -> tuple[bool, str]:
    """Whether an integer column looks like a code rather than a quantity, and why."""
    if not n_unique:
        return False, "empty"
    density = n_unique / (high - low + 1)
    if low in (0, 1) and high > 20 and density >= 0.3 and n_unique >= 10:
        return False, "ordinal_numeric"
    counted = any(w in name.lower() for w in COUNT_WORDS)
    for kind, distinct, lowest, below, dense, spare_counts in CODE_TESTS:
        fits = distinct[0] <= n_unique <= distinct[1] and lowest[0] <= low <= lowest[1] and high < below and density < dense
        if fits and not (spare_counts and counted):
            return True, kind
    return False, "excluded_count_feature" if counted else "not_categorical"


def categorical_report(
    df: DataFrame, exclude: Sequence[str] = (), max_categories: int = 50, force_categorical: Sequence[str] = (), force_numeric: Sequence[str] = ()
) -> DataFrame:
    """(column, is_categorical, reason, source) for text, integer and forced columns."""
    ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name not in exclude}
    look = [c for c, t in kinds.items() if isinstance(t, (T.StringType, *ints)) and c not in force_numeric and c not in force_categorical]
    # codes have few values; counts near or under the limits are taken exactly
    close = 2 * max(max_categories, 50)
    prof = {r["column"]: r for r in profile(df, look, "approx", lambda c, d, n: d <= close).collect()} if look else {}
    rows = []
    for c in kinds:
        if c in force_numeric:
            rows.append((c, False, "force_numeric", "user"))
        elif c in force_categorical:
            rows.append((c, True, "force_categorical", "user"))
        elif c in prof:
            r = prof[c]
            if isinstance(kinds[c], T.StringType):
                few = r["n_distinct"] <= max_categories
                rows.append((c, few, "text_type" if few else "high_cardinality", "auto"))
            else:
                rows.append((c, *integer_kind(c, r["n_distinct"], r["min"], r["max"]), "auto"))
    return df.sparkSession.createDataFrame(rows, "column string, is_categorical boolean, reason string, source string")


def binary_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """0/1 features by name marker or by value."""
    from scorewright.operators.rules import BINARY_MARKERS

    named = [f for f in features if any(m in f for m in BINARY_MARKERS)]
    rest = [f for f in features if f not in named]
    small = small_domains(df, rest, 2)
    return [f for f in features if f in named or (f in small and set(small[f]) <= {0.0, 1.0})]


def non_feature_columns(df: DataFrame, exclude: Sequence[str] = (), uniqueness: float = 0.95) -> DataFrame:
    """(column, reason): id, time, sample_type, high_cardinality; a column may have several of the first three."""
    cols = [c for c in df.columns if c not in exclude]
    types = {f.name: f.dataType for f in df.schema.fields}
    near = 0.05
    prof = {
        r["column"]: r
        for r in profile(df, cols, "approx", lambda c, d, n: d <= 10 or abs(d - uniqueness * n) <= near * n).collect()
    }
    texts = [c for c in cols if isinstance(types[c], T.StringType)]
    ask = [c for c in texts if not named_time(c) and not any(w in c.lower() for w in NOT_TIME_WORDS)]
    parsed: set[str] = set()
    if ask:
        aggs = []
        for i, c in enumerate(ask):
            x = F.col(f"`{c}`")
            aggs += [
                F.count(x).alias(f"n{i}"), F.count(F.when(x.rlike("[-/:]"), 1)).alias(f"s{i}"),
                F.count(F.when(F.length(x) >= 6, 1)).alias(f"l{i}"), F.count(x.try_cast("timestamp")).alias(f"t{i}"),
            ]
        r = df.agg(*aggs).first()
        for i, c in enumerate(ask):
            n = r[f"n{i}"]
            if n and (r[f"s{i}"] / n > 0.5 or r[f"l{i}"] / n > 0.8) and r[f"t{i}"] / n > 0.8:
                parsed.add(c)
    few = [c for c in cols if isinstance(types[c], T.StringType) or prof[c]["n_distinct"] <= 5]
    sample: set[str] = set()
    if few:
        # the word list bounds the result, not the columns
        hits = value_counts(df, few).where(F.lower(F.trim("value")).isin(SAMPLE_VALUES)).select("column").distinct()
        sample = {r["column"] for r in hits.collect()}
    rows: list[tuple[str, str]] = []
    for c in cols:
        reasons = []
        if named_id(c):
            reasons.append("id")
        if named_time(c) or is_datetime(types[c]) or c in parsed:
            reasons.append("time")
        if any(p in c.lower() for p in SAMPLE_PATTERNS) or c in sample:
            reasons.append("sample_type")
        r = prof[c]
        if not reasons and not isinstance(types[c], (T.FloatType, T.DoubleType)) and r["n"] and r["n_distinct"] / r["n"] >= uniqueness:
            reasons.append("high_cardinality")
        rows += [(c, x) for x in reasons]
    return df.sparkSession.createDataFrame(rows, "column string, reason string")


def time_candidates(df: DataFrame) -> DataFrame:
    """Columns that may order the rows in time: format, name match, parseable; best first."""
    cols = [f.name for f in df.schema.fields if is_datetime(f.dataType) or isinstance(f.dataType, (T.StringType, T.NumericType))]
    fmts = parse_formats(df, cols)
    rows = []
    for c in cols:
        by_name = any(w in c.lower() for w in TIME_CANDIDATE_WORDS)
        ok = fmts[c] is not None
        if by_name or ok:
            fmt = {"yyyyMMdd": "YYYYMMDD", "yyyyMM": "YYYYMM", "datetime": "datetime", "numeric": "numeric"}.get(fmts[c] or "", "string")
            rows.append((c, fmt, by_name, ok, (2 if by_name and ok else 1 if ok else 0)))
    rows.sort(key=lambda r: -r[4])
    return df.sparkSession.createDataFrame(rows, "column string, format string, name_match boolean, parseable boolean, priority int")

