"""Column profile: one wide scan, plus one value-count job where exact distincts are asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.numeric import distinct_estimate, numeric_columns, ratio
from scorewright.functions.datetimes import is_datetime
from scorewright.operators.histogram import clean_double
from scorewright.operators.quantiles import quantiles

# Columns per aggregate; wider ones make generated code too large.
AGG_COLUMNS = 30

PROFILE_SCHEMA = (
    "column string, dtype string, n long, n_null long, null_rate double, n_distinct long, mode_share double, "
    "min double, max double, mean double, std double, avg_length double"
)


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _chunks(cols: Sequence[str], size: int = AGG_COLUMNS) -> list[list[str]]:
    return [list(cols[i:i + size]) for i in range(0, len(cols), size)]


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) in long form; equal values combine before the shuffle. 0.0 and -0.0 are one value."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    typed = {c: F.col(f"`{c}`") + F.lit(0.0).cast(kinds[c]) if kinds[c] in ("float", "double") else F.col(f"`{c}`") for c in cols}
    cells = [
        F.struct(F.lit(c).alias("column"), F.when(~is_missing(df, c), typed[c].cast("string")).alias("value"))
        for c in cols
    ]
    long = df.select(F.inline(F.array(*cells))).where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_and_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_distinct, mode_n, n_values) exactly."""
    return value_counts(df, cols).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("mode_n"), F.sum("n").alias("n_values")
    )


def profile(
    df: DataFrame, cols: Sequence[str] | None = None, distinct: str = "exact", exact_for: Callable[[str, int, int], bool] | None = None
) -> DataFrame:
    """One row per column. ``distinct``: exact (value counts), approx (sketch) or none.

    With ``approx``, ``exact_for(column, estimate, rows)`` picks the columns whose
    estimate is too close to call; only those pay for exact value counts.
    """
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    facts: dict[str, dict] = {}
    n = 0
    for chunk in _chunks(cols):
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(chunk):
            aggs.append(F.count(F.when(is_missing(df, c), 1)).alias(f"m{i}"))
            if isinstance(types[c], T.NumericType):
                x = clean_double(c)
                aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"u{i}"), F.stddev_samp(x).alias(f"s{i}")]
            if isinstance(types[c], T.StringType):
                aggs.append(F.avg(F.length(f"`{c}`")).alias(f"l{i}"))
            if distinct == "approx":
                aggs.append(distinct_estimate(F.when(~is_missing(df, c), F.col(f"`{c}`"))).alias(f"d{i}"))
        row = df.agg(*aggs).first().asDict()
        n = row["n"]
        for i, c in enumerate(chunk):
            facts[c] = {k: row.get(f"{k}{i}") for k in "mabusld"}
    exact = cols if distinct == "exact" else [c for c in cols if exact_for and exact_for(c, facts[c]["d"], n)]
    if exact:
        for r in distinct_and_mode(df, exact).collect():
            facts[r["column"]].update(d=r["n_distinct"], mode=r["mode_n"] / r["n_values"])
        for c in exact:
            facts[c]["d"] = facts[c]["d"] or 0
    rows = [
        (c, types[c].simpleString(), n, f["m"], f["m"] / n if n else 0.0, f["d"], f.get("mode"), f["a"], f["b"], f["u"], f["s"], f["l"])
        for c, f in facts.items()
    ]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def preview(df: DataFrame, n: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """First n rows; with ``order`` the choice is deterministic (top-n, no full sort)."""
    return (df.orderBy(*order) if order else df).limit(n)


def sample_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Up to k smallest distinct values per column as text; the top-k is taken before the shuffle."""
    w = Window.partitionBy("column").orderBy("value")
    return value_counts(df, cols).select("column", "value", F.row_number().over(w).alias("r")).where(F.col("r") <= k).select("column", "value")


# ---------------------------------------------------------------- missing values


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(variable, missing_count, missing_rate), most missing first."""
    cols = list(cols or df.columns)
    parts = None
    for chunk in _chunks(cols):
        wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(is_missing(df, c), 1)).alias(c) for c in chunk])
        long = wide.unpivot("n", [f"`{c}`" for c in chunk], "variable", "missing_count")
        parts = long if parts is None else parts.unionByName(long)
    return parts.select(
        "variable", "missing_count", ratio(F.col("missing_count"), F.col("n")).alias("missing_rate")
    ).orderBy(F.desc("missing_rate"), "variable")


def missing_summary(report: DataFrame) -> DataFrame:
    r = F.col("missing_rate")
    return report.agg(
        F.avg(r).alias("avg_rate"), F.min(r).alias("min_rate"), F.max(r).alias("max_rate"), F.count(F.when(r > 0, 1)).alias("n_with_missing"),
        F.count(F.when(r == 0, 1)).alias("none"), F.count(F.when((r > 0) & (r <= 0.1), 1)).alias("upto_10"),
        F.count(F.when((r > 0.1) & (r <= 0.3), 1)).alias("upto_30"), F.count(F.when((r > 0.3) & (r <= 0.5), 1)).alias("upto_50"),
        F.count(F.when(r > 0.5, 1)).alias("over_50"),
    )


def top_missing(report: DataFrame, above: float = 0.3, k: int = 10) -> DataFrame:
    return report.where(F.col("missing_rate") > above).orderBy(F.desc("missing_rate"), "variable").limit(k)


# ---------------------------------------------------------------- constant / dominated columns


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with at most one distinct value: min = max, no distinct needed."""
    cols = list(cols or df.columns)
    found: list[tuple[str, bool]] = []
    for chunk in _chunks(cols):
        aggs = []
        for i, c in enumerate(chunk):
            x = F.when(~is_missing(df, c), F.col(f"`{c}`"))
            aggs.append(F.coalesce(F.min(x) == F.max(x), F.lit(True)).alias(f"k{i}"))
        row = df.agg(*aggs).first()
        found += [(c, row[f"k{i}"]) for i, c in enumerate(chunk)]
    return df.sparkSession.createDataFrame(found, "column string, is_constant boolean")


def quality_filter(df: DataFrame, cols: Sequence[str], missing_limit: float = 0.95, identical_limit: float = 0.95) -> DataFrame:
    """Missing rate and mode share per column with the reason it would be dropped."""
    miss = missing_report(df, cols)
    mode = distinct_and_mode(df, cols).select(F.col("column").alias("variable"), ratio(F.col("mode_n"), F.col("n_values")).alias("mode_share"))
    share = F.coalesce(F.col("mode_share"), F.lit(0.0))
    reason = (
        F.when(F.col("missing_rate") >= missing_limit, "missing").when(share >= identical_limit, "identical").otherwise("")
    )
    return miss.join(F.broadcast(mode), "variable", "left").select("variable", "missing_rate", share.alias("mode_share"), reason.alias("reason"))


def dominated_columns(df: DataFrame, cols: Sequence[str], limit: float = 0.95) -> dict[str, float]:
    """Columns where one value holds at least ``limit`` (over one half) of the present rows, with its exact share.

    Such a value is also the median of any order, so the approximate median of a
    hash names the only candidate; counting it settles the matter without a shuffle.
    """
    if limit <= 0.5:
        raise ValueError("limit must be over one half")
    out: dict[str, float] = {}
    for chunk in _chunks(cols):
        # 52 bits, since the sketch works on doubles
        h = {c: F.when(~is_missing(df, c), F.shiftrightunsigned(F.xxhash64(F.col(f"`{c}`")), 12)) for c in chunk}
        mid = df.agg(*[F.percentile_approx(h[c], 0.5, 1000).alias(f"m{i}") for i, c in enumerate(chunk)]).first()
        aggs = []
        for i, c in enumerate(chunk):
            aggs += [F.count(h[c]).alias(f"n{i}"), F.count(F.when(h[c] == F.lit(mid[f"m{i}"]), 1)).alias(f"k{i}")]
        row = df.agg(*aggs).first()
        out.update({c: row[f"k{i}"] / row[f"n{i}"] for i, c in enumerate(chunk) if row[f"n{i}"] and row[f"k{i}"] >= limit * row[f"n{i}"]})
    return out


# ---------------------------------------------------------------- outliers


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, k·IQR bounds and the rows outside them."""
    q = quantiles(df, cols, [0.25, 0.75])
    live = [c for c in cols if None not in q[c]]
    bounds = {c: (q[c][0] - k * (q[c][1] - q[c][0]), q[c][1] + k * (q[c][1] - q[c][0])) for c in live}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(live):
        x = clean_double(c)
        aggs.append(F.count(F.when((x < bounds[c][0]) | (x > bounds[c][1]), 1)).alias(f"o{i}"))
    row = df.agg(*aggs).first()
    rows = [(c, q[c][0], q[c][1], *bounds[c], row[f"o{i}"], row[f"o{i}"] * 100.0 / row["n"]) for i, c in enumerate(live)]
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, q3 double, lower double, upper double, n_outliers long, pct double"
    )


def zscore_outliers(df: DataFrame, cols: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Rows more than ``limit`` sample standard deviations from the mean."""
    stats = df.agg(*[f(clean_double(c)).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("u", F.avg), ("s", F.stddev_samp))]).first()
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        u, s = stats[f"u{i}"], stats[f"s{i}"]
        far = F.abs(clean_double(c) - F.lit(u)) / F.lit(s) > limit if s else F.lit(False)
        aggs.append(F.count(F.when(far, 1)).alias(f"o{i}"))
    row = df.agg(*aggs).first()
    rows = [(c, stats[f"u{i}"], stats[f"s{i}"], row[f"o{i}"], row[f"o{i}"] * 100.0 / row["n"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, mean double, std double, n_outliers long, pct double")


def outlier_summary(outliers: DataFrame) -> DataFrame:
    return outliers.where("n_outliers > 0").orderBy(F.desc("pct"), "column")


# ---------------------------------------------------------------- quality score


def data_quality(
    df: DataFrame, target: str, weight: str | None = None, missing_limit: float = 0.3, cardinality_limit: int = 50, variance_limit: float = 0.01
) -> DataFrame:
    """Score 0-100 with its parts, and whether feature engineering is advised."""
    feats = [c for c in df.columns if c not in (target, weight)]
    numeric = set(numeric_columns(df))
    # only "one value" and "more than the limit" matter
    rows = profile(df, feats, "approx", lambda c, d, n: d <= 2 * cardinality_limit).collect()
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.sparkSession.createDataFrame(
        [_quality(rows, numeric, text, missing_limit, cardinality_limit, variance_limit)],
        "n_features long, avg_missing double, n_high_missing long, n_numeric long, n_text long, n_high_cardinality long, "
        "n_constant long, n_low_variance long, quality_score double, n_issues long, needs_feature_engineering boolean",
    )


def _quality(rows: Sequence[Row], numeric: set[str], text: set[str], missing_limit: float, cardinality_limit: int, variance_limit: float):
    n = len(rows)
    avg_missing = sum(r["null_rate"] for r in rows) / n if n else 0.0
    high_missing = sum(r["null_rate"] > missing_limit for r in rows)
    n_num = sum(r["column"] in numeric for r in rows)
    many = [r["column"] for r in rows if r["column"] not in numeric and r["n_distinct"] > cardinality_limit]
    # text columns count once as non-numeric and once as text
    high_card = len(many) + sum(c in text for c in many)
    const = low = 0
    for r in rows:
        if r["column"] in numeric and r["n_distinct"]:
            if r["n_distinct"] == 1:
                const += 1
            elif (r["std"] or 0.0) / (r["mean"] + 1e-10) < variance_limit:
                low += 1
    n_text = sum(r["column"] in text for r in rows)
    score = 100.0
    if n:
        score -= min(30.0, avg_missing * 100) + min(20.0, (1 - n_num / n) * 40)
        score -= min(15.0, high_card / n * 50) + min(15.0, (const + low) / n * 50)
    score = max(0.0, min(100.0, score))
    issues = sum(x > 0 for x in (high_missing, n_text, high_card, const))
    return (n, avg_missing, high_missing, n_num, n_text, high_card, const, low, score, issues, score < 70 or issues >= 2)


# ---------------------------------------------------------------- target and roles


def check_target(df: DataFrame, target: str) -> None:
    """Exactly two values, both 0 or 1."""
    y = F.col(f"`{target}`").try_cast("double")
    r = df.agg(
        F.count(F.when(y == 0, 1)).alias("n0"), F.count(F.when(y == 1, 1)).alias("n1"),
        F.count(F.when(y.isNotNull() & ~y.isin(0.0, 1.0), 1)).alias("other"), F.count(F.when(y.isNull() & F.col(f"`{target}`").isNotNull(), 1)).alias("text"),
    ).first()
    if not r["n0"] or not r["n1"] or r["other"] or r["text"]:
        raise ValueError(f"{target} must hold exactly the values 0 and 1")


def role_suggestions(df: DataFrame) -> DataFrame:
    """Numeric / categorical / binary flags and possible target, weight and id columns."""
    numeric = set(numeric_columns(df))
    prof = {r["column"]: r for r in profile(df, None, "approx", lambda c, d, n: d <= 4).collect()}
    two = [c for c, r in prof.items() if r["n_distinct"] == 2]
    zero_one = set()
    if two:
        row = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"v{i}") for i, c in enumerate(two)]).first()
        zero_one = {c for i, c in enumerate(two) if {v.removesuffix(".0") for v in row[f"v{i}"]} == {"0", "1"}}
    rows = []
    for f in df.schema.fields:
        low = f.name.lower()
        rows.append((
            f.name, f.name in numeric, isinstance(f.dataType, T.StringType), f.name in two, f.name in zero_one,
            f.name in numeric and ("weight" in low or "wt" in low), "id" in low or "uuid" in low, is_datetime(f.dataType),
        ))
    return df.sparkSession.createDataFrame(
        rows, "column string, is_numeric boolean, is_categorical boolean, is_binary boolean, maybe_target boolean, "
        "maybe_weight boolean, maybe_id boolean, is_datetime boolean",
    )


def feature_details(df: DataFrame, iv: DataFrame, features: Sequence[str], origin: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Profile of each feature with its IV, IV level and where it came from."""
    origin = origin or {}
    src = df.sparkSession.createDataFrame(
        [(f, *origin.get(f, ("original", f))) for f in features], "column string, source string, origin_column string"
    )
    level = F.when(F.col("iv") >= 0.3, "strong").when(F.col("iv") >= 0.1, "medium").when(F.col("iv") >= 0.02, "weak").otherwise("none")
    return profile(df, features).join(F.broadcast(iv.select(F.col("feature").alias("column"), "iv")), "column", "left").join(
        F.broadcast(src), "column"
    ).select(
        "column", "dtype", "iv", level.alias("iv_level"), F.col("null_rate").alias("missing_rate"), "n_distinct", "min", "max", "mean", "std", "source", "origin_column"
    )
