"""Cut points, WOE, IV and bin statistics on the long histogram."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.numeric import distinct_estimate, ratio
from scorewright.operators.histogram import binned_long, clean_double, edge_table, histogram
from scorewright.operators.quantiles import BUFFER_ROWS, column_ranges, quantiles

PCT_FLOOR = 1e-4
WOE_LIMIT = 10.0

Cuts = dict[str, list[float]]


# ---------------------------------------------------------------- cut points


def quantile_edges(df: DataFrame, features: Sequence[str], n_bins: int | Mapping[str, int], **kw) -> dict[str, list[float]]:
    """All distinct quantile edges including both ends; ``n_bins`` for all or per feature."""
    k = {f: n_bins[f] if isinstance(n_bins, Mapping) else n_bins for f in features}
    probs = {f: [i / k[f] for i in range(k[f] + 1)] for f in features}
    return {f: sorted({v for v in q if v is not None}) for f, q in quantiles(df, features, probs, **kw).items()}


def quantile_cuts(df: DataFrame, features: Sequence[str], n_bins: int | Mapping[str, int], **kw) -> Cuts:
    return {f: e[1:-1] for f, e in quantile_edges(df, features, n_bins, **kw).items()}


def uniform_edges(df: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    out = {}
    for f, (n, lo, hi) in column_ranges(df, features).items():
        if not n:
            out[f] = []
        elif lo == hi:
            out[f] = [lo]
        else:
            out[f] = [lo + (hi - lo) * i / n_bins for i in range(n_bins)] + [hi]
    return out


def uniform_cuts(df: DataFrame, features: Sequence[str], n_bins: int) -> Cuts:
    return {f: e[1:-1] for f, e in uniform_edges(df, features, n_bins).items()}


def kmeans_cuts(df: DataFrame, feature: str, n_bins: int, seed: int = 42) -> list[float]:
    """Upper end of every cluster but the last, clusters ordered by centre."""
    x = df.select(clean_double(feature).alias("x")).where("x IS NOT NULL")
    vec = VectorAssembler(inputCols=["x"], outputCol="v").transform(x)
    model = KMeans(featuresCol="v", k=n_bins, seed=seed, maxIter=50).fit(vec)
    tops = model.transform(vec).groupBy("prediction").agg(F.max("x").alias("top")).collect()
    return sorted({r["top"] for r in tops})[:-1]


def rounded_thresholds(cuts: Mapping[str, Sequence[float]], digits: int = 4) -> Cuts:
    return {f: sorted({round(float(c), digits) for c in cs}) for f, cs in cuts.items()}


def thresholds(
    df: DataFrame,
    features: Sequence[str],
    n_bins: int = 10,
    method: str = "quantile",
    custom: Mapping[str, Sequence[float]] | None = None,
    target: str | None = None,
) -> Cuts:
    """Candidate thresholds per feature, rounded to 4 digits and deduplicated."""
    custom = custom or {}
    if method == "custom":
        return {f: sorted(float(c) for c in custom.get(f, [])) for f in features}
    if method == "uniform":
        return rounded_thresholds(uniform_cuts(df, features, n_bins))
    if method == "quantile":
        probs = [i / n_bins for i in range(1, n_bins)]
        q = quantiles(df, features, probs)
        return rounded_thresholds({f: [v for v in vs if v is not None] for f, vs in q.items()})
    if method in ("chi2", "tree"):
        from scorewright.operators.supervised import chi_merge_cuts, tree_cuts

        fn = chi_merge_cuts if method == "chi2" else tree_cuts
        return fn(df, features, target, n_bins)
    raise ValueError(f"unknown binning method: {method}")


def small_domains(df: DataFrame, features: Sequence[str], limit: int) -> dict[str, list[float]]:
    """Sorted values of the features with at most ``limit`` distinct values.

    A sketch decides who is small first, so ``collect_set`` only ever runs on
    columns with a bounded number of values.
    """
    feats = list(features)
    if not feats:
        return {}
    est = df.agg(*[distinct_estimate(clean_double(f)).alias(f"d{i}") for i, f in enumerate(feats)]).first()
    near = [f for i, f in enumerate(feats) if est[f"d{i}"] <= 2 * limit]
    if not near:
        return {}
    sets = df.agg(*[F.sort_array(F.collect_set(clean_double(f))).alias(f"s{i}") for i, f in enumerate(near)]).first()
    return {f: list(sets[f"s{i}"]) for i, f in enumerate(near) if len(sets[f"s{i}"]) <= limit}


# ---------------------------------------------------------------- WOE and IV


def add_woe(hist: DataFrame, bad: str = "bad", total: str = "n", zero_only: bool = False) -> DataFrame:
    """Shares, WOE = ln(bad share / good share) and IV parts of a histogram.

    Windows run over the few bins of one feature. ``zero_only`` replaces just
    zero shares by the floor (the weighted-IV variant) and leaves WOE unclipped.
    """
    w = Window.partitionBy("feature")
    good = F.col(total) - F.col(bad)
    pb = ratio(F.col(bad), F.sum(F.col(bad)).over(w))
    pg = ratio(good, F.sum(good).over(w))

    def floor(p: Column) -> Column:
        if zero_only:
            return F.when(p == 0, F.lit(PCT_FLOOR)).otherwise(p)
        return F.greatest(p, F.lit(PCT_FLOOR))

    woe = F.ln(F.col("pct_bad") / F.col("pct_good"))
    if not zero_only:
        woe = F.greatest(F.least(woe, F.lit(WOE_LIMIT)), F.lit(-WOE_LIMIT))
    return (
        hist.withColumn("good", good)
        .withColumn("bad_rate", ratio(F.col(bad), F.col(total)))
        .withColumn("pct_bad", floor(pb))
        .withColumn("pct_good", floor(pg))
        .withColumn("woe", woe)
        .withColumn("iv", (F.col("pct_bad") - F.col("pct_good")) * F.col("woe"))
    )


def woe_table(
    df: DataFrame, target: str, cuts: Mapping[str, Sequence[float]], closed: str = "left"
) -> DataFrame:
    """bins(feature, bin, lo, hi, n, good, bad, bad_rate, pct_bad, pct_good, woe, iv)."""
    hist = histogram(df, cuts, target, closed=closed).select("feature", "bin", "n", "bad")
    edges = F.broadcast(edge_table(df.sparkSession, cuts))
    return add_woe(hist).join(edges, ["feature", "bin"]).select(
        "feature", "bin", "lo", "hi", "n", "good", "bad", "bad_rate", "pct_bad", "pct_good", "woe", "iv"
    )


def fit_woe(df: DataFrame, target: str, features: Sequence[str], n_bins: int = 5, method: str = "quantile") -> DataFrame:
    fn = {"quantile": quantile_cuts, "uniform": uniform_cuts}.get(method)
    if fn:
        cuts = fn(df, features, n_bins)
    elif method == "kmeans":
        cuts = {f: kmeans_cuts(df, f, n_bins) for f in features}
    elif method in ("chi2", "tree"):
        cuts = thresholds(df, features, n_bins, method, target=target)
    else:
        raise ValueError(f"unknown binning method: {method}")
    return woe_table(df, target, cuts)


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Numeric features with more than one value (all-null and constant ones go)."""
    spans = column_ranges(df, [f for f in features if f in df.columns])
    return [f for f, (n, lo, hi) in spans.items() if n and lo != hi]


def iv_table(bins: DataFrame) -> DataFrame:
    """IV per feature with its strength class."""
    iv = bins.groupBy("feature").agg(F.sum("iv").alias("iv"), F.count(F.lit(1)).alias("n_bins"))
    return iv.withColumn("strength", iv_strength(F.col("iv"))).withColumn("low_iv", F.col("iv") < 0.02)


def iv_strength(iv: Column) -> Column:
    return (
        F.when(iv < 0.02, "none")
        .when(iv < 0.1, "weak")
        .when(iv < 0.3, "medium")
        .when(iv < 0.5, "strong")
        .otherwise("very_strong")
    )


def iv_power(iv: Column) -> Column:
    """Label scale of the weighted IV; it sits one step above ``iv_strength``."""
    return (
        F.when(iv < 0.02, "Weak").when(iv < 0.1, "Medium").when(iv < 0.3, "Strong").otherwise("Very Strong")
    )


def weighted_iv(
    df: DataFrame, target: str, weight: str | None, features: Sequence[str], n_bins: int = 10
) -> DataFrame:
    """IV on weights; few-valued features keep their values as bins, others get (a, b] deciles."""
    small = small_domains(df, features, n_bins)
    wide = [f for f in features if f not in small]
    # a value domain becomes one right-closed bin per value
    cuts: Cuts = {f: vals[:-1] for f, vals in small.items()}
    cuts.update(quantile_cuts(df, wide, n_bins))
    hist = histogram(df, cuts, target, weight, closed="right")
    iv = add_woe(hist, bad="bad_w", total="w", zero_only=True).groupBy("feature").agg(F.sum("iv").alias("iv"))
    return iv.withColumn("power", iv_power(F.col("iv")))


def iv_summary(iv: DataFrame) -> DataFrame:
    return iv.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.avg("iv").alias("avg_iv"),
        F.max("iv").alias("max_iv"),
        F.min("iv").alias("min_iv"),
        F.count(F.when(F.col("iv") >= 0.3, 1)).alias("strong"),
        F.count(F.when((F.col("iv") >= 0.1) & (F.col("iv") < 0.3), 1)).alias("medium"),
        F.count(F.when((F.col("iv") >= 0.02) & (F.col("iv") < 0.1), 1)).alias("weak"),
    )


def iv_distribution(iv: DataFrame) -> DataFrame:
    v = F.col("iv")
    return iv.agg(
        F.count(F.when(v >= 0.1, 1)).alias("ge_010"),
        F.count(F.when((v >= 0.05) & (v < 0.1), 1)).alias("ge_005"),
        F.count(F.when((v >= 0.02) & (v < 0.05), 1)).alias("ge_002"),
        F.count(F.when(v < 0.02, 1)).alias("lt_002"),
    )


def select_by_iv(iv: DataFrame, lower: float = 0.1, upper: float | None = None) -> DataFrame:
    keep = F.col("iv") >= lower
    if upper is not None:
        keep = keep & (F.col("iv") <= upper)
    return iv.withColumn("selected", keep)


# ---------------------------------------------------------------- transform


def woe_columns(
    df: DataFrame, bins: DataFrame, features: Sequence[str], column: str = "woe", suffix: str = "_woe"
) -> DataFrame:
    """Adds one ``{feature}_woe`` per feature; missing values get 0.

    The fitted bins (features x bins rows) travel as literals, so scoring is a
    single narrow stage over the rows.
    """
    fitted: dict[str, list] = {f: [] for f in features}
    rows = bins.where(F.col("feature").isin(list(features))).select("feature", "bin", "lo", "hi", column).collect()
    for r in sorted(rows, key=lambda r: (r["feature"], r["bin"])):
        fitted[r["feature"]].append(r)
    out = []
    for f in features:
        x = clean_double(f)
        expr = None
        for r in fitted[f]:
            cond = x.isNotNull() if r["hi"] is None else x < F.lit(r["hi"])
            expr = F.when(cond, F.lit(float(r[column]))) if expr is None else expr.when(cond, F.lit(float(r[column])))
        out.append((F.lit(0.0) if expr is None else expr.otherwise(F.lit(0.0))).alias(f"{f}{suffix}"))
    return df.select("*", *out)


def monotonicity(bins: DataFrame) -> DataFrame:
    """Per feature: direction of WOE over its bins and the number of turning points."""
    w = Window.partitionBy("feature").orderBy("bin")
    step = F.col("woe") - F.lag("woe").over(w)
    steps = bins.select("feature", "bin", step.alias("step"), (F.lead("woe").over(w) - F.col("woe")).alias("next_step"))
    agg = steps.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.coalesce(F.min("step"), F.lit(0.0)).alias("lo"),
        F.coalesce(F.max("step"), F.lit(0.0)).alias("hi"),
        F.count(F.when(F.col("step") * F.col("next_step") < 0, 1)).alias("turns"),
    )
    up, down = F.col("lo") >= 0, F.col("hi") <= 0
    return agg.select(
        "feature",
        "n_bins",
        F.when(F.col("n_bins") < 2, "n/a").when(up, "increasing").when(down, "decreasing").otherwise("non_monotonic").alias("direction"),
        ((F.col("n_bins") < 2) | up | down).alias("is_monotonic"),
        F.when(up | down, F.lit(0)).otherwise(F.col("turns")).alias("violations"),
    )


# ---------------------------------------------------------------- descriptive bins


def bin_statistics(
    df: DataFrame, feature: str, edges: Sequence[float], closed: str = "left", buffer_rows: int = BUFFER_ROWS
) -> DataFrame:
    """Count, share, min, max, mean, median and std of each bin between given edges.

    ``left``: [a, b), the last bin also takes its upper end. ``right``: (a, b],
    the first bin also takes its lower end. Values outside the edges stay out.
    """
    edges = sorted({float(e) for e in edges})
    inner = edges[1:-1]
    x = clean_double(feature)
    inside = df.select(x.alias(feature)).where((F.col(feature) >= edges[0]) & (F.col(feature) <= edges[-1]))
    total = df.agg(F.count(x).alias("n")).first()["n"]
    long = binned_long(inside, {feature: inner}, closed=closed)
    base = long.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    # one column per bin, so that all medians are found by the same scans
    bins = [f"b{b}" for b in range(len(edges) - 1)]
    wide = long.select(*[F.when(F.col("bin") == b, F.col("value")).alias(c) for b, c in enumerate(bins)])
    medians = quantiles(wide, bins, [0.5], buffer_rows)
    med = F.broadcast(df.sparkSession.createDataFrame([(b, medians[c][0]) for b, c in enumerate(bins)], "bin int, median double"))
    lo = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 2)
    return base.join(med, "bin").select(
        F.lit(feature).alias("feature"), "bin", lo.alias("lo"), hi.alias("hi"), "n",
        (F.col("n") * 100.0 / F.lit(float(total))).alias("pct"), "min", "max", "mean", "median", "std",
    )
