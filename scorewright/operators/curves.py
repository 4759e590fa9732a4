"""KS, ROC, score bands and rank order, all on tables of distinct scores or bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.numeric import ratio
from scorewright.operators.histogram import histogram
from scorewright.operators.ordering import running_totals
from scorewright.operators.quantiles import column_ranges, quantiles

# Band widths considered readable.
NICE_WIDTHS = [5, 10, 20, 25, 50, 100, 200, 250, 500]


def score_counts(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score) -> n, bad, good; one row per distinct score."""
    y = F.col(target).cast("long")
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("bad"), (F.count(F.lit(1)) - F.sum(y)).alias("good")
    )


def _totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good")])


def _with_totals(t: DataFrame, counts: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return t.join(_totals(counts, by), list(by))
    row = _totals(counts, by).first()
    return t.select("*", *[F.lit(row[c]).cast("long").alias(c) for c in ("all_n", "all_bad", "all_good")])


def ks_curve(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative bad, good and population shares per distinct score, from low to high."""
    counts = score_counts(df, score, target, by)
    t = running_totals(counts, "score", ["n", "bad", "good"], by)
    t = _with_totals(t, counts, by)
    cb = ratio(F.col("before_bad") + F.col("bad"), F.col("all_bad"))
    cg = ratio(F.col("before_good") + F.col("good"), F.col("all_good"))
    return t.select(
        *by, "score", "n", cb.alias("cum_bad_pct"), cg.alias("cum_good_pct"),
        ratio(F.col("before_n") + F.col("n"), F.col("all_n")).alias("population_pct"), F.abs(cb - cg).alias("ks"),
    )


def ks_position(curve: DataFrame) -> DataFrame:
    """Maximum of a KS curve and where it is first reached."""
    best = F.max_by(F.struct("score", "population_pct"), F.struct("ks", -F.col("population_pct")))
    return curve.agg(F.max("ks").alias("ks_max"), best.alias("at")).select(
        "ks_max", F.col("at.score").alias("ks_score"), F.col("at.population_pct").alias("ks_population_pct")
    )


def roc_points(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr) after each distinct score, highest score first."""
    counts = score_counts(df, score, target, by)
    t = running_totals(counts, "score", ["bad", "good"], by, descending=True)
    t = _with_totals(t, counts, by)
    return t.select(
        *by, "score", ratio(F.col("before_good") + F.col("good"), F.col("all_good")).alias("fpr"),
        ratio(F.col("before_bad") + F.col("bad"), F.col("all_bad")).alias("tpr"),
    )


def discrimination(df: DataFrame, score: str, target: str, by: Sequence[str] = (), higher_is_bad: bool = True) -> DataFrame:
    """KS, AUC and Gini per group.

    With totals before each distinct score, the trapezoid of that step is
    good x (bads ranked above + bad / 2), so no second pass over the curve is needed.
    """
    counts = score_counts(df, score, target, by)
    t = running_totals(counts, "score", ["bad", "good"], by, descending=higher_is_bad)
    t = _with_totals(t, counts, by)
    tpr = ratio(F.col("before_bad") + F.col("bad"), F.col("all_bad"))
    fpr = ratio(F.col("before_good") + F.col("good"), F.col("all_good"))
    area = F.col("good").cast("double") * (F.col("before_bad") + F.col("bad") / 2.0)
    auc = F.col("area") / (F.col("b").cast("double") * F.col("g"))
    return (
        t.groupBy(*by)
        .agg(F.greatest(F.max(tpr - fpr), F.lit(0.0)).alias("ks"), F.sum(area).alias("area"),
             F.first("all_bad").alias("b"), F.first("all_good").alias("g"), F.first("all_n").alias("n"))
        .select(*by, "n", "ks", auc.alias("auc"), (2 * auc - 1).alias("gini"))
    )


def overfit_check(metrics: DataFrame, split: str = "split", ks_gap: float = 0.05, auc_gap: float = 0.03) -> DataFrame:
    """Train minus other-sample gaps and whether they pass the limits."""
    every = Window.partitionBy(F.lit(0))
    train = F.col(split) == "train"
    k = F.max(F.when(train, F.col("ks"))).over(every) - F.col("ks")
    a = F.max(F.when(train, F.col("auc"))).over(every) - F.col("auc")
    gaps = metrics.select(split, k.alias("ks_gap"), a.alias("auc_gap")).where(~train)
    return gaps.withColumn("overfit", (F.col("ks_gap") > ks_gap) | (F.col("auc_gap") > auc_gap))


# ---------------------------------------------------------------- bands


def nice_width(span: float, bands: int = 8) -> float:
    if span <= 0:
        return 10.0
    return float(min(NICE_WIDTHS, key=lambda w: abs(w - span / bands)))


def equal_width_edges(df: DataFrame, score: str, bands: int = 8) -> list[float]:
    n, lo, hi = column_ranges(df, [score])[score]
    if not n:
        return []
    w = nice_width(hi - lo, bands)
    start, stop = math.floor(lo / w) * w, math.ceil(hi / w) * w
    steps = round((stop - start) / w)
    edges = [start + i * w for i in range(steps + 1)]
    return edges if len(edges) > 1 else [lo, hi]


def equal_frequency_edges(df: DataFrame, score: str, bands: int = 10) -> list[float]:
    q = quantiles(df, [score], [i / bands for i in range(bands + 1)])[score]
    edges = sorted({v for v in q if v is not None})
    if len(edges) == 1:
        return [edges[0] - 1, edges[0], edges[0] + 1]
    if len(edges) == 2:
        return [edges[0], (edges[0] + edges[1]) / 2, edges[1]]
    return edges


def score_bands(df: DataFrame, score: str, target: str, method: str = "equal_frequency", bands: int | None = None) -> DataFrame:
    """Band table on integer scores: size, shares, bad rate, lift, cumulative bad share.

    Bands are [lo, hi), the last one closed; percentages are 0-100.
    """
    ints = df.where(F.col(score).isNotNull()).select(F.bround(F.col(score).cast("double")).alias(score), target)
    edges = equal_width_edges(ints, score, bands or 8) if method == "equal_width" else equal_frequency_edges(ints, score, bands or 10)
    # Python rounds half to even, as numpy does
    edges = sorted({float(round(e)) for e in edges})
    if len(edges) == 1:
        edges.append(edges[0])
    inside = ints.where((F.col(score) >= edges[0]) & (F.col(score) <= edges[-1]))
    hist = histogram(inside, {score: edges[1:-1]}, target).select("bin", "n", F.col("bad").cast("long").alias("bad"))
    frame = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)], "bin int, lo double, hi double"
    )
    t = frame.join(hist, "bin", "left").fillna(0, ["n", "bad"])
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rate = ratio(F.col("bad"), F.col("n"))
    overall = ratio(F.sum("bad").over(every), F.sum("n").over(every))
    return t.select(
        "bin", "lo", "hi", "n", (ratio(F.col("n"), F.sum("n").over(every)) * 100).alias("pct"), "bad",
        (F.col("n") - F.col("bad")).alias("good"), (rate * 100).alias("bad_rate"), ratio(rate, overall).alias("lift"),
        (ratio(F.sum("bad").over(upto), F.sum("bad").over(every)) * 100).alias("cum_bad_pct"),
    )


def rank_order_violations(bands: DataFrame) -> DataFrame:
    """Bands whose bad rate rises over the band below them."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    prev = F.lag("bad_rate").over(w)
    return bands.select("bin", prev.alias("prev_bad_rate"), "bad_rate").where("bad_rate > prev_bad_rate").withColumn(
        "rise", F.col("bad_rate") - F.col("prev_bad_rate")
    )


def band_lift(bands: DataFrame) -> DataFrame:
    """Lift and bad rate of the first and the last band."""
    return bands.agg(
        F.min_by("lift", "bin").alias("first_lift"), F.max_by("lift", "bin").alias("last_lift"),
        F.min_by("bad_rate", "bin").alias("first_bad_rate"), F.max_by("bad_rate", "bin").alias("last_bad_rate"),
    )
