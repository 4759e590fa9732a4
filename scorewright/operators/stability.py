"""Stability of rules, scores and features between samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.numeric import ratio
from scorewright.functions.rule_expr import any_of
from scorewright.operators.histogram import histogram
from scorewright.operators.quantiles import column_ranges
from scorewright.operators.rule_index import rule_sums
from scorewright.operators.ruleset import compiled

PSI_EPS = 1e-6


def psi_label(psi: Column) -> Column:
    return (
        F.when(psi.isNull(), "n/a").when(psi < 0.1, "stable").when(psi < 0.25, "slight_change").otherwise("significant_change")
    )


def hit_rates_by(df: DataFrame, rules: Sequence[str], split: str) -> DataFrame:
    """(pos, rule, split, rate): hits per (split, rule), from one scan."""
    sums, index = rule_sums(df, rules, {}, split)
    hits = sums.withColumnRenamed("n", "hit_n")
    # few splits: every rule stands in each of them, whether it hits there or not
    listed = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r).alias("rule")) for i, r in enumerate(index.names)])
    grid = hits.where("pos = -1").select(split, F.col("hit_n").alias("n"), F.inline(listed))
    return grid.join(hits, [split, "pos"], "left").select(
        "pos", "rule", split, ratio(F.coalesce(F.col("hit_n"), F.lit(0)), F.col("n")).alias("rate")
    )


def rule_psi(df: DataFrame, rules: Sequence[str], split: str, base: str, compare: str) -> DataFrame:
    """|(h2 - h1) ln(h2 / h1)| of hit rates; null when a side hits nothing."""
    rates = hit_rates_by(df.where(F.col(split).isin(base, compare)), rules, split)
    wide = rates.groupBy("pos", "rule").agg(
        F.max(F.when(F.col(split) == base, F.col("rate"))).alias("hit_rate_base"),
        F.max(F.when(F.col(split) == compare, F.col("rate"))).alias("hit_rate_compare"),
    )
    a, b = F.col("hit_rate_base"), F.col("hit_rate_compare")
    psi = F.when((a > 0) & (b > 0), F.abs((b - a) * F.ln(b / a)))
    return wide.withColumn("psi", psi).withColumn("stability", psi_label(F.col("psi")))


def psi_summary(psi: DataFrame) -> DataFrame:
    p = F.col("psi")
    return psi.agg(
        F.avg(p).alias("avg_psi"), F.max(p).alias("max_psi"), F.min(p).alias("min_psi"),
        F.count(F.when(p < 0.1, 1)).alias("n_stable"), F.count(F.when((p >= 0.1) & (p < 0.25), 1)).alias("n_slight_change"),
        F.count(F.when(p >= 0.25, 1)).alias("n_significant_change"),
    )


def cv_level(cv: Column, threshold: float = 0.35) -> Column:
    return (
        F.when(cv < 0.15, "highly_stable").when(cv < 0.25, "stable").when(cv < threshold, "moderate").otherwise("unstable")
    )


def _cv(rate: Column) -> Column:
    """Population std over mean of the non-zero rates; 0 with fewer than two."""
    nz = F.when(rate > 0, rate)
    return F.when(F.count(nz) >= 2, F.stddev_pop(nz) / F.avg(nz)).otherwise(F.lit(0.0))


def rule_cv(df: DataFrame, rules: Sequence[str], split: str, threshold: float = 0.35) -> DataFrame:
    """Coefficient of variation of each rule's hit rate over train / test / oot."""
    rates = hit_rates_by(df, rules, split)
    rate = F.col("rate")
    out = rates.groupBy("pos", "rule").agg(
        *[F.coalesce(F.max(F.when(F.col(split) == s, rate)), F.lit(0.0)).alias(f"hit_rate_{s}") for s in ("train", "test", "oot")],
        _cv(rate).alias("cv"),
    )
    return out.withColumn("stability_level", cv_level(F.col("cv"), threshold))


def ruleset_cv(df: DataFrame, rules: Sequence[str], split: str) -> DataFrame:
    """Stability of the whole set and the score bonus it earns."""
    hit = any_of([h for _, h in compiled(df, rules)])
    rates = df.groupBy(split).agg((F.count(F.when(hit, 1)) / F.count(F.lit(1))).alias("rate"))
    cv = F.col("overall_cv")
    bonus = F.when(cv < 0.15, 10).when(cv < 0.25, 5).when(cv < 0.35, 0).otherwise(-5)
    return rates.agg(_cv(F.col("rate")).alias("overall_cv")).withColumn("score_bonus", bonus)


def drop_unstable(selected: DataFrame, cv: DataFrame) -> DataFrame:
    return selected.join(cv.where("stability_level = 'unstable'").select("rule"), "rule", "left_anti")


# ---------------------------------------------------------------- distributions


def distribution_psi(
    df: DataFrame, columns: Sequence[str], split: str, base: str, compare: str, bins: int = 10
) -> DataFrame:
    """PSI of every column between two samples: equal-width bins over the base range.

    The end bins are open, each share gets +1e-6, PSI = |sum (a - e) ln(a / e)|.
    All columns share one histogram job.
    """
    two = df.where(F.col(split).isin(base, compare))
    spans = column_ranges(two.where(F.col(split) == base), columns)
    cuts = {}
    for c, (n, lo, hi) in spans.items():
        if not n:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        cuts[c] = [lo + (hi - lo) * i / bins for i in range(1, bins)]
    cells = histogram(two, cuts, by=[split]).select(split, "feature", "bin", "n")
    per = cells.groupBy("feature", "bin").agg(
        F.coalesce(F.sum(F.when(F.col(split) == base, F.col("n"))), F.lit(0)).alias("e"),
        F.coalesce(F.sum(F.when(F.col(split) == compare, F.col("n"))), F.lit(0)).alias("a"),
    )
    w = Window.partitionBy("feature")
    e = ratio(F.col("e"), F.sum("e").over(w)) + PSI_EPS
    a = ratio(F.col("a"), F.sum("a").over(w)) + PSI_EPS
    parts = per.select("feature", e.alias("e"), a.alias("a"))
    out = parts.groupBy("feature").agg(
        F.abs(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e")))).alias("psi")
    )
    return out.withColumn("stability", psi_label(F.col("psi")))


def csi_summary(csi: DataFrame) -> DataFrame:
    return csi.agg(
        F.count(F.lit(1)).alias("total_features"),
        *[F.count(F.when(F.col("stability") == s, 1)).alias(s) for s in ("stable", "slight_change", "significant_change")],
    )
