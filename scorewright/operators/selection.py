"""Feature selection: IV, correlation, VIF, stepwise and sign checks with reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.correlation import ROWS, correlation, correlation_drops, distinct_rows, vif, vif_elimination
from scorewright.operators.logit import coefficient_signs, stepwise


@dataclass
class Selection:
    kept: list[str]
    removed: dict[str, str] = field(default_factory=dict)

    def drop(self, names: Sequence[str], reason: str) -> None:
        gone = [f for f in self.kept if f in set(names)]
        self.removed.update(dict.fromkeys(gone, reason))
        self.kept = [f for f in self.kept if f not in gone]


def select_features(
    df: DataFrame, iv: DataFrame, features: Sequence[str], target: str, iv_range: tuple[float, float] = (0.02, 0.5), max_corr: float | None = 0.7,
    max_vif: float | None = 5.0, use_stepwise: bool = False, level: float = 0.05, signs: str = "ignore", suffix: str = "_woe",
) -> Selection:
    """Each step sees what the one before it kept; ``df`` holds ``{feature}{suffix}`` columns. The steps after IV work on the
    counted distinct rows of these columns and the target."""
    table = {r["feature"]: r["iv"] for r in iv.where(F.col("feature").isin(list(features))).collect()}
    sel = Selection(list(features))
    sel.drop([f for f in features if table.get(f, 0.0) < iv_range[0]], "low_iv")
    sel.drop([f for f in features if table.get(f, 0.0) > iv_range[1]], "high_iv")

    def cols() -> list[str]:
        return [f"{f}{suffix}" for f in sel.kept]

    def back(names: Sequence[str]) -> list[str]:
        return [n.removesuffix(suffix) for n in names]

    if not sel.kept:
        return sel
    df = distinct_rows(df, [*cols(), target]).cache()
    if max_corr is not None and len(sel.kept) > 1:
        # strongest IV first, so the weaker feature of a pair is the second one
        ordered = sorted(cols(), key=lambda c: -table[c.removesuffix(suffix)])
        sel.drop(back(correlation_drops(correlation(df, ordered, count=ROWS), max_corr)), "correlation")
    if max_vif is not None and len(sel.kept) > 1:
        kept, _ = vif_elimination(df, cols(), max_vif, count=ROWS)
        sel.drop([f for f in sel.kept if f"{f}{suffix}" not in kept], "vif")
    if use_stepwise and sel.kept:
        kept, _ = stepwise(df, cols(), target, "both", level, weight=ROWS)
        sel.drop([f for f in sel.kept if f"{f}{suffix}" not in kept], "stepwise")
    if signs != "ignore" and sel.kept:
        kept, _ = coefficient_signs(df, cols(), target, signs, ROWS)
        sel.drop([f for f in sel.kept if f"{f}{suffix}" not in kept], "coefficient_sign")
    df.unpersist()
    return sel


def removal_counts(df: DataFrame, removed: Mapping[str, str], n_all: int) -> DataFrame:
    """Features left after each step."""
    steps = ["low_iv", "high_iv", "correlation", "vif", "stepwise", "coefficient_sign"]
    left, rows = n_all, []
    for i, s in enumerate(steps):
        n = sum(r == s for r in removed.values())
        left -= n
        rows.append((i, s, n, left))
    return df.sparkSession.createDataFrame(rows, "step int, reason string, n_removed int, n_left int")


def selection_detail(
    df: DataFrame, bins: DataFrame, iv: DataFrame, features: Sequence[str], selection: Selection, suffix: str = "_woe"
) -> DataFrame:
    """Per feature: IV and level, strongest partner, VIF, bins, bad-rate range, kept or removed and why."""
    cols = [f"{f}{suffix}" for f in features]
    rows = distinct_rows(df, cols).cache()
    pairs = correlation(rows, cols, count=ROWS)
    both = pairs.select(F.col("feature1").alias("a"), F.col("feature2").alias("b"), "corr").unionByName(
        pairs.select(F.col("feature2").alias("a"), F.col("feature1").alias("b"), "corr")
    ).select(F.regexp_replace("a", f"{suffix}$", "").alias("feature"), F.regexp_replace("b", f"{suffix}$", "").alias("partner"), F.abs("corr").alias("r"))
    partner = both.where("r IS NOT NULL").groupBy("feature").agg(F.max_by("partner", F.struct("r", "partner")).alias("top_partner"), F.max("r").alias("top_corr"))
    v = vif(rows, cols, ROWS).select(F.regexp_replace("feature", f"{suffix}$", "").alias("feature"), "vif")
    b = bins.groupBy("feature").agg(F.count(F.lit(1)).alias("n_bins"), F.min("bad_rate").alias("min_bad_rate"), F.max("bad_rate").alias("max_bad_rate"))
    why = df.sparkSession.createDataFrame([(f, selection.removed.get(f, "kept")) for f in features], "feature string, outcome string")
    level = (
        F.when(F.col("iv") >= 0.3, "strong").when(F.col("iv") >= 0.1, "medium").when(F.col("iv") >= 0.05, "moderate").when(F.col("iv") >= 0.02, "weak").otherwise("none")
    )
    out = why.join(F.broadcast(iv.select("feature", "iv")), "feature", "left")
    for t in (partner, v, b):
        out = out.join(F.broadcast(t), "feature", "left")
    return out.select("feature", "iv", level.alias("iv_level"), "top_partner", "top_corr", "vif", "n_bins", "min_bad_rate", "max_bad_rate", "outcome")
