"""Score scaling, scorecard points and score statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.numeric import ratio
from scorewright.operators.binning import woe_columns
from scorewright.operators.quantiles import quantiles

# Rating grades and the lower ends of their score ranges.
RATING_BREAKS = [0, 550, 600, 650, 700, 750, 800]
RATING_LABELS = ["D", "C", "B", "BB", "BBB", "A", "AA"]


@dataclass(frozen=True)
class Scale:
    """score = a - b ln(p / (1 - p)), clipped to [low, high]."""

    a: float
    b: float
    low: float = 300.0
    high: float = 850.0

    @classmethod
    def from_bad_rate(
        cls, bad_rate: float, base_score: float = 600.0, pdo: float = 20.0, rate: float = 2.0, low: float = 300.0, high: float = 850.0
    ) -> Scale:
        b = pdo / math.log(rate)
        return cls(base_score + b * math.log(bad_rate / (1 - bad_rate)), b, low, high)

    @classmethod
    def fit(cls, df: DataFrame, target: str, **kw) -> Scale:
        return cls.from_bad_rate(df.agg(F.avg(F.col(target).cast("double"))).first()[0], **kw)

    def score(self, p: Column) -> Column:
        q = F.greatest(F.least(p, F.lit(1 - 1e-10)), F.lit(1e-10))
        s = F.lit(self.a) - F.lit(self.b) * F.ln(q / (1 - q))
        return F.greatest(F.least(s, F.lit(self.high)), F.lit(self.low))

    def probability(self, score: Column) -> Column:
        """Inverse of ``score`` (before clipping)."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.a) - score) / F.lit(self.b)))


def convert(df: DataFrame, column: str, scale: Scale, direction: str = "to_score", digits: int = 4) -> DataFrame:
    """(input, output) pairs in either direction."""
    x = F.col(column).cast("double")
    out = scale.score(x) if direction == "to_score" else scale.probability(x)
    return df.select(x.alias("input"), F.round(out, digits).alias("output"))


def rating(score: Column) -> Column:
    out = None
    for lo, hi, name in zip(RATING_BREAKS, [*RATING_BREAKS[1:], None], RATING_LABELS):
        cond = score >= lo if hi is None else (score >= lo) & (score < hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def card_scale(base_score: float = 600.0, base_odds: float = 20.0, pdo: float = 20.0) -> tuple[float, float]:
    """(a, b) of the card; ``base_odds`` is good:bad, so odds at the base score are 1 / base_odds."""
    b = pdo / math.log(2)
    return base_score + b * math.log(1.0 / base_odds), b


def card_points(
    bins: DataFrame, coef: Mapping[str, float], intercept: float, base_score: float = 600.0, base_odds: float = 20.0,
    pdo: float = 20.0, digits: int = 2,
) -> tuple[DataFrame, float]:
    """scorecard(feature, bin, lo, hi, woe, points) and the base points."""
    a, b = card_scale(base_score, base_odds, pdo)
    coefs = bins.sparkSession.createDataFrame([(f, float(c)) for f, c in coef.items()], "feature string, coef double")
    points = F.round(F.lit(-b) * F.col("coef") * F.col("woe"), digits)
    card = bins.join(F.broadcast(coefs), "feature").select("feature", "bin", "lo", "hi", "woe", "coef", points.alias("points"))
    return card, round(a - b * intercept, digits)


def apply_card(df: DataFrame, card: DataFrame, base_points: float, features: Sequence[str], out: str = "score") -> DataFrame:
    """Adds the total score: base points plus the points of each feature's bin."""
    pts = woe_columns(df, card, features, column="points", suffix="__pts")
    total = F.lit(float(base_points))
    for f in features:
        total = total + F.col(f"{f}__pts")
    return pts.withColumn(out, total).drop(*[f"{f}__pts" for f in features])


def card_range(card: DataFrame, base_points: float) -> DataFrame:
    """Lowest and highest total the card can give."""
    per = card_detail(card)
    return per.agg(
        (F.sum("min_points") + base_points).alias("min_score"), (F.sum("max_points") + base_points).alias("max_score")
    )


def card_detail(card: DataFrame) -> DataFrame:
    return card.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_bins"), F.min("points").alias("min_points"), F.max("points").alias("max_points"),
        (F.max("points") - F.min("points")).alias("spread"),
    )


def card_export(bins: DataFrame, card: DataFrame) -> DataFrame:
    """Full card: variable, total_iv, cof, index, bin, count, share, good, bad, badprob, woe, score."""
    w = Window.partitionBy("feature")
    label = F.concat(
        F.lit("["), F.coalesce(F.col("lo").cast("string"), F.lit("-inf")), F.lit(","),
        F.coalesce(F.col("hi").cast("string"), F.lit("inf")), F.lit(")"),
    )
    stats = bins.select(
        "feature", "bin", label.alias("label"), F.sum("iv").over(w).alias("total_iv"), "n",
        ratio(F.col("n"), F.sum("n").over(w)).alias("count_distr"), "good", "bad", "bad_rate", "woe",
    )
    return stats.join(card.select("feature", "bin", "coef", "points"), ["feature", "bin"]).select(
        F.col("feature").alias("variable"), "total_iv", F.col("coef").alias("cof"), F.col("bin").alias("index"),
        F.col("label").alias("bin"), F.col("n").alias("count"), "count_distr", "good", "bad", F.col("bad_rate").alias("badprob"),
        "woe", F.col("points").alias("score"),
    )


def score_statistics(df: DataFrame, score: str, split: str, values: Sequence[str]) -> DataFrame:
    """Min, max, mean, population std, median and quartiles per split."""
    x = F.col(score).cast("double")
    base = df.groupBy(split).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")
    )
    wide = df.select(*[F.when(F.col(split) == v, x).alias(f"s{i}") for i, v in enumerate(values)])
    q = quantiles(wide, wide.columns, [0.25, 0.5, 0.75])
    rows = [(v, *q[f"s{i}"]) for i, v in enumerate(values)]
    qs = df.sparkSession.createDataFrame(rows, f"{split} string, q25 double, median double, q75 double")
    return base.join(F.broadcast(qs), split)
