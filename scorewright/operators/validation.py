"""Quality verdicts of rule sets and scorecards.

Inputs are one-row summaries already reduced by Spark; what is left is scalar
arithmetic on a handful of numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.curves import discrimination
from scorewright.operators.evaluate import compound_rule_metrics
from scorewright.operators.rules import complexity_report, rule_table
from scorewright.operators.ruleset import multi_hit, redundant_rules, sharing_pairs, sharing_report, union_metrics

# Tier limits (excellent, good, acceptable) and score weights.
LIFT_TIERS = (3.0, 2.0, 1.5)
RECALL_TIERS = (0.30, 0.20, 0.10)
COVERAGE_OPTIMAL = (0.01, 0.30)
COVERAGE_ALLOWED = (0.005, 0.50)
OVERLAP_OPTIMAL, OVERLAP_WARNING = 0.30, 0.50
COMPLEXITY_OPTIMAL, COMPLEXITY_MAX = 3, 5
MULTI_HIT_WARNING = 0.30
RULE_WEIGHTS = {"discrimination": 30, "recall": 25, "coverage": 15, "independence": 15, "complexity": 15}

KS_TIERS = (0.40, 0.30, 0.20)
AUC_TIERS = (0.80, 0.70, 0.60)
DISTINCT_MIN, RANGE_MIN, STD_MIN = 20, 50, 10
PSI_TIERS = (0.10, 0.25)
CARD_WEIGHTS = {"discrimination": 40, "distribution": 30, "stability": 30}

_STATUS = ("excellent", "good", "acceptable", "warning")


def _tier(ok: Sequence[bool]) -> str:
    return next((s for s, hit in zip(_STATUS, ok) if hit), "warning")


def lift_report(metrics: DataFrame) -> DataFrame:
    """Average, min, max lift and counts per tier over rules with hits."""
    ex, good, ok = LIFT_TIERS
    lift = F.col("lift")
    return metrics.where("hit_n > 0").agg(
        F.avg(lift).alias("avg_lift"), F.min(lift).alias("min_lift"), F.max(lift).alias("max_lift"),
        F.count(F.when(lift >= ex, 1)).alias("excellent"), F.count(F.when((lift >= good) & (lift < ex), 1)).alias("good"),
        F.count(F.when((lift >= ok) & (lift < good), 1)).alias("acceptable"), F.count(F.when(lift < ok, 1)).alias("poor"),
    )


def lift_status(avg: float | None, low: float | None) -> str:
    if avg is None:
        return "error"
    ex, good, ok = LIFT_TIERS
    return _tier([avg >= ex and low >= good, avg >= good and low >= ok, avg >= ok])


def recall_status(recall: float) -> str:
    return _tier([recall >= t for t in RECALL_TIERS])


def coverage_status(cov: float) -> str:
    if COVERAGE_OPTIMAL[0] <= cov <= COVERAGE_OPTIMAL[1]:
        return "excellent"
    if COVERAGE_ALLOWED[0] <= cov <= COVERAGE_ALLOWED[1]:
        return "good"
    return "warning_low" if cov < COVERAGE_ALLOWED[0] else "warning_high"


def complexity_status(avg: float, top: int) -> str:
    if avg <= COMPLEXITY_OPTIMAL and top <= COMPLEXITY_MAX:
        return "excellent"
    return "good" if avg <= COMPLEXITY_MAX else "warning"


# The share of a dimension's points that a status earns. A status that is missing here earns points by the
# measured value, as ``rule_score`` says.
SHARES = {
    "lift": {"excellent": 1.0, "good": 0.85, "acceptable": 0.70},
    "recall": {"excellent": 1.0, "good": 0.85, "acceptable": 0.70},
    "coverage": {"excellent": 1.0, "good": 0.85, "warning_low": 0.5, "warning_high": 0.6},
    "complexity": {"excellent": 1.0, "good": 0.8},
}


def rule_score(f: Mapping[str, float]) -> dict[str, float]:
    """Points per dimension from the facts of a rule set.

    Below the tiers, points fall in proportion to the value (lift, recall) or to its inverse (complexity). Independence
    is half for overlap, falling between the two overlap limits, and half for redundancy, half a point a rule.
    """
    status = lift_status(f["avg_lift"], f["min_lift"])
    weak_lift = 0.0 if status != "warning" else 0.2 if f["avg_lift"] < 1 else 0.5 * f["avg_lift"] / LIFT_TIERS[2]
    simple = 0.5 * COMPLEXITY_MAX / max(f["avg_complexity"], 1e-9)
    share = {
        "discrimination": SHARES["lift"].get(status, weak_lift),
        "recall": SHARES["recall"].get(recall_status(f["recall"]), 0.5 * f["recall"] / RECALL_TIERS[2]),
        "coverage": SHARES["coverage"][coverage_status(f["coverage"])],
        "complexity": SHARES["complexity"].get(complexity_status(f["avg_complexity"], f["max_complexity"]), simple),
    }
    points = {k: RULE_WEIGHTS[k] * v for k, v in share.items()}
    half = RULE_WEIGHTS["independence"] / 2
    points["independence"] = half * _overlap_share(f["avg_overlap"]) + max(0.0, half - 0.5 * f["n_redundant"])
    return {k: round(points[k], 1) for k in ("discrimination", "recall", "coverage", "independence", "complexity")}


def _overlap_share(overlap: float) -> float:
    if overlap > OVERLAP_WARNING:
        return max(0.0, 0.5 * (1 - overlap))
    return 1 - max(0.0, overlap - OVERLAP_OPTIMAL) / (OVERLAP_WARNING - OVERLAP_OPTIMAL)


def rule_warnings(f: Mapping[str, float]) -> list[str]:
    checks = [
        ("weak_lift", lift_status(f["avg_lift"], f["min_lift"]) == "warning"),
        ("low_recall", recall_status(f["recall"]) == "warning"),
        ("coverage_low", coverage_status(f["coverage"]) == "warning_low"),
        ("coverage_high", coverage_status(f["coverage"]) == "warning_high"),
        ("high_overlap", f["avg_overlap"] > OVERLAP_WARNING),
        ("redundant_rules", f["n_redundant"] > 0),
        ("high_complexity", complexity_status(f["avg_complexity"], f["max_complexity"]) == "warning"),
        ("many_multi_hits", f["multi_hit_rate"] > MULTI_HIT_WARNING),
    ]
    return [name for name, bad in checks if bad]


def validate_rules(df: DataFrame, rules: Sequence[str], target: str) -> DataFrame:
    """One row: facts, points per dimension, total score and warnings."""
    spark = df.sparkSession
    metrics, _ = compound_rule_metrics(df, rules, target)
    lift = lift_report(metrics).first()
    union = union_metrics(df, rules, target).first()
    pairs, own = sharing_pairs(df, rules)
    over = sharing_report(pairs, own).first()
    n_red = redundant_rules(pairs).count()
    many = multi_hit(df, rules).where("n_hit > 1").agg(F.coalesce(F.sum("pct"), F.lit(0.0)).alias("r")).first()["r"]
    comp = complexity_report(rule_table(spark, rules)).first()
    facts = {
        "avg_lift": lift["avg_lift"], "min_lift": lift["min_lift"], "recall": union["union_recall"], "coverage": union["coverage"],
        "avg_overlap": over["avg_overlap"], "n_redundant": n_red, "multi_hit_rate": many,
        "avg_complexity": comp["avg_complexity"], "max_complexity": comp["max_complexity"],
    }
    pts = rule_score(facts)
    row = (*[float(v) if v is not None else None for v in facts.values()], *pts.values(), round(sum(pts.values()), 1), ",".join(rule_warnings(facts)))
    names = [*facts, *[f"points_{k}" for k in pts], "quality_score"]
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in names) + ", warnings string")


# ---------------------------------------------------------------- scorecard


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    """Distinct scores, range, population std and the resulting status."""
    x = F.col(score).cast("double")
    t = df.agg(
        F.count_distinct(x).alias("unique_scores"), F.min(x).alias("score_min"), F.max(x).alias("score_max"), F.stddev_pop(x).alias("score_std"),
        F.avg(x).alias("score_mean"),
    )
    issues = (
        (F.col("unique_scores") < DISTINCT_MIN).cast("int") + (F.col("score_max") - F.col("score_min") < RANGE_MIN).cast("int")
        + (F.col("score_std") < STD_MIN).cast("int")
    )
    status = F.element_at(F.array(*[F.lit(s) for s in _STATUS]), issues + 1)
    return t.select(
        "unique_scores", "score_min", "score_max", (F.col("score_max") - F.col("score_min")).alias("score_range"), "score_std",
        "score_mean", status.alias("status"),
    )


def card_verdict(dist: str, ks: float | None, auc: float | None, psi: float | None) -> dict:
    disc = "none" if ks is None else _tier([ks >= k and auc >= a for k, a in zip(KS_TIERS, AUC_TIERS)])
    stab = "none" if psi is None else "excellent" if psi < PSI_TIERS[0] else "good" if psi < PSI_TIERS[1] else "warning"
    share = {"excellent": 1.0, "good": 0.8, "acceptable": 0.6, "warning": 0.3, "none": 0.5}
    w = CARD_WEIGHTS
    pts = {
        "discrimination": round(w["discrimination"] * share[disc], 1),
        "distribution": round(w["distribution"] * share[dist], 1),
        "stability": round(w["stability"] * (0.4 if stab == "warning" else share[stab]), 1),
    }
    total = sum(pts.values())
    status = _tier([total >= 80, total >= 60, total >= 40])
    return {**{f"points_{k}": v for k, v in pts.items()}, "quality_score": total, "status": status}


def validate_card(df: DataFrame, score: str, target: str | None = None, psi: float | None = None) -> DataFrame:
    """One row with distribution, discrimination and stability points of a scored table."""
    dist = score_distribution(df, score).first()
    ks = auc = None
    if target:
        d = discrimination(df, score, target, higher_is_bad=False).first()
        ks, auc = d["ks"], d["auc"]
    v = card_verdict(dist["status"], ks, auc, psi)
    row = (dist["unique_scores"], dist["score_range"], dist["score_std"], ks, auc, psi,
           v["points_discrimination"], v["points_distribution"], v["points_stability"], v["quality_score"], v["status"])
    return df.sparkSession.createDataFrame(
        [row], "unique_scores long, score_range double, score_std double, ks double, auc double, psi double, "
        "points_discrimination double, points_distribution double, points_stability double, quality_score double, status string",
    )
