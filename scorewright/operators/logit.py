"""Logistic regression with statistics, stepwise selection and iterative cleaning.

Fits are Newton steps on sums that Spark computes: each scan adds up likelihood,
gradient and Hessian (a few k x k numbers per task) for all candidate models at
once, so a selection round costs five or six scans however many features compete.
Binned features are first grouped into distinct design rows (bad share and total
weight): the likelihood is unchanged and the scans run on at most bins^features rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.numeric import distinct_estimate
from scorewright.operators.evaluate import weight_column

Z95 = 1.96
PROBA_EPS = 1e-10
DESIGN_ROWS = 1_000_000
ROWS_PER_TASK = 50_000
# Scans after which models that still move are tested for separation, the step (in units of the linear predictor) that
# counts as moving, and the share of the largest predictor by which a row may stand on the wrong side.
SEPARATION_SCANS, MOVING, WRONG_SIDE = (8, 16, 24, 32), 0.05, 1e-6


def balanced_weight(df: DataFrame, target: str, weight: str | None = None) -> Column:
    """n / (2 n_class) per row, times the sample weight."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(target) == 1, 1)).alias("b")).first()
    n, b = r["n"], r["b"]
    cls = F.when(F.col(target) == 1, F.lit(n / (2.0 * b) if b else 0.0)).otherwise(F.lit(n / (2.0 * (n - b)) if n > b else 0.0))
    return cls * weight_column(weight)


def imbalance(df: DataFrame, target: str, strategy: str = "auto") -> DataFrame:
    """Target rate, 1:x ratio, severity and the strategy it leads to."""
    rate = F.col("target_rate")
    severity = (
        F.when(rate >= 0.2, "none").when(rate >= 0.1, "light").when(rate >= 0.05, "medium").when(rate >= 0.01, "heavy").otherwise("extreme")
    )
    auto = F.when(rate < 0.1, "class_weight").otherwise("none")
    return df.agg(F.avg(F.col(target).cast("double")).alias("target_rate")).select(
        rate, F.when(rate > 0, (1 - rate) / rate).alias("goods_per_bad"), severity.alias("severity"),
        (auto if strategy == "auto" else F.lit(strategy)).alias("applied_strategy"),
    )


def design_table(df: DataFrame, features: Sequence[str], target: str, weight: Column | None = None, group: bool | None = None) -> DataFrame:
    """(features..., y, w, n): complete rows, or one row per distinct feature vector.

    A grouped row carries the weighted bad share as ``y`` and the weight as ``w``,
    which is the binomial model's own form and has the same likelihood.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(target).cast("double").alias("y"), w.cast("double").alias("w")).dropna()
    est = rows.agg(distinct_estimate(*[F.col(f) for f in features]).alias("d")).first()["d"] if features else 0
    if group is None:
        group = est <= DESIGN_ROWS
    if not group:
        return rows.withColumn("n", F.lit(1))
    cells = rows.groupBy(*features).agg(F.sum(F.col("w") * F.col("y")).alias("__bad"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    cells = cells.where("w > 0").select(*features, F.least(F.col("__bad") / F.col("w"), F.lit(1.0)).alias("y"), "w", "n")
    # a small table in few partitions: the scans below are many and short. Dealt out anew, since coalesce would have one
    # task aggregate all partitions of the shuffle, each with a table of its own
    return cells.repartition(1 + est // ROWS_PER_TASK, *[F.col(f"`{f}`") for f in features])


@dataclass
class LogitFit:
    features: list[str]
    intercept: float
    coef: list[float]
    std_err: list[float]
    z: list[float]
    p: list[float]
    intercept_stats: tuple[float, float, float]
    info: dict = field(default_factory=dict)
    converged: bool = True
    separated: bool = False
    scans: int = 0
    halvings: int = 0

    def by_feature(self, values: Sequence[float]) -> dict[str, float]:
        return dict(zip(self.features, values))


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-square by the series / continued fraction of the incomplete gamma."""
    if x <= 0:
        return 1.0
    a, x = k / 2.0, x / 2.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * lead)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * lead


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def linear_predictor(features: Sequence[str], coef: Sequence[float], intercept: float) -> Column:
    eta = F.lit(float(intercept))
    for f, b in zip(features, coef):
        eta = eta + F.lit(float(b)) * F.col(f"`{f}`")
    return eta


def probability(features: Sequence[str], coef: Sequence[float], intercept: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_predictor(features, coef, intercept)))


Sums = tuple[float, np.ndarray, np.ndarray]


def likelihood_sums(design: DataFrame, models: Mapping[int, tuple[list[str], np.ndarray]]) -> dict[int, Sums]:
    """(log-likelihood, gradient, Hessian) of several models in one scan, intercept first."""
    used = list(dict.fromkeys(f for feats, _ in models.values() for f in feats))

    def partials(batches):
        sums = {m: np.zeros((len(beta), len(beta) + 2)) for m, (_, beta) in models.items()}
        for pdf in batches:
            y, w = pdf["y"].to_numpy(), pdf["w"].to_numpy()
            cols = {f: pdf[f].to_numpy(float) for f in used}
            one = np.ones(len(pdf))
            for m, (feats, beta) in models.items():
                x = np.column_stack([one, *[cols[f] for f in feats]])
                eta = x @ beta
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                k = len(beta)
                sums[m][:, :k] += x.T @ (x * (w * p * (1 - p))[:, None])
                sums[m][:, k] += x.T @ (w * (y - p))
                sums[m][0, k + 1] += float(np.sum(w * (y * eta - np.logaddexp(0, eta))))
        for m, t in sums.items():
            i, j = np.indices(t.shape).reshape(2, -1)
            yield pd.DataFrame({"m": np.int32(m), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": t[i, j]})

    out = {m: np.zeros((len(beta), len(beta) + 2)) for m, (_, beta) in models.items()}
    parts = design.select(*used, "y", "w").mapInPandas(partials, "m int, i int, j int, v double")
    for r in parts.groupBy("m", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["m"]][r["i"], r["j"]] = r["v"]
    return {m: (t[0, -1], t[:, -2], t[:, :-2]) for m, t in out.items()}


def separating(design: DataFrame, directions: Mapping[int, tuple[list[str], np.ndarray]]) -> set[int]:
    """The models whose direction (intercept first) orders all rows by class, in one scan.

    Along such a direction the likelihood rises without end, so no estimate exists: no bad row lies below zero, no good
    row above, and some row off it. A grouped row of both classes must lie at zero.
    """
    if not directions:
        return set()
    aggs = []
    for m, (feats, d) in directions.items():
        x = linear_predictor(feats, d[1:], d[0])
        aggs += [F.min(F.when(F.col("y") > 0, x)).alias(f"bad{m}"), F.max(F.when(F.col("y") < 1, x)).alias(f"good{m}"), F.max(F.abs(x)).alias(f"far{m}")]
    r = design.where("w > 0").agg(*aggs).first()
    out = set()
    for m in directions:
        slack = WRONG_SIDE * (r[f"far{m}"] or 0.0)
        if slack > 0 and (r[f"bad{m}"] is None or r[f"bad{m}"] >= -slack) and (r[f"good{m}"] is None or r[f"good{m}"] <= slack):
            out.add(m)
    return out


def fit_many(
    design: DataFrame, models: Sequence[Sequence[str]], ridge: float = 0.0, guess: LogitFit | None = None, max_scans: int = 40
) -> list[LogitFit]:
    """Maximum-likelihood (or ridge) fits of several feature lists over one design table, started from ``guess``.

    Steps that lower the likelihood are halved. On separable data Newton's steps never shrink and tend to a direction that
    orders the classes; models that keep moving are tested for it, and a proven one stops as ``separated``. ``converged``
    is false for these and for models that ``max_scans`` ended.
    """
    if guess is None:
        t = design.agg(F.sum(F.col("w") * F.col("y")).alias("b"), F.sum("w").alias("w")).first()
        rate = min(max(t["b"] / t["w"], 1e-9), 1 - 1e-9)
        start, known = math.log(rate / (1 - rate)), {}
    else:
        start, known = guess.intercept, guess.by_feature(guess.coef)
    feats = [list(m) for m in models]
    beta = {m: np.array([start, *[known.get(f, 0.0) for f in fs]]) for m, fs in enumerate(feats)}
    last: dict[int, tuple[float, np.ndarray]] = {}
    cov: dict[int, np.ndarray] = {}
    scale: dict[int, np.ndarray] = {}
    moves: dict[int, np.ndarray] = {}
    scans, halvings = dict.fromkeys(beta, 0), dict.fromkeys(beta, 0)
    active, separated = set(beta), set()

    def tested(among: set[int]) -> set[int]:
        moving = {m for m in among if m in moves and np.max(np.abs(moves[m]) * scale[m]) > MOVING}
        return separating(design, {m: (feats[m], moves[m]) for m in moving})

    for scan in range(1, max_scans + 1):
        if not active:
            break
        sums = likelihood_sums(design, {m: (feats[m], beta[m]) for m in active})
        for m, (ll, grad, hess) in sums.items():
            scans[m] = scan
            pen = np.array([0.0, *[ridge] * len(feats[m])])
            ll = ll - 0.5 * float(pen @ beta[m] ** 2)
            if m in last and ll < last[m][0] - 1e-9 * abs(last[m][0]):
                beta[m] = (beta[m] + last[m][1]) / 2  # overshot: go half way back
                halvings[m] += 1
                continue
            scale.setdefault(m, np.sqrt(np.diag(hess) / max(hess[0, 0], 1e-300)))
            cov[m] = np.linalg.pinv(hess + np.diag(pen))
            step = cov[m] @ (grad - pen * beta[m])
            last[m] = (ll, beta[m])
            beta[m] = beta[m] + step
            moves[m] = step
            if float((grad - pen * last[m][1]) @ step) < 1e-9:
                active.discard(m)
        if scan in SEPARATION_SCANS:
            found = tested(active)
            separated |= found
            active -= found
    separated |= tested(set(beta) - separated)
    out = []
    for m in range(len(feats)):
        fit = _finished(feats[m], beta[m], cov[m])
        fit.converged, fit.separated = m not in active and m not in separated, m in separated
        fit.scans, fit.halvings = scans[m], halvings[m]
        out.append(fit)
    return out


def fit_report(df: DataFrame, fits: Sequence[LogitFit]) -> DataFrame:
    """(model, converged, separated, scans, halvings), models named by their features."""
    rows = [(" + ".join(f.features) or "const", f.converged, f.separated, f.scans, f.halvings) for f in fits]
    return df.sparkSession.createDataFrame(rows, "model string, converged boolean, separated boolean, scans int, halvings int")


def _finished(feats: list[str], beta: np.ndarray, cov: np.ndarray) -> LogitFit:
    se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = beta / se
    p = [math.erfc(abs(v) / math.sqrt(2)) for v in z]
    return LogitFit(
        feats, float(beta[0]), [float(b) for b in beta[1:]], [float(s) for s in se[1:]], [float(v) for v in z[1:]], p[1:],
        (float(se[0]), float(z[0]), p[0]),
    )


def fit_design(design: DataFrame, features: Sequence[str], with_info: bool = False, weighted: bool = False) -> LogitFit:
    """One fit; ``with_info`` adds likelihood statistics from one more scan."""
    fit = fit_many(design, [features])[0]
    if with_info:
        fit.info = fit_statistics(design, fit, weighted)
    return fit


def fit_statistics(design: DataFrame, fit: LogitFit, weighted: bool = False) -> dict:
    pr = probability(fit.features, fit.coef, fit.intercept)
    y, w = F.col("y"), F.col("w")
    t = design.agg(F.sum(w * y).alias("b"), F.sum(w).alias("w"), F.sum("n").alias("n")).first()
    p0 = t["b"] / t["w"]
    ll, ll0 = design.agg(
        F.sum(w * (y * F.ln(pr + PROBA_EPS) + (1 - y) * F.ln(1 - pr + PROBA_EPS))).alias("ll"),
        F.sum(w * (y * math.log(p0 + PROBA_EPS) + (1 - y) * math.log(1 - p0 + PROBA_EPS))).alias("ll0"),
    ).first()
    k = len(fit.features) + 1
    lr = 2 * (ll - ll0)
    return {
        "n_observations": int(t["n"]), "n_features": len(fit.features), "n_params": k, "log_likelihood": ll,
        "null_log_likelihood": ll0, "pseudo_r2": 1 - ll / ll0 if ll0 else 0.0, "aic": -2 * ll + 2 * k,
        "bic": -2 * ll + math.log(t["n"]) * k, "lr_stat": lr, "lr_pvalue": chi2_tail(lr, k - 1) if k > 1 else None,
        "weighted": weighted, "converged": fit.converged, "separated": fit.separated,
    }


def logit_statistics(
    df: DataFrame, features: Sequence[str], target: str, weight: str | None = None, balanced: bool = False
) -> tuple[DataFrame, dict]:
    """Coefficient table (const first) and model statistics."""
    w = balanced_weight(df, target, weight) if balanced else (F.col(weight) if weight else None)
    design = design_table(df, features, target, w).cache()
    try:
        fit = fit_design(design, features, with_info=True, weighted=w is not None)
    finally:
        design.unpersist()
    return coefficient_table(df, fit), fit.info


def coefficient_table(df: DataFrame, fit: LogitFit) -> DataFrame:
    se, z, p = fit.intercept_stats
    rows = [("const", fit.intercept, se, z, p)]
    rows += list(zip(fit.features, fit.coef, fit.std_err, fit.z, fit.p))
    full = [(f, c, s, zz, pp, c - Z95 * s, c + Z95 * s, stars(pp)) for f, c, s, zz, pp in rows]
    return df.sparkSession.createDataFrame(
        full, "feature string, coef double, std_err double, z double, p_value double, ci_low double, ci_high double, stars string"
    )


def odds_ratios(coefs: DataFrame) -> DataFrame:
    return coefs.select("feature", F.exp("coef").alias("odds_ratio"), F.exp("ci_low").alias("or_low"), F.exp("ci_high").alias("or_high"), "p_value")


# ---------------------------------------------------------------- selection


def stepwise(
    df: DataFrame, features: Sequence[str], target: str, direction: str = "both", level: float = 0.05,
    max_rounds: int = 100, weight: str | None = None,
) -> tuple[list[str], list[tuple[int, str, str, float]]]:
    """Forward, backward or alternating selection by p-value on one cached design table."""
    design = design_table(df, features, target, F.col(weight) if weight else None).cache()
    log: list[tuple[int, str, str, float]] = []
    chosen = list(features) if direction == "backward" else []
    current = fit_many(design, [chosen])[0] if chosen else None
    try:
        for rnd in range(1, max_rounds + 1):
            changed = False
            rest = [f for f in features if f not in chosen]
            if direction in ("forward", "both") and rest:
                fits = fit_many(design, [[*chosen, f] for f in rest], guess=current)
                p, f, fit = min(((fit.p[-1], f, fit) for f, fit in zip(rest, fits)), key=lambda t: t[:2])
                # a feature that was just dropped would come straight back
                if p < level and not any(a == "remove" and g == f for _, a, g, _ in log[-1:]):
                    chosen, current, changed = [*chosen, f], fit, True
                    log.append((rnd, "add", f, p))
            if direction in ("backward", "both") and chosen:
                p, f = max(zip(current.p, chosen))
                if p > level:
                    chosen = [c for c in chosen if c != f]
                    log.append((rnd, "remove", f, p))
                    current = fit_many(design, [chosen], guess=current)[0] if chosen else None
                    changed = True
            if not changed:
                break
    finally:
        design.unpersist()
    return chosen, log


def significance(df: DataFrame, features: Sequence[str], target: str, level: float = 0.05) -> tuple[DataFrame, dict]:
    """p-values with a pass flag, plus AIC, BIC and pseudo R²."""
    coefs, info = logit_statistics(df, features, target)
    return coefs.where("feature <> 'const'").withColumn("significant", F.col("p_value") <= level), info


def coefficient_signs(df: DataFrame, features: Sequence[str], target: str, mode: str = "warn", weight: str | None = None) -> tuple[list[str], DataFrame]:
    """Signs in a ridge fit with penalty |b|²/2 on the summed loss; WOE features should have b >= 0."""
    schema = "feature string, coef double, valid_direction boolean"
    if mode == "ignore":
        return list(features), df.sparkSession.createDataFrame([], schema)
    design = design_table(df, features, target, F.col(weight) if weight else None).cache()
    try:
        coef = fit_many(design, [features], ridge=1.0)[0].coef
    finally:
        design.unpersist()
    rows = [(f, float(c), bool(c >= 0)) for f, c in zip(features, coef)]
    keep = [f for f, _, ok in rows if ok or mode == "warn"]
    return keep, df.sparkSession.createDataFrame(rows, schema)


def clean_model(
    df: DataFrame, features: Sequence[str], target: str, level: float = 0.05, significance_mode: str = "remove",
    sign_mode: str = "remove", max_rounds: int = 20, weight: Column | None = None,
) -> tuple[LogitFit, list[tuple[int, int, str | None, str | None, float | None]]]:
    """Refit and drop one feature per round: worst p-value first, then the most negative coefficient.

    Log rows: (round, features in the fit, removed, reason, value). The intercept never counts.
    """
    design = design_table(df, features, target, weight).cache()
    left, log, fit = list(features), [], None
    try:
        for rnd in range(1, max_rounds + 1):
            fit = fit_many(design, [left], guess=fit)[0]
            weak = [(p, f) for p, f in zip(fit.p, left) if p > level]
            negative = [(c, f) for c, f in zip(fit.coef, left) if c < 0]
            if significance_mode == "remove" and weak:
                value, drop = max(weak)
                reason = "not_significant"
            elif sign_mode == "remove" and negative:
                value, drop = min(negative)
                reason = "negative_coefficient"
            else:
                log.append((rnd, len(left), None, None, None))
                break
            log.append((rnd, len(left), drop, reason, value))
            left.remove(drop)
            if not left:
                raise ValueError("cleaning removed every feature")
        final = fit if fit.features == left else fit_many(design, [left], guess=fit)[0]
        final.info = fit_statistics(design, final, weight is not None)
    finally:
        design.unpersist()
    return final, log

