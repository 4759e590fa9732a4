"""Rule mining end to end: prepare, derive features, generate, filter, select, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.rule_expr import BadRule, compile_rules
from scorewright.operators import binning, clean, columns, evaluate, logit, profile, rules, ruleset, split, stability, trees, validation
from scorewright.plans.staging import stage
from scorewright.roles import Roles


@dataclass(frozen=True)
class RuleMiningParams:
    """Defaults follow the task description of the reference behaviour."""

    modes: tuple[str, ...] = ("single", "tree", "combination")
    n_bins: int = 10
    bin_method: str = "quantile"
    n_vars: int = 2
    max_depth: int = 3
    min_leaf_share: float = 0.02
    min_iv: float = 0.02
    missing_limit: float = 0.5
    max_hit_rate: float = 0.1
    min_lift: float = 2.0
    max_set_hit_rate: float = 0.1
    allow_overlap: bool = True
    min_set_lift: float | None = None
    min_set_bad_rate: float | None = None
    imbalance: str = "auto"
    oot_ratio: float = 0.2
    test_ratio: float = 0.3
    cv_threshold: float = 0.35
    drop_unstable: bool = False
    prior_rules: tuple[str, ...] = ()
    max_categories: int = 20


@dataclass
class RuleMiningResult:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    bad_rules: list[BadRule] = field(default_factory=list)
    info: dict = field(default_factory=dict)


def prepare(df: DataFrame, roles: Roles, params: RuleMiningParams) -> tuple[DataFrame, dict]:
    """Roles checked, non-features and mostly missing columns dropped, features derived, rows split."""
    roles.check(df)
    profile.check_target(df, roles.target)
    fixed = roles.non_features()
    odd = [r["column"] for r in columns.non_feature_columns(df, fixed).where("reason <> 'time'").collect()]
    slim = df.drop(*dict.fromkeys(odd))
    out, info = clean.preprocess(slim, exclude=fixed, missing_limit=params.missing_limit, max_categories=params.max_categories)
    info["non_features"] = sorted(set(odd))
    if roles.keys:
        out = split.split_data(
            out, roles.target, list(roles.keys), roles.sample_type, roles.time, params.oot_ratio if roles.time else 0.0, params.test_ratio
        )
    else:
        out = out.withColumn("split", F.lit("train"))
    return out, info


def class_weight(df: DataFrame, roles: Roles, params: RuleMiningParams) -> Column:
    """Row weights of trees and directions: balanced by class if the run asks for it or, on ``auto``, its classes do."""
    balance = params.imbalance == "class_weight" or (
        params.imbalance == "auto" and logit.imbalance(df, roles.target).first()["applied_strategy"] == "class_weight"
    )
    return logit.balanced_weight(df, roles.target, roles.weight) if balance else evaluate.weight_column(roles.weight)


def generate(df: DataFrame, feats: Sequence[str], roles: Roles, params: RuleMiningParams) -> DataFrame:
    """Distinct candidate rules (rule, used_var, threshold, direction) of all modes."""
    parts = []
    binary = columns.binary_features(df, feats)
    tree_weight = class_weight(df, roles, params) if {"tree", "combination"} & set(params.modes) else None
    if "single" in params.modes:
        cuts = binning.thresholds(df, [f for f in feats if f not in binary], params.n_bins, params.bin_method, target=roles.target)
        cuts.update({f: [1.0] for f in binary})
        parts.append(rules.threshold_rules(df.sparkSession, cuts, binary).drop("rule_id"))
    if "tree" in params.modes:
        leaky = {r["feature"] for r in evaluate.leakage(df, list(feats), roles.target).where("leaky").collect()}
        use = [f for f in feats if f not in leaky]
        parts.append(trees.tree_rules(df, use, roles.target, tree_weight, params.max_depth, params.min_leaf_share))
    if "combination" in params.modes and len(feats) >= params.n_vars:
        parts.append(
            trees.combination_tree_rules(df, feats, roles.target, tree_weight, params.n_vars, params.max_depth, params.min_leaf_share)
        )
    out = None
    for p in parts:
        for c, t in (("threshold", "double"), ("direction", "string")):
            if c not in p.columns:
                p = p.withColumn(c, F.lit(None).cast(t))
        p = p.select("rule", "used_var", "threshold", "direction")
        out = p if out is None else out.unionByName(p)
    return out.dropDuplicates(["rule"])


def measure(df: DataFrame, candidates: DataFrame, roles: Roles) -> DataFrame:
    """Metrics of all candidates: threshold rules from one histogram, the rest from their hits."""
    cuts: dict[str, list[float]] = {}
    single, other = [], []
    for r in candidates.orderBy("rule").collect():
        if r["direction"] in ("<=", ">"):
            single.append(r["rule"])
            cuts.setdefault(r["used_var"], []).append(r["threshold"])
        else:
            other.append(r["rule"])
    cols = ["rule", "hit_n", "hit_w", "bad_w", "recall", "bad_rate", "lift", "hit_rate"]
    out = evaluate.compound_rule_metrics(df, other, roles.target, roles.weight)[0].select(*cols)
    if single:
        listed = df.sparkSession.createDataFrame([(r,) for r in single], "rule string")
        both = evaluate.threshold_rule_metrics(df, cuts, roles.target, roles.weight).select(*cols)
        out = out.unionByName(both.join(F.broadcast(listed), "rule", "left_semi"))
    return out


def run(df: DataFrame, roles: Roles, params: RuleMiningParams | None = None) -> RuleMiningResult:
    params = params or RuleMiningParams()
    res = RuleMiningResult()
    ready, res.info = prepare(df, roles, params)
    ready = stage(ready, ("split",))
    dev = ready.where(F.col("split") != "oot")
    t = res.tables
    candidates = [c for c in clean.feature_columns(ready, [*roles.non_features(), "split"])]
    iv = binning.weighted_iv(dev, roles.target, roles.weight, candidates).cache()
    t["feature_iv"] = iv
    res.features = [r["feature"] for r in iv.where(F.col("iv") >= params.min_iv).orderBy(F.desc("iv"), "feature").collect()] or candidates
    t["split_rates"] = split.split_target_rates(ready, roles.target)
    t["missing"] = profile.missing_report(df)

    # the rule list is metadata: its size follows features x bins, not rows
    generated = generate(dev, res.features, roles, params).cache()
    listed = [r["rule"] for r in generated.select("rule").orderBy("rule").collect()]
    _, res.bad_rules = compile_rules(listed, dev.columns)
    directions = trees.rule_directions(dev, res.features, roles.target, class_weight(dev, roles, params)).cache()
    t["directions"] = directions
    directed = evaluate.filter_multi_rules(evaluate.filter_by_direction(generated, directions), directions)
    metrics = measure(dev, directed, roles).cache()
    t["rule_metrics"] = generated.join(metrics, "rule")
    t["rule_status"] = evaluate.rule_funnel(generated, directed, metrics, params.max_hit_rate, params.min_lift)
    good = evaluate.filter_by_metrics(metrics, params.max_hit_rate, params.min_lift)
    kept = [r["rule"] for r in good.orderBy("rule").collect()]
    if not kept:
        return res
    pick = ruleset.best_rules_overlap if params.allow_overlap else ruleset.best_rules_greedy
    best = pick(dev, kept, roles.target, roles.weight, params.max_set_hit_rate, params.min_set_lift, params.min_set_bad_rate).cache()
    final = [r["rule"] for r in best.orderBy("pos").collect()]
    if not final:
        return res
    if roles.time and roles.keys:
        cv = stability.rule_cv(ready, final, "split", params.cv_threshold)
        t["stability"] = cv
        if params.drop_unstable:
            best = stability.drop_unstable(best, cv)
            final = [r["rule"] for r in best.orderBy("pos").collect()]
        t["rule_psi"] = stability.rule_psi(ready, final, "split", "train", "oot")
    t["best_rules"] = ruleset.optimal_with_info(metrics, best)
    t["rejected"] = ruleset.rejection_reasons(good, best, params.max_set_hit_rate, params.allow_overlap)
    if params.prior_rules:
        t["prior_increment"] = ruleset.prior_increment(dev, final, list(params.prior_rules), roles.target, roles.weight)
        t["prior_summary"] = ruleset.prior_summary(dev, list(params.prior_rules), roles.target, roles.weight)
    if roles.amount:
        t["amounts"] = ruleset.rule_amounts(dev, final, roles.target, roles.amount)
        t["cumulative_amounts"] = ruleset.cumulative_amounts(dev, final, roles.target, roles.amount)
    t["validation"] = validation.validate_rules(dev, final, roles.target)
    return res
