"""Scorecard development end to end: quality, split, WOE, selection, model, card, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.numeric import nan_to_null
from scorewright.operators import binning, clean, curves, logit, profile, scorecard, selection, split, stability, validation
from scorewright.plans.staging import stage
from scorewright.roles import Roles


@dataclass(frozen=True)
class ScorecardParams:
    bin_method: str = "quantile"
    max_bins: int = 8
    missing_limit: float = 0.95
    identical_limit: float = 0.95
    iv_range: tuple[float, float] = (0.02, 0.5)
    max_corr: float = 0.7
    max_vif: float = 5.0
    use_stepwise: bool = True
    level: float = 0.05
    sign_mode: str = "remove"
    imbalance: str = "auto"
    base_score: float = 600.0
    base_odds: float = 20.0
    pdo: float = 20.0
    oot_ratio: float = 0.2
    test_ratio: float = 0.3


@dataclass
class Scorecard:
    features: list[str]
    card: DataFrame
    base_points: float
    tables: dict[str, DataFrame] = field(default_factory=dict)
    model: logit.LogitFit | None = None
    log: list = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return scorecard.apply_card(df, self.card, self.base_points, self.features, out)


def run(df: DataFrame, roles: Roles, params: ScorecardParams | None = None) -> Scorecard:
    params = params or ScorecardParams()
    roles.check(df)
    profile.check_target(df, roles.target)
    ready = clean.sentinels_to_null(nan_to_null(df), [c for c in clean.feature_columns(df, roles.non_features())])
    ready = split.split_data(
        ready, roles.target, list(roles.keys), roles.sample_type, roles.time, params.oot_ratio if roles.time else 0.0, params.test_ratio
    )
    ready = stage(ready, ("split",))
    train = ready.where("split = 'train'")
    tables: dict[str, DataFrame] = {}
    cols = clean.feature_columns(ready, [*roles.non_features(), "split"])
    missing = {r["variable"]: r["missing_rate"] for r in profile.missing_report(train, cols).collect()}
    same = profile.dominated_columns(train, cols, params.identical_limit)
    quality = [(c, missing[c], same.get(c), "missing" if missing[c] >= params.missing_limit else "identical" if c in same else "") for c in cols]
    tables["quality"] = df.sparkSession.createDataFrame(quality, "variable string, missing_rate double, mode_share double, reason string")
    feats = sorted(c for c, _, _, reason in quality if not reason)
    feats = binning.usable_features(train, feats)
    bins = binning.fit_woe(train, roles.target, feats, params.max_bins, params.bin_method).cache()
    iv = binning.iv_table(bins).cache()
    tables.update(bins=bins, iv=iv, monotonicity=binning.monotonicity(bins))
    woe_train = binning.woe_columns(train, bins, feats)
    sel = selection.select_features(
        woe_train, iv, feats, roles.target, params.iv_range, params.max_corr, params.max_vif, params.use_stepwise, params.level
    )
    tables["selection"] = selection.selection_detail(woe_train, bins, iv, feats, sel)
    tables["selection_steps"] = selection.removal_counts(df, sel.removed, len(feats))
    if not sel.kept:
        raise ValueError("no feature passed the selection")
    balance = params.imbalance == "class_weight" or (
        params.imbalance == "auto" and logit.imbalance(train, roles.target).first()["applied_strategy"] == "class_weight"
    )
    weight = logit.balanced_weight(train, roles.target, roles.weight) if balance else (F.col(roles.weight) if roles.weight else None)
    fit, log = logit.clean_model(
        woe_train, [f"{f}_woe" for f in sel.kept], roles.target, params.level, "remove", params.sign_mode, weight=weight
    )
    final = [f.removesuffix("_woe") for f in fit.features]
    tables["model"] = logit.coefficient_table(df, fit)
    card, base = scorecard.card_points(
        bins, dict(zip(final, fit.coef)), fit.intercept, params.base_score, params.base_odds, params.pdo
    )
    card = card.cache()
    out = Scorecard(final, card, base, tables, fit, log)
    scored = out.score(ready).cache()
    tables["card_export"] = scorecard.card_export(bins, card)
    tables["card_detail"] = scorecard.card_detail(card)
    tables["card_range"] = scorecard.card_range(card, base)
    splits = [r["split"] for r in scored.select("split").distinct().collect() if r["split"]]
    tables["score_statistics"] = scorecard.score_statistics(scored, "score", "split", splits)
    evaluation = curves.discrimination(scored, "score", roles.target, ["split"], higher_is_bad=False).cache()
    tables["evaluation"] = evaluation
    tables["overfit"] = curves.overfit_check(evaluation)
    other = "oot" if "oot" in splits else "test"
    psi = stability.distribution_psi(scored, ["score"], "split", "train", other)
    tables["score_psi"] = psi
    woe_all = binning.woe_columns(ready, bins, final)
    csi = stability.distribution_psi(woe_all, [f"{f}_woe" for f in final], "split", "train", other)
    tables["feature_csi"] = csi.orderBy(F.desc("psi"), "feature")
    tables["score_bands"] = curves.score_bands(scored, "score", roles.target)
    tables["validation"] = validation.validate_card(scored, "score", roles.target, psi.first()["psi"])
    return out
