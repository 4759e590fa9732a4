"""Rule-set analysis: union coverage, increments, overlap, selection, amounts.

Rules are Columns over the data, so nothing here materialises hit masks. Ordered
prefixes need only the first rule each row hits; overlap needs a rules x rules
product summed per task; greedy selection works on the table of distinct hit
lists, which stays distributed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.numeric import ratio, when_sum
from scorewright.functions.rule_expr import any_of, compile_rules
from scorewright.operators.evaluate import hit_list, totals, weight_column
from scorewright.operators.rule_index import rule_products, rule_sums


def compiled(df: DataFrame, rules: Sequence[str]) -> list[tuple[str, Column]]:
    """Rules that compile against the data; callers report the rest via ``compile_rules``."""
    return compile_rules(rules, df.columns)[0]


def names_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(names)), "pos int, rule string")


# ---------------------------------------------------------------- hit lists


def hit_signatures(
    df: DataFrame, rules: Sequence[str], target: str, weight: str | None = None, amount: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., hits) -> n, w, bad_w, amt, bad_amt, one row per distinct list of hit rules."""
    good = compiled(df, rules)
    w = weight_column(weight)
    bad = F.col(target) == 1
    amt = amount_value(amount) if amount else F.lit(0.0)
    rows = df.select(
        *by, hit_list([h for _, h in good]).alias("hits"), w.alias("__w"), bad.alias("__bad"), amt.alias("__amt")
    )
    return rows.groupBy(*by, "hits").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w"), when_sum(F.col("__bad"), F.col("__w")).alias("bad_w"),
        F.sum("__amt").alias("amt"), when_sum(F.col("__bad"), F.col("__amt")).alias("bad_amt"),
    )


def multi_hit(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Rows by number of rules hit, with share of all rows."""
    good = compiled(df, rules)
    cnt = sum((h.cast("int") for _, h in good), F.lit(0))
    w = Window.partitionBy(F.lit(0))
    return (
        df.groupBy(cnt.alias("n_hit")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", F.col("n") / F.sum("n").over(w))
    )


def union_metrics(df: DataFrame, rules: Sequence[str], target: str, weight: str | None = None) -> DataFrame:
    """Coverage and recall of the OR of all rules."""
    hit = any_of([h for _, h in compiled(df, rules)])
    w, bad = weight_column(weight), F.col(target) == 1
    agg = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("hit_n"),
        F.sum(w).alias("w"), when_sum(hit, w).alias("hit_w"),
        when_sum(bad, w).alias("total_bad_w"), when_sum(hit & bad, w).alias("hit_bad_w"),
    )
    return agg.select(
        "n", "hit_n", ratio(F.col("hit_n"), F.col("n")).alias("coverage"),
        ratio(F.col("hit_bad_w"), F.col("total_bad_w")).alias("union_recall"),
        ratio(F.col("hit_bad_w"), F.col("hit_w")).alias("union_bad_rate"),
        ratio(F.col("hit_w"), F.col("w")).alias("union_hit_rate"),
    )


# ---------------------------------------------------------------- increments


def prior_increment(
    df: DataFrame, rules: Sequence[str], prior: Sequence[str], target: str, weight: str | None = None
) -> DataFrame:
    """Each rule alone and on top of the OR of the prior rules."""
    total = totals(df, target, weight)
    in_prior = any_of([h for _, h in compiled(df, prior)])
    w, bad = weight_column(weight), F.col(target) == 1
    sums, index = rule_sums(df, rules, {
        "w": w, "bad_w": F.when(bad, w), "new_w": F.when(~in_prior, w), "new_bad_w": F.when(~in_prior & bad, w), "both_w": F.when(in_prior, w),
    })
    tw, tb = F.lit(total["w"]), F.lit(total["bad_w"])
    out = names_table(df, index.names).join(sums, "pos", "left").fillna(0.0)
    alone, extra = ratio(F.col("bad_w"), tb), ratio(F.col("new_bad_w"), tb)
    return out.select(
        "rule", alone.alias("standalone_recall"), ratio(F.col("w"), tw).alias("standalone_hit_rate"),
        extra.alias("incremental_recall"), ratio(F.col("new_w"), tw).alias("incremental_hit_rate"),
        ratio(F.col("both_w"), F.col("w")).alias("overlap_rate"), ratio(extra, alone).alias("marginal_contribution"),
    )


def prior_summary(df: DataFrame, prior: Sequence[str], target: str, weight: str | None = None) -> DataFrame:
    hit = any_of([h for _, h in compiled(df, prior)])
    w, bad = weight_column(weight), F.col(target) == 1
    return df.agg(
        F.sum(w).alias("w"), when_sum(bad, w).alias("b"), when_sum(hit, w).alias("hw"), when_sum(hit & bad, w).alias("hb"),
        F.count(F.when(hit, 1)).alias("prior_hit_count"), F.count(F.when(hit & bad, 1)).alias("prior_bad_count"),
    ).select(
        ratio(F.col("hw"), F.col("w")).alias("prior_hit_rate"), ratio(F.col("hb"), F.col("b")).alias("prior_recall"),
        "prior_hit_count", "prior_bad_count",
    )


# ---------------------------------------------------------------- amounts


def amount_value(name: str) -> Column:
    """Numeric amount; text that is no number, NaN and missing count as 0."""
    x = F.col(f"`{name}`").try_cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))


def rule_amounts(df: DataFrame, rules: Sequence[str], target: str, amount: str) -> DataFrame:
    """Hit and bad amounts per rule with shares, amount bad rate and amount lift."""
    amt, bad = amount_value(amount), F.col(target) == 1
    t = df.agg(F.sum(amt).alias("a"), when_sum(bad, amt).alias("b")).first()
    total, total_bad = F.lit(t["a"] or 0.0), F.lit(t["b"] or 0.0)
    sums, index = rule_sums(df, rules, {"hit_amount": amt, "bad_amount": F.when(bad, amt)})
    out = names_table(df, index.names).join(sums.withColumnRenamed("n", "hit_n"), "pos", "left").fillna(0)

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    rate = share(F.col("bad_amount"), F.col("hit_amount"))
    return out.select(
        "rule", "hit_n", "hit_amount", share(F.col("hit_amount"), total).alias("hit_amount_pct"), "bad_amount",
        share(F.col("bad_amount"), total_bad).alias("bad_amount_pct"), rate.alias("amount_bad_rate"),
        share(rate, share(total_bad, total)).alias("amount_lift"),
        share(F.col("hit_amount"), F.col("hit_n").cast("double")).alias("avg_amount_per_hit"),
    )


# ---------------------------------------------------------------- ordered prefixes


def first_hits(
    df: DataFrame, rules: Sequence[str], target: str, weight: str | None = None, amount: str | None = None
) -> DataFrame:
    """Per position in the given order: what that rule adds beyond all earlier rules.

    The first rule a row hits is one CASE, so the whole prefix table is a single
    aggregate with as many groups as rules.
    """
    good = compiled(df, rules)
    first = None
    for i, (_, h) in enumerate(good):
        first = F.when(h, F.lit(i)) if first is None else first.when(h, F.lit(i))
    w, bad = weight_column(weight), F.col(target) == 1
    amt = amount_value(amount) if amount else F.lit(0.0)
    new = df.groupBy(first.alias("pos")).agg(
        F.count(F.lit(1)).alias("new_n"), F.sum(w).alias("new_w"), when_sum(bad, w).alias("new_bad_w"),
        F.sum(amt).alias("new_amt"), when_sum(bad, amt).alias("new_bad_amt"),
    )
    cols = ["new_n", "new_w", "new_bad_w", "new_amt", "new_bad_amt"]
    return names_table(df, [r for r, _ in good]).join(new, "pos", "left").fillna(0, cols)


def prefix_table(
    df: DataFrame, rules: Sequence[str], target: str, weight: str | None = None, amount: str | None = None
) -> DataFrame:
    """Cumulative metrics after each rule of an ordered list."""
    total = totals(df, target, weight)
    upto = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = first_hits(df, rules, target, weight, amount)
    cum = steps.select(
        "pos", "rule", "new_n", "new_w", "new_bad_w",
        F.sum("new_w").over(upto).alias("cum_w"), F.sum("new_bad_w").over(upto).alias("cum_bad_w"),
        F.sum("new_amt").over(upto).alias("cum_amt"), F.sum("new_bad_amt").over(upto).alias("cum_bad_amt"),
    )
    rate = ratio(F.col("cum_bad_w"), F.col("cum_w"))
    tw, tb = F.lit(total["w"]), F.lit(total["bad_w"])
    return cum.select(
        "*", ratio(F.col("cum_bad_w"), tb).alias("cum_recall"), rate.alias("cum_bad_rate"),
        ratio(rate, ratio(tb, tw)).alias("cum_lift"), ratio(F.col("cum_w"), tw).alias("cum_hit_rate"),
    )


def cumulative_amounts(df: DataFrame, rules: Sequence[str], target: str, amount: str) -> DataFrame:
    """Amounts of new hits accumulated in rule order."""
    amt, bad = amount_value(amount), F.col(target) == 1
    t = df.agg(F.sum(amt).alias("a"), when_sum(bad, amt).alias("b")).first()
    total, total_bad = F.lit(t["a"] or 0.0), F.lit(t["b"] or 0.0)

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    rate = share(F.col("cum_bad_amt"), F.col("cum_amt"))
    return prefix_table(df, rules, target, amount=amount).select(
        "pos", "rule", F.col("cum_amt").alias("cum_hit_amount"), F.col("cum_bad_amt").alias("cum_bad_amount"),
        share(F.col("cum_amt"), total).alias("cum_hit_amount_pct"), share(F.col("cum_bad_amt"), total_bad).alias("amount_recall"),
        rate.alias("cum_amount_bad_rate"), share(rate, share(total_bad, total)).alias("cum_amount_lift"),
    )


def post_strategy_bad_rate(bad_rate: Column, recall: Column, hit_rate: Column) -> Column:
    """Bad rate among the rows the rules let through."""
    return F.when(hit_rate < 1, bad_rate * (F.lit(1.0) - recall) / (F.lit(1.0) - hit_rate)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- selection


def recall_target(
    min_recall: float | None, target_bad_rate: float | None, bad_rate: float, max_hit_rate: float
) -> float | None:
    """Recall a set must reach; a target bad rate t turns into 1 - (t / p)(1 - max hit rate)."""
    need = min_recall
    if target_bad_rate is not None and 0 < target_bad_rate < bad_rate:
        implied = min(1.0, max(0.0, 1 - target_bad_rate / bad_rate * (1 - max_hit_rate)))
        need = implied if need is None else max(need, implied)
    return need


def back_off(prefix: Sequence[Mapping], min_lift: float | None = None, min_bad_rate: float | None = None) -> int:
    """Length of the prefix closest to an unmet lift (first) or bad-rate target; longest on ties."""
    if len(prefix) <= 1:
        return len(prefix)
    if min_lift is not None and prefix[-1]["cum_lift"] < min_lift:
        field, goal = "cum_lift", min_lift
    elif min_bad_rate is not None and prefix[-1]["cum_bad_rate"] < min_bad_rate:
        field, goal = "cum_bad_rate", min_bad_rate
    else:
        return len(prefix)
    gaps = [max(0.0, goal - p[field]) for p in prefix]
    met = [i for i, g in enumerate(gaps) if g == 0]
    best = max(met) if met else max(i for i, g in enumerate(gaps) if g == min(gaps))
    return best + 1


def best_rules_overlap(
    df: DataFrame, rules: Sequence[str], target: str, weight: str | None = None, max_hit_rate: float = 0.1,
    min_lift: float | None = None, min_bad_rate: float | None = None,
) -> DataFrame:
    """Rules by bad rate, highest first, until the next one would push the hit rate over the limit.

    Two jobs whatever the number of rules: single-rule metrics, then the prefix table.
    """
    from scorewright.operators.evaluate import compound_rule_metrics

    metrics, _ = compound_rule_metrics(df, rules, target, weight)
    rate = ratio(F.col("bad_w"), F.col("hit_w"))
    ranked = [
        r["rule"]
        for r in metrics.select("pos", "rule", rate.alias("r")).where("r > 0").orderBy(F.desc("r"), "pos").collect()
    ]
    if not ranked:
        return prefix_table(df, list(rules), target, weight).where(F.lit(False))
    table = prefix_table(df, ranked, target, weight)
    kept = []
    for p in table.orderBy("pos").collect():
        if p["cum_hit_rate"] > max_hit_rate:
            break
        kept.append(p)
    n = back_off(kept, min_lift, min_bad_rate)
    return df.sparkSession.createDataFrame(kept[:n], table.schema)


def best_rules_greedy(
    df: DataFrame, rules: Sequence[str], target: str, weight: str | None = None, max_hit_rate: float = 0.1,
    min_lift: float | None = None, min_bad_rate: float | None = None,
) -> DataFrame:
    """Repeatedly the rule with the highest bad rate on the rows no chosen rule hits.

    Each round is one aggregate over the table of distinct hit lists; the list of
    chosen rules is the only state on the driver.
    """
    good = compiled(df, rules)
    total = totals(df, target, weight)
    sig = hit_signatures(df, rules, target, weight).where(F.size("hits") > 0).cache()
    base = total["bad_w"] / total["w"] if total["w"] else 0.0
    chosen: list[int] = []
    prefix: list[dict] = []
    cum_w = cum_b = 0.0
    try:
        while len(chosen) < len(good):
            left = sig
            if chosen:
                left = sig.where(~F.arrays_overlap("hits", F.array(*[F.lit(i) for i in chosen])))
            scores = (
                left.select(F.explode("hits").alias("pos"), "w", "bad_w").groupBy("pos")
                .agg(F.sum("w").alias("w"), F.sum("bad_w").alias("bad_w"))
                .withColumn("rate", ratio(F.col("bad_w"), F.col("w")))
            )
            top = scores.where("rate > 0").orderBy(F.desc("rate"), "pos").first()
            if top is None:
                break
            if total["w"] and (cum_w + top["w"]) / total["w"] > max_hit_rate:
                break
            cum_w += top["w"]
            cum_b += top["bad_w"]
            chosen.append(top["pos"])
            rate = cum_b / cum_w if cum_w else 0.0
            prefix.append({
                "pos": len(chosen) - 1, "rule": good[top["pos"]][0], "new_w": top["w"], "new_bad_w": top["bad_w"],
                "cum_recall": cum_b / total["bad_w"] if total["bad_w"] else 0.0, "cum_bad_rate": rate,
                "cum_lift": rate / base if base else 0.0, "cum_hit_rate": cum_w / total["w"] if total["w"] else 0.0,
            })
    finally:
        sig.unpersist()
    schema = ("pos int, rule string, new_w double, new_bad_w double, cum_recall double, cum_bad_rate double, "
              "cum_lift double, cum_hit_rate double")
    return df.sparkSession.createDataFrame(prefix[: back_off(prefix, min_lift, min_bad_rate)], schema)


def optimal_with_info(metrics: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected rules with their own metrics next to the cumulative ones."""
    info = metrics.select("rule", "recall", "bad_rate", "lift", "hit_rate")
    cums = selected.select("pos", "rule", "cum_recall", "cum_bad_rate", "cum_lift", "cum_hit_rate")
    return info.join(cums, "rule").orderBy("cum_hit_rate", "pos")


def rank_by_bad_rate(metrics: DataFrame) -> DataFrame:
    """Position of each rule by bad rate (ties by rule text)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bad_rate"), "rule")
    return metrics.withColumn("rank", F.row_number().over(w))


def rejection_reasons(
    metrics: DataFrame, selected: DataFrame, max_hit_rate: float, allow_overlap: bool = True,
    recall_goal: float | None = None, from_bad_rate: bool = False,
) -> DataFrame:
    """Why each evaluated rule is not in the chosen set."""
    ranked = rank_by_bad_rate(metrics.select("rule", "bad_rate", "hit_rate", "lift"))
    chosen = selected.select("rule", "cum_recall", "cum_hit_rate")
    last = ranked.join(chosen, "rule").agg(
        F.max("rank").alias("rank"), F.max("cum_recall").alias("reached"), F.max("cum_hit_rate").alias("used")
    ).first()
    beyond = F.col("rank") > (last["rank"] or 0)
    goal_met = F.lit(recall_goal is not None and (last["reached"] or 0.0) >= recall_goal * 0.95)
    limit = F.lit((last["used"] or 0.0) >= max_hit_rate * 0.95)
    rest = F.when(beyond, "ranked_low").otherwise("unexpected") if allow_overlap else F.lit("rows_consumed")
    reason = (
        F.when(beyond & goal_met, "target_bad_rate_met" if from_bad_rate else "recall_target_met")
        .when(beyond & limit, "hit_rate_limit")
        .otherwise(rest)
    )
    return (
        ranked.join(chosen.select("rule"), "rule", "left_anti")
        .select("rule", "bad_rate", "hit_rate", "lift", "rank", reason.alias("reason"))
    )


# ---------------------------------------------------------------- rule pairs


def _paired(co: DataFrame, own: DataFrame) -> DataFrame:
    """Names, hits and likeness for the pairs (i, j, common)."""
    a = own.select(F.col("pos").alias("i"), F.col("rule").alias("rule1"), F.col("hits").alias("hits1"))
    b = own.select(F.col("pos").alias("j"), F.col("rule").alias("rule2"), F.col("hits").alias("hits2"))
    jaccard = ratio(F.col("common"), F.col("hits1") + F.col("hits2") - F.col("common"), None)
    out = co.join(a, "i").join(b, "j").withColumn("jaccard", jaccard)
    return out.select("i", "j", "rule1", "hits1", "rule2", "hits2", "common", "jaccard")


def _own_hits(df: DataFrame, co: DataFrame, names: Sequence[str]) -> DataFrame:
    alone = co.where("i = j").select(F.col("i").alias("pos"), F.col("common").alias("hits"))
    return names_table(df, names).join(alone, "pos", "left").fillna(0, ["hits"])


def sharing_pairs(df: DataFrame, rules: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs i < j of rules that hit a row together, with hit counts and common hits, and the rules (pos, rule, hits).

    Pairs without a common row are never formed.
    """
    co, index = rule_products(df, rules)
    co = co.cache()
    own = _own_hits(df, co, index.names)
    return _paired(co.where("i < j"), own), own


def rule_pairs(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """All pairs i < j with hit counts and common hits (a report of rules² rows; ``sharing_pairs`` leaves out empty ones)."""
    co, index = rule_products(df, rules)
    first = F.posexplode(F.sequence(F.col("pos") + 1, F.lit(len(index.names) - 1))).alias("p", "j")
    every = names_table(df, index.names).where(F.col("pos") < len(index.names) - 1).select(F.col("pos").alias("i"), first).drop("p")
    return _paired(every.join(co, ["i", "j"], "left").fillna(0, ["common"]), _own_hits(df, co, index.names))


def sharing_report(pairs: DataFrame, own: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``overlap_report`` from ``sharing_pairs``: the other pairs count as zero, but for pairs of two rules without hits."""
    r = own.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hits") == 0, 1)).alias("idle")).first()
    judged = math.comb(r["n"], 2) - math.comb(r["idle"], 2)
    return pairs.agg(
        (F.coalesce(F.sum("jaccard"), F.lit(0.0)) / max(judged, 1)).alias("avg_overlap"), F.count(F.when(F.col("jaccard") > threshold, 1)).alias("n_high")
    ).withColumn("status", F.when(F.col("avg_overlap") > threshold, "warning").otherwise("ok"))


def overlap_report(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pairs.agg(
        F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("avg_overlap"), F.count(F.when(F.col("jaccard") > threshold, 1)).alias("n_high")
    ).withColumn("status", F.when(F.col("avg_overlap") > threshold, "warning").otherwise("ok"))


def redundant_rules(pairs: DataFrame) -> DataFrame:
    """(containing, redundant): every hit of the second is a hit of the first."""
    full = F.array(
        F.when((F.col("hits2") > 0) & (F.col("common") == F.col("hits2")), F.struct(F.col("rule1").alias("containing_rule"), F.col("rule2").alias("redundant_rule"))),
        F.when((F.col("hits1") > 0) & (F.col("common") == F.col("hits1")), F.struct(F.col("rule2").alias("containing_rule"), F.col("rule1").alias("redundant_rule"))),
    )
    return pairs.select(F.inline(F.array_compact(full)))
