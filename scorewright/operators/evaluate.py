"""Rule metrics: histogram path for threshold rules, an index of comparisons for compound rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.numeric import distinct_estimate, ratio
from scorewright.functions.rule_expr import BadRule
from scorewright.operators.histogram import edge_table, histogram
from scorewright.operators.rule_index import rule_sums
from scorewright.operators.rules import number_text

# Hit weight below which a rule's metrics are zero.
MIN_HIT_WEIGHT = 1.0


def weight_column(weight: str | Column | None) -> Column:
    if isinstance(weight, Column):
        return weight.cast("double")
    return (F.col(weight) if weight else F.lit(1.0)).cast("double")


def totals(df: DataFrame, target: str, weight: str | None = None) -> dict[str, float]:
    w = weight_column(weight)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(F.when(F.col(target) == 1, w)).alias("bad_w")
    ).first()
    return {"n": row["n"], "w": row["w"] or 0.0, "bad_w": row["bad_w"] or 0.0}


def metric_columns(hit_w: Column, bad_w: Column, total: Mapping[str, float]) -> list[Column]:
    """recall, bad_rate, lift, hit_rate at full precision, zeros under the minimum hit weight."""
    enough = hit_w >= MIN_HIT_WEIGHT
    w, b = F.lit(float(total["w"])), F.lit(float(total["bad_w"]))
    bad_rate = ratio(bad_w, hit_w)
    zero = F.lit(0.0)
    return [
        F.when(enough, ratio(bad_w, b)).otherwise(zero).alias("recall"),
        F.when(enough, bad_rate).otherwise(zero).alias("bad_rate"),
        F.when(enough, ratio(bad_rate, ratio(b, w))).otherwise(zero).alias("lift"),
        ratio(hit_w, w).alias("hit_rate"),
    ]


def threshold_rule_metrics(
    df: DataFrame, cuts: Mapping[str, Sequence[float]], target: str, weight: str | None = None
) -> DataFrame:
    """Metrics of every ``<= t`` and ``> t`` rule from one histogram and running sums.

    One scan for any number of thresholds; the windows see one row per bin.
    """
    total = totals(df, target, weight)
    live = {f: c for f, c in cuts.items() if len(c)}
    hist = histogram(df, live, target, weight, closed="right").select("feature", "bin", "n", "w", "bad_w")
    edges = F.broadcast(edge_table(df.sparkSession, live))
    cells = edges.join(hist, ["feature", "bin"], "left").fillna(0, ["n", "w", "bad_w"])
    upto = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("feature").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    cums = cells.select(
        "feature",
        F.col("hi").alias("threshold"),
        *[F.coalesce(F.sum(c).over(win), F.lit(0)).alias(f"{c}_{s}")
          for c in ("n", "w", "bad_w") for win, s in ((upto, "le"), (after, "gt"))],
    ).where(F.col("threshold").isNotNull())
    long = cums.select(
        "feature", "threshold",
        F.inline(F.array(*[
            F.struct(
                F.lit(d).alias("direction"), F.col(f"n_{s}").alias("hit_n"),
                F.col(f"w_{s}").cast("double").alias("hit_w"), F.col(f"bad_w_{s}").cast("double").alias("bad_w"),
            )
            for d, s in (("<=", "le"), (">", "gt"))
        ])),
    )
    text = {t: number_text(t) for c in live.values() for t in map(float, c)}
    names = F.create_map(*[x for t, s in text.items() for x in (F.lit(t), F.lit(s))])
    rule = F.concat(F.lit("("), F.col("feature"), F.lit(" "), F.col("direction"), F.lit(" "),
                    F.element_at(names, F.col("threshold")), F.lit(")"))
    return long.select(
        rule.alias("rule"), F.col("feature").alias("used_var"), "threshold", "direction", "hit_n", "hit_w", "bad_w",
        *metric_columns(F.col("hit_w"), F.col("bad_w"), total),
    )


# Rules whose conditions still compile into one method the JVM optimises.
RULES_PER_SCAN = 16


def hit_list(hits: Sequence[Column], first: int = 0) -> Column:
    """Positions (ascending, from ``first``) of the rules a row hits."""
    if len(hits) <= RULES_PER_SCAN:
        return F.array_remove(F.array(*[F.when(h, F.lit(i)).otherwise(F.lit(-1)) for i, h in enumerate(hits, first)]), -1)
    return F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hits, first)]))


def compound_rule_metrics(
    df: DataFrame, rules: Sequence[str], target: str, weight: str | None = None
) -> tuple[DataFrame, list[BadRule]]:
    """Metrics of any number of arbitrary rules from one scan."""
    total = totals(df, target, weight)
    w = weight_column(weight)
    sums, index = rule_sums(df, rules, {"hit_w": w, "bad_w": F.when(F.col(target) == 1, w)})
    table = df.sparkSession.createDataFrame(list(enumerate(index.names)), "pos int, rule string")
    out = table.join(sums.withColumnRenamed("n", "hit_n"), "pos", "left").fillna(0, ["hit_n", "hit_w", "bad_w"]).select(
        "pos", "rule", "hit_n", "hit_w", "bad_w", *metric_columns(F.col("hit_w"), F.col("bad_w"), total)
    )
    return out, index.bad


def filter_by_metrics(metrics: DataFrame, max_hit_rate: float = 0.03, min_lift: float = 3.5) -> DataFrame:
    """Strict filter on full-precision metrics."""
    return metrics.where(
        (F.col("bad_rate") > 0) & (F.col("hit_rate") < max_hit_rate) & (F.col("lift") > min_lift)
    )


def filter_by_direction(rules: DataFrame, directions: DataFrame) -> DataFrame:
    """Keep a single-variable rule unless its feature expects the other side."""
    d = directions.select(F.col("var").alias("used_var"), F.col("direction").alias("expected"))
    keep = F.col("expected").isNull() | (F.col("direction") == "==") | (F.col("expected") == "==") | (
        F.col("direction") == F.col("expected")
    )
    return rules.join(d, "used_var", "left").where(keep).drop("expected")


def filter_multi_rules(
    rules: DataFrame, directions: DataFrame, score_vars: Sequence[str] = (), score_direction: str = ">"
) -> DataFrame:
    """Drop rules with a score variable on the wrong side or with an uninformative variable.

    The second filter is skipped when it would hit more than 80% of the rules.
    """
    wrong = "<=" if score_direction == ">" else ">"
    out = rules
    for v in score_vars:
        out = out.where(~F.col("rule").rlike(rf"(?<!\w){re.escape(v)} {wrong}"))
    dead = directions.where(F.col("cutoff") == "(-inf, inf]").select(F.col("var").alias("v"))
    hit = (
        out.select("rule", F.explode(F.split("used_var", " & ")).alias("v"))
        .join(F.broadcast(dead), "v", "left_semi").select("rule").distinct()
    )
    n, n_hit = out.count(), hit.count()
    if n and n_hit / n > 0.8:
        return out
    return out.join(hit, "rule", "left_anti")


def rule_funnel(
    all_rules: DataFrame, directed: DataFrame, metrics: DataFrame, max_hit_rate: float, min_lift: float
) -> DataFrame:
    """Every generated rule with its pass flags and the reason it was dropped."""
    d = directed.select("rule", F.lit(True).alias("direction_valid"))
    m = metrics.select("rule", "recall", "bad_rate", "lift", "hit_rate")
    j = all_rules.select("rule").join(d, "rule", "left").join(m, "rule", "left")
    dv = F.coalesce(F.col("direction_valid"), F.lit(False))
    seen = dv & F.col("hit_rate").isNotNull()
    br, hr, lf = F.col("bad_rate") > 0, F.col("hit_rate") < max_hit_rate, F.col("lift") > min_lift
    reason = (
        F.when(~seen, "direction")
        .when(~br, "zero_bad_rate")
        .when(~hr & ~lf, "hit_rate_and_lift")
        .when(~hr, "hit_rate")
        .when(~lf, "lift")
        .otherwise("")
    )
    return j.select(
        "rule", *[F.when(dv, F.col(c)).alias(c) for c in ("recall", "bad_rate", "lift", "hit_rate")],
        dv.alias("direction_valid"),
        F.when(dv, br).alias("bad_rate_valid"), F.when(dv, hr).alias("hit_rate_valid"), F.when(dv, lf).alias("lift_valid"),
        (seen & br & hr & lf).alias("is_valid"), reason.alias("filter_reason"),
    )


def funnel_counts(funnel: DataFrame) -> DataFrame:
    return funnel.groupBy("filter_reason").agg(F.count(F.lit(1)).alias("n_rules"))


def rule_source_stats(rules: DataFrame, by: str = "feature") -> DataFrame:
    """Rules per variable combination or per feature (exact variable names) with their share."""
    n = rules.count()
    key = F.explode(F.array_distinct(F.split("used_var", " & "))) if by == "feature" else F.col("used_var")
    counts = rules.select(key.alias(by)).groupBy(by).agg(F.count(F.lit(1)).alias("n_rules"))
    return counts.select(by, "n_rules", (F.col("n_rules") * 100.0 / F.lit(n)).alias("pct"))


def leakage(df: DataFrame, features: Sequence[str], target: str, max_groups: int = 10) -> DataFrame:
    """Features with at most ``max_groups`` values, and whether each value is all bad or all good.

    A sketch rules out the many-valued columns first, so only few-valued ones are
    grouped; their counts combine map-side whatever the skew.
    """
    est = df.agg(*[distinct_estimate(F.col(f"`{f}`")).alias(f"d{i}") for i, f in enumerate(features)]).first()
    few = [f for i, f in enumerate(features) if est[f"d{i}"] <= 2 * max_groups]
    if not few:
        return df.sparkSession.createDataFrame([], "feature string, n_groups bigint, n_pure bigint, leaky boolean")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("value")) for f in few])
    long = df.select(F.col(target).cast("long").alias("y"), F.inline(cells)).where("value IS NOT NULL")
    groups = long.groupBy("feature", "value").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    pure = (F.col("bad") == 0) | (F.col("bad") == F.col("n"))
    return (
        groups.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(pure, 1)).alias("n_pure"))
        .where(F.col("n_groups") <= max_groups)
        .withColumn("leaky", F.col("n_pure") == F.col("n_groups"))
    )
