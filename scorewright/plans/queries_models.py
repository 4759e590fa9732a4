"""Queries: correlation, models, scorecard, curves, logs, everyday table work."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.numeric import rnd
from scorewright.operators import adhoc, binning, correlation, curves, logit, logs, scorecard, stability, validation
from scorewright.plans.queries_data import SPLIT, split_loans
from scorewright.plans.queries_rules import WOE5, rounded
from scorewright.plans.registry import CALLS, FEATURES, LOANS, calls, loans, query, table
from scorewright.plans.staging import checkpoint_folder
from scorewright.sources import sinks

# ---------------------------------------------------------------- correlation

PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@query("correlation_pairs", " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in PAIRS))
def correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlation(table(spark, sf, "lineitem"), FEATURES))


def _rank_cte(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(
    "spearman_pairs",
    f"WITH r AS (SELECT {', '.join(f'{_rank_cte(c)} AS {c}' for c in FEATURES)} FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 6) AS corr FROM r" for a, b in PAIRS),
)
def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlation(table(spark, sf, "lineitem"), FEATURES, "spearman"))


@query(
    "kendall_pairs",
    """WITH t AS (SELECT l_quantity AS a, l_discount AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
    s AS (SELECT sum(CASE WHEN sign(x.a - z.a) * sign(x.b - z.b) > 0 THEN x.n * z.n ELSE 0 END) / 2 AS conc,
      sum(CASE WHEN sign(x.a - z.a) * sign(x.b - z.b) < 0 THEN x.n * z.n ELSE 0 END) / 2 AS disc FROM t x, t z),
    k AS (SELECT sum(n) * (sum(n) - 1) / 2 AS p FROM t), ta AS (SELECT sum(n * (n - 1)) / 2 AS t FROM (SELECT sum(n) AS n FROM t GROUP BY a)),
    tb AS (SELECT sum(n * (n - 1)) / 2 AS t FROM (SELECT sum(n) AS n FROM t GROUP BY b))
    SELECT 'l_quantity' AS feature1, 'l_discount' AS feature2, round((conc - disc) / sqrt((p - ta.t) * (p - tb.t)), 8) AS corr FROM s, k, ta, tb""",
)
def kendall_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "kendall"), default=8)


@query(
    "kendall_many_values",
    """WITH t AS (SELECT o_totalprice AS a, o_custkey AS b FROM orders),
    s AS (SELECT sum(sign(x.a - z.a) * sign(x.b - z.b)) AS d, count(*) FILTER (x.a <> z.a) AS pa, count(*) FILTER (x.b <> z.b) AS pb FROM t x, t z)
    SELECT 'o_totalprice' AS feature1, 'o_custkey' AS feature2, round(d / sqrt(pa::DOUBLE * pb), 8) AS corr FROM s""",
)
def kendall_many_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlation(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "kendall"), default=8)


def _corr_features(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    return df.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))


CORR_COLS = ["l_extendedprice", "l_quantity", "revenue", "unit_price"]
CORR_BASE = f"WITH {LOANS}, cf AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice / l_quantity AS unit_price FROM loans), cp AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS c FROM cf" for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]
) + ")"


@query("high_correlation_pairs", f"{CORR_BASE} SELECT feature1, feature2, round(c, 6) AS corr FROM cp WHERE abs(c) > 0.5")
def high_correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.high_pairs(correlation.correlation(_corr_features(spark, sf), CORR_COLS), 0.5))


@query("correlation_filter", f"{CORR_BASE} SELECT DISTINCT feature2 AS dropped FROM cp WHERE abs(c) > 0.5")
def correlation_filter(spark: SparkSession, sf: str) -> DataFrame:
    gone = correlation.correlation_drops(correlation.correlation(_corr_features(spark, sf), CORR_COLS), 0.5)
    return spark.createDataFrame([(g,) for g in gone], "dropped string")


_G = {f"g{i}{j}": f"sum({a} * {b})" for i, a in enumerate(FEATURES[:3]) for j, b in enumerate(FEATURES[:3]) if i <= j}


@query(
    "vif",
    f"""WITH s AS (SELECT {', '.join(f'{e} AS {k}' for k, e in _G.items())} FROM lineitem),
    d AS (SELECT *, g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02) AS det FROM s)
    SELECT 'l_quantity' AS feature, round(g00 * (g11 * g22 - g12 * g12) / det, 6) AS vif FROM d UNION ALL
    SELECT 'l_discount', round(g11 * (g00 * g22 - g02 * g02) / det, 6) FROM d UNION ALL SELECT 'l_tax', round(g22 * (g00 * g11 - g01 * g01) / det, 6) FROM d""",
)
def vif(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.vif(table(spark, sf, "lineitem"), FEATURES[:3]))


VIF_COLS = [*CORR_COLS, "l_tax"]
_K = len(VIF_COLS)

# Every set of columns m (as bits) and column t of it: sweeping the others out of the cross-products leaves t's residual.
VIF_SWEEPS = f"""s AS (SELECT {', '.join(f'sum({a}::DOUBLE * {b}::DOUBLE) AS g{i}_{j}' for i, a in enumerate(VIF_COLS) for j, b in enumerate(VIF_COLS))} FROM cf),
  g AS ({' UNION ALL '.join(f'SELECT {i} AS i, {j} AS j, g{i}_{j} AS v FROM s' for i in range(_K) for j in range(_K))}),
  sw AS (SELECT m, t, 0 AS k, i, j, v FROM (SELECT unnest(range(1, {2**_K})) AS m), (SELECT unnest(range({_K})) AS t), g
      WHERE (m >> t) & 1 = 1 AND (m >> i) & 1 = 1 AND (m >> j) & 1 = 1
    UNION ALL SELECT m, t, k + 1, i, j, CASE WHEN (m >> k) & 1 = 1 AND k <> t THEN v - max(v) FILTER (j = k) OVER (PARTITION BY m, t, i)
      * max(v) FILTER (i = k) OVER (PARTITION BY m, t, j) / max(v) FILTER (i = k AND j = k) OVER (PARTITION BY m, t) ELSE v END FROM sw WHERE k < {_K}),
  vifs AS (SELECT m, t, g.v / sw.v AS vif FROM sw JOIN g ON g.i = t AND g.j = t WHERE k = {_K} AND sw.i = t AND sw.j = t),
  worst AS (SELECT m, max(vif) AS vif, arg_max(t, vif) AS t FROM vifs GROUP BY m),
  names AS (SELECT unnest({VIF_COLS!r}) AS feature, unnest(range({_K})) AS t),
  rounds AS (SELECT 0 AS r, {2**_K - 1}::BIGINT AS m UNION ALL
    SELECT r + 1, m - (1 << t) FROM rounds JOIN worst USING (m) WHERE r < 10 AND bit_count(m) > 1 AND vif > 5)"""


@query(
    "vif_elimination",
    f"""WITH RECURSIVE {CORR_BASE.removeprefix('WITH ')}, {VIF_SWEEPS}
    SELECT feature, 'kept' AS outcome, NULL::DOUBLE AS vif FROM (SELECT arg_max(m, r) AS m FROM rounds), names WHERE (m >> t) & 1 = 1
    UNION ALL SELECT feature, 'round_' || (r + 1), round(vif, 6) FROM rounds JOIN worst USING (m) JOIN names USING (t) WHERE r < 10 AND bit_count(m) > 1 AND vif > 5""",
)
def vif_elimination(spark: SparkSession, sf: str) -> DataFrame:
    kept, log = correlation.vif_elimination(_corr_features(spark, sf), VIF_COLS, 5.0)
    rows = [(f, "kept", None) for f in kept] + [(f, f"round_{r}", v) for r, f, v in log]
    return rounded(spark.createDataFrame(rows, "feature string, outcome string, vif double"))


@query(
    "vif_near_collinear",
    """WITH x AS (SELECT l_quantity::HUGEINT AS a, l_quantity::HUGEINT * 1000000 + round(l_discount * 100)::HUGEINT AS b FROM lineitem),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM x),
    v AS (SELECT round(log10(aa::DOUBLE * bb::DOUBLE / (aa * bb - ab * ab)::DOUBLE), 6) AS log_vif FROM s)
    SELECT 'l_quantity' AS feature, log_vif FROM v UNION ALL SELECT 'nearly_quantity', log_vif FROM v""",
)
def vif_near_collinear(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns that differ by a few parts in 10^7 of their length, compared with whole-number arithmetic."""
    near = F.col("l_quantity").cast("double") * 1000000 + F.round(F.col("l_discount") * 100)
    out = correlation.vif(table(spark, sf, "lineitem").withColumn("nearly_quantity", near), ["l_quantity", "nearly_quantity"])
    return out.select("feature", rnd(F.log10("vif"), 6).alias("log_vif"))


# ---------------------------------------------------------------- models


def woe_frame(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Loans with WOE columns and the bins behind them."""
    df = loans(spark, sf)
    bins = binning.fit_woe(df, "y", FEATURES, 5).cache()
    return binning.woe_columns(df, bins, FEATURES), bins


WOE_COLS = [f"{f}_woe" for f in FEATURES]


@query("logit_statistics")
def logit_statistics(spark: SparkSession, sf: str) -> DataFrame:
    coefs, _ = logit.logit_statistics(woe_frame(spark, sf)[0], WOE_COLS, "y")
    return rounded(coefs, default=4)


@query("logit_fit_quality")
def logit_fit_quality(spark: SparkSession, sf: str) -> DataFrame:
    _, info = logit.logit_statistics(loans(spark, sf), ["l_quantity", "l_discount"], "y", "w", balanced=True)
    rows = [(k, float(v)) for k, v in info.items() if not isinstance(v, bool) and v is not None]
    return rounded(spark.createDataFrame(rows, "statistic string, value double"), default=3)


_SEPARABLE = {
    "l_quantity": "l_quantity::DOUBLE",
    "sure": "CASE WHEN y = 1 THEN 10 + l_tax ELSE l_tax END",
    "touching": "CASE WHEN y = 1 THEN greatest(l_linenumber, 2) ELSE least(l_linenumber, 2) END",
    "touching_below": "CASE WHEN y = 1 THEN least(l_linenumber, 3) ELSE greatest(l_linenumber, 3) END",
    "crossing": "CASE WHEN y = 1 THEN 2 + l_linenumber ELSE l_linenumber END",
}


# One feature separates the classes if the values of one class all lie at or beyond those of the other, and with it any model.
@query(
    "logit_separation",
    f"""WITH {LOANS}, x AS (SELECT y, unnest([{', '.join(repr(f) for f in _SEPARABLE)}]) AS f, unnest([{', '.join(f'({e})::DOUBLE' for e in _SEPARABLE.values())}]) AS v FROM loans),
    s AS (SELECT f, min(v) < max(v) AND (min(v) FILTER (y = 1) >= max(v) FILTER (y = 0) OR max(v) FILTER (y = 1) <= min(v) FILTER (y = 0)) AS sep FROM x GROUP BY f),
    m AS (SELECT f AS model, sep FROM s UNION ALL SELECT 'l_quantity + ' || f, sep FROM s WHERE f <> 'l_quantity')
    SELECT model, NOT sep AS converged, sep AS separated FROM m""",
)
def logit_separation(spark: SparkSession, sf: str) -> DataFrame:
    """Which models have no estimate because a direction orders the classes."""
    df = loans(spark, sf).select("y", *[F.expr(e.replace("::DOUBLE", "")).cast("double").alias(f) for f, e in _SEPARABLE.items()])
    design = logit.design_table(df, list(_SEPARABLE), "y").cache()
    models = [[f] for f in _SEPARABLE] + [["l_quantity", f] for f in _SEPARABLE if f != "l_quantity"]
    fits = logit.fit_many(design, models)
    design.unpersist()
    return logit.fit_report(df, fits).select("model", "converged", "separated")


# A one-feature, two-group logit has a closed form: the log odds of each group.
@query(
    "logit_odds_ratio",
    f"""WITH {LOANS}, t AS (SELECT sum(((l_quantity > 40) AND y = 1)::INT)::DOUBLE AS a, sum(((l_quantity > 40) AND y = 0)::INT)::DOUBLE AS b,
      sum(((l_quantity <= 40) AND y = 1)::INT)::DOUBLE AS c, sum(((l_quantity <= 40) AND y = 0)::INT)::DOUBLE AS d FROM loans),
    r AS (SELECT ln(a * d / (b * c)) AS beta, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM t)
    SELECT 'large' AS feature, round(exp(beta), 3) AS odds_ratio, round(exp(beta - 1.96 * se), 3) AS or_low, round(exp(beta + 1.96 * se), 3) AS or_high FROM r""",
)
def logit_odds_ratio(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf).withColumn("large", (F.col("l_quantity") > 40).cast("int"))
    coefs, _ = logit.logit_statistics(df, ["large"], "y")
    return rounded(logit.odds_ratios(coefs.where("feature <> 'const'")).drop("p_value"), default=3)


@query(
    "class_balance",
    f"""WITH {LOANS}, r AS (SELECT avg(y) AS r FROM loans) SELECT round(r, 6) AS target_rate, round((1 - r) / r, 6) AS goods_per_bad,
    CASE WHEN r >= 0.2 THEN 'none' WHEN r >= 0.1 THEN 'light' WHEN r >= 0.05 THEN 'medium' WHEN r >= 0.01 THEN 'heavy' ELSE 'extreme' END AS severity,
    CASE WHEN r < 0.1 THEN 'class_weight' ELSE 'none' END AS applied_strategy FROM r""",
)
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(logit.imbalance(loans(spark, sf), "y"))


@query(
    "class_weights",
    f"""WITH {LOANS}, c AS (SELECT count(*) AS n, sum(y) AS b FROM loans) SELECT y, count(*) AS n, round(sum(CASE WHEN y = 1 THEN c.n / (2.0 * b) ELSE c.n / (2.0 * (c.n - b)) END * w), 4) AS weight
    FROM loans, c GROUP BY y""",
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    return df.withColumn("cw", logit.balanced_weight(df, "y", "w")).groupBy("y").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("cw"), 4).alias("weight"))


@query("stepwise_selection")
def stepwise_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen, log = logit.stepwise(woe_frame(spark, sf)[0], WOE_COLS, "y", "both", 0.05)
    rows = [(r, a, f, p, f in chosen) for r, a, f, p in log]
    return rounded(spark.createDataFrame(rows, "round int, action string, feature string, p_value double, kept boolean"))


@query("coefficient_signs")
def coefficient_signs(spark: SparkSession, sf: str) -> DataFrame:
    _, signs = logit.coefficient_signs(woe_frame(spark, sf)[0], WOE_COLS, "y", "remove")
    return rounded(signs, default=4)


@query("feature_significance")
def feature_significance(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = logit.significance(woe_frame(spark, sf)[0], WOE_COLS, "y", 0.05)
    return rounded(t.select("feature", "coef", "p_value", "significant"), default=4)


@query("model_cleaning")
def model_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    _, log = logit.clean_model(woe_frame(spark, sf)[0], WOE_COLS, "y", 0.01)
    return rounded(spark.createDataFrame(log, "round int, n_features int, removed string, reason string, value double"))


# ---------------------------------------------------------------- scorecard with fixed coefficients

COEF = {"l_quantity": 0.9, "l_discount": 0.8, "l_tax": 0.5, "l_extendedprice": 0.1}
INTERCEPT = -2.1
_CARD_SQL = f"""{WOE5}, coef AS (SELECT unnest({list(COEF)!r}) AS feature, unnest({list(COEF.values())!r}::DOUBLE[]) AS coef),
  card AS (SELECT feature, bin, c, woe, coef, round(-(20 / ln(2)) * coef * woe, 2) + 0.0::DOUBLE AS points FROM woe JOIN coef USING (feature))"""
_BASE_PTS = f"round(600 + 20 / ln(2) * ln(1 / 20.0) - 20 / ln(2) * ({INTERCEPT}), 2)"


def _card(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, float]:
    bins = binning.fit_woe(loans(spark, sf), "y", FEATURES, 5)
    card, base = scorecard.card_points(bins, COEF, INTERCEPT)
    return bins, card, base


@query("scorecard_points", f"{_CARD_SQL} SELECT feature, bin, round(woe, 6) AS woe, points, {_BASE_PTS} AS base_points FROM card")
def scorecard_points(spark: SparkSession, sf: str) -> DataFrame:
    _, card, base = _card(spark, sf)
    return card.select("feature", "bin", rnd(F.col("woe")).alias("woe"), rnd(F.col("points"), 2).alias("points"), F.lit(base).alias("base_points"))


@query(
    "scorecard_detail",
    f"{_CARD_SQL} SELECT feature, count(*) AS n_bins, min(points) AS min_points, max(points) AS max_points, round(max(points) - min(points), 2) AS spread FROM card GROUP BY feature",
)
def scorecard_detail(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scorecard.card_detail(_card(spark, sf)[1]), default=2)


@query(
    "scorecard_range",
    f"""{_CARD_SQL}, d AS (SELECT min(points) AS a, max(points) AS b FROM card GROUP BY feature)
    SELECT round(sum(a) + {_BASE_PTS}, 2) AS min_score, round(sum(b) + {_BASE_PTS}, 2) AS max_score FROM d""",
)
def scorecard_range(spark: SparkSession, sf: str) -> DataFrame:
    _, card, base = _card(spark, sf)
    return rounded(scorecard.card_range(card, base), default=2)


@query(
    "scorecard_export",
    f"""{_CARD_SQL} SELECT w.feature AS variable, round(sum(w.iv) OVER (PARTITION BY w.feature), 6) AS total_iv, coef AS cof, w.bin AS "index", n AS count,
    round(n / sum(n) OVER (PARTITION BY w.feature), 6) AS count_distr, good::DOUBLE AS good, bad::DOUBLE AS bad, round(bad_rate, 6) AS badprob, round(w.woe, 6) AS woe,
    points AS score FROM woe w JOIN card USING (feature, bin)""",
)
def scorecard_export(spark: SparkSession, sf: str) -> DataFrame:
    bins, card, _ = _card(spark, sf)
    return rounded(scorecard.card_export(bins, card).drop("bin"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    _, card, base = _card(spark, sf)
    return scorecard.apply_card(df, card, base, FEATURES)


def _scored_sql(source: str = "loans", name: str = "scored") -> str:
    parts = " + ".join(f"p{i}.points" for i in range(len(FEATURES)))
    joins = " ".join(
        f"JOIN (SELECT bin, points FROM card WHERE feature = '{f}') p{i} ON p{i}.bin = len(list_filter(c{i}.c, lambda t: t <= l.{f}))" for i, f in enumerate(FEATURES)
    )
    cross = " ".join(f"CROSS JOIN (SELECT c FROM cuts WHERE feature = '{f}') c{i}" for i, f in enumerate(FEATURES))
    return f"{name} AS (SELECT l.*, round({_BASE_PTS} + {parts}, 2) AS score FROM {source} l {cross} {joins})"


@query(
    "apply_scorecard",
    f"{_CARD_SQL}, {_scored_sql()} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM scored",
)
def apply_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd(F.col("score"), 2).alias("score"))


_P = "greatest(least(1 / (1 + exp(-(0.05 * l_quantity + 8 * l_discount - 4.2))), 1 - 1e-10), 1e-10)"
_A = "(600 + 20 / ln(2) * ln(r / (1 - r)))"


def with_probability(df: DataFrame) -> DataFrame:
    return df.withColumn("p", 1 / (1 + F.exp(-(0.05 * F.col("l_quantity") + 8 * F.col("l_discount") - 4.2))))


@query(
    "score_from_probability",
    f"""WITH {LOANS}, r AS (SELECT avg(y) AS r FROM loans), s AS (SELECT l_quantity, l_discount, greatest(least({_A} - 20 / ln(2) * ln({_P} / (1 - {_P})), 850), 300) AS s FROM loans, r)
    SELECT l_quantity, l_discount, round(s, 4) AS score, CASE WHEN s < 550 THEN 'D' WHEN s < 600 THEN 'C' WHEN s < 650 THEN 'B' WHEN s < 700 THEN 'BB' WHEN s < 750 THEN 'BBB'
      WHEN s < 800 THEN 'A' ELSE 'AA' END AS rating, count(*) AS n FROM s GROUP BY ALL""",
)
def score_from_probability(spark: SparkSession, sf: str) -> DataFrame:
    df = with_probability(loans(spark, sf))
    scale = scorecard.Scale.fit(df, "y")
    s = df.select("l_quantity", "l_discount", scale.score(F.col("p")).alias("s"))
    return s.groupBy("l_quantity", "l_discount", rnd(F.col("s"), 4).alias("score"), scorecard.rating(F.col("s")).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "probability_from_score",
    f"""WITH {LOANS}, r AS (SELECT avg(y) AS r FROM loans) SELECT l_quantity AS quantity, round(1 / (1 + exp(-({_A} - (400 + 6 * l_quantity)) / (20 / ln(2)))), 6) AS probability, count(*) AS n
    FROM loans, r GROUP BY ALL""",
)
def probability_from_score(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    scale = scorecard.Scale.fit(df, "y")
    p = scale.probability(400 + 6 * F.col("l_quantity"))
    return df.groupBy(F.col("l_quantity").alias("quantity"), rnd(p).alias("probability")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "score_conversion",
    f"""WITH {LOANS}, r AS (SELECT avg(y) AS r FROM loans) SELECT round(l_discount, 2) AS input, round(greatest(least({_A} - 20 / ln(2) * ln(greatest(round(l_discount, 2), 1e-10) /
    (1 - greatest(round(l_discount, 2), 1e-10))), 850), 300), 4) AS output, count(*) AS n FROM loans, r GROUP BY ALL""",
)
def score_conversion(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf).withColumn("d", F.round("l_discount", 2))
    return scorecard.convert(df, "d", scorecard.Scale.fit(df, "y"), "to_score").groupBy("input", "output").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- curves

_CURVE = """cnt AS (SELECT l_extendedprice AS score, count(*) AS n, sum(y) AS bad, count(*) - sum(y) AS good FROM loans GROUP BY 1),
  run AS (SELECT *, sum(bad) OVER (ORDER BY score) / (SELECT sum(bad) FROM cnt) AS cb, sum(good) OVER (ORDER BY score) / (SELECT sum(good) FROM cnt) AS cg,
    sum(n) OVER (ORDER BY score) / (SELECT sum(n) FROM cnt) AS cp FROM cnt)"""


@query("ks_curve", f"WITH {LOANS}, {_CURVE} SELECT score, n, round(cb, 6) AS cum_bad_pct, round(cg, 6) AS cum_good_pct, round(cp, 6) AS population_pct, round(abs(cb - cg), 6) AS ks FROM run")
def ks_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.ks_curve(loans(spark, sf), "l_extendedprice", "y"))


@query(
    "ks_position",
    f"WITH {LOANS}, {_CURVE} SELECT round(abs(cb - cg), 6) AS ks_max, score AS ks_score, round(cp, 6) AS ks_population_pct FROM run ORDER BY abs(cb - cg) DESC, cp LIMIT 1",
)
def ks_position(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.ks_position(curves.ks_curve(loans(spark, sf), "l_extendedprice", "y")))


@query(
    "roc_points",
    f"""WITH {LOANS}, cnt AS (SELECT l_quantity AS score, sum(y) AS bad, count(*) - sum(y) AS good FROM loans GROUP BY 1)
    SELECT score, round(sum(good) OVER o / (SELECT sum(good) FROM cnt), 6) AS fpr, round(sum(bad) OVER o / (SELECT sum(bad) FROM cnt), 6) AS tpr FROM cnt WINDOW o AS (ORDER BY score DESC)""",
)
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.roc_points(loans(spark, sf), "l_quantity", "y"))


def _auc_sql(source: str, score: str, by: str = "", direction: str = "DESC") -> str:
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""cnt AS (SELECT {key}{score} AS score, count(*) AS n, sum(y) AS bad, count(*) - sum(y) AS good FROM {source} GROUP BY ALL),
    cu AS (SELECT *, sum(bad) OVER ({part} ORDER BY score {direction}) AS cb, sum(good) OVER ({part} ORDER BY score {direction}) AS cg, sum(bad) OVER ({part}) AS tb,
      sum(good) OVER ({part}) AS tg FROM cnt),
    auc AS (SELECT {key}sum(n)::BIGINT AS n, greatest(max(cb / tb - cg / tg), 0) AS ks, sum(good * (cb - bad / 2.0)) / (any_value(tb) * any_value(tg)) AS auc FROM cu {group})"""


@query("ks_auc_gini", f"WITH {LOANS}, {_auc_sql('loans', 'l_extendedprice')} SELECT n, round(ks, 6) AS ks, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini FROM auc")
def ks_auc_gini(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.discrimination(loans(spark, sf), "l_extendedprice", "y"))


_SPLIT_SCORED = _CARD_SQL + f", {SPLIT}, {_scored_sql('split3')}"


def split_scored(spark: SparkSession, sf: str) -> DataFrame:
    _, card, base = _card(spark, sf)
    s = scorecard.apply_card(split_loans(spark, sf), card, base, FEATURES)
    # sums of two-decimal points in a different order must give equal scores
    return s.withColumn("score", F.round("score", 2))


@query(
    "split_evaluation",
    f"{_SPLIT_SCORED}, {_auc_sql('scored', 'score', 'split', 'ASC')} SELECT split, n, round(ks, 6) AS ks, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini FROM auc",
)
def split_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curves.discrimination(split_scored(spark, sf), "score", "y", ["split"], higher_is_bad=False))


@query(
    "overfit_check",
    f"""{_SPLIT_SCORED}, {_auc_sql('scored', 'score', 'split', 'ASC')}, b AS (SELECT ks AS k0, auc AS a0 FROM auc WHERE split = 'train')
    SELECT split, round(k0 - ks, 6) AS ks_gap, round(a0 - auc, 6) AS auc_gap, k0 - ks > 0.05 OR a0 - auc > 0.03 AS overfit FROM auc, b WHERE split <> 'train'""",
)
def overfit_check(spark: SparkSession, sf: str) -> DataFrame:
    d = curves.discrimination(split_scored(spark, sf), "score", "y", ["split"], higher_is_bad=False)
    return rounded(curves.overfit_check(d.cache()))


@query(
    "score_statistics",
    f"""{_SPLIT_SCORED} SELECT split, count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
    round(quantile_cont(score, 0.25), 6) AS q25, round(median(score), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75 FROM scored GROUP BY split""",
)
def score_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scorecard.score_statistics(split_scored(spark, sf), "score", "split", ["train", "test", "oot"]))


_BAND_TAIL = """SELECT bin::INTEGER AS bin, lo, hi, n, round(n * 100 / sum(n) OVER (), 6) AS pct, bad, n - bad AS good, round(CASE WHEN n > 0 THEN bad * 100 / n ELSE 0 END, 6) AS bad_rate,
  round(CASE WHEN n > 0 THEN bad / n / (sum(bad) OVER () / sum(n) OVER ()) ELSE 0 END, 6) AS lift, round(sum(bad) OVER (ORDER BY bin) * 100 / sum(bad) OVER (), 6) AS cum_bad_pct FROM bands"""
_INTS = "ints AS (SELECT round_even(score, 0) AS s, y FROM scored)"
_BANDS10 = f"""{_INTS}, q AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(s, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]), lambda t: round_even(t, 0)))) AS e FROM ints),
  fr AS (SELECT unnest(range(len(e) - 1)) AS bin, e FROM q), hit AS (SELECT len(list_filter(e[2:len(e) - 1], lambda t: t <= s)) AS bin, count(*) AS n, sum(y) AS bad FROM ints, q GROUP BY 1),
  bands AS (SELECT bin, e[bin + 1] AS lo, e[bin + 2] AS hi, coalesce(n, 0) AS n, coalesce(bad, 0)::BIGINT AS bad FROM fr LEFT JOIN hit USING (bin))"""


@query("score_bands", f"{_CARD_SQL}, {_scored_sql()}, {_BANDS10} {_BAND_TAIL}")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("score", F.round("score", 2))
    return rounded(curves.score_bands(s, "score", "y", "equal_frequency", 10))


@query(
    "equal_width_score_bands",
    f"""{_CARD_SQL}, {_scored_sql()}, {_INTS}, sp AS (SELECT min(s) AS a, max(s) AS b FROM ints),
    nw AS (SELECT a, b, (SELECT w FROM (SELECT unnest([5, 10, 20, 25, 50, 100, 200, 250, 500]) AS w) ORDER BY abs(w - (b - a) / 8), w LIMIT 1)::DOUBLE AS w FROM sp),
    st AS (SELECT floor(a / w) * w AS lo0, (ceil(b / w) - floor(a / w))::BIGINT AS k, w FROM nw), fr AS (SELECT unnest(range(k)) AS bin, lo0, w, k FROM st),
    hit AS (SELECT least(floor((s - lo0) / w), k - 1)::BIGINT AS bin, count(*) AS n, sum(y) AS bad FROM ints, st GROUP BY 1),
    bands AS (SELECT bin, lo0 + bin * w AS lo, lo0 + (bin + 1) * w AS hi, coalesce(n, 0) AS n, coalesce(bad, 0)::BIGINT AS bad FROM fr LEFT JOIN hit USING (bin)) {_BAND_TAIL}""",
)
def equal_width_score_bands(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("score", F.round("score", 2))
    return rounded(curves.score_bands(s, "score", "y", "equal_width", 8))


@query(
    "rank_order_check",
    f"""{_CARD_SQL}, {_scored_sql()}, {_BANDS10}, r AS (SELECT bin, bad * 100 / n AS br, lag(bad * 100 / n) OVER (ORDER BY bin) AS pr FROM bands)
    SELECT count(*) FILTER (br > pr) AS n_violations, count(*) FILTER (br > pr) = 0 AS is_monotonic FROM r""",
)
def rank_order_check(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("score", F.round("score", 2))
    v = curves.rank_order_violations(curves.score_bands(s, "score", "y", "equal_frequency", 10))
    return v.agg(F.count(F.lit(1)).alias("n_violations")).withColumn("is_monotonic", F.col("n_violations") == 0)


@query(
    "band_lift",
    f"""{_CARD_SQL}, {_scored_sql()}, {_BANDS10}, r AS (SELECT bin, bad * 100 / n AS br, bad / n / (sum(bad) OVER () / sum(n) OVER ()) AS lift FROM bands)
    SELECT round(arg_min(lift, bin), 6) AS first_lift, round(arg_max(lift, bin), 6) AS last_lift, round(arg_min(br, bin), 6) AS first_bad_rate, round(arg_max(br, bin), 6) AS last_bad_rate FROM r""",
)
def band_lift(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("score", F.round("score", 2))
    return rounded(curves.band_lift(curves.score_bands(s, "score", "y", "equal_frequency", 10)))


def _psi_sql(cols: list[str], source: str) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, split, len(list_filter(list_transform(range(1, 10), lambda i: a + (b - a) * i / 10), lambda t: t <= {c})) AS bin, count(*) AS n
          FROM {source}, (SELECT min({c})::DOUBLE AS a, max({c})::DOUBLE AS b FROM {source} WHERE split = 'train') WHERE split IN ('train', 'oot') GROUP BY ALL""")
    return f"""cell AS ({' UNION ALL '.join(parts)}), pv AS (SELECT feature, bin, coalesce(sum(n) FILTER (split = 'train'), 0) AS e, coalesce(sum(n) FILTER (split = 'oot'), 0) AS a FROM cell GROUP BY ALL),
    sh AS (SELECT feature, e / sum(e) OVER (PARTITION BY feature) + 1e-6 AS e, a / sum(a) OVER (PARTITION BY feature) + 1e-6 AS a FROM pv),
    psi AS (SELECT feature, abs(sum((a - e) * ln(a / e))) AS psi FROM sh GROUP BY feature)"""


_PSI_OUT = "round(psi, 8) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'slight_change' ELSE 'significant_change' END AS stability FROM psi"


@query("score_psi", f"{_SPLIT_SCORED}, {_psi_sql(['score'], 'scored')} SELECT feature, {_PSI_OUT}")
def score_psi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stability.distribution_psi(split_scored(spark, sf), ["score"], "split", "train", "oot"), default=8)


@query("feature_csi", f"WITH {LOANS}, {SPLIT}, {_psi_sql(FEATURES, 'split3')} SELECT feature, {_PSI_OUT}")
def feature_csi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stability.distribution_psi(split_loans(spark, sf), FEATURES, "split", "train", "oot"), default=8)


@query(
    "feature_csi_summary",
    f"""WITH {LOANS}, {SPLIT}, {_psi_sql(FEATURES, 'split3')} SELECT count(*) AS total_features, count(*) FILTER (psi < 0.1) AS stable,
    count(*) FILTER (psi >= 0.1 AND psi < 0.25) AS slight_change, count(*) FILTER (psi >= 0.25) AS significant_change FROM psi""",
)
def feature_csi_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stability.csi_summary(stability.distribution_psi(split_loans(spark, sf), FEATURES, "split", "train", "oot"))


@query(
    "score_distribution_check",
    f"""{_CARD_SQL}, {_scored_sql()}, d AS (SELECT count(DISTINCT score) AS u, min(score) AS a, max(score) AS b, stddev_pop(score) AS s, avg(score) AS m FROM scored)
    SELECT u AS unique_scores, a AS score_min, b AS score_max, round(b - a, 8) AS score_range, round(s, 8) AS score_std, round(m, 8) AS score_mean,
    (['excellent', 'good', 'acceptable', 'warning'])[(u < 20)::INT + (b - a < 50)::INT + (s < 10)::INT + 1] AS status FROM d""",
)
def score_distribution_check(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("score", F.round("score", 2))
    return rounded(validation.score_distribution(s, "score"), default=8)


@query("scorecard_validation")
def scorecard_validation(spark: SparkSession, sf: str) -> DataFrame:
    s = split_scored(spark, sf)
    psi = stability.distribution_psi(s, ["score"], "split", "train", "oot").first()["psi"]
    return rounded(validation.validate_card(s, "score", "y", psi))


# ---------------------------------------------------------------- logs


def priced(spark: SparkSession, sf: str) -> DataFrame:
    c = calls(spark, sf)
    return c.withColumn("estimated_cost", logs.token_cost(F.col("model_name"), F.col("prompt_tokens"), F.col("completion_tokens")))


# gpt-4o-mini matches the shorter key 'gpt-4' first, as the price list is read in order
PRICED = f"""{CALLS}, priced AS (SELECT *, CASE WHEN contains(model_name, 'gpt-4') THEN prompt_tokens / 1000 * 0.03::DOUBLE + completion_tokens / 1000 * 0.06::DOUBLE
  WHEN contains(model_name, 'claude-3-haiku') THEN prompt_tokens / 1000 * 0.00025::DOUBLE + completion_tokens / 1000 * 0.00125::DOUBLE
  ELSE prompt_tokens / 1000 * 0.00014::DOUBLE + completion_tokens / 1000 * 0.00028::DOUBLE END AS estimated_cost FROM calls)"""


@query(
    "token_cost",
    f"WITH {PRICED} SELECT model_name, prompt_tokens, completion_tokens, round(estimated_cost, 9) AS estimated_cost, count(*) AS n FROM priced GROUP BY ALL",
)
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    return priced(spark, sf).groupBy("model_name", "prompt_tokens", "completion_tokens", rnd(F.col("estimated_cost"), 9).alias("estimated_cost")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "call_log_stats",
    f"""WITH {PRICED} SELECT count(*) AS total_calls, count(*) FILTER (status = 'success') AS success_calls, count(*) FILTER (status = 'error') AS error_calls,
    sum(total_tokens)::BIGINT AS total_tokens, round(sum(estimated_cost), 4) AS total_cost FROM priced WHERE NOT is_test_data""",
)
def call_log_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(logs.call_log_stats(priced(spark, sf), exclude_test=True), default=4)


@query("model_usage", f"WITH {PRICED} SELECT model_name, count(*) AS calls, sum(total_tokens)::BIGINT AS tokens, round(sum(estimated_cost), 4) AS cost FROM priced GROUP BY model_name")
def model_usage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(logs.model_stats(priced(spark, sf)), default=4)


@query(
    "token_cost_summary",
    f"""WITH {PRICED} SELECT count(*) AS total_calls, round(count(*) FILTER (status = 'success') * 100 / count(*), 6) AS success_rate, sum(total_tokens)::BIGINT AS total_tokens,
    round(sum(estimated_cost), 4) AS total_cost, round(avg(response_time), 8) AS avg_response_time FROM priced""",
)
def token_cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(logs.cost_summary(priced(spark, sf)), {"total_cost": 4, "avg_response_time": 8})


@query(
    "log_data_summary",
    f"""WITH {CALLS} SELECT count(*) FILTER (is_test_data) AS test_rows, count(*) FILTER (NOT is_test_data) AS real_rows, count(*) AS all_rows,
    count(*) FILTER (is_test_data) > 0 AS has_test, count(*) FILTER (NOT is_test_data) > 0 AS has_real FROM calls""",
)
def log_data_summary(spark: SparkSession, sf: str) -> DataFrame:
    return logs.log_data_summary(calls(spark, sf))


@query(
    "log_page",
    f"""WITH {CALLS} SELECT event_id, status, model_name FROM calls WHERE status = 'error' AND NOT is_test_data ORDER BY "timestamp" DESC, event_id LIMIT 20 OFFSET 10""",
)
def log_page(spark: SparkSession, sf: str) -> DataFrame:
    page = logs.list_logs(calls(spark, sf), {"status": "error", "is_test_data": False}, tie=["event_id"], offset=10, limit=20)
    return page.select("event_id", "status", "model_name")


@query(
    "log_retention",
    f"""WITH {CALLS} SELECT status, count(*) AS n FROM calls WHERE "timestamp" >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY AND NOT is_test_data GROUP BY status""",
)
def log_retention(spark: SparkSession, sf: str) -> DataFrame:
    kept = logs.retain(calls(spark, sf), "timestamp", "2024-01-20 00:00:00", 10, drop_test=True)
    return kept.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "log_row_deletion",
    f"""WITH {CALLS} SELECT strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM calls
    WHERE "timestamp" >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY AND NOT is_test_data
      AND NOT (strftime("timestamp", '%Y-%m-%d') = '2024-01-12' AND coalesce(status = 'success' OR status = 'error', FALSE)) GROUP BY ALL""",
)
def log_row_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """A log written by day, expired and test rows and one whole day deleted in place, and what is then read back."""
    path = f"{checkpoint_folder(spark)}/log-{uuid4().hex}"
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    sinks.write_partitioned(calls(spark, sf).select("*", day), path, ["day"])
    sinks.delete_rows(spark, path, logs.expired("timestamp", "2024-01-20 00:00:00", 10, drop_test=True))
    sinks.delete_rows(spark, path, F.col("day") == "2024-01-12")
    left = spark.read.parquet(path)
    return left.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("tokens"))


_TASK_STATUS = ["completed", "failed", "stopped", "running", "paused", "completed", "completed"]


@query(
    "task_statistics",
    f"""WITH t AS (SELECT o_orderdate AS created_at, ({_TASK_STATUS!r})[o_custkey % 7 + 1] AS status, (o_custkey % 5)::DOUBLE AS duration_seconds FROM orders)
    SELECT count(*) AS total, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('completed', 'failed', 'stopped', 'running', 'paused'))},
    round(coalesce(avg(duration_seconds) FILTER (duration_seconds <> 0), 0), 6) AS avg_duration, round(count(*) FILTER (status = 'completed') / count(*), 6) AS success_rate
    FROM t WHERE created_at >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 365 DAY""",
)
def task_statistics(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("created_at"), F.element_at(F.array(*[F.lit(s) for s in _TASK_STATUS]), (F.col("o_custkey") % 7 + 1).cast("int")).alias("status"),
        (F.col("o_custkey") % 5).cast("double").alias("duration_seconds"),
    )
    return rounded(logs.task_statistics(t, "2000-01-01 00:00:00", 365))


_STREAK = """seq AS (SELECT *, sum(ok::INT) OVER (PARTITION BY channel ORDER BY ts, event_id) AS g, count(*) OVER (PARTITION BY channel) AS cn,
    sum(ok::INT) OVER (PARTITION BY channel) AS all_ok FROM calls),
  runs AS (SELECT channel, g, count(*) FILTER (NOT ok) AS len FROM seq GROUP BY channel, g)"""


@query(
    "channel_health_batch",
    f"""WITH {CALLS}, {_STREAK}, k AS (SELECT *, all_ok - g AS after FROM seq WHERE ok),
    e AS (SELECT channel, sum(CASE WHEN g = 1 THEN 1.0 ELSE 0.2 END::DOUBLE * pow(0.8::DOUBLE, after) * response_time) AS avg FROM k GROUP BY channel)
    SELECT c.channel, count(*) AS total, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, round(any_value(e.avg), 6) AS avg_response_time,
    round(count(*) FILTER (NOT ok) / count(*), 6) AS error_rate, any_value((SELECT len FROM runs r WHERE r.channel = c.channel ORDER BY g DESC LIMIT 1)) AS consecutive_failures,
    any_value((SELECT max(len) < 3 FROM runs r WHERE r.channel = c.channel)) AS is_healthy FROM calls c JOIN e ON e.channel = c.channel GROUP BY c.channel""",
)
def channel_health_batch(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(logs.channel_health(calls(spark, sf)))


# ---------------------------------------------------------------- everyday table work


@query("customer_orders_joined", "SELECT c_custkey, c_mktsegment, n_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def customer_orders_joined(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
    j = adhoc.join_entities(adhoc.join_entities(c, [n], "nationkey"), [o], "c_custkey")
    return j.select("c_custkey", "c_mktsegment", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query(
    "crosstab",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
)
def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return adhoc.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("multi_group_keys", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def multi_group_keys(spark: SparkSession, sf: str) -> DataFrame:
    return adhoc.keys_with_many(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@query("value_frequency", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return adhoc.value_frequency(table(spark, sf, "documents"), "lang")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return adhoc.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _chi_sql(a: str, b: str, source: str) -> str:
    return f"""WITH {LOANS}, c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2), r AS (SELECT a, sum(n) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(n) AS cb FROM c GROUP BY b),
    g AS (SELECT coalesce(n, 0) AS n, ra * cb / (SELECT sum(n) FROM c) AS e FROM r CROSS JOIN k LEFT JOIN c USING (a, b)), s AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nc)
    SELECT round(sum(pow(CASE WHEN nr = 2 AND nc = 2 THEN abs(n - e) - least(abs(n - e), 0.5) ELSE abs(n - e) END, 2) / e), 6) AS chi2, any_value((nr - 1) * (nc - 1)) AS dof,
    sum(n)::BIGINT AS n FROM g, s"""


@query("chi_square", _chi_sql("l_returnflag", "l_linenumber", "loans"))
def chi_square(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(adhoc.chi_square(loans(spark, sf), "l_returnflag", "l_linenumber"))


@query("chi_square_corrected", _chi_sql("l_linestatus", "y", "loans"))
def chi_square_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(adhoc.chi_square(loans(spark, sf), "l_linestatus", "y"))


@query(
    "group_rates",
    f"""WITH {LOANS} SELECT l_linestatus, l_linenumber, (grouping_id(l_linestatus, l_linenumber))::INTEGER AS level, count(*) AS n, round(avg(y), 6) AS rate
    FROM loans GROUP BY ROLLUP (l_linestatus, l_linenumber)""",
)
def group_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(adhoc.group_rates(loans(spark, sf), ["l_linestatus", "l_linenumber"], "y"))


@query(
    "winsorized",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM lineitem)
    SELECT l_linenumber, count(*) AS n, round(sum(greatest(least(l_extendedprice, b), a)), 2) AS total, count(*) FILTER (l_extendedprice < a OR l_extendedprice > b) AS n_pulled FROM lineitem, q GROUP BY 1""",
)
def winsorized(spark: SparkSession, sf: str) -> DataFrame:
    w = adhoc.winsorize(table(spark, sf, "lineitem"), "l_extendedprice", 0.05, 0.95)
    return w.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("l_extendedprice_w"), 2).alias("total"),
        F.count(F.when(F.col("l_extendedprice_w") != F.col("l_extendedprice"), 1)).alias("n_pulled"),
    )


@query(
    "co_membership",
    """WITH m AS (SELECT DISTINCT o_custkey AS e, o_orderpriority AS g FROM orders) SELECT a.g AS g1, b.g AS g2, count(*) AS n FROM m a JOIN m b ON a.e = b.e AND a.g <= b.g GROUP BY 1, 2""",
)
def co_membership(spark: SparkSession, sf: str) -> DataFrame:
    return adhoc.co_membership(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


_MIXED = "CASE WHEN l_discount = 0 THEN 'q' || l_quantity::INT ELSE 'o' || l_orderkey END"


@query(
    "co_membership_heavy",
    f"""WITH m AS (SELECT DISTINCT {_MIXED} AS e, l_suppkey AS g FROM lineitem)
    SELECT a.g AS g1, b.g AS g2, count(*) AS n FROM m a JOIN m b ON a.e = b.e AND a.g <= b.g GROUP BY ALL""",
)
def co_membership_heavy(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that share entities, some of which (the quantities) deal with nearly all suppliers."""
    many = F.concat(F.lit("q"), F.col("l_quantity").cast("int"))
    entity = F.when(F.col("l_discount") == 0, many).otherwise(F.concat(F.lit("o"), F.col("l_orderkey")))
    return adhoc.co_membership(table(spark, sf, "lineitem").select(entity.alias("e"), "l_suppkey"), "e", "l_suppkey")
