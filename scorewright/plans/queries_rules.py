"""Queries: binning and IV, rules and their metrics, rule-set analysis, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.numeric import rnd
from scorewright.operators import binning, clean, evaluate, rules, ruleset, stability, supervised, trees, validation
from scorewright.operators.split import time_halves
from scorewright.plans.queries_data import SPLIT, split_loans
from scorewright.plans.registry import FEATURES, KEYS, LOANS, loans, query, sql_long, sql_quantile_bins, sql_woe, table

LONG = sql_long()
QCUT5 = sql_quantile_bins(5)
HIST = "hist AS (SELECT feature, bin, any_value(c) AS c, count(*) AS n, sum(y) AS bad FROM binned GROUP BY feature, bin)"
WOE = sql_woe()
WOE5 = f"WITH {LOANS}, {LONG}, {QCUT5}, {HIST}, {WOE}"


def rounded(df: DataFrame, digits: dict[str, int] | None = None, default: int = 6) -> DataFrame:
    """All double columns rounded for comparison."""
    digits = digits or {}
    return df.select(*[
        rnd(F.col(f"`{c}`"), digits.get(c, default)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def woe_bins_df(spark: SparkSession, sf: str, n_bins: int = 5) -> DataFrame:
    return binning.fit_woe(loans(spark, sf), "y", FEATURES, n_bins)


# ---------------------------------------------------------------- binning, WOE, IV


@query(
    "woe_bins",
    f"""{WOE5} SELECT feature, bin, round(c[bin], 6) AS lo, round(c[bin + 1], 6) AS hi, n, good::DOUBLE AS good, bad::DOUBLE AS bad,
    round(bad_rate, 6) AS bad_rate, round(pb, 6) AS pct_bad, round(pg, 6) AS pct_good, round(woe, 6) AS woe, round(iv, 6) AS iv FROM woe""",
)
def woe_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(woe_bins_df(spark, sf))


IV_LABEL = """CASE WHEN iv < 0.02 THEN 'none' WHEN iv < 0.1 THEN 'weak' WHEN iv < 0.3 THEN 'medium' WHEN iv < 0.5 THEN 'strong' ELSE 'very_strong' END"""
IV = f"ivs AS (SELECT feature, sum(iv) AS iv, count(*) AS n_bins FROM woe GROUP BY feature)"


@query("iv_table", f"{WOE5}, {IV} SELECT feature, round(iv, 6) AS iv, n_bins, {IV_LABEL} AS strength, iv < 0.02 AS low_iv FROM ivs")
def iv_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(binning.iv_table(woe_bins_df(spark, sf)))


@query(
    "iv_summary",
    f"""{WOE5}, {IV} SELECT count(*) AS n_features, round(avg(iv), 6) AS avg_iv, round(max(iv), 6) AS max_iv, round(min(iv), 6) AS min_iv,
    count(*) FILTER (iv >= 0.3) AS strong, count(*) FILTER (iv >= 0.1 AND iv < 0.3) AS medium, count(*) FILTER (iv >= 0.02 AND iv < 0.1) AS weak FROM ivs""",
)
def iv_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(binning.iv_summary(binning.iv_table(woe_bins_df(spark, sf))))


@query(
    "iv_distribution",
    f"""{WOE5}, {IV} SELECT count(*) FILTER (iv >= 0.1) AS ge_010, count(*) FILTER (iv >= 0.05 AND iv < 0.1) AS ge_005,
    count(*) FILTER (iv >= 0.02 AND iv < 0.05) AS ge_002, count(*) FILTER (iv < 0.02) AS lt_002 FROM ivs""",
)
def iv_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return binning.iv_distribution(binning.iv_table(woe_bins_df(spark, sf)))


@query("iv_selection", f"{WOE5}, {IV} SELECT feature, round(iv, 6) AS iv, iv >= 0.02 AND iv <= 0.5 AS selected FROM ivs")
def iv_selection(spark: SparkSession, sf: str) -> DataFrame:
    iv = binning.iv_table(woe_bins_df(spark, sf)).select("feature", "iv")
    return rounded(binning.select_by_iv(iv, 0.02, 0.5))


@query(
    "uniform_woe_bins",
    f"""WITH {LOANS}, {LONG}, ends AS (SELECT feature, min(v) AS a, max(v) AS b FROM long GROUP BY feature),
    cuts AS (SELECT feature, [a + (b - a) * 1 / 4, a + (b - a) * 2 / 4, a + (b - a) * 3 / 4] AS c FROM ends),
    binned AS (SELECT long.*, c, len(list_filter(c, lambda t: t <= v))::INTEGER AS bin FROM long JOIN cuts USING (feature)), {HIST}, {WOE}
    SELECT feature, bin, n, bad::DOUBLE AS bad, round(woe, 6) AS woe, round(iv, 6) AS iv FROM woe""",
)
def uniform_woe_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(binning.fit_woe(loans(spark, sf), "y", FEATURES, 4, "uniform").select("feature", "bin", "n", "bad", "woe", "iv"))


MANUAL = {"l_quantity": [10.0, 25.0, 40.0], "l_discount": [0.03, 0.07]}


@query(
    "manual_woe_bins",
    f"""WITH {LOANS}, {sql_long(list(MANUAL))}, binned AS (SELECT *, c, len(list_filter(c, lambda t: t <= v))::INTEGER AS bin
    FROM (SELECT *, CASE feature WHEN 'l_quantity' THEN [10.0, 25.0, 40.0]::DOUBLE[] ELSE [0.03, 0.07]::DOUBLE[] END AS c FROM long)), {HIST}, {WOE}
    SELECT feature, bin, c[bin] AS lo, c[bin + 1] AS hi, n, bad::DOUBLE AS bad, round(woe, 6) AS woe, round(iv, 6) AS iv FROM woe""",
)
def manual_woe_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(binning.woe_table(loans(spark, sf), "y", MANUAL).select("feature", "bin", "lo", "hi", "n", "bad", "woe", "iv"))


@query(
    "woe_monotonicity",
    f"""{WOE5}, st AS (SELECT feature, bin, woe - lag(woe) OVER win AS s, lead(woe) OVER win - woe AS t FROM woe WINDOW win AS (PARTITION BY feature ORDER BY bin)),
    g AS (SELECT feature, count(*) AS n_bins, coalesce(min(s), 0) AS lo, coalesce(max(s), 0) AS hi, count(*) FILTER (s * t < 0) AS turns FROM st GROUP BY feature)
    SELECT feature, n_bins, CASE WHEN n_bins < 2 THEN 'n/a' WHEN lo >= 0 THEN 'increasing' WHEN hi <= 0 THEN 'decreasing' ELSE 'non_monotonic' END AS direction,
    n_bins < 2 OR lo >= 0 OR hi <= 0 AS is_monotonic, CASE WHEN lo >= 0 OR hi <= 0 THEN 0 ELSE turns END AS violations FROM g""",
)
def woe_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    return binning.monotonicity(woe_bins_df(spark, sf))


@query(
    "woe_transform",
    f"""{WOE5}, mapped AS (SELECT b.k1, b.k2, b.k3, b.k4, b.feature, w.woe FROM (
      SELECT s.*, len(list_filter(c, lambda t: t <= v))::INTEGER AS bin FROM (
        {' UNION ALL '.join(f"SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_shipdate AS k5, '{f}' AS feature, {f} AS v FROM loans" for f in FEATURES)}
      ) s JOIN cuts USING (feature)) b JOIN woe w ON b.feature = w.feature AND b.bin = w.bin)
    SELECT k1 AS l_orderkey, k2 AS l_linenumber, feature, round(sum(woe), 6) AS woe, count(*) AS n FROM mapped GROUP BY k1, k2, feature""",
)
def woe_transform(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    out = binning.woe_columns(df, binning.fit_woe(df, "y", FEATURES, 5), FEATURES)
    long = out.select("l_orderkey", "l_linenumber", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_woe").alias("woe")) for f in FEATURES])))
    return long.groupBy("l_orderkey", "l_linenumber", "feature").agg(rnd(F.sum("woe")).alias("woe"), F.count(F.lit(1)).alias("n"))


@query(
    "weighted_iv",
    f"""WITH {LOANS}, {LONG}, small AS (SELECT feature FROM long GROUP BY feature HAVING count(DISTINCT v) <= 10),
    wide AS (SELECT * FROM long WHERE feature NOT IN (SELECT feature FROM small)), {sql_quantile_bins(10, 'right', 'wide')},
    cells AS (SELECT feature, bin::DOUBLE AS bin, sum(w) AS t, sum(y * w) AS b FROM binned GROUP BY ALL UNION ALL
      SELECT feature, v, sum(w), sum(y * w) FROM long WHERE feature IN (SELECT feature FROM small) GROUP BY ALL),
    p AS (SELECT feature, b / sum(b) OVER (PARTITION BY feature) AS pb, (t - b) / sum(t - b) OVER (PARTITION BY feature) AS pg FROM cells),
    f AS (SELECT feature, CASE WHEN pb = 0 THEN 1e-4 ELSE pb END AS pb, CASE WHEN pg = 0 THEN 1e-4 ELSE pg END AS pg FROM p),
    v AS (SELECT feature, sum((pb - pg) * ln(pb / pg)) AS iv FROM f GROUP BY feature)
    SELECT feature, round(iv, 6) AS iv, CASE WHEN iv < 0.02 THEN 'Weak' WHEN iv < 0.1 THEN 'Medium' WHEN iv < 0.3 THEN 'Strong' ELSE 'Very Strong' END AS power FROM v""",
)
def weighted_iv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(binning.weighted_iv(loans(spark, sf), "y", "w", FEATURES, 10))


@query(
    "bin_statistics",
    f"""WITH {LOANS}, {sql_long(['l_extendedprice'])}, {sql_quantile_bins(5)}, ends AS (SELECT min(v) AS a, max(v) AS b, count(*) AS t FROM long)
    SELECT feature, bin, round(CASE WHEN bin = 0 THEN a ELSE c[bin] END, 8) AS lo, round(CASE WHEN bin = len(c) THEN b ELSE c[bin + 1] END, 8) AS hi,
    count(*) AS n, round(count(*) * 100 / t, 8) AS pct, min(v) AS min, max(v) AS max, round(avg(v), 8) AS mean, round(median(v), 8) AS median,
    round(stddev_samp(v), 8) AS std FROM binned, ends GROUP BY feature, bin, c, a, b, t""",
)
def bin_statistics(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    edges = binning.quantile_edges(df, ["l_extendedprice"], 5)["l_extendedprice"]
    return rounded(binning.bin_statistics(df, "l_extendedprice", edges), default=8)


@query(
    "custom_bins",
    f"""WITH {LOANS}, b AS (SELECT l_quantity AS v, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 30 THEN 1 ELSE 2 END AS bin
      FROM loans WHERE l_quantity BETWEEN 5 AND 45), t AS (SELECT count(l_quantity) AS t FROM loans)
    SELECT 'l_quantity' AS feature, bin, ([5.0, 10.0, 30.0]::DOUBLE[])[bin + 1] AS lo, ([10.0, 30.0, 45.0]::DOUBLE[])[bin + 1] AS hi, count(*) AS n,
    round(count(*) * 100 / t, 8) AS pct, min(v) AS min, max(v) AS max, round(avg(v), 8) AS mean, round(median(v), 8) AS median,
    round(stddev_samp(v), 8) AS std FROM b, t GROUP BY bin, t""",
)
def custom_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(binning.bin_statistics(loans(spark, sf), "l_quantity", [5, 10, 30, 45], "right"), default=8)


@query("kmeans_bins")
def kmeans_bins(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    return rounded(binning.woe_table(df, "y", {"l_extendedprice": binning.kmeans_cuts(df, "l_extendedprice", 4)}))


@query("chi_merge_bins")
def chi_merge_bins(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    return rounded(binning.woe_table(df, "y", supervised.chi_merge_cuts(df, FEATURES, "y", 5)))


@query("tree_bins")
def tree_bins(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    return rounded(binning.woe_table(df, "y", supervised.tree_cuts(df, FEATURES, "y", 5)))


_PROBS9 = "[" + ", ".join(repr(i / 10) for i in range(1, 10)) + "]::DOUBLE[]"
THRESHOLDS = f"""th AS (SELECT DISTINCT feature, round(unnest(q), 4) AS t FROM (SELECT feature, quantile_cont(v, {_PROBS9}) AS q FROM long GROUP BY feature))"""


@query("rule_thresholds", f"WITH {LOANS}, {LONG}, {THRESHOLDS} SELECT feature, t AS threshold FROM th")
def rule_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    cuts = binning.thresholds(loans(spark, sf), FEATURES, 10)
    return spark.createDataFrame([(f, t) for f, ts in cuts.items() for t in ts], "feature string, threshold double")


# ---------------------------------------------------------------- single rules


def metric_sql(hit: str = "hit_w", bad: str = "bad_w") -> str:
    return f"""CASE WHEN {hit} >= 1 THEN round({bad} / tb, 6) ELSE 0 END AS recall, CASE WHEN {hit} >= 1 THEN round({bad} / {hit}, 6) ELSE 0 END AS bad_rate,
    CASE WHEN {hit} >= 1 THEN round({bad} / {hit} / (tb / tw), 6) ELSE 0 END AS lift, round({hit} / tw, 6) AS hit_rate"""


TOTAL = "tot AS (SELECT sum(w) AS tw, sum(y * w) AS tb, count(*) AS tn FROM loans)"


def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    return evaluate.threshold_rule_metrics(df, binning.thresholds(df, FEATURES, 10), "y", "w")


TH_METRICS = f"""WITH {LOANS}, {LONG}, {THRESHOLDS}, {TOTAL}, sides AS (
    SELECT th.feature AS used_var, t AS threshold, '<=' AS direction, count(*) AS hit_n, sum(w) AS hit_w, sum(y * w) AS bad_w
      FROM th JOIN long ON long.feature = th.feature AND v <= t GROUP BY ALL UNION ALL
    SELECT th.feature, t, '>', count(*), sum(w), sum(y * w) FROM th JOIN long ON long.feature = th.feature AND v > t GROUP BY ALL),
  grid AS (SELECT feature AS used_var, t AS threshold, d AS direction FROM th, (SELECT unnest(['<=', '>']) AS d)),
  m AS (SELECT used_var, threshold, direction, coalesce(hit_n, 0) AS hit_n, coalesce(hit_w, 0) AS hit_w, coalesce(bad_w, 0) AS bad_w, tw, tb
    FROM grid LEFT JOIN sides USING (used_var, threshold, direction), tot)"""


@query(
    "threshold_rule_metrics",
    f"{TH_METRICS} SELECT used_var, threshold, direction, hit_n, round(hit_w, 4) AS hit_w, round(bad_w, 4) AS bad_w, {metric_sql()} FROM m",
)
def threshold_rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(threshold_metrics(spark, sf).drop("rule"), {"hit_w": 4, "bad_w": 4})


@query(
    "rule_metric_filter",
    f"SELECT * FROM ({TH_METRICS} SELECT used_var, threshold, direction, {metric_sql()} FROM m) WHERE bad_rate > 0 AND hit_rate < 0.35 AND lift > 1.3",
)
def rule_metric_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.filter_by_metrics(threshold_metrics(spark, sf), 0.35, 1.3)
    return rounded(m.select("used_var", "threshold", "direction", "recall", "bad_rate", "lift", "hit_rate"))


@query(
    "single_variable_rules",
    f"""WITH {LOANS}, {LONG}, {THRESHOLDS} SELECT feature AS used_var, t AS threshold, d AS direction FROM th, (SELECT unnest(['<=', '>']) AS d)""",
)
def single_variable_rules(spark: SparkSession, sf: str) -> DataFrame:
    cuts = binning.thresholds(loans(spark, sf), FEATURES, 10)
    return rules.threshold_rules(spark, cuts).select("used_var", "threshold", "direction")


@query(
    "categorical_rules",
    """SELECT DISTINCT 'l_returnflag' AS used_var, '(l_returnflag == ''' || l_returnflag || ''')' AS rule, l_returnflag AS value, '==' AS direction FROM lineitem
    UNION ALL SELECT DISTINCT 'l_linenumber', '(l_linenumber == ' || l_linenumber || ')', l_linenumber::VARCHAR, '==' FROM lineitem""",
)
def categorical_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.categorical_rules(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"])


# A fixed rule list shared by the rule-set queries, with its SQL spelling.
RULES = [
    ("(l_quantity > 48) & (l_discount >= 0.08)", "l_quantity > 48 AND l_discount >= 0.08"),
    ("(l_quantity > 40) & (l_discount >= 0.09)", "l_quantity > 40 AND l_discount >= 0.09"),
    ("(l_quantity > 44) & (l_discount >= 0.06)", "l_quantity > 44 AND l_discount >= 0.06"),
    ("(l_extendedprice > 80000) & (l_quantity > 35) & (l_discount >= 0.07)", "l_extendedprice > 80000 AND l_quantity > 35 AND l_discount >= 0.07"),
    ("(l_quantity > 46)", "l_quantity > 46"),
    ("(l_linenumber.isin([1, 7])) & (l_quantity > 42)", "l_linenumber IN (1, 7) AND l_quantity > 42"),
    ("~(l_quantity <= 43) & (l_linestatus == 'F')", "NOT (l_quantity <= 43) AND l_linestatus = 'F'"),
    ("((l_tax >= 0.07) | (l_tax <= 0.01)) & (l_discount != 0.05) & (l_quantity > 41)", "(l_tax >= 0.07 OR l_tax <= 0.01) AND l_discount <> 0.05 AND l_quantity > 41"),
]
TEXTS = [r for r, _ in RULES]
PRIOR = ["(l_quantity > 47)", "(l_discount >= 0.1)"]
PRIOR_SQL = "(l_quantity > 47 OR l_discount >= 0.1)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FLAGS = "flags AS (SELECT *, " + ", ".join(f"({s}) AS h{i}" for i, (_, s) in enumerate(RULES)) + " FROM loans)"
HITS = "hits AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, {_lit(r)} AS rule, h{i} AS hit, * FROM flags" for i, (r, _) in enumerate(RULES)) + ")"
BASE = f"WITH {LOANS}, {TOTAL}, {FLAGS}, {HITS}"
RULE_SUMS = """sums AS (SELECT pos, rule, count(*) FILTER (hit) AS hit_n, coalesce(sum(w) FILTER (hit), 0) AS hit_w,
  coalesce(sum(w) FILTER (hit AND y = 1), 0) AS bad_w FROM hits GROUP BY pos, rule)"""


@query("compound_rule_metrics", f"{BASE}, {RULE_SUMS} SELECT rule, hit_n, round(hit_w, 4) AS hit_w, round(bad_w, 4) AS bad_w, {metric_sql()} FROM sums, tot")
def compound_rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = evaluate.compound_rule_metrics(loans(spark, sf), TEXTS, "y", "w")
    return rounded(m.drop("pos"), {"hit_w": 4, "bad_w": 4})


MANY = [f"(l_quantity > {q}) & (l_discount <= {d / 100})" for q in range(50) for d in range(10)]


@query(
    "many_rule_metrics",
    f"""WITH {LOANS}, {TOTAL}, rules AS (SELECT '(l_quantity > ' || q || ') & (l_discount <= ' || (d / 100.0)::DECIMAL(4, 2)::DOUBLE || ')' AS rule, q, d
      FROM range(50) AS a(q), range(10) AS b(d)),
    sums AS (SELECT rule, count(l_quantity) AS hit_n, coalesce(sum(w), 0) AS hit_w, coalesce(sum(w) FILTER (y = 1), 0) AS bad_w
      FROM rules LEFT JOIN loans ON l_quantity > q AND l_discount <= (d / 100.0)::DECIMAL(4, 2) GROUP BY rule)
    SELECT rule, hit_n, round(hit_w, 4) AS hit_w, round(bad_w, 4) AS bad_w, {metric_sql()} FROM sums, tot""",
)
def many_rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Five hundred rules in one scan."""
    m, _ = evaluate.compound_rule_metrics(loans(spark, sf), MANY, "y", "w")
    return rounded(m.drop("pos"), {"hit_w": 4, "bad_w": 4})


MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]
_MODE = f"{MODES}[l_orderkey % 7 + 1]"


@query(
    "one_hot_rule_metrics",
    f"""WITH {LOANS}, {TOTAL}, sums AS (SELECT m AS mode, count(*) AS hit_n, sum(w) AS hit_w, coalesce(sum(w) FILTER (y = 1), 0) AS bad_w
      FROM loans JOIN (SELECT unnest(['{"', '".join(MODES)}']) AS m) ON {_MODE} = m AND l_quantity > 20 GROUP BY m)
    SELECT '(mode_is_' || mode || ' > 0.5) & (l_quantity > 20)' AS rule, hit_n, round(hit_w, 4) AS hit_w, round(bad_w, 4) AS bad_w, {metric_sql()} FROM sums, tot""",
)
def one_hot_rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on one-hot columns whose names hold what their values hold, spaces included."""
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (F.col("l_orderkey") % 7 + 1).cast("int"))
    out, _ = clean.one_hot(loans(spark, sf).withColumn("mode", mode), ["mode"])
    m, _ = evaluate.compound_rule_metrics(out, [f"(mode_is_{x} > 0.5) & (l_quantity > 20)" for x in MODES], "y", "w")
    return rounded(m.drop("pos"), {"hit_w": 4, "bad_w": 4})


CUBE_CUTS = {"l_quantity": [10.0, 20.0, 35.0, 45.0], "l_discount": [0.02, 0.05], "l_tax": [0.01, 0.03, 0.06]}
_BIN = {f: " + ".join(f"({f} > {c})::INT" for c in cs) for f, cs in CUBE_CUTS.items()}
_PAIRS = [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax")]


@query(
    "combination_cells",
    f"WITH {LOANS} " + " UNION ALL ".join(
        f"""SELECT '{a} & {b}' AS used_var, ({_BIN[a]})::INT AS first_bin, ({_BIN[b]})::INT AS second_bin, count(*) AS n, round(sum(w), 4) AS w,
        round(coalesce(sum(w) FILTER (y = 1), 0), 4) AS bad_w FROM loans GROUP BY ALL""" for a, b in _PAIRS
    ),
)
def combination_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cubes that trees on variable combinations are grown from."""
    cubes = trees.combination_cubes(loans(spark, sf), CUBE_CUTS, trees.combos(list(CUBE_CUTS), 2), "y", "w")
    base = trees.radix(CUBE_CUTS)
    name = F.element_at(F.array(*[F.lit(f"{a} & {b}") for a, b in _PAIRS]), F.col("combo") + 1)
    out = cubes.select(name.alias("used_var"), (F.col("cell") % base).cast("int").alias("first_bin"), F.floor(F.col("cell") / base).cast("int").alias("second_bin"), "n", "w", "bad_w")
    return rounded(out, {"w": 4, "bad_w": 4})


@query("rule_ranking", f"{BASE}, {RULE_SUMS} SELECT rule, row_number() OVER (ORDER BY bad_w / hit_w DESC, rule) AS rank FROM sums")
def rule_ranking(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = evaluate.compound_rule_metrics(loans(spark, sf), TEXTS, "y", "w")
    return ruleset.rank_by_bad_rate(m).select("rule", F.col("rank").cast("long").alias("rank"))


_DIR_SQL = "(SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS used_var, unnest(['>', '>', '==']) AS expected)"


def _directions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("l_quantity", "(40, inf)", ">"), ("l_discount", "(0.06, inf)", ">"), ("l_tax", "== 1", "==")], "var string, cutoff string, direction string"
    )


@query(
    "rule_direction_filter",
    f"""WITH {LOANS}, {LONG}, {THRESHOLDS} SELECT feature AS used_var, t AS threshold, d AS direction FROM th, (SELECT unnest(['<=', '>']) AS d)
    LEFT JOIN {_DIR_SQL} e ON th.feature = e.used_var WHERE expected IS NULL OR d = '==' OR expected = '==' OR expected = d""",
)
def rule_direction_filter(spark: SparkSession, sf: str) -> DataFrame:
    r = rules.threshold_rules(spark, binning.thresholds(loans(spark, sf), FEATURES, 10))
    return evaluate.filter_by_direction(r, _directions(spark)).select("used_var", "threshold", "direction")


@query(
    "rule_funnel",
    f"""{TH_METRICS}, f AS (SELECT used_var, threshold, direction, CASE WHEN hit_w >= 1 THEN bad_w / hit_w ELSE 0 END AS bad_rate, CASE WHEN hit_w >= 1 THEN
      bad_w / hit_w / (tb / tw) ELSE 0 END AS lift, hit_w / tw AS hit_rate, coalesce(expected = direction OR expected = '==', true) AS dv
      FROM m LEFT JOIN {_DIR_SQL} e USING (used_var))
    SELECT used_var, threshold, direction, dv AS direction_valid, dv AND bad_rate > 0 AND hit_rate < 0.35 AND lift > 1.3 AS is_valid,
    CASE WHEN NOT dv THEN 'direction' WHEN NOT bad_rate > 0 THEN 'zero_bad_rate' WHEN NOT hit_rate < 0.35 AND NOT lift > 1.3 THEN 'hit_rate_and_lift'
      WHEN NOT hit_rate < 0.35 THEN 'hit_rate' WHEN NOT lift > 1.3 THEN 'lift' ELSE '' END AS filter_reason FROM f""",
)
def rule_funnel(spark: SparkSession, sf: str) -> DataFrame:
    m = threshold_metrics(spark, sf)
    everything = m.select("rule", "used_var", "threshold", "direction")
    directed = evaluate.filter_by_direction(everything, _directions(spark))
    f = evaluate.rule_funnel(everything, directed, m, 0.35, 1.3)
    return f.join(everything, "rule").select("used_var", "threshold", "direction", "direction_valid", "is_valid", "filter_reason")


@query(
    "rule_funnel_counts",
    f"""{TH_METRICS}, f AS (SELECT CASE WHEN hit_w >= 1 THEN bad_w / hit_w ELSE 0 END AS bad_rate, CASE WHEN hit_w >= 1 THEN bad_w / hit_w / (tb / tw) ELSE 0 END AS lift,
      hit_w / tw AS hit_rate FROM m) SELECT CASE WHEN NOT bad_rate > 0 THEN 'zero_bad_rate' WHEN NOT hit_rate < 0.35 AND NOT lift > 1.3 THEN 'hit_rate_and_lift'
      WHEN NOT hit_rate < 0.35 THEN 'hit_rate' WHEN NOT lift > 1.3 THEN 'lift' ELSE '' END AS filter_reason, count(*) AS n_rules FROM f GROUP BY 1""",
)
def rule_funnel_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = threshold_metrics(spark, sf)
    return evaluate.funnel_counts(evaluate.rule_funnel(m, m, m, 0.35, 1.3))


@query(
    "rule_sources",
    f"""WITH {LOANS}, {LONG}, {THRESHOLDS}, g AS (SELECT feature, 2 * count(*) AS n_rules FROM th GROUP BY feature)
    SELECT feature, n_rules, round(n_rules * 100 / sum(n_rules) OVER (), 6) AS pct FROM g""",
)
def rule_sources(spark: SparkSession, sf: str) -> DataFrame:
    r = rules.threshold_rules(spark, binning.thresholds(loans(spark, sf), FEATURES, 10))
    return rounded(evaluate.rule_source_stats(r))


@query(
    "leakage_check",
    f"""WITH {LOANS}, c AS (SELECT 'l_linestatus' AS feature, l_linestatus AS v, y FROM loans UNION ALL SELECT 'y_copy', (1 - y)::VARCHAR, y FROM loans UNION ALL
      SELECT 'l_returnflag', l_returnflag, y FROM loans UNION ALL SELECT 'l_quantity', l_quantity::VARCHAR, y FROM loans),
    g AS (SELECT feature, v, sum(y) AS b, count(*) AS n FROM c GROUP BY feature, v)
    SELECT feature, count(*) AS n_groups, count(*) FILTER (b = 0 OR b = n) AS n_pure, count(*) = count(*) FILTER (b = 0 OR b = n) AS leaky
    FROM g GROUP BY feature HAVING count(*) <= 10""",
)
def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf).withColumn("y_copy", 1 - F.col("y"))
    return evaluate.leakage(df, ["l_linestatus", "y_copy", "l_returnflag", "l_quantity"], "y")


@query(
    "rule_complexity",
    f"""{BASE}, c AS (SELECT rule, length(rule) - length(regexp_replace(rule, '[&|]', '', 'g')) + 1 AS k FROM {{hit_rules}})
    SELECT round(avg(k), 6) AS avg_complexity, max(k)::INTEGER AS max_complexity, count(*) FILTER (k <= 3) AS simple,
    count(*) FILTER (k > 3 AND k <= 5) AS moderate, count(*) FILTER (k > 5) AS "complex" FROM c""".replace(
        "{hit_rules}", "(SELECT rule FROM hits WHERE hit GROUP BY rule)"
    ),
)
def rule_complexity(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = evaluate.compound_rule_metrics(loans(spark, sf), TEXTS, "y")
    return rounded(rules.complexity_report(m.where("hit_n > 0")))


# ---------------------------------------------------------------- rule sets


@query(
    "rule_union_recall",
    f"""{BASE}, a AS (SELECT *, {' OR '.join(f'h{i}' for i in range(len(RULES)))} AS hit FROM flags)
    SELECT count(*) AS n, count(*) FILTER (hit) AS hit_n, round(count(*) FILTER (hit) / count(*), 6) AS coverage,
    round(sum(w) FILTER (hit AND y = 1) / sum(w) FILTER (y = 1), 6) AS union_recall, round(sum(w) FILTER (hit AND y = 1) / sum(w) FILTER (hit), 6) AS union_bad_rate,
    round(sum(w) FILTER (hit) / sum(w), 6) AS union_hit_rate FROM a""",
)
def rule_union_recall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.union_metrics(loans(spark, sf), TEXTS, "y", "w"))


@query(
    "rule_multi_hit",
    f"""{BASE}, a AS (SELECT {' + '.join(f'h{i}::INT' for i in range(len(RULES)))} AS n_hit FROM flags)
    SELECT n_hit::INTEGER AS n_hit, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM a GROUP BY n_hit""",
)
def rule_multi_hit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.multi_hit(loans(spark, sf), TEXTS))


PAIRS = """pairs AS (SELECT a.rule AS rule1, b.rule AS rule2, a.n AS hits1, b.n AS hits2, c.n AS common FROM
  (SELECT pos, rule, count(*) FILTER (hit) AS n FROM hits GROUP BY ALL) a JOIN (SELECT pos, rule, count(*) FILTER (hit) AS n FROM hits GROUP BY ALL) b ON a.pos < b.pos
  JOIN (""" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, count(*) FILTER (h{i} AND h{j}) AS n FROM flags" for i in range(len(RULES)) for j in range(i + 1, len(RULES))
) + ") c ON c.i = a.pos AND c.j = b.pos)"


@query("rule_overlap", f"{BASE}, {PAIRS} SELECT rule1, rule2, hits1, hits2, common, round(common / (hits1 + hits2 - common), 6) AS jaccard FROM pairs")
def rule_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.rule_pairs(loans(spark, sf), TEXTS).drop("i", "j"))


@query(
    "high_overlap_pairs",
    f"{BASE}, {PAIRS} SELECT rule1, rule2, round(common / (hits1 + hits2 - common), 6) AS jaccard FROM pairs WHERE common / (hits1 + hits2 - common) > 0.3 ORDER BY 3 DESC, 1, 2 LIMIT 10",
)
def high_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = ruleset.rule_pairs(loans(spark, sf), TEXTS).where("jaccard > 0.3").orderBy(F.desc("jaccard"), "rule1", "rule2").limit(10)
    return rounded(p.select("rule1", "rule2", "jaccard"))


@query(
    "rule_overlap_summary",
    f"""{BASE}, {PAIRS}, j AS (SELECT common / (hits1 + hits2 - common) AS jaccard FROM pairs) SELECT round(avg(jaccard), 6) AS avg_overlap,
    count(*) FILTER (jaccard > 0.5) AS n_high, CASE WHEN avg(jaccard) > 0.5 THEN 'warning' ELSE 'ok' END AS status FROM j""",
)
def rule_overlap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.overlap_report(ruleset.rule_pairs(loans(spark, sf), TEXTS)))


@query(
    "rule_redundancy",
    f"""{BASE}, {PAIRS} SELECT rule1 AS containing_rule, rule2 AS redundant_rule FROM pairs WHERE hits2 > 0 AND common = hits2
    UNION ALL SELECT rule2, rule1 FROM pairs WHERE hits1 > 0 AND common = hits1""",
)
def rule_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    return ruleset.redundant_rules(ruleset.rule_pairs(loans(spark, sf), TEXTS))


# Narrow ranges of quantity, one beyond all values, and single discounts: most pairs share no row.
RANGES = [(q, q + w) for w in (1, 3) for q in range(50)] + [(60, 70)]
DISCOUNTS = [d / 100 for d in range(11)]
RANGE_RULES = [f"(l_quantity > {a}) & (l_quantity <= {b})" for a, b in RANGES] + [f"(l_discount == {d})" for d in DISCOUNTS]

RANGE_HITS = f"""cells AS (SELECT l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL),
  rules AS (SELECT unnest(range({len(RANGE_RULES)})) AS pos, unnest({RANGE_RULES!r}) AS rule,
    unnest({[a for a, _ in RANGES] + [-1] * len(DISCOUNTS)!r}) AS low, unnest({[b for _, b in RANGES] + [10**6] * len(DISCOUNTS)!r}) AS high,
    unnest({[-1.0] * len(RANGES) + DISCOUNTS!r}::DOUBLE[]) AS discount),
  hit AS (SELECT pos, rule, c.* FROM cells c JOIN rules ON l_quantity > low AND l_quantity <= high AND (discount < 0 OR l_discount = discount)),
  own AS (SELECT pos, rule, coalesce(sum(n), 0)::BIGINT AS hits FROM rules LEFT JOIN hit USING (pos, rule) GROUP BY ALL),
  shared AS (SELECT a.pos AS i, b.pos AS j, sum(a.n)::BIGINT AS common FROM hit a JOIN hit b ON a.l_quantity = b.l_quantity AND a.l_discount = b.l_discount AND a.pos < b.pos GROUP BY ALL),
  sharing AS (SELECT x.rule AS rule1, x.hits AS hits1, z.rule AS rule2, z.hits AS hits2, common, common / (x.hits + z.hits - common) AS jaccard
    FROM shared JOIN own x ON x.pos = i JOIN own z ON z.pos = j)"""


@query("sharing_rule_pairs", f"WITH {RANGE_HITS} SELECT * REPLACE (round(jaccard, 6) AS jaccard) FROM sharing")
def sharing_rule_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Of 112 rules the pairs that hit a row together."""
    pairs, _ = ruleset.sharing_pairs(table(spark, sf, "lineitem"), RANGE_RULES)
    return rounded(pairs.drop("i", "j"))


@query(
    "sharing_rule_summary",
    f"""WITH {RANGE_HITS}, every AS (SELECT CASE WHEN x.hits + z.hits > 0 THEN 1 END AS one FROM own x JOIN own z ON x.pos < z.pos),
    r AS (SELECT (SELECT sum(jaccard) FROM sharing) / (SELECT count(one) FROM every) AS a)
    SELECT round(a, 6) AS avg_overlap, (SELECT count(*) FROM sharing WHERE jaccard > 0.5) AS n_high, CASE WHEN a > 0.5 THEN 'warning' ELSE 'ok' END AS status,
      (SELECT count(*) FROM sharing WHERE common = hits2) + (SELECT count(*) FROM sharing WHERE common = hits1) AS n_redundant FROM r""",
)
def sharing_rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    pairs, own = ruleset.sharing_pairs(table(spark, sf, "lineitem"), RANGE_RULES)
    return rounded(ruleset.sharing_report(pairs, own).withColumn("n_redundant", F.lit(ruleset.redundant_rules(pairs).count())))


@query(
    "prior_rule_increment",
    f"""{BASE}, s AS (SELECT rule, sum(w) FILTER (hit) AS w1, sum(w) FILTER (hit AND y = 1) AS b1, sum(w) FILTER (hit AND NOT {PRIOR_SQL}) AS w2,
      sum(w) FILTER (hit AND y = 1 AND NOT {PRIOR_SQL}) AS b2, sum(w) FILTER (hit AND {PRIOR_SQL}) AS wb FROM hits GROUP BY rule)
    SELECT rule, round(b1 / tb, 6) AS standalone_recall, round(w1 / tw, 6) AS standalone_hit_rate, round(coalesce(b2, 0) / tb, 6) AS incremental_recall,
    round(coalesce(w2, 0) / tw, 6) AS incremental_hit_rate, round(coalesce(wb, 0) / w1, 6) AS overlap_rate, round(coalesce(b2, 0) / b1, 6) AS marginal_contribution FROM s, tot""",
)
def prior_rule_increment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.prior_increment(loans(spark, sf), TEXTS, PRIOR, "y", "w"))


@query(
    "prior_rule_summary",
    f"""WITH {LOANS} SELECT round(sum(w) FILTER ({PRIOR_SQL}) / sum(w), 6) AS prior_hit_rate, round(sum(w) FILTER ({PRIOR_SQL} AND y = 1) / sum(w) FILTER (y = 1), 6) AS prior_recall,
    count(*) FILTER ({PRIOR_SQL}) AS prior_hit_count, count(*) FILTER ({PRIOR_SQL} AND y = 1) AS prior_bad_count FROM loans""",
)
def prior_rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.prior_summary(loans(spark, sf), PRIOR, "y", "w"))


AMT = "l_extendedprice"


@query(
    "rule_amounts",
    f"""{BASE}, a AS (SELECT sum({AMT}) AS ta, sum({AMT}) FILTER (y = 1) AS tba FROM loans),
    s AS (SELECT rule, count(*) FILTER (hit) AS hit_n, coalesce(sum({AMT}) FILTER (hit), 0) AS ha, coalesce(sum({AMT}) FILTER (hit AND y = 1), 0) AS ba FROM hits GROUP BY rule)
    SELECT rule, hit_n, round(ha, 2) AS hit_amount, round(ha / ta, 6) AS hit_amount_pct, round(ba, 2) AS bad_amount, round(ba / tba, 6) AS bad_amount_pct,
    round(ba / ha, 6) AS amount_bad_rate, round(ba / ha / (tba / ta), 6) AS amount_lift, round(ha / hit_n, 4) AS avg_amount_per_hit FROM s, a""",
)
def rule_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.rule_amounts(loans(spark, sf), TEXTS, "y", AMT), {"hit_amount": 2, "bad_amount": 2, "avg_amount_per_hit": 4})


FIRST = "firsts AS (SELECT *, CASE " + " ".join(f"WHEN h{i} THEN {i}" for i in range(len(RULES))) + " END AS pos FROM flags)"
PREFIX = f"""{FIRST}, new AS (SELECT pos, sum(w) AS nw, sum(y * w) AS nb, sum({AMT}) AS na, sum({AMT}) FILTER (y = 1) AS nba FROM firsts WHERE pos IS NOT NULL GROUP BY pos),
  cum AS (SELECT pos, (SELECT any_value(rule) FROM hits h WHERE h.pos = r.pos) AS rule, sum(coalesce(nw, 0)) OVER o AS cw, sum(coalesce(nb, 0)) OVER o AS cb,
    sum(coalesce(na, 0)) OVER o AS ca, sum(coalesce(nba, 0)) OVER o AS cba FROM (SELECT unnest(range({len(RULES)})) AS pos) r LEFT JOIN new USING (pos) WINDOW o AS (ORDER BY pos))"""


@query(
    "cumulative_rule_curve",
    f"""{BASE}, {PREFIX} SELECT pos::INTEGER AS pos, rule, round(cb / tb, 6) AS cum_recall, round(cb / cw, 6) AS cum_bad_rate, round(cb / cw / (tb / tw), 6) AS cum_lift,
    round(cw / tw, 6) AS cum_hit_rate, round((tb / tw) * (1 - cb / tb) / (1 - cw / tw), 6) AS bad_rate_after FROM cum, tot""",
)
def cumulative_rule_curve(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    t = evaluate.totals(df, "y", "w")
    p = ruleset.prefix_table(df, TEXTS, "y", "w")
    after = ruleset.post_strategy_bad_rate(F.lit(t["bad_w"] / t["w"]), F.col("cum_recall"), F.col("cum_hit_rate"))
    return rounded(p.select("pos", "rule", "cum_recall", "cum_bad_rate", "cum_lift", "cum_hit_rate", after.alias("bad_rate_after")))


@query(
    "cumulative_amounts",
    f"""{BASE}, {PREFIX}, a AS (SELECT sum({AMT}) AS ta, sum({AMT}) FILTER (y = 1) AS tba FROM loans)
    SELECT pos::INTEGER AS pos, rule, round(ca, 2) AS cum_hit_amount, round(cba, 2) AS cum_bad_amount, round(ca / ta, 6) AS cum_hit_amount_pct, round(cba / tba, 6) AS amount_recall,
    round(cba / ca, 6) AS cum_amount_bad_rate, round(cba / ca / (tba / ta), 6) AS cum_amount_lift FROM cum, a""",
)
def cumulative_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.cumulative_amounts(loans(spark, sf), TEXTS, "y", AMT), {"cum_hit_amount": 2, "cum_bad_amount": 2})


_ORDERED = f"""{RULE_SUMS}, ord AS (SELECT pos, rule, row_number() OVER (ORDER BY bad_w / hit_w DESC, pos) - 1 AS ord FROM sums WHERE bad_w > 0),
  fh AS (SELECT l.ord, sum(w) AS nw, sum(y * w) AS nb FROM (SELECT w, y, least(""" + ", ".join(
    f"CASE WHEN h{i} THEN (SELECT ord FROM ord WHERE pos = {i}) END" for i in range(len(RULES))
) + """) AS ord FROM flags) l WHERE l.ord IS NOT NULL GROUP BY l.ord),
  run AS (SELECT ord, rule, sum(coalesce(nw, 0)) OVER (ORDER BY ord) AS cw, sum(coalesce(nb, 0)) OVER (ORDER BY ord) AS cb FROM ord LEFT JOIN fh USING (ord))"""


@query(
    "best_rules_overlap",
    f"""{BASE}, {_ORDERED} SELECT ord::INTEGER AS pos, rule, round(cb / tb, 6) AS cum_recall, round(cb / cw, 6) AS cum_bad_rate, round(cb / cw / (tb / tw), 6) AS cum_lift,
    round(cw / tw, 6) AS cum_hit_rate FROM run, tot WHERE cw / tw <= 0.08""",
)
def best_rules_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = ruleset.best_rules_overlap(loans(spark, sf), TEXTS, "y", "w", 0.08)
    return rounded(b.select("pos", "rule", "cum_recall", "cum_bad_rate", "cum_lift", "cum_hit_rate"))


@query("best_rules_greedy")
def best_rules_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ruleset.best_rules_greedy(loans(spark, sf), TEXTS, "y", "w", 0.12))


@query(
    "best_rules_with_target",
    f"""{BASE}, {_ORDERED}, lim AS (SELECT *, cb / cw / (tb / tw) AS lift FROM run, tot WHERE cw / tw <= 0.2),
    pick AS (SELECT CASE WHEN (SELECT lift FROM lim ORDER BY ord DESC LIMIT 1) >= 5 THEN (SELECT max(ord) FROM lim)
      WHEN (SELECT max(lift) FROM lim) >= 5 THEN (SELECT max(ord) FROM lim WHERE lift >= 5) ELSE (SELECT ord FROM lim ORDER BY lift DESC, ord DESC LIMIT 1) END AS last)
    SELECT ord::INTEGER AS pos, rule, round(lift, 6) AS cum_lift FROM lim, pick WHERE ord <= last""",
)
def best_rules_with_target(spark: SparkSession, sf: str) -> DataFrame:
    b = ruleset.best_rules_overlap(loans(spark, sf), TEXTS, "y", "w", 0.2, min_lift=5.0)
    return rounded(b.select("pos", "rule", "cum_lift"))


@query(
    "optimal_rules_with_metrics",
    f"""{BASE}, {_ORDERED} SELECT r.rule, {metric_sql('hit_w', 'bad_w')}, round(cb / tb, 6) AS cum_recall, round(cw / tw, 6) AS cum_hit_rate
    FROM run r JOIN sums s ON r.rule = s.rule, tot WHERE cw / tw <= 0.08""",
)
def optimal_rules_with_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    m, _ = evaluate.compound_rule_metrics(df, TEXTS, "y", "w")
    o = ruleset.optimal_with_info(m, ruleset.best_rules_overlap(df, TEXTS, "y", "w", 0.08))
    return rounded(o.select("rule", "recall", "bad_rate", "lift", "hit_rate", "cum_recall", "cum_hit_rate"))


@query(
    "rejection_reasons",
    f"""{BASE}, {_ORDERED}, rk AS (SELECT rule, row_number() OVER (ORDER BY bad_w / hit_w DESC, rule) AS rank FROM sums),
    sel AS (SELECT rule, cw / tw AS used FROM run, tot WHERE cw / tw <= 0.08), lim AS (SELECT max(rank) AS last, max(used) AS used FROM sel JOIN rk USING (rule))
    SELECT rule, rank, CASE WHEN rank > last AND used >= 0.08 * 0.95 THEN 'hit_rate_limit' WHEN rank > last THEN 'ranked_low' ELSE 'unexpected' END AS reason
    FROM rk, lim WHERE rule NOT IN (SELECT rule FROM sel)""",
)
def rejection_reasons(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    m, _ = evaluate.compound_rule_metrics(df, TEXTS, "y", "w")
    r = ruleset.rejection_reasons(m, ruleset.best_rules_overlap(df, TEXTS, "y", "w", 0.08), 0.08)
    return r.select("rule", F.col("rank").cast("long").alias("rank"), "reason")


@query(
    "rule_lift_report",
    f"""{BASE}, {RULE_SUMS}, l AS (SELECT bad_w / hit_w / (tb / tw) AS lift FROM sums, tot WHERE hit_w >= 1) SELECT round(avg(lift), 6) AS avg_lift, round(min(lift), 6) AS min_lift,
    round(max(lift), 6) AS max_lift, count(*) FILTER (lift >= 3) AS excellent, count(*) FILTER (lift >= 2 AND lift < 3) AS good,
    count(*) FILTER (lift >= 1.5 AND lift < 2) AS acceptable, count(*) FILTER (lift < 1.5) AS poor FROM l""",
)
def rule_lift_report(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = evaluate.compound_rule_metrics(loans(spark, sf), TEXTS, "y", "w")
    return rounded(validation.lift_report(m))


@query("rule_set_validation")
def rule_set_validation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validation.validate_rules(loans(spark, sf), TEXTS, "y"))


# ---------------------------------------------------------------- stability

SPLIT_HITS = f"""WITH {LOANS}, {SPLIT}, flags AS (SELECT *, {', '.join(f'({s}) AS h{i}' for i, (_, s) in enumerate(RULES))} FROM split3),
  rates AS ({' UNION ALL '.join(f"SELECT {i} AS pos, {_lit(r)} AS rule, split, avg(h{i}::INT) AS rate FROM flags GROUP BY split" for i, (r, _) in enumerate(RULES))})"""
PSI_LABEL = "CASE WHEN psi IS NULL THEN 'n/a' WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'slight_change' ELSE 'significant_change' END"
RULE_PSI = f"""{SPLIT_HITS}, p AS (SELECT rule, a, b, CASE WHEN a > 0 AND b > 0 THEN abs((b - a) * ln(b / a)) END AS psi FROM (
  SELECT rule, max(rate) FILTER (split = 'train') AS a, max(rate) FILTER (split = 'oot') AS b FROM rates GROUP BY rule))"""


def rule_psi_df(spark: SparkSession, sf: str) -> DataFrame:
    return stability.rule_psi(split_loans(spark, sf), TEXTS, "split", "train", "oot")


@query("rule_psi", f"{RULE_PSI} SELECT rule, round(a, 6) AS hit_rate_base, round(b, 6) AS hit_rate_compare, round(psi, 8) AS psi, {PSI_LABEL} AS stability FROM p")
def rule_psi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rule_psi_df(spark, sf).drop("pos"), {"psi": 8})


@query(
    "rule_psi_summary",
    f"""{RULE_PSI} SELECT round(avg(psi), 8) AS avg_psi, round(max(psi), 8) AS max_psi, round(min(psi), 8) AS min_psi, count(*) FILTER (psi < 0.1) AS n_stable,
    count(*) FILTER (psi >= 0.1 AND psi < 0.25) AS n_slight_change, count(*) FILTER (psi >= 0.25) AS n_significant_change FROM p""",
)
def rule_psi_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stability.psi_summary(rule_psi_df(spark, sf)), default=8)


@query(
    "rule_psi_by_time",
    f"""WITH {LOANS}, r AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER () AS nn FROM loans),
    per AS (SELECT *, CASE WHEN rn <= nn // 2 THEN 'base' WHEN rn > nn - nn // 2 THEN 'compare' END AS period FROM r),
    p AS ({' UNION ALL '.join(f"SELECT {_lit(t)} AS rule, avg(({s})::INT) FILTER (period = 'base') AS a, avg(({s})::INT) FILTER (period = 'compare') AS b FROM per" for t, s in RULES)})
    SELECT rule, round(a, 6) AS hit_rate_base, round(b, 6) AS hit_rate_compare, round(CASE WHEN a > 0 AND b > 0 THEN abs((b - a) * ln(b / a)) END, 8) AS psi FROM p""",
)
def rule_psi_by_time(spark: SparkSession, sf: str) -> DataFrame:
    halves = time_halves(loans(spark, sf), "l_shipdate", KEYS, 2)
    return rounded(stability.rule_psi(halves, TEXTS, "period", "base", "compare").drop("pos", "stability"), {"psi": 8})


CV = "CASE WHEN count(*) FILTER (rate > 0) >= 2 THEN stddev_pop(rate) FILTER (rate > 0) / avg(rate) FILTER (rate > 0) ELSE 0 END"


@query(
    "rule_stability_cv",
    f"""{SPLIT_HITS} SELECT *, CASE WHEN cv < 0.15 THEN 'highly_stable' WHEN cv < 0.25 THEN 'stable' WHEN cv < 0.35 THEN 'moderate' ELSE 'unstable' END AS stability_level FROM (
    SELECT rule, round(max(rate) FILTER (split = 'train'), 6) AS hit_rate_train, round(max(rate) FILTER (split = 'test'), 6) AS hit_rate_test,
    round(max(rate) FILTER (split = 'oot'), 6) AS hit_rate_oot, round({CV}, 6) AS cv FROM rates GROUP BY rule)""",
)
def rule_stability_cv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stability.rule_cv(split_loans(spark, sf), TEXTS, "split").drop("pos"))


@query(
    "rule_set_stability",
    f"""{SPLIT_HITS}, u AS (SELECT avg(({' OR '.join(f'h{i}' for i in range(len(RULES)))})::INT) AS rate FROM flags GROUP BY split)
    SELECT round(cv, 6) AS overall_cv, CASE WHEN cv < 0.15 THEN 10 WHEN cv < 0.25 THEN 5 WHEN cv < 0.35 THEN 0 ELSE -5 END AS score_bonus FROM (SELECT {CV} AS cv FROM u)""",
)
def rule_set_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stability.ruleset_cv(split_loans(spark, sf), TEXTS, "split"))


# ---------------------------------------------------------------- mining


@query("rule_directions")
def rule_directions(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf).withColumn("is_open", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(trees.rule_directions(df, [*FEATURES, "l_linenumber", "is_open"], "y", "w"))


@query("tree_rules")
def tree_rules(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    found = [r["rule"] for r in trees.tree_rules(df, FEATURES, "y", F.col("w")).orderBy("rule").collect()]
    m, _ = evaluate.compound_rule_metrics(df, found, "y", "w")
    return rounded(m.drop("pos"))


@query("tree_node_table")
def tree_node_table(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    paths = [r["rule"] for r in trees.tree_rules(df, FEATURES, "y", F.col("w"), all_nodes=True).orderBy("rule").collect()]
    return rounded(trees.node_statistics(df, paths, "y", "w", optimal=paths[:1]))


@query("combination_tree_rules")
def combination_tree_rules(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    found = [r["rule"] for r in trees.combination_tree_rules(df, FEATURES, "y", "w", n_vars=2).orderBy("rule").collect()]
    m, _ = evaluate.compound_rule_metrics(df, found, "y", "w")
    return rounded(m.drop("pos"))

