"""Queries: rule parsing and comparison, selection, complete mining and scorecard runs, the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import binning, evaluate, profile, rules, selection
from scorewright.plans import rule_mining, scorecard_build
from scorewright.plans.queries_models import woe_frame
from scorewright.plans.queries_rules import IV, WOE5, rounded
from scorewright.plans.registry import CALLS, FEATURES, KEYS, LOANS, loans, query, table
from scorewright.plans.staging import checkpoint_folder
from scorewright.roles import Roles
from scorewright.streaming.channel_health import channel_health_stream

_OPS = [">", ">=", "<", "<=", "==", "in", "not in", "between"]


def rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One structured rule per part, every operator in turn."""
    p = table(spark, sf, "part")
    op = F.element_at(F.array(*[F.lit(o) for o in _OPS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    th = F.when(op == "between", F.concat(F.lit("["), size, F.lit(", "), (F.col("p_size") + 9).cast("string"), F.lit("]"))).when(
        op.isin("in", "not in"), F.concat(size, F.lit(", "), (F.col("p_size") + 1).cast("string"))
    ).otherwise(size)
    return p.select(
        F.col("p_partkey").cast("string").alias("Rule_ID"), F.col("p_name").alias("rule_name"), F.lit("p_size").alias("Feature"), op.alias("operator"), th.alias("threshold"),
        F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("(p_size > "), size, F.lit(")"))).alias("expression"),
    )


_ROWS = f"""r AS (SELECT p_partkey AS k, ({_OPS!r})[p_partkey % 8 + 1] AS op, p_size AS s FROM part)"""


@query(
    "parsed_rules",
    f"""WITH {_ROWS} SELECT k::VARCHAR AS rule_id, CASE WHEN k % 10 = 0 THEN '(p_size > ' || s || ')' WHEN op = 'between' THEN '(p_size >= ' || s || ') & (p_size <= ' || (s + 9) || ')'
    WHEN op = 'in' THEN '(p_size.isin([' || s || ', ' || (s + 1) || ']))' WHEN op = 'not in' THEN '(~p_size.isin([' || s || ', ' || (s + 1) || ']))'
    ELSE '(p_size ' || op || ' ' || s || '.0)' END AS rule, CASE WHEN k % 10 = 0 THEN 'expression' ELSE 'structured' END AS mode FROM r""",
)
def parsed_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.parse_rule_rows(rule_rows(spark, sf)).select("rule_id", "rule", "mode")


@query(
    "parsed_rule_lines",
    """SELECT p_partkey, 'R' || lpad((i)::VARCHAR, 3, '0') AS rule_id, trim(line) AS rule FROM (SELECT p_partkey, unnest(range(1, 5)) AS i,
    unnest(['# part ' || p_partkey, ' (p_size > ' || p_size || ')', '', '(p_size <= 3)']) AS line FROM part) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')""",
)
def parsed_rule_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    text = F.concat_ws("\n", F.concat(F.lit("# part "), F.col("p_partkey")), F.concat(F.lit(" (p_size > "), F.col("p_size"), F.lit(")")), F.lit(""), F.lit("(p_size <= 3)"))
    return rules.parse_rule_text(p.select("p_partkey", text.alias("text")), keep=["p_partkey"]).select("p_partkey", "rule_id", "rule")


@query(
    "rule_column_check",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(replace(p_brand, '#', '_')) ELSE '' END AS missing_columns, p_partkey % 3 <> 0 AS valid FROM part""",
)
def rule_column_check(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    extra = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" & ("), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit(" == 1)"))).otherwise(F.lit(" & ~p_type.isin(['A b'])"))
    r = p.select("p_partkey", F.concat(F.lit("(p_size > "), F.col("p_size").cast("string"), F.lit(")"), extra).alias("rule"))
    return rules.missing_rule_columns(r, p.columns).select("p_partkey", "missing_columns", "valid")


@query(
    "threshold_comparison",
    """WITH p AS (SELECT f, t FROM (SELECT 'f' || s_nationkey AS f, (s_suppkey % 4) * 1000.0 AS t, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) WHERE k = 1),
    m AS (SELECT 'f' || (n_nationkey + 2) AS f, n_regionkey * 1000.0 AS t FROM nation)
    SELECT coalesce(p.f, m.f) AS feature, p.t::DOUBLE AS prior_threshold, m.t::DOUBLE AS new_threshold, CASE WHEN m.f IS NULL THEN 'deprecated' WHEN p.f IS NULL THEN 'new'
      WHEN abs(m.t - p.t) < 1e-6 THEN 'retained' ELSE 'threshold_adjusted' END AS status, CASE WHEN abs(m.t - p.t) >= 1e-6 THEN (m.t - p.t)::DOUBLE END AS change,
    CASE WHEN abs(m.t - p.t) >= 1e-6 THEN CASE WHEN m.t > p.t THEN 'increased' ELSE 'decreased' END END AS change_direction FROM p FULL JOIN m ON p.f = m.f""",
)
def threshold_comparison(spark: SparkSession, sf: str) -> DataFrame:
    prior = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("rule_id"), F.concat(F.lit("f"), F.col("s_nationkey")).alias("feature"), ((F.col("s_suppkey") % 4) * 1000).cast("string").alias("threshold")
    )
    mined = table(spark, sf, "nation").select(
        F.concat(F.lit("(f"), F.col("n_nationkey") + 2, F.lit(" > "), F.col("n_regionkey") * 1000, F.lit(")")).alias("rule")
    )
    c = rules.compare_thresholds(prior, mined)
    return c.select("feature", "prior_threshold", "new_threshold", "status", "change", "change_direction")


@query(
    "multi_variable_direction_filter",
    f"""WITH {LOANS} SELECT rule FROM (SELECT DISTINCT '(l_quantity > ' || l_quantity::INT || ') & (l_linenumber <= ' || l_linenumber || ')' AS rule, l_linenumber AS n FROM loans
    UNION SELECT DISTINCT '(l_quantity <= ' || l_quantity::INT || ') & (l_tax > 0.05)', 0 FROM loans UNION SELECT DISTINCT '(l_discount > 0.05) & (l_suppkey > ' || l_suppkey % 10 || ')', -1 FROM loans)
    WHERE n > 0""",
)
def multi_variable_direction_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    q = F.col("l_quantity").cast("int").cast("string")
    a = df.select(F.concat(F.lit("(l_quantity > "), q, F.lit(") & (l_linenumber <= "), F.col("l_linenumber"), F.lit(")")).alias("rule"), F.lit("l_quantity & l_linenumber").alias("used_var"))
    b = df.select(F.concat(F.lit("(l_quantity <= "), q, F.lit(") & (l_tax > 0.05)")).alias("rule"), F.lit("l_quantity & l_tax").alias("used_var"))
    c = df.select(F.concat(F.lit("(l_discount > 0.05) & (l_suppkey > "), F.col("l_suppkey") % 10, F.lit(")")).alias("rule"), F.lit("l_discount & l_suppkey").alias("used_var"))
    every = a.unionByName(b).unionByName(c).distinct()
    d = spark.createDataFrame([("l_quantity", "(40, inf)", ">"), ("l_suppkey", "(-inf, inf]", "<=")], "var string, cutoff string, direction string")
    return evaluate.filter_multi_rules(every, d, ["l_quantity"], ">").select("rule")


# ---------------------------------------------------------------- features


@query(
    "feature_details",
    f"""{WOE5}, {IV} """ + " UNION ALL ".join(
        f"""SELECT '{f}' AS "column", round((SELECT iv FROM ivs WHERE feature = '{f}'), 6) AS iv, (count(*) - count({f})) / count(*) AS missing_rate, count(DISTINCT {f}) AS n_distinct,
        min({f}) AS min, max({f}) AS max, round(avg({f}), 8) AS mean, round(stddev_samp({f}), 8) AS std, 'original' AS source FROM loans""" for f in FEATURES
    ),
)
def feature_details(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    iv = binning.iv_table(binning.fit_woe(df, "y", FEATURES, 5))
    d = profile.feature_details(df, iv, FEATURES).select("column", "iv", "missing_rate", "n_distinct", "min", "max", "mean", "std", "source")
    return rounded(d, {"iv": 6}, 8)


@query("feature_selection")
def feature_selection(spark: SparkSession, sf: str) -> DataFrame:
    df, bins = woe_frame(spark, sf)
    iv = binning.iv_table(bins)
    sel = selection.select_features(df, iv, FEATURES, "y", (0.0, 10.0), use_stepwise=True)
    return rounded(selection.selection_detail(df, bins, iv, FEATURES, sel))


@query("selection_steps")
def selection_steps(spark: SparkSession, sf: str) -> DataFrame:
    df, bins = woe_frame(spark, sf)
    sel = selection.select_features(df, binning.iv_table(bins), FEATURES, "y", (0.02, 10.0), signs="remove")
    return selection.removal_counts(df, sel.removed, len(FEATURES))


# ---------------------------------------------------------------- complete runs

ROLES = Roles("y", "w", "l_extendedprice", "l_shipdate", keys=tuple(KEYS), exclude=("l_returnflag",))


@query("mined_rule_set")
def mined_rule_set(spark: SparkSession, sf: str) -> DataFrame:
    res = rule_mining.run(loans(spark, sf), ROLES, rule_mining.RuleMiningParams(min_iv=0.0, prior_rules=("(l_quantity > 49)",)))
    return rounded(res.tables["best_rules"])


@query("built_scorecard")
def built_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    card = scorecard_build.run(
        loans(spark, sf).drop("w", "l_returnflag", "l_linestatus"), Roles("y", time="l_shipdate", keys=tuple(KEYS)), scorecard_build.ScorecardParams(iv_range=(0.0001, 10.0))
    )
    return rounded(card.tables["card_export"].drop("bin"))


@query(
    "channel_health_stream",
    f"""WITH {CALLS} SELECT channel, count(*) AS total, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures FROM calls GROUP BY channel""",
)
def channel_health_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole event file as a stream, run to its end; one result folder per run in the shared folder."""
    from uuid import uuid4

    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    c = e.select(
        "event_id", "ts", (F.col("user_id") % 8).alias("channel"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("response_time")
    )
    out = f"{checkpoint_folder(spark)}/channel-health-{uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/rows")

    run = channel_health_stream(c).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("channel").agg(F.max_by(F.struct("total", "successes", "failures"), "batch").alias("s"))
    return last.select("channel", "s.total", "s.successes", "s.failures")
