"""Registered queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- shared inputs

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

TARGET_SQL = "(l_quantity > 40 AND l_discount >= 0.07) OR (l_orderkey * 31 + l_linenumber * 17) % 23 = 0"

LOANS = f"""loans AS (
  SELECT *, CASE WHEN {TARGET_SQL} THEN 1 ELSE 0 END AS y, 1 + l_tax AS w FROM lineitem)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def loans(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a loan table: target ``y``, weight ``w``, amount ``l_extendedprice``."""
    df = table(spark, sf, "lineitem")
    bad = ((F.col("l_quantity") > 40) & (F.col("l_discount") >= 0.07)) | (
        (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 23 == 0
    )
    return df.withColumn("y", bad.cast("int")).withColumn("w", 1 + F.col("l_tax"))


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels; unlabelled ones have missing labels."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


DOCS = "docs AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a call log: 'error' is a failed call, ``value`` its response time."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "ts", (F.col("user_id") % 8).alias("channel"), (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("response_time"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % len(MODELS) + 1).cast("int")).alias("model_name"),
        (F.col("event_id") % 100).cast("long").alias("prompt_tokens"), (F.col("user_id") % 50).cast("long").alias("completion_tokens"),
        (F.col("event_id") % 100 + F.col("user_id") % 50).cast("long").alias("total_tokens"), (F.col("user_id") % 10 == 0).alias("is_test_data"),
        F.col("ts").alias("timestamp"),
    )


MODELS = ["gpt-4o-mini", "deepseek-chat", "claude-3-haiku", "local-model"]

CALLS = f"""calls AS (
  SELECT event_id, ts, user_id % 8 AS channel, event_type <> 'error' AS ok, value AS response_time,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    ({MODELS!r})[user_id % {len(MODELS)} + 1] AS model_name, event_id % 100 AS prompt_tokens, user_id % 50 AS completion_tokens,
    event_id % 100 + user_id % 50 AS total_tokens, user_id % 10 = 0 AS is_test_data, ts AS "timestamp"
  FROM events)"""


# ---------------------------------------------------------------- SQL fragments


def sql_long(features: list[str] = FEATURES, source: str = "loans", extra: str = "y, w") -> str:
    parts = [f"SELECT '{f}' AS feature, {f}::DOUBLE AS v, {extra} FROM {source}" for f in features]
    return "long AS (" + " UNION ALL ".join(parts) + ")"


def sql_quantile_bins(n: int, closed: str = "left", source: str = "long") -> str:
    probs = ", ".join(f"{i / n!r}" for i in range(n + 1))
    op = "<=" if closed == "left" else "<"
    return f"""cuts AS (SELECT feature, e[2:len(e) - 1] AS c FROM (
    SELECT feature, list_sort(list_distinct(quantile_cont(v, [{probs}]::DOUBLE[]))) AS e FROM {source} GROUP BY feature)),
  binned AS (SELECT s.*, c, len(list_filter(c, lambda t: t {op} v))::INTEGER AS bin
    FROM {source} s JOIN cuts USING (feature) WHERE v IS NOT NULL)"""


def sql_woe(hist: str = "hist", out: str = "woe") -> str:
    """hist(feature, bin, n, bad) to shares, WOE and IV parts."""
    return f"""{out} AS (SELECT *, (pb - pg) * woe AS iv FROM (SELECT *, greatest(least(ln(pb / pg), 10), -10) AS woe FROM (
    SELECT *, n - bad AS good, bad / n AS bad_rate, greatest(bad / sum(bad) OVER (PARTITION BY feature), 1e-4) AS pb,
      greatest((n - bad) / sum(n - bad) OVER (PARTITION BY feature), 1e-4) AS pg FROM {hist})))"""
