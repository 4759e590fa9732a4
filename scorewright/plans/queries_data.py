"""Queries: sources, profile, data quality, features, detection, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.datetimes import DATETIME_FEATURES, add_datetime_features, parse_formats
from scorewright.functions.numeric import rnd
from scorewright.functions.texts import TEXT_FEATURES, add_text_features, mask
from scorewright.operators import clean, columns, profile, sensitive, split
from scorewright.plans.registry import DOCS, FEATURES, KEYS, LOANS, labelled_documents, loans, query, table
from scorewright.sources.tables import describe_columns

LINE_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_NUMERIC = LINE_COLS[:8]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- profile


def _profile_sql() -> str:
    out = []
    for c in LINE_COLS:
        num = c in LINE_NUMERIC
        stats = (
            f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS std"
            if num else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
        )
        out.append(
            f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, "
            f"round((SELECT max(k) FROM (SELECT count(*) AS k FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}), 6) AS mode_share, "
            f"{stats} FROM lineitem"
        )
    return _union(out)


@query("column_profile", _profile_sql())
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = profile.profile(table(spark, sf, "lineitem"))
    return p.select(
        "column", "n", "n_null", "n_distinct", rnd(F.col("mode_share")).alias("mode_share"), "min", "max",
        rnd(F.col("mean"), 8).alias("mean"), rnd(F.col("std"), 8).alias("std"),
    )


@query("table_preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def table_preview(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return profile.preview(o.orderBy(F.desc("o_totalprice"), "o_orderkey"), 10)


@query(
    "sample_values",
    _union([
        f"(SELECT '{c}' AS \"column\", {c} AS value FROM orders GROUP BY {c} ORDER BY {c} LIMIT 5)" for c in ("o_orderstatus", "o_orderpriority")
    ]),
)
def sample_values(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sample_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], 5)


@query(
    "column_listing",
    "SELECT position - 1 AS position, name AS \"column\" FROM (SELECT unnest(range(1, 12)) AS position, "
    f"unnest({LINE_COLS!r}) AS name) WHERE (SELECT count(*) FROM lineitem) > 0",
)
def column_listing(spark: SparkSession, sf: str) -> DataFrame:
    return describe_columns(table(spark, sf, "lineitem")).select(F.col("position").cast("long").alias("position"), "column")


DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_MISSING = "miss AS (" + _union([
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) AS missing_rate FROM docs" for c in DOC_COLS
]) + ")"


@query("missing_report", f"WITH {DOCS}, {_MISSING} SELECT variable, missing_count, round(missing_rate, 6) AS missing_rate FROM miss")
def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    r = profile.missing_report(labelled_documents(spark, sf))
    return r.select("variable", "missing_count", rnd(F.col("missing_rate")).alias("missing_rate"))


@query(
    "missing_summary",
    f"""WITH {DOCS}, {_MISSING} SELECT round(avg(missing_rate), 6) AS avg_rate, round(min(missing_rate), 6) AS min_rate,
    round(max(missing_rate), 6) AS max_rate, count(*) FILTER (missing_rate > 0) AS n_with_missing,
    count(*) FILTER (missing_rate = 0) AS none, count(*) FILTER (missing_rate > 0 AND missing_rate <= 0.1) AS upto_10,
    count(*) FILTER (missing_rate > 0.1 AND missing_rate <= 0.3) AS upto_30,
    count(*) FILTER (missing_rate > 0.3 AND missing_rate <= 0.5) AS upto_50, count(*) FILTER (missing_rate > 0.5) AS over_50 FROM miss""",
)
def missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = profile.missing_summary(profile.missing_report(labelled_documents(spark, sf)))
    return s.select(*[rnd(F.col(c)).alias(c) if c.endswith("_rate") else c for c in s.columns])


@query("top_missing", f"WITH {DOCS}, {_MISSING} SELECT variable, missing_count FROM miss WHERE missing_rate > 0.3 ORDER BY missing_rate DESC, variable LIMIT 10")
def top_missing(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_missing(profile.missing_report(labelled_documents(spark, sf))).select("variable", "missing_count")


@query("constant_columns", _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS is_constant FROM lineitem" for c in LINE_COLS]))
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile.constant_columns(table(spark, sf, "lineitem"))


@query(
    "mode_share_filter",
    f"WITH {DOCS}, {_MISSING}, " + "modes AS (" + _union([
        f"SELECT '{c}' AS variable, max(k) / sum(k) AS s FROM (SELECT count(*) AS k FROM docs WHERE {c} IS NOT NULL GROUP BY {c})" for c in DOC_COLS
    ]) + """) SELECT variable, round(missing_rate, 6) AS missing_rate, round(coalesce(s, 0), 6) AS mode_share,
    CASE WHEN missing_rate >= 0.5 THEN 'missing' WHEN coalesce(s, 0) >= 0.8 THEN 'identical' ELSE '' END AS reason
    FROM miss JOIN modes USING (variable)""",
)
def mode_share_filter(spark: SparkSession, sf: str) -> DataFrame:
    q = profile.quality_filter(labelled_documents(spark, sf), DOC_COLS, 0.5, 0.8)
    return q.select("variable", rnd(F.col("missing_rate")).alias("missing_rate"), rnd(F.col("mode_share")).alias("mode_share"), "reason")


def _iqr_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, count(*) FILTER "
        f"({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS k, count(*) AS n FROM lineitem, "
        f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, q3"
    )


@query(
    "iqr_outliers",
    "SELECT \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower, round(hi, 6) AS upper, k AS n_outliers, "
    f"round(k * 100 / n, 6) AS pct FROM ({_union([_iqr_sql(c) for c in FEATURES])})",
)
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    o = profile.iqr_outliers(table(spark, sf, "lineitem"), FEATURES)
    return o.select("column", *[rnd(F.col(c)).alias(c) for c in ("q1", "q3", "lower", "upper")], "n_outliers", rnd(F.col("pct")).alias("pct"))


def _z_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", round(u, 6) AS mean, round(s, 6) AS std, count(*) FILTER (abs({c} - u) / s > 1.5) AS n_outliers, "
        f"round(count(*) FILTER (abs({c} - u) / s > 1.5) * 100 / count(*), 6) AS pct FROM lineitem, "
        f"(SELECT avg({c}) AS u, stddev_samp({c}) AS s FROM lineitem) GROUP BY u, s"
    )


@query("zscore_outliers", _union([_z_sql(c) for c in FEATURES]))
def zscore_outliers(spark: SparkSession, sf: str) -> DataFrame:
    # a limit of 1.5 leaves something to count on evenly spread columns
    o = profile.zscore_outliers(table(spark, sf, "lineitem"), FEATURES, 1.5)
    return o.select("column", rnd(F.col("mean")).alias("mean"), rnd(F.col("std")).alias("std"), "n_outliers", rnd(F.col("pct")).alias("pct"))


@query(
    "outlier_summary",
    f"SELECT \"column\", n_outliers, pct FROM ({_union([_z_sql(c) for c in FEATURES])}) WHERE n_outliers > 0 ORDER BY pct DESC, \"column\"",
)
def outlier_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = profile.outlier_summary(profile.zscore_outliers(table(spark, sf, "lineitem"), FEATURES, 1.5))
    return o.select("column", "n_outliers", rnd(F.col("pct")).alias("pct"))


_QUALITY_FEATS = [c for c in DOC_COLS if c != "toxic"]
_QUALITY_NUM = ["doc_id", "n_chars", "quality"]
_QUALITY_TXT = ["text", "lang", "source"]


def _quality_sql() -> str:
    cols = []
    for c in _QUALITY_FEATS:
        num = c in _QUALITY_NUM
        low = f"stddev_samp({c}) / (avg({c}) + 1e-10) < 0.01" if num else "false"
        cols.append(
            f"SELECT '{c}' AS c, {str(num).lower()} AS num, (count(*) - count({c})) / count(*) AS miss, count(DISTINCT {c}) AS d, {low} AS low FROM docs"
        )
    return f"""WITH {DOCS}, cols AS ({_union(cols)}), f AS (SELECT count(*) AS n, avg(miss) AS avg_missing,
      count(*) FILTER (miss > 0.3) AS n_high_missing, count(*) FILTER (num) AS n_numeric, count(*) FILTER (NOT num) AS n_text,
      2 * count(*) FILTER (NOT num AND d > 50) AS n_high_cardinality, count(*) FILTER (num AND d = 1) AS n_constant,
      count(*) FILTER (num AND d > 1 AND low) AS n_low_variance FROM cols),
    s AS (SELECT *, 100.0 - least(30, avg_missing * 100) - least(20, (1 - n_numeric / n) * 40) - least(15, n_high_cardinality / n * 50)
      - least(15, (n_constant + n_low_variance) / n * 50) AS score, (n_high_missing > 0)::INT + (n_text > 0)::INT
      + (n_high_cardinality > 0)::INT + (n_constant > 0)::INT AS issues FROM f)
    SELECT n AS n_features, round(avg_missing, 6) AS avg_missing, n_high_missing, n_numeric, n_text, n_high_cardinality, n_constant,
      n_low_variance, round(score, 6)::DOUBLE AS quality_score, issues::BIGINT AS n_issues, (score < 70 OR issues >= 2) AS needs_feature_engineering FROM s"""


@query("data_quality_score", _quality_sql())
def data_quality_score(spark: SparkSession, sf: str) -> DataFrame:
    q = profile.data_quality(labelled_documents(spark, sf), "toxic")
    return q.withColumn("avg_missing", rnd(F.col("avg_missing"))).withColumn("quality_score", rnd(F.col("quality_score")))


@query(
    "sentinel_counts",
    "SELECT 'l_linenumber' AS \"column\", count(*) FILTER (l_linenumber IN (1, 7)) AS n_replaced FROM lineitem UNION ALL "
    "SELECT 'l_quantity', count(*) FILTER (l_quantity IN (1, 7)) FROM lineitem",
)
def sentinel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.sentinel_counts(table(spark, sf, "lineitem"), ["l_linenumber", "l_quantity"], [1, 7])


@query(
    "sentinels_to_missing",
    "SELECT l_linestatus, count(*) AS n, count(CASE WHEN l_linenumber NOT IN (1, 7) THEN 1 END) AS n_kept, "
    "sum(CASE WHEN l_linenumber NOT IN (1, 7) THEN l_linenumber END)::BIGINT AS total FROM lineitem GROUP BY l_linestatus",
)
def sentinels_to_missing(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.sentinels_to_null(table(spark, sf, "lineitem").select("l_linestatus", "l_linenumber"), ["l_linenumber"], [1, 7])
    return df.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count("l_linenumber").alias("n_kept"), F.sum("l_linenumber").alias("total"))


@query("listwise_complete_rows", f"WITH {DOCS} SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM docs WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def listwise_complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.listwise(labelled_documents(spark, sf), ["quality", "toxic"]).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_CLEAN_SQL = f"""WITH {DOCS}, {_MISSING}, one AS ({_union([f"SELECT '{c}' AS variable, count(DISTINCT {c}) <= 1 AS k FROM docs" for c in DOC_COLS])})
  SELECT variable AS "column", CASE WHEN variable = 'doc_id' THEN 'id' WHEN variable = 'source' THEN 'extra' WHEN k THEN 'constant'
    WHEN missing_rate >= 0.5 THEN 'missing' ELSE 'kept' END AS outcome FROM miss JOIN one USING (variable)"""


@query("column_cleaning", _CLEAN_SQL)
def column_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled_documents(spark, sf)
    kept, gone = clean.clean_columns(df, extra=["source"], auto_id=True, missing_limit=0.5)
    rows = [(c, k) for k, cs in gone.items() for c in cs] + [(c, "kept") for c in kept.columns]
    return spark.createDataFrame(rows, "column string, outcome string")


@query("renamed_features", "SELECT o_orderkey AS loan_id, o_totalprice AS amount FROM orders")
def renamed_features(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.rename_features(table(spark, sf, "orders"), {"o_orderkey": "loan_id", "o_totalprice": "amount", "absent": "x"})
    return df.select("loan_id", "amount")


# ---------------------------------------------------------------- derived features

_DT = {
    "year": "year(d)", "month": "month(d)", "day": "day(d)", "dayofweek": "isodow(d) - 1", "hour": "hour(d)", "minute": "minute(d)",
    "quarter": "quarter(d)", "is_weekend": "(isodow(d) >= 6)::INT", "is_month_start": "(day(d) = 1)::INT",
    "is_month_end": "(last_day(d) = d::DATE)::INT", "days_since": "date_diff('day', d::DATE, (SELECT max(o_orderdate) FROM orders)::DATE)",
}


@query(
    "datetime_features",
    "SELECT o_orderkey, " + ", ".join(f"({e})::BIGINT AS o_orderdate_dt_{k}" for k, e in _DT.items())
    + " FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)",
)
def datetime_features(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return add_datetime_features(o, ["o_orderdate"], DATETIME_FEATURES)


_TXT_SQL = r"""SELECT doc_id, length(t)::BIGINT AS text_txt_length,
  CASE WHEN regexp_replace(t, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+')) END::BIGINT AS text_txt_word_count,
  regexp_matches(t, '\d')::BIGINT AS text_txt_has_digits, regexp_matches(t, '[一-鿿]')::BIGINT AS text_txt_has_chinese,
  regexp_matches(t, '[a-zA-Z]')::BIGINT AS text_txt_has_english, regexp_matches(t, '[!@#$%^&*(),.?":{}|<>]')::BIGINT AS text_txt_has_special,
  (NOT regexp_matches(t, '\S'))::BIGINT AS text_txt_is_empty,
  round(length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) / greatest(length(t), 1), 6) AS text_txt_digit_ratio,
  round(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) / greatest(length(t), 1), 6) AS text_txt_upper_ratio
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


@query("text_features", _TXT_SQL)
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    d = add_text_features(table(spark, sf, "documents").select("doc_id", "text"), ["text"], TEXT_FEATURES)
    return d.select("doc_id", *[
        rnd(F.col(c)).alias(c) if c.endswith("_ratio") else F.col(c).cast("long").alias(c) for c in d.columns if c != "doc_id"
    ])


@query(
    "keyword_flags",
    "SELECT doc_id, (contains(lower(text), 'licen') OR contains(lower(text), 'copyright'))::BIGINT AS text_txt_legal, "
    "(contains(lower(text), '@') OR contains(lower(text), 'http'))::BIGINT AS text_txt_contact FROM documents",
)
def keyword_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = add_text_features(
        table(spark, sf, "documents").select("doc_id", "text"), ["text"], [], {"legal": ["Licen", "copyright"], "contact": ["@", "HTTP"]}
    )
    return d.select("doc_id", F.col("text_txt_legal").cast("long").alias("text_txt_legal"), F.col("text_txt_contact").cast("long").alias("text_txt_contact"))


@query(
    "one_hot",
    "SELECT " + ", ".join(f"sum((l_linestatus = '{v}')::INT)::BIGINT AS l_linestatus_is_{v}" for v in "FO")
    + ", " + ", ".join(f"sum((l_returnflag = '{v}')::INT)::BIGINT AS l_returnflag_is_{v}" for v in "ANR")
    + ", l_linenumber FROM lineitem GROUP BY l_linenumber",
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_linenumber", "l_linestatus", "l_returnflag")
    out, mapping = clean.one_hot(df, ["l_linestatus", "l_returnflag"])
    new = [c for cs in mapping.values() for c in cs]
    return out.groupBy("l_linenumber").agg(*[F.sum(c).alias(c) for c in new])


_KINDS = {
    "l_orderkey": (False, None), "l_partkey": (False, None), "l_suppkey": (False, None), "l_linenumber": (True, None),
    "l_returnflag": (True, None), "l_linestatus": (True, None),
}


@query(
    "categorical_columns",
    _union([
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 50 AS is_categorical FROM lineitem" for c in ("l_returnflag", "l_linestatus")
    ] + [
        f"""SELECT '{c}', NOT (a IN (0, 1) AND b > 20 AND s >= 0.3 AND d >= 10) AND ((d <= 15 AND a >= 1 AND b < 20) OR (d <= 10 AND a = 0 AND b < 15)
          OR (d <= 15 AND s < 0.3 AND b < 1000) OR (d = 2 AND a >= 0 AND b <= 2) OR (d > 10 AND d <= 50 AND s < 0.5 AND b < 100 AND a >= 1))
          FROM (SELECT min({c}) AS a, max({c}) AS b, count(DISTINCT {c}) AS d, count(DISTINCT {c}) / (max({c}) - min({c}) + 1) AS s FROM lineitem)"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey")
    ] + [
        # its name holds 'num', a counting word, so only the small-range and binary tests apply
        """SELECT 'l_linenumber', NOT (a IN (0, 1) AND b > 20 AND s >= 0.3 AND d >= 10) AND ((d <= 15 AND a >= 1 AND b < 20) OR (d = 2 AND a >= 0 AND b <= 2))
          FROM (SELECT min(l_linenumber) AS a, max(l_linenumber) AS b, count(DISTINCT l_linenumber) AS d,
          count(DISTINCT l_linenumber) / (max(l_linenumber) - min(l_linenumber) + 1) AS s FROM lineitem)"""
    ]),
)
def categorical_columns(spark: SparkSession, sf: str) -> DataFrame:
    return columns.categorical_report(table(spark, sf, "lineitem")).select("column", "is_categorical")


@query(
    "binary_columns",
    f"WITH {DOCS} SELECT c AS \"column\", coalesce(a >= 0 AND b <= 1 AND d <= 2, true) AS is_binary FROM (" + _union([
        f"SELECT '{c}' AS c, min({c}) AS a, max({c}) AS b, count(DISTINCT {c}) AS d FROM docs" for c in ("doc_id", "n_chars", "quality", "toxic")
    ]) + ")",
)
def binary_columns(spark: SparkSession, sf: str) -> DataFrame:
    feats = ["doc_id", "n_chars", "quality", "toxic"]
    found = columns.binary_features(labelled_documents(spark, sf), feats)
    return spark.createDataFrame([(f, f in found) for f in feats], "column string, is_binary boolean")


@query(
    "datetime_columns",
    "SELECT c AS \"column\" FROM (" + _union([
        f"SELECT '{c}' AS c, count(TRY_CAST({c} AS TIMESTAMP)) = count({c}) AND count({c}) > 0 AS ok FROM orders"
        for c in ("o_orderstatus", "o_orderpriority", "o_orderdate")
    ]) + ") WHERE ok",
)
def datetime_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = columns.datetime_columns(table(spark, sf, "orders"))
    return spark.createDataFrame([(c,) for c in found], "column string")


@query(
    "text_columns",
    "SELECT c AS \"column\" FROM (" + _union([
        f"SELECT '{c}' AS c, count(DISTINCT {c}) / count(*) AS u, avg(length({c})) AS l FROM documents" for c in ("text", "lang", "source")
    ]) + ") WHERE u >= 0.5 AND l >= 20",
)
def text_columns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in columns.long_text_columns(table(spark, sf, "documents"))], "column string")


@query(
    "non_feature_columns",
    """SELECT 'event_id' AS "column", 'id' AS reason FROM (SELECT count(*) FROM events) UNION ALL SELECT 'user_id', 'id' UNION ALL
    SELECT 'ts', 'time' UNION ALL SELECT 'props', 'high_cardinality' FROM (SELECT count(DISTINCT props) / count(*) AS u FROM events) WHERE u >= 0.95""",
)
def non_feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    return columns.non_feature_columns(table(spark, sf, "events"))


@query("time_column_candidates")
def time_column_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day_text", F.date_format("ts", "yyyy/MM/dd")).withColumn("month_number", F.date_format("ts", "yyyyMM").cast("int"))
    return columns.time_candidates(e)


@query(
    "parsed_time_formats",
    """WITH t AS (SELECT strftime(ts, '%Y/%m/%d') AS day_text, strftime(ts, '%Y%m%d')::INT AS day_number, strftime(ts, '%Y%m')::INT AS month_number FROM events)
    SELECT 'day_text' AS "column", 'yyyy/MM/dd' AS format FROM t HAVING avg((try_strptime(day_text, '%Y/%m/%d') IS NOT NULL)::INT) > 0.9 UNION ALL
    SELECT 'day_number', 'yyyyMMdd' FROM t HAVING avg((day_number BETWEEN 19000101 AND 21001231)::INT) > 0.9 UNION ALL
    SELECT 'month_number', 'yyyyMM' FROM t HAVING avg((month_number BETWEEN 190001 AND 210012)::INT) > 0.9 UNION ALL
    SELECT 'value', 'numeric' FROM t HAVING count(*) > 0""",
)
def parsed_time_formats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.date_format("ts", "yyyy/MM/dd").alias("day_text"), F.date_format("ts", "yyyyMMdd").cast("int").alias("day_number"),
        F.date_format("ts", "yyyyMM").cast("int").alias("month_number"), "value",
    )
    return spark.createDataFrame(list(parse_formats(e, e.columns).items()), "column string, format string")


@query(
    "column_roles",
    f"WITH {LOANS} " + _union([
        f"SELECT '{c}' AS \"column\", {str(c not in ('l_returnflag', 'l_linestatus', 'l_shipdate')).lower()} AS is_numeric, "
        f"{str(c in ('l_returnflag', 'l_linestatus')).lower()} AS is_categorical, count(DISTINCT {c}) = 2 AS is_binary, "
        + (f"min({c}) = 0 AND max({c}) = 1 AND count(DISTINCT {c}) = 2" if c in ("y",) else "false") + " AS maybe_target FROM loans"
        for c in [*LINE_COLS, "y", "w"]
    ]),
)
def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    return profile.role_suggestions(loans(spark, sf)).select("column", "is_numeric", "is_categorical", "is_binary", "maybe_target")


@query("preprocessed_documents", r"""SELECT count(*) AS n, sum(length(text))::BIGINT AS total_length, sum(regexp_matches(text, '\d')::INT)::BIGINT AS with_digits,
    sum((lang = 'en')::INT)::BIGINT AS lang_en FROM documents""")
def preprocessed_documents(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = clean.preprocess(table(spark, sf, "documents"), auto_id=True)
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.sum("text_txt_length").alias("total_length"), F.sum("text_txt_has_digits").alias("with_digits"),
        F.sum("lang_is_en").alias("lang_en"),
    )


# ---------------------------------------------------------------- sensitive data

_PATTERNS = {r.name: r.pattern for r in sensitive.RULES if r.pattern}


@query(
    "sensitive_value_hits",
    _union([
        f"SELECT '{c}' AS \"column\", '{name}' AS rule, count({c}) AS n_values, count(*) FILTER (regexp_matches({c}, '{p}')) AS n_hits, "
        f"round(count(*) FILTER (regexp_matches({c}, '{p}')) / count({c}), 6) AS hit_rate FROM documents"
        for c in ("text", "source") for name, p in _PATTERNS.items()
    ]),
)
def sensitive_value_hits(spark: SparkSession, sf: str) -> DataFrame:
    h = sensitive.value_hits(table(spark, sf, "documents"), ["text", "source"])
    return h.select("column", "rule", "n_values", "n_hits", rnd(F.col("hit_rate")).alias("hit_rate"))


def _first_hit_sql(cols: list[str], source: str) -> str:
    live = [r for r in sensitive.RULES if r.pattern]
    parts = []
    for c in cols:
        rate = {r.name: f"count(*) FILTER (regexp_matches({c}::VARCHAR, '{r.pattern}')) / count({c})" for r in live}
        case = " ".join(f"WHEN {rate[r.name]} >= {r.threshold} THEN '{r.name}'" for r in live)
        parts.append(f"SELECT '{c}' AS \"column\", CASE {case} END AS rule FROM {source}")
    return _union(parts)


SCANNED = {
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}


@query(
    "sensitive_columns",
    "SELECT \"column\", 'value_regex' AS method, rule FROM (" + _union([_first_hit_sql(cs, t) for t, cs in SCANNED.items()]) + ") WHERE rule IS NOT NULL",
)
def sensitive_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = [sensitive.sensitive_columns(table(spark, sf, t)) for t in SCANNED]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("column", "method", "rule")


@query(
    "masked_values",
    "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE c_name[1:2] || '****' || c_name[-2:] END AS masked FROM customer",
)
def masked_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", mask(F.col("c_name")).alias("masked"))


# ---------------------------------------------------------------- splits

_H = "('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 13))::BIGINT"
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
SPLIT = f"""split0 AS (SELECT *, {_H} AS h, row_number() OVER (ORDER BY {_ORDER}) AS rn, count(*) OVER () AS nn FROM loans),
  split1 AS (SELECT *, rn > nn - floor(nn * 0.2) AS is_oot FROM split0),
  split2 AS (SELECT *, row_number() OVER (PARTITION BY is_oot, y ORDER BY h) AS k, count(*) OVER (PARTITION BY is_oot, y) AS nk FROM split1),
  split3 AS (SELECT *, CASE WHEN is_oot THEN 'oot' WHEN k <= floor(nk * 0.3) THEN 'test' ELSE 'train' END AS split FROM split2)"""


def split_loans(spark: SparkSession, sf: str) -> DataFrame:
    return split.time_split(loans(spark, sf), "y", "l_shipdate", KEYS, 0.2, 0.3)


@query("out_of_time_split", f"WITH {LOANS}, {SPLIT} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, split FROM split3")
def out_of_time_split(spark: SparkSession, sf: str) -> DataFrame:
    return split_loans(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "split")


@query(
    "stratified_split",
    f"""WITH {LOANS}, s AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_H}) AS k, count(*) OVER (PARTITION BY y) AS nk FROM loans)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k <= floor(nk * 0.25) THEN 'test' ELSE 'train' END AS split FROM s""",
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.random_split(loans(spark, sf), "y", KEYS, 0.25).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "split")


@query(
    "label_split",
    """SELECT CASE lower(trim(lab)) WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' WHEN 'oot' THEN 'oot' WHEN 'val' THEN 'oot' END AS split, count(*) AS n
    FROM (SELECT (['Train', ' test', 'VAL', 'other'])[o_custkey % 4 + 1] AS lab FROM orders) GROUP BY 1""",
)
def label_split(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn(
        "lab", F.element_at(F.array(*[F.lit(x) for x in ("Train", " test", "VAL", "other")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    ).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    s = split.split_data(o, "y", ["o_orderkey"], label="lab")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_target_rates",
    f"""WITH {LOANS}, {SPLIT} SELECT split, count(*) AS n, round(avg(y), 6) AS target_rate FROM split3 GROUP BY split
    UNION ALL SELECT 'all', count(*), round(avg(y), 6) FROM split3""",
)
def split_target_rates(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_target_rates(split_loans(spark, sf), "y").select("split", "n", rnd(F.col("target_rate")).alias("target_rate"))


@query(
    "split_time_ranges",
    f"""WITH {LOANS}, {SPLIT} SELECT split, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS min_time,
    strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max_time FROM split3 GROUP BY split""",
)
def split_time_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_time_ranges(split_loans(spark, sf), "l_shipdate")


_TEXT_KEYS = {
    "flag": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag || '/' || l_orderkey % 10 END",
    "line": "'order-' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey",
}


@query(
    "text_key_split",
    f"""WITH {LOANS}, k AS (SELECT *, date_trunc('year', l_shipdate) AS year, {', '.join(f'{e} AS {c}' for c, e in _TEXT_KEYS.items())} FROM loans),
    r AS (SELECT *, row_number() OVER (ORDER BY year, flag NULLS FIRST, line) AS rn, count(*) OVER () AS n FROM k)
    SELECT rn > n - n // 5 AS oot, count(*) AS n, sum(y)::BIGINT AS bad, min(line) AS first, max(line) AS last FROM r GROUP BY 1""",
)
def text_key_split(spark: SparkSession, sf: str) -> DataFrame:
    """The newest fifth by year; within the year that is cut, text keys with missing values and ties decide."""
    df = loans(spark, sf).select("y", F.date_trunc("year", "l_shipdate").alias("year"), *[F.expr(e).alias(c) for c, e in _TEXT_KEYS.items()])
    parts = split.time_split(df, "y", "year", list(_TEXT_KEYS))
    return parts.groupBy((F.col("split") == "oot").alias("oot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"), F.min("line").alias("first"), F.max("line").alias("last")
    )


@query(
    "period_halves",
    f"""WITH {LOANS}, r AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rn, count(*) OVER () // 3 AS m, count(*) OVER () AS nn FROM loans)
    SELECT CASE WHEN rn <= m THEN 'base' WHEN rn > nn - m THEN 'compare' END AS period, count(*) AS n, sum(y)::BIGINT AS bad FROM r GROUP BY 1""",
)
def period_halves(spark: SparkSession, sf: str) -> DataFrame:
    p = split.time_halves(loans(spark, sf), "l_shipdate", KEYS, 3)
    return p.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))


