"""Rule tables: single-variable rules, parsing, complexity, comparison."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.functions.rule_expr import RuleError, rule_sql

RULE_SCHEMA = "rule_id string, rule string, used_var string, threshold double, direction string"

# Words in a rule that are not column names.
RULE_KEYWORDS = [
    "and", "or", "not", "in", "True", "False", "None", "isin", "abs", "str", "int", "float",
]

# Name parts that mark a 0/1 feature.
BINARY_MARKERS = ["_is_", "_txt_has_", "_flag_", "_binary_"]


def number_text(v: float) -> str:
    return repr(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))


def rule_table(spark: SparkSession, rules: Sequence[str]) -> DataFrame:
    """A plain list of rule texts as a rules table, in list order."""
    rows = [(f"R{i + 1:03d}", r, None, None, None) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def threshold_rules(
    spark: SparkSession,
    cuts: Mapping[str, Sequence[float]],
    binary: Iterable[str] = (),
    directions: str = "both",
) -> DataFrame:
    """``== 1`` for binary features, ``<= t`` and ``> t`` for every threshold of the others."""
    binary = set(binary)
    seen: dict[str, tuple] = {}
    for f, ts in cuts.items():
        if f in binary:
            seen.setdefault(f"({f} == 1)", (f, 1.0, "=="))
            continue
        for t in ts:
            for d in ("<=", ">"):
                if directions in (d, "both"):
                    seen.setdefault(f"({f} {d} {number_text(t)})", (f, float(t), d))
    rows = [(f"R{i + 1:03d}", r, f, t, d) for i, (r, (f, t, d)) in enumerate(seen.items())]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def categorical_rules(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One equality rule per distinct value, from one scan, built as a table (never collected)."""
    types = dict(df.dtypes)
    cells = [
        F.struct(F.lit(c).alias("used_var"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(types[c] == "string").alias("quoted"))
        for c in columns
    ]
    vals = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()
    lit = F.when(F.col("quoted"), F.concat(F.lit("'"), F.col("value"), F.lit("'"))).otherwise(F.col("value"))
    return vals.select(
        "used_var",
        F.concat(F.lit("("), F.col("used_var"), F.lit(" == "), lit, F.lit(")")).alias("rule"),
        "value",
        F.lit("==").alias("direction"),
    )


def complexity(rule: Column) -> Column:
    """Number of conditions: connectives + 1."""
    return F.length(rule) - F.length(F.regexp_replace(rule, "[&|]", "")) + 1


def complexity_report(rules: DataFrame) -> DataFrame:
    c = complexity(F.col("rule"))
    return rules.agg(
        F.avg(c).alias("avg_complexity"),
        F.max(c).alias("max_complexity"),
        F.count(F.when(c <= 3, 1)).alias("simple"),
        F.count(F.when((c > 3) & (c <= 5), 1)).alias("moderate"),
        F.count(F.when(c > 5, 1)).alias("complex"),
    )


# ---------------------------------------------------------------- parsing


def parse_rule_text(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One rule per line of a text column; blank lines and ``#`` comments are skipped."""
    lines = df.select(*keep, F.posexplode(F.split(F.trim(F.col(text)), "\n")).alias("line_no", "line"))
    rule = F.trim("line")
    return lines.where((rule != "") & ~rule.startswith("#")).select(
        *keep,
        F.concat(F.lit("R"), F.lpad((F.col("line_no") + 1).cast("string"), 3, "0")).alias("rule_id"),
        rule.alias("rule"),
        F.lit("expression").alias("mode"),
    )


def rule_file_mode(columns: Iterable[str]) -> str:
    cols = {c.strip().lower() for c in columns}
    structured = {"feature", "operator", "threshold"} <= cols
    if structured and "expression" in cols:
        return "mixed"
    return "structured" if structured else "expression" if "expression" in cols else "unknown"


def parse_rule_rows(df: DataFrame) -> DataFrame:
    """rules(rule_id, rule_name, rule, feature, operator, threshold, direction, mode, error).

    Expression text wins over the structured columns of a row. Row problems land
    in ``error``; rows with neither an expression nor a feature are dropped.
    """
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    mode = rule_file_mode(df.columns)
    if mode == "unknown":
        raise RuleError(f"needs feature/operator/threshold or expression columns, found {df.columns}")

    def col(name: str) -> Column:
        return F.trim(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")

    expr = F.when(col("expression") != "", col("expression"))
    feature = F.when(col("feature") != "", col("feature"))
    op, th = F.lower(col("operator")), col("threshold")
    number = th.try_cast("double")
    bounds = F.split(F.regexp_replace(th, r"[\[\]()\s]", ""), ",")
    items = F.when(th.startswith("["), th).otherwise(F.concat(F.lit("["), th, F.lit("]")))
    between_ok = F.coalesce(
        th.rlike(r"^\s*[\[(]\s*[-+]?[0-9.]+(?:[eE][-+]?\d+)?\s*,\s*[-+]?[0-9.]+(?:[eE][-+]?\d+)?\s*[\])]\s*$"),
        F.lit(False),
    )
    simple = op.isin(">", ">=", "<", "<=", "==", "!=")
    structured = (
        F.when((op == "between") & between_ok,
               F.concat(F.lit("("), feature, F.lit(" >= "), bounds[0], F.lit(") & ("), feature, F.lit(" <= "), bounds[1], F.lit(")")))
        .when(op == "in", F.concat(F.lit("("), feature, F.lit(".isin("), items, F.lit("))")))
        .when(op == "not in", F.concat(F.lit("(~"), feature, F.lit(".isin("), items, F.lit("))")))
        .when(simple & number.isNotNull(), F.concat(F.lit("("), feature, F.lit(" "), op, F.lit(" "), number.cast("string"), F.lit(")")))
        .when(simple, F.concat(F.lit("("), feature, F.lit(" "), op, F.lit(" '"), th, F.lit("')")))
    )
    rule = F.coalesce(expr, structured)
    return df.where(expr.isNotNull() | feature.isNotNull()).select(
        col("rule_id").alias("rule_id"),
        col("rule_name").alias("rule_name"),
        rule.alias("rule"),
        F.when(expr.isNull(), feature).alias("feature"),
        F.when(expr.isNull(), op).alias("operator"),
        F.when(expr.isNull(), th).alias("threshold"),
        F.when(expr.isNull(), F.coalesce(col("direction"), F.lit("reject"))).alias("direction"),
        F.when(expr.isNotNull(), "expression").otherwise("structured").alias("mode"),
        F.when(rule.isNull(), F.concat(F.lit("cannot build a rule from operator "), F.coalesce(op, F.lit("null")),
                                       F.lit(" and threshold "), F.coalesce(th, F.lit("null")))).alias("error"),
    )


def missing_rule_columns(rules: DataFrame, available: Sequence[str]) -> DataFrame:
    """Identifiers of each rule that are not columns of the data; quoted text does not count."""
    bare = F.regexp_replace("rule", r"'[^']*'|\"[^\"]*\"", " ")
    names = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"), F.lit(1)))
    known = F.array(*[F.lit(c) for c in [*available, *RULE_KEYWORDS]])
    missing = F.sort_array(F.array_except(names, known))
    return rules.withColumn("missing_columns", F.array_join(missing, ",")).withColumn(
        "valid", F.size(missing) == 0
    )


def check_rules(rules: Sequence[str], columns: Iterable[str]) -> list[tuple[str, str | None]]:
    """(rule, error or None) without touching data."""
    out = []
    for r in rules:
        try:
            rule_sql(r, columns)
            out.append((r, None))
        except RuleError as exc:
            out.append((r, str(exc)))
    return out


# ---------------------------------------------------------------- comparison


def compare_thresholds(prior: DataFrame, mined: DataFrame) -> DataFrame:
    """Prior structured rules against the first condition of each mined rule, by feature.

    prior(rule_id, feature, threshold), mined(rule). Classes: new,
    threshold_adjusted, retained, deprecated.
    """
    first = Window.partitionBy("feature").orderBy("rule_id")
    p = (
        prior.where(F.col("feature").isNotNull())
        .withColumn("__r", F.row_number().over(first))
        .where("__r = 1")
        .select("feature", F.col("threshold").try_cast("double").alias("prior_threshold"), F.lit(True).alias("in_prior"))
    )
    pattern = r"^\s*\(?\s*(\w+)\s*(>=|<=|>|<|==|!=)\s*([\d.]+)\s*\)?"
    part = [F.regexp_extract("rule", pattern, i) for i in (1, 2, 3)]
    m = mined.select(
        "rule",
        F.when(part[0] != "", part[0]).alias("feature"),
        F.when(part[1] != "", part[1]).alias("operator"),
        part[2].try_cast("double").alias("new_threshold"),
    )
    both = m.join(p, "feature", "full_outer")
    diff = F.col("new_threshold") - F.col("prior_threshold")
    status = (
        F.when(F.col("rule").isNull(), "deprecated")
        .when(F.col("in_prior").isNull(), "new")
        .when(diff.isNull() | (F.abs(diff) < 1e-6), "retained")
        .otherwise("threshold_adjusted")
    )
    adjusted = status == "threshold_adjusted"
    return both.select(
        "feature", "rule", "operator", "prior_threshold", "new_threshold",
        status.alias("status"),
        F.when(adjusted, diff).alias("change"),
        F.when(adjusted, F.when(diff > 0, "increased").otherwise("decreased")).alias("change_direction"),
    )
