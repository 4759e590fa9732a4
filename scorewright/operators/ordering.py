"""Running totals over an ordered column without a global window.

Rows are first grouped by value, values are cut into ranges by sketch quantiles,
and each range runs its own window; range totals (a few hundred rows) supply the
offsets. A value holding a third of the rows is a single grouped row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000


# Ranges a sketch can place; with more rows the ranges grow instead.
MAX_RANGES = 1000


def _range_cuts(table: DataFrame, key: str, range_rows: int) -> list[float]:
    probs = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    row = table.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, probs, 10 * MAX_RANGES).alias("q")).first()
    parts = min(MAX_RANGES, -(-row["n"] // range_rows))
    if parts <= 1:
        return []
    return sorted({float(row["q"][i * MAX_RANGES // parts - 1]) for i in range(1, parts)})


def _range_id(key: str, cuts: Sequence[float]) -> Column:
    if not cuts:
        return F.lit(0)
    # a literal edge list; each lookup scans it inside one expression
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(key) >= c))


def running_totals(
    table: DataFrame, key: str, measures: Sequence[str], by: Sequence[str] = (), descending: bool = False,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Adds ``before_{m}``: sum of m over rows of the group that come earlier in key order.

    ``table`` holds one row per (by..., key), numeric key.
    """
    cuts = _range_cuts(table, key, range_rows)
    t = table.withColumn("__range", _range_id(key, cuts))
    order = F.desc(key) if descending else F.asc(key)
    inner = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", *[F.coalesce(F.sum(m).over(inner), F.lit(0)).alias(f"__in_{m}") for m in measures])
    if not cuts:
        return t.select(*table.columns, *[F.col(f"__in_{m}").alias(f"before_{m}") for m in measures])
    rorder = F.desc("__range") if descending else F.asc("__range")
    outer = Window.partitionBy(*by).orderBy(rorder).rowsBetween(Window.unboundedPreceding, -1) if by else (
        Window.partitionBy(F.lit(0)).orderBy(rorder).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = t.groupBy(*by, "__range").agg(*[F.sum(m).alias(m) for m in measures]).select(
        *by, "__range", *[F.coalesce(F.sum(m).over(outer), F.lit(0)).alias(f"__off_{m}") for m in measures]
    )
    # without groups there is one offset row per range
    return t.join(offsets if by else F.broadcast(offsets), [*by, "__range"]).select(
        *table.columns, *[(F.col(f"__in_{m}") + F.col(f"__off_{m}")).alias(f"before_{m}") for m in measures]
    )


def average_ranks(df: DataFrame, column: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(value, n, avg_rank): 1-based ranks with ties averaged."""
    vals = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return running_totals(vals, "value", ["n"], range_rows=range_rows).select(
        "value", "n", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("avg_rank")
    )


def with_ranks(
    df: DataFrame, column: str, broadcast_rows: int = 500_000, hot_share: float = 0.001, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Adds ``{column}__rank``. Few distinct values: broadcast; many: hot values are joined apart from the rest."""
    ranks = average_ranks(df, column, range_rows).cache()
    stats = ranks.agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).first()
    out = f"{column}__rank"
    value = F.col(column).cast("double")
    table = ranks.select(F.col("value").alias("__v"), F.col("avg_rank").alias(out), "n")
    if stats["d"] <= broadcast_rows:
        return df.join(F.broadcast(table.drop("n")), value == F.col("__v"), "left").drop("__v")
    # at most 1 / hot_share values can be hot
    hot = F.broadcast(table.where(F.col("n") > stats["n"] * hot_share).drop("n"))
    cold = table.where(F.col("n") <= stats["n"] * hot_share).drop("n")
    first = df.join(hot, value == F.col("__v"), "inner").drop("__v")
    rest = df.join(hot.select("__v"), value == F.col("__v"), "left_anti")
    return first.unionByName(
        rest.where(F.col(column).isNotNull()).join(cold, value == F.col("__v"), "left").drop("__v")
    ).unionByName(df.where(F.col(column).isNull()).withColumn(out, F.lit(None).cast("double")))
