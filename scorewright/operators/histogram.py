"""The long histogram: one row per (feature, bin) with counts and weighted sums.

Binning runs in the JVM (``Bucketizer`` does a binary search per value), the
long form is built by ``stack`` and every aggregate is algebraic, so map-side
partial aggregation leaves at most features x bins rows per task to shuffle -
whatever the skew of the values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INF = math.inf


def splits(cuts: Sequence[float], closed: str = "left") -> list[float]:
    """Bucketizer splits for inner cut points.

    ``left`` gives [a, b) bins. For (a, b] each cut moves to the next double up,
    which makes ``x < cut'`` the same test as ``x <= cut``.
    """
    inner = sorted({float(c) for c in cuts})
    if closed == "right":
        inner = [math.nextafter(c, INF) for c in inner]
    return [-INF, *inner, INF]


def clean_double(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def _numbered_long(df: DataFrame, cuts: Mapping[str, Sequence[float]], keep: Sequence[Column], closed: str) -> DataFrame:
    """Keep columns, fid (position in ``cuts``), bin (null = missing), value."""
    feats = list(cuts)
    live = [i for i, f in enumerate(feats) if len(cuts[f])]
    base = df.select(*keep, *[clean_double(f).alias(f"__x{i}") for i, f in enumerate(feats)])
    kept = base.columns[: len(keep)]
    if live:
        base = Bucketizer(
            inputCols=[f"__x{i}" for i in live],
            outputCols=[f"__b{i}" for i in live],
            splitsArray=[splits(cuts[feats[i]], closed) for i in live],
            handleInvalid="keep",
        ).transform(base)
    cells = [
        f"{i}, CASE WHEN __x{i} IS NOT NULL THEN {f'CAST(__b{i} AS INT)' if i in live else '0'} END, __x{i}" for i in range(len(feats))
    ]
    return base.select(*[F.col(f"`{k}`") for k in kept], F.expr(f"stack({len(cells)}, {', '.join(cells)}) AS (fid, bin, value)"))


def _feature_name(feats: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("fid") + 1).alias("feature")


def binned_long(
    df: DataFrame, cuts: Mapping[str, Sequence[float]], keep: Sequence[Column] = (), closed: str = "left"
) -> DataFrame:
    """Rows x features in long form: keep columns, feature, bin (null = missing), value."""
    long = _numbered_long(df, cuts, keep, closed)
    return long.select(*[F.col(f"`{k}`") for k in long.columns[: len(keep)]], _feature_name(list(cuts)), "bin", "value")


def histogram(
    df: DataFrame,
    cuts: Mapping[str, Sequence[float]],
    target: str | None = None,
    weight: str | None = None,
    by: Sequence[str] = (),
    closed: str = "left",
    missing: bool = False,
) -> DataFrame:
    """(by..., feature, bin) -> n, bad, w, bad_w, vmin, vmax; missing rows only on request.

    Grouping runs on feature numbers; names come back on the few aggregated rows.
    """
    if not cuts:
        raise ValueError("no features to bin")
    y = (F.col(target) if target else F.lit(0)).cast("double")
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    long = _numbered_long(df, cuts, [*[F.col(b) for b in by], y.alias("__y"), w.alias("__w")], closed)
    if not missing:
        long = long.where(F.col("bin").isNotNull())
    counted = long.groupBy(*by, "fid", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("__y").alias("bad"),
        F.sum("__w").alias("w"),
        F.sum(F.col("__y") * F.col("__w")).alias("bad_w"),
        F.min("value").alias("vmin"),
        F.max("value").alias("vmax"),
    )
    return counted.select(*by, _feature_name(list(cuts)), "bin", "n", "bad", "w", "bad_w", "vmin", "vmax")


def edge_table(spark: SparkSession, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(feature, bin, lo, hi); an open end is null. Row count = number of cut points + features."""
    rows = []
    for f, cs in cuts.items():
        inner: list[float | None] = [None, *sorted({float(c) for c in cs}), None]
        rows += [(f, i, inner[i], inner[i + 1]) for i in range(len(inner) - 1)]
    return spark.createDataFrame(rows, "feature string, bin int, lo double, hi double")
