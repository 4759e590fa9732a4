"""Correlation, collinearity and the filters on top of them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.numeric import distinct_estimate
from scorewright.operators.binning import small_domains
from scorewright.operators.histogram import binned_long, clean_double
from scorewright.operators.ordering import with_ranks

#: Distinct values up to which Kendall's tau reads the cross-tab of values.
KENDALL_CELLS = 200
#: Rows whose pairs can be counted in 64 bits: a sum over pairs stays below the square of the rows.
INT64_ROWS = 3_000_000_000
#: Points of a strip, and the fewest and most strips of a column; beyond MAX_STRIPS * STRIP_ROWS points strips grow.
STRIP_ROWS, MIN_STRIPS, MAX_STRIPS = 100_000, 16, 1000
#: Distinct rows up to which rows are counted first, how many of them a task takes, and the column of their numbers.
DISTINCT_ROWS, ROWS_PER_TASK, ROWS = 1_000_000, 50_000, "__rows"


def distinct_rows(df: DataFrame, cols: Sequence[str], count: str = ROWS) -> DataFrame:
    """(cols..., count): one row per distinct row of the columns where these are few (as binned columns have), else all rows.
    Moments, factors and fits that count a row ``count`` times need no other scan."""
    rows = df.select(*[F.col(f"`{c}`") for c in cols])
    est = rows.agg(distinct_estimate(F.lit(0), *[F.col(f"`{c}`") for c in cols]).alias("d")).first()["d"]
    if est > DISTINCT_ROWS:
        return rows.withColumn(count, F.lit(1).cast("long"))
    keys = [F.col(f"`{c}`") for c in cols]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).repartition(1 + est // ROWS_PER_TASK, *keys)


def _moments(df: DataFrame, cols: Sequence[str], count: str | None = None) -> DataFrame:
    """(i, j, n, si, sj, sii, sjj, sij) for i <= j over rows where both are present, each ``count`` times.

    Every Arrow batch adds small matrix products, so a task ships cols² rows.
    """
    k = len(cols)
    times = F.lit(1.0) if count is None else F.col(count).cast("double")
    x = df.select(*[clean_double(c).alias(f"c{i}") for i, c in enumerate(cols)], times.alias("times"))
    total = [(F.sum(F.col(f"c{i}") * F.col("times")), F.sum(F.when(F.col(f"c{i}").isNotNull(), F.col("times")))) for i in range(k)]
    means = x.agg(*[F.try_divide(a, b).alias(f"c{i}") for i, (a, b) in enumerate(total)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])

    def partials(batches):
        n = np.zeros((k, k))
        s, q, p = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        for pdf in batches:
            a = pdf.to_numpy(dtype=float)
            a, t = a[:, :k], a[:, k:]
            there = ~np.isnan(a)
            m = there.astype(float)
            v = np.where(there, a - shift, 0.0)
            n += (m * t).T @ m
            s += (v * t).T @ m
            q += (v * v * t).T @ m
            p += (v * t).T @ v
        i, j = np.triu_indices(k)
        yield pd.DataFrame({
            "i": i.astype(np.int32), "j": j.astype(np.int32), "n": n[i, j], "si": s[i, j], "sj": s[j, i],
            "sii": q[i, j], "sjj": q[j, i], "sij": p[i, j],
        })

    schema = "i int, j int, n double, si double, sj double, sii double, sjj double, sij double"
    parts = x.mapInPandas(partials, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])


def _names(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    ix = "i" if prefix == "1" else "j"
    return F.broadcast(df.sparkSession.createDataFrame(list(enumerate(cols)), f"{ix} int, feature{prefix} string"))


def pearson(df: DataFrame, cols: Sequence[str], count: str | None = None) -> DataFrame:
    m = _moments(df, cols, count).where("i < j")
    n = F.col("n")
    cov = n * F.col("sij") - F.col("si") * F.col("sj")
    var = (n * F.col("sii") - F.col("si") ** 2) * (n * F.col("sjj") - F.col("sj") ** 2)
    corr = F.when(var > 0, cov / F.sqrt(var))
    return m.join(_names(df, cols, "1"), "i").join(_names(df, cols, "2"), "j").select("feature1", "feature2", corr.alias("corr"))


def spearman(df: DataFrame, cols: Sequence[str], **rank_options) -> DataFrame:
    """Pearson on average ranks; with missing values the ranks are taken per pair of columns."""
    x = df.select(*[clean_double(c).alias(c) for c in cols])
    nulls = x.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in cols]).first()
    groups = [list(cols)] if not any(nulls) else [list(p) for p in combinations(cols, 2)]
    out = None
    for g in groups:
        sub = x.select(*g).dropna()
        for c in g:
            sub = with_ranks(sub, c, **rank_options)
        part = pearson(sub.select(*[F.col(f"`{c}__rank`").alias(c) for c in g]), g)
        out = part if out is None else out.unionByName(part)
    return out


def kendall(df: DataFrame, cols: Sequence[str], max_values: int = KENDALL_CELLS) -> DataFrame:
    """Tau-b, exact: from the cross-tab of values where both columns have at most ``max_values``, else by strips."""
    small = small_domains(df, cols, max_values)
    x = df.select(*[clean_double(c).alias(c) for c in cols])
    rows = []
    for a, b in combinations(cols, 2):
        both = x.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
        if a in small and b in small:
            counts = _cell_counts(both.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"), F.lit(1).alias("n")), small[a][:-1], small[b][:-1])
            rows.append((a, b, _tau_b(counts)))
        else:
            rows.append((a, b, _tau_b_by_strips(both, a, b, small)))
    return df.sparkSession.createDataFrame(rows, "feature1 string, feature2 string, corr double")


def _in_strips(pairs: DataFrame, cuts_a: Sequence[float], cuts_b: Sequence[float]) -> DataFrame:
    """(a, b, n) with the numbers ``ia, ib`` of the strips they lie in."""
    half = binned_long(pairs, {"a": cuts_a}, [F.col("b").alias("__b"), F.col("n")], closed="right").select(F.col("bin").alias("ia"), F.col("value").alias("a"), F.col("__b").alias("b"), "n")
    return binned_long(half, {"b": cuts_b}, [F.col("a").alias("__a"), F.col("ia"), F.col("n")], closed="right").select(
        F.col("__a").alias("a"), F.col("value").alias("b"), "n", "ia", F.col("bin").alias("ib")
    )


def _cell_counts(pairs: DataFrame, cuts_a: Sequence[float], cuts_b: Sequence[float]) -> np.ndarray:
    counts = np.zeros((len(cuts_a) + 1, len(cuts_b) + 1))
    for r in _in_strips(pairs, cuts_a, cuts_b).groupBy("ia", "ib").agg(F.sum("n").alias("n")).collect():
        counts[r["ia"], r["ib"]] = r["n"]
    return counts


def _strip_cuts(pairs: DataFrame, column: str, n: int, values: Sequence[float] | None) -> list[float]:
    """Cuts of a column into strips, (low, high] each. A value that fills a strip gets one of its own."""
    if values is not None:
        return list(values[:-1])
    k = min(MAX_STRIPS, max(MIN_STRIPS, -(-n // STRIP_ROWS)))
    q = pairs.agg(F.percentile_approx(column, [i / k for i in range(1, k)], 10 * k).alias("q")).first()["q"]
    cuts = set(q)
    cuts |= {math.nextafter(v, -math.inf) for v, w in zip(q, q[1:]) if v == w}
    return sorted(c for c in cuts if math.isfinite(c))


def _single(cuts: Sequence[float], values: Sequence[float] | None) -> list[int]:
    """Numbers of the strips known to hold one value."""
    if values is not None:
        return list(range(len(values)))
    return [i for i in range(1, len(cuts)) if math.nextafter(cuts[i], -math.inf) == cuts[i - 1]]


def _concordance(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """Concordant less discordant pairs among points (a, b) of n rows each, exact at any number of rows.

    Two points with different a part at one level of a binary tree over the order of a; at each level one pass in order of b
    counts them.
    """
    code = np.unique(a, return_inverse=True)[1].astype(np.int64)
    rank = np.unique(b, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    code, rank, n = code[order], rank[order], n[order].astype(np.int64)
    if sum(n.tolist()) > INT64_ROWS:
        n = n.astype(object)  # Python integers
    total = 0
    for level in range(int(code.max()).bit_length()):
        at = np.argsort(code >> (level + 1), kind="stable")
        group, right, r, m = code[at] >> (level + 1), (code[at] >> level) & 1, rank[at], n[at]
        left = np.concatenate([[0], np.cumsum(np.where(right == 0, m, 0))])
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_run = new_group | np.concatenate([[True], r[1:] != r[:-1]])

        def ends(new):
            starts = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            return left[starts[which]], left[np.append(starts[1:], len(new))[which]]

        g_start, g_end = ends(new_group)
        r_start, r_end = ends(new_run)
        total += int((np.where(right == 1, m, 0) * ((r_start - g_start) - (g_end - r_end))).sum())
    return total


def _within(a: str, b: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [float(_concordance(pdf[a].to_numpy(), pdf[b].to_numpy(), pdf["n"].to_numpy()))]})

    return run


def _tau_b_by_strips(both: DataFrame, a: str, b: str, small: dict[str, list[float]]) -> float | None:
    """Pairs of rows in different strips of both columns come from the cross-tab of strips. Those in one strip of a are
    counted there by value, those in one strip of b but different ones of a there by value of b and strip of a."""
    pairs = both.groupBy(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).agg(F.count(F.lit(1)).alias("n")).cache()
    try:
        rows, points = pairs.agg(F.sum("n"), F.count(F.lit(1))).first()
        if not rows:
            return None
        cuts = [_strip_cuts(pairs, c, points, small.get(name)) for c, name in (("a", a), ("b", b))]
        counts = _cell_counts(pairs, *cuts)
        placed = _in_strips(pairs, *cuts)
        diff = sum(_cell_pairs(counts))
        for strip, x, y, name, own in (("ia", "a", "b", a, cuts[0]), ("ib", "ia", "b", b, cuts[1])):
            single = _single(own, small.get(name))
            if len(single) <= len(own):
                inside = placed if not single else placed.where(~F.col(strip).isin(single))
                points_in = inside.groupBy(strip, x, y).agg(F.sum("n").alias("n"))
                diff += points_in.groupBy(strip).applyInPandas(_within(x, y), "s double").agg(F.sum("s")).first()[0] or 0.0
        ties = [pairs.groupBy(c).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] for c in ("a", "b")]
    finally:
        pairs.unpersist()
    all_pairs = rows * (rows - 1) / 2
    den = math.sqrt((all_pairs - ties[0]) * (all_pairs - ties[1]))
    return float(diff / den) if den else None


def _cell_pairs(t: np.ndarray) -> tuple[float, float]:
    """Concordant pairs and, negative, discordant ones among rows that differ in both cells."""
    below = np.zeros_like(t)
    below[1:, 1:] = t.cumsum(0).cumsum(1)[:-1, :-1]
    above = np.zeros_like(t)
    above[1:, :-1] = t.cumsum(0)[:, ::-1].cumsum(1)[:, ::-1][:-1, 1:]
    return (t * below).sum(), -(t * above).sum()


def _tau_b(t: np.ndarray) -> float | None:
    n = t.sum()
    pairs = n * (n - 1) / 2
    tie_a = (t.sum(axis=1) * (t.sum(axis=1) - 1)).sum() / 2
    tie_b = (t.sum(axis=0) * (t.sum(axis=0) - 1)).sum() / 2
    den = math.sqrt((pairs - tie_a) * (pairs - tie_b))
    return float(sum(_cell_pairs(t)) / den) if den else None


def correlation(df: DataFrame, cols: Sequence[str], method: str = "pearson", **options) -> DataFrame:
    """(feature1, feature2, corr) of the upper triangle, pairwise-complete."""
    fn = {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method]
    return fn(df, cols, **options)


def high_pairs(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    return corr.where(F.abs("corr") > threshold).orderBy(F.desc(F.abs("corr")), "feature1", "feature2")


def correlation_drops(corr: DataFrame, threshold: float = 0.7, keep: str = "first") -> list[str]:
    """Features removed by the pair list: the second of each pair, or both with ``keep='none'``."""
    out: list[str] = []
    for r in high_pairs(corr, threshold).collect():
        out += [r["feature2"]] if keep == "first" else [r["feature1"]] if keep == "last" else [r["feature1"], r["feature2"]]
    return list(dict.fromkeys(out))


# ---------------------------------------------------------------- VIF


# Triangular factors that one task or the driver stacks at a time.
FACTORS_AT_ONCE = 32
# A direction whose length falls below this share of the longest is taken as an exact linear relation, and a column
# takes part in it when its component exceeds the second figure.
RANK_SHARE, TAKES_PART = 1e-13, 1e-6


def _stacked(factors: Sequence[np.ndarray], k: int) -> np.ndarray:
    """The triangular factor of all rows behind the given ones, k x k."""
    r = np.linalg.qr(np.vstack(factors), mode="r") if factors else np.zeros((0, k))
    return np.vstack([r, np.zeros((k - len(r), k))])


def triangular_factor(df: DataFrame, cols: Sequence[str], count: str | None = None) -> np.ndarray:
    """R of the QR decomposition of the complete rows (rows with a missing or infinite value are left out), each taken
    ``count`` times.

    Each task reduces its Arrow batches to one k x k factor; factors meet in groups of ``FACTORS_AT_ONCE`` until as many
    are left. Unlike a cross-product matrix, R keeps the condition of the data itself. Zeros without complete rows.
    """
    k = len(cols)
    finite = [F.when(F.abs(clean_double(c)) < math.inf, clean_double(c)) for c in cols]
    rows = df.select(*[x.alias(f"c{i}") for i, x in enumerate(finite)], *([] if count is None else [F.col(count).alias("times")])).dropna()

    def reduced(batches):
        r = np.zeros((0, k))
        for pdf in batches:
            if len(pdf):
                a = pdf.to_numpy(float)
                if count is not None:
                    a = a[:, :k] * np.sqrt(a[:, k:])
                r = np.linalg.qr(np.vstack([r, a]), mode="r")
        if len(r):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [_stacked([r], k).ravel()]})

    def merged(pdf):
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "r": [_stacked([x.reshape(k, k) for x in pdf["r"]], k).ravel()]})

    parts = rows.mapInPandas(reduced, "part int, r array<double>")
    width, left = 1, rows.rdd.getNumPartitions()
    while left > FACTORS_AT_ONCE:
        width *= FACTORS_AT_ONCE
        parts = parts.groupBy((F.col("part") / width).cast("int").alias("g")).applyInPandas(merged, "part int, r array<double>")
        left = -(-left // FACTORS_AT_ONCE)
    return _stacked([np.array(x["r"]).reshape(k, k) for x in parts.orderBy("part").collect()], k)


def vif_values(r: np.ndarray) -> list[float]:
    """Variance inflation of each column of R: |x_i|² (XᵀX)⁻¹_ii from its singular directions.

    Columns that take part in an exact linear relation, and columns of zeros, are infinite; the others are judged on the
    remaining directions.
    """
    length = np.sqrt((r * r).sum(axis=0))
    used = np.flatnonzero(length > 0)
    out = np.full(r.shape[1], math.inf)
    if len(used):
        _, size, directions = np.linalg.svd(r[:, used] / length[used], full_matrices=True)
        size = np.pad(size, (0, len(used) - len(size)))
        flat = size <= RANK_SHARE * size[0]
        tied = (np.abs(directions[flat]) > TAKES_PART).any(axis=0)
        out[used] = np.where(tied, math.inf, (directions[~flat] ** 2 / size[~flat, None] ** 2).sum(axis=0))
    return [float(v) for v in out]


def vif(df: DataFrame, cols: Sequence[str], count: str | None = None) -> DataFrame:
    rows = list(zip(cols, vif_values(triangular_factor(df, cols, count))))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def vif_elimination(
    df: DataFrame, cols: Sequence[str], threshold: float = 5.0, max_rounds: int = 10, count: str | None = None
) -> tuple[list[str], list[tuple[int, str, float]]]:
    """Drop the largest VIF while above the threshold; every round reads columns of the one triangular factor."""
    r = triangular_factor(df, cols, count)
    left = list(range(len(cols)))
    log = []
    for rnd in range(1, max_rounds + 1):
        if len(left) < 2:
            break
        v = vif_values(r[:, left])
        worst = int(np.argmax(v))
        if v[worst] <= threshold:
            break
        log.append((rnd, cols[left[worst]], v[worst]))
        left.pop(worst)
    return [cols[i] for i in left], log
