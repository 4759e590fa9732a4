"""Supervised cut points: chi-square merging and one-feature trees.

Spark reduces each feature to at most 100 quantile cells; the merge or split
search then runs per feature on those few rows (``applyInPandas``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.binning import Cuts, quantile_cuts, quantile_edges, rounded_thresholds, small_domains
from scorewright.operators.histogram import edge_table, histogram

FINE_CELLS = 100
MIN_LEAF_SHARE = 0.01

_CUT_SCHEMA = "feature string, cut double"


def _fine_cells(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, Cuts]:
    """(feature, bin, lo, n, bad) on min(100, distinct) quantile cells."""
    small = small_domains(df, features, FINE_CELLS - 1)
    size = {f: len(small[f]) if f in small else FINE_CELLS for f in features}
    edges = quantile_edges(df, [f for f in features if size[f] >= 2], size)
    cuts: Cuts = {f: e[1:-1] for f, e in edges.items() if len(e) >= 3}
    cells = histogram(df, cuts, target).select("feature", "bin", "n", "bad")
    return cells.join(F.broadcast(edge_table(df.sparkSession, cuts)), ["feature", "bin"]), cuts


def _pair_chi2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2x2 chi-square of adjacent cells, rows are [good, bad]; inf when a class is absent."""
    n = a.sum(axis=1) + b.sum(axis=1)
    cls = a + b
    det = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    den = cls[:, 0] * cls[:, 1] * a.sum(axis=1) * b.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * det * det / den
    # an empty cell next to a mixed one differs in nothing
    chi = np.where((den == 0) & (cls[:, 0] > 0) & (cls[:, 1] > 0), 0.0, chi)
    return np.where((cls[:, 0] == 0) | (cls[:, 1] == 0), np.inf, chi)


def _merge(n_bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        counts = np.column_stack([pdf["n"] - pdf["bad"], pdf["bad"]]).astype(float)
        lows = pdf["lo"].to_numpy()
        while len(counts) > n_bins:
            i = int(np.argmin(_pair_chi2(counts[:-1], counts[1:])))
            counts[i] += counts[i + 1]
            counts = np.delete(counts, i + 1, axis=0)
            lows = np.delete(lows, i + 1)
        return pd.DataFrame({"feature": pdf["feature"].iloc[0], "cut": lows[1:]})

    return run


def _gini_gain(n: np.ndarray, bad: np.ndarray, min_leaf: float) -> tuple[float, int]:
    """Best weighted-impurity decrease and the first cell of the right side."""
    if len(n) < 2:
        return 0.0, -1
    left_n, left_b = np.cumsum(n)[:-1], np.cumsum(bad)[:-1]
    tot_n, tot_b = n.sum(), bad.sum()
    right_n, right_b = tot_n - left_n, tot_b - left_b

    def mass(k, b):
        return np.where(k > 0, 2 * b * (k - b) / np.maximum(k, 1e-300), 0.0)

    gain = mass(tot_n, tot_b) - mass(left_n, left_b) - mass(right_n, right_b)
    gain = np.where((left_n >= min_leaf) & (right_n >= min_leaf), gain, -1.0)
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def _split(n_bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n, bad = pdf["n"].to_numpy(float), pdf["bad"].to_numpy(float)
        min_leaf = max(1, int(n.sum() * MIN_LEAF_SHARE))
        leaves, starts = [(0, len(n))], set()
        while len(leaves) < n_bins:
            best = max(
                ((*_gini_gain(n[a:b], bad[a:b], min_leaf), a, b) for a, b in leaves), key=lambda t: t[0]
            )
            gain, at, a, b = best
            if gain <= 1e-12:
                break
            leaves.remove((a, b))
            leaves += [(a, a + at), (a + at, b)]
            starts.add(a + at)
        return pd.DataFrame({"feature": pdf["feature"].iloc[0], "cut": pdf["lo"].to_numpy()[sorted(starts)]})

    return run


def _supervised_cuts(df: DataFrame, features: Sequence[str], target: str, n_bins: int, step) -> Cuts:
    pairs = df.where(F.col(target).isNotNull())
    n = pairs.count()
    if n < 2 * n_bins:
        return rounded_thresholds(quantile_cuts(pairs, features, n_bins))
    cells, _ = _fine_cells(pairs, features, target)
    rows = cells.groupBy("feature").applyInPandas(step(n_bins), _CUT_SCHEMA).collect()
    out: Cuts = {f: [] for f in features}
    for r in rows:
        if r["cut"] is not None:
            out[r["feature"]].append(r["cut"])
    return rounded_thresholds(out)


def chi_merge_cuts(df: DataFrame, features: Sequence[str], target: str, n_bins: int = 10) -> Cuts:
    """Merge adjacent cells with the least chi-square until n_bins remain."""
    return _supervised_cuts(df, features, target, n_bins, _merge)


def tree_cuts(df: DataFrame, features: Sequence[str], target: str, n_bins: int = 10) -> Cuts:
    """Best-first gini splits up to n_bins leaves of at least 1% of the rows each."""
    return _supervised_cuts(df, features, target, n_bins, _split)
