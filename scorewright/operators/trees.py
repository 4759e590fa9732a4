"""Rules from decision trees.

Full-feature trees are grown level by level from (node, feature, bin) counts over
all rows, the bins cut at exact quantiles. Trees on many small variable
combinations are grown on binned cubes: every task counts the cells of a block of
combinations into dense arrays, batch by batch, and hands on its sums once, so no
row is multiplied by the number of combinations. Each cube, bounded by
bins ** n_vars cells, is split in ``applyInPandas``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.numeric import ratio
from scorewright.operators.binning import quantile_cuts, small_domains
from scorewright.operators.evaluate import weight_column
from scorewright.operators.histogram import binned_long, clean_double
from scorewright.operators.rules import BINARY_MARKERS

#: Bytes of the dense counts a task holds; combinations beyond it go to further blocks, each a scan of the bin codes.
CUBE_BYTES = 64 * 2**20


def threshold_text(t: float) -> str:
    """4 decimals without trailing zeros; 6 decimals for tiny values."""
    if t != 0 and abs(t) < 1e-4:
        return f"{t:.6f}"
    return f"{t:.4f}".rstrip("0").rstrip(".")


def _between(a: float, b: float) -> float:
    """A threshold between two neighbouring values, either of which may be infinite."""
    return a / 2 + b / 2 if math.isfinite(b - a) else a if math.isfinite(a) else min(b - 1, 0.0)


def tree_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> dict[str, list[float]]:
    """Candidate thresholds of every feature, from all rows: the middles between values where there are at most
    ``max_bins``, exact quantiles elsewhere. Rules print 4 decimals, so cells are cut at the printed value."""
    small = small_domains(df, features, max_bins)
    cuts = {f: [_between(a, b) for a, b in zip(v, v[1:])] for f, v in small.items()}
    cuts.update(quantile_cuts(df, [f for f in features if f not in small], max_bins))
    return {f: sorted({float(threshold_text(c)) for c in cuts[f] if math.isfinite(c)}) for f in features}


def _best_split(cells: pd.DataFrame, min_w: float) -> tuple[int, int] | None:
    """(feature, cut) of the largest Gini gain in one node; among equal ones the first feature and lowest cut."""
    top, at = 1e-9, None
    for fid, c in cells.groupby("fid"):
        c = c.sort_values("bin")
        w, b = c["w"].to_numpy(float).cumsum(), c["bad_w"].to_numpy(float).cumsum()

        def mass(tw, tb):
            return np.where(tw > 0, 2 * tb * (tw - tb) / np.maximum(tw, 1e-300), 0.0)

        gain = mass(w[-1:], b[-1:]) - mass(w[:-1], b[:-1]) - mass(w[-1] - w[:-1], b[-1] - b[:-1])
        gain = np.where((w[:-1] >= min_w) & (w[-1] - w[:-1] >= min_w), gain / w[-1], -1.0)
        for i, g in enumerate(gain):
            # sums of weights differ in their last digits from run to run
            if g > top * (1 + 1e-9):
                top, at = float(g), (int(fid), int(c["bin"].iloc[i]))
    return at


def tree_rules(
    df: DataFrame, features: Sequence[str], target: str, weight: Column | None = None, max_depth: int = 3,
    min_leaf_share: float = 0.02, all_nodes: bool = False, max_bins: int = 64,
) -> DataFrame:
    """Rules from one weighted tree over all features; rows with a missing value are left out.

    Each level is one scan: (node, feature, bin) counts over all rows, of which the driver takes every node's best split.
    No rows are sampled, so the thresholds do not depend on how the rows are partitioned.
    """
    w = F.lit(1.0) if weight is None else weight
    feats = list(features)
    rows = df.select(*[clean_double(f).alias(f) for f in feats], (F.col(target) == 1).alias("__y"), w.cast("double").alias("__w")).dropna()
    edges = tree_edges(rows, feats, max_bins)
    # an open node: its rule parts and the same as a row test
    nodes: list[tuple[tuple[str, ...], Column]] = [((), F.lit(True))]
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    bad_side: dict[tuple[str, ...], bool] = {}
    min_w = None
    for _ in range(max_depth):
        node = F.coalesce(*[F.when(test, F.lit(i)) for i, (_, test) in enumerate(nodes)])
        long = binned_long(rows.withColumn("__node", node).where("__node IS NOT NULL"), edges, [F.col("__node"), F.col("__y"), F.col("__w")], closed="right")
        bad = F.sum(F.when(F.col("__y"), F.col("__w")).otherwise(F.lit(0.0))).alias("bad_w")
        counted = long.groupBy("__node", "feature", "bin").agg(F.sum("__w").alias("w"), bad).collect()
        cells = pd.DataFrame([(r["__node"], feats.index(r["feature"]), r["bin"], r["w"], r["bad_w"]) for r in counted], columns=["node", "fid", "bin", "w", "bad_w"])
        if min_w is None:
            min_w = cells.loc[cells["fid"] == 0, "w"].sum() * min(min_leaf_share, 0.49) * (1 - 1e-9)
        nxt = []
        for i, (path, test) in enumerate(nodes):
            own = cells[cells["node"] == i]
            found = _best_split(own, min_w)
            if found is None:
                continue
            fid, cut = found
            f, t = feats[fid], edges[feats[fid]][cut]
            own, low = own[own["fid"] == fid], F.col(f"`{f}`") <= t
            children[path] = []
            for op, side, part in (("<=", low, own[own["bin"] <= cut]), (">", ~low, own[own["bin"] > cut])):
                child = (*path, f"({f} {op} {threshold_text(t)})")
                children[path].append(child)
                bad_side[child] = part["bad_w"].sum() * 2 > part["w"].sum()
                nxt.append((child, test & side))
        nodes = nxt
        if not nodes:
            break
    # two leaves of one parent that both lean to the same side are one leaf, as in Spark ML's trees
    for path in sorted(children, key=len, reverse=True):
        a, b = children[path]
        if a not in children and b not in children and bad_side[a] == bad_side[b]:
            del children[path]
    paths = [" & ".join(p) for p in _walk(children, ()) if p and (all_nodes or p not in children)]
    return df.sparkSession.createDataFrame([(" & ".join(feats), p) for p in dict.fromkeys(paths)], "used_var string, rule string")


def _walk(children: dict, path: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [path, *[p for c in children.get(path, ()) for p in _walk(children, c)]]


# ---------------------------------------------------------------- combination trees


def combos(features: Sequence[str], n_vars: int, max_onehot: int = 2, marker: str = "_is_") -> list[tuple[str, ...]]:
    return [c for c in combinations(features, n_vars) if sum(marker in f for f in c) <= max_onehot]


def binned_wide(df: DataFrame, cuts: dict[str, list[float]], target: str, weight: str | Column | None) -> DataFrame:
    """One bin-index column per feature with target and weight, nothing else."""
    from pyspark.ml.feature import Bucketizer

    from scorewright.operators.histogram import splits

    feats = list(cuts)
    base = df.select(*[clean_double(f).alias(f"x{i}") for i, f in enumerate(feats)],
                     (F.col(target) == 1).alias("bad"), weight_column(weight).alias("w"))
    live = [i for i, f in enumerate(feats) if cuts[f]]
    if live:
        base = Bucketizer(
            inputCols=[f"x{i}" for i in live], outputCols=[f"k{i}" for i in live],
            splitsArray=[splits(cuts[feats[i]], "right") for i in live], handleInvalid="keep",
        ).transform(base)
    bins = [
        F.when(F.col(f"x{i}").isNotNull(), F.col(f"k{i}").cast("int") if i in live else F.lit(0)).alias(f"b{i}")
        for i in range(len(feats))
    ]
    return base.select(*bins, "bad", "w")


def cube_blocks(sizes: Sequence[int], max_bytes: int | None = None) -> list[list[int]]:
    """Combinations, given by their cells, dealt to blocks whose three counts fit the bytes; a larger one is a block by itself."""
    room = CUBE_BYTES if max_bytes is None else max_bytes
    out: list[list[int]] = [[]]
    used = 0
    for c, size in enumerate(sizes):
        if out[-1] and used + 24 * size > room:
            out.append([])
            used = 0
        out[-1].append(c)
        used += 24 * size
    return out


def combination_cubes(
    df: DataFrame, cuts: dict[str, list[float]], sets: Sequence[tuple[str, ...]], target: str, weight: str | Column | None = None
) -> DataFrame:
    """(combo, cell) -> n, w, bad_w for every variable combination.

    A cell is one number, its bins written in base ``radix(cuts)``. A task adds up its
    rows in arrays of all cells of a block of combinations, so it hands on at most one
    row per cell, whatever its rows. Rows that miss one of a combination's values do
    not count in it. A column as ``weight`` gives class weights.
    """
    feats = list(cuts)
    pos, base = {f: i for i, f in enumerate(feats)}, radix(cuts)
    wide = binned_wide(df, cuts, target, weight)
    codes = wide.select(
        *[F.coalesce(F.col(f"b{i}"), F.lit(-1)).cast("int").alias(f"b{i}") for i in range(len(feats))],
        F.coalesce("w", F.lit(0.0)).alias("w"), F.when(F.col("bad"), F.coalesce("w", F.lit(0.0))).otherwise(F.lit(0.0)).alias("bad_w"),
    )

    def counter(block: list[int]):
        shapes = {c: tuple(len(cuts[f]) + 1 for f in sets[c]) for c in block}
        places = {c: [pos[f] for f in sets[c]] for c in block}
        powers = {c: np.array([base**j for j in range(len(sets[c]))], np.int64) for c in block}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {c: np.zeros((3, math.prod(shape))) for c, shape in shapes.items()}
            for batch in batches:
                bins = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(feats))]
                w, bad = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "bad_w"))
                for c, at in places.items():
                    known = np.logical_and.reduce([bins[i] >= 0 for i in at])
                    cell = np.ravel_multi_index([bins[i][known] for i in at], shapes[c])
                    for k, v in enumerate((None, w[known], bad[known])):
                        held[c][k] += np.bincount(cell, v, held[c].shape[1])
            for c, sums in held.items():
                full = np.flatnonzero(sums[0])
                cell = np.stack(np.unravel_index(full, shapes[c]), axis=1) @ powers[c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(full), c), pa.int32()), pa.array(cell, pa.int64()), pa.array(sums[0][full].astype(np.int64)), pa.array(sums[1][full]), pa.array(sums[2][full])],
                    ["combo", "cell", "n", "w", "bad_w"],
                )

        return run

    blocks = cube_blocks([math.prod(len(cuts[f]) + 1 for f in s) for s in sets])
    out = None
    for block in blocks:
        part = codes.mapInArrow(counter(block), "combo int, cell long, n long, w double, bad_w double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("combo", "cell").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("bad_w").alias("bad_w"))


def radix(cuts: dict[str, list[float]]) -> int:
    return max((len(c) for c in cuts.values()), default=0) + 1


def _cube_tree(sets, edges, max_depth: int, min_leaf_share: float):
    base = radix(edges)

    def best(cells: np.ndarray, n: np.ndarray, w: np.ndarray, b: np.ndarray, min_n: float):
        top = (1e-9, -1, -1)
        for v in range(cells.shape[1]):
            k = int(cells[:, v].max()) + 1
            cn, cw, cb = (np.bincount(cells[:, v], x, k).cumsum() for x in (n, w, b))
            ok = (cn[:-1] >= min_n) & (cn[-1] - cn[:-1] >= min_n)
            if not ok.any():
                continue

            def mass(tw, tb):
                return np.where(tw > 0, 2 * tb * (tw - tb) / np.maximum(tw, 1e-300), 0.0)

            gain = mass(cw[-1], cb[-1]) - mass(cw[:-1], cb[:-1]) - mass(cw[-1] - cw[:-1], cb[-1] - cb[:-1])
            gain = np.where(ok, gain, -1.0)
            i = int(gain.argmax())
            if gain[i] > top[0]:
                top = (float(gain[i]), v, i)
        return top

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sets[int(pdf["combo"].iloc[0])]
        code = pdf["cell"].to_numpy(dtype=np.int64)
        cells = np.column_stack([code // base**j % base for j in range(len(names))])
        n, w, b = (pdf[c].to_numpy(float) for c in ("n", "w", "bad_w"))
        min_n = max(1, int(n.sum() * min_leaf_share))
        rules: list[str] = []
        todo = [(np.arange(len(pdf)), [])]
        while todo:
            at, path = todo.pop()
            gain, v, cut = best(cells[at], n[at], w[at], b[at], min_n) if len(path) < max_depth else (0, -1, -1)
            if v < 0:
                if path:
                    rules.append(" & ".join(path))
                continue
            t = threshold_text(edges[names[v]][cut])
            left = cells[at, v] <= cut
            todo.append((at[left], [*path, f"({names[v]} <= {t})"]))
            todo.append((at[~left], [*path, f"({names[v]} > {t})"]))
        return pd.DataFrame({"used_var": " & ".join(names), "rule": rules}, columns=["used_var", "rule"])

    return run


def combination_tree_rules(
    df: DataFrame, features: Sequence[str], target: str, weight: str | Column | None = None, n_vars: int = 2, max_depth: int = 3,
    min_leaf_share: float = 0.02, n_bins: int = 20, max_onehot: int = 2,
) -> DataFrame:
    """Distinct leaf rules of one tree per variable combination. A column as ``weight`` gives class weights."""
    small = small_domains(df, features, n_bins)
    cuts = {f: v[:-1] for f, v in small.items()}
    cuts.update(quantile_cuts(df, [f for f in features if f not in small], n_bins))
    # thresholds are printed with 4 decimals, so cells are cut at the printed value
    cuts = {f: sorted({float(threshold_text(c)) for c in cuts[f]}) for f in features}
    sets = combos(features, n_vars, max_onehot)
    cubes = combination_cubes(df, cuts, sets, target, weight)
    rules = cubes.groupBy("combo").applyInPandas(
        _cube_tree(sets, cuts, max_depth, min_leaf_share), "used_var string, rule string"
    )
    return rules.dropDuplicates(["rule"])


# ---------------------------------------------------------------- directions


def rule_directions(
    df: DataFrame, features: Sequence[str], target: str, weight: str | Column | None = None, min_leaf_share: float = 0.02, max_depth: int = 3
) -> DataFrame:
    """Expected risk side per feature: var, cutoff, bad_rate, pct, lift, direction.

    Works on (feature, cell) counts: values for 0/1 and small integer features,
    quantile cells for the rest.
    """
    binary_named = [f for f in features if any(m in f for m in BINARY_MARKERS)]
    small = small_domains(df, features, 20)
    kinds: dict[str, str] = {}
    for f in features:
        v = small.get(f)
        if f in binary_named or (v is not None and set(v) <= {0.0, 1.0}):
            kinds[f] = "binary"
        elif v is not None and all(x == int(x) for x in v) and max(v) - min(v) <= 40:
            kinds[f] = "discrete"
        else:
            kinds[f] = "continuous"
    cuts = {f: (small.get(f) or [0.0, 1.0])[:-1] for f in features if kinds[f] != "continuous"}
    cuts.update(quantile_cuts(df, [f for f in features if kinds[f] == "continuous"], 100))
    kind = F.create_map(*[x for f, k in kinds.items() for x in (F.lit(f), F.lit(k))])
    long = binned_long(df, cuts, [weight_column(weight).alias("w"), (F.col(target) == 1).alias("bad")], closed="right")
    cells = long.where("bin IS NOT NULL").groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("w"))), F.lit(0.0)).alias("b"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax"),
    ).withColumn("kind", F.element_at(kind, F.col("feature")))
    total = df.agg(F.sum(weight_column(weight)).alias("w"), F.sum(F.when(F.col(target) == 1, weight_column(weight))).alias("b")).first()
    fn = _direction(total["w"], total["b"] / total["w"], min_leaf_share, max_depth)
    out = cells.groupBy("feature").applyInPandas(fn, "var string, cutoff string, bad_rate double, pct double, direction string")
    return out.withColumn("lift", ratio(F.col("bad_rate"), F.lit(total["b"] / total["w"])))


def _direction(all_w: float, base: float, min_leaf_share: float, max_depth: int):
    from scorewright.operators.supervised import _gini_gain

    def deepest(n, w, b, a, z, depth, min_n):
        """Splits whose node has a leaf child, as first right-hand cells."""
        if depth == max_depth or z - a < 2:
            return None
        cum = np.cumsum(n[a:z])[:-1]
        ok = (cum >= min_n) & (n[a:z].sum() - cum >= min_n)
        if not ok.any():
            return None
        gains = [(_gini_gain(np.array([w[a:a + i].sum(), w[a + i:z].sum()]), np.array([b[a:a + i].sum(), b[a + i:z].sum()]), 0)[0], i)
                 for i in range(1, z - a) if ok[i - 1]]
        gain, i = max(gains, key=lambda t: t[0])
        if gain <= 1e-9:
            return None
        left = deepest(n, w, b, a, a + i, depth + 1, min_n)
        right = deepest(n, w, b, a + i, z, depth + 1, min_n)
        return (left or set()) | (right or set()) | ({a + i} if left is None or right is None else set())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"var": [], "cutoff": [], "bad_rate": [], "pct": [], "direction": []})
        pdf = pdf.sort_values("bin")
        f, kind = pdf["feature"].iloc[0], pdf["kind"].iloc[0]
        n, w, b = (pdf[c].to_numpy(float) for c in ("n", "w", "b"))
        top = pdf["vmax"].to_numpy()
        low = pdf["vmin"].to_numpy()

        def row(cutoff, mask, side):
            hw = w[mask].sum()
            return pd.DataFrame([(f, cutoff, b[mask].sum() / hw if hw else 0.0, hw / all_w, side)], columns=list(empty.columns))

        if kind == "binary":
            return row("== 1", top == 1, "==")
        if len(w) < 2:
            return empty
        at = np.arange(len(w))
        if kind == "discrete":
            best = None
            for i in range(len(w) - 1):
                t = (top[i] + low[i + 1]) / 2
                for mask, cutoff, side in ((at <= i, f"(-inf, {t}]", "<="), (at > i, f"({t}, inf)", ">")):
                    lift = (b[mask].sum() / w[mask].sum()) / base if base else 0.0
                    if lift > (best[0] if best else 0.0):
                        best = (lift, cutoff, mask, side)
            return empty if best is None else row(best[1], best[2], best[3])
        found = deepest(n, w, b, 0, len(w), 0, max(1, n.sum() * min_leaf_share))
        if not found:
            return empty
        starts = [0, *sorted(found), len(w)]
        rates = [b[a:z].sum() / w[a:z].sum() for a, z in zip(starts, starts[1:])]
        k = int(np.argmax(rates))
        a, z = starts[k], starts[k + 1]
        if a == 0:
            return row(f"(-inf, {threshold_text((top[z - 1] + low[z]) / 2)}]", at < z, "<=")
        lo_text = threshold_text((top[a - 1] + low[a]) / 2)
        if z == len(w):
            return row(f"({lo_text}, inf)", at >= a, ">")
        up, down = b[a:].sum() / w[a:].sum(), b[:z].sum() / w[:z].sum()
        if up > down:
            return row(f"({lo_text}, inf)", at >= a, ">")
        return row(f"(-inf, {threshold_text((top[z - 1] + low[z]) / 2)}]", at < z, "<=")

    return run


# ---------------------------------------------------------------- node table


def node_statistics(df: DataFrame, paths: Sequence[str], target: str, weight: str | None = None, optimal: Sequence[str] = ()) -> DataFrame:
    """Rows, goods, bads and bad rate of every tree node given as rule text."""
    from scorewright.operators.evaluate import compound_rule_metrics

    metrics, _ = compound_rule_metrics(df, paths, target, weight)
    leaf = [not any(q != p and q.startswith(p + " & ") for q in paths) for p in paths]
    info = df.sparkSession.createDataFrame(
        [(p, len(p.split(" & ")), lf, p in set(optimal)) for p, lf in zip(paths, leaf)],
        "rule string, depth int, is_leaf boolean, in_optimal boolean",
    )
    return metrics.join(info, "rule").select(
        "rule", "depth", "is_leaf", "in_optimal", F.col("hit_n").alias("samples"), F.col("bad_w").alias("bad"),
        (F.col("hit_w") - F.col("bad_w")).alias("good"), ratio(F.col("bad_w"), F.col("hit_w")).alias("bad_rate"),
    )
