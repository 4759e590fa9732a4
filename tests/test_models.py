"""Correlation, logistic models, scorecards, curves, splits."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.operators import binning, correlation, curves, logit, scorecard, split, trees, validation
from scorewright.operators.evaluate import compound_rule_metrics
from scorewright.operators.rules import threshold_rules


@pytest.fixture(scope="module")
def woe_pdf():
    rng = np.random.default_rng(42)
    n = 5000
    y = (rng.random(n) < 0.1).astype(int)
    pdf = pd.DataFrame({
        "f1_woe": np.where(y, rng.normal(0.8, 0.3, n), rng.normal(0.3, 0.2, n)), "f2_woe": np.where(y, rng.normal(0.6, 0.2, n), rng.normal(0.2, 0.15, n)),
        "f3_woe": rng.normal(0.1, 0.1, n), "y": y, "w": rng.random(n) + 0.5,
    })
    return pdf.round({"f1_woe": 1, "f2_woe": 1, "f3_woe": 1})


@pytest.fixture(scope="module")
def woe(spark, woe_pdf):
    return spark.createDataFrame(woe_pdf).cache()


def newton(pdf, feats, w):
    x = np.column_stack([np.ones(len(pdf)), pdf[feats]])
    y, b = pdf["y"].to_numpy(), np.zeros(len(feats) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (w * p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, x.T @ (w * (y - p)))
    return b, np.sqrt(np.diag(np.linalg.inv(h))), float(np.sum(w * (y * np.log(p) + (1 - y) * np.log(1 - p))))


FEATS = ["f1_woe", "f2_woe", "f3_woe"]


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("group", [True, False])
def test_logit_matches_newton(woe, woe_pdf, weight, group):
    w = np.ones(len(woe_pdf)) if weight is None else woe_pdf[weight].to_numpy()
    b, se, ll = newton(woe_pdf, FEATS, w)
    design = logit.design_table(woe, FEATS, "y", F.col(weight) if weight else None, group).cache()
    fit = logit.fit_design(design, FEATS, with_info=True)
    np.testing.assert_allclose([fit.intercept, *fit.coef], b, rtol=1e-6)
    np.testing.assert_allclose([fit.intercept_stats[0], *fit.std_err], se, rtol=1e-5)
    assert fit.info["log_likelihood"] == pytest.approx(ll, rel=1e-5)
    assert fit.info["n_observations"] == len(woe_pdf)
    assert fit.info["pseudo_r2"] > 0 and fit.info["lr_pvalue"] < 0.05


def test_many_models_in_one_scan(woe, woe_pdf):
    design = logit.design_table(woe, FEATS, "y").cache()
    fits = logit.fit_many(design, [["f1_woe"], ["f2_woe", "f3_woe"]])
    for fit in fits:
        np.testing.assert_allclose([fit.intercept, *fit.coef], newton(woe_pdf, fit.features, np.ones(len(woe_pdf)))[0], rtol=1e-6)


def test_chi2_tail():
    for x, k, want in [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.0705, 5, 0.05), (23.209251, 10, 0.01), (0.0, 3, 1.0)]:
        assert logit.chi2_tail(x, k) == pytest.approx(want, rel=1e-5)


def test_balanced_weights_combine(woe, woe_pdf):
    w = logit.balanced_weight(woe, "y", "w")
    got = woe.withColumn("cw", w).groupBy("y").agg(F.sum("cw").alias("s")).collect()
    n, b = len(woe_pdf), woe_pdf["y"].sum()
    for r in got:
        k = b if r["y"] else n - b
        assert r["s"] == pytest.approx(n / (2 * k) * woe_pdf.loc[woe_pdf.y == r["y"], "w"].sum())


def test_stepwise_and_cleaning(woe):
    for direction in ("forward", "backward", "both"):
        chosen, _ = logit.stepwise(woe, FEATS, "y", direction)
        assert {"f1_woe", "f2_woe"} <= set(chosen)
    flipped = woe.withColumn("f4_woe", -F.col("f1_woe") + F.col("f3_woe") * 3)
    fit, log = logit.clean_model(flipped, [*FEATS, "f4_woe"], "y")
    assert all(c >= 0 for c in fit.coef) and all(p <= 0.05 for p in fit.p)
    assert len(log) < 20 and "const" not in [r[2] for r in log]


def test_pairwise_complete_correlations(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(800, 3)), columns=list("abc"))
    pdf["b"] = pdf["b"] + pdf["a"]
    pdf["c"] = pdf["c"].round(0)
    pdf.loc[::5, "a"] = np.nan
    pdf.loc[::7, "c"] = np.nan
    df = spark.createDataFrame(pdf)
    for method in ("pearson", "spearman"):
        got = {(r["feature1"], r["feature2"]): r["corr"] for r in correlation.correlation(df, list("abc"), method).collect()}
        for (a, b), v in got.items():
            pair = pdf[[a, b]].dropna()
            x, z = (pair[a], pair[b]) if method == "pearson" else (pair[a].rank(), pair[b].rank())
            assert v == pytest.approx(np.corrcoef(x, z)[0, 1], abs=1e-9)


def test_kendall_tau_b(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 6, 300)
    b = np.clip(a + rng.integers(-2, 3, 300), 0, 6)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    s = np.sign(a[:, None] - a[None]) * np.sign(b[:, None] - b[None])
    p = 300 * 299 / 2
    ta = sum(c * (c - 1) / 2 for c in np.bincount(a))
    tb = sum(c * (c - 1) / 2 for c in np.bincount(b))
    want = s.sum() / 2 / math.sqrt((p - ta) * (p - tb))
    assert correlation.kendall(df, ["a", "b"]).first()["corr"] == pytest.approx(want)


def test_kendall_of_many_values_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 1500
    a = rng.normal(size=n).round(3)
    a[::3] = 0.25  # one value fills many strips
    a[:2] = np.inf, -np.inf
    b = np.where(np.isfinite(a), a, 0) + rng.normal(size=n)
    pdf = pd.DataFrame({"a": a, "b": b, "c": rng.integers(0, 9, n) + (b > 1)})
    df = spark.createDataFrame(pdf).repartition(3)
    monkeypatch.setattr(correlation, "STRIP_ROWS", 40, raising=False)
    got = {(r["feature1"], r["feature2"]): r["corr"] for r in correlation.kendall(df, ["a", "b", "c"]).collect()}
    signs = {c: (v[:, None] > v[None]).astype(int) - (v[:, None] < v[None]) for c, v in ((c, pdf[c].to_numpy()) for c in pdf)}
    for (x, z), tau in got.items():
        want = (signs[x] * signs[z]).sum() / math.sqrt((signs[x] ** 2).sum() * (signs[z] ** 2).sum())
        assert tau == pytest.approx(want, abs=1e-12)


def test_concordance_of_heavy_points():
    n = 3_000_000_000
    up = np.arange(4.0)
    assert correlation._concordance(up, up, np.full(4, n)) == 6 * n * n
    assert correlation._concordance(up, -up, np.full(4, n)) == -6 * n * n
    rng = np.random.default_rng(3)
    a, b, m = rng.integers(0, 9, 50).astype(float), rng.integers(0, 9, 50).astype(float), rng.integers(1, 9, 50)
    assert correlation._concordance(a, b, m * n) == correlation._concordance(a, b, m) * n * n


def test_vif_and_elimination(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) + 1
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 0] + 0.01 * x[:, 2]})
    df = spark.createDataFrame(pdf)
    got = {r["feature"]: r["vif"] for r in correlation.vif(df, list("abc")).collect()}
    for f in "abc":
        rest = pdf[[c for c in "abc" if c != f]].to_numpy()
        beta, *_ = np.linalg.lstsq(rest, pdf[f], rcond=None)
        res = pdf[f] - rest @ beta
        assert got[f] == pytest.approx((pdf[f] ** 2).sum() / (res**2).sum(), rel=1e-6)
    kept, log = correlation.vif_elimination(df, list("abc"), 5.0)
    assert len(kept) == 2 and log[0][1] in ("a", "c")
    dup = df.withColumn("d", F.col("a"))
    assert math.isinf(max(r["vif"] for r in correlation.vif(dup, ["a", "d"]).collect()))


def test_vif_of_near_collinear_columns(spark):
    """Columns that differ by 1e-7 of their length have a finite VIF, and merging factors in several rounds keeps it."""
    rng = np.random.default_rng(5)
    a, e, other = rng.normal(size=(3, 4000)) + 1
    e -= a * (a @ e) / (a @ a)
    b = a + 1e-7 * e
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": other})).repartition(70)
    got = {r["feature"]: r["vif"] for r in correlation.vif(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx((a @ a) / (1e-14 * (e @ e)), rel=1e-5) and got["b"] == pytest.approx(got["a"], rel=1e-5)
    r = correlation.triangular_factor(df, ["a", "b", "c"])
    assert np.allclose(r.T @ r, np.stack([a, b, other]) @ np.stack([a, b, other]).T)


def test_vif_edges(spark):
    inf, nan = math.inf, math.nan
    rows = [(1.0, 2.0, 0.0, 3.0), (2.0, -1.0, 0.0, 1.0), (4.0, 1.0, 0.0, 5.0), (inf, 1.0, 0.0, 1.0), (nan, 1.0, 0.0, 1.0), (None, 9.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, z double, s double").withColumn("s", F.col("a") + F.col("b"))
    got = {r["feature"]: r["vif"] for r in correlation.vif(df, ["a", "b", "z", "s"]).collect()}
    assert all(math.isinf(v) for v in got.values())  # s = a + b, z is zero
    got = {r["feature"]: r["vif"] for r in correlation.vif(df, ["a", "b", "z"]).collect()}
    assert math.isinf(got["z"]) and got["a"] == pytest.approx(21 * 6 / (21 * 6 - 16)) == got["b"]
    assert [math.isinf(r["vif"]) for r in correlation.vif(df.where("a > 99 and a < 100"), ["a", "b"]).collect()] == [True, True]


@pytest.mark.parametrize(("name", "values", "separated"), [
    ("complete", [(-2, 0), (-1, 0), (1, 1), (3, 1)], True),
    ("touching", [(-2, 0), (0, 0), (0, 1), (3, 1)], True),
    ("reversed", [(-2, 1), (-1, 1), (1, 0), (3, 0)], True),
    ("one row over", [(-2, 0), (1.1, 0), (1, 1), (3, 1), (4, 1), (-5, 0)], False),
    ("one class", [(-2, 0), (1, 0), (3, 0)], True),
])
def test_separation(spark, name, values, separated):
    df = spark.createDataFrame([(float(x), y) for x, y in values], "x double, y int")
    for group in (True, False):
        fit = logit.fit_many(logit.design_table(df, ["x"], "y", group=group), [["x"]])[0]
        assert (fit.separated, fit.converged) == (separated, not separated) and 0 < fit.scans <= 40


def test_separation_by_two_features_only_together(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    y = (x @ [1, -2] > 0.3).astype(int)
    noisy = np.where(rng.random(400) < 0.05, 1 - y, y)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": 1000 * x[:, 1], "y": y, "z": noisy}))
    alone, both = logit.fit_many(logit.design_table(df, ["a", "b"], "y"), [["a"], ["a", "b"]])
    assert alone.converged and not alone.separated and both.separated and not both.converged and both.scans < 40
    plain = logit.fit_many(logit.design_table(df, ["a", "b"], "z"), [["a", "b"]])[0]
    assert plain.converged and not plain.separated
    report = logit.fit_report(df, [alone, both]).collect()
    assert [(r["model"], r["separated"]) for r in report] == [("a", False), ("a + b", True)]


def test_correlation_filter_keep_modes(spark):
    corr = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("a", "c", 0.1)], "feature1 string, feature2 string, corr double")
    assert correlation.correlation_drops(corr) == ["b", "c"]
    assert set(correlation.correlation_drops(corr, keep="none")) == {"a", "b", "c"}


# ---------------------------------------------------------------- scorecard


def test_score_round_trip(spark):
    s = scorecard.Scale.from_bad_rate(0.1, 600, 20)
    df = spark.createDataFrame([(p,) for p in (0.01, 0.1, 0.3, 0.7)], "p double")
    got = df.select("p", s.score(F.col("p")).alias("s")).withColumn("back", s.probability(F.col("s"))).collect()
    for r in got:
        assert r["back"] == pytest.approx(r["p"])
    assert got[1]["s"] == pytest.approx(600) and got[0]["s"] > got[3]["s"]
    assert scorecard.Scale.from_bad_rate(0.1).low == 300


def test_ratings(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 549.99, 550, 649, 700, 800, 850)], "s double")
    got = [r[0] for r in df.select(scorecard.rating(F.col("s"))).collect()]
    assert got == ["D", "D", "C", "B", "BBB", "AA", "AA"]


def test_card_adds_up(spark, woe_pdf):
    df = spark.createDataFrame(woe_pdf.rename(columns={"f1_woe": "f1", "f2_woe": "f2"}))
    bins = binning.fit_woe(df, "y", ["f1", "f2"], 4)
    card, base = scorecard.card_points(bins, {"f1": 0.8, "f2": 1.1}, -2.0, 600, 20, 20)
    total = scorecard.apply_card(df, card, base, ["f1", "f2"])
    w = binning.woe_columns(df, bins, ["f1", "f2"])
    a, b = scorecard.card_scale(600, 20, 20)
    want = w.select((a - b * (-2.0 + 0.8 * F.col("f1_woe") + 1.1 * F.col("f2_woe"))).alias("s")).agg(F.sum("s")).first()[0]
    assert total.agg(F.sum("score")).first()[0] == pytest.approx(want, rel=1e-4)
    lo, hi = scorecard.card_range(card, base).first()
    seen = total.agg(F.min("score"), F.max("score")).first()
    assert lo - 0.05 <= seen[0] and seen[1] <= hi + 0.05


@pytest.mark.parametrize("hot", [False, True])
def test_auc_ks_brute_force(spark, hot):
    rng = np.random.default_rng(3)
    n = 1500
    y = (rng.random(n) < 0.2).astype(int)
    s = np.round(rng.normal(y * 0.8, 1, n), 1)
    if hot:
        s[: n // 3] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    d = curves.discrimination(df, "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ks = max((pos >= t).mean() - (neg >= t).mean() for t in np.unique(s))
    assert d["auc"] == pytest.approx(auc) and d["ks"] == pytest.approx(ks) and d["gini"] == pytest.approx(2 * auc - 1)
    flipped = df.withColumn("s", -F.col("s"))
    assert curves.discrimination(flipped, "s", "y", higher_is_bad=False).first()["auc"] == pytest.approx(auc)


def test_bands(spark):
    assert [curves.nice_width(v) for v in (0, 300, 410, 90, 5000)] == [10.0, 25.0, 50.0, 10.0, 500.0]
    df = spark.createDataFrame([(300.0 + i, int(i % 7 == 0)) for i in range(400)], "s double, y int")
    for m in ("equal_frequency", "equal_width"):
        b = curves.score_bands(df, "s", "y", m).toPandas().sort_values("bin")
        assert b["n"].sum() == 400 and b["bad"].sum() == df.where("y = 1").count()
        assert b["cum_bad_pct"].iloc[-1] == pytest.approx(100) and b["cum_bad_pct"].is_monotonic_increasing
    one = spark.createDataFrame([(500.0, 1), (500.0, 0)], "s double, y int")
    assert curves.score_bands(one, "s", "y").agg(F.sum("n")).first()[0] == 2


def test_card_verdict():
    assert validation.card_verdict("excellent", 0.45, 0.82, 0.05)["quality_score"] == 100
    v = validation.card_verdict("warning", 0.1, 0.55, 0.3)
    assert v["quality_score"] == 40 * 0.3 + 30 * 0.3 + 30 * 0.4 and v["status"] == "warning"
    assert validation.card_verdict("good", None, None, None)["quality_score"] == 20 + 24 + 15


# ---------------------------------------------------------------- splits


def test_time_split_sizes_with_hot_day(spark):
    rows = [(i, "2024-01-02" if i % 3 == 0 else f"2024-01-{1 + i % 28:02d}", int(i % 9 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, d string, y int").withColumn("d", F.to_timestamp("d"))
    s = split.time_split(df, "y", "d", ["id"], 0.25, 0.3).cache()
    n = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n["oot"] == 750 and sum(n.values()) == 3000
    rest = s.where("split <> 'oot'")
    want = sum(int(r["n"] * 0.3) for r in rest.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect())
    assert n["test"] == want
    newest_train = rest.agg(F.max("d")).first()[0]
    assert s.where("split = 'oot'").agg(F.min("d")).first()[0] >= newest_train
    again = split.time_split(df.repartition(7), "y", "d", ["id"], 0.25, 0.3)
    assert again.join(s.withColumnRenamed("split", "s2"), ["id"]).where("split <> s2").count() == 0


def test_text_time_column(spark):
    df = spark.createDataFrame([(i, f"{1 + i % 28:02d}/03/2024", i % 2) for i in range(200)], "id long, d string, y int")
    s = split.time_split(df, "y", "d", ["id"], 0.1)
    assert s.where("split = 'oot'").count() == 20


def test_label_split(spark):
    df = spark.createDataFrame([(i, "Train " if i % 5 else "VAL", i % 2) for i in range(100)], "id long, s string, y int")
    out = split.split_data(df, "y", ["id"], label="s", test_ratio=0.25)
    n = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"oot": 20, "test": 20, "train": 60}
    with pytest.raises(ValueError):
        split.split_data(df.withColumn("s", F.lit("test")), "y", ["id"], label="s")


# ---------------------------------------------------------------- trees


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    n = 4000
    a, b, c = rng.random(n) * 100, rng.random(n) * 10, rng.random(n)
    y = ((a > 60) & (b <= 3)) ^ (rng.random(n) < 0.02)
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "c_is_x": (c > 0.5).astype(float), "y": y.astype(int)})).cache()


def test_tree_rules_partition_rows(planted):
    found = [r["rule"] for r in trees.tree_rules(planted, ["a", "b", "c"], "y").collect()]
    m = compound_rule_metrics(planted, found, "y")[0]
    assert m.agg(F.sum("hit_n")).first()[0] == planted.count()
    assert m.agg(F.max("bad_rate")).first()[0] > 0.9


def test_tree_candidates_come_from_all_rows(spark):
    n = 50_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"), (F.col("id") % 3).alias("z"))
    edge = float(np.quantile(np.arange(n), 39 / 64))
    df = df.withColumn("y", (F.col("x") > edge).cast("int"))
    t = trees.threshold_text(edge)
    for parts in (1, 7):
        found = [r["rule"] for r in trees.tree_rules(df.repartition(parts), ["z", "x"], "y").collect()]
        assert found == [f"(x <= {t})", f"(x > {t})"]


def test_combination_trees(planted):
    assert len(trees.combos(["a", "b", "x_is_1", "x_is_2", "x_is_3"], 3)) == 9
    found = trees.combination_tree_rules(planted, ["a", "b", "c"], "y", n_vars=2).collect()
    assert {r["used_var"] for r in found} == {"a & b", "a & c", "b & c"}
    m = compound_rule_metrics(planted, [r["rule"] for r in found if r["used_var"] == "a & b"], "y")[0]
    assert m.agg(F.sum("hit_n")).first()[0] == planted.count()
    assert m.agg(F.max("bad_rate")).first()[0] > 0.85
    # any number of blocks gives the same cubes
    cuts = {"a": [20.0, 60.0], "b": [3.0], "c": [0.5]}
    sets = trees.combos(["a", "b", "c"], 2)
    one = sorted(map(tuple, trees.combination_cubes(planted, cuts, sets, "y").collect()))
    before, trees.CUBE_BYTES = trees.CUBE_BYTES, 100
    two = sorted(map(tuple, trees.combination_cubes(planted, cuts, sets, "y").collect()))
    trees.CUBE_BYTES = before
    assert one == two and sum(r[2] for r in one if r[0] == 0) == 4000
    assert trees.cube_blocks([4, 4, 100, 1], 200) == [[0, 1], [2], [3]]


def test_cubes_equal_plain_counts(spark):
    rng = np.random.default_rng(4)
    rows = [(*[None if r < 0.1 else float(int(r * 30)) for r in rng.random(12)], int(rng.random() < 0.2), float(rng.random())) for _ in range(500)]
    feats = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join([*[f"{f} double" for f in feats], "y int", "w double"])).repartition(5)
    cuts = {f: [5.0, 11.0, 20.0] if i % 3 else [] for i, f in enumerate(feats)}
    sets = trees.combos(feats, 3)
    weight = F.when(F.col("y") == 1, 4.0).otherwise(1.0) * F.col("w")
    got = {(r.combo, r.cell): (r.n, r.w, r.bad_w) for r in trees.combination_cubes(df, cuts, sets, "y", weight).collect()}
    want = {}
    for r in rows:
        code = [None if x is None else int(np.searchsorted(cuts[f], x)) for f, x in zip(feats, r, strict=False)]
        w = r[-1] * (4.0 if r[-2] else 1.0)
        for c, s in enumerate(sets):
            own = [code[feats.index(f)] for f in s]
            if None not in own:
                cell = sum(b * trees.radix(cuts) ** j for j, b in enumerate(own))
                n, a, b = want.get((c, cell), (0, 0.0, 0.0))
                want[c, cell] = (n + 1, a + w, b + w * r[-2])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_combination_trees_of_forty_features(spark):
    df = spark.range(3000).select(*[((F.hash("id", F.lit(i)) % 100) / 10.0).alias(f"f{i}") for i in range(40)], "id")
    df = df.withColumn("y", ((F.col("f3") > 2) & (F.col("f7") <= 1)).cast("int"))
    found = trees.combination_tree_rules(df, [f"f{i}" for i in range(40)], "y", n_vars=2, min_leaf_share=0.01)
    assert found.select("used_var").distinct().count() > 700
    m = compound_rule_metrics(df, [r.rule for r in found.where("used_var = 'f3 & f7'").collect()], "y")[0]
    assert m.agg(F.max("bad_rate")).first()[0] > 0.9


def test_directions(planted):
    d = {r["var"]: r for r in trees.rule_directions(planted, ["a", "b", "c_is_x"], "y").collect()}
    assert d["a"]["direction"] == ">" and d["b"]["direction"] == "<=" and d["c_is_x"]["direction"] == "=="


def test_node_statistics(planted):
    paths = ["(a <= 60)", "(a > 60)", "(a > 60) & (b <= 3)", "(a > 60) & (b > 3)"]
    t = {r["rule"]: r for r in trees.node_statistics(planted, paths, "y", optimal=paths[2:3]).collect()}
    assert not t["(a > 60)"]["is_leaf"] and t["(a > 60) & (b <= 3)"]["in_optimal"]
    assert t["(a > 60)"]["samples"] == t[paths[2]]["samples"] + t[paths[3]]["samples"]


def test_threshold_rules_binary(spark):
    r = threshold_rules(spark, {"flag": [1.0], "x": [2.0, 2.5]}, ["flag"]).collect()
    assert [x["rule"] for x in r] == ["(flag == 1)", "(x <= 2)", "(x > 2)", "(x <= 2.5)", "(x > 2.5)"]


def test_no_task_aggregates_all_partitions_of_the_design(spark):
    """The grouped design ends in few partitions by a shuffle; coalesce would hand every partition's table to one task."""
    df = spark.range(2000).select((F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    design = logit.design_table(df, ["a", "b"], "y")
    assert "Coalesce" not in design._jdf.queryExecution().sparkPlan().toString()
    assert design.rdd.getNumPartitions() == 1
    assert {r["n"] for r in design.collect()} <= {57, 58} and design.agg(F.sum("n"), F.count("*")).first() == (2000, 35)


def test_counted_distinct_rows_stand_for_all_rows(spark):
    """Correlation, VIF and signs of binned columns need one grouped scan; missing values keep their rows."""
    df = spark.range(3000).select(
        (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") % 5 + F.col("id") % 7).cast("double").alias("b"),
        (F.col("id") % 3 + F.col("id") % 2).cast("double").alias("c"), ((F.col("id") * 13) % 17 < F.col("id") % 7 + 3).cast("int").alias("y"),
    )
    cols, n = ["a", "b", "c"], correlation.ROWS
    few = correlation.distinct_rows(df, [*cols, "y"]).cache()
    assert few.count() < 600 and few.agg(F.sum(n)).first()[0] == 3000
    pairs = {(r["feature1"], r["feature2"]): r["corr"] for r in correlation.correlation(df, cols).collect()}
    assert pairs == pytest.approx({(r["feature1"], r["feature2"]): r["corr"] for r in correlation.correlation(few, cols, count=n).collect()})
    assert [r["vif"] for r in correlation.vif(few, cols, n).collect()] == pytest.approx([r["vif"] for r in correlation.vif(df, cols).collect()])
    want = {r["feature"]: r["coef"] for r in logit.coefficient_signs(df, cols, "y")[1].collect()}
    assert {r["feature"]: r["coef"] for r in logit.coefficient_signs(few, cols, "y", weight=n)[1].collect()} == pytest.approx(want)
