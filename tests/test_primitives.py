"""Histogram, quantile, running-total and selection primitives against numpy/pandas."""

import datetime
import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.operators.binning import small_domains, weighted_iv, woe_columns, woe_table
from scorewright.operators.histogram import binned_long, histogram, splits
from scorewright.operators.ordering import average_ranks, running_totals, with_ranks
from scorewright.operators import quantiles as quantiles_module
from scorewright.operators.quantiles import RowOrder, order_statistics, quantiles


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(42)
    n = 6000
    x = rng.lognormal(9, 2, n)
    hot = np.where(rng.random(n) < 0.35, 7.0, rng.normal(0, 1, n))  # one value holds a third of the rows
    ints = rng.integers(-50, 50, n).astype(float)
    big = np.where(rng.random(n) < 0.01, 1e15, rng.random(n))
    pdf = pd.DataFrame({"x": x, "hot": hot, "ints": ints, "big": big, "y": rng.integers(0, 2, n), "w": rng.random(n) + 0.5})
    pdf.loc[::17, "x"] = np.nan
    return pdf


def test_splits_sides():
    assert splits([1.0, 2.0]) == [-math.inf, 1.0, 2.0, math.inf]
    right = splits([1.0], "right")
    assert right[1] > 1.0 and right[1] == math.nextafter(1.0, math.inf)


@pytest.mark.parametrize("closed", ["left", "right"])
def test_bins_match_pandas_cut(spark, numbers, closed):
    cuts = {"ints": [-10.0, 0.0, 13.0], "x": [1000.0, 9000.0]}
    df = spark.createDataFrame(numbers)
    got = {(r["feature"], r["bin"]): r["n"] for r in histogram(df, cuts).collect()}
    if closed == "right":
        got = {(r["feature"], r["bin"]): r["n"] for r in histogram(df, cuts, closed="right").collect()}
    for f, cs in cuts.items():
        want = pd.cut(numbers[f], [-np.inf, *cs, np.inf], right=closed == "right", labels=False).value_counts()
        for b, n in want.items():
            assert got[(f, int(b))] == n
    missing = binned_long(df, {"x": [0.0]}).where("bin IS NULL").count()
    assert missing == numbers["x"].isna().sum()


@pytest.mark.parametrize("buffer_rows", [0, 10**9])
def test_quantiles_exact_both_ways(spark, numbers, buffer_rows):
    df = spark.createDataFrame(numbers)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, ["x", "hot", "ints", "big"], probs, buffer_rows=buffer_rows)
    for c, q in got.items():
        want = np.quantile(numbers[c].dropna(), probs)
        np.testing.assert_allclose(q, want, rtol=1e-12, err_msg=c)


@pytest.mark.parametrize("finish_rows", [0, 100, 10**9])
def test_order_statistics(spark, numbers, finish_rows):
    df = spark.createDataFrame(numbers)
    for c in ("x", "hot", "big"):
        v = np.sort(numbers[c].dropna())
        ranks = [0, 1, len(v) // 3, len(v) - 1]
        got = order_statistics(df, {c: ranks}, resolution=16, finish_rows=finish_rows)[c]
        assert got == {r: v[r] for r in ranks}


def test_quantiles_of_empty_and_constant(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    for rows in (0, 100):
        got = quantiles(df, ["a", "b"], [0.0, 0.5, 1.0], buffer_rows=rows)
        assert got["a"] == [1.0, 1.0, 1.0]
        assert got["b"] in ([None] * 3, None)


@pytest.mark.parametrize("buffer_rows", [0, 10**9])
def test_quantiles_with_infinities(spark, buffer_rows):
    inf = math.inf
    pdf = pd.DataFrame({"one": [inf, *range(40)], "both": [-inf] * 3 + list(range(30)) + [inf] * 8, "all": [inf] * 41, "ends": [-inf] * 20 + [inf] * 21}).astype(float)
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.01, 0.25, 0.5, 0.7, 0.99, 1.0]
    got = quantiles(df, list(pdf), probs, buffer_rows=buffer_rows)
    for c, q in got.items():
        v = np.sort(pdf[c])
        at = [p * (len(v) - 1) for p in probs]
        for x, p in zip(q, at):
            a, b = v[math.floor(p)], v[math.ceil(p)]
            if np.isfinite([a, b]).all():
                assert x == pytest.approx(a + (b - a) * (p - math.floor(p)), rel=1e-12)
            else:
                assert x == (a if a == b or np.isinf(a) else b)
    assert quantiles(df, ["ends"], [19.5 / 40], buffer_rows=buffer_rows) == {"ends": [None]}
    assert order_statistics(df, {"both": [0, 2, 3, 32, 33, 40]})["both"] == {0: -inf, 2: -inf, 3: 0.0, 32: 29.0, 33: inf, 40: inf}


def test_kth_row_with_hot_tie(spark):
    rows = [(5 if i % 3 else 4, i % 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "t long, a long, b long")
    order = sorted(rows)
    by = RowOrder(df, ["t", "a", "b"])
    for k in (0, 999, 1500, 2999):
        key = by.kth(k)
        assert tuple(order[k][: len(key)]) == key
        n = df.where(by.at_or_after(key)).count()
        assert n == 3000 - k


@pytest.mark.parametrize("range_rows", [10**6, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_ranges(spark, numbers, range_rows, descending):
    df = spark.createDataFrame(numbers[["ints", "hot", "y"]].assign(g=lambda d: (d["ints"] > 0).astype(int)))
    table = df.groupBy("g", F.col("hot").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b"))
    got = running_totals(table, "k", ["n", "b"], ["g"], descending, range_rows).toPandas()
    pdf = got.sort_values("k", ascending=not descending)
    for m in ("n", "b"):
        want = pdf.groupby("g")[m].cumsum() - pdf[m]
        assert (pdf[f"before_{m}"] == want).all()
    assert len(got) == table.count()


def test_average_ranks_and_hot_join(spark, numbers):
    df = spark.createDataFrame(numbers[["hot"]])
    want = numbers["hot"].rank()
    got = average_ranks(df, "hot", range_rows=50).toPandas().set_index("value")["avg_rank"]
    pd.testing.assert_series_equal(numbers["hot"].map(got), want, check_names=False)
    split = with_ranks(df, "hot", broadcast_rows=0, hot_share=0.01).toPandas()
    assert len(split) == len(numbers)
    assert split["hot__rank"].sum() == pytest.approx(want.sum())
    assert split.loc[split["hot"] == 7.0, "hot__rank"].nunique() == 1


def test_small_domains(spark, numbers):
    df = spark.createDataFrame(numbers)
    got = small_domains(df, ["y", "ints", "x"], 5)
    assert got == {"y": [0.0, 1.0]}


def test_woe_invariants(spark, numbers):
    df = spark.createDataFrame(numbers)
    bins = woe_table(df, "y", {"x": [500.0, 8000.0], "ints": [0.0]}).cache()
    pdf = bins.toPandas()
    assert pdf[pdf.feature == "x"]["n"].sum() == numbers["x"].notna().sum()
    assert (pdf.groupby("feature")["iv"].sum() >= 0).all()
    out = woe_columns(df, bins, ["x"]).where("x IS NULL OR isnan(x)").select("x_woe").distinct().collect()
    assert [r[0] for r in out] == [0.0]  # missing rows get WOE 0


def test_weighted_iv_zero_share_floor(spark):
    rows = [(v, int(v == 3), 1.0) for v in [1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 3.0]]
    df = spark.createDataFrame(rows, "x double, y int, w double")
    iv = weighted_iv(df, "y", "w", ["x"], 10).first()["iv"]
    want = (1e-4 - 0.5) * math.log(1e-4 / 0.5) * 2 + (1 - 1e-4) * math.log(1 / 1e-4)
    assert iv == pytest.approx(want)


_BIG = 2**60
ORDERED = {
    "text": (["", "a", "a\0", "ab", "abcdefé", "abcdefgh", "abcdefgh" * 3, "é", "z", "😀", None], "string"),
    "long": ([0, -5, _BIG, _BIG + 1, _BIG + 2, -_BIG - 1, 2**63 - 1, -(2**63), None], "long"),
    "decimal": ([Decimal("1.00"), Decimal("-3.25"), Decimal(10**20) + Decimal("0.25"), Decimal(10**20), Decimal(10**20) + Decimal("0.50"), None], "decimal(30,2)"),
    "double": ([0.5, -math.inf, math.inf, math.nan, -2.0, 1e300, None], "double"),
    "day": ([datetime.date(2024, 1, 5), datetime.date(1960, 1, 1), None], "date"),
}


@pytest.mark.parametrize("kind", list(ORDERED))
def test_rows_by_keys_of_any_type(spark, monkeypatch, kind):
    """Every rank against a plain sort, with and without the bounded top-k; ties fall to the second, text key."""
    values, of = ORDERED[kind]
    rows = [(v, t) for v in values for t in ("row1-same-prefix", "row1-same-prefiy", "row1", None)]
    df = spark.createDataFrame(rows, f"x {of}, t string").coalesce(1)

    def first_missing(v):
        if v is None or v != v:
            return (0, 0)
        return (1, v.encode() if isinstance(v, str) else v)

    plain = sorted(rows, key=lambda r: (first_missing(r[0]), first_missing(r[1])))
    order = RowOrder(df, ["x", "t"])
    for take in (quantiles_module.TAKE_ROWS, 0):
        monkeypatch.setattr(quantiles_module, "TAKE_ROWS", take)
        for k in range(0, len(rows), 9 if take else 21):
            key = order.kth(k)
            same = [r for r in plain if (first_missing(r[0]), first_missing(r[1])) < (first_missing(plain[k][0]), first_missing(plain[k][1]))]
            assert df.where(~order.at_or_after(key)).count() == len(same), (k, key)
        assert order.kth(len(rows)) is None
    assert RowOrder(df.where("t = 'none'"), ["x", "t"]).kth(0) is None
    with pytest.raises(TypeError):
        RowOrder(spark.createDataFrame([([1],)], "a array<int>"), ["a"])
