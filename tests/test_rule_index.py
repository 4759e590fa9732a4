"""Rules as trees and their evaluation in one scan, against each rule's own expression."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.functions.rule_expr import Leaf, RuleError, rule_column, rule_tree
from scorewright.operators import evaluate, stability
from scorewright.operators.rule_index import rule_sums

SCHEMA = "a int, b double, c string, d long, e decimal(12,2), t date, `REG AIR` double, `x-1.y` int, w double, y int, g string"
PARTS = [
    "(a <= 3)", "(a > 2)", "(a != 1)", "(b >= 0.5)", "(b < -1)", "(b == 0)", "(c == 'x')", "(c != \"y\")", "(c.isin(['x', 'z']))", "(c < 'y')", "(a.isin([1, 2, 2.5]))",
    "(d == 9007199254740993)", "(d > 9007199254740992)", "(d <= 2.5)", "(e > 1.25)", "(e == 2)", "(t >= '2024-01-03')", "(a > d)", "(REG AIR > 0.5)", "(x-1.y == 1)", "(a.isin([]))", "(b > a)",
]


def rows(n=400):
    r = random.Random(1)
    pick = lambda *x: r.choice([None, *x])
    day = datetime.date(2024, 1, 1)
    return [
        (
            pick(0, 1, 2, 3, 4), pick(0.0, -0.0, 0.5, -2.0, float("nan"), float("inf"), 3.25), pick("x", "y", "z", ""), pick(1, 2, 3, 2**53 + 1, 2**53), pick(1, 2, 3),
            pick(day, day + datetime.timedelta(2)), pick(0.0, 1.0), pick(0, 1), pick(0.5, 1.0, 2.0), r.choice([0, 1, None]), pick("train", "test"),
        )
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def df(spark):
    from decimal import Decimal

    given_rows = [(*x[:4], None if x[4] is None else Decimal(x[4]) + Decimal("0.25") * (x[4] % 2), *x[5:]) for x in rows()]
    return spark.createDataFrame(given_rows, SCHEMA).repartition(3)


def long_list():
    r = random.Random(2)
    out = list(PARTS)
    while len(out) < 520:
        a, b, c = r.sample(PARTS, 3)
        out.append(r.choice([f"{a} & {b}", f"{a} | {b} & {c}", f"~({a} | {b}) & {c}", f"({a} & ~{b}) | {c}", f"~~{a}"]))
    return out


def test_many_rules_equal_their_expressions(df):
    rules = [*long_list(), "(nope > 1)", "(a > )", "(a > 1) (b > 1)"]
    sums, index = rule_sums(df, rules, {"w": F.col("w"), "bad": F.when(F.col("y") == 1, F.col("w"))}, "g")
    assert index.names == rules[:-3] and len(index.bad) == 3
    got = {(r.pos, r.g): (r.n, r.w, r.bad) for r in sums.collect()}
    plain = df.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(F.when(rule_column(x, df.columns), v)).alias(f"{k}{i}") for i, x in enumerate(index.names) for k, f, v in (("n", F.count, F.lit(1)), ("w", F.sum, F.col("w")), ("b", F.sum, F.when(F.col("y") == 1, F.col("w"))))],
    )
    want = {}
    for r in plain.collect():
        want[-1, r.g] = r.n
        for i in range(len(index.names)):
            if r[f"n{i}"]:
                want[i, r.g] = (r[f"n{i}"], r[f"w{i}"] or 0.0, r[f"b{i}"] or 0.0)
    assert {k: v[0] for k, v in got.items() if k[0] == -1} == {k: v for k, v in want.items() if k[0] == -1}
    assert {k: v for k, v in got.items() if k[0] >= 0} == {k: v for k, v in want.items() if k[0] >= 0}


def test_500_rules_scan_the_table_once(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    metrics, _ = evaluate.compound_rule_metrics(table, long_list()[:500], "y", "w")
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and metrics.count() == 500
    rates = stability.hit_rates_by(table, long_list()[:500], "g")
    assert rates.count() == 1500


def test_no_rows_and_no_rules(df):
    out, bad = evaluate.compound_rule_metrics(df.where("a > 99"), ["(a > 1)"], "y")
    assert [(r.hit_n, r.recall) for r in out.collect()] == [(0, 0.0)] and bad == []
    assert evaluate.compound_rule_metrics(df, [], "y")[0].collect() == []


def test_tree():
    a, b, c = Leaf("a", ">", (1,)), Leaf("b", "==", ("x (y) & z",)), Leaf("REG AIR", "<=", (0.5,))
    cols = ["a", "b", "REG AIR", "REG"]
    assert rule_tree("a > 1 | b == 'x (y) & z' & ~REG AIR <= 0.5", cols) == ("or", a, ("and", b, ("not", c)))
    assert rule_tree("((a > 1) & (b == 'x (y) & z')) & (REG AIR <= 0.5)", cols) == ("and", a, b, c)
    for wrong in ("", "()", "(a > 1", "a > 1)", "a > 1 &", "& a > 1", "~", "a > 1 b == 'x'", "(a > 1) ~ (a > 1)", "q > 1", "a > 1 ; a > 2", "a.isin([b])"):
        with pytest.raises(RuleError):
            rule_tree(wrong, cols)


@given(st.recursive(st.sampled_from(["a > 1", "b <= 2"]), lambda x: st.one_of(x.map("~({})".format), st.tuples(x, st.sampled_from("&|"), x).map(lambda p: f"({p[0]}) {p[1]} ({p[2]})")), max_leaves=12))
@settings(max_examples=200, deadline=None)
def test_trees_mean_what_python_means(rule):
    def value(tree, row):
        if isinstance(tree, Leaf):
            return row["a"] > 1 if tree.column == "a" else row["b"] <= 2
        parts = [value(t, row) for t in tree[1:]]
        return not parts[0] if tree[0] == "not" else all(parts) if tree[0] == "and" else any(parts)

    for a in (1, 2):
        for b in (2, 3):
            plain = rule.replace("a > 1", str(a > 1)).replace("b <= 2", str(b <= 2)).replace("~", " not ").replace("&", " and ").replace("|", " or ")
            assert value(rule_tree(rule, ["a", "b"]), {"a": a, "b": b}) == eval(plain)
