"""Every registered query against its SQL twin, and plan checks."""

import hashlib
from pathlib import Path

import duckdb
import pytest

from scorewright.plans.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(repr(r[i]) for i in order) for r in rows)).encode()).hexdigest()


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    cur = con.execute(ORACLE[name])
    cols, want = [d[0] for d in cur.description], None
    want = cur.fetchall()
    assert sorted(cols) == sorted(df.columns) and len(rows) == len(want)
    assert digest(df.columns, rows) == digest(cols, want)


PLANNED = [
    "woe_bins", "iv_table", "threshold_rule_metrics", "compound_rule_metrics", "rule_overlap", "rule_psi", "ks_auc_gini", "apply_scorecard", "out_of_time_split",
    "feature_csi", "chi_square", "co_membership", "channel_health_batch", "missing_report",
]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_cross_joins_and_prune_columns(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    if name in ("woe_bins", "iv_table", "threshold_rule_metrics"):
        assert "l_returnflag" not in text.split("ReadSchema:")[-1].split("\n")[0]


def test_split_needs_no_shuffle(spark):
    plan = QUERIES["out_of_time_split"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
