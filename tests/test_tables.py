"""Profiles, detection, cleaning, sensitive data, logs, sources and table work."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.functions.datetimes import add_datetime_features, parse_formats
from scorewright.functions.texts import add_text_features, mask
from scorewright.operators import adhoc, clean, columns, evaluate, logs, profile, sensitive
from scorewright.plans.staging import stage
from scorewright.sources import sinks, tables
from scorewright.streaming.channel_health import channel_health_stream


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({
        "user_id": range(n), "valid": rng.integers(0, 3, n), "create_date": ["2024-01-05"] * n, "age": rng.normal(40, 9, n), "edu": rng.integers(1, 6, n),
        "acct_cnt": rng.integers(0, 72, n), "province": rng.choice([11, 25, 37, 44, 65], n), "const": 1, "data_kind": rng.choice(["Train", "oot "], n),
        "note": [f"a rather long free text number {i}" for i in range(n)], "grade": rng.choice(["A", "B"], n), "y": rng.integers(0, 2, n),
    })
    pdf.loc[:380, "age"] = np.nan
    return spark.createDataFrame(pdf).cache()


def test_non_feature_columns(people):
    got = {(r["column"], r["reason"]) for r in columns.non_feature_columns(people, ["y"]).collect()}
    assert got == {("user_id", "id"), ("create_date", "time"), ("data_kind", "sample_type"), ("note", "high_cardinality")}


def test_name_patterns():
    assert columns.named_id("user_id") and columns.named_id("ID") and columns.named_id("code")
    assert not columns.named_id("valid") and not columns.named_id("video")
    assert columns.named_time("create_time") and not columns.named_time("update_count")


@pytest.mark.parametrize(
    "name, args, want",
    [
        ("gender", (2, 0, 1), (True, "binary")), ("edu", (5, 1, 5), (True, "small_range")), ("lvl", (6, 0, 5), (True, "small_range_from_zero")),
        ("overdue_cnt", (6, 0, 5), (False, "excluded_count_feature")), ("acct", (70, 0, 71), (False, "ordinal_numeric")),
        ("marital", (6, 10, 99), (True, "sparse_encoding")), ("province", (20, 11, 65), (True, "medium_sparse")), ("x", (300, 2, 400), (False, "not_categorical")),
    ],
)
def test_integer_kinds(name, args, want):
    assert columns.integer_kind(name, *args) == want


def test_categorical_report(people):
    got = {r["column"]: r["is_categorical"] for r in columns.categorical_report(people, ["y"], force_numeric=["edu"], force_categorical=["const"]).collect()}
    assert got["edu"] is False and got["const"] is True and got["province"] is True
    assert got["acct_cnt"] is False and got["grade"] is True and got["note"] is False


def test_profile_counts_nan_as_missing(people):
    p = {r["column"]: r for r in profile.profile(people).collect()}
    assert p["age"]["n_null"] == 381 and p["age"]["n_distinct"] == 19
    assert p["grade"]["n_distinct"] == 2 and p["note"]["avg_length"] > 20
    approx = {r["column"]: r for r in profile.profile(people, None, "approx").collect()}
    assert approx["edu"]["n_distinct"] == 5 and approx["const"]["n_distinct"] == 1


def test_cleaning(people):
    out, gone = clean.clean_columns(people, exclude=["y"], auto_id=True, missing_limit=0.9)
    assert gone == {"id": ["user_id"], "extra": [], "constant": ["const", "create_date"], "missing": ["age"]} or set(gone["constant"]) == {"const", "create_date"}
    assert "y" in out.columns and "age" not in out.columns
    df = out.sparkSession.createDataFrame([(-9999.0, 1), (5.0, -998)], "a double, b int")
    assert clean.sentinels_to_null(df).collect() == [(None, 1), (5.0, None)]


def test_preprocess(people):
    out, info = clean.preprocess(people, exclude=["y"], auto_id=True, missing_limit=0.9)
    assert info["text"] == ["note"] and "note_txt_length" in out.columns and "grade_is_A" in out.columns
    assert out.count() == 400


def test_quality_and_outliers_on_empty(spark):
    df = spark.createDataFrame([], "a double, b string, y int")
    assert profile.missing_report(df).count() == 3
    assert profile.iqr_outliers(df, ["a"]).count() == 0


def test_target_check(spark):
    profile.check_target(spark.createDataFrame([(0,), (1,)], "y int"), "y")
    for bad in ([(0,), (0,)], [(0,), (1,), (2,)], [(1,)]):
        with pytest.raises(ValueError):
            profile.check_target(spark.createDataFrame(bad, "y int"), "y")


def test_dominated_columns(spark):
    rows = [(1 if i % 50 else 7, "x" if i >= 4 else str(i), float(i), None) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d string")
    assert profile.dominated_columns(df, ["a", "b", "c", "d"], 0.95) == {"a": 0.98, "b": 0.98}
    q = {r["variable"]: r["reason"] for r in profile.quality_filter(df, ["a", "b", "c", "d"]).collect()}
    assert q == {"a": "identical", "b": "identical", "c": "", "d": "missing"}


def test_leakage(spark):
    df = spark.createDataFrame([(i % 4, i % 2, int(i % 4 == 0)) for i in range(100)], "a int, b int, y int")
    got = {r["feature"]: r["leaky"] for r in evaluate.leakage(df, ["a", "b"], "y").collect()}
    assert got == {"a": True, "b": False}


# ---------------------------------------------------------------- features


def test_datetime_features(spark):
    df = spark.createDataFrame([("2024-02-29 13:05:00",), ("2024-03-02 00:00:00",), (None,)], "t string").withColumn("t", F.to_timestamp("t"))
    got = add_datetime_features(df, ["t"], ["dayofweek", "is_weekend", "is_month_end", "is_month_start", "quarter", "days_since", "minute"]).collect()
    assert tuple(got[0]) == (3, 0, 1, 0, 1, 1, 5) and tuple(got[1]) == (5, 1, 0, 0, 1, 0, 0)
    assert tuple(got[2]) == (None, 0, 0, 0, None, None, None)
    with pytest.raises(ValueError):
        add_datetime_features(df, ["t"], ["century"])


def test_text_features(spark):
    df = spark.createDataFrame([("Ab 1 中!",), ("  ",), (None,)], "s string")
    got = add_text_features(df, ["s"], keywords={"k": ["AB", "("]}).collect()
    assert got[0]["s_txt_length"] == 7 and got[0]["s_txt_word_count"] == 3 and got[0]["s_txt_has_chinese"] == 1 and got[0]["s_txt_k"] == 1
    assert got[0]["s_txt_digit_ratio"] == pytest.approx(1 / 7) and got[0]["s_txt_upper_ratio"] == pytest.approx(1 / 7)
    for r in got[1:]:
        assert r["s_txt_is_empty"] == 1 and r["s_txt_word_count"] == 0 and r["s_txt_k"] == 0


def test_time_formats(spark):
    df = spark.createDataFrame([("20-10-2024", 202401, 20240131, "x")] * 20, "a string, b int, c int, d string")
    assert parse_formats(df, ["a", "b", "c", "d"]) == {"a": "dd-MM-yyyy", "b": "yyyyMM", "c": "yyyyMMdd", "d": None}


# ---------------------------------------------------------------- sensitive data


def test_sensitive_by_name_and_value(spark):
    rows = [(0, f"1380013{i:04d}", f"user{i}@mail.com", f"note {i}", 1.5, "110101199001011234") for i in range(50)]
    df = spark.createDataFrame(rows, "label int, f1 string, contact string, f2 string, f3 double, id_card string")
    got = {r["column"]: r for r in sensitive.sensitive_columns(df).collect()}
    assert got["id_card"]["method"] == "column_name" and got["id_card"]["level"] == "high"
    assert got["f1"]["rule"] == "mobile" and got["f1"]["method"] == "value_regex" and got["f1"]["hit_rate"] == 1.0
    assert got["contact"]["rule"] == "email" and set(got) == {"id_card", "f1", "contact"}
    assert sensitive.sensitive_columns(df).first()["level"] == "high"
    assert sensitive.masked_samples(df, "contact", "email", order=["contact"]).first()["sample"] == "us****om"


def test_sensitive_nothing(spark):
    df = spark.createDataFrame([(1, "a", None)], "label int, f0 string, f1 string")
    assert sensitive.sensitive_columns(df).count() == 0
    assert sensitive.sensitive_columns(df.limit(0)).count() == 0


def test_mask(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), (None,)], "s string")
    assert [r[0] for r in df.select(mask(F.col("s"))).collect()] == ["****", "ab****de", None]


# ---------------------------------------------------------------- logs


def make_calls(spark, n=3000):
    rng = np.random.default_rng(9)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 86400 * 2, n)), unit="s")
    return pd.DataFrame({
        "channel": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 5, n)), "ts": t, "event_id": range(n), "ok": rng.random(n) < 0.7,
        "response_time": rng.random(n) + 0.1,
    })


def replay(pdf):
    out = {}
    for c, g in pdf.groupby("channel"):
        avg, streak, healthy, good = 0.0, 0, True, 0
        for ok, x in zip(g["ok"], g["response_time"]):
            if ok:
                good, streak = good + 1, 0
                avg = x if avg == 0 else avg * 0.8 + x * 0.2
            else:
                streak += 1
                healthy = healthy and streak < 3
        out[c] = (len(g), good, avg, streak, healthy)
    return out


def test_channel_health_matches_replay(spark):
    pdf = make_calls(spark)
    want = replay(pdf)
    for chunk in ("hour", "day", "minute"):
        got = logs.channel_health(spark.createDataFrame(pdf), chunk=chunk).collect()
        assert len(got) == len(want)
        for r in got:
            n, good, avg, streak, healthy = want[r["channel"]]
            assert (r["total"], r["successes"], r["consecutive_failures"], r["is_healthy"]) == (n, good, streak, healthy)
            assert r["avg_response_time"] == pytest.approx(avg, rel=1e-9)


def test_stream_equals_replay(spark, tmp_path):
    pdf = make_calls(spark, 400)
    src = str(tmp_path / "calls")
    for k, part in enumerate([pdf[:150], pdf[150:300], pdf[300:]]):
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{src}/part={k}")
    stream = spark.readStream.schema(spark.createDataFrame(pdf).schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = str(tmp_path / "out")

    def save(batch, i):
        batch.withColumn("b", F.lit(i)).write.mode("append").parquet(out)

    q = channel_health_stream(stream, "1 day").writeStream.outputMode("update").foreachBatch(save)
    q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("channel").agg(F.max_by(F.struct("*"), "total").alias("s")).select("s.*").collect()
    want = replay(pdf)
    assert {r["channel"] for r in last} == set(want)
    for r in last:
        n, good, avg, streak, healthy = want[r["channel"]]
        assert (r["total"], r["successes"], r["consecutive_failures"], r["is_healthy"]) == (n, good, streak, healthy)
        assert r["avg_response_time"] == pytest.approx(avg)


def test_token_prices(spark):
    df = spark.createDataFrame([("GPT-4o-mini", 1000, 1000), ("claude-3-haiku-x", 2000, 0), ("other", 1000, 1000)], "m string, p long, c long")
    got = [r[0] for r in df.select(logs.token_cost(F.col("m"), F.col("p"), F.col("c"))).collect()]
    assert got == pytest.approx([0.09, 0.0005, 0.00042])


# ---------------------------------------------------------------- table work


def test_chi_square(spark):
    t = [[10, 20, 30], [20, 5, 15]]
    rows = [(i, j) for i, r in enumerate(t) for j, n in enumerate(r) for _ in range(n)]
    got = adhoc.chi_square(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    o = np.array(t, float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert got["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and got["dof"] == 2
    o = np.array([[12, 5], [3, 0]], float)  # one empty cell
    rows = [(i, j) for i in range(2) for j in range(2) for _ in range(int(o[i, j]))]
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    d = np.abs(o - e)
    got = adhoc.chi_square(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert got["chi2"] == pytest.approx(((d - np.minimum(d, 0.5)) ** 2 / e).sum())


def test_co_membership_both_ways(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), f"g{b}") for a, b in zip(rng.integers(0, 60, 500), rng.integers(0, 7, 500))]
    df = spark.createDataFrame(rows, "e int, g string")
    a = {(r["g1"], r["g2"]): r["n"] for r in adhoc.co_membership(df, "e", "g").collect()}
    for light, block in ((0, 2), (3, 4), (3, 512), (100, 512)):
        b = {(r["g1"], r["g2"]): r["n"] for r in adhoc.co_membership(df, "e", "g", light=light, block=block).collect()}
        assert a == b
    assert a[("g0", "g0")] == len({e for e, g in rows if g == "g0"})


def test_winsorize_and_group_rates(spark):
    df = spark.createDataFrame([(float(i), i % 2, int(i > 50)) for i in range(101)], "x double, k int, y int")
    w = adhoc.winsorize(df, "x", 0.1, 0.9).agg(F.min("x_w"), F.max("x_w")).first()
    assert tuple(w) == (10.0, 90.0)
    g = adhoc.group_rates(df, ["k"], "y").collect()
    assert {r["k"] for r in g} == {0, 1, None} and sum(r["n"] for r in g if r["k"] is None) == 101


# ---------------------------------------------------------------- sources and sinks


def test_csv_rules_names_and_results(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2.5\n2,NaN\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "int", "x": "double"} and df.where("x IS NULL").count() == 1
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), "id long, x double").dtypes[0] == ("id", "bigint")
    (tmp_path / "r.csv").write_bytes("Rule_ID,规则,Expression\n1,年龄,(a > 1)\n".encode("gbk"))
    r = tables.read_rule_file(spark, str(tmp_path / "r.csv"))
    assert r.columns == ["rule_id", "规则", "expression"] and r.first()[1] == "年龄"
    (tmp_path / "n.csv").write_text("feature_code,feature_name\nx,Amount\n")
    names = tables.read_name_mapping(spark, str(tmp_path / "n.csv"))
    assert clean.rename_features(df, names).columns == ["id", "Amount"]
    sinks.save_results({"t": df, "u": df.limit(1)}, str(tmp_path / "res"))
    assert sinks.load_result(spark, str(tmp_path / "res"), "t").count() == 2
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).count() == 2
    sinks.write_partitioned(df, str(tmp_path / "p"), ["id"])
    sinks.write_partitioned(df.where("id = 1").withColumn("x", F.lit(9.0)), str(tmp_path / "p"), ["id"])
    assert spark.read.parquet(str(tmp_path / "p")).where("id = 1").first()["x"] == 9.0
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_stage_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "i int, split string, x double")
    back = stage(df, ("split",))
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=lambda r: r[0]) == [(1, "a", 2.5), (2, None, None)]


def test_retention_deletes_expired_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    from scorewright.sources import sinks

    days = spark.range(40).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).cast("string").alias("day"), "id")
    path = f"{tmp_path}/log"
    sinks.write_partitioned(days, path, ["day"])
    gone = sinks.drop_partitions(spark, path, "day", "2024-01-30")
    assert len(gone) == 29 and gone[-1] == "2024-01-29"
    assert spark.read.parquet(path).count() == 11


def test_co_membership_of_one_entity_in_all_groups(spark):
    """An entity in each of 2,500 groups beside entities of two groups, a missing entity and a missing group."""
    rows = [("all", i) for i in range(2500)] + [(f"e{i}", g) for i in range(300) for g in (i, i + 1)] + [(None, 1), ("e1", None), ("all", 7)]
    got = adhoc.co_membership(spark.createDataFrame(rows, "e string, g int"), "e", "g")
    n = got.groupBy("n").count().collect()
    # alone: 1; a pair (i, i + 1) and a group that one or two small entities hold besides
    assert {r["n"]: r["count"] for r in n} == {1: 2500 * 2501 // 2 - 300 - 301, 2: 300 + 2, 3: 299}
    assert adhoc.co_membership(spark.createDataFrame([], "e string, g int"), "e", "g").count() == 0


def _files(root):
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in root.rglob("*.parquet")}


def test_delete_rows_rewrites_only_touched_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from scorewright.sources import sinks

    root = tmp_path / "log"
    rows = [(i, None if i % 10 == 3 else i % 2 == 0, d, f"a b%{i % 2}") for i in range(40) for d in ("01", "02", "03")]
    df = spark.createDataFrame(rows, "id int, test boolean, day string, kind string")
    sinks.write_partitioned(df.repartition(2), str(root), ["day", "kind"])
    before = _files(root)
    assert sinks.delete_rows(spark, str(root), F.col("test") & (F.col("day") == 2)) == 20
    after = _files(root)
    assert {f for f in before if "day=01" in f or "day=03" in f} <= set(after) and all(after[f] == t for f, t in before.items() if f in after)
    # all rows of day 02 with an even id were test rows: their partition is gone, the leading zero is kept
    assert {f.split("/")[0] for f in after} == {"day=01", "day=02", "day=03"} and not [f for f in after if "day=02" in f and f.split("/")[1].endswith("0")]
    back = spark.read.parquet(str(root))
    assert {(r["id"], r["test"], f"0{r['day']}", r["kind"]) for r in back.collect()} == {r for r in rows if not (r[1] and r[2] == "02")}
    assert sinks.delete_rows(spark, str(root), F.col("test")) == 40 and spark.read.parquet(str(root)).where("test IS NULL").count() == 12
    assert sinks.delete_rows(spark, str(root), F.lit(None).cast("boolean")) == 0
    assert not [p for p in root.iterdir() if p.name.startswith("_deletion")]


def test_unfinished_deletions(spark, tmp_path):
    """A run that died before its journal leaves the table as it was, one that died after it is carried out."""
    import json

    from pyspark.sql import functions as F

    from scorewright.sources import sinks

    root = tmp_path / "t"
    spark.range(20).coalesce(1).write.parquet(str(root))
    old = next(root.glob("*.parquet"))
    (root / "_deletion-a" / "data").mkdir(parents=True)
    assert sinks.finish_deletions(spark, str(root)) == 0 and spark.read.parquet(str(root)).count() == 20
    work = root / "_deletion-b"
    spark.range(5).coalesce(1).write.parquet(str(work / "data"))
    new = next((work / "data").glob("*.parquet"))
    (work / "journal.json").write_text(json.dumps({"old": [str(old)], "new": [[str(new), f"{root}/{new.name}"]]}))
    assert spark.read.parquet(str(root)).count() == 20
    assert sinks.finish_deletions(spark, str(root)) == 1 and spark.read.parquet(str(root)).count() == 5
    assert sinks.delete_rows(spark, str(root), F.col("id") == 2) == 1
    assert sorted(r["id"] for r in spark.read.parquet(str(root)).collect()) == [0, 1, 3, 4]


def test_rule_file_that_no_encoding_reads(spark, tmp_path):
    from scorewright.sources import tables

    (tmp_path / "bad.csv").write_bytes(b"rule\n\x81\xff\xfe\xff\n")
    with pytest.raises(ValueError):
        tables.read_rule_file(spark, str(tmp_path / "bad.csv"))


def test_medians_of_bins_are_exact_at_every_size(spark):
    from scorewright.operators import binning

    rng = np.random.default_rng(11)
    x = np.round(rng.normal(50, 20, 3001), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    edges = [0, 20, 50, 50.5, 100, 200]
    for rows in (10, 10**6):
        got = {r["bin"]: r["median"] for r in binning.bin_statistics(df, "x", edges, buffer_rows=rows).collect()}
        for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
            inside = x[(x >= lo) & (x < hi)]
            assert (got.get(b) is None) if not len(inside) else got[b] == pytest.approx(np.median(inside))


def test_sensitive_values_of_many_columns(spark):
    from pyspark.sql import functions as F

    from scorewright.operators import sensitive

    digits = "\u0661\u0663\u0668\u0660\u0660\u0661\u0663\u0668\u0660\u0660\u0660"
    df = spark.range(4).select(*[F.lit("13800138000" if i == 19 else "x").alias(f"c{i}") for i in range(20)], F.lit(f"1{digits[1]}{digits[2:]}").alias("arabic"))
    hits = {(r["column"], r["rule"]): r["n_hits"] for r in sensitive.value_hits(df, df.columns).collect()}
    assert len({c for c, _ in hits}) == 21 and hits["c19", "mobile"] == 4 and hits["c0", "mobile"] == 0
    assert hits["arabic", "landline"] == 4  # digits of any script
    assert sensitive.value_hits(df, []).collect() == []


def test_zero_has_one_sign(spark):
    from scorewright.operators import profile

    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "x double")
    assert profile.distinct_and_mode(df, ["x"]).first()[1:] == (2, 2, 3)


def test_co_membership_does_not_shuffle_finished_counts(spark):
    """Every pair of blocks is added up in one task; the result, quadratic in the groups, is not shuffled."""
    rows = [(f"e{k}", g) for k in range(3) for g in range(0, 400, k + 1)] + [("small", 1), ("small", 900)]
    got = adhoc.co_membership(spark.createDataFrame(rows, "e string, g int"), "e", "g", block=20)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in above and "Exchange" not in above
    n = {(r["g1"], r["g2"]): r["n"] for r in got.collect()}
    sets = [{g for e, g in rows if e == name} for name in ("e0", "e1", "e2", "small")]
    want = {}
    for s in sets:
        for a in s:
            for b in s:
                if a <= b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert n == want


def _counted(sets):
    out = {}
    for s in sets:
        for a in s:
            for b in s:
                if a <= b:
                    out[a, b] = out.get((a, b), 0) + 1
    return out


def test_co_membership_blocks_meet_without_being_shuffled_again(spark):
    """Each block is shuffled once for either side, however many others it meets; 21 blocks, 231 pairs."""
    sets = [set(range(0, 400, k + 1)) for k in range(3)] + [{1, 9}]
    df = spark.createDataFrame([(f"e{i}", g) for i, s in enumerate(sets) for g in s], "e string, g int")
    got = adhoc.co_membership(df, "e", "g", block=20)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "HashJoin" not in plan and "Aggregate" not in plan
    sent = got._jdf.queryExecution().optimizedPlan().toString()
    assert sent.count("RepartitionByExpression") == 2 and sent.count("Relation") == 2
    assert {(r["g1"], r["g2"]): r["n"] for r in got.collect()} == _counted(sets)


@pytest.mark.parametrize("listed,held,row", [(64, 8, 1 << 18), (3, 1, 40), (0, 2, 200), (10**9, 8, 7)])
def test_co_membership_in_chunks_and_shares(spark, monkeypatch, listed, held, row):
    """Heavy entities in any groups, light ones in groups of heavy ones, of their own and of both; repeated and missing values."""
    monkeypatch.setattr(adhoc, "PAIRS_LISTED", listed)
    monkeypatch.setattr(adhoc, "BLOCKS_HELD", held)
    monkeypatch.setattr(adhoc, "MEMBERS_PER_ROW", row)
    rng = np.random.default_rng(8)
    sets = [{f"g{x}" for x in rng.integers(0, 90, int(rng.integers(18, 60)))} for _ in range(15)]
    sets += [{f"g{x}" for x in rng.integers(0, 120, int(rng.integers(1, 7)))} for _ in range(80)]
    rows = [(f"e{i}", g) for i, s in enumerate(sets) for g in s]
    df = spark.createDataFrame([*rows, *rows[::3], (None, "g1"), ("e1", None)], "e string, g string")
    for block in (9, 40, 1024):
        got = adhoc.co_membership(df, "e", "g", block=block).collect()
        assert len(got) == len({(r["g1"], r["g2"]) for r in got})
        assert {(r["g1"], r["g2"]): r["n"] for r in got} == _counted(sets)
