"""Train / test / out-of-time splits as a ``split`` column.

Exact sizes come from order statistics, not from a global sort: the key of the
boundary row is found by selection and every row is compared with it, so the
split itself is a narrow projection that needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.datetimes import order_value, parse_formats
from scorewright.operators.quantiles import RowOrder, select_ranks

SEED = 42


def hash_rank(keys: Sequence[str], seed: int = SEED) -> Column:
    """52-bit number from the row key; md5, so any engine can reproduce it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def split_by_label(df: DataFrame, label: str) -> DataFrame:
    """train / test / oot from a label column (oot also as validation, val); other rows get null."""
    v = F.lower(F.trim(F.col(f"`{label}`").cast("string")))
    return df.withColumn(
        "split", F.when(v == "train", "train").when(v == "test", "test").when(v.isin("oot", "validation", "val"), "oot")
    )


def stratified_test(df: DataFrame, target: str, keys: Sequence[str], ratio: float = 0.3, seed: int = SEED, among: Column | None = None) -> Column:
    """'test' for the int(n * ratio) rows of each class (0 and 1) with the smallest hash, else 'train'."""
    pool = df if among is None else df.where(among)
    h, y = hash_rank(keys, seed), F.col(target).cast("int")
    wide = pool.select(h.alias("h"), y.alias("y")).select(*[F.when(F.col("y") == c, F.col("h")).alias(f"h{c}") for c in (0, 1)])

    def last(n: int) -> list[int]:
        return [int(n * ratio) - 1]

    found = select_ranks(wide, {"h0": last, "h1": last}, bounds={"h0": (0.0, 2.0**52), "h1": (0.0, 2.0**52)})
    test = F.lit(False)
    for c in (0, 1):
        for e in found[f"h{c}"].values():
            test = test | ((y == c) & (h <= F.lit(e.value)))
    return F.when(test, F.lit("test")).otherwise(F.lit("train"))


def random_split(df: DataFrame, target: str, keys: Sequence[str], ratio: float = 0.3, seed: int = SEED) -> DataFrame:
    return df.withColumn("split", stratified_test(df, target, keys, ratio, seed))


def newest_rows(timed: DataFrame, keys: Sequence[str], share: float) -> Column | None:
    """Test for the newest int(n * share) rows by ``__t``; ties in time are cut by the keys, of any type."""
    size = timed.agg(F.count(F.lit(1)).alias("n"), F.count("__t").alias("known")).first()
    k = int(size["n"] * share)
    if k <= 0:
        return None
    order = RowOrder(timed.where("__t IS NOT NULL"), ["__t", *keys])
    cut = order.kth(max(size["known"] - k, 0))
    return None if cut is None else F.col("__t").isNotNull() & order.at_or_after(cut)


def time_split(
    df: DataFrame, target: str, time: str, keys: Sequence[str], oot_ratio: float = 0.2, test_ratio: float = 0.3, seed: int = SEED
) -> DataFrame:
    """Newest rows are oot; the older ones split into train and test within each class."""
    timed = df.withColumn("__t", order_value(df, time, parse_formats(df, [time])[time]))
    oot = newest_rows(timed, keys, oot_ratio)
    if oot is None:
        return random_split(df, target, keys, test_ratio, seed)
    rest = stratified_test(timed, target, keys, test_ratio, seed, among=~oot)
    return timed.withColumn("split", F.when(oot, F.lit("oot")).otherwise(rest)).drop("__t")


def split_data(
    df: DataFrame, target: str, keys: Sequence[str], label: str | None = None, time: str | None = None, oot_ratio: float = 0.0,
    test_ratio: float = 0.3, seed: int = SEED,
) -> DataFrame:
    """Label column first, then time, then random; a label split without test rows splits its train rows."""
    if label and label in df.columns:
        out = split_by_label(df, label)
        n = out.agg(F.count(F.when(F.col("split") == "train", 1)).alias("a"), F.count(F.when(F.col("split") == "test", 1)).alias("b")).first()
        if not n["a"]:
            raise ValueError(f"{label} holds no 'train' rows")
        if not n["b"]:
            inner = stratified_test(out, target, keys, test_ratio, seed, among=F.coalesce(F.col("split") == "train", F.lit(False)))
            out = out.withColumn("split", F.when(F.col("split") == "train", inner).otherwise(F.col("split")))
        return out
    if time and time in df.columns and oot_ratio > 0:
        return time_split(df, target, time, keys, oot_ratio, test_ratio, seed)
    return random_split(df, target, keys, test_ratio, seed)


def time_halves(df: DataFrame, time: str, keys: Sequence[str], n_periods: int = 2) -> DataFrame:
    """``period`` = base for the first n // k rows by time, compare for the last n // k, else null."""
    fmt = parse_formats(df, [time])[time]
    timed = df.withColumn("__t", order_value(df, time, fmt)).where("__t IS NOT NULL")
    n = timed.count()
    size = n // n_periods
    order = RowOrder(timed, ["__t", *keys])
    start, stop = order.kth(n - size), order.kth(size)
    late = order.at_or_after(start) if start else F.lit(False)
    early = ~order.at_or_after(stop) if stop else F.lit(True)
    return timed.withColumn("period", F.when(early, F.lit("base")).when(late, F.lit("compare"))).drop("__t")


def split_target_rates(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Size and target rate of the whole table and of every split."""
    y = F.col(target).cast("double")
    per = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("bad"))
    whole = per.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(F.lit("all").alias(split), "n", "bad")
    return per.unionByName(whole).select(split, "n", F.try_divide(F.col("bad"), F.col("n").cast("double")).alias("target_rate"))


def split_time_ranges(df: DataFrame, time: str, split: str = "split") -> DataFrame:
    t = F.col(f"`{time}`").cast("timestamp")
    return df.groupBy(split).agg(
        F.date_format(F.min(t), "yyyy-MM-dd HH:mm:ss").alias("min_time"), F.date_format(F.max(t), "yyyy-MM-dd HH:mm:ss").alias("max_time")
    )
