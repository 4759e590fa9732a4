"""Call-log and task-log statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.numeric import ratio

# Price per 1,000 tokens (input, output) by model-name part, first match wins.
TOKEN_PRICES = [
    ("gpt-4", 0.03, 0.06),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-4o", 0.005, 0.015),
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("gpt-3.5-turbo", 0.0005, 0.0015),
    ("o1", 0.015, 0.06),
    ("o1-mini", 0.003, 0.012),
    ("claude-3-opus", 0.015, 0.075),
    ("claude-3-5-sonnet", 0.003, 0.015),
    ("claude-3-sonnet", 0.003, 0.015),
    ("claude-3-haiku", 0.00025, 0.00125),
    ("deepseek-chat", 0.00014, 0.00028),
    ("deepseek-coder", 0.00014, 0.00028),
    ("deepseek-reasoner", 0.00055, 0.00219),
    ("gemini-1.5-pro", 0.00125, 0.005),
    ("gemini-1.5-flash", 0.000075, 0.0003),
    ("gemini-2.0-flash", 0.0001, 0.0004),
]
DEFAULT_PRICE = (0.00014, 0.00028)


def call_log_stats(logs: DataFrame, exclude_test: bool = False) -> DataFrame:
    """Totals over a call log."""
    rows = logs.where(~F.col("is_test_data")) if exclude_test else logs
    return rows.agg(
        F.count(F.lit(1)).alias("total_calls"), F.count(F.when(F.col("status") == "success", 1)).alias("success_calls"),
        F.count(F.when(F.col("status") == "error", 1)).alias("error_calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("total_cost"),
    )


def model_stats(logs: DataFrame) -> DataFrame:
    return logs.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("cost"),
    )


def token_cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Estimated cost of one call at full precision: the short price list is one CASE per row."""
    low = F.lower(model)

    def cost(i: float, o: float) -> Column:
        return prompt_tokens / 1000.0 * i + completion_tokens / 1000.0 * o

    out = None
    for key, i, o in TOKEN_PRICES:
        out = F.when(low.contains(key), cost(i, o)) if out is None else out.when(low.contains(key), cost(i, o))
    return out.otherwise(cost(*DEFAULT_PRICE))


def cost_summary(logs: DataFrame) -> DataFrame:
    """Success share in %, tokens, cost and mean response time."""
    n = F.count(F.lit(1))
    return logs.agg(
        n.alias("total_calls"), (ratio(F.count(F.when(F.col("status") == "success", 1)), n) * 100).alias("success_rate"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("total_cost"), F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("avg_response_time"),
    )


def log_data_summary(logs: DataFrame) -> DataFrame:
    test = F.count(F.when(F.col("is_test_data"), 1))
    real = F.count(F.when(~F.col("is_test_data"), 1))
    return logs.agg(test.alias("test_rows"), real.alias("real_rows")).select(
        "test_rows", "real_rows", (F.col("test_rows") + F.col("real_rows")).alias("all_rows"), (F.col("test_rows") > 0).alias("has_test"),
        (F.col("real_rows") > 0).alias("has_real"),
    )


def task_statistics(tasks: DataFrame, now: str, days: int = 30, task_type: str | None = None) -> DataFrame:
    """Counts per status, success rate and mean non-zero duration of the last ``days``."""
    recent = tasks.where(F.col("created_at").cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    if task_type:
        recent = recent.where(F.col("task_type") == task_type)
    dur = F.when(F.col("duration_seconds") != 0, F.col("duration_seconds"))
    status = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("completed", "failed", "stopped", "running", "paused")]
    return recent.agg(F.count(F.lit(1)).alias("total"), *status, F.coalesce(F.avg(dur), F.lit(0.0)).alias("avg_duration")).withColumn(
        "success_rate", ratio(F.col("completed"), F.col("total"))
    )


def list_logs(
    logs: DataFrame, equals: Mapping[str, object] | None = None, start: str | None = None, end: str | None = None, time: str = "timestamp",
    tie: Sequence[str] = (), offset: int = 0, limit: int = 50,
) -> DataFrame:
    """A page of matching rows, newest first (bounded top-k, not a full sort)."""
    rows = logs
    for c, v in (equals or {}).items():
        rows = rows.where(F.col(c) == F.lit(v))
    t = F.col(time).cast("timestamp")
    if start:
        rows = rows.where(t >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(t <= F.lit(end).cast("timestamp"))
    return rows.orderBy(F.desc(time), *tie).offset(offset).limit(limit)


def expired(time: str, now: str, days: int = 30, drop_test: bool = False) -> Column:
    """Rows a retention run deletes: older than ``days`` or, if asked, test rows. Null where time or flag is missing."""
    gone = F.col(time).cast("timestamp") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return gone | F.col("is_test_data") if drop_test else gone


def retain(logs: DataFrame, time: str, now: str, days: int = 30, drop_test: bool = False) -> DataFrame:
    """Rows a retention run keeps; those without a time go too. ``sinks.delete_rows`` with ``expired`` deletes in place."""
    return logs.where(~expired(time, now, days, drop_test))


# ---------------------------------------------------------------- channel health

DECAY, GAIN = 0.8, 0.2
MAX_FAILURES = 3


def channel_health(calls: DataFrame, channel: str = "channel", time: str = "ts", tie: str = "event_id", ok: str = "ok", response: str = "response_time", chunk: str = "hour") -> DataFrame:
    """Per channel: totals, running average of response time (0.8 old + 0.2 new), error rate,
    trailing failures and health.

    The running average is linear in its state, so each (channel, time chunk) is
    reduced to a pair (factor, offset) plus its failure streaks, and only those
    few rows per channel are combined in order. A channel holding a third of the
    calls is spread over its chunks.

    As in the per-call state, an average of exactly 0 restarts from the next
    response; response times are taken to be positive.
    """
    calls = calls.select(
        F.col(channel).alias("channel"), F.date_trunc(chunk, F.col(time).cast("timestamp")).alias("chunk"),
        F.col(time).cast("timestamp").alias("t"), F.col(tie).alias("id"), F.col(ok).alias("ok"), F.col(response).cast("double").alias("x"),
    )
    part = Window.partitionBy("channel", "chunk")
    newest = part.orderBy(F.desc("t"), F.desc("id"))
    later_ok = F.sum(F.col("ok").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    run = part.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.select(
        "*", F.coalesce(later_ok, F.lit(0)).alias("ok_after"), F.coalesce(F.sum(F.col("ok").cast("int")).over(run), F.lit(0)).alias("ok_upto"),
    )
    # failures between two successes share (chunk, ok_upto); their count is a streak length
    streaks = rows.where(~F.col("ok")).groupBy("channel", "chunk", "ok_upto").agg(F.count(F.lit(1)).alias("len"))
    inner = streaks.groupBy("channel", "chunk").agg(
        F.max("len").alias("longest"), F.coalesce(F.max(F.when(F.col("ok_upto") == 0, F.col("len"))), F.lit(0)).alias("head")
    )
    sums = rows.groupBy("channel", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.lit(GAIN) * F.pow(F.lit(DECAY), F.col("ok_after")) * F.col("x"))), F.lit(0.0)).alias("offset"),
        F.min_by(F.when(F.col("ok"), F.col("x")), F.when(F.col("ok"), F.col("ok_upto"))).alias("first_x"),
        F.count(F.when(~F.col("ok") & (F.col("ok_after") == 0), 1)).alias("tail"),
    )
    parts = sums.join(inner, ["channel", "chunk"], "left").fillna(0, ["longest", "head"])
    state = F.sort_array(F.collect_list(F.struct("chunk", "n", "n_ok", "offset", "first_x", "tail", "longest", "head")))
    zero = F.struct(
        F.lit(0.0).alias("avg"), F.lit(0).cast("long").alias("streak"), F.lit(0).cast("long").alias("worst"), F.lit(False).alias("seen")
    )

    def step(s: Column, p: Column) -> Column:
        # the first success ever starts the average at its own value instead of at 0.2 x
        decay = F.pow(F.lit(DECAY), p["n_ok"])
        start = p["offset"] + F.pow(F.lit(DECAY), p["n_ok"] - 1) * F.lit(1 - GAIN) * p["first_x"]
        avg = F.when(p["n_ok"] == 0, s["avg"]).when(~s["seen"], start).otherwise(s["avg"] * decay + p["offset"])
        joined = s["streak"] + p["head"]
        return F.struct(
            avg.alias("avg"), F.when(p["n_ok"] == 0, s["streak"] + p["n"]).otherwise(p["tail"]).cast("long").alias("streak"),
            F.greatest(s["worst"], joined, p["longest"]).cast("long").alias("worst"), (s["seen"] | (p["n_ok"] > 0)).alias("seen"),
        )

    per = parts.groupBy("channel").agg(F.sum("n").alias("total"), F.sum("n_ok").alias("successes"), state.alias("parts"))
    final = per.withColumn("s", F.aggregate("parts", zero, step))
    failed = F.col("total") - F.col("successes")
    return final.select(
        "channel", "total", "successes", failed.alias("failures"), F.col("s.avg").alias("avg_response_time"),
        ratio(failed, F.col("total")).alias("error_rate"), F.col("s.streak").alias("consecutive_failures"),
        (F.col("s.worst") < MAX_FAILURES).alias("is_healthy"),
    )

