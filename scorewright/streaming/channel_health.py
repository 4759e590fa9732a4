"""Channel health over a stream of calls (``applyInPandasWithState``).

State per channel: totals, running average of response time, trailing and
longest failure streak. Calls inside a micro-batch are applied in event-time
order; a call older than the watermark is dropped, and one that arrives in a
later batch than a newer call is applied when it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scorewright.operators.logs import DECAY, GAIN, MAX_FAILURES

OUTPUT = (
    "channel long, total long, successes long, failures long, avg_response_time double, error_rate double, "
    "consecutive_failures long, is_healthy boolean"
)
STATE = "total long, successes long, avg double, streak long, healthy boolean"


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total, good, avg, streak, healthy = state.get if state.exists else (0, 0, 0.0, 0, True)
    calls = pd.concat(batches, ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
    for ok, x in zip(calls["ok"].to_numpy(), calls["response_time"].to_numpy()):
        total += 1
        if ok:
            good += 1
            streak = 0
            avg = float(x) if avg == 0 else avg * DECAY + float(x) * GAIN
        else:
            streak += 1
            healthy = healthy and streak < MAX_FAILURES
    state.update((total, good, avg, streak, bool(healthy)))
    yield pd.DataFrame([{
        "channel": key[0], "total": total, "successes": good, "failures": total - good, "avg_response_time": avg,
        "error_rate": (total - good) / total if total else 0.0, "consecutive_failures": streak, "is_healthy": bool(healthy),
    }])


def channel_health_stream(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """calls(channel, ts, event_id, ok, response_time) -> one updated row per channel and batch."""
    stamped = calls.select(
        F.col("channel").cast("long").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "ok", "response_time"
    ).withWatermark("ts", late)
    return stamped.groupBy("channel").applyInPandasWithState(_apply, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
