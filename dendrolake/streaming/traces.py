"""Structured Streaming over sampler logs that are still being written. The watermark and the windows of
`value_windows` are this library's own addition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP_MOST, KEEP_LEAST = 5000, 1000
CHAIN_ESS = "method string, experiment string, seed long, seen long, kept long, step long, ess double, reached boolean"


def thin(values: list[float], step: int, value: float, seen: int) -> tuple[list[float], int]:
    """Keep every step-th value; when too many are kept, drop every second and double the step."""
    if seen % step == 0:
        values.append(value)
        if len(values) > KEEP_MOST:
            values, step = values[::2], step * 2
    return values, step


def online_ess(trace: DataFrame, target: float = 200.0) -> DataFrame:
    """trace: a stream of method, experiment, seed, sample, value. After each micro-batch a row for each chain with
    news: its effective sample size over what is kept, the first tenth left out, and whether it reaches target."""

    def update(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        from ..operators.traces import ess_tracer

        values, step, seen = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 1, 0)
        for frame in frames:
            for v in frame.sort_values("sample")["value"].tolist():
                values, step = thin(values, step, v, seen)
                seen += 1
        state.update((values, step, seen))
        ess = ess_tracer(values[len(values) // 10:])
        ess = 0.0 if ess != ess else ess
        yield pd.DataFrame([[*key, seen, len(values), step, ess, ess > target]], columns=["method", "experiment", "seed", "seen", "kept", "step", "ess", "reached"])

    return trace.groupBy("method", "experiment", "seed").applyInPandasWithState(update, CHAIN_ESS, "values array<double>, step long, seen long", "update", GroupStateTimeout.NoTimeout)


def value_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events: a stream of ts, event_type, value. Counts and means by type and window; rows later than `late` are
    left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")
    )
