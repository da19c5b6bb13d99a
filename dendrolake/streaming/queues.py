"""A bounded queue of the latest observations of each key, with a fit whenever their number has doubled, as a stateful stream. The state is a list and
three numbers for each key, kept by RocksDB (spark.sql.streaming.stateStore.providerClass) and found again after a restart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FITS = "key string, observed long, kept long, mean double, sd double"


def mean_and_deviation(values: list[float]) -> tuple[float, float] | None:
    """None for less than two, or for values that don't vary."""
    n = len(values)
    mean = sum(values) / n if n else 0.0
    square = sum((x - mean) ** 2 for x in values)
    return (mean, (square / (n - 1)) ** 0.5) if n > 1 and square > 0 else None


class QueueFits(StatefulProcessor):
    """Counts every observation, keeps the last `most` that are finite, and fits them when `first` have been counted, then whenever the count has doubled since;
    a fit that fails is tried again after `first` more."""

    def __init__(self, first: int, most: int, fit: Callable):
        self.first, self.most, self.fit = first, most, fit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "value double")
        self.numbers = handle.getValueState("numbers", "observed long, next long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import math

        import pandas as pd

        values = [x[0] for x in self.queue.get()] if self.queue.exists() else []
        observed, due = self.numbers.get() if self.numbers.exists() else (0, self.first)
        out = []
        for frame in rows:
            for x in frame.sort_values("nth")["value"].tolist():
                observed += 1
                if x is not None and math.isfinite(x):
                    values = [*values, x] if len(values) < self.most else [*values[1 - self.most:], x] if self.most > 1 else [x]
                if observed >= due:
                    found = self.fit(values)
                    due = 2 * observed if found else observed + self.first
                    if found:
                        out.append((key[0], observed, len(values), *found))
        self.queue.put([(x,) for x in values])
        self.numbers.update((observed, due))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FITS.split(", ")])

    def close(self) -> None:
        pass


def queue_fits(observations: DataFrame, first: int = 100, most: int = 1000, fit: Callable = mean_and_deviation) -> DataFrame:
    """observations: a stream of key, nth, value. A row of FITS for each fit; within a micro-batch observations go by nth."""
    if first < 1 or most < 1:
        raise ValueError("at least one observation must be waited for and kept")
    rows = observations.selectExpr("CAST(key AS STRING) AS key", "nth", "CAST(value AS DOUBLE) AS value")
    return rows.groupBy("key").transformWithStateInPandas(QueueFits(first, most, fit), FITS, "append", "none")
