"""The running loop: one streaming query polls widgets, keeps each series' history, state and model, waits, trains and forecasts.

A stateful processor holds for each series a descriptor (state, forecasts made, waits), the last samples and a model. New samples move
the state machine of ``loop.next_state``: the first ones are trained on and forecast; later ones lead to forecasts, every few to a new
training before. After each turn a timer is set; if it fires before new samples come, that is a wait, and after too many the series is invalid until samples come
again. State, timers and the polled time are in the query's checkpoint, so a run that was killed goes on where it was, and what a batch writes
replaces what the same batch wrote before: each forecast is there once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewright.operators import forecast
from tidewright.sources import series, widgets
from tidewright.streaming import loop

EVENTS = "series string, event string, state int, made timestamp, horizon int, ts timestamp, forecast double"
#: What a turn of the machine in a state is called.
NAMES = {loop.CREATE: "create", loop.TRAIN: "train", loop.UPDATE: "update", loop.PREDICT: "forecast", loop.REFRESH: "retrain", loop.WAIT: "wait", loop.INVALID: "invalid"}


def samples(payloads: DataFrame) -> DataFrame:
    """(series, ts, value) of polled widgets: their three series and the imbalance."""
    wide = series.widget_series(payloads.filter("error is null"))
    long = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("value")) for n in ("first", "second", "third", "imbalance")])
    return wide.select(F.to_timestamp("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.explode(long).alias("x")).select("x.series", "ts", "x.value").filter("ts is not null and value is not null")


class Controller(StatefulProcessor):
    """The machine of one series; seconds are those between two samples, a wait takes WAIT_SECONDS for each minute of them."""

    def __init__(self, seconds: float = 60.0 * loop.MINUTES, keep: int = 512, horizon: int = 4, lags: int = 6, every: int = loop.RETRAIN, attempts: int = loop.ATTEMPTS):
        self.seconds, self.keep, self.horizon, self.lags, self.every, self.attempts = seconds, keep, horizon, lags, every, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<long>, values array<double>")
        self.model = handle.getValueState("model", "b array<double>")
        self.descriptor = handle.getValueState("descriptor", "state int, forecasts long, waits int")

    def _described(self) -> tuple[int, int, int]:
        return tuple(self.descriptor.get()) if self.descriptor.exists() else (loop.CREATE, 0, 0)

    def _timer(self, timer) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, (tuple, list)) else at)
        self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + int(1000 * self.seconds * loop.WAIT_SECONDS / 60))

    def fitted(self, values: list[float]) -> list[float]:
        """A constant and autoregressive factors by least squares; fewer lags, or the mean alone, for short histories."""
        x = np.array(values)
        p = max(0, min(self.lags, (len(x) - 2) // 3))
        _, model = forecast.fit_arima(x, (p, 0, 0))
        return [float(v) for v in model["b"]] if model else [float(x.mean())]

    def forecasts(self, values: list[float], b: list[float]) -> list[float]:
        past = list(values)
        for _ in range(self.horizon):
            past.append(b[0] + sum(f * past[-i] for i, f in enumerate(b[1:], 1)))
        return past[len(values) :]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, made, waits = self._described()
        times, values = (list(c) for c in self.held.get()) if self.held.exists() else ([], [])
        last = times[-1] if times else -(1 << 62)
        fresh = pd.concat(list(rows)).drop_duplicates("ts")
        new = sorted((t, v) for t, v in zip(fresh["ts"].astype("datetime64[us]").astype("int64"), fresh["value"], strict=True) if t > last)
        out: list[tuple] = []
        if new:
            times, values = [*times, *(int(t) for t, _ in new)][-self.keep :], [*values, *(float(v) for _, v in new)][-self.keep :]
            self.held.update((times, values))
            at, n = pd.Timestamp(times[-1], unit="us"), len(new)
            state = loop.UPDATE if state in (loop.WAIT, loop.INVALID) and made else loop.CREATE if state in (loop.WAIT, loop.INVALID) else state
            waits = 0
            while True:
                state = loop.next_state(state, n, made, waits, self.every, self.attempts)
                if state in (loop.TRAIN, loop.REFRESH):
                    self.model.update((self.fitted(values),))
                    out.append((key[0], NAMES[state], state, at, None, None, None))
                elif state == loop.PREDICT:
                    step = pd.Timedelta(seconds=self.seconds)
                    found = self.forecasts(values, list(self.model.get()[0]))
                    out += [(key[0], NAMES[state], state, at, h, at + h * step, v) for h, v in enumerate(found, 1)]
                    made += 1
                else:
                    break
            self.descriptor.update((state, made, waits))
            self._timer(timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"horizon": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, made, waits = self._described()
        waits += 1
        state = loop.INVALID if loop.next_state(loop.WAIT, 0, made, waits, self.every, self.attempts) == loop.INVALID else loop.WAIT
        self.descriptor.update((state, made, waits))
        if state == loop.WAIT:
            self._timer(timerValues)
        last = self.held.get()[0][-1] if self.held.exists() else None
        yield pd.DataFrame([(key[0], NAMES[state], state, pd.Timestamp(last, unit="us") if last is not None else None, None, None, None)], columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"horizon": "Int32", "ts": "datetime64[us]", "forecast": "float64"})

    def close(self) -> None:
        pass


def controlled(stream: DataFrame, controller: Controller) -> DataFrame:
    """The events (EVENTS) of a stream (series, ts, value)."""
    return stream.groupBy("series").transformWithStateInPandas(controller, outputStructType=EVENTS, outputMode="append", timeMode="processingTime")


#: State of processors with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(spark: SparkSession, base: str, folder: str, first: str, seconds: float = 60.0 * loop.MINUTES, controller: Controller | None = None, **options: str) -> StreamingQuery:
    """Polls base from the time first on, every so many seconds, and writes the events of each batch under folder/events."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    widgets.register(spark)
    polled = spark.readStream.format("widget").options(base=base, start=first, seconds=str(seconds), **options).load()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    events = controlled(samples(polled), controller or Controller(seconds))
    return events.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=f"{max(1, round(seconds))} seconds").start()


def run(query: StreamingQuery, batches: int | None) -> None:
    """Until the query ends, or for so many batches of this run."""
    if batches is None:
        query.awaitTermination()
        return
    first = None
    while query.isActive:
        query.awaitTermination(0.2)
        done = query.lastProgress
        if done is not None:
            first = done["batchId"] if first is None else first
            if done["batchId"] - first + 1 >= batches:
                query.stop()


def with_actuals(forecasts: DataFrame, actuals: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of forecasts (series, ts, ...) with the value that came for their time, null once none came within so long after it.

    Both are streams. A forecast waits in the join's state for its actual, which comes a step or more later; values that are later than
    late go unmatched, and state older than that is dropped.
    """
    made = forecasts.withWatermark("ts", late)
    came = actuals.select(F.col("series").alias("_series"), F.col("ts").alias("_ts"), F.col("value").alias("actual")).withWatermark("_ts", late)
    return made.join(came, (F.col("series") == F.col("_series")) & (F.col("ts") == F.col("_ts")), "left").drop("_series", "_ts")
