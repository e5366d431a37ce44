"""The forecasting loop as a stream: append new samples, keep the last n, train or load models, forecast; its states, resume and retries."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewright.operators.windows import last_n
from tidewright.sources.series import indexed

#: Batches between two trainings.
RETRAIN = 4
#: States of the loop (fixed values).
CREATE, TRAIN, UPDATE, PREDICT, REFRESH, WAIT, INVALID = range(7)
#: Days of the first pull; minutes between samples; attempts before the loop gives up; seconds to wait for each minute between samples.
FIRST_DAYS, MINUTES, ATTEMPTS, WAIT_SECONDS = 7, 10, 6, 30


def stage_of(batch_id: int, every: int = RETRAIN) -> str:
    """What a batch does: the first one trains, each later one predicts, every few train again before."""
    return "train" if batch_id == 0 else "retrain" if batch_id % every == 0 else "predict"


def next_state(state: int, new_rows: int = 0, predictions: int = 0, waits: int = 0, every: int = RETRAIN, attempts: int = ATTEMPTS) -> int:
    """The state after one: created data are trained on, then predicted; new data lead to a prediction, every few to an update of the models first, and none to a wait."""
    if state == CREATE:
        return TRAIN if new_rows else WAIT if waits <= attempts else INVALID
    if state in (TRAIN, REFRESH):
        return PREDICT
    if state == PREDICT:
        return UPDATE
    if state == UPDATE:
        return (REFRESH if predictions and predictions % every == 0 else PREDICT) if new_rows else WAIT
    if state == WAIT:
        return UPDATE if waits <= attempts else INVALID
    return INVALID


def first_window(now: dt.datetime, days: int = FIRST_DAYS) -> tuple[dt.datetime, dt.datetime]:
    """The times of the first pull."""
    return now - dt.timedelta(days=days), now


def next_window(last: dt.datetime, now: dt.datetime, minutes: int = MINUTES) -> tuple[dt.datetime, dt.datetime] | None:
    """The times of a later pull, from the first sample after the last one; None while there can be none."""
    start = last + dt.timedelta(minutes=minutes)
    return (start, now) if start <= now else None


class Machine:
    """Runs handlers by state, the first that takes a state ends its turn; the descriptor tells where to resume.

    Handlers get the descriptor and give the number of new rows, or None if they don't take the state. save keeps the descriptor.
    """

    def __init__(self, handlers: list[Callable[[dict], int | None]], save: Callable[[dict], None], descriptor: dict | None = None, wait: Callable[[float], None] = lambda seconds: None, minutes: int = MINUTES):
        self.handlers, self.save, self.wait, self.minutes = handlers, save, wait, minutes
        self.descriptor = {"state": CREATE, "predictions": 0, "waits": 0} | (descriptor or {})

    def step(self) -> int:
        d = self.descriptor
        new = 0
        if d["state"] == WAIT:
            self.wait(self.minutes * WAIT_SECONDS)
            d["waits"] += 1
        for handler in self.handlers:
            got = handler(d)
            if got is not None:
                new = got
                break
        if new and d["state"] in (CREATE, UPDATE):
            d["waits"] = 0
        d["predictions"] += d["state"] == PREDICT
        d["state"] = next_state(d["state"], new, d["predictions"], d["waits"])
        self.save(dict(d))
        return d["state"]

    def run(self, steps: int) -> list[int]:
        out = []
        for _ in range(steps):
            out.append(self.step())
            if out[-1] == INVALID:
                break
        return out


class Loop:
    """State of the loop in Parquet tables under one folder: history of each batch, models, forecasts, progress.

    train gives models (a table) of a history; predict gives forecasts of a history and saved models. Batches that only predict read the
    models that an earlier batch saved.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int, train: Callable[[DataFrame], DataFrame], predict: Callable[[DataFrame, DataFrame], DataFrame], every: int = RETRAIN):
        self.spark, self.folder, self.keep, self.train, self.predict, self.every = spark, folder, keep, train, predict, every

    def _latest(self, before: int):
        """The progress of the last batch before a given one."""
        try:
            rows = self.spark.read.schema("batch_id long, history string, models string").parquet(f"{self.folder}/progress")
            return rows.filter(F.col("batch_id") < before).orderBy(F.desc("batch_id")).first()
        except Exception as e:  # no batch has ended yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        """One micro-batch; one that runs again starts from what was before it and overwrites what it wrote."""
        done = self._latest(batch_id)
        new = rows.select("series", "ts", "value")
        both = (self.spark.read.parquet(done["history"]).select("series", "ts", "value").unionByName(new) if done else new).dropDuplicates(["series", "ts"])
        path = f"{self.folder}/history/batch={batch_id}-{uuid.uuid4().hex}"
        last_n(indexed(both), self.keep).select("series", "ts", "value", "idx").write.parquet(path)
        history = indexed(self.spark.read.parquet(path).drop("idx"))
        stage, models = stage_of(batch_id, self.every), done["models"] if done else None
        if stage != "predict" or models is None:
            models = f"{self.folder}/models/batch={batch_id}-{uuid.uuid4().hex}"
            self.train(history).write.parquet(models)
        self.predict(history, self.spark.read.parquet(models)).withColumn("stage", F.lit(stage)).write.mode("overwrite").parquet(f"{self.folder}/forecasts/batch={batch_id}")
        self.spark.createDataFrame([(batch_id, path, models)], "batch_id long, history string, models string").coalesce(1).write.mode("append").parquet(f"{self.folder}/progress")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """stream has series, ts and value; late repeats within the watermark are dropped."""
        fresh = stream.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["series", "ts"])
        return fresh.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class History(StatefulProcessor):
    """Keeps the last ``size`` values of each key and emits, for each new one, how many are held and their mean."""

    size = 512

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()[0]) if self.held.exists() else []
        out = []
        for pdf in rows:
            for v in pdf.sort_values("ts")["value"]:
                held = [*held, float(v)][-self.size :]
                out.append((key[0], len(held), sum(held) / len(held)))
        self.held.update((held,))
        yield pd.DataFrame(out, columns=["series", "n", "mean"])

    def close(self) -> None:
        pass


def histories(stream: DataFrame) -> DataFrame:
    """(series, n, mean) for each new value of a stream (series, ts, value): how many of the last values are held, and their mean."""
    return stream.groupBy("series").transformWithStateInPandas(History(), outputStructType="series string, n long, mean double", outputMode="append", timeMode="none")
