"""The forecasting loop over a file stream, its states, and bounded histories."""

import datetime as dt

from pyspark.sql import functions as F

from tidewright.streaming import loop
from tidewright.streaming.loop import Loop, stage_of


def test_stages():
    assert [stage_of(i) for i in range(6)] == ["train", "predict", "predict", "predict", "retrain", "predict"]


def test_loop_keeps_the_last_rows_and_predicts_with_saved_models(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(6):
        rows = [("s", f"2024-01-01 0{i}:{m:02d}:00", float(10 * i + m)) for m in (0, 10, 20)]
        spark.createDataFrame(rows, "series string, t string, value double").select("series", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("series string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    trained = []

    def train(history):
        trained.append(history.count())
        return history.groupBy("series").agg(F.max("value").alias("top"))

    predict = lambda h, m: h.groupBy("series").agg(F.avg("value").alias("forecast"), F.count("*").alias("n"), F.max("idx").alias("last")).join(m, "series")
    Loop(spark, str(tmp_path / "state"), 5, train, predict).start(stream, str(tmp_path / "check")).awaitTermination()
    found = {r.batch: r for r in spark.read.parquet(str(tmp_path / "state/forecasts")).collect()}
    assert len(found) >= 6 and found[2].n == 5 and found[2].last == 4
    assert [found[i].stage for i in range(6)] == ["train", "predict", "predict", "predict", "retrain", "predict"]
    # Batches between two trainings use the model of the first: its largest value stays while the history moves on.
    assert found[1].top == found[3].top < found[4].top == found[5].top and len(trained) == 2


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    mean = lambda h, m: h.groupBy("series").agg(F.avg("value").alias("forecast"), F.count("*").alias("n"))
    run = Loop(spark, str(tmp_path), 4, lambda h: h.limit(1), mean)
    rows = lambda i: spark.createDataFrame([("s", dt.datetime(2024, 1, 1, i), float(i))], "series string, ts timestamp, value double")
    for i in (0, 1, 2, 2):
        run.batch(rows(i), i)
    assert spark.read.parquet(f"{tmp_path}/forecasts/batch=2").first().n == 3


def test_states_and_resume():
    pulls, saved = iter([0, 5, 1, 1, 0, 0, 1]), []

    def data(d):
        return next(pulls) if d["state"] in (loop.CREATE, loop.UPDATE) else None

    waited = []
    m = loop.Machine([lambda d: None, data, lambda d: 0], saved.append, wait=waited.append)
    path = m.run(14)
    assert path[:2] == [loop.WAIT, loop.UPDATE] and waited[0] == 300
    assert loop.next_state(loop.CREATE, 3) == loop.TRAIN and loop.next_state(loop.TRAIN) == loop.PREDICT
    assert loop.next_state(loop.UPDATE, 1, predictions=4) == loop.REFRESH and loop.next_state(loop.UPDATE, 1, predictions=3) == loop.PREDICT
    assert loop.next_state(loop.UPDATE, 0) == loop.WAIT and loop.next_state(loop.WAIT, waits=7) == loop.INVALID
    again = loop.Machine([lambda d: 0], saved.append, saved[2])
    assert again.descriptor["state"] == saved[2]["state"]
    stuck = loop.Machine([lambda d: 0], saved.append, {"state": loop.UPDATE})
    assert stuck.run(40)[-1] == loop.INVALID


def test_windows_of_pulls():
    now = dt.datetime(2024, 1, 10)
    assert loop.first_window(now) == (dt.datetime(2024, 1, 3), now)
    assert loop.next_window(now - dt.timedelta(minutes=20), now) == (now - dt.timedelta(minutes=10), now)
    assert loop.next_window(now, now + dt.timedelta(minutes=5)) is None


def test_bounded_histories():
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    p = loop.History()
    p.init(type("Handle", (), {"getValueState": lambda self, name, schema: Value()})())
    p.size = 3
    rows = lambda v: iter([pd.DataFrame({"ts": range(len(v)), "value": v})])
    first = next(p.handleInputRows(("k",), rows([1.0, 2.0]), None))
    second = next(p.handleInputRows(("k",), rows([3.0, 4.0]), None))
    assert first["n"].tolist() == [1, 2] and second["n"].tolist() == [3, 3] and second["mean"].tolist() == [2.0, 3.0]
