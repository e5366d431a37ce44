"""The running loop against a local service, killed and started again; actuals that come late or never."""

import datetime as dt
import http.server
import json
import os
import subprocess
import sys
import threading
import time
import urllib.parse
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.streaming import live, loop

ROOT = Path(__file__).resolve().parent.parent


class Service(http.server.BaseHTTPRequestHandler):
    """Three series with a sample for each second after the start of what is asked for, up to its end; none while it is silent."""

    silent = False

    def do_GET(self):
        asked = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
        low, high = (dt.datetime.fromisoformat(asked[k][0]) for k in ("start_date", "end_date"))
        times = [] if self.silent else [low + dt.timedelta(seconds=i) for i in range(1, int((high - low).total_seconds()) + 1)]
        part = lambda k: {"type": "s", "id": str(k), "attributes": {"title": str(k), "values": [{"value": k + t.second % 7, "percentage": 0.0, "datetime": t.isoformat() + ".000+00:00"} for t in times]}}
        body = json.dumps({"data": {"type": "w", "id": "1", "attributes": {"title": "t", "last-update": "u"}}, "included": [part(k) for k in (1, 2, 3)]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/w"
    server.shutdown()


def events(folder):
    found = [pd.read_parquet(p) for p in sorted(folder.glob("events/batch=*"), key=lambda p: int(p.name[6:])) if list(p.glob("*.parquet"))]
    return pd.concat(found) if found else pd.DataFrame({"event": []})


def test_a_run_that_is_killed_goes_on(service, tmp_path):
    first = (dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0) - dt.timedelta(seconds=40)).isoformat()
    line = [sys.executable, "-m", "tidewright", "auto", "-u", service, "-s", first, "--seconds", "2", "-p", "3", "--out", str(tmp_path / "out")]
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false --conf spark.local.dir={tmp_path} pyspark-shell"}
    with (tmp_path / "log").open("w") as log:
        one = subprocess.Popen(line, env=env, cwd=tmp_path, stdout=log, stderr=log, start_new_session=True)
        began = time.time()
        while time.time() - began < 150 and (events(tmp_path / "out")["event"] == "forecast").sum() < 3 * 4 * 3:
            time.sleep(0.5)
        os.killpg(one.pid, 9)
        one.wait()
        before = events(tmp_path / "out")
        subprocess.run([*line, "--batches", "7"], env=env, cwd=tmp_path, stdout=log, stderr=log, timeout=200, check=True)
    after = events(tmp_path / "out")
    one = after[after.series == "second"]
    made = one[one.event == "forecast"]
    assert len(after) > len(before) > 0 and set(after.series) == {"first", "second", "third", "imbalance"}
    assert not made.duplicated(["made", "horizon"]).any() and made.groupby("made").size().eq(3).all()
    assert (one.event == "train").sum() == 1 and one.event.iloc[0] == "train"  # the second run found the first one's models and state
    kinds = [e for e, h in zip(one.event, one.horizon, strict=True) if e != "forecast" or h == 1]
    assert [i for i, e in enumerate(kinds) if e == "retrain"][:1] == [5]  # after four forecasts
    assert made[made.horizon == 1].made.is_monotonic_increasing


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Handle:
    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_the_machine_of_a_series():
    c, handle = live.Controller(seconds=600, keep=5, horizon=2, attempts=2), Handle()
    c.init(handle)
    rows = lambda a, b: iter([pd.DataFrame({"ts": pd.to_datetime([60 * i for i in range(a, b)], unit="s"), "value": [float(i) for i in range(a, b)]})])
    turn = lambda a, b: [r for df in c.handleInputRows(("s",), rows(a, b), Clock()) for r in df.event]
    wait = lambda: [r for df in c.handleExpiredTimer(("s",), Clock(), None) for r in df.event]
    assert turn(0, 4) == ["train", "forecast", "forecast"] and handle.timers == [1000 + 300_000]
    assert turn(2, 4) == [] and turn(3, 6) == ["forecast", "forecast"]  # samples that came before don't count
    assert handle.values["held"].get()[1] == [1, 2, 3, 4, 5]
    assert turn(6, 7) == turn(7, 8) == ["forecast", "forecast"]
    assert turn(8, 9) == ["retrain", "forecast", "forecast"]
    assert wait() == ["wait"] and wait() == ["wait"] and turn(9, 10) == ["forecast", "forecast"]
    assert [wait() for _ in range(3)] == [["wait"], ["wait"], ["invalid"]] and handle.values["descriptor"].get()[0] == loop.INVALID
    assert turn(10, 11) == ["forecast", "forecast"] and handle.values["descriptor"].get() == (loop.UPDATE, 7, 0)
    assert c.forecasts([1.0, 2.0], [0.5, 1.0]) == [2.5, 3.0]


def test_actuals_that_come_late_or_never(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda i: start + dt.timedelta(minutes=10 * i)
    made = [("s", at(i), float(i)) for i in range(12)]
    came = [[("s", at(i), 10.0 * i) for i in range(4)], [("s", at(i), 10.0 * i) for i in (4, 6, 8)], [("s", at(5), 50.0)], [("s", at(40), 400.0)], [("s", at(41), 410.0)], [("s", at(42), 420.0)], [("s", at(7), 70.0)], [("s", at(80), 800.0)]]
    for name, parts, column in (("made", [made, [("s", at(40), 0.0)], [("s", at(60), 0.0)], [("s", at(80), 0.0)]], "forecast"), ("came", came, "value")):
        for part in parts:
            spark.createDataFrame(part, f"series string, ts timestamp, {column} double").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(0.05)
    stream = lambda name, column: spark.readStream.schema(f"series string, ts timestamp, {column} double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    joined = live.with_actuals(stream("made", "forecast"), stream("came", "value"), "2 hours")
    joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {r.ts: r.actual for r in spark.read.parquet(str(tmp_path / "out")).filter(F.col("ts") < at(30)).collect()}
    # The sixth one came late, but within two hours; the eighth came after that, and four never.
    assert got == {at(i): (10.0 * i if i in (0, 1, 2, 3, 4, 5, 6, 8) else None) for i in range(12)}
