"""A data source that polls JSON widgets: in a batch one request for each URL, as a stream one for each new stretch of time."""

from __future__ import annotations

import datetime as dt
import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tidewright.sources.series import widget_url

SCHEMA = "url string, payload string, error string"


def fetch(url: str, timeout: float, attempts: int) -> tuple[str, str | None, str | None]:
    """(url, payload, error): the payload, or what the last attempt failed with."""
    error = None
    for _ in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as f:
                return url, f.read().decode("utf-8", "replace"), None
        except OSError as e:
            error = str(e)
    return url, None, error


def stretches(start: dt.datetime, end: dt.datetime, days: int) -> list[tuple[dt.datetime, dt.datetime]]:
    """The time from start to end in parts of at most so many days, as services limit what one request may ask for."""
    out = []
    while start < end:
        out.append((start, min(end, start + dt.timedelta(days=days))))
        start = out[-1][1]
    return out


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float, attempts: int):
        self.urls, self.timeout, self.attempts = urls, timeout, attempts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield fetch(partition.value, self.timeout, self.attempts)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are the end of the time read so far; a failed request gives no row and leaves it where it was, so that the next batch asks again."""

    def __init__(self, options: dict):
        self.base, self.trunc = options["base"], options.get("trunc", "hour")
        self.start, self.seconds = options["start"], float(options.get("seconds", 60 * int(options.get("minutes", "10"))))
        self.timeout, self.attempts = float(options.get("timeout", "30")), int(options.get("attempts", "6"))
        self.until = options.get("until")

    def initialOffset(self) -> dict:
        return {"end": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        low = dt.datetime.fromisoformat(start["end"])
        now = dt.datetime.fromisoformat(self.until) if self.until else dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
        if now - low < dt.timedelta(seconds=self.seconds):
            return iter([]), start
        row = fetch(self.url(low, now), self.timeout, self.attempts)
        return (iter([row]), {"end": now.isoformat()}) if row[2] is None else (iter([]), start)

    def url(self, low: dt.datetime, high: dt.datetime) -> str:
        unit = "minutes" if self.seconds % 60 == 0 else "seconds"
        return widget_url(self.base, low.isoformat(timespec=unit), high.isoformat(timespec=unit), self.trunc)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if start == end:
            return iter([])
        return iter([fetch(self.url(dt.datetime.fromisoformat(start["end"]), dt.datetime.fromisoformat(end["end"])), self.timeout, self.attempts)])


class WidgetSource(DataSource):
    """Format ``widget``. Batch options: urls, a JSON list; timeout, attempts. Stream options: base, start, trunc, minutes (or seconds), timeout, attempts."""

    @classmethod
    def name(cls) -> str:
        return "widget"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["urls"]), float(self.options.get("timeout", "30")), int(self.options.get("attempts", "3")))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WidgetSource)


def read_widgets(spark: SparkSession, base: str, start: dt.datetime, end: dt.datetime, trunc: str = "hour", days: int = 7, **geo: str):
    """Payloads of a time, one request and one task for each stretch of it."""
    register(spark)
    urls = [widget_url(base, a.isoformat(timespec="minutes"), b.isoformat(timespec="minutes"), trunc, **geo) for a, b in stretches(start, end, days)]
    return spark.read.format("widget").option("urls", json.dumps(urls)).load()
