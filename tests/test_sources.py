"""CSV series, JSON widgets, the registry and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.__main__ import main
from tidewright.sources import registry, series


def test_day_first_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date Time,Imbalance,Other\n08.11.2019 20:20,0.1,x\n08.11.2019 20:00,1.1,2\n08.11.2019 20:10,0.3,\n")
    rows = series.indexed(series.read_csv(spark, str(tmp_path), "Date Time", ["Imbalance", "Other"])).orderBy("series", "idx").collect()
    assert [(r.series, r.idx, r.value) for r in rows] == [("Imbalance", 0, 1.1), ("Imbalance", 1, 0.3), ("Imbalance", 2, 0.1), ("Other", 0, 2.0)]
    assert (rows[0].ts.month, rows[0].ts.day) == (11, 8)


def test_prefix_and_zero_policies(spark):
    df = spark.createDataFrame([(f"2024-01-0{i}", v) for i, v in enumerate(["1", "x", "3"], 1)], "t string, v string")
    assert series.typed(df, "t", "v", missing=series.PREFIX).count() == 1
    assert [r.value for r in series.typed(df, "t", "v", missing=series.ZERO).orderBy("ts").collect()] == [1, 0, 3]
    assert series.typed(df, "t", "v", scale=2, bias=1).agg(F.sum("value")).first()[0] == 10


def test_widget(spark):
    values = lambda k, n: [{"value": k + i, "percentage": 0.1, "datetime": f"2020-09-24T0{i}:00:00.000+02:00"} for i in range(n)]
    payload = {"data": {"type": "w", "id": "1", "attributes": {"title": "t", "last-update": "u"}}, "included": [{"type": "s", "id": str(k), "attributes": {"title": "s", "values": values(k, n)}} for k, n in ((1, 3), (10, 2), (5, 3))]}
    df = spark.createDataFrame([(json.dumps(payload),), ("{}",), (None,)], "payload string")
    rows = series.widget_series(df).orderBy("ts").collect()
    assert [(r.ts, r.first, r.imbalance) for r in rows] == [("2020-09-24T00:00:00", 1, 9), ("2020-09-24T01:00:00", 2, 9)]
    assert list(series.widget_header(df).filter("id = '1'").first().sizes) == [3, 2, 3]
    assert series.widget_url("u", "a", "b", geo_limit="p", geo_ids="1").endswith("&geo_limit=p&geo_ids=1")


def test_registry(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path / "r"))
    r.insert(method="mle", path="a", match_key="ID")
    r.insert(method="mle", path="b", match_key="ID")
    assert r.latest(method="mle", match_key="ID")["path"] == "b" and r.latest(method="none") is None


def test_command_line(spark, tmp_path):
    main(["confusion", "--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_sinks_and_bundles(spark, tmp_path):
    import datetime as dt

    from tidewright.operators import forecast, packets

    ts = lambda h: dt.datetime(2024, 1, 1, h)
    made = spark.createDataFrame([("s", m, h, float(10 * h)) for m in ("a", "b") for h in (1, 2)], "series string, model string, horizon int, forecast double")
    last = spark.createDataFrame([("s", ts(5))], "series string, last_ts timestamp")
    rows = forecast.bundle(made, last, 10)
    assert sorted({r.ts for r in rows.collect()}) == [ts(5) + dt.timedelta(minutes=10), ts(5) + dt.timedelta(minutes=20)]
    wide = registry.forecast_table(rows, ["a", "b"]).collect()
    assert [(r.a, r.b) for r in wide] == [(10, 10), (20, 20)]
    actual = spark.createDataFrame([("s", ts(5) + dt.timedelta(minutes=10), 11.0)], "series string, ts timestamp, value double")
    assert sorted((r.horizon, r.actual) for r in registry.with_actuals(rows, actual).filter("model = 'a'").collect()) == [(1, 11.0), (2, None)]
    registry.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    for n in (1, 2, 2):
        registry.write_versioned(rows.limit(n), str(tmp_path / "kept"), n)
    assert spark.read.parquet(str(tmp_path / "kept")).groupBy("version").count().orderBy("version").collect()[1]["count"] == 2
    (tmp_path / "d.log").write_text("(1.5) can0 1A#FF\nno packet\n")
    assert packets.read_dump(spark, str(tmp_path / "d.log")).first().bits == "11111111"
    assert packets.bloom_size(1 << 12, 0.05) == 656 and packets.bloom_hashes(1 << 12, 656) == 4


def test_retention_by_new_rows(spark):
    import datetime as dt

    from tidewright.functions import scalars

    rows = lambda a, b: spark.createDataFrame([("s", dt.datetime(2024, 1, i), float(i)) for i in range(a, b)], "series string, ts timestamp, value double")
    assert sorted(r.value for r in scalars.unioned(rows(1, 8), rows(8, 11)).collect()) == [4, 5, 6, 7, 8, 9, 10]


def test_optional_files_and_balances(spark, tmp_path):
    assert series.read_if_exists(spark, str(tmp_path / "none.csv"), "t") is None
    (tmp_path / "b.csv").write_text("t,made,used\n01.02.2021 00:00,1.5,2\n01.02.2021 00:10,2,1.25\n01.02.2021 00:20,,4\n01.02.2021 00:30,3,3\n")
    path = str(tmp_path / "b.csv")
    assert series.value_columns(spark, path, "t") == ["made", "used"] and series.read_if_exists(spark, path, "t").count() == 7
    rows = series.read_balance(spark, path, "t", "made", "used").orderBy("ts").collect()
    assert [(r.generated, r.value) for r in rows] == [(1.5, 0.5), (2.0, -0.75)]


def test_widget_source(spark, tmp_path, monkeypatch):
    import datetime as dt

    from tidewright.sources import widgets

    parts = widgets.stretches(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 16), 7)
    assert len(parts) == 3 and parts[-1] == (dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 16))
    widgets.register(spark)
    (tmp_path / "w.json").write_text('{"data": {"type": "w", "id": "9", "attributes": {"title": "t"}}, "included": []}')
    urls = [f"file://{tmp_path}/w.json", f"file://{tmp_path}/none.json"]
    rows = spark.read.format("widget").option("urls", json.dumps(urls)).load().orderBy("url").collect()
    assert rows[0].payload is None and rows[0].error and rows[1].error is None
    assert series.widget_header(spark.createDataFrame(rows[1:], widgets.SCHEMA)).first().id == "9"
    asked = []
    monkeypatch.setattr(widgets, "fetch", lambda url, timeout, attempts: asked.append(url) or (url, "{}", "no" if len(asked) == 1 else None))
    stream = widgets._Stream({"base": "http://x", "start": "2024-01-01T00:00:00", "until": "2024-01-08T00:00:00"})
    first = stream.initialOffset()
    assert stream.read(first)[1] == first  # the request failed: the next one asks for the same time
    got, end = stream.read(first)
    assert len(list(got)) == 1 and end == {"end": "2024-01-08T00:00:00"} and stream.read(end)[1] == end and "start_date=2024-01-01T00:00" in asked[1]
    assert len(list(stream.readBetweenOffsets(first, end))) == 1 and not list(stream.readBetweenOffsets(end, end))


def test_widget_stream(spark, tmp_path):
    import http.server
    import threading

    from tidewright.sources import widgets

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"asked": "%s"}' % self.path.encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        widgets.register(spark)
        base = f"http://127.0.0.1:{server.server_port}/w"
        stream = spark.readStream.format("widget").options(base=base, start="2024-01-01T00:00:00", until="2024-01-08T00:00:00", attempts="1").load()
        seen = []
        query = stream.writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        assert len(seen) == 1 and "start_date=2024-01-01T00:00&end_date=2024-01-08T00:00" in seen[0].payload
    finally:
        server.shutdown()


def test_balance_is_normalised_and_summed_up(spark, tmp_path):
    (tmp_path / "b.csv").write_text("t,made,used\n01.03.2021 00:00,1,3\n01.03.2021 00:10,2,5\n01.03.2021 00:20,2,9\n01.03.2021 00:30,,4\n01.03.2021 00:40,1,1\n")
    rows = series.read_balance(spark, str(tmp_path / "b.csv"), "t", "made", "used")
    got = series.balance_summary(rows).first()
    assert (got.first_value, got.low, got.high, got["mean"], got["std"]) == (2.0, 2.0, 7.0, 4.0, pytest.approx(7**0.5))
    assert got.low_normalised == pytest.approx(-2 / 7**0.5) and got.high_normalised == pytest.approx(3 / 7**0.5) and str(got.last_time) == "2021-03-01 00:20:00"


def test_forecasts_of_one_time_of_the_day(spark):
    from tidewright.sources import registry

    made = spark.createDataFrame([("s", "m", h, float(h)) for h in (1, 2, 3)], "series string, model string, horizon int, forecast double")
    last = spark.createDataFrame([("s", "2024-02-28 17:40:00")], "series string, t string").select("series", F.to_timestamp("t").alias("last_ts"))
    got = [str(r.ts) for r in registry.hourly_bundle(made, last, 7, 30).orderBy("horizon").collect()]
    assert got == ["2024-02-29 07:30:00", "2024-03-01 07:30:00", "2024-03-02 07:30:00"]
