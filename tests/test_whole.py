"""The queries that cover every row, lag or segment, where those of the same kind with fixed SQL cover a part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import forecast, packets, regress, spectra, windows

from test_windows import series


def test_periodogram_reads_the_whole_series(spark):
    x = np.random.default_rng(0).normal(size=301)
    found = spectra.periodogram(series(spark, x)).orderBy("k").collect()
    angle = 2 * np.pi * np.outer(np.arange(151), np.arange(301)) / 301
    power = np.abs(np.exp(-1j * angle) @ (x - x.mean())) ** 2 / 301
    power[1:] *= 2
    assert [r.k for r in found] == list(range(151)) and [r.power for r in found] == pytest.approx(power, abs=1e-9)


def test_ramps_of_both_directions_cover_every_step(spark):
    from tidewright.plans import catalogue

    rows = catalogue.QUERIES["ramp_segments"](spark, "/root/testdata/sf0.001").collect()
    assert min(r.change for r in rows) < 0 < max(r.change for r in rows)
    steps = sorted(i for r in rows for i in range(r.start, r.end))
    assert steps == sorted(set(steps))
    codes = {r.code for r in catalogue.QUERIES["ramp_states"](spark, "/root/testdata/sf0.001").collect()}
    assert codes & {1, 2, 3, 4} and codes & {5, 6, 7, 8}


def test_every_lag_is_correlated(spark):
    x = np.random.default_rng(1).normal(size=80)
    r = {row.lag: row.r for row in windows.pearson_all_lags(series(spark, x), 512).collect()}
    assert set(r) == set(range(80))
    assert [r[k] for k in range(1, 78)] == pytest.approx([np.corrcoef(x[k:], x[:-k])[0, 1] for k in range(1, 78)])
    found = spectra.correlograms(series(spark, x), 24).collect()
    assert {(row.series, row.lag) for row in found} == {(f"s|{k}", lag) for k in ("plain", "diff1", "diff2", "diff1s") for lag in range(20)}
    z = np.diff(x, 2) - np.diff(x, 2).mean()
    assert next(row.r for row in found if row.series == "s|diff2" and row.lag == 7) == pytest.approx((z[7:] * z[:-7]).sum() / (z * z).sum())


def test_matrices_have_every_series_and_day(spark, tmp_path):
    from tidewright.plans import catalogue

    hours = "select 'a' event_type, timestamp'2024-01-05 03:00:00' ts, 1.0D value, 1L event_id union all select 'b', timestamp'2031-07-09 04:00:00', 2.0D, 2L"
    spark.sql(hours).write.parquet(f"{tmp_path}/events.parquet")
    cells = {(r.series, r.slot, r.day) for r in catalogue.QUERIES["slot_day_cells"](spark, str(tmp_path)).filter("value is not null").collect()}
    assert cells == {("a", 3, "2024-01-05"), ("b", 4, "2031-07-09")}
    for name in ("day_slot_matrix", "matrix_margins"):
        assert {r.series for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} == {"a", "b"}


def test_seasonal_order_is_found(spark):
    e = np.random.default_rng(2).normal(size=400)
    for i in range(6, 400):
        e[i] += 0.9 * e[i - 6]
    rows = {r.kind: r for r in forecast.seasonal_orders(series(spark, e), 6).collect()}
    assert rows["seasonal"].sp == 1 and rows["seasonal"].aic < rows["plain"].aic and not rows["plain"].chosen


def test_gap_histograms_and_their_comparison(spark):
    x = np.random.default_rng(3).exponential(size=60)
    rows = [("k", i, float(t)) for i, t in enumerate(np.cumsum(x))] + [("rare", i, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, event_id long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = packets.gap_histogram(df).orderBy("bin").collect()
    gaps = [r.gap for r in packets.gaps(df.filter("key = 'k'")).collect() if r.gap is not None]
    assert [r.key for r in got] == ["k"] * 10 and [r.n for r in got] == np.histogram(gaps)[0].tolist()
    flat = spark.createDataFrame([("k", b, 7) for b in range(10)], "key string, bin int, n long")
    steep = spark.createDataFrame([("k", b, 91 if b == 0 else 1) for b in range(10)], "key string, bin int, n long")
    rates = spark.createDataFrame([("k", 2, 3.0)], "key string, n long, rate double")
    r = regress.histogram_anomaly(flat, steep, rates).collect()[0]
    assert (r.d, r.ks, r.p_n) == pytest.approx((0.81, 0.9, 4.5 * np.exp(-3))) and r.anomaly and r.p == pytest.approx(2 * 20 / 184756)
