"""Windows, runs, states and scalings on small series with results worked out by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import scalars
from tidewright.operators import packets, states, windows


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "series string, idx long, value double")


@pytest.mark.parametrize("size", [2, 3, 100])
def test_supervised_rows_do_not_depend_on_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", size)
    real = windows.in_blocks
    monkeypatch.setattr(windows, "in_blocks", lambda d, b, a, f: real(d, b, a, f, size))
    rows = windows.supervised(series(spark, range(1, 7)), 2).orderBy("idx").collect()
    assert [(list(r.x), r.y) for r in rows] == [([1, 2], 3), ([2, 3], 4), ([3, 4], 5), ([4, 5], 6)]


def test_padding_and_shift(spark):
    rows = windows.padded(series(spark, [5, 6]), 3).orderBy("idx").collect()
    assert [list(r.x) for r in rows] == [[0, 0, 0], [0, 0, 5]]
    assert [r.shifted for r in windows.shifted(series(spark, [1, 2, 3]), 1, -1.0).orderBy("idx").collect()] == [-1, 1, 2]


def three_points(v):
    v = list(v)
    for i in range(len(v) - 2):
        if v[i] == v[i + 2]:
            v[i + 1] = v[i]
    return v


def test_smoothing_carries_on(spark):
    assert three_points([1, 2, 1, 5, 1]) == [1, 1, 1, 1, 1]
    rng = random.Random(3)
    data = {"a": [1.0, 2.0, 1.0, 5.0, 1.0], "b": [1.0, 2.0], "c": [4.0]} | {f"r{k}": [float(rng.randrange(k % 3 + 2)) for _ in range(60)] for k in range(9)}
    rows = spark.createDataFrame([(s, i, v) for s, x in data.items() for i, v in enumerate(x)], "series string, idx long, value double")
    for size in (1, 2, 7, 100):
        found = windows.smoothed(rows, size=size).toPandas().sort_values(["series", "idx"])
        for s, x in data.items():
            assert found[found.series == s].smooth.tolist() == three_points(x), (s, size)


def test_differences_as_polynomials(spark):
    assert windows.lag_polynomial(1, 1) == {0: 1, 1: -2, 2: 1} and windows.lag_polynomial(1, 2) == {0: 1, 1: -1, 2: -1, 3: 1} and windows.lag_polynomial() == {0: 1}
    x = [float(v * v % 37) for v in range(40)]
    want = np.array(x)
    for d in (1, 3, 4):
        want = want[:-d] - want[d:]
    got = windows.filtered(series(spark, x), {"chain": (windows.lag_polynomial(1, 3, 4), 8)}).orderBy("idx").collect()
    assert [r.chain for r in got] == [*want.tolist(), *[None] * 8]
    long = windows.filtered_series(series(spark, x), {"chain": (windows.lag_polynomial(1, 3, 4), 8), "plain": (windows.lag_polynomial(), 0)})
    assert sorted((r.series, r["count"]) for r in long.groupBy("series").count().collect()) == [("s|chain", 32), ("s|plain", 40)]


def test_a_large_mean_changes_no_autocorrelation(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=400) * 1024) / 1024
    got = [{r.lag: r.r for r in windows.autocorrelation(series(spark, (x + m).tolist()), [1, 2, 5]).collect()} for m in (0.0, 1e8)]
    e = x - x.mean()
    assert all(got[0][k] == pytest.approx((e[k:] * e[:-k]).sum() / (e * e).sum()) and got[1][k] == pytest.approx(got[0][k], rel=1e-6) for k in (1, 2, 5))


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_correlations_at_all_lags_by_blocks(spark, size):
    rng = np.random.default_rng(size)
    data = {"a": rng.normal(size=90) + 1e6, "b": np.cumsum(rng.normal(size=25)), "c": np.ones(6), "d": np.array([1.0])}
    rows = spark.createDataFrame([(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)], "series string, idx long, value double")
    got = {(r.series, r.lag): r.r for r in windows.pearson_all_lags(rows, 30, size=size).collect()}
    assert set(got) == {(s, k) for s, x in data.items() for k in range(min(30, len(x)))}
    for (s, k), r in got.items():
        x = data[s]
        if len(x) - k > 2 and s in "ab":
            assert r == pytest.approx(np.corrcoef(x[k:], x[: len(x) - k])[0, 1], abs=1e-7)


def test_an_outlier_leaves_the_ranges_even(spark):
    rng = np.random.default_rng(2)
    values = [*np.round(rng.normal(size=6000), 6).tolist(), 1e12]
    counts = spark.createDataFrame([("s", v, 1) for v in set(values)], "series string, value double, n long")
    placed = counts.join(windows.splitters(counts, "value"), "series").withColumn("r", windows.range_of(F.col("value"), F.col("splitters")))
    sizes = sorted(r["count"] for r in placed.groupBy("r").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and len(sizes) > 900
    ranked = sorted((r.value, r._before) for r in windows.cumulated(counts).collect())
    assert [b for _, b in ranked] == list(range(len(ranked)))


def test_runs_and_longest(spark):
    signs = series(spark, [0.5, 0.2, -1, 0, 0, 3]).withColumn("state", states.sign_state(F.col("value"), 1e-6))
    found = windows.runs(signs).orderBy("start").collect()
    assert [(r.state, r.start, r.len) for r in found] == [(1, 0, 2), (-1, 2, 1), (0, 3, 2), (1, 5, 1)]
    assert {(r.state, r.start, r.len) for r in windows.longest_runs(windows.runs(signs)).collect()} == {(1, 0, 2), (-1, 2, 1), (0, 3, 2)}


def test_ramps(spark):
    up = windows.ramps(series(spark, [1, 2, 4, 3, 5]), True).orderBy("start").collect()
    assert [(r.start, r.end, r.duration, r.change) for r in up] == [(0, 2, 2, 3.0), (3, 4, 1, 2.0)]


def test_ramp_codes_and_samples(spark):
    # Rates a minute over the samples of each ramp: 3 / 30, no code under a change of 1, -4 / 20, and the last sample has none.
    df = series(spark, [1, 2, 4, 4, 4.5, 4.5, 0.5, 9])
    ramps = windows.both_ramps(df)
    coded = {(r.start, r.end): r.code for r in ramps.withColumn("code", states.ramp_code(F.col("duration"), F.col("change"), 10)).collect()}
    assert coded == {(0, 2): 2, (3, 4): None, (5, 6): 7, (6, 7): 4}
    assert [r.state for r in states.ramp_samples(df, ramps, 10).orderBy("idx").collect()] == [2, 2, 2, 0, 0, 7, 7, 0]


def test_five_states(spark):
    """Less generated than consumed is positive: lack above zero, excess below."""
    rows = states.five_states(series(spark, [1, 2, 9, -1, -12, 0, -3])).orderBy("idx").collect()
    want = [states.LACK, states.DEMAND_RISE, states.LACK, states.GENERATION_RISE, states.EXCESS, states.BALANCE, states.EXCESS]
    assert [r.state for r in rows] == want


def test_eight_states_tell_turbine_pump_and_off_apart(spark):
    cases = [(1, 0, 0, 0), (0, 1, 0, 1), (1, 1, 0, 2), (1, 0, 1, 3), (0, 1, 1, 4), (1, 1, 1, 5), (0, 1, -1, 6), (1, 1, -1, 7), (0, 0, 0, None), (0, 0, 1, None), (1, 0, -1, None), (-1, 1, 0, None)]
    df = spark.createDataFrame([(float(d), float(w), float(h), c) for d, w, h, c in cases], "d double, w double, h double, c int")
    assert all(r.c == r.s for r in df.withColumn("s", states.eight_states(F.col("d"), F.col("w"), F.col("h"))).collect())
    assert states.NAMES8[6] == ("WP_", "Diesels Off, WindTurbines, Hydrawlic Pump")


def test_change_states(spark):
    rows = [(0, 1.0, 0.0, 0.0), (1, 1.2, 0.0, 0.0), (2, 2.0, 1.0, 0.0), (3, 2.0, 0.2, 3.0), (4, 1.0, 0.3, -3.0), (5, 0.0, 0.0, 0.0), (6, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([("s", *r) for r in rows], "series string, idx long, d double, w double, h double")
    found = states.change_states(df, "d", "w", "h").orderBy("idx").collect()
    assert [r.code for r in found] == [1 + 8 + 128, 1, 2 + 16, 1 + 32 + 128, 4 + 8 + 256, 4, 0]
    names = states.NAMES36
    assert len(names) == 36 and [r.state is not None and names[r.state][0] for r in found] == ["_D_WT", "_Dxxx", False, "_DdWT", "dD_WP", False, False]
    assert states.change_states(df, "d", "w", "h", compat=False).filter("idx = 0").first().code == 1
    assert {n for n, _ in names.values()} >= {"xxxW_", "xxiWT", "iDiWP", "dDxxT", "_D_W_"}


def test_abrupt_sides(spark):
    df = series(spark, [0, 1, 5, 9, 10])
    got = lambda side: [r.state for r in states.abrupt_states(df, 0.7, side).orderBy("idx").collect()]
    assert got("all") == [-1, -1, 0, 1, 1] and got("upper") == [0, 0, 0, 1, 1] and got("lower") == [-1, -1, 0, 0, 0]


def test_stability_runs(spark):
    runs, times = windows.stability(series(spark, [10, 10, 0, 10, 20]), 9, 11, 10)
    assert sorted((r.stable, r.minutes) for r in runs.collect()) == [(False, 10), (True, 30)]
    assert tuple(times.first()) == ("s", 30, 10, 10)


def test_power_rates_report_the_first_step_of_a_rate(spark):
    rows = windows.power_rates(series(spark, [0, 10, 0, 10, 5, 5, 5, 5]), 10).collect()
    assert sorted((r.kind, r.idx, r.rate) for r in rows) == [("fall", 1, -1.0), ("fall", 3, -0.5), ("rise", 0, 1.0), ("rise", 0, 1.0)]


def test_gaps_cross_days(spark):
    times = ["2024-01-01 23:59:59", "2024-01-02 00:00:01", "2024-01-05 00:00:00"]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "key string, event_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert [r.gap for r in packets.gaps(df).orderBy("ts").collect()] == [None, 2.0, 3 * 86400 - 1.0]


def test_median_of_buckets(spark):
    from tidewright.operators import aggregates

    for values in ([3], [1, 2], [5, 5, 1, 9], list(range(1001)), [1e9, 0, 1, 2, 3]):
        r = aggregates.scalar_properties(series(spark, values)).first()
        ordered = sorted(map(float, values))
        assert r.median == (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2


def test_grids_are_dealt_to_tasks(spark):
    from tidewright.operators import aggregates

    keys = spark.createDataFrame([(1,), (200_000,), (5,)], "k long")
    assert aggregates.missing(keys, "k").count() == 200_000 - 3


def test_rate_and_gap_divergences(spark):
    from tidewright.operators import regress

    one = lambda n, gap: spark.createDataFrame([("k", n, 1 / gap)], "key string, n long, rate double")
    r = regress.gap_divergence(one(10, 2.0), one(30, 4.0)).first()
    mean = (10 * 2e6 + 30 * 4e6) / 40
    directed = (10 * (2e6 - mean) ** 2 + 30 * (4e6 - mean) ** 2) / mean
    assert r.directed == pytest.approx(directed) and r.divergence == pytest.approx(0.5 * directed + 0.5 * (10 * (2e6 - mean) ** 2 / 2e6 + 30 * (4e6 - mean) ** 2 / 4e6)) and r.anomaly


def test_transition_matrix_has_zeros(spark):
    df = series(spark, range(4)).withColumn("state", F.expr("element_at(array(0, 1, 0, 1), cast(idx as int) + 1)"))
    p = {(r.i, r.j): r.p for r in states.transition_matrix(df, [0, 1, 2]).collect()}
    assert p[0, 1] == 1 and p[1, 0] == 1 and p[2, 2] == 0 and len(p) == 9


def test_scaling(spark):
    rows = scalars.scaled(series(spark, [1, 2, 3, 5])).orderBy("idx").collect()
    assert [r.minmax for r in rows] == [0, 0.25, 0.5, 1] and [r.maxabs for r in rows] == [-1, -0.5, 0, 1]


def test_packets(spark):
    lines = spark.createDataFrame([("(1.500000) can0 0A1#6B6B00FF",), ("(2.000001) can0 7FF#ABC",), ("junk",), (None,)], "value string")
    rows = packets.parse(lines).orderBy("ts").collect()
    assert [r.id for r in rows] == ["0A1", "7FF"] and rows[1].data == "0ABC"
    assert rows[0].bits == "01101011011010110000000011111111"
    codes = spark.createDataFrame([("01*1",), ("",)], "b string").select(packets.transitions(F.col("b"))).collect()
    assert [list(c[0]) for c in codes] == [[1, 6, 4, 3], []]


def test_bloom_has_no_false_negatives(spark):
    items = spark.range(0, 300).withColumnRenamed("id", "item")
    m, k = 1 << 14, packets.bloom_hashes(1 << 14, 300)
    checked = packets.bloom_check(spark.range(0, 2000).withColumnRenamed("id", "item"), "item", packets.bloom(items, "item", m, k), m, k)
    member = {r.item for r in checked.filter("member").collect()}
    assert set(range(300)) <= member and len(member) < 320


def test_empty_series(spark):
    empty = series(spark, [])
    assert windows.supervised(empty, 2).count() == 0 and windows.runs(empty.withColumn("state", F.lit(1))).count() == 0
