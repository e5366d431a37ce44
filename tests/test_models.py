"""Hidden Markov models, forecasts and spectra against literal fixtures and direct computation."""

import itertools
import math

import numpy as np
import pytest

from tidewright.operators import forecast, hmm, simulate

#: Fixed values of small models whose probabilities and paths are known.
PI, A = np.array([0.2, 0.8]), np.array([[0.5, 0.5], [0.4, 0.6]])
BY_TIME = np.array([[0.1, 0.5, 0.1], [0.4, 0.2, 0.4]])


def timed(m):
    return hmm.Model(PI, A, lambda obs: BY_TIME.T[: len(obs)])


def test_discrete_model():
    m = timed(None)
    assert math.exp(hmm.forward(m, np.arange(3))[1]) == pytest.approx(0.028562)
    path, p = hmm.viterbi(m, np.arange(3))
    assert path == [1, 0, 1] and math.exp(p) == pytest.approx(0.0128)
    assert hmm.viterbi(m, np.arange(3), positional=True)[0] == [0, 1, 1]


OBS = np.array([1, -5, 0.1, 0.9, -0.09, 4, 6, 2.5])
PI3, A3 = np.array([0.4, 0.5, 0.1]), np.array([[0.1, 0.7, 0.2], [0.5, 0.1, 0.4], [0.1, 0.8, 0.1]])


@pytest.mark.parametrize(("cumulative", "total", "best", "path"), [(True, 9.2832010e-4, 4.0651087e-5, [1, 0, 1, 0, 1, 0, 1, 0]), (False, 3.1574510e-11, 3.9289116e-12, [1, 0, 1, 2, 1, 2, 2, 2])])
def test_gaussian_model(cumulative, total, best, path):
    m = hmm.Model(PI3, A3, hmm.gaussian(np.array([-1.0, 0, 1]), np.array([2.0, 1, 2]), cumulative))
    assert math.exp(hmm.forward(m, OBS)[1]) == pytest.approx(total, rel=1e-5)
    found, p = hmm.viterbi(m, OBS)
    assert found == path and math.exp(p) == pytest.approx(best, rel=1e-5)


def test_posterior_against_enumeration():
    m, b = timed(None), BY_TIME.T
    weight = np.zeros((3, 2))
    for path in itertools.product(range(2), repeat=3):
        p = PI[path[0]] * b[0, path[0]]
        for t in (1, 2):
            p *= A[path[t - 1], path[t]] * b[t, path[t]]
        for t in range(3):
            weight[t, path[t]] += p
    assert np.allclose(hmm.posterior(m, np.arange(3)), weight / weight.sum(1, keepdims=True))


def sequential(model, obs):
    """(path, posterior states) of a whole series, in whole units of logarithms."""
    start, moves, mean, std = model
    b = np.rint(hmm.log_emissions(obs, mean, std, "normal") * hmm.LOG_UNIT).astype(np.int64)
    a, v, back = hmm.whole_logs(moves), hmm.whole_logs(start) + b[0], []
    for row in b[1:]:
        step = v[:, None] + a
        back.append(step.argmax(0))
        v = step.max(0) + row
    path = [int(v.argmax())]
    for row in back[::-1]:
        path.append(int(row[path[-1]]))
    return path[::-1], hmm.posterior(hmm.Model(start, moves, hmm.gaussian(mean, std)), obs).argmax(1).tolist()


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_paths_by_blocks_are_those_of_the_whole_series(spark, size):
    rng = np.random.default_rng(size)
    start, moves, mean, std = np.array([0.2, 0.5, 0.3]), np.array([[0.6, 0.2, 0.2], [0.1, 0.8, 0.1], [0.3, 0.0, 0.7]]), np.array([-1.0, 0, 1]), np.array([1.0, 0.7, 1.0])
    # In "even" all states look and move alike, so every path ties.
    models = {"one": (start, moves, mean, std), "two": (start, moves, mean, std), "even": (np.ones(3) / 3, np.ones((3, 3)) / 3, np.zeros(3), np.ones(3))}
    data = {"one": rng.normal(size=50), "two": np.array([0.3]), "even": np.round(rng.normal(size=25), 1)}
    rows = spark.createDataFrame([(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)], "series string, idx long, value double")
    table = spark.createDataFrame([(s, m[0].tolist(), m[1].tolist(), m[2].tolist(), m[3].tolist()) for s, m in models.items()], "series string, start array<double>, moves array<array<double>>, mean array<double>, std array<double>")
    found = hmm.paths(rows, table, size=size).toPandas().sort_values(["series", "idx"])
    for s, x in data.items():
        path, best = sequential(models[s], x)
        got = found[found.series == s]
        assert got.viterbi.tolist() == path
        if s != "even":
            assert got.posterior.tolist() == best


@pytest.mark.parametrize("rates", [False, True])
def test_levels_by_blocks(spark, rates):
    rng = np.random.default_rng(5)
    x = np.abs(np.cumsum(rng.normal(size=200))) + 0.2
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, idx long, value double")
    whole, cut = (hmm.smoothed_power(rows, 1.0, rates=rates, size=n).toPandas().sort_values("idx") for n in (1000, 30))
    assert whole.equals(cut.reset_index(drop=True)) or whole.smooth.tolist() == cut.smooth.tolist()
    assert whole.smooth.between(whole.programmed.min(), whole.programmed.max()).all() and whole.idx.tolist() == list(range(200))


def test_arima_finds_an_autoregression():
    rng, x = np.random.default_rng(0), [0.0]
    for e in rng.normal(size=2000):
        x.append(0.8 * x[-1] + e)
    aic, model = forecast.fit_arima(np.array(x), (1, 0, 0))
    assert model["b"][1] == pytest.approx(0.8, abs=0.05) and aic < forecast.fit_arima(np.array(x), (0, 0, 0))[0]
    trend = np.arange(50.0) * 2
    assert forecast.forecast_arima(trend, forecast.fit_arima(trend, (0, 1, 0))[1], 3) == pytest.approx([100, 102, 104])
    season = np.tile([1.0, 5, 9, 2], 20)
    assert forecast.forecast_arima(season, forecast.fit_arima(season, (0, 0, 0), (0, 1), 4)[1], 4) == pytest.approx([1, 5, 9, 2], abs=1e-6)


def test_network_learns_a_wave():
    x = np.sin(np.arange(400) / 5) / 2 + 0.5
    rows = np.lib.stride_tricks.sliding_window_view(x, 9)
    net = forecast.Network(8).fit(rows[:, :-1], rows[:, -1], 40)
    assert np.abs(net.predict(rows[:, :-1]) - rows[:, -1]).mean() < 0.05


def test_simulation_is_repeatable_and_in_range():
    rows = simulate.simulated(3)
    assert rows == simulate.simulated(3)
    assert all(0 <= r[5] < 4 and r[4] != "red" for r in rows)


def test_spectra(spark):
    import duckdb  # noqa: F401

    from tidewright.operators.spectra import periodogram, welch

    x = np.random.default_rng(1).normal(size=64)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, idx long, value double")
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / 64
    p[1:-1] *= 2
    assert np.allclose([r.power for r in periodogram(df).orderBy("k").collect()], p)
    assert welch(df, 32).count() == 17


def test_emissions_forecasts_and_saved_models(spark):
    b = hmm.discrete(np.array([[0.1, 0.9], [0.6, 0.4]]))([1, 0])
    assert b.tolist() == [[0.9, 0.4], [0.1, 0.6]]
    assert hmm.poisson(np.array([2.0]))([3])[0, 0] == pytest.approx(math.exp(-2) * 8 / 6)
    m = hmm.Model(PI3, A3, hmm.gaussian(np.array([-1.0, 0, 1]), np.array([2.0, 1, 2])))
    assert hmm.forecast_states(m, np.array([1.0, 0, 0]), 2) == [int((A3[0]).argmax()), int((A3[0] @ A3).argmax())]
    start, moves, emit = hmm.as_dictionaries(m, ["a", "b", "c"], OBS[:2], ["t0", "t1"])
    assert start["b"] == 0.5 and moves["a"]["b"] == 0.7 and emit["c"]["t1"] == pytest.approx(math.exp(-((-5 - 1) / 2) ** 2 / 2) / (2 * math.sqrt(2 * math.pi)))
    again = hmm.from_fields(hmm.to_fields(PI3, A3, [-1.0, 0, 1], [2.0, 1, 2], [0, 1, 2]))
    assert hmm.forward(again, OBS)[1] == pytest.approx(hmm.forward(m, OBS)[1])
    df = spark.createDataFrame([("s", i, float(v), int(v > 0)) for i, v in enumerate(OBS)], "series string, idx long, value double, state int")
    emissions, transitions = hmm.estimated(df, [0, 1])
    assert emissions.count() == 2 and transitions.count() == 4


@pytest.mark.parametrize("size", [3, 100])
def test_likelihood_by_blocks(spark, size):
    models = spark.createDataFrame([("s", PI3.tolist(), A3.tolist(), [-1.0, 0.0, 1.0], [2.0, 1.0, 2.0])], "series string, start array<double>, moves array<array<double>>, mean array<double>, std array<double>")
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(OBS)], "series string, idx long, value double")
    m = hmm.Model(PI3, A3, hmm.gaussian(np.array([-1.0, 0, 1]), np.array([2.0, 1, 2])))
    r = hmm.log_likelihood(df, models, size=size).first()
    assert r.n == 8 and r.logp == pytest.approx(hmm.forward(m, OBS)[1])


def test_welch_haar_and_pacf_by_parts(spark):
    from tidewright.operators import spectra

    x = np.random.default_rng(4).normal(size=200).cumsum()
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, idx long, value double")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    parts = np.array([x[i : i + 64] for i in range(0, 137, 32)])
    p = (np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * w, axis=1)) ** 2).mean(0) / (w * w).sum()
    p[1:-1] *= 2
    assert np.allclose([r.power for r in spectra.welch(df, 64).orderBy("frequency").collect()], p)
    rows = spectra.haar_denoised(df, 0.0).orderBy("idx").collect()
    assert np.allclose([r.denoised for r in rows], x)
    padded = np.pad(x, (28, 28), mode="symmetric").reshape(-1, 64).mean(1).repeat(64)[28:228]
    assert np.allclose([r.approximation for r in rows], padded)
    for n in (1, 2, 3, 5):
        small = spectra.haar_denoised(df.filter(f"idx < {n}"), 0.0).orderBy("idx").collect()
        assert np.allclose([r.denoised for r in small], x[:n])


def test_f_quantiles():
    from tidewright.operators import regress

    # Table values of the 95 % point.
    assert regress.f_quantile(0.95, 1, 10) == pytest.approx(4.9646, abs=1e-4) and regress.f_quantile(0.95, 6, 30) == pytest.approx(2.4205, abs=1e-4)
    assert regress.f_quantile(0.5, 10, 10) == pytest.approx(1) and regress.f_quantile(1.2, 3, 4) is None


def frame(spark, data):
    return spark.createDataFrame([(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)], "series string, idx long, value double")


def seasonal_walk(n=360, season=12):
    rng, walk = np.random.default_rng(0), np.zeros(n)
    for i in range(n):
        walk[i] = (walk[i - season] if i >= season else 0) + rng.normal()
    return walk


def test_seasonal_stability():
    from tidewright.operators import spectra

    rng = np.random.default_rng(0)
    still = np.tile(np.sin(np.arange(12) / 12 * 2 * np.pi) * 5, 30) + rng.normal(size=360)
    assert spectra.canova_hansen(still, 12)[2] == 0 and spectra.canova_hansen(seasonal_walk(), 12)[2] == 1


def direct_dickey_fuller(x):
    """(statistic, lags, observations) by least squares on the rows themselves."""
    x = x - x.mean()
    n, d = len(x), np.diff(x)
    top = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))

    def fit(p, first):
        t = np.arange(first, n)
        z = np.column_stack([np.ones(len(t)), x[t - 1], *[d[t - 1 - i] for i in range(1, p + 1)]])
        b, *_ = np.linalg.lstsq(z, d[t - 1], rcond=None)
        e = d[t - 1] - z @ b
        return len(t) * (math.log(2 * math.pi * (e @ e) / len(t)) + 1) + 2 * (p + 2), b[1] / math.sqrt((e @ e) / (len(t) - p - 2) * np.linalg.inv(z.T @ z)[1, 1])

    p = min(range(top + 1), key=lambda p: (fit(p, top + 1)[0], p))
    return fit(p, p + 1)[1], p, n - p - 1


def test_dickey_fuller_by_blocks(spark):
    from tidewright.operators import unitroots

    rng = np.random.default_rng(3)
    noise = rng.normal(size=400)
    auto = np.zeros(300)
    for i in range(2, 300):
        auto[i] = 0.6 * auto[i - 1] - 0.3 * auto[i - 2] + noise[i]
    data = {"walk": np.cumsum(noise), "auto": auto, "short": noise[:15], "far": auto + 1e8, "|odd|": noise[:50]}
    for size in (64, 1 << 16):
        found = {r.series: r for r in unitroots.stationarity(frame(spark, data)).collect()} if size > 64 else {r.series: r for r in unitroots.dickey_fuller(frame(spark, data), size=size).collect()}
        for s, x in data.items():
            t, p, n = direct_dickey_fuller(x)
            assert (found[s].lags, found[s].nobs) == (p, n) and found[s].adf == pytest.approx(t, rel=1e-4 if s == "far" else 1e-7)
    assert found["walk"].ndiffs == 1 and found["auto"].ndiffs == 0 and found["walk"].p > 0.1 and found["auto"].p < 0.01
    # Published values: the 5 % point and its share.
    assert unitroots.p_value(-2.86154) == pytest.approx(0.05, abs=2e-3) and unitroots.p_value(-3.43035) == pytest.approx(0.01, abs=1e-3) and unitroots.p_value(-30) == 0 and unitroots.p_value(3) == 1
    assert unitroots.point(0.05, 100) == pytest.approx(-2.8909, abs=1e-3)


def direct_seasonal(x, m, p):
    """The t value of the filtered difference a season before, with p lags, by least squares on the rows themselves."""
    n, top = len(x), 3
    at = lambda f, t: np.array([f(i) for i in t])
    v, w = (lambda i: x[i] - x[i - 1]), (lambda i: x[i] - x[i - m])
    y = lambda i: w(i) - w(i - 1)
    t = np.arange(m + top + 1, n)
    lags = np.column_stack([at(y, t - i) for i in range(1, p + 1)])
    phi = np.linalg.lstsq(lags, at(y, t), rcond=None)[0]
    z4 = at(w, t - 1) - sum(phi[i] * at(w, t - 2 - i) for i in range(p))
    z5 = at(v, t - m) - sum(phi[i] * at(v, t - m - 1 - i) for i in range(p))
    z = np.column_stack([lags, z4, z5])
    b = np.linalg.lstsq(z, at(y, t), rcond=None)[0]
    e = at(y, t) - z @ b
    return b[-1] / math.sqrt((e @ e) / (len(t) - p - 2) * np.linalg.inv(z.T @ z)[-1, -1])


def test_seasonal_roots_by_blocks(spark):
    from tidewright.operators import unitroots

    rng = np.random.default_rng(0)
    still = np.tile(np.sin(np.arange(12) / 12 * 2 * np.pi) * 5, 30) + rng.normal(size=360)
    data = {"still": still, "walk": seasonal_walk(), "short": still[:18], "one": still[:1]}
    for size in (50, 1 << 16):
        found = {r.series: r for r in unitroots.seasonal_roots(frame(spark, data), 12, size=size).collect()}
        assert found["still"].differences == 0 and found["walk"].differences == 1 and found["short"].lags == 0
        for s in ("still", "walk"):
            assert found[s].ocsb == pytest.approx(direct_seasonal(data[s], 12, found[s].lags), rel=1e-6)
    assert unitroots.seasonal_point(12) == pytest.approx(-1.803, abs=5e-3)
    asked = {r.series: (r.d, r.sd) for r in unitroots.differences(frame(spark, {"still": still, "walk": seasonal_walk()}), 12).collect()}
    assert asked["still"] == (0, 0) and asked["walk"] == (0, 1)
