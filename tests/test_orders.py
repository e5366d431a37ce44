"""Exact likelihoods against the covariance matrix, and the search of orders against planted ones and the whole grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import orders


def planted(n, phi=0.0, season=0.0, period=1, theta=0.0, seed=0):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 200), np.zeros(n + 200)
    for i in range(period + 1, n + 200):
        x[i] = phi * x[i - 1] + season * x[i - period] - phi * season * x[i - period - 1] + e[i] + theta * e[i - 1]
    return x[200:]


@pytest.mark.parametrize("order, period", [((1, 0, 0, 0, 0, 0), 1), ((2, 0, 1, 0, 0, 0), 1), ((1, 0, 1, 1, 0, 1), 4), ((0, 0, 0, 0, 0, 0), 1), ((0, 0, 2, 1, 0, 0), 3)])
def test_the_filter_gives_the_exact_likelihood(order, period):
    rng = np.random.default_rng(sum(order))
    u, z = rng.normal(size=sum(order)) * 0.5, rng.normal(size=40)
    form = orders.Arma(u, order, period)
    # Weights of past shocks give the covariances of the samples.
    weights, a = [], form.r.copy()
    for _ in range(4000):
        weights.append(a[0])
        a = form.t @ a
    weights = np.array(weights)
    cov = [float((weights[k:] * weights[: len(weights) - k]).sum()) for k in range(40)]
    c = np.array([[cov[abs(i - j)] for j in range(40)] for i in range(40)])
    scale = z @ np.linalg.solve(c, z) / 40
    want = -0.5 * (40 * (np.log(2 * np.pi * scale) + 1) + np.linalg.slogdet(c)[1])
    assert orders.log_likelihood(z, u, order, period) == pytest.approx(want, rel=1e-8)


def test_fits_find_the_factors():
    x = planted(600, phi=0.7) + 5
    model = orders.fitted(x, (1, 0, 0, 0, 0, 0), 1)
    assert np.tanh(model["parameters"][0]) == pytest.approx(0.7, abs=0.08) and model["mean"] == pytest.approx(5, abs=0.5)
    inside, out = orders.predicted(x, model, 3)
    f = np.tanh(model["parameters"][0])
    assert np.allclose(inside[1:], model["mean"] + f * (x[:-1] - model["mean"])) and out[0] == pytest.approx(model["mean"] + f * (x[-1] - model["mean"]))
    trend = np.arange(40.0) * 2
    assert orders.predicted(trend, orders.fitted(trend, (0, 2, 0, 0, 0, 0), 1), 3)[1] == pytest.approx([80, 82, 84])
    season = np.tile([1.0, 5, 9, 2], 20)
    assert orders.predicted(season, orders.fitted(season, (0, 0, 0, 0, 1, 0), 4), 4)[1] == pytest.approx([1, 5, 9, 2])
    assert orders.fitted(np.ones(3), (2, 0, 2, 1, 0, 1), 12)["aic"] == np.inf


def test_the_search_finds_planted_orders_with_fewer_fits(spark):
    data = {"season": planted(260, phi=0.5, season=0.7, period=6, seed=1), "noise": planted(200, seed=2), "moving": planted(260, theta=0.8, seed=3), "tiny": np.ones(2)}
    df = spark.createDataFrame([(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)], "series string, idx long, value double")
    most = (2, 2, 1, 1)
    tried = orders.search(df, 6, most).toPandas()
    best = tried[tried.chosen].set_index("series")
    assert len(best) == 4 and (best.loc["season", "p"], best.loc["season", "sp"]) == (1, 1) and best.loc["moving", "q"] >= 1 and best.loc["noise", list(orders.NAMES)].sum() <= 1
    for s in ("season", "noise", "moving"):
        mine = tried[tried.series == s]
        grid = {o: orders.fitted(data[s], (o[0], 0, o[1], o[2], 0, o[3]), 6)["aic"] for o in orders.possible_orders(6, most)}
        assert len(mine) < len(grid) and not mine.duplicated(list(orders.NAMES)).any()
        assert mine.aic.min() <= min(grid.values()) + 2.5  # as good as the grid's best, or nearly
    chosen = spark.createDataFrame(best.reset_index()[["series", *orders.NAMES]])
    errors = orders.errors_inside(df, chosen, 6)
    summary = {r.series: r for r in orders.error_summary(errors).collect()}
    assert summary["season"].n == 260 and summary["season"].std < 1.2 and errors.filter(F.round(F.abs("error") - F.col("abs_error"), 6) != 0).count() == 0
    assert orders.forecasts(df, chosen, 6, 3).groupBy("series").count().filter("count = 3").count() == 4
    taken = spark.createDataFrame([(s, 1, 0) for s in data], "series string, d int, sd int")
    assert {(r.d, r.sd) for r in orders.search(df.filter("series = 'noise'"), 0, (1, 1, 0, 0), taken).collect()} == {(1, 0)}
    assert orders.search(df.limit(0), 6).count() == 0
