"""Forecasts per series: ARIMA by conditional least squares with an AIC grid, networks on lags, recursive steps, bundles."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.spectra import per_series


def _differenced(x: np.ndarray, d: int, seasonal: int, period: int) -> np.ndarray:
    for _ in range(d):
        x = np.diff(x)
    for _ in range(seasonal):
        x = x[period:] - x[:-period]
    return x


def _design(x: np.ndarray, e: np.ndarray, p: int, q: int, sp: int, period: int, sq: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(regressors, targets): a constant, p and seasonal lags of x, q and seasonal lags of the residuals e."""
    lags = [*range(1, p + 1), *(period * i for i in range(1, sp + 1))]
    shocks = [*range(1, q + 1), *(period * i for i in range(1, sq + 1))]
    first = max([0, *lags, *shocks])
    rows = [np.ones(len(x) - first), *(x[first - n : len(x) - n] for n in lags), *(e[first - n : len(e) - n] for n in shocks)]
    return np.column_stack(rows), x[first:]


def fit_arima(x: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, ...] = (0, 0), period: int = 0) -> tuple[float, dict]:
    """(AIC, model) by the two steps of Hannan and Rissanen: residuals of a long autoregression, then least squares."""
    (p, d, q), (sp, sd, sq) = order, (*seasonal, 0)[:3]
    z = _differenced(np.asarray(x, float), d, sd, period)
    e = np.zeros(len(z))
    if q or sq:
        long = min(max(10, p + q), len(z) // 4)
        a, y = _design(z, e, long, 0, 0, 0)
        e[long:] = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    a, y = _design(z, e, p, q, sp, period, sq)
    if len(y) <= a.shape[1] + 1:
        return np.inf, {}
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    r = y - a @ b
    aic = len(y) * np.log((r * r).mean() + 1e-12) + 2 * (a.shape[1] + 1)
    resid = np.zeros(len(z))
    resid[len(z) - len(r) :] = r
    return float(aic), {"order": order, "seasonal": seasonal, "period": period, "b": b, "resid": resid}


def refreshed(x: np.ndarray, model: dict) -> dict:
    """A fitted model with its residuals on other data of the same series; its coefficients stay."""
    if not model:
        return {}
    (p, d, q), (sp, sd, sq), period, b = model["order"], (*model["seasonal"], 0)[:3], model["period"], model["b"]
    z = _differenced(np.asarray(x, float), d, sd, period)
    e = np.zeros(len(z))
    first = max([0, p, period * sp, q, period * sq])
    for t in range(first, len(z)):
        row = [1.0, *(z[t - n] for n in range(1, p + 1)), *(z[t - period * i] for i in range(1, sp + 1)), *(e[t - n] for n in range(1, q + 1)), *(e[t - period * i] for i in range(1, sq + 1))]
        e[t] = z[t] - np.dot(row, b)
    return {**model, "resid": e}


def forecast_arima(x: np.ndarray, model: dict, steps: int) -> np.ndarray:
    """Recursive forecasts; the differences are undone step by step. Zeros if there is no model."""
    if not model:
        return np.zeros(steps)
    (p, d, q), (sp, sd, sq), period, b = model["order"], (*model["seasonal"], 0)[:3], model["period"], model["b"]
    z, e, out = list(_differenced(np.asarray(x, float), d, sd, period)), list(model["resid"]), list(map(float, x))
    for _ in range(steps):
        row = [1.0, *(z[-n] for n in range(1, p + 1)), *(z[-period * i] for i in range(1, sp + 1)), *(e[-n] for n in range(1, q + 1)), *(e[-period * i] for i in range(1, sq + 1))]
        z.append(float(np.dot(row, b)))
        e.append(0.0)
        # The next value is the one whose difference, with those before it, is the forecast difference.
        guess = _differenced(np.array([*out, 0.0]), d, sd, period)[-1] if d or sd else 0.0
        out.append(z[-1] - guess)
    return np.array(out[len(x) :])


def order_grid(df: DataFrame, max_order: int = 2, max_d: int = 1) -> DataFrame:
    """(series, p, d, q, aic): every order of the grid for every series, one fit for each of them, each in a group of its own."""
    orders = [(p, d, q) for p, d, q in itertools.product(range(max_order + 1), range(max_d + 1), range(max_order + 1))]
    each = df.select("series", "idx", "value").withColumn("o", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("pdq", o, strict=True)]) for o in orders]))).select("series", "idx", "value", "o.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        o = tuple(int(pdf[c].iloc[0]) for c in "pdq")
        return pd.DataFrame([(pdf["series"].iloc[0], *o, fit_arima(pdf.sort_values("idx")["value"].to_numpy(float), o)[0])], columns=["series", "p", "d", "q", "aic"])

    return each.groupBy("series", "p", "d", "q").applyInPandas(run, "series string, p int, d int, q int, aic double")


def best_orders(grid: DataFrame) -> DataFrame:
    return grid.groupBy("series").agg(F.min_by(F.struct("p", "d", "q"), F.struct("aic", "p", "d", "q")).alias("o"), F.min("aic").alias("aic")).select("series", "o.*", "aic")


def seasonal_orders(df: DataFrame, period: int, max_order: tuple[int, int, int] = (2, 2, 2), max_seasonal: tuple[int, int, int] = (1, 0, 1)) -> DataFrame:
    """(series, kind, p, d, q, sp, sd, sq, aic, chosen): the best plain order, the best seasonal order alone, and both together; the least AIC is chosen."""
    plain, seasonal = (list(itertools.product(*(range(n + 1) for n in top))) for top in (max_order, max_seasonal))

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].to_numpy(float)
        aic = lambda o, s: fit_arima(x, o, s, period)[0]
        none = (0, 0, 0)
        o, s = min(plain, key=lambda o: (aic(o, none), o)), min(seasonal, key=lambda s: (aic(none, s), s))
        rows = [(pdf["series"].iloc[0], kind, *a, *b, aic(a, b)) for kind, a, b in (("plain", o, none), ("seasonal", none, s), ("both", o, s))]
        least = min(range(3), key=lambda i: rows[i][-1])
        return pd.DataFrame([(*r, i == least) for i, r in enumerate(rows)], columns=["series", "kind", "p", "d", "q", "sp", "sd", "sq", "aic", "chosen"])

    return per_series(df, body, "series string, kind string, p int, d int, q int, sp int, sd int, sq int, aic double, chosen boolean")


class Network:
    """A small dense network for one-step forecasts, trained by Adam on mean squared errors; features are scaled lags."""

    def __init__(self, inputs: int, hidden: tuple[int, ...] = (16, 32, 16), seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [inputs, *hidden, 1]
        self.w = [rng.normal(size=(a, b)) * np.sqrt(2 / a) for a, b in itertools.pairwise(sizes)]
        self.b = [np.zeros(n) for n in sizes[1:]]

    def _layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(self.w) - 1 else z)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._layers(x)[-1][:, 0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 3e-3, seed: int = 1) -> Network:
        rng, t = np.random.default_rng(seed), 0
        params = [*self.w, *self.b]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                i = order[low : low + batch]
                layers = self._layers(x[i])
                g, gw, gb = 2 * (layers[-1] - y[i, None]) / len(i), [], []
                for k in range(len(self.w) - 1, -1, -1):
                    gw.append(layers[k].T @ g)
                    gb.append(g.sum(0))
                    g = (g @ self.w[k].T) * (layers[k] > 0) if k else g
                t += 1
                for p, grad, a, c in zip(params, [*gw[::-1], *gb[::-1]], m, v, strict=True):
                    a *= 0.9
                    a += 0.1 * grad
                    c *= 0.999
                    c += 0.001 * grad * grad
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
        return self


def network_forecasts(df: DataFrame, lags: int = 24, steps: int = 4, epochs: int = 20) -> DataFrame:
    """(series, horizon, forecast, mae): a network on lags by series, applied to its own forecasts in turn; in-sample error."""

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].to_numpy(float)
        low, span = x.min(), max(np.ptp(x), 1e-9)
        s = (x - low) / span
        rows = np.lib.stride_tricks.sliding_window_view(s, lags + 1)
        net = Network(lags).fit(rows[:, :-1], rows[:, -1], epochs)
        mae = float(np.abs(net.predict(rows[:, :-1]) - rows[:, -1]).mean() * span)
        out = list(s)
        for _ in range(steps):
            out.append(float(net.predict(np.array([out[-lags:]]))[0]))
        return pd.DataFrame({"series": pdf["series"].iloc[0], "horizon": np.arange(1, steps + 1), "forecast": np.array(out[len(s) :]) * span + low, "mae": mae})

    return per_series(df, body, "series string, horizon int, forecast double, mae double")


def arima_forecasts(df: DataFrame, order: tuple[int, int, int] = (2, 0, 1), steps: int = 4, seasonal: tuple[int, int] = (0, 0), period: int = 0) -> DataFrame:
    """(series, horizon, forecast)."""

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].to_numpy(float)
        y = forecast_arima(x, fit_arima(x, order, seasonal, period)[1], steps)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "horizon": np.arange(1, steps + 1), "forecast": y})

    return per_series(df, body, "series string, horizon int, forecast double")


def bundle(forecasts: DataFrame, last: DataFrame, minutes: int) -> DataFrame:
    """Long forecasts (series, model, horizon, forecast) with their times: the series' last time and horizon steps."""
    return forecasts.join(last, "series").withColumn("ts", F.col("last_ts") + F.make_interval(mins=F.col("horizon") * minutes)).drop("last_ts")
