"""Seasonal ARIMA by exact likelihood, and the search of orders that moves to better neighbours, all series a step.

A model is a state-space form; a Kalman filter from the stationary covariance gives the likelihood with its scale concentrated out. Parameters are
searched as partial autocorrelations, so every model is stationary and invertible. The search fits a few orders for each series, moves to
the best, and goes on with those of its neighbours that weren't fitted, until none is better: far fewer fits than the grid. The candidates of
a step of all series are one DataFrame, a fit a row. A fit needs its whole series; give bounded ones.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.forecast import _differenced

NAMES = ("p", "d", "q", "sp", "sd", "sq")


def from_partial(r: np.ndarray) -> np.ndarray:
    """Factors of a stationary autoregression from its partial autocorrelations."""
    phi = np.zeros(0)
    for a in r:
        phi = np.append(phi - a * phi[::-1], a)
    return phi


def polynomial(short: np.ndarray, seasonal: np.ndarray, period: int, sign: float) -> np.ndarray:
    """Factors behind the first of (1 + sign short)(1 + sign seasonal), seasonal ones being period apart."""
    a = np.concatenate([[1.0], sign * short])
    b = np.zeros(len(seasonal) * period + 1)
    b[0] = 1
    b[period::period] = sign * seasonal if len(seasonal) else []
    return np.convolve(a, b)[1:]


class Arma:
    """The state-space form of given factors."""

    def __init__(self, parameters: np.ndarray, order: tuple[int, ...], period: int):
        p, _, q, sp, _, sq = order
        parts = np.split(np.tanh(parameters), np.cumsum([p, q, sp]))
        ar = -polynomial(from_partial(parts[0]), from_partial(parts[2]), max(period, 1), -1.0)
        ma = polynomial(from_partial(parts[1]), from_partial(parts[3]), max(period, 1), -1.0)
        n = max(len(ar), len(ma) + 1, 1)
        self.ar, self.r = np.append(ar, np.zeros(n - len(ar))), np.concatenate([[1.0], ma, np.zeros(n - 1 - len(ma))])
        self.t = np.eye(n, k=1)
        self.t[:, 0] += self.ar
        self.rr = np.outer(self.r, self.r)

    def stationary(self) -> np.ndarray:
        """The covariance of the state before any sample, by doubling."""
        p, a = self.rr, self.t
        for _ in range(60):
            step = a @ p @ a.T
            p = p + step
            if np.abs(step).max() <= 1e-13 * np.abs(p).max():
                break
            a = a @ a
        return p

    def run(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one-step errors, their variances over the scale, the state after the last sample)."""
        n, p, a, settled = len(z), self.stationary(), np.zeros(len(self.r)), False
        v, f, k = np.empty(n), np.empty(n), None
        for i in range(n):
            v[i] = z[i] - a[0]
            if not settled:
                f[i] = p[0, 0]
                k = self.t @ p[:, 0] / f[i]
                after = self.t @ p @ self.t.T + self.rr - np.outer(k, k) * f[i]
                settled = np.abs(after - p).max() <= 1e-10 * max(1.0, p[0, 0])
                p = after
            else:
                f[i] = f[i - 1]
            first = a[0]
            a[:-1] = a[1:]
            a[-1] = 0
            a += self.ar * first + k * v[i]
        return v, f, a


def log_likelihood(z: np.ndarray, parameters: np.ndarray, order: tuple[int, ...], period: int) -> float:
    v, f, _ = Arma(parameters, order, period).run(z)
    scale = max(float((v * v / f).mean()), 1e-300)
    return -0.5 * (len(z) * (np.log(2 * np.pi * scale) + 1) + np.log(f).sum())


def minimised(f, x: np.ndarray, step: float = 0.6, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Nelder and Mead's simplex."""
    points = [x, *(x + step * e for e in np.eye(len(x)))]
    values = [f(p) for p in points]
    for _ in range(60 * max(1, len(x))):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        far = centre + (centre - points[-1])
        at_far = f(far)
        if at_far < values[0]:
            more = centre + 2 * (centre - points[-1])
            at_more = f(more)
            points[-1], values[-1] = (more, at_more) if at_more < at_far else (far, at_far)
        elif at_far < values[-2]:
            points[-1], values[-1] = far, at_far
        else:
            near = centre + 0.5 * (points[-1] - centre)
            at_near = f(near)
            if at_near < values[-1]:
                points[-1], values[-1] = near, at_near
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *map(f, points[1:])]
    best = int(np.argmin(values))
    return points[best], values[best]


def fitted(x: np.ndarray, order: tuple[int, ...], period: int) -> dict:
    """{aic, parameters, mean, order, period}: the likeliest model; AIC is infinite if the series is too short for it. The mean counts where nothing is differenced."""
    p, d, q, sp, sd, sq = order
    z = _differenced(np.asarray(x, float), d, sd, period)
    k = p + q + sp + sq
    mean = float(z.mean()) if len(z) and not d and not sd else 0.0
    z = z - mean
    if len(z) < max(k + 3, period * (sp + sq) + 2) or not np.any(z):
        return {"aic": np.inf, "parameters": [0.0] * k, "mean": mean, "order": list(order), "period": period}
    loss = lambda u: -log_likelihood(z, np.clip(u, -4, 4), order, period)
    u, least = minimised(loss, np.zeros(k)) if k else (np.zeros(0), loss(np.zeros(0)))
    return {"aic": 2 * least + 2 * (k + 1 + (not d and not sd)), "parameters": np.clip(u, -4, 4).tolist(), "mean": mean, "order": list(order), "period": period}


def predicted(x: np.ndarray, model: dict, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(what each sample was forecast to be from those before it, forecasts beyond the last); the first samples that differences take have themselves."""
    x, (_, d, _, _, sd, _), period = np.asarray(x, float), model["order"], model["period"]
    z = _differenced(x, d, sd, period) - model["mean"]
    form = Arma(np.array(model["parameters"]), tuple(model["order"]), period)
    v, _, a = form.run(z)
    lost = len(x) - len(z)
    inside = np.concatenate([x[:lost], x[lost:] - v])
    out = list(x)
    for _ in range(steps):
        guess = _differenced(np.array([*out, 0.0]), d, sd, period)[-1] if d or sd else 0.0
        out.append(a[0] + model["mean"] - guess)
        a = form.t @ a
    return inside, np.array(out[len(x) :])


def in_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """(series, x): each series as one array."""
    return df.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("v")))), lambda r: r["v"]).alias("x"))


def fits(wanted: DataFrame, data: DataFrame, period: int) -> DataFrame:
    """(series, NAMES, aic) of wanted orders (series, NAMES), one fit a row; the rows are dealt to all tasks."""

    def run(batches):
        for pdf in batches:
            aic = [fitted(np.asarray(r.x, float), tuple(int(getattr(r, n)) for n in NAMES), period)["aic"] for r in pdf.itertuples(index=False)]
            yield pdf.drop(columns="x").assign(aic=aic)

    tasks = max(1, data.sparkSession.sparkContext.defaultParallelism)
    rows = wanted.join(data, "series").select("series", *NAMES, "x").repartition(tasks, "series", *NAMES)
    return rows.mapInPandas(run, "series string, " + ", ".join(f"{n} int" for n in NAMES) + ", aic double")


#: Where the search begins, as far as the largest orders allow: (p, q, sp, sq).
BEGIN = ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))
#: Its moves.
MOVES = (*[tuple(s if i == k else 0 for i in range(4)) for k in range(4) for s in (-1, 1)], (1, 1, 0, 0), (-1, -1, 0, 0), (1, -1, 0, 0), (-1, 1, 0, 0), (0, 0, 1, 1), (0, 0, -1, -1))


def search(df: DataFrame, period: int = 0, most: tuple[int, int, int, int] = (2, 2, 1, 1), differences: DataFrame | None = None, value: str = "value") -> DataFrame:
    """(series, NAMES, aic, round, chosen): every order that was fitted, in which round, and the one of least AIC.

    most are the largest p, q, sp and sq; without a period the seasonal ones are 0. differences (series, d, sd) are the differences of each series; none if not given.
    """
    top = most if period > 1 else (*most[:2], 0, 0)
    data = in_rows(df, value).persist()
    held = data.select("series")
    taken = differences.select("series", F.col("d").cast("int"), F.col("sd").cast("int")) if differences is not None else held.select("series", F.lit(0).alias("d"), F.lit(0).alias("sd"))
    begin = sorted({tuple(min(a, b) for a, b in zip(o, top, strict=True)) for o in BEGIN})
    order = lambda o: F.struct(*[F.lit(v).alias(n) for n, v in zip(("p", "q", "sp", "sq"), o, strict=True)])
    wanted = held.join(taken, "series").withColumn("o", F.explode(F.array(*map(order, begin)))).select("series", "o.p", "d", "o.q", "o.sp", "sd", "o.sq")
    tried, step = None, 0
    while True:
        found = fits(wanted, data, max(period, 1)).withColumn("round", F.lit(step)).persist()
        if not found.count():
            break
        tried = found if tried is None else tried.unionByName(found)
        # The least order wins ties, and a series whose best order is an earlier one is done.
        best = tried.groupBy("series").agg(F.min_by(F.struct(*NAMES, "round"), F.struct("aic", *NAMES)).alias("o")).select("series", "o.*").filter(F.col("round") == step)
        step += 1
        moved = best.withColumn("m", F.explode(F.array(*map(order, MOVES))))
        moved = moved.select("series", *[(F.col(n) + F.col(f"m.{n}") if n in ("p", "q", "sp", "sq") else F.col(n)).alias(n) for n in NAMES])
        inside = [F.col(n).between(0, t) for n, t in zip(("p", "q", "sp", "sq"), top, strict=True)]
        wanted = moved.filter(inside[0] & inside[1] & inside[2] & inside[3]).distinct().join(tried.select("series", *NAMES), ["series", *NAMES], "left_anti")
    if tried is None:
        return found.withColumn("chosen", F.lit(False))
    least = tried.groupBy("series").agg(F.min_by(F.struct(*NAMES), F.struct("aic", *NAMES)).alias("_o"))
    return tried.join(least, "series").withColumn("chosen", F.struct(*NAMES) == F.col("_o")).drop("_o")



def _chosen(df: DataFrame, orders: DataFrame, value: str) -> DataFrame:
    return in_rows(df, value).join(orders.select("series", *NAMES), "series")


def errors_inside(df: DataFrame, orders: DataFrame, period: int, value: str = "value", places: int = 4) -> DataFrame:
    """(series, idx, observation, predicted, error, abs_error): each sample against its one-step forecast by the likeliest model of its series' order (series, NAMES)."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.x, float)
                y, _ = predicted(x, fitted(x, tuple(int(getattr(r, n)) for n in NAMES), max(period, 1)), 0)
                e = np.round(x - y, places)
                yield pd.DataFrame({"series": r.series, "idx": np.arange(len(x)), "observation": x, "predicted": y, "error": e, "abs_error": np.abs(e)})

    return _chosen(df, orders, value).mapInPandas(run, "series string, idx long, observation double, predicted double, error double, abs_error double")


def forecasts(df: DataFrame, orders: DataFrame, period: int, steps: int = 4, value: str = "value") -> DataFrame:
    """(series, horizon, forecast) by the likeliest model of each series' order (series, NAMES)."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.x, float)
                _, y = predicted(x, fitted(x, tuple(int(getattr(r, n)) for n in NAMES), max(period, 1)), steps)
                yield pd.DataFrame({"series": r.series, "horizon": np.arange(1, steps + 1), "forecast": y})

    return _chosen(df, orders, value).mapInPandas(run, "series string, horizon int, forecast double")


def error_summary(errors: DataFrame, split: Column | None = None) -> DataFrame:
    """(series, [split,] n, mae, max_abs, mean, std) of errors_inside."""
    by = ["series", *([split.alias("split")] if split is not None else [])]
    return errors.groupBy(*by).agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.max("abs_error").alias("max_abs"), F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"))


def possible_orders(period: int, most: tuple[int, int, int, int]) -> list[tuple[int, ...]]:
    """All orders (p, q, sp, sq) of the grid that the search avoids."""
    return list(itertools.product(*(range(n + 1) for n in (most if period > 1 else (*most[:2], 0, 0)))))
