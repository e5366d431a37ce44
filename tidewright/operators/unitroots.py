"""Tests of unit roots, plain and seasonal, from sums of lag products: one pass over blocks, small normal equations after it.

The regressions of all candidate lags of a series are parts of one matrix of products (Gram matrix) of the level and the lagged
differences. Blocks add up their own, cell by cell; only the cells meet by series. Every regression is then solved from the matrix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.spectra import KPSS5, kpss
from tidewright.operators.windows import BLOCK, filtered_series, lag_polynomial

#: Response surfaces of the Dickey-Fuller statistic with a constant (MacKinnon): of its p-value below and above the border, with the ends beyond
#: which it is 0 or 1, and of its points by 1 / n (fixed values).
BORDER, LOW_END, HIGH_END = -1.61, -18.83, 2.74
BELOW, ABOVE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
POINTS = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}
#: Most differences that are tried.
MOST_DIFFERENCES = 5


def p_value(t: float) -> float:
    """Of a Dickey-Fuller statistic with a constant."""
    if t <= LOW_END or t >= HIGH_END:
        return 0.0 if t <= LOW_END else 1.0
    z = sum(c * t**i for i, c in enumerate(BELOW if t <= BORDER else ABOVE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def point(share: float, n: int) -> float:
    return sum(c / n**i for i, c in enumerate(POINTS[share]))


def most_lags(n: Column) -> Column:
    """The lags that are tried with so many samples."""
    return F.greatest(F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2), F.lit(0)).cast("int")


def grams(df: DataFrame, reach: Column, rows_of: Callable[[np.ndarray, int, int, int], np.ndarray], value: str = "value", size: int = BLOCK, head: int = 0) -> DataFrame:
    """(series, n, reach, scale, gram, head): products of the rows that rows_of gives, summed over a series.

    reach is how many samples a row looks back, by n. rows_of gets the samples of a block with those before it, where its own begin and
    which of the whole series that is, and the reach; samples are deviations from the mean over scale, their deviation. head are the first samples.
    """
    stats = df.groupBy("series").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), (F.max("idx") + 1).alias("n"))
    stats = stats.withColumns({"_s": F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0), "reach": reach})
    rows = df.join(stats, "series").select("series", "idx", "n", "reach", "_s", ((F.col(value) - F.col("_m")) / F.col("_s")).alias("v"))
    blocks = F.sequence(F.floor(F.col("idx") / size), F.least(F.floor((F.col("idx") + F.col("reach")) / size), F.floor((F.col("n") - 1) / size)))
    placed = rows.withColumn("b", F.explode(blocks)).groupBy("series", "n", "reach", "_s", "b").agg(F.min("idx").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda r: r["v"]).alias("x"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x, low = np.asarray(r.x, float), r.b * size
                x, first = (x[low - r.reach - r.first :], low - r.reach) if low - r.reach > r.first else (x, r.first)
                z = rows_of(x, low - first, low, int(r.reach))
                out.append((r.series, r.n, r.reach, r.scale, (z.T @ z).ravel(), x[:head].tolist() if r.b == 0 else []))
            yield pd.DataFrame(out, columns=["series", "n", "reach", "scale", "gram", "head"])

    parts = placed.withColumnRenamed("_s", "scale").mapInPandas(run, "series string, n long, reach int, scale double, gram array<double>, head array<double>")
    cells = parts.select("series", "n", "reach", "scale", F.posexplode("gram").alias("at", "g")).groupBy("series", "n", "reach", "scale", "at").agg(F.sum("g").alias("g"))
    whole = cells.groupBy("series", "n", "reach", "scale").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "g"))), lambda r: r["g"]).alias("gram"))
    first = parts.groupBy("series").agg(F.max("head").alias("head"))
    return whole.join(first, "series")


def least_squares(gram: np.ndarray, xs: list[int], y: int, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, their t values, sum of squared residuals) of column y on columns xs of a Gram matrix of n rows."""
    a, b = gram[np.ix_(xs, xs)], gram[xs, y]
    inverse = np.linalg.pinv(a, rcond=1e-13)
    c = inverse @ b
    sse = max(float(gram[y, y] - c @ b), 1e-300)
    return c, c / np.sqrt(np.maximum(sse / max(1, n - len(xs)) * inverse.diagonal(), 1e-300)), sse


def likelihood_criterion(sse: float, n: int, k: int) -> float:
    return n * (math.log(2 * math.pi * sse / n) + 1) + 2 * k


def _level_rows(x: np.ndarray, own: int, at: int, reach: int) -> np.ndarray:
    """Rows (1, level before, differences before, difference) of the samples from own on that have reach - 1 differences before them."""
    d = np.diff(x)
    t = np.arange(max(own, reach - at + own), len(x))
    return np.column_stack([np.ones(len(t)), x[t - 1], *[d[t - 1 - i] for i in range(1, reach)], d[t - 1]])


def dickey_fuller(df: DataFrame, value: str = "value", size: int = BLOCK) -> DataFrame:
    """(series, adf, lags, nobs, p, point1, point5, point10): augmented Dickey-Fuller with a constant; the lags of least AIC over a common sample, then all samples that they allow."""
    made = grams(df, most_lags(F.col("n")) + 1, _level_rows, value, size, head=1 << 12)

    def solved(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                top, n = int(r.reach) - 1, int(r.n - r.reach)
                k = top + 3
                g = np.asarray(r.gram, float).reshape(k, k)
                best, p = min((likelihood_criterion(least_squares(g, list(range(p + 2)), k - 1, n)[2], n, p + 2), p) for p in range(top + 1))
                # The samples that fewer lags allow before the common ones are among the first of the series.
                x = np.asarray(r.head[: top + 1], float)
                keep = [*range(p + 2), k - 1]
                g = g[np.ix_(keep, keep)]
                if top > p:
                    z = _level_rows(x, 0, 0, p + 1)
                    g = g + z.T @ z
                n += top - p
                _, t, _ = least_squares(g, list(range(p + 2)), p + 2, n)
                out.append((r.series, float(t[1]), p, n, p_value(float(t[1])), *[point(s, n) for s in POINTS]))
            yield pd.DataFrame(out, columns=["series", "adf", "lags", "nobs", "p", "point1", "point5", "point10"])

    return made.mapInPandas(solved, "series string, adf double, lags int, nobs long, p double, point1 double, point5 double, point10 double")


def differences_needed(df: DataFrame, most: int = MOST_DIFFERENCES, value: str = "value") -> DataFrame:
    """(series, kpss, ndiffs): the level statistic of the series, and the fewest differences with which it is under its 5 % point, most if none is.

    The differences of all orders are series of their own, so the search takes one round. Its statistic has 3 sqrt(n) / 13 lags; a series that doesn't vary needs none.
    """
    kinds = {f"d{k}": (lag_polynomial(*[1] * k), k) for k in range(most + 1)}
    found = kpss(filtered_series(df, kinds, value), lags=F.floor(3 * F.sqrt("_n") / 13))
    name = F.split("series", r"\|")
    order = F.substring(F.element_at(name, -1), 2, 9).cast("int")
    each = found.select(F.array_join(F.slice(name, F.lit(1), F.size(name) - 1), "|").alias("series"), order.alias("d"), "kpss")
    return each.groupBy("series").agg(F.max(F.when(F.col("d") == 0, F.col("kpss"))).alias("kpss"), F.coalesce(F.min(F.when(F.coalesce("kpss", F.lit(0.0)) <= KPSS5, F.col("d"))), F.lit(most)).alias("ndiffs"))


def stationarity(df: DataFrame, value: str = "value") -> DataFrame:
    """(series, adf, lags, nobs, p, point1, point5, point10, kpss, ndiffs)."""
    return dickey_fuller(df, value).join(differences_needed(df, value=value), "series")


#: Most lags of the seasonal test.
SEASONAL_LAGS = 3


def seasonal_roots(df: DataFrame, period: int, value: str = "value", size: int = BLOCK, lags: int = SEASONAL_LAGS) -> DataFrame:
    """(series, ocsb, lags, point, differences): the test of Osborn, Chui, Smith and Birchenhall, with the lags of least AIC.

    y is the difference of the seasonal difference. An autoregression of y filters the seasonal and the plain differences; y is then
    regressed on its lags, the filtered seasonal difference one sample before and the filtered plain one a season before. A t value of
    the latter above the point asks for a seasonal difference.
    """
    width = 1 + lags + 2 * (lags + 1)

    def rows_of(x: np.ndarray, own: int, at: int, reach: int) -> np.ndarray:
        v, w = np.diff(x), x[period:] - x[:-period] if len(x) > period else np.zeros(0)
        y = np.diff(w)
        t = np.arange(max(own, reach - at + own), len(x))
        if not len(t):
            return np.zeros((0, width))
        return np.column_stack([y[t - period - 1], *[y[t - period - 1 - i] for i in range(1, lags + 1)], *[w[t - 1 - i - period] for i in range(lags + 1)], *[v[t - period - i - 1] for i in range(lags + 1)]])

    made = grams(df, F.lit(period + lags + 1), rows_of, value, size)

    def solved(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g, n = np.asarray(r.gram, float).reshape(width, width), max(0, int(r.n - r.reach))
                tried = []
                for p in range(1, lags + 1) if n > 2 * lags + 8 else ():
                    phi = least_squares(g, list(range(1, p + 1)), 0, n)[0]
                    # y, its lags, and the two differences less what the autoregression says of them.
                    take = np.zeros((width, p + 3))
                    take[0, 0] = 1
                    for i in range(p):
                        take[1 + i, 1 + i] = 1
                    for column, start in ((p + 1, 1 + lags), (p + 2, 2 + 2 * lags)):
                        take[start, column] = 1
                        take[start + 1 : start + 1 + p, column] = -phi
                    h = take.T @ g @ take
                    _, t, sse = least_squares(h, list(range(1, p + 3)), 0, n)
                    tried.append((likelihood_criterion(sse, n, p + 2), p, float(t[-1])))
                border = seasonal_point(period)
                _, p, t = min(tried) if tried else (0.0, 0, 0.0)
                out.append((r.series, t, p, border, int(bool(tried) and t > border)))
            yield pd.DataFrame(out, columns=["series", "ocsb", "lags", "point", "differences"])

    return made.mapInPandas(solved, "series string, ocsb double, lags int, point double, differences int")


def differences(df: DataFrame, period: int = 0, value: str = "value", most: int = MOST_DIFFERENCES) -> DataFrame:
    """(series, d, sd): the differences that the level statistic asks for, and whether the seasonal test asks for one; where it does, d is that of the seasonal difference."""
    plain = differences_needed(df, most, value).select("series", F.col("ndiffs").alias("d"))
    if period < 2:
        return plain.withColumn("sd", F.lit(0))
    roots = seasonal_roots(df, period, value).select("series", F.col("differences").alias("sd"))
    after = differences_needed(filtered_series(df, {"s": (lag_polynomial(period), period)}, value), most).select(F.regexp_replace("series", r"\|s$", "").alias("series"), F.col("ndiffs").alias("_after"))
    both = plain.join(roots, "series").join(after, "series", "left")
    return both.select("series", F.when(F.col("sd") > 0, F.coalesce("_after", F.lit(0))).otherwise(F.col("d")).alias("d"), "sd")


def seasonal_point(period: int) -> float:
    """The smoothed 5 % point of the seasonal statistic by the logarithm of the period (fixed values)."""
    at = math.log(period) - 0.7656451
    return -0.2937411 * math.exp(-0.2850853 * at - 0.05983644 * at * at) - 1.652202
