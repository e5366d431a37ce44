"""Spectra of series: the periodogram as sums of products, Welch's estimate, wavelets, stationarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.windows import BLOCK, autocorrelation


def per_series(df: DataFrame, body, schema: str) -> DataFrame:
    """Applies a sequential function to each series, ordered by idx, in one task a series."""
    return df.groupBy("series").applyInPandas(lambda pdf: body(pdf.sort_values("idx")), schema)


def welch(df: DataFrame, segment: int = 256, fs: float = 1.0, value: str = "value") -> DataFrame:
    """(series, frequency, power): mean of Hann-windowed periodograms of segments that overlap by half.

    Segments are groups of their own, whatever the length of the series; a series shorter than one is one segment.
    """
    sizes = df.groupBy("series").agg((F.max("idx") + 1).alias("_n")).withColumn("_s", F.least(F.col("_n"), F.lit(segment)))
    hop = F.greatest(F.floor(F.col("_s") / 2), F.lit(1))
    last = F.floor((F.col("_n") - F.col("_s")) / hop)
    own = F.floor(F.col("idx") / hop)
    first = F.greatest(F.ceil((F.col("idx") - F.col("_s") + 1) / hop), F.lit(0))
    placed = df.join(sizes, "series").filter(first <= F.least(own, last)).select("series", "idx", F.col(value).alias("v"), "_s", F.explode(F.sequence(first, F.least(own, last))).alias("part"))
    parts = placed.groupBy("series", "part", "_s").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("x"))

    def run(batches):
        for pdf in batches:
            out = []
            for raw in pdf["x"]:
                x = np.asarray(raw, float)
                w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x))
                p = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (fs * (w * w).sum())
                p[1 : (None if len(x) % 2 else -1)] *= 2
                out.append(p)
            yield pd.DataFrame({"series": pdf["series"], "n": pdf["_s"], "power": out})

    each = parts.select("series", "_s", "x").mapInPandas(run, "series string, n long, power array<double>")
    rows = each.select("series", "n", F.posexplode("power").alias("k", "power"))
    return rows.groupBy("series", "n", "k").agg(F.avg("power").alias("power")).select("series", (F.col("k") * fs / F.col("n")).alias("frequency"), "power")


def periodogram(df: DataFrame, fs: float = 1.0, value: str = "value") -> DataFrame:
    """(series, k, power) of every value of each series less their mean: one-sided density at n // 2 + 1 frequencies k fs / n."""

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        n = len(x)
        p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / (n * fs)
        p[1 : (None if n % 2 else -1)] *= 2
        return pd.DataFrame({"series": pdf["series"].iloc[0], "k": np.arange(len(p)), "power": p})

    return per_series(df, body, "series string, k long, power double")


def correlograms(df: DataFrame, season: int, value: str = "value") -> DataFrame:
    """(series, lag, r): biased autocorrelations of a series and its three differences, named series|kind, at all lags under n // 4."""

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        x, name, out = pdf[value].to_numpy(float), pdf["series"].iloc[0], []
        d = np.diff(x)
        for kind, z in (("plain", x), ("diff1", d), ("diff2", np.diff(x, 2)), ("diff1s", d[season:] - d[:-season])):
            n = len(z)
            if top := min(len(x) // 4, n):
                z = z - z.mean()
                r = np.fft.irfft(np.abs(np.fft.rfft(z, 2 * n)) ** 2, 2 * n)[:top]
                s = (z * z).sum()
                out.append(pd.DataFrame({"series": f"{name}|{kind}", "lag": np.arange(top), "r": r / s if s else np.full(top, np.nan)}))
        return pd.concat(out) if out else pd.DataFrame({"series": [], "lag": [], "r": []})

    return per_series(df, body, "series string, lag int, r double")


def partial_autocorrelation(df: DataFrame, lags: int, value: str = "value") -> DataFrame:
    """(series, lag, r): Durbin-Levinson recursion on the biased autocorrelations, which come from blocks; only they meet by series."""
    r = autocorrelation(df, list(range(1, lags + 1)), value)
    row = r.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "r"))), lambda x: x["r"]).alias("r"))

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf["series"], pdf["r"], strict=True):
                r, phi, out, v = np.concatenate([[1.0], raw]), np.zeros(0), [], 1.0
                for m in range(1, len(r)):
                    a = (r[m] - (phi * r[m - 1 : 0 : -1]).sum()) / v if m > 1 else r[1]
                    phi = np.append(phi - a * phi[::-1], a)
                    v *= 1 - a * a
                    out.append(a)
                yield pd.DataFrame({"series": name, "lag": np.arange(1, len(r)), "r": out})

    return row.mapInPandas(run, "series string, lag int, r double")


#: Levels of the wavelets: aligned blocks of 2 to that power are transformed each by itself.
LEVELS = 6


def haar_denoised(df: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """(series, idx, approximation, denoised): Haar wavelets; details under the threshold go; the approximation has none.

    A series is centred in the next power of two, its ends mirrored. Haar's steps stay within aligned blocks, so each block that holds a
    sample is a group of its own; those at the ends get the mirrored samples too.
    """
    n = df.groupBy("series").agg((F.max("idx") + 1).alias("_n")).withColumn("_p", F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2("_n"))), F.lit(2.0)).cast("long"))
    sizes = n.withColumns({"_left": F.floor((F.col("_p") - F.col("_n")) / 2), "_size": F.least(F.col("_p"), F.lit(1 << LEVELS))})
    # Places of a sample: its own, and those of its mirror images that share a block with a sample.
    around = F.ceil(F.col("_size") / F.col("_n")).cast("int") + 1
    at = F.col("idx") + F.col("_left")
    mirror = F.col("_left") - 1 - F.col("idx")
    every = F.flatten(F.transform(F.sequence(-around, around), lambda k: F.array(at + k * 2 * F.col("_n"), mirror + k * 2 * F.col("_n"))))
    low = F.floor(F.col("_left") / F.col("_size")) * F.col("_size")
    high = (F.floor((F.col("_left") + F.col("_n") - 1) / F.col("_size")) + 1) * F.col("_size")
    near = F.filter(every, lambda p: (p >= low) & (p < high))
    placed = df.join(sizes, "series").select("series", F.col(value).alias("v"), "_size", "_left", "_n", F.explode(near).alias("p"))
    blocks = placed.groupBy("series", "_size", "_left", "_n", F.floor(F.col("p") / F.col("_size")).alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("x"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, details = np.asarray(r.x, float), []
                while len(a) > 1:
                    details.append((a[::2] - a[1::2]) / math.sqrt(2))
                    a = (a[::2] + a[1::2]) / math.sqrt(2)
                made = []
                for keep in (False, True):
                    y = a
                    for d in details[::-1]:
                        d = np.where(np.abs(d) < threshold, 0, d) if keep else np.zeros_like(d)
                        y = np.stack([(y + d) / math.sqrt(2), (y - d) / math.sqrt(2)], 1).ravel()
                    made.append(y)
                idx = r.b * r.size + np.arange(r.size) - r.left
                own = (idx >= 0) & (idx < r.n)
                yield pd.DataFrame({"series": r.series, "idx": idx[own], "approximation": made[0][own], "denoised": made[1][own]})

    ready = blocks.select("series", F.col("_size").alias("size"), F.col("_left").alias("left"), F.col("_n").alias("n"), "b", "x")
    return ready.mapInPandas(run, "series string, idx long, approximation double, denoised double")


def kpss(df: DataFrame, value: str = "value", lags: Column | None = None) -> DataFrame:
    """(series, lags, kpss): the level statistic, from partial sums within blocks and lagged products; no series meets in one task.

    lags are given by the number of samples _n; 12 (_n / 100)^0.25 if not.
    """
    stats = df.groupBy("series").agg(F.avg(value).alias("_m"), F.count("*").alias("_n"), F.var_pop(value).alias("_v"))
    centred = df.join(stats, "series").select("series", "idx", (F.col(value) - F.col("_m")).alias("value"), F.floor(F.col("idx") / BLOCK).alias("_b"))
    blocks = centred.groupBy("series", "_b").agg(F.sum("value").alias("_s"))
    before = blocks.select("series", "_b", F.coalesce(F.sum("_s").over(Window.partitionBy("series").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.sum("value").over(Window.partitionBy("series", "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = centred.withColumn("_c", inside).join(before, ["series", "_b"]).groupBy("series").agg(F.sum((F.col("_c") + F.col("_before")) ** 2).alias("_cc"))
    top = lags if lags is not None else F.ceil(12 * F.pow(F.col("_n") / 100, F.lit(0.25)))
    most = stats.select(F.max(top)).first()[0] or 0
    r = autocorrelation(df, list(range(1, max(1, int(most)) + 1)), value).join(stats.select("series", "_n", top.alias("q")), "series").filter((F.col("lag") <= F.col("q")) & (F.col("lag") < F.col("_n")))
    long = r.groupBy("series").agg(F.sum((1 - F.col("lag") / (F.col("q") + 1)) * F.col("r")).alias("_w"))
    variance = F.col("_n") * F.col("_v") * (1 + 2 * F.coalesce("_w", F.lit(0.0)))
    return stats.join(sums, "series").join(long, "series", "left").select("series", top.cast("int").alias("lags"), F.try_divide(F.col("_cc") / F.col("_n"), variance).alias("kpss"))


#: The 5 % point of the KPSS (level) statistic.
KPSS5 = 0.463


#: Points of 5 % of the seasonal stability statistic by its degrees of freedom, from 1 on (fixed values).
STABILITY5 = (0.470, 0.749, 1.010, 1.240, 1.470, 1.680, 1.900, 2.110, 2.320, 2.540, 2.750, 2.960)


def canova_hansen(x: np.ndarray, period: int) -> tuple[float, float, int]:
    """(statistic, its 5 % point, seasonal differences): whether a seasonal pattern stays as it is.

    The residuals of the series on a constant and the waves of the period are summed up wave by wave; their long-run covariance has
    Bartlett weights over period * (n / 100)^0.25 lags. Beyond the table the point grows by 0.214 a degree.
    """
    x, n = np.asarray(x, float), len(x)
    t = np.arange(1, n + 1)
    waves = [f(2 * np.pi * k * t / period) for k in range(1, period // 2 + 1) for f in (np.cos, np.sin) if not (f is np.sin and 2 * k == period)]
    z = np.column_stack(waves)
    a = np.column_stack([np.ones(n), z])
    e = x - a @ np.linalg.lstsq(a, x, rcond=None)[0]
    f = z * e[:, None]
    lags = int(round(period * (n / 100) ** 0.25))
    omega = f.T @ f / n
    for i in range(1, min(lags, n - 1) + 1):
        c = f[i:].T @ f[:-i] / n
        omega += (1 - i / (lags + 1)) * (c + c.T)
    sums = f.cumsum(0)
    statistic = float(np.trace(np.linalg.pinv(omega) @ (sums.T @ sums)) / n**2)
    df = z.shape[1]
    point = STABILITY5[df - 1] if df <= len(STABILITY5) else STABILITY5[-1] + 0.214 * (df - len(STABILITY5))
    return statistic, point, int(statistic > point)


def stability(df: DataFrame, period: int, value: str = "value") -> DataFrame:
    """(series, ch, ch_point, ch_differences): whether the seasonal pattern of each series, which is one task, stays as it is."""

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["series"].iloc[0], *canova_hansen(pdf[value].to_numpy(float), period))], columns=["series", "ch", "ch_point", "ch_differences"])

    return per_series(df, body, "series string, ch double, ch_point double, ch_differences int")


def seasonality(df: DataFrame, period: int, value: str = "value") -> DataFrame:
    """(series, ch, ch_point, ch_differences, ocsb, ocsb_differences)."""
    from tidewright.operators.unitroots import seasonal_roots

    roots = seasonal_roots(df, period, value).select("series", "ocsb", F.col("differences").alias("ocsb_differences"))
    return stability(df, period, value).join(roots, "series")
