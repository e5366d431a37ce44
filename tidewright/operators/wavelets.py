"""Daubechies wavelets of series, at all levels: filter banks in blocks, so that no series meets in one task.

A series is first padded to a power of two where it is shorter than 2^16, half at each end; beyond its ends it goes on as the straight line
through the last two samples, at every level. A block carries what the filters of its levels reach before it: a level of
a filter of L taps needs L - 2 samples to the left, so m levels need (L - 2)(2^m - 1), which doubles with each level. As many levels as
half a block has room for are made in one pass; the approximations of all blocks, so much shorter, are dealt to blocks again for the next.
Reconstruction needs L coefficients of every level beyond a block only, and is one pass.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.windows import BLOCK

#: Orders that the surveyed analysis reports, of those from 1 to 38 that it lists (fixed values).
ORDERS = (1, 2, 10, 20, 30, 38)
#: Samples of the arrays in which rows are gathered first.
PIECE = 4096
#: Series of at least so many samples aren't padded.
PADDED = 1 << 16


@cache
def daubechies(order: int) -> np.ndarray:
    """The 2 * order taps of the scaling filter: the factor of smallest phase of the half-band polynomial, by its cepstrum."""
    m = 1 << 14
    w = 2 * np.pi * np.arange(m) / m
    y, power, term = np.sin(w / 2) ** 2, np.zeros(m), np.ones(m)
    for k in range(order):
        power += term
        term = term * y * (order + k) / (k + 1)
    c = np.fft.ifft(0.5 * np.log(power)).real
    c[1 : m // 2] *= 2
    c[m // 2 + 1 :] = 0
    spectrum = np.sqrt(2) * ((1 + np.exp(-1j * w)) / 2) ** order * np.exp(np.fft.fft(c))
    return np.fft.ifft(spectrum).real[: 2 * order]


def filters(order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high) of the analysis, (low, high) of the synthesis."""
    h = daubechies(order)
    high = np.where(np.arange(2 * order) % 2, 1.0, -1.0) * h
    return h[::-1], high, h, high[::-1]


def top_level(n: int, taps: int) -> int:
    """The largest level at which a filter isn't longer than what it filters."""
    return max(0, int(np.floor(np.log2(n / (taps - 1))))) if n >= taps - 1 else 0


def longer(x: np.ndarray, left: int, right: int) -> np.ndarray:
    """x continued at its ends along straight lines."""
    a, b = (x[0] - x[1], x[-1] - x[-2]) if len(x) > 1 else (0.0, 0.0)
    return np.concatenate([x[0] + a * np.arange(left, 0, -1), x, x[-1] + b * np.arange(1, right + 1)])


def split(x: np.ndarray, first: int, n: int, order: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(place of the first coefficient, approximations, details) of samples from a place on, of a sequence of n."""
    low, high, _, _ = filters(order)
    taps = 2 * order
    left, right = (taps - 2) * (first == 0), (taps - 1) * (first + len(x) == n)
    x, first = longer(x, left, right), first - left
    k = np.arange(-(-(first + taps - 2) // 2), (first + len(x) - 2) // 2 + 1)
    at = 2 * k + 1 - first
    return int(k[0]) if len(k) else 0, np.convolve(x, low)[at], np.convolve(x, high)[at]


def joined(a: np.ndarray, at_a: int, d: np.ndarray, at_d: int, low: int, high: int, order: int) -> np.ndarray:
    """Samples low to high of the level below, from coefficients that begin at the given places."""
    _, _, rec_low, rec_high = filters(order)
    out = np.zeros(high - low)
    for c, at, taps in ((a, at_a, rec_low), (d, at_d, rec_high)):
        up = np.zeros(2 * len(c))
        up[::2] = c
        y, start = np.convolve(up, taps), low - 2 * at + 2 * order - 2
        own = y[max(start, 0) : start + high - low]
        out[max(-start, 0) : max(-start, 0) + len(own)] += own
    return out


def padded(df: DataFrame, value: str = "value") -> DataFrame:
    """(series, p, v, left, n): the samples at their places in the padded series, of which left come before the first, and n in all."""
    size = df.groupBy("series").agg((F.max("idx") + 1).alias("_n"))
    up = F.pow(F.lit(2.0), F.ceil(F.round(F.log2("_n"), 9))).cast("long")
    size = size.withColumn("_more", F.when((F.col("_n") > 4) & (F.col("_n") < PADDED), up - F.col("_n")).otherwise(0))
    size = size.select("series", "_n", F.floor(F.col("_more") / 2).alias("left"), (F.col("_n") + F.col("_more")).alias("n"))
    rows = df.join(size, "series").select("series", "idx", F.col(value).cast("double").alias("v"), "left", "n", "_n")
    ends = rows.filter("idx < 2 or idx >= _n - 2").groupBy("series").agg(*[F.max(F.when(F.col("idx") == at, F.col("v"))).alias(name) for name, at in (("a", F.lit(0)), ("b", F.lit(1)), ("y", F.col("_n") - 2), ("z", F.col("_n") - 1))])
    # The first sample brings those before it along, the last one those after it.
    own = F.struct((F.col("idx") + F.col("left")).alias("p"), F.col("v").alias("v"))
    line = lambda n, at, value, slope: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), lambda m: F.struct(at(m).alias("p"), (value + m * slope).alias("v")))).otherwise(F.array().cast("array<struct<p:bigint,v:double>>"))
    before = line(F.col("left"), lambda m: F.col("left") - m, F.col("a"), F.coalesce(F.col("a") - F.col("b"), F.lit(0.0)))
    after = line(F.col("n") - F.col("_n") - F.col("left"), lambda m: F.col("left") + F.col("_n") - 1 + m, F.col("z"), F.coalesce(F.col("z") - F.col("y"), F.lit(0.0)))
    none = F.array().cast("array<struct<p:bigint,v:double>>")
    every = F.concat(F.array(own), F.when(F.col("idx") == 0, before).otherwise(none), F.when(F.col("idx") == F.col("_n") - 1, after).otherwise(none))
    return rows.join(ends.drop("left", "n", "_n"), "series").select("series", F.explode(every).alias("x"), "left", "n").select("series", "x.p", "x.v", "left", "n")


def in_arrays(found: DataFrame, size: int, before: int) -> DataFrame:
    """Pieces (series, left, n0, top, level, n, start, x) by block: what a block of size samples, and before ones ahead of it, holds, in order."""
    reach = F.sequence(F.floor(F.col("start") / size), F.least(F.floor((F.col("start") + F.size("x") - 1 + before) / size), F.floor((F.col("n") - 1) / size)))
    placed = found.withColumn("b", F.explode(reach))
    rows = F.sort_array(F.collect_list(F.struct("start", "x")))
    return placed.groupBy("series", "left", "n0", "top", "level", "n", "b").agg(F.transform(rows, lambda r: r["start"]).alias("starts"), F.flatten(F.transform(rows, lambda r: r["x"])).alias("x"))


_PIECES = "series string, left long, n0 long, top int, level int, n long, start long, x array<double>"


def coefficients(df: DataFrame, order: int, value: str = "value", size: int = BLOCK, pad: bool = True) -> DataFrame:
    """(series, left, n0, top, level, n, start, x, detail): all details and the last approximations, as arrays from a place of their level on.

    n is the length of the level, n0 that of the padded series, top the number of levels.
    """
    taps = 2 * order
    size = 1 << int(np.ceil(np.log2(max(size, 4 * taps))))
    step = max(1, int(np.log2(size / 2 / max(taps - 2, 1) + 1))) if taps > 2 else int(np.log2(size))
    rows = padded(df, value) if pad else df.join(df.groupBy("series").agg((F.max("idx") + 1).alias("n")), "series").select("series", F.col("idx").alias("p"), F.col(value).cast("double").alias("v"), F.lit(0).cast("long").alias("left"), "n")
    top = F.greatest(F.floor(F.round(F.log2(F.col("n") / (taps - 1)), 9)), F.lit(0)).cast("int")
    start = (F.floor(F.col("p") / PIECE) * PIECE).alias("start")
    pieces = rows.groupBy("series", "left", F.col("n").alias("n0"), F.when(F.col("n") >= taps - 1, top).otherwise(0).alias("top"), F.lit(0).alias("level"), "n", start).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda r: r["v"]).alias("x"))
    most = pieces.agg(F.max("top")).first()[0] or 0

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                head = (r.series, r.left, r.n0, r.top)
                x, first, n, low, high = np.asarray(r.x, float), int(r.starts[0]), int(r.n), r.b * size, min((r.b + 1) * size, r.n)
                skip = max(0, low - (taps - 2) * ((1 << step) - 1) - first)
                x, first = x[skip:], first + skip
                x = x[: high - first]
                for level in range(r.level + 1, min(r.level + step, r.top) + 1):
                    last = high == n
                    first, x, d = split(x, first, n, order)
                    n = (n + taps - 1) // 2
                    low, high = low // 2, n if last else high // 2
                    out.append((*head, level, n, low, d[low - first : high - first], True))
                level = min(r.level + step, r.top)
                out += [(*head, level, n, a, x[a - first : min(a + PIECE, high) - first], False) for a in range(low, high, PIECE)]
            yield pd.DataFrame(out, columns=["series", "left", "n0", "top", "level", "n", "start", "x", "detail"])

    done, now = [], pieces
    for level in range(0, max(most, 1), step):
        made = in_arrays(now, size, (taps - 2) * ((1 << step) - 1)).mapInPandas(run, _PIECES + ", detail boolean")
        done.append(made.filter(F.col("detail") | (F.col("level") == F.col("top"))))
        now = made.filter(~F.col("detail") & (F.col("level") < F.col("top"))).drop("detail")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def denoised(df: DataFrame, order: int, threshold: float = 0.1, value: str = "value", size: int = BLOCK, pad: bool = True) -> DataFrame:
    """(series, idx, approximation, denoised): the series from its last approximation alone, and from all coefficients but details under the threshold."""
    taps = 2 * order
    size = 1 << int(np.ceil(np.log2(max(size, 4 * taps))))

    def dealt(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x, end = np.asarray(r.x, float), r.start + len(r.x)
                blocks = -(-r.n0 // size)
                for b in range(max(0, ((r.start - taps - 1) << r.level) // size - 1), min(blocks - 1, (end << r.level) // size) + 1):
                    low, high = max(r.start, (b * size) >> r.level), min(end, (((b + 1) * size) >> r.level) + taps + 1)
                    if low < high:
                        out.append((r.series, r.left, r.n0, r.top, r.level, r.n, low, x[low - r.start : high - r.start], r.detail, b))
            yield pd.DataFrame(out, columns=["series", "left", "n0", "top", "level", "n", "start", "x", "detail", "b"])

    sent = coefficients(df, order, value, size, pad).mapInPandas(dealt, _PIECES + ", detail boolean, b long")
    parts = sent.groupBy("series", "left", "n0", "top", "b").agg(F.sort_array(F.collect_list(F.struct("level", "detail", "start", "n", "x"))).alias("c"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                held, sizes = {}, {0: r.n0}
                for c in r.c:
                    held.setdefault((c["level"], c["detail"]), []).append((c["start"], c["x"]))
                    sizes[c["level"]] = c["n"]
                held = {k: (v[0][0], np.concatenate([np.asarray(x, float) for _, x in v])) for k, v in held.items()}
                spans = [(r.b * size, min((r.b + 1) * size, r.n0))]
                for level in range(1, r.top + 1):
                    a, b = spans[-1]
                    spans.append((a // 2, min(sizes[level], (b + taps - 3) // 2 + 1)))
                made = []
                for least in (np.inf, threshold):
                    at, x = held[r.top, False]
                    for level in range(r.top, 0, -1):
                        at_d, d = held[level, True]
                        low, high = spans[level - 1]
                        x = joined(x, at, np.where(np.abs(d) < least, 0.0, d), at_d, low, high, order)
                        at = low
                    low, high = spans[0]
                    made.append(x[low - at : high - at])
                yield pd.DataFrame({"series": r.series, "idx": np.arange(*spans[0]) - r.left, "_n": r.n0 - r.left, "approximation": made[0], "denoised": made[1]})

    found = parts.mapInPandas(run, "series string, idx long, _n long, approximation double, denoised double")
    own = df.groupBy("series").agg((F.max("idx") + 1).alias("_own"))
    return found.join(own, "series").filter("idx >= 0 and idx < _own").drop("_n", "_own")


def family(df: DataFrame, orders: tuple[int, ...] = ORDERS, threshold: float = 0.1, value: str = "value") -> DataFrame:
    """(series, wavelet, idx, approximation, denoised) by the wavelets of several orders, named db1, db2 and so on."""
    out = None
    for order in orders:
        one = denoised(df, order, threshold, value).withColumn("wavelet", F.lit(f"db{order}"))
        out = one if out is None else out.unionByName(one)
    return out
