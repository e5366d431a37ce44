"""Least squares on any number of columns from grouped sums, analysis of variance, and tests of event rates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.windows import differences


#: Share of a column's variance that the columns before it must leave for it to count as one of its own.
RANK = 1e-10


def gram(df: DataFrame, y: Column, xs: list[Column], by: list[str]) -> DataFrame:
    """(by, n, mean, gram): means of the x and y, and the sums of products of their deviations, row by row, over rows without nulls.

    The sums come from covariances, which are merged about the means of their parts, so a large constant costs no digits.
    """
    names = [f"_x{i}" for i in range(len(xs))] + ["_y"]
    rows = df.select(*by, *[c.cast("double").alias(n) for c, n in zip([*xs, y], names, strict=True)]).dropna(subset=names)
    pairs = {(i, j): F.covar_pop(names[i], names[j]) * F.count("*") for i in range(len(names)) for j in range(i, len(names))}
    whole = F.array(*[pairs[min(i, j), max(i, j)] for i in range(len(names)) for j in range(len(names))])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(n) for n in names]).alias("mean"), whole.alias("gram")).filter("n > 0")


def fitted(n: int, mean: np.ndarray, gram: np.ndarray) -> tuple[int, list[float | None], float, float]:
    """(rank, coefficients from the constant on, sum of squares of y, of the residuals), by Cholesky's method; columns that depend on earlier ones have none."""
    k = len(mean) - 1
    g, used = gram.reshape(k + 1, k + 1).copy(), []
    scale = g.diagonal().copy()
    for i in range(k):  # what the columns so far leave of the others
        if g[i, i] > RANK * scale[i] and scale[i] > 0:
            used.append(i)
            g = g - np.outer(g[:, i], g[i]) / g[i, i]
    b: list[float | None] = [None] * (k + 1)
    whole = gram.reshape(k + 1, k + 1)
    if used:
        root = np.sqrt(scale[used])
        lower = np.linalg.cholesky(whole[np.ix_(used, used)] / np.outer(root, root))
        own = np.linalg.solve(lower.T, np.linalg.solve(lower, whole[used, k] / root)) / root
        for i, v in zip(used, own, strict=True):
            b[i + 1] = float(v)
    b[0] = float(mean[k] - sum(b[i + 1] * mean[i] for i in used))
    return len(used) + 1, b, float(whole[k, k]), max(0.0, float(g[k, k]))


def solved(grams: DataFrame) -> DataFrame:
    """Adds rank, b (the constant first), sst and sse: least squares of y on a constant and the x, one small system a row."""

    def run(parts):
        for pdf in parts:
            found = [fitted(n, np.asarray(m, float), np.asarray(g, float)) for n, m, g in zip(pdf["n"], pdf["mean"], pdf["gram"], strict=True)]
            yield pdf.assign(rank=[f[0] for f in found], b=[f[1] for f in found], sst=[f[2] for f in found], sse=[f[3] for f in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema)
    return grams.mapInPandas(run, f"{schema}, rank int, b array<double>, sst double, sse double")


def line(b: Column, xs: list[Column]) -> Column:
    """What coefficients say of the x; columns without one count as nothing."""
    return sum((F.coalesce(F.get(b, F.lit(i + 1)), F.lit(0.0)) * x for i, x in enumerate(xs)), F.get(b, F.lit(0)))


def anova(df: DataFrame, y: Column, xs: list[Column], by: str) -> DataFrame:
    """One row: separate planes by category against one plane for all: n, k categories, p coefficients, sse, ssb, mse, f, divergence."""
    own = solved(gram(df, y, xs, [by])).agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"), F.count("*").alias("k"))
    one = solved(gram(df, y, xs, [])).select(F.col("sse").alias("sse_pooled"))
    both = own.join(one).withColumn("p", F.lit(len(xs) + 1))  # one row each
    ssb, mse = F.col("sse_pooled") - F.col("sse"), F.col("sse") / (F.col("n") - F.col("p") * F.col("k"))
    return both.select("n", "k", "p", "sse", ssb.alias("ssb"), mse.alias("mse"), (ssb / (F.col("p") * (F.col("k") - 1)) / mse).alias("f"), (ssb / mse).alias("divergence"))


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_quantile(q: float, dfn: float, dfd: float) -> float | None:
    """The value below which a share q of the F distribution lies; None unless q is between 0 and 1."""
    if not 0 < q < 1:
        return None
    low, high = 0.0, 1.0
    for _ in range(200):  # x = dfn F / (dfn F + dfd)
        mid = (low + high) / 2
        low, high = (mid, high) if _beta(dfn / 2, dfd / 2, mid) < q else (low, mid)
    return dfd * low / (dfn * (1 - low))


def decision(table: DataFrame) -> DataFrame:
    """A one-row table of anova with dfn, dfd, critical, the 95 % point of its F distribution, and quantile, the point at the divergence's F taken as a share."""

    def run(parts):
        for pdf in parts:
            dfn, dfd = pdf["p"] * (pdf["k"] - 1), pdf["n"] - pdf["p"] * pdf["k"]
            share = pdf["divergence"] / dfn
            at = lambda q: [f_quantile(x, a, b) for x, a, b in zip(q, dfn, dfd, strict=True)]
            yield pdf.assign(dfn=dfn, dfd=dfd, critical=at([0.95] * len(pdf)), quantile=at(share))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInPandas(run, f"{schema}, dfn long, dfd long, critical double, quantile double")


def shapes(df: DataFrame, columns: list[str], y: str, by: str) -> DataFrame:
    """One row: k categories, n rows, p features, and whether every category has a value of y for each of its rows and as many of each feature."""
    whole = F.count(y) == F.count("*")
    for c in columns:
        whole = whole & (F.count(c) == F.count("*"))
    each = df.groupBy(by).agg(F.count("*").alias("n"), whole.alias("whole"))
    return each.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit(len(columns)).alias("p"), (F.coalesce(F.every("whole"), F.lit(False))).alias("valid"))


def predicted(df: DataFrame, y: Column, xs: list[Column], by: str) -> DataFrame:
    """The rows with own and pooled: what the plane of their category, and the one of all, say."""
    own = solved(gram(df, y, xs, [by])).select(F.col(by).alias("_by"), F.col("b").alias("_own"))
    one = solved(gram(df, y, xs, [])).select(F.col("b").alias("_one"))
    both = df.join(own, F.col(by).eqNullSafe(F.col("_by"))).join(F.broadcast(one))  # one row
    return both.withColumns({"own": line(F.col("_own"), xs), "pooled": line(F.col("_one"), xs)}).drop("_by", "_own", "_one")


def quality(df: DataFrame, y: Column, xs: list[Column]) -> DataFrame:
    """One row: fit of y on a constant and the x: n, rank, b, r2, sigma2, mean_abs, max_abs, f, from one more pass over the residuals."""
    fit = solved(gram(df, y, xs, []))
    e = df.join(F.broadcast(fit.select("b", "sst", "rank"))).select((y - line(F.col("b"), xs)).alias("e"), "b", "sst", "rank").dropna(subset=["e"])  # one row
    q = e.agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("sse"), F.avg(F.abs("e")).alias("mean_abs"), F.max(F.abs("e")).alias("max_abs"), *[F.first(c).alias(c) for c in ("b", "sst", "rank")])
    ssr, k = F.col("sst") - F.col("sse"), F.col("rank") - 1
    return q.select("n", "rank", "b", (ssr / F.col("sst")).alias("r2"), (F.col("sse") / (F.col("n") - 1)).alias("sigma2"), "mean_abs", "max_abs", (ssr / k / (F.col("sse") / (F.col("n") - 1 - k))).alias("f"))


#: Bands of a density, by thirds of its range (fixed values).
BANDS = ("LOW", "MID", "HIGH")


def density_subsets(df: DataFrame, output: str, source: str, least: float = 1e-6) -> DataFrame:
    """Adds density, output over source; flag, -1 where the source is under least and 0 else; d and dd, the source's differences; and band, by thirds of the density's range, null for flagged rows.

    A third is closed above, and the lowest one below; its width is rounded to 4 places, so the highest values may have no band.
    """
    rows = differences(df.withColumnRenamed(source, "_s"), 1, "_s").select(*[F.col("_s").alias(source) if c == source else F.col(c) for c in df.columns], F.col("d1").alias("d"), F.col("d2").alias("dd"))
    rows = rows.withColumn("flag", F.when(F.abs(source) < least, -1).otherwise(0))
    rows = rows.withColumn("density", F.when(F.col("flag") == 0, F.bround(F.col(output) / F.col(source), 4)))
    ends = rows.agg(F.min("density").alias("_low"), F.max("density").alias("_high"))
    both = rows.join(F.broadcast(ends))  # one row
    third = F.bround((F.col("_high") - F.col("_low")) / 3, 4)
    x = F.col("density")
    band = F.when(x <= F.col("_low") + third, BANDS[0]).when(x <= F.col("_low") + 2 * third, BANDS[1]).when(x <= F.col("_high"), BANDS[2])
    return both.withColumn("band", band).drop("_low", "_high")


def exponential_rates(gaps: DataFrame, least: int, key: str = "key") -> DataFrame:
    """(key, n, rate, variance) of exponential gaps in seconds, for keys with enough of them."""
    n = gaps.groupBy(key).agg(F.count("*").alias("n"), F.sum("gap").alias("total")).filter((F.col("n") >= least) & (F.col("total") > 0))
    rate = F.col("n") / F.col("total")
    return n.select(key, "n", rate.alias("rate"), (rate * rate / F.col("n")).alias("variance"))


#: The 5 % point of the chi-square distribution with one degree of freedom.
CHI2 = 3.84


def rate_divergence(train: DataFrame, test: DataFrame, key: str = "key") -> DataFrame:
    """(key, directed, divergence, anomaly): Kullback statistics of two exponential rates, against CHI2."""
    both = train.select(key, F.col("rate").alias("r1"), F.col("n").alias("n1")).join(test.select(key, F.col("rate").alias("r2"), F.col("n").alias("n2")), key)
    ratio = F.col("r1") / F.col("r2")
    directed = 2 * F.col("n2") * (F.log(1 / ratio) + ratio - 1)
    divergence = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")) * (ratio + 1 / ratio - 2)
    return both.select(key, directed.alias("directed"), divergence.alias("divergence"), ((directed > CHI2) | (divergence > CHI2)).alias("anomaly"))


def gap_divergence(train: DataFrame, test: DataFrame, key: str = "key", units: float = 1e6) -> DataFrame:
    """(key, directed, divergence, anomaly): squared differences of two mean gaps from their pooled mean, over that and over the means.

    Gaps count in microseconds; the statistics grow with the unit.
    """
    both = train.select(key, F.col("n").alias("n1"), (units / F.col("rate")).alias("x1")).join(test.select(key, F.col("n").alias("n2"), (units / F.col("rate")).alias("x2")), key)
    pooled = both.withColumn("x", (F.col("n1") * F.col("x1") + F.col("n2") * F.col("x2")) / (F.col("n1") + F.col("n2")))
    square = lambda i: F.col(f"n{i}") * (F.col(f"x{i}") - F.col("x")) * (F.col(f"x{i}") - F.col("x"))
    directed = (square(1) + square(2)) / F.col("x")
    divergence = 0.5 * directed + 0.5 * (square(1) / F.col("x1") + square(2) / F.col("x2"))
    return pooled.select(key, directed.alias("directed"), divergence.alias("divergence"), ((directed > CHI2) | (divergence > CHI2)).alias("anomaly"))


def poisson_log(n: Column, rate: Column) -> Column:
    """Logarithm of the Poisson probability of n events; at a rate of 0 none is certain and any are impossible."""
    power = F.when(rate == 0, F.when(n == 0, 0.0).otherwise(float("-inf"))).otherwise(n * F.log(rate))
    return -rate + power - F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def ks_points(bins: int) -> list[float]:
    """Exact two-sided p-values of a Kolmogorov-Smirnov statistic of h / bins, h = 0 to bins, for two samples of bins values."""
    c = math.comb
    return [1.0, *(2 * sum((-1) ** (j - 1) * c(2 * bins, bins - j * h) for j in range(1, bins // h + 1)) / c(2 * bins, bins) for h in range(1, bins + 1))]


def histogram_anomaly(train: DataFrame, test: DataFrame, rates: DataFrame, bins: int = 10) -> DataFrame:
    """(key, n, rate, p_n, d, ks, p, anomaly) of keys in both periods, from two tables (key, bin, n) and rates (key, n, rate).

    d is the largest difference of the bins' shares, ks and p compare the two sets of shares as samples; keys without both
    histograms have 0, 0 and 0.6. p_n is the Poisson probability of the n packets of a key.
    """
    total = lambda df, name: df.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("_h"), F.sum("n").alias("_s")).select("key", F.transform("_h", lambda x: x["n"] / F.col("_s")).alias(name))
    both = rates.join(total(train, "_a"), "key", "left").join(total(test, "_b"), "key", "left")
    below = lambda column, x: F.size(F.filter(column, lambda v: v <= x))
    h = F.array_max(F.transform(F.concat("_a", "_b"), lambda x: F.abs(below("_a", x) - below("_b", x))))
    found = both.withColumns({"_k": F.coalesce(h, F.lit(0)), "_known": F.col("_a").isNotNull() & F.col("_b").isNotNull()})
    d = F.coalesce(F.array_max(F.zip_with("_a", "_b", lambda a, b: F.abs(a - b))), F.lit(0.0))
    p = F.when(F.col("_known"), F.element_at(F.array(*map(F.lit, ks_points(bins))), F.col("_k") + 1)).otherwise(0.6)
    return found.select("key", "n", "rate", F.exp(poisson_log(F.col("n"), F.col("rate"))).alias("p_n"), d.alias("d"), (F.col("_k") / bins).alias("ks"), p.alias("p"), (p < 0.05).alias("anomaly"))
