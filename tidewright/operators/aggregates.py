"""Statistics of series, tables of counts and margins, rates of classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.windows import cumulated


def scalar_properties(df: DataFrame, value: str = "value") -> DataFrame:
    """(series, low, high, mean, median, mode, std); the mode is the smallest of the most frequent values.

    The median comes from the running counts of distinct values within ranges between sampled splitters, so no series' values meet in one buffer.
    """
    counts = df.groupBy("series", F.col(value).alias("value")).agg(F.count("*").alias("n"))
    mode = counts.groupBy("series").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("mode"))
    stats = df.groupBy("series").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("_n"))
    ranked = cumulated(counts).join(stats.select("series", "_n"), "series")
    holds = lambda rank: F.when((F.col("_before") <= rank) & (F.col("_before") + F.col("n") > rank), F.col("value"))
    middle = ranked.groupBy("series").agg(((F.max(holds(F.floor((F.col("_n") - 1) / 2))) + F.max(holds(F.floor(F.col("_n") / 2)))) / 2).alias("median"))
    return stats.drop("_n").join(mode, "series").join(middle, "series").select("series", "low", "high", "mean", "median", "mode", "std")


def histogram(df: DataFrame, bins: int = 10, value: str = "value") -> DataFrame:
    """(series, bin, n): equal-width bins from the smallest to the largest value, the last closed; empty bins have n = 0."""
    ends = df.groupBy("series").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("low")) / width), F.lit(bins - 1))).cast("int")
    counts = df.join(ends, "series").groupBy("series", place.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("series", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["series", "bin"], "left").fillna(0, ["n"])


def spanned(ends: DataFrame, low: str, high: str, name: str, step: int = 1 << 16) -> DataFrame:
    """The rows of ends once for each integer from low to high: chunks first, dealt to the tasks, then their numbers."""
    chunk = ends.withColumn("_c", F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step))))
    inside = F.sequence(F.greatest(F.col("_c") * step, F.col(low)), F.least((F.col("_c") + 1) * step - 1, F.col(high)))
    return chunk.repartition("_c").withColumn(name, F.explode(inside)).drop("_c")


def time_at_level(df: DataFrame, minutes: int, value: str = "value", step: float = 1.0) -> DataFrame:
    """(series, level, minutes) on the whole grid of levels between the smallest and the largest."""
    level = F.bround(F.col(value) / step).cast("long")
    counts = df.groupBy("series", level.alias("level")).agg((F.count("*") * minutes).alias("minutes"))
    grid = spanned(counts.groupBy("series").agg(F.min("level").alias("a"), F.max("level").alias("b")), "a", "b", "level").select("series", "level")
    return grid.join(counts, ["series", "level"], "left").fillna(0, ["minutes"])


def missing(df: DataFrame, key: str, name: str = "missing") -> DataFrame:
    """(name): the whole numbers between the smallest and the largest key that no row has."""
    seen = df.select(F.col(key).cast("long").alias("_seen")).filter("_seen is not null").distinct()
    grid = spanned(seen.agg(F.min("_seen").alias("a"), F.max("_seen").alias("b")), "a", "b", name).select(name)
    return grid.join(seen, F.col(name) == F.col("_seen"), "left_anti")


def margins(df: DataFrame, row: str, column: str, value: str = "value", by: tuple[str, ...] = (), places: tuple[int, ...] = (3, 3, 2, 2)) -> DataFrame:
    """(*by, margin, key, ave, std, low, high) by row and by column of long matrices, in one pass over grouping sets, rounded."""
    side = F.when(F.grouping(row) == 0, row).otherwise(column)
    key = F.coalesce(F.col(row).cast("string"), F.col(column).cast("string"))
    stats = [F.avg(value).alias("ave"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high")]
    return df.groupingSets([[*by, row], [*by, column]], *by, row, column).agg(side.alias("margin"), *stats).select(*by, "margin", key.alias("key"), *[F.bround(c, n).alias(c) for c, n in zip(("ave", "std", "low", "high"), places, strict=True)])


def pivoted(df: DataFrame, row: str | list[str], column: str, columns: list, value: str = "value") -> DataFrame:
    """One row for each row key and one column for each of the given column keys."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """(actual, predicted, n) for all pairs of the given labels."""
    values = F.array(*map(F.lit, labels))
    grid = df.sparkSession.range(1).select(F.explode(values).alias("actual")).select("actual", F.explode(values).alias("predicted"))
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def binary_rates(df: DataFrame, actual: Column, predicted: Column, places: int = 4) -> DataFrame:
    """One row: tn, fp, fn, tp and the seventeen rates made of them; a rate over nothing is null."""
    n = df.agg(*[F.count_if((actual == a) & (predicted == p)).cast("double").alias(k) for k, a, p in (("tn", False, False), ("fp", False, True), ("fn", True, False), ("tp", True, True))])
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    over = F.try_divide
    one = n.withColumns({"tpr": over(tp, tp + fn), "tnr": over(tn, tn + fp), "ppv": over(tp, tp + fp), "npv": over(tn, tn + fn)})
    tpr, tnr, ppv, npv = (F.col(k) for k in ("tpr", "tnr", "ppv", "npv"))
    rates = {
        "fnr": 1 - tpr, "fpr": 1 - tnr, "fdr": 1 - ppv, "for_": 1 - npv,
        "pt": over(F.sqrt(tpr * (1 - tnr)) + tnr - 1, tpr + tnr - 1), "ts": over(tp, tp + fn + fp), "acc": over(tp + tn, tp + tn + fp + fn), "ba": (tpr + tnr) / 2,
        "f1": over(2 * tp, 2 * tp + fp + fn), "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "fm": F.sqrt(ppv * tpr), "bm": tpr + tnr - 1, "mk": ppv + npv - 1,
    }
    full = one.withColumns(rates)
    return full.select(*[F.col(k).cast("long").alias(k) for k in ("tn", "fp", "fn", "tp")], *[F.round(k, places).alias(k) for k in full.columns[4:]])


def discrete_kl(p: DataFrame, q: DataFrame, key: str = "bin") -> DataFrame:
    """(series, kl): sum of p ln(p / q) of the normalised counts n, both raised by 1e-15; q has no series."""
    share = p.join(p.groupBy("series").agg(F.sum("n").alias("total")), "series").select("series", key, (F.col("n") / F.col("total") + 1e-15).alias("p"))
    base = q.join(F.broadcast(q.agg(F.sum("n").alias("total")))).select(key, (F.col("n") / F.col("total") + 1e-15).alias("q"))  # one row
    return share.join(base, key).groupBy("series").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def fixed_histogram(df: DataFrame, low: float, high: float, bins: int, value: str = "value", by: str = "series") -> DataFrame:
    """(by, bin, n, density) over equal bins of a given range, the last closed; values outside don't count."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).between(low, high)).groupBy(by, place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, [by, "bin"], "left").fillna(0, ["n"])
    total = counts.groupBy(by).agg(F.sum("n").alias("_all"))
    return full.join(total, by, "left").select(by, "bin", "n", F.coalesce(F.col("n") / F.col("_all") / width, F.lit(0.0)).alias("density"))
