"""Scalar expressions: times, scalings, normal probabilities, quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.windows import positions


def shift_time(text: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    """A time as text, moved and written as yyyy-MM-dd HH:mm:ss."""
    step = F.make_interval(days=F.lit(days), hours=F.lit(hours), mins=F.lit(minutes), secs=F.lit(seconds))
    return F.date_format(F.to_timestamp(text) + step, "yyyy-MM-dd HH:mm:ss")


def wall_clock(iso: Column) -> Column:
    """The wall-clock time of an ISO-8601 text; its offset is ignored."""
    return F.replace(F.substring(iso, 1, 19), F.lit("T"), F.lit(" "))


def quantised(value: Column, unit: float) -> Column:
    """The value in whole units, half to even, as an integer."""
    return F.bround(F.bround(value / unit) * unit).cast("long")


def combined(value: Column, positive: Column, negative: Column) -> Column:
    """The first source where the value isn't negative, else the second with its sign changed."""
    return F.when(value >= 0, positive).otherwise(-negative)


def scaled(df: DataFrame, value: str = "value", places: int = 4) -> DataFrame:
    """Adds center, standard (population deviation), minmax and maxabs by series, half to even at 4 places."""
    s = df.groupBy("series").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.min(value).alias("_a"), F.max(value).alias("_b"))
    x, unit = F.col(value), F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"))
    out = df.join(s, "series").withColumns({"center": x - F.col("_m"), "standard": F.try_divide(x - F.col("_m"), F.col("_s")), "minmax": unit, "maxabs": 2 * unit - 1})
    return out.withColumns({c: F.bround(c, places) for c in ("center", "standard", "minmax", "maxabs")}).drop("_m", "_s", "_a", "_b")


def chronological(df: DataFrame, evaluation: int, test: int) -> DataFrame:
    """Adds split: the last ``test`` rows of each series, the ``evaluation`` rows before them, and train."""
    n = df.groupBy("series").agg((F.max("idx") + 1).alias("_n"))
    left = F.col("_n") - F.col("idx")
    return df.join(n, "series").withColumn("split", F.when(left <= test, "test").when(left <= test + evaluation, "eval").otherwise("train")).drop("_n")


def scaled_on_train(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds scaled: min-max by the train rows of each series; other rows may leave [0, 1]."""
    ends = df.filter("split = 'train'").groupBy("series").agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return df.join(ends, "series").withColumn("scaled", F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


#: Coefficients, highest power first, of the quotient that gives the normal tail to double precision (fixed values after Hart).
TAIL_OVER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_UNDER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function: a quotient of polynomials, and a continued fraction far out."""
    x = F.abs(z)

    def polynomial(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    far = x + 0.65
    for k in (4, 3, 2, 1):
        far = x + k / far
    tail = F.exp(-z * z / 2) * F.when(x < 7.07106781186547, polynomial(TAIL_OVER) / polynomial(TAIL_UNDER)).otherwise(1 / far / 2.5066282746310002)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def unioned(old: DataFrame, new: DataFrame, order: str = "ts") -> DataFrame:
    """Old rows and new ones, as many of the oldest left out as there are new ones, by series; ranked within days, not by whole series."""
    n = new.groupBy("series").agg(F.count("*").alias("_new"))
    both = old.unionByName(new, allowMissingColumns=True)
    ranked = positions(both, (order,), F.date_trunc("day", F.col(order)).cast("long"))
    return ranked.join(n, "series", "left").filter(F.col("rank") >= F.coalesce("_new", F.lit(0))).drop("rank", "_new")
