"""Small operators on sets of rows: exclusions, dense codes, trailing rows, joins by position, concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def excluded(df: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """Rows whose key, as text, is none of ids; rows without a key stay."""
    return df.filter(F.col(key).isNull() | ~F.col(key).cast("string").isin(list(ids))) if ids else df


def filled(df: DataFrame, constants: dict[str, object], copies: dict[str, str]) -> DataFrame:
    """Adds columns of one value, and copies of columns under new names."""
    return df.withColumns({**{k: F.lit(v) for k, v in constants.items()}, **{k: F.col(v) for k, v in copies.items()}})


def dense_codes(df: DataFrame, column: str, name: str = "dense") -> DataFrame:
    """Adds the rank, from 0, of the column's value among its distinct values, which are a small table; null stays null."""
    kinds = df.select(F.col(column).alias("_value")).filter("_value is not null").distinct()
    ranked = kinds.withColumn(name, F.row_number().over(Window.orderBy("_value")) - 1)  # one row for each state
    return df.join(ranked, F.col(column) == F.col("_value"), "left").drop("_value")


def without_trailing(df: DataFrame, count: str = "count") -> DataFrame:
    """Rows up to the last one of each series whose count isn't 0."""
    last = df.filter(F.col(count) != 0).groupBy("series").agg(F.max("idx").alias("_last"))
    return df.join(last, "series").filter(F.col("idx") <= F.col("_last")).drop("_last")


def first_open(forecasts: DataFrame) -> DataFrame:
    """The earliest forecast of each series that has no actual value yet."""
    return forecasts.filter("actual is null").groupBy("series").agg(F.min_by(F.struct(*[c for c in forecasts.columns if c != "series"]), "ts").alias("r")).select("series", "r.*")


def concatenated(df: DataFrame, name: str) -> DataFrame:
    """The rows of several series as one, in the order of their names: each one's positions come after those of the ones before."""
    sizes = df.groupBy("series").agg((F.max("idx") + 1).alias("_n"))
    earlier = Window.orderBy("series").rowsBetween(Window.unboundedPreceding, -1)  # one row for each series
    shift = sizes.select("series", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    return df.join(shift, "series").select(F.lit(name).alias("series"), (F.col("idx") + F.col("_shift")).alias("idx"), *[c for c in df.columns if c not in ("series", "idx")])


def blocks_from(df: DataFrame, labels: DataFrame, size: int, value: str = "value") -> DataFrame:
    """(series, label, data): for each label (series, ts) the size values from the row of that time on, fewer at the end."""
    starts = labels.join(df.select("series", "ts", F.col("idx").alias("_at")), ["series", "ts"]).select("series", F.col("ts").alias("label"), "_at")
    steps = starts.select("series", "label", F.explode(F.sequence(F.col("_at"), F.col("_at") + size - 1)).alias("idx"))
    rows = steps.join(df.select("series", "idx", F.col(value).alias("_v")), ["series", "idx"])
    return rows.groupBy("series", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "_v"))), lambda x: x["_v"]).alias("data"))


def zipped(left: DataFrame, right: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row of left with the first of right, and so on, as far as both reach; both are short lists ordered by the given columns."""
    numbered = lambda df, key: df.withColumn("_pos", F.row_number().over(Window.orderBy(key)))
    return numbered(left, order[0]).join(numbered(right, order[1]), "_pos").drop("_pos")


def mismatches(df: DataFrame, found: Column, given: Column) -> DataFrame:
    """(difference, n, share) of two labellings; 0 is a match."""
    n = df.select((found - given).alias("difference")).filter("difference is not null").groupBy("difference").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("difference", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


#: Weights of the five labellings in a combined code: all features, components, standardised (reversed), min-max, exogenous (fixed values).
WEIGHTS = (1, 2, 4, 8, 16)


def combined_code(every: Column, components: Column, standard: Column, minmax: Column, exogenous: Column) -> Column:
    parts = (every, components, 1 - standard, minmax, exogenous)
    total = F.lit(0)
    for weight, part in zip(WEIGHTS, parts, strict=True):
        total = total + weight * part
    return total.cast("int")


def label_centres(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(label, n, mean of each column)."""
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
