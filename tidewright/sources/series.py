"""Time series in long form: (series, idx, ts, value), from tables, CSV files and JSON widgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What becomes of values that are missing or not numbers.
DROP, ZERO, PREFIX = "drop", "zero", "prefix"


def indexed(df: DataFrame, order: Sequence[str] = ("ts",), bucket: Column | None = None) -> DataFrame:
    """Adds idx, the position of each row within its series, from 0.

    Rows are ranked within (series, bucket), a day by default, and the ranks are shifted by the rows of earlier buckets, whose
    counts are a small table; so a long series isn't sorted in one task.
    """
    keyed = df.withColumn("_bucket", bucket if bucket is not None else F.date_trunc("day", F.col(order[0])).cast("long"))
    before = Window.partitionBy("series").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = keyed.groupBy("series", "_bucket").count().select("series", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("series", "_bucket").orderBy(*order))
    ranked = keyed.withColumn("_rank", rank)
    same = (ranked["series"] == shift["series"]) & ranked["_bucket"].eqNullSafe(shift["_bucket"])
    return ranked.join(shift, same).select(*[ranked[c] for c in df.columns], (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("idx"))


def typed(df: DataFrame, ts: str, value: str, scale: float = 1.0, bias: float = 0.0, missing: str = DROP, pattern: str | None = None) -> DataFrame:
    """(ts, value) of a raw table: numbers by a cast that tolerates bad ones, day-first times by pattern, value * scale + bias."""
    when = F.try_to_timestamp(F.col(ts), F.lit(pattern)) if pattern else F.col(ts).cast("timestamp")
    number = F.col(value).try_cast("double")
    clean = df.withColumns({"ts": when, "value": number * scale + bias})
    if missing == ZERO:
        clean = clean.withColumn("value", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))
    bad = F.col("value").isNull() | F.isnan("value")
    if missing == PREFIX:
        first = clean.filter(bad).agg(F.min("ts").alias("_first"))
        clean = clean.join(F.broadcast(first)).filter(F.col("_first").isNull() | (F.col("ts") < F.col("_first"))).drop("_first")  # one row
    return clean.filter(~bad) if missing == DROP else clean


def read_csv(spark: SparkSession, path: str, ts: str, values: Sequence[str], pattern: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """(series, ts, value) of a wide CSV file or folder; day-first times, values that aren't numbers are left out."""
    raw = spark.read.csv(path, header=True)
    long = raw.select(F.col(f"`{ts}`").alias("_ts"), F.explode(F.array(*[F.struct(F.lit(v).alias("series"), F.col(f"`{v}`").alias("raw")) for v in values])).alias("v")).select("_ts", "v.*")
    return typed(long, "_ts", "raw", pattern=pattern).select("series", "ts", "value")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path names anything, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_if_exists(spark: SparkSession, path: str, ts: str, values: Sequence[str] = (), pattern: str = "dd.MM.yyyy HH:mm") -> DataFrame | None:
    """read_csv of a path that may be absent, of all columns but the time if none are named; None if it is."""
    return read_csv(spark, path, ts, list(values) or value_columns(spark, path, ts), pattern) if exists(spark, path) else None


def value_columns(spark: SparkSession, path: str, ts: str) -> list[str]:
    """The columns of a CSV file besides its time."""
    return [c for c in spark.read.csv(path, header=True).columns if c != ts]


def read_balance(spark: SparkSession, path: str, ts: str, generated: str, consumed: str, pattern: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """(series, ts, generated, consumed, value, normalised): wide rows up to the first one without a generated value, the imbalance, consumed less generated, and its deviation from the mean over the sample deviation."""
    raw = spark.read.csv(path, header=True)
    rows = typed(raw.select(F.col(f"`{ts}`").alias("_ts"), F.col(f"`{generated}`").alias("raw"), F.col(f"`{consumed}`").try_cast("double").alias("consumed")), "_ts", "raw", missing=PREFIX, pattern=pattern)
    made = rows.select(F.lit("balance").alias("series"), "ts", F.col("value").alias("generated"), "consumed", F.bround(F.col("consumed") - F.col("value"), 2).alias("value"))
    return normalised(made)


def normalised(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds normalised: deviations from the series' mean over its sample deviation."""
    stats = df.groupBy("series").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(stats, "series").withColumn("normalised", (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def balance_summary(df: DataFrame, value: str = "value") -> DataFrame:
    """(series, first_time, last_time, first_value, low, high, mean, std, low_normalised, high_normalised)."""
    return df.groupBy("series").agg(
        F.min("ts").alias("first_time"),
        F.max("ts").alias("last_time"),
        F.min_by(value, "ts").alias("first_value"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min("normalised").alias("low_normalised"),
        F.max("normalised").alias("high_normalised"),
    )


#: A polled widget: its included series have values in one order of times.
WIDGET = (
    "data struct<type string, id string, attributes struct<title string, `last-update` string>>, "
    "included array<struct<type string, id string, attributes struct<title string, `values` array<struct<value double, percentage double, datetime string>>>>>"
)


def widget_series(payloads: DataFrame, column: str = "payload", imbalance: bool = True, field: str = "value") -> DataFrame:
    """(ts, first, second, third, imbalance): the three series of a JSON widget, zipped by position over the shortest."""
    parsed = payloads.select(F.from_json(column, WIDGET).alias("w")).filter(F.size("w.included") == 3)
    values = [F.col("w.included")[i]["attributes"]["values"] for i in range(3)]
    parsed = parsed.withColumn("n", F.least(*[F.size(v) for v in values])).filter("n > 0")
    at = parsed.select(*[v.alias(f"v{i}") for i, v in enumerate(values)], F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    wide = at.select(F.substring(F.get("v0", "i")["datetime"], 1, 19).alias("ts"), *[F.get(f"v{i}", "i")[field].alias(n) for i, n in enumerate(("first", "second", "third"))])
    return wide.withColumn("imbalance", F.col("second") - F.col("first")) if imbalance else wide


def widget_header(payloads: DataFrame, column: str = "payload") -> DataFrame:
    w = payloads.select(F.from_json(column, WIDGET).alias("w"))
    return w.select("w.data.type", "w.data.id", "w.data.attributes.title", F.col("w.data.attributes.`last-update`").alias("last_update"), F.transform("w.included", lambda s: F.size(s["attributes"]["values"])).alias("sizes"))


def widget_url(base: str, start: str, end: str, trunc: str = "hour", geo_limit: str | None = None, geo_ids: str | None = None) -> str:
    geo = f"&geo_limit={geo_limit}&geo_ids={geo_ids}" if geo_limit and geo_ids else ""
    return f"{base}?start_date={start}&end_date={end}&time_trunc={trunc}{geo}"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as unordered samples by type: (series, ts, value, event_id)."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series"), "ts", "event_id", "value")
    return typed(raw, "ts", "value")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as irregular series by type: (series, idx, ts, value, event_id)."""
    return indexed(samples(spark, sf_dir), ("ts", "event_id"))


def exact_sum(amount: str) -> Column:
    """The sum of amounts with up to nine decimal places, the same in whatever order they meet; further places are rounded."""
    return F.sum(F.col(amount).cast("decimal(28,9)")).cast("double")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of the events by type: (series, idx, ts, value)."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    sums = raw.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ts")).agg(exact_sum("value").alias("value"))
    return indexed(sums, ("ts",))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by day as one series: (series, idx, ts, value)."""
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sums = raw.groupBy(F.lit("orders").alias("series"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(exact_sum("o_totalprice").alias("value"))
    return indexed(sums, ("ts",), bucket=F.year("ts"))
