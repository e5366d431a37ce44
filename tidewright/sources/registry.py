"""Sinks: a registry of trained models and result tables, as Parquet under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "time timestamp, dump string, match_key string, method string, path string, repository string, misc string"


class Registry:
    """Rows of FIELDS; inserts append, a lookup gives the latest row that equals the query in every field it names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def insert(self, **fields: str) -> None:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        if unknown := set(fields) - set(names):
            raise ValueError(f"no such field: {sorted(unknown)}")
        row = self.spark.range(1).select(F.current_timestamp().alias("time"), *[F.lit(fields.get(n)).cast("string").alias(n) for n in names[1:]])
        row.coalesce(1).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        return self.spark.read.schema(FIELDS).parquet(self.folder)

    def latest(self, **query: str) -> dict | None:
        rows = self.table()
        for k, v in query.items():
            rows = rows.filter(F.col(k) == v)
        found = rows.agg(F.max_by(F.struct("*"), "time").alias("r")).first()["r"]
        return found.asDict() if found else None


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the committer makes it appear as a whole."""
    df.write.mode("overwrite").csv(path, header=True)


def write_versioned(df: DataFrame, path: str, version: int) -> None:
    """One folder for each version; writing a version again replaces it only."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def forecast_table(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """Long forecasts (ts, model, forecast) as one row for each time and one column for each of the given models."""
    return forecasts.groupBy("ts").pivot("model", models).agg(F.first("forecast")).orderBy("ts")


def hourly_bundle(forecasts: DataFrame, last: DataFrame, hour: int, minute: int) -> DataFrame:
    """Long forecasts (series, model, horizon, forecast) of one time of the day: the first is for that time of the day after the series' last one, each later one a day on."""
    day = F.date_add(F.col("last_ts"), F.col("horizon").cast("int")).cast("timestamp")
    return forecasts.join(last, "series").withColumn("ts", day + F.make_interval(hours=F.lit(hour), mins=F.lit(minute))).drop("last_ts")


def with_actuals(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts with the value that came later, null where it hasn't come yet."""
    return forecasts.join(actuals.select("series", "ts", F.col("value").alias("actual")), ["series", "ts"], "left")
