"""What is kept between runs: fitted models, filters and descriptors as tables, series chunks and reports as files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row for each saved thing: its kind, its name, its fields as JSON, its arrays or weights as bytes, and when it was saved.
FIELDS = "kind string, name string, fields string, content binary, saved timestamp"


class Store:
    """A folder of saved models, filters and descriptors; a thing saved again replaces what a later load gives."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, kind: str, name: str, fields: dict, content: bytes = b"") -> None:
        """Writes one row and reads it again; what comes back must be what was written."""
        row = self.spark.createDataFrame([(kind, name, json.dumps(fields, sort_keys=True), bytearray(content))], "kind string, name string, fields string, content binary")
        row.withColumn("saved", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.folder)
        if self.load(kind, name) != (json.loads(json.dumps(fields)), content):
            raise OSError(f"{kind} {name} did not come back as it was saved")

    def save_rows(self, kind: str, rows: DataFrame, name: str, content: str, fields: Sequence[str] = ()) -> None:
        """Saves a table of models, one thing for each row, without bringing them to the driver."""
        kept = rows.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.to_json(F.struct(*fields)).alias("fields") if fields else F.lit("{}").alias("fields"), F.col(content).alias("content"))
        kept.withColumn("saved", F.current_timestamp()).write.mode("append").parquet(self.folder)

    def table(self, kind: str | None = None) -> DataFrame:
        """The latest row of each thing."""
        rows = self.spark.read.schema(FIELDS).parquet(self.folder)
        rows = rows if kind is None else rows.filter(F.col("kind") == kind)
        return rows.groupBy("kind", "name").agg(F.max_by(F.struct("fields", "content", "saved"), "saved").alias("r")).select("kind", "name", "r.*")

    def load(self, kind: str, name: str) -> tuple[dict, bytes]:
        found = self.table(kind).filter(F.col("name") == name).first()
        if found is None:
            raise KeyError(f"no {kind} named {name}")
        return json.loads(found["fields"]), bytes(found["content"] or b"")

    def names(self, kind: str) -> list[str]:
        return sorted(r["name"] for r in self.table(kind).select("name").collect())


def save_filter(bitmaps: DataFrame, path: str, bits_: int, k: int) -> None:
    """A Bloom filter as JSON lines: its size in each line, and a word of the bitmap as hexadecimal digits."""
    lines = bitmaps.select(F.lit(bits_).alias("bits"), F.lit(k).alias("hashes"), "word", F.hex("bitmap").alias("bitmap"))
    lines.write.mode("overwrite").json(path)


def load_filter(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(bitmaps, bits, hashes)."""
    rows = spark.read.schema("bits long, hashes int, word long, bitmap string").json(path)
    size = rows.agg(F.max("bits"), F.max("hashes")).first()
    return rows.select("word", F.unhex("bitmap").alias("bitmap")), size[0], size[1]


def write_chunk(rows: DataFrame, path: str, features: str = "features", label: str = "y", width: int | None = None) -> int:
    """Features and a label as CSV columns x0, x1, ..., y; returns the number of features."""
    width = width or rows.agg(F.max(F.size(features))).first()[0] or 0
    rows.select(*[F.get(features, F.lit(i)).alias(f"x{i}") for i in range(width)], F.col(label).alias("y")).write.mode("overwrite").csv(path, header=True)
    return width


def read_chunk(spark: SparkSession, path: str) -> DataFrame:
    """(features, y): every column but y, in order, as numbers."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.array(*[F.col(f"`{c}`").try_cast("double") for c in raw.columns if c != "y"]).alias("features"), F.col("y").cast("int").alias("y"))


def normalised(chunk: DataFrame) -> DataFrame:
    """Features less their mean over their deviation, position by position; a constant one is 0."""
    each = chunk.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = each.agg(F.sort_array(F.collect_list(F.struct("pos", "m", "s"))).alias("_s"))  # one row, a triple for each feature
    scale = lambda v, i: F.coalesce(F.try_divide(v - F.get("_s", i)["m"], F.get("_s", i)["s"]), F.lit(0.0))
    return chunk.join(F.broadcast(stats)).select(F.transform("features", scale).alias("features"), "y")


def files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the plain files of a folder, on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(s.getPath().getName() for s in found if s.isFile())


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def line_range(spark: SparkSession, path: str, offset: int, size: int) -> DataFrame:
    """(line, value): lines offset to offset + size of a dump, fewer at its end.

    Lines are numbered by the files' own order: each one's place among the lines of its partition, after those of the partitions before.
    """
    rows = spark.read.text(path).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    from pyspark.sql import Window

    shift = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row for each partition
    numbered = rows.join(F.broadcast(shift), "_part").select((F.col("_place") - F.col("_first") + F.col("_before")).alias("line"), "value")
    return numbered.filter((F.col("line") >= offset) & (F.col("line") < offset + size))


def write_fixed_width(rows: DataFrame, path: str, columns: Sequence[str], width: int = 16, places: int = 6) -> None:
    """Lines of columns of one width, numbers with so many places."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.lpad(F.format_number(c, places) if kinds[c] in ("double", "float") else F.col(c).cast("string"), width, " ")
    rows.select(F.concat(*[cell(c) for c in columns]).alias("value")).write.mode("overwrite").text(path)


def write_dictionary(spark: SparkSession, values: dict, path: str) -> None:
    """A dictionary as CSV rows of key and value, values as JSON."""
    spark.createDataFrame([(str(k), json.dumps(v)) for k, v in values.items()], "key string, value string").coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_dictionary(spark: SparkSession, path: str) -> dict:
    return {r["key"]: json.loads(r["value"]) for r in spark.read.csv(path, header=True).collect()}


def numbers(text: Column) -> Column:
    """The numbers of a list written as text, such as [1.0, 2]; an empty list has none."""
    inner = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda v: v.try_cast("double")))


def as_text(value, indent: int = 0) -> str:
    """Dictionaries and lists inside each other as indented lines."""
    pad = " " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:\n{as_text(v, indent + 2)}" for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return "".join(as_text(v, indent + 2) for v in value)
    return f"{pad}{value}\n"
