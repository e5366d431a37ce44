"""Helpers shared by the corpus operators: the shared folder, intermediate tables, text batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session, where it still has Spark's defaults."""
    for name, default, ours in (("Records", "10000", BATCH_ROWS), ("Bytes", "67108864b", BATCH_BYTES)):
        if spark.conf.get(key := f"spark.sql.execution.arrow.max{name}PerBatch", default) == default:
            spark.conf.set(key, str(ours))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests, where it is unset, a new one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewright-shared-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and rereads it: the lineage ends, and a lost executor costs no recomputation."""
    return Scratch(df.sparkSession).keep(df, name)


#: Hadoop's local file system starts four processes for each file that it writes, three of them for its checksum file; Parquet pages have
#: checksums of their own, so tables of local folders are written without. Other file systems don't read these options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}


class Scratch:
    """Intermediate tables of one operator; ``clear`` deletes those that its result doesn't read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table that the result may read."""
        path = shared_path(self.spark, name)
        df.write.options(**PLAIN_FILES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table that only the operator's own steps read."""
        path = shared_path(self.spark, name)
        self.paths.append(path)
        df.write.options(**PLAIN_FILES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


#: Spark's settings of how small shuffled partitions are put together: (setting, its default, ours).
_COALESCE = (("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true", "false"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "67108864b", "8388608b"))


@contextmanager
def few_small_tasks(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffled partitions are put together up to 8 MB, so that the many small tables of an operator are few files; larger ones stay.

    Settings that aren't Spark's defaults are left alone.
    """
    ours = [(k, spark.conf.get(k, default), value) for k, default, value in _COALESCE if spark.conf.get(k, default) in (default, default.rstrip("b"), "64MB")]
    for k, _, value in ours:
        spark.conf.set(k, value)
    try:
        yield
    finally:
        for k, before, _ in ours:
            spark.conf.set(k, before)


class WordCache(dict):
    """Computes a value for each distinct word once; it is emptied when it is full, so its memory is bounded."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


def word_hashes(limit: int = 400_000) -> WordCache:
    """64-bit hashes of words given as bytes."""
    return WordCache(xxhash.xxh3_64_intdigest, limit)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """Whole texts of a batch in UTF-8; null is the empty text."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py() or b""


#: Edges that one task of a round of components writes.
EDGES = 500_000


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges of long ids: (node, root), root being the smallest id that a node reaches.

    Alternates the large-star and small-star steps until no edge changes; every step lowers some end of an edge or ends the
    loop. Each step groups with map-side minima and joins them back, so a hub is split by the skew join, and no component
    meets in one task. Nodes without edges don't appear. The result is a table of scratch.
    """
    now = scratch.table(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
        if state[0] == 0 or state == seen:
            break
        seen, before = state, Scratch(scratch.spark)
        before.paths, scratch.paths = [scratch.paths[-1]], scratch.paths[:-1]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        # No step adds edges beyond twice what it had: a file for each half a million, however many tasks a shuffle has.
        now = scratch.table(small.coalesce(max(1, -(-2 * state[0] // EDGES))), "stars")
        before.clear()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
