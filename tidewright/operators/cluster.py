"""Blocks of series, principal components, k-means and classifiers on them."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.windows import in_blocks


def series_blocks(df: DataFrame, size: int, share: float = 1.0, seed: int = 0) -> DataFrame:
    """(series, start, data): runs of size values; a share of the starts by a seeded hash, the first and last always."""

    def body(d: DataFrame, w) -> DataFrame:
        return d.withColumn("data", F.collect_list("value").over(w.rowsBetween(0, size - 1)))

    rows = in_blocks(df, 0, size, body).filter(F.size("data") == size)
    ends = df.groupBy("series").agg((F.max("idx") - size + 1).alias("_last"))
    lucky = F.pmod(F.xxhash64("series", "idx", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return rows.join(ends, "series").filter(lucky | (F.col("idx") == 0) | (F.col("idx") == F.col("_last"))).select("series", F.col("idx").alias("start"), "data")


def centred_columns(df: DataFrame, data: str = "data") -> DataFrame:
    """Vectors less the mean of each position."""
    vectors = df.withColumn("features", array_to_vector(F.col(data).cast("array<double>")))
    return StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(vectors).transform(vectors)


def principal(df: DataFrame, ratio: float = 0.6, most: int = 16, vector: str = "centred") -> tuple[DataFrame, list[float]]:
    """(rows with column pcs, explained shares): as many components as explain the ratio."""
    size = len(df.select(vector).first()[0])
    model = PCA(k=min(most, size), inputCol=vector, outputCol="all").fit(df)
    shares, k, total = list(model.explainedVariance), 0, 0.0
    while k < len(shares) and total <= ratio:
        total, k = total + shares[k], k + 1
    return model.transform(df).withColumn("pcs", array_to_vector(F.slice(vector_to_array("all"), 1, k))).drop("all"), shares[:k]


def kmeans_costs(df: DataFrame, vector: str, ks: range, seed: int = 0) -> DataFrame:
    """(k, cost, silhouette) of k-means for each k; k = 1 is the spread around the mean."""
    rows = []
    held = df.select(vector).persist()
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol=vector).fit(held) if k > 1 else None
        silhouette = float(ClusteringEvaluator(featuresCol=vector).evaluate(model.transform(held))) if model else None
        rows.append((k, float(model.summary.trainingCost) if model else None, silhouette))
    held.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


def kmeans_members(df: DataFrame, vector: str, k: int, keep: list[str], seed: int = 0) -> DataFrame:
    model = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol="cluster").fit(df)
    return model.transform(df).select(*keep, "cluster")


def by_centre(members: DataFrame, rows: DataFrame, on: list[str], column: str, cluster: str = "cluster") -> DataFrame:
    """members with their clusters numbered by the mean of a column of rows, smallest first, so that several clusterings' numbers mean the same."""
    means = members.join(rows.select(*on, F.col(column).alias("_v")), on).groupBy(cluster).agg(F.avg("_v").alias("_mean"))
    number = means.select(cluster, (F.row_number().over(Window.orderBy("_mean", cluster)) - 1).cast("int").alias("_number"))  # a row for each cluster
    return members.join(F.broadcast(number), cluster).withColumn(cluster, F.col("_number")).drop("_number")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share): how often two clusterings of the rows say what, and what share of all rows that is."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("a", "b", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def assigned(df: DataFrame, data: str, centres: dict[int, list[float]]) -> DataFrame:
    """Adds cluster, the nearest of given centres (the first on ties), and distance, its squared distance."""
    square = lambda c: F.aggregate(F.zip_with(F.col(data).cast("array<double>"), F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    nearest = F.array_min(F.array(*[F.struct(square(c).alias("d"), F.lit(k).cast("long").alias("k")) for k, c in sorted(centres.items())]))
    return df.withColumn("_n", nearest).withColumns({"cluster": F.col("_n.k"), "distance": F.col("_n.d")}).drop("_n")


def cluster_profiles(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """(cluster, pos, mean) of the members' data by position."""
    return df.join(members, on).select("cluster", F.posexplode("data").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("mean"))


def classified(train: DataFrame, test: DataFrame, layers: list[int], vector: str = "features", label: str = "label", seed: int = 0) -> DataFrame:
    """The test rows with a prediction by a multilayer perceptron."""
    model = MultilayerPerceptronClassifier(layers=layers, featuresCol=vector, labelCol=label, seed=seed, maxIter=60).fit(train)
    return model.transform(test)
