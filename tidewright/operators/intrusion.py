"""Intrusion sets and detectors for bus packets: synthetic intrusions, one small classifier for each packet id, its scores."""

from __future__ import annotations

import io
import math
import tempfile
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers between input and the two classes, with their functions (fixed values).
HIDDEN = ((128, "relu"), (32, "relu"), (16, "sigmoid"))
#: Rows of one key that are learned or scored together.
PART_ROWS = 65_536
#: How often the parts of a key are averaged at most while they are learned.
ROUNDS = 8


def _uniform(*seed: Column) -> Column:
    """A number from 0 to 1 that depends on the seed alone, so that a task that runs again draws the same."""
    return F.pmod(F.xxhash64(*seed), F.lit(1 << 52)) / float(1 << 52)


def with_intrusions(rows: DataFrame, share: float, row_id: str, features: str = "features", shares: bool = True, seed: int = 0) -> DataFrame:
    """The rows with y = 0, and a share of them once more with drawn features and y = 1.

    Drawn features are shares of 0 to 1 at three places, or whole numbers of 0 to 31. row_id tells rows apart.
    """
    lucky = _uniform(F.lit(seed), F.col(row_id)) < share
    draw = lambda i: _uniform(F.lit(seed + 1), F.col(row_id), i)
    drawn = F.transform(features, lambda _, i: F.round(draw(i), 3) if shares else F.floor(draw(i) * 32).cast("double"))
    return rows.withColumn("y", F.lit(0)).unionByName(rows.filter(lucky).withColumn(features, drawn).withColumn("y", F.lit(1)))


def split(df: DataFrame, key: str, order: str, share: float = 0.9) -> DataFrame:
    """Adds at, the row's place among those of its key by the order column's hash, from 0 to 1, and train: the first share of them."""
    return df.withColumn("at", _uniform(F.col(key), F.col(order), F.lit(2))).withColumn("train", F.col("at") < share)


class Classifier:
    """A dense network with a softmax over two classes, trained by Adam on cross-entropy."""

    def __init__(self, inputs: int, hidden: tuple[tuple[int, str], ...] = HIDDEN, classes: int = 2, seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [inputs, *(n for n, _ in hidden), classes]
        self.kinds = [k for _, k in hidden]
        self._hold([rng.normal(size=(a, b)) * np.sqrt(2 / a) for a, b in zip(sizes[:-1], sizes[1:], strict=True)], [np.zeros(n) for n in sizes[1:]])

    def _hold(self, w: list[np.ndarray], b: list[np.ndarray]) -> None:
        """Weights and biases are views of one vector."""
        self.shapes = [p.shape for p in (*w, *b)]
        self.params = np.concatenate([p.ravel() for p in (*w, *b)])
        self.w, self.b = self._views(self.params)

    def _views(self, flat: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ends = np.cumsum([math.prod(s) for s in self.shapes])
        each = [p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), self.shapes, strict=True)]
        return each[: len(each) // 2], each[len(each) // 2 :]

    def _layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            if i == len(self.kinds):
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
            else:
                z = np.maximum(z, 0) if self.kinds[i] == "relu" else 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            out.append(z)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._layers(x)[-1]

    def moments(self) -> np.ndarray:
        """Adam's means of gradients and of their squares, and its steps, before the first step."""
        return np.zeros(2 * self.params.size + 1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 1e-3, seed: int = 1) -> Classifier:
        return self.go_on(x, y, self.moments(), range(epochs), batch, rate, (seed, 0))

    def go_on(self, x: np.ndarray, y: np.ndarray, moments: np.ndarray, epochs: range, batch: int = 64, rate: float = 1e-3, seed: tuple[int, ...] = (1, 0)) -> Classifier:
        """Learns the rows in each of the epochs, whose numbers decide the order, from the moments on, which change with it."""
        size, grad = self.params.size, np.empty_like(self.params)
        m, v, (gw, gb) = moments[:size], moments[size:-1], self._views(grad)
        for epoch in epochs:
            order = np.random.default_rng((*seed, epoch)).permutation(len(x))
            for low in range(0, len(x), batch):
                i = order[low : low + batch]
                layers = self._layers(x[i])
                g = layers[-1].copy()
                g[np.arange(len(i)), y[i]] -= 1
                g /= len(i)
                for k in range(len(self.w) - 1, -1, -1):
                    np.matmul(layers[k].T, g, out=gw[k])
                    np.sum(g, 0, out=gb[k])
                    if k:
                        h = layers[k]
                        g = (g @ self.w[k].T) * ((h > 0) if self.kinds[k - 1] == "relu" else h * (1 - h))
                moments[-1] += 1
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                self.params -= rate * (m / (1 - 0.9 ** moments[-1])) / (np.sqrt(v / (1 - 0.999 ** moments[-1])) + 1e-8)
        return self

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, kinds=np.array(self.kinds), **{f"w{i}": w for i, w in enumerate(self.w)}, **{f"b{i}": b for i, b in enumerate(self.b)})
        return f.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Classifier:
        got = np.load(io.BytesIO(raw), allow_pickle=False)
        out = cls.__new__(cls)
        n = sum(k.startswith("w") for k in got.files)
        out.kinds = got["kinds"].tolist()
        out._hold([got[f"w{i}"] for i in range(n)], [got[f"b{i}"] for i in range(n)])
        return out


def _matrix(t: pa.Table, features: str) -> np.ndarray:
    return t.column(features).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _parts(df: DataFrame, rows: int) -> DataFrame:
    """(key, _part, _parts, inputs, n, x, y): all rows (key, features, y, at) in parts of about so many, one row each, kept on disk."""
    ready = df.select(F.col("key").cast("string").alias("key"), F.col("features").cast("array<double>").alias("features"), F.col("y").cast("long").alias("y"), "at")
    sizes = ready.groupBy("key").agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("_parts"))
    # Broadcast, as a join by shuffles leaves the rows dealt by keys alone, and a key's parts in one task.
    dealt = ready.join(F.broadcast(sizes), "key").withColumn("_part", F.pmod(F.xxhash64("at", "y", "features"), F.col("_parts")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        x, y = _matrix(t, "features"), t.column("y").to_numpy()
        order = np.lexsort((*x.T, y, t.column("at").to_numpy()))
        one = t.select(["key", "_part", "_parts"]).slice(0, 1)
        for name, value, kind in (("inputs", x.shape[1], pa.int32()), ("n", len(x), pa.int64()), ("x", x[order].tobytes(), pa.binary()), ("y", y[order].tobytes(), pa.binary())):
            one = one.append_column(name, pa.array([value], kind))
        return one

    return dealt.groupBy("key", "_part").applyInArrow(pack, "key string, _part int, _parts int, inputs int, n long, x binary, y binary").persist(StorageLevel.DISK_ONLY)


def _learned(parts: DataFrame, start: DataFrame | None, epochs: int, classes: int, seed: int) -> DataFrame:
    """(key, inputs, state): a classifier for each key that has learned all rows of all its parts in each epoch, from the one row of start on.

    Each part goes on from its key's classifier, and the parts' weights and moments are averaged by their rows, up to ROUNDS times.
    If each key has one part, nothing is averaged, and all epochs come at once.
    """
    names = ["key", "_part", "_parts", "inputs", "n", "state"]
    schema = "key string, _part int, _parts int, inputs int, n long, state binary"
    none = pa.schema([("key", pa.string()), ("_part", pa.int32()), ("_parts", pa.int32()), ("inputs", pa.int32()), ("n", pa.int64()), ("state", pa.binary())]).empty_table()

    def epochs_of(numbers: range, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        row = {c: left.column(c)[0] for c in left.column_names}
        model, state = Classifier(row["inputs"].as_py(), classes=classes), right.column("state")[0]
        moments = model.moments()
        if state.is_valid:
            kept = np.frombuffer(state.as_buffer())
            model.params[:] = kept[: model.params.size]
            if numbers.start:
                moments[:] = kept[model.params.size :]
        x, y = np.frombuffer(row["x"].as_buffer()).reshape(row["n"].as_py(), -1), np.frombuffer(row["y"].as_buffer(), np.int64)
        model.go_on(x, y, moments, numbers, seed=(seed, row["_part"].as_py()))
        return left.select(names[:-1]).append_column("state", pa.array([np.concatenate([model.params, moments]).tobytes()], pa.binary()))

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("_part")
        n = t.column("n").to_numpy()
        state = sum(share * np.frombuffer(s.as_buffer()) for share, s in zip(n / n.sum(), t.column("state"), strict=True))
        one = t.select(names[:4]).slice(0, 1)
        return one.append_column("n", pa.array([int(n.sum())], pa.int64())).append_column("state", pa.array([state.tobytes()], pa.binary()))

    keys = parts.groupBy("key", "_parts").agg(F.first("inputs").alias("inputs"))
    models = keys.withColumn("state", F.lit(None).cast("binary")) if start is None else keys.crossJoin(F.broadcast(start.select("state")))  # one row
    rounds = 1 if (parts.agg(F.max("_parts")).first()[0] or 1) == 1 else max(1, min(epochs, ROUNDS))
    sc = parts.sparkSession.sparkContext
    if not sc.getCheckpointDir() and sc.master.startswith("local"):  # elsewhere spark.checkpoint.dir has to be set
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-shared-"))
    for i in range(rounds):
        numbers = range(epochs * i // rounds, epochs * (i + 1) // rounds)
        asked = models.select(F.col("key").alias("_key"), "state", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
        found = parts.groupBy("key", "_part").cogroup(asked.groupBy("_key", "_part")).applyInArrow(partial(epochs_of, numbers), schema)
        # A key's parts meet in two steps, so that no task holds all of them.
        cells = found.groupBy("key", (F.col("_part") % F.ceil(F.sqrt("_parts"))).alias("_cell")).applyInArrow(mean, schema)
        models = cells.groupBy("key").applyInArrow(mean, schema).checkpoint()  # the plans of the rounds don't nest
    return models


def _models(learned: DataFrame, classes: int) -> DataFrame:
    """(key, model) of what was learned."""

    @F.arrow_udf("binary")
    def model(inputs: pa.Array, states: pa.Array) -> pa.Array:
        out = []
        for n, state in zip(inputs.to_pylist(), states, strict=True):
            one = Classifier(n, classes=classes)
            one.params[:] = np.frombuffer(state.as_buffer())[: one.params.size]
            out.append(one.to_bytes())
        return pa.array(out, pa.binary())

    return learned.select("key", model("inputs", "state").alias("model"))


def trained(df: DataFrame, key: str, features: str = "features", epochs: int = 10, rows: int = PART_ROWS) -> DataFrame:
    """(key, model): a classifier for each key that learns all its rows with train, in parts of about so many rows."""
    parts = _parts(df.filter("train").select(F.col(key).alias("key"), F.col(features).alias("features"), "y", "at"), rows)
    learned = _learned(parts, None, epochs, 2, 1)
    parts.unpersist()
    return _models(learned, 2)


def trained_in_turn(chunks: DataFrame, epochs: int = 5, classes: int = 10, rows: int = PART_ROWS) -> DataFrame:
    """(model, chunks, n, accuracy): one classifier that learns the chunks (chunk, features, y) one after the other and is evaluated on every row of the last.

    All rows of a chunk are learned, in parts of about so many rows; a single chunk is learned and evaluated.
    Further columns tell rows apart: rows with the same features and y then have different hashes. Equal features are scored once, and count as often as they come.
    """
    at = F.pmod(F.xxhash64(*chunks.columns), F.lit(1 << 52)) / float(1 << 52)
    placed = chunks.select("chunk", F.col("chunk").cast("string").alias("key"), "features", "y", at.alias("at"))
    sizes = placed.filter(F.col("chunk").isNotNull()).groupBy("chunk", "key").agg(F.count("*").alias("n")).orderBy("chunk").collect()  # one row for each chunk
    if not sizes:
        return chunks.sparkSession.createDataFrame([], "model binary, chunks int, n long, accuracy double")
    last = F.lit(sizes[-1].chunk)
    parts = _parts(placed.filter(F.col("chunk") < last if len(sizes) > 1 else F.col("chunk") == last), rows)
    learned = None
    for i, r in enumerate(sizes[:-1] or sizes):
        learned = _learned(parts.filter(F.col("key") == r.key), learned, epochs, classes, i)
    parts.unpersist()

    def hits(left: pa.Table, right: pa.Table) -> pa.Table:
        n, hit = left.column("n").to_numpy(), np.zeros(0)
        if left.num_rows:
            hit = n * (Classifier.from_bytes(right.column("model")[0].as_py()).scores(_matrix(left, "features")).argmax(1) == left.column("y").to_numpy())
        return pa.table({"n": pa.array([int(n.sum())], pa.int64()), "hit": pa.array([int(hit.sum())], pa.int64())})

    model, dealt = _models(learned, classes).select("model"), math.ceil(sizes[-1].n / PART_ROWS)
    asked = placed.filter(F.col("chunk") == last).groupBy("features", "y").agg(F.count("*").alias("n"))
    kept = model.select("model", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))).alias("_part"))
    found = asked.withColumn("_part", F.pmod(F.xxhash64("features", "y"), F.lit(dealt)).cast("int")).groupBy("_part").cogroup(kept.groupBy("_part")).applyInArrow(hits, "n long, hit long")
    return model.withColumn("chunks", F.lit(len(sizes))).join(F.broadcast(found.agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"))))  # one row each


def scored(df: DataFrame, models: DataFrame, key: str, features: str = "features") -> DataFrame:
    """The rows with their key as text, score (of class 1) and predicted; rows of keys without a model are left out.

    A key's rows are dealt into parts of about PART_ROWS; a part meets its model once.
    """
    rows = df.withColumn("key", F.col(key).cast("string"))
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).cast("int").alias("_parts"))
    dealt = rows.join(sizes, "key").select(*names, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.col("_parts")).cast("int").alias("_part"))
    kept = models.select("key", "model").join(sizes, "key").select("key", "model", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names)
        if not right.num_rows:
            left = left.slice(0, 0)
        p = np.zeros(0)
        if left.num_rows:
            p = Classifier.from_bytes(right.column("model")[0].as_py()).scores(_matrix(left, features))[:, 1]
        return left.append_column("score", pa.array(p)).append_column("predicted", pa.array((p >= 0.5).astype(np.int32)))

    at = ("key", "_part")
    return dealt.groupBy(*at).cogroup(kept.groupBy(*at)).applyInArrow(run, f"{schema}, score double, predicted int")


def binary_confusion(df: DataFrame, by: str) -> DataFrame:
    """(by, tn, fp, fn, tp) of y against predicted."""
    n = lambda y, p: F.count_if((F.col("y") == y) & (F.col("predicted") == p))
    return df.groupBy(by).agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))
