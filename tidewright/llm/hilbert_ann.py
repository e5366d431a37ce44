"""Nearest neighbours by largest inner product, over shifted space-filling curves, with an exact check.

Vectors are scaled into the unit ball and lifted by one coordinate onto the sphere, where a larger inner product with a
query is a smaller distance. For each of several curves they are projected to DIMS random directions, shifted, put on a grid and
ordered by Hilbert keys. Keys are range-partitioned by ends from a bounded sample and ranked exactly within the ranges, so every
row has a position on every curve; BLOCK positions are a block, at any size. A query is compared with the rows whose
blocks lie within ``reach`` positions of its own key on each curve; the candidates of all curves merge, and are ranked by exact
inner products in double precision.

A query's place on a curve is that of its direction on the sphere, or that of its own row. Place, number of curves and reach are
calibrated: the true neighbours of sample queries (a tenth of them, PROBES at most) are found by one linear scan, and of the places and the numbers CURVES,
each with the smallest reach that holds TARGET of them on some curve, the choice with the fewest comparisons is taken. Clustered vectors need a narrow reach. Where even that
choice would compare over half of the rows, as vectors without structure do or tables of few blocks, wide windows save nothing: then a query is only compared with the block it lies in, on one curve.

This choice is one of cost, not of the result. However far the windows went, a check follows: the rows in the order of the first curve, in groups of close ones, meet
tiles of queries, and a group is passed over by the queries whose k-th product so far its centre and radius can't reach. So what is returned are the exact
neighbours, at any size and for any choice.

Equal vectors are one class with its smallest vec_ids, as many as can ever be returned, so copies neither fill a block nor
hide each other. Vectors that are null, zero, or hold null or non-finite components take no part; shorter ones than the longest
count as ending in zeros. Ties go to the smaller vec_id, however many vectors tie. Repeated rows count as one vector. An
empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch

CURVES, DIMS, GRID_BITS = (2, 4, 8), 8, 6
BLOCK, PROBES, TARGET = 1024, 200, 0.94
#: The sample that ranges and reaches are fitted on: rows and bytes at most.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Queries that meet a block in one task.
MEET = 4096
#: Bytes of a tile of queries, which is broadcast, with what a task finds for it, and rows that are held at once to meet it, up to TILE bytes too.
TILE, PRODUCT = 16 << 20, 8192
#: Queries of one matrix product, and about how many rows a group of close ones has.
AT_ONCE, GROUP = 512, 128


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of grid cells (rows of ``bits``-bit coordinates) along the Hilbert curve, by the transpose form of the key."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            bit = (x[i] >> level & 1).astype(bool)
            swap = (x[0] ^ x[i]) & low
            first = np.where(bit, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(bit, x[i], x[i] ^ swap) if i else first
            x[0] = first
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] >> level & 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v ^ turn) >> level & 1
    return key


def close_groups(x: np.ndarray) -> Iterator[np.ndarray]:
    """Cuts rows into groups of close ones: each goes to the nearest of evenly picked rows, those far from all of them are cut again."""
    left = np.arange(len(x))
    while len(left) > GROUP:
        y = x[left]
        picked = y[np.linspace(0, len(y) - 1, len(y) // GROUP).astype(int)]
        apart = (picked * picked).sum(1) - 2 * (y @ picked.T)
        nearest = apart.argmin(1)
        apart = np.maximum(apart[np.arange(len(y)), nearest] + (y * y).sum(1), 0)
        close = apart <= 4 * np.quantile(apart, 0.25)
        close |= not close.any()  # distances that aren't finite
        order = np.flatnonzero(close)[np.argsort(nearest[close], kind="stable")]
        yield from np.split(left[order], np.flatnonzero(np.diff(nearest[order])) + 1)
        left = left[~close]
    if len(left):
        yield left


class Best:
    """The k best (id, exact product) of each query so far, of those with a product of least or more, ties to the smaller id."""

    def __init__(self, q: np.ndarray, least: np.ndarray, k: int):
        self.q, self.least, self.k = q, least.copy(), k
        self.norms = np.linalg.norm(q, axis=1)
        self.scores, self.ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.compared = 0

    def meet(self, x: np.ndarray, ids: np.ndarray) -> None:
        """A group of rows: it is compared with the queries for which its centre and radius don't rule it out."""
        centre = x.mean(0)
        most = self.q @ centre + self.norms * np.sqrt(((x - centre) ** 2).sum(1).max())
        reached = np.flatnonzero(~(most + _slack(self.q, x) < self.least))
        for low in range(0, len(reached), AT_ONCE):
            i = reached[low : low + AT_ONCE]
            s = self.q[i] @ x.T
            slack = _slack(self.q[i], x)
            hit = s >= (self.least[i] - slack)[:, None]  # all pairs that could count are ranked by exact products
            many = np.flatnonzero(hit.sum(1) > 4 * self.k)
            if len(many):
                hit[many] &= s[many] >= (np.partition(s[many], len(x) - self.k, 1)[:, len(x) - self.k] - slack[many])[:, None]
            self.compared += s.size
            rows, at = np.nonzero(hit)
            step = max(1, TILE // (8 * x.shape[1]))
            for first in range(0, len(rows), step):
                r, a = i[rows[first : first + step]], at[first : first + step]
                self._merge(r, ids[a], np.cumsum(self.q[r] * x[a], 1)[:, -1])  # term by term, as in _top

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        kept = scores >= self.least[rows]
        who = np.unique(rows[kept])
        rows = np.concatenate([np.repeat(who, self.k), rows[kept]])
        ids, scores = np.concatenate([self.ids[who].ravel(), ids[kept]]), np.concatenate([self.scores[who].ravel(), scores[kept]])
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k]
        self.ids[who], self.scores[who] = ids[order].reshape(-1, self.k), scores[order].reshape(-1, self.k)
        self.least[who] = np.maximum(self.least[who], self.scores[who, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, id, exact product)."""
        rows, at = np.nonzero(self.scores > -np.inf)
        return rows, self.ids[rows, at], self.scores[rows, at]


class Curves:
    """The projections, shifts and grids of the curves, fitted on a bounded sample, and the sample's keys."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.longest, d = longest, sample.shape[1] + 1
        dims = min(DIMS, d)
        self.to = [np.linalg.qr(rng.normal(size=(d, dims)))[0] for _ in range(max(CURVES))]
        self.shift = rng.uniform(-0.5, 0.5, (len(self.to), dims))
        y = [self._lifted(sample) @ p for p in self.to]
        self.centre, self.spread = [v.mean(0) for v in y], [np.maximum(v.std(0), 1e-9) for v in y]
        self.sorted = np.sort(self.keys(sample), axis=0)

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))[:, None]])

    def _sphere(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])

    def keys(self, x: np.ndarray, query: bool = False, curves: int | None = None) -> np.ndarray:
        z, n = self._sphere(x) if query else self._lifted(x), curves or len(self.to)
        out = np.empty((len(x), n), np.int64)
        for c in range(n):
            y = (z @ self.to[c] - self.centre[c]) / self.spread[c] + self.shift[c]
            out[:, c] = hilbert_keys(np.clip((y / 8 + 0.5) * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1).astype(np.int64), GRID_BITS)
        return out

    def shares(self, keys: np.ndarray) -> np.ndarray:
        """About which share of the rows comes before each key, by the sample."""
        return np.stack([np.searchsorted(s, k) for s, k in zip(self.sorted.T, keys.T)], 1) / len(self.sorted)

    def ranges(self, keys: np.ndarray, n: int) -> np.ndarray:
        """The range of each key when the sample is cut into n."""
        ends = self.sorted[(np.arange(1, n) * len(self.sorted)) // n]
        return np.stack([np.searchsorted(e, k, "right") for e, k in zip(ends.T, keys.T)], 1)


def _slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row of q, more than its products with rows of x, as matrix products give them, may differ from the exact ones."""
    return 1e-12 * x.shape[1] * max(1.0, x.shape[1] / 1000) * np.abs(x).max(initial=0) * np.abs(q).max(1, initial=0)


def _top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, ids, exact products) of each query's k best rows of x with a product of least or more, ties to the smaller id."""
    for low in range(0, len(q), 512):
        s = q[low : low + 512] @ x.T
        # The matrix product may differ from the exact one in the last places: all that could reach the k-th are ranked exactly.
        bound = np.partition(s, len(x) - k, 1)[:, len(x) - k] if len(x) > k else np.full(len(s), -np.inf)
        if least is not None:
            bound = np.maximum(bound, least[low : low + 512])
        slack = _slack(q[low : low + 512], x)
        for i in range(len(s)):
            at = np.flatnonzero(s[i] >= bound[i] - slack[i])
            exact = np.cumsum(q[low + i] * x[at], 1)[:, -1]  # term by term, so that the sum doesn't depend on the machine
            if least is not None:
                at, exact = at[exact >= least[low + i]], exact[exact >= least[low + i]]
            order = np.lexsort((ids[at], -exact))[:k]
            yield low + i, ids[at][order], exact[order]


def prepared(vectors: DataFrame, k: int, every: int, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """(vectors (vec_id, h, g) that take part, their classes (h, g, rep, members, x, asked, norm)); None without any."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    valid = vectors.filter("vec_id is not null and embedding is not null").filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    longest = valid.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    whole = F.when(F.size("x") < longest, F.concat("x", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("x")))).otherwise(F.col("x"))
    named = valid.select("vec_id", whole.alias("x")).select("vec_id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"))
    # Only the k + 1 smallest ids of a class leave a task, however many copies there are.
    few = named.dropDuplicates(["vec_id", "h", "g"]).withColumn("at", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).filter(F.col("at") <= k + 1)
    asked = named.groupBy("h", "g").agg(F.max(F.pmod("vec_id", F.lit(every)) == 0).alias("asked"))
    classes = few.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("members"), F.first("x").alias("x")).join(asked, ["h", "g"])
    classes = classes.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))
    if vectors.schema["embedding"].dataType.elementType.typeName() == "float":
        classes = classes.withColumn("x", F.col("x").cast("array<float>"))  # half the bytes, and the same numbers
    return named.select("vec_id", "h", "g"), scratch.table(classes, "classes")


def plan(classes: DataFrame, k: int, scratch: Scratch) -> tuple[Curves, int, int, int, bool, DataFrame | None]:
    """(curves, how many of them, reach in positions, rows, whether queries lie by direction, the best (q, rep, score) of some queries): fitted on a sample and calibrated on the true neighbours of those queries; no curves if such windows would hold over half of the rows."""
    spark = classes.sparkSession
    n, longest, d = classes.agg(F.count("*"), F.max("norm"), F.max(F.size("x"))).first()
    rows = max(PROBES, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    picked = classes.orderBy(F.xxhash64("rep"), "rep").limit(rows).select("rep", "x").toArrow()
    sample = np.array(picked["x"].combine_chunks().flatten(), float).reshape(-1, d)
    curves = Curves(sample, float(longest))
    probed = min(PROBES, -(-classes.filter("asked").count() // 10))
    some = classes.filter("asked").orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(probed).select("rep", "x").toArrow()
    if not len(some):
        return curves, 0, 0, n, True, None
    probes = some["rep"].to_numpy(), np.array(some["x"].combine_chunks().flatten(), float).reshape(-1, d)
    shared = spark.sparkContext.broadcast((curves, probes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves, (who, q) = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, m = batch.column("rep").to_numpy(), np.array(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
                share = dict(zip(ids.tolist(), curves.shares(curves.keys(m)).tolist(), strict=True))
                found = [(int(who[i]), int(r), float(s), share[int(r)]) for i, near, score in _top(q, m, ids, k + 1) for r, s in zip(near, score, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], names=["q", "rep", "score", "share"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = classes.select("rep", "x").mapInArrow(scan, "q long, rep long, score double, share array<double>").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    best = scratch.table(best.drop("at"), "probes")
    true = best.filter("rep <> q").select("q", "share").collect()  # PROBES * (k + 1) at most
    if not true:
        return curves, 0, 0, n, True, best.drop("share")
    choices = []
    for sphere in (True, False):
        home = dict(zip(probes[0].tolist(), curves.shares(curves.keys(probes[1], sphere)), strict=True))
        apart = np.abs(np.array([home[r["q"]] - np.array(r["share"]) for r in true])) * n
        choices += [(c, int(np.quantile(apart[:, :c].min(1), TARGET, method="higher")) + -(-n // len(sample)), sphere) for c in CURVES]
    compared = lambda r: r[0] * (min(n, 2 * r[1] + BLOCK) + BLOCK)
    c, reach, sphere = min(choices, key=compared)
    return curves, c if 2 * compared((c, reach, sphere)) <= n else 0, reach, n, sphere, best.drop("share")


def checked(classes: DataFrame, rows: DataFrame, found: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(q, rep, score): the k + 1 best classes of each asked class, exactly: tiles of queries meet the rows (rep, x) of a curve, by groups of close ones, for what isn't below the last of the k + 1 best found."""
    d = classes.agg(F.max(F.size("x"))).first()[0]
    asks = scratch.table(classes.filter("asked").select("rep", "x").join(_least(_best(found, k), k), "rep", "left").fillna(float("-inf"), ["least"]), "checks")
    tiles = -(-asks.count() * (8 * d + 16 * (k + 1)) // TILE)
    for tile in range(tiles):
        some = asks.filter(F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(tiles)) == tile).toArrow()
        if not len(some):
            continue
        shared = classes.sparkSession.sparkContext.broadcast((some["rep"].to_numpy(), np.array(some["x"].combine_chunks().flatten(), float).reshape(-1, d), some["least"].to_numpy()))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            who, q, least = shared.value
            best, held = Best(q, least, k + 1), []

            def met() -> None:
                ids, x = (np.concatenate(part) for part in zip(*held, strict=True))
                held.clear()
                for at in close_groups(x):
                    best.meet(x[at], ids[at])

            for batch in batches:
                if batch.num_rows:
                    held.append((batch.column("rep").to_numpy(), np.array(batch.column("x").flatten(), float).reshape(-1, d)))
                    if sum(len(ids) for ids, _ in held) >= PRODUCT or sum(x.nbytes for _, x in held) >= TILE:
                        met()
            if held:
                met()
            at, ids, scores = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(who[at]), pa.array(ids), pa.array(scores)], names=["q", "rep", "score"])

        best = _best(rows.select("rep", "x").mapInArrow(scan, "q long, rep long, score double"), k)
        found = found.unionByName(scratch.table(best, "tile"))
        shared.destroy()
    return _best(found, k)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    ready = prepared(vectors, k, every, scratch)
    if ready is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named, classes = ready
    curves, count, reach, n, sphere, known = plan(classes, k, scratch)
    if known is None:  # no vector is asked for
        scratch.clear()
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found, rows = candidates(classes, curves, count or 1, reach if count else 0, n, sphere, k, scratch)
    best = scratch.keep(checked(classes, rows.filter("curve = 0"), found.unionByName(known), k, scratch), "best")
    members = scratch.keep(best.join(classes.select("rep", "members"), "rep").select("q", "score", F.explode("members").alias("vec_id")), "members")
    queries = scratch.keep(named.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "h", "g").distinct().join(classes.select("h", "g", F.col("rep").alias("q")), ["h", "g"]).select("query_id", "q"), "queries")
    scratch.clear()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = queries.join(members, "q").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def positions(classes: DataFrame, curves: Curves, count: int, n: int, sphere: bool, scratch: Scratch) -> DataFrame:
    """(rep, curve, ask, at): where each row, and each query (ask), lies on each curve; at counts the rows before it."""
    ranges = max(1, min(-(-n // BLOCK), len(curves.sorted) // 8))
    shared = classes.sparkSession.sparkContext.broadcast(curves)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, ids = np.array(batch.column("x").flatten(), float).reshape(batch.num_rows, -1), batch.column("rep").to_numpy()
                asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
                for some, query in ((np.arange(len(m)), False), (asked, True)):
                    keys = shared.value.keys(m[some], query and sphere, count) if len(some) else np.empty((0, count), np.int64)
                    places = shared.value.ranges(keys, ranges) if len(some) else keys
                    size = len(some) * count
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], count)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(some))), pa.array(np.full(size, query)), pa.array(places.ravel().astype(np.int32)), pa.array(keys.ravel())], names=["rep", "curve", "ask", "range", "key"])

    keyed = scratch.table(classes.select("rep", "asked", "x").mapInArrow(index, "rep long, curve int, ask boolean, range int, key long"), "keys")
    # The running count of rows in a range, and the rows of the ranges before it: a table of at most SAMPLE rows.
    row = F.when(F.col("ask"), 0).otherwise(1)
    inside = F.sum(row).over(Window.partitionBy("curve", "range").orderBy("key", "ask", "rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - row
    totals = keyed.groupBy("curve", "range").agg(F.sum(row).alias("rows"))
    before = totals.select("curve", "range", F.coalesce(F.sum("rows").over(Window.partitionBy("curve").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return scratch.table(keyed.withColumn("inside", inside).join(before, ["curve", "range"]).select("rep", "curve", "ask", (F.col("inside") + F.col("before")).alias("at")), "positions")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k + 1 best rows (q, rep, score) of each q, once each."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return pairs.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).drop("rank")


def _least(best: DataFrame, k: int) -> DataFrame:
    """(rep, least): the score that all of a query's k + 1 best (q, rep, score) reach; none while they are fewer."""
    return best.groupBy(F.col("q").alias("rep")).agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))


def _met(asks: DataFrame, rows: DataFrame, x: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(q, rep, score): the k + 1 best rows (rep, curve, block, x) of each block that a query (rep, curve, block, least) asks for, of those with a score of least or more."""
    # Blocks that many queries ask for meet them in several tasks.
    meets = scratch.table(asks.groupBy("curve", "block").agg(F.ceil(F.count("*") / F.lit(MEET)).cast("int").alias("t")), "meets")
    dealt = asks.join(meets, ["curve", "block"]).select("rep", "curve", "block", "least", F.pmod(F.xxhash64("rep"), F.col("t")).cast("int").alias("part"))
    left = scratch.table(dealt.join(x, "rep"), "asks")
    right = rows.join(meets, ["curve", "block"]).select("rep", "curve", "block", "x", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("part"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "rep": [], "score": []}).astype({"q": "int64", "rep": "int64", "score": "float64"})
        who, ids = left["rep"].to_numpy(), right["rep"].to_numpy()
        found = list(_top(np.stack(left["x"]).astype(float), np.stack(right["x"]).astype(float), ids, k + 1, left["least"].to_numpy()))
        return pd.DataFrame({"q": np.repeat(who[[i for i, _, _ in found]], [len(r) for _, r, _ in found]), "rep": np.concatenate([r for _, r, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    keys = ("curve", "block", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "q long, rep long, score double")


def candidates(classes: DataFrame, curves: Curves, count: int, reach: int, n: int, sphere: bool, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((q, rep, score), (rep, curve, block, x)): the k + 1 best classes found of each asked class, by windows on each curve, and the rows in the blocks of the curves.

    The blocks that a query lies in come first; the others only give what isn't below the last of the best found there.
    """
    place = positions(classes, curves, count, n, sphere, scratch)
    block = lambda at: F.floor(at / F.lit(BLOCK))
    at, last = F.col("at"), F.lit(n - 1)
    home = block(F.greatest(F.least(at, last), F.lit(0)))
    windows = F.sequence(block(F.greatest(at - reach, F.lit(0))), block(F.greatest(F.least(at + reach, last), F.lit(0))))
    x = classes.select("rep", "x")
    placed = place.filter("not ask").select("rep", "curve", block(at).alias("block")).join(x, "rep")
    rows = scratch.table(placed.repartition("curve", "block").sortWithinPartitions("curve", "block"), "rows")
    first = place.filter("ask").select("rep", "curve", home.alias("block"), F.lit(float("-inf")).alias("least"))
    near = scratch.table(_best(_met(first, rows, x, k, scratch), k), "near")
    if not reach:
        return near, rows
    others = place.filter("ask").select("rep", "curve", home.alias("home"), F.explode(windows).alias("block")).filter("block <> home").drop("home")
    far = _met(others.join(_least(near, k), "rep", "left").fillna(float("-inf"), ["least"]), rows, x, k, scratch)
    return scratch.table(_best(near.unionByName(far), k), "found"), rows
