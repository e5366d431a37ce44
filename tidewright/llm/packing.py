"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Texts are cut into pieces of at most ``capacity`` ids; only longer ones are cut. Full pieces are sequences of their own. The
other pieces' lengths are dealt by a hash to islands of about ISLAND pieces. Each island evolves a small population of
packings: the first is best-fit decreasing, the others best-fit in random orders. Crossover injects whole well-filled bins
of one parent into the other, removes the bins that hold duplicates, and best-fits the displaced pieces in decreasing
order; fitness is the mean squared fill. An island whose first packing meets the lower bound has nothing to evolve.

At the end of an epoch an island's elite, the bins that are filled to ELITE or more, migrate whole to other islands, whose
populations hold them as bins beside packings that open them; an elite bin that its new island's best packing keeps is done, and
so is one without room. The pieces of poorly filled bins are dealt anew. Where hardly any bin is elite (no sums of
lengths come near the capacity), all but the emptiest bins are done, and the rest goes to fewer islands, until one is left.

Only (key, length, group) move between tasks, never ids or texts. Nulls and empty texts are the end id alone; very long texts are
cut into full pieces. Rows that repeat a doc_id are packed each by itself. An empty table gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch
from tidewright.llm.tokens import Encoder, with_end
from tidewright.llm.words import chunks

ISLAND, POPULATION, GENERATIONS, ELITE = 4096, 6, 16, 0.998
#: Tasks of an epoch at most; each takes its islands one after the other.
TASKS = 4096


def best_fit(sizes: list[int], pieces: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Puts each piece, in the given order, into the open bin that it fills most; bins given stay and take more."""
    bins = [list(b) for b in bins or []]
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has exactly r left
    for k, b in enumerate(bins):
        r = capacity - sum(sizes[p] for p in b)
        room[r].append(k)
        open_ |= 1 << r
    for p in pieces:
        s = sizes[p]
        fit = open_ >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
            bins[k].append(p)
            r -= s
        else:
            k, r = len(bins), capacity - s
            bins.append([p])
        room[r].append(k)
        open_ |= 1 << r
    return bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> float:
    return sum((sum(sizes[p] for p in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], giver: list[list[int]], taker: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The taker with some whole well-filled bins of the giver; what that displaces is best-fitted again."""
    full = sorted(giver, key=lambda b: -sum(sizes[p] for p in b))[: max(1, len(giver) // 2)]
    inject = [full[i] for i in np.flatnonzero(rng.random(len(full)) < 0.5)] or full[:1]
    taken = {p for b in inject for p in b}
    kept, loose = list(inject), []
    for b in taker:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            loose += [p for p in b if p not in taken]
    # Poorly filled bins are opened as well, so that their pieces can fill gaps.
    ends = [b for b in kept if sum(sizes[p] for p in b) < 0.9 * capacity]
    loose += [p for b in ends for p in b]
    kept = [b for b in kept if sum(sizes[p] for p in b) >= 0.9 * capacity]
    return best_fit(sizes, sorted(loose, key=lambda p: (-sizes[p], p)), capacity, kept)


def evolve(sizes: list[int], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS, migrants: list[list[int]] | None = None) -> list[list[int]]:
    """The best packing of an island, never worse than best-fit decreasing; migrants are bins that came from other islands."""
    rng = np.random.default_rng(seed)
    down = sorted(range(len(sizes)), key=lambda p: (-sizes[p], p))
    lower = -(-sum(sizes) // capacity)
    held = {p for b in migrants or [] for p in b}
    loose = [p for p in down if p not in held]
    packings = [best_fit(sizes, loose, capacity, migrants)] if migrants else []
    if not packings or len(packings[0]) > lower:
        packings.append(best_fit(sizes, down, capacity))
    score = lambda b: (-len(b), fitness(sizes, b, capacity))
    packings.sort(key=score, reverse=True)
    if len(packings[0]) <= lower or len(sizes) < 3:
        return packings[0]
    while len(packings) < population:
        some = loose if migrants and len(packings) % 2 else list(range(len(sizes)))
        packings.append(best_fit(sizes, [some[i] for i in rng.permutation(len(some))], capacity, migrants if some is loose else None))
    packings.sort(key=score, reverse=True)
    for _ in range(generations):
        giver, taker = rng.integers(0, max(1, population // 2)), rng.integers(0, population)
        packings.append(crossover(sizes, packings[giver], packings[taker], capacity, rng))
        packings.sort(key=score, reverse=True)
        packings.pop()
        if len(packings[0]) <= lower:
            break
    return packings[0]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end: int, scratch: Scratch) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, key): each text's ids and the end id, cut into pieces; key tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, _, data, offsets in chunks(batch):
                flat, bounds = with_end(*encoder.encode(data, offsets), end)
                total = np.diff(bounds)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                at = bounds[row] + start
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at + length, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[low + i] for i in row], pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return scratch.keep(found.withColumn("key", F.monotonically_increasing_id()), "pieces")


def _epoch(pieces: DataFrame, islands: int, epoch: int, capacity: int, last: bool, trim: bool, scratch: Scratch) -> DataFrame:
    """(key, length, bin, offset, done) of pieces (key, length, group): bins are named by their smallest key, null for pieces to be dealt anew.

    Bins that are done: elite ones that came as a group and were kept, or have no room; all bins at last; with trim all but the
    emptiest eighth of each island. Other elite bins are the groups of the next epoch.
    """

    def island(key: np.ndarray, size: list[int], group: np.ndarray, number: int) -> pa.RecordBatch:
        named: dict[int, list[int]] = {}
        for p in np.flatnonzero(group >= 0).tolist():
            named.setdefault(int(group[p]), []).append(p)
        migrants = list(named.values())
        came = {tuple(b) for b in migrants}
        filled = sorted(((sum(size[p] for p in b), b) for b in evolve(size, capacity, epoch * 1_000_003 + number, migrants=migrants)), key=lambda x: x[0])
        rows = ([], [], [], [], [])
        for k, (fill, b) in enumerate(filled):
            elite = fill >= ELITE * capacity
            done = last or fill == capacity or (elite and tuple(sorted(b)) in came) or (trim and k >= max(1, len(filled) // 8))
            name, at = int(min(key[p] for p in b)), 0
            for p in b:
                for column, value in zip(rows, (int(key[p]), size[p], name if done or elite else None, at if done else None, done), strict=True):
                    column.append(value)
                at += size[p]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=["key", "length", "bin", "offset", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                key, size, group = (np.concatenate([h[i] for h in held]) for i in range(3))
                held.clear()
                order = np.argsort(key, kind="stable")
                yield island(key[order], size[order].tolist(), group[order], now)

        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("island").to_numpy()
            parts = [batch.column("key").to_numpy(), batch.column("length").to_numpy(), batch.column("group").fill_null(-1).to_numpy(zero_copy_only=False)]
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if int(number[low]) != now:
                    yield from ended()
                    now = int(number[low])
                held.append([x[low:high] for x in parts])
        yield from ended()

    home = F.pmod(F.xxhash64(F.coalesce("group", "key"), F.lit(epoch)), F.lit(islands))
    mine = pieces.select("key", "length", "group", home.alias("island"))
    return scratch.keep(mine.repartition(min(islands, TASKS), "island").sortWithinPartitions("island").mapInArrow(run, "key long, length long, bin long, offset long, done boolean"), "epoch")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): whole documents in few sequences of at most capacity ids."""
    scratch = Scratch(docs.sparkSession)
    pieces = pieces_of(docs, tokenizer, capacity, end, scratch)
    left = pieces.filter(F.col("length") < capacity).select("key", "length", F.lit(None).cast("long").alias("group"))
    placed = pieces.filter(F.col("length") == capacity).select("key", F.col("key").alias("bin"), F.lit(0).cast("long").alias("offset"))
    n = loose = left.count()
    epoch, trim, halved = 0, False, 0
    while n:
        islands = max(1, -(-n // ISLAND) >> halved)
        done = _epoch(left, islands, epoch, capacity, islands == 1, trim, scratch)
        placed = placed.unionByName(done.filter("done").select("key", "bin", "offset"))
        left = done.filter("not done").select("key", "length", F.col("bin").alias("group"))
        n, now = left.agg(F.count("*"), F.count_if(F.col("group").isNull())).first()
        if now > 0.9 * loose:  # hardly any bin is well filled: only the emptiest are dealt anew, and if that does not help, to fewer islands
            trim, halved = True, halved + trim
        loose, epoch = now, epoch + 1
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
