"""N-gram Jaccard join by PartEnum signatures, and the groups that its links form.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Two different sets s, t with
|s & t| / |s | t| >= num/den differ in at most (den-num)/(den+num) * (|s|+|t|) elements. Sizes fall into bands whose ends
differ by the factor num/den, so linked sets lie in one band or in neighbouring ones; a set of band i takes part in the
instances i and i+1. An instance deals the feature domain to n1 first-level partitions of n2 cells each and enumerates the
subsets of n2-k2 cells of every partition; a signature is the hash of the elements in those cells. With at most d
differing elements, at most d // (k2+1) partitions have more than k2 differing cells, so linked sets share a signature.

Some signatures are shared by chance: weak ones over few elements, and hot ones, which more than HOT sets have (frequent
lines). n1 has ``slack`` and ``spare`` partitions beyond those that the pigeonhole argument needs. A set with at most
``slack`` partitions that hold a weak signature leaves its weak ones out; a set with at most ``spare`` hot signatures leaves
these out. Linked sets share more than slack + spare partitions. If one of them leaves hot signatures out, more than slack
shared partitions have none; if one of them leaves weak ones out, a shared partition without weak ones remains; its
signature both emit. If neither leaves some kind out, both emit all of that kind. Nothing is lost. The sets of a large
group of near copies have hot signatures throughout, and keep them.

Signatures travel packed: 40 bits of hash beside the bucket's number and 16 bits that name the set in a table of the
packet, some 6 bytes a signature. Sets that share one form a list; equal lists are one, and gaps in size that no link spans
cut it. Sketches, the parities of a set's elements by cell, rule out most pairs and no link: first every member of a list is
compared with the list's pivot, then lists whose members aren't yet connected are tested within tiles. What sketches
leave is tested exactly on the whole sets, pair by pair; a group that these pairs don't connect is tested within tiles again.
Tiles are of bounded size and give a spanning forest, never all pairs. Of a list over several tiles, only the sets outside
its largest connected part meet all others.

Copies have one set, one id and one set of signatures. Nulls and texts without words have an empty set, which is linked with
nothing; a text with fewer than k words has one shingle, the whole sequence. Very long texts are handled whole, each by itself,
in memory proportional to the text. Repeated rows form one group. Rows with a null doc_id keep it and get a null component
only if all of their group have it. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, components, few_small_tasks, mix
from tidewright.llm.words import chunks, words

#: Cells a first-level partition has, and cells that may differ in one.
N2, K2 = 2, 1
#: A signature of more sets is hot.
HOT = 256
#: A tile holds so many sets and bytes of sketches or elements at most.
TILE_SETS, TILE_BYTES = 4096, 16 << 20
#: Signatures of a bucket on average, of a packet of one task, and sets that a packet's table names.
BUCKET, PACKET, NAMED = 2 << 20, 1 << 20, 1 << 15
#: Sets that are compared with one pivot in a task.
LEAVES = 512
#: Elements of so many sets of a tile are counted by a matrix product, rarer ones pair by pair.
FREQUENT = 32
#: Up to so many ids are broadcast to find their texts (about 30 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000

_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, bounds): text i of a chunk has the sorted distinct shingle hashes elements[bounds[i]:bounds[i+1]].

    A-Z are lower-cased and words end at ASCII white space.
    """
    h, _, _, first = words(data, offsets)
    h, count = mix(h), np.diff(first)
    rows = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(rows)])
    row = np.repeat(np.arange(len(count)), rows)
    at = np.arange(bounds[-1]) - bounds[row] + first[row]
    x = np.zeros(len(at), np.uint64)
    for i in range(k):
        there = at + i < first[row + 1]
        x += np.where(there, h[np.minimum(at + i, max(len(h) - 1, 0))] * _A[i], _A[7]) if len(h) else 0
    x = mix(x)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        x[a:b].sort()
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[fresh], np.concatenate([np.zeros(1, np.int64), np.cumsum(fresh)])[bounds]


def set_ids(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A signed 64-bit id of each set of a chunk, the same for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ _A[5]), dtype=np.uint64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * _A[2]).view(np.int64)


def weak_below(num: int, den: int) -> int:
    """A signature over fewer elements is weak: 2, or 1 at similarities under 0.9, where signatures are too small for more."""
    return 2 if 10 * num >= 9 * den else 1


@lru_cache
def bands(num: int, den: int) -> np.ndarray:
    """The largest size in each band."""
    ends, low = [], 1
    while low < 1 << 40:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return np.array(ends)


@lru_cache(maxsize=None)
def instance(j: int, num: int, den: int, n2: int, k2: int, weak: int) -> tuple[int, int, int, int]:
    """(first-level partitions, slack, spare, differing elements) of instance j.

    It serves pairs within band j-1 and pairs of the bands j-1 and j, and so no pair for j = 0.
    """
    if not j:
        return 1, 0, 0, 0
    ends = bands(num, den)
    low = int(ends[j - 2]) + 1 if j >= 2 else 1
    differ = (den - num) * int(ends[j - 1] + ends[j]) // (den + num)
    need = differ // (k2 + 1) + 1
    spare = 1 + need // 8
    if need <= 3:
        return need + spare, 0, spare, differ
    slack = 0
    for _ in range(8):
        mean = low * (n2 - k2) / n2 / (need + spare + slack)
        term, few = np.exp(-mean), 0.0
        for i in range(weak):
            few += term
            term *= mean / (i + 1)
        share = min(1.0, len(_subsets(n2, k2)) * few)
        slack = min(need, int(np.ceil((need + spare + slack) * share + 2 * np.sqrt((need + spare + slack) * share))))
    return need + spare + slack, slack, spare, differ


def _instances(j: np.ndarray, num: int, den: int, n2: int = N2, k2: int = K2) -> np.ndarray:
    """The four columns of ``instance`` for each of j."""
    kinds, inverse = np.unique(j, return_inverse=True)
    return np.array([instance(int(x), num, den, n2, k2, weak_below(num, den)) for x in kinds], np.int64).reshape(-1, 4)[inverse].T


@lru_cache
def _subsets(n2: int, k2: int) -> np.ndarray:
    from itertools import combinations

    return np.array(list(combinations(range(n2), n2 - k2)))


def signatures(elements: np.ndarray, bounds: np.ndarray, num: int, den: int, n2: int = N2, k2: int = K2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, owning sets, steps) of the sets of a chunk, step 1 for the later of a set's two instances; empty sets have none."""
    size = np.diff(bounds)
    band, weak = np.searchsorted(bands(num, den), size), weak_below(num, den)
    subsets = _subsets(n2, k2)
    found, owners, steps = [], [], []
    for step in (0, 1):
        j = band + step
        n1, slack, _, differ = _instances(j, num, den, n2, k2)
        n1 = np.where((differ > 0) & (size > 0), n1, 0)  # else only equal sets are linked, and they have one id
        one = np.repeat(np.arange(len(size)), np.where(n1 > 0, size, 0))
        mine = elements[np.repeat(n1 > 0, size)]
        start = np.concatenate([np.zeros(1, np.int64), np.cumsum(n1)])
        x = mix(mine + (j.astype(np.uint64) * _A[3])[one])
        cell = ((x >> np.uint64(20)) % (n1 * n2).astype(np.uint64)[one]).astype(np.int64) + start[one] * n2
        value = np.zeros(start[-1] * n2, np.uint64)
        np.add.at(value, cell, mix(x ^ _A[6]))
        value, count = value.reshape(-1, n2), np.bincount(cell, minlength=start[-1] * n2).reshape(-1, n2)
        owner = np.repeat(np.arange(len(size)), n1)
        part = (np.arange(start[-1]) - start[owner]).astype(np.uint64)
        tag = (part[:, None] * np.uint64(len(subsets)) + np.arange(len(subsets), dtype=np.uint64)) * _A[4] + (j.astype(np.uint64) * _A[7])[owner][:, None]
        sig = mix(mix((value[:, subsets] * (subsets.astype(np.uint64) * np.uint64(2) + np.uint64(1))).sum(2, dtype=np.uint64)) + tag)
        strong = count[:, subsets].sum(2) >= weak
        odd = np.bincount(owner, weights=~strong.all(1), minlength=len(size)) > slack
        keep = strong | odd[owner][:, None]
        found.append(sig[keep])
        owners.append(np.repeat(owner, len(subsets)).reshape(keep.shape)[keep])
        steps.append(np.full(len(found[-1]), step, np.uint16))
    return np.concatenate(found), np.concatenate(owners), np.concatenate(steps)


def cells_of(n: np.ndarray) -> np.ndarray:
    """Cells of a sketch: the power of two that is n or more, 64 at least."""
    return np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def sketches(elements: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """One bit for each cell of a set: whether it holds an odd number of elements.

    An element that only one of two sets has turns one bit, so two sets differ in no fewer elements than bits. Halves of a sketch
    combined by exclusive or are the sketch of half as many cells.
    """
    n = np.diff(bounds)
    cells = cells_of(n)
    start = np.concatenate([np.zeros(1, np.int64), np.cumsum(cells)])
    row = np.repeat(np.arange(len(n)), n)
    place = (mix(elements + _A[1]) >> np.uint64(8)).astype(np.int64) & (cells[row] - 1)
    odd = np.packbits((np.bincount(start[row] + place, minlength=start[-1]) & 1).astype(bool), bitorder="little")
    return [odd[a:b].tobytes() for a, b in zip(start[:-1] // 8, start[1:] // 8, strict=True)]


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sid, sketch): the size, id and sketch of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch):
                elements, bounds = shingle_sets(data, offsets, k)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array(n, pa.int64()), pa.array(set_ids(elements, bounds), mask=n == 0), pa.array(sketches(elements, bounds), pa.binary())], names=["doc_id", "n", "sid", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, sid long, sketch binary")


def _packets(sid: np.ndarray, n: np.ndarray, sig: np.ndarray, owner: np.ndarray, step: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures by bucket, sorted: the bytes of the 40 low bits one place after the other, then the sets' numbers and steps; and the sets."""
    bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket << np.uint64(40) | sig & np.uint64((1 << 40) - 1), kind="stable")
    bucket, low, owner, step = bucket[order].astype(np.int64), sig[order], owner[order], step[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        used, mine = np.unique(owner[a:b], return_inverse=True)
        packed = low[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes() + (mine.astype("<u2") << 1 | step[a:b]).astype("<u2").tobytes()
        named = sid[used].astype("<i8").tobytes() + n[used].astype("<i4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([packed], pa.binary()), pa.array([named], pa.binary())], names=["bucket", "packed", "named"])


def set_signatures(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """(bucket, packed, named): packets of the signatures of each set, once for each set and task (or million sets of a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, sets, sigs = set(), [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, sets, sigs
            if sigs:
                shift = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
                yield from _packets(*(np.concatenate([h[i] for h in held]) for i in (0, 1, 2)), np.concatenate([h[3] + x for h, x in zip(held, shift, strict=True)]), np.concatenate([h[4] for h in held]), buckets)
            held, sets, sigs = [], 0, 0

        for batch in batches:
            for _, _, data, offsets in chunks(batch):
                elements, bounds = shingle_sets(data, offsets, k)
                ids, n = set_ids(elements, bounds), np.diff(bounds)
                first = np.sort(np.unique(ids, return_index=True)[1])
                fresh = [i for i in first.tolist() if n[i] and ids[i].item() not in seen]
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.update(ids[fresh].tolist())
                for low in range(0, len(fresh), NAMED):
                    some = np.array(fresh[low : low + NAMED])
                    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(n[some])])
                    mine = elements[np.repeat(bounds[some] - at[:-1], n[some]) + np.arange(at[-1])]
                    sig, owner, step = signatures(mine, at, num, den)
                    if sets + len(some) > NAMED or sigs + len(sig) > PACKET:
                        yield from flush()
                    held.append((ids[some], n[some], sig, owner, step))
                    sets, sigs = sets + len(some), sigs + len(sig)
        yield from flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, packed binary, named binary")


class _Bucket:
    """Collects the signatures of one bucket and gives the lists (list, sid, step, spare); spare is -1 where the signature isn't hot."""

    def __init__(self, number: int, num: int, den: int, most: int, rows: int):
        self.number, self.num, self.den, self.most, self.least = number, num, den, most, 4 * rows
        self.held, self.rows, self.limit, self.hot = [], 0, self.least, np.empty(0, np.uint64)

    def add(self, packed: bytes, named: bytes) -> Iterator[pa.RecordBatch]:
        m, k = len(packed) // 7, len(named) // 12
        sid, n = np.frombuffer(named, "<i8", k), np.frombuffer(named, "<i4", k, 8 * k)
        low = np.zeros((m, 8), np.uint8)
        low[:, :5] = np.frombuffer(packed, np.uint8, 5 * m).reshape(5, m).T
        mine = np.frombuffer(packed, "<u2", m, 5 * m)
        self.held.append((low.view("<u8").ravel(), sid[mine >> 1], n[mine >> 1], (mine & 1).astype(np.int8)))
        self.rows += m
        if self.rows > self.limit:
            # Hot signatures leave at once, so that what is held stays near the bucket's due share.
            yield from self._lists(False)
            self.rows = sum(len(h[0]) for h in self.held)
            self.limit = max(self.least, 2 * self.rows)

    def _lists(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        sig, sid, n, step = (np.concatenate([h[i] for h in self.held]) for i in range(4))
        order = np.lexsort((sid, n, sig))
        sig, sid, n, step = sig[order], sid[order], n[order], step[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
        sig, sid, n, step = sig[fresh], sid[fresh], n[fresh], step[fresh]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        group = np.cumsum(new) - 1
        hot = (np.bincount(group) > self.most)[group] | np.isin(sig, self.hot)
        self.hot = np.union1d(self.hot, sig[hot & new])
        yield self._rows((mix(sig[hot] | np.full(1, self.number << 40, np.uint64)).view(np.int64), sid[hot], step[hot], n[hot]), True)
        self.held = [] if last else [(sig[~hot], sid[~hot], n[~hot], step[~hot])]
        if not last:
            return
        sig, sid, n = sig[~hot], sid[~hot], n[~hot]
        new = np.ones(len(sig), bool)
        size = n.astype(np.int64)
        new[1:] = (sig[1:] != sig[:-1]) | (size[:-1] * self.den < size[1:] * self.num)
        group = np.cumsum(new) - 1
        many = (np.bincount(group, minlength=1) > 1)[group] if len(sig) else np.empty(0, bool)
        sid, group = sid[many], group[many]
        if len(sid):
            start = np.flatnonzero(np.diff(group, prepend=-1))
            size = np.diff(np.append(start, len(sid)))
            name = mix(np.add.reduceat(mix(sid.view(np.uint64) ^ _A[1]), start) + size.astype(np.uint64) * _A[2])
            once = np.zeros(len(start), bool)
            once[np.unique(name, return_index=True)[1]] = True  # equal lists are one
            keep = np.repeat(once, size)
            yield self._rows((np.repeat(name, size)[keep].view(np.int64), sid[keep], np.zeros(keep.sum(), np.int8), None), False)

    def _rows(self, columns: tuple, hot: bool) -> pa.RecordBatch:
        lists, sid, step, n = columns
        spare = _instances(np.searchsorted(bands(self.num, self.den), n) + step, self.num, self.den)[2] if hot and len(sid) else np.full(len(sid), -1)
        return pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(sid, pa.int64()), pa.array(step, pa.int8()), pa.array(spare, pa.int64())], names=["list", "sid", "step", "spare"])

    def done(self) -> Iterator[pa.RecordBatch]:
        yield from self._lists(True)


def shared_signatures(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """(list, sid, step, spare): the sets that share a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for number, packed, named in zip(*(batch.column(c) for c in ("bucket", "packed", "named")), strict=True):
                if now is None or now.number != number.as_py():
                    if now:
                        yield from now.done()
                    now = _Bucket(number.as_py(), num, den, HOT, BUCKET)
                yield from now.add(packed.as_py(), named.as_py())
        if now:
            yield from now.done()

    parts = min(buckets, 1 << 15)
    packets = set_signatures(docs, k, num, den, buckets).repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")
    return packets.mapInArrow(run, "list long, sid long, step byte, spare long")


def _rebuilt(docs: DataFrame, wanted: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(sid, n, data): the whole sets of the documents whose doc_id is in wanted (rep, sid), from their texts, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for low, high, data, offsets in chunks(batch):
                elements, bounds = shingle_sets(data, offsets, k)
                n, own = np.diff(bounds), set_ids(elements, bounds)
                sid = batch.column("sid")[low:high].to_numpy(zero_copy_only=False) if "sid" in batch.schema.names else np.where(n > 0, own, own - 1)
                rows = [i for i in range(high - low) if own[i] == sid[i] and sid[i].item() not in seen and not seen.add(sid[i].item())]
                if len(seen) > 1 << 20:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(sid[rows], pa.int64()), pa.array(n[rows], pa.int64()), pa.array([elements[bounds[i] : bounds[i + 1]].tobytes() for i in rows], pa.binary())], names=["sid", "n", "data"])

    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    schema = "sid long, n long, data binary"
    sets = texts.join(ids, "rep").select("sid", "text").mapInArrow(run, schema)
    nameless = wanted.filter("rep is null").select("sid")
    if not nameless.isEmpty():  # sets that only rows without a doc_id have are found by their ids
        sets = sets.unionByName(texts.filter("rep is null").select("text").mapInArrow(run, schema).join(nameless, "sid", "left_semi"))
    sets = scratch.table(sets, "whole")
    twice = sets.groupBy("sid").count().filter("count > 1").limit(1).count()
    return sets.dropDuplicates(["sid"]) if twice else sets


def forest(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: den * |s & t| >= num * |s | t|, exactly."""
    m = len(ids)
    size = np.array([len(s) for s in sets])
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(inverse, kind="stable")
    owner, first = owner[order], np.cumsum(times) - times
    common = np.zeros(m * m, np.int32)
    for d in range(2, min(FREQUENT, m + 1)):
        rows = owner[first[times == d][:, None] + np.arange(d)]
        for x in range(d - 1):
            for y in range(x + 1, d):
                np.add.at(common, rows[:, x] * m + rows[:, y], 1)
    common = common.reshape(m, m)
    frequent = np.flatnonzero(times >= FREQUENT)
    for low in range(0, len(frequent), 1024):
        some = frequent[low : low + 1024]
        block = np.zeros((m, len(some)), np.float32)
        for k, e in enumerate(some):
            block[owner[first[e] : first[e] + times[e]], k] = 1
        for at in range(0, m, 512):
            common[at : at + 512] += np.rint(block[at : at + 512] @ block.T).astype(np.int32)
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x in range(m - 1):
        inter = common[x, x + 1 :].astype(np.int64)
        for y in np.flatnonzero((inter > 0) & (den * inter >= num * (size[x] + size[x + 1 :] - inter))) + x + 1:
            if (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((int(ids[x]), int(ids[y])))
    return out


def _folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """Sketches (the last axis) folded to width words."""
    while sketch.shape[-1] > width:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def sketch_forest(ids: np.ndarray, n: np.ndarray, raw: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches don't rule a link out: it connects all that links connect."""
    out, words_ = [], np.array([len(x) // 8 for x in raw])
    left, cells = {}, {}
    for w in np.unique(words_).tolist():
        left[w] = np.flatnonzero(words_ == w)
        cells[w] = np.frombuffer(b"".join(raw[i] for i in left[w]), "<u8").reshape(-1, w)
    while any(len(x) for x in left.values()):
        # Grow the component of the first set left, one set's pairs at a time; linked sets' widths differ by one step at most.
        w = next(w for w, x in left.items() if len(x))
        todo = [(left[w][0], cells[w][0])]
        left[w], cells[w] = left[w][1:], cells[w][1:]
        while todo:
            x, sketch = todo.pop()
            for w in (len(sketch) // 2, len(sketch), len(sketch) * 2):
                if w not in left or not len(left[w]):
                    continue
                y, m = left[w], min(w, len(sketch))
                differ = np.bitwise_count(_folded(cells[w], m) ^ _folded(sketch, m)).sum(1, dtype=np.int64)
                near = ((den + num) * differ <= (den - num) * (n[y] + n[x])) & (den * np.minimum(n[y], n[x]) >= num * np.maximum(n[y], n[x]))
                if near.any():
                    out += [(int(ids[i]), int(ids[x])) for i in y[near]]
                    todo += list(zip(y[near].tolist(), cells[w][near], strict=True))
                    left[w], cells[w] = y[~near], cells[w][~near]
    return out


def _near(n: int, a: bytes, m: int, b: bytes, num: int, den: int) -> bool:
    """Whether two sketches leave a link possible."""
    if den * min(n, m) < num * max(n, m):
        return False
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    width = min(len(x), len(y))
    return (den + num) * int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(dtype=np.int64)) <= (den - num) * (n + m)


def _linked(n: int, a: bytes, m: int, b: bytes, num: int, den: int) -> bool:
    """Whether two whole sets are linked."""
    if den * min(n, m) < num * max(n, m):
        return False
    both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]))
    inter = int((both[1:] == both[:-1]).sum())
    return den * inter >= num * (n + m - inter)


def _pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int, whole: bool, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b) those whose sketches, or whole sets, pass; sets is (sid, n, data).

    A b with many pairs is dealt to several groups, to each of which its own set goes once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, now, n, data = _linked if whole else _near, None, 0, b""
        for batch in batches:
            found = []
            for b, salt, leaf, sid, size, raw in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "leaf", "sid", "n", "data")), strict=True):
                if not leaf:
                    now, n, data = (b, salt), size, raw
                elif now == (b, salt) and test(n, data, size, raw, num, den):
                    found.append((sid, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    ends = scratch.table(pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(LEAVES)).cast("int").alias("t")), "ends")
    # Only a b of several groups needs its number there; those are few, and no pairs move to find them.
    large = ends.filter("t > 1")
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    salt = F.when(F.col("t") > 1, F.pmod(F.xxhash64("a", F.lit(5)), F.col("t"))).otherwise(0).cast("int")
    leaves = pairs.join(large, "b", "left").select(F.col("a").alias("sid"), "b", salt.alias("salt"), F.lit(1).alias("leaf"))
    roots = ends.select(F.col("b").alias("sid"), "b", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("salt"), F.lit(0).alias("leaf"))
    rows = leaves.unionByName(roots).join(sets, "sid").select("b", "salt", "leaf", "sid", "n", "data")
    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "leaf").mapInArrow(run, "a long, b long")


def _tested(members: DataFrame, sets: DataFrame, num: int, den: int, whole: bool, scratch: Scratch) -> DataFrame:
    """Links (a, b) within each list of members (list, sid, root), or the pairs that sketches leave; root tells what is connected already.

    A list that fits a tile is one. Of a larger one, the sets outside its largest connected part and the others are cut into blocks;
    a tile holds two blocks, one of them of the first kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sizes, raws = None, [], [], []

        def done() -> pa.RecordBatch:
            links = []
            if len(ids) > 1:
                links = forest(np.array(ids), [np.frombuffer(x, np.uint64) for x in raws], num, den) if whole else sketch_forest(np.array(ids), np.array(sizes), raws, num, den)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, x, y, sid, n, raw in zip(*(batch.column(c).to_pylist() for c in ("list", "x", "y", "sid", "n", "data")), strict=True):
                if (key, x, y) != tile:
                    if len(ids) > 1:
                        yield done()
                    tile, ids, sizes, raws = (key, x, y), [], [], []
                ids.append(sid)
                sizes.append(n)
                raws.append(raw)
        yield done()

    size = sets.select("sid", F.length("data").cast("long").alias("bytes"))
    sized = members.join(size, "sid")
    parts = sized.groupBy("list", "root").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
    lists = parts.groupBy("list").agg(F.sum("c").alias("c"), F.sum("bytes").alias("bytes"), F.max(F.struct("c", "root", "bytes")).alias("top"))
    fits = (F.col("c") <= TILE_SETS) & (F.col("bytes") <= TILE_BYTES)
    cut = lambda c, b: F.greatest(F.ceil(c * 2 / TILE_SETS), F.ceil(b * 2 / TILE_BYTES)).cast("int")
    large = scratch.table(lists.filter(~fits).select("list", F.col("top.root").alias("top"), cut(F.col("c") - F.col("top.c"), F.col("bytes") - F.col("top.bytes")).alias("outer"), cut(F.col("top.c"), F.col("top.bytes")).alias("inner")), "large")
    both = sized.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "list", "left")
    inside = F.col("root") == F.col("top")
    slot = lambda n: F.pmod(F.xxhash64("sid", F.lit(7)), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(inside, F.col("outer") + slot(F.col("inner"))).otherwise(slot(F.col("outer")))
    blocks = F.when(inside, F.when(F.col("outer") > 0, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    tiles = F.when(F.col("top").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(blocks, lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y"))))
    rows = both.select("list", "sid", F.explode(tiles).alias("tile")).select("list", "sid", "tile.x", "tile.y").join(sets, "sid")
    return rows.select("list", "x", "y", "sid", "n", "data").repartition("list", "x", "y").sortWithinPartitions("list", "x", "y").mapInArrow(run, "a long, b long")


def _unsettled(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(list, sid, root): the members (list, sid) of lists that the components (node, root) don't connect."""
    rooted = members.join(joined.withColumnRenamed("node", "sid"), "sid", "left").select("list", "sid", F.coalesce("root", "sid").alias("root"))
    open_ = rooted.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).filter("low < high and c > 2").select("list")
    return rooted.join(open_, "list")


def ngram_jaccard_groups(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_shingles, component_id, set_id).

    component_id is the smallest doc_id reachable by links; set_id is the class of documents with equal sets (null: empty).
    """
    with few_small_tasks(docs.sparkSession):
        return _groups(docs, k, num, den)


def _groups(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sets = scratch.keep(document_sets(docs, k), "sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    classes = scratch.table(sets.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("data")), "classes")
    sketched = classes.select("sid", "n", "data")

    shared = scratch.table(shared_signatures(docs, k, num, den, buckets), "shared")
    hot = shared.filter("spare >= 0").distinct()
    many = hot.groupBy("sid", "step").agg(F.count("*").alias("c"))
    kept = hot.join(many, ["sid", "step"]).filter("c > spare").select("list", "sid")
    members = scratch.table(shared.filter("spare < 0").select("list", "sid").distinct().unionByName(kept), "members")

    pivots = members.groupBy("list").agg(F.min("sid").alias("b"))
    pairs = members.join(pivots, "list").filter("sid <> b").select(F.col("sid").alias("a"), "b").distinct()
    near = scratch.table(_pairs(scratch.table(pairs, "pairs"), sketched, num, den, False, scratch), "near")
    open_ = scratch.table(_unsettled(members, components(near, scratch)), "open")
    more = scratch.table(_tested(open_, sketched, num, den, False, scratch), "more")

    near = near.unionByName(more).distinct()
    groups = scratch.table(components(near, scratch).withColumnRenamed("node", "sid").join(classes.select("sid", "rep"), "sid"), "groups")
    whole = _rebuilt(docs, groups.select("sid", "rep"), k, scratch)
    links = scratch.table(_pairs(near, whole, num, den, True, scratch), "links")
    open_ = scratch.table(_unsettled(groups.select(F.col("root").alias("list"), "sid"), components(links, scratch)), "unlinked")
    links = links.unionByName(scratch.table(_tested(open_, whole, num, den, True, scratch), "last"))

    least = classes.select("sid", "rep").join(components(links, scratch).withColumnRenamed("node", "sid"), "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    smallest = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(least.join(smallest, "root").select("sid", "component_id"), "named")
    scratch.clear()
    return sets.select("doc_id", "n", "sid").join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("sid").alias("set_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; all its columns stay.

    Documents with an empty set or a null doc_id stay, each of them. Rows that repeat a doc_id stay or go together.
    """
    groups = ngram_jaccard_groups(docs, k, num, den)
    gone = Scratch(docs.sparkSession).keep(groups.filter("doc_id <> component_id and set_id is not null").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs["doc_id"] == gone["gone"], "left_anti")
