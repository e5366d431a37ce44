"""Language-model scores by Katz back-off: Good-Turing discounted n-gram counts with exactly normalised back-off weights.

A text is its words and one end; A-Z are folded. The model has bigrams (a text begins in a start context), words and one unknown
word, which stands for all that the training texts lack. With c* the discounted count, a seen word w after u has the probability
c*(u,w) / c(u), an unseen one weight(u) * P(w), where P(w) = c*(w) / N, and the unknown word what the others leave. A context that was
never seen gives P(w). Counts up to ``TURING`` are discounted by Good and Turing's formula in Katz's form; larger ones, and small ones for
which the formula gives no value between 0 and the count, lose half an occurrence, so every context keeps some mass for what it
hasn't seen. weight(u) is what the seen words of u leave, over what P leaves to all others: the words and the unknown one sum to 1.

Counts are never gathered in one place; they are tables dealt to buckets by hash, in which the n-grams of a text are looked up:

1. Words are counted, for the frequent ones (at most ``1 / FREQUENT``), which are broadcast, and for the counts of counts.
2. Each block of texts sends its distinct bigrams, with counts and with the texts that hold them, to the buckets of their words; those of a
   frequent word go to the buckets of their contexts instead, and those of two frequent words to buckets of their own, so no word makes a
   bucket large. A bucket adds the counts up, knows the counts of words and bigrams there, and gives each text the sum of its logarithms; what depends
   on the discounts, which aren't known yet, is given as numbers of tokens with each small count.
   The bigrams that were learned are kept with their counts, a row for each bucket; so are the weights of 3.
3. It also sends sums over the seen words of each context, and the bigrams that it didn't find, to the buckets of the contexts, where the
   weights are made and looked up. The weights of frequent contexts are broadcast.
4. Each block adds up what its texts got.

Words are compared by 48-bit hashes. Blocks and buckets are of bounded size, however many there are. Sums are kept in
units of 2^-32, so they don't depend on the order of addition.

Null and empty texts are one end. Rows without a doc_id aren't learned. Repeated rows are learned and scored each by itself. With
nothing to learn every token has probability 1. Very long texts are scored whole, one text being at least a block. An empty table gives no
rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, mix
from tidewright.llm.words import LOWER, WHITE, chunks, words

#: Largest count that Good and Turing's formula discounts, and what larger ones lose.
TURING, LOSS = 5, 0.5
#: Share of all tokens from which a word is frequent.
FREQUENT = 1e-3
#: Tokens of a block and of a bucket, and the numbers of buckets.
BLOCK, BUCKET, FEWEST, MOST = 1 << 20, 1_500_000, 36, 1 << 16
#: The start context and the end of a text, as hashes.
START, END = np.uint64(0xA5A5_17C3_90E1), np.uint64(0x5A5A_E83C_6F1E)
#: Units of the sums.
UNIT = 2.0**32

#: Rows between the steps.
DOCS, SUMS, COUNTS, CONTEXTS, MISSED, MISSED_FREQUENT, GRAMS, WEIGHTS, FREQUENT_WEIGHTS = range(9)
STEP = "kind int, at int, block long, counts array<long>, data binary"
_NAMES = ("kind", "at", "block", "counts", "data")

#: Tokens by what the discounts decide: seen 1 to TURING times; not seen, the word never, 1 to TURING times, oftener.
KINDS = 2 * TURING + 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, the bytes of one place of all numbers together."""
    head = ";".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays if len(a)]
    return len(head).to_bytes(2, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    end = 2 + int.from_bytes(data[:2], "little")
    raw, low, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[end:]), np.uint8), 0, []
    for name in data[2:end].decode().split(";"):
        kind, n = np.dtype(name[:3]), int(name[3:])
        high = low + n * kind.itemsize
        out.append(np.ascontiguousarray(raw[low:high].reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.empty(0, kind))
        low = high
    return out


def rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


_STEP = pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("block", pa.int64()), ("counts", pa.list_(pa.int64())), ("data", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


class Block:
    """Texts as tokens, one after the other, each with the number of its text."""

    def __init__(self):
        self.parts, self.ids, self.learned, self.sizes, self.n = [], [], [], [], 0

    def add(self, ids: pa.Array, learned: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        hashes, _, _, first = words(data, offsets, WHITE, LOWER)
        count = np.diff(first)
        last = first[1:] + np.arange(len(count))
        own = np.empty(len(hashes) + len(count), np.uint64)
        own[last] = END
        inner = np.ones(len(own), bool)
        inner[last] = False
        own[inner] = hashes >> np.uint64(16)
        self.parts.append(own)
        self.ids += ids.to_pylist()
        self.learned += learned.to_pylist()
        self.sizes += (count + 1).tolist()
        self.n += len(own)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, numbers of texts); the block holds its tokens no more."""
        own, self.parts = np.concatenate(self.parts), []
        return own, np.repeat(np.arange(len(self.sizes), dtype=np.uint32), self.sizes)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    now = Block()
    for batch in batches:
        for low, high, data, offsets in chunks(batch):
            now.add(batch.column("doc_id")[low:high], batch.column("learned")[low:high], data, offsets)
            if now.n >= BLOCK:
                yield now
                now = Block()
    if now.n:
        yield now


def bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(buckets)).astype(np.uint16 if buckets <= MOST else np.int32)


def word_counts(docs: DataFrame, scratch: Scratch, buckets: int) -> tuple[np.ndarray, dict]:
    """(frequent words with their training counts, numbers of the whole corpus): the counts themselves stay in their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            own, of = block.tokens()
            kinds, which = np.unique(own, return_inverse=True)
            del own
            every = np.bincount(which)
            learned = np.bincount(which, weights=np.array(block.learned)[of], minlength=len(kinds))
            to = bucket(kinds, buckets)
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(buckets + 1))
            found = [(k, 0, pack(kinds[order[a:b]], learned[order[a:b]].astype(np.uint32), every[order[a:b]].astype(np.uint32))) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            yield rows(found, _SENT)

    def merged(table: pa.Table) -> pa.Table:
        kinds, learned, every = map(np.concatenate, zip(*(unpack(x.as_py()) for x in table.column("data")), strict=True))
        kinds, which = np.unique(kinds, return_inverse=True)
        learned, every = (np.bincount(which, weights=x).astype(np.int64) for x in (learned, every))
        top = np.argsort(-every, kind="stable")[: int(1 / FREQUENT)]
        counts = [int(learned.sum()), int(every.sum()), int((learned > 0).sum()), *np.bincount(np.minimum(learned, TURING + 2), minlength=TURING + 3)[1 : TURING + 2].tolist()]
        return pa.table({"counts": pa.array([counts], pa.list_(pa.int64())), "word": pa.array([kinds[top].astype(np.int64)], pa.list_(pa.int64())), "learned": pa.array([learned[top]], pa.list_(pa.int64())), "every": pa.array([every[top]], pa.list_(pa.int64()))})

    sent = docs.mapInArrow(run, "bucket int, block long, data binary")
    found = scratch.table(sent.groupBy("bucket").applyInArrow(merged, "counts array<long>, word array<long>, learned array<long>, every array<long>"), "words")
    counts = found.agg(*[F.coalesce(F.sum(F.col("counts")[k]), F.lit(0)) for k in range(TURING + 4)]).first()
    top = found.select(F.explode(F.arrays_zip("word", "learned", "every")).alias("x")).select("x.*").filter(F.col("every") >= FREQUENT * counts[1])
    top = sorted((r.word, r.learned) for r in top.collect())
    return np.array(top, np.int64).reshape(-1, 2), {"learned": counts[0], "tokens": counts[1], "types": counts[2], "of_counts": list(counts[3:])}


class Frequent:
    """The frequent words, and the start context, by number."""

    def __init__(self, found: np.ndarray):
        self.hashes = np.unique(np.append(found[:, 0].astype(np.uint64), START))
        self.counts = np.zeros(len(self.hashes), np.int64)
        self.counts[np.searchsorted(self.hashes, found[:, 0].astype(np.uint64))] = found[:, 1]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def sender(frequent, buckets: int):
    """Each block's distinct bigrams, their training counts and their texts, by bucket; and what the block is made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for seq, block in enumerate(blocks(batches)):
            number = (task << 32) + seq
            own, of = block.tokens()
            texts = len(block.ids)
            kinds, w = np.unique(own, return_inverse=True)
            kinds, w = np.append(kinds, START), w.astype(np.uint64)
            own = u = np.concatenate([w[:1], w[:-1]])
            u[np.cumsum(block.sizes) - block.sizes] = len(kinds) - 1
            if (int(len(kinds)) ** 2 * texts).bit_length() <= 64:
                w *= np.uint64(len(kinds))
                w += u
                w *= np.uint64(texts)
                w += of
                key, n = np.unique(w, return_counts=True)
                del w, u, own, of
                pair, of = np.divmod(key, np.uint64(texts))
                del key
                w, u = np.divmod(pair, np.uint64(len(kinds)))
                del pair
            else:
                order = np.lexsort((of, u, w))
                w, u, of = w[order], u[order], of[order]
                new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (u[1:] != u[:-1]) | (of[1:] != of[:-1])))
                n = np.diff(np.append(new, len(w)))
                w, u, of = w[new], u[new], of[new]
            of, n, w, u = of.astype(np.uint32), n.astype(np.uint32), w.astype(np.uint32), u.astype(np.uint32)
            hot, own_bucket = frequent.value.number(kinds) >= 0, bucket(kinds, buckets)
            to = np.where(~hot[w], own_bucket[w], np.where(~hot[u], own_bucket[u], 0))
            both = np.flatnonzero(hot[w] & hot[u])
            to[both] = bucket(mix(kinds[w[both]]) + kinds[u[both]], buckets)
            order = np.argsort(to, kind="stable")
            to, w, u, of, n = to[order], w[order], u[order], of[order], n[order]
            del order
            new = np.append(True, (w[1:] != w[:-1]) | (u[1:] != u[:-1]) | (to[1:] != to[:-1]))
            start = np.flatnonzero(new)
            learned = np.add.reduceat(np.where(np.array(block.learned)[of], n, 0), start).astype(np.uint32)
            texts_of = np.diff(np.append(start, len(w))).astype(np.uint32)
            w, u, at = kinds[w[start]], kinds[u[start]], to[start]
            some, pairs = np.unique(at, return_index=True)
            pairs, entries = np.append(pairs, len(at)), np.append(start[pairs], len(of))
            yield rows([(-1 - number % buckets, number, pickled(block))], _SENT)
            for i, k in enumerate(some):
                a, b, c, d = pairs[i], pairs[i + 1], entries[i], entries[i + 1]
                yield rows([(int(k), number, pack(w[a:b], u[a:b], learned[a:b], texts_of[a:b], of[c:d], n[c:d]))], _SENT)

    return run


def pickled(block: Block) -> bytes:
    known = np.array([i is not None for i in block.ids], np.uint8)
    return pack(known, np.array([i or 0 for i in block.ids], np.int64), np.array(block.sizes, np.int64))


def sums(of: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    return np.rint(np.bincount(of, weights=values, minlength=texts) * UNIT).astype(np.int64)


def merger(frequent, buckets: int):
    """Adds up the counts of a bucket's bigrams, looks all texts' bigrams up in them, and passes on what the contexts decide."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.table([pa.array([DOCS] * len(table), pa.int32()), pa.nulls(len(table), pa.int32()), table.column("block"), pa.nulls(len(table), pa.list_(pa.int64())), table.column("data")], schema=_STEP)
        numbers, sent = table.column("block").to_pylist(), [unpack(x.as_py()) for x in table.column("data")]
        w, u, learned = (np.concatenate([s[k] for s in sent]) for k in range(3))
        order = np.lexsort((u, w))
        new = np.append(True, (np.diff(w[order]) != 0) | (np.diff(u[order]) != 0))
        pair = np.empty(len(w), np.int64)
        pair[order] = np.cumsum(new) - 1
        seen = np.bincount(pair, weights=learned).astype(np.int64)
        w, u = w[order[new]], u[order[new]]
        new = np.append(True, w[1:] != w[:-1])
        word = np.cumsum(new) - 1
        count = np.bincount(word, weights=seen).astype(np.int64)
        hot = frequent.value.number(w[new])
        count = np.where(hot >= 0, frequent.value.counts[hot], count)[word]
        large = np.where(seen > TURING, np.log10(np.maximum(seen - LOSS, 1)), np.where((seen == 0) & (count > TURING), np.log10(np.maximum(count - LOSS, 1)), 0.0))
        # The next token has this word as its context, whose count divides.
        large -= np.where((w != END) & (count > 0), np.log10(np.maximum(count, 1)), 0.0)
        kind = np.where(seen > TURING, KINDS, np.where(seen > 0, seen - 1, TURING + np.minimum(count, TURING + 1)))
        plain, known = np.log10(count + 0.5), (count > 0).astype(np.float64)
        found, upto, missed, missed_hot = [], 0, [], []
        before = frequent.value.number(u)
        for block, (x, _, _, size, of, n) in zip(numbers, sent, strict=True):
            own = pair[upto : upto + len(x)]
            upto += len(x)
            at = np.repeat(own, size)
            texts, who = np.unique(of, return_inverse=True)
            by_kind = np.bincount(kind[at] * len(texts) + who, weights=n, minlength=(KINDS + 1) * len(texts))[: KINDS * len(texts)].astype(np.uint32)
            found.append((SUMS, None, block, None, pack(texts, sums(who, n * large[at], len(texts)), sums(who, n * plain[at], len(texts)), np.bincount(who, weights=n * known[at]).astype(np.uint32), by_kind)))
            lost = seen[at] == 0
            some = np.flatnonzero(lost & (before[at] >= 0))
            if len(some):
                found.append((MISSED_FREQUENT, None, block, None, pack(before[at[some]].astype(np.uint16), of[some], n[some])))
            some = np.flatnonzero(lost & (before[at] < 0))
            missed.append((u[at[some]], np.full(len(some), block, np.int64), of[some], n[some]))
        of_counts = np.bincount(np.minimum(seen, TURING + 2), minlength=TURING + 3)[1 : TURING + 2].tolist()
        found.append((COUNTS, None, None, of_counts, None))
        found.append((GRAMS, table.column("bucket")[0].as_py(), None, None, pack(u[seen > 0], w[seen > 0], seen[seen > 0].astype(np.uint32), count[seen > 0].astype(np.uint32))))
        found += [(CONTEXTS, k, None, None, pack(*x)) for k, x in dealt(context_sums(u, seen, count), buckets)]
        found += [(MISSED, k, None, None, pack(*x)) for k, x in dealt([np.concatenate([m[k] for m in missed]) for k in range(4)], buckets)]
        return pa.Table.from_batches([rows(found, _STEP)])

    return run


def dealt(columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by the bucket of the first one's hashes, in its order."""
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    to = bucket(columns[0], buckets)
    order = np.argsort(to, kind="stable")
    some, at = np.unique(to[order], return_index=True)
    for k, a, b in zip(some.tolist(), at, np.append(at, len(order))[1:], strict=True):
        yield k, [c[order[a:b]] for c in columns]


def context_sums(u: np.ndarray, seen: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """For each context: its tokens; its seen words by their count in it, 1 to TURING and oftener; and by their count at all, with the sum of the latter, of those that are large."""
    some = seen > 0
    u, seen, count = u[some], seen[some], count[some]
    order = np.argsort(u, kind="stable")
    u, seen, count = u[order], seen[order], count[order]
    start = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.empty(0, np.int64)
    total = (lambda x: np.add.reduceat(x.astype(np.int64), start)) if len(u) else (lambda x: np.empty(0, np.int64))
    classes = [total(seen == r) for r in range(1, TURING + 1)] + [total(seen > TURING)]
    classes += [total(count == r) for r in range(1, TURING + 1)] + [total(count > TURING)]
    return [u[start], total(seen), *[c.astype(np.uint32) for c in classes], total(np.where(count > TURING, count, 0))]


def discounted(of_counts: list[int]) -> np.ndarray:
    """The discounted counts 1 to TURING, from the numbers of n-grams that occur 1 to TURING + 1 times."""
    n, out = [0, *of_counts], []
    for r in range(1, TURING + 1):
        d = 0.0
        if n[1] and n[r] and (TURING + 1) * n[TURING + 1] != n[1]:
            common = (TURING + 1) * n[TURING + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
        out.append(r * d if 0 < d < 1 else r - LOSS)
    return np.array(out)


class Discounts:
    """Discounted counts of bigrams and of words, and what the words leave to the unknown one."""

    def __init__(self, bigrams: list[int], whole: dict):
        self.bigrams, self.words, self.tokens = discounted(bigrams), discounted(whole["of_counts"]), whole["learned"]
        rare, n = np.arange(1, TURING + 1), np.array(whole["of_counts"][:TURING])
        lost = float(((rare - self.words) * n).sum()) + LOSS * (whole["types"] - int(n.sum()))
        self.unknown = lost / self.tokens if self.tokens else 1.0

    def weights(self, columns: list[np.ndarray]) -> np.ndarray:
        """log10 of each context's weight times its tokens, from its sums."""
        tokens, by_seen, by_count, large = columns[0], np.array(columns[1 : TURING + 2], np.float64), np.array(columns[TURING + 2 : -1], np.float64), columns[-1]
        left = (by_seen[:-1] * (np.arange(1, TURING + 1) - self.bigrams)[:, None]).sum(0) + LOSS * by_seen[-1]
        taken = ((by_count[:-1] * self.words[:, None]).sum(0) + large - LOSS * by_count[-1]) / self.tokens
        return np.log10(left) - np.log10(np.maximum(1 - taken, self.unknown))


def weigher(frequent, discounts):
    """Makes the weights of a bucket's contexts and looks up those of the bigrams that weren't found."""

    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data")
        sent = {k: [unpack(data[i].as_py()) for i, x in enumerate(kinds) if x == k] for k in (CONTEXTS, MISSED)}
        found = []
        if not sent[CONTEXTS]:
            return pa.Table.from_batches([], schema=_STEP)
        u, *columns = (np.concatenate(c) for c in zip(*sent[CONTEXTS], strict=True))
        u, which = np.unique(u, return_inverse=True)
        columns = [np.bincount(which, weights=c).astype(np.int64) for c in columns]
        weight = discounts.value.weights(columns)
        hot = frequent.value.number(u)
        if (hot >= 0).any():
            found.append((FREQUENT_WEIGHTS, None, None, None, pack(hot[hot >= 0], weight[hot >= 0])))
        found.append((WEIGHTS, table.column("at")[0].as_py(), None, None, pack(u, columns[0], weight - np.log10(columns[0]))))
        if sent[MISSED]:
            x, block, of, n = (np.concatenate(c) for c in zip(*sent[MISSED], strict=True))
            at = np.minimum(np.searchsorted(u, x), len(u) - 1)
            some = u[at] == x
            at, block, of, n = at[some], block[some], of[some], n[some]
            order = np.lexsort((x[some], of, block))
            at, block, of, n = at[order], block[order], of[order], n[order]
            number, start = np.unique(block, return_index=True)
            for b, low, high in zip(number.tolist(), start, np.append(start, len(block))[1:], strict=True):
                texts, who = np.unique(of[low:high], return_inverse=True)
                found.append((MISSED, None, b, None, pack(texts, sums(who, n[low:high] * weight[at[low:high]], len(texts)))))
        return pa.Table.from_batches([rows(found, _STEP)]) if found else pa.Table.from_batches([], schema=_STEP)

    return run


def assembler(shared):
    """Adds up what the texts of a block got."""

    def run(table: pa.Table) -> pa.Table:
        whole, discounts, weights = shared.value
        kinds = table.column("kind").to_pylist()
        order = sorted(range(len(kinds)), key=lambda i: kinds[i])
        data = [(kinds[i], unpack(table.column("data")[i].as_py())) for i in order]
        known, ids, size = data[0][1]
        large, plain, count, by_kind = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros((KINDS, len(ids)), np.int64)
        for kind, x in data[1:]:
            if kind == SUMS:
                texts = x[0]
                large[texts] += x[1]
                plain[texts] += x[2]
                count[texts] += x[3]
                by_kind[:, texts] += x[4].reshape(KINDS, len(texts))
            elif kind == MISSED:
                large[x[0]] += x[1]
            else:
                large += sums(x[1], x[2] * weights[x[0]], len(ids))
        score = large / UNIT
        if whole["learned"]:
            score = score - np.log10(max(1, whole["texts"]))
            value = np.concatenate([np.log10(discounts.bigrams), [np.log10(discounts.unknown)], np.log10(discounts.words / whole["learned"]), [-np.log10(whole["learned"])]])
            score = score + value @ by_kind
        base = plain / UNIT - size * np.log10(whole["learned"] + 0.5 * (whole["types"] + 1))
        return pa.table({"doc_id": pa.array(ids, mask=known == 0), "n_tokens": size, "n_known": count, "train_tokens": np.full(len(ids), whole["learned"], np.int64), "base_score": base, "score": np.minimum(score, 0.0)})

    return run


def language_scores(docs: DataFrame, held: Column, tables: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document, by a model of those that aren't held out.

    base_score: the text's log10 probability by single words with half a count added to each; score: that by the model. Where
    held is null the document isn't learned. The model stays in the shared folder as two tables, a row for each bucket: bigrams (context, word,
    their count and the word's) and weights (context, its count, log10 of its weight); tables is a folder for a copy, which ``read_tables`` opens.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    share = spark.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(~held, F.lit(False)).alias("learned"))
    top, whole = word_counts(docs.select("doc_id", "text", "learned"), scratch, FEWEST)
    whole["texts"] = docs.filter("learned").select(F.lit(1)).agg(F.count("*")).first()[0]
    buckets, frequent = min(MOST - 1, max(FEWEST, -(-whole["tokens"] // BUCKET))), share(Frequent(top))
    sent = docs.mapInArrow(sender(frequent, buckets), "bucket int, block long, data binary")
    step = scratch.keep(sent.groupBy("bucket").applyInArrow(merger(frequent, buckets), STEP), "grams")
    counts = step.filter(F.col("kind") == COUNTS).agg(*[F.coalesce(F.sum(F.col("counts")[k]), F.lit(0)) for k in range(TURING + 1)]).first()
    discounts = Discounts(list(counts), whole)
    after = step.filter(F.col("kind").isin(CONTEXTS, MISSED)).groupBy("at").applyInArrow(weigher(frequent, share(discounts)), STEP)
    after = scratch.keep(after, "weights")
    weights = np.zeros(len(frequent.value.hashes))
    for r in after.filter(F.col("kind") == FREQUENT_WEIGHTS).select("data").collect():
        at, value = unpack(r.data)
        weights[at] = value
    if tables is not None:
        step.filter(F.col("kind") == GRAMS).unionByName(after.filter(F.col("kind") == WEIGHTS)).select("kind", "at", "data").write.partitionBy("kind").parquet(tables)
    parts = step.filter(F.col("kind").isin(DOCS, SUMS, MISSED_FREQUENT)).unionByName(after.filter(F.col("kind") == MISSED)).select("kind", "block", "data")
    scratch.clear()
    return parts.groupBy("block").applyInArrow(assembler(share((whole, discounts, weights))), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def read_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grams: context, word, n, word_n; weights: context, n, log10_weight) of a model that was kept, by hashes."""

    def opened(names: tuple[str, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("data"):
                    yield pa.RecordBatch.from_arrays([pa.array(c if c.dtype == np.float64 else c.astype(np.int64)) for c in unpack(x.as_py())], names=list(names))

        return run

    grams = df.filter(F.col("kind") == GRAMS).select("data").mapInArrow(opened(("context", "word", "n", "word_n")), "context long, word long, n long, word_n long")
    weights = df.filter(F.col("kind") == WEIGHTS).select("data").mapInArrow(opened(("context", "n", "log10_weight")), "context long, n long, log10_weight double")
    return grams, weights


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows with crc32 of the id as text = 1 modulo 5 are never learned."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    found = language_scores(docs, held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
