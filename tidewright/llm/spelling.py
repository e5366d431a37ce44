"""Spelling variants: words that one inserted, deleted or replaced letter makes equal, found by a positional q-gram index.

A word is a run of Latin letters in which A-Z are folded; the pairs sought differ by one letter. The index holds positional 2-grams:
those at every second place of the longer word of a pair. One edit spoils exactly one of them, so a pair must share all but one at
their places (for the shorter word, one place earlier behind the edit); that is the overlap bound of the count filter. A list is
therefore kept for each word length and each choice of all grams but one, and holds the words of that length and of one less:
whatever meets in a list meets the bound, under the limits on length and place. Lists are merged from the sorted
postings of all tasks that share a bucket, and their pairs are verified letter by letter. As the words of a list differ in one 2-gram
only, a list has at most 90 * 90 + 90 words (26 letters and 64 others), however the words are distributed: no list is hot. Words of over LONG letters
have four grams, a quarter each. A pair is given by one list only, that of the gram in which its first difference lies.

Counts are over all documents. Some runs lose a letter first (``spoil``): those whose CRC-32 with their doc_id is divisible by it. Of a
word's neighbours the one of largest count, ties going to the smaller word, is its form if it is at least twice as frequent; forms
are followed to their root by doubling the steps. Every step at least doubles the count, so there are no cycles and few rounds.

Nulls and texts without letters have no words; very long texts are read whole; runs without a doc_id are never spoilt; repeated rows count each
by itself. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch
from tidewright.llm.words import LOWER, SAME, chunks, hashes, places, spans

#: Letters of a gram, and of the longest word that is cut into such grams.
GRAM, LONG = 2, 64
#: Rows of (word, count) that a task adds up before it passes them on; postings of a bucket; pairs that are verified at once.
WORDS, POSTINGS, PAIRS = 1 << 20, 200_000, 1 << 16
#: Smallest number of buckets.
BUCKETS = 48

_ASCII = np.array([chr(b).isalpha() if b < 128 else False for b in range(256)])
_rng = np.random.default_rng(20240613)
_VALUE = _rng.integers(0, 1 << 64, (LONG + 1, 256), dtype=np.uint64)
#: CRC-32 of the reflected polynomial, byte by byte.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of A-Z, a-z and U+00C0 to U+00FF in UTF-8; the latter are all code points that begin with the byte C3."""
    led = np.zeros(len(data), bool)
    lead = data == 0xC3
    led[1:] = lead[:-1]
    return _ASCII[data] | lead | led


def crc32(state: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Carries the CRC-32 of what comes before each word on over the word, one place of all words at a time."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + size[i]].tobytes(), int(state[i]))
    order = order[long:]
    now, at, left = ~state[order], starts[order], size[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # words longer than k
        now[:n] = _CRC[(now[:n] ^ data[at[:n] + k]) & 0xFF] ^ (now[:n] >> 8)
    out[order] = ~now
    return out


def _strings(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.repeat(starts, size) + places(size)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))


def counted(docs: DataFrame, least: int = 5, spoil: int | None = None) -> DataFrame:
    """(w, n): the words of at least so many letters, and how often they come in all documents."""

    def of_chunk(ids: list, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.Table]:
        starts, ends = spans(letters(data), offsets)
        size = ends - starts
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0xC3, out=lead[1:])
        points = size - (lead[ends] - lead[starts])
        some = points >= least
        starts, size, points = starts[some], size[some], points[some]
        data = LOWER[data]
        kinds, at, which = np.unique(hashes(data, starts, size, SAME), return_index=True, return_inverse=True)
        n = np.bincount(which, minlength=len(kinds))
        if spoil:
            row = np.searchsorted(offsets, starts, "right") - 1
            known = np.array([i is not None for i in ids], bool)
            before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            crc = crc32(before[row], data, starts, size)
            hit = np.flatnonzero((crc % spoil == 0) & known[row])
            n -= np.bincount(which[hit], minlength=len(kinds))
            spoilt: Counter[str] = Counter()
            for i in hit[points[hit] > least]:
                word, gone = data[starts[i] : starts[i] + size[i]].tobytes().decode(), int(crc[i]) % int(points[i])
                spoilt[word[:gone] + word[gone + 1 :]] += 1
            if spoilt:
                yield pa.table({"w": pa.array(spoilt.keys(), pa.string()), "n": pa.array(spoilt.values(), pa.int64())})
        at, n = at[n > 0], n[n > 0]
        yield pa.table({"w": _strings(data, starts[at], size[at]), "n": pa.array(n.astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            found = pa.concat_tables(held).group_by("w").aggregate([("n", "sum")])
            return pa.table({"w": found["w"], "n": found["n_sum"]})

        for batch in batches:
            for low, high, data, offsets in chunks(batch):
                held += of_chunk(batch.column("doc_id")[low:high].to_pylist(), data, offsets)
                if sum(t.num_rows for t in held) > WORDS:
                    held = [summed()]
                    if held[0].num_rows > WORDS // 2:
                        yield from held.pop().to_batches(1 << 16)
        if held:
            yield from summed().to_batches(1 << 16)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): words as one byte a letter."""
    column = words.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    lead = raw == 0xC3
    upto = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~lead, out=upto[1:])
    one = raw.copy()
    one[1:][lead[:-1]] += 0x40
    return one[~lead], upto[offsets - offsets[0]]


def grams(length: int) -> list[tuple[int, int]]:
    """The places of the grams of a word of so many letters."""
    size = GRAM if length <= LONG else -(-length // 4)
    return [(a, min(a + size, length)) for a in range(0, length, size)]


def postings(length: int, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(gram left out, whether the word is the shorter one, keys) of words of one length, given as rows of bytes."""
    for short in (0, 1):
        longer = length + short
        here = [(_at(words, i), _at(words, i, short)) for i in range(length)]
        ahead = np.zeros((length + 1, len(words)), np.uint64)
        behind = np.zeros((length + 1, len(words)), np.uint64)
        for i, (x, y) in enumerate(here):
            ahead[i + 1] = ahead[i] + x
            behind[i + 1] = behind[i] + y
        for gram, (a, b) in enumerate(grams(longer)):
            mark = np.uint64((longer * 0x9E3779B97F4A7C15 + gram * 0xC2B2AE3D27D4EB4F) % (1 << 64))
            yield gram, short, (ahead[a] + behind[length] - behind[b - short]) ^ mark


def _at(words: np.ndarray, i: int, later: int = 0) -> np.ndarray:
    """A random number for the letter of each word at a place, taken for so many places later."""
    place = i + later
    value = _VALUE[place % LONG][words[:, i]]
    return value if place < LONG else value * np.uint64(2 * place + 1)


def near(a: bytes, b: bytes) -> int:
    """The place in the longer one at which two words differ by one edit, else -1."""
    if len(a) < len(b):
        a, b = b, a
    e = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return e if e < len(a) and (a[e + 1 :] == b[e + 1 :] if len(a) == len(b) else a[e + 1 :] == b[e:]) else -1


def verified(table: pa.Table) -> pa.Table:
    """(w, n_near, near_n, near) of the words of a bucket of postings, by the pairs that only this bucket gives."""
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    words = table.column("w").take(pa.array(order)).to_pylist()
    n, tag = table.column("n").to_numpy()[order], table.column("tag").to_numpy()[order]
    size = np.array([len(w) for w in words], np.int64)
    width = int(min(LONG, size.max())) + 1
    matrix = np.array([w[:width] for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)
    end = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    later = np.repeat(end, np.diff(np.concatenate([[0], end]))) - np.arange(len(keys)) - 1  # words behind each in its list
    upto, found, low = np.cumsum(later), [], 0
    while low < len(keys):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(low, high), later[low:high])
        b = a + 1 + places(later[low:high])
        low = high
        some = (tag[a] & tag[b] & 1) == 0  # of two shorter words, another list decides
        a, b = a[some], b[some]
        a, b = np.where(size[a] >= size[b], a, b), np.where(size[a] >= size[b], b, a)
        far = size[a] > LONG
        x, y = matrix[a[~far]], matrix[b[~far]]
        differ = x != y
        first = differ.argmax(1)
        same = size[a[~far]] == size[b[~far]]
        shifted = np.zeros(differ.shape, bool)
        shifted[:, :-1] = x[:, 1:] != y[:, :-1]
        shifted &= np.arange(width) >= first[:, None]
        one = np.where(same, differ.sum(1) == 1, ~shifted.any(1)) & (first // GRAM == tag[a[~far]] >> 1)
        found.append((a[~far][one], b[~far][one]))
        for i, j in zip(a[far], b[far], strict=True):
            if (e := near(words[i], words[j])) >= 0 and e // -(-int(size[i]) // 4) == tag[i] >> 1:
                found.append((np.array([i]), np.array([j])))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    left, right = np.concatenate([a, b]), np.concatenate([b, a])
    involved = np.unique(left)
    rank = np.empty(len(words), np.int64)
    rank[sorted(involved.tolist(), key=words.__getitem__)] = np.arange(len(involved))
    best = np.lexsort((rank[right], -n[right], left))
    first = best[np.searchsorted(left[best], involved)]
    text = lambda of: pa.array([words[i].decode("latin-1") for i in of.tolist()], pa.string())
    count = np.bincount(left, minlength=len(words))[involved].astype(np.int64)
    return pa.table({"w": text(left[first]), "n_near": pa.array(count), "near_n": pa.array(n[right[first]]), "near": text(right[first])})


def neighbours(words: DataFrame, buckets: int) -> DataFrame:
    """(w, n_near, near_n, near): how many words are one edit from a word, and the most frequent of them; words (w, n) are distinct."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = latin(batch.column("w"))
            size, n = np.diff(offsets), batch.column("n").to_numpy()
            for length in np.unique(size):
                mine = np.flatnonzero(size == length)
                for part in np.array_split(mine, -(-len(mine) * int(length) // (1 << 20))):
                    rows = data[offsets[part][:, None] + np.arange(length)]
                    held = pa.array([r.tobytes() for r in rows], pa.binary())
                    for gram, short, key in postings(int(length), rows):
                        of = (key % np.uint64(buckets)).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(key.view(np.int64)), pa.array(np.full(len(part), 2 * gram + short, np.int32)), pa.array(n[part]), held], names=["bucket", "key", "tag", "n", "w"])

    posted = words.select("w", "n").mapInArrow(post, "bucket int, key long, tag int, n long, w binary")
    found = posted.groupBy("bucket").applyInArrow(verified, "w string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    return found.groupBy("w").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("w", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.w").alias("near"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of links (word, form) without cycles: each round follows twice as many forms as the one before."""
    now = scratch.table(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.filter("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        now = scratch.table(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def spelling_groups(docs: DataFrame, least: int = 5, often: int = 3, ratio: int = 2, spoil: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least least letters that comes at least often times."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(counted(docs, least, spoil).filter(F.col("n") >= often), "words")
    posted = words.agg(F.sum(F.length("w") + 1)).first()[0] or 0
    buckets = max(BUCKETS, -(-posted // POSTINGS))
    found = words.join(neighbours(words, buckets), "w", "left")
    chosen = F.col("near_n") >= ratio * F.col("n")
    rows = scratch.keep(found.select(F.col("w").alias("word"), F.when(chosen, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("near_n")).alias("form_n")), "forms")
    last = scratch.keep(roots(rows.filter("form is not null").select("word", "form"), scratch), "roots")
    scratch.clear()
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
