"""Filter interaction audit: what each filter removes alone, after others, and over all orders of them.

One scan of the Arrow buffers measures every text: classes of bytes and their prefix sums count code points, capitals and symbols;
the 64-bit hashes of a document's words are sorted, and equal neighbours that are also equal byte by byte count once, so that
the number of distinct words is exact (a document in which two words share a hash is counted again by its words). A filter is a
condition on these measures, or ``DUPLICATE``: the text is that of a smaller doc_id. Documents are then counted by part, by the mask
of the filters that they fail and by label; all orders of the filters are read off those counts.

Texts are the same if their SHA-256 is. Copies are counted by task before they are shuffled, and so is everything after, so a
group of copies is at most one row for each part, mask and label. A null text is empty; a null part is the empty string; very long
texts are measured whole. A null doc_id is no one's copy and has no labels. Rows that share doc_id and text are all first or all
copies; each counts. Of several labels of a doc_id any that is 1 counts; labels may be null or missing. An empty table gives no
rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.words import SAME, WHITE, chunks, places, slices, words

#: As a condition: the text is that of a smaller doc_id.
DUPLICATE = "duplicate"
#: The number of orders grows as the factorial of the filters.
MOST_FILTERS = 7

_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
#: Bytes that begin a code point.
_BEGINS = np.array([b & 0xC0 != 0x80 for b in range(256)])


def by_text(of_byte: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of a class each text has, by prefix sums."""
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(of_byte[data], out=upto[1:])
    return np.diff(upto[offsets])


def distinct_words(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct words of each text, from sorted hashes whose equal neighbours are compared by their bytes."""
    order = np.concatenate([np.argsort(hashes[a:b]) + a for a, b in zip(first[:-1], first[1:], strict=True)]) if len(first) > 1 else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.flatnonzero((hashes[order[1:]] == hashes[order[:-1]]) & (row[1:] == row[:-1]))
    left, right = order[again], order[again + 1]
    size = ends - starts
    same = size[left] == size[right]
    both = np.flatnonzero(same)
    for low, high in slices(size[left[both]]):
        part = both[low:high]
        n = size[left[part]]
        at = places(n)
        differ = data[np.repeat(starts[left[part]], n) + at] != data[np.repeat(starts[right[part]], n) + at]
        if differ.any():
            same[np.unique(np.repeat(part, n)[differ])] = False
    out = np.diff(first) - np.bincount(row[again], minlength=len(first) - 1)
    for i in np.unique(row[again[~same]]):
        out[i] = len({data[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)})
    return out


def measures(docs: DataFrame, part: str = "lang", symbols: str = "#$%&*|") -> DataFrame:
    """(doc_id, part, n_words, n_distinct, n_capitals, n_chars, n_symbols, digest) of every document; symbols are ASCII characters."""
    symbol = np.array([chr(b) in symbols for b in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch):
                hashes, starts, ends, first = words(data, offsets, WHITE, SAME)
                counts = (np.diff(first), distinct_words(data, hashes, starts, ends, first), *(by_text(x, data, offsets) for x in (_CAPITAL, _BEGINS, symbol)))
                whole = memoryview(np.ascontiguousarray(data))
                digest = pa.array([hashlib.sha256(whole[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[low:high] for c in ("doc_id", "part")), *(pa.array(c.astype(np.int64)) for c in counts), digest], names=["doc_id", "part", *COUNTS, "digest"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, part string, {', '.join(f'{c} long' for c in COUNTS)}, digest binary")


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def masks(measured: DataFrame, filters: Mapping[str, Column | str], labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters that they fail, bit i being the i-th filter, and by label."""
    bit = {name: 1 << i for i, name in enumerate(filters)}
    own = sum((F.when(c, bit[name]).otherwise(0) for name, c in filters.items() if not isinstance(c, str)), F.lit(0))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    known = known.filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    of = ["part", "mask", "good", "toxic"]
    rows = measured.select("doc_id", "part", own.alias("mask"), "digest").join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    if not any(c == DUPLICATE for c in filters.values() if isinstance(c, str)):
        return rows.groupBy(*of).agg(F.count("*").alias("n"))
    copied = F.lit(sum(bit[name] for name, c in filters.items() if isinstance(c, str) and c == DUPLICATE))
    rows = rows.groupBy("doc_id", "digest", *of).agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    rows = rows.groupBy("digest", *of).agg(F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"))
    rows = rows.withColumn("first", F.when(F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest")), F.col("least.n")).otherwise(0))
    copies = F.col("named") - F.col("first")
    rows = rows.select(*of[:1], *of[2:], F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - copies).alias("n")), F.struct(F.col("mask").bitwiseOR(copied).alias("mask"), copies.alias("n")))).alias("x"))
    return rows.select(*of[:1], "x.mask", *of[2:], "x.n").filter("n > 0").groupBy(*of).agg(F.sum("n").alias("n"))


def orders(counted: DataFrame, filters: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts by mask: the filters apply from left to right.

    kept: documents that pass this filter and those before it; removed: that this one removes here; redundant: that fail it but are gone;
    unique_fails: that fail it only; good_lost and toxic_lost: of those removed, the ones labelled so; shapley: those that the
    filter removes, summed over all orders.
    """
    if len(filters) > MOST_FILTERS or any(len(x) != 1 for x in filters):
        raise ValueError(f"filters are at most {MOST_FILTERS} letters")
    every = range(1 << len(filters))
    total = lambda label: F.array(*[F.sum(F.when((F.col("mask") == m) & label, F.col("n")).otherwise(0)) for m in every])
    held = counted.groupBy("part").agg(total(F.lit(True)).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))
    rows = held.select("*", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    place = {name: F.instr("filter_order", name) for name in filters}
    before = sum((F.when(place[name] < F.col("step"), 1 << i).otherwise(0) for i, name in enumerate(filters)), F.lit(0))
    own = sum((F.when(place[name] == F.col("step"), 1 << i).otherwise(0) for i, name in enumerate(filters)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("own", own)
    number = F.array(*map(F.lit, every))

    def summed(of: str, want) -> Column:
        held = F.filter(number, lambda m: want(m.bitwiseAND(F.col("before")) > 0, m.bitwiseAND(F.col("own")) > 0, m))
        return F.aggregate(held, F.lit(0).cast("long"), lambda a, m: a + F.element_at(of, m + 1))

    here = lambda gone, fails, m: ~gone & fails
    rows = rows.select(
        "part",
        "filter_order",
        "step",
        summed("n", lambda gone, fails, m: ~gone & ~fails).alias("kept"),
        summed("n", here).alias("removed"),
        summed("n", lambda gone, fails, m: gone & fails).alias("redundant"),
        F.element_at("n", F.col("own") + 1).alias("unique_fails"),
        summed("good", here).alias("good_lost"),
        summed("toxic", here).alias("toxic_lost"),
        F.col("own"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | str], part: str = "lang", symbols: str = "#$%&*|") -> DataFrame:
    """The audit of filters, named by single letters, over all orders of them: see ``orders``."""
    return orders(masks(measures(docs, part, symbols), filters, labels), list(filters))
