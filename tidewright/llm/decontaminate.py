"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage with block-max WAND.

Words are runs of letters and digits, lower-cased in ASCII. An item is indexed in parts of at most PART words; a part's BM25
impacts are divided by its score against itself, so one threshold fits all parts. The training texts are cut into passages
of 2 * PART words that overlap by half, so every run of PART words lies in one passage. A passage is a set of query terms.

The search is lossless. Passages of a chunk are first bounded together: the most frequent terms are put aside as long as, in
every part, what they can add stays under half of the threshold, so a passage must reach the rest with other terms, whose
block-maximal impacts are summed by (passage, block of parts), and then the impacts by part. Each passage that a bound leaves
is searched by block-max WAND: a cursor for each of its terms, the pivot from the terms' maxima, whole blocks skipped by the block
maxima, and parts that remain scored in full. Every part over the threshold is then verified on the words: question and answer,
the first two thirds of the part and the rest, must each overlap the passage in OVERLAP of their 3-grams.

An item of fewer than MIN_WORDS words is no evidence within a longer text; a text that consists of its words holds it, with
score and overlaps 1. The index is broadcast when it has at most INDEX_POSTINGS postings; a larger benchmark is searched in
several indexes of that size, one scan each, with document frequencies and mean length of the whole benchmark, so the scores
don't depend on the cut. Nulls and empty texts match nothing, very long ones are searched whole; an empty benchmark matches
nothing; equal items match side by side. Repeated rows are searched each by itself. Other columns, whatever their names, are
carried along where documents are returned and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, mix
from tidewright.llm.words import LOWER, NOT_ALNUM, chunks, words

PART, MIN_WORDS, BLOCK = 64, 5, 64
#: BM25; the normalised score from which a part is retrieved; the share of 3-grams that verifies it.
K1, B, THRESHOLD, OVERLAP = 1.2, 0.75, 0.6, 0.6
INDEX_POSTINGS = 2_000_000
#: Up to so many ids of documents are broadcast (about 30 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def grams(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Hashes of the word n-grams; the whole sequence if it is shorter."""
    n = min(n, len(h))
    return mix(sum((h[i : len(h) - n + 1 + i] * _M[i] for i in range(n)), np.zeros(len(h) - n + 1 if n else 0, np.uint64)))


def cut(text: str | None) -> list[np.ndarray]:
    """The word hashes of an item's parts."""
    raw = (text or "").encode()
    h = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_ALNUM, LOWER)[0]
    return np.array_split(h, max(1, -(-len(h) // PART)))


class Statistics:
    """Document frequencies of sorted terms, number of parts and their mean length: of some items, or of more than an index holds."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, parts: int, mean: float):
        self.terms, self.df, self.parts, self.mean = terms, df, parts, mean

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Statistics:
        every = np.concatenate([np.unique(p) for p in parts] or [np.empty(0, np.uint64)])
        return cls(*np.unique(every, return_counts=True), len(parts), float(np.mean([len(p) for p in parts] or [1])))


class Index:
    """Postings, block maxima and word sequences of the parts of some items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, whole: Statistics | None = None):
        self.threshold, self.parts, self.short = threshold, [], {}
        for item, text in items:
            for p in cut(text):
                if len(p) >= MIN_WORDS:
                    self.parts.append((item, p))
                elif len(p):
                    self.short.setdefault(p.tobytes(), []).append(item)
        whole = whole or Statistics.of([p for _, p in self.parts])
        terms = [np.unique(p, return_counts=True) for _, p in self.parts]
        self.terms = np.unique(np.concatenate([t for t, _ in terms] or [np.empty(0, np.uint64)]))
        df = whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log(1 + (whole.parts - df + 0.5) / (df + 0.5))
        rows, cols, impact = [], [], []
        for k, (t, tf) in enumerate(terms):
            at = np.searchsorted(self.terms, t)
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.parts[k][1]) / whole.mean))
            rows.append(at), cols.append(np.full(len(at), k)), impact.append(w / w.sum())
        term, part, w = (np.concatenate(x) if x else np.empty(0) for x in (rows, cols, impact))
        term, part = term.astype(np.int64), part.astype(np.int64)
        order = np.lexsort((part, term))
        self.part, self.impact = part[order], w[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if len(self.terms) else np.empty(0)
        # Terms put aside, the most frequent first, while no part can get half of the threshold from them.
        self.aside, self.rest, spent = np.zeros(len(self.terms), bool), np.zeros(len(self.parts)), np.zeros(len(self.parts))
        for t in np.argsort(-np.diff(self.first), kind="stable"):
            mine = slice(self.first[t], self.first[t + 1])
            spent[self.part[mine]] += self.impact[mine]
            if spent[self.part[mine]].max(initial=0) >= threshold / 2:
                break
            self.aside[t], self.rest = True, spent.copy()
        blocks = -(-len(self.parts) // BLOCK)
        self.rest_of_block = np.array([self.rest[b * BLOCK : (b + 1) * BLOCK].max() for b in range(blocks)] or [0.0])
        # Block maxima: one posting for each term and block.
        key = term[order] * max(blocks, 1) + self.part // BLOCK
        self.block_key, at = np.unique(key, return_index=True)
        self.block_max = np.maximum.reduceat(self.impact, at) if len(at) else np.empty(0)
        self.blocks = max(blocks, 1)
        self.block_first = np.searchsorted(self.block_key // self.blocks, np.arange(len(self.terms) + 1))

    def search(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word of the passage, part, score) for the words of the texts of a chunk."""
        if not len(self.terms) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == h)
        row = np.searchsorted(first, known, "right") - 1
        count = np.diff(first)
        passages = np.maximum(1, -(-count // PART) - 1)
        base = np.cumsum(passages) - passages
        slot = (known - first[row]) // PART
        # A word at slot s lies in the passages s - 1 and s.
        passage = np.concatenate([base[row] + np.minimum(slot, passages[row] - 1), (base[row] + slot - 1)[(slot > 0) & (slot < passages[row])]])
        term = np.concatenate([at[known], at[known][(slot > 0) & (slot < passages[row])]])
        pair = np.unique(passage * len(self.terms) + term)
        passage, term = pair // len(self.terms), pair % len(self.terms)
        strong = ~self.aside[term]
        p, t = passage[strong], term[strong]
        n = self.block_first[t + 1] - self.block_first[t]
        where = np.repeat(self.block_first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        block = self.block_key[where] % self.blocks
        key, inverse = np.unique(np.repeat(p, n) * self.blocks + block, return_inverse=True)
        bound = np.bincount(inverse, weights=self.block_max[where], minlength=len(key)) + self.rest_of_block[key % self.blocks]
        live = key[bound >= self.threshold - 1e-9]
        if not len(live):
            return
        n = self.first[t + 1] - self.first[t]
        keep = np.isin(p, live // self.blocks)
        p, t, n = p[keep], t[keep], n[keep]
        where = np.repeat(self.first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        who, part = np.repeat(p, n), self.part[where]
        good = np.isin(who * self.blocks + part // BLOCK, live)
        key, inverse = np.unique(who[good] * len(self.parts) + part[good], return_inverse=True)
        bound = np.bincount(inverse, weights=self.impact[where[good]], minlength=len(key)) + self.rest[key % len(self.parts)]
        for p in np.unique(key[bound >= self.threshold - 1e-9] // len(self.parts)).tolist():
            low, high = np.searchsorted(passage, [p, p + 1])
            i = int(np.searchsorted(base, p, "right")) - 1
            for part, score in self.wand(term[low:high]):
                yield i, int(first[i] + (p - base[i]) * PART), part, score

    def wand(self, terms: np.ndarray) -> Iterator[tuple[int, float]]:
        """(part, score) of every part that reaches the threshold for a set of terms, by block-max WAND."""
        at, end, most = self.first[terms].copy(), self.first[terms + 1], self.most[terms]
        need, over = self.threshold - 1e-9, len(self.parts)
        here = self.part[at].copy()
        while True:
            order = np.argsort(here, kind="stable")
            reach = np.cumsum(most[order])
            pivot = int(np.searchsorted(reach, need))
            if pivot >= len(order) or (part := int(here[order[pivot]])) >= over:
                return
            while pivot + 1 < len(order) and here[order[pivot + 1]] == part:
                pivot += 1
            upto = order[: pivot + 1]
            key = terms[upto] * self.blocks + part // BLOCK
            where = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            if np.where(self.block_key[where] == key, self.block_max[where], 0.0).sum() < need:
                # No part of this block can reach the threshold with these terms alone: on to the next block, or the next term's part.
                goal = (part // BLOCK + 1) * BLOCK
                if pivot + 1 < len(order):
                    goal = min(goal, int(here[order[pivot + 1]]))
                move = upto
            elif here[order[0]] == part:
                if (score := float(self.impact[at[upto]].sum())) >= self.threshold:
                    yield part, score
                goal, move = part + 1, upto
            else:
                goal, move = part, upto[here[upto] < part]
            for c in move.tolist():
                at[c] += int(np.searchsorted(self.part[at[c] : end[c]], goal))
                here[c] = self.part[at[c]] if at[c] < end[c] else over

    def _impacts(self, part: int) -> np.ndarray:
        t = np.searchsorted(self.terms, np.unique(self.parts[part][1]))
        return np.array([self.impact[self.first[x] + np.searchsorted(self.part[self.first[x] : self.first[x + 1]], part)] for x in t])

    def overlaps(self, passage: np.ndarray, part: int) -> tuple[float, float]:
        """Shares of the question's and the answer's 3-grams that the passage holds."""
        h = self.parts[part][1]
        have, cut = {n: np.unique(grams(passage, n)) for n in (1, 2, 3)}, len(h) - max(2, len(h) // 3)
        share = lambda x: float(np.isin(grams(x), have[min(3, len(x))]).mean())
        return share(h[:cut]), share(h[cut:])


def _shards(items: DataFrame, shards: int, scratch: Scratch) -> Iterator[tuple[list[tuple[int, str]], Statistics | None]]:
    """The items of each index, with the statistics of all of them."""
    home = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")
    if shards > 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    parts = [p for p in cut(text) if len(p) >= MIN_WORDS]
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(parts), pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array([np.unique(p).view(np.int64) for p in parts], pa.list_(pa.int64()))], names=["shard", "size", "terms"])

        parts = scratch.table(items.select(home.alias("shard"), "text").mapInArrow(run, "shard int, size long, terms array<long>"), "parts")
        n, mean = parts.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(1.0))).first()
        terms = parts.select("shard", F.explode("terms").alias("term"))
        df = scratch.table(terms.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards")), "frequencies")
    for s in range(shards):
        part = items.filter(home == s).orderBy("item_id", "text").collect()
        whole = None
        if shards > 1:
            mine = df.filter(F.array_contains("shards", s)).select("term", "df").toArrow()
            term, many = mine["term"].to_numpy().view(np.uint64), mine["df"].to_numpy()
            order = np.argsort(term)
            whole = Statistics(term[order], many[order], n, mean)
        yield [(r["item_id"], r["text"]) for r in part], whole


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the best verified passage of each document and item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # The test set is small by nature; its size decides how many indexes of bounded size there are.
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for part, whole in _shards(items, max(1, -(-total // (2 * INDEX_POSTINGS))), scratch):
        shared = spark.sparkContext.broadcast(Index(part, threshold, whole))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = []
                for low, _, data, offsets in chunks(batch):
                    h, _, _, first = words(data, offsets, NOT_ALNUM, LOWER)
                    for i, at, k, score in index.search(h, first):
                        question, answer = index.overlaps(h[at : min(at + 2 * PART, int(first[i + 1]))], k)
                        if min(question, answer) >= overlap:
                            rows.append((batch.column("doc_id")[low + i].as_py(), index.parts[k][0], score, question, answer))
                    for i in np.flatnonzero(np.diff(first) < MIN_WORDS).tolist() if index.short else ():
                        rows += [(batch.column("doc_id")[low + i].as_py(), item, 1.0, 1.0, 1.0) for item in index.short.get(h[first[i] : first[i + 1]].tobytes(), ())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(zip(*rows, strict=True))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        hits = chosen.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        found = hits if found is None else found.unionByName(hits)
    scratch.clear()
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no test item, with all their columns; those with a null doc_id stay."""
    gone = Scratch(docs.sparkSession).keep(contaminated(docs, benchmark).select(F.col("doc_id").alias("gone")).filter("gone is not null").distinct(), "leaks")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs["doc_id"] == gone["gone"], "left_anti")
