"""Language identification by interpolated Kneser-Ney character models, kept in sorted hash arrays.

A text is lower-cased and every run of characters that aren't letters becomes one blank; it starts with three blanks. For each
language the counts of the 4-grams of a sample give the model: absolute discounting of the raw counts at order 4 and of
continuation counts (distinct left neighbours) below, interpolated down to a uniform distribution. The model holds, sorted
by hash, for each n-gram that any language has the interpolated log-probability in every language, and for each context
the back-off weight in every language; a scan looks up the longest n-gram and backs off from those it misses.

The language with the lowest cross-entropy per character wins. The score is the softmax of the cross-entropies at a
temperature that is calibrated on a part of the sample that the counts leave out; a text whose cross-entropy lies above
what REJECT of that part's texts have in their own language is marked rejected, but its language is still given.

Nulls and texts without a letter are ``und`` with score 0. Texts are learned whole, but the sample is bounded in rows and
bytes for each language; every eighth text of it calibrates. Very long texts are scored whole, a slice of positions at a time.
Ties go to the language that sorts first. With nothing to learn every text is ``und``. Repeated rows are predicted each by
itself; of rows that share a doc_id and a language, the smallest text is learned, once, and a row without a language teaches
nothing. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, mix
from tidewright.llm.words import chunks

ORDER = 4
#: Bounds of the training sample for each language: rows, those with the smallest hashes, and bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 4 << 20
#: Languages of one model, so that its dense tables stay small; more are learned in several models, whose lowest cross-entropy wins over all.
LANGUAGES = 16
#: Up to so many ids of the sample are broadcast (about 50 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Positions of a text that are scored at once.
SLICE = 1 << 18
#: Share of the left-out texts that lie within the accepted cross-entropy of their own language.
REJECT = 0.995

#: Temperatures that the calibration tries.
TEMPERATURES = np.geomspace(0.005, 2, 30)

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a blank."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for c in (*range(0xD800), *range(0xE000, 0x110000)):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    return _fold[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds): the normalised characters of all texts, each after ORDER - 1 blanks."""
    size = np.array([len(t) for t in texts], np.int64)
    raw = _folded()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), size)
    keep = raw != 32
    keep[1:] |= (raw[:-1] != 32) & (row[1:] == row[:-1])  # the first blank of a run; none at the start of a text
    raw, row = raw[keep], row[keep]
    pad = ORDER - 1
    n = np.bincount(row, minlength=len(texts))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(n + pad)])
    out = np.full(bounds[-1], 32, np.uint32)
    out[np.arange(len(raw)) + (row + 1) * pad] = raw
    return out, bounds


def hashes(points: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, for n = 1 to ORDER; the first positions are to be ignored."""
    x, out = points.astype(np.uint64), []
    total = np.zeros(len(x), np.uint64)
    for n in range(ORDER):
        shifted = np.concatenate([np.zeros(min(n, len(x)), np.uint64), x[: len(x) - n]])
        total = total + mix(shifted + _K[n]) * _K[3 - n]
        out.append(mix(total + np.full(1, n, np.uint64)))
    return out


class Model:
    """Sorted hash arrays of every order: n-gram -> log-probability by language; context -> back-off weight by language."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], size: int | None = None):
        """grams: language -> (distinct 4-grams as rows of code points, oldest first; their counts); size: of the alphabet, with one for others."""
        self.languages = sorted(grams)
        keys: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
        tables = []
        for lang in self.languages:
            g, count = grams[lang]
            level, orders = count.astype(np.float64), []
            for n in range(ORDER, 0, -1):
                g_n, c_n = (g, level) if n == ORDER else self._continued(g, n)
                orders.append((g_n, c_n))
                g = g_n
            tables.append(orders[::-1])
        self.size = size or len(np.unique(np.concatenate([t[0][0][:, 0] for t in tables]))) + 1
        for n in range(ORDER):
            keys[n] = np.unique(np.concatenate([self._hash(t[n][0]) for t in tables]))
        self.keys, self.prob = keys, [np.zeros((len(k), len(tables)), np.float32) for k in keys]
        self.context = [np.unique(np.concatenate([self._hash(t[n][0][:, :-1]) for t in tables])) if n else np.zeros(1, np.uint64) for n in range(ORDER)]
        self.backoff = [np.zeros((len(c), len(tables)), np.float32) for c in self.context]
        every = [np.unique(np.concatenate([t[n][0] for t in tables]), axis=0) for n in range(ORDER)]
        for col, orders in enumerate(tables):
            for n in range(ORDER):
                g, c = orders[n]
                ones, twos = (c == 1).sum(), (c == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                own = self._hash(g[:, :-1]) if n else np.zeros(len(g), np.uint64)
                where = np.searchsorted(self.context[n], own)
                total = np.bincount(where, weights=c, minlength=len(self.context[n]))
                kinds = np.bincount(where, minlength=len(self.context[n]))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                self.backoff[n][:, col] = np.log(weight)
                lower = np.full(len(every[n]), -np.log(self.size)) if n == 0 else self._at(n - 1, every[n][:, 1:], col)
                all_hash = self._hash(every[n])
                ctx = np.searchsorted(self.context[n], self._hash(every[n][:, :-1])) if n else np.zeros(len(every[n]), np.int64)
                seen = np.zeros(len(every[n]))
                order = np.argsort(all_hash)
                seen[order[np.searchsorted(all_hash[order], self._hash(g))]] = c
                p = np.maximum(seen - discount, 0) / np.maximum(total[ctx], 1) + weight[ctx] * np.exp(lower)
                self.prob[n][np.searchsorted(self.keys[n], all_hash), col] = np.log(p)
        self.temperature, self.limits = 1.0, np.full(len(tables), np.inf)

    @staticmethod
    def _hash(g: np.ndarray) -> np.ndarray:
        """The hashes that ``hashes`` gives at the end of these n-grams."""
        n = g.shape[1]
        total = np.zeros(len(g), np.uint64)
        for i in range(n):
            total = total + mix(g[:, n - 1 - i].astype(np.uint64) + _K[i]) * _K[3 - i]
        return mix(total + np.full(1, n - 1, np.uint64))

    @staticmethod
    def _continued(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams that end the given longer ones, and how many distinct symbols come before each."""
        short, count = np.unique(g[:, 1:], axis=0, return_counts=True)
        return short, count.astype(np.float64)

    def _at(self, n: int, g: np.ndarray, col: int) -> np.ndarray:
        return self.prob[n][np.searchsorted(self.keys[n], self._hash(g)), col]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol by text and language; letters of each text)."""
        points, bounds = symbols(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        real = np.ones(len(points), bool)
        for i in range(ORDER - 1):
            real[bounds[:-1] + i] = False
        at = np.flatnonzero(real)
        out = np.zeros((len(texts), len(self.languages)))
        grams = hashes(points) if len(at) else []
        for low in range(0, len(at), SLICE):
            part = at[low : low + SLICE]
            # The longest n-gram that the model has, and the back-off weights of the contexts above it.
            logs = np.zeros((len(part), len(self.languages)), np.float32)
            todo = np.arange(len(part))
            for n in range(ORDER - 1, -1, -1):
                h = grams[n][part[todo]]
                where = np.minimum(np.searchsorted(self.keys[n], h), len(self.keys[n]) - 1)
                hit = self.keys[n][where] == h
                logs[todo[hit]] += self.prob[n][where[hit]]
                todo = todo[~hit]
                if n:
                    h = grams[n - 1][part[todo] - 1]
                    where = np.minimum(np.searchsorted(self.context[n], h), len(self.context[n]) - 1)
                    known = self.context[n][where] == h
                    logs[todo[known]] += self.backoff[n][where[known]]
                else:
                    logs[todo] += self.backoff[0][0] - np.log(self.size)
            for col in range(len(self.languages)):
                out[:, col] -= np.bincount(row[part], weights=logs[:, col], minlength=len(texts))
        letters = np.bincount(row[at], weights=points[at] != 32, minlength=len(texts))
        return out / np.maximum(np.bincount(row[at], minlength=len(texts)), 1)[:, None], letters

    def losses(self, texts: list[str], truth: np.ndarray) -> np.ndarray:
        """For each text that has a letter: its language, its cross-entropy in it, and its loss at each temperature."""
        h, letters = self.entropies(texts)
        h, truth = h[letters > 0], truth[letters > 0]
        z = -(h - h.min(1, keepdims=True))
        own = np.arange(len(h))
        loss = [np.log(np.exp(z / t).sum(1)) - z[own, truth] / t for t in TEMPERATURES]
        return np.column_stack([truth, h[own, truth], *loss])

    def calibrate(self, found: np.ndarray) -> None:
        """Fits the temperature and the accepted cross-entropies on the losses of texts that the counts left out."""
        if not len(found):
            return
        self.temperature = float(TEMPERATURES[int(np.argmin(found[:, 2:].mean(0)))])
        for col in range(len(self.languages)):
            own = found[found[:, 0] == col, 1]
            self.limits[col] = np.quantile(own, REJECT) if len(own) else np.inf

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, letters = self.entropies(texts)
        best = h.argmin(1)
        z = np.exp(-(h - h.min(1, keepdims=True)) / self.temperature)
        some = letters > 0
        names = [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
        return names, np.where(some, 1 / z.sum(1), 0.0), ~some | (h.min(1) > self.limits[best])


class Models(Model):
    """Several models over one alphabet as one: a language's cross-entropies don't depend on the others of its model."""

    def __init__(self, models: list[Model]):
        self.models, self.languages = models, [x for m in models for x in m.languages]
        self.temperature, self.limits = 1.0, np.full(len(self.languages), np.inf)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [m.entropies(texts) for m in self.models]
        return np.concatenate([h for h, _ in found], 1), found[0][1]


def sampled(docs: DataFrame, allowed: Column, rows: int, scratch: Scratch) -> DataFrame:
    """(lang, at, text): at most so many documents of each language, those with the smallest hashes."""
    order = F.xxhash64("doc_id", F.lit(1))
    known = docs.filter("lang is not null and doc_id is not null and text is not null").filter(allowed).select("doc_id", "lang").distinct()
    # A threshold leaves some four times as many ids of a language as are wanted, so that no task ranks all of them.
    share = known.groupBy(F.col("lang").alias("of")).agg((F.lit(4.0 * rows) / F.count("*")).alias("share"))
    near = known.withColumn("at", order).join(share, F.col("lang") == F.col("of")).filter((F.col("at") / 2.0**64 + 0.5) < F.col("share"))
    chosen = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))).filter(F.col("rank") <= rows).select("doc_id", "lang", "at")
    chosen = scratch.table(chosen, "chosen")
    texts = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, ["doc_id", "lang"]).groupBy("lang", "at", "doc_id").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, at_once: int = LANGUAGES) -> Model | None:
    """Counts the 4-grams of a bounded sample for each language on the executors, and builds models of at_once languages on the driver."""
    scratch = Scratch(docs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        learned, left, total = [], [], 0
        for i, text in enumerate(pdf.sort_values(["at", "doc_id"])["text"]):
            total += len(text.encode())
            if total > size and i:
                break
            (left if i % 8 == 7 else learned).append(text)
        points, bounds = symbols(learned)
        real = np.ones(len(points), bool)
        for i in range(ORDER - 1):
            real[bounds[:-1] + i] = False
        at = np.flatnonzero(real)
        grams = np.stack([points[at - i] for i in range(ORDER - 1, -1, -1)], 1) if len(at) else np.empty((0, ORDER), np.uint32)
        kinds, count = np.unique(grams, axis=0, return_counts=True)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "grams": [kinds.astype("<u4").tobytes()], "counts": [count.astype("<i8").tobytes()], "left": [left], "alphabet": [np.unique(grams[:, -1]).astype(np.int64).tolist()]})

    found = scratch.table(sampled(docs, allowed, rows, scratch).groupBy("lang").applyInPandas(run, "lang string, grams binary, counts binary, left array<string>, alphabet array<long>").filter(F.length("counts") > 0), "languages")
    named = sorted(r["lang"] for r in found.select("lang").collect())
    if not named:
        scratch.clear()
        return None
    alphabet = found.select(F.explode("alphabet").alias("c")).distinct().count() + 1
    models = []
    for i in range(0, len(named), at_once):
        group = found.filter(F.col("lang").isin(named[i : i + at_once])).select("lang", "grams", "counts").collect()
        models.append(Model({r["lang"]: (np.frombuffer(r["grams"], "<u4").reshape(-1, ORDER), np.frombuffer(r["counts"], "<i8")) for r in group}, alphabet))
    model = models[0] if len(models) == 1 else Models(models)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(shared.value.languages)}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = shared.value.losses([text], np.array([number[lang]]))
                yield pa.RecordBatch.from_arrays([pa.array(got.tolist(), pa.list_(pa.float64()))], names=["row"])

    left = found.select("lang", F.explode("left").alias("text")).repartition(max(8, len(named)))
    model.calibrate(np.array([r["row"] for r in left.mapInArrow(measured, "row array<double>").collect()]))
    scratch.clear()
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low, high, _, _ in chunks(batch):
                some = [x or "" for x in batch.column("text")[low:high].to_pylist()]
                names, score, rejected = model.predict(some) if model else (["und"] * len(some), np.zeros(len(some)), np.ones(len(some), bool))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array(names), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected); rows with crc32 of the id as text = 2 modulo 4 are never learned."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = identify(docs, fit(docs, ~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
