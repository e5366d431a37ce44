"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs that skip one word of a whole text, hashed to 2**BITS coordinates; their
values are equal and a text's vector has unit length up to FULL distinct features. A-Z are lower-cased; words end at ASCII
that is neither letter nor digit. Training visits a sample of labelled rows in hash order, EPOCHS times, with per-coordinate
rates and L1 shrinkage, so most weights are exactly zero; the rest are sent to the executors. The score is the logistic function
of a slope times the summed weights plus an intercept; both are calibrated on the last quarter of the sample, which the weights
don't learn from.

Nulls and empty texts score the intercept alone, very long ones are read whole. Labels that are null are skipped; a doc_id with
several labels counts with the largest. With no labelled row, or one class only, the score is the class share, or 0 with no
label. Rows that repeat a doc_id are scored each by itself; of them the smallest text is learned, once. Equal texts have equal
scores. An empty table gives no rows. Other columns, whatever their names, are carried along where documents are returned and
ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, mix
from tidewright.llm.words import LOWER, NOT_ALNUM, chunks, words

BITS = 20
#: Labelled rows of the training sample at most, those with the smallest hashes; and at most so many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 16_000, 64 << 20
#: FTRL-proximal: per-coordinate rate ALPHA / (BETA + sqrt of summed squared gradients), L1 (times the root of the rows, as
#: the gradients' noise grows so) and L2 penalties.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 0.11, 0.05, 3

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, rows) of a chunk: all words, pairs and skip-pairs of each text, not yet distinct."""
    h, _, _, first = words(data, offsets, NOT_ALNUM, LOWER)
    h, row = mix(h), np.repeat(np.arange(len(first) - 1), np.diff(first))
    found, rows = [mix(h + _C[0])], [row]
    for gap in (1, 2):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.empty(0, bool)
        found.append(mix(h[:-gap][same] * _C[1] + h[gap:][same] * _C[2] + np.full(1, gap, np.uint64)) if len(same) else np.empty(0, np.uint64))
        rows.append(row[:-gap][same] if len(same) else np.empty(0, np.int64))
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def train(sample: list[tuple[bytes, int]], bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(coordinates, weights, slope, intercept) of the weights that aren't zero."""
    y = np.array([t for _, t in sample], np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return np.empty(0, np.int64), np.empty(0), 0.0, 40.0 if share else -40.0
    rows = []
    for raw, _ in sample:
        data = np.frombuffer(raw, np.uint8)
        rows.append(np.unique(features(data, np.array([0, len(data)]), bits)[0]))
    l1 *= np.sqrt(len(rows))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    base = float(np.log(share / (1 - share)))

    fitted = len(rows) - len(rows) // 4 if min(y[len(rows) - len(rows) // 4 :].sum(), (1 - y[len(rows) - len(rows) // 4 :]).sum()) >= 5 else len(rows)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, t in zip(rows[:fitted], y[:fitted], strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(base + w.sum(), -35, 35))) - t
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    every = np.flatnonzero(np.abs(z) > l1)
    dense = np.zeros(1 << bits)
    dense[every] = weights(every)
    check = slice(fitted if fitted < len(rows) else 0, None)
    x, y = np.array([dense[at].sum() for at in rows[check]]), y[check]
    slope, intercept = 1.0, base
    for _ in range(50):  # Newton steps of a logistic fit of the labels on the margin, slope at most 4
        p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -35, 35)))
        v = p * (1 - p) + 1e-9
        g, h = np.array([(x * (p - y)).sum(), (p - y).sum()]), np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, intercept = float(np.clip(slope - step[0], 0.05, 4.0)), float(intercept - step[1])
    return every, dense[every], slope, intercept


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Trains in one task on a bounded sample of the labelled rows for which allowed holds; only the weights come back.

    The sample is cut to its bytes before its texts meet in that task.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").filter(allowed).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit(8))
    chosen = known.orderBy(order, "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = scratch.table(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text", order.alias("at"), "doc_id", F.octet_length("text").cast("long").alias("bytes")), "labelled")
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most ``rows`` rows, without their texts
    within = found.select("at", "doc_id", "bytes", before.alias("before")).filter((F.col("before") + F.col("bytes") <= size) | (F.col("before") == 0)).select("doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ready = pdf.sort_values(["at", "doc_id"])
        at, w, slope, intercept = train([(text.encode(), int(label)) for label, text in zip(ready["label"], ready["text"], strict=True)])
        return pd.DataFrame({"at": [at.astype("<i8").tobytes()], "w": [w.astype("<f8").tobytes()], "slope": [slope], "intercept": [intercept]})

    bounded = found.join(F.broadcast(within), "doc_id").select("label", "text", "at", "doc_id")
    got = bounded.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "at binary, w binary, slope double, intercept double").first()
    scratch.clear()
    if got is None:
        return np.empty(0, np.int64), np.empty(0), 0.0, -40.0
    return np.frombuffer(got["at"], "<i8"), np.frombuffer(got["w"], "<f8"), got["slope"], got["intercept"]


def scored(docs: DataFrame, text: str, model: tuple[np.ndarray, np.ndarray, float, float]) -> DataFrame:
    """The columns of docs by number (c0, c1, ...) and the score of the column named text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32), model[2], model[3]))  # at most 8 bytes for each of 2**BITS coordinates
    names = [f"c{i}" for i in range(len(docs.columns))]
    ready = docs.toDF(*names)
    ready = ready.select(*names, F.col(names[docs.columns.index(text)]).cast("string").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, slope, intercept = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for batch in batches:
            for low, high, data, offsets in chunks(batch, "words"):
                n = high - low
                coordinates, row = features(data, offsets)
                hit = dense[coordinates] != 0
                pair = np.unique(row[hit] << BITS | coordinates[hit])
                total = np.bincount(pair >> BITS, weights=dense[pair & ((1 << BITS) - 1)], minlength=n)
                p = 1 / (1 + np.exp(-np.clip(slope * total + intercept, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[low:high] for c in names), pa.array(p)], names=[*names, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema[:-1])
    return ready.mapInArrow(run, f"{schema}, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 1 modulo 3; such rows' labels are never learned."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", model).select(F.col("c0").alias("doc_id"), "score")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Documents that score below the threshold, with all their columns."""
    found = scored(docs, "text", fit(docs, labels, ~held_out(F.col("doc_id"))))
    return found.filter(F.col("score") < threshold).drop("score").toDF(*docs.columns)
