"""Images: colour histograms, mean and covariance of pixels, two-dimensional wavelets, and six features from their divergences."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.wavelets import daubechies

def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(name, height, width, channels, data) of the image files of a folder; data are rows of blue, green, red (and alpha) bytes."""
    rows = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    name = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), r"\.[^.]*$", "")
    return rows.select(name.alias("name"), "height", "width", F.col("nChannels").alias("channels"), "data")


def rgb(raw: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Planes of red, green and blue; grey images have three equal ones, an alpha channel is left out."""
    a = np.frombuffer(raw, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, 2::-1]


def png(image: np.ndarray) -> bytes:
    """Planes of red, green and blue as a PNG file."""
    height, width = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def converted(images: DataFrame) -> DataFrame:
    """(name, content) of images of any readable format as PNG files of red, green and blue, without an alpha channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [png(rgb(r["data"], r["height"], r["width"], r["channels"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(content, pa.binary())], names=["name", "content"])

    return images.select("name", "height", "width", "channels", "data").mapInArrow(run, "name string, content binary")


#: Height, width and value of the plain white and black images that others are held against (fixed values).
PLAIN = {"white": (500, 335, 255), "black": (727, 626, 1)}


def plain_images(spark: SparkSession) -> DataFrame:
    """The plain images as read_images gives images, grey."""
    rows = [(name, h, w, 1, bytes([v]) * (h * w)) for name, (h, w, v) in PLAIN.items()]
    return spark.createDataFrame(rows, "name string, height int, width int, channels int, data binary")


def densities(image: np.ndarray) -> np.ndarray:
    """The shares of the 256 values in each channel."""
    return np.stack([np.bincount(image[:, :, c].ravel(), minlength=256) / image[:, :, c].size for c in range(3)])


def pixel_moments(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the pixels at four places; the covariance by one less than their number."""
    flat = image.reshape(-1, 3).astype(float)
    return np.round(flat.mean(0), 4), np.round(np.cov(flat.T, ddof=1), 4)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """The largest of the channels' sums of p ln(p / q), both raised by 1e-15."""
    p, q = p + 1e-15, q + 1e-15
    return float((p * np.log(p / q)).sum(1).max())


def gaussian_divergence(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two normal distributions, at six places; a covariance that is nearly singular gets 1e-5 on its diagonal."""
    (m0, c0), (m1, c1) = ((m, c + 1e-5 * np.eye(len(m)) if np.linalg.det(c) < 1e-8 else c) for m, c in (one, other))
    back = np.linalg.inv(c1)
    logs = np.linalg.slogdet(c1)[1] - np.linalg.slogdet(c0)[1]
    return round(float(np.trace(back @ c0) + (m1 - m0) @ back @ (m1 - m0) - len(m0) + logs) / 2, 6)


def _bank(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low-pass, high-pass) of the synthesis."""
    return h, h[::-1] * (-1) ** np.arange(len(h))


def split(x: np.ndarray, h: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """(approximation, detail) along an axis, the ends mirrored."""
    low, high = _bank(h)
    x = np.moveaxis(x, axis, -1)
    n, length = x.shape[-1], len(h)
    place = np.arange(-(length - 1), n + length - 1) % (2 * n)
    padded = x[..., np.where(place < n, place, 2 * n - 1 - place)]
    at = np.arange(1, n + length - 1, 2)
    windows = padded[..., at[:, None] + np.arange(length)]
    return tuple(np.moveaxis(windows @ f, -1, axis) for f in (low, high))


def joined(a: np.ndarray, d: np.ndarray, h: np.ndarray, axis: int, n: int) -> np.ndarray:
    """The n values whose split along an axis is (a, d)."""
    a, d = np.moveaxis(a, axis, -1), np.moveaxis(d, axis, -1)
    out = np.zeros((*a.shape[:-1], 2 * a.shape[-1] + len(h)))
    for coefficients, f in zip((a, d), _bank(h), strict=True):
        for k, w in enumerate(f):
            out[..., k : k + 2 * a.shape[-1] : 2] += w * coefficients
    first = len(h) - 2
    return np.moveaxis(out[..., first : first + n], -1, axis)


def decomposed(plane: np.ndarray, h: np.ndarray, levels: int) -> tuple[np.ndarray, list]:
    """(approximation, details of each level with the shape before it)."""
    details, a = [], plane.astype(float)
    for _ in range(levels):
        shape = a.shape
        low, high = split(a, h, 0)
        (a, hl), (lh, hh) = split(low, h, 1), split(high, h, 1)
        details.append((hl, lh, hh, shape))
    return a, details


def rebuilt(a: np.ndarray, details: list, h: np.ndarray, approximation: bool = True, detail: bool = True) -> np.ndarray:
    """The plane from its parts; parts that aren't wanted count as zero."""
    a = a if approximation else np.zeros_like(a)
    for hl, lh, hh, shape in details[::-1]:
        hl, lh, hh = (x if detail else np.zeros_like(x) for x in (hl, lh, hh))
        a = joined(joined(a, hl, h, 1, shape[1]), joined(lh, hh, h, 1, shape[1]), h, 0, shape[0])
    return a


def parts(image: np.ndarray, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(approximation, detail) of an image by wavelets of so many vanishing moments at all levels, as bytes."""
    h = daubechies(order)
    levels = max(1, int(math.log2(max(1.0, min(image.shape[:2]) / (len(h) - 1)))))
    planes = [decomposed(image[:, :, c], h, levels) for c in range(3)]
    made = [np.stack([rebuilt(a, d, h, keep, not keep) for a, d in planes], 2) for keep in (True, False)]
    return tuple(np.clip(np.rint(x), 0, 255).astype(np.uint8) for x in made)


def features_of(image: np.ndarray, order: int = 2) -> list[float]:
    """Divergences of the image from its approximation and its detail, by histograms and as normal distributions, and from white and black."""
    approximation, detail = parts(image, order)
    own, (a, d) = densities(image), (densities(x) for x in (approximation, detail))
    moments, others = pixel_moments(image), (pixel_moments(approximation), pixel_moments(detail))
    tail = lambda value: -math.log(own[:, value].min() + 1e-15)
    return [divergence(own, a), divergence(own, d), *(gaussian_divergence(moments, o) for o in others), tail(255), tail(1)]


#: Names of the six features.
FEATURES = ("approximation", "detail", "normal_approximation", "normal_detail", "white", "black")


def image_features(images: DataFrame, order: int = 2) -> DataFrame:
    """(name, height, width, six features) of each image; an image is handled whole, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = features_of(rgb(row["data"], row["height"], row["width"], row["channels"]), order)
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([row["height"]], pa.int32()), pa.array([row["width"]], pa.int32()), *(pa.array([float(v)]) for v in values)], names=["name", "height", "width", *FEATURES])

    return images.select("name", "height", "width", "channels", "data").mapInArrow(run, "name string, height int, width int, " + ", ".join(f"{c} double" for c in FEATURES))


def image_histograms(images: DataFrame) -> DataFrame:
    """(name, channel, value, share) of the values that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                share = densities(rgb(row["data"], row["height"], row["width"], row["channels"]))
                c, v = np.nonzero(share)
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]] * len(c)), pa.array([("red", "green", "blue")[i] for i in c]), pa.array(v.astype(np.int32)), pa.array(share[c, v])], names=["name", "channel", "value", "share"])

    return images.select("name", "height", "width", "channels", "data").mapInArrow(run, "name string, channel string, value int, share double")


def pixel_statistics(images: DataFrame) -> DataFrame:
    """(name, mean, covariance): three means, and the covariances row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mean, cov = pixel_moments(rgb(row["data"], row["height"], row["width"], row["channels"]))
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([mean.tolist()], kind), pa.array([cov.ravel().tolist()], kind)], names=["name", "mean", "covariance"])

    return images.select("name", "height", "width", "channels", "data").mapInArrow(run, "name string, mean array<double>, covariance array<double>")
