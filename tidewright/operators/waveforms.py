"""Bus signals: the wave of each bit transition, noise, histograms of waves, their fingerprints in a Bloom filter, training sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import packets

#: First and last level in volts of the wave of each transition, by its code (fixed values).
ENDS = {0: (2.5, 2.5), 1: (1.5, 3.5), 2: (3.5, 1.5), 3: (2.5, 1.5), 4: (1.5, 2.5), 5: (3.5, 3.5), 6: (3.5, 1.5), 7: (1.5, 3.5), 8: (1.5, 1.5)}
#: Edges in volts of a wave's histogram (fixed values).
EDGES = (0.8, 1.3, 1.8, 2.3, 2.8, 3.3, 3.8, 4.3)
#: The label of a distorted transition (fixed value).
DISTORTED = 9


def samples_of(fsample: float, bitrate: float) -> int:
    return int(fsample / bitrate)


def pure_wave(code: Column, n: int, slope: float) -> Column:
    """n samples: a line from the first level to the last over a share slope of them, then the last level."""
    rise = int(slope * n)
    level = lambda end: F.element_at(F.create_map(*[F.lit(x) for k, v in ENDS.items() for x in (k, v[end])]), code)
    a, b = level(0), level(1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < rise, a + (b - a) * i / max(rise, 1)).otherwise(b))


def noisy(wave: Column, snr: Column | float, *seed: Column) -> Column:
    """The wave with even noise whose largest value follows from the wave's power and the ratio in decibels; the seed decides the noise."""
    power = F.aggregate(wave, F.lit(0.0), lambda s, v: s + v * v) / F.size(wave)
    amplitude = F.sqrt(power / F.pow(F.lit(10.0), (F.lit(snr) if isinstance(snr, (int, float)) else snr) / 10))
    drawn = lambda i: F.pmod(F.xxhash64(*seed, i), F.lit(1 << 52)) / float(1 << 51) - 1
    return F.transform(wave, lambda v, i: v + amplitude * drawn(i))


def moved(wave: Column, by: Column, direction: Column, level: float = 2.5) -> Column:
    """The wave later or earlier by some samples: 0 to the left with its last value repeated, 1 to the right with its first, 2 to the right with a level."""
    n = F.size(wave)
    fill = lambda v: F.array_repeat(v, by.cast("int"))
    right = F.slice(wave, F.lit(1), n - by)
    return F.when(direction == 0, F.concat(F.slice(wave, by + 1, n - by), fill(F.element_at(wave, -1)))).when(direction == 1, F.concat(fill(F.element_at(wave, 1)), right)).otherwise(F.concat(fill(F.lit(level)), right))


def wave_histogram(wave: Column) -> Column:
    """Counts between EDGES, the last bin closed; values outside don't count."""
    last = len(EDGES) - 2

    def count(i: int) -> Column:
        low, high = EDGES[i], EDGES[i + 1]
        return F.size(F.filter(wave, lambda v: (v >= low) & ((v <= high) if i == last else (v < high))))

    return F.array(*map(count, range(last + 1)))


def word(code: Column, histogram: Column) -> Column:
    """The fingerprint of a transition and a histogram: hexadecimal numbers without zeros before them, so that 0 leaves none."""
    short = lambda v: F.when(v == 0, "").otherwise(F.lower(F.hex(v.cast("long"))))
    return F.concat(short(code), F.lit("_"), F.array_join(F.transform(histogram, short), ""))


#: Most chunks of lines to train on and to test (fixed values).
CHUNKS = {"train": 8, "test": 10}


def falling_ratio(snr: float, chunk: Column) -> Column:
    """The ratio in decibels of a chunk: 5 less with each, until it is 3 or less."""
    ratios = [snr]
    while len(ratios) < CHUNKS["test"]:
        ratios.append(ratios[-1] - 5 if ratios[-1] > 3 else ratios[-1])
    return F.element_at(F.array(*map(F.lit, ratios)), F.least(chunk, F.lit(CHUNKS["test"] - 1)).cast("int") + 1)


def _drawn(hashes: np.ndarray, i: int) -> np.ndarray:
    """Numbers from -1 to 1: what ``noisy`` draws for sample i, XXH64 of the number i from the hash of the seed on."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (hashes + (p5 + np.uint64(4))) ^ (np.full(1, i, np.uint64) * p1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return ((h ^ h >> np.uint64(32)) & np.uint64((1 << 52) - 1)).astype(float) / float(1 << 51) - 1


def _samples(codes: pa.Array, snr: pa.Array, hashes: pa.Array, n: int, slope: float):
    """The samples of a batch of noisy waves, the first of all waves, then the second, and so on."""
    rise = int(slope * n)
    pure = np.array([[a + (b - a) * i / max(rise, 1) if i < rise else b for i in range(n)] for a, b in (ENDS[c] for c in range(len(ENDS)))])
    power = np.array([sum(v * v for v in wave) / n for wave in pure.tolist()])
    code, h = codes.fill_null(0).to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False).view(np.uint64)
    amplitude = np.sqrt(power[code] / 10.0 ** (snr.to_numpy(zero_copy_only=False) / 10))
    for i in range(n):
        yield pure[code, i] + amplitude * _drawn(h, i)


def _lists(values: np.ndarray, nulls: pa.Array, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists, null where a code is."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind), mask=nulls.is_null() if nulls.null_count else None)


def signals(stream: DataFrame, fsample: float = 16e6, bitrate: float = 125e3, slope: float = 0.3, snr: float | Column = 40.0, seed: int = 0, distorted: float = 0.0, snr_distorted: float = 3.0) -> DataFrame:
    """(series, idx, pos, code, y, wave, histogram) of each transition of packets (series, idx, codes).

    A share ``distorted`` of the transitions has the worse noise and the label DISTORTED; the others' label is their code. The waves are
    those of ``pure_wave`` and ``noisy`` and the histograms those of ``wave_histogram``, made for a batch of transitions at a time.
    """
    n = samples_of(fsample, bitrate)

    @F.arrow_udf("array<double>")
    def wave(code: pa.Array, ratio: pa.Array, hashes: pa.Array) -> pa.Array:
        return _lists(np.stack(list(_samples(code, ratio, hashes, n, slope)), 1), code, pa.float64())

    @F.arrow_udf("array<int>")
    def histogram(code: pa.Array, ratio: pa.Array, hashes: pa.Array) -> pa.Array:
        reached = np.zeros((len(EDGES), len(code)), np.int32)  # samples at an edge or above it; above the last one
        for v in _samples(code, ratio, hashes, n, slope):
            for k, edge in enumerate(EDGES[:-1]):
                reached[k] += v >= edge
            reached[-1] += v > EDGES[-1]
        return _lists((reached[:-1] - reached[1:]).T, code, pa.int32())

    each = stream.select("series", "idx", (snr if isinstance(snr, Column) else F.lit(float(snr))).cast("double").alias("_snr"), F.posexplode("codes").alias("pos", "code"))
    key = (F.lit(seed), F.col("series"), F.col("idx"), F.col("pos"))
    bad = F.pmod(F.xxhash64(*key, F.lit("bad")), F.lit(1 << 52)) / float(1 << 52) < distorted
    ready = each.withColumn("_bad", bad).withColumns({"_ratio": F.when(F.col("_bad"), float(snr_distorted)).otherwise(F.col("_snr")), "_hash": F.xxhash64(*key)})
    made = (F.col("code"), F.col("_ratio"), F.col("_hash"))
    return ready.select("series", "idx", "pos", "code", F.when(F.col("_bad"), DISTORTED).otherwise(F.col("code")).alias("y"), wave(*made).alias("wave"), histogram(*made).alias("histogram"))


def trained_words(waves: DataFrame) -> DataFrame:
    """(item): the fingerprints of the mean histogram of each transition of each packet, cut to whole numbers."""
    bins = len(EDGES) - 1
    means = waves.groupBy("series", "idx", "code").agg(*[F.avg(F.get("histogram", F.lit(i))).alias(f"_{i}") for i in range(bins)])
    return means.select(word(F.col("code"), F.array(*[F.floor(f"_{i}") for i in range(bins)])).alias("item")).distinct()


def unknown_transitions(waves: DataFrame, filter_: DataFrame, bits_: int, k: int, few: bool = False) -> DataFrame:
    """(series, idx, n, unknown): transitions of each packet, and how many of them have a fingerprint that the filter doesn't hold.

    With few, the different fingerprints are broadcast: waves of n samples have 9 * comb(n + 7, 7) of them at most, 2.2 million for 16 samples.
    """
    asked = waves.select("series", "idx", word(F.col("code"), F.col("histogram")).alias("item"))
    checked = packets.bloom_check(asked, "item", filter_, bits_, k)
    return asked.join(F.broadcast(checked) if few else checked, "item").groupBy("series", "idx").agg(F.count("*").alias("n"), F.count_if(~F.col("member")).alias("unknown"))


def filter_size(items: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a filter for so many items at a rate of false positives."""
    bits_ = max(64, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return bits_, packets.bloom_hashes(bits_, items)
