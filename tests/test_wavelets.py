"""Wavelets in blocks against the transform of a whole series at once."""

import numpy as np
import pytest

from tidewright.operators import wavelets


def whole(x, order, threshold):
    """(approximation, denoised) by matrices of the filter bank, level by level."""
    low, high, rec_low, rec_high = wavelets.filters(order)
    taps, sizes, a, details = 2 * order, [], x, []
    for _ in range(wavelets.top_level(len(x), taps)):
        n = len(a)
        ext = wavelets.longer(a, taps - 2, taps - 1)
        at = lambda f, ext=ext, n=n: np.array([sum(f[j] * ext[2 * k + 1 - j + taps - 2] for j in range(taps)) for k in range((n + taps - 1) // 2)])
        sizes.append(n)
        details.append(at(high))
        a = at(low)
    out = []
    for keep in (False, True):
        y = a
        for n, d in zip(sizes[::-1], details[::-1], strict=True):
            d = np.where(np.abs(d) < threshold, 0, d) if keep else np.zeros(len(d))
            y = np.array([sum(y[k] * rec_low[i - 2 * k + taps - 2] + d[k] * rec_high[i - 2 * k + taps - 2] for k in range(max(0, -(-(i - 1) // 2)), (i + taps - 2) // 2 + 1)) for i in range(n)])
        out.append(y)
    return out


def pad(x):
    n = len(x)
    more = (1 << (n - 1).bit_length()) - n if 4 < n < 1 << 16 else 0
    return wavelets.longer(x, more // 2, more - more // 2), more // 2


def test_taps():
    root = np.sqrt(3)
    assert np.allclose(wavelets.daubechies(1), [1 / np.sqrt(2)] * 2, atol=1e-12)
    assert np.allclose(wavelets.daubechies(2), np.array([1 + root, 3 + root, 3 - root, 1 - root]) / (4 * np.sqrt(2)), atol=1e-12)
    for order in wavelets.ORDERS:
        h = wavelets.daubechies(order)
        assert len(h) == 2 * order and abs(h.sum() - np.sqrt(2)) < 1e-11
        for shift in range(order):  # orthonormal to its even shifts
            assert abs((h[2 * shift :] * h[: len(h) - 2 * shift]).sum() - (shift == 0)) < 1e-10
        sign = np.where(np.arange(2 * order) % 2, -1, 1)
        assert abs((h * sign).sum()) < 1e-10  # a moment vanishes


@pytest.mark.parametrize("order, size", [(1, 16), (2, 16), (3, 64), (10, 128), (38, 512)])
def test_blocks_give_the_whole_transform(spark, order, size):
    rng = np.random.default_rng(order)
    data = {"a": np.cumsum(rng.normal(size=700)), "b": rng.normal(size=512), "c": rng.normal(size=90), "d": np.array([3.0, 1.0, 2.0]), "e": np.array([5.0]), "f": np.arange(21.0)}
    rows = [(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)]
    found = wavelets.denoised(spark.createDataFrame(rows, "series string, idx long, value double"), order, 0.4, size=size).toPandas()
    for s, x in data.items():
        y, left = pad(x)
        want = whole(y, order, 0.4)
        got = found[found.series == s].sort_values("idx")
        assert got.idx.tolist() == list(range(len(x)))
        assert np.allclose(got.approximation, want[0][left : left + len(x)], atol=1e-8) and np.allclose(got.denoised, want[1][left : left + len(x)], atol=1e-8)


def test_nothing_is_lost_without_a_threshold(spark):
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(size=3000))
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, idx long, value double")
    for order in (2, 20):
        got = wavelets.denoised(df, order, 0.0, size=256, pad=False).toPandas().sort_values("idx")
        assert np.allclose(got.denoised, x, atol=1e-8)
    parts = wavelets.coefficients(df, 2, size=256, pad=False).toPandas()
    assert parts.groupby("detail")["level"].max().tolist() == [wavelets.top_level(3000, 4)] * 2
    assert parts["x"].map(len).max() <= 4096 and (parts["level"] == 1).sum() >= 3000 // 256
