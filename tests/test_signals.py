"""Waves, images, saved things, networks and intrusion sets, against direct computation."""

import datetime as dt
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import cleaning, images, intrusion, networks, packets, regress, simulate, waveforms
from tidewright.sources import store


def test_waves_of_transitions(spark):
    df = spark.createDataFrame([(c,) for c in range(9)], "c int")
    rows = {r.c: r.w for r in df.select("c", waveforms.pure_wave(F.col("c"), 10, 0.4).alias("w")).collect()}
    assert rows[0] == [2.5] * 10 and rows[5] == [3.5] * 10 and rows[8] == [1.5] * 10
    assert rows[1] == pytest.approx([1.5, 2.0, 2.5, 3.0] + [3.5] * 6) and rows[6][0] == 3.5 and rows[6][-1] == 1.5


def test_noise_has_the_power_of_its_ratio(spark):
    wave = F.array_repeat(F.lit(2.0), 4000)
    row = spark.range(1).select(waveforms.noisy(wave, 20.0, F.lit(7)).alias("a"), waveforms.noisy(wave, 20.0, F.lit(7)).alias("b"), waveforms.noisy(wave, 20.0, F.lit(8)).alias("c")).first()
    noise = np.array(row.a) - 2
    assert row.a == row.b != row.c and np.abs(noise).max() <= 0.2 and np.mean(noise**2) == pytest.approx(0.04 / 3, rel=0.1)


def test_moved_waves(spark):
    w = F.array(*[F.lit(float(i)) for i in range(5)])
    got = spark.range(1).select(*[waveforms.moved(w, F.lit(2), F.lit(k)).alias(f"k{k}") for k in range(3)]).first()
    assert got.k0 == [2, 3, 4, 4, 4] and got.k1 == [0, 0, 0, 1, 2] and got.k2 == [2.5, 2.5, 0, 1, 2]


def test_words_and_unknown_transitions(spark):
    df = spark.createDataFrame([(5, [0, 16, 255]), (0, [1, 0, 10])], "c int, h array<int>")
    assert [r[0] for r in df.select(waveforms.word(F.col("c"), F.col("h"))).collect()] == ["5_10ff", "_1a"]
    hist = spark.range(1).select(waveforms.wave_histogram(F.array(*[F.lit(v) for v in (0.8, 1.29, 1.3, 4.3, 4.4, 0.1)])).alias("h")).first().h
    assert hist == [2, 1, 0, 0, 0, 0, 1]
    stream = spark.createDataFrame([("s", i, [1, 6, 7, 5]) for i in range(20)], "series string, idx long, codes array<int>")
    made = waveforms.signals(stream, bitrate=1e6, snr=60.0)
    bits, k = waveforms.filter_size(100, 0.01)
    known = packets.bloom(waveforms.trained_words(made), "item", bits, k)
    assert waveforms.unknown_transitions(made, known, bits, k).agg(F.sum("unknown")).first()[0] == 0
    loud = waveforms.signals(stream, bitrate=1e6, snr=60.0, distorted=0.5, snr_distorted=0.0)
    assert 20 < loud.filter(F.col("y") == waveforms.DISTORTED).count() < 60
    assert waveforms.unknown_transitions(loud, known, bits, k).agg(F.sum("unknown")).first()[0] > 10


def test_streams_carry_the_last_bit_on(spark):
    df = spark.createDataFrame([("s", 0, "01"), ("s", 1, "10"), ("t", 0, "0")], "series string, idx long, bits string")
    assert {(r.series, r.idx): r.codes for r in packets.stream_transitions(df).collect()} == {("s", 0): [1, 6], ("s", 1): [8, 7], ("t", 0): [1]}


def test_wavelets_give_the_image_back():
    x = np.random.default_rng(0).integers(0, 255, (37, 50)).astype(float)
    for order in (1, 2, 4, 12):
        h = images.daubechies(order)
        a, d = images.decomposed(x, h, 2)
        assert np.abs(images.rebuilt(a, d, h) - x).max() < 1e-8
        assert abs(h.sum() - 2**0.5) < 1e-9 and abs(h @ h - 1) < 1e-9


def png(path, a):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_image_features(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (40, 32, 3)).astype(np.uint8)
    png(tmp_path / "noise.png", a)
    png(tmp_path / "white.png", np.full((20, 20, 3), 255, np.uint8))
    rows = images.read_images(spark, str(tmp_path))
    shares = images.image_histograms(rows).filter("name = 'noise' and channel = 'red' and value = 7").collect()
    assert sum(r.share for r in shares) == pytest.approx((a[:, :, 0] == 7).mean())
    stats = {r.name: r for r in images.pixel_statistics(rows).collect()}
    assert stats["noise"].mean == pytest.approx(a.reshape(-1, 3).mean(0), abs=1e-4)
    assert np.reshape(stats["noise"].covariance, (3, 3)) == pytest.approx(np.cov(a.reshape(-1, 3).T.astype(float)), abs=1e-3)
    got = {r.name: r for r in images.image_features(rows).collect()}
    assert got["white"].white == pytest.approx(0, abs=1e-9) and got["white"].black == pytest.approx(-np.log(1e-15))
    assert got["white"].normal_approximation == pytest.approx(0, abs=1e-6) and got["noise"].detail > 0


def test_gaussian_divergence():
    one, other = (np.zeros(2), np.eye(2)), (np.array([1.0, 0]), 2 * np.eye(2))
    assert images.gaussian_divergence(one, one) == 0
    assert images.gaussian_divergence(one, other) == pytest.approx(0.5 * (1 + 0.5 - 2 + np.log(4)), abs=1e-6)


def test_store_and_files(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "kept"))
    s.save("hmm", "a", {"start": [0.5, 0.5]}, b"\x01\x02")
    s.save("hmm", "a", {"start": [1.0, 0.0]})
    assert s.load("hmm", "a") == ({"start": [1.0, 0.0]}, b"") and s.names("hmm") == ["a"]
    with pytest.raises(KeyError):
        s.load("hmm", "b")
    models = spark.createDataFrame([("x", bytearray(b"m"))], "series string, content binary")
    s.save_rows("network", models, "series", "content")
    assert s.load("network", "x")[1] == b"m"
    items = spark.range(100).withColumnRenamed("id", "item")
    store.save_filter(packets.bloom(items, "item", 4096, 3), str(tmp_path / "bf"), 4096, 3)
    bitmaps, bits, k = store.load_filter(spark, str(tmp_path / "bf"))
    assert packets.bloom_check(items, "item", bitmaps, bits, k).filter("member").count() == 100
    rows = spark.createDataFrame([([1.0, 2.0], 0), ([3.0, 2.0], 1)], "features array<double>, y int")
    assert store.write_chunk(rows, str(tmp_path / "chunk")) == 2
    back = store.read_chunk(spark, str(tmp_path / "chunk"))
    assert sorted(map(tuple, back.select("y", "features").collect())) == [(0, [1.0, 2.0]), (1, [3.0, 2.0])]
    assert sorted(r.features for r in store.normalised(back).collect()) == [[-1.0, 0.0], [1.0, 0.0]]
    (tmp_path / "dump").write_text("".join(f"line {i}\n" for i in range(30)))
    assert store.line_count(spark, str(tmp_path / "dump")) == 30 and store.files(spark, str(tmp_path)) == ["dump"]
    assert [r.value for r in store.line_range(spark, str(tmp_path / "dump"), 27, 10).orderBy("line").collect()] == ["line 27", "line 28", "line 29"]
    store.write_fixed_width(spark.createDataFrame([(1, 2.5)], "i int, v double"), str(tmp_path / "wide"), ["i", "v"], 10, 2)
    assert spark.read.text(str(tmp_path / "wide")).first().value == "         1      2.50"
    store.write_dictionary(spark, {"a": [1, 2], "b": "x"}, str(tmp_path / "d"))
    assert store.read_dictionary(spark, str(tmp_path / "d")) == {"a": [1, 2], "b": "x"}
    text = spark.createDataFrame([("[1.0, 2]",), ("[]",)], "t string")
    assert [r[0] for r in text.select(store.numbers(F.col("t"))).collect()] == [[1.0, 2.0], []]
    assert store.as_text({"a": [1, {"b": 2}]}) == "a:\n    1\n    b:\n      2\n"


@pytest.mark.parametrize("name", sorted(networks.SHAPES))
def test_gradients_of_networks(name):
    rng = np.random.default_rng(0)
    shape = [(k, s) for k, s in networks.SHAPES[name] if k != "drop"]
    net = networks.Network(shape, 8, seed=3)
    x, y = rng.normal(size=(5, 8)), rng.normal(size=5)
    _, grads = net.loss_gradients(x, y)
    params = [p for layer in net.layers for p in layer.params]
    for p, g in zip(params, grads, strict=True):
        at = tuple(rng.integers(0, n) for n in p.shape)
        keep, step = p[at], 1e-6
        p[at] = keep + step
        up = net.loss_gradients(x, y)[0]
        p[at] = keep - step
        down = net.loss_gradients(x, y)[0]
        p[at] = keep
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


def test_networks_learn_are_saved_and_forecast(spark):
    x = np.sin(np.arange(300) / 5) * 3 + 10
    rows = np.lib.stride_tricks.sliding_window_view((x - 7) / 6, 9)
    net = networks.Network(networks.SHAPES["vanilla_lstm"], 8).fit(rows[:, :-1], rows[:, -1], 15)
    assert np.abs(net.predict(rows[:, :-1]) - rows[:, -1]).mean() < 0.1
    again = networks.Network.from_bytes(net.to_bytes())
    assert np.array_equal(again.predict(rows[:5, :-1]), net.predict(rows[:5, :-1]))
    assert networks.patched(networks.SHAPES["mlp_1"], 1, "units", 8)[1] == ("dense", {"units": 8})
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, idx long, value double")
    models = networks.trained(df, ("mlp_2", "best_arima", "seasonal_arima"), lags=16, epochs=15, period=24)
    found = networks.forecasts(df, models, 3).collect()
    want = np.sin(np.arange(300, 303) / 5) * 3 + 10
    assert {(r.model, r.horizon) for r in found} == {(m, h) for m in ("mlp_2", "best_arima", "seasonal_arima") for h in (1, 2, 3)}
    assert all(abs(r.forecast - want[r.horizon - 1]) < 1.0 for r in found if r.model == "best_arima")


def test_batches_keep_to_their_windows(spark):
    df = spark.range(200).select(F.lit("s").alias("series"), F.col("id").alias("idx"))
    rows = networks.ordered_batches(df, 0.5, 64, 32).collect()
    assert sum(r.train for r in rows) == 100 and all(r.batch // 2 == r.idx // 64 for r in rows)


def test_intrusions_are_found(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 2 else "b", i, [float(v) for v in np.round(0.5 + 0.01 * rng.normal(size=8), 3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, row long, features array<double>")
    marked = intrusion.with_intrusions(df, 0.3, "row").withColumn("key", F.col("row") * 2 + F.col("y"))
    assert marked.count() == pytest.approx(3900, abs=120) and {r.y for r in marked.collect()} == {0, 1}
    parts = intrusion.split(marked, "id", "key")
    models = intrusion.trained(parts, "id", epochs=20)
    counts = {r.id: r for r in intrusion.binary_confusion(intrusion.scored(parts.filter("not train"), models, "id"), "id").collect()}
    assert set(counts) == {"a", "b"} and all((r.tn + r.tp) / (r.tn + r.tp + r.fn + r.fp) > 0.95 for r in counts.values())
    whole = intrusion.with_intrusions(df, 0.3, "row", shares=False).filter("y = 1").first().features
    assert all(v == int(v) and 0 <= v < 32 for v in whole)


def test_tokens_and_fleets():
    assert simulate.credit_tokens("pump", 0, 0.0) == (0, 5) and simulate.credit_tokens("pump", 1, 0.5) == (5, 0)
    assert simulate.credit_tokens("turbine", 0, 0.0) == (9, 0) and simulate.credit_tokens("turbine", 1, 0.9) == (0, 9)
    names = [d.name for d in simulate.fleet({"diesel": 3}, {"diesel": ["x", "y"]})]
    assert names == ["x-0", "y-1", "x-2"]
    assert [simulate.imbalance_range(v) for v in (0.5, 0.1, -0.2, -0.7)] == [0, 1, 2, 3]


def test_small_operators(spark):
    df = spark.createDataFrame([("s", 0, 5), ("s", 1, 0), ("t", 0, 0)], "series string, idx long, count int")
    assert [tuple(r) for r in cleaning.without_trailing(df).collect()] == [("s", 0, 5)]
    open_ = spark.createDataFrame([("s", dt.datetime(2024, 1, i), float(i), None if i > 1 else 1.0) for i in (3, 1, 2)], "series string, ts timestamp, forecast double, actual double")
    assert cleaning.first_open(open_).first().forecast == 2
    codes = cleaning.dense_codes(spark.createDataFrame([(7,), (3,), (None,), (7,)], "v int"), "v").collect()
    assert sorted((r.v or 0, r.dense) for r in codes if r.v) == [(3, 0), (7, 1), (7, 1)] and any(r.dense is None for r in codes)
    assert cleaning.excluded(codes and spark.createDataFrame([("a",), (None,)], "k string"), "k", ["a"]).count() == 1


def test_one_classifier_learns_chunks_in_turn(spark):
    rng = np.random.default_rng(3)
    rows = [(c, [float(v) for v in rng.normal(size=4) + 3 * np.eye(4)[k]], k) for c in range(4) for k in range(3) for _ in range(120)]
    df = spark.createDataFrame(rows, "chunk int, features array<double>, y int")
    r = intrusion.trained_in_turn(df, 10, 3).first()
    assert r.chunks == 4 and r.n == 360 and r.accuracy > 0.85


def test_least_squares_on_any_number_of_columns(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 4)) * 1024) / 1024
    y = 3 + x @ [1.0, -2.0, 0.5, 4.0] + np.round(rng.normal(size=300) * 1024) / 1024
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)
    columns = [F.col(f"x{i}") for i in range(4)]
    for shift in (0.0, 1e8):
        df = spark.createDataFrame([(float(b), *map(float, a + shift)) for a, b in zip(x, y, strict=True)], "y double, x0 double, x1 double, x2 double, x3 double")
        fit = regress.solved(regress.gram(df, F.col("y"), columns, [])).first()
        assert fit.n == 300 and fit.rank == 5 and list(fit.b)[1:] == pytest.approx(want[1:], rel=1e-6)
        assert fit.sse == pytest.approx(((y - np.column_stack([np.ones(300), x]) @ want) ** 2).sum(), rel=1e-6)
    # A column that depends on others has no coefficient; the fit is that of the others.
    twice = df.withColumn("x4", F.col("x1") + F.col("x2")).withColumn("x5", F.lit(7.0))
    fit = regress.solved(regress.gram(twice, F.col("y"), [*columns[:3], F.col("x4"), F.col("x5"), columns[3]], [])).first()
    assert fit.rank == 5 and fit.b[4] is None and fit.b[5] is None and fit.b[6] == pytest.approx(want[4], rel=1e-6)
    q = regress.quality(df, F.col("y"), columns).first()
    assert q.r2 == pytest.approx(1 - fit.sse / ((y - y.mean()) ** 2).sum(), rel=1e-6) and q.rank == 5


def test_clusters_are_numbered_by_their_centres(spark):
    from tidewright.operators import cluster

    rows = spark.createDataFrame([(i, float(i % 3) * 10 + i / 100) for i in range(30)], "idx int, v double")
    members = spark.createDataFrame([(i, (2, 0, 1)[i % 3]) for i in range(30)], "idx int, cluster int")
    numbered = cluster.by_centre(members, rows, ["idx"], "v")
    assert all(r.cluster == r.idx % 3 for r in numbered.collect())
    both = numbered.join(members.withColumnRenamed("cluster", "other"), "idx")
    assert sorted((r.a, r.b, r.n, round(r.share, 6)) for r in cluster.agreement(both, "cluster", "other").collect()) == [(0, 2, 10, 0.333333), (1, 0, 10, 0.333333), (2, 1, 10, 0.333333)]


def test_chunks_get_noisier(spark):
    rows = spark.range(12).select(waveforms.falling_ratio(14.0, F.col("id")).alias("snr")).collect()
    assert [r.snr for r in rows] == [14, 9, 4, -1, -1, -1, -1, -1, -1, -1, -1, -1]


def test_images_change_their_format(spark, tmp_path):
    rng = np.random.default_rng(1)
    planes = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    given = spark.createDataFrame([("alpha", 5, 7, 4, planes.tobytes()), ("grey", 5, 7, 1, planes[:, :, 0].tobytes())], "name string, height int, width int, channels int, data binary")
    for r in images.converted(given).collect():
        (tmp_path / f"{r.name}.png").write_bytes(bytes(r.content))
    got = {r.name: images.rgb(bytes(r.data), r.height, r.width, r.channels) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert (got["alpha"] == planes[:, :, 2::-1]).all() and (got["grey"] == planes[:, :, :1]).all()
    plain = images.image_histograms(images.plain_images(spark)).collect()
    assert {(r.name, r.value) for r in plain if r.share == 1} >= {("white", 255), ("black", 1)}
