"""What only large tables bring out: filters that fill up, shares that round to nothing, wide ids, many rows of a key."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import intrusion, packets, regress, waveforms
from tidewright.plans import catalogue


def same_as_sql(spark, name, folder, tables):
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    got = sorted((tuple(r[n] for n in names) for r in catalogue.QUERIES[name](spark, str(folder)).collect()), key=str)
    assert got == sorted((tuple(r) for r in found.fetchall()), key=str)


def test_bloom_bounds_with_more_items_than_a_fixed_filter_holds(spark, tmp_path):
    spark.range(1_000_000).select(F.col("id").alias("o_orderkey"), (F.col("id") / 100 + 1).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    same_as_sql(spark, "bloom_bounds", tmp_path, ["orders"])
    bits = packets.bloom_bits(1000, 0.05, 4)
    assert (1 - np.exp(-4 * 1000 / bits)) ** 4 == pytest.approx(0.05, rel=0.01)


def test_bloom_members_are_exact_in_a_full_filter(spark):
    items, asked = spark.range(0, 2000, 2).withColumnRenamed("id", "item"), spark.range(2000).withColumnRenamed("id", "item")
    loose = packets.bloom_check(asked, "item", packets.bloom(items, "item", 1 << 11, 3), 1 << 11, 3)
    assert loose.filter("member and item % 2 = 1").count() > 100
    sure = {r.item: r.member for r in packets.bloom_members(asked, items, "item", 1 << 11, 3).collect()}
    assert sure == {i: i % 2 == 0 for i in range(2000)}


def test_histogram_anomaly_of_a_share_that_rounds_to_nothing(spark, tmp_path):
    rates = spark.createDataFrame([("a", 2, 0.0), ("b", 0, 0.0), ("c", 1, 1.0), ("d", 1, None)], "key string, n long, rate double")
    none = spark.createDataFrame([], "key string, bin int, n long")
    p = {r.key: r.p_n for r in regress.histogram_anomaly(none, none, rates).collect()}
    assert (p["a"], p["b"], p["d"]) == (0.0, 1.0, None) and p["c"] == pytest.approx(np.exp(-1))
    # The first user has one of 210 000 packets of the first half.
    first, second = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 20)
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    at = F.timestamp_micros(F.when(F.col("id") < 210_000, F.lit(micros(first)) + F.col("id") * 1000).otherwise(F.lit(micros(second)) + F.col("id") * 1000))
    user = F.when(F.col("id").isin(7, 210_007, 210_008), 0).otherwise(F.col("id") % 50 + 1).cast("long")
    spark.range(210_500).select(F.col("id").alias("event_id"), at.alias("ts"), user.alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, "histogram_anomaly", tmp_path, ["events"])


def test_packet_classifiers_of_users_with_more_digits(spark, tmp_path):
    user = F.when(F.col("id") % 3 == 0, F.col("id") * 1000).otherwise(F.col("id") % 9)
    spark.range(600).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.when(F.col("id") != 5, user).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    r = catalogue.QUERIES["packet_classifiers"](spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].id == "view" and r[0].tn + r[0].fp > 30


def test_a_key_is_scored_in_parts(spark, monkeypatch):
    monkeypatch.setattr(intrusion, "PART_ROWS", 10)
    x = np.random.default_rng(0).uniform(size=(95, 3))
    rows = spark.createDataFrame([("a" if i < 90 else "b", i, v.tolist(), i % 2) for i, v in enumerate(x)], "id string, row long, features array<double>, y int")
    model = intrusion.Classifier(3)
    models = spark.createDataFrame([("a", model.to_bytes())], "key string, model binary")
    found = intrusion.scored(rows, models, "id")
    assert found.columns == ["id", "row", "features", "y", "key", "score", "predicted"]
    got = {r.row: (r.score, r.predicted) for r in found.collect()}
    want = model.scores(x[:90])[:, 1]
    assert sorted(got) == list(range(90)) and [got[i][0] for i in range(90)] == pytest.approx(want) and all(got[i][1] == (want[i] >= 0.5) for i in range(90))


def test_signals_in_batches_are_those_of_the_expressions(spark):
    stream = spark.createDataFrame([("s" if i % 3 else "t", i, [i % 9, (i * 5) % 9, 6]) for i in range(60)], "series string, idx long, codes array<int>")
    for bitrate, slope in ((1e6, 0.3), (125e3, 0.5)):
        made = waveforms.signals(stream, bitrate=bitrate, slope=slope, snr=12.0, seed=5, distorted=0.3, snr_distorted=1.0)
        ratio = F.when(F.col("y") == waveforms.DISTORTED, 1.0).otherwise(12.0)
        plain = waveforms.noisy(waveforms.pure_wave(F.col("code"), waveforms.samples_of(16e6, bitrate), slope), ratio, F.lit(5), F.col("series"), F.col("idx"), F.col("pos"))
        rows = made.withColumn("plain", plain).withColumn("h", waveforms.wave_histogram(F.col("plain"))).collect()
        assert len(rows) == 180 and 20 < sum(r.y == waveforms.DISTORTED for r in rows) < 90
        for r in rows:
            assert r.wave == pytest.approx(r.plain, rel=1e-14) and r.histogram == r.h


def test_rows_with_equal_features_are_learned_in_their_share(spark, monkeypatch):
    monkeypatch.setattr(intrusion, "PART_ROWS", 50)
    # Three features only, each with its label: by the features' hashes alone a small bound takes all rows of one or none.
    rows = [(c, [float(k == j) for j in range(3)], k, i) for c in range(3) for i in range(900) for k in (i % 3,)]
    df = spark.createDataFrame(rows, "chunk int, features array<double>, y int, row int")
    r = intrusion.trained_in_turn(df, 40, 3, rows=90).first()
    assert (r.chunks, r.n, r.accuracy) == (3, 900, 1.0)
    mixed = df.withColumn("y", F.when((F.col("chunk") == 2) & (F.col("row") < 90), (F.col("y") + 1) % 3).otherwise(F.col("y")))
    assert intrusion.trained_in_turn(mixed, 40, 3, rows=90).first().accuracy == pytest.approx(0.9)


def test_a_classifier_learns_all_rows_of_a_key(spark):
    x = np.round(np.random.default_rng(1).uniform(size=(450, 4)), 3)
    rows = [("a" if i < 400 else "b", i, v.tolist(), int(v[0] > 0.5)) for i, v in enumerate(x)]
    parts = intrusion.split(spark.createDataFrame(rows, "id string, row long, features array<double>, y int"), "id", "row").withColumn("train", F.lit(True)).persist()
    learn = lambda df, n: {r.key: intrusion.Classifier.from_bytes(r.model) for r in intrusion.trained(df, "id", epochs=12, rows=100 if n else 1000).collect()}
    whole, places = learn(parts, True), sorted((r.at, r.row) for r in parts.filter("id = 'a'").collect())
    # A bound of 100 rows would not reach the last place.
    less = learn(parts.filter(F.col("row") != places[-1][1]), True)
    assert np.abs(whole["a"].w[0] - less["a"].w[0]).max() > 1e-6 and (whole["b"].w[0] == less["b"].w[0]).all()
    # A key of one part, beside one of four and alone: plain learning in the order of places.
    order = [r.row for r in parts.filter("id = 'b'").orderBy("at").collect()]
    direct = intrusion.Classifier(4).fit(x[order], (x[order, 0] > 0.5).astype(int), 12)
    for models in (whole, learn(parts, False)):
        assert all(a == pytest.approx(b) for a, b in zip(models["b"].w, direct.w, strict=True))
    every = intrusion.Classifier(4).fit(x[[i for _, i in places]], (x[[i for _, i in places], 0] > 0.5).astype(int), 12)
    assert all(a == pytest.approx(b) for a, b in zip(learn(parts, False)["a"].w, every.w, strict=True))


def test_bits_of_users_of_any_sign(spark, tmp_path, monkeypatch):
    users = [0, 5, 65_535, 65_536, None, -1, -(1 << 63), (1 << 63) - 1]
    spark.createDataFrame([(i, "view", u) for i, u in enumerate(users)], "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(intrusion, "with_intrusions", lambda rows, *a: seen.append(rows) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        catalogue.QUERIES["packet_classifiers"](spark, str(tmp_path))
    got = {r.event_id: "".join(str(int(b)) for b in r.features) for r in seen[0].collect()}
    assert got == {i: f"{(u or 0) % (1 << 64):064b}" for i, u in enumerate(users)}


def test_a_classifier_learns_all_rows_of_its_chunks(spark):
    x = np.round(np.random.default_rng(2).uniform(size=(600, 4)), 3)
    rows = [(int(i >= 400), i, v.tolist(), int(v[0] > 0.5)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "chunk int, row int, features array<double>, y int")
    last = df.filter("chunk = 0").orderBy(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 52)).desc()).first().row
    whole, less = (intrusion.trained_in_turn(d, 3, 2, rows=100).first() for d in (df, df.filter(F.col("row") != last)))
    # A bound of 100 rows would not reach the last one.
    assert (whole.chunks, whole.n) == (2, 200) == (less.chunks, less.n)
    a, b = (intrusion.Classifier.from_bytes(r.model) for r in (whole, less))
    assert np.abs(a.w[0] - b.w[0]).max() > 1e-6
    assert whole.accuracy == pytest.approx((a.scores(x[400:]).argmax(1) == (x[400:, 0] > 0.5)).mean())
    one = intrusion.trained_in_turn(df.filter("chunk = 1"), 2, 2).first()
    assert (one.chunks, one.n) == (1, 200)
    nothing = df.limit(0)
    assert intrusion.trained_in_turn(nothing, 2, 2).collect() == []
    assert intrusion.trained(intrusion.split(nothing, "chunk", "row"), "chunk").collect() == []
