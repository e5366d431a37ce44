"""The command lines, one for each kind of work: each reads CSV files, dumps or image folders and writes tables under a folder.

    python -m tidewright QUERY --tables FOLDER          a query of the catalogue over Parquet tables
    python -m tidewright KIND ...                       one of KINDS below, with options of its own
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import scalars
from tidewright.operators import aggregates, cluster, forecast, hmm, images, intrusion, networks, orders, packets, regress, spectra, states, unitroots, waveforms, windows
from tidewright.sources import series, store
from tidewright.streaming import live, loop

PATTERN = "dd.MM.yyyy HH:mm"


def names(text: str) -> list[str]:
    """Comma-separated names; an empty text has none."""
    return [x.strip() for x in text.split(",") if x.strip()]


def _series(spark: SparkSession, a: argparse.Namespace, columns: list[str]) -> DataFrame:
    return series.indexed(series.read_csv(spark, a.csv_dataset, a.timestamp, columns, a.pattern))


def _wide(spark: SparkSession, a: argparse.Namespace, columns: list[str]) -> DataFrame:
    """(series, idx, ts, one column for each name), rows where all of them are numbers."""
    raw = spark.read.csv(a.csv_dataset, header=True)
    parts = [F.col(f"`{c}`").try_cast("double").alias(c) for c in columns]
    rows = raw.select(F.lit("all").alias("series"), F.try_to_timestamp(F.col(f"`{a.timestamp}`"), F.lit(a.pattern)).alias("ts"), *parts).dropna()
    return series.indexed(rows)


def _write(df: DataFrame, a: argparse.Namespace, name: str) -> None:
    df.write.mode("overwrite").format(a.format).options(header=True).save(f"{a.out}/{name}")


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, so that CSV can hold them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def offline(spark: SparkSession, a: argparse.Namespace) -> None:
    """Models on windows of a series, one-step errors by split, and forecasts; hmofflp does it for the given hours only."""
    rows = _series(spark, a, [a.endogen])
    if a.mode == "hmofflp":
        hours = [int(h) for h in names(a.hours)]
        rows = series.indexed(rows.filter(F.hour("ts").isin(hours) & (F.minute("ts") == a.minute)).withColumn("series", F.concat_ws("|", "series", F.hour("ts"))).drop("idx"))
    parts = scalars.chronological(rows, a.eval, a.test)
    _write(unitroots.stationarity(rows), a, "stationarity")
    _write(spectra.welch(rows), a, "psd")
    train = parts.filter("split = 'train'").select("series", "idx", "value")
    models = networks.trained(train, tuple(names(a.models)), a.n_step, a.epochs)
    store.Store(spark, f"{a.out}/models").save_rows("model", models.withColumn("name", F.concat_ws("/", "series", "model")), "name", "content")
    _write(networks.forecasts(rows.select("series", "idx", "value"), models, a.num_predicts), a, "forecasts")
    errors = windows.supervised(scalars.scaled_on_train(parts), a.n_step, "scaled").withColumn("e", F.col("y") - F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / a.n_step)
    _write(errors.groupBy("series", "split").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.max(F.abs("e")).alias("max_abs")), a, "baseline")


def arima(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best order by AIC on the last chunk of a series, errors within the sample, and a forecast."""
    rows = windows.last_n(_series(spark, a, [a.endogen]), a.chunk)
    rows = series.indexed(rows.drop("idx"))
    if a.season:
        _write(forecast.seasonal_orders(rows, a.season, (a.p_max, a.d_max, a.q_max), (a.P_max, a.D_max, a.Q_max)), a, "orders")
    else:
        _write(forecast.order_grid(rows, max(a.p_max, a.q_max), a.d_max), a, "orders")
    if a.search == "steps":
        needed = unitroots.differences(rows, a.season if a.D_max else 0, most=a.d_max)
        tried = orders.search(rows, a.season, (a.p_max, a.q_max, a.P_max, a.Q_max), needed)
        _write(tried, a, "search")
        best = tried.filter("chosen")
    elif a.season:
        best = spark.read.format(a.format).options(header=True, inferSchema=True).load(f"{a.out}/orders").filter("chosen")
    else:
        best = forecast.best_orders(forecast.order_grid(rows, max(a.p_max, a.q_max), a.d_max)).selectExpr("series", "p", "d", "q", "0 AS sp", "0 AS sd", "0 AS sq")
    errors = orders.errors_inside(rows, best, a.season)
    _write(errors, a, "errors")
    _write(orders.error_summary(errors), a, "error_summary")
    _write(orders.forecasts(rows, best, a.season, a.out_sample), a, "forecasts")


def clusters(spark: SparkSession, a: argparse.Namespace) -> None:
    """Blocks of a series, their principal components, clusters and mean blocks; their costs for each number of clusters."""
    rows = _series(spark, a, [a.tsname])
    n = rows.count()
    blocks = cluster.series_blocks(rows, a.block_size, share=min(1.0, a.num_block / max(1, n - a.block_size)))
    pcs, _ = cluster.principal(cluster.centred_columns(blocks))
    members = cluster.kmeans_members(pcs, "pcs", a.num_clusters, ["series", "start"])
    _write(members, a, "members")
    _write(cluster.cluster_profiles(blocks, members, ["series", "start"]), a, "profiles")
    _write(cluster.kmeans_costs(pcs, "pcs", range(1, a.num_clusters + 1)), a, "costs")


def labels(spark: SparkSession, a: argparse.Namespace) -> None:
    """ddbld: labels from five clusterings of the columns, their codes and centres. stcls: a classifier on given labels, its predictions."""
    columns = [a.endogen, *names(a.exogen)]
    rows = _wide(spark, a, [*columns, *names(a.label)])
    if a.mode == "stcls":
        label = names(a.label)[0]
        vectors = cluster.array_to_vector(F.array(*columns))
        ready = rows.withColumns({"features": vectors, "label": F.col(label).cast("int")})
        n = ready.agg(F.max("idx") + 1, F.max("label") + 1).first()
        cut = int(n[0] * 0.9)
        found = cluster.classified(ready.filter(F.col("idx") < cut), ready.filter(F.col("idx") >= cut), [len(columns), 48, 48, 48, 48, int(n[1])])
        _write(found.select("idx", "label", F.col("prediction").cast("int").alias("prediction")), a, "predictions")
        return
    coded = labelled(rows, columns, 2)
    _write(coded, a, "labels")
    _write(cluster_centres(coded, columns), a, "centres")


def labelled(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """rows with five clusterings (all columns, components, standardised, min-max, exogenous), their combined code and its dense number.

    The clusters of each are numbered by the mean of the first column, so that their numbers can be compared.
    """
    from tidewright.operators import cleaning

    scale = {"all": columns, "pca": columns, "standard": columns, "minmax": columns, "exog": columns[1:] or columns}
    stats = rows.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop), ("a", F.min), ("b", F.max))])
    wide = rows.join(F.broadcast(stats))  # one row
    value = {
        "standard": lambda c, i: F.coalesce(F.try_divide(F.col(c) - F.col(f"m{i}"), F.col(f"s{i}")), F.lit(0.0)),
        "minmax": lambda c, i: F.coalesce(F.try_divide(F.col(c) - F.col(f"a{i}"), F.col(f"b{i}") - F.col(f"a{i}")), F.lit(0.0)),
    }
    out = rows
    for name, used in scale.items():
        data = F.array(*[value.get(name, lambda c, i: F.col(c))(c, columns.index(c)) for c in used])
        vectors = cluster.centred_columns(wide.select("idx", data.alias("data")))
        if name == "pca":
            vectors = cluster.principal(vectors, 0.99)[0].withColumn("centred", F.col("pcs"))
        members = cluster.by_centre(cluster.kmeans_members(vectors, "centred", k, ["idx"]), rows, ["idx"], columns[0])
        out = out.join(members.withColumnRenamed("cluster", name), "idx")
    code = cleaning.combined_code(*[F.col(n) for n in ("all", "pca", "standard", "minmax", "exog")])
    return cleaning.dense_codes(out.withColumn("code", code), "code", "desired")


def cluster_centres(coded: DataFrame, columns: list[str]) -> DataFrame:
    from tidewright.operators import cleaning

    return cleaning.label_centres(coded, "desired", columns)


def analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Properties, histograms, correlations and spectra of series, and their abrupt states, by the sides asked for."""
    sides = {**dict.fromkeys(names(a.two_sides), "all"), **dict.fromkeys(names(a.one_side_upper), "upper"), **dict.fromkeys(names(a.one_side_lower), "lower")}
    columns = list(dict.fromkeys([a.tsname, *names(a.extra_ts), *sides]))
    rows = _series(spark, a, columns)
    _write(aggregates.scalar_properties(rows), a, "properties")
    _write(aggregates.histogram(rows), a, "histograms")
    _write(windows.pearson_all_lags(rows, 512), a, "autocorrelation")
    _write(spectra.periodogram(rows, 1 / (60 * a.discret)), a, "periodogram")
    for name in columns:
        marked = states.abrupt_states(rows.filter(F.col("series") == name), a.abrupt_level, sides.get(name, a.abrupt_type))
        _write(windows.longest_runs(windows.runs(marked)), a, f"runs/{name}")
        _write(states.rates(marked, a.discret), a, f"rates/{name}")


def matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    """A series as periods by slots (X) or slots by periods (Y), scaled if asked for, and its margins."""
    rows = _series(spark, a, [a.ts])
    if a.scale != "NO":
        rows = scalars.scaled(rows).withColumn("value", F.col({"CENTER": "center", "STANDARD": "standard", "MINMAX": "minmax", "MAXABS": "maxabs"}[a.scale.upper()]))
    n = rows.count()
    if n % a.period:
        raise SystemExit(f"{n} rows are no whole number of periods of {a.period}")
    cells = rows.select(F.floor(F.col("idx") / a.period).alias("period"), F.pmod("idx", F.lit(a.period)).alias("slot"), "value")
    row, column, many = ("period", "slot", a.period) if a.direction == "X" else ("slot", "period", n // a.period)
    _write(aggregates.pivoted(cells, row, column, list(range(many))), a, "matrix")
    _write(aggregates.margins(cells, row, column), a, "margins")


def regression(spark: SparkSession, a: argparse.Namespace) -> None:
    """Least squares of a column on others; with categories, planes of their own against one for all, and the decision between them."""
    xs = names(a.exogen)
    raw = spark.read.csv(a.csv_dataset, header=True)
    rows = raw.select(*[F.col(f"`{c}`").try_cast("double").alias(n) for c, n in ((a.endogen, "y"), *((c, f"x{i}") for i, c in enumerate(xs, 1)))], *([F.col(f"`{a.category}`").alias("category")] if a.category else []))
    columns = [f"x{i}" for i in range(1, len(xs) + 1)]
    clean, x = rows.dropna(subset=["y", *columns]), [F.col(c) for c in columns]
    found = regress.quality(clean, F.col("y"), x)
    _write(found.select("n", "rank", *[F.get("b", F.lit(i)).alias(f"b{i}") for i in range(len(x) + 1)], "r2", "sigma2", "mean_abs", "max_abs", "f"), a, "quality")
    if a.category:
        if not regress.shapes(rows, columns, "y", "category").first()["valid"]:
            raise SystemExit("a category lacks values")
        _write(regress.decision(regress.anova(clean, F.col("y"), x, "category")), a, "anova")
        _write(regress.predicted(clean, F.col("y"), x, "category"), a, "predictions")


def _dump(spark: SparkSession, a: argparse.Namespace, offset: int, size: int) -> DataFrame:
    """Packets of a range of lines: (series, idx, id, data, bits, packet, ts, event_id)."""
    lines = store.line_range(spark, a.dump, offset, size)
    part = lambda i: F.regexp_extract("value", packets.LINE, i)
    rows = lines.filter(F.col("value").rlike(packets.LINE)).select("line", part(1).cast("decimal(20,6)").alias("s"), part(3).alias("id"), part(4).alias("raw"))
    data = F.when(F.length("raw") % 2 == 1, F.concat(F.lit("0"), "raw")).otherwise(F.col("raw"))
    made = rows.select(F.lit("dump").alias("series"), F.col("line").alias("event_id"), F.timestamp_micros((F.col("s") * 1000000).cast("long")).alias("ts"), "id", data.alias("data"))
    ready = made.withColumns({"packet": F.concat("id", "data"), "bits": packets.bits(F.col("data"))})
    return series.indexed(ready, ("event_id",), bucket=F.floor(F.col("event_id") / 65536))


def physical(spark: SparkSession, a: argparse.Namespace) -> None:
    """train: fingerprints of waves to a Bloom filter. test: packets with transitions that it doesn't know.

    With --chunks the lines come in so many chunks (8 at most to train, 10 to test), and in a test each chunk has 5 dB more noise than the one before.
    """
    start, size = (0, a.train_size) if a.mode == "train" else (a.train_size, a.test_size)
    if a.chunks:
        size = a.chunk * min(a.chunks, waveforms.CHUNKS[a.mode])
    dump = _dump(spark, a, start, size)
    falling = waveforms.falling_ratio(a.snr, F.floor((F.col("event_id") - start) / a.chunk)) if a.chunks and a.mode == "test" else F.lit(a.snr)
    stream = packets.stream_transitions(dump.withColumn("snr", falling)).join(dump.select("series", "idx", falling.alias("snr")), ["series", "idx"])
    waves = waveforms.signals(stream, a.fsample * 1e6, a.bitrate * 1e3, a.slope, F.col("snr"), seed=start)
    if a.mode == "train":
        bits, k = waveforms.filter_size(a.bf_size, a.bf_prob)
        store.save_filter(packets.bloom(waveforms.trained_words(waves), "item", bits, k), f"{a.out}/filter", bits, k)
    else:
        bitmaps, bits, k = store.load_filter(spark, f"{a.out}/filter")
        _write(waveforms.unknown_transitions(waves, bitmaps, bits, k), a, "anomalies")


def frequency(spark: SparkSession, a: argparse.Namespace) -> None:
    """train: shares and gaps of packets by key, their rates. test: keys whose histogram of gaps, or rate, differs."""
    key = {"ID": "id", "Packet": "packet", "Data": "data"}[a.matched_key]
    part = lambda start, size: _dump(spark, a, start, size).withColumn("key", F.col(key))
    train = part(0, a.train_size)
    if a.mode == "train":
        _write(packets.gap_statistics(train), a, "gaps")
        return
    test = part(a.train_size, a.test_size)
    gap = lambda p: packets.gaps(p).filter("gap is not null")
    if a.method == "mle":
        rates = [regress.exponential_rates(gap(p), 3) for p in (train, test)]
        _write(regress.gap_divergence(*rates), a, "anomalies")
        return
    first = test.agg(F.min("ts").alias("_start"), (F.count("*") + 1).alias("_total"))
    offsets = test.join(F.broadcast(first)).select("key", ((F.unix_micros("ts") - F.unix_micros("_start")) / 1e6).alias("gap"), "_total")  # one row
    seen = offsets.groupBy("key", "_total").agg(F.count("*").alias("n"))
    rates = seen.join(packets.gap_statistics(train).select("key", "prob"), "key").select("key", "n", (F.col("prob") * F.col("_total")).alias("rate"))
    _write(regress.histogram_anomaly(packets.gap_histogram(train), packets.histogram(offsets), rates), a, "anomalies")


def detectors(spark: SparkSession, a: argparse.Namespace) -> None:
    """dset: features of packets by id with intrusions. train: a classifier for each id. test: its scores on rows that it didn't learn."""
    if a.mode == "dset":
        shares = packets.bit_features(_dump(spark, a, 0, a.train_size), a.chunk)
        each = shares.groupBy("id", "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "prb"))), lambda x: x["prb"]).alias("found"))
        rows = each.select("id", F.concat_ws(":", "id", "chunk").alias("row"), F.concat("found", F.array_repeat(F.lit(0.0), F.lit(64) - F.size("found"))).alias("features"))
        marked = intrusion.with_intrusions(rows.filter(~F.col("id").isin(names(a.exclude))), a.share, "row")
        marked.write.mode("overwrite").parquet(f"{a.out}/sets")
        return
    rows = intrusion.split(spark.read.parquet(f"{a.out}/sets").withColumn("key_", F.concat_ws("|", "row", "y")), "id", "key_")
    kept = store.Store(spark, f"{a.out}/models")
    if a.mode == "train":
        kept.save_rows("ids", intrusion.trained(rows, "id", epochs=a.epochs), "key", "model")
    else:
        models = kept.table("ids").select(F.col("name").alias("key"), F.col("content").alias("model"))
        _write(intrusion.binary_confusion(intrusion.scored(rows.filter("not train"), models, "id"), "id"), a, "confusion")


def markov(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sign states of a series: their model, and how well it decodes them."""
    rows = states.centred(_series(spark, a, [a.tsname]))
    codes = [-1, 0, 1]
    model = hmm.parameters(rows, codes)
    _write(_flat(model), a, "model")
    for r in model.collect():  # one small row for each series asked for
        store.Store(spark, f"{a.out}/models").save("hmm", r["series"], hmm.to_fields(r["start"], [list(x) for x in r["moves"]], r["mean"], r["std"], codes))
    from tidewright.operators import cleaning

    found = hmm.decoded(rows, codes)
    _write(found, a, "states")
    _write(cleaning.mismatches(found, F.col("viterbi"), F.col("state")), a, "mismatches")
    _write(hmm.log_likelihood(rows, model), a, "likelihood")


def pictures(spark: SparkSession, a: argparse.Namespace) -> None:
    """Features of the images of a folder, and their clusters."""
    rows = images.image_features(images.read_images(spark, a.images), a.order)
    _write(rows, a, "features")
    vectors = cluster.centred_columns(spark.read.format(a.format).options(header=True, inferSchema=True).load(f"{a.out}/features").withColumn("data", F.array(*images.FEATURES)))
    _write(cluster.kmeans_members(vectors, "centred", a.num_clusters, ["name"]), a, "clusters")


def auto(spark: SparkSession, a: argparse.Namespace) -> None:
    """Polls a service of widgets, and trains and forecasts as samples come, until it is stopped; a later run with the same folder goes on."""
    first = a.start or (dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0) - dt.timedelta(days=loop.FIRST_DAYS)).isoformat()
    controller = live.Controller(a.seconds, a.keep, a.num_predicts, a.n_step, a.every, a.attempts)
    live.run(live.start(spark, a.url, a.out, first, a.seconds, controller, attempts=str(a.attempts)), a.batches)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Trains the configured models on a column of a CSV file and keeps them."""
    rows = _series(spark, a, [a.tsname]).select("series", "idx", "value")
    _write(networks.trained(rows, tuple(names(a.models)), a.n_step, a.epochs), a, "models")


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """Forecasts of a column of a CSV file by the models that train kept in the same folder, with their times."""
    rows = _series(spark, a, [a.tsname])
    found = networks.forecasts(rows.select("series", "idx", "value"), spark.read.parquet(f"{a.out}/models"), a.num_predicts)
    _write(forecast.bundle(found, rows.groupBy("series").agg(F.max("ts").alias("last_ts")), a.discret), a, "forecasts")


def control(spark: SparkSession, a: argparse.Namespace) -> None:
    """Does nothing, as in the surveyed program."""


CSV = (("-c", "--csv_dataset", {"required": True}), (None, "--timestamp", {"default": "Date Time"}), (None, "--pattern", {"default": PATTERN}))
DUMP = (("-d", "--dump", {"required": True}), ("-S", "--train_size", {"type": int, "default": 1024}), ("-s", "--test_size", {"type": int, "default": 512}), ("-c", "--chunk", {"type": int, "default": 32}))


def _int(short: str | None, long: str, default: int) -> tuple:
    return short, long, {"type": int, "default": default}


#: The command lines: what runs, and its options as (short, long, settings).
KINDS: dict[str, tuple[Callable, tuple]] = {
    "auto": (auto, (("-u", "--url", {"required": True}), ("-s", "--start", {"default": ""}), (None, "--seconds", {"type": float, "default": 60.0 * loop.MINUTES}), _int("-k", "--keep", 512), _int("-p", "--num_predicts", 4), _int("-n", "--n_step", 6), _int(None, "--every", loop.RETRAIN), _int(None, "--attempts", loop.ATTEMPTS), (None, "--batches", {"type": int}))),
    "train": (train, (*CSV, ("-t", "--tsname", {"default": "Imbalance"}), _int("-n", "--n_step", 32), _int(None, "--epochs", 10), (None, "--models", {"default": ",".join(networks.MODELS)}))),
    "predict": (predict, (*CSV, ("-t", "--tsname", {"default": "Imbalance"}), _int("-p", "--num_predicts", 4), _int("-d", "--discret", 10))),
    "control": (control, ()),
    "offline": (offline, (*CSV, ("-m", "--mode", {"default": "offlp", "choices": ("offlp", "hmofflp")}), ("-t", "--endogen", {"required": True}), _int("-n", "--n_step", 32), _int("-p", "--num_predicts", 4), _int("-s", "--test", 32), _int("-e", "--eval", 256), (None, "--hours", {"default": "7,19"}), _int(None, "--minute", 0), _int(None, "--epochs", 10), (None, "--models", {"default": ",".join(networks.MODELS)}))),
    "arima": (arima, (*CSV, ("-o", "--endogen", {"required": True}), _int("-u", "--chunk", 512), _int("-f", "--out_sample", 4), _int("-p", "--p_max", 4), _int("-d", "--d_max", 2), _int("-q", "--q_max", 2), _int("-P", "--P_max", 2), _int("-D", "--D_max", 0), _int("-Q", "--Q_max", 1), _int("-S", "--season", 0), (None, "--search", {"default": "grid", "choices": ("grid", "steps")}))),
    "clusters": (clusters, (*CSV, ("-t", "--tsname", {"default": "Imbalance"}), _int("-b", "--block_size", 144), _int("-n", "--num_block", 500), _int("-l", "--num_clusters", 3))),
    "labels": (labels, (*CSV, ("-m", "--mode", {"default": "stcls", "choices": ("stcls", "ddbld")}), ("-t", "--endogen", {"default": "Imbalance"}), ("-x", "--exogen", {"default": ""}), ("-l", "--label", {"default": ""}))),
    "analyse": (analyse, (*CSV, ("-t", "--tsname", {"default": "Imbalance"}), ("-x", "--extra_ts", {"default": ""}), ("-u", "--one_side_upper", {"default": ""}), ("-l", "--one_side_lower", {"default": ""}), ("-w", "--two_sides", {"default": ""}), ("-b", "--abrupt_type", {"default": "upper", "choices": ("all", "upper", "lower")}), ("-r", "--abrupt_level", {"type": float, "default": 0.9}), _int("-d", "--discret", 10))),
    "matrix": (matrix, (*CSV, ("-t", "--ts", {"required": True}), ("-r", "--direction", {"default": "X", "choices": ("X", "Y")}), _int("-p", "--period", 144), ("-s", "--scale", {"default": "NO"}))),
    "regression": (regression, (("-c", "--csv_dataset", {"required": True}), ("-e", "--endogen", {"required": True}), ("-x", "--exogen", {"required": True}), (None, "--category", {"default": ""}))),
    "physical": (physical, (*DUMP, ("-m", "--mode", {"default": "train", "choices": ("train", "test")}), ("-f", "--fsample", {"type": float, "default": 16.0}), ("-b", "--bitrate", {"type": float, "default": 256.0}), ("-R", "--snr", {"type": float, "default": 40.0}), ("-p", "--slope", {"type": float, "default": 0.3}), _int(None, "--bf_size", 2048), (None, "--bf_prob", {"type": float, "default": 0.05}), _int(None, "--chunks", 0))),
    "frequency": (frequency, (*DUMP, ("-m", "--mode", {"default": "train", "choices": ("train", "test")}), ("-M", "--method", {"default": "ppd", "choices": ("ppd", "mle")}), ("-k", "--matched_key", {"default": "ID", "choices": ("ID", "Packet", "Data")}))),
    "detectors": (detectors, (*DUMP, ("-m", "--mode", {"default": "dset", "choices": ("dset", "train", "test")}), _int("-e", "--epochs", 10), (None, "--exclude", {"default": ""}), (None, "--share", {"type": float, "default": 0.1}))),
    "markov": (markov, (*CSV, ("-t", "--tsname", {"default": "Imbalance"}))),
    "pictures": (pictures, (("-i", "--images", {"required": True}), _int(None, "--order", 2), _int("-l", "--num_clusters", 3))),
}


def parser() -> argparse.ArgumentParser:
    from tidewright.plans import catalogue

    top = argparse.ArgumentParser(prog="tidewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = top.add_subparsers(dest="kind", required=True)
    for kind, (run, options) in KINDS.items():
        sub = kinds.add_parser(kind, help=run.__doc__, description=run.__doc__)
        for short, long, settings in options:
            sub.add_argument(*([short] if short else []), long, **settings)
        sub.add_argument("--out", required=True, help="folder to write")
        sub.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    for name in sorted(catalogue.QUERIES):
        sub = kinds.add_parser(name)
        sub.add_argument("--tables", required=True, help="folder of the Parquet tables")
        sub.add_argument("--out", help="folder to write; rows are shown if there is none")
        sub.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    return top


def main(argv: list[str] | None = None) -> None:
    from tidewright.plans import catalogue

    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.unionOutputPartitioning", "false").getOrCreate()
    if a.kind in KINDS:
        KINDS[a.kind][0](spark, a)
        return
    rows = catalogue.QUERIES[a.kind](spark, a.tables)
    if a.out:
        rows.write.mode("overwrite").format(a.format).options(header=True).save(a.out)
    else:
        rows.show(truncate=False)
