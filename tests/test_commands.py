"""Every command line runs on small files and writes its tables."""

import math
import random
import struct
import zlib

import pytest

from tidewright.__main__ import main
from tidewright.commands import KINDS, names


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("commands"), random.Random(0)
    lines = ["Date Time,Imbalance,Wind,Hydro,Label"]
    for i in range(6 * 144):
        day, minute = divmod(i, 144)
        wave = math.sin(i / 23) * 4 + rng.random()
        lines.append(f"{day + 1:02d}.03.2021 {minute // 6:02d}:{minute % 6 * 10:02d},{wave:.2f},{abs(wave) + rng.random():.2f},{rng.random() - 0.5:.2f},{int(wave > 2)}")
    (folder / "a.csv").write_text("\n".join(lines) + "\n")
    ids = ["0A1", "7FF", "123"]
    dump, t = [], 100.0
    for i in range(3000):
        t += rng.expovariate(50)
        dump.append(f"({t:.6f}) can0 {ids[i % 3]}#{rng.randrange(1 << 64):016X}")
    (folder / "dump.log").write_text("\n".join(dump) + "\n")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    (folder / "pictures").mkdir()
    for k in range(4):
        raw = b"".join(b"\0" + bytes(rng.randrange(60 * k, 60 * k + 60) for _ in range(3 * 24)) for _ in range(20))
        (folder / "pictures" / f"p{k}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 24, 20, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    return folder


RUNS = [
    ("offline", "-t Imbalance --models mlp_1,best_arima --epochs 1 -e 100", ["forecasts", "baseline", "psd"]),
    ("offline", "-m hmofflp -t Imbalance --models best_arima -n 2 -s 1 -e 1 --hours 7,19", ["forecasts"]),
    ("arima", "-o Imbalance -p 1 -q 1 -d 1 -u 200", ["orders", "forecasts"]),
    ("arima", "-o Imbalance -p 1 -q 1 -d 1 -P 1 -S 6 -u 200", ["orders", "errors", "error_summary", "forecasts"]),
    ("arima", "-o Imbalance -p 1 -q 1 -d 1 -P 1 -Q 0 -S 6 -u 150 --search steps", ["search", "errors", "forecasts"]),
    ("clusters", "-b 36 -n 60 -l 2", ["members", "profiles", "costs"]),
    ("labels", "-m ddbld -x Wind,Hydro", ["labels", "centres"]),
    ("labels", "-m stcls -x Wind,Hydro -l Label", ["predictions"]),
    ("analyse", "-x Wind -w Wind -r 0.8", ["properties", "histograms", "autocorrelation", "periodogram", "runs/Wind", "rates/Imbalance"]),
    ("matrix", "-t Wind -s STANDARD -r Y", ["matrix", "margins"]),
    ("regression", "-e Imbalance -x Wind,Hydro --category Label", ["quality", "anova", "predictions"]),
    ("markov", "", ["model", "states", "mismatches", "likelihood"]),
]


def test_train_then_predict(spark, made, tmp_path):
    at = ["-c", str(made / "a.csv"), "--out", str(tmp_path)]
    main(["train", *at, "--models", "mlp_1,best_arima", "--epochs", "1"])
    main(["predict", *at, "-p", "3"])
    rows = spark.read.parquet(f"{tmp_path}/forecasts").orderBy("model", "horizon").collect()
    assert [(r.model, r.horizon) for r in rows] == [(m, h) for m in ("best_arima", "mlp_1") for h in (1, 2, 3)] and str(rows[0].ts) == "2021-03-07 00:00:00"
    main(["control", "--out", str(tmp_path)])


@pytest.mark.parametrize(("kind", "options", "tables"), RUNS)
def test_series_commands(spark, made, tmp_path, kind, options, tables):
    main([kind, "-c", str(made / "a.csv"), *options.split(), "--out", str(tmp_path)])
    assert all(spark.read.parquet(f"{tmp_path}/{t}").count() > 0 for t in tables)


def test_dump_commands(spark, made, tmp_path):
    at = ["-d", str(made / "dump.log"), "--out", str(tmp_path), "-S", "2000", "-s", "900"]
    for mode in ("train", "test"):
        main(["physical", *at[:4], "-S", "100", "-s", "50", "-m", mode, "-b", "1000"])
        main(["frequency", *at, "-m", mode])
    assert spark.read.parquet(f"{tmp_path}/anomalies").count() == 3
    main(["physical", *at[:4], "-c", "20", "--chunks", "3", "-m", "test", "-b", "1000"])
    assert spark.read.parquet(f"{tmp_path}/anomalies").count() == 60
    main(["frequency", *at, "-m", "test", "-M", "mle"])
    assert spark.read.parquet(f"{tmp_path}/anomalies").count() == 3
    for mode in ("dset", "train", "test"):
        main(["detectors", *at, "-m", mode, "-e", "2", "--exclude", "123"])
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/confusion").collect()} <= {"0A1", "7FF"}


def test_pictures(spark, made, tmp_path):
    main(["pictures", "-i", str(made / "pictures"), "--out", str(tmp_path), "-l", "2"])
    assert spark.read.parquet(f"{tmp_path}/clusters").count() == 4


def test_lists_of_names():
    assert names("") == [] and names("a, b") == ["a", "b"] and len(KINDS) == 16
