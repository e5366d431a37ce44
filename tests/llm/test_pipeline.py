"""The pipeline's stages against plain versions of them, and on odd documents."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import decontaminate, queries, toxicity
from tidewright.llm.common import materialise

from test_ngram_jaccard import brute as groups_of

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def toxic_scores(rows, model):
    """Scores by sets of words, pairs and skip-pairs, with the weights that the operator learned."""
    at, w, slope, intercept = model
    weight = dict(zip(at.tolist(), w.astype(np.float32).tolist(), strict=True))
    out = {}
    for r in rows:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        found = set(toxicity.features(raw, np.array([0, len(raw)]))[0].tolist())
        out[r.doc_id] = 1 / (1 + math.exp(-max(-35, min(35, slope * sum(weight.get(f, 0) for f in found) + intercept))))
    return out


def contaminated(rows, items):
    """Documents that hold a test item: every passage against every part of every item."""
    parts = []
    for text in items:
        ws = words(text)
        n = max(1, -(-len(ws) // decontaminate.PART))
        size, more = divmod(len(ws), n)
        at = 0
        for i in range(n):
            part = ws[at : at + size + (i < more)]
            at += len(part)
            if len(part) >= decontaminate.MIN_WORDS:
                parts.append(part)
    df = {t: sum(t in p for p in parts) for p in parts for t in p}
    mean = sum(map(len, parts)) / max(1, len(parts))

    def impact(t, p):
        tf = p.count(t)
        return math.log(1 + (len(parts) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(p) / mean))

    grams = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    def share(ws, passage):
        n = min(3, len(ws))
        mine = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
        have = grams(passage, n)
        return sum(g in have for g in mine) / len(mine)

    out = set()
    for r in rows:
        ws = words(r.text)
        for s in range(max(1, -(-len(ws) // 64) - 1)):
            passage = ws[64 * s : 64 * s + 128]
            have = set(passage)
            for p in parts:
                every = {t: impact(t, p) for t in set(p)}
                if sum(v for t, v in every.items() if t in have) >= 0.6 * sum(every.values()) - 1e-9:
                    cut = len(p) - max(2, len(p) // 3)
                    if min(share(p[:cut], passage), share(p[cut:], passage)) >= 0.6:
                        out.add(r.doc_id)
    return out


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    table = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = materialise(stage(spark, docs, FOLDER), "test")
        assert docs.columns == names
        kept[name] = (before, docs.collect())
    before, after = kept["toxicity"]
    model = toxicity.fit(table("documents"), table("labels"), ~toxicity.held_out(F.col("doc_id")))
    score = toxic_scores(before, model)
    assert {r.doc_id for r in after} == {i for i, s in score.items() if s < 0.7} and len(after) < len(before)
    before, after = kept["ngram_jaccard"]
    groups = groups_of([(r.doc_id, r.text) for r in before], 5, 8, 10)
    assert {r.doc_id for r in after} == {i for i, (_, first) in groups.items() if i == first} and len(after) < len(before)
    before, after = kept["decontamination"]
    bad = contaminated(before, [r.text for r in table("benchmark").collect()])
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
    before, after = kept["pii"]
    assert [r.doc_id for r in sorted(after)] == [r.doc_id for r in sorted(before)] and any(a.text != b.text for a, b in zip(sorted(after), sorted(before), strict=True))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    sizes, places = {}, {}
    for r in packed:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert max(sizes.values()) <= 2048 and len(sizes) <= -(-sum(sizes.values()) // 2048) + 1
    for p in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:], strict=False)) and min(p)[0] == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_odd_documents_go_through(spark, tmp_path, case):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here at all", "en", "s", 17), (3, "a b c d e f g h", "en", "s", 15), (3, "a b c d e f g h", "en", "s", 15), (4, "a b c d e f g h", "en", "s", 15), (5, "Mr Smith " + "word " * 60_000, "en", "s", 9), (6, None, "en", "s", None)]
    docs = spark.createDataFrame(rows if case == "odd" else [], SCHEMA)
    for name in ("row", "gone", "c0", "score", "_text", "_toxicity", "found", "key", "sid", "a.b", "n_email"):
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, str(tmp_path)), "odd")
        assert now.columns == docs.columns
    if case == "odd":
        got = now.collect()
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 3, 5, 6] and all(r["a.b"] == "a.b" and r.n_email == "n_email" and r._text == "_text" for r in got)
        assert next(r for r in got if r.doc_id == 5).n_chars > 300_000
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) >= (7 if case == "odd" else 0) and (case == "odd" or not packed)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    found = c.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(str, found.fetchall()))


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_odd_documents_that_labels_and_the_benchmark_hit(spark, tmp_path):
    """Nulls, repeated rows, ties and long texts among documents that the first stages reject."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    vile = lambda n: " ".join(rng.choice(["zokk", "vurm", "blagh"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n))
    learned = [(i, vile(40) if i % 2 else prose(40)) for i in range(400)]
    item, odd_vile = prose(30), vile(60)
    odd = [(None, odd_vile), (None, None), (1000, ""), (1001, odd_vile), (1001, odd_vile), (1002, f"{prose(50)} {item} {prose(50)}"), (None, item), (1003, item), (1003, item), (1004, prose(70_000)), (1005, None)]
    docs = spark.createDataFrame([(i, t, None if i is None else "en", "s", len(t or "")) for i, t in learned + odd], SCHEMA).withColumn("toxic", F.lit("mine")).withColumn("item_id", F.lit(5)).withColumn("a.b", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*[(i, None, i % 2) for i in range(400)], (0, 1, 0), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, str(tmp_path)), "odd")
        assert now.columns == docs.columns
        kept[name] = now.select("doc_id", "text").collect()
    left = [r.text for r in kept["toxicity"]]
    assert odd_vile not in left and sum(t in left for i, t in learned if i % 2 == 0) >= 195 and sum(t in left for i, t in learned if i % 2) <= 10
    assert sum(t is None or t == "" for t in left) == 3 and left.count(item) == 3
    # Rows without a doc_id stay, and so do all rows of the doc_id that stays.
    assert sorted((r.doc_id or 0) for r in kept["ngram_jaccard"] if r.text == item) == [0, 1003, 1003]
    assert [r.doc_id for r in kept["decontamination"] if item in (r.text or "")] == [None] and {1000, 1004, 1005} <= {r.doc_id for r in kept["pii"]}
