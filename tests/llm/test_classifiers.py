"""Language identification and toxicity: held-out accuracy, labels that must not leak, edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import language, toxicity


def test_language_accuracy_and_edges(spark, corpus, docs):
    rows = corpus("documents")
    more = spark.createDataFrame([(10**6 + i, t, None, "s", 0) for i, t in enumerate([None, "", "12 34 !", "x" * 200_000])], rows.schema)
    got = {r.doc_id: r for r in language.language_id(rows.unionByName(more)).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in rows.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    assert [got[10**6 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[10**6 + 3].lang_pred != "und"
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language.language_id(rows.limit(0)).count() == 0
    nothing = language.language_id(rows.withColumn("lang", F.lit(None).cast("string")).limit(3)).collect()
    assert [r.lang_pred for r in nothing] == ["und"] * 3


def test_held_out_languages_are_not_learned(docs):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:10]
    rows = docs(["hello there"] * 10, ids).withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in language.language_id(rows).collect()} == {"und"}


def test_model_is_interpolated_kneser_ney():
    texts = {"a": "abab abba baab", "b": "cdcd cddc"}
    grams = {}
    for lang, t in texts.items():
        points, bounds = language.symbols([t])
        c = Counter(tuple(points[i - 3 : i + 1]) for i in range(3, len(points)))
        grams[lang] = (np.array(list(c), np.uint32), np.array(list(c.values())))
    m = language.Model(grams)

    def p(lang, gram, counts=None):
        n = len(gram)
        if n == 0:
            return 1 / m.size
        level = {tuple(g): c for g, c in zip(grams[lang][0].tolist(), grams[lang][1].tolist(), strict=True)}
        for _ in range(4 - n):
            level = Counter(g[1:] for g in level)
        one, two = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        d = one / (one + 2 * two) if one and two else 0.5
        total, kinds = sum(c for g, c in level.items() if g[:-1] == gram[:-1]), sum(g[:-1] == gram[:-1] for g in level)
        lower = p(lang, gram[1:])
        return max(level.get(gram, 0) - d, 0) / total + d * kinds / total * lower if total else lower

    text = "abba cdx"
    points, _ = language.symbols([text])
    h, _ = m.entropies([text])
    for col, lang in enumerate(m.languages):
        want = -sum(math.log(p(lang, tuple(points[i - 3 : i + 1].tolist()))) for i in range(3, len(points))) / (len(points) - 3)
        assert h[0, col] == pytest.approx(want, rel=1e-4)


def labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts, toxic = [], []
    for _ in range(n):
        t = list(rng.choice(words, rng.integers(5, 80)))
        bad = rng.random() < 0.3
        for _ in range(2 * bad):
            t.insert(int(rng.integers(len(t))), str(rng.choice(["Idiot", "clown,"])))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity(spark, docs):
    texts, toxic = labelled(900)
    rows = docs([*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(rows, labels).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(900))
    assert sum(got[i].predicted == toxic[i] for i in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    kept = toxicity.without_toxic(rows, labels)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.7}


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-9 for r in toxicity.toxicity(docs(["a", None]), none).collect())
    assert toxicity.toxicity(docs([]), none).count() == 0
    one = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 1, 1)], none.schema)
    assert all(r.score > 0.99 for r in toxicity.toxicity(docs(["a", "b", "c"]), one).collect())


def test_sparse_weights():
    texts, toxic = labelled(600)
    at, w, _, _ = toxicity.train([(t.encode(), y) for t, y in zip(texts, toxic, strict=True)])
    assert 0 < len(at) < 2000 and np.all(w != 0)


def test_every_language_is_learned_in_as_many_models_as_it_takes(corpus):
    rows = corpus("documents").filter("doc_id < 120")
    one, more = (language.fit(rows, F.lit(True), at_once=n) for n in (256, 1))
    assert len(more.models) == len(one.languages) > 1 and more.languages == one.languages
    texts = [r.text for r in rows.select("text").limit(20).collect()]
    assert np.allclose(one.entropies(texts)[0], more.entropies(texts)[0], atol=1e-4)
    names, score, _ = more.predict(texts)
    assert names == one.predict(texts)[0] and score == pytest.approx(one.predict(texts)[1], abs=1e-3)


def test_more_languages_than_one_model_holds(spark):
    words = {f"l{i:03d}": "".join(chr(97 + (i * k + k * k) % 26) for k in range(1, 9)) for i in range(language.LANGUAGES + 4)}
    df = spark.createDataFrame([(i, " ".join([w] * 9), k) for i, (k, w) in enumerate(words.items())], "doc_id long, text string, lang string")
    assert set(language.fit(df, F.lit(True)).languages) == set(words)


def test_repeated_rows_teach_once_and_rows_without_a_language_teach_nothing(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(ids[0], "abab baba abab", "x"), (ids[0], "abab baba abab", "x"), (ids[0], "zzzz", "x"), (ids[1], "cdcd dcdc", "y"), (ids[1], "qqqq", None), (ids[2], "cddc", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("at", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("grams", F.lit("g"))
    from tidewright.llm.common import Scratch

    taught = sorted((r.lang, r.text) for r in language.sampled(df, F.lit(True), 10, Scratch(spark)).collect())
    assert taught == [("x", "abab baba abab"), ("y", "cdcd dcdc"), ("y", "cddc")]
    assert language.language_id(df).count() == 6


def test_long_texts_are_scored_in_slices(corpus, monkeypatch):
    rows = corpus("documents").filter("doc_id < 80")
    model = language.fit(rows, F.lit(True))
    text = " ".join(r.text for r in rows.select("text").collect() if r.text)[:120_000]
    whole = model.entropies([text, "the end", text[:50]])
    monkeypatch.setattr(language, "SLICE", 1000)
    assert np.allclose(whole[0], model.entropies([text, "the end", text[:50]])[0])


def plain_ftrl(sample, bits, alpha, beta, l1, l2, epochs):
    """FTRL-proximal one coordinate at a time, in dictionaries."""
    rows = []
    for raw, y in sample:
        data = np.frombuffer(raw, np.uint8)
        rows.append((set(toxicity.features(data, np.array([0, len(data)]), bits)[0].tolist()), y))
    share = sum(y for _, y in rows) / len(rows)
    l1 *= math.sqrt(len(rows))
    base, z, n = math.log(share / (1 - share)), Counter(), Counter()

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for found, y in rows[: len(rows) - len(rows) // 4]:
            w = {f: weight(f) for f in found}
            g = 1 / (1 + math.exp(-(base + sum(w.values())))) - y
            for f in found:
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z if weight(f)}


def test_weights_are_those_of_a_plain_ftrl():
    texts, toxic = labelled(300, 5)
    sample = [(t.encode(), y) for t, y in zip(texts, toxic, strict=True)]
    at, w, _, _ = toxicity.train(sample, 14, 1.0, 1.0, 0.11, 0.05, 2)
    want = plain_ftrl(sample, 14, 1.0, 1.0, 0.11, 0.05, 2)
    assert set(at.tolist()) == set(want) and all(abs(want[i] - x) < 1e-9 for i, x in zip(at.tolist(), w.tolist(), strict=True))


def test_ties_repeated_rows_long_texts_and_a_bounded_sample(spark):
    texts, toxic = labelled(200, 2)
    ids = list(range(200))
    df = spark.createDataFrame([(i, t, "e", "s", 1, 0.5, 1) for i, t in zip([*ids, 0, 0, 1], [*texts, texts[0], "other", "x " * 600_000], strict=True)], "doc_id long, text string, lang string, source string, n_chars long, score double, label int")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df.withColumn("c0", F.lit("x")), labels).collect()
    assert len(got) == 203 and len({r.score for r in got if r.doc_id == 0}) == 2
    one = toxicity.fit(df, labels, F.lit(True), size=1)  # a sample of one row has one class
    assert not len(one[0]) and abs(one[3]) == 40 and len(toxicity.fit(df, labels, F.lit(True))[0])


def test_letters_are_those_of_unicode(docs):
    from tidewright.llm import language

    texts = ["\U00032010", "\U0002fffe", "\U00020000", "\U0003134f", "\U000e0041", "ª", "123", "퟿"]
    table = language._folded()
    assert [bool(table[ord(t)] != 32) for t in texts if len(t) == 1] == [t.isalpha() for t in texts if len(t) == 1]
    rows = docs([*texts[:-1], "the cat sat on the mat"] * 3)
    got = [(r.doc_id % 8, r.lang_pred) for r in language.language_id(rows).collect()]
    assert all((lang == "und") == (not (texts[:-1] + ["the"])[i].isalpha()) for i, lang in got)
