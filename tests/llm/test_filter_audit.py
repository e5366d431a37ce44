"""The audit of filters against counts document by document."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import filter_audit, queries, words
from tidewright.llm.filter_audit import DUPLICATE


def filters():
    return {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 10 * F.col("n_chars"),
        "D": F.col("n_symbols") > 0,
        "E": DUPLICATE,
    }


WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, labels):
    """(part, order, step) -> (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    least, failing = {}, []
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        mine = [x for x in labels if x[0] == i and i is not None]
        failing.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {f[0] for f in failing}:
        docs, total = [f[1:] for f in failing if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [d for d in docs if d[0] & set(order[:k])]
                left = [d for d in docs if not d[0] & set(order[:k])]
                here = [d for d in left if f in d[0]]
                total[f] += len(here)
                out[part, "".join(order), k + 1] = [len(left) - len(here), len(here), sum(f in d[0] for d in gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
        for key in out:
            if key[0] == part:
                out[key].append(total[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_of_odd_documents(spark):
    many = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", " \t\n\x0b\x0c\r", many, many, many + " #", many.upper(), "É" * 50 + " ABCDE", "a " * 300, many + " end|", " " * 10, many + " x" * 31, many + " x" * 30, "B" * 300_000, many]
    ids = [3, 2, 5, 9, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, None]
    langs = ["en", None, "en", "en", "de", "en", "de", "en", "en", "", "fr", "en", "en", "en", "en"]
    rows = [*zip(ids, texts, langs, strict=True), (8, many, "de"), (20, many, None)]
    labels = [(9, 1, 0), (9, 0, 1), (10, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1), (20, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n long, mask string")
    held = spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, toxic int, n int")
    want = plain(rows, labels)
    assert found(filter_audit.filter_audit(docs, held, filters())) == want and len(want) == 4 * 600
    assert found(filter_audit.filter_audit(docs, held.limit(0), filters())) == plain(rows, [])
    assert filter_audit.filter_audit(docs.limit(0), held, filters()).count() == 0


def test_audit_of_the_corpus(spark, corpus):
    docs, labels = corpus("documents"), corpus("labels")
    want = plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert found(queries.op11_filter_audit(spark, "/root/testdata/sf0.001")) == want


def test_fewer_filters_without_duplicates(spark, corpus):
    got = filter_audit.filter_audit(corpus("documents"), corpus("labels"), {"X": F.col("n_words") < 50, "Y": F.col("n_symbols") > 0}, symbols="!").collect()
    assert {r.filter_order for r in got} == {"XY", "YX"} and all(r.kept >= 0 for r in got)
    with pytest.raises(ValueError):
        filter_audit.orders(corpus("documents"), list("ABCDEFGH"))


def test_words_that_share_a_hash_are_told_apart():
    raw = [b"aa bb aa cc bb", b"", b"dd dd", b"ee ff"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    _, starts, ends, first = words.words(data, offsets)
    assert filter_audit.distinct_words(data, np.zeros(len(starts), np.uint64), starts, ends, first).tolist() == [3, 0, 1, 2]
