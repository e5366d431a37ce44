"""Groups of near copies against all pairs of sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm import ngram_jaccard as nj


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and den * len(s & t) >= num * len(s | t) and find(i) != find(j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus_of(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=3))
    texts = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 20, 60, 200]))) for _ in range(n // 3)]
    line = " ".join(word() for _ in range(8))
    for _ in range(n - len(texts)):
        base = rng.choice(texts).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            base[rng.randrange(len(base))] = word()
        texts.append(" ".join(base) + rng.choice(["", "", " " + line]))
    return [*texts, None, "", " \t\n", "One", "one", "ONE two", "É x y z", "é x y z", "a b c d"]


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(3, 9, 10, 0), (5, 8, 10, 1), (3, 90, 100, 2)])
def test_same_as_all_pairs(docs, k, num, den, seed):
    texts = corpus_of(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_jaccard_groups(docs(texts), k, num, den).collect()}
    assert got == brute(list(enumerate(texts)), k, num, den)


@pytest.mark.parametrize("sizes", [{"TILE_SETS": 6, "LEAVES": 3}, {"HOT": 2, "TILE_SETS": 4, "LEAVES": 2}, {"HOT": 3, "BUCKET": 20, "PACKET": 50, "NAMED": 7, "TILE_BYTES": 2000}, {"BROADCAST_IDS": 0, "HOT": 5}])
def test_small_tiles_packets_and_hot_lists_lose_no_link(docs, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(nj, name, value)
    texts = corpus_of(3, 40)
    base = texts[5].split() * 3
    texts += [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(0, len(base), 4)][:12]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_jaccard_groups(docs(texts), 3, 8, 10).collect()}
    assert got == brute(list(enumerate(texts)), 3, 8, 10)


def test_long_texts_and_nameless_rows(docs):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    half = [f"v{i}" for i in range(60)]
    texts = [" ".join(long), " ".join(long[:100_000] + ["x"] * 3 + long[100_000:]), " ".join(long[:90_000]), " ".join(half), " ".join([*half[:57], "a", "b", "c"]), " ".join([*half[:53], "d", "e", "f", "g", "a", "b", "c"])]
    rows = docs(texts).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    got = {r.n_shingles if r.doc_id is None else r.doc_id: r.component_id for r in nj.ngram_jaccard_groups(rows, 3, 8, 10).collect()}
    # Without doc_id 4 the rows 3 and 5 would not be linked; 2 holds 0.75 of 0.
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 58: 3, 5: 3}


def test_words_that_collide_in_polynomial_hashes(docs):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = nj.ngram_jaccard_groups(docs([a, b, a])).collect()
    assert sorted(r.component_id for r in rows) == [0, 0, 1]


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, m in ((10, 12), (100, 130), (3000, 5000)):
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        s, t = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        x, y = (np.frombuffer(r, "<u8") for r in nj.sketches(np.concatenate([s, t]), np.array([0, len(s), len(s) + len(t)])))
        width = min(len(x), len(y))
        assert np.bitwise_count(nj._folded(x, width) ^ nj._folded(y, width)).sum() <= len(np.setxor1d(s, t))


def test_repeated_rows_and_empty_table(docs):
    rows = nj.ngram_jaccard_groups(docs(["a b c d", "a b c d", "x"], [5, 5, 7])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (5, 5), (7, 7)]
    assert nj.ngram_jaccard_groups(docs([])).count() == 0


def test_one_of_each_group_stays(docs):
    kept = nj.drop_near_copies(docs(["a b c d e f", "A b c d e f", None, "", "z"], [3, 1, 4, 5, 6]))
    assert kept.columns == docs([]).columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
