"""Katz back-off scores against a plain model of the same definition, and the sum of its probabilities."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import katz, queries

END, START = "\x00end", "\x00start"


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [END]


def star(counts, limit=5):
    n = Counter(counts)
    out = {}
    for r in range(1, limit + 1):
        d = 0.0
        if n[1] and n[r] and (limit + 1) * n[limit + 1] != n[1]:
            k = (limit + 1) * n[limit + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (n[r] * r) - k) / (1 - k)
        out[r] = r * d if 0 < d < 1 else r - 0.5
    return lambda c: out[c] if c <= limit else c - 0.5


class Plain:
    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for t in texts:
            last = START
            for w in tokens(t):
                self.one[w] += 1
                self.two[last][w] += 1
                last = w
        self.n = sum(self.one.values())
        self.star1, self.star2 = star(self.one.values()), star([c for x in self.two.values() for c in x.values()])
        self.rest = 1 - sum(map(self.star1, self.one.values())) / self.n if self.n else 1.0

    def word(self, w):
        return self.star1(self.one[w]) / self.n if self.one[w] else self.rest

    def prob(self, u, w):
        after = self.two.get(u)
        if not after:
            return self.word(w)
        total = sum(after.values())
        if after[w]:
            return self.star2(after[w]) / total
        left = 1 - sum(map(self.star2, filter(None, after.values()))) / total
        return left / (1 - sum(self.word(x) for x, c in after.items() if c)) * self.word(w)

    def scores(self, t):
        base = score = known = 0
        last = START
        for w in tokens(t):
            base += math.log10((self.one[w] + 0.5) / (self.n + 0.5 * (len(self.one) + 1)))
            score += math.log10(self.prob(last, w))
            known += self.one[w] > 0
            last = w
        return len(tokens(t)), known, self.n, base, score


def check(df, rows, close=1e-6):
    plain = Plain([t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1])
    got, want = defaultdict(list), defaultdict(list)
    for r in df.collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        got[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    for i, t in rows:
        want[i].append(plain.scores(t))
    assert got.keys() == want.keys()
    for i in want:
        assert len(got[i]) == len(want[i])
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9, abs=close)


def made(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(150)]
    return [" ".join(rng.choice(pool[: rng.choice((3, 20, 150))]) + rng.choice(["", "", "", "Q"]) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_scores_of_made_texts(docs):
    texts = made(1, 120) + [None, "", " \n\t", "the " * 3000 + "the cat", "A a É é", "x" * 100_000 + " " + "word of it " * 20_000]
    rows = list(enumerate(texts)) + [(5, texts[5]), (6, texts[7]), (None, texts[9])]
    check(katz.lm_scores(docs([t for _, t in rows], [i for i, _ in rows])), rows)


def test_small_blocks_and_many_buckets_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", 200)
    monkeypatch.setattr(katz, "BUCKET", 100)
    monkeypatch.setattr(katz, "FREQUENT", 0.05)
    texts = made(2, 150)
    check(katz.lm_scores(docs(texts).repartition(3)), list(enumerate(texts)))


def test_nothing_to_learn(spark, docs):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = katz.lm_scores(docs(["a b"] * len(held), held)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] * len(held) and all(abs(r.base_score) < 1e-8 and r.score == 0 for r in got)
    assert katz.lm_scores(docs([])).count() == 0


def test_scores_of_the_corpus(spark, corpus):
    check(queries.op12_lm_scoring(spark, "/root/testdata/sf0.001"), [(r.doc_id, r.text) for r in corpus("documents").select("doc_id", "text").collect()])


def test_the_kept_model_is_normalised(spark, docs, tmp_path):
    texts = made(3, 80)
    katz.language_scores(docs(texts), F.lit(False), str(tmp_path / "model")).count()
    grams, weights = katz.read_tables(spark.read.parquet(str(tmp_path / "model")))
    grams, weights, plain = grams.collect(), {r.context: r for r in weights.collect()}, Plain(texts)
    assert len(grams) == sum(map(len, plain.two.values())) and len(weights) == len(plain.two)
    after, words = defaultdict(dict), {r.word: plain.star1(r.word_n) / plain.n for r in grams}
    for r in grams:
        after[r.context][r.word] = plain.star2(r.n) / weights[r.context].n
    words[None] = plain.rest
    assert sum(words.values()) == pytest.approx(1)
    for u, seen in after.items():
        assert sum(seen.get(w, 10 ** weights[u].log10_weight * p) for w, p in words.items()) == pytest.approx(1)


def test_arrays_are_packed_and_unpacked():
    some = [np.arange(5, dtype=np.uint64) << 40, np.empty(0, np.uint32), np.array([-1.5, 2.0]), np.array([3], np.uint8)]
    got = katz.unpack(katz.pack(*some))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(some, got, strict=True))
    assert [x.tolist() for x in katz.unpack(katz.pack(np.empty(0, np.int64)))] == [[]]
