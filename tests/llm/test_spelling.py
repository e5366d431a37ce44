"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewright.llm import queries, spelling


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows, least=5, often=3, spoil=97):
    """word -> (form, root, n, n_near, form_n)."""
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if c >= often and len(w) >= least}
    by_size, near = {}, {w: [] for w in n}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for w in n:
        for size in (len(w), len(w) + 1):
            for x in by_size.get(size, []):
                if (size > len(w) or x > w) and one_edit(w, x):
                    near[w].append(x)
                    near[x].append(w)
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def variants(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        word = "".join(rng.choices("abé", k=rng.randint(4, 9)))
        out += [word] * rng.randint(1, 30)
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(len(word) + 1)
            made = rng.choice([word[:i] + rng.choice("abé÷") + word[i:], word[:i] + word[i + 1 :], word[:i] + "ß" + word[i + 1 :]])
            out += [made] * rng.randint(1, 9)
            word = rng.choice([word, made])
    rng.shuffle(out)
    return out


def test_groups_of_made_words(docs):
    texts = [", ".join(w.upper() if k % 3 else w for w in variants(k)) for k in range(60)]
    long = "x" * 70 + "yz" * 20
    texts += [None, "", "  ", "1234 — ’", f"{long} " * 9 + f"{long}q " * 4 + f"{long[:80]}q{long[81:]} " * 3, "abcde’abcde abcdeĀabcdf abcdf abcdf abcdf", "éééÉé éééÉé éééÉé ééééé ééééé ééééé ééééé ééééé ééééé", "word " * 20_000 + "words " * 30_000]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[3])]
    got = found(spelling.spelling_groups(docs([t for _, t in rows], [i for i, _ in rows]), spoil=97))
    want = plain(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 50 and any(v[0] != v[1] for w, v in want.items() if v[0])
    assert spelling.spelling_groups(docs([]), spoil=97).count() == 0
    assert spelling.spelling_groups(docs([None, "", "a b"]), spoil=97).count() == 0


def test_groups_of_the_corpus(spark, corpus):
    want = plain([(r.doc_id, r.text) for r in corpus("documents").collect()])
    assert found(queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == want and len(want) > 500


def test_checksums_of_words_carry_on():
    raw = [b"a", b"hello", b"z" * 200, "é÷".encode(), b"x" * 64, b"y" * 65]
    data, size = np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw)))
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(raw))], np.uint32)
    assert spelling.crc32(before, data, np.cumsum(size) - size, size).tolist() == [zlib.crc32(f"{i}:".encode() + w) for i, w in enumerate(raw)]


def test_a_list_holds_words_that_differ_in_one_gram_only():
    words = [b"abcdef", b"abcdeg", b"abcde", b"xbcdef", b"abxdef"]
    keys = {}
    for size in (5, 6):
        mine = [w for w in words if len(w) == size]
        for gram, short, key in spelling.postings(size, np.array([list(w) for w in mine], np.uint8)):
            for w, k in zip(mine, key.tolist(), strict=True):
                keys.setdefault((gram, k), []).append((w, short))
    met = sorted(sorted(w for w, _ in v) for v in keys.values() if len(v) > 1 and not all(short for _, short in v))
    assert met == [[b"abcde", b"abcdef", b"abcdeg"], [b"abcdef", b"abxdef"], [b"abcdef", b"xbcdef"]]
    data, offsets = spelling.latin(pa.array(["é÷a", "", "ÿ"]))
    assert data.tobytes().decode("latin-1") == "é÷aÿ" and offsets.tolist() == [0, 3, 3, 4]
