"""Nearest neighbours against brute force; Hilbert keys visit every cell by single steps."""

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import hilbert_ann as ha
from tidewright.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    ids = np.array(sorted({i for i, _ in rows}))
    x = np.array([dict(rows)[i] for i in ids], np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in ha.nearest(df).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_hilbert_curve():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ha.hilbert_keys(g, 3)
    assert sorted(keys) == list(range(512)) and np.all(np.abs(np.diff(g[np.argsort(keys)], axis=0)).sum(1) == 1)


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=8) * rng.uniform(0.5, 2))]) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(40)]
    rows += [(580, [1.0, 2.0] + [0.0] * 6)]  # given without its zeros
    bad = [(500, None, 0), (520, [0.0] * 8, 0), (540, [1.0, None] + [0.0] * 6, 0), (560, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (600, [], 0)]
    given = [(i, v[:2] if i == 580 else v, 0) for i, v in rows] + bad + [(0, rows[0][1], 1)]
    got = found(spark.createDataFrame(given, SCHEMA).withColumn("x", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("rep", F.lit(3)))
    want = brute(rows)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    assert all(abs(a - b) < 1e-9 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def clustered(n, clusters, d, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 2
    return [(i, [float(v) for v in np.float32(centres[i % clusters] + rng.normal(size=d) * 0.3)]) for i in range(n)]


def test_recall_and_the_share_compared_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(ha, "BLOCK", 64)
    monkeypatch.setattr(ha, "MEET", 5)
    rows = clustered(6000, 61, 16)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got, want = found(df), brute(rows)
    assert set(got) == set(want) and all(len(r) == 20 for r in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9
    scratch = Scratch(spark)
    _, classes = ha.prepared(df, 20, 20, scratch)
    _, curves, reach, n, _, _ = ha.plan(classes, 20, scratch)
    assert n == 6000 and curves > 1 and curves * (2 * reach + 64) < n / 2


def test_vectors_without_structure_meet_all_rows_once(spark, monkeypatch):
    monkeypatch.setattr(ha, "BLOCK", 64)
    monkeypatch.setattr(ha, "PRODUCT", 100)
    monkeypatch.setattr(ha, "TILE", 40 * 32 * 8)
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=32))]) for i in range(2400)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    scratch = Scratch(spark)
    _, classes = ha.prepared(df, 20, 20, scratch)
    _, curves, _, n, _, known = ha.plan(classes, 20, scratch)
    assert curves == 0 and n == 2400 and known.select("q").distinct().count() == 12
    got, want = found(df), brute(rows)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_results_are_exact_at_any_size_and_for_any_choice_of_windows(spark, monkeypatch):
    rows = clustered(3000, 31, 16, seed=2)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = {q: [i for i, _ in r] for q, r in brute(rows).items()}
    plan, candidates, asked = ha.plan, ha.candidates, []
    monkeypatch.setattr(ha, "candidates", lambda *a: asked.append(a[2:4]) or candidates(*a))
    # One table as few blocks and as many; then no wide windows, and too narrow ones.
    for block, choice in ((1024, None), (64, None), (64, (0, 0)), (64, (8, 1))):
        monkeypatch.setattr(ha, "BLOCK", block)
        monkeypatch.setattr(ha, "plan", lambda *a, choice=choice: (p := plan(*a))[:1] + (choice or p[1:3]) + p[3:])
        assert {q: [i for i, _ in r] for q, r in found(df).items()} == want
    assert asked[0] == (1, 0) and asked[1][0] > 1 and asked[2:] == [(1, 0), (8, 1)]


def test_check_passes_over_blocks_and_keeps_ties():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 12)) * 3, 50, 0) + rng.normal(size=(2000, 12)) * 0.1
    x[1700] *= 1e6
    x[[60, 1999]] = x[10]  # three equal rows in three blocks
    q = np.vstack([x[10:2000:97], x[1700]])
    s = np.stack([np.cumsum(x * v, 1)[:, -1] for v in q])
    ids = np.arange(2000)[::-1]
    want = [ids[np.lexsort((ids, -v))[:7]].tolist() for v in s]
    for least in (np.full(len(q), -np.inf), np.sort(s, 1)[:, -7]):
        best = ha.Best(q, least, 7)
        for low in rng.permutation(40) * 50:
            best.meet(x[low : low + 50], ids[low : low + 50])
        at, got, score = best.found()
        assert [got[at == i].tolist() for i in range(len(q))] == want and np.array_equal(score, np.sort(s, 1)[:, :-8:-1].ravel())
    assert best.compared < 0.3 * s.size
    few = ha.Best(q, np.full(len(q), -np.inf), 7)
    few.meet(x[:3], ids[:3])
    assert len(few.found()[0]) == 3 * len(q)


def test_groups_of_close_rows_rule_out_most_of_clustered_vectors():
    x = np.array([v for _, v in clustered(4000, 40, 32)])
    for rows in (x, x[:1], np.ones((700, 3)), np.full((300, 2), 1e200), np.where(np.arange(4000)[:, None] % 97, x, x * 1e5)):
        with np.errstate(all="ignore"):
            assert np.array_equal(np.sort(np.concatenate(list(ha.close_groups(rows)))), np.arange(len(rows)))
    x = x[np.random.default_rng(8).permutation(4000)]
    q, shares = x[::20], []
    for groups in (list(ha.close_groups(x)), np.split(np.arange(4000), 40)):
        best = ha.Best(q, np.sort(q @ x.T, 1)[:, -21] - 1e-6, 21)
        for at in groups:
            best.meet(x[at], at)
        shares.append(best.compared / (len(q) * len(x)))
    assert shares[0] < 0.2 < 0.9 < shares[1]


def test_positions_count_the_rows_before(spark, monkeypatch):
    monkeypatch.setattr(ha, "BLOCK", 50)
    rows = clustered(700, 7, 6)
    scratch = Scratch(spark)
    _, classes = ha.prepared(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), 5, 20, scratch)
    curves, _, _, n, _, _ = ha.plan(classes, 5, scratch)
    place = ha.positions(classes, curves, 3, n, True, scratch).collect()
    x = np.array([v for _, v in rows])
    own, asked = curves.keys(x, False, 3), curves.keys(x, True, 3)
    for c in range(3):
        at = {r.rep: r.at for r in place if r.curve == c and not r.ask}
        assert sorted(at.values()) == list(range(700)) and [at[i] for i in np.lexsort((np.arange(700), own[:, c]))] == list(range(700))
        assert all(r.at == (own[:, c] <= asked[r.rep, c]).sum() for r in place if r.curve == c and r.ask)


def test_ties_go_to_the_smaller_id(spark):
    vectors = [(i, [1.0, float(i), 0.0]) for i in range(801, 1001)] + [(20, [1.0, 0.0, 0.0])]
    got = found(spark.createDataFrame([(i, v, 0) for i, v in vectors], SCHEMA))
    assert [i for i, _ in got[20]] == list(range(801, 821))
    one = list(ha._top(np.array([[1.0, 0, 0]]), np.array([[1.0, i, 0] for i in range(200)])[::-1].copy(), np.arange(200)[::-1] + 801, 5))
    assert one[0][1].tolist() == [801, 802, 803, 804, 805]


def test_empty(spark):
    assert ha.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
