import numpy as np
import pytest

from graphloom.llm import hilbert_knn as H


def brute(v, k):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r], "x", 1) for i, r in enumerate(v)], "vec_id long, embedding array<float>, near string, rank int")


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_recall(spark, kind, monkeypatch):
    """Against brute force, with windows narrower than the table."""
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(1500, 8)) if kind == "noise" else (rnd.normal(size=(150, 16))[rnd.integers(0, 150, 1500)] + 0.05 * rnd.normal(size=(1500, 16)))
    if kind == "copies":
        v[500:900] = v[3]
    v = v.astype(np.float32)
    fits = []
    fitted = H.fitted
    monkeypatch.setattr(H, "fitted", lambda *a: fits.append(fitted(*a)) or fits[-1])
    got = {}
    for r in H.neighbours(frame(spark, v), block=100, every=3).collect():
        got.setdefault(r.id, []).append((r.near, r.similarity))
    want = brute(v.astype(float), 10)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(got) == set(range(0, 1500, 3)) and all(len(x) == 10 for x in got.values())
    hits = [s >= float(u[i] @ u[want[i][-1]]) - 1e-5 for i, x in got.items() for _, s in x]
    assert np.mean(hits) >= 0.9
    (use, w), = fits
    assert 2 * w + 1 < (1500 if kind == "noise" else 700)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [0.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [float("inf"), 0.0]), (11, [None, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, id int")
    got = {(r.id, r.rank): (r.near, r.similarity) for r in H.neighbours(df, k=3, every=1).collect()}
    assert {i for i, _ in got} == {1, 2, 3, 8, 9}
    assert got[1, 1] == (9, 1.0) and got[9, 1] == (1, 1.0) and got[8, 1] == (1, 0.0) and got[3, 1][0] == 2
    assert H.neighbours(df.limit(0), every=1).count() == 0
    assert H.neighbours(df.filter("vec_id = 1"), every=1).count() == 0


def test_curve_visits_each_cell_once_in_steps():
    side = 8
    grid = np.array(np.meshgrid(*[range(side)] * 3)).reshape(3, -1).T
    keys = H.hilbert_keys(grid, 3).astype(int)
    assert sorted(keys) == list(range(side**3))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_setting():
    gaps = np.array([[1, 90], [80, 2], [3, 70], [60, 60]])
    assert H.setting(gaps, 0.75) == (2, 3) and H.setting(gaps, 1.0) == (1, 80) and H.setting(gaps[:1], 1.0) == (1, 1)
    assert H.setting(gaps[:0], 0.9) == (1, 1)


def test_ties_of_many_equal_vectors_go_to_the_smaller_id():
    rnd = np.random.default_rng(6)
    v = np.concatenate([np.repeat(rnd.normal(size=(1, 64)), 600, axis=0), rnd.normal(size=(300, 64))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rnd.permutation(900)
    q, near, _ = H._ranked(v, ids, v, ids, 10)
    for i in ids[:600]:
        assert near[q == i].tolist() == [x for x in np.sort(ids[:600]) if x != i][:10]
