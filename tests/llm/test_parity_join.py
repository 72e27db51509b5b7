import random
import re

import numpy as np
import pytest

from graphloom.llm import parity_join as P
from graphloom.llm.components import components


def brute(rows, n, t):
    sets = {}
    for i, text in rows:
        if i is None or text is None:
            continue
        w = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", text.lower())
        if w:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}
    out = {}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= t:
                out[a, b] = round(j, 6)
    return out


def brute_rows(rows, n, t):
    """(id, class, links) of each document, from all pairs."""
    docs = set()
    for i, text in rows:
        if i is not None:
            w = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (text or "").lower())
            docs.add((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    docs = list(docs)
    near = [[j for j, (_, b) in enumerate(docs) if j != i and a and b and len(a & b) >= t * len(a | b)] for i, (_, a) in enumerate(docs)]
    out = []
    for i in range(len(docs)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        out.append((docs[i][0], min(docs[j][0] for j in seen), len(near[i])))
    return sorted(out)


def got_rows(df):
    return sorted((r.doc_id, r.class_id, r.links) for r in df.collect())


def corpus(seed=3, docs=120):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(docs):
        words = rnd.choices(vocab, k=rnd.choice([1, 2, 3, 5, 8, 30, 90, 300, 900]))
        rows.append((len(rows), " ".join(words)))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            other = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2, 1 + len(words) // 25])):
                k = rnd.randrange(len(other))
                other[k : k + 1] = rnd.choice([[], [rnd.choice(vocab)], [other[k], rnd.choice(vocab)]])
                other = other or ["x"]
            rows.append((len(rows), " ".join(other)))
    rows += [(9000, None), (9001, ""), (9002, "...!"), (None, rows[0][1]), (9003, "É à " * 40), (9004, "é À " * 40), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize("t, block, sets", [(0.5, P.BLOCK, P.SETS), (0.8, P.BLOCK, P.SETS), (0.5, 300, 3), (0.3, P.BLOCK, P.SETS)])
def test_join_against_brute_force(spark, t, block, sets):
    """Every link is found; small blocks make groups of copies span many cells."""
    rows = corpus() + [(7000, "one text under two ids"), (7001, "One text, under two ids"), (7000, "another text of that id, a long one")]
    got = got_rows(P.join(spark.createDataFrame(rows, "doc_id long, text string"), t=t, block=block, sets=sets))
    want = brute_rows(rows, 3, t)
    assert got == want and sum(n > 0 for *_, n in want) > 60


def test_large_group_of_near_copies(spark):
    """A third of all rows: copies of one text, each with some words changed, and exact copies."""
    rnd = random.Random(12)
    vocab = [f"v{k}" for k in range(300)]
    base = rnd.choices(vocab, k=60)
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([5, 40, 100])))) for i in range(200)]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(60)] = rnd.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base)) for i in range(40)]
    for how in ({}, {"block": 500}):
        assert got_rows(P.join(spark.createDataFrame(rows, "doc_id long, text string"), **how)) == brute_rows(rows, 3, 0.5)


def test_pairs_at_the_threshold(spark):
    """One set within the other of twice its size, at and next to similarity 0.5, from 1 to 600 n-grams."""
    rows, i = [], 0
    for n in [1, 2, 3, 7, 20, 62, 63, 64, 126, 300]:
        for extra in (-1, 0, 1):
            w = [f"a{n}x{extra}x{k}" for k in range(2 * n + extra + 2)]
            rows += [(i, " ".join(w)), (i + 1, " ".join(w[: n + 2]))]
            i += 2
    got = got_rows(P.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_rows(rows, 3, 0.5) and sum(n for *_, n in got) == 2 * 20


def test_other_ids_and_long_text(spark):
    long = " ".join(f"k{k % 5000}" for k in range(120_000))
    rows = [("b", long), ("a", long + " more"), ("c", "k1 k2 k3"), ("d", None)]
    assert got_rows(P.join(spark.createDataFrame(rows, "doc_id string, text string"))) == [("a", "a", 1), ("b", "a", 1), ("c", "c", 0), ("d", "d", 0)]


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int, f string, key int, h string, __drop int, links int, class_id int, root int")
    assert P.join(empty).count() == 0 and P.one_of_each(empty).count() == 0 and P.one_of_each(empty).columns == empty.columns
    rest = (1, 1, 1, 1)
    df = spark.createDataFrame([(3, "a b c d e f", 1, "x", 2, "1", *rest), (2, "a b c d e f", 1, "y", 2, "1", *rest), (None, "a b c d e f", 0, "z", 1, "1", *rest), (5, None, 0, "q", 1, "1", *rest)], empty.schema)
    assert sorted(r.f for r in P.one_of_each(df).collect()) == ["q", "y", "z"]
    assert P.one_of_each(df).columns == df.columns


def test_one_of_each_keeps_one_per_group(spark):
    rows = corpus(5)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in P.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = {i for i, c, _ in brute_rows(rows, 3, 0.5) if i == c}
    assert kept == sorted((i is None, i or 0) for i, _ in rows if i is None or i in first)
    assert len(kept) < len(rows) - 40


def test_one_of_each_keeps_the_other_text_of_an_id(spark):
    rows = [(1, "one two three four"), (5, "one two three four"), (5, "quite another text here")]
    got = P.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [rows[0], rows[2]]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(7, 7), (1000 + 3, 1000), *[(2000 + i, 2001 + i) for i in range(40)]]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for parts in (1, 40):
        got = {r.node: r.root for r in components(df.repartition(parts)).collect()}
        assert got == {x: find(x) for x in parent}
    assert components(df.limit(0)).count() == 0


def test_sketch_distance_bounds_difference():
    rnd = np.random.default_rng(0)
    for size, change in ((5, 2), (60, 10), (700, 300)):
        a = np.unique(rnd.integers(0, 1 << 52, size).astype(np.uint64))
        b = np.unique(np.r_[a[change:], rnd.integers(0, 1 << 52, change).astype(np.uint64)])
        s = P.sketches(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), 8)
        far = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert 0 < far <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8])
def test_similar_sets_share_a_joined_bit(t):
    """Any two sets of similarity t, under any levels, share a bit that serves the smaller one."""
    rnd = np.random.default_rng(int(t * 10))
    for _ in range(400):
        n = int(rnd.integers(1, 80))
        m = int(rnd.integers(n, int(n / t) + 1))
        both = int(np.ceil(t / (1 + t) * (n + m) - 1e-9))
        if both > n:
            continue
        a = np.unique(rnd.integers(0, 1 << 52, n + m).astype(np.uint64))[: n + m - both]
        rnd.shuffle(a)
        x, y = np.sort(a[:n]), np.sort(a[n - both : n - both + m])
        level_of = {int(v): int(rnd.integers(1, 4)) for v in np.intersect1d(x, y)} | {}
        level = np.array([level_of.get(int(v), int(rnd.integers(0, 2)) * 0) for v in np.r_[x, y]])
        d, i, smaller = P.joined_bits(np.r_[x, y], np.array([0, n, n + m]), level, t)
        g = np.r_[x, y][i]
        assert np.isin(g[(d == 0) & smaller], g[d == 1]).any()
        assert abs(P.bands(np.array([n]), t)[0] - P.bands(np.array([m]), t)[0]) <= 1


def test_chance_ties_no_texts(spark):
    """Texts that share each of their phrases with another text, and no two of them more than one, stay apart; near copies don't."""
    rnd = random.Random(4)
    texts = [[] for _ in range(60)]
    for p, (a, b) in enumerate({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(400)}):
        for k in (a, b):
            texts[k].append(" ".join(f"p{p}x{j}" for j in range(9)))
    texts = [" ".join(t) for t in texts]
    texts.append(texts[0] + " end")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    how = P._frequent(df, 3, sum(len(t.split()) - 2 for t in texts))
    edges, _ = P._candidates(df, 3, 0.5, how)
    assert edges.filter("a <> b").distinct().count() == 1
    rows = list(enumerate(texts))
    assert got_rows(P.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_rows(rows, 3, 0.5)


def test_ties_against_all_pairs():
    """Groups smaller and larger than what is tested by neighbours, with few and many tied sets."""
    rnd = np.random.default_rng(5)
    for sets, keys, kinds in ((30, 5, 3), (300, 3, 5), (300, 40, 200), (400, 2, 400)):
        size, kind = rnd.integers(10, 40, sets), rnd.integers(0, kinds, sets)
        pairs = {(k, s): rnd.random() < 0.5 for k in range(keys) for s in range(sets) if rnd.random() < 0.6}
        key, own = (np.array(x) for x in zip(*pairs))
        tests = []
        ties = P.Ties(size, 0.5)
        ties.add(key.astype(np.uint64), own, np.array(list(pairs.values())), lambda a, b: tests.append(len(a)) or kind[a] == kind[b])
        a, b = [], []
        for x, y in ((x, y) for x in range(sets) for y in range(sets) if x != y and kind[x] == kind[y] and 0.5 * size[y] <= size[x] <= size[y]):
            if any(pairs.get((k, x)) and (k, y) in pairs for k in range(keys)):
                a.append(x), b.append(y)
        nodes, roots = P.forest(np.array(a, int), np.array(b, int))
        want = np.arange(sets)
        want[nodes] = roots
        assert (ties.root(np.arange(sets)) == want).all()
        assert kinds > 5 or sum(tests) < sets * 80


def test_near_denies_no_similar_pair():
    rnd = np.random.default_rng(6)
    sets = []
    for n in rnd.integers(1, 600, 150):
        a = np.unique(rnd.integers(0, 1 << 52, n).astype(np.uint64))
        sets += [a, np.unique(np.r_[a[: int(len(a) * rnd.uniform(0.4, 1))], rnd.integers(0, 1 << 52, int(n * rnd.uniform(0, 0.6))).astype(np.uint64)])]
    size = np.array([len(x) for x in sets])
    size_ok = [i for i in range(0, len(sets), 2) if size[i] and size[i + 1]]
    words = P.widths(size)
    flat = np.concatenate([P.sketches(x, np.array([0, len(x)]), int(w))[0] for x, w in zip(sets, words)])
    start = np.cumsum(words) - words
    a = np.array(size_ok)
    got = P.near(flat, start, size, a, a + 1, 0.5)
    want = [len(np.intersect1d(sets[i], sets[i + 1])) >= 0.5 * len(np.union1d(sets[i], sets[i + 1])) for i in a]
    assert got[want].all() and 20 < sum(want) < len(a) - 20
    x, y = (v.ravel() for v in np.meshgrid(a, a))
    other = (x < y) & (np.minimum(size[x], size[y]) > 30) & (2 * np.minimum(size[x], size[y]) >= np.maximum(size[x], size[y]))
    assert other.sum() > 500 and P.near(flat, start, size, x[other], y[other], 0.5).mean() < 0.01
