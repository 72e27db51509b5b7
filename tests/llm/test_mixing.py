import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import mixing as M


def h(*parts):
    return int(hashlib.md5("/".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:8], 16)


def brute(rows, budget=None, blocks=M.BLOCKS, seed=M.SEED):
    rows = [(i, s, len(t.split())) for i, t, s in rows if t and t.split()]
    per = Counter()
    for _, s, n in rows:
        per[s] += n
    names = sorted(per, key=lambda s: (s is not None, s))
    goal = sum(per.values()) if budget is None else budget
    w = dict(zip(names, M.weights([per[s] for s in names], goal)[1]))
    out = Counter()
    for s in names:
        due = int(w[s] * goal + 0.5)
        passes, rest = divmod(due, per[s])
        by = defaultdict(list)
        for i, x, n in rows:
            if x == s:
                at = h(seed, s, i)
                by[at % blocks].append((at, i, n))
        more = set()
        for b in sorted(by, key=lambda b: (h(seed, "pass", passes, s, b), b)):
            size = sum(n for *_, n in by[b])
            if size <= rest:
                more |= {i for _, i, _ in by[b]}
                rest -= size
                continue
            for at in sorted({a for a, *_ in by[b]}):
                same = [(i, n) for a, i, n in by[b] if a == at]
                if sum(n for _, n in same) > rest:
                    break
                rest -= sum(n for _, n in same)
                more |= {i for i, _ in same}
            break
        for i, x, _ in rows:
            if x == s:
                out[i, s] = passes + (i in more)
    return out


def corpus():
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.choice([1, 3, 40, 300])) , rnd.choice(["hot"] * 8 + ["a", "b", None])) for i in range(400)]
    return rows + [(900, None, "a"), (901, " \n", "a"), (None, "x y", "b"), rows[3], rows[3], (902, "x " * 5000, "b"), (903, "y", "only")]


@pytest.mark.parametrize("budget", [None, 5000, 150_000])
def test_draw_against_brute_force(spark, budget):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, copies int, block string")
    want = brute(rows, budget)
    got = M.draw(df, budget=budget).collect()
    assert {(r.doc_id, r.source): r.copies for r in got} == dict(want)
    assert len(got) == sum(1 for _, t, _ in rows if t and t.split())
    out = M.mixed(df, budget=budget)
    assert out.columns == df.columns
    times = Counter((r.doc_id, r.source) for r in out.collect())
    rep = Counter((i, s) for i, t, s in rows if t and t.split())
    assert times == {k: n * rep[k] for k, n in want.items() if n}


def test_weights():
    tokens = [1000, 100, 10, 0]
    a, w = M.weights(tokens, 1110, 0.9, 1e9)
    assert 0 < a < 1 and abs(sum(w) - 1) < 1e-9 and w[3] == 0
    assert abs(-sum(x * math.log(x) for x in w if x) - 0.9 * math.log(3)) < 1e-6
    _, w = M.weights(tokens, 1110, 0.9, 2.0)
    assert max(x * 1110 / t for x, t in zip(w, tokens) if t) <= 2 + 1e-6
    assert M.weights([5, 5], 10)[0] == 1.0 and M.weights([], 10) == (1.0, []) and M.weights([0], 5)[1] == [0.0]
    assert M.weights([7], 70)[1] == [1.0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.draw(df).count() == 0 and M.mixed(df).count() == 0
