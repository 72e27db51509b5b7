import random
import re
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import suffix_dedup as S


def words(t):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+", t.lower())


def brute(rows, length):
    """{(doc, removed): set of covered words}."""
    seen, cover = defaultdict(list), defaultdict(set)
    for i, t in sorted({r for r in rows if None not in r}):
        w = words(t)
        for p in range(len(w) - length + 1):
            seen[tuple(w[p : p + length])].append((i, p))
    for places in seen.values():
        if len(places) > 1:
            for n, (i, p) in enumerate(sorted(places)):
                cover[i, n > 0].update(range(p, p + length))
    return cover


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"v{k}" for k in range(300)]
    shared = [rnd.choices(vocab, k=k) for k in (9, 10, 11, 30, 80)]
    rows = []
    for i in range(90):
        w = rnd.choices(vocab, k=rnd.choice([0, 3, 9, 10, 40, 200]))
        for _ in range(rnd.choice([0, 1, 2])):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(shared)
        rows.append((i, ". ".join(w).title()))
    rows += [(200, rows[7][1]), (201, "The " * 70), (202, "é È " * 30), (203, None), (None, rows[8][1]), rows[9], rows[9], (204, ""), (-5, rows[11][1])]
    return rows


@pytest.mark.parametrize("shard_words", [10**6, 300])
def test_repeats_against_brute_force(spark, shard_words):
    rows = corpus(shard_words)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = defaultdict(set)
    for r in S.repeats(df, length=10, gram=5, shard_words=shard_words).collect():
        got[r.doc_id, r.removed].update(range(r.start_word, r.end_word))
    assert got == brute(rows, 10) and len(got) > 45


def test_remove_repeats(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_chars int, k string")
    cover = brute(rows, 10)
    got = S.remove_repeats(df, length=10, gram=5)
    assert got.columns == df.columns
    want = []
    for i, t in rows:
        left = None if t is None else words(t)
        if left is not None and i is not None and cover.get((i, True)):
            left = [w for p, w in enumerate(left) if p not in cover[i, True]]
            if not left:
                continue
        want.append((i, left))
    out = got.collect()
    assert sorted(map(repr, [(r.doc_id, None if r.text is None else words(r.text)) for r in out])) == sorted(map(repr, want))
    assert all(r.n_chars in (5, len(r.text or "")) for r in out)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp int")
    assert S.repeats(df).count() == 0 and S.remove_repeats(df).collect() == []


def test_suffix_array_and_prefixes():
    rnd = np.random.default_rng(1)
    for n, v in [(0, 1), (1, 1), (50, 1), (400, 2), (700, 40)]:
        seq = rnd.integers(0, v, n)
        order = S.suffix_array(seq)
        want = sorted(range(n), key=lambda i: seq[i:].tolist())
        assert order.tolist() == want
        lcp = S.common_prefixes(seq, order)
        for r in range(1, n):
            a, b = seq[order[r - 1] :], seq[order[r] :]
            m = min(len(a), len(b))
            same = a[:m] == b[:m]
            assert lcp[r] == (m if same.all() else int(np.argmin(same)))


def test_minimizers_are_first_least():
    rnd = np.random.default_rng(2)
    g = rnd.integers(0, 40, 300).astype(np.uint64) << np.uint64(30)
    for w in (1, 2, 7, 26):
        got = S.minimizers(g, w)
        assert got.tolist() == [i + int(np.argmin(g[i : i + w])) for i in range(len(g) - w + 1)]
