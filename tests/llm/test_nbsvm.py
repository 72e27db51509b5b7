import random
import re

import numpy as np
import pyarrow as pa

from graphloom.llm import nbsvm as N
from graphloom.llm.text import Words, word_hash


def corpus(n=600):
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = rnd.choices(vocab, k=rnd.choice([8, 40, 120]))
        bad, toxic = i % 4 == 0, i % 4 == 1
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [w[0]] * len(w)
        for _ in range(3 * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(["vile", "nasty"]))
        rows.append((i, " ".join(w)))
        if i < n // 2:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    extra = [(900, None), (901, ""), (902, " \n"), (None, "plain w1 w2 w3"), (903, "w5 " * 3 + "w7 " * 40_000), rows[5], rows[5]]
    labels += [(None, 1, 0), (77_777, 0, 1), (3, None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, keep string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    low, toxic = N.train(docs, lab, "quality = 0"), N.train(docs, lab, "toxic = 1")
    got = N.classify(docs, low, toxic).collect()
    assert len(got) == len(rows) + len(extra)
    held = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 600]
    assert np.mean([r.keep == (r.doc_id % 4 > 1) for r in held]) > 0.97
    for r in got:
        if r.doc_id in (900, 901, 902):
            assert r.keep is False and r.low_quality is None and r.toxic is None
    assert len({r.toxic for r in got if r.doc_id == 5}) == 1
    assert N.classify(docs.limit(0), low, toxic).count() == 0


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert N.train(docs, lab, "toxic = 1")[1] == -1.0 and N.train(docs, lab.limit(0), "toxic = 1")[1] == -1.0
    assert N.train(docs, lab, "quality = 1")[1] == 1.0


def brute_fit(rows, y, c=1.0):
    """Weights and bias by projected gradient ascent on the whole dual, with dense vectors."""
    feats = sorted({f for r in rows for f in r.tolist()})
    x = np.array([[f in set(r.tolist()) for f in feats] for r in rows], float)
    size = 1 << N.BITS
    p, q = x[y == 1].sum(0) + 1, x[y == -1].sum(0) + 1
    ratio = np.log(p / (p.sum() + size - len(feats))) - np.log(q / (q.sum() + size - len(feats)))
    z = np.c_[x * ratio, np.ones(len(x))] * y[:, None]
    gram = z @ z.T
    alpha, step = np.zeros(len(x)), 1 / np.linalg.norm(gram, 2)
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, c)
    w = z.T @ alpha
    return dict(zip(feats, w[:-1] * ratio)), w[-1], alpha, z @ w


def test_fit_against_brute_force():
    """The dual's solution, and its optimality: margin 1 where alpha is free, over at 0, under at c."""
    rnd = np.random.default_rng(0)
    rows = [np.unique(rnd.integers(0, 60, 12)).astype(np.int32) for _ in range(80)]
    y = np.where([r[0] < 3 for r in rows], 1, -1)
    want, bias, alpha, margin = brute_fit(rows, y)
    assert (margin[alpha < 1e-9] > 1 - 1e-3).all() and (margin[alpha > 1 - 1e-9] < 1 + 1e-3).all()
    w, b = N.fit(rows, y, epochs=2000, least_docs=1)
    assert abs(b - bias) < 0.02 and max(abs(w[f] - v) for f, v in want.items()) < 0.02
    got = np.array([v * (w[r].sum() + b) for r, v in zip(rows, y)])
    free = (alpha > 1e-3) & (alpha < 1 - 1e-3)
    assert free.any() and np.abs(got[free] - 1).max() < 0.02 and np.abs(got - margin).max() < 0.05


def brute_features(t):
    """Bins by a walk over the characters of a text."""
    found, low, word = set(), t.lower(), r"[a-z0-9_\x80-\U0010ffff]+"
    h = lambda x: np.array([word_hash(x)], np.uint64)
    words = re.findall(word, low)
    found |= {(1, int(N._bins(h(w), 1)[0])) for w in words}
    found |= {(2, int(N._bins(h(a) * np.uint64(3) + h(b), 2)[0])) for a, b in zip(words, words[1:])}
    for run in re.findall(r"[!-/:-@\[-^`{-~]+", t):
        raw = np.frombuffer(run.encode(), np.uint8)
        found.add((3, int(N._bins(Words.of_bytes(raw, np.array([0, len(raw)]), N._PUNCT).hashes, 3)[0])))
    for w in re.findall(word, t, re.I):
        raw = np.frombuffer("".join("A" if "A" <= x <= "Z" else "0" if x.isdigit() and x.isascii() else "_" if x == "_" else "a" if x.isascii() else "a" * len(x.encode()) for x in w).encode(), np.uint8)
        found.add((4, int(N._bins(Words.of_bytes(raw, np.array([0, len(raw)])).hashes, 4)[0])))
    if len(words):
        again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        k = 0 if again == 0 else 1 + sum(again >= x for x in (0.02, 0.05, 0.2))
        found.add((5, int(N._bins(np.array([k], np.uint64), 5)[0])))
    return {f for _, f in found}


def test_query_against_brute_force(spark):
    rows, labels = corpus(240)
    rows = rows + [(500, "naïve Ünit_7 x-y !! {a} b.c"), (501, "w1 w1 w1 w2 w3"), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    heads = N.train(docs, lab, "quality = 0"), N.train(docs, lab, "toxic = 1")
    for r in N.classify(docs, *heads).collect():
        t = dict(rows)[r.doc_id]
        want = [sum(float(w[f]) for f in brute_features(t)) + b for w, b in heads] if t else [None, None]
        assert (r.low_quality, r.toxic) == (None, None) if not t else np.allclose((r.low_quality, r.toxic), want, atol=1e-4)
        assert r.keep == bool(t and max(want) < 0)


def test_features_are_distinct_and_local():
    texts = ["Foo bar foo bar!!", "", None, "foo bar", "x " * 30]
    f, off = N.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own, _ = N.features(pa.array([t], pa.string()))
        assert f[off[i] : off[i + 1]].tolist() == own.tolist() and len(set(own.tolist())) == len(own)
