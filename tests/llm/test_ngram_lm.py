import math
import random
import re
from collections import Counter

import numpy as np

from graphloom.llm import ngram_lm as L
from graphloom.llm.elias_fano import EliasFano, load, save


def words(t):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (t or "").lower())


def brute(texts, least=2, d=0.75):
    """Scores of the texts under the model of the texts, from plain dictionaries."""
    toks = [words(t) for t in texts]
    c1 = Counter(w for t in toks for w in t)
    total = sum(c1.values())
    unk = sum(n for n in c1.values() if n < least)
    c1 = {w: n for w, n in c1.items() if n >= least}
    toks = [[w if w in c1 else None for w in t] for t in toks]
    c2 = Counter(x for t in toks for x in zip(t, t[1:]) if None not in x)
    c2 = {x: n for x, n in c2.items() if n >= least}
    c3 = Counter(x for t in toks for x in zip(t, t[1:], t[2:]) if x[:2] in c2 and x[1:] in c2)
    c3 = {x: n for x, n in c3.items() if n >= least}
    left1, left2 = Counter(), Counter()
    for x, n in c2.items():
        left1[x[0]] += n - d
    for x, n in c3.items():
        left2[x[:2]] += n - d

    def p1(w):
        return c1[w] / total if w else max(unk, 1) / (total + 1)

    def p2(v, w):
        return max(c2.get((v, w), 0) - d, 0) / c1[v] + (1 - left1[v] / c1[v]) * p1(w)

    def p3(u, v, w):
        return max(c3.get((u, v, w), 0) - d, 0) / c2[u, v] + (1 - left2[u, v] / c2[u, v]) * p2(v, w)

    out = []
    for t in toks:
        s = 0.0
        for i, w in enumerate(t):
            a = t[i - 1] if i else None
            b = t[i - 2] if i > 1 else None
            if w is None or a is None:
                s += math.log10(p1(w))
            elif b is None or (b, a) not in c2:
                s += math.log10(p2(a, w))
            else:
                s += math.log10(p3(b, a, w))
        out.append((len(t), sum(w is None for w in t), s))
    return out


def test_elias_fano(tmp_path):
    rnd = np.random.default_rng(1)
    for values in [[], [0], [5], [0, 0, 0], [3, 3, 9, 9, 9, 500], np.sort(rnd.integers(0, 1 << 40, 3000)), np.sort(rnd.integers(0, 900, 5000)), np.r_[np.arange(400), 1 << 33, (1 << 33) + 1], np.sort(rnd.integers(0, 1 << 56, 700))]:
        values = np.array(values, np.int64)
        save(str(tmp_path / "x"), EliasFano.parts(values, "v"))
        ef = EliasFano(load(str(tmp_path / "x")), "v")
        assert ef.n == len(values)
        i = np.arange(len(values))
        assert ef.get(i).tolist() == values.tolist()
        ask = np.unique(np.r_[values, values + 1, np.maximum(values - 1, 0), 0, rnd.integers(0, 1 << 41, 50)])
        assert ef.find(ask).tolist() == np.searchsorted(values, ask).tolist()


def test_scores_against_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"w{k}" for k in range(25)] + ["é", "ß"]
    texts = [" ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 3, 10, 60])) + rnd.choice([[], [f"rare{i}"]])) for i in range(150)]
    texts += [None, "", "?!", texts[0], texts[0], " ".join(rnd.choices(vocab, k=4000))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "w1 w2 w3", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, unknown string").repartition(3)
    got = {r.doc_id: r for r in L.score(df, L.build(df, parts=5)).collect()}
    want = brute([t for _, t, _ in rows])
    assert len(got) == len(rows)
    for (i, _, _), (n, unk, s) in zip(rows, want):
        r = got[i]
        assert (r.n_words, r.unknown) == (n, unk)
        assert abs(r.log10_prob - s) < 0.01 * max(n, 1) and (n == 0) == (r.perplexity is None)
    a, b = sum(r.log10_prob for r in got.values()), sum(s for *_, s in want)
    assert abs(a - b) < 2e-3 * abs(b)


def test_empty_and_unique_corpora(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.score(df, L.build(df, parts=3)).collect()}
    assert got[1].unknown == 3 and got[2].n_words == 1
    assert L.score(df.limit(0), L.build(df.limit(0), parts=2)).count() == 0


def test_query_counts_what_occurs_once(spark, tmp_path):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices([f"w{k}" for k in range(25)], k=30) + [f"once{i}", "w1", f"more{i}"]) for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in L.op4_ngram_lm(spark, str(tmp_path)).collect()}
    want = brute(texts, least=1)
    assert all(got[i].unknown == 0 and abs(got[i].log10_prob - s) < 0.01 * n for i, (n, _, s) in enumerate(want))
    assert abs(sum(r.log10_prob for r in got.values()) / sum(s for *_, s in want) - 1) < 2e-3
