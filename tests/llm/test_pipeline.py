import os
import random
import re
from collections import Counter

import pytest

from graphloom.llm import mixing, pieces

from .test_mixing import brute as brute_mix
from .test_parity_join import brute as brute_pairs
from .test_suffix_dedup import brute as brute_repeats
from .test_suffix_dedup import words

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")


def cut(text, gone):
    """text without the words at the places in gone and without what follows each."""
    spans = [m.span() for m in re.finditer(r"[A-Za-z0-9_\x80-\U0010ffff]+", text)]
    ends = [s for s, _ in spans[1:]] + [len(text)]
    return text[: spans[0][0]] + "".join(text[s:e] for p, ((s, _), e) in enumerate(zip(spans, ends)) if p not in gone)


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as C

    rnd = random.Random(8)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(3, 9))) for _ in range(900)]
    passage = " ".join(rnd.choices(vocab, k=70))
    rows = []
    for i in range(60):
        w = rnd.choices(vocab, k=rnd.choice([6, 40, 200]))
        rows.append((i, " ".join(w) + ".", rnd.choice(["a", "a", "a", "b"])))
        if i % 6 == 0:
            w[3:4] = ["changed"]
            rows.append((100 + i, " ".join(w) + ".", "b"))
        if i % 9 == 0:
            rows.append((200 + i, " ".join(rnd.choices(vocab, k=90)) + " " + passage + ". " + " ".join(rnd.choices(vocab, k=90)), "b"))
    junk = [(300, "no " * 50, "a"), (301, "| a | b " * 9, "b"), (302, None, "a"), (303, "", "b"), (304, "LOUD TEXT " * 9 + "x" + str(rnd.random()), "a")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows + junk], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, tuple(r.ids)): 0 for r in C.run(spark, str(tmp_path)).collect()}
    for r in C.run(spark, str(tmp_path)).collect():
        got[r.doc_id, tuple(r.ids)] += 1
    parent = {i: i for i, *_ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in brute_pairs([(i, t) for i, t, _ in rows], 3, 0.5):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    rows = [r for r in rows if find(r[0]) == r[0]]
    assert len(rows) < 76
    cover = brute_repeats([(i, t) for i, t, _ in rows], 50)
    assert sum(removed for _, removed in cover) >= 5
    rows = [(i, cut(t, cover.get((i, True), ())), s) for i, t, s in rows]
    rows = [r for r in rows if words(r[1])]
    times = brute_mix(rows)
    m = pieces.model(pieces._read(pieces.MODEL))
    want = Counter({(i, tuple(m.encode(t).tolist())): times[i, s] for i, t, s in rows if times[i, s]})
    assert got == dict(want)


def test_columns_and_empty_table(spark, tmp_path):
    import corpus_pipeline as C

    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns and stage(spark, df, "").count() == 0
    assert C.encode(spark, df, "").count() == 0
