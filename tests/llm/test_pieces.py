import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pieces as P
from graphloom.llm import text
from graphloom.llm.lookup import trimmed

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no model file")
HARD = ["", " ", "  a", "a ", "▁x", "a▁b", "a\x00b", "�", "\t x", "12345", "abc  12     y", "A\r\nB\n\n c", "<unk>", "<s> hi <0x0A>", "é😀\U0010ffff", "ß" * 50, "a" * 3000, " " * 40, "x\n" * 200, "internationalisation of unbelievable counterrevolutionaries"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def check(m, lib, text):
    ids = m.encode(text).tolist()
    assert ids == lib.encode(text)
    assert m.decode(ids) == lib.decode(ids)


def test_hard_texts(lib):
    m = P.model(P._read(P.MODEL))
    rnd = random.Random(1)
    for text in HARD:
        check(m, lib, text)
    pieces = [lib.id_to_piece(i) for i in range(260, 32000)]
    for _ in range(1500):
        check(m, lib, "".join(rnd.choices(pieces, k=rnd.randrange(1, 9))))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    check(P.model(P._read(P.MODEL)), sentencepiece.SentencePieceProcessor(model_file=P.MODEL), text)


def test_long_texts_take_seconds(lib):
    m = P.model(P._read(P.MODEL))
    began = time.perf_counter()
    for text in ("😀" * 100_000, "龘" * 50_000, " " * 100_000, "  " + "ab" * 50_000, "a" + " " * 50_000 + "b" * 50_000, "😀 龘x\n" * 20_000, "word " * 60_000):
        check(m, lib, text)
    assert time.perf_counter() - began < 90


def test_compatible_pairs_by_merging():
    m = P.model(P._read(P.MODEL))
    rnd = random.Random(3)
    own = [i for i in m.id.values() if len(m.piece[i]) == 1 or m.left[i] >= 0]
    some = [i for i in own if len(m.piece[i]) < 4]
    for _ in range(6000):
        a, b = rnd.choice(some if rnd.random() < 0.7 else own), rnd.choice(some if rnd.random() < 0.7 else own)
        x, y = m.piece[a], m.piece[b]
        if m.merge(x) == [x] and m.merge(y) == [y]:
            assert m.compatible(a, b) == (m.merge(x + y) == [x, y])


def test_batches_of_texts(lib):
    m = P.model(P._read(P.MODEL))
    texts = HARD + [None, "", "▁▁ a ▁b", "x" * 9, "\n", " \n ", "ends in blank ", "é"] * 3
    ids, off = m.encode_all(pa.array(texts))
    for t, a, b in zip(texts, off, off[1:]):
        assert ids[a:b].tolist() == (lib.encode(t) if t else [])
    some = [t for t in texts if t and "▁" not in t]
    for part in (some, texts):
        ids, off = m.encode_all(pa.array(part))
        assert m.exact(pa.array(part), ids, off).tolist() == [(not t) or m.decode(m.encode(t).tolist()) == t for t in part]
    wrong = ids.copy()
    wrong[off[9]] = 300
    assert not m.exact(pa.array(part), wrong, off)[9]


def test_stretches_side_by_side(lib):
    """All kinds of stretches in one batch, and many distinct ones without keeping them."""
    m = P.model(P._read(P.MODEL))
    rnd = random.Random(5)
    pieces = [lib.id_to_piece(i).replace(P.BLANK, "") for i in range(260, 32000)]
    texts = [" ".join("".join(rnd.choices(pieces, k=rnd.choice([1, 2, 3, 5, 30]))) for _ in range(rnd.randrange(1, 40))) + rnd.choice(["", "\n", "  x", "\x01", "😀é", "a" * 64, "é" * 33, " b" * 3]) for _ in range(1500)] + HARD
    ids, off = m.encode_all(pa.array(texts))
    for t, a, b in zip(texts, off, off[1:]):
        assert ids[a:b].tolist() == lib.encode(t)
    m.known.clear()
    words = ["".join(rnd.choices("etaoinshr", k=9)) for _ in range(20_000)]
    ids, off = m.encode_all(pa.array(words))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == lib.encode(words)
    assert not m.known


def test_pairs_beyond_the_most():
    asked = []
    p = P.Pairs(lambda k: asked.append(k) or k % 3 == 0, 5000)
    rnd = np.random.default_rng(2)
    for n in (0, 1, 300, 4000, 4000, 9000, 10):
        keys = rnd.integers(0, 1 << 30, n) if n != 300 else np.arange(300).repeat(2)
        assert p(keys).tolist() == (keys % 3 == 0).tolist() == p(keys).tolist()
        assert (p.slots >= 0).sum() == p.known <= max(5000, n)
    before = len(asked)
    p(keys)
    assert len(asked) == before


def test_memory_of_a_worker():
    """Tables are small, a slice is, and a task that ends leaves nothing but the model."""
    m = P.model(P._read(P.MODEL))
    assert m.go.nbytes + m.row.nbytes < 18_000_000
    words = text.Words(pa.array(["a b c"]))
    assert len(words.hashes) == 3 and text._pows
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 100_000] * 3 + ["b"] * 9})
    out = list(trimmed(P._rows(["n_ids"], "text", P._read(P.MODEL), False))([batch]))
    assert [b.num_rows for b in out] == [1, 1, 10] and out[-1].column("n_ids").to_pylist()[1:] == [1] * 9
    assert not text._pows and not P._models
    assert text.Words(pa.array(["a b c"])).hashes.tolist() == words.hashes.tolist()


def test_a_worker_makes_its_model_once(lib, monkeypatch):
    """The next task of a worker reads the packed tables, and encodes and decodes as with those made anew."""
    proto = P._read(P.MODEL)
    made, init = [], P.Model.__init__
    monkeypatch.setattr(P.Model, "__init__", lambda self, x: made.append(x) or init(self, x))
    monkeypatch.setattr(P, "_models", {})
    monkeypatch.setattr(P, "_answers", {})
    monkeypatch.setattr(P, "_packed", {}, raising=False)
    rnd = random.Random(6)
    pieces = [lib.id_to_piece(i) for i in range(260, 32000)]
    texts = HARD + ["".join(rnd.choices(pieces, k=rnd.randrange(1, 9))) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for task in range(3):
        (out,) = trimmed(P._rows(["ids", "exact"], "text", proto, True))([batch])
        assert out.column("ids").to_pylist() == lib.encode(texts)
        assert not P._models and len(made) == 1
    m = P.model(proto)
    for text in texts[:60]:
        check(m, lib, text)
    assert len(made) == 1 and len(P._packed[hash(proto)]) < 4_000_000


def test_rows(spark, lib):
    rows = [(i, t, "z") for i, t in enumerate(HARD)] + [(None, None, "n"), (3, "ab", "r"), (3, "ab", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ids string")
    out = P.encode(df, check=True)
    assert out.columns == ["doc_id", "text", "ids", "n_ids", "exact"]
    got = P.decode(out).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None:
            assert r.ids is None and r.n_ids is None and r.exact is None and r.decoded is None
        else:
            assert r.ids == lib.encode(r.text) and r.n_ids == len(r.ids)
            assert r.decoded == lib.decode(r.ids) and r.exact == (r.decoded == r.text)
    assert P.encode(df.limit(0)).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        P.Model(b"no model")
