"""Operator 7, SentencePiece encoding and decoding for merge-type (BPE) models.

The encoding of a text prefix ends in a token that is unique for the prefix. For each prefix an
automaton over the vocabulary gives the tokens that end there; the one whose predecessor, the
last token of the remaining prefix, forms a compatible pair with it (encoding both texts
together gives just the two) is stored in a table. The ids are then read backwards from the end.

No piece of such a model has a blank after another character, and characters that are not in the
vocabulary never merge, so texts are cut before blanks and at such characters. The cuts are found on
the bytes of a batch of texts, its distinct stretches are encoded once, and the ids of all stretches are
put together by array operations. Distinct stretches of up to `SHORT` bytes go through the automaton side
by side, a byte of each at a time, in arrays; others, and those with characters that are not in the
vocabulary, one by one. Short ones of these are remembered (up to `REMEMBER` of them, then afresh), as are
pairs (up to `PAIRS`). Pieces of blanks only share one score, which breaks the uniqueness; stretches that begin with two
blanks or more are merged step by step with a heap. Characters that are not in the vocabulary become byte
tokens. Time is in proportion to a text's length, times its logarithm within such blank stretches.

Models whose normaliser changes texts, or without byte fallback, are refused. Defined results:
a null text has null ids and an empty one none; any id value passes through, repeated rows are
encoded each; texts are encoded whole; an empty table gives no rows. U+2581 counts as a
blank, as in the library, and decodes as one. Extra columns are kept by `encode`, unless
they have the name of a new column, when the new one takes their place.
"""

from __future__ import annotations

import pickle
import re
from heapq import heapify, heappop, heappush
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .lookup import trimmed
from .store import table
from .text import slices, string_buffer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
REMEMBER = 100_000
PAIRS = 1_000_000
SHORT = 64
SLICE = 1 << 19  # bytes of text at a time


class Pairs:
    """Answers for keys from 0 on, in a hash table of arrays that is emptied beyond `most`; ask(key) tells those not known yet."""

    def __init__(self, ask, most: int = PAIRS):
        self.ask, self.most = ask, most
        self._room(12)

    def _room(self, bits: int) -> None:
        self.bits, self.known, self.slots = bits, 0, np.full(1 << bits, -1, np.int64)  # 2 * key + answer

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _add(self, entries: np.ndarray) -> None:
        if self.known + len(entries) > self.most:
            self._room(12)
        if 2 * (self.known + len(entries)) > len(self.slots):
            old = self.slots[self.slots >= 0]
            self._room(int(4 * (len(old) + len(entries))).bit_length())
            self._add(old)
        self.known += len(entries)
        at = self._home(entries >> 1)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries  # another's place, or another got it just now
            entries, at = entries[left], (at[left] + 1) & (len(self.slots) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, at, rest = np.zeros(len(keys), bool), self._home(keys), np.arange(len(keys))
        new = []
        while len(rest):
            v = self.slots[at]
            hit, none = v >> 1 == keys[rest], v < 0
            out[rest[hit]] = (v[hit] & 1).astype(bool)
            new.append(rest[none])
            go = ~(hit | none)
            rest, at = rest[go], (at[go] + 1) & (len(self.slots) - 1)
        if new and len(new := np.concatenate(new)):
            fresh, which = np.unique(keys[new], return_inverse=True)
            told = np.fromiter(map(self.ask, fresh.tolist()), bool, len(fresh))
            out[new] = told[which]
            self._add(fresh * 2 + told)
        return out


class Model:
    """Tables of one model, from the bytes of its file."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {}
        self.id, self.score = {}, {}
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p], self.score[p] = i, sp.get_score(i)
        if len(self.byte) != 256 or sp.encode(" Å  x") != self._merged_ids(f"{BLANK * 2}Å{BLANK * 2}x"):
            raise ValueError("not a BPE model with byte fallback that leaves texts as they are")
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.id):
            raise ValueError("a piece holds a blank after another character")
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.plain = [None if i in self.byte_of else p.replace(BLANK, " ") if p in self.id else "" for i, p in enumerate(self.piece)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if set(p) != {BLANK} or len(p) == 1:
                if self.merge(p) == [p]:  # others never come out of an encoding
                    self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self._halves()
        self._learn()
        self._arrays()
        self.chars = frozenset(c for c in self.id if len(c) == 1)
        # the bytes that each id decodes to, one after the other
        own = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.plain)]
        self.own_bytes = np.frombuffer(b"".join(own), np.uint8)
        self.own_size = np.array([len(b) for b in own], np.int64)
        self.own_start = np.cumsum(self.own_size) - self.own_size

    def _learn(self) -> None:
        """Begins without answers."""
        n = len(self.piece)
        self.pair: dict[int, bool] = {}
        self.fits = Pairs(lambda k: self.compatible(*divmod(k, n)))
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pair", "fits", "known")}

    def __setstate__(self, tables: dict) -> None:
        self.__dict__.update(tables)
        self._learn()

    def merge(self, s: str, most: int | None = None) -> list[str]:
        """Merging as defined: the best-scored adjacent pair first, the leftmost of equals; no merges to `most` characters or more."""
        parts: list = list(s)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int):
            x = self.score.get(parts[i] + parts[after[i]]) if after[i] < n else None
            return None if x is None or most is not None and len(parts[i]) + len(parts[after[i]]) >= most else (-x, i, len(parts[i]) + len(parts[after[i]]))

        heap = [p for i in range(n) if (p := pair(i)) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            if parts[i] is None or after[i] >= n or len(parts[i]) + len(parts[after[i]]) != size:
                continue  # of a part that has changed since
            j = after[i]
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)) is not None:
                    heappush(heap, p)
        return [p for p in parts if p is not None]

    def _merged_ids(self, s: str) -> list[int]:
        return [i for p in self.merge(s) for i in ([self.id[p]] if p in self.id else [self.byte[b] for b in p.encode()])]

    def _halves(self) -> None:
        """rank: place of each piece's merge in the order of merges, -1 for characters; left, right: ids of what it is merged from."""
        n = len(self.piece)
        self.rank, self.left, self.right, self.rank_of = [-1] * n, [-1] * n, [-1] * n, {}
        chars = {c: self.id[c] for p in self.id for c in p if c in self.id}
        order = sorted((p for p in self.id if len(p) > 1 and set(p) != {BLANK}), key=lambda p: -self.score[p])
        rank = {p: r for r, p in enumerate(order)}
        for p, r in rank.items():
            self.rank_of[p] = self.rank[self.id[p]] = r
            # the last merge is the one whose later half was made last
            cuts = [(max(rank.get(p[:k], -1), rank.get(p[k:], -1)), k) for k in range(1, len(p)) if (p[:k] in rank or p[:k] in chars) and (p[k:] in rank or p[k:] in chars)]
            cuts = [(late, k) for late, k in sorted(cuts) if late < r]
            for _, k in cuts:
                if self.rank[self.id[p]] == r and (len(cuts) == 1 or self._tells(p, k)):
                    self.left[self.id[p]], self.right[self.id[p]] = self.id[p[:k]], self.id[p[k:]]
                    break

    def _tells(self, p: str, k: int) -> bool:
        """Whether merging p comes to the halves before and after k in the end."""
        return self.merge(p, len(p)) == [p[:k], p[k:]]

    def _arrays(self) -> None:
        """The automaton over bytes, a blank as 32. go: the next state, for a row and a byte's kind (0: in no piece); row: a state's, which
        it shares with the longest proper end of its text where no piece goes on from it; longest: the longest token that
        ends in a state; shorter: the next one that ends where a token ends; both -1 for none; long: its bytes."""
        tokens = {p.replace(BLANK, " ").encode(): i for p, (i, _) in self.automaton.items()}
        used = sorted({b for p in tokens for b in p})
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = np.arange(1, len(used) + 1)
        kind, kinds = self.kind.tolist(), len(used) + 1
        states: list[dict[int, int]] = [{}]
        own = [-1]
        for p, i in tokens.items():
            at = 0
            for b in p:
                to = states[at].get(kind[b])
                if to is None:
                    to = states[at][kind[b]] = len(states)
                    states.append({})
                    own.append(-1)
                at = to
            own[at] = i
        n = len(self.piece)
        go, self.longest = np.zeros((1 + sum(map(bool, states[1:])), kinds), np.uint16 if len(states) < 1 << 16 else np.int32), np.array(own, np.int32)
        row, rows = [0] * len(states), 1
        self.shorter, self.long = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        for p, i in tokens.items():
            self.long[i] = len(p)
        fall = [0] * len(states)  # the state of the longest proper end of a state's text
        line = [0]
        for at in line:
            if at:
                row[at] = row[fall[at]]
                if states[at]:
                    go[rows] = go[row[at]]
                    row[at], rows = rows, rows + 1
                end = self.longest[fall[at]]
                if own[at] < 0:
                    self.longest[at] = end
                else:
                    self.shorter[own[at]] = end
            for k, to in states[at].items():
                fall[to] = int(go[row[at], k])
                go[row[at], k] = to
                line.append(to)
        self.go, self.row, self.kinds = go.ravel(), np.array(row, np.int32), kinds

    def _side_by_side(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which stretches it could encode, how many ids each has, their ids from the last one on, the stretch's place of each id)."""
        size = np.diff(off)
        doubled = np.zeros(len(size), bool)
        two = size > 1
        doubled[two] = (raw[off[:-1][two]] == 32) & (raw[off[:-1][two] + 1] == 32)
        which = np.flatnonzero((size <= SHORT) & ~doubled)
        which = which[np.argsort(-size[which], kind="stable")]
        size, first = size[which], off[which]
        most = int(size[0]) if len(size) else 0
        ends = np.append(raw[1:] & 0xC0 != 0x80, True)  # the last byte of each character
        token = np.full((most + 1, len(which)), -1, np.int32)
        state, failed = np.zeros(len(which), np.int64), np.zeros(len(which), bool)
        active = np.searchsorted(-size, -np.arange(most), "left")
        for e, k in enumerate(active.tolist()):
            at = first[:k] + e
            state[:k] = now = self.go[self.row[state[:k]] * self.kinds + self.kind[raw[at]]]
            who = np.flatnonzero(ends[at])
            last = self.longest[now[who]]
            while len(who):
                begin = e + 1 - self.long[last]
                before = token[begin, who]
                ok = (begin == 0) & (last >= 0)
                test = np.flatnonzero((before >= 0) & (last >= 0))
                ok[test] = self.fits(before[test].astype(np.int64) * len(self.piece) + last[test])
                token[e + 1, who[ok]] = last[ok]
                failed[who[last < 0]] = True
                more = ~ok & (last >= 0)
                who, last = who[more], self.shorter[last[more]]
        who, rest = np.flatnonzero(~failed), size.copy()
        many, ids, places = np.zeros(len(which), np.int64), [], []
        done = who
        while len(who):
            t = token[rest[who], who]
            ids.append(t)
            places.append(who)
            many[who] += 1
            rest[who] -= self.long[t]
            who = who[rest[who] > 0]
        place = np.full(len(which), -1, np.int64)
        place[done] = np.arange(len(done))
        return which[done], many[done], np.concatenate(ids or [np.zeros(0, np.int32)]), place[np.concatenate(places or [np.zeros(0, np.int64)])]

    def _distinct(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches one after the other, how many each has)."""
        size = np.zeros(len(stretches), np.int64)
        done, many, ids, place = self._side_by_side(*string_buffer(stretches))
        size[done] = many
        left = np.ones(len(stretches), bool)
        left[done] = False
        left = np.flatnonzero(left)
        if len(self.known) > REMEMBER:
            self.known.clear()
        if len(self.pair) > PAIRS:
            self.pair.clear()
        others = []
        for t in stretches.take(pa.array(left)).to_pylist():
            found = self.known.get(t)
            if found is None:
                found = self.stretch(t.replace(" ", BLANK))
                if len(t) <= SHORT:
                    self.known[t] = found
            others.append(found)
        size[left] = [len(x) for x in others]
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        # the first of place are the last ids of their stretches, the second ones those before, and so on
        order = np.argsort(place, kind="stable")
        nth = np.arange(len(ids)) - (np.cumsum(many) - many)[place[order]]
        out[(start + size - 1)[done][place[order]] - nth] = ids[order]
        out[_spread(start, size, left)] = np.fromiter((i for x in others for i in x), np.int32, int(size[left].sum()))
        return out, size

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the texts of both together gives just the two: no merge across the border comes before those within."""
        rank, rank_of, piece, left, right = self.rank, self.rank_of, self.piece, self.left, self.right
        limit = len(rank)
        while True:
            if rank_of.get(piece[a] + piece[b], limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            elif rank[b] < 0:
                return True
            else:
                limit, b = rank[b] + 1, left[b]
            if a < 0 or b < 0:
                raise ValueError("a piece that no merge of two makes")

    def stretch(self, s: str) -> tuple[int, ...]:
        """Ids of a stretch that has no blank after another character."""
        if s.startswith(BLANK * 2):
            return tuple(self._merged_ids(s))
        if self.chars.issuperset(s):
            return tuple(self._prefixes(s))
        out: list[int] = []
        for known, part in groupby(s, self.chars.__contains__):
            part = "".join(part)
            out += self._prefixes(part) if known else [self.byte[b] for b in part.encode()]
        return tuple(out)

    def _prefixes(self, s: str) -> list[int]:
        """Ids of a stretch of known characters, by the table of prefixes."""
        token, size = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        pair, many = self.pair, len(self.piece)
        for end, (t, n) in self.automaton.iter(s):
            end += 1
            if size[end]:
                continue
            if n < end:
                a = token[end - n]
                ok = pair.get(a * many + t)
                if ok is None:
                    ok = pair[a * many + t] = self.compatible(a, t)
                if not ok:
                    continue
            token[end], size[end] = t, n
        out, end = [], len(s)
        while end:
            out.append(token[end])
            end -= size[end]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text]))[0]

    def encode_all(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets); nulls have none."""
        raw, off = blanked(col)
        if not len(raw):
            return np.zeros(0, np.int32), off
        blank, line = raw == 32, raw == 10
        head = line.copy()  # a stretch begins at a line end, after one, and at a blank after something else
        head[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        head[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(head)
        stretch = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.r_[start, len(raw)].astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        code = stretch.indices.to_numpy()
        flat, size = self._distinct(stretch.dictionary)
        ends = np.r_[0, np.cumsum(size[code])]
        return flat[_spread(np.cumsum(size) - size, size, code)], ends[np.searchsorted(start, off)]

    def exact(self, col: pa.Array, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether the bytes that each text's ids decode to are the text's."""
        raw, want = string_buffer(col)
        ends = np.r_[0, np.cumsum(self.own_size[ids])][off]
        size = np.diff(want)
        # decoding leaves out the blank that encoding puts before a text
        same = np.diff(ends) == size + (size > 0)
        back = self.own_bytes[_spread(self.own_start, self.own_size, ids)]
        skip = np.zeros(len(back), bool)
        skip[ends[:-1][np.diff(ends) > 0]] = True
        if same.all():
            differs = np.r_[0, np.cumsum(back[~skip] != raw)]
            return differs[want[1:]] == differs[want[:-1]]
        return np.array([ok and bytes(back[a + (b > a) : b]) == bytes(raw[c:d]) for ok, a, b, c, d in zip(same, ends, ends[1:], want, want[1:])], bool)

    def decode(self, ids) -> str:
        parts = [self.plain[i] for i in ids]
        if None in parts:
            at = 0
            while at < len(parts):
                if parts[at] is None:
                    end = at
                    while end < len(parts) and parts[end] is None:
                        end += 1
                    parts[at:end] = [bytes(self.byte_of[int(i)] for i in ids[at:end]).decode("utf-8", "replace"), *[""] * (end - at - 1)]
                    at = end
                else:
                    at += 1
        out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


def _spread(start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the elements of runs (start, size), for each of `which` in turn."""
    n = size[which]
    return np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def blanked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with U+2581 as a blank and one blank put before each that isn't empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.replace_substring(pc.fill_null(col, ""), BLANK, " ")
    return string_buffer(pc.if_else(pc.equal(pc.binary_length(col), 0), "", pc.binary_join_element_wise(" ", col, "")))


_models: dict[int, Model] = {}
_answers: dict[int, Pairs] = {}
_packed: dict[int, bytes] = {}


def model(proto: bytes) -> Model:
    key = hash(proto)
    if key not in _models:
        m = _models[key] = pickle.loads(zstandard.decompress(_packed[key])) if key in _packed else Model(proto)
        if key in _answers:
            _answers[key].ask, m.fits = m.fits.ask, _answers[key]
        _answers[key] = m.fits
    return _models[key]


def forget(proto: bytes) -> None:
    """Drops a model but for its packed tables, which are read in a fraction of the time that making them takes; the answers for pairs stay."""
    key = hash(proto)
    m = _models.pop(key, None)
    if m is not None:
        if key not in _packed:
            _packed[key] = zstandard.compress(pickle.dumps(m, pickle.HIGHEST_PROTOCOL), 1)
        m.fits.ask = None  # it holds the model


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _rows(names: list[str], text: str, proto: bytes, check: bool):
    def run(batches):
        m = model(proto)
        for whole in batches:
            for b in slices(whole, text, SLICE):
                col = b.column(text)
                none = col.is_null()
                ids, off = m.encode_all(col)
                cols = {n: b.column(n) for n in names if n in b.schema.names}
                cols["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()), mask=none)
                cols["n_ids"] = pc.if_else(none, None, pa.array(np.diff(off), pa.int32()))
                if check:
                    cols["exact"] = pc.if_else(none, None, pa.array(m.exact(col, ids, off)))
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)
        del m
        forget(proto)  # as a worker that waits for a task would keep it

    return run


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """The columns `keep` (all), ids and n_ids; with check also exact: whether decoding gives the text."""
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.IntegerType())] + [T.StructField("exact", T.BooleanType())] * check
    fresh = {f.name for f in new}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in fresh]
    fields = [f for f in docs.schema.fields if f.name in keep] + new
    needed = [c for c in docs.columns if c in keep or c == text]
    return docs.select(*["`" + c.replace("`", "``") + "`" for c in needed]).mapInArrow(trimmed(_rows([f.name for f in fields], text, _read(path), check)), T.StructType(fields))


def _texts(ids: str, proto: bytes, names: list[str]):
    def run(batches):
        m = model(proto)
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            cols["decoded"] = pa.array([None if v is None else m.decode(v) for v in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return run


def decode(rows: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """rows and decoded, the text of the ids; bytes that are no UTF-8 become U+FFFD."""
    fields = [f for f in rows.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.StringType())]
    return rows.mapInArrow(_texts(ids, _read(path), [f.name for f in fields]), T.StructType(fields))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"], check=True)
