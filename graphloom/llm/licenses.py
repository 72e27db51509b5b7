"""Operator 3, licence scans with a generalised suffix automaton.

The words of all templates form one suffix automaton. The words of a document are streamed
through it, which gives at each word the longest run ending there that occurs in any template
(matching statistics). Runs of `shortest` words or more that cannot be longer are chained, template by template, in
order of both texts; a chain that covers `cover` of a template's words is reported with the span
of the document that it takes up. A span within another one that covers more words is left out, so that
a licence isn't reported again as one that it contains. Documents that share no `shortest`-gram with a template, found
by one set lookup on gram hashes, cannot hold such a run and skip the automaton.

Defined results: null, empty and wordless texts and tables hold nothing; null ids pass through;
repeated rows are each reported; texts are streamed whole; of chains that tie the earlier start
wins, of templates that tie over the same words the one that is covered most, then the first name; a template that occurs several times is reported each time; columns other than id and text
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .store import table
from .text import Words, grams, slices

SHORTEST, COVER, GAP = 4, 0.6, 12

class Automaton:
    """Suffix automaton of several sequences. next, link, length: by state; places: (sequence, end) where the state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        for s, seq in enumerate(sequences):
            last = 0
            for end, word in enumerate(seq, 1):
                last = self._add(last, word)
                self.places[last].add((s, end))
        for state in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.places[self.link[state]] |= self.places[state]
        self.places[0] = set()

    def _state(self, length: int) -> int:
        self.next.append({}), self.link.append(0), self.length.append(length), self.places.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        c = self._state(self.length[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def statistics(self, seq):
        """(length, state) at each element of seq."""
        state, n = 0, 0
        for word in seq:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                n += 1
            yield n, state


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, shortest: int = SHORTEST, cover: float = COVER, gap: int = GAP):
        self.names = sorted(templates)
        words = [Words(pa.array([templates[n]])).hashes for n in self.names]
        self.size = [len(w) for w in words]
        if min(self.size) < shortest:
            raise ValueError(f"a template has fewer than {shortest} words")
        self.automaton = Automaton([w.tolist() for w in words])
        self.grams = np.unique(np.concatenate([grams(w, shortest)[: len(w) - shortest + 1] for w in words]))
        self.shortest, self.cover, self.gap = shortest, cover, gap

    def stretches(self, h: np.ndarray, off: np.ndarray):
        """(text, start, end) of stretches whose successive grams are all in templates."""
        if len(h) < self.shortest:
            return
        g = grams(h, self.shortest)
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == g)
        doc = np.searchsorted(off, hit, "right") - 1
        ok = hit + self.shortest <= off[doc + 1]
        hit, doc = hit[ok], doc[ok]
        if not len(hit):
            return
        head = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(doc) > 0)])
        for a, b in zip(head, np.r_[head[1:], len(hit)]):
            yield int(doc[a]), int(hit[a] - off[doc[a]]), int(hit[b - 1] - off[doc[a]] + self.shortest)

    def spans(self, h: np.ndarray, stretches: list[tuple[int, int]]) -> list[tuple[str, int, int, int]]:
        """(template, start, end, covered words) of one text."""
        by: dict[int, set[tuple[int, int, int]]] = {}
        for a, b in stretches:
            stats = list(self.automaton.statistics(h[a:b].tolist()))
            for i, (n, state) in enumerate(stats):
                if n >= self.shortest and (i + 1 == len(stats) or stats[i + 1][0] <= n):
                    for s, end in self.automaton.places[state]:
                        by.setdefault(s, set()).add((a + i + 1 - n, end - n, n))
        out = []
        for s, runs in sorted(by.items()):
            out += self._chains(s, sorted(runs))
        return _outermost(out, dict(zip(self.names, self.size)))

    def _chains(self, s: int, runs: list[tuple[int, int, int]]):
        """The best chain first, then the best of those runs that are beyond what was taken.

        A run's predecessors begin within the gap and the longest run before it, and a chain has at most as
        many runs as the template has words, so taking a chain changes few values behind it.
        """
        found, starts = [], [r[0] for r in runs]
        back_to = self.gap + max(n for _, _, n in runs)
        best, back, gone = [0] * len(runs), [-1] * len(runs), [False] * len(runs)

        def value(i: int) -> tuple[int, int]:
            x, y, n = runs[i]
            most, via = n, -1
            for j in range(i - 1, bisect_left(starts, x - back_to) - 1, -1):
                px, py, pn = runs[j]
                over = max(0, px + pn - x, py + pn - y)
                if not gone[j] and px < x and py < y and over < n and x - (px + pn) <= self.gap and best[j] + n - over > most:
                    most, via = best[j] + n - over, j
            return most, via

        for i in range(len(runs)):
            best[i], back[i] = value(i)
        heap = [(-best[i], starts[i], i) for i in range(len(runs))]
        heapify(heap)
        while heap:
            most, _, end = heappop(heap)
            if gone[end]:
                continue
            if -most != best[end]:
                heappush(heap, (-best[end], starts[end], end))
                continue
            if -most < self.cover * self.size[s]:
                break
            i = end
            while back[i] >= 0:
                i = back[i]
            a, b = runs[i][0], runs[end][0] + runs[end][2]
            found.append((self.names[s], a, b, min(-most, self.size[s])))
            changed = a
            for i in range(bisect_left(starts, a - back_to), bisect_left(starts, b)):
                if not gone[i] and runs[i][0] + runs[i][2] > a:
                    gone[i], changed = True, max(changed, runs[i][0])
            for i in range(bisect_left(starts, b), len(runs)):
                if starts[i] > changed + back_to:
                    break
                if not gone[i]:
                    now = value(i)
                    if now != (best[i], back[i]):
                        (best[i], back[i]), changed = now, starts[i]
        return found


def _outermost(spans: list[tuple[str, int, int, int]], size: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """Of spans (template, start, end, covered), in order of start, those not within one that covers more words (of as many, a larger share; then the first name)."""
    order = sorted(spans, key=lambda x: (-x[3], -x[3] / size[x[0]], x[0], x[1]))
    first, reach, kept = [], [], []  # kept spans by start, and how far those up to each reach
    for x in order:
        i = bisect_right(first, x[1])
        if i and reach[i - 1] >= x[2]:
            continue
        kept.append(x)
        first.insert(i, x[1])
        reach.insert(i, max(x[2], reach[i - 1] if i else 0))
        for k in range(i + 1, len(reach)):
            if reach[k] >= x[2]:
                break
            reach[k] = x[2]
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, shortest: int = SHORTEST, cover: float = COVER) -> DataFrame:
    """(id, license, start_word, end_word, covered, coverage) for each template span, end exclusive."""

    def run(batches):
        s = Scanner(templates, shortest, cover)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                by: dict[int, list] = {}
                for d, a, b in s.stretches(w.hashes, w.off):
                    by.setdefault(d, []).append((a, b))
                rows = [(d, *x) for d, st in by.items() for x in s.spans(w.hashes[w.off[d] : w.off[d + 1]], st)]
                if rows:
                    d, name, a, b, n = zip(*rows)
                    share = [round(c / s.size[s.names.index(x)], 6) for c, x in zip(n, name)]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(d)), pa.array(name), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int32()), pa.array(share)], ["id", "license", "start_word", "end_word", "covered", "coverage"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, license string, start_word int, end_word int, covered int, coverage double").withColumnRenamed("id", id_col)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
