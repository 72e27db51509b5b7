import random
import re
import time

import numpy as np
import pyarrow as pa

from graphloom.llm import licenses as L
from graphloom.llm.text import Words


def brute_statistics(templates, seq):
    out = []
    for i in range(1, len(seq) + 1):
        n = 0
        for k in range(1, i + 1):
            run = seq[i - k : i]
            if any(run == t[j : j + k] for t in templates for j in range(len(t) - k + 1)):
                n = k
        out.append(n)
    return out


def test_statistics_and_places_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        templates = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 14))] for _ in range(rnd.randrange(1, 4))]
        a = L.Automaton(templates)
        seq = [rnd.randrange(4) for _ in range(25)]
        stats = list(a.statistics(seq))
        assert [n for n, _ in stats] == brute_statistics(templates, seq)
        for i, (n, state) in enumerate(stats):
            if n:
                run = seq[i + 1 - n : i + 1]
                assert a.places[state] == {(s, j + n) for s, t in enumerate(templates) for j in range(len(t) - n + 1) if t[j : j + n] == run}


def brute_runs(seq, template, shortest):
    """(place in seq, place in the template, length) of the common runs of `shortest` or more that end where no longer one goes on."""
    found = set()
    stats = brute_statistics(template, seq)
    for end, n in enumerate(stats, 1):
        if n >= shortest and (end == len(seq) or stats[end] <= n):
            for k, t in enumerate(template):
                found |= {(k, end - n, j, n) for j in range(len(t) - n + 1) if t[j : j + n] == seq[end - n : end]}
    return found


def brute_chains(runs, size, cover, gap):
    """Spans by the definition: of the free runs the best chain, until none covers enough."""
    out, free = [], sorted(runs)
    while free:
        best = []
        for x, y, n in free:
            most, start = n, x
            for (px, py, pn), (value, first) in zip(free, best):
                over = max(0, px + pn - x, py + pn - y)
                if px < x and py < y and over < n and x - px - pn <= gap and value + n - over >= most and value + n - over > n:
                    most, start = value + n - over, first
            best.append((most, start))
        k = max(range(len(free)), key=lambda i: (best[i][0], -free[i][0], -i))
        if best[k][0] < cover * size:
            return out
        a, b = best[k][1], free[k][0] + free[k][2]
        out.append((a, b, min(best[k][0], size)))
        free = [r for r in free if r[0] + r[2] <= a or r[0] >= b]
    return out


def naive(text, scanner, templates=L.TEMPLATES):
    """Spans of a text by brute force: every common run, every chain, then none within a better one."""
    words = lambda t: re.findall(r"[a-z0-9_\x80-\U0010ffff]+", t.lower())
    seq, own = words(text), [words(templates[n]) for n in scanner.names]
    spans = []
    runs = brute_runs(seq, own, scanner.shortest)
    for k, name in enumerate(scanner.names):
        mine = {r[1:] for r in runs if r[0] == k}
        spans += [(name, a, b, n, n / len(own[k])) for a, b, n in brute_chains(mine, len(own[k]), scanner.cover, scanner.gap)]
    better = lambda x, y: (-x[3], -x[4], x[0], x[1]) < (-y[3], -y[4], y[0], y[1])
    return sorted((x[:4] for x in spans if not any(y[1] <= x[1] and x[2] <= y[2] and better(y, x) for y in spans)), key=lambda x: (x[1], x[2], x[0]))


def test_chains_against_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        templates = {f"t{k}": " ".join(rnd.choice("abcde") for _ in range(rnd.randrange(4, 16))) for k in range(3)}
        s = L.Scanner(templates, 2, 0.5, 3)
        text = " ".join(rnd.choice([*templates.values(), "a b x", "d", "x x x x"]) for _ in range(rnd.randrange(1, 7)))
        h = Words(pa.array([text])).hashes
        assert s.spans(h, [(0, len(h))]) == naive(text, s, templates)


def test_ten_thousand_notices_in_one_text():
    s = L.Scanner()
    for name in ("MIT-notice", "GPL-2.0-or-later", "BSD-3-Clause"):
        many = 10_000 if name == "MIT-notice" else 500
        h = Words(pa.array([(L.TEMPLATES[name] + " x y z ") * many])).hashes
        began = time.perf_counter()
        got = s.spans(h, [(a, b) for _, a, b in s.stretches(h, np.array([0, len(h)]))])
        assert [x[0] for x in got] == [name] * many
        assert time.perf_counter() - began < 20


def test_every_template_is_found_under_its_name():
    s = L.Scanner()
    for name, text in L.TEMPLATES.items():
        h = Words(pa.array([text])).hashes
        assert s.spans(h, [(0, len(h))])[0][0] == name, name


def whole(text, s):
    h = Words(pa.array([text])).hashes
    return s.spans(h, [(0, len(h))])


def test_scan(spark):
    rnd = random.Random(2)
    prose = [f"p{k}" for k in range(50)]
    rows, want = [], {}
    names = sorted(L.TEMPLATES)
    for i in range(120):
        before, after = rnd.choices(prose, k=rnd.randrange(0, 40)), rnd.choices(prose, k=rnd.randrange(0, 40))
        body, hits = [], []
        for name in rnd.sample(names, rnd.choice([0, 1, 1, 2])):
            w = L.TEMPLATES[name].split()
            if len(w) > 20 and rnd.random() < 0.5:
                w[9:11] = ["changed"]
            body += w + rnd.choices(prose, k=14)
            hits.append(name)
        rows.append((i, " ".join(before + body + after)))
        want[i] = hits
    rows += [(500, None), (501, ""), (None, L.TEMPLATES["ISC"]), (502, L.TEMPLATES["ISC"]), (502, L.TEMPLATES["ISC"]), (503, "Licensed under the"), (504, (L.TEMPLATES["MIT-notice"] + " x y z ") * 40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = L.scan(df).collect()
    s = L.Scanner()
    cache = {t: naive(t, s) for _, t in rows[:5] + rows[-4:-1] if t}
    assert all(cache[t] == whole(t, s) for t in cache)
    expect = sorted((str(i), *x) for i, t in rows if t for x in whole(t, s))
    assert sorted((str(r.doc_id), r.license, r.start_word, r.end_word, r.covered) for r in got) == expect
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.license)
    assert all(set(hits) <= found.get(i, set()) for i, hits in want.items())
    assert all(i not in found for i, hits in want.items() if not hits)
    assert sum(r.doc_id == 504 for r in got) == 40 and sum(r.doc_id == 502 for r in got) == 2 * sum(r.doc_id is None for r in got)
    assert L.scan(df.limit(0)).count() == 0
