import random
import re

from graphloom.llm import quality_rules as Q

WORDS = re.compile(r"[^ \t\r\n]+")


def brute(t):
    """The names of the rules that reject a text, one by one."""
    if t is None:
        return {"null"}
    out = set()
    words, lines = WORDS.findall(t), [x for x in t.split("\n") if x.strip(" ")]
    if not words:
        out.add("blank")
    for name, cls, most in (("symbols", "|&$%#*!<>{}~^", 0.03), ("shouting", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.4), ("digits", "0123456789", 0.8)):
        if sum(c in cls for c in t) > most * len(t):
            out.add(name)
    if len(words) > len(t) / 3 or len(words) < len(t) / 30:
        out.add("word_length")
    raw = t.split("\n")
    if sum(x.endswith("...") for x in raw) > 0.3 * len(lines):
        out.add("ellipsis")
    if len(lines) > 3 and sum(x[:1] in ("-", "*") and x != "" for x in raw) > 0.9 * len(lines):
        out.add("bullets")
    if sum(map(len, set(lines))) < 0.5 * sum(map(len, lines)):
        out.add("repeated_lines")
    if len(words) >= 20 and len(set(words)) < 0.2 * len(words):
        out.add("few_words")
    if len(words) >= 10 and sum(a == b for a, b in zip(words, words[1:])) > 0.2 * len(words):
        out.add("stutter")
    return out


def texts():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    yield from [None, "", " \n\t ", "a", "A B C D", "12345 67890 1", "x" * 100, "a b c d e f", "one two three.\n...\nmore...", "good " * 30, "the the the the a b c d e f g h"]
    for _ in range(150):
        kind = rnd.randrange(7)
        t = prose(rnd.randrange(5, 80))
        yield [t, t.upper(), t + " #$%" * rnd.randrange(9), "\n".join(["- " + prose(4)] * rnd.randrange(1, 8)), "\n".join(prose(5) + rnd.choice(["", "..."]) for _ in range(6)), " ".join(rnd.choice(["aa", "bb", "cc", "dd"]) for _ in range(40)), "\n".join("* " + prose(5) for _ in range(rnd.randrange(2, 9)))][kind]
    yield prose(100_000)  # a very long text, good to its end
    yield prose(60_000) + " zz zz" * 40_000  # and one that is bad in its second half only


def test_rules_against_brute_force_in_any_order(spark):
    own = list(texts())
    rows = [(i, t, "k", True) for i, t in enumerate(own)] + [(None, own[20], None, None), (3, own[3], "k", True), (3, own[3], "k", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string, keep boolean")
    want = sorted(((r[0] is not None, r[0]), not brute(r[1])) for r in rows)
    assert 20 < sum(k for _, k in want) < len(want) - 20
    got = Q.judge(df).collect()
    assert sorted(((r.doc_id is not None, r.doc_id), r.keep) for r in got) == want
    back = df.select("doc_id", (~Q.reject(Q.RULES[::-1], "text")).alias("keep")).collect()
    assert sorted(((r.doc_id is not None, r.doc_id), r.keep) for r in back) == want
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == sorted(k for k, good in want if good)
    assert Q.judge(df.limit(0)).count() == 0 and Q.keep_good(df.limit(0)).count() == 0


def test_each_rule_rejects_and_the_best_comes_first(spark):
    own = [t for t in texts() if t]
    df = spark.createDataFrame([(t,) for t in own[:-2]], "text string")
    found = Q.estimate(df, sample_rows=10_000)
    assert {x["rule"].name for x in found} == {r.name for r in Q.RULES}
    assert [x["gain"] for x in found] == sorted((x["gain"] for x in found), reverse=True)
    for rule in Q.RULES:
        hit = [r.hit for r in df.select("text", Q._col(rule, "text").alias("hit")).collect()]
        assert hit == [rule.name in brute(t) for t in own[:-2]], rule.name
