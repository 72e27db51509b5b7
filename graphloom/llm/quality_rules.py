"""Operator 10, quality rules: a short-circuit cascade.

Each rule is a JVM-side predicate that is true for a text to reject. Its cost (seconds) and
selectivity (share rejected) are measured on a sample; the rules are then joined with OR in
descending order of rejection per cost, so a text that an early cheap rule rejects never reaches
the later ones. The order changes only the time, never the rows.

Defined results: a null, empty or blank text is rejected; a null id is a row like any other;
repeated rows are each judged, and rules that tie in gain are tried the cheaper first; very long texts are judged whole; an empty table gives no rows;
columns of the input other than id and text are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import table


@dataclass(frozen=True)
class Rule:
    name: str
    spark: str
    duck: str


def _ratio(name: str, cls: str, most: float) -> Rule:
    return Rule(name, f"regexp_count(t, '{cls}') > {most} * length(t)", f"length(regexp_replace(t, '[^{cls[1:-1]}]', '', 'g')) > {most} * length(t)")


_W = r"split(regexp_replace(t, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', ''), '[ \\t\\r\\n]+')"
_DW = r"string_split_regex(regexp_replace(t, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '[ \t\r\n]+')"
_L = r"filter(split(t, '\\n'), x -> length(trim(x)) > 0)"
_DL = r"list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) > 0)"

RULES = [
    Rule("blank", r"NOT (t RLIKE '[^ \\t\\r\\n]')", r"NOT regexp_matches(t, '[^ \t\r\n]')"),
    _ratio("symbols", "[|&$%#*!<>{}~^]", 0.03),
    _ratio("shouting", "[A-Z]", 0.4),
    _ratio("digits", "[0-9]", 0.8),
    Rule("word_length", r"regexp_count(t, '[^ \\t\\r\\n]+') > length(t) / 3.0 OR regexp_count(t, '[^ \\t\\r\\n]+') < length(t) / 30.0", r"len(regexp_extract_all(t, '[^ \t\r\n]+')) > length(t) / 3.0 OR len(regexp_extract_all(t, '[^ \t\r\n]+')) < length(t) / 30.0"),
    Rule("ellipsis", rf"regexp_count(t, '(?m)\\.\\.\\.$') > 0.3 * size({_L})", rf"len(regexp_extract_all(t, '(?m)\.\.\.$')) > 0.3 * len({_DL})"),
    Rule("bullets", rf"size({_L}) > 3 AND regexp_count(t, '(?m)^[-*]') > 0.9 * size({_L})", rf"len({_DL}) > 3 AND len(regexp_extract_all(t, '(?m)^[-*]')) > 0.9 * len({_DL})"),
    Rule("repeated_lines", f"aggregate(array_distinct({_L}), 0, (a, x) -> a + length(x)) < 0.5 * aggregate({_L}, 0, (a, x) -> a + length(x))", f"list_sum(list_transform(list_distinct({_DL}), lambda x: length(x))) < 0.5 * list_sum(list_transform({_DL}, lambda x: length(x)))"),
    Rule("few_words", f"size({_W}) >= 20 AND size(array_distinct({_W})) < 0.2 * size({_W})", f"len({_DW}) >= 20 AND len(list_distinct({_DW})) < 0.2 * len({_DW})"),
    Rule("stutter", f"size({_W}) >= 10 AND size(filter(zip_with({_W}, slice({_W}, 2, greatest(size({_W}) - 1, 0)), (a, b) -> a = b), x -> x)) > 0.2 * size({_W})", f"len({_DW}) >= 10 AND len(list_filter(list_zip({_DW}[:-2], {_DW}[2:]), lambda x: x[1] = x[2])) > 0.2 * len({_DW})"),
]


def _col(rule: Rule, text: str) -> Column:
    """The rule's predicate on the column `text`, false for null."""
    quoted = "`" + text.replace("`", "``") + "`"
    return F.coalesce(F.expr(re.sub(r"(?<![\w'\\])t(?![\w'])", lambda _: quoted, rule.spark)), F.lit(False))


def estimate(docs: DataFrame, text: str = "text", sample_rows: int = 2000, rules: list[Rule] = RULES) -> list[dict]:
    """Cost and selectivity of each rule, best rejection per cost first.

    sample_rows bounds the sample. It is a fifth of the rows of as many partitions, from the first on, as
    it takes to fill it: files that are sorted by source may give an order that suits the first
    source best, which costs time and changes no row.
    """
    rows = docs.sample(0.2, seed=7).select(F.col(text).alias(text)).take(sample_rows)
    # a table of Arrow needs no Python workers, which would stay
    part = docs.sparkSession.createDataFrame(pa.table({text: pa.array([r[0] for r in rows], pa.string())})).coalesce(1).persist()
    try:
        rows = part.count()
        began = time.perf_counter()
        part.agg(F.sum(F.length(text))).collect()
        base = time.perf_counter() - began
        found = []
        for rule in rules:
            began = time.perf_counter()
            hit = part.agg(F.sum(_col(rule, text).cast("int"))).first()[0] or 0
            cost = max(time.perf_counter() - began - base, 1e-3)
            found.append({"rule": rule, "cost": cost, "selectivity": hit / max(rows, 1), "gain": hit / max(rows, 1) / cost})
    finally:
        part.unpersist()
    return sorted(found, key=lambda x: (-x["gain"], x["cost"]))


def reject(rules: list[Rule], text: str = "text") -> Column:
    """True where a rule rejects; the rules are tried in the order given."""
    out = F.col(text).isNull()
    for rule in rules:
        out = out | _col(rule, text)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(id, keep) for each row."""
    src = docs.select(F.col(id_col), F.col(text))
    order = [x["rule"] for x in estimate(src, text, rules=rules)]
    return src.select(id_col, (~reject(order, text)).alias("keep"))


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    return docs.filter(~reject([x["rule"] for x in estimate(docs, text, rules=rules)], text))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE = "SELECT doc_id, t IS NOT NULL AND NOT (" + " OR ".join(f"coalesce(({r.duck}), false)" for r in RULES) + ") AS keep FROM (SELECT doc_id, text AS t FROM documents)"
