"""Column expressions for ids, paths and classes of nodes, and patterns turned into regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

BLANKS = r"[\s\x0b\x1c-\x1f\x85 ]+"


def slug(c: Column) -> Column:
    """Lower case, other characters than a-z 0-9 . _ : - as single dashes, none at the ends, `unknown` where nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9._:-]+", "-"), "-{2,}", "-")
    x = F.regexp_replace(x, "^-+|-+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("unknown")).otherwise(x)


def file_id(path: Column) -> Column:
    """`file:` and the slug of each part of the path without its last suffix."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?<=[^/])\.[^./]+$", ""), "/"), lambda p: (p != "") & (p != "."))
    return F.concat(F.lit("file:"), F.array_join(F.transform(parts, slug), "/"))


def entity_id(kind: Column, platform: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, F.when(F.coalesce(platform, F.lit("")) != "", slug(platform)), slug(name))


def words(text: str) -> list[str]:
    """Words of a query as a split at all blanks, separators of federated ids too."""
    return [w for w in re.split(r"[\s\x1c-\x1f]+", text.lower()) if w]


def fnmatch_regex(pattern: str) -> str:
    out = ""
    for part in re.findall(r"\[[!^]?\]?[^\]]*\]|.", pattern, re.S):
        out += ".*" if part == "*" else "." if part == "?" else ("[^" + part[2:] if part[1] in "!^" else part) if len(part) > 1 else re.escape(part)
    return f"(?s)^{out}$"


def glob_regex(pattern: str) -> str:
    """`**` spans folders, `*` and `?` do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return f"^{out}$"


def node_file() -> Column:
    return F.coalesce(F.when(F.col("file") != "", F.col("file")), F.when((F.col("type") == "file") & F.col("id").startswith("file:"), F.expr("substr(id, 6)")), F.lit(""))


def language() -> Column:
    named = F.regexp_replace(F.lower(F.trim("language")), "_", "-")
    alias = F.create_map(*[F.lit(x) for p in S.LANGUAGE_ALIASES.items() for x in p])
    suffix = F.create_map(*[F.lit(x) for p in S.LANGUAGE_OF_SUFFIX.items() for x in p])
    own = F.coalesce(alias[named], F.regexp_replace(named, "-", ""))
    return F.when(F.trim(F.coalesce("language", F.lit(""))) != "", own).otherwise(F.coalesce(suffix[F.lower(F.regexp_extract(node_file(), r"[^/.][^/]*\.([^./]+)$", 1))], F.lit("unknown")))


def unresolved() -> Column:
    return F.col("id").startswith("symbol:unresolved:") | ((F.col("type") == "symbol") & F.coalesce(~F.col("resolved"), F.lit(False)))


def _any(c: str, values) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in values])), F.lit(False))


def _in(c: str, values) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def interacts() -> Column:
    return _in("protocol", S.PROTOCOLS) | _in("surface_kind", S.SURFACE_KINDS) | _in("boundary_kind", S.BOUNDARY_KINDS)


def node_class() -> Column:
    """doc, build, boundary, interface or primary."""
    return (
        F.when(_in("type", S.DOC_TYPES) | _any("roles", S.DOC_ROLES) | _in("doc_kind", S.DOC_DOC_KINDS), "doc")
        .when(_in("type", S.BUILD_TYPES) | _any("roles", S.BUILD_ROLES) | _in("doc_kind", S.BUILD_DOC_KINDS), "build")
        .when(_in("type", S.BOUNDARY_TYPES), "boundary")
        .when(_in("type", S.INTERFACE_TYPES) | interacts(), "interface")
        .otherwise("primary")
    )


def trace_bucket() -> Column:
    return F.when(node_class() == "interface", "interfaces").when((node_class() == "boundary") | _in("type", S.RUNTIME_TYPES), "boundaries").when(_in("type", S.SERVICE_TYPES), "services").when(_in("type", S.CONTRACT_TYPES), "contracts").when(_in("type", S.CHECK_TYPES), "verifications")


def surface() -> Column:
    return F.when(F.col("type") == "command", "cli_commands").when(F.col("type") == "tool", "mcp_tools").when(_in("type", S.API_TYPES), "api_endpoints").when(F.col("type") == "entrypoint", "entrypoints").when(F.col("type") == "boundary", "boundaries")


def test_node() -> Column:
    p = F.lower(F.regexp_replace(F.coalesce("file", F.lit("")), r"\\", "/"))
    return p.rlike(r"_test\.(py|go)|\.test\.(tsx?|js)|(^|/)(tests|__tests__)(/|$)|(^|/)test_[^/]*$") | _any("roles", ["test"])


def _rank(c: str, ranks: dict[str, int]) -> Column:
    out = F
    for k, v in ranks.items():
        out = out.when(F.col(c) == k, v)
    return out.otherwise(99)


def authority_rank() -> Column:
    return _rank("authority", S.AUTHORITY_RANK)


def confidence_rank() -> Column:
    return _rank("confidence", S.CONFIDENCE_RANK)


def authority_relevance() -> Column:
    return F.when(authority_rank() < 4, (4 - authority_rank()) / 4.0).otherwise(0.0)


def resolution_penalty() -> Column:
    return F.when(F.col("id").startswith("symbol:unresolved:") | (F.coalesce(F.col("resolution"), F.lit("")) == "unresolved"), 1).otherwise(0)


def role_boost(roles: tuple[str, ...] = ()) -> Column:
    """0 where the node has one of the roles that are asked for, or none is asked for, else 1."""
    return F.when(_any("roles", roles), 0).otherwise(1) if roles else F.lit(0)
