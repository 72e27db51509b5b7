"""Extractors: from files (path, text) to fragments of a graph.

An extractor is a function of (path, text) that yields node and edge rows; it is registered under
a name and runs over a DataFrame of files, in parallel. Files that can't be parsed give nothing.
"""

from __future__ import annotations

import ast
import json
import re
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..model import Graph, fill
from ..store import cut
from .files import constants

ROW = "kind string, id string, type string, label string, src string, dst string, props_json string"
_extractors: dict[str, tuple[re.Pattern, Callable[[str, str], Iterator[dict]]]] = {}


def extractor(name: str, files: str):
    """Registers an extractor for paths that the regular expression finds."""
    def add(f):
        _extractors[name] = (re.compile(files), f)
        return f

    return add


def names() -> list[str]:
    return sorted(_extractors)


def node(id_: str, kind: str, label: str, **props) -> dict:
    return {"kind": "node", "id": id_, "type": kind, "label": label, "props_json": json.dumps(props, sort_keys=True, ensure_ascii=False)}


def edge(src: str, dst: str, kind: str, **props) -> dict:
    return {"kind": "edge", "type": kind, "src": src, "dst": dst, "props_json": json.dumps(props, sort_keys=True, ensure_ascii=False)}


def run(name: str, files: DataFrame) -> DataFrame:
    """Rows of schema ROW that the extractor finds in files (path, text)."""
    want, f = _extractors[name]

    def work(frames):
        for pdf in frames:
            rows = []
            for path, text in zip(pdf.path, pdf.text):
                if want.search(path):
                    try:
                        rows += list(f(path, text or ""))
                    except (SyntaxError, ValueError, KeyError, TypeError, RecursionError):
                        continue
            yield pd.DataFrame(rows, columns=["kind", "id", "type", "label", "src", "dst", "props_json"], dtype=object)

    return files.select("path", "text").mapInPandas(work, ROW)


def fragment(rows: DataFrame, strategy: str) -> Graph:
    """Nodes and edges of extracted rows, with known properties in their own columns."""
    n = rows.filter("kind = 'node'")
    plain = [f.name for f in S.NODE.fields if f.name not in ("id", "type", "label", "props_json", "source_strategy", "resolved") and f.dataType.typeName() == "string"]
    lists = [f.name for f in S.NODE.fields if f.dataType.typeName() == "array"]
    bag = F.from_json("props_json", ", ".join([f"{c} string" for c in plain] + [f"{c} array<string>" for c in lists] + ["resolved boolean"]))
    n = n.withColumn("p", bag).select("id", "type", "label", "props_json", F.lit(strategy).alias("source_strategy"), *[F.col(f"p.{c}").alias(c) for c in [*plain, *lists, "resolved"]])
    return Graph(fill(n, S.NODE), fill(rows.filter("kind = 'edge'"), S.EDGE))


def discover(files: DataFrame, plan: list[str] | None = None) -> Graph:
    """The graph of files by the extractors of a plan in order; of one id the last extractor's node stays, of one (src, dst, type) the first edge."""
    from ..operators.build import first_of, post_process

    nodes = edges = None
    for i, name in enumerate(plan or names()):
        g = fragment(run(name, files), name)
        n, e = g.nodes.withColumn("pos", F.lit(i)), g.edges.withColumn("pos", F.lit(i))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    # files are read and parsed once
    return post_process(Graph(cut(first_of(nodes, ["id"], [F.desc("pos"), "props_json"]).drop("pos")), cut(first_of(edges, ["src", "dst", "type"], [F.col("pos"), F.col("props_json")]).drop("pos"))))


def external(command: list[str], timeout: int = 30, safe: bool = False) -> dict:
    """A fragment that a command prints as JSON; nothing where it fails, takes too long or prints something else. safe refuses to run commands."""
    if safe:
        return {"nodes": {}, "edges": []}
    try:
        done = subprocess.run(command, capture_output=True, timeout=timeout, text=True, check=True)
        doc = json.loads(done.stdout)
        return {"nodes": dict(doc["nodes"]), "edges": [e for e in doc.get("edges", []) if {"from", "to", "type"} <= e.keys()]}
    except (OSError, subprocess.SubprocessError, ValueError, KeyError, TypeError):
        return {"nodes": {}, "edges": []}


def _stem(path: str) -> str:
    return re.sub(r"(?<=[^/])\.[^./]+$", "", path)


def _file(path: str) -> str:
    return f"file:{_stem(path)}"


def _module(path: str) -> str:
    return re.sub(r"\.__init__$", "", _stem(path).replace("/", "."))


def _name(x) -> str:
    """A dotted name of an expression, or nothing."""
    if isinstance(x, ast.Name):
        return x.id
    if isinstance(x, ast.Attribute) and (base := _name(x.value)):
        return f"{base}.{x.attr}"
    return ""


def _text(x) -> str | None:
    return x.value if isinstance(x, ast.Constant) and isinstance(x.value, str) else None


@extractor("python_module", r"\.py$")
def _python_module(path, text):
    top = ast.parse(text)
    out = [n.name for n in top.body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and not n.name.startswith("_")]
    used = sorted({n.module if isinstance(n, ast.ImportFrom) else a.name for n in ast.walk(top) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names if not isinstance(n, ast.ImportFrom) or n.module and not n.level})
    yield node(_file(path), "file", path.rsplit("/", 1)[-1], file=path, exports=sorted(out), imports_from=used, constants=constants(top), language="python", line_count=text.count("\n") + 1, description=(ast.get_docstring(top) or "").split("\n")[0])


@extractor("python_package", r"(^|/)__init__\.py$")
def _python_package(path, text):
    folder = path.rpartition("/")[0]
    yield node(f"package:{folder.replace('/', '.')}", "package", folder.rsplit("/", 1)[-1], file=path, language="python")
    yield edge(f"package:{folder.replace('/', '.')}", _file(path), "contains")
    if "/" in folder:
        yield edge(f"package:{folder.rpartition('/')[0].replace('/', '.')}", f"package:{folder.replace('/', '.')}", "contains")


@extractor("python_callgraph", r"\.py$")
def _python_callgraph(path, text):
    import sys

    top, mod = ast.parse(text), _module(path)
    local, imported = {}, {}
    for n in ast.walk(top):
        if isinstance(n, ast.Import):
            imported |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            imported |= {a.asname or a.name: f"{n.module}.{a.name}" for a in n.names}

    def walk(body, prefix):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                local[prefix + n.name] = n
                yield from walk(n.body, prefix + n.name + ".")
            elif isinstance(n, ast.ClassDef):
                yield from walk(n.body, prefix + n.name + ".")

    list(walk(top.body, ""))
    for q, f in local.items():
        own = f"symbol:py:{mod}:{q}"
        yield node(own, "symbol", q, file=path, qualname=q, module=mod, language="python", line=f.lineno)
        seen = set()
        for c in ast.walk(f):
            if not isinstance(c, ast.Call) or not (called := _name(c.func)):
                continue
            head, _, rest = called.partition(".")
            scope = q.rpartition(".")[0]
            if head == "self" and rest and f"{scope}.{rest}" in local:
                to, ok = f"symbol:py:{mod}:{scope}.{rest}", True
            elif called in local:
                to, ok = f"symbol:py:{mod}:{called}", True
            elif head in imported and imported[head].split(".")[0] not in sys.stdlib_module_names:
                m, _, n = (imported[head] + ("." + rest if rest else "")).rpartition(".")
                to, ok = f"symbol:py:{m}:{n}", True
            else:
                to, ok = f"symbol:unresolved:{called.rsplit('.', 1)[-1]}", False
                if head in imported:
                    continue
            if (to, ok) not in seen:
                seen.add((to, ok))
                if not ok:
                    yield node(to, "symbol", called.rsplit(".", 1)[-1], qualname=called.rsplit(".", 1)[-1], resolved=False)
                yield edge(own, to, "calls", resolved=ok, provenance={"file": path, "line": c.lineno})


def _decorated(top, verbs: str):
    for n in ast.walk(top):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in n.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and re.fullmatch(verbs, d.func.attr):
                    yield n, d


@extractor("fastapi", r"\.py$")
def _fastapi(path, text):
    top = ast.parse(text)
    prefix = {t.id: next((_text(k.value) or "" for k in n.value.keywords if k.arg == "prefix"), "") for n in top.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and _name(n.value.func).endswith("APIRouter") for t in n.targets if isinstance(t, ast.Name)}
    for f, d in _decorated(top, "get|post|put|patch|delete|head|options"):
        if d.args and (p := _text(d.args[0])) is not None:
            full = prefix.get(_name(d.func.value), "") + p
            id_ = f"route:{d.func.attr.upper()}:{full}"
            yield node(id_, "route", f"{d.func.attr.upper()} {full}", file=path, protocol="http", boundary_kind="inbound", surface_kind="request_response", transport="http", line=f.lineno)
            yield edge(_file(path), id_, "exposes")
            if model := next((_name(k.value) for k in d.keywords if k.arg == "response_model"), ""):
                yield edge(id_, f"contract:{model}", "responds_with")
            for a in f.args.args:
                if a.annotation is not None and (t := _name(a.annotation)) and t[0].isupper() and t not in ("Request", "Response"):
                    yield edge(id_, f"contract:{t}", "accepts")


def _classes(text: str, bases: str):
    for n in ast.walk(ast.parse(text)):
        if isinstance(n, ast.ClassDef) and any(re.fullmatch(bases, _name(b).rsplit(".", 1)[-1]) for b in n.bases):
            yield n


@extractor("pydantic", r"\.py$")
def _pydantic(path, text):
    for c in _classes(text, "BaseModel|BaseSettings"):
        yield node(f"contract:{c.name}", "contract", c.name, file=path, members=[n.target.id for n in c.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)], description=(ast.get_docstring(c) or "").split("\n")[0])
    for c in _classes(text, "Enum|StrEnum|IntEnum"):
        yield node(f"enum:{c.name}", "enum", c.name, file=path, members=[t.id for n in c.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)])


@extractor("sqlalchemy", r"\.py$")
def _sqlalchemy(path, text):
    for c in _classes(text, ".*"):
        table = next((_text(n.value) for n in c.body if isinstance(n, ast.Assign) and any(_name(t) == "__tablename__" for t in n.targets)), None)
        if table:
            calls = [x for x in ast.walk(c) if isinstance(x, ast.Call)]
            cols = [(n.target if isinstance(n, ast.AnnAssign) else n.targets[0]).id for n in c.body if isinstance(n, (ast.Assign, ast.AnnAssign)) and isinstance(n.value, ast.Call) and re.search("(Column|mapped_column)$", _name(n.value.func))]
            yield node(f"entity:{c.name}", "entity", c.name, file=path, table=table, columns=cols)
            for x in calls:
                if _name(x.func).endswith("ForeignKey") and x.args and (to := _text(x.args[0])):
                    yield edge(f"entity:{c.name}", f"__table__:{to.split('.')[0]}", "depends_on", ref=to)


@extractor("http_client", r"\.py$")
def _http_client(path, text):
    for c in ast.walk(ast.parse(text)):
        if isinstance(c, ast.Call) and (m := re.fullmatch(r"(?:httpx|requests)\.(get|post|put|patch|delete|head)", _name(c.func))) and c.args and (url := _text(c.args[0])):
            id_ = f"rpc:http:out:{m[1].upper()}:{url}"
            yield node(id_, "rpc", f"{m[1].upper()} {url}", declared_in=path, protocol="http", boundary_kind="outbound", surface_kind="request_response")
            yield edge(_file(path), id_, "invokes")


@extractor("grpc_proto", r"\.proto$")
def _grpc_proto(path, text):
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    package = (re.search(r"^\s*package\s+([\w.]+)\s*;", text, re.M) or [None, ""])[1]
    full = lambda n: n if "." in n or not package else f"{package}.{n}"
    for kind, name in re.findall(r"\b(message|enum)\s+(\w+)\s*\{", text):
        t = "contract" if kind == "message" else "enum"
        yield node(f"{t}:grpc:{full(name)}", t, name, file=path, protocol="grpc")
        yield edge(_file(path), f"{t}:grpc:{full(name)}", "contains")
    for m in re.finditer(r"\bservice\s+(\w+)\s*\{", text):
        depth, end = 1, m.end()
        while depth and end < len(text):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        for rpc, s1, a, s2, b in re.findall(r"\brpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)", text[m.end() : end]):
            id_ = f"rpc:grpc:{full(m[1])}.{rpc}"
            yield node(id_, "rpc", f"{m[1]}.{rpc}", file=path, protocol="grpc", boundary_kind="inbound", transport="http2", surface_kind="stream" if s1 or s2 else "request_response")
            yield edge(_file(path), id_, "contains")
            yield edge(id_, f"contract:grpc:{full(a)}", "accepts")
            yield edge(id_, f"contract:grpc:{full(b)}", "responds_with")


@extractor("grpc_bindings", r"\.py$")
def _grpc_bindings(path, text):
    """Servicers implement and stubs invoke methods; the service's package isn't known here."""
    top = ast.parse(text)
    for c in _classes(text, r"\w+Servicer"):
        service = next(_name(b).rsplit(".", 1)[-1][: -len("Servicer")] for b in c.bases if _name(b).endswith("Servicer"))
        for f in c.body:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.name[0].isupper():
                yield edge(_file(path), f"rpc:grpc:{service}.{f.name}", "implements")
    stubs = {t.id: _name(n.value.func).rsplit(".", 1)[-1][:-4] for n in ast.walk(top) if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and _name(n.value.func).endswith("Stub") for t in n.targets if isinstance(t, ast.Name)}
    for c in ast.walk(top):
        if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute) and _name(c.func.value) in stubs:
            yield edge(_file(path), f"rpc:grpc:{stubs[_name(c.func.value)]}.{c.func.attr}", "invokes")


_PRODUCE, _CONSUME = r"(send|produce|publish|emit|send_and_wait)", r"(subscribe|consume|listen|on_event)"


@extractor("events", r"\.py$")
def _events(path, text):
    for c in ast.walk(ast.parse(text)):
        if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute) and c.args:
            side = "produces" if re.fullmatch(_PRODUCE, c.func.attr) else "consumes" if re.fullmatch(_CONSUME, c.func.attr) else ""
            first = c.args[0].elts[0] if isinstance(c.args[0], (ast.List, ast.Tuple)) and c.args[0].elts else c.args[0]
            if side and (topic := _text(first)) and re.fullmatch(r"[\w.\-/:]+", topic):
                yield node(f"channel:{topic}", "channel", topic, declared_in=path, protocol="event", surface_kind="pub_sub", boundary_kind="outbound" if side == "produces" else "inbound")
                yield edge(_file(path), f"channel:{topic}", side)


_SECTIONS = [(k, words.split("|")) for k, words in (x.split(">") for x in """setup>install|setup|getting started|quickstart|quick start|prerequisite|requirements
configuration>config|environment variable|settings
api-reference>api reference|api doc|endpoints
architecture>architecture|design|system overview|component
troubleshooting>troubleshoot|debug|common error|common issue|faq
overview>overview|introduction|summary|context
deployment>deploy|release|ci/cd
usage>usage|examples|how to
testing>test|verification
migration>migrat|upgrade
security>security|auth|permission|access control
contributing>contribut|development""".split("\n"))]  # fmt: skip


def section_kind(title: str) -> str | None:
    low = title.lower()
    return next((k for k, words in _SECTIONS if any(w in low for w in words)), None)


@extractor("markdown", r"\.md$")
def _markdown(path, text):
    lines, id_ = text.split("\n"), f"doc:{_stem(path)}"
    title = next((x[2:].strip() for x in lines if x.startswith("# ")), _stem(path).rsplit("/", 1)[-1])
    kind = next((k for k in ("adr", "runbook", "policy") if k in path.lower()), "guide")
    yield node(id_, "doc", title, file=path, doc_kind=kind, authority="canonical", confidence="definite", roles=["doc"])
    heads = [(i, x[3:].strip()) for i, x in enumerate(lines, 1) if x.startswith("## ")]
    for (i, h), end in zip(heads, [i - 1 for i, _ in heads[1:]] + [len(lines)]):
        slug = re.sub("[^a-z0-9]+", "-", h.lower()).strip("-")
        more = {"section_kind": k} if (k := section_kind(h)) else {}
        yield node(f"{id_}#{slug}", "doc", h, file=path, doc_kind=kind, span={"start_line": i, "end_line": end}, **more)
        yield edge(id_, f"{id_}#{slug}", "contains")


def _front(text: str) -> dict[str, str]:
    m = re.match(r"---\n(.*?)\n---", text, re.S)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition(":") for x in m[1].split("\n")) if v} if m else {}


@extractor("frontmatter_md", r"\.md$")
def _frontmatter(path, text):
    if f := _front(text):
        name = f.get("name") or _stem(path).rsplit("/", 1)[-1]
        yield node(f"agent:{name}", "agent", name, file=path, **{k: v for k, v in f.items() if k not in ("name", "file")})


@extractor("firstline_md", r"(^|/)commands/.*\.md$")
def _firstline(path, text):
    name = _stem(path).rsplit("/", 1)[-1]
    yield node(f"command:{name}", "command", name, file=path, description=next((x.lstrip("# ").strip() for x in text.split("\n") if x.strip()), ""))


@extractor("runbook", r"(^|/)runbooks?/.*\.md$")
def _runbook(path, text):
    name = _stem(path).rsplit("/", 1)[-1]
    yield node(f"runbook:{name}", "runbook", name, file=path, doc_kind="runbook")
    for s in sorted(set(re.findall(r"\bservice:([\w-]+)", text))):
        yield edge(f"runbook:{name}", f"service:{s}", "documents")


@extractor("manifest", r"(^|/)(package\.json|Makefile)$")
def _manifest(path, text):
    if path.endswith("Makefile"):
        yield node(f"config:{path}", "config", "Makefile", file=path)
        found = re.findall(r"^([A-Za-z][\w-]*)\s*:(?!=)", text, re.M)
    else:
        doc = json.loads(text)
        yield node(f"config:{path}", "config", doc.get("name") or path, file=path)
        found = list(doc.get("scripts") or {})
    for t in dict.fromkeys(found):
        kind = "test-target" if "test" in t else "build-target"
        yield node(f"{kind}:{path}:{t}", kind, t, file=path)
        yield edge(f"config:{path}", f"{kind}:{path}:{t}", "configures")


@extractor("bazel", r"(^|/)BUILD(\.bazel)?$")
def _bazel(path, text):
    folder = path.rpartition("/")[0]
    label = lambda d: d if d.startswith(("//", "@")) else f"//{folder}:{d.lstrip(':')}"
    for c in ast.walk(ast.parse(text)):
        if isinstance(c, ast.Call) and re.fullmatch(r"(py|cc|go|java|rust|sh|ts)_(library|binary|test)", _name(c.func)):
            kw = {k.arg: k.value for k in c.keywords}
            if name := _text(kw.get("name")):
                test = _name(c.func).endswith("_test")
                id_ = f"{'test' if test else 'build'}-target:{label(name)}"
                yield node(id_, id_.split(":")[0], label(name), file=path, rule=_name(c.func))
                for d in [x for e in getattr(kw.get("deps"), "elts", []) if (x := _text(e))]:
                    yield edge(id_, f"build-target:{label(d)}", "depends_on")
                    if test:
                        yield edge(id_, f"build-target:{label(d)}", "tests")


def _load_yaml(text: str):
    try:
        import yaml
    except ImportError:
        raise ValueError("PyYAML is missing") from None
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        raise ValueError("no YAML") from None


@extractor("compose", r"(^|/)(docker-)?compose[\w.-]*\.ya?ml$")
def _compose(path, text):
    services = (_load_yaml(text) or {}).get("services") or {}
    yield node(f"compose:{path}", "compose", path, file=path)
    for s, body in services.items():
        yield node(f"service:{s}", "service", s, file=path, image=(body or {}).get("image"))
        yield edge(f"compose:{path}", f"service:{s}", "orchestrates")
        for d in (body or {}).get("depends_on") or []:
            yield edge(f"service:{s}", f"service:{d}", "depends_on")


@extractor("dockerfile", r"(^|/)Dockerfile[\w.-]*$")
def _dockerfile(path, text):
    yield node(f"dockerfile:{path}", "dockerfile", path, file=path, base=re.findall(r"^FROM\s+(\S+)", text, re.M | re.I))
    if "/" in path:
        yield edge(f"dockerfile:{path}", f"service:{path.split('/')[-2]}", "builds")


@extractor("gh_workflow", r"(^|/)\.github/workflows/[^/]+\.ya?ml$")
def _gh_workflow(path, text):
    doc = _load_yaml(text) or {}
    on = doc.get("on", doc.get(True)) or {}
    yield node(f"workflow:{_stem(path).rsplit('/', 1)[-1]}", "workflow", doc.get("name") or path, file=path, triggers=sorted([on] if isinstance(on, str) else on), jobs=sorted(doc.get("jobs") or {}))


@extractor("yaml_meta", r"\.ya?ml$")
def _yaml_meta(path, text):
    doc = _load_yaml(text)
    if isinstance(doc, dict) and doc.get("name"):
        yield node(f"workflow:{doc['name']}", "workflow", str(doc["name"]), file=path, description=str(doc.get("description") or ""))


@extractor("deploy_surface", r"(^|/)(k8s|deploy|helm|terraform)/.*\.(ya?ml|tf)$")
def _deploy(path, text):
    yield node(f"deploy:{path}", "deploy", path.rsplit("/", 1)[-1], file=path)
    for kind, name in re.findall(r"kind:\s*(Deployment|Service|StatefulSet).*?name:\s*([\w-]+)", text, re.S):
        yield edge(f"deploy:{path}", f"service:{name}", "configures", kind=kind)


@extractor("config_file", r"\.(toml|ini|cfg|env)$")
def _config(path, text):
    yield node(f"config:{path}", "config", path.rsplit("/", 1)[-1], file=path)


@extractor("tool_script", r"(^|/)(tools|scripts)/[^/]+\.(py|sh)$")
def _tool(path, text):
    name = _stem(path).rsplit("/", 1)[-1]
    first = next((x.lstrip("#\"' ").strip() for x in text.split("\n") if x.strip() and not x.startswith("#!")), "")
    yield node(f"tool:{name}", "tool", name, file=path, description=first)


@extractor("worker_stage", r"(^|/)(workers|stages)/[^/]+\.py$")
def _stage(path, text):
    name = _stem(path).rsplit("/", 1)[-1]
    if not name.startswith("_"):
        yield node(f"stage:{name}", "stage", name, file=path)


@extractor("typescript_exports", r"\.(tsx?|jsx?)$")
def _typescript(path, text):
    out = re.findall(r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:enum|type|interface|class|var|let|const|function)\s+(\w+)", text, re.M)
    used = re.findall(r"""(?:^|\n)\s*import\s[^'"\n]*?from\s+['"]([^'"]+)""", text) + re.findall(r"""require\(\s*['"]([^'"]+)""", text)
    yield node(_file(path), "file", path.rsplit("/", 1)[-1], file=path, exports=sorted(set(out)), imports_from=sorted(set(used)), language="typescript", line_count=text.count("\n") + 1)


_OTHER = {"go": ("go", r"^func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)|^type\s+([A-Z]\w*)", r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$'), "rs": ("rust", r"^\s*pub\s+(?:async\s+)?(?:fn|struct|enum|trait|mod)\s+(\w+)", r"^\s*use\s+([\w:]+)"), "java": ("java", r"^\s*public\s+(?:\w+\s+)*?(?:class|interface|enum|record)\s+(\w+)", r"^\s*import\s+(?:static\s+)?([\w.*]+);"), "cs": ("csharp", r"^\s*public\s+(?:\w+\s+)*?(?:class|interface|enum|record|struct)\s+(\w+)", r"^\s*using\s+([\w.]+);"), "cpp": ("cpp", r"^\s*(?:class|struct|enum)\s+(\w+)|^[\w:<>*&\s]+?\b(\w+)\s*\([^;]*\)\s*\{", r'^\s*#include\s+[<"]([^>"]+)')}


@extractor("source_outline", r"\.(go|rs|java|cs|cpp|cc|cxx|hpp|hh|h)$")
def _outline(path, text):
    """Exports and imports of other languages by their declaration lines, in place of a grammar."""
    lang, out, used = _OTHER.get(path.rsplit(".", 1)[-1], _OTHER["cpp"])
    found = sorted({x for m in re.finditer(out, text, re.M) for x in m.groups() if x})
    yield node(_file(path), "file", path.rsplit("/", 1)[-1], file=path, exports=found, imports_from=sorted(set(re.findall(used, text, re.M))), language=lang, line_count=text.count("\n") + 1)


@extractor("boundary_entrypoint", r"\.py$")
def _entrypoint(path, text):
    if re.search(r"""^if __name__ == ['"]__main__['"]""", text, re.M):
        yield node(f"entrypoint:{_module(path)}", "entrypoint", path, file=path, roles=["implementation"])
        yield edge(f"entrypoint:{_module(path)}", _file(path), "exposes")
    if m := re.search(r"\b(FastAPI|Flask)\(", text):
        yield node(f"boundary:{_module(path)}", "boundary", path, file=path, protocol="http", boundary_kind="inbound", framework=m[1])
        yield edge(f"boundary:{_module(path)}", _file(path), "contains")


@extractor("runtime_contract", r"(^|/)Dockerfile[\w.-]*$")
def _runtime(path, text):
    for m in re.findall(r"https?://[^/\s]+(/[\w./-]*)", " ".join(re.findall(r"^HEALTHCHECK.*$", text, re.M))):
        yield node(f"rpc:http:GET:{m}", "rpc", f"GET {m}", declared_in=path, protocol="http", boundary_kind="inbound")
        yield edge(f"dockerfile:{path}", f"rpc:http:GET:{m}", "verifies")
    for p in re.findall(r"^EXPOSE\s+(\d+)", text, re.M):
        yield edge(f"dockerfile:{path}", f"boundary:port:{p}", "exposes")
        yield node(f"boundary:port:{p}", "boundary", f"port {p}", declared_in=path)


@extractor("test_peer", r"(^|/)(test_[^/]+|[^/]+_test)\.py$")
def _test_peer(path, text):
    peer = re.sub(r"^test_|_test$", "", _stem(path).rsplit("/", 1)[-1])
    yield node(_file(path), "file", path.rsplit("/", 1)[-1], file=path, roles=["test"], language="python")
    for m in sorted(set(re.findall(rf"^(?:from|import)\s+([\w.]*\b{re.escape(peer)})\b", text, re.M))):
        yield edge(_file(path), f"file:{m.replace('.', '/')}", "tests")


@extractor("concept_issues", r"issues\.jsonl$")
def _concepts(path, text):
    for line in filter(str.strip, text.split("\n")):
        x = json.loads(line)
        yield node(f"concept:{x['id']}", "concept", x.get("title") or x["id"], description=x.get("description") or "", status=x.get("status"))
        for d in x.get("dependencies") or []:
            yield edge(f"concept:{x['id']}", f"concept:{d['depends_on_id'] if isinstance(d, dict) else d}", "relates_to")


@extractor("ros2_package", r"(^|/)package\.xml$")
def _ros_package(path, text):
    if m := re.search(r"<name>\s*([\w-]+)", text):
        yield node(f"ros_package:{m[1]}", "ros_package", m[1], file=path)
        for d in sorted(set(re.findall(r"<(?:build_|exec_|run_|test_)?depend>\s*([\w-]+)", text))):
            yield edge(f"ros_package:{m[1]}", f"ros_package:{d}", "depends_on")


@extractor("ros2_interfaces", r"\.(msg|srv|action)$")
def _ros_interface(path, text):
    parts = path.split("/")
    package = parts[-3] if len(parts) > 2 else "unknown"
    id_ = f"ros_interface:{package}/{parts[-1]}"
    yield node(id_, "ros_interface", parts[-1], file=path, protocol="ros2", fields=re.findall(r"^\s*([\w/\[\]]+\s+\w+)", text, re.M))
    yield edge(f"ros_package:{package}", id_, "contains")


@extractor("ros2_cmake", r"(^|/)CMakeLists\.txt$")
def _ros_cmake(path, text):
    if not (m := re.search(r"project\(\s*([\w-]+)", text)):
        return
    own = f"ros_package:{m[1]}"
    yield node(own, "ros_package", m[1], file=path)
    for d in re.findall(r"find_package\(\s*([\w-]+)", text):
        yield edge(own, f"ros_package:{d}", "depends_on")
    for t in re.findall(r"add_executable\(\s*([\w-]+)", text):
        yield node(f"build-target:{m[1]}:{t}", "build-target", t, file=path)
        yield edge(own, f"build-target:{m[1]}:{t}", "builds")


@extractor("ros2_launch", r"\.launch\.py$")
def _ros_launch(path, text):
    for c in ast.walk(ast.parse(text)):
        if isinstance(c, ast.Call) and _name(c.func).rsplit(".", 1)[-1] == "Node":
            kw = {k.arg: _text(k.value) for k in c.keywords}
            if kw.get("package") and kw.get("executable"):
                id_ = f"ros_node:{kw['package']}/{kw.get('name') or kw['executable']}"
                yield node(id_, "ros_node", kw.get("name") or kw["executable"], file=path)
                yield edge(_file(path), id_, "orchestrates")
                yield edge(id_, f"ros_package:{kw['package']}", "depends_on")


_ROS = {"create_publisher": ("ros_topic", "produces", 1), "create_subscription": ("ros_topic", "consumes", 1), "create_service": ("ros_service", "exposes", 1), "create_client": ("ros_service", "consumes", 1)}


@extractor("ros2_topology", r"\.py$")
def _ros_topology(path, text):
    for c in _classes(text, "Node"):
        own = f"ros_node:{c.name}"
        calls = [x for x in ast.walk(c) if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute)]
        if any(x.func.attr in _ROS or x.func.attr == "declare_parameter" for x in calls):
            yield node(own, "ros_node", c.name, file=path, protocol="ros2")
        for i, x in enumerate(calls):
            if x.func.attr in _ROS:
                kind, role, at = _ROS[x.func.attr]
                name = (_text(x.args[at]) if len(x.args) > at else None) or f"<dynamic>:{c.name}/{i}"
                yield node(f"{kind}:{name}", kind, name, declared_in=path, protocol="ros2")
                yield edge(own, f"{kind}:{name}", role)
            elif x.func.attr == "declare_parameter" and x.args and (p := _text(x.args[0])):
                yield node(f"ros_parameter:{c.name}/{p}", "ros_parameter", p, declared_in=path)
                yield edge(own, f"ros_parameter:{c.name}/{p}", "configures")


@extractor("agent_assets", r"(^|/)(AGENTS\.md|SKILL\.md|\.mcp\.json|[\w./-]*(agents|skills|prompts|hooks|instructions)/.*\.(md|json))$")
def _agent_assets(path, text):
    how = {"source_strategy": "agent_graph_static", "file": path}
    if path.endswith(".json"):
        for s in (json.loads(text) or {}).get("mcpServers") or {}:
            yield node(f"mcp-server:generic:{s}", "mcp-server", s, name=s, **how)
        return
    kind = next((k for part, k in (("skills/", "skill"), ("SKILL.md", "skill"), ("agents/", "agent"), ("prompts/", "prompt"), ("hooks/", "hook")) if part in path), "instruction")
    f = _front(text)
    name = f.get("name") or (path.split("/")[-2] if path.endswith("SKILL.md") and "/" in path else _stem(path).rsplit("/", 1)[-1])
    own = f"{kind}:generic:{name}"
    yield node(own, kind, name, name=name, description=f.get("description", ""), **({"authority": f["authority"]} if "authority" in f else {}), **how)
    for s in sorted(set(re.findall(r"\bskill[: ]`?([\w-]+)`", text))):
        yield edge(own, f"skill:generic:{s}", "uses_skill")
    for p in sorted(set(re.findall(r"(?<![\w/])((?:[\w.-]+/)+[\w.-]+\.\w+)", text))):
        yield edge(own, _file(p), "references_file")
