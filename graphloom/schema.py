"""Vocabularies, weights and row types of the graph."""

from __future__ import annotations

from pyspark.sql import types as T


def _words(text: str) -> tuple[str, ...]:
    return tuple(sorted(text.split()))


CONTRACT_VERSION = 5
MAX_LAYOUT = 2
NODE_TYPES = _words(
    """agent boundary build-target channel command compose concept config contract deploy doc dockerfile entity
    entrypoint enum file gate hook instruction mcp-server package permission platform policy prompt repo ros_action
    ros_interface ros_node ros_package ros_parameter ros_service ros_topic route rpc runbook scope service skill stage
    subagent symbol test-suite test-target tool workflow"""
)
EDGE_TYPES = _words(
    """accepts applies_to_path builds calls configures conflicts_with consumes contains contracts depends_on documents
    duplicates enforces exposes feeds_into gated_by gates generated_from generates governs handoff_to implements
    implements_workflow invokes invokes_agent migrates orchestrates overrides owned_by part_of_platform produces
    provides_tool references_file relates_to represents responds_with restricts_tool supersedes tests
    triggers_on_event uses_command uses_skill validates verifies"""
)
AUTHORITIES = _words("manual external derived canonical")
CONFIDENCES = _words("speculative inferred definite")
ROLES = _words("script fixture migration build doc config test implementation")
DOC_KINDS = _words("verification gate guide runbook policy adr")
SECTION_KINDS = _words("contributing security migration testing usage deployment overview troubleshooting architecture api-reference configuration setup")
PROTOCOLS = _words("inproc ros2 event grpc http")
SURFACE_KINDS = _words("one_way stream pub_sub request_response")
TRANSPORTS = _words("inproc ros2_dds mqtt kafka amqp http2 http tcp")
BOUNDARY_KINDS = _words("internal outbound inbound")
TRANSPORT_OF = {"ros2": _words("ros2_dds"), "inproc": _words("inproc"), "grpc": _words("tcp http2"), "http": _words("tcp http2 http"), "event": _words("inproc tcp mqtt kafka amqp")}

DOC_TYPES, DOC_ROLES, DOC_DOC_KINDS = ("doc", "policy", "runbook"), ("doc", "policy"), ("adr", "guide", "policy", "runbook")
BUILD_TYPES, BUILD_ROLES, BUILD_DOC_KINDS = ("build-target", "gate", "test-suite", "test-target"), ("build", "gate", "test"), ("gate", "verification")
BOUNDARY_TYPES = ("boundary", "entrypoint")
INTERFACE_TYPES = ("channel", "ros_action", "ros_interface", "ros_service", "ros_topic", "rpc")
RUNTIME_TYPES, SERVICE_TYPES, CONTRACT_TYPES, CHECK_TYPES = ("compose", "deploy", "dockerfile"), ("package", "service"), ("contract", "enum"), ("gate", "test-suite", "test-target")
API_TYPES = ("channel", "route", "rpc")
TRACE_EDGES = _words("calls builds configures orchestrates enforces feeds_into invokes depends_on documents tests verifies responds_with accepts implements produces consumes exposes contains")
MEANINGFUL_TYPES = _words("workflow package file doc config command agent")
INTERACTION_WORDS = _words(
    """ros2 invokes invoke calls call response request handlers handler producer consumer subscribe publish pub_sub
    pubsub streams stream events event topics topic channels channel routes route endpoints endpoint api http grpc rpc
    protocols protocol boundaries boundary interfaces interface"""
)
STARTUP_WORDS = _words("flow execution runtime run launch boot entrypoints entrypoint startup starts start")

COMMUNITY_WEIGHTS = {"contains": 4.0} | dict.fromkeys(("exposes", "implements", "invokes", "calls"), 3.0) | dict.fromkeys(("responds_with", "accepts"), 2.5) | dict.fromkeys(("orchestrates", "produces", "consumes", "configures", "builds", "depends_on"), 2.0) | dict.fromkeys(("verifies", "validates", "tests"), 1.5) | {"references_file": 1.0, "documents": 1.0, "relates_to": 0.5}
AGENT_WEIGHTS = dict.fromkeys(_words("implements_workflow triggers_on_event provides_tool generated_from handoff_to invokes_agent uses_command uses_skill"), 5.0) | dict.fromkeys(_words("same_purpose same_name part_of_platform restricts_tool conflicts_with duplicates overrides applies_to_path"), 2.0) | {"references_file": 0.5}
AGENT_WEIGHT_ELSE, AGENT_THRESHOLD = 0.5, 1.0
AUTHORITY_RANK = {"canonical": 0, "derived": 1, "manual": 2, "inferred": 3}
CONFIDENCE_RANK = {"definite": 0, "inferred": 1, "speculative": 2}
MERGE_RANK = {"referenced": 0, "derived": 1, "external": 2, "canonical": 3}
SIGNAL_WEIGHTS = {"bm25": 0.4, "semantic": 0.3, "structural": 0.2, "authority": 0.1}
LANGUAGE_OF_SUFFIX = {s: lang for lang, suffixes in {"cpp": "cc cpp cxx h hh hpp hxx", "csharp": "cs", "go": "go", "java": "java", "javascript": "js jsx", "markdown": "md", "python": "py", "rust": "rs", "typescript": "ts tsx"}.items() for s in suffixes.split()}
LANGUAGE_ALIASES = {a: lang for lang, names in {"cpp": "c++ c-plus-plus cplusplus", "csharp": "c# c-sharp cs", "javascript": "js", "typescript": "ts"}.items() for a in names.split()}

_SYNONYMS = """
api>controller response request http rest handler route endpoint
authentication>oauth jwt credential token session login auth
authorization>policy rbac acl role permission authz auth
build>make webpack bundle compile bazel
ci>build deploy pipeline workflow github_actions cd
component>web element widget react ui
config>toml yaml dotenv configuration env settings
database>model alembic migration schema mysql sqlite postgres sql db
dependency>dep module package require import
deploy>helm k8s docker release cd ci deployment
doc>guide readme docs documentation
docker>deploy image compose dockerfile container
documentation>adr manual guide readme docs doc
encryption>tls ssl cipher hash decrypt encrypt
endpoint>path url api handler route
entrypoint>run boot launch program main startup
error>handler catch raise failure fault exception
execution>invoke call run flow entrypoint startup
extract>acquisition etl transform scrape parse
fixture>sample seed factory mock test
flow>startup invoke call execution path trace
flyer>offer deal promotion ad circular
frontend>view page component react ui web
job>pipeline queue task worker
lint>prettier flake8 ruff eslint style format
log>trace audit logger logging
logging>debug trace audit logger log
login>credential authentication sign_in signin auth
logout>session sign_out signout
middleware>auth filter interceptor handler
migration>db downgrade upgrade migrate schema alembic
mock>patch test fixture fake stub
model>db orm table entity schema
notification>push webhook email alert notify
page>web component screen view route
pipeline>queue job task notify match extract acquire stage worker
price>match promotion discount deal cost
product>good grocery sku item
queue>pipeline redis celery job task worker
request>middleware handler api http
response>status handler api http
retailer>vendor chain supermarket store
route>api path url handler endpoint
schema>entity db migration column table model
secret>vault env password key credential
security>ssrf csrf xss sanitize vulnerability secret encryption auth
session>jwt cookie token auth
sql>sqlite postgres database db query
start>run boot launch program main entrypoint startup
startup>execution runtime run boot launch program main entrypoint
storage>bucket s3 redis cache store database db
store>shop location chain supermarket retailer
task>schedule pipeline queue job worker
test>pytest unittest assert mock fixture spec
token>session credential bearer auth jwt
transform>process etl parse map convert
worker>process celery queue job task pipeline
"""
#: Word -> words that stand for it, in the order in which they are tried.
SYNONYMS = {a: b.split()[::-1] for a, _, b in (line.partition(">") for line in _SYNONYMS.split("\n")) if b}

_STRINGS = "id type label file qualname module description language protocol surface_kind transport boundary_kind doc_kind section_kind layer authority confidence source_strategy resolution props_json".split()
_LISTS = "exports constants aliases roles imports_from".split()
NODE = T.StructType([T.StructField(c, T.StringType()) for c in _STRINGS] + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS] + [T.StructField("resolved", T.BooleanType())])
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("src", "dst", "type", "props_json")])
