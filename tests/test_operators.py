"""Operators on small tables with known results."""

import io
import random
import time
import zipfile
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stratalens import session
from stratalens.operators import aggregates, filters, graph, joins, mutations, ordering, parsers, walks
from stratalens.plans import library, registry, report, rules
from stratalens.session import shared_dir
from stratalens.sources import files as sources
from stratalens.streaming import state

MEMBERS = "id string, owner_id string, name string, status string, team_members array<struct<user:string,role:string,permissions:array<string>>>"


@pytest.fixture(scope="module")
def projects(spark):
    rows = [
        ("1", "u", "Alpha", "completed", [("u", "member", ["read"]), ("v", "owner", ["admin"])]),
        ("2", "v", "beta", "failed", [("u", "owner", ["write"])]),
        ("3", "w", "gamma", "analyzing", None),
    ]
    return spark.createDataFrame(rows, MEMBERS).withColumn("description", F.lit(None).cast("string")).withColumn("type", F.lit("web"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_array_predicates(projects):
    assert ids(projects.filter(filters.any_any("team_members", F.lit("u"), "owner"))) == ["1", "2"]
    assert ids(projects.filter(filters.same_element("team_members", F.lit("u"), ["owner"]))) == ["2"]
    assert ids(projects.filter(filters.has_permission("team_members", ["write", "admin"]))) == ["1", "2"]
    assert ids(projects.filter(filters.owner_or_member(F.lit("w")))) == ["3"]
    assert ids(projects.filter(filters.project_filter(user="u", status="all", search="ALPH"))) == ["1"]


def test_file_filters(spark):
    rows = spark.createDataFrame([("src/a.ts",), ("node_modules/x/a.js",), ("src/builder.ts",), ("src/._a.ts",), ("a.log",), ("x/.git/y.py",)], "path string")
    keep = lambda c: sorted(r.path for r in rows.filter(c).collect())
    assert keep(filters.included_file(F.col("path")) & ~filters.excluded_directory(F.col("path"))) == ["src/a.ts"]
    assert keep(filters.included_file(F.col("path"), anchor="segment")) == ["src/a.ts", "src/builder.ts"]
    assert keep(~filters.ignored_upload(F.col("path"))) == ["src/a.ts", "src/builder.ts"]


def test_validation_keeps_the_first_message(spark):
    df = spark.createDataFrame([("", 5, "x"), ("ab", None, "y")], "name string, n int, other string")
    rules_ = {"name": [(F.col("name") != "", "name is required"), (F.length("name") > 1, "name is short")], "n": [(F.col("n") > 3, "n is small")]}
    got = filters.validated(df, rules_)
    assert got.columns == ["name", "n", "errors"]
    assert [[tuple(e) for e in r.errors] for r in got.collect()] == [[("name", "name is required")], [("n", "n is small")]]


def test_mutations(spark, projects, tmp_path):
    got = {r.id: r for r in mutations.updated(projects, F.col("id") == "2", {"status": F.lit("completed")}).collect()}
    assert got["2"].status == "completed" and got["3"].status == "analyzing"
    left, count = mutations.deleted(projects, F.col("status") == "failed")
    assert ids(left) == ["1", "3"] and count.first().deleted == 1
    users = spark.createDataFrame([(1, "x", None), (2, "y", True)], "id int, timezone string, save boolean")
    assert [tuple(r) for r in mutations.reset_if_any_missing(users, {"timezone": "UTC", "save": False}).orderBy("id").collect()] == [(1, "UTC", False), (2, "y", True)]
    assert [tuple(r) for r in mutations.fill_missing(users, {"timezone": "UTC", "save": False}).orderBy("id").collect()] == [(1, "x", False), (2, "y", True)]
    path = str(tmp_path / "t")
    mutations.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "project_id string, n int"), path)
    mutations.upsert(spark.createDataFrame([("b", 3)], "project_id string, n int"), path)
    assert sorted((r.project_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_sections(spark):
    df = spark.createDataFrame([([("b", 2, "B"), ("a", 1, "A")],)], "s array<struct<id:string,order:int,title:string>>")
    new = F.struct(F.lit("c").alias("id"), F.lit(0).alias("order"), F.lit("C").alias("title"))
    got = df.select(mutations.section_added(F.col("s"), new).alias("a"), mutations.section_changed("s", "id", F.lit("b"), {"title": F.lit("X")}).alias("c"), mutations.section_titled("s", "A").alias("t")).first()
    assert [x.id for x in got.a] == ["c", "a", "b"] and got.c[0].title == "X" and got.t.id == "a"


def test_joins(spark, projects):
    users = spark.createDataFrame([("u", "Uma"), ("v", "Vic")], "id string, name string")
    got = {r.id: r.owner_name for r in joins.populated(projects, "owner_id", users, "id", ["name"], "owner_").collect()}
    assert got == {"1": "Uma", "2": "Vic", "3": None}
    nested = {r.id: r.team_members for r in joins.populated_array(projects, "id", "team_members", "user", users, "id", ["name"]).collect()}
    assert [m.found.name for m in nested["1"]] == ["Uma", "Vic"] and nested["3"] is None
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "b")], "source string, target string")
    assert [tuple(r) for r in joins.mutual(edges).collect()] == [("a", "b")]


def walk(spark, pairs, project="p"):
    return spark.createDataFrame([(project, *x) for x in pairs], "project_id string, source string, target string")


@pytest.mark.parametrize("most", [0, 1000])
def test_cycles_and_layers(spark, most):
    got = {tuple(r.cycle): r.severity for r in graph.simple_cycles(walk(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("b", "c"), ("c", "d"), ("d", "b")]), most=most).collect()}
    assert got == {("a", "b", "a"): "high", ("c", "c"): "critical", ("b", "c", "d", "b"): "high"}
    edge = walk(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    nodes = spark.createDataFrame([("p", x) for x in "abcz"], "project_id string, id string")
    assert {r.id: r.layer for r in graph.layers(edge, nodes, most).collect()} == {"a": 2, "b": 1, "c": 0, "z": 0}
    flags = {r.id: (r.is_entry, r.is_leaf) for r in graph.degrees(edge, nodes).collect()}
    assert flags == {"a": (True, False), "b": (False, False), "c": (False, True), "z": (True, True)}


@pytest.fixture
def items(spark, tmp_path, monkeypatch):
    """The registered queries on items of orders, with partitions for few bytes."""
    monkeypatch.setattr(session, "PART_BYTES", 200, raising=False)
    columns = ["id % 40 AS l_orderkey", "cast(id AS int) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "0D AS l_extendedprice"]
    spark.range(400).selectExpr(*columns).repartition(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return lambda name: registry.QUERIES[name](spark, str(tmp_path))


def test_layers_have_partitions_for_the_input(items):
    got = items("dag_layers")
    assert got.rdd.getNumPartitions() >= 10  # the session says 4
    assert sorted(r.layer for r in got.filter("project_id = '7'").collect()) == [0, 0, 1, 2, 2, 3, 4, 4, 5, 6]


def test_degrees_have_partitions_for_the_input(items):
    got = items("entry_leaf_flags")
    assert got.rdd.getNumPartitions() >= 10
    assert sorted((int(r.id), r.fan_out, r.fan_in) for r in got.filter("project_id = '7'").collect())[:3] == [(1, 2, 0), (2, 2, 1), (3, 1, 2)]
    assert got.count() == 400


@pytest.mark.parametrize(("size", "most"), [(4, 0), (10, 1000), (3000, 5000)])
def test_cycles_of_any_length(spark, size, most):
    ring = [(f"n{i:04}", f"n{(i + 1) % size:04}") for i in range(size)]
    edge = walk(spark, [*ring, ("n0003", "x")])
    assert [len(r.cycle) for r in graph.simple_cycles(edge, most=most).collect()] == [size + 1]
    assert graph.simple_cycles(edge, size - 1, most).count() == 0


@pytest.mark.parametrize("most", [2, 1000])
def test_projects_stay_apart(spark, most):
    """Two projects without a cycle whose paths together would have one, and a third with one."""
    edge = walk(spark, [("a", "b"), ("b", "c")]).unionByName(walk(spark, [("c", "a")], "q")).unionByName(walk(spark, [("a", "b"), ("b", "a"), ("b", "z")], "r"))
    nodes = edge.select("project_id", F.col("source").alias("id")).unionByName(edge.select("project_id", F.col("target").alias("id")))
    assert [(r.project_id, r.cycle) for r in graph.simple_cycles(edge, most=most).collect()] == [("r", ["a", "b", "a"])]
    got = {(r.project_id, r.id): r.component for r in graph.strong_components(edge, most).collect()}
    assert got == {("p", "a"): "a", ("p", "b"): "b", ("p", "c"): "c", ("q", "a"): "a", ("q", "c"): "c", ("r", "a"): "a", ("r", "b"): "a", ("r", "z"): "z"}
    got = {(r.project_id, r.id): r.layer for r in graph.layers(edge, nodes, most).collect()}
    assert got == {("p", "a"): 2, ("p", "b"): 1, ("p", "c"): 0, ("q", "a"): 0, ("q", "c"): 1, ("r", "a"): 1, ("r", "b"): 1, ("r", "z"): 0}
    assert {(r.project_id, r.nodes, r.edges) for r in graph.metrics(edge, nodes).collect()} == {("p", 3, 2), ("q", 2, 1), ("r", 3, 3)}
    assert {(r.project_id, r.source): r.is_circular for r in graph.within_components(edge, most).filter("target <> 'z'").collect()} == {("p", "a"): False, ("p", "b"): False, ("q", "c"): False, ("r", "a"): True, ("r", "b"): True}


def test_walks_equal_plain_search():
    """All simple cycles, components and layers of random graphs, by search over all paths."""
    r = random.Random(9)
    for _ in range(150):
        n = r.randint(1, 7)
        edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(r.randint(1, 16))]
        near = defaultdict(set)
        for a, b in edges:
            near[a].add(b)
        found = set()

        def search(path):
            for b in near[path[-1]]:
                if b == path[0]:
                    found.add((*path, b))
                elif b > path[0] and b not in path:
                    search([*path, b])

        for a in sorted(near):
            search([a])
        got = [tuple(c) for (c,) in walks.cycles(edges)]
        assert len(got) == len(set(got)) and set(got) == found
        for longest in (1, 2, 3):
            got = [tuple(c) for (c,) in walks.cycles(edges, longest)]
            assert len(got) == len(set(got)) and set(got) == {c for c in found if len(c) <= longest + 1}


@pytest.mark.parametrize("most", [0, 1000])
def test_strong_components_equal_reachability(spark, most):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(20)]
    reach = defaultdict(set)
    for a, b in pairs:
        reach[a].add(b)
    nodes = sorted({x for p in pairs for x in p})
    for k in nodes:
        for i in nodes:
            if k in reach[i]:
                reach[i] |= reach[k]
    want = {x: min([x, *[y for y in nodes if y in reach[x] and x in reach[y]]]) for x in nodes}
    assert {r.id: r.component for r in graph.strong_components(walk(spark, pairs), most).collect()} == want


PYTHON = "import os, sys\nfrom . import x\nfrom .m import y as z\n\nasync def g():\n    pass\n\nclass C:\n    def f(self, a):\n        pass\n"
SCRIPT = """// import no from 'no';
import d, { e as f } from "m1";
import * as n from 'm2'; import 'm3';
const t = `import q from 'q'`, u = /import 'r'/;
export { f as ff } from './m4';
export * from './m5';
export default class K extends J { constructor(x) { this.x = x; } run(y: number) { if (y) { return 1; } } }
export const h = async (q) => { const inner = 1; return import('m6'); };
interface I { a: string }
type T = string | number;
"""


def test_python_parser():
    got = parsers.parse("a.py", PYTHON)
    assert [(i["source"], i["import_type"]) for i in got["imports"]] == [("os", "default"), ("sys", "default"), ("m", "named")]
    assert {(c["raw_type"], c["name"]) for c in got["components"]} == {("class", "C"), ("function", "f")}
    bad = parsers.parse("a.py", "def f(:\n  pass\n")
    assert not bad["parse_success"] and "SyntaxError" in bad["parse_errors"][0]


def test_javascript_parser():
    got = parsers.parse("a.ts", SCRIPT)
    assert got["parse_success"]
    assert [(i["source"], i["import_type"], i["is_dynamic"]) for i in got["imports"]] == [("m1", "default", False), ("m2", "namespace", False), ("m3", "side_effect", False), ("m6", "default", True)]
    assert [(e["export_type"], e["name"], e["source"]) for e in got["exports"]] == [("named", None, "./m4"), ("all", "*", "./m5"), ("default", "K", None), ("named", "h", None)]
    kinds = {(c["raw_type"], c["name"], c["is_exported"]) for c in got["components"]}
    assert {("class", "K", True), ("constructor", "constructor", False), ("method", "run", False), ("function", "h", True), ("constant", "inner", True), ("interface", "I", False), ("type", "T", False)} <= kinds
    assert not parsers.parse("a.js", "function f( { ")["parse_success"]


def test_javascript_members_and_declarators():
    text = """const a = 1, b = (x) => x,
  c = { k: [1, 2] };
let { p, q } = a, z
export class A<T> extends B implements C {
  private readonly x: number = 1;
  static y = { a: 1, b: [2] }
  #hidden;
  z?: string
  @Input() label = 'q';
  constructor(private svc: Svc, public n = 3) { super(); }
  async *gen<T>(a: T, { b, c }: X = {}): Promise<void> { for (const i of a) { yield i; } }
  get v(): number { return this.#hidden; }
  static { init(); }
  handler = (e) => { this.go(e); };
}
const el = <div className="x">don't {a ? <b>hi</b> : null}</div>;
const t = `x ${function inside(y) { return `${y}`; }} z`;
"""
    got = parsers.parse("a.tsx", text)
    assert got["parse_success"]
    found = [(c["raw_type"], c["name"], c["start_line"], c["visibility"]) for c in got["components"]]
    assert [x for x in found if x[0] == "property"] == [("property", "x", 5, "private"), ("property", "y", 6, "public"), ("property", "#hidden", 7, "private"), ("property", "z", 8, "public"), ("property", "label", 9, "public"), ("property", "handler", 14, "public")]
    assert {x[1] for x in found if x[0] in ("constant", "variable")} == {"a", "c", "z", "i", "el", "t"}
    assert {x[1] for x in found if x[0] in ("function", "method", "constructor")} == {"b", "gen", "v", "constructor", "inside"}
    assert {c["name"]: c["parameters"] for c in got["components"] if c["raw_type"] in ("constructor", "function")}["constructor"] == ["svc", "n"]


def test_javascript_syntax_errors_and_long_files():
    for text in ("f( [ ) ]", "function f( { ", "/* x", "`a ${b", "const x = 1 }"):
        assert parsers.parse("a.js", text)["parse_errors"][0].startswith("SyntaxError")
    began = time.process_time()
    assert len(parsers.parse("a.ts", "const a = 1;\nclass C { x = 1; }\n" * 40_000)["components"]) == 120_000
    assert time.process_time() - began < 30


@pytest.mark.parametrize("name", ["parsed_imports", "parsed_components", "analysis_libraries", "parsed_exports"])
def test_files_are_parsed_once_after_they_are_dealt_out(spark, tmp_path, name):
    spark.range(50).selectExpr("id AS p_partkey", "cast(id % 20 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1
    assert plan.index("EvalPython") < plan.index("RepartitionByExpression")


def test_imports_are_linked_row_by_row(spark, tmp_path):
    """Files that are there twice, which a join by path would multiply."""
    rows = spark.range(2).selectExpr("2L AS p_partkey", "5 AS p_size")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = [(r.ord, r.source, r.target) for r in registry.QUERIES["parsed_imports"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(2 * [(0, "./f16.ts", "src/f16.ts"), (1, "lib5/x", "lib5/x"), (2, "side", "side"), (3, "dyn", "dyn")])


def test_analysis_of_a_tree(spark, tmp_path):
    tree = {"src/a.ts": "import { b } from './b.ts';\nimport x from 'lodash/fp';\n", "src/b.ts": "import { a } from './a.ts';\nexport const b = 1;\n", "src/c.py": "import os\n\ndef f():\n    return 1\n", "node_modules/z.js": "import 'q'; // skipped\n"}
    for name, content in tree.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    files = sources.source_files(spark, str(tmp_path), "p")
    assert sorted(r.path for r in files.collect()) == ["src/a.ts", "src/b.ts", "src/c.py"]
    (tmp_path / "package.json").write_text('{"dependencies": {"lodash": "4"}, "devDependencies": {"os": "0"}}')
    (tmp_path / "src" / "package.json").write_text('{"dependencies": {"lodash": "9"}}')
    manifest = sources.root_manifest(spark, str(tmp_path), "p")
    got = library.dependency_analysis(files, manifest)
    assert sorted((r.source, r.target) for r in got["edges"].collect()) == [("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts")]
    assert [tuple(r.cycle) for r in got["cycles"].collect()] == [("src/a.ts", "src/b.ts", "src/a.ts")]
    assert {r.library: (r.usage_count, r.version, r.is_dev_dependency) for r in got["libraries"].collect()} == {"lodash": (1, "4", False), "os": (1, "0", True)}
    assert [r.type for r in got["insights"].collect()] == ["circular_dependency"] and [r.type for r in got["recommendations"].collect()] == ["refactor"]
    assert got["metrics"].first().nodes == 3 and got["dependencies"].count() == 6


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("p/a.py", "x = 1\n")
        z.writestr("../evil.py", "x")
        z.writestr("p/d/b.md", "# t")
        z.writestr("p/.hidden", "x")
    rows = spark.createDataFrame([("p", bytearray(buffer.getvalue())), ("q", bytearray(b"no zip"))], "project_id string, content binary")
    found, stats = library.ingest_archive(rows)
    got = {(r.path, r.language, r.lines, r.is_directory) for r in found.collect()}
    assert got == {("p/a.py", "python", 2, False), ("p/d/b.md", "markdown", 1, False), ("p", "directory", 0, True), ("p/d", "directory", 0, True)}
    assert {r.language: r.n_files for r in stats.collect()} == {"python": 1, "markdown": 1}


def test_storage(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# x")
    (tmp_path / "d/a.md.meta.json").write_text('{"k": "v"}')
    got = sources.object_metadata(spark, str(tmp_path)).collect()
    assert [(r.key, r.size, r.content_type, r.metadata) for r in got] == [("d/a.md", 3, "text/markdown", {"k": "v"})]


def test_ordering(spark):
    ends = spark.createDataFrame([("GET", "/b", 1), ("POST", "/a", 0), ("GET", "/a", 2), ("PUT", "/c", 3), ("DELETE", "/d", 4)], "method string, path string, ord int")
    assert [r.path for r in ordering.examples(ends).collect()] == ["/b", "/a", "/c"]
    assert [r.ord for r in ordering.examples(ends.filter("ord > 9").unionByName(ends.withColumn("method", F.lit("HEAD")))).collect()] == [0, 1, 2]
    got = spark.range(1).select(ordering.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), ordering.joined_sections(F.lit("x"), F.lit(" "), F.lit(None), F.lit("y")).alias("s")).first()
    assert got.m == {"a": "1", "b": "3"} and got.s == "x\n\n---\n\ny"
    with pytest.raises(ValueError):
        ordering.sort_column("password", "asc")


def test_aggregates(spark):
    sev = lambda xs: aggregates.overall_severity(spark.createDataFrame([(x,) for x in xs], "severity string")).first().severity
    assert sev(["low", "critical", "medium"]) == "critical" and sev([]) == "none"
    results = spark.createDataFrame([("p", [("x", "class"), ("y", "class")], None, [])], "project_id string, components array<struct<name:string,type:string>>, dependencies array<struct<type:string>>, api_endpoints array<struct<method:string>>")
    row = aggregates.analysis_summary(results.withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<struct<type:string>>")))).first()
    assert row.components == 2 and row.by_type == {"class": 2} and row.by_method == {}


def test_rules_and_reports(spark):
    metrics = spark.createDataFrame([(2, 200, 3000, 60, 3)], "cycles int, nodes int, edges int, libraries int, clusters int")
    assert [r.type for r in rules.insights(metrics).collect()] == ["circular_dependency", "complexity", "external_dependencies", "coupling"]
    assert [r.priority for r in rules.recommendations(metrics).collect()] == ["high", "medium", "medium", "low"]
    comps = spark.createDataFrame([("userController", "src/controllers/u.ts"), ("AuthService", "src/services/a.ts")], "name string, path string")
    assert [r.pattern for r in rules.pattern_evidence(comps).collect()] == ["MVC", "Service Layer"]
    ends = spark.createDataFrame([("GET", "/a", "f", False), ("DELETE", "/b", "g", True)], "method string, path string, handler string, protected boolean")
    assert [r.name for r in rules.features(comps, ends).collect()] == ["Authentication", "REST API"]
    assert [r.name for r in rules.data_components(comps, "processors").collect()] == ["AuthService"]
    api = ends.agg(F.collect_list(F.struct("*")).alias("endpoints")).withColumn("name", F.lit("P"))
    text = report.api_docs(api).first().content
    assert "- DELETE: 1" in text and "## Authentication" in text and text.count("\n\n---\n\n") == 6
    assert "No API endpoints" in report.api_docs(api.withColumn("endpoints", F.filter("endpoints", lambda x: x["method"] == "X"))).first().content


def test_architecture_report(spark):
    row = spark.createDataFrame(
        [("P", ["Layered"], 60, 10, 20, ["ts"], 5000, 5.0, 90.0, 10.0, [("Services", 2, ["a", "b", "c", "d"])], [], ["Do it"], [])],
        "name string, patterns array<string>, components int, dependencies int, files int, languages array<string>, lines int, complexity double, maintainability_index double,"
        " technical_debt double, layers array<struct<name:string,n:int,members:array<string>>>, insights array<string>, actions array<string>, improvements array<string>",
    )
    text = report.architecture(row).first().content
    assert "Medium Scale" in text and "Layered Architecture" in text and "a, b, c" in text and "## Dependencies" not in text and "Do it" in text


def test_states(spark):
    rows = spark.createDataFrame([("queued", 10), ("processing", 150), ("failed", 100), ("queued", -5)], "status string, progress int")
    assert [tuple(r.s) for r in rows.select(state.next_job_state(F.col("status"), F.col("progress")).alias("s")).collect()] == [("processing", 10), ("completed", 100), ("failed", 100), ("queued", 0)]
    jobs = spark.createDataFrame([("1", "queued", 30, None), ("2", "completed", 100, None)], "id string, status string, progress int, error_message string")
    assert {r.id: r.status for r in state.cancelled(state.cancelled(jobs, "1"), "2").collect()} == {"1": "failed", "2": "completed"}
    assert [r.checkpoint for r in state.stage_log(jobs.filter("id = '1'")).collect()] == [10, 25]


def test_throttle_and_breaker_streams(spark, tmp_path):
    rows = [("k", True, f"2024-01-01 00:0{i}:00") for i in range(4)] + [("j", True, "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "provider string, ok boolean, t string").select("provider", "ok", F.col("t").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.throttled(stream, "provider", limit=3, late="1 minute").writeStream.format("memory").queryName("throttle").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.provider, r.n, r.blocked) for r in spark.table("throttle").collect()} == {("k", 4, True), ("j", 1, False)}


def by_events(calls, limit=3, wait=300):
    """The breaker event by event: a failure adds one and sets a timer, which sets the count to none, as a success does."""
    out = []
    for key in sorted({k for k, _, _ in calls}):
        n, timers = 0, []
        for _, ok, at in sorted((c for c in calls if c[0] == key), key=lambda c: c[2]):
            if any(x <= at for x in timers):
                n, timers = 0, [x for x in timers if x > at]
            n = 0 if ok else n + 1
            timers += [] if ok else [at + wait]
            out.append((key, at, n, n >= limit))
    return sorted(out)


def test_breaker_in_batch_and_as_a_stream(spark, tmp_path):
    r = random.Random(5)
    calls = sorted({(r.choice("kj"), r.random() < 0.15, 1_704_067_200 + at) for at in r.sample(range(4000), 160)}, key=lambda c: c[2])
    rows = [(k, ok, at) for k, ok, at in calls]
    df = spark.createDataFrame(rows, "provider string, ok boolean, at long").select("provider", "ok", F.timestamp_seconds("at").alias("ts"))
    take = lambda rows: sorted((x.provider, int(x.ts.timestamp()), x.failures, x.is_open) for x in rows)
    want = by_events(rows)
    assert take(state.breaker(df, "provider", F.col("ok")).collect()) == want and any(x[3] for x in want)
    for i in range(4):
        df.orderBy("ts").limit((i + 1) * 40).exceptAll(df.orderBy("ts").limit(i * 40)).coalesce(1).write.parquet(str(tmp_path / "calls" / f"part={i}"))
    stream = spark.readStream.schema("provider string, ok boolean, ts timestamp, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls")).select("provider", "ok", "ts")
    q = state.breaker_stream(stream, late="2 hours").writeStream.format("memory").queryName("breaker").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert take(spark.table("breaker").collect()) == want


def test_stored_objects(spark, tmp_path):
    root = f"file://{tmp_path}/o"
    rows = spark.createDataFrame([("a/s1/x y.md", bytearray(b"one"), {"k": "v"}), ("a/s2/é.md", bytearray(b"three"), None), ("loose.md", bytearray(b"."), None)], "key string, content binary, metadata map<string,string>")
    assert {(r.key, r["size"]) for r in mutations.put_objects(rows, root).collect()} == {("a/s1/x y.md", 3), ("a/s2/é.md", 5), ("loose.md", 1)}
    got = {r.key: (r["size"], r.metadata) for r in sources.object_metadata(spark, root).collect()}
    assert got == {"a/s1/x y.md": (3, {"k": "v"}), "a/s2/é.md": (5, None), "loose.md": (1, None)}
    mutations.moved(spark, f"{root}/a/s1/x y.md", f"{root}/a/s2/z.md")
    assert {r.key: r.metadata for r in sources.object_metadata(spark, root).collect()}["a/s2/z.md"] == {"k": "v"}
    swept = lambda at: tuple(mutations.swept(sources.stored(spark, root), root, F.lit(at).cast("timestamp")).first())
    assert swept("2001-01-01") == (0, 0) and swept("2999-01-01") == (1, 8)
    assert [r.key for r in sources.stored(spark, root).collect()] == ["loose.md"]


def test_a_cluster_needs_a_shared_folder():
    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(fake(master))


def test_only_the_root_manifest_counts(spark):
    files = spark.createDataFrame([("p", "package.json", '{"dependencies": {"x": "1"}}'), ("p", "sub/package.json", '{"dependencies": {"x": "2"}}'), ("q", "package.json", "no json")], "project_id string, path string, content string")
    found = sources.manifests(files)
    assert {r.project_id: r.dependencies for r in found.collect()} == {"p": {"x": "1"}, "q": None}
    uses = spark.createDataFrame([("p", "x"), ("q", "x")], "project_id string, library string")
    both = found.unionByName(found.withColumn("dependencies", F.transform_values("dependencies", lambda k, v: F.lit("0"))))
    assert sorted(tuple(r) for r in joins.library_versions(uses, both).collect()) == [("p", "x", "0", False), ("q", "x", None, False)]


def test_library_queries(spark, projects):
    users = spark.createDataFrame([("u", "Uma", "e")], "id string, name string, email string")
    rows = projects.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    shown, counts = library.list_projects(rows, users, user="u", sort="name", direction="asc", size=1)
    assert [r.id for r in shown.collect()] == ["1"] and counts.first().pages == 2
    assert library.user_project_stats(projects, "u").first().asDict() == {"total": 2, "completed": 1, "active": 0, "failed": 1}
    new = projects.filter("id = '1'").withColumn("id", F.lit("9")).unionByName(projects.filter("id = '1'").withColumn("id", F.lit("8")).withColumn("name", F.lit("new")))
    assert ids(library.insert_project(projects, new)) == ["1", "2", "3", "8"]
    left = {r.id: len(r.team_members or []) for r in library.remove_member(projects, "1", "v").collect()}
    assert left["1"] == 2  # the owner stays


def test_object_metadata_has_every_object(spark, tmp_path):
    for i in range(1003):
        (tmp_path / f"{i:04}.txt").write_text("x")
    (tmp_path / "1002.txt.meta.json").write_text('{"owner": "me"}')
    got = {r.key: r.metadata for r in sources.object_metadata(spark, str(tmp_path)).collect()}
    assert len(got) == 1003 and got["1002.txt"] == {"owner": "me"} and sources.listing(spark, str(tmp_path)).count() == 1000
