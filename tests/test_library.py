"""Operators of the library on small fixtures and a project on disk."""

import json
import re

import pytest
from pyspark.sql import functions as F

from graphloom import cli, rpc
from graphloom.functions import columns as C
from graphloom.functions import taxonomy as T
from graphloom.functions.numbering import numbered
from graphloom.operators import assist as A
from graphloom.operators import export as X
from graphloom.operators import graph as G
from graphloom.operators import incremental as I
from graphloom.operators import parse as P
from graphloom.operators import query as Q
from graphloom.operators import scan as N
from graphloom.sources import files as S
from graphloom.streaming import watch as W

INVENTORY = "path string, language string, size_lines bigint, file_category string"
FILES = [
    ("src/main.rs", "rust", 150, "code"),
    ("src/lib.rs", "rust", 50, "code"),
    ("src/types.rs", "rust", 300, "code"),
    ("Cargo.toml", "toml", 20, "config"),
    ("README.md", "markdown", 40, "docs"),
    ("deploy.sh", "shell", 25, "script"),
]
SOURCE = """use crate::lib;
use std::{
    io};

pub fn hello() {}

pub async fn load_data() {}
pub(crate) fn internal() {}
pub struct Config { a: u32 }
trait Handler {
    fn handle(&self);
}
impl Handler for Config {
    fn handle(&self) {}
}
fn main() {}
"""


@pytest.fixture()
def inventory(spark):
    return spark.createDataFrame(FILES, INVENTORY)


@pytest.fixture()
def parsed(spark):
    kind = "path string, language string, line_count bigint, " + ", ".join(f"{c} {t}" for c, t in P.SCHEMA.items())
    imports = {"src/main.rs": [("lib", "crate::lib", [1, 1])], "src/lib.rs": [("types", "crate::types", [1, 1]), ("lib", "crate::lib", [2, 2])]}
    return spark.createDataFrame([(p, lang, n, [], imports.get(p, []), [], [], [], []) for p, lang, n, _ in FILES], kind)


@pytest.fixture()
def graph(inventory, parsed):
    return G.build_graph(inventory, parsed, "demo", "2025-01-15T10:30:00Z", "abc123def456")


def column(spark, function, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(function(F.col("v"))).collect()]


def test_languages_and_categories(spark):
    paths = ["main.rs", "app.ts", "script.py", "README.md", "config.json", "unknown.xyz", ".env", "Dockerfile", "a.RS", "x/.github/workflows/ci.yml"]
    assert column(spark, C.language, *paths) == ["rust", "typescript", "python", "markdown", "json", "unknown", "unknown", "unknown", "unknown", "yaml"]
    cases = {"src/main.rs": "code", "README.md": "docs", "Cargo.toml": "config", "Dockerfile": "infra", "deploy.sh": "script", "inspect.rs": "test", "index.html": "config", "data.csv": "data", "Makefile": "config", "rules.mk": "code", "tests/a.rs": "test", ".github/workflows/ci.yml": "infra", "x.bin": "unknown", ".bashrc": "config", "LICENSE": "docs"}
    assert column(spark, lambda p: C.category(p, C.language(p)), *cases) == list(cases.values())


def test_lines_names_and_summaries(spark):
    assert column(spark, C.line_count, "", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n", None) == [0, 1, 1, 2, 2, 1, 0]
    assert column(spark, C.display_name, "src/main.rs", "a/b.tar.gz", "Makefile", "x/.env") == ["main", "b.tar", "Makefile", ""]
    assert column(spark, C.ancestors, "a/b/c.rs", "c.rs") == [["a", "a/b"], []]
    assert column(spark, C.summary_lines, "rust (150 lines, 2 definitions, 1 imports)", "rust (50 lines)", "none") == ["150", "50", "?"]
    ids = column(spark, C.node_id, "src/main.rs", "src/main.rs", "x")
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 16


def test_complexities(spark):
    rows = spark.createDataFrame([(200,), (201,), (1000,), (1001,)], "n bigint")
    assert [r[0] for r in rows.orderBy("n").select(C.file_complexity(F.col("n"))).collect()] == ["simple", "moderate", "moderate", "complex"]
    pairs = spark.createDataFrame([(49, 9999), (50, 9999), (49, 10_000), (199, 99_999), (200, 0), (0, 100_000)], "f bigint, l bigint")
    got = {(r[0], r[1]): r[2] for r in pairs.select("f", "l", C.project_complexity(F.col("f"), F.col("l"))).collect()}
    assert list(got.values()) == ["simple", "moderate", "moderate", "moderate", "complex", "complex"]


def test_stats(inventory):
    row = N.project_stats(inventory).first()
    assert (row.total_files, row.total_lines, row.estimated_complexity, row.filtered_by_ignore) == (6, 585, "simple", 0)
    assert {r[0]: r[1] for r in N.category_counts(inventory).collect()} == {"code": 3, "config": 1, "docs": 1, "script": 1}
    assert N.project_stats(inventory.limit(0)).first().total_lines == 0


def test_parser_names_lines_and_order(spark):
    files = spark.createDataFrame([("a.rs", SOURCE), ("b.py", "def f(): pass"), ("n.rs", None)], "path string, content string")
    rows = P.Registry().parse(files)
    got = [(r.name, r.kind, r.line) for r in P.definition_rows(rows).orderBy("position").collect()]
    assert got == [("hello", "function", 4), ("load_data", "function", 6), ("internal", "function", 8), ("handle", "function", 11), ("handle", "function", 14), ("Config", "struct", 9), ("Handler", "trait", 10), ("impl Handler", "implementation", 13)]
    imports = [(r.name, r.source, r.line) for r in P.import_rows(rows).orderBy("position").collect()]
    assert imports == [("lib", "crate::lib", 1), ("{\n    io}", "std::{\n    io}", 2)]
    assert rows.count() == 1


def test_registry_takes_the_first_parser(spark):
    registry = P.Registry()
    registry.register(P.MARKDOWN)
    registry.register(P.Parser("other", ("rs", "zz"), lambda rows: rows))
    files = spark.createDataFrame([("a.rs", "fn x() {}"), ("b.md", "# One\ntext\n## Two\n"), ("c.zz", "x"), ("d", "x")], "path string, content string")
    got = {r.path: r for r in registry.parse(files).collect()}
    assert {p: r.language for p, r in got.items()} == {"a.rs": "rust", "b.md": "markdown", "c.zz": "other"}
    assert [(s.title, s.level, s.line_range) for s in got["b.md"].sections] == [("One", 1, [1, 1]), ("Two", 2, [3, 3])]
    assert registry.find("rs").language == "rust" and registry.find("none") is None
    assert P.Registry([]).parse(files).count() == 0


def test_edges(inventory, parsed, spark):
    names = {r.id: r.path for r in inventory.select(C.node_id(F.col("path")).alias("id"), "path").union(spark.createDataFrame([("src",)], "path string").select(C.node_id(F.col("path")), "path")).collect()}
    contains = sorted((names[r.source], names[r.target], r.weight) for r in G.contains_edges(inventory).collect())
    assert [c[:2] for c in contains] == [("src", "src/lib.rs"), ("src", "src/main.rs"), ("src", "src/types.rs")]
    imports = sorted((names[r.source], names[r.target], r.description) for r in G.import_edges(parsed).collect())
    assert imports == [("src/lib.rs", "src/types.rs", "src/lib.rs imports crate::types"), ("src/main.rs", "src/lib.rs", "src/main.rs imports crate::lib")]


def test_import_ties_and_parent_fallback(spark):
    kind = "path string, imports array<struct<name: string, source: string, line_range: array<int>>>"
    rows = spark.createDataFrame([("a/mod.rs", []), ("b/mod.rs", []), ("c/x.rs", [("mod", "crate::mod", [1, 1]), ("mod", "super::mod", [2, 2]), ("Foo", "crate::types::Foo", [3, 3])]), ("types.rs", [])], kind)
    got = [r.description for r in G.import_edges(rows).collect()]
    assert got == ["c/x.rs imports crate::mod"]
    first = G.import_edges(rows).first()
    assert first.target == rows.limit(1).select(C.node_id(F.lit("a/mod.rs"))).first()[0]
    assert G.import_edges(rows, parent_fallback=True).count() == 2


def test_layers_partition_nodes(graph):
    rows = {r.id: r for r in graph.layers.collect()}
    assert {k: len(r.node_ids) for k, r in rows.items()} == {"code": 5, "config": 1, "docs": 1}
    assert list(rows) == sorted(rows) and rows["code"].name == "Core Code"
    assert Q.layer_coverage(graph.nodes, graph.layers).count() == 0
    assert graph.nodes.count() == graph.nodes.select("id").distinct().count() == 7


def test_tour(graph, spark):
    steps = graph.tour.orderBy("order").collect()
    assert [s.order for s in steps] == [1, 2, 3, 4, 5, 6]
    assert [s.title for s in steps] == ["Project Overview", "Directory Structure", "Source Code Files", "Configuration Files", "Documentation Files", "Explore Connections"]
    flat = G.tour(G.file_nodes(spark.createDataFrame(FILES[3:], INVENTORY))).orderBy("order").collect()
    assert [s.order for s in flat] == [1, 3, 4, 5, 6]  # without folders step 2 is missing
    assert [s.order for s in G.tour(graph.nodes.limit(0)).orderBy("order").collect()] == [1, 3]


def test_questions(graph, spark):
    one = Q.overview(graph).first()
    assert (one.name, one.nodes, one.edges, one.layers, one.complexity, one.commit) == ("demo", 7, 5, 3, "simple", "abc123def456")
    assert {(r.source, r.target) for r in Q.import_list(graph.edges, graph.nodes).collect()} == {("src/main.rs", "src/lib.rs"), ("src/lib.rs", "src/types.rs")}
    assert [r.path for r in Q.tree(spark.createDataFrame(FILES, INVENTORY)).orderBy("sort_key").collect()] == ["Cargo.toml", "README.md", "deploy.sh", "src", "src/lib.rs", "src/main.rs", "src/types.rs"]
    assert Q.tree_roots(graph.edges).count() == 1
    assert {r.label for r in Q.search(graph.nodes, "SRC").collect()} == {"src", "src/main.rs", "src/lib.rs", "src/types.rs"}
    assert Q.search(graph.nodes, "").count() == 7
    ids = graph.nodes.where("name = 'lib'").select("id")
    near = Q.neighbours(graph.edges, graph.nodes, ids).orderBy("rank").collect()
    assert [(r.label, r.way, r.type, r.total) for r in near] == [("src", "in", "contains", 3), ("src/types.rs", "out", "imports", 3), ("src/main.rs", "in", "imports", 3)]
    odd = graph.edges.unionByName(graph.edges.limit(1).withColumn("source", F.lit("nobody")))
    assert Q.valid_links(odd, graph.nodes).count() == 5
    assert [r.missing for r in Q.dangling_edges(odd, graph.nodes).collect()] == ["source"]
    assert Q.visible(graph.nodes, graph.layers, ["code"]).count() == 2
    assert Q.highlighted(graph.nodes, graph.tour, 2).where("in_step").count() == 1
    assert {r.label: r.depth for r in Q.tree_of_graph(graph.edges, graph.nodes).collect()} == {"src": 0, "src/lib.rs": 1, "src/main.rs": 1, "src/types.rs": 1}


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))


def test_exports_and_loading(graph, spark, tmp_path):
    X.export(graph, "json", str(tmp_path / "deep" / "graph.json"))
    held = json.loads((tmp_path / "deep" / "graph.json").read_text())
    assert list(held) == ["version", "kind", "project", "nodes", "edges", "layers", "tour"]
    assert "line_range" not in held["nodes"][0] and held["edges"][0]["weight"] == 0.3
    again = S.load_graph(spark, str(tmp_path / "deep" / "graph.json")).first()
    assert len(again.nodes) == 7 and {n.type for n in again.nodes} == {"file", "config", "document", "module"} and again.project.name == "demo"
    text = X.markdown(graph)
    for part in ("# demo", "## Layers", "### Core Code (5)", "## Imports", "- src/main.rs → src/lib.rs", "2 imports.", "## Tour", "1. **Project Overview**"):
        assert part in text
    evil = G.Graph(graph.project, graph.nodes.withColumn("summary", F.lit("</script><b>")), graph.edges, graph.layers, graph.tour)
    page = X.dashboard(evil)
    assert "</script><b>" not in page and "demo" in page
    assert "&lt;" in X.static_html(evil) or "Core Code" in X.static_html(evil)
    (tmp_path / "small.json").write_text('{"version": "1", "nodes": [{"id": "a", "type": "file", "name": "a", "summary": ""}], "edges": [{"source": "a", "target": "b", "type": "calls"}], "layers": [], "tour": []}')
    small = S.load_graph(spark, str(tmp_path / "small.json")).first()
    assert small.nodes[0].complexity == "simple" and small.nodes[0].tags == [] and small.edges[0].direction == "forward" and small.edges[0].weight == 0.5


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "demo"
    content = {
        ".github/workflows/ci.yml": b"on: push\n",
        "_priv/b.py": b"x = 1\n",
        ".hidden": b"no",
        "target/x.rs": b"fn no() {}",
        "node_modules/y.js": b"no",
        ".git/HEAD": b"ref: refs/heads/main\n",
        ".git/refs/heads/main": b"0123456789abcdef\n",
        "empty.txt": b"",
        "dos.md": b"# A\r\nb\r\n",
        "bytes.rs": b"\xff\xfe fn bad() {}\n",
        "src/a.rs": b"use crate::b;\npub fn run() {}\n",
        "src/b.rs": b"pub struct B;\n",
    }
    for name, data in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def test_project_on_disk(spark, project):
    found = {r.path: r for r in N.inventory(S.project_files(spark, str(project))).collect()}
    assert sorted(found) == [".github/workflows/ci.yml", "_priv/b.py", "bytes.rs", "dos.md", "empty.txt", "src/a.rs", "src/b.rs"]
    assert {p: r.size_lines for p, r in found.items()} == {".github/workflows/ci.yml": 1, "_priv/b.py": 1, "bytes.rs": 0, "dos.md": 2, "empty.txt": 0, "src/a.rs": 2, "src/b.rs": 1}
    assert found[".github/workflows/ci.yml"].file_category == "infra"
    assert S.commit_hash(str(project)) == "0123456789abcdef" and S.commit_hash("/nowhere") == "unknown"


def test_ignored_files_of_a_project(spark, project):
    (project / ".graphignore").write_text("*.md\n_priv/\n!empty.txt\n")
    (project / "src/.graphignore").write_text("b.rs\n")
    kept, left_out = S.project_paths(spark, str(project))
    assert sorted(r.path for r in left_out.collect()) == ["_priv/b.py", "dos.md", "src/b.rs"]
    assert sorted(r.path for r in kept.collect()) == [".github/workflows/ci.yml", "bytes.rs", "empty.txt", "src/a.rs"]
    files, left = S.scanned_files(spark, str(project))
    assert N.project_stats(N.inventory(files), left).first().filtered_by_ignore == 3


def test_incremental_build_parses_changes_only(spark, project, tmp_path):
    state = str(tmp_path / "state")
    seen = []

    def spy(rows):
        seen.append(sorted(r.path for r in rows.select("path").collect()))
        return P.RUST.transform(rows)

    registry = P.Registry([P.Parser("rust", ("rs",), spy)])
    build = lambda: I.build_incremental(S.project_files(spark, str(project)), "demo", state, registry=registry)
    first = build()
    assert first.edges.where("type = 'imports'").count() == 1
    assert build() is None
    (project / "src/b.rs").write_text("pub struct B;\nuse crate::a;\n")
    seen.clear()
    second = build()
    assert seen == [["src/b.rs"]]
    assert second.edges.where("type = 'imports'").count() == 2
    (project / "src/b.rs").unlink()
    third = build()
    assert third.nodes.where("file_path = 'src/b.rs'").count() == 0
    with pytest.raises(Exception, match="unreadable"):
        I.fingerprints(spark.createDataFrame([("a", None)], "path string, content string")).collect()


def test_snapshot_status(spark):
    kind = "path string, hash string"
    old = spark.createDataFrame([("a.rs", "1"), ("b.rs", "2"), ("d.rs", "4")], kind)
    new = spark.createDataFrame([("a.rs", "1"), ("b.rs", "2x"), ("c.rs", "3")], kind)
    assert sorted(r.path for r in I.changed_files(old, new).collect()) == ["b.rs", "c.rs"]
    assert I.changed_files(old.limit(0), new).count() == 3
    assert dict(map(tuple, I.snapshot_status(old, new).collect())) == {"a.rs": "unchanged", "b.rs": "modified", "c.rs": "added", "d.rs": "deleted"}


def test_batches(spark, inventory):
    ten = spark.createDataFrame([(f"f{k}.rs", "rust", 100 if k else 5000, "code") for k in range(11)], INVENTORY)
    got = A.batches(ten, A.AnalysisConfig(max_files_per_batch=3)).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 1]
    with pytest.raises(ValueError):
        A.batches(ten, A.AnalysisConfig(max_files_per_batch=0))
    assert [r.n for r in numbered(ten, "path").orderBy("path").collect()] == list(range(1, 12))
    assert numbered(ten.limit(0), "path").count() == 0


def test_extract_json(spark):
    answers = ['{"a": 1}', " [1] ", 'text\n```json\n{"a": 2}\n```\nmore', "```\n[2]\n```", 'see {"a": 3} end', "nothing"]
    assert column(spark, C.extract_json, *answers) == ['{"a": 1}', "[1]", '{"a": 2}', "[2]", '{"a": 3} end', "nothing"]


def test_aliases(spark):
    assert column(spark, C.node_alias, "func", "FN", "mod", "doc", "route", "x") == ["function", "function", "module", "document", "endpoint", None]
    assert column(spark, C.edge_alias, "calls", "invokes", "extends", "reads", "depends", "unknown") == ["calls", "calls", "inherits", "reads_from", "depends_on", "related"]
    assert len(T.NODE_TYPES) == 21 and len(T.EDGE_TYPES) == 35 and len(T.EXTENSIONS) == 29


def test_model_build(spark, inventory, tmp_path):
    contents = spark.createDataFrame([(p, "text") for p, *_ in FILES], "path string, content string")
    asked = tmp_path / "asked"
    asked.mkdir()

    def dispatch(agent, prompt):
        if agent == "file-analyzer":
            return 'Sure:\n```json\n{"nodes": [{"id": "f1", "type": "fn", "name": "calc", "file_path": "src/main.rs", "line_range": [10, 25], "tags": ["math", 3]}, {}], "edges": [{"source": "f1", "target": "f2", "type": "invokes"}]}\n```'
        if agent == "graph-reviewer":
            assert '"id":"f1"' in prompt and '"source":"f1"' in prompt
            return '{"issues": [{"severity": "error", "message": "no tests"}, {"severity": "warning", "message": "w"}], "improvements": ["name node-2"]}'
        return "no JSON here" if agent == "tour-builder" else '[{"id": "core", "name": "Core", "node_ids": ["f1"]}]'

    with pytest.raises(ValueError, match="not enabled"):
        A.build_with_model(inventory, contents, "demo", dispatch, str(tmp_path), A.AnalysisConfig())
    made = A.build_with_model(inventory, contents, "demo", dispatch, str(tmp_path), A.AnalysisConfig(use_llm_analysis=True, max_files_per_batch=10), "0")
    nodes = {r.id: r for r in made.nodes.collect()}
    assert nodes["f1"].type == "function" and nodes["f1"].tags == ["math"] and nodes["f1"].line_range == [10, 25]
    assert nodes["node-2"].name == "unknown" and nodes["file-3"].file_path == "Cargo.toml"
    assert [(r.type, r.weight) for r in made.edges.collect()] == [("calls", 0.5)]
    layers = {r.id: r.node_ids for r in made.layers.collect()}
    assert layers["core"] == ["f1"] and sorted(i for ids in layers.values() for i in ids) == sorted(nodes)
    assert [r.title for r in made.tour.orderBy("order").collect()] == ["Project Overview", "Key Files"]
    assert {tuple(r) for r in made.findings.collect()} == {("error", "no tests"), ("improvement", "name node-2")}


def test_layers_cover_all_nodes_when_an_answer_fails(spark, tmp_path):
    """Two prompts about the architecture, one answered badly and one naming a node twice; the later prompts show layers and tour."""
    files = N.inventory(spark.createDataFrame([(f"src/f{k:03}.{'md' if k % 3 == 0 else 'rs'}", "x\n") for k in range(700)], "path string, content string"))
    contents = spark.createDataFrame([("src/f001.rs", "x")], "path string, content string")

    def dispatch(agent, prompt):
        ids = re.findall(r'"id":"(file-[0-9]+)"', prompt)
        if agent == "architecture-analyzer":
            return json.dumps([{"id": "a", "name": "A", "node_ids": ids}, {"id": "b", "name": "B", "node_ids": ids[:2] + ["f1"]}]) if '"f1"' in prompt else "I can't."
        if agent == "tour-builder":
            assert '"layer":' in prompt
            return json.dumps([{"order": 1, "title": "T", "node_ids": ids[:1]}])
        if agent == "graph-reviewer":
            return json.dumps({"improvements": [line for line in prompt.split("\n") if '"step":' in line or '"layer":' in line and '"name":"A"' in line]})
        return '{"nodes": [{"id": "f1", "name": "one", "file_path": "src/f001.rs"}]}'

    made = A.build_with_model(files, contents, "demo", dispatch, str(tmp_path), A.AnalysisConfig(use_llm_analysis=True), "0")
    nodes = [r.id for r in made.nodes.collect()]
    layers = {r.id: (r.name, r.node_ids) for r in made.layers.collect()}
    assert len(nodes) == 700 and sorted(i for _, ids in layers.values() for i in ids) == sorted(nodes)
    assert layers["a"][0] == "A" and len(layers["a"][1]) == 499 and layers["b"] == ("B", ["f1"]) and {*layers} - {"a", "b"} == {"code"}
    assert made.layers.join(made.nodes, F.array_contains("node_ids", made.nodes.id)).count() == 700
    shown = " ".join(r.message for r in made.findings.collect())
    assert '"title":"T"' in shown and '"node_id":"file-' in shown and '"layer":"a"' in shown


def test_prompts_show_the_whole_graph_and_their_answers_are_merged(spark):
    files = N.inventory(spark.createDataFrame([(f"src/f{k}.rs", "fn a() {}\n") for k in range(7)], "path string, content string"))
    nodes, edges = G.file_nodes(files), G.contains_edges(files)
    prompts = A.graph_prompts("tour-builder", A.project_context(N.project_stats(files)), nodes, edges, lines=4).orderBy("batch").collect()
    shown = [line for r in prompts for line in r.prompt.split("\n")[2:]]
    assert [r.batch for r in prompts] == [0, 1, 2, 3] and len(shown) == nodes.count() + edges.count() == 14
    assert all(sum(f'"id":"{r.id}"' in line for line in shown) == 1 for r in nodes.collect())
    layers = A.answer_layers(spark.createDataFrame([(1, '[{"id": "a", "name": "Late", "node_ids": ["z", "x"]}, {"id": "b", "name": "B"}]'), (0, '[{"id": "a", "name": "A", "node_ids": ["x", "y"]}]')], "batch bigint, response string"))
    assert [(r.id, r.name, r.node_ids) for r in A.merged_layers(layers).collect()] == [("a", "A", ["x", "y", "z"]), ("b", "B", [])]
    tours = A.answer_tour(spark.createDataFrame([(1, '[{"order": 1, "title": "c"}]'), (0, '[{"order": 2, "title": "b"}, {"order": 1, "title": "a"}]')], "batch bigint, response string"))
    assert [(r.order, r.title) for r in A.merged_tour(tours).orderBy("order").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_answers_that_are_wrong(spark):
    rows = spark.createDataFrame([(1, "[{}]"), (2, '[{"id": "a", "name": "A"}]'), (3, "nope")], "batch bigint, response string")
    got = {r.batch: r.layers for r in A.answer_layers(rows).collect()}
    assert got[1] is None and got[3] is None and got[2][0].node_ids == []
    tours = {r.batch: r.tour for r in A.answer_tour(rows).collect()}
    assert tours[1][0].title == "Untitled Step" and tours[1][0].order == 0 and tours[3] is None
    assert [r.batch for r in A.unreadable(rows).collect()] == [3]
    review = spark.createDataFrame([('{"issues": [{"severity": "error", "message": "m"}, {"severity": "info", "message": "n"}]}',)], "response string")
    assert [r.message for r in A.review_findings(review).collect()] == ["m"]


def test_command_line_and_rpc(spark, project, tmp_path, capsys):
    out = tmp_path / "graph.json"
    assert cli.main(["build", str(project), str(out)]) == 0
    assert json.loads(out.read_text())["project"]["git_commit_hash"] == "0123456789abcdef"
    assert cli.main(["build", str(project), str(out), "--incremental"]) == 0
    assert "up to date" in capsys.readouterr().out
    assert cli.main(["scan", str(project)]) == 0 and "7 files | simple" in capsys.readouterr().out
    assert cli.main(["parse", str(project)]) == 0 and "src/a.rs: 1 defs, 1 imports" in capsys.readouterr().out
    assert cli.main([]) == 0
    calls = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "project_scan", "arguments": {"path": str(project)}}}, {"id": 4, "method": "tools/call", "params": {"name": "no"}}, {"id": 5, "method": "what"}, {"method": "notified"}]
    got = [json.loads(x) for x in rpc.serve(spark, ["", "{bad", *map(json.dumps, calls)])]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5]
    assert len(got[1]["result"]["tools"]) == 3 and '"total_files"' in got[2]["result"]["content"][0]["text"]
    assert got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601


def test_watched_stream(spark, tmp_path, monkeypatch):
    kind = "path string, content string, version bigint"
    source, changes = tmp_path / "in", tmp_path / "changes"

    def run():
        W.watch(spark.readStream.schema(kind).json(str(source)), str(changes), str(tmp_path / "cp")).awaitTermination()

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(source))

    seen = lambda: {tuple(r) for r in spark.read.schema("path string, status string, version bigint, batch int").parquet(str(changes)).collect()}
    arrive([("a", "1", 1), ("b", "1", 1), ("a", "2", 2), (None, "x", 1)])
    run()
    first = {("a", "added", 2, 0), ("b", "added", 1, 0)}
    assert seen() == first
    # The second batch is killed after it has written; it runs again from the same state.
    arrive([("a", "2", 3), ("b", "9", 2), ("c", "1", 1), ("b", "1", 0)])
    real = W.save

    def killed(batch, path):
        real(batch, path)
        raise RuntimeError("Killed")

    monkeypatch.setattr(W, "save", killed)
    with pytest.raises(Exception, match="Killed"):
        run()
    monkeypatch.undo()
    run()
    second = first | {("b", "modified", 2, 1), ("c", "added", 1, 1)}
    assert seen() == second
    arrive([("a", None, 4), ("a", "7", 3), ("c", "2", 0), ("b", None, 3), ("b", "5", 4)])
    run()
    third = second | {("a", "deleted", 4, 2), ("b", "modified", 4, 2)}
    assert seen() == third
    arrive([("a", "7", 3), ("a", "8", 5)])
    run()
    assert seen() == third | {("a", "added", 5, 3)}
