"""What a query sends to the driver, and what one task does, stays bounded as tables grow."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.functions import spread
from graphloom.operators import definitions as D
from graphloom.operators import search as S
from graphloom.plans import catalog
from graphloom.sources import virtual as V

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["definition_nodes", "part_definition_nodes", "definition_edges", "scored_search"])
def test_nothing_that_grows_is_broadcast(spark, name):
    """Parts are a file of a few bytes a row, so by size alone Spark took all that was made of them for small."""
    assert "Broadcast" not in plan(catalog.queries()[name](spark, DATA))


@pytest.mark.parametrize("name", ["definition_nodes", "part_definition_nodes"])
def test_definitions_need_one_deal_of_the_parts(spark, name):
    found = plan(catalog.queries()[name](spark, DATA))
    assert found.count("Exchange") == 1 and "Join" not in found


def test_nodes_by_themselves_are_those_of_the_graph(spark):
    texts = ["fn a() { fn b() {} }\nfn b(", "struct S { f: fn(u8) -> u8 }\nimpl S { fn b() { [1; 2] } }\nfn never() {", ""]
    files = spark.createDataFrame([(f"p{k}.rs", t) for k, t in enumerate(texts)] + [("n.rs", None)], "path string, content string")
    key = lambda rows: sorted((r.id, r.name, r.file_path, tuple(r.line_range), r.ord) for r in rows.collect())
    alone = key(D.definition_nodes(files))
    assert alone == key(D.definition_graph(files)[0]) and len(alone) == 6
    lines = sorted((path, name, *at) for _, name, path, at, _ in alone)
    assert lines == [("p0.rs", "a", 1, 1), ("p0.rs", "b", 1, 1), ("p0.rs", "b", 2, 2), ("p1.rs", "S", 1, 1), ("p1.rs", "b", 2, 2), ("p1.rs", "never", 3, 3)]


def test_what_is_around_a_token_is_found_without_a_join(spark):
    """Tokens, bodies and ids were joined within files; now one join looks up the names that are defined once anywhere."""
    texts = ["fn a() { fn b() { c() } b() }\nstruct S { x: u8 }", "impl S { fn c() { [d(); 2] } }\nfn d();\nfn e() { c() }"]
    files = spark.createDataFrame([(f"p{k}.rs", t) for k, t in enumerate(texts)], "path string, content string")
    edges = D.definition_graph(files)[1]
    assert plan(edges).count("Join") == 1
    rows = sorted((r.type, r.description) for r in edges.select("type", "description").collect())
    assert rows == [("calls", f"p{at}") for at in ("0.rs line 1 calls b", "0.rs line 1 calls c", "1.rs line 1 calls d", "1.rs line 3 calls c")] + [("contains", f"p{at}") for at in ("0.rs line 1 contains a", "0.rs line 1 contains b", "0.rs line 2 contains S", "1.rs line 1 contains c", "1.rs line 2 contains d", "1.rs line 3 contains e")]


@pytest.mark.parametrize("name", ["script_definitions", "script_imports", "script_endpoints", "parse_definitions"])
def test_texts_are_parsed_once(spark, name):
    """An inner explode was preceded by a filter on the size of the parsed arrays, which parsed each text again."""
    assert "(size(coalesce(" not in plan(catalog.queries()[name](spark, DATA))


@pytest.mark.parametrize("source", [V.part_sources, V.program_sources, V.script_sources])
def test_parts_are_dealt_by_their_number(spark, source, monkeypatch):
    monkeypatch.setattr(spread.dealt, "__kwdefaults__", {"per": 50})
    assert source(spark, DATA).rdd.getNumPartitions() == V.table(spark, DATA, "part").count() // 50


def test_deals_of_few_rows_and_of_none(spark):
    rows = spark.range(7)
    assert spread.dealt(rows, "id", per=3).rdd.getNumPartitions() == 3
    assert spread.dealt(rows.where("id < 0"), "id", per=3).rdd.getNumPartitions() == 1


def test_names_that_share_all_but_a_number_meet_few_others(spark):
    """By trigrams each of these names met a good part of all others."""
    names = [f"large ring {k}" for k in range(100_000, 102_000)]
    index = S.build_index(spark.createDataFrame([(n, n) for n in names], "id string, name string"))
    asked = spark.createDataFrame([(k, n) for k, n in enumerate(names[::100])], "query_id bigint, text string")
    met = S.candidates(index, asked).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert met < 1000


def test_imports_of_lines_are_numbered_where_they_are_dealt(spark):
    """Each order's lines were gathered before they were taken apart again, in a sort that held a scan's whole share of the lines."""
    imports, files = V.import_lines(spark, DATA)
    assert "collect_list" not in plan(catalog.queries()["import_edges"](spark, DATA)) and plan(imports).count("Exchange") == 1
    lines = V.table(spark, DATA, "lineitem")
    assert imports.count() == lines.count()
    wanted = lines.orderBy("l_orderkey", "l_linenumber", "l_partkey").collect()
    got = {(r.path, r.position): (r.source, r.last) for r in imports.collect()}
    seen = {}
    for r in wanted:
        path = f"orders/o_{r.l_orderkey}.rs"
        seen[path] = seen.get(path, -1) + 1
        assert got[path, seen[path]] == (f"crate::parts::p_{r.l_partkey}", f"p_{r.l_partkey}")
    assert files.count() == len(seen) + V.table(spark, DATA, "part").count()


def test_a_snapshot_parses_its_files_once(spark, tmp_path, monkeypatch):
    """Each of a state's tables parsed all files again."""
    from graphloom.operators import incremental as I
    from graphloom.operators import merge as M

    given = []
    monkeypatch.setattr(M, "full", lambda *rows, make=M.full: given.extend(rows) or make(*rows))
    files = spark.createDataFrame([("src/a.rs", "use crate::b;\nfn f() {}\n"), ("src/b.rs", "fn g() {}\n")], "path string, content string")
    state = I.full_state(files, str(tmp_path / "state"))
    assert [(r.source, r.target_path) for r in state.links.select("source", "target_path").collect()] == [("crate::b", "src/b.rs")]
    assert all("ExistingRDD" in plan(rows) for rows in given)


def test_lines_and_answers_are_dealt(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(V, "dealt", lambda rows, *keys, **how: dealt.append(keys) or spread.dealt(rows, *keys, **how))
    V.source_versions(spark, DATA)
    V.agent_answers(spark, DATA)
    assert dealt == [("path",), ("path",), ("p_partkey",)]


@pytest.mark.parametrize("name", ["edge_union", "import_list", "dangling_edges", "valid_links", "neighbours"])
def test_imports_meet_on_as_many_tasks_as_their_lines_need(spark, name, monkeypatch):
    """Small partitions were joined to ones of 64 compressed MB, which were millions of rows; neighbours computed all edges four times."""
    monkeypatch.setattr(catalog, "tasks_of", lambda rows: 37)
    found = plan(catalog.queries()[name](spark, DATA))
    assert found.count(", 37), REPARTITION_BY_NUM") >= (5 if name == "edge_union" else 7)
    assert sum("FileScan" in line and "l_partkey" in line for line in found.splitlines()) == 1


def test_edges_of_a_graph_of_rows_are_computed_once(spark):
    """A Markdown report counts edges and lists imports twice, and each time parsed all files again."""
    graph = catalog._part_graph(spark, DATA)
    assert "ExistingRDD" in plan(graph.edges) and "FileScan" not in plan(graph.edges)


def test_model_answers_are_dealt_and_nodes_taken_apart_once(spark, monkeypatch):
    """A file of a few MB of events was a task or two, and nodes were taken out of their answers again by each pass that draws or sorts ranges."""
    from graphloom.operators import assist as A

    dealt, given = [], []
    monkeypatch.setattr(V, "dealt", lambda rows, *keys, **how: dealt.append(keys) or spread.dealt(rows, *keys, per=50))
    monkeypatch.setattr(A, "numbered", lambda rows, *order, make=A.numbered: given.append(rows) or make(rows, *order))
    answers = V.model_answers(spark, DATA)
    assert dealt == [("event_id",)] and answers.rdd.getNumPartitions() == V.table(spark, DATA, "events").count() // 50
    items = A.answer_items(answers)
    # The schema of a whole answer is not made to see whether it is an array, and both kinds are read in one pass.
    assert "schema_of_variant" not in plan(items) and plan(items).count("ExistingRDD") == 1
    A.answer_nodes(items)
    assert len(given) == 1 and "ExistingRDD" in plan(given[0]) and "variant" not in plan(given[0])


def test_white_space_at_the_ends_is_that_before_no_other_character(spark):
    """A pattern's end was also before a last line separator, so that white space inside the text went."""
    from graphloom.functions import columns as C

    texts = ["\n\x0b a \x0c\r\t", "a  ", "a \u0085", "  a", " \n", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    assert [r[0] for r in rows.select(C.trimmed(F.col("t"))).collect()] == ["a", "a  ", "a \u0085", "  a", "", "", None]


def test_items_and_elements_of_odd_answers(spark):
    from graphloom.operators import assist as A

    odd = [None, "", "7", "[]", "{}", "[null, 1]", '{"nodes": {"a": {"id": "x"}}}', '{"nodes": null}', '[1, {"nodes": [null, {"id": 5, "line_range": [1, "2", 3]}, {"id": "b", "tags": ["t", 4]}]}]']
    items = A.answer_items(spark.createDataFrame(list(enumerate(odd)), "batch bigint, response string"))
    assert sorted(tuple(r) for r in items.select("batch", "item").collect()) == [(4, 0), (5, 0), (5, 1), (6, 0), (7, 0), (8, 0), (8, 1)]
    nodes = A.answer_nodes(items).orderBy("ord").collect()
    assert [(r.id, r.name, r.line_range, r.tags) for r in nodes] == [("node-1", "unknown", None, []), ("node-2", "unknown", [1, 2], []), ("b", "unknown", None, ["t"])]


def test_a_build_reads_each_file_once(spark, tmp_path):
    """A full build read the files for fingerprints, inventory and parsed texts each, an incremental one five times."""
    from pyspark.sql import types as T

    from graphloom.operators import incremental as I

    reads = spark.sparkContext.accumulator(0)
    read = F.udf(lambda text: reads.add(1) or text, T.StringType())
    of = lambda texts: spark.createDataFrame(sorted(texts.items()), "path string, content string").withColumn("content", read("content"))
    old = {"src/a.rs": "use crate::b;\n", "src/b.rs": "fn g() {}\n", "n.md": "x"}
    I.full_state(of(old), str(tmp_path / "state"), "first", "2025-01-01T00:00:00Z")
    assert reads.value == 3
    new = I.changed_state(of(old | {"src/a.rs": "use crate::c;\n", "src/c.rs": ""}), str(tmp_path / "state"))
    assert reads.value == 3 + 4
    assert [(r.path, r.target_path) for r in new.links.collect()] == [("src/a.rs", "src/c.rs")]


def test_files_are_compared_as_by_their_status(spark):
    """Repeated rows, excluded files, folders with backslashes and paths that are null: in one pass as by two tables of fingerprints."""
    from graphloom.operators import incremental as I
    from graphloom.operators import parse as P
    from graphloom.operators import scan as N

    rows = lambda *pairs: spark.createDataFrame(list(pairs), "path string, content string")
    old = rows(("a.rs", "x"), ("a.rs", "x"), ("b.rs", "x"), ("b.rs", "y"), ("c.rs", "x"), ("d.rs", "x"), ("e.rs", "x"), (None, "x"))
    new = rows(("a.rs", "x"), ("b.rs", "x"), ("c.rs", "x"), ("c.rs", "y"), ("d.rs", "y"), ("f.rs", "use a;"), ("f.rs", "use a;"), (".h.rs", "use a;"), ("s\\t.rs", "use a;"), ("s/u.rs", "fn f() {}"), ("n.md", "x"), (None, "x"))
    status = I.snapshot_status(I.fingerprints(old), I.fingerprints(new)).where("status <> 'unchanged'")
    one = I.compared(I.fingerprints(old), new)
    key = lambda rows: sorted(map(repr, rows.distinct().collect()))
    assert key(one.where("status <> 'unchanged'").select("path", "status")) == key(status)
    assert sorted(map(repr, one.where("hash is not null").select("path", "hash").collect())) == sorted(map(repr, I.fingerprints(new).collect()))
    gone, found, parsed = I.changes_of(one)
    changed = new.join(status.where("status in ('added', 'modified')").select("path").distinct(), "path", "left_semi")
    plainly = N.inventory(changed)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plainly.collect()))
    texts = P.Registry().parse(changed.join(N.code_files(plainly).select("path"), "path", "left_semi"))
    brief = lambda rows: sorted((r.path, r.line_count, [d.name for d in r.definitions], [i.source for i in r.imports]) for r in rows.collect())
    assert brief(parsed) == brief(texts) and len(brief(texts)) > 3
    assert key(gone.where("path is not null")) == key(status.where("status in ('modified', 'deleted') and path is not null").select("path"))


def test_patterns_are_searched_only_where_their_words_are(spark):
    """Definitions and sources without places are those of the texts with marks, main, several lines and no words."""
    from graphloom.operators import parse as P

    texts = ["fn main() {}\nfn a() {}", "f\u0001n b() {}\nst\u0002ruct C;", "use a::\n  b ;\n\u0001use c;", "impl<T> X for Y {}\ntrait Z {}\nenum E {}", "nothing", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, content string").orderBy("k")
    c = F.col("content")
    both = rows.select(P.rust_definitions(c)["name"].alias("a"), P.rust_definitions(c, P.texts)["name"].alias("b"), P.rust_imports(c)["source"].alias("c"), P.rust_sources(c)["source"].alias("d")).collect()
    assert [r.a for r in both] == [r.b for r in both] == [["a"], ["b", "C"], [], ["Z", "E", "impl X"], [], []]
    assert [r.c for r in both] == [r.d for r in both] == [[], [], ["a::\n  b", "c"], [], [], []]


def test_folders_and_edges_are_counted_by_folder(spark):
    """Each file's folders were taken apart for it."""
    from graphloom.functions import columns as C
    from graphloom.operators import graph as G
    from graphloom.operators import merge as M

    paths = ["a.rs", "/a.rs", "a/b.rs", "a/b/c.rs", "a/b/c.rs", "a//b.rs", "a/", "x/y/z/w", "//", "", None]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = lambda made: sorted(map(tuple, made.collect()))
    assert rows(M._sums([G.contains_counts(files)], "p", "c")) == rows(G.contains_pairs(files).groupBy("p", "c").count())
    assert rows(M._sums([G.folder_counts(files)], "p")) == rows(files.select(F.explode(C.ancestors(F.col("path"))).alias("p")).groupBy("p").count())


@pytest.mark.parametrize("name, never", [("merged_edges", {"summary", "complexity", "members", "language"}), ("merged_layers", {"summary", "imports", "target_path", "position", "key"}), ("merged_nodes", {"summary", "target_path", "position", "key", "members"})])
def test_a_merged_table_holds_what_it_needs(spark, name, never, monkeypatch):
    """All tables of the old state and of the change were computed and held, whichever one was asked for."""
    from graphloom.operators import incremental as I
    from graphloom.operators import merge as M

    seen, make = [], catalog.held
    for module in (catalog, I, M):
        monkeypatch.setattr(module, "held", lambda rows: seen.append(set(rows.columns)) or make(rows))
    made = catalog.queries()[name](spark, DATA)
    assert made.columns and 0 < len(seen) <= 11
    # The inventory is held where files are examined; from there on only what the table takes.
    assert not [held & never for held in seen if "file_category" not in held and held & never]
