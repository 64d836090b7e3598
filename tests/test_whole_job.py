"""Registered queries cover their whole tables, and rows give the same as documents of one project."""

import json
import os
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphloom.operators import assist as A
from graphloom.operators import export as X
from graphloom.operators import graph as G
from graphloom.operators import parse as P
from graphloom.operators import scan as N
from graphloom.plans import catalog
from graphloom.sources import files as L
from graphloom.sources import virtual as V

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def parts(spark):
    """All parts' graph as one document and as rows."""
    files = V.part_sources(spark, DATA)
    given = N.inventory(files), P.Registry().parse(files), "parts", "2025-01-01T00:00:00Z"
    return G.build_graph(*given), G.build_rows(*given)


def in_order(rows):
    return sorted((r.section, r.ord, r.json) for r in rows.collect())


def test_json_rows_are_the_document(spark, parts):
    held = json.loads(X.graph_json(parts[0]).first()["json"])
    rows = in_order(catalog.graph_json(spark, DATA))
    assert rows == in_order(X.json_rows(parts[0])) == in_order(X.json_rows(parts[1]))
    own = {k: [json.loads(j) for section, _, j in rows if section == k] for k in range(7)}
    assert own[0] == [{k: held[k] for k in ("version", "kind", "project")}]
    assert own[1] == held["nodes"] and own[2] == held["edges"]
    assert sum("file_path" in n for n in own[1]) == V.table(spark, DATA, "part").count()
    ids = {layer["id"]: [m["id"] for m in own[4] if m["layer"] == layer["id"]] for layer in own[3]}
    assert [{k: v for k, v in layer.items() if k != "members"} | {"node_ids": ids[layer["id"]]} for layer in own[3]] == held["layers"]
    assert [layer["members"] for layer in own[3]] == [len(layer["node_ids"]) for layer in held["layers"]]
    assert [step | {"node_ids": [s["id"] for s in own[6] if s["order"] == step["order"]]} for step in own[5]] == held["tour"]


def test_markdown_lines_cover_all_parts(spark, parts):
    key = lambda rows: sorted((r.section, r.ord, r.line) for r in rows.collect())
    found = key(catalog.markdown_lines(spark, DATA))
    assert found == key(X.markdown_lines(parts[0]))
    assert sum(section == 2 and line.startswith("| ") for section, _, line in found) == V.table(spark, DATA, "part").count()


def test_payload_rows_are_the_payload(spark, parts):
    held = X.payload(parts[0]).first()
    rows = in_order(catalog.dashboard_payload(spark, DATA))
    for k, name in enumerate(("nodes", "links")):
        assert [json.loads(j) for section, _, j in rows if section == k] == json.loads(held[name])
    members: dict = {}
    for section, _, j in rows:
        if section == 2:
            m = json.loads(j)
            members.setdefault(m["layer"], []).append(m["id"])
    assert members == json.loads(held["layers"])


def test_fallback_tour_rows_are_the_tour(spark, parts):
    nodes = parts[0].nodes
    held = {r.order: r for r in A.fallback_tour(nodes).collect()}
    rows = sorted(((r.order, r.position, r.title, r.description, r.id) for r in catalog.fallback_tour(spark, DATA).collect()))
    assert len(rows) == V.table(spark, DATA, "part").count() + 5
    for order, step in held.items():
        own = [r for r in rows if r[0] == order]
        assert [r[4] for r in own] == step.node_ids and {r[2:4] for r in own} == {(step.title, step.description)}
    empty = A.fallback_tour_rows(nodes.limit(0)).orderBy("order").collect()
    assert [(r.order, r.position, r.id) for r in empty] == [(1, None, None), (2, None, None)]


def test_markdown_sections_of_whole_texts(spark):
    wanted = []
    for r in V.markdown_files(spark, DATA).collect():
        for k, line in enumerate(r.content.split("\n"), 1):
            if m := re.match(r"(#{1,6}) +(.*)$", line):
                wanted.append((r.path, re.sub(r"\s+#*\s*$", "", m[2]), len(m[1]), k))
    texts = V.table(spark, DATA, "documents").where("text is not null")
    assert texts.join(V.markdown_files(spark, DATA), F.expr("path = concat('docs/doc_', doc_id, '.md') and contains(content, text)")).count() == texts.count()
    assert sorted((r.path, r.title, r.level, r.line) for r in catalog.markdown_sections(spark, DATA).collect()) == sorted(wanted)


def test_stored_rows_are_switched_as_a_whole(spark, parts, tmp_path):
    parts = parts[1]
    place = str(tmp_path / "graph")
    assert L.load_rows(spark, place) is None
    X.write_rows(parts, place)
    first = L.load_rows(spark, place)
    assert (first.version, first.kind) == (parts.version, parts.kind)
    for name in G.ROW_TABLES:
        ours, theirs = getattr(parts, name), getattr(first, name)
        assert ours.columns == theirs.columns
        assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.collect()))
    few = replace(parts, nodes=parts.nodes.limit(1), kind=None)
    X.write_rows(few, place)
    second = L.load_rows(spark, place)
    assert second.nodes.count() == 1 and second.kind is None
    assert first.nodes.count() == parts.nodes.count()  # who reads the graph before still can
    X.write_rows(parts, place)
    assert len(list((tmp_path / "graph").glob("graph-*"))) == 2
