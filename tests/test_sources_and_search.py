"""Lexer, definitions and calls, ignore files, and scored search against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions.lexer import code_only
from graphloom.operators import definitions as D
from graphloom.operators import graph as G
from graphloom.operators import ignore as R
from graphloom.operators import search as S

FILES = "path string, content string"


def table(spark, rows):
    return spark.createDataFrame(rows, FILES)


# --- lexer ---


@pytest.mark.parametrize(
    ("language", "text", "shown"),
    [
        ("rust", 'a "b // c" d // "e\nf', "a          d      \nf"),
        ("rust", "x /* a /* b */ c */ y", "x                   y"),
        ("rust", "x /* never\nclosed", "x         \n      "),
        ("rust", "let c = '\"'; fn f<'a>(s: &'a str) {}", "let c =    ; fn f<'a>(s: &'a str) {}"),
        ("rust", 'r#"a "quoted" b"# + "\\\\" + b"x"', "                  +      +     "),
        ("python", "x = '''a\n# b''' # c 'd\ny = \"\\\"\" + 'z'", "x =     \n           \ny =      +    "),
        ("typescript", "`a // ${b}` + 'c' /* d\n*/ + \"e\"", "            +          \n   +    "),
        ("rust", "", ""),
        ("rust", None, None),
    ],
)
def test_strings_and_comments_are_blanked(spark, language, text, shown):
    found = spark.createDataFrame([(text,)], "t string").select(code_only(F.col("t"), language).alias("c")).first().c
    assert (found and re.sub(" +", " ", found)) == (shown and re.sub(" +", " ", shown))
    if text:
        assert len(found) == len(text)


def test_long_comments_and_strings_are_blanked(spark):
    text = "/* " + "/* x */ * / " * 30_000 + "*/ fn f() { \"" + "\\\" " * 30_000 + "\" }"
    found = spark.createDataFrame([(text,)], "t string").select(code_only(F.col("t"), "rust").alias("c")).first().c
    assert len(found) == len(text) and found.split() == ["fn", "f()", "{", "}"]


# --- definitions and calls ---

LIB = """use crate::util;
pub struct Pair(u32, u32);

impl Pair {
    pub fn new(
        a: u32,
    ) -> Pair
    {
        fn check(x: u32) -> bool { x > limit(0) }
        if check(a) { util::twice(a); }
        Pair(a, 1)
    }
    fn each(&self, f: impl Fn(u32)) { for i in (0..3) { f(helper(i)); self.each(g); } }
}

trait Shape { fn area(&self) -> u32; fn twice_area(&self) -> u32 { 2 * self.area() } }
fn helper(x: [u32; 2]) -> u32 { nowhere(x) }
static X: u32 = helper([1, 2]);
"""


def test_definitions_and_calls(spark):
    files = table(spark, [("lib.rs", LIB), ("util.rs", "pub fn twice(x: u32) -> u32 {\n    x + x\n}\n"), ("a.rs", "fn twice() {}\nfn limit(x: u32)\n"), ("none.rs", None), ("empty.rs", "")])
    imports = spark.createDataFrame([("lib.rs", "util.rs")], "path string, target_path string")
    nodes, edges = D.definition_graph(files, imports)
    found = {r.id: r for r in nodes.collect()}
    assert sorted((r.file_path, r.name, r.type, *r.line_range) for r in found.values()) == sorted([
        ("lib.rs", "Pair", "class", 2, 2), ("lib.rs", "new", "function", 5, 12), ("lib.rs", "check", "function", 9, 9), ("lib.rs", "each", "function", 13, 13),
        ("lib.rs", "Shape", "class", 16, 16), ("lib.rs", "area", "function", 16, 16), ("lib.rs", "twice_area", "function", 16, 16), ("lib.rs", "helper", "function", 17, 17),
        ("util.rs", "twice", "function", 1, 3), ("a.rs", "twice", "function", 1, 1), ("a.rs", "limit", "function", 2, 2),
    ])
    files_ids = {r.id: r.path for r in table(spark, [(p, "") for p in ("lib.rs", "util.rs", "a.rs")]).select("path", G.C.node_id(F.col("path")).alias("id")).collect()}
    label = lambda i: files_ids.get(i) or f"{found[i].file_path}:{found[i].name}"
    links = {(r.type, label(r.source), label(r.target)) for r in edges.collect()}
    assert {x[1:] for x in links if x[0] == "calls"} == {
        ("lib.rs:check", "a.rs:limit"), ("lib.rs:new", "lib.rs:check"), ("lib.rs:new", "util.rs:twice"), ("lib.rs:new", "lib.rs:Pair"), ("lib.rs:each", "lib.rs:helper"), ("lib.rs:twice_area", "lib.rs:area"), ("lib.rs", "lib.rs:helper"),
    }
    assert ("contains", "lib.rs:new", "lib.rs:check") in links and ("contains", "lib.rs:Shape", "lib.rs:area") in links and ("contains", "lib.rs", "lib.rs:new") in links
    assert len(links) == edges.count() == 18
    alone = D.definition_graph(files)[1].where("type = 'calls'")
    assert alone.count() == 6  # two files define twice, and none is imported


def test_definitions_in_a_project_graph(spark):
    from graphloom.operators import parse as P
    from graphloom.operators import query as Q
    from graphloom.operators import scan as N

    files = table(spark, [("src/a.rs", "use crate::b;\nfn run() { help(); }\n"), ("src/b.rs", "pub fn help() {}\n"), ("c.rs", "fn help() {}\n")])
    parsed = P.Registry().parse(files)
    graph = D.with_definitions(G.build_graph(N.inventory(files), parsed, "p", "t"), files, parsed)
    assert Q.dangling_edges(graph.edges, graph.nodes).count() == 0 and Q.layer_coverage(graph.nodes, graph.layers).count() == 0
    names = {r.id: f"{r.file_path}:{r.name}" for r in graph.nodes.collect()}
    assert [(names[r.source], names[r.target]) for r in graph.edges.where("type = 'calls'").collect()] == [("src/a.rs:run", "src/b.rs:help")]


def test_unclosed_and_repeated_definitions(spark):
    nodes, edges = D.definition_graph(table(spark, [("a.rs", "fn f() {\n fn f() { f() }\n }}\n fn g(\n"), ("b.rs", "fn h() {\n{\n h()")]))
    assert sorted((r.name, *r.line_range) for r in nodes.collect()) == [("f", 1, 3), ("f", 2, 2), ("g", 4, 4), ("h", 1, 3)]
    assert nodes.select("id").distinct().count() == 4
    # Inside the second f, the first of that name is called.
    assert edges.where("type = 'calls'").count() == 1
    assert [rows.count() for rows in D.definition_graph(table(spark, []))] == [0, 0]


# --- ignore files ---


def plain_match(pattern, path):
    """A pattern against a whole path, by trying all ways."""
    if not pattern:
        return not path
    if pattern.startswith("**/"):
        return plain_match(pattern[3:], path) or any(c == "/" and plain_match(pattern[3:], path[i + 1 :]) for i, c in enumerate(path))
    if pattern == "/**":
        return path.startswith("/") and len(path) > 1
    if pattern[0] == "*":
        rest = pattern.lstrip("*")
        return any(plain_match(rest, path[i:]) for i in range(len(path) + 1) if "/" not in path[:i])
    if not path:
        return False
    if pattern[0] == "?":
        return path[0] != "/" and plain_match(pattern[1:], path[1:])
    if pattern[0] == "[" and "]" in pattern[2:]:
        end = pattern.index("]", 2)
        inside = pattern[1:end]
        return ((path[0] in inside.lstrip("!")) != inside.startswith("!")) and plain_match(pattern[end + 1 :], path[1:])
    if pattern[0] == "\\":
        return path[0] == pattern[1] and plain_match(pattern[2:], path[1:])
    return path[0] == pattern[0] and plain_match(pattern[1:], path[1:])


def plain_ignored(path, rules):
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        here, folder, last = "/".join(parts[:n]), n < len(parts), None
        for m in range(n):
            base = "/".join(parts[:m])
            for line in rules.get(base, "").split("\n"):
                line = re.sub(r"(?<!\\)\s+$", "", line)
                if not line or line.startswith("#"):
                    continue
                negated, text = line.startswith("!"), line.removeprefix("!")
                only, text = text.endswith("/"), text.rstrip("/")
                below = here[len(base) + 1 :] if base else here
                whole = text.removeprefix("/") if "/" in text else f"**/{text}"
                if (folder or not only) and plain_match(whole, below):
                    last = not negated
        if last:
            return True
    return False


PATTERNS = ("*.rs", "!a.rs", "src/", "/src", "src/*.md", "**/x/", "x/**", "!x/a*", "a?b", "[ab].md", "[!a].rs", "\\!b", "\\#c", "#remark", "a.b", "!*.md", "/x/**/a*", "**/b.md", "*", "!src", "a\\*b", "", "  ", "b.md  ")


def test_ignore_rules_by_all_ways(spark):
    rng = random.Random(5)
    names = ("a.rs", "b.rs", "b.md", "a.md", "axb", "a.b", "aXb", "!b", "#c", "a*b", "x")
    for _ in range(3):
        rules = {base: "\n".join(rng.choice(PATTERNS) for _ in range(rng.randint(0, 6))) for base in ("", "src", "src/x", "x")}
        paths = sorted({"/".join((*(rng.choice(("src", "x", "y")) for _ in range(rng.randint(0, 3))), rng.choice(names))) for _ in range(150)})
        marks = table(spark, [(f"{b}/.graphignore".lstrip("/"), t) for b, t in rules.items()])
        found = {r.path: r.ignored for r in R.ignored(table(spark, [(p, "") for p in paths + paths[:3]] + [(None, "")]), marks).collect()}
        assert found == {p: plain_ignored(p, rules) for p in paths}, rules


def test_ignoring_without_rules_and_with_odd_files(spark, monkeypatch):
    files = table(spark, [("a/b.rs", "x"), ("a/.graphignore", None), (".graphignore", "\n# none\n/\n")])
    kept, left_out = R.without_ignored(files)
    assert kept.count() == 3 and left_out.count() == 0
    assert R.ignored(files.limit(0), files).count() == 0
    monkeypatch.setattr(R, "SENT_FOLDERS", 0)
    marks = table(spark, [(".graphignore", "*.rs\n"), ("a/.graphignore", "!b.rs")])
    assert {r.path: r.ignored for r in R.ignored(table(spark, [("a/b.rs", ""), ("b.rs", "")]), marks).collect()} == {"a/b.rs": False, "b.rs": True}


# --- scored search ---


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_search_finds_all_names_within_the_distance(spark, most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abAB é") for _ in range(rng.randint(0, 14)))
    nodes = [(f"n{k}", word()) for k in range(120)] + [("n0", "again"), ("x", None), (None, "abab")]
    nodes += [(f"m{k}", n + rng.choice("ab")) for k, (_, n) in enumerate(nodes[:40])]
    asked = [(k, rng.choice([word(), nodes[k][1][:-1], nodes[k][1].upper()])) for k in range(60)] + [(90, None), (91, ""), (1, "ab"), (1, "ab")]
    index = S.build_index(spark.createDataFrame(nodes, "id string, name string"), most)
    found = S.search_names(index, spark.createDataFrame(asked, "query_id int, text string")).collect()
    wanted = set()
    for q, text in asked:
        for i, name in nodes:
            if text is not None and name is not None and i is not None and (d := distance(text.lower(), name.lower())) <= most:
                wanted.add((q, i, name.lower(), d, round(d / max(len(text), len(name), 1), 5)))
    assert {(r.query_id, r.id, r.name, r.distance, round(r.score, 5)) for r in found} == wanted and len(found) == len(wanted)


def test_frequent_trigrams_are_not_looked_up(spark):
    """All names share most trigrams; a query meets few of them."""
    nodes = spark.range(3000).select(F.col("id").cast("string"), F.format_string("common prefix %05d", F.col("id") * 37 % 99991).alias("name"))
    asked = spark.createDataFrame([(1, "common prefix 00037"), (2, "comon prefix 12345")], "query_id int, text string")
    assert S.candidates(S.build_index(nodes, 1), asked).count() < 300


# --- indented texts, articles, manifests ---


def plain_chains(text):
    """Ancestors by a stack of lines, as they are read."""
    out, stack, block = [], [], None
    for n, raw in enumerate(text.split("\n"), 1):
        if not raw.strip():
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        if block is not None and indent * 2 + raw.lstrip().startswith("- ") > block:
            out.append((n, None, None))
            continue
        if raw.strip().startswith("#"):
            continue
        block = None
        body = raw.strip()
        entries = []
        if body.startswith("- "):
            rest = body[2:].lstrip()
            keyed = ":" in rest
            entries.append((indent * 2 + 1, None))
            if keyed:
                entries.append(((indent + len(body) - len(rest)) * 2, rest.split(":")[0]))
        else:
            entries.append((indent * 2, body.split(":")[0] if ":" in body else None))
        for level, key in entries:
            while stack and stack[-1][0] >= level:
                stack.pop()
            out.append((n, key, tuple(k for _, k in stack)))
            stack.append((level, key))
        if body.endswith(": |"):
            block = stack[-1][0]
    return out


def test_outline_is_a_stack(spark):
    from graphloom.operators.outline import outline

    rng = random.Random(6)
    texts = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(0, 14)):
            lines.append(" " * rng.randint(0, 5) + rng.choice(["a: 1", "b:", "- c: x", "- d", "e: |", "# f", "", "g: 'h'"]))
        texts.append((f"{k}.yml", "\n".join(lines)))
    found = {}
    for r in outline(table(spark, [*texts, ("null.yml", None)])).orderBy("path", "at").collect():
        found.setdefault(r.path, []).append((r.line, None, None) if r.is_text else (r.line, r.key, tuple(c.key for c in r.chain)))
    dedupe = lambda rows: [r for k, r in enumerate(rows) if r[2] is not None or not k or rows[k - 1] != r]
    for path, text in texts:
        assert dedupe(found.get(path, [])) == dedupe(plain_chains(text)), text


def test_articles_and_backlinks(spark):
    from graphloom.operators import wiki as W

    kind = "id string, folder string, title string, content string"
    rows = [("1", "x", "Home", "[[A_b]] [[a  B#s|t]] [[none]] [[HOME]]"), ("2", "x", "a b", "[[Home]]"), ("3", "y", "A b", None), ("4", "y", None, "[[a b]] [[Home]] [[]] [[a"), (None, "y", "lost", "")]
    articles = spark.createDataFrame(rows, kind).withColumn("first", F.lit(1)).withColumn("n", F.lit(2))
    assert sorted((r.source, r.position, r.title, r.target, r.rule) for r in W.links(articles).collect()) == [
        ("1", 0, "A_b", "2", "folder"), ("1", 1, "a  B", "2", "folder"), ("1", 2, "none", None, "missing"), ("1", 3, "HOME", "1", "unique"), ("2", 0, "Home", "1", "unique"), ("4", 0, "a b", "3", "folder"), ("4", 1, "Home", "1", "unique"),
    ]
    nodes, edges = W.article_graph(articles.where("id is not null"), most=2)
    meta = {r.id: r.knowledge_meta for r in nodes.collect()}
    assert meta["1"].wikilinks == ["A_b", "a  B"] and meta["1"].backlinks == ["2", "4"] and meta["3"].backlinks == ["4"] and meta["4"].category == "y"
    assert {(r.source, r.target, r.description) for r in edges.collect()} == {("1", "2", "2 links"), ("2", "1", "1 links"), ("4", "3", "1 links"), ("4", "1", "1 links")}
    assert W.links(articles.limit(0)).count() == 0


def test_manifests_that_are_odd(spark):
    from graphloom.operators import frameworks as K

    cargo = '[dependencies]\naxum = "1"\n# tokio = "1"\n\n[target.x.dependencies]\ntokio.workspace = true\n[package]\nactix-web = "no"\n'
    files = table(spark, [("package.json", "{bad"), ("a/package.json", '{"dependencies": {"next": "1"}, "peerDependencies": {"react": "2"}}'), ("requirements-dev.txt", "-r x\nflask\nFLASK>1\n"), ("Cargo.toml", cargo), ("go.mod", None), ("x.txt", "flask")])
    deps = K.dependencies(files)
    assert deps.where("name = 'flask'").count() == 1
    assert sorted(map(tuple, K.frameworks(deps).collect())) == [("Cargo.toml", "axum"), ("Cargo.toml", "tokio"), ("a/package.json", "next"), ("a/package.json", "react"), ("requirements-dev.txt", "flask")]
    project = spark.createDataFrame([("p", ["a"], [])], "name string, languages array<string>, frameworks array<string>")
    assert K.with_frameworks(project, K.frameworks(deps)).first().frameworks == ["axum", "flask", "next", "react", "tokio"]
    assert K.with_frameworks(project, K.frameworks(deps.limit(0))).first().frameworks == []
