"""DuckDB SQL that states the registered queries independently; nothing is taken from the library's own tables."""

from __future__ import annotations

# Extensions and languages, written out for SQL.
_LANGUAGES = """lang_of(ext, language) AS (VALUES ('rs', 'rust'), ('ts', 'typescript'), ('tsx', 'typescript'), ('js', 'javascript'), ('jsx', 'javascript'), ('mjs', 'javascript'), ('cjs', 'javascript'),
    ('py', 'python'), ('pyi', 'python'), ('pyx', 'python'), ('go', 'go'), ('java', 'java'), ('kt', 'kotlin'), ('kts', 'kotlin'), ('swift', 'swift'), ('c', 'c'), ('h', 'c'),
    ('cpp', 'cpp'), ('cc', 'cpp'), ('cxx', 'cpp'), ('hpp', 'cpp'), ('hxx', 'cpp'), ('cs', 'csharp'), ('rb', 'ruby'), ('php', 'php'), ('lua', 'lua'), ('sql', 'sql'),
    ('sh', 'shell'), ('bash', 'shell'), ('zsh', 'shell'), ('ps1', 'powershell'), ('psm1', 'powershell'), ('psd1', 'powershell'), ('md', 'markdown'), ('mdx', 'markdown'), ('rst', 'markdown'),
    ('json', 'json'), ('yaml', 'yaml'), ('yml', 'yaml'), ('toml', 'toml'), ('xml', 'xml'), ('svg', 'xml'), ('html', 'xml'), ('htm', 'xml'), ('css', 'css'), ('scss', 'css'), ('sass', 'css'), ('less', 'css'),
    ('dockerfile', 'dockerfile'), ('dockerignore', 'dockerfile'), ('tf', 'terraform'), ('tfvars', 'terraform'), ('proto', 'protobuf'), ('graphql', 'graphql'), ('gql', 'graphql'),
    ('env', 'env'), ('envrc', 'env'), ('makefile', 'makefile'), ('mk', 'makefile'))"""
_CODE = """'rust', 'typescript', 'javascript', 'python', 'go', 'java', 'kotlin', 'swift', 'c', 'cpp', 'csharp', 'ruby', 'php', 'lua', 'sql', 'powershell', 'terraform', 'protobuf', 'graphql', 'dockerfile', 'css', 'makefile'"""


def inventory(raw: str) -> str:
    """CTEs raw(path, content) -> files(path, language, size_lines, file_category)."""
    return f"""{_LANGUAGES}, raw AS ({raw}), named AS (
    SELECT path, split_part(path, '/', -1) AS name, regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1) AS ext,
        CASE WHEN content IS NULL OR content = '' THEN 0
             ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END AS size_lines
    FROM raw
), kept AS (
    SELECT n.*, coalesce(language, 'unknown') AS language, lower(name) AS low FROM named n LEFT JOIN lang_of USING (ext)
    WHERE NOT (starts_with(name, '.') OR contains('/' || path, '/.git/') OR contains('/' || path, '/target/') OR contains('/' || path, '/node_modules/'))
), files AS (
    SELECT path, language, size_lines::BIGINT AS size_lines, CASE
        WHEN low IN ('dockerfile', 'docker-compose.yml', 'docker-compose.yaml') OR contains(path, '.github/workflows') OR contains(path, 'Jenkinsfile') THEN 'infra'
        WHEN language IN ('json', 'yaml', 'toml', 'xml', 'env') OR low IN ('makefile', '.env', '.envrc') OR starts_with(low, '.env.') OR low LIKE '%rc' OR low LIKE '%.conf' THEN 'config'
        WHEN language = 'markdown' OR low IN ('readme.md', 'changelog.md', 'contributing.md', 'license', 'licence') THEN 'docs'
        WHEN contains(low, 'test') OR contains(low, 'spec') OR contains('/' || path, '/tests/') OR contains('/' || path, '/__tests__/') OR contains('/' || path, '/test/') THEN 'test'
        WHEN ext IN ('csv', 'tsv', 'jsonl') THEN 'data'
        WHEN language = 'shell' THEN 'script'
        WHEN language IN ({_CODE}) THEN 'code'
        ELSE 'unknown' END AS file_category
    FROM kept
)"""


DOCS = """SELECT CASE doc_id % 9 WHEN 0 THEN b || '/doc_' || doc_id || '.rs' WHEN 1 THEN b || '/doc_' || doc_id || '.py' WHEN 2 THEN b || '/doc_' || doc_id || '.md'
    WHEN 3 THEN b || '/doc_' || doc_id || '.toml' WHEN 4 THEN b || '/doc_' || doc_id || '.sh' WHEN 5 THEN b || '/doc_' || doc_id || '.csv'
    WHEN 6 THEN b || '/test_' || doc_id || '.rs' WHEN 7 THEN b || '/svc_' || doc_id || '/Dockerfile' ELSE b || '/doc_' || doc_id || '.xyz' END AS path, text AS content
    FROM (SELECT *, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS b FROM documents WHERE doc_id IS NOT NULL)"""
PAGES = "SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html AS content FROM pages"
PLACES = """SELECT translate(r_name, ' ', '_') || '/' || translate(n_name, ' ', '_') || '/' || c_name || '.json' AS path, c_mktsegment AS content
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
PARTS = """SELECT translate(p_brand, '# ', '__') || '/' || translate(p_type, ' ', '_') || '/p_' || p_partkey || '.rs' AS path, concat_ws(chr(10),
    'use crate::parts::p_' || p_partkey || ';', 'use crate::sizes::s_' || p_size || '::', '    Inner;', '',
    'pub struct Part' || p_partkey || ' { size: u32 }', 'enum Kind { A, B }', '', '', 'pub(crate) async fn load_' || p_partkey || '() {}',
    '    unsafe fn inner() {}', 'fn main() {}', 'pub unsafe trait Shape { fn area(&self); }', 'impl<T> Shape for Part' || p_partkey || ' {',
    '    fn area(&self) {}', '}', CASE WHEN p_partkey % 3 = 0 THEN 'const fn skipped() {}' || chr(10) ELSE '' END) AS content FROM part"""
_V = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_PATTERNS = (
    (1, "function", _V + r"(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"),
    (2, "struct", _V + r"struct\s+(\w+)"),
    (3, "trait", _V + r"(?:unsafe\s+)?trait\s+(\w+)"),
    (4, "enum", _V + r"enum\s+(\w+)"),
    (5, "implementation", _V + r"(?:unsafe\s+)?impl(?:\s*<[^>]*>\s*)?\s+(\S+)"),
    (6, "import", r"use\s+([^;]+);"),
)


def found() -> str:
    """CTE found(path, rank, kind, text, k, line): the matches of all patterns in raw."""
    cases = " UNION ALL ".join(
        f"SELECT path, {r} AS rank, '{kind}' AS kind, string_split(regexp_replace(content, '(?m)^\\s*{p}', chr(1) || '\\1' || chr(2) || '\\0', 'g'), chr(1)) AS parts FROM raw" for r, kind, p in _PATTERNS
    )
    return f"""marked AS ({cases}), chunks AS (SELECT path, rank, kind, parts[k] AS part, k FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM marked)),
    counted AS (SELECT *, CASE WHEN k = 1 THEN part ELSE split_part(part, chr(2), 2) END AS rest FROM chunks),
    lined AS (SELECT *, 1 + sum(length(rest) - length(replace(rest, chr(10), ''))) OVER (PARTITION BY path, rank ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM counted),
    found AS (SELECT path, rank, kind, split_part(part, chr(2), 1) AS text, k, line FROM lined WHERE k > 1)"""


DEFINITIONS = """definitions AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY rank, k) - 1 AS position, CASE WHEN rank = 5 THEN 'impl ' || text ELSE text END AS name, kind, line
    FROM found WHERE rank < 6 AND NOT (rank = 1 AND text = 'main'))"""
IMPORTS = """imports AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS position, split_part(source, '::', -1) AS name, source, line
    FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS source FROM found WHERE rank = 6))"""
NODE_TYPE = "CASE file_category WHEN 'config' THEN 'config' WHEN 'docs' THEN 'document' WHEN 'infra' THEN 'resource' WHEN 'data' THEN 'schema' ELSE 'file' END"
COMPLEXITY = "CASE WHEN size_lines <= 200 THEN 'simple' WHEN size_lines <= 1000 THEN 'moderate' ELSE 'complex' END"
LEVEL = "CASE WHEN n < 50 AND l < 10000 THEN 'simple' WHEN n < 200 AND l < 100000 THEN 'moderate' ELSE 'complex' END"


def _id(path: str) -> str:
    return f"substr(sha256({path}), 1, 16)"


FILE_NODES = f"""file_nodes AS (SELECT {_id("path")} AS id, {NODE_TYPE} AS type, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS name, path AS file_path,
    language || ' (' || size_lines || ' lines)' AS summary, language AS tags, {COMPLEXITY} AS complexity, '1' || path AS ord FROM files)"""
PREFIXES = """prefixes AS (SELECT path, array_to_string(p[1:k], '/') AS parent, array_to_string(p[1:k + 1], '/') AS child FROM (
    SELECT path, p, unnest(range(1, len(p))) AS k FROM (SELECT path, string_split(path, '/') AS p FROM files)))"""
FOLDERS = f"""folder_nodes AS (SELECT DISTINCT {_id("parent")} AS id, 'module' AS type, split_part(parent, '/', -1) AS name, NULL::VARCHAR AS file_path,
    'Directory: ' || parent AS summary, 'directory' AS tags, 'simple' AS complexity, '2' || parent AS ord FROM prefixes)"""
CONTAINS = f"""contains_edges AS (SELECT DISTINCT {_id("parent")} AS source, {_id("child")} AS target, 'contains' AS type, 'forward' AS direction,
    parent || ' contains ' || child AS description, CAST(0.3 AS FLOAT) AS weight, '1' || parent || chr(0) || child AS ord FROM prefixes)"""
NODES = f"{FILE_NODES}, {PREFIXES}, {FOLDERS}, {CONTAINS}, nodes AS (SELECT * FROM file_nodes UNION ALL SELECT * FROM folder_nodes)"
ORDER_IMPORTS = f"""links AS (SELECT 'orders/o_' || l_orderkey || '.rs' AS a, 'parts/p_' || l_partkey || '.rs' AS b, 'crate::parts::p_' || l_partkey AS source, l_linenumber,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)),
    firsts AS (SELECT a, b, min(position) AS position, any_value(source) AS source FROM links GROUP BY a, b),
    import_edges AS (SELECT {_id("a")} AS source, {_id("b")} AS target, 'imports' AS type, 'forward' AS direction, a || ' imports ' || source AS description,
        CAST(0.5 AS FLOAT) AS weight, '2' || a || chr(0) || lpad(position::VARCHAR, 9, '0') AS ord, a, b FROM firsts)"""
LAYER = """CASE WHEN type IN ('file', 'function', 'class', 'module') THEN 'code' WHEN type = 'config' THEN 'config' WHEN type = 'document' THEN 'docs'
    WHEN type IN ('resource', 'service', 'pipeline') THEN 'infra' WHEN type IN ('schema', 'table') THEN 'data' WHEN type = 'endpoint' THEN 'api' ELSE 'other' END"""
LAYER_NAME = "CASE id WHEN 'code' THEN 'Core Code' WHEN 'config' THEN 'Configuration' WHEN 'docs' THEN 'Documentation' WHEN 'infra' THEN 'Infrastructure' WHEN 'data' THEN 'Data & Schema' WHEN 'api' THEN 'API Layer' ELSE 'Other' END"
_SNAP = """old AS (SELECT 'doc_' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0),
    new AS (SELECT 'doc_' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)"""
_ANSWERS = """answers AS (SELECT event_id AS batch, CASE k % 6 WHEN 0 THEN body WHEN 1 THEN '[' || body || ']'
        WHEN 2 THEN 'Here it is:' || nl || '```json' || nl || body || nl || '```' || nl || 'Done.' WHEN 3 THEN '```' || nl || body || nl || '```'
        WHEN 4 THEN 'The result: ' || body ELSE '  ' || nl || body || nl || ' ' END AS response
    FROM (SELECT event_id, k, nl, '{"nodes": [{"type": "' || ['fn', 'File', 'mod', 'DOC', 'route', 'nonsense', 'db'][k % 7 + 1] || '"'
            || CASE WHEN k % 3 > 0 THEN ', "id": "n' || k || '"' ELSE '' END
            || CASE WHEN k % 4 > 0 THEN ', "name": "' || event_type || '"' ELSE ', "name": 7' END
            || CASE WHEN k % 5 > 0 THEN ', "line_range": [' || (k % 50) || ', 99]' ELSE ', "line_range": [1]' END
            || ', "tags": ["a", 5, "' || event_type || '"], "complexity": "' || ['Complex', 'moderate', 'odd'][k % 3 + 1] || '"}], "edges": [{"source": "n' || k || '", "target": "n' || user_id
            || '", "type": "' || ['invokes', 'EXTENDS', 'reads', 'depends', 'unknown'][k % 5 + 1] || '", "direction": "' || ['reverse', 'both', 'forward', 'sideways'][k % 4 + 1] || '"'
            || CASE WHEN k % 2 = 0 THEN ', "weight": 0.25' ELSE '' END || '}, {"source": "orphan"}]}' AS body
        FROM (SELECT *, event_id AS k, chr(10) AS nl FROM events)))"""
_EXTRACT = """extracted AS (SELECT batch, CASE WHEN regexp_matches(w, '^[{\\[]') THEN w WHEN regexp_matches(t, '^[{\\[]') THEN t WHEN regexp_matches(f, '^[{\\[]') THEN f
        WHEN r <> '' THEN r ELSE w END AS json FROM (
    SELECT batch, w, regexp_replace(regexp_extract(w, '(?s)^.*?```json(.*?)```', 1), '^\\s+|\\s+$', '', 'g') AS t,
        regexp_replace(regexp_extract(w, '(?s)^.*?```(.*?)```', 1), '^\\s+|\\s+$', '', 'g') AS f, regexp_extract(w, '(?s)^[^{\\[]*([{\\[].*)$', 1) AS r
    FROM (SELECT batch, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS w FROM answers)))"""
_ITEMS = """items AS (SELECT batch, 0 AS item, CASE WHEN json_type(json) = 'ARRAY' THEN json_extract(json, '$[0]') ELSE json::JSON END AS v FROM extracted)"""


def _cases(column: str, table: dict[str, str], rest: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {rest} END"


# The spellings that the queries use, and what they stand for.
_NODE_SPELLINGS = {"fn": "function", "func": "function", "file": "file", "mod": "module", "doc": "document", "route": "endpoint", "view": "table", "db": "table", "terraform": "resource"}
_EDGE_SPELLINGS = {"calls": "calls", "invokes": "calls", "extends": "inherits", "reads": "reads_from", "depends": "depends_on", "buildson": "builds_on"}
_TYPES = """['file', 'function', 'class', 'module', 'concept', 'config', 'document', 'service', 'table', 'endpoint', 'pipeline', 'schema', 'resource', 'domain', 'flow', 'step', 'article', 'entity', 'topic', 'claim', 'source', 'other']"""
_COLOURS = {
    "file": "#58a6ff", "function": "#79c0ff", "class": "#1f6feb", "module": "#a5d6ff", "config": "#d29922", "document": "#3fb950", "service": "#f0883e", "table": "#bc8cff",
    "endpoint": "#f778ba", "pipeline": "#e5534b", "schema": "#a371f7", "resource": "#db6d28", "concept": "#56d364", "domain": "#ff7b72", "flow": "#ffa198", "step": "#ffc2bb",
    "article": "#7ee787", "entity": "#68e0b8", "topic": "#aff5b4", "claim": "#d2a8ff", "source": "#e3b341",
}
_COLOUR = _cases("type", _COLOURS, "'#8b949e'")
_RADIUS = "CASE complexity WHEN 'complex' THEN 10 WHEN 'moderate' THEN 8 ELSE 6 END::INT"
_FALLBACK = """(VALUES ('code', 'Core Code', 'Source code and modules', ['file', 'function', 'class', 'module']), ('concepts', 'Concepts', 'Domain concepts and abstractions', ['concept']),
    ('config', 'Configuration', 'Configuration files', ['config']), ('docs', 'Documentation', 'Documentation', ['document']), ('infra', 'Infrastructure', 'Infrastructure and deployment', ['service', 'pipeline', 'resource']),
    ('data', 'Data & Schema', 'Data models and schemas', ['table', 'schema']), ('api', 'API Layer', 'API endpoints', ['endpoint']), ('domain', 'Domain Logic', 'Domain models and flows', ['domain', 'flow', 'step']),
    ('knowledge', 'Knowledge', 'Knowledge artifacts', ['article', 'entity', 'topic', 'claim', 'source'])) AS f(id, name, description, types)"""
_TOUR = """kinds(r, type, label) AS (VALUES (0, 'file', 'Source Code'), (1, 'config', 'Configuration'), (2, 'document', 'Documentation'), (3, 'resource', 'Infrastructure'), (4, 'schema', 'Data & Schemas')),
    by_type AS (SELECT type, count(*) AS n FROM file_nodes GROUP BY type), steps AS (SELECT row_number() OVER (ORDER BY r) + 2 AS o, type, label, n FROM kinds JOIN by_type USING (type)),
    counts AS (SELECT (SELECT count(*) FROM file_nodes) AS files, (SELECT count(*) FROM folder_nodes) AS folders, (SELECT max(o) + 1 FROM steps) AS last),
    stops AS (SELECT 1 AS o, row_number() OVER (ORDER BY ord) - 1 AS k, id, file_path FROM file_nodes QUALIFY k < 5 UNION ALL SELECT 2, row_number() OVER (ORDER BY ord) - 1, id, NULL FROM folder_nodes
        UNION ALL SELECT o, row_number() OVER (PARTITION BY type ORDER BY ord) - 1 AS k, id, file_path FROM file_nodes JOIN steps USING (type) QUALIFY k < 10),
    titles AS (SELECT 1 AS o, 'Project Overview' AS title UNION ALL SELECT 2, 'Directory Structure' UNION ALL SELECT o, label || ' Files' FROM steps UNION ALL SELECT last, 'Explore Connections' FROM counts)"""


_NEW_SOURCES = f"""new_lines AS (SELECT *, 'orders/b_' || (l_orderkey % 50) || '/o_' || l_orderkey || '.rs' AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position
        FROM lineitem WHERE l_orderkey % 11 <> 0 AND NOT (l_orderkey % 7 = 0 AND l_linenumber % 2 = 0)),
    seconds AS (SELECT p_partkey AS p, 'alt/f_' || (p_partkey % 40) || '/p_' || p_partkey || '.rs' AS path FROM part WHERE p_partkey % 10 = 0),
    firsts_ AS (SELECT p_partkey AS p, 'parts/p_' || p_partkey || '.rs' AS path FROM part WHERE p_partkey % 9 <> 0),
    files AS (SELECT path, 'rust' AS language, 'file' AS type, count(*) AS n, 0 AS d, count(*) AS i FROM new_lines GROUP BY path
        UNION ALL SELECT path, 'rust', 'file', 1, 1, 0 FROM firsts_ UNION ALL SELECT path, 'rust', 'file', 1, 1, 0 FROM seconds
        UNION ALL SELECT 'notes/p_' || p_partkey || '.md', 'markdown', 'document', 1, 0, 0 FROM part WHERE p_partkey % 8 = 0
        UNION ALL SELECT 'conf/p_' || p_partkey || '.toml', 'toml', 'config', 1, 0, 0 FROM part WHERE p_partkey % 12 = 0),
    {PREFIXES}, {FOLDERS}, {CONTAINS},
    new_nodes AS (SELECT {_id("path")} AS id, type, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS name, path AS file_path,
        language || CASE WHEN d + i > 0 THEN ' (' || n || ' lines, ' || d || ' definitions, ' || i || ' imports)' ELSE ' (' || n || ' lines)' END AS summary, language AS tags, 'simple' AS complexity FROM files
        UNION ALL SELECT id, type, name, file_path, summary, tags, complexity FROM folder_nodes),
    targets AS (SELECT p, min(path) AS target FROM (SELECT * FROM firsts_ UNION ALL SELECT * FROM seconds) GROUP BY p),
    new_imports AS (SELECT path, target, min(position) AS position, any_value(p) AS p FROM new_lines JOIN targets ON p = l_partkey GROUP BY path, target)"""
_PROGRAMS = f"""prog AS (SELECT p_partkey AS k, 'prog/p_' || p_partkey || '.rs' AS path, p_partkey % 5 AS o FROM part),
    defs AS (SELECT k, path, 'class' AS type, 'Part' || k AS name, 'struct' AS kind, 3 + o AS a, 3 + o AS b FROM prog UNION ALL SELECT k, path, 'function', 'helper_' || k, 'fn', 4 + o, 8 + o FROM prog
        UNION ALL SELECT k, path, 'function', 'shared_' || k, 'fn', 9 + o, 12 + o FROM prog UNION ALL SELECT k, path, 'function', 'inner', 'fn', 10 + o, 10 + o FROM prog),
    ids AS (SELECT *, {_id("path || '#' || type || ' ' || name || '#1'")} AS id FROM defs)"""
_IGNORED = """placed AS (SELECT doc_id AS k, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l FROM documents WHERE doc_id IS NOT NULL),
    decided AS (SELECT *, CASE WHEN k % 9 = 7 AND k % 10 = 7 THEN TRUE WHEN k % 9 = 5 AND k BETWEEN 10 AND 99 THEN FALSE WHEN l = 'en' AND k % 9 = 2 AND k % 10 = 9 THEN FALSE WHEN l = 'en' THEN TRUE END AS below,
        CASE WHEN l = 'fr' AND k % 9 = 1 AND k % 10 = 1 THEN TRUE WHEN k % 9 = 6 AND k < 10 THEN TRUE WHEN k % 9 = 5 THEN NOT starts_with(k::VARCHAR, '7') END AS above FROM placed),
    marks AS (SELECT k, (s = 'src1' AND l = 'de') OR (k % 9 = 7 AND (k % 10 IN (0, 5) OR l = 'en')) OR coalesce(below, above, FALSE) AS ignored FROM decided)"""
_NAMES = """named AS (SELECT 'part-' || p_partkey AS id, lower(p_name || ' ' || p_partkey) AS name FROM part UNION ALL SELECT 'nation-' || n_nationkey, lower(n_name) FROM nation UNION ALL SELECT 'region-' || r_regionkey, lower(substr(r_name, 1, 4)) FROM region),
    wrong AS (SELECT p_partkey * 10 AS q, p_name || ' ' || p_partkey AS t FROM part WHERE p_partkey % 100 = 0),
    asked AS (SELECT q AS query_id, t AS text FROM wrong UNION ALL SELECT q + 1, substr(t, 1, 2) || substr(t, 4) FROM wrong UNION ALL SELECT q + 2, 'x' || substr(t, 1, 4) || 'yz' || substr(t, 6) FROM wrong
        UNION ALL SELECT q + 3, substr(t, 1, 3) FROM wrong UNION ALL SELECT -1 - n_nationkey, substr(n_name, 2) || 'a' FROM nation)"""


_ARTICLES = """written AS (SELECT doc_id AS k, lpad(doc_id::VARCHAR, 12, '0') AS id, coalesce(source, 'none') AS folder, lower(CASE WHEN doc_id % 40 = 0 THEN 'shared ' || (doc_id % 7) ELSE 'document ' || doc_id END) AS own,
        coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
    said AS (SELECT id, folder, 0 AS p, 'document_' || (k + 1) AS title FROM written UNION ALL SELECT id, folder, 1, 'Shared  ' || (k % 9) FROM written UNION ALL SELECT id, folder, 2, 'Document ' || k FROM written
        UNION ALL SELECT id, folder, 3, 'nowhere ' || k FROM written UNION ALL SELECT id, folder, 4, 'Document 1' FROM written WHERE k % 3 = 0 UNION ALL SELECT id, folder, 5, 'DOCUMENT 1' FROM written WHERE k % 3 = 0),
    wiki AS (SELECT s.id AS source, p AS position, title, CASE WHEN n > 1 AND near_n = 1 THEN near ELSE first END AS target,
            CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' WHEN near_n = 1 THEN 'folder' ELSE 'first' END AS rule
        FROM (SELECT *, lower(regexp_replace(title, '[_ ]+', ' ', 'g')) AS t FROM said) s LEFT JOIN (SELECT own, min(id) AS first, count(*) AS n FROM written GROUP BY own) a ON a.own = t
            LEFT JOIN (SELECT own, folder, min(id) AS near, count(*) AS near_n FROM written GROUP BY own, folder) f ON f.own = t AND f.folder = s.folder),
    back AS (SELECT target AS id, source, count(*) AS links FROM wiki WHERE target IS NOT NULL AND target <> source GROUP BY ALL)"""
_MANIFESTS = """kinds AS (SELECT p_partkey AS k, (p_partkey // 30) % 4 AS kind FROM part),
    used AS (SELECT k, kind, 'react' AS framework FROM kinds WHERE kind = 0 AND k % 3 = 0 UNION ALL SELECT k, kind, 'next' FROM kinds WHERE kind = 0 AND k % 6 = 0 UNION ALL SELECT k, kind, 'express' FROM kinds WHERE kind = 0 AND k % 5 = 0
        UNION ALL SELECT k, kind, 'django' FROM kinds WHERE kind = 1 AND k % 3 = 0 UNION ALL SELECT k, kind, 'fastapi' FROM kinds WHERE kind = 1 AND k % 5 = 0 UNION ALL SELECT k, kind, 'pyspark' FROM kinds WHERE kind = 1 AND k % 7 = 0
        UNION ALL SELECT k, kind, 'tokio' FROM kinds WHERE kind = 2 AND k % 2 = 0 UNION ALL SELECT k, kind, 'axum' FROM kinds WHERE kind = 2 AND k % 6 = 0 UNION ALL SELECT k, kind, 'actix' FROM kinds WHERE kind = 2 AND k % 5 = 0
        UNION ALL SELECT k, kind, 'gin' FROM kinds WHERE kind = 3 AND k % 3 = 0)"""


_LAYER_ANSWERS = """told AS (SELECT p_partkey AS batch, 0 AS position, 'l' || (p_partkey % 7) AS id, 'Layer ' || p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'x' END AS description,
        CASE p_partkey % 5 WHEN 0 THEN 'a' || p_partkey || ',b' ELSE '' END AS node_ids FROM part WHERE p_partkey % 5 < 2
    UNION ALL SELECT p_partkey, 1, 'm' || p_partkey, 'More', 'd', '' FROM part WHERE p_partkey % 5 = 0)"""
_TOUR_ANSWERS = """steps AS (SELECT p_partkey AS batch, 0 AS position, 2 AS o, 'Second ' || p_partkey AS title, '' AS description, 'x' || p_partkey AS node_ids, NULL AS language_lesson FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 1, 0, 'Untitled Step', 'first', '', NULL FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 0, (p_partkey % 7)::INT, 'T', '', 'a,b', 'l' || p_partkey FROM part WHERE p_partkey % 3 = 1)"""


def sql() -> dict[str, str]:
    docs, pages, places, parts = (f"WITH {inventory(x)}" for x in (DOCS, PAGES, PLACES, PARTS))
    doc_nodes, place_nodes = f"{docs}, {NODES}", f"{places}, {NODES}"
    code = f"WITH raw AS ({PARTS}), {found()}, {DEFINITIONS}, {IMPORTS}"
    stats = "SELECT count(*) AS n, coalesce(sum(size_lines), 0)::BIGINT AS l, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM files"
    node_columns = "id, type, name, file_path, summary, tags, complexity"
    mixed = f"{doc_nodes}, {ORDER_IMPORTS}, known AS (SELECT id, file_path, name FROM nodes UNION ALL SELECT {_id("'parts/p_' || p_partkey || '.rs'")}, 'parts/p_' || p_partkey || '.rs', 'p_' || p_partkey FROM part), edges AS (SELECT source, target, type, ord FROM contains_edges UNION ALL SELECT source, target, type, ord FROM import_edges)"
    llm = f"WITH {_ANSWERS}, {_EXTRACT}, {_ITEMS}"
    made = {
        "scan_inventory": f"{docs} SELECT * FROM files",
        "scan_pages": f"{pages} SELECT * FROM files",
        "language_counts": f"{docs} SELECT language, count(*) AS files FROM files GROUP BY language",
        "category_counts": f"{docs} SELECT file_category, count(*) AS files FROM files GROUP BY file_category",
        "project_stats": f"{docs} SELECT n AS total_files, l AS total_lines, languages, 0::BIGINT AS filtered_by_ignore, {LEVEL} AS estimated_complexity FROM ({stats})",
        "exclusion_filter": """SELECT path, starts_with(split_part(path, '/', -1), '.') OR contains('/' || path, '/.git/') OR contains('/' || path, '/target/') OR contains('/' || path, '/node_modules/') AS excluded FROM (
            SELECT ['.git/', 'a/.git/', 'target/', 'b/node_modules/', '.github/', 'src/.', 'targets/', 'src/'][doc_id % 8 + 1] || 'f' || doc_id AS path FROM documents)""",
        "node_ids": f"WITH raw AS ({PAGES}) SELECT path, {_id('path')} AS id, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS name FROM raw",
        "file_nodes": f"{doc_nodes} SELECT {node_columns} FROM file_nodes",
        "directory_nodes": f"{place_nodes} SELECT {node_columns} FROM folder_nodes",
        "directory_nodes_pages": f"{pages}, {NODES} SELECT {node_columns} FROM folder_nodes",
        "contains_edges": f"{doc_nodes} SELECT source, target, type, direction, description, weight FROM contains_edges",
        "category_node_types": f"{docs} SELECT file_category, {NODE_TYPE} AS type, count(*) AS files FROM files GROUP BY ALL",
        "parse_definitions": f"{code} SELECT path, position::INT AS position, name, kind, line::INT AS line FROM definitions",
        "parse_imports": f"{code} SELECT path, position::INT AS position, name, source, line::INT AS line FROM imports",
        "file_summary_join": f"{parts}, {found()}, {DEFINITIONS}, {IMPORTS}, d AS (SELECT path, count(*) AS d FROM definitions GROUP BY path), i AS (SELECT path, count(*) AS i FROM imports GROUP BY path) SELECT path AS file_path, CASE WHEN d > 0 OR i > 0 THEN language || ' (' || size_lines || ' lines, ' || d || ' definitions, ' || i || ' imports)' ELSE language || ' (' || size_lines || ' lines)' END AS summary FROM files LEFT JOIN d USING (path) LEFT JOIN i USING (path)",
        "import_edges": f"WITH {ORDER_IMPORTS} SELECT source, target, type, direction, description, weight FROM import_edges",
        "edge_union": f"{doc_nodes}, {ORDER_IMPORTS} SELECT type, count(*) AS edges, count(DISTINCT source) AS sources FROM (SELECT source, type FROM contains_edges UNION ALL SELECT source, type FROM import_edges) GROUP BY type",
        "layer_membership": f"{doc_nodes} SELECT {LAYER} AS layer, id FROM nodes",
        "layer_summary": f"{doc_nodes} SELECT id, {LAYER_NAME} AS name, nodes FROM (SELECT {LAYER} AS id, count(*) AS nodes FROM nodes GROUP BY 1)",
        "layers": f"{doc_nodes} SELECT {LAYER} AS layer, (row_number() OVER (PARTITION BY {LAYER} ORDER BY ord) - 1)::INT AS position, id FROM nodes",
        "layer_listing": f"{doc_nodes} SELECT {LAYER} AS layer, count(*) OVER (PARTITION BY {LAYER}) AS members, (row_number() OVER (PARTITION BY {LAYER} ORDER BY ord) - 1)::INT AS position, coalesce(file_path, name) AS label FROM nodes",
        "tour_listing": f"""{doc_nodes}, {_TOUR} SELECT t.o::INT AS "order", title, coalesce(k, 0)::INT AS position, coalesce(file_path, id) AS label FROM titles t LEFT JOIN stops s ON s.o = t.o""",
        "tour_steps": f"""{doc_nodes}, {_TOUR}, sizes AS (SELECT o, count(*) AS stops FROM stops GROUP BY o), told AS (
            SELECT 1 AS o, 'This project contains ' || files || ' files organized across ' || folders || ' directories. Start here to understand the high-level structure.' AS description,
                'A knowledge graph represents code as interconnected nodes — files, functions, classes — with edges showing how they relate.' AS language_lesson FROM counts
            UNION ALL SELECT 2, 'The project has ' || folders || ' top-level directories. Each contains related files grouped by purpose.', 'Contains edges (parent→child) show the file tree hierarchy in graph form.' FROM counts
            UNION ALL SELECT o, n || ' ' || lower(label) || ' files found. These define the project''s ' || lower(label) || '.', NULL FROM steps
            UNION ALL SELECT last, 'Use the graph to trace imports, dependencies, and directory structure. Each edge type reveals a different relationship.',
                'Imports edges show module dependencies. Contains edges show directory hierarchy. Together they reveal the project''s architecture.' FROM counts)
            SELECT o::INT AS "order", title, description, language_lesson, coalesce(stops, 0) AS stops FROM told JOIN titles USING (o) LEFT JOIN sizes USING (o)""",
        "display_types": f"SELECT id, type, {_COLOUR} AS colour, {_RADIUS} AS radius, right(coalesce(path, name), 15) AS label FROM (SELECT 'n' || p_partkey AS id, {_TYPES}[p_partkey % 22 + 1] AS type, ['simple', 'moderate', 'complex'][p_partkey % 3 + 1] AS complexity, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN 'parts/' || translate(p_brand, '#', '_') || '/p_' || p_partkey END AS path FROM part)",
        "tree_depths": """WITH RECURSIVE e AS (SELECT 'p' || p_partkey AS s, 'p' || (p_partkey + 1) AS t FROM part WHERE p_partkey % 10 < 9 UNION ALL SELECT 'p' || p_partkey, 'p' || (-p_partkey) FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0
                UNION ALL SELECT 'p' || (-p_partkey - 1000000000), 'p' || (-p_partkey - 1000000000 + CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE -1 END) FROM part),
            down AS (SELECT DISTINCT s AS id, 0 AS depth FROM e WHERE s NOT IN (SELECT t FROM e) UNION SELECT t, depth + 1 FROM down JOIN e ON s = id WHERE depth < 50)
            SELECT d.id, d.depth, coalesce(p_name, d.id) AS label FROM (SELECT id, min(depth) AS depth FROM down GROUP BY id) d LEFT JOIN part ON 'p' || p_partkey = d.id""",
        "graph_complexity": f"{doc_nodes} SELECT CASE WHEN c > s + m THEN 'complex' WHEN m > s THEN 'moderate' ELSE 'simple' END AS complexity FROM (SELECT count(*) FILTER (complexity = 'complex') AS c, count(*) FILTER (complexity = 'moderate') AS m, count(*) FILTER (complexity = 'simple') AS s FROM nodes)",
        "overview": f"""{place_nodes} SELECT 'places' AS name, 'json' AS languages, 'simple' AS complexity, NULL::VARCHAR AS "commit", (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM contains_edges) AS edges,
            (SELECT count(DISTINCT {LAYER}) FROM nodes) AS layers, 'places project with ' || n || ' files across 1 languages. Complexity: ' || upper({LEVEL}[1]) || {LEVEL}[2:] || '.' AS description FROM ({stats})""",
        "file_inventory": f"{doc_nodes} SELECT file_path AS path, tags AS language, regexp_extract(summary, '^[^(]*\\((.*?) lines', 1) AS lines, type FROM file_nodes",
        "import_list": f"{mixed} SELECT coalesce(s.file_path, s.name, e.source) AS source, coalesce(t.file_path, t.name, e.target) AS target FROM edges e LEFT JOIN known s ON s.id = e.source LEFT JOIN known t ON t.id = e.target WHERE type = 'imports'",
        "tree_roots": f"{doc_nodes} SELECT DISTINCT source AS id FROM contains_edges WHERE source NOT IN (SELECT target FROM contains_edges)",
        "tree_preorder": f"{docs}, {PREFIXES} SELECT len(string_split(path, '/'))::INT - 1 AS depth, path, translate(path, '/', chr(1)) AS sort_key FROM (SELECT parent AS path FROM prefixes UNION SELECT child FROM prefixes)",
        "neighbours": f"""{mixed}, asked AS (SELECT id FROM known),
            both_ways AS (SELECT source AS id, target AS other, 'out' AS way, type, ord FROM edges WHERE source <> target UNION ALL SELECT target, source, 'in', type, ord FROM edges WHERE source <> target),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, way, other) AS rank, count(*) OVER (PARTITION BY id) AS total FROM both_ways WHERE id IN (SELECT id FROM asked))
            SELECT r.id, rank::INT AS rank, total, other, way, type, coalesce(file_path, name, other) AS label FROM ranked r LEFT JOIN known k ON k.id = other WHERE rank <= 10""",
        "search_nodes": f"{doc_nodes} SELECT id, lower(coalesce(file_path, name)) AS label FROM nodes WHERE contains(lower(concat_ws(' ', coalesce(file_path, name, id), CASE WHEN file_path IS NOT NULL THEN name END, tags)), 'c0')",
        "valid_links": f"{mixed} SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM known) AND target IN (SELECT id FROM known)",
        "dangling_edges": f"{mixed} SELECT source, target, type, CASE WHEN NOT s AND NOT t THEN 'both' WHEN NOT s THEN 'source' ELSE 'target' END AS missing FROM (SELECT *, source IN (SELECT id FROM known) AS s, target IN (SELECT id FROM known) AS t FROM edges) WHERE NOT s OR NOT t",
        "degrees": f"WITH {ORDER_IMPORTS} SELECT id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT source AS id, 1 AS o, 0 AS i FROM import_edges UNION ALL SELECT target, 0, 1 FROM import_edges) GROUP BY id",
        "layer_coverage": f"{doc_nodes} SELECT id, n AS layers FROM (SELECT id, CASE WHEN type = 'file' THEN 0 WHEN type = 'config' THEN 2 ELSE 1 END::BIGINT AS n FROM nodes) WHERE n <> 1",
        "visible_nodes": f"{doc_nodes} SELECT id, type FROM nodes WHERE {LAYER} NOT IN ('docs', 'infra')",
        "tour_highlight": f"{doc_nodes}, {_TOUR} SELECT id, id IN (SELECT id FROM stops WHERE o = 3) AS in_step FROM nodes",
        "display_attributes": f"{doc_nodes} SELECT id, {_COLOUR} AS colour, CASE complexity WHEN 'complex' THEN 10 WHEN 'moderate' THEN 8 ELSE 6 END::INT AS radius, right(coalesce(file_path, name), 15) AS label FROM nodes",
        "fingerprints": f"WITH raw AS ({DOCS}) SELECT path, sha256(content) AS hash FROM raw",
        "changed_files": f"WITH {_SNAP} SELECT path FROM new LEFT JOIN old USING (path) WHERE old.hash IS NULL OR old.hash <> new.hash",
        "snapshot_status": f"WITH {_SNAP} SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.hash IS NULL THEN 'added' WHEN new.hash IS NULL THEN 'deleted' WHEN old.hash <> new.hash THEN 'modified' ELSE 'unchanged' END AS status FROM old FULL JOIN new ON old.path = new.path",
        "batches": f"{docs} SELECT (row_number() OVER (ORDER BY path) - 1) // 5 AS batch, path FROM files WHERE size_lines <= 2000",
        "project_context": f"{docs} SELECT 'The project has ' || n || ' files and ' || l || ' lines in ' || replace(languages, ',', ', ') || '; its complexity is ' || {LEVEL} || '.' AS context FROM ({stats})",
        "alias_nodes": f"SELECT event_id, {_cases('lower(s)', _NODE_SPELLINGS, 'NULL')} AS type FROM (SELECT event_id, ['fn', 'FUNC', 'mod', 'doc', 'route', 'view', 'click', 'Terraform'][event_id % 8 + 1] AS s FROM events)",
        "alias_edges": f"SELECT event_id, {_cases('lower(s)', _EDGE_SPELLINGS, chr(39) + 'related' + chr(39))} AS type FROM (SELECT event_id, ['calls', 'Invokes', 'extends', 'reads', 'depends', 'BuildsOn', 'x'][event_id % 7 + 1] AS s FROM events)",
        "extract_json": f"WITH {_ANSWERS}, {_EXTRACT} SELECT batch, json FROM extracted",
        "llm_nodes": f"""{llm}, n AS (SELECT batch, json_extract(v, '$.nodes[0]') AS x, row_number() OVER (ORDER BY batch) AS k FROM items)
            SELECT coalesce(x->>'$.id', 'node-' || k) AS id, coalesce({_cases("lower(x->>'$.type')", _NODE_SPELLINGS, 'NULL')}, 'file') AS type,
            CASE WHEN json_type(x, '$.name') = 'VARCHAR' THEN x->>'$.name' ELSE 'unknown' END AS name,
            CASE WHEN json_array_length(x, '$.line_range') >= 2 THEN (x->>'$.line_range[0]') || '-' || (x->>'$.line_range[1]') END AS lines,
            'a,' || (x->>'$.tags[2]') AS tags, CASE WHEN lower(x->>'$.complexity') IN ('complex', 'moderate') THEN lower(x->>'$.complexity') ELSE 'simple' END AS complexity FROM n""",
        "llm_edges": f"""{llm}, e AS (SELECT json_extract(v, '$.edges[0]') AS x FROM items)
            SELECT x->>'$.source' AS source, x->>'$.target' AS target, {_cases("lower(x->>'$.type')", _EDGE_SPELLINGS, chr(39) + 'related' + chr(39))} AS type,
            CASE lower(x->>'$.direction') WHEN 'reverse' THEN 'backward' WHEN 'both' THEN 'bidirectional' ELSE 'forward' END AS direction, coalesce((x->>'$.weight')::FLOAT, 0.5::FLOAT) AS weight FROM e""",
        "ensure_files": f"{docs} SELECT 'file-' || (row_number() OVER (ORDER BY path) + (SELECT count(*) FROM files WHERE file_category = 'code')) AS id, path AS file_path, split_part(path, '/', -1) AS name, language || ' file (' || size_lines || ' lines, ' || path || ')' AS summary FROM files WHERE file_category <> 'code'",
        "script_definitions": """SELECT 'scripts/p_' || p_partkey || '.' || ext AS path, position, replace(name, '@', p_partkey::VARCHAR) AS name, kind, (line + p_partkey % 4)::INT AS line FROM part, (VALUES
            ('py', 0, 'load_@', 'function', 7), ('py', 1, 'area', 'function', 9), ('py', 2, 'Part@', 'class', 6),
            ('ts', 0, 'load_@', 'function', 10), ('ts', 1, 'twice_@', 'function', 12), ('ts', 2, 'Part@', 'class', 5), ('ts', 3, 'Shape', 'interface', 11), ('ts', 4, 'Kind', 'enum', 13)) v(ext, position, name, kind, line)""",
        "script_imports": """SELECT 'scripts/p_' || p_partkey || '.' || ext AS path, position, replace(replace(name, '@', p_partkey::VARCHAR), '+', (p_partkey + 1)::VARCHAR) AS name, replace(replace(source, '@', p_partkey::VARCHAR), '+', (p_partkey + 1)::VARCHAR) AS source, (line + p_partkey % 4)::INT AS line FROM part, (VALUES
            ('py', 0, 'os', 'os', 1), ('py', 1, 'p_+', 'pkg.p_+', 1), ('py', 2, 'sub', 'pkg.sub', 13), ('ts', 0, 'p_+', './sub/p_+.js', 1), ('ts', 1, 'lib_@', 'lib_@', 14)) v(ext, position, name, source, line)""",
        "script_endpoints": """SELECT 'scripts/p_' || p_partkey || '.ts' AS path, position, method, replace(route, '@', p_partkey::VARCHAR) AS route, (line + p_partkey % 4)::INT AS line FROM part, (VALUES (0, 'GET', '/parts/@', 15), (1, 'POST', '/parts', 16)) v(position, method, route, line)""",
        "compose_services": """SELECT 'stack/s_' || s_suppkey || '/docker-compose.yml' AS path, 0 AS position, 'web_' || s_suppkey AS name, 'img_' || s_suppkey || ':latest' AS image, '80:' || s_suppkey || ',9090' AS ports FROM supplier
            UNION ALL SELECT 'stack/s_' || s_suppkey || '/docker-compose.yml', 1, 'db', 'db_' || s_nationkey, '' FROM supplier""",
        "workflow_steps": """SELECT '.github/workflows/s_' || s_suppkey || '.yml' AS path, position, replace(name, '@', s_suppkey::VARCHAR) AS name, replace(replace(command, '@', s_suppkey::VARCHAR), '~', chr(10)) AS command, line FROM supplier, (VALUES
            (0, 'Build @', 'make p_@', 6), (1, 'Two', 'echo ''name: no''~# a remark: kept~  - name: no', 8), (2, NULL, NULL, 14), (3, NULL, 'end', 17)) v(position, name, command, line)""",
        "wiki_links": f"WITH {_ARTICLES} SELECT * FROM wiki",
        "wiki_backlinks": f"WITH {_ARTICLES} SELECT * FROM back",
        "wiki_counts": f"""WITH {_ARTICLES} SELECT id, coalesce(o, 0) AS outgoing, coalesce(m, 0) AS missing, coalesce(i, 0) AS incoming FROM written
            LEFT JOIN (SELECT source AS id, count(*) AS o, count(*) FILTER (target IS NULL) AS m FROM wiki GROUP BY source) USING (id) LEFT JOIN (SELECT id, count(*) AS i FROM back GROUP BY id) USING (id)""",
        "manifest_frameworks": f"WITH {_MANIFESTS} SELECT 'apps/p_' || k || '/' || ['package.json', 'requirements.txt', 'Cargo.toml', 'go.mod'][kind + 1] AS path, framework FROM used",
        "project_frameworks": f"WITH {_MANIFESTS} SELECT 'apps' AS name, (SELECT string_agg(DISTINCT ['json', 'unknown', 'toml', 'unknown'][kind + 1], ',' ORDER BY ['json', 'unknown', 'toml', 'unknown'][kind + 1]) FROM kinds) AS languages, (SELECT string_agg(DISTINCT framework, ',' ORDER BY framework) FROM used) AS frameworks, '2025-01-01T00:00:00Z' AS analyzed_at",
        "answer_layers": f"WITH {_LAYER_ANSWERS} SELECT batch, position, id, name, description, node_ids FROM told",
        "answer_tour": f"WITH {_TOUR_ANSWERS} SELECT batch, position, o AS \"order\", title, description, node_ids, language_lesson FROM steps",
        "merged_tour": f"WITH {_TOUR_ANSWERS} SELECT (row_number() OVER (ORDER BY batch, o, position))::INT AS \"order\", title, description, node_ids FROM steps",
        "layer_assignment": f"""WITH {_LAYER_ANSWERS}, named AS (SELECT node, arg_min(id, batch) AS layer FROM (SELECT batch, id, unnest(string_split(node_ids, ',')) AS node FROM told WHERE node_ids <> '') GROUP BY node),
            rest AS (SELECT 'a' || p_partkey AS node, {_TYPES}[p_partkey % 21 + 1] AS type FROM part) SELECT layer, node FROM named
            UNION ALL SELECT f.id, node FROM rest JOIN {_FALLBACK} ON list_contains(types, type) WHERE node NOT IN (SELECT node FROM named)""",
        "review_findings": """SELECT 'error' AS kind, 'bad ' || p_partkey AS message FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'improvement', 'better ' || (p_partkey % 7) FROM part WHERE p_partkey % 2 = 0
            UNION ALL SELECT 'improvement', 'more ' || p_partkey FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT 'improvement', 'less' FROM part WHERE p_partkey % 2 = 1""",
        "fallback_tour": f"""{parts}, listed AS (SELECT {_id("path")} AS id, (row_number() OVER (ORDER BY path) - 1)::INT AS position FROM files)
            SELECT 1 AS "order", 'Project Overview' AS title, 'This project contains ' || (SELECT count(*) FROM files) || ' files. Start here to understand the high-level structure.' AS description, position, id FROM listed WHERE position < 5
            UNION ALL SELECT 2, 'Key Files', 'Explore the main source files to understand the project structure.', position, id FROM listed""",
        "merged_nodes": f"WITH {_NEW_SOURCES} SELECT * FROM new_nodes",
        "merged_edges": f"""WITH {_NEW_SOURCES} SELECT source, target, type, direction, description, weight FROM contains_edges
            UNION ALL SELECT {_id("path")}, {_id("target")}, 'imports', 'forward', path || ' imports crate::parts::p_' || p, CAST(0.5 AS FLOAT) FROM new_imports""",
        "merged_layers": f"WITH {_NEW_SOURCES} SELECT id, {LAYER_NAME} AS name, members FROM (SELECT {LAYER} AS id, count(*) AS members FROM new_nodes GROUP BY 1)",
        "definition_nodes": f"WITH {_PROGRAMS} SELECT id, type, name, path AS file_path, a || '-' || b AS lines, kind || ' (' || (b - a + 1) || ' lines)' AS summary, 'rust' AS tags, 'simple' AS complexity FROM ids",
        "definition_edges": f"""WITH {_PROGRAMS}, links AS (
                SELECT CASE WHEN d.name = 'inner' THEN s.id ELSE {_id("d.path")} END AS source, d.id AS target, 'contains' AS type, d.path, d.a AS line, d.name FROM ids d JOIN ids s ON s.k = d.k AND s.name = 'shared_' || s.k
                UNION ALL SELECT h.id, t.id, 'calls', h.path, 7 + h.k % 5, t.name FROM ids h JOIN ids t ON t.k = h.k + 1 AND t.name = 'shared_' || t.k WHERE h.name = 'helper_' || h.k
                UNION ALL SELECT c.id, t.id, 'calls', c.path, c.k % 5 + CASE WHEN c.name = 'inner' THEN 10 ELSE 11 END, t.name FROM ids c JOIN ids t ON t.k = c.k AND t.type = 'function' AND t.name <> c.name AND t.name NOT LIKE 'shared%' WHERE c.name = 'inner' OR c.name LIKE 'shared%')
            SELECT source, target, type, 'forward' AS direction, path || ' line ' || line || ' ' || type || ' ' || name AS description, CAST(CASE type WHEN 'calls' THEN 0.8 ELSE 0.3 END AS FLOAT) AS weight FROM links""",
        "part_definition_nodes": f"""WITH raw AS (SELECT split_part(path, '/p_', -1) AS k, path FROM ({PARTS})), named AS (SELECT path, replace(k, '.rs', '') AS k FROM raw)
            SELECT type, replace(name, '@', k) AS name, path AS file_path, lines FROM named, (VALUES ('class', 'Part@', '5-5'), ('class', 'Kind', '6-6'), ('function', 'load_@', '9-9'), ('function', 'inner', '10-10'),
                ('function', 'main', '11-11'), ('class', 'Shape', '12-12'), ('function', 'area', '12-12'), ('function', 'area', '14-14'), ('function', 'skipped', '16-16')) AS v(type, name, lines) WHERE lines <> '16-16' OR k::BIGINT % 3 = 0""",
        "ignored_files": f"WITH {_IGNORED} SELECT path, ignored FROM marks JOIN (SELECT doc_id, x.path FROM ({DOCS.replace('SELECT CASE', 'SELECT doc_id, CASE', 1)}) x) ON doc_id = k",
        "ignoring_stats": f"{docs.replace('FROM raw\n)', 'FROM raw WHERE path IN (SELECT path FROM kept_paths)\n)').replace('WITH ', f'WITH {_IGNORED}, kept_paths AS (SELECT path FROM marks JOIN (SELECT doc_id, x.path FROM ({DOCS.replace('SELECT CASE', 'SELECT doc_id, CASE', 1)}) x) ON doc_id = k WHERE NOT ignored), ', 1)} SELECT n AS total_files, l AS total_lines, languages, (SELECT count(*) FROM marks WHERE ignored) AS filtered_by_ignore, {LEVEL} AS estimated_complexity FROM ({stats})",
        "scored_search": f"WITH {_NAMES}, far AS (SELECT DISTINCT query_id, id, name, levenshtein(lower(text), name)::INT AS distance, lower(text) AS t FROM named, asked) SELECT query_id, id, name, distance, (distance / greatest(length(t), length(name), 1))::FLOAT AS score FROM far WHERE distance <= 2",
        "fallback_layers": f"SELECT id, name, description, count(*) AS members FROM (SELECT {_TYPES}[p_partkey % 21 + 1] AS type FROM part) JOIN {_FALLBACK} ON list_contains(types, type) GROUP BY ALL",
    }
    made |= {
        "stored_nodes": f"{doc_nodes} SELECT {node_columns} FROM nodes",
        "stored_edges": made["contains_edges"],
        "stored_tour": made["tour_listing"],
        "stored_status": made["snapshot_status"],
        "incremental_edges": made["merged_edges"],
        "markdown_sections": r"""WITH texts AS (SELECT doc_id, string_split(concat_ws(chr(10), '# Document ' || doc_id, '', coalesce(text, ''), '', '## Source ##', '### ' || coalesce(source, 'none'), '###### ' || coalesce(lang, 'none')), chr(10)) AS l
                FROM documents WHERE doc_id IS NOT NULL), lines AS (SELECT doc_id, l[k] AS line, k FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM texts))
            SELECT 'docs/doc_' || doc_id || '.md' AS path, regexp_replace(regexp_replace(line, '^#+ +', ''), '\s+#*\s*$', '') AS title, length(regexp_extract(line, '^#+')) AS level, k::INT AS line
            FROM lines WHERE regexp_matches(line, '^#{1,6} ')""",
        "dashboard_payload": f"""{parts}, {found()}, {DEFINITIONS}, {IMPORTS}, {NODES}, d AS (SELECT path AS file_path, count(*) AS d FROM definitions GROUP BY path), i AS (SELECT path AS file_path, count(*) AS i FROM imports GROUP BY path),
            shown AS (SELECT *, CASE WHEN d > 0 OR i > 0 THEN replace(summary, ' lines)', ' lines, ' || coalesce(d, 0) || ' definitions, ' || coalesce(i, 0) || ' imports)') ELSE summary END AS told FROM nodes LEFT JOIN d USING (file_path) LEFT JOIN i USING (file_path)),
            members AS (SELECT {LAYER} AS layer, (row_number() OVER (PARTITION BY {LAYER} ORDER BY ord) - 1)::INT AS position, id FROM nodes)
            SELECT 0 AS section, id AS ord, to_json(struct_pack(id := id, colour := {_COLOUR}, radius := {_RADIUS}, label := right(coalesce(file_path, name), 15), type := type, summary := told))::VARCHAR AS json FROM shown
            UNION ALL SELECT 1, source || chr(0) || target || chr(0) || type, to_json(struct_pack(source := source, target := target, type := type))::VARCHAR FROM contains_edges
            UNION ALL SELECT 2, layer || ' ' || lpad(position::VARCHAR, 9, '0'), to_json(struct_pack(layer := layer, position := position, id := id))::VARCHAR FROM members""",
    }
    return made
