"""Fixed tables of the data model: languages, categories, node and edge types, and their spellings."""

from __future__ import annotations

# File extensions of each language.
EXTENSIONS = {
    "rust": ("rs",),
    "typescript": ("ts", "tsx"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py", "pyi", "pyx"),
    "go": ("go",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "swift": ("swift",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"),
    "csharp": ("cs",),
    "ruby": ("rb",),
    "php": ("php",),
    "lua": ("lua",),
    "sql": ("sql",),
    "shell": ("sh", "bash", "zsh"),
    "powershell": ("ps1", "psm1", "psd1"),
    "markdown": ("md", "mdx", "rst"),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
    "xml": ("xml", "svg", "html", "htm"),
    "css": ("css", "scss", "sass", "less"),
    "dockerfile": ("dockerfile", "dockerignore"),
    "terraform": ("tf", "tfvars"),
    "protobuf": ("proto",),
    "graphql": ("graphql", "gql"),
    "env": ("env", "envrc"),
    "makefile": ("makefile", "mk"),
}
LANGUAGE_OF = {ext: language for language, exts in EXTENSIONS.items() for ext in exts}

# What decides a file's category, in the order of precedence.
INFRA_NAMES = ("dockerfile", "docker-compose.yml", "docker-compose.yaml")
INFRA_PATHS = (".github/workflows", "Jenkinsfile")
CONFIG_LANGUAGES = ("json", "yaml", "toml", "xml", "env")
CONFIG_NAMES = ("makefile", ".env", ".envrc")
DOC_NAMES = ("readme.md", "changelog.md", "contributing.md", "license", "licence")
TEST_PATHS = ("/tests/", "/__tests__/", "/test/")
DATA_EXTENSIONS = ("csv", "tsv", "jsonl")
CODE_LANGUAGES = (
    "rust", "typescript", "javascript", "python", "go", "java", "kotlin", "swift", "c", "cpp", "csharp", "ruby", "php", "lua", "sql", "powershell",
    "terraform", "protobuf", "graphql", "dockerfile", "css", "makefile",
)
CATEGORIES = ("code", "config", "docs", "infra", "data", "script", "test", "unknown")

# The node type that a file of each category becomes.
CATEGORY_NODES = {"config": "config", "docs": "document", "infra": "resource", "data": "schema"}

# Node types and other spellings of them.
NODE_ALIASES = {
    "file": (),
    "function": ("func", "fn", "method"),
    "class": ("interface", "struct"),
    "module": ("mod", "pkg", "package"),
    "concept": (),
    "config": ("setting", "env", "configuration"),
    "document": ("doc", "readme", "docs"),
    "service": ("container", "deployment", "pod"),
    "table": ("migration", "database", "db", "view"),
    "endpoint": ("route", "api", "query", "mutation"),
    "pipeline": ("job", "ci"),
    "schema": ("proto", "protobuf"),
    "resource": ("infra", "infrastructure", "terraform"),
    "domain": (),
    "flow": (),
    "step": (),
    "article": (),
    "entity": (),
    "topic": (),
    "claim": (),
    "source": (),
}
NODE_TYPES = tuple(NODE_ALIASES)

# Edge types by group, and other spellings of some.
EDGE_GROUPS = {
    "structural": ("imports", "exports", "contains", "inherits", "implements"),
    "behavioral": ("calls", "subscribes", "publishes", "middleware"),
    "data flow": ("reads_from", "writes_to", "transforms", "validates"),
    "dependency": ("depends_on", "tested_by", "configures"),
    "semantic": ("related", "similar_to"),
    "infrastructure": ("deploys", "serves", "provisions", "triggers"),
    "schema": ("migrates", "documents", "routes", "defines_schema"),
    "domain": ("contains_flow", "flow_step", "cross_domain"),
    "knowledge": ("cites", "contradicts", "builds_on", "exemplifies", "categorized_under", "authored_by"),
}
EDGE_TYPES = tuple(t for group in EDGE_GROUPS.values() for t in group)
EDGE_ALIASES = {
    "extends": "inherits",
    "invokes": "calls",
    "emits": "publishes",
    "reads": "reads_from",
    "writes": "writes_to",
    "depends": "depends_on",
    "dependency": "depends_on",
    "tests": "tested_by",
    "relates": "related",
    "similar": "similar_to",
    "documented_by": "documents",
    "defines": "defines_schema",
    "crossdomain": "cross_domain",
    "buildson": "builds_on",
    "categorized": "categorized_under",
    "authored": "authored_by",
}
DIRECTIONS = ("forward", "backward", "bidirectional")
DIRECTION_ALIASES = {"reverse": "backward", "both": "bidirectional", "bi": "bidirectional"}
COMPLEXITIES = ("simple", "moderate", "complex")

# Id, name, description and node types of each layer.
LAYERS = (
    ("code", "Core Code", "Source code files and modules", ("file", "function", "class", "module")),
    ("config", "Configuration", "Configuration and settings files", ("config",)),
    ("docs", "Documentation", "Documentation and markdown files", ("document",)),
    ("infra", "Infrastructure", "Infrastructure and deployment files", ("resource", "service", "pipeline")),
    ("data", "Data & Schema", "Data models and schema definitions", ("schema", "table")),
    ("api", "API Layer", "API endpoints and routes", ("endpoint",)),
)
OTHER_LAYER = ("other", "Other", "Miscellaneous nodes")
# The layers of a model's graph for which the model named none.
FALLBACK_LAYERS = (
    ("code", "Core Code", "Source code and modules", ("file", "function", "class", "module")),
    ("concepts", "Concepts", "Domain concepts and abstractions", ("concept",)),
    ("config", "Configuration", "Configuration files", ("config",)),
    ("docs", "Documentation", "Documentation", ("document",)),
    ("infra", "Infrastructure", "Infrastructure and deployment", ("service", "pipeline", "resource")),
    ("data", "Data & Schema", "Data models and schemas", ("table", "schema")),
    ("api", "API Layer", "API endpoints", ("endpoint",)),
    ("domain", "Domain Logic", "Domain models and flows", ("domain", "flow", "step")),
    ("knowledge", "Knowledge", "Knowledge artifacts", ("article", "entity", "topic", "claim", "source")),
)
