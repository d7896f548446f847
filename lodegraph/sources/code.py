"""Facts of source files: imports, symbols, routes and bridges between languages, with their lines.

Files are a table (project, path, content).  Comments are masked in Arrow batches, one regular expression
a file; all else is built-in functions over the table of lines: the first pattern that a line matches
names its fact.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.text import stable_id

# Extensions of source files in the order in which an import is completed by them, languages
# by extension, folders of tests and examples, and the patterns of imports, symbols and routes.
EXTENSIONS = [".c", ".cc", ".cpp", ".cs", ".dart", ".ex", ".exs", ".go", ".h", ".hpp", ".java", ".cjs", ".cts", ".js", ".jsx", ".kt", ".kts", ".mjs", ".mts", ".php", ".py", ".r", ".rb", ".rs", ".scala", ".svelte", ".swift", ".ts", ".tsx", ".vue", ".clj", ".cljs", ".fs", ".fsx", ".lua", ".vb"]
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".dart": "dart", ".ex": "elixir", ".exs": "elixir", ".go": "go", ".h": "c", ".hpp": "cpp", ".java": "java", ".cjs": "javascript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".mjs": "javascript", ".mts": "typescript", ".php": "php", ".py": "python", ".r": "r", ".rb": "ruby", ".rs": "rust", ".scala": "scala",
    ".svelte": "svelte", ".swift": "swift", ".ts": "typescript", ".tsx": "typescript", ".vue": "vue", ".clj": "clojure", ".cljs": "clojure", ".fs": "fsharp", ".fsx": "fsharp", ".lua": "lua", ".vb": "visual-basic",
}
TEST_FOLDERS = ["test", "tests", "spec", "specs", "e2e", "integration", "integration-tests", "integration_tests", "__tests__", "fixture", "fixtures", "__fixtures__", "testdata"]
EXAMPLE_FOLDERS = ["examples", "samples", "worked"]
TEST_NAMES = [r"(?:\.test|\.spec|_test)\.[a-z0-9]+$", r"^test_.+\.[a-z0-9]+$", r"(?:tests?|specs?)\.(?:cs|fs|vb|java|kt|kts)$"]
SCRIPT_IMPORTS = [(r"""^\s*import(?:.+?from\s*)?["']([^"']+)["']""", "import"), (r"""require\(["']([^"']+)["']\)""", "require")]
PYTHON_IMPORTS = [(r"^\s*from\s+([A-Za-z0-9_.]+)\s+import\s+", "import"), (r"^\s*import\s+([A-Za-z0-9_.]+)(?:\s|$)", "import")]
RUBY_IMPORTS = [(r"""^\s*require(?:_relative)?\s+["']([^"']+)["']""", "require")]
IMPORTS: dict[tuple[str, ...], list[tuple[str, str]]] = {
    (".cjs", ".cts", ".js", ".jsx", ".mjs", ".mts", ".ts", ".tsx", ".vue", ".svelte"): SCRIPT_IMPORTS,
    (".py",): PYTHON_IMPORTS,
    (".c", ".cc", ".cpp", ".h", ".hpp"): [(r"""^\s*#\s*include\s*["<]([^">]+)[">]""", "include")],
    (".rs",): [(r"^\s*use\s+([A-Za-z0-9_:*.-]+)", "use")],
    (".java", ".kt", ".kts", ".scala"): [(r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;?", "import")],
    (".cs", ".fs", ".fsx", ".vb"): [(r"^\s*(?:global\s+)?using\s+([A-Za-z0-9_.]+)", "using")],
    (".go",): [(r"""^\s*import\s+(?:[A-Za-z0-9_.]+\s+)?["']([^"']+)["']""", "import")],
    (".rb",): RUBY_IMPORTS,
    (".php",): [(r"^\s*use\s+([A-Za-z0-9_\\]+)", "use")],
    (".ex", ".exs"): [(r"^\s*(?:alias|import|require|use)\s+([A-Za-z0-9_.]+)", "import")],
    (".dart",): [(r"""^\s*import\s+["']([^"']+)["']""", "import")],
    (".lua",): [(r"""\brequire\s*\(?\s*["']([^"']+)["']""", "require")],
    (".r",): [(r"""^\s*(?:library|require)\s*\(\s*["']?([^"')\s]+)["']?""", "import")],
}
OTHER_IMPORTS = [*SCRIPT_IMPORTS, *PYTHON_IMPORTS, (r"^\s*(?:import|using|use)\s+([A-Za-z0-9_:.*\\/.-]+)", "import"), *RUBY_IMPORTS]
SYMBOLS = [
    (r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "function"),
    (r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|enum|type)\s+([A-Za-z_$][\w$]*)", "type"),
    (r"^\s*(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)", "value"),
    (r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", "function"),
    (r"^\s*class\s+([A-Za-z_]\w*)", "type"),
    (r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "function"),
    (r"^\s*type\s+([A-Za-z_]\w*)\s+", "type"),
    (r"^\s*(?:public\s+|private\s+|protected\s+|internal\s+|abstract\s+|final\s+)*(?:class|interface|record|enum)\s+([A-Za-z_]\w*)", "type"),
    (r"^\s*(?:public|protected|internal)\s+(?:(?:static|virtual|override|abstract|async|sealed|final|synchronized|native|unsafe|partial|extern|new)\s+)*(?:<[^>]+>\s*)?[A-Za-z_$][\w$<>,.?\[\]: ]*\s+([A-Za-z_$][\w$]*)\s*\(", "method"),
    (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)", "function"),
    (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|trait|enum|type)\s+([A-Za-z_]\w*)", "type"),
    (r"^\s*(?:public\s+|private\s+|protected\s+)?function\s+([A-Za-z_]\w*)", "function"),
    (r"^\s*(?:class|module|struct|protocol|mixin)\s+([A-Za-z_]\w*)", "type"),
]
ROUTES = [
    (r"""(?i)@(?:Get|Post|Put|Delete|Patch|Options|Head)\s*\(\s*["']([^"']*)["']""", "decorated route"),
    (r"""(?i)\b(?:app|router|server|api|route|fastify|fiber)\.(?:get|post|put|delete|patch|options|head)\s*\(\s*["']([^"']+)["']""", "router route"),
    (r"""@(?:GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\s*\([^"']*["']([^"']*)["']""", "mapped route"),
    (r"""(?i)\[Http(?:Get|Post|Put|Delete|Patch)\s*\(\s*["']([^"']*)["']""", "HTTP route"),
    (r"""(?i)^\s*(?:get|post|put|delete|patch)\s+["']([^"']+)["']""", "HTTP route"),
]
METHOD = r"(?i)(?:@|\.|\[|^\s*)(get|post|put|delete|patch|options|head)"
BRIDGE = r"(?<![A-Za-z0-9_:])(?:deno_core::)?extension!\s*\("
#: Bytes of a file that is read, and facts of a kind that one file gives.
MOST_BYTES = 2 * 1024 * 1024
MOST_IMPORTS, MOST_SYMBOLS, MOST_ROUTES = 250, 100, 100
BREAK = r"\r?\n"

_PYTHON = re.compile(r"#[^\n]*|'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)", re.S)
_SCRIPT = re.compile(r"""(?P<gone>//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*(?:`|\Z|\\\Z))|'(?:\\[^\n]|[^'\\\n])*'?|"(?:\\[^\n]|[^"\\\n])*"?""", re.S)
_MASKED = {".py": "python"} | dict.fromkeys((".js", ".jsx", ".mjs", ".ts", ".tsx"), "script")


def mask(path: str, text: str) -> str:
    """The text without comments, and without the contents of long strings (Python) or templates (scripts), in
    the same lines; other files are as they are."""
    kind = _MASKED.get(posixpath.splitext(path)[1].lower())
    if kind is None:
        return text
    text = text.replace("\r\n", "\n")
    if kind == "python":
        return _PYTHON.sub(lambda m: "\n" * m[0].count("\n"), text)
    return _SCRIPT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m["gone"] else m[0], text)


@F.arrow_udf(StringType())
def masked(path: pa.Array, text: pa.Array) -> pa.Array:
    return pa.array([mask(p or "", t or "") for p, t in zip(path.to_pylist(), text.to_pylist(), strict=True)], pa.string())


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def language(path: Column, runtime: Column | None = None) -> Column:
    """The language that a path tells; a header is C++ where that is the project's runtime."""
    ext = extension(path)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    own = F.coalesce(F.try_element_at(known, ext), F.when(ext != "", F.substring(ext, 2, 99)), F.lit("unknown"))
    return own if runtime is None else F.when((ext == ".h") & (runtime == "cpp"), "cpp").otherwise(own)


def role(path: Column) -> Column:
    """test, example or production, by folders and names."""
    parts, base = F.split(F.lower(path), "/"), F.element_at(F.split(F.lower(path), "/"), -1)
    named = F.lit(False)
    for shape in TEST_NAMES:
        named = named | base.rlike(shape)
    return F.when(F.arrays_overlap(parts, F.array(*map(F.lit, TEST_FOLDERS))) | named, "test").when(F.arrays_overlap(parts, F.array(*map(F.lit, EXAMPLE_FOLDERS))), "example").otherwise("production")


def sources(files: DataFrame) -> DataFrame:
    """The production source files that are small enough to be read, without repeats of a path."""
    own = files.where(extension(F.col("path")).isin(EXTENSIONS) & (role(F.col("path")) == "production") & (F.octet_length("content") <= MOST_BYTES))
    return own.select("project", "path", "content").dropDuplicates(["project", "path"])


def _first(line: Column, patterns: list[tuple[Column | None, str, str]]) -> Column:
    """struct(name, detail) of the first pattern with a name in the line."""
    ways = []
    for when, shape, detail in patterns:
        name = F.btrim(F.regexp_extract(line, shape, 1), F.lit(" \t\f\u000b"))
        ways.append(F.when((name != "") if when is None else when & (name != ""), F.struct(name.alias("name"), F.lit(detail).alias("detail"))))
    return F.coalesce(*ways)


def import_patterns(ext: Column) -> list[tuple[Column | None, str, str]]:
    known = [e for group in IMPORTS for e in group]
    out: list[tuple[Column | None, str, str]] = [(ext.isin(*group), shape, detail) for group, own in IMPORTS.items() for shape, detail in own]
    return out + [(~ext.isin(known), shape, detail) for shape, detail in OTHER_IMPORTS]


def facts(files: DataFrame, most: tuple[int, int, int] | None = (MOST_IMPORTS, MOST_SYMBOLS, MOST_ROUTES)) -> DataFrame:
    """(project, path, kind, line, name, detail, method) of source files: kinds import, symbol and route, lines from 1;
    of each kind the first ``most`` of a file, all with None.  A line gives one fact of a kind at most."""
    own = files.select("project", "path", F.split("content", BREAK).alias("raw"), F.split(masked("path", "content"), BREAK).alias("code"))
    lines = own.select("project", "path", F.posexplode(F.arrays_zip("code", "raw")).alias("at", "l")).select("project", "path", (F.col("at") + 1).alias("line"), F.col("l.code").alias("code"), F.col("l.raw").alias("raw")).where(F.trim("code") != "")
    ext, code = extension(F.col("path")), F.col("code")
    start = F.ltrim(F.col("raw"))
    hashed, dashed = ext.isin(".py", ".rb", ".sh", ".bash", ".zsh"), ext.isin(".sql", ".lua", ".hs")
    comment = F.when(hashed, start.startswith("#")).when(dashed, start.startswith("--")).otherwise(start.rlike(r"^(//|/\*|\*)"))
    found = [
        ("import", _first(code, import_patterns(ext))),
        ("symbol", _first(code, [(None, *p) for p in SYMBOLS])),
        ("route", F.when(~comment, _first(code, [(None, *p) for p in ROUTES]))),
    ]
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), x.alias("f")) for kind, x in found))
    verb = F.upper(F.regexp_extract("raw", METHOD, 1))
    out = lines.select("project", "path", "line", "raw", F.explode(F.filter(each, lambda e: e.f.isNotNull())).alias("e"))
    method = F.when(F.col("e.kind") == "route", F.when(verb == "", "HTTP").otherwise(verb))
    out = out.select("project", "path", F.col("e.kind").alias("kind"), "line", F.col("e.f.name").alias("name"), F.col("e.f.detail").alias("detail"), method.alias("method"))
    if most is None:
        return out
    nth = F.row_number().over(Window.partitionBy("project", "path", "kind").orderBy("line"))
    cap = F.when(F.col("kind") == "import", most[0]).when(F.col("kind") == "symbol", most[1]).otherwise(most[2])
    return out.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")


def resolved(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts; those that lead above the root are dropped."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def import_candidates(path: Column, name: Column, detail: Column) -> Column:
    """The paths that an import may mean, best first; none for one that names a package."""
    joined = lambda a, b: resolved(F.concat_ws("/", a, b))
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    module = F.replace(F.substr(name, dots + 1), F.lit("."), F.lit("/"))
    up = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(dots - 1, F.lit(0))), lambda k: F.when(k == 0, F.lit(".")).otherwise(F.lit(".."))), "/")
    python = joined(F.when(dots > 0, joined(folder(path), up)).otherwise(F.lit("")), module)
    is_python = extension(path) == ".py"
    near, top = joined(folder(path), name), resolved(name)
    bases = F.when(is_python, F.array(python)).when(name.startswith("."), F.array(near)).when(detail == "include", F.array(near, top)).otherwise(F.array().cast("array<string>"))

    def complete(base: Column) -> Column:
        ext = extension(base)
        stem = F.substr(base, F.lit(1), F.length(base) - F.length(ext))
        script = F.when(ext.isin(".js", ".jsx", ".mjs"), F.array(*(F.concat(stem, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs")))).otherwise(F.array().cast("array<string>"))
        inside = F.when(base == "", F.lit("")).otherwise(F.concat(base, F.lit("/")))
        open_ = F.array(*(x for e in EXTENSIONS for x in (F.concat(base, F.lit(e)), F.concat(inside, F.lit(f"index{e}")))))
        as_python = F.when(is_python, F.array(F.concat(base, F.lit(".py")), F.concat(inside, F.lit("__init__.py")))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(base), as_python, F.when(ext.isin(EXTENSIONS), script).otherwise(open_))

    return F.array_distinct(F.flatten(F.transform(bases, complete)))


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """Imports among ``facts`` with target, the path in the same project that the first existing candidate is, and
    resolution: local, unresolved-local or external."""
    own = found.where("kind = 'import'").select("project", "path", "line", "name", "detail")
    known = files.select("project", F.col("path").alias("candidate")).distinct()
    ways = own.select("*", F.posexplode(import_candidates(F.col("path"), F.col("name"), F.col("detail"))).alias("pos", "candidate"))
    key = ["project", "path", "line"]
    hit = ways.join(known, ["project", "candidate"]).groupBy(*key).agg(F.min_by("candidate", "pos").alias("target"))
    state = F.when(F.col("target").isNotNull(), "local").when(F.col("name").startswith("."), "unresolved-local").otherwise("external")
    return own.join(hit, key, "left").withColumn("resolution", state)


def structure(files: DataFrame, most: tuple[int, int, int] | None = (MOST_IMPORTS, MOST_SYMBOLS, MOST_ROUTES)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, proofs) of all files: entities (id, kind, key, label, project), relations (id, src, dst,
    kind, confidence, proof), proofs (id, path, line, detail).  Files, modules, symbols and endpoints are entities;
    a relation is there once for each proof."""
    zero = F.lit("\0")
    own = sources(files)
    found = facts(own, most)
    imports = resolve_imports(found, files)
    file_key = lambda path: F.concat(F.lit("file:"), F.col("project"), F.lit(":"), path)
    whole = own.select("project", "path", F.lit(None).cast("int").alias("line"), F.lit("contains").alias("kind"), F.lit("high").alias("confidence"), F.lit("project").alias("from_kind"), F.concat(F.lit("project:"), F.col("project")).alias("from_key"), F.lit("file").alias("to_kind"), file_key(F.col("path")).alias("to_key"), F.col("path").alias("label"), F.concat(language(F.col("path")), F.lit(" source file")).alias("detail"))
    local = F.col("target").isNotNull()
    named = F.concat(F.lit("module:"), F.col("project"), F.lit(":"), F.col("name"))
    trust = F.when(local, "high").when(F.col("resolution") == "external", "medium").otherwise("low")
    used = imports.select("project", "path", "line", F.lit("imports").alias("kind"), trust.alias("confidence"), F.lit("file").alias("from_kind"), file_key(F.col("path")).alias("from_key"), F.when(local, "file").otherwise("module").alias("to_kind"), F.when(local, file_key(F.col("target"))).otherwise(named).alias("to_key"), F.coalesce("target", "name").alias("label"), F.concat_ws(": ", "detail", "name").alias("detail"))
    key = F.when(F.col("kind") == "symbol", F.concat_ws(":", F.lit("symbol"), "project", "path", "detail", "name")).otherwise(F.concat_ws(":", F.lit("source-endpoint"), "project", "path", "method", "name"))
    label = F.when(F.col("kind") == "symbol", F.col("name")).otherwise(F.concat_ws(" ", "method", "name"))
    detail = F.when(F.col("kind") == "symbol", F.concat_ws(": ", "detail", "name")).otherwise(label)
    made = found.where("kind <> 'import'").select("project", "path", "line", F.lit("defines").alias("kind"), F.lit("medium").alias("confidence"), F.lit("file").alias("from_kind"), file_key(F.col("path")).alias("from_key"), F.when(F.col("kind") == "symbol", "symbol").otherwise("endpoint").alias("to_kind"), key.alias("to_key"), label.alias("label"), detail.alias("detail"))
    rows = whole.unionByName(used).unionByName(made)
    proof = stable_id(F.lit("proof"), F.concat(F.lit("source-structure"), zero, F.col("path"), zero, zero, F.coalesce(F.col("line").cast("string"), F.lit("")), zero, F.col("detail")))
    a, b = stable_id(F.col("from_kind"), F.col("from_key")), stable_id(F.col("to_kind"), F.col("to_key"))
    rows = rows.withColumns({"src": a, "dst": b, "proof": proof})
    entities = rows.select(F.col("dst").alias("id"), F.col("to_kind").alias("kind"), F.col("to_key").alias("key"), "label", "project")
    entities = entities.groupBy("id", "kind", "key", "project").agg(F.min("label").alias("label")).select("id", "kind", "key", "label", "project")
    relations = rows.select(stable_id(F.lit("relation"), F.concat(F.col("src"), zero, F.col("kind"), zero, F.col("dst"))).alias("id"), "src", "dst", "kind", "confidence", "proof").distinct()
    return entities, relations, rows.select(F.col("proof").alias("id"), "path", "line", "detail").distinct()


def balanced(text: str, at: int) -> str | None:
    """What is between the bracket at ``at`` and its closing one; brackets in quotes do not count."""
    depth = 0
    for m in re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[()]', re.S).finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            return text[at + 1 : m.start()]
    return None


def extensions_of(text: str) -> Iterator[tuple[str, int, list[str], list[str]]]:
    """(name, line, operations, scripts) of the extension macros of a Rust file."""
    for m in re.finditer(BRIDGE, text):
        body = balanced(text, m.end() - 1)
        name = re.match(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*,", body or "")
        if not name:
            continue
        lists = lambda key: re.findall(rf"\b(?:{key})\s*=\s*\[(.*?)\]", body, re.S)  # noqa: B023, E731
        operations = {o for part in lists("ops") for o in re.findall(r"\b(op_[A-Za-z0-9_]+)\b", part)}
        scripts = {s for part in lists("esm|js|lazy_loaded_esm|lazy_loaded_js") for s in re.findall(r"""["']([^"']+\.(?:[cm]?[jt]s|tsx?|jsx?))["']""", part)}
        yield name[1], text.count("\n", 0, m.start()) + 1, sorted(operations), sorted(scripts)


DECLARED = ArrayType(StructType().add("name", StringType()).add("line", IntegerType()).add("operations", ArrayType(StringType())).add("scripts", ArrayType(StringType())))


@F.arrow_udf(DECLARED)
def declared(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("operations", pa.list_(pa.string())), ("scripts", pa.list_(pa.string()))]))
    keys = ("name", "line", "operations", "scripts")
    return pa.array([[dict(zip(keys, d, strict=True)) for d in extensions_of(t or "")] for t in text.to_pylist()], kind)


def bridges(files: DataFrame) -> DataFrame:
    """(project, path, extension, line, relation, target, operation, call_line): what Rust extension macros declare:
    their operations (defines), scripts that exist (references) and the calls of operations in those (calls)."""
    rust = files.where((extension(F.col("path")) == ".rs") & (role(F.col("path")) == "production") & F.col("content").rlike(BRIDGE) & (F.octet_length("content") <= MOST_BYTES))
    own = rust.select("project", "path", "content", F.explode(declared("content")).alias("d")).select("project", "path", "content", F.col("d.name").alias("extension"), "d.line", "d.operations", "d.scripts")
    line = lambda text, token: F.size(F.split(F.substr(text, F.lit(1), F.position(token, text) - 1), "\n"))
    head = ["project", "path", "extension", "line"]
    operation = own.select(*head, "content", F.explode("operations").alias("operation"))
    defines = operation.select(*head, F.lit("defines").alias("relation"), "path", "operation", line(F.col("content"), F.col("operation")).alias("call_line")).toDF(*head, "relation", "target", "operation", "call_line")
    script = own.select(*head, "operations", F.explode("scripts").alias("s")).select(*head, "operations", resolved(F.concat_ws("/", folder(F.col("path")), F.col("s"))).alias("target"))
    held = script.join(files.select("project", F.col("path").alias("target"), F.col("content").alias("text")), ["project", "target"])
    references = held.select(*head, F.lit("references").alias("relation"), "target", F.lit(None).cast("string").alias("operation"), F.lit(None).cast("int").alias("call_line"))
    called = held.select(*head, "target", "text", F.explode("operations").alias("operation")).where(F.contains("text", F.col("operation")))
    calls = called.select(*head, F.lit("calls").alias("relation"), "target", "operation", line(F.col("text"), F.col("operation")).alias("call_line"))
    return defines.unionByName(references).unionByName(calls)
