import itertools
import random

import pytest
from lodegraph.operators import occurrence
from lodegraph.plans import catalog
from lodegraph.sources import code, owners

FILES = {
    "web/src/app.ts": "import { Api } from '../api/client.js';\n// import x from './gone'\nimport { m } from './missing';\nimport React from 'react';\n/* const no = require('x')\nfunction hidden() {}\n*/ export class Shop {\n  handler() { app.get('/orders', list); }\n}\n// router.post('/commented', x)\nconst t = `\nclass InTemplate {}\n`;\nexport const url = 'http://x//y'; // note\n",
    "web/src/api/client.ts": "export async function load() {}\nexport interface Order {}\n",
    "web/api/client.ts": "export const client = 1;\n",
    "web/src/app.test.ts": "import './app';",
    "api/main.py": "from fastapi import FastAPI\nfrom .models import Order  # models\nfrom ..shared import util\nimport lib.tools\nimport os\n'''\nclass InDoc: pass\n'''\nclass Service:\n    async def get(self): pass\n@app.get('/health')\n@app.Post(\"\")\n# @app.get('/old')\n",
    "api/models.py": "class Order: pass\n",
    "lib/tools/__init__.py": "",
    "native/a.cpp": '#include "a.h"\n#include <vector>\n#include "inc/b.h"\n',
    "native/a.h": "struct A {};\n",
    "inc/b.h": "struct B {};\n",
    "svc/Home.java": 'import java.util.List;\n@GetMapping("/home")\npublic String home(Model m) {\n',
    "svc/Api.cs": 'using System.Text;\n[HttpDelete("/item/{id}")]\npublic async Task<int> Remove(int id)\n',
    "docs/readme.md": "import nothing",
    "mod/x.rs": "use std::fmt::Debug;\npub fn go() {}\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("p", k, v) for k, v in FILES.items()], "project string, path string, content string")


def test_facts_with_their_lines(spark, files):
    got = {(r.path, r.kind, r.line, r.name, r.detail, r.method) for r in code.facts(code.sources(files)).collect()}
    of = lambda path, kind: sorted((x[2], x[3], x[4]) for x in got if x[:2] == (path, kind))
    assert of("web/src/app.ts", "import") == [(1, "../api/client.js", "import"), (3, "./missing", "import"), (4, "react", "import")]
    assert of("web/src/app.ts", "symbol") == [(7, "Shop", "type"), (11, "t", "value"), (14, "url", "value")]
    assert of("web/src/app.ts", "route") == [(8, "/orders", "router route")]
    assert of("api/main.py", "import") == [(1, "fastapi", "import"), (2, ".models", "import"), (3, "..shared", "import"), (4, "lib.tools", "import"), (5, "os", "import")]
    assert of("api/main.py", "symbol") == [(9, "Service", "type"), (10, "get", "function")]
    assert {x[2:] for x in got if x[:2] == ("api/main.py", "route")} == {(11, "/health", "router route", "GET")}
    assert {x[2:] for x in got if x[1] == "route" and x[0].startswith("svc")} == {(2, "/home", "mapped route", "GET"), (2, "/item/{id}", "HTTP route", "HTTP")}
    assert of("svc/Home.java", "symbol") == [(3, "home", "method")] and of("svc/Api.cs", "symbol") == [(3, "Remove", "method")]
    assert of("mod/x.rs", "import") == [(1, "std::fmt::Debug", "use")] and of("mod/x.rs", "symbol") == [(2, "go", "function")]
    assert not {x for x in got if x[0] in ("web/src/app.test.ts", "docs/readme.md")}
    capped = code.facts(code.sources(files), most=(1, 2, 0)).collect()
    assert sorted((r.kind, r.line) for r in capped if r.path == "web/src/app.ts") == [("import", 1), ("symbol", 7), ("symbol", 11)]


def test_local_imports(files):
    got = {(r.path, r.name): (r.target, r.resolution) for r in code.resolve_imports(code.facts(code.sources(files)), files).collect()}
    assert got["web/src/app.ts", "../api/client.js"] == ("web/api/client.ts", "local")
    assert got["web/src/app.ts", "./missing"] == (None, "unresolved-local") and got["web/src/app.ts", "react"] == (None, "external")
    assert got["api/main.py", ".models"] == ("api/models.py", "local") and got["api/main.py", "..shared"] == (None, "unresolved-local")
    assert got["api/main.py", "lib.tools"] == ("lib/tools/__init__.py", "local") and got["api/main.py", "os"] == (None, "external")
    assert got["native/a.cpp", "a.h"] == ("native/a.h", "local") and got["native/a.cpp", "inc/b.h"] == ("inc/b.h", "local") and got["native/a.cpp", "vector"][1] == "external"


def test_graph_of_sources(files):
    entities, relations, proofs = (x.collect() for x in code.structure(files))
    kind = {r.id: (r.kind, r.label) for r in entities}
    assert len(kind) == len(entities) and {r.proof for r in relations} == {r.id for r in proofs}
    named = {(kind[r.src][1], r.kind, *kind[r.dst], r.confidence) for r in relations if r.src in kind}
    assert ("web/src/app.ts", "imports", "file", "web/api/client.ts", "high") in named
    assert ("web/src/app.ts", "imports", "module", "./missing", "low") in named and ("web/src/app.ts", "imports", "module", "react", "medium") in named
    assert ("api/main.py", "defines", "endpoint", "GET /health", "medium") in named and ("web/src/api/client.ts", "defines", "symbol", "Order", "medium") in named


def test_masks_keep_lines():
    text = "a = '//no' # c\nb = \"\"\"x\n# y\n\"\"\" + '''z\nunclosed"
    assert code.mask("a.py", text) == "a = '//no' \nb = \n\n + \n"
    assert code.mask("a.js", "x('a//b'); /* c\nd */ y // z\nq = 'open\nr = \"\\\"//\" + `t\\`\n// in` + 1").splitlines() == ["x('a//b');     ", "     y     ", "q = 'open", 'r = "\\"//" +    ' + " ", "       + 1"]
    assert code.mask("a.go", "// kept") == "// kept"


def test_bridges(spark):
    rust = '// deno_core::extension!(no\nregister_extension!(x, ops = [op_no]);\ndeno_core::extension!(\n  net,\n  ops = [op_dial, ops::op_listen<P>],\n  esm = [ "js/01_net.js", "js/gone.js" ],\n  docs = "a ) b",\n  options = { f: fn() },\n);\nfn op_dial() {}\n'
    files = spark.createDataFrame([("p", "ext/net/lib.rs", rust), ("p", "ext/net/js/01_net.js", "a();\nops.op_dial();\n"), ("q", "ext/net/js/gone.js", "")], "project string, path string, content string")
    got = {tuple(r)[2:] for r in code.bridges(files).collect()}
    assert got == {("net", 3, "defines", "ext/net/lib.rs", "op_dial", 5), ("net", 3, "defines", "ext/net/lib.rs", "op_listen", 5), ("net", 3, "references", "ext/net/js/01_net.js", None, None), ("net", 3, "calls", "ext/net/js/01_net.js", "op_dial", 2)}
    assert code.balanced("f(a (b) \"(\" c) d", 1) == 'a (b) "(" c' and code.balanced("(a", 0) is None


@pytest.mark.parametrize("gram", [1, 2, 4])
def test_occurrences(spark, gram):
    rng = random.Random(gram)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [(k, k % 3, text(rng.randrange(12))) for k in range(40)] + [(98, 0, None), (99, 1, "aab" * 400)]
    patterns = [(k, k % 3, text(rng.randrange(1, 7))) for k in range(60)] + [(97, 0, ""), (98, 0, None), (99, 1, "aabaab" * 30)]
    a, b = spark.createDataFrame(texts, "text_id int, grp int, text string"), spark.createDataFrame(patterns, "pattern_id int, grp int, pattern string")
    want = {(i, j) for (i, _, t), (j, _, p) in itertools.product(texts, patterns) if t is not None and p and p in t}
    rows = list(map(tuple, occurrence.occurrences(a, b, gram=gram).collect()))
    assert set(rows) == want and len(rows) == len(want)
    within = {(g, i, j) for (i, g, t), (j, h, p) in itertools.product(texts, patterns) if g == h and t is not None and p and p in t}
    assert set(map(tuple, occurrence.occurrences(a, b, by=["grp"], gram=gram).collect())) == within
    assert occurrence.occurrences(a, b.where("pattern = ''")).collect() == []


def test_no_nested_loop_over_names(spark):
    plan = catalog.QUERIES["env_theta_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_owners(spark):
    text = ["# rules", "", "/apps/web @web @ops user@mail", "*.js @js", "/apps/* @apps", "lib/core/ @Core", "gone/ @none", "/apps/web/x"]
    lines = spark.createDataFrame([("CODEOWNERS", n, x) for n, x in enumerate(text, 1)], "path string, line_no int, line string")
    projects = spark.createDataFrame([("w", "apps/web"), ("w2", "apps/website"), ("c", "lib/core"), ("d", "lib/cor"), ("top", ".")], "project string, root string")
    met = owners.owned(owners.rules(lines), projects)
    rows = {(r.line_no, r.owner, r.project) for r in met.collect()}
    top = {(n, o, "top") for n, o in ((3, "@web"), (3, "@ops"), (5, "@apps"), (6, "@Core"), (7, "@none"))}
    assert rows == top | {(3, "@web", "w"), (3, "@ops", "w"), (3, "@web", "w2"), (3, "@ops", "w2"), (5, "@apps", "w"), (5, "@apps", "w2"), (6, "@Core", "c"), (4, "@js", None)}
    assert {(r.project, r.owner) for r in owners.last_rule(met).collect()} == {("w", "@apps"), ("w2", "@apps"), ("c", "@Core"), ("top", "@none")}
