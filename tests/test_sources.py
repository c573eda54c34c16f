"""Parsers, extraction, indexes and sinks on small fixtures."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.engine import GraphEngine
from quillgraph.functions import paths, text
from quillgraph.operators import code_search, control, evaluate, merge
from quillgraph.sources import extract, files, parsers, scip, sinks
from quillgraph.streaming import status

FILES = {
    "package.json": '{"name": "shop", "dependencies": {"express": "^4", "stripe": "1"}}',
    "README.md": "# Shop\nSee [the guide](docs/guide.md#a) and [gone](missing.md).\n## Parts\nThe `UserService` reads users. OrderService too.\n```ts\n# not a heading\n```\n### Deep\n## Parts\n",
    "docs/guide.md": "# Guide\n[back](../README.md)\n[out](../../x.md)\n",
    "db/migrations/1.sql": 'CREATE TABLE IF NOT EXISTS public.users (\n  id SERIAL PRIMARY KEY,\n  email VARCHAR(255) NOT NULL UNIQUE, -- mail, it\'s\n  org_id INT REFERENCES orgs(id),\n  CONSTRAINT fk FOREIGN KEY (org_id) REFERENCES orgs (id)\n);\nALTER TABLE users ADD COLUMN age numeric(10, 2) DEFAULT 0;\nCREATE UNIQUE INDEX ix ON users (email, age);\nINSERT INTO audit SELECT * FROM users;\n',
    "openapi.yaml": "openapi: 3.0.0\nservers:\n  - url: https://h.test/api\npaths:\n  /users/{id}:\n    get:\n      summary: x\n    post: {}\n",
    "docker-compose.yml": "services:\n  web:\n    image: shop\n    depends_on: [db]\n  db:\n    image: postgres:16\n",
    "src/user.service.ts": "import { Repo } from './repo';\nimport Stripe from 'stripe';\nexport class UserService extends Base {\n  async find(id) { return this.db.query(`SELECT * FROM users WHERE id = ${id}`); }\n  save() { new Repo(); fetch('https://api.github.com/x'); fetch('http://localhost/y'); this.bus.emit('user.saved', 1); }\n}\n",
    "src/repo.ts": "// import x from 'y'\nexport class Repo { run() { return \"DELETE FROM sessions\"; } }\nexport interface Base {}\n",
    "src/routes.ts": "import { UserService } from './user.service.js';\nconst q = new Queue('mail');\nrouter.get('/api/users/:id', auth, show);\nfunction show(req, res) {}\n",
    "dist/skip.js": "x",
}


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(p, t) for p, t in FILES.items()], "path string, text string").repartition(3)


@pytest.fixture(scope="module")
def graph(tree):
    g, dropped = extract.assemble(tree)
    return extract.Graph(g.nodes.cache(), g.edges.cache()), dropped


def named(g):
    a, b = g.nodes.select(F.col("id").alias("source"), F.col("name").alias("a")), g.nodes.select(F.col("id").alias("target"), F.col("name").alias("b"))
    return {(r["a"], r["relationship"], r["b"]) for r in g.edges.join(a, "source").join(b, "target").select("a", "relationship", "b").collect()}


def test_extraction_finds_the_facts_and_no_others(graph):
    g, dropped = graph
    e = named(g)
    want = {
        ("shop", "DEPENDS_ON", "express"), ("README.md", "LINKS_TO", "guide.md"), ("guide.md", "LINKS_TO", "README.md"), ("Shop", "CONTAINS", "Parts"), ("Parts", "CONTAINS", "Deep"), ("Parts", "DOCUMENTS", "UserService"),
        ("1.sql", "DEFINES", "users"), ("users", "CONTAINS", "email"), ("users", "REFERENCES", "orgs"), ("1.sql", "WRITES_TO", "audit"), ("1.sql", "READS_FROM", "users"),
        ("openapi.yaml", "DEFINES", "GET /api/users/{id}"), ("GET /api/users/{id}", "IMPLEMENTED_BY", "GET /api/users/:id"), ("docker-compose.yml", "DEFINES", "db"), ("web", "DEPENDS_ON", "db"), ("db", "USES", "postgres"),
        ("user.service.ts", "IMPORTS", "repo.ts"), ("routes.ts", "IMPORTS", "user.service.ts"), ("UserService", "CONTAINS", "find"), ("UserService", "EXTENDS", "Base"), ("find", "READS_FROM", "users"), ("UserService", "READS_FROM", "users"), ("save", "INSTANTIATES", "Repo"),
        ("save", "CALLS", "GitHub"), ("UserService", "CALLS", "GitHub"), ("user.service.ts", "USES", "Stripe"), ("save", "PUBLISHES", "user.saved"), ("UserService", "PUBLISHES", "user.saved"), ("run", "WRITES_TO", "sessions"), ("Repo", "WRITES_TO", "sessions"), ("routes.ts", "PUBLISHES", "mail"), ("routes.ts", "CONTAINS", "GET /api/users/:id"), ("GET /api/users/:id", "ROUTES_TO", "show"),
    }
    assert want <= e, want - e
    assert not any("localhost" in x for t in e for x in t) and not any(r == "READS_FROM" and b == "sessions" for _, r, b in e) and ("user.service.ts", "READS_FROM", "users") not in e and not any(b == "y" for _, _, b in e)
    assert ("Parts", "DOCUMENTS", "OrderService") not in e
    ids = [r["id"] for r in g.nodes.select("id").collect()]
    assert len(ids) == len(set(ids)) and dropped.first()["dropped"] >= 0
    assert {r["qualified_name"] for r in g.nodes.filter("node_type = 'document_section' AND name = 'Parts'").collect()} == {"README.md#parts", "README.md#parts-l9"}


def test_extraction_does_not_depend_on_partitions(tree, graph):
    again, _ = extract.assemble(tree.repartition(7))
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert rows(again.nodes) == rows(graph[0].nodes) and rows(again.edges) == rows(graph[0].edges)


def test_engine(spark, tree, graph):
    e = GraphEngine(graph[0], tree)
    ids = {r["name"]: r["id"] for r in graph[0].nodes.collect()}
    assert [r["name"] for r in e.search("userservice")[0].collect()][0] == "UserService"
    said, path, steps = e.trace(ids["openapi.yaml"], ids["show"])
    assert said == "found" and not path.undirected and [r["relationship"] for r in steps.orderBy("step").collect()] == ["DEFINES", "IMPLEMENTED_BY", "ROUTES_TO"]
    assert {r["name"] for r in e.tree_level("docs").collect()} == {"guide.md"} and e.changed_since(e.manifest()).count() == 0
    assert e.node_detail(ids["UserService"])["children"].count() == 2 and e.model().count() == graph[0].nodes.count()
    assert [r["body"] for r in e.source_window("src/repo.ts", start=1, end=1)[0].collect()] == ["// import x from 'y'"]
    assert e.query("data", limit=50).nodes.count() > 0 and not e.query("files", root=ids["src"], depth=1).truncated


def test_roles(spark, graph):
    got = {r["id"]: r["role"] for r in extract.roles(graph[0]).collect()}
    byname = {r["id"]: r["name"] for r in graph[0].nodes.collect()}
    assert {byname[i]: r for i, r in got.items()}.get("show") == "controller"


def test_sql_schema():
    s = parsers.sql_schema(FILES["db/migrations/1.sql"])
    u = s["tables"]["users"]
    assert list(u.columns) == ["id", "email", "org_id", "age"] and u.primary_key == ["id"]
    assert u.columns["email"] == {"type": "VARCHAR(255)", "not_null": True, "primary_key": False, "unique": True, "line": 3} and u.columns["age"]["type"] == "NUMERIC(10, 2)"
    assert [(k["from_column"], k["to_table"], k["to_column"]) for k in s["foreign_keys"]] == [("org_id", "orgs", "id")] * 2
    assert s["indexes"] == [{"name": "ix", "table": "users", "columns": ["email", "age"], "unique": True, "line": 8}]
    assert parsers.sql_schema("create table (") == {"tables": {}, "foreign_keys": [], "indexes": []}
    assert parsers.blank_noise("a 'x''y' -- c\n\"q\"") == "a " + " " * 6 + " " + " " * 4 + '\n"q"'


def test_structured_rows():
    rows = {r[0]: r[2:] for r in parsers.json_rows('{"a": 1, // c\n "b": [true, {"x": null,},], "a": "2"}')}
    assert rows == {"": ("object", None, 1), "a": ("string", "2", 2), "b": ("array", None, 2), "b[0]": ("boolean", "true", 2), "b[1]": ("object", None, 2), "b[1].x": ("null", None, 2)}
    assert [r[2] for r in parsers.json_rows("")] == ["null"] and parsers.json_rows('{"a": ') and parsers.json_rows("[[[")
    rows = [(r[0], r[2], r[3]) for r in parsers.yaml_rows("on: push\nyes: &a no\nb: *a\nc: 0x1F\nd: 2020-01-01\nl: [1, {k: v}]\nb: 2\n---\nz: 1\n")]
    assert rows == [("", "object", None), ("on", "string", "push"), ("yes", "string", "no"), ("b", "null", None), ("c", "number", "0x1F"), ("d", "string", "2020-01-01"), ("l", "array", None), ("l[0]", "number", "1"), ("l[1]", "object", None), ("l[1].k", "string", "v"), ("b", "number", "2")]
    assert parsers.yaml_rows("a: [") and extract.redact("DB_PASSWORD", "x") == "[redacted]" and extract.redact("host", "y" * 300) == "y" * 200


def test_prisma_and_code():
    assert parsers.prisma('datasource db {\n provider = "mysql"\n}\nmodel User {\n id Int\n @@map("users")\n}\nmodel Log {\n}') == {"provider": "mysql", "models": {"User": "users", "Log": "Log"}}
    t = parsers.code_tokens("import a, { b as c } from 'm'; export * from './n'; const x = require('k'); a.b(`t ${y} u`, 2); new Z()")
    assert [(i["kind"], i["module"], i["names"]) for i in parsers.imports(t)] == [("import", "m", [("a", "a"), ("b", "c")]), ("export", "./n", []), ("import", "k", [])]
    assert [(n, len(a), before) for n, a, _, before in parsers.calls(t)] == [(["require"], 1, "="), (["a", "b"], 2, ";"), (["Z"], 0, "new")]
    assert [x.value for x in t if x.kind == "tpl"] == ["t \0 u"]


def test_paths(spark):
    cases = {
        "src/a.ts": ("code", None, "typescript", ".ts"), "vendor/a.ts": ("vendor", None, "typescript", ".ts"), "a/gen/b.py": ("generated", None, "python", ".py"), "package-lock.json": ("generated", "lockfile", None, ".json"), "x.d.ts": ("code", None, "typescript", ".d.ts"),
        "openapi.v3.yaml": ("schema", "api-spec", None, ".yaml"), "user.schema.json": ("schema", "json-schema", None, ".json"), ".github/workflows/ci.yml": ("configuration", "ci-workflow", None, ".yml"), ".env": ("configuration", "env", None, None), ".env.sample": ("configuration", "env-example", None, ".sample"),
        "Dockerfile.dev": ("configuration", "dockerfile", None, ".dev"), "vite.config.ts": ("code", "tooling-config", "typescript", ".ts"), "src/vite.config.ts": ("code", None, "typescript", ".ts"), "LICENSE": ("document", "documentation", None, None), "README.md": ("document", "readme", None, ".md"),
        "db/migrations/1.sql": ("database", "migration", None, ".sql"), "a.png": ("binary", None, None, ".png"), "odd": ("unknown", None, None, None), "tsconfig.base.json": ("configuration", "typescript-config", None, ".json"), "s.proto": ("schema", None, None, ".proto"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string").select("path", paths.classify(F.col("path")).alias("c"), paths.is_ignored(F.col("path")).alias("i"), paths.holds_secrets(F.col("path")).alias("s"))
    for r in df.collect():
        assert (r["c"]["category"], r["c"]["role"], r["c"]["language"], r["c"]["extension"]) == cases[r["path"]], r
        assert r["i"] == (r["path"] in ("vendor/a.ts", "package-lock.json")) and r["s"] == (r["path"] == ".env")


def test_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(text.resolve_relative(F.lit("a/b/c.md"), F.lit("../d/./e.md"))) == "a/d/e.md" and get(text.resolve_relative(F.lit("a.md"), F.lit("../x"))) is None and get(text.resolve_relative(F.lit("a/b.md"), F.lit("/x/y"))) == "x/y"
    assert get(text.normalize_route(F.lit("/a/:id/{x}/*?q=1"))) == "/a/{}/{}/{}" and get(text.slugify(F.lit(" Hello, World! a_b "))) == "hello-world-a_b"
    assert get(text.host_of(F.lit("HTTPS://u@Api.X.com:80/p"))) == "api.x.com" and get(text.host_of(F.lit("ftp://x"))) is None and get(text.is_placeholder(F.lit("a.LOCAL")))
    assert get(text.link_path(F.lit("a/b.md?x#y"))) == "a/b.md" and get(text.link_fragment(F.lit("a#y"))) == "y" and get(text.link_kind(F.lit("mailto:x"))) == "external"
    assert get(paths.ancestor_paths(F.lit("a/b/c"))) == ["a", "a/b"] and get(paths.directory_of(F.lit("a"))) == "" and get(paths.depth_of(F.lit("a/b"))) == 2
    assert get(evaluate.ordered_waypoints(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "bd")))) and not get(evaluate.ordered_waypoints(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "db"))))


def test_code_search_columns_are_utf16(spark):
    df = spark.createDataFrame([("a", "😀x needle needle\r\nno\n" + "y" * 500 + "needle")], "path string, text string")
    hits, total = code_search.search_page(df, "needle")
    assert [(r["line"], r["column"]) for r in hits.collect()] == [(1, 4), (1, 11), (3, 500)] and total.first()["total"] == 3
    assert all(len(r["window"]) <= 200 and "needle" in r["window"] for r in hits.collect())
    assert code_search.window_bounds(5000, around=(10, 12)) == code_search.Window(1, 24, 5000, False) and code_search.window_bounds(5000).truncated
    for bad in ("/a", "../a", "a/../b", "C:x", "a\0"):
        with pytest.raises(ValueError):
            code_search.safe_path(bad)
    assert code_search.safe_path("./a//b") == "a/b"


def test_scan_load_and_sinks(spark, tmp_path, graph):
    for p, t in FILES.items():
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text(t)
    root = str(tmp_path / "repo")
    found = {r["path"]: r["category"] for r in files.scan(spark, root).collect()}
    assert "dist/skip.js" not in found and found["src/repo.ts"] == "code" and found["db/migrations/1.sql"] == "database"
    loaded = {r["path"]: r["text"] for r in files.load(spark, root).collect()}
    assert loaded["README.md"] == FILES["README.md"] and len(files.load(spark, root, max_files=2).collect()) == 2
    store = str(tmp_path / "store")
    g = graph[0]
    first = sinks.replace_graph(g, store, "p")
    second = sinks.replace_graph(g, store, "p")
    assert first != second and sinks.read_graph(spark, store, "p").nodes.count() == g.nodes.count()
    assert sinks.delete_project(spark, store, "p")
    df = spark.createDataFrame([("b", {"z": "1", "a": "2"}), ("a", None)], "id string, meta map<string,string>")
    assert [r["json"] for r in sinks.stable_json(df).collect()] == ['{"id":"a"}', '{"id":"b","meta":{"a":"2","z":"1"}}']


def _message(*parts):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return out

    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            raw = value.encode() if isinstance(value, str) else b"".join(map(varint, value)) if isinstance(value, list) else value
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def test_index(spark, tmp_path):
    s = "scip-ts npm pkg 1.0 src/`a.ts`/A#"
    m, f = s + "run().", "scip-ts npm pkg 1.0 src/`b.ts`/help()."
    occ = lambda r, sym, roles=0, enc=None: (2, _message((1, r), (2, sym), (3, roles), *([(7, enc)] if enc else [])))
    a = _message((1, "src/a.ts"), occ([0, 6, 7], s, 1, [0, 0, 9, 1]), occ([1, 2, 5], m, 1, [1, 2, 4, 3]), occ([2, 4, 8], f), occ([7, 4, 8], f), occ([3, 1, 2], "local 1"), (3, _message((1, s), (5, 7), (4, _message((1, "scip-ts npm pkg 1.0 src/`b.ts`/I#"), (3, 1))))), (5, "ignored text"))
    b = _message((1, "src/b.ts"), (4, "TypeScript"), occ([0, 9, 13], f, 1, [0, 0, 2, 1]), occ([4, 9, 10], "scip-ts npm pkg 1.0 src/`b.ts`/I#", 1), (3, _message((1, "scip-ts npm pkg 1.0 src/`b.ts`/I#"), (5, 21))), (99, 5))
    raw = _message((1, _message((3, "file:///x"), (2, _message((1, "t"))))), (2, b), (2, a))
    (tmp_path / "index.scip").write_bytes(raw)
    assert [d["path"] for d in scip.decode_index(raw)["documents"]] == ["src/a.ts", "src/b.ts"]
    assert scip.parse_symbol(m) == [("src", "namespace"), ("a.ts", "namespace"), ("A", "type"), ("run", "method")] and scip.parse_symbol("local 3") == [] and scip.parse_symbol("broken") == []
    index = scip.read_index(spark, str(tmp_path / "index.scip")).cache()
    defs = {r["qualified_name"]: (r["node_type"], r["language"]) for r in index.filter("kind = 'definition'").collect()}
    assert defs == {"A": ("class", "typescript"), "A.run": ("method", "typescript"), "help": ("function", "TypeScript"), "I": ("interface", "TypeScript")}
    e = {(r["source_symbol"], r["relationship"], r["target_symbol"]) for r in scip.code_edges(index).collect()}
    assert e == {(m, "CALLS", f), (s, "CALLS", f), (None, "IMPORTS", "src/b.ts"), (s, "IMPLEMENTS", "scip-ts npm pkg 1.0 src/`b.ts`/I#")}


def test_merge_overlay(spark):
    cols = "id string, source_node string, relationship string, target_node string, seq int, occurrences long, extra string, source string, confidence string, method string, file string, line int, matched string"
    rows = [("e", "a", "USES", "b", 1, 1, "x", "s1", "medium", "ast", "f1", 7, "m"), ("e", "a", "USES", "b", 2, 2, "y", "s2", "medium", "sql", "f2", 8, None), ("e", "a", "USES", "b", 3, 1, "z", "s3", "high", None, "f3", None, None)]
    r = merge.merge_edges(spark.createDataFrame(rows, cols)).first()
    assert (r["occurrences"], r["extra"], r["source"], r["confidence"], r["method"], r["file"], r["line"], r["matched"]) == (4, "x", "s3", "high", "ast", "f3", 7, "m")


def test_control_decisions(spark):
    assert [control.freshness(*x) for x in ((False, True, 0), (True, False, 0), (True, True, 2), (True, True, 0))] == ["not_indexed", "unknown", "stale", "current"]
    assert [control.index_decision(*x) for x in ((True, "stale"), (False, "current"), (False, "current", True), (False, "stale"))] == ["already_indexing", "up_to_date", "started", "started"]
    m = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, content_hash string")
    assert control.manifest_digest(m).first()["digest"] == control.manifest_digest(m.repartition(2)).first()["digest"]
    assert status.coalesced([(0, "a", 0), (0.1, "a", 1), (0.2, "b", 0), (0.7, "b", 1)]) == [(0, "a", 0), (0.2, "b", 0), (0.7, "b", 1)]


def test_status_stream(spark, tmp_path):
    d = str(tmp_path / "in")
    spark.createDataFrame([(1, "QUEUED", "2024-01-01 00:00:00"), (1, "COMPLETED", "2024-01-01 00:05:00"), (2, "FAILED", "2024-01-01 00:01:00")], "project_id int, status string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(d)
    stream = spark.readStream.schema(spark.read.parquet(d).schema).parquet(d)
    q = status.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest_status").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert {(r["project_id"], r["status"]) for r in spark.sql("SELECT * FROM latest_status").collect()} == {(1, "COMPLETED"), (2, "FAILED")}
    finally:
        q.stop()


def test_builders_clients_and_decorators(spark):
    code = """@UseGuards(AdminGuard)
@Controller('users')
export class UserController {
  @Get(':id')
  @UseGuards(AuthGuard)
  show(id) { return db.with('recent', q).selectFrom('recent').innerJoin('public.teams as t', 'a', 'b'); }
  @Post()
  make() { this.prisma.userAccount.create({}); db.updateTable('plans').set({}); db.selectFrom(name); }
}
class AuthGuard {}
class AdminGuard {}
"""
    files_ = spark.createDataFrame([("src/u.ts", code), ("db/schema.prisma", 'datasource d {\n provider = "postgres"\n}\nmodel UserAccount {\n @@map("accounts")\n}\n'), ("package.json", '{"dependencies": {"mysql2": "1", "express": "4"}}'), ("x.ts", "import m from 'mongoose';")], "path string, text string")
    e = named(extract.assemble(files_)[0])
    want = {("u.ts", "CONTAINS", "GET /users/:id"), ("GET /users/:id", "ROUTES_TO", "show"), ("GET /users/:id", "AUTHENTICATED_BY", "AuthGuard"), ("GET /users/:id", "AUTHENTICATED_BY", "AdminGuard"), ("POST /users", "ROUTES_TO", "make"), ("POST /users", "AUTHENTICATED_BY", "AdminGuard"), *((a, r, b) for a, r, b in (("show", "READS_FROM", "teams"), ("make", "WRITES_TO", "plans"), ("make", "WRITES_TO", "accounts")) for a in (a, "UserController")), ("schema.prisma", "DEFINES", "accounts")}
    assert want <= e, want - e
    assert not any(b == "recent" for _, _, b in e) and ("POST /users", "AUTHENTICATED_BY", "AuthGuard") not in e
    assert [tuple(r) for r in extract.database_provider(files_).collect()] == [("postgresql", "db/schema.prisma")]
    assert [tuple(r) for r in extract.database_provider(files_.filter("path <> 'db/schema.prisma'")).collect()] == [("mysql", "package.json:mysql2")]
    assert {r["framework"] for r in extract.frameworks(files_).collect()} == {"express", "mongoose"}


def test_sql_parsing_ends():
    for sql in ("", "select", "SELECT * FROM", "select select x from select", "ALTER TABLE t ADD COLUMN;", "create table t (", "from (select a", "update", "insert into 5", "delete from"):
        parsers.table_accesses(sql)
        parsers.sql_schema(sql)
    assert [x[:3] for x in parsers.table_accesses("SELECT a, * FROM t JOIN u ON 1; DELETE FROM v")] == [("t", "read", "SELECT"), ("u", "read", "JOIN"), ("v", "write", "DELETE")]


def test_long_import_lists_keep_their_module():
    names = [f"n{i}" for i in range(500)]
    for word in ("import", "export"):
        got = parsers.imports(parsers.code_tokens(f"{word} {{ {', '.join(names)} }} from './m'\nconst x = 'y'"))
        assert [(i["kind"], i["module"], len(i["names"])) for i in got] == [(word, "./m", 500)]
    assert parsers.imports(parsers.code_tokens("export { a, b }\nuse\n'strict'")) == []


def test_configuration_query_takes_every_event(spark, small):
    from quillgraph.plans import extraction_queries  # noqa: F401  (registers)
    from quillgraph.plans.registry import QUERIES

    got = Counter((r["file"], r["relationship"], r["matched"], r["line"]) for r in QUERIES["x08_configuration"](spark, small).collect())
    ids = [r["event_id"] for r in spark.read.parquet(f"{small}/events.parquet").select("event_id").collect()]
    assert max(ids) >= 500
    assert got == Counter((f"c/e{i}.json", "CONTAINS", m, n) for i in ids for m, n in (("k", 1), ("deep.x", 3)))
