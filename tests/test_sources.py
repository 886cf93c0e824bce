from __future__ import annotations

import ast
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import changes, resolve
from sparkloom.sources import diff, gitlog, pysource, scan
from sparkloom.streaming import incremental


def test_scan_keeps_odd_names(spark, tmp_path):
    for name, raw in {"pkg/__init__.py": b"", "pkg/_x.py": b"token = 'abc'", ".git/a.py": b"1", "a.bin": b"1", "README.MD": b"hi", "bad.py": b"\xff"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(raw)
    os.symlink(tmp_path / "README.MD", tmp_path / "link.md")
    got = {r.path: r for r in scan.scan(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["README.MD", "bad.py", "pkg/__init__.py", "pkg/_x.py"]
    assert bytes(got["pkg/_x.py"].content) == b"token = '[REDACTED]'" and bytes(got["bad.py"].content) == b"\xff" and got["pkg/__init__.py"].size == 0


def test_clone_guards(tmp_path):
    with pytest.raises(ValueError):
        scan.clone("file:///none", str(tmp_path / ".." / "out"), str(tmp_path))
    with pytest.raises(subprocess.SubprocessError):
        scan.clone("file:///does/not/exist", str(tmp_path / "x"), str(tmp_path), timeout=20)
    assert not (tmp_path / "x").exists()


def test_strict_json():
    assert scan.strict_json('{"a": [1, 2.5]}') == {"a": [1, 2.5]}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[Infinity]"):
        with pytest.raises(ValueError):
            scan.strict_json(bad)


def test_git_history(spark, tmp_path):
    git = lambda *a, **e: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=A@x.org", *a], check=True, capture_output=True, env=os.environ | e)
    git("init", "-q")
    for i, subject in enumerate(["start", "Fix the bug"]):
        (tmp_path / "a.py").write_text(str(i))
        (tmp_path / f"b{i} é.py").write_text("x")
        git("add", "-A")
        git("commit", "-q", "-m", subject, GIT_COMMITTER_DATE=f"2026-01-0{i + 1}T00:00:00Z", GIT_AUTHOR_DATE="2026-01-01T00:00:00Z")
    tracked, commits = gitlog.history(spark, str(tmp_path))
    assert tracked.count() == 3
    assert sorted((r.path, r.author, r.bugfix) for r in commits.collect()) == [("a.py", "a@x.org", False), ("a.py", "a@x.org", True), ("b0 é.py", "a@x.org", False), ("b1 é.py", "a@x.org", True)]


PATCH = """diff --git a/m.py b/m.py
index 1..2 100644
--- a/m.py
+++ b/m.py
@@ -1,3 +1,4 @@
 def f():
-    return 1
+    x = 2
+    return x
 # end
\\ No newline at end of file
diff --git a/old name.py b/new.py
similarity index 100%
rename from old name.py
rename to new.py
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git "a/\\303\\251.py" "b/\\303\\251.py"
new file mode 100644
--- /dev/null
+++ "b/\\303\\251.py"
@@ -0,0 +1 @@
+y
diff --git a/p.png b/p.png
Binary files a/p.png and b/p.png differ
"""


def test_diff_parser(spark):
    files = diff.parse(PATCH)
    assert [(f.status, f.old, f.new) for f in files] == [("MODIFIED", "m.py", "m.py"), ("RENAMED", "old name.py", "new.py"), ("REMOVED", "gone.py", None), ("ADDED", None, "é.py"), ("MODIFIED", "p.png", "p.png")]
    assert files[4].binary and [x[0] for x in files[0].lines] == [" ", "-", "+", "+", " "] and files[0].lines[-1][4] is False
    base, head = "def f():\n    return 1\n# end", "def f():\n    x = 2\n    return x\n# end"
    assert diff.applies(files[0], base, head) and not diff.applies(files[0], base, head + "\n") and not diff.applies(files[0], head, base)
    for bad in ("diff --cc a\n", "x\0", PATCH.replace("@@ -1,3 +1,4 @@", "@@ -1,9 +1,4 @@"), "diff --git a/../x b/../x\n"):
        with pytest.raises(diff.DiffError):
            diff.parse(bad)
    diff.register(spark)
    spark.createDataFrame([(PATCH,)], "text string").createOrReplaceTempView("patches")
    rows = spark.sql("SELECT d.* FROM patches, LATERAL parse_diff(text) d")
    assert rows.where("kind IN ('+', '-')").count() == 5 and rows.where("binary").count() == 1


CODE = '''"""doc"""
import os
class A:
    """about"""
    @property
    def p(self): return 1
    def m(self, x: int, /, y="a", *args, z=None, **kw) -> int:
        if x and y or z:
            return [i for i in args if i if i > 1]
        try:
            pass
        except ValueError:
            assert x
        match x:
            case 1 if y: pass
            case _: pass
        def inner():
            while True: pass
        return 0
def f(): return lambda: 1 if 2 else 3
'''


def test_python_symbols(spark):
    files = spark.createDataFrame([("a.py", bytearray(CODE.encode())), ("bad.py", bytearray(b"def")), ("x.txt", bytearray(b""))], "path string, content binary")
    rows = pysource.parse_files(files).collect()
    by = {r.qualname: r for r in rows if r.path == "a.py"}
    assert [(q, by[q].kind) for q in by] == [("A", "class"), ("A.p", "method"), ("A.m", "method"), ("A.m.inner", "function"), ("f", "function")]
    assert by["A.p"].start_line == 5 and by["A"].docstring == "about" and by["A"].complexity is None
    # if 1, bool operators 2, comprehension 1 + 2, except 1, assert 1, a case with its guard 2
    assert by["A.m"].complexity == 1 + 1 + 2 + 3 + 1 + 1 + 2 and by["A.m.inner"].complexity == 2 and by["f"].complexity == 1
    assert [(p["name"], p["kind"]) for p in by["A.m"].parameters][:3] == [("self", "POSITIONAL_ONLY"), ("x", "POSITIONAL_ONLY"), ("y", "POSITIONAL_OR_KEYWORD")]
    assert [r.path for r in rows if r.error] == ["bad.py"]


def test_routes_and_models():
    imports = "from fastapi import FastAPI\nfrom flask import Blueprint\nfrom sqlmodel import SQLModel\nimport sqlalchemy.orm as so\nBase = so.declarative_base()\n"
    body = ("app = FastAPI()\n@app.get('/u')\ndef a(): pass\n@app.post(x)\ndef b(): pass\nbp = Blueprint('x')\n@bp.route('/v', methods=['PUT', 'GET'])\ndef c(): pass\nclass M(SQLModel, table=True): pass\nclass N(Base):\n    __tablename__ = 'n'\n")
    assert pysource.routes(ast.parse(body)) == [] and pysource.models(ast.parse(body)) == []  # names that nothing verified brings in
    tree = ast.parse(imports + body)
    assert [(r["method"], r["route"], r["handler"]) for r in pysource.routes(tree)] == [("GET", "/u", "a"), ("PUT", "/v", "c"), ("GET", "/v", "c")]
    assert [(m["name"], m["framework"]) for m in pysource.models(tree)] == [("M", "SQLModel"), ("N", "SQLAlchemy")]


SOURCES = {
    "src/pkg/__init__.py": "from .core import Service\n",
    "src/pkg/core.py": "class Base:\n    def ping(self): pass\nclass Service(Base):\n    def __init__(self):\n        self.other = Base()\n    def run(self):\n        self.helper()\n        self.other.ping()\n        missing()\n    def helper(self): pass\ndef make() -> Service:\n    return Service()\n",
    "src/app.py": "import pkg.core\nfrom pkg import Service\nfrom pkg.core import make as build\ndef main(s: Service):\n    s.run()\n    build().helper()\n    x = Service()\n    x.run()\n    pkg.core.make()\n    for x2 in []: x2()\nif main:\n    def cond(): pass\ncond()\n",
    "src/twice.py": "def a(): pass\ndef a(): pass\na()\neval('1')\n",
    "src/test_app.py": "from app import main\ndef test_main():\n    main(None)\n",
}


@pytest.fixture(scope="module")
def resolved(spark):
    files = spark.createDataFrame([(1, p, bytearray(t.encode())) for p, t in SOURCES.items()], "repository_id long, path string, content binary")
    return files, resolve.resolve_references(files).persist()


def test_resolution(resolved):
    got = {(r.path.split("/")[-1], r.kind, r.expression): (r.status, r.targets[0].key.split('"')[3] if len(r.targets) == 1 and r.targets[0].key else len(r.targets)) for r in resolved[1].collect()}
    assert got["core.py", "base_class", "Base"] == ("EXACT", "Base")
    assert got["core.py", "call", "self.helper"] == ("INFERRED", "Service.helper") and got["core.py", "call", "self.other.ping"] == ("INFERRED", "Base.ping")
    assert got["core.py", "call", "missing"] == ("UNRESOLVED", 0)
    assert got["app.py", "call", "s.run"] == ("INFERRED", "Service.run") and got["app.py", "call", "build().helper"] == ("INFERRED", "Service.helper")
    assert got["app.py", "call", "x.run"] == ("INFERRED", "Service.run") and got["app.py", "call", "pkg.core.make"] == ("EXACT", "make")
    assert got["app.py", "call", "x2"] == ("UNRESOLVED", 0) and got["app.py", "call", "cond"] == ("UNRESOLVED", 0)
    assert got["app.py", "import", "pkg:Service"] == ("EXACT", "Service") and got["app.py", "import", "pkg.core"] == ("EXACT", 1)
    assert got["twice.py", "call", "a"][0] == "UNRESOLVED"  # eval makes the module's names uncertain


def test_graph_plan_and_test_links(spark, resolved):
    files, results = resolved
    symbols = pysource.parse_files(files)
    nodes, edges = changes.graph_plan(symbols, files, resolve.reference_edges(results))
    name = {r.symbol_id: (r.path, r.qualname) for r in nodes.collect()}
    found = {(name[r.src][1], name[r.dst][1], r.kind, r.confidence) for r in edges.collect()}
    assert ("Service", "Base", "INHERITS", 1.0) in found and ("main", "Service.run", "CALLS", 0.5) in found and ("test_main", "main", "CALLS", 1.0) in found
    links = resolve.test_links(nodes.where("kind != 'module'"), edges.where("kind = 'CALLS'").select("src", "dst", "confidence"))
    got = {(name[r.implementation][1], name[r.test][1], r.how, r.confidence) for r in links.collect()}
    assert ("main", "test_main", "direct", 1.0) in got and ("Service.run", "test_main", "two_hop", 0.4) in got


def test_symbol_changes_and_seeds(spark):
    frame = lambda t: pysource.parse_files(spark.createDataFrame([("m.py", bytearray(t.encode()))], "path string, content binary"))
    base = frame("def a(x): return 1\ndef b(): pass\ndef c(): pass\ndef d(): pass\ndef d(): pass\n")
    head = frame("def a(x, y): return 1\ndef b(): return 2\ndef e(): pass\ndef d(): pass\n")
    pairs = changes.pair_symbols(base, head)
    got = {r.qualname: (r.change, r.gap) for r in pairs.collect()}
    assert got == {"a": ("SIGNATURE_CHANGED", None), "b": ("BODY_CHANGED", None), "c": ("REMOVED", None), "e": ("ADDED", None), "d": (None, "AMBIGUOUS_SYMBOL_IDENTITY")}
    key = {r.qualname: r.head_key for r in pairs.collect()}
    bind = spark.createDataFrame([(key["a"], 7, "m.py", "function", "a")], "local_key string, symbol_id long, path string, kind string, qualname string")
    found, missing = changes.seeds(pairs, bind, "head")
    assert [r.symbol_id for r in found.collect()] == [7] and missing.count() == 2
    with pytest.raises(ValueError):
        changes.seeds(pairs, bind.withColumn("kind", F.lit("class")), "head")


@pytest.mark.parametrize("edit", [{"src/pkg/core.py": "class Base: pass\n"}, {"src/app.py": None}, {"src/new.py": "from pkg import Service\nService()\n"}])
def test_incremental_equals_fresh(spark, resolved, edit):
    after = {p: t for p, t in (SOURCES | edit).items() if t is not None}
    frame = lambda src: spark.createDataFrame([(1, p, bytearray(t.encode())) for p, t in src.items()], "repository_id long, path string, content binary")
    inventory = lambda f: f.select("path", F.sha2("content", 256).alias("hash"))
    new = frame(after)
    old_results, new_results = resolved[1], resolve.resolve_references(new)
    needs = lambda r: r.select("path", F.explode("targets").alias("t")).select("path", F.col("t.path").alias("needs")).where("path != needs")
    deps = needs(old_results).union(needs(new_results)).distinct()
    dirty, affected = incremental.update(inventory(resolved[0]), inventory(new), deps)
    assert {r.path for r in dirty.collect()} == set(edit)
    ends = ["src_path", "src_key", "dst_path", "dst_key", "kind", "confidence"]
    fresh = resolve.reference_edges(new_results).select(*ends)
    kept = resolve.reference_edges(old_results).join(affected.select(F.col("path").alias("src_path")), "src_path", "left_anti").select(*ends)
    redone = fresh.join(affected.select(F.col("path").alias("src_path")), "src_path", "left_semi").select(*ends)
    assert sorted(map(str, kept.union(redone).collect())) == sorted(map(str, fresh.collect()))


def test_inventory_stream(spark, tmp_path):
    folder, state, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    schema = "path string, hash string, seen long"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema).write.parquet(f"{folder}/x", mode="append")
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    incremental.inventory_stream(spark, folder, state, mark).awaitTermination()
    spark.createDataFrame([("a", "2", 2)], schema).coalesce(1).write.mode("append").parquet(folder)
    incremental.inventory_stream(spark, folder, state, mark).awaitTermination()
    assert sorted((r.path, r.hash) for r in incremental.latest_state(spark, state).collect()) == [("a", "2"), ("b", "1")]


def test_windowed_churn(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-01-01 00:00:00", "x", True), ("a", "2026-01-02 00:00:00", "y", False)], "path string, t string, author string, bugfix boolean").select("path", F.to_timestamp("t").alias("ts"), "author", "bugfix")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_churn(stream, 2).writeStream.format("memory").queryName("churned").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT max(commit_count) AS n, max(bugfix_commits) AS b FROM churned").first().asDict() == {"n": 2, "b": 1}


def test_a_broken_diff_is_a_row(spark):
    from sparkloom.sources import diff

    diff.register(spark)
    good = "--- a/m.py\n+++ b/m.py\n@@ -1,1 +1,1 @@\n-x\n+y\n"
    spark.createDataFrame([(1, good), (2, "--- a/m\n+++ b/m\n@@ -1,9 +1,9 @@\n-x\n"), (3, None)], "i int, t string").createOrReplaceTempView("mixed_patches")
    rows = spark.sql("SELECT p.i, l.kind, l.error FROM mixed_patches p, LATERAL parse_diff(p.t) l").collect()
    assert sorted((r.i, r.kind) for r in rows if r.error is None) == [(1, "+"), (1, "-")] and [(r.i, r.error) for r in rows if r.error] == [(2, "a hunk is cut off")]


def test_modules_of_one_name_are_rows_with_an_error(spark):
    from sparkloom.operators.resolve import reference_edges, resolve_references

    files = [(1, "a.py", b"def f(): pass\n"), (1, "src/a.py", b"def f(): pass\n"), (1, "b.py", b"from a import f\nfrom c import g\nf()\n"), (1, "c.py", b"def g(): pass\ng()\n"), (1, "bad.py", b"def (\n")]
    rows = resolve_references(spark.createDataFrame(files, "repository_id long, path string, content binary")).collect()
    assert {r.path for r in rows if r.error} == {"a.py", "src/a.py", "bad.py"} and all(r.status is None for r in rows if r.error)
    by = {(r.path, r.expression): r.status for r in rows if not r.error}
    assert by["b.py", "a:f"] == "UNRESOLVED" and by["b.py", "c:g"] == "EXACT" and by["c.py", "g"] == "EXACT"
    assert reference_edges(spark.createDataFrame(rows, resolve_references(spark.createDataFrame(files, "repository_id long, path string, content binary")).schema)).count() >= 2


def test_receivers_written_twice_have_no_routes():
    import ast

    from sparkloom.sources.pysource import name_writes, routes

    once = "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/a')\ndef a(): pass\n"
    assert [r["route"] for r in routes(ast.parse(once))] == ["/a"] and routes(ast.parse(once + "app = None\n")) == [] and routes(ast.parse(once + "for app in []: pass\n")) == []
    tree = ast.parse("import a.b, c as d\nfrom e import *\nfrom e import f\nif x:\n    f = g = 1\ntry:\n    del g\nfinally:\n    pass\ndef f(): h = 1\nclass K:\n    m = 1\n[i for i in y]\n")
    assert name_writes(tree) == {"a": 1, "d": 1, "f": 3, "g": 2, "K": 1, "i": 1}


def test_shapes_of_sources():
    """References of 36 small sources, by hand: frames, branches, members, types."""
    from sparkloom.operators.resolve import Repository
    from sparkloom.plans.shapes import SHAPES

    for source, wanted in SHAPES:
        got = [(r["kind"], r["expression"], r["line"], r["status"]) for r in Repository({"src/p.py": source.encode()}).results()]
        assert sorted(got) == sorted(wanted), source


def test_model_uses_and_dependents(spark):
    from sparkloom.operators.resolve import dependents, model_uses, resolve_references

    files = [(1, "m.py", b"class Item: pass\nclass Plain: pass\n"), (1, "u.py", b"from m import Item, Plain\ndef f():\n    Item()\n    Plain()\nItem()\nItem()\n")]
    results = resolve_references(spark.createDataFrame(files, "repository_id long, path string, content binary"))
    models = spark.createDataFrame([("m.py", '["class", "Item", 1]')], "path string, key string")
    got = {(r.src_path, r.src_key, r.dst_path): (r.kind, r.confidence, len(r.references)) for r in model_uses(results, models).collect()}
    assert got == {("u.py", '["function", "f", 2]', "m.py"): ("USES", 1.0, 1), ("u.py", None, "m.py"): ("USES", 1.0, 2)}
    assert [(r.path, r.needs) for r in dependents(results).collect()] == [("u.py", "m.py")]


def test_symbol_diff_gaps():
    from sparkloom.operators.changes import diff_symbols

    base = {"m.py": b"class A:\n    def m(self): pass; x = 1\n", "l.py": b"x"}
    patch = "--- a/m.py\n+++ b/m.py\n@@ -2 +2 @@\n-    def m(self): pass; x = 1\n+    def m(self, y): pass\n"
    head = {"m.py": b"class A:\n    def m(self, y): pass\n"}
    assert [(r["qualname"], r["change"]) for r in diff_symbols(patch, base, head)] == [("A.m", "SIGNATURE_CHANGED")]
    assert [r["code"] for r in diff_symbols(patch, base, head, most=10)] == ["SOURCE_BUDGET_EXCEEDED"] * 2
    assert [r["code"] for r in diff_symbols("@@@ x", {}, {})] == ["SOURCE_PARSE_ERROR"]
    link = "diff --git a/l.py b/l.py\nold mode 120000\nnew mode 120000\n--- a/l.py\n+++ b/l.py\n@@ -1 +1 @@\n-x\n+y\n"
    assert [r["code"] for r in diff_symbols(link, base, {"l.py": b"y"})] == ["NON_SOURCE_ENTRY"]
    two = "--- a/t.py\n+++ b/t.py\n@@ -1 +1 @@\n-def f(): pass; g = lambda: 1\n+def f(): ...\n"
    assert [r.get("change") for r in diff_symbols(two, {"t.py": b"def f(): pass; g = lambda: 1\n"}, {"t.py": b"def f(): ...\n"})] == ["BODY_CHANGED"]


def test_endpoints_are_parts_of_the_graph(spark):
    from sparkloom.operators.changes import graph_plan

    code = b"from fastapi import APIRouter as R\nfrom sqlalchemy.orm import DeclarativeBase\nr = R()\n@r.get('/x')\ndef x(): pass\nclass Base(DeclarativeBase): pass\nclass T(Base):\n    __tablename__ = 't'\nclass U(Base): pass\nclass V(Base):\n    __tablename__ = name()\n"
    files = spark.createDataFrame([("a.py", code), ("bad.py", b"def")], "path string, content binary")
    found = pysource.detect_frameworks(files)
    assert {(r.path, r.part, r.name) for r in found.collect()} == {("a.py", "endpoint", "GET /x"), ("a.py", "model", "t"), ("bad.py", None, None)}
    nodes, drafts = pysource.endpoint_graph(found)
    all_nodes, edges = graph_plan(pysource.parse_files(files), files.select("path"), drafts, nodes)
    name = {r.symbol_id: (r.kind, r.name) for r in all_nodes.collect()}
    assert {(name[e.src], e.kind, name[e.dst]) for e in edges.collect()} == {(("module", "a.py"), "EXPOSES", ("endpoint", "GET /x")), (("endpoint", "GET /x"), "CALLS", ("function", "x"))}


def test_inventories_are_put_together(spark, tmp_path):
    import os

    folder, state, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    for n in range(5):
        spark.createDataFrame([("a", str(n), n), (f"p{n}", "x", n)], "path string, hash string, seen long").coalesce(1).write.mode("append").parquet(folder)
        incremental.inventory_stream(spark, folder, state, mark, compact=2).awaitTermination()
        got = {r.path: r.hash for r in incremental.latest_state(spark, state).collect()}
        assert got == {"a": str(n), **{f"p{i}": "x" for i in range(n + 1)}}
    assert sum(x.startswith("delta=") for x in os.listdir(state)) <= 2 and sum(x.startswith("base=") for x in os.listdir(state)) <= 2


def test_golden_import_twice(spark, tmp_path):
    import json

    from sparkloom.sources.scan import import_golden

    doc = {"files": [{"id": 1, "repository_id": 4, "path": "a.py"}], "symbols": [{"id": 10, "file_id": 1, "name": "f"}, {"id": 11, "file_id": 1, "name": "g"}], "edges": [{"id": 5, "source_symbol_id": 10, "target_symbol_id": 11, "kind": "CALLS"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    out = str(tmp_path / "out")
    for _ in range(2):
        import_golden(spark, str(tmp_path / "g.json"), out)
    assert [spark.read.parquet(f"{out}/{t}").count() for t in ("files", "symbols", "edges")] == [1, 2, 1]
    doc["symbols"].pop(), doc["edges"].clear()
    (tmp_path / "g.json").write_text(json.dumps(doc | {"edges": [{"id": 6, "source_symbol_id": 10, "target_symbol_id": 10, "kind": "USES"}]}))
    import_golden(spark, str(tmp_path / "g.json"), out)
    assert [r.kind for r in spark.read.parquet(f"{out}/edges").collect()] == ["USES"] and spark.read.parquet(f"{out}/symbols").count() == 1
