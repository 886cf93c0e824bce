"""Python sources read with the standard ast module: symbols, parameters, complexity, references, routes, models.

Each file is read on its own, so a plain Arrow batch of files is the unit of work; what needs a
whole repository is in resolve.py.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLABLES = (ast.FunctionDef, ast.AsyncFunctionDef)
DEFINITIONS = (*CALLABLES, ast.ClassDef)
ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "head", "options")


class SourceError(ValueError):
    """The file can't be read as Python."""


def read(raw: bytes) -> ast.Module:
    try:
        return ast.parse(raw.decode("utf-8-sig"))
    except (UnicodeDecodeError, SyntaxError, ValueError) as e:
        raise SourceError(str(e)) from e


def complexity(node: ast.AST) -> int:
    """1 and one for each decision of a callable's own body; nested scopes, headers and decorators don't count."""
    total = 1
    stack = list(node.body)
    while stack:
        n = stack.pop()
        if isinstance(n, (*DEFINITIONS, ast.Lambda)):
            continue
        if isinstance(n, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            total += 1 + len(n.ifs)
        elif isinstance(n, ast.match_case):
            total += (not (n.guard is None and _matches_all(n.pattern))) + (n.guard is not None)
        stack += ast.iter_child_nodes(n)
    return total


def _matches_all(p: ast.pattern) -> bool:
    if isinstance(p, ast.MatchAs):
        return p.pattern is None or _matches_all(p.pattern)
    return isinstance(p, ast.MatchOr) and any(map(_matches_all, p.patterns))


def parameters(args: ast.arguments) -> list[dict]:
    """In order of the signature: name, kind, annotation, default (as text)."""
    src = lambda x: None if x is None else ast.unparse(x)
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    out = [(a, "POSITIONAL_ONLY" if i < len(args.posonlyargs) else "POSITIONAL_OR_KEYWORD", d) for i, (a, d) in enumerate(zip(plain, defaults))]
    out += [(args.vararg, "VAR_POSITIONAL", None)] if args.vararg else []
    out += [(a, "KEYWORD_ONLY", d) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    out += [(args.kwarg, "VAR_KEYWORD", None)] if args.kwarg else []
    return [{"name": a.arg, "kind": k, "annotation": src(a.annotation), "default": src(d)} for a, k, d in out]


def symbols(tree: ast.Module, raw: bytes) -> list[dict]:
    """Classes, functions and methods in order: local key, parent, lines (decorators included), signature, docstring, digests."""
    rows = raw.decode("utf-8-sig").splitlines(keepends=True)
    out: list[dict] = []

    def visit(body, scope: list[tuple[str, bool]], parent: str | None):
        for n in body:
            if isinstance(n, DEFINITIONS):
                is_class = isinstance(n, ast.ClassDef)
                kind = "class" if is_class else "method" if scope and scope[-1][1] else "function"
                qual = ".".join([*[s for s, _ in scope], n.name])
                first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
                key = json.dumps([kind, qual, first])
                header = ast.dump(ast.ClassDef(n.name, n.bases, n.keywords, [], n.decorator_list, [])) if is_class else ast.dump(ast.FunctionDef(n.name, n.args, [], n.decorator_list, n.returns, None, [])) + type(n).__name__
                text = "".join(rows[first - 1 : n.end_lineno])
                sign = f"class {n.name}({', '.join(map(ast.unparse, [*n.bases, *n.keywords]))})" if is_class else f"{'async ' * isinstance(n, ast.AsyncFunctionDef)}def {n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                out.append({"local_key": key, "parent_key": parent, "name": n.name, "qualname": qual, "kind": kind, "start_line": first, "end_line": n.end_lineno, "signature": sign, "docstring": ast.get_docstring(n), "complexity": None if is_class else complexity(n), "parameters": [] if is_class else parameters(n.args), "header_digest": hashlib.sha256(header.encode()).hexdigest(), "content_digest": hashlib.sha256(text.encode()).hexdigest(), "text": text})
                visit(n.body, [*scope, (n.name, is_class)], key)
            else:
                for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                    visit(getattr(n, field, []) if isinstance(getattr(n, field, []), list) else [], scope, parent)

    visit(tree.body, [], None)
    return out


PARAMS = "array<struct<name:string,kind:string,annotation:string,default:string>>"
SYMBOLS = f"path string, local_key string, parent_key string, name string, qualname string, kind string, start_line int, end_line int, signature string, docstring string, complexity int, parameters {PARAMS}, header_digest string, content_digest string, text string, error string"


def parse_files(files: DataFrame) -> DataFrame:
    """A row a symbol of files (path, content); a file that can't be read is one row with its error."""
    names = [c.split(" ")[0] for c in SYMBOLS.replace("name:string,kind:string,annotation:string,default:string", "").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    rows += [{"path": path, "error": None, **s} for s in symbols(read(bytes(raw)), bytes(raw))]
                except (SourceError, RecursionError) as e:
                    rows.append({"path": path, "error": str(e)})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None) if rows else pd.DataFrame(columns=names)

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, SYMBOLS)


def name_writes(tree: ast.Module) -> Counter:
    """How often each name is written in the module's own scope: imports, definitions, assignments and deletions, also inside
    its statements; bodies of functions and classes have scopes of their own. Star imports name nothing."""
    out: Counter = Counter()
    todo: list[ast.AST] = list(tree.body)
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Import):
            out.update(a.asname or a.name.partition(".")[0] for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            out.update(a.asname or a.name for a in n.names if a.name != "*")
        elif isinstance(n, DEFINITIONS):
            out[n.name] += 1
        else:
            if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load):
                out[n.id] += 1
            todo.extend(ast.iter_child_nodes(n))
    return out


def module_names(files: DataFrame) -> DataFrame:
    """path, name, writes, error: name_writes() of each file; a file that can't be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    rows += [(path, k, n, None) for k, n in sorted(name_writes(read(bytes(raw))).items())]
                except (SourceError, RecursionError) as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "name", "writes", "error"]).astype(object)

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, "path string, name string, writes long, error string")


def imported(tree: ast.Module) -> dict[str, str]:
    """What a module's names stand for, of those that absolute imports bind and nothing else writes."""
    writes, out = name_writes(tree), {}
    todo: list[ast.AST] = list(tree.body)
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Import):
            out |= {a.asname or a.name.partition(".")[0]: a.name if a.asname else a.name.partition(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            out |= {a.asname or a.name: f"{n.module}.{a.name}" for a in n.names if n.level == 0 and n.module}
        elif not isinstance(n, DEFINITIONS):
            todo.extend(ast.iter_child_nodes(n))
    return {k: v for k, v in out.items() if writes[k] == 1}


def _stands_for(node: ast.expr, known: dict[str, str]) -> str | None:
    """The dotted name that an expression of names stands for, by the module's imports."""
    head, _, rest = ast.unparse(node).partition(".") if isinstance(node, (ast.Name, ast.Attribute)) else ("", "", "")
    return None if head not in known else f"{known[head]}.{rest}" if rest else known[head]


# What makes a receiver of routes, a table's base, a base's maker; routes of all methods.
RECEIVERS = {"fastapi.FastAPI": "FastAPI", "fastapi.APIRouter": "FastAPI", "flask.Flask": "Flask", "flask.Blueprint": "Flask"}
BASES = {"sqlmodel.SQLModel": "SQLModel", "sqlalchemy.orm.DeclarativeBase": "SQLAlchemy"}
BASE_MAKERS = ("sqlalchemy.orm.declarative_base", "sqlalchemy.ext.declarative.declarative_base")


def routes(tree: ast.Module) -> list[dict]:
    """Endpoints of module-level receivers: method, route, handler. Only literal routes and methods are taken, and only receivers
    that a verified import makes and nothing else writes."""
    known, writes = imported(tree), name_writes(tree)
    receivers: dict[str, str] = {}
    for n in tree.body:
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            made = RECEIVERS.get(_stands_for(n.value.func, known) or "")
            if made and writes[n.targets[0].id] == 1:
                receivers[n.targets[0].id] = made
    out = []
    for n in tree.body:
        if not isinstance(n, CALLABLES):
            continue
        for d in n.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in receivers and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
                continue
            framework, methods = receivers[d.func.value.id], []
            if d.func.attr in ROUTE_METHODS:
                methods = [d.func.attr]
            elif d.func.attr in ("route", "api_route"):
                given = next((k.value for k in d.keywords if k.arg == "methods"), None)
                if given is None:
                    methods = ["get"] if framework == "Flask" else []
                elif isinstance(given, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in given.elts):
                    methods = [e.value for e in given.elts]
            out += [{"method": m.upper(), "route": d.args[0].value, "handler": n.name, "line": min([n.lineno, *[x.lineno for x in n.decorator_list]]), "framework": framework} for m in methods]
    return out


def models(tree: ast.Module) -> list[dict]:
    """Module-level classes that are tables: of SQLModel's family with table=True, or of SQLAlchemy's with a literal __tablename__.

    A family is that of a verified import, of a base that an imported maker makes, or of a class of the module before it.
    """
    known, writes = imported(tree), name_writes(tree)
    family: dict[str, str] = {}
    out = []
    for n in tree.body:
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            if _stands_for(n.value.func, known) in BASE_MAKERS and writes[n.targets[0].id] == 1:
                family[n.targets[0].id] = "SQLAlchemy"
        if not isinstance(n, ast.ClassDef):
            continue
        found = {f for b in n.bases if (f := BASES.get(_stands_for(b, known) or "") or (family.get(b.id) if isinstance(b, ast.Name) else None))}
        if len(found) != 1:  # none, or two that don't go together
            continue
        own = found.pop()
        if writes[n.name] == 1:
            family[n.name] = own
        table = any(k.arg == "table" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords)
        named = None
        for s in n.body:
            target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
            if isinstance(target, ast.Name) and target.id == "__tablename__":
                named = s.value.value if isinstance(s.value, ast.Constant) and isinstance(s.value.value, str) else None
        if table if own == "SQLModel" else named:
            first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
            out.append({"name": n.name, "table": named or n.name.lower(), "framework": own, "bases": [ast.unparse(b) for b in n.bases], "key": json.dumps(["class", n.name, first])})
    return out


FRAMEWORKS = "path string, part string, key string, name string, framework string, handler_key string, line int, error string"


def detect_frameworks(files: DataFrame) -> DataFrame:
    """Endpoints (part `endpoint`: name is method and route, handler_key its function) and tables (part `model`: key is the class) of files;
    a file that can't be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    tree = read(bytes(raw))
                    for r in routes(tree):
                        rows.append((path, "endpoint", json.dumps(["endpoint", r["method"], r["route"], r["line"]]), f"{r['method']} {r['route']}", r["framework"], json.dumps(["function", r["handler"], r["line"]]), r["line"], None))
                    rows += [(path, "model", m["key"], m["table"], m["framework"], None, None, None) for m in models(tree)]
                except (SourceError, RecursionError) as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FRAMEWORKS.split(", ")]).astype(object)
            yield frame.where(frame.notna(), None)

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, FRAMEWORKS)


def endpoint_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, drafts) of detected endpoints, as graph_plan() takes them: the module exposes an endpoint, which calls its handler."""
    ends = found.where("part = 'endpoint'")
    nodes = ends.select("path", "key", "name", F.lit(None).cast("string").alias("qualname"), F.lit("endpoint").alias("kind"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    draft = lambda src, dst, kind: ends.select(F.col("path").alias("src_path"), src.alias("src_key"), F.col("path").alias("dst_path"), dst.alias("dst_key"), F.lit(kind).alias("kind"), F.lit(1.0).alias("confidence"), F.array("key").alias("references"))
    return nodes, draft(F.lit(None).cast("string"), F.col("key"), "EXPOSES").union(draft(F.col("key"), F.col("handler_key"), "CALLS"))
