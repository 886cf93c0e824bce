"""References to symbols: names, imports, members and simple types, a repository at a time.

A repository is the unit because imports lead through all its modules; one group of applyInPandas
holds its sources. Rules are sound rather than complete: what a rule doesn't cover is UNRESOLVED.
"""

from __future__ import annotations

import ast
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.pysource import CALLABLES, DEFINITIONS, SourceError, read, symbols

EXACT, INFERRED, AMBIGUOUS, UNRESOLVED = "EXACT", "INFERRED", "AMBIGUOUS", "UNRESOLVED"
CONFIDENCE = {EXACT: 1.0, INFERRED: 0.5}
EDGE_OF = {"call": "CALLS", "import": "IMPORTS", "base_class": "INHERITS"}
#: Calls that make a namespace's names uncertain.
DYNAMIC = {"exec", "eval", "globals", "locals", "vars", "setattr", "delattr"}
PLAIN_DECORATORS = {"staticmethod", "classmethod", "dataclass", "dataclasses.dataclass", "abstractmethod", "abc.abstractmethod"}
DEPTH = 24
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def module_name(path: str, roots: tuple[str, ...] = ("src/",)) -> str:
    for r in roots:
        path = path.removeprefix(r)
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


@dataclass
class Event:
    kind: str  # definition, import, or other (parameters, assignments, loops, ...)
    line: int
    maybe: bool  # even where its statement runs, it may not be bound (a walrus, a pattern, a handler's name)
    node: object = None
    target: tuple[str, str | None] | None = None  # module, member
    value: ast.expr | None = None
    path: tuple = ()  # branches it lies in: (statement, label, whether other labels exclude it)

    def established(self, path: tuple) -> bool:
        """Whether it has run wherever a reference in these branches runs."""
        return not self.maybe and path[: len(self.path)] == self.path

    def excluded(self, path: tuple) -> bool:
        """Whether it lies in another branch of an `if` than the reference."""
        mine = {statement: label for statement, label, only in self.path if only}
        return any(mine.get(statement, label) != label for statement, label, _ in path)


@dataclass
class Scope:
    kind: str  # module, class, function
    node: ast.AST
    parent: Scope | None
    key: str | None  # of the symbol that owns it
    names: dict[str, list[Event]] = field(default_factory=dict)
    inner: dict[ast.AST, Scope] = field(default_factory=dict)
    uncertain: bool = False
    globals_: set[str] = field(default_factory=set)

    def frame(self) -> Scope:
        """The scope whose code runs this one's: bodies of classes and comprehensions run with what is around them."""
        s = self
        while s.parent is not None and not isinstance(s.node, (*CALLABLES, ast.Lambda)):
            s = s.parent
        return s


class Module:
    def __init__(self, path: str, raw: bytes):
        self.path, self.name, self.package = path, module_name(path), path.endswith("__init__.py")
        self.tree = read(raw)
        self.symbols = symbols(self.tree, raw)
        by_line = {(s["qualname"], s["start_line"]): s for s in self.symbols}
        self.by_key = {s["local_key"]: s for s in self.symbols}
        self.references: list[tuple[str, Scope, ast.AST, str, int, tuple]] = []
        self.branches: tuple = ()  # branches that the walk is in; none in a function's body, which runs some other time
        self.scope = Scope("module", self.tree, None, None)
        self._find = lambda qual, n: by_line.get((qual, min([n.lineno, *[d.lineno for d in n.decorator_list]])))
        self._body(self.tree.body, self.scope, "")

    def _branch(self, body: list[ast.stmt], s: Scope, prefix: str, label: tuple):
        self.branches, before = (*self.branches, label), self.branches
        self._body(body, s, prefix)
        self.branches = before

    def _later(self, run):
        """What a function's body does: outside of the branches around its definition."""
        self.branches, before = (), self.branches
        run()
        self.branches = before

    def _event(self, s: Scope, name: str, e: Event):
        e.path = self.branches
        s.names.setdefault(name, []).append(e)

    def _imports(self, n, s: Scope):
        if isinstance(n, ast.Import):
            for a in n.names:
                self._event(s, a.asname or a.name.split(".")[0], Event("import", n.lineno, False, n, (a.name if a.asname else a.name.split(".")[0], None)))
                self.references.append(("import", s, n, a.name, n.lineno, self.branches))
            return
        base = n.module or ""
        if n.level:
            parts = self.name.split(".") if self.name else []
            parts = parts[: len(parts) - n.level + (1 if self.package else 0)] if n.level - self.package <= len(parts) else None
            base = None if parts is None else ".".join([*parts, *([n.module] if n.module else [])])
        for a in n.names:
            if a.name == "*" or base is None:
                s.uncertain |= a.name == "*"
                continue
            self._event(s, a.asname or a.name, Event("import", n.lineno, False, n, (base, a.name)))
            self.references.append(("import", s, n, f"{base}:{a.name}", n.lineno, self.branches))

    def _targets(self, t: ast.expr, s: Scope, line: int, value=None, maybe: bool = False):
        if isinstance(t, ast.Name):
            where = s
            if t.id in s.globals_:
                while where.parent:
                    where = where.parent
            self._event(where, t.id, Event("other", line, maybe, t, None, value))
        elif isinstance(t, (ast.Tuple, ast.List)):
            for e in t.elts:
                self._targets(e, s, line, None, maybe)
        elif isinstance(t, ast.Starred):
            self._targets(t.value, s, line, None, maybe)
        else:
            self._expr(t, s)

    def _expr(self, n: ast.AST | None, s: Scope):
        if n is None:
            return
        if isinstance(n, ast.Lambda):
            own = Scope("function", n, s, s.key)
            for a in ast.walk(n.args):
                if isinstance(a, ast.arg):
                    self._event(own, a.arg, Event("other", n.lineno, False, a))
            self._later(lambda: self._expr(n.body, own))
            return
        if isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            own = Scope("function", n, s, s.key)
            for i, g in enumerate(n.generators):
                self._expr(g.iter, own if i else s)
                self._targets(g.target, own, n.lineno)
                for c in g.ifs:
                    self._expr(c, own)
            for f in ("elt", "key", "value"):
                self._expr(getattr(n, f, None), own)
            return
        if isinstance(n, ast.NamedExpr):
            self._expr(n.value, s)
            where = s
            while isinstance(where.node, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                where = where.parent
            self._targets(n.target, where, n.lineno, None, True)
            return
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name) and n.func.id in DYNAMIC:
                s.uncertain = True
            self.references.append(("call", s, n.func, ast.unparse(n.func), n.lineno, self.branches))
        for c in ast.iter_child_nodes(n):
            self._expr(c, s)

    def _body(self, body: list[ast.stmt], s: Scope, prefix: str):
        for n in body:
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                self._imports(n, s)
            elif isinstance(n, DEFINITIONS):
                for d in n.decorator_list:
                    self._expr(d, s)
                qual = f"{prefix}{n.name}"
                sym = self._find(qual, n)
                key = sym["local_key"] if sym else None
                self._event(s, n.name, Event("definition", n.lineno, False, n))
                own = s.inner[n] = Scope("class" if isinstance(n, ast.ClassDef) else "function", n, s, key)
                if isinstance(n, ast.ClassDef):
                    for b in n.bases:
                        self.references.append(("base_class", Scope("ref", n, s, key), b, ast.unparse(b), n.lineno, self.branches))
                        self._expr(b, s)
                else:
                    a = n.args
                    for d in [*a.defaults, *a.kw_defaults]:
                        self._expr(d, s)
                    self._later(lambda: self._function(n, own, qual + "."))
                    continue
                self._body(n.body, own, qual + ".")
            elif isinstance(n, ast.Assign):
                self._expr(n.value, s)
                for t in n.targets:
                    self._targets(t, s, n.lineno, n.value if len(n.targets) == 1 else None)
            elif isinstance(n, (ast.AnnAssign, ast.AugAssign)):
                self._expr(n.value, s)
                self._targets(n.target, s, n.lineno, n.value if isinstance(n, ast.AnnAssign) else None)
            elif isinstance(n, (ast.Global, ast.Nonlocal)):
                s.globals_ |= set(n.names) if isinstance(n, ast.Global) else set()
                s.uncertain |= isinstance(n, ast.Nonlocal)
            elif isinstance(n, (ast.For, ast.AsyncFor)):
                self._expr(n.iter, s)
                self._targets(n.target, s, n.lineno, None, True)
                self._branch([*n.body, *n.orelse], s, prefix, (id(n), "loop", False))
            elif isinstance(n, ast.While):
                self._expr(n.test, s)
                self._branch([*n.body, *n.orelse], s, prefix, (id(n), "loop", False))
            elif isinstance(n, ast.If):
                self._expr(n.test, s)
                self._branch(n.body, s, prefix, (id(n), "body", True))
                self._branch(n.orelse, s, prefix, (id(n), "else", True))
            elif isinstance(n, (ast.With, ast.AsyncWith)):
                for i in n.items:
                    self._expr(i.context_expr, s)
                    if i.optional_vars is not None:
                        self._targets(i.optional_vars, s, n.lineno)
                self._body(n.body, s, prefix)
            elif isinstance(n, (ast.Try, ast.TryStar)):
                self._branch(n.body, s, prefix, (id(n), "try", False))
                for h in n.handlers:
                    self._expr(h.type, s)
                    if h.name:
                        self._event(s, h.name, Event("other", h.lineno, True, h))
                    self._branch(h.body, s, prefix, (id(n), h.lineno, False))
                self._branch([*n.orelse, *n.finalbody], s, prefix, (id(n), "rest", False))
            elif isinstance(n, ast.Match):
                self._expr(n.subject, s)
                for i, c in enumerate(n.cases):
                    for p in ast.walk(c.pattern):
                        if isinstance(p, (ast.MatchAs, ast.MatchStar)) and p.name:
                            self._event(s, p.name, Event("other", n.lineno, True, p))
                    self._expr(c.guard, s)
                    self._branch(c.body, s, prefix, (id(n), i, False))
            elif isinstance(n, ast.Delete):
                for t in n.targets:
                    self._targets(t, s, n.lineno)
            else:
                for c in ast.iter_child_nodes(n):
                    self._expr(c, s)


    def _function(self, n, own: Scope, prefix: str):
        a = n.args
        for i, p in enumerate([*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]):
            self._event(own, p.arg, Event("other", n.lineno, False, ("parameter", i, p)))
        self._body(n.body, own, prefix)


#: What an expression is: ("module", name), ("symbol", module, key), ("instance", module, class key), or None.
class Repository:
    def __init__(self, sources: dict[str, bytes]):
        self.errors: dict[str, str] = {}
        self.twice: set[str] = set()
        self.modules: dict[str, Module] = {}
        for path in sorted(sources):
            if path.endswith(".py"):
                try:
                    m = Module(path, bytes(sources[path]))
                except (SourceError, RecursionError) as e:
                    self.errors[path] = str(e)
                    continue
                if m.name in self.modules or m.name in self.twice:  # which of them is meant can't be told: neither is resolved
                    self.twice.add(m.name)
                    for p in {path, self.modules.pop(m.name, m).path}:
                        self.errors[p] = f"two modules are named {m.name}"
                    continue
                self.modules[m.name] = m

    def _scope_of(self, m: Module, node: ast.AST) -> Scope | None:
        todo = [m.scope]
        while todo:
            s = todo.pop()
            if node in s.inner:
                return s.inner[node]
            todo += s.inner.values()
        return None

    def _settle(self, m: Module, s: Scope, events: list[Event], depth: int, cert: str, path: tuple = ()):
        """(targets, certainty) of what a name is bound to, of the bindings that are possible for a reference in these branches."""
        if s.uncertain or not events:
            return [], UNRESOLVED
        if len(events) > 1:
            if any(e.kind != "definition" for e in events):
                return [], UNRESOLVED
            return [("symbol", m.name, s.inner[e.node].key) for e in events], AMBIGUOUS
        e = events[0]
        if not e.established(path):
            return [], UNRESOLVED
        if e.kind == "definition":
            key = s.inner[e.node].key
            return ([("symbol", m.name, key)], cert) if key else ([], UNRESOLVED)
        if e.kind == "import":
            module, member = e.target
            if member is None:
                return ([("module", module)], cert) if module in self.modules or any(x.startswith(module + ".") for x in self.modules) else ([], UNRESOLVED)
            return self._member(("module", module), member, depth + 1, cert)
        kind = self._type_of(m, s, e, depth + 1)
        return ([kind], INFERRED) if kind else ([], UNRESOLVED)

    def _type_of(self, m: Module, s: Scope, e: Event, depth: int):
        if depth > DEPTH:
            return None
        if isinstance(e.node, tuple):  # a parameter
            _, i, arg = e.node
            fn = s.node
            if i == 0 and s.parent is not None and s.parent.kind == "class":
                how = {ast.unparse(d) for d in fn.decorator_list}
                if "staticmethod" not in how and how <= PLAIN_DECORATORS | {"property"}:
                    return ("symbol" if "classmethod" in how else "instance", m.name, s.parent.key)
            return self._annotated(m, s.parent, arg.annotation, depth)
        return self._made(m, s, e.value, depth) if e.value is not None else None

    def _annotated(self, m: Module, s: Scope | None, ann: ast.expr | None, depth: int):
        if ann is None or s is None:
            return None
        if isinstance(ann, ast.Constant) and isinstance(ann.value, str):
            try:
                ann = ast.parse(ann.value, mode="eval").body
            except SyntaxError:
                return None
        found, cert = self.resolve(m, s, ann, None, depth + 1)
        return ("instance", *found[0][1:]) if cert in CONFIDENCE and found[0][0] == "symbol" and self._kind(found[0]) == "class" else None

    def _made(self, m: Module, s: Scope, value: ast.expr, depth: int):
        """The type of an expression: a class's call, or a call of a function with an annotated class."""
        if isinstance(value, ast.Name) or isinstance(value, ast.Attribute):
            found, cert = self.resolve(m, s, value, None, depth + 1)
            return found[0] if cert in CONFIDENCE and found[0][0] == "instance" else None
        if not isinstance(value, ast.Call):
            return None
        found, cert = self.resolve(m, s, value.func, None, depth + 1)
        if cert not in CONFIDENCE or found[0][0] != "symbol":
            return None
        if self._kind(found[0]) == "class":
            return ("instance", *found[0][1:])
        own, node = self._node(found[0])
        if isinstance(node, ast.FunctionDef) and not node.decorator_list and not any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node)):
            where = self._scope_of(own, node)
            return self._annotated(own, where.parent if where else None, node.returns, depth + 1)
        return None

    def _kind(self, target) -> str:
        return self.modules[target[1]].by_key[target[2]]["kind"]

    def _node(self, target):
        m = self.modules[target[1]]
        todo = [m.scope]
        while todo:
            s = todo.pop()
            for node, inner in s.inner.items():
                if inner.key == target[2]:
                    return m, node
                todo.append(inner)
        return m, None

    def _member(self, base, name: str, depth: int, cert: str):
        if depth > DEPTH:
            return [], UNRESOLVED
        if base[0] == "module":
            m = self.modules.get(base[1])
            if m is not None and name in m.scope.names:
                return self._settle(m, m.scope, m.scope.names[name], depth, cert)
            sub = f"{base[1]}.{name}" if base[1] else name
            return ([("module", sub)], cert) if sub in self.modules and (m is None or m.package) else ([], UNRESOLVED)
        m, node = self._node(base)
        if not isinstance(node, ast.ClassDef):
            return [], UNRESOLVED
        s = self._scope_of(m, node)
        certain = INFERRED if base[0] == "instance" else cert
        if name in s.names:
            found, c = self._settle(m, s, s.names[name], depth, certain)
            if c in CONFIDENCE and found[0][0] == "symbol":
                _, target = self._node(found[0])
                if target is not None and not {ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in target.decorator_list} <= PLAIN_DECORATORS:
                    return [], UNRESOLVED
            return found, c
        if base[0] == "instance":
            return self._attribute(m, s, name, depth)
        return [], UNRESOLVED

    def _attribute(self, m: Module, cls: Scope, name: str, depth: int):
        """self.x with one write in the class, directly in an undecorated __init__."""
        if any(n.startswith("__getattr") for n in cls.names):
            return [], UNRESOLVED
        writes = []
        for fn, inner in cls.inner.items():
            if isinstance(fn, CALLABLES) and fn.args.args:
                me = fn.args.args[0].arg
                for x in ast.walk(fn):
                    if isinstance(x, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                        for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                            if isinstance(t, ast.Attribute) and t.attr == name and isinstance(t.value, ast.Name) and t.value.id == me:
                                writes.append((fn, inner, x))
        if len(writes) != 1 or writes[0][0].name != "__init__" or writes[0][0].decorator_list or writes[0][2] not in writes[0][0].body:
            return [], UNRESOLVED
        _, inner, x = writes[0]
        made = self._made(m, inner, x.value, depth + 1) if x.value is not None else None
        return ([made], INFERRED) if made else ([], UNRESOLVED)

    def resolve(self, m: Module, s: Scope, n: ast.expr, line: int | None, depth: int = 0, path: tuple = ()):
        """(targets, status) of a name or attribute read in a scope at a line and in branches of its own frame (or any time).

        Bindings of the same frame count if they come before and lie in no excluded branch, back to the last that is sure
        to have run; those of a frame around count all, for they may run before or after.
        """
        if depth > DEPTH:
            return [], UNRESOLVED
        if isinstance(n, ast.Attribute):
            found, cert = self.resolve(m, s, n.value, line, depth + 1, path)
            return self._member(found[0], n.attr, depth + 1, cert) if cert in CONFIDENCE else ([], UNRESOLVED)
        if isinstance(n, ast.Call):
            made = self._made(m, s, n, depth + 1)
            return ([made], INFERRED) if made else ([], UNRESOLVED)
        if not isinstance(n, ast.Name):
            return [], UNRESOLVED
        where, first = (s.parent if s.kind == "ref" else s), True
        frame = where.frame()
        while where is not None:
            if where.uncertain:
                return [], UNRESOLVED
            if (where.kind != "class" or first) and n.id in where.names and n.id not in where.globals_:
                events = where.names[n.id]
                if line is not None and where.frame() is frame:
                    events = [e for e in events if not e.excluded(path) and (e.line <= line or isinstance(where.node, COMPREHENSIONS))]
                    last = max((i for i, e in enumerate(events) if e.established(path)), default=0)
                    return self._settle(m, where, events[last:], depth, EXACT, path)
                return self._settle(m, where, events, depth, EXACT)
            first, where = False, where.parent
        return [], UNRESOLVED

    def results(self) -> list[dict]:
        out = []
        for m in self.modules.values():
            for i, (kind, s, n, text, line, path) in enumerate(m.references):
                if kind == "import":
                    module, _, member = text.partition(":")
                    found, cert = self._member(("module", module), member, 0, EXACT) if member else (([("module", module)], EXACT) if module in self.modules else ([], UNRESOLVED))
                else:
                    found, cert = self.resolve(m, s, n, line, 0, path)
                if cert in CONFIDENCE and found[0][0] == "instance":
                    found, cert = [], UNRESOLVED
                if kind == "base_class" and cert in CONFIDENCE and (found[0][0] != "symbol" or self._kind(found[0]) != "class"):
                    found, cert = [], UNRESOLVED
                targets = [(self.modules[t[1]].path, t[2]) if t[0] == "symbol" else (self.modules[t[1]].path, None) for t in found if t[0] == "symbol" or t[1] in self.modules]
                if cert in CONFIDENCE and not targets:
                    cert = UNRESOLVED
                out.append({"reference_key": json.dumps([m.path, kind, line, i]), "path": m.path, "owner_key": s.key, "kind": kind, "expression": text, "line": line, "status": cert, "targets": [{"path": p, "key": k} for p, k in targets]})
        return out


RESULTS = "repository_id long, reference_key string, path string, owner_key string, kind string, expression string, line int, status string, targets array<struct<path:string,key:string>>, error string"


def resolve_references(files: DataFrame) -> DataFrame:
    """References of files (repository_id, path, content) with status and targets: EXACT and INFERRED have one, AMBIGUOUS several, UNRESOLVED none.

    A file that can't be read, or that shares its module's name with another, is one row with its error and no status.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        repo = Repository(dict(zip(pdf["path"], pdf["content"])))
        rows = repo.results() + [{"path": p, "error": e} for p, e in sorted(repo.errors.items())]
        names = [c.split(" ")[0] for c in RESULTS.replace("path:string,key:string", "").split(", ")]
        out = pd.DataFrame([{"repository_id": pdf["repository_id"].iloc[0], **r} for r in rows], columns=names).astype(object)
        return out.where(out.notna(), None)

    return files.select("repository_id", "path", "content").groupBy("repository_id").applyInPandas(run, RESULTS)


def dependents(results: DataFrame) -> DataFrame:
    """path, needs: files whose references lead into another file, by results of an earlier run."""
    each = results.where("status IS NOT NULL").select("path", F.explode("targets").alias("t")).select("path", F.col("t.path").alias("needs"))
    return each.where("path != needs").distinct()


def model_uses(results: DataFrame, models: DataFrame) -> DataFrame:
    """Draft USES edges from constructor calls whose one target is a known model. models: path, key. A null source key is the file's module."""
    calls = results.where((F.col("kind") == "call") & F.col("status").isin(EXACT, INFERRED) & (F.size("targets") == 1)).withColumn("t", F.col("targets")[0])
    known = models.select(F.col("path").alias("dst_path"), F.col("key").alias("dst_key")).distinct()
    rows = calls.select("repository_id", F.col("path").alias("src_path"), F.col("owner_key").alias("src_key"), F.col("t.path").alias("dst_path"), F.col("t.key").alias("dst_key"), F.lit("USES").alias("kind"), F.when(F.col("status") == EXACT, 1.0).otherwise(0.5).alias("confidence"), "reference_key")
    rows = rows.join(known, ["dst_path", "dst_key"], "left_semi")
    return rows.groupBy("repository_id", "src_path", "src_key", "dst_path", "dst_key", "kind").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("reference_key")).alias("references"))


def reference_edges(results: DataFrame) -> DataFrame:
    """Draft edges between (path, key) ends; a null key is the file's module. Only EXACT and INFERRED make edges; the merge takes the best."""
    known = results.where(F.col("status").isin(EXACT, INFERRED)).withColumn("t", F.col("targets")[0])
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_OF.items() for x in kv]), F.col("kind"))
    source_key = F.when(F.col("kind") == "import", F.lit(None).cast("string")).otherwise(F.col("owner_key"))
    rows = known.select("repository_id", F.col("path").alias("src_path"), source_key.alias("src_key"), F.col("t.path").alias("dst_path"), F.col("t.key").alias("dst_key"), kind.alias("kind"), F.when(F.col("status") == EXACT, 1.0).otherwise(0.5).alias("confidence"), "reference_key")
    ends = ["repository_id", "src_path", "src_key", "dst_path", "dst_key", "kind"]
    merged = rows.groupBy(*ends).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("reference_key")).alias("references"))
    return merged.where(~(F.col("src_path").eqNullSafe(F.col("dst_path")) & F.col("src_key").eqNullSafe(F.col("dst_key")) & (F.col("kind") == "IMPORTS")))


def is_test_symbol(path, qualname, kind):
    """test_*.py with a top-level test_ function or a test_ method of a top-level Test class."""
    name = F.element_at(F.split(path, "/"), -1)
    top = (kind == "function") & qualname.rlike(r"^test_[^.]*$")
    inner = (kind == "method") & qualname.rlike(r"^Test[^.]*\.test_[^.]*$")
    return name.rlike(r"^test_.*\.py$") & (top | inner)


def test_links(symbols_df: DataFrame, calls: DataFrame) -> DataFrame:
    """implementation, test, confidence, how: a direct call (its confidence), two hops (least * 0.8), or the name where the test has neither (0.5).

    symbols_df: symbol_id, path, name, qualname, kind. calls: src, dst, confidence (CALLS edges).
    """
    outside = ~F.col("path").rlike(r"(^|/)tests?/") & ~F.element_at(F.split("path", "/"), -1).rlike(r"^test_.*\.py$")
    s = symbols_df.withColumn("is_test", is_test_symbol(F.col("path"), F.col("qualname"), F.col("kind"))).withColumn("impl", outside & F.col("kind").isin("function", "method"))
    tests, impl = s.where("is_test"), s.where("impl").select("symbol_id", "name", "path")
    direct = calls.join(tests.select(F.col("symbol_id").alias("src")), "src", "left_semi").join(impl.select(F.col("symbol_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("implementation"), F.col("src").alias("test"), "confidence", F.lit("direct").alias("how"))
    from sparkloom.operators.graph import two_hop_tests

    far = two_hop_tests(calls, s.select("symbol_id", "is_test")).join(impl.select(F.col("symbol_id").alias("target")), "target", "left_semi").select(F.col("target").alias("implementation"), "test", "confidence", F.lit("two_hop").alias("how"))
    called = direct.union(far.join(direct.select("implementation", "test"), ["implementation", "test"], "left_anti"))
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.py$", "")
    wanted = tests.join(called.select(F.col("test").alias("symbol_id")).distinct(), "symbol_id", "left_anti").select(F.col("symbol_id").alias("test"), F.regexp_replace("name", "^test_", "").alias("name"), F.regexp_replace(stem(F.col("path")), "^test_", "").alias("stem"))
    named = wanted.join(impl.select(F.col("symbol_id").alias("implementation"), "name", stem(F.col("path")).alias("stem")), ["name", "stem"])
    only = named.groupBy("test").agg(F.count("*").alias("n"), F.min("implementation").alias("implementation")).where("n = 1")
    return called.union(only.select("implementation", "test", F.lit(0.5), F.lit("name")))


test_links.__test__ = False
