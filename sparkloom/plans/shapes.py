"""Small Python sources with what their references must resolve to, worked out by hand from the rules of name lookup.

Each entry: the source, then (kind, expression, line, status) of its references.
"""

from __future__ import annotations

SHAPES: list[tuple[str, list[tuple[str, str, int, str]]]] = [
    ("def f(): pass\nf()\n", [("call", "f", 2, "EXACT")]),
    ("f()\ndef f(): pass\n", [("call", "f", 1, "UNRESOLVED")]),  # not bound yet
    ("def g():\n    f()\ndef f(): pass\n", [("call", "f", 2, "EXACT")]),  # the body runs later
    ("def f(): pass\ndef f(): pass\nf()\n", [("call", "f", 3, "EXACT")]),  # the last surely ran
    ("def f(): pass\ndef f(): pass\ndef g():\n    f()\n", [("call", "f", 4, "AMBIGUOUS")]),  # the body may run between
    ("if x:\n    def f(): pass\nf()\n", [("call", "f", 3, "UNRESOLVED")]),
    ("if x:\n    def f(): pass\n    f()\n", [("call", "f", 3, "EXACT")]),  # in the same branch
    ("if x:\n    def f(): pass\nelse:\n    f()\n", [("call", "f", 4, "UNRESOLVED")]),  # in the other
    ("if x:\n    def f(): pass\nelse:\n    def f(): pass\nf()\n", [("call", "f", 5, "AMBIGUOUS")]),
    ("def f(): pass\nif x:\n    def f(): pass\nf()\n", [("call", "f", 4, "AMBIGUOUS")]),
    ("def f(): pass\nif x:\n    f = 1\nf()\n", [("call", "f", 4, "UNRESOLVED")]),
    ("def f(): pass\nf = 1\ndef f(): pass\nf()\n", [("call", "f", 4, "EXACT")]),
    ("while x:\n    def f(): pass\n    f()\nf()\n", [("call", "f", 3, "EXACT"), ("call", "f", 4, "UNRESOLVED")]),
    ("try:\n    def f(): pass\nexcept E:\n    f = None\nf()\n", [("call", "f", 5, "UNRESOLVED")]),
    ("def f(): pass\ndel f\nf()\n", [("call", "f", 3, "UNRESOLVED")]),
    ("def f(): pass\nfor f in x:\n    f()\n", [("call", "f", 3, "UNRESOLVED")]),
    ("def g(f):\n    f()\n", [("call", "f", 2, "UNRESOLVED")]),
    ("def f(): pass\ndef g():\n    f = 1\n    f()\n", [("call", "f", 4, "UNRESOLVED")]),  # the function's own name
    ("def f(): pass\ndef g():\n    global f\n    f()\n", [("call", "f", 4, "EXACT")]),
    ("def outer():\n    def inner(): pass\n    inner()\nouter()\n", [("call", "inner", 3, "EXACT"), ("call", "outer", 4, "EXACT")]),
    ("class A:\n    def m(self): pass\n    def n(self):\n        m()\n", [("call", "m", 4, "UNRESOLVED")]),  # class names aren't seen from methods
    ("class A:\n    def m(self): pass\na = A()\na.m()\n", [("call", "A", 3, "EXACT"), ("call", "a.m", 4, "INFERRED")]),
    ("class A:\n    def m(self):\n        self.n()\n    def n(self): pass\n", [("call", "self.n", 3, "INFERRED")]),
    ("class A:\n    @staticmethod\n    def m(): pass\nA.m()\n", [("call", "A.m", 4, "EXACT")]),
    ("class A:\n    @wrap\n    def m(self): pass\nA().m()\n", [("call", "A().m", 4, "UNRESOLVED"), ("call", "A", 4, "EXACT")]),
    ("class A:\n    def m(self): pass\ndef use(a: A):\n    a.m()\n", [("call", "a.m", 4, "INFERRED")]),
    ("class A:\n    def m(self): pass\ndef make() -> A: ...\nmake().m()\n", [("call", "make().m", 4, "INFERRED"), ("call", "make", 4, "EXACT")]),
    ("class B: pass\nclass C(B): pass\n", [("base_class", "B", 2, "EXACT")]),
    ("def B(): pass\nclass C(B): pass\n", [("base_class", "B", 2, "UNRESOLVED")]),  # not a class
    ("import os\nos.getcwd()\n", [("import", "os", 1, "UNRESOLVED"), ("call", "os.getcwd", 2, "UNRESOLVED")]),
    ("from m import *\ndef f(): pass\nf()\n", [("call", "f", 3, "UNRESOLVED")]),  # a star may bind any name
    ("def f(): pass\nexec(s)\nf()\n", [("call", "exec", 2, "UNRESOLVED"), ("call", "f", 3, "UNRESOLVED")]),
    ("def f(): pass\n[f() for i in x]\n[f() for f in x]\n", [("call", "f", 2, "EXACT"), ("call", "f", 3, "UNRESOLVED")]),
    ("def f(): pass\nrun(lambda: f())\nrun(lambda f: f())\n", [("call", "run", 2, "UNRESOLVED"), ("call", "f", 2, "EXACT"), ("call", "run", 3, "UNRESOLVED"), ("call", "f", 3, "UNRESOLVED")]),
    ("def f(): pass\nif (f := x):\n    f()\n", [("call", "f", 3, "UNRESOLVED")]),
    ("def f(): pass\nmatch x:\n    case {'a': f}:\n        f()\n", [("call", "f", 4, "UNRESOLVED")]),
]
