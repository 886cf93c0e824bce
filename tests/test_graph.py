"""Walks, blast radius, expansion and closures on small graphs, with expectations worked out by hand or by brute force."""

from __future__ import annotations

import random

import pytest

from sparkloom.operators import graph
from sparkloom.operators.scope import neighbours, repo_graph, repo_symbols, scoped_edges, skipped_confidences, snapshot_graph
from sparkloom.schema import ContractError, check_edges

#: Root 7. A cycle (4, 5), a weak short and a strong long way to 5, a chain behind it, a foreign caller, unknown,
#: impossible and zero confidences, an edge out of the root, an import.
EDGES = [
    (1, 4, 7, "CALLS", 0.9), (2, 5, 4, "CALLS", 1.0), (3, 4, 5, "CALLS", 1.0), (4, 5, 7, "CALLS", 0.3), (5, 2, 5, "INHERITS", 0.5), (6, 3, 2, "CALLS", 1.0), (7, 6, 3, "CALLS", 1.0),
    (8, 50, 7, "CALLS", 1.0), (9, 8, 7, "CALLS", None), (10, 9, 7, "CALLS", 2.0), (11, 1, 7, "CALLS", 0.0), (12, 7, 1, "CALLS", 1.0), (13, 9, 7, "IMPORTS", 1.0),
]


@pytest.fixture(scope="module")
def world(spark):
    files = spark.createDataFrame([(1, 1, "a.py"), (2, 2, "b.py")], "file_id long, repository_id long, path string")
    symbols = spark.createDataFrame([(i, 1, f"s{i}", f"m.s{i}", "function") for i in range(1, 10)] + [(50, 2, "x", "m.x", "function")], "symbol_id long, file_id long, name string, qualname string, kind string")
    edges = spark.createDataFrame(EDGES, "edge_id long, src long, dst long, kind string, confidence double")
    return files, symbols, edges


def test_reverse_reach(world):
    """By hand: 5 is 0.9 * 0.8 over 4 (0.3 at once); 2 is 0.72 * 0.5 * 0.8, 3 another 0.8; 6 is in reach by the short way only."""
    files, symbols, edges = world
    got = {r.symbol_id: (round(r.score, 9), r.depth, r.min_depth) for r in graph.reverse_reach(symbols, files, edges, 1, 7).collect()}
    assert got == {4: (0.9, 1, 1), 5: (0.72, 2, 1), 2: (0.288, 3, 2), 3: (0.2304, 4, 3), 6: (0.0768, 4, 4), 1: (0.0, 1, 1)}
    assert [r.symbol_id for r in graph.reverse_reach(symbols, files, edges, 1, 7, kinds=("IMPORTS",)).collect()] == [9]
    own = scoped_edges(edges, repo_symbols(symbols, files, 1), graph.WALK_KINDS)
    assert skipped_confidences(own).first().skipped == 2
    for bad in (0, 5, True, "4"):
        with pytest.raises(ValueError):
            graph.reverse_reach(symbols, files, edges, 1, 7, depth=bad)
    with pytest.raises(ValueError):
        graph.reverse_reach(symbols, files, edges, 1, 7, kinds=("EXPOSES",))
    with pytest.raises(graph.BudgetExceeded):
        graph.reverse_reach(symbols, files, edges, 1, 7, cap=5)
    assert graph.reverse_reach(symbols, files, edges, 1, 7, cap=6, expansions=graph.MAX_EXPANSIONS).count() == 6
    with pytest.raises(graph.BudgetExceeded):
        graph.reverse_reach(symbols, files, edges, 1, 7, expansions=4)


def test_graphs_over_a_cap_are_refused(world):
    files, symbols, edges = world
    own, links = repo_graph(symbols, files, edges, 1, 9, 12)
    assert own.count() == 9 and links.count() == 12  # without the foreign caller's edge
    for nodes, most in ((8, 12), (9, 11)):
        with pytest.raises(graph.BudgetExceeded):
            repo_graph(symbols, files, edges, 1, nodes, most)


def test_snapshots(spark, world):
    from pyspark.sql import functions as F

    files, symbols, edges = world
    snaps = spark.createDataFrame([(3, 1, "ready"), (4, 1, "failed"), (5, 2, "ready")], "id long, repository_id long, status string")
    files = files.withColumn("snapshot_id", F.lit(3))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "symbol_id long")
    own, links = snapshot_graph(snaps, symbols, files, edges, 1, 3, ids(2, 4))
    assert {r.symbol_id for r in own.collect() if r.is_database_model} == {2, 4} and links.count() == 12
    assert {r.symbol_id for r in graph.snapshot_blast_radius(snaps, symbols, files, edges, 1, 3, ids(7), 1).collect()} == {7, 4, 5, 1}
    for snapshot in (4, 5, 6):  # not ready, another repository's, none
        with pytest.raises(ContractError):
            snapshot_graph(snaps, symbols, files, edges, 1, snapshot)
    with pytest.raises(ContractError):
        snapshot_graph(snaps, symbols, files, edges, 1, 3, ids(50))


def test_deletion_takes_touching_edges(world):
    from sparkloom.operators.writes import delete_repository

    files, symbols, edges = delete_repository(*world, 2)
    assert {r.file_id for r in files.collect()} == {1} and symbols.where("symbol_id = 50").count() == 0
    assert {r.edge_id for r in edges.collect()} == {e[0] for e in EDGES} - {8}


def brute(edges, seeds, depth, decay=0.8):
    best, least = {}, {}
    todo = [((s,), (), 1.0) for s in seeds]
    while todo:
        path, ids, w = todo.pop()
        at, d = path[-1], len(ids)
        least[at] = min(least.get(at, d), d)
        c = (-w, d, path, ids)
        best[at] = min(best.get(at, c), c)
        if d < depth:
            todo += [((*path, s), (*ids, i), round(w * c * (decay if d else 1), 12)) for i, s, t, _, c in edges if t == at and s not in path and c is not None and 0 <= c <= 1]
    return {k: (round(-v[0], 9), v[1], least[k], list(v[2]), list(v[3])) for k, v in best.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_blast_radius_against_enumeration(spark, seed):
    r = random.Random(seed)
    pairs = {(r.randint(1, 12), r.randint(1, 12)) for _ in range(26)}
    edges = [(i, a, b, "CALLS", r.choice([1.0, 0.5, 0.2, None])) for i, (a, b) in enumerate(sorted(p for p in pairs if p[0] != p[1]), 1)]
    files = spark.createDataFrame([(1, 1, "a.py")], "file_id long, repository_id long, path string")
    symbols = spark.createDataFrame([(i, 1, f"s{i}", None, "endpoint" if i == 3 else "function") for i in range(1, 13)], "symbol_id long, file_id long, name string, qualname string, kind string")
    frame = spark.createDataFrame(edges, "edge_id long, src long, dst long, kind string, confidence double")
    seeds = spark.createDataFrame([(1,), (2,), (2,)], "symbol_id long")
    got = {x.symbol_id: (round(x.score, 9), x.depth, x.min_depth, x.symbol_path, x.edge_path) for x in graph.blast_radius(symbols, files, frame, 1, seeds, 3).collect()}
    assert got == brute(edges, [1, 2], 3)


def test_chain_decay_and_limit(spark):
    edges = spark.createDataFrame([(i, i + 1, i, "CALLS", 1.0) for i in range(1, 7)], "edge_id long, src long, dst long, kind string, confidence double")
    levels = graph.walks(edges, spark.createDataFrame([(1,)], "symbol_id long"), 4)
    assert [level.first().score for level in levels] == pytest.approx([1, 1, 0.8, 0.64, 0.512])
    skipped, limited = graph.blast_examined(edges, levels)
    assert skipped.count() == 0 and limited.first().depth_limited
    assert not graph.blast_examined(edges, graph.walks(edges, spark.createDataFrame([(1,)], "symbol_id long"), 6))[1].first().depth_limited


def test_typed_expansion(spark):
    kinds = {1: "module", 2: "endpoint", 3: "function", 4: "function", 5: "function", 6: "class", 7: "class", 8: "class"}
    symbols = spark.createDataFrame(list(kinds.items()), "symbol_id long, kind string")
    edges = spark.createDataFrame([(1, 1, 2, "EXPOSES", 1.0), (2, 2, 3, "CALLS", 1.0), (3, 3, 4, "CALLS", 1.0), (4, 4, 5, "CALLS", 1.0), (5, 7, 6, "INHERITS", 1.0), (6, 4, 8, "USES", 1.0)], "edge_id long, src long, dst long, kind string, confidence double")

    def reach(seed, intent):
        s = spark.createDataFrame([(seed, 1)], "symbol_id long, seed_rank int")
        return {r.symbol_id for r in graph.typed_expand(symbols, edges, s, intent).collect()}

    assert reach(4, "endpoints") == {2, 3} and reach(3, "endpoints") == {1, 2} and reach(1, "endpoints") == {2, 3}
    assert reach(4, "callers") == {2, 3} and reach(4, "implementation") == {5, 8} and reach(7, "inheritance") == {6}
    assert reach(4, "general") >= {2, 3, 5, 8}


def test_neighbours_and_checks(world):
    files, symbols, edges = world
    both = [(r.direction, r.symbol_id) for r in neighbours(edges, symbols, 4).collect()]
    assert sorted(both) == [("in", 5), ("out", 5), ("out", 7)]
    with pytest.raises(ContractError):
        check_edges(edges)


def test_closure_on_a_cycle(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "f")], "path string, needs string")
    assert {r.path for r in graph.closure(deps, spark.createDataFrame([("c",)], "path string")).collect()} == {"a", "b", "c", "d"}


def test_closure_of_a_long_chain(spark):
    """120 files, each needing the next: as many rounds, and plans that stay small."""
    deps = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(120)], "path string, needs string").coalesce(1).persist()
    assert graph.closure(deps, spark.createDataFrame([("f120",)], "path string").coalesce(1)).count() == 121


def test_families_of_a_long_chain(spark):
    from sparkloom.operators.changes import families

    classes = spark.createDataFrame([(0, "a"), (1000, "b")] + [(i, None) for i in range(1, 70)], "class_id long, family string").coalesce(1)
    bases = spark.createDataFrame([(i + 1, i) for i in range(69)] + [(69, 1000)], "class_id long, base_id long").coalesce(1).persist()
    got = {r.class_id: r.family for r in families(classes, bases).collect()}
    assert got == {**{i: "a" for i in range(69)}, 1000: "b"}  # the last has two


def test_expansion_says_what_it_leaves_out(spark):
    symbols = spark.createDataFrame([(i, "function") for i in range(60)], "symbol_id long, kind string")
    edges = spark.createDataFrame([(i, i, 0, "CALLS", 1.0) for i in range(1, 31)] + [(100 + i, 30 + i, 40, "CALLS", 1.0) for i in range(1, 4)], "edge_id long, src long, dst long, kind string, confidence double")
    seeds = spark.createDataFrame([(0, 1), (40, 2), (59, 3)], "symbol_id long, seed_rank int")
    out, reasons = graph.typed_expansion(symbols, edges, seeds, "callers", total=21)
    assert out.count() == 21 and {(r.seed, r.reason) for r in reasons.collect()} == {(0, "SEED_LIMIT"), (40, "TOTAL_LIMIT"), (59, "NO_MATCH")}
    with pytest.raises(graph.BudgetExceeded):
        graph.typed_expansion(symbols, edges, seeds, "callers", expansions=32)
    with pytest.raises(graph.BudgetExceeded):
        graph.typed_expansion(symbols, edges, spark.createDataFrame([(i, i) for i in range(9)], "symbol_id long, seed_rank int"), "callers")


@pytest.fixture(scope="module")
def over_the_caps(spark, tmp_path_factory):
    """Tables whose snapshot 1 has 110,000 symbols and 600,000 edges: more than the default caps allow."""
    at, n = tmp_path_factory.mktemp("over"), 220_000
    mine = lambda x: f"({x}) % 110000 div 2 * 4 + ({x}) % 2"  # noqa: E731  symbols of the snapshot's files, 0 and 1 of four
    orders = spark.range(600_000).selectExpr(f"{mine('id * 7919 + id div 110000 * 32')} AS o_custkey", f"id * {n} + {mine('id')} AS o_orderkey", "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT', '5-LOW'), int(id % 5 + 1)) AS o_orderpriority", "element_at(array('F', 'O', 'P'), int(id % 3 + 1)) AS o_orderstatus")
    tables = {
        "supplier": spark.range(4).selectExpr("id AS s_suppkey", "'S#' || id AS s_name"),
        "part": spark.range(n).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'STEEL' AS p_type", "int(id % 50 + 1) AS p_size"),
        "customer": spark.range(n).selectExpr("id AS c_custkey"),
        "orders": orders,
    }
    for name, rows in tables.items():
        rows.coalesce(2).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name, least", [("g4_snapshot_blast_radius", 6), ("s11_snapshot_graph", 500_001)])
def test_snapshots_of_any_size(spark, over_the_caps, name, least):
    import __spark_entry__ as entry

    con = pytest.importorskip("duckdb").connect()
    for t in ("supplier", "part", "customer", "orders", "documents", "embeddings", "events"):
        at = over_the_caps if t in ("supplier", "part", "customer", "orders") else "/root/testdata/sf0.001"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet{'/*.parquet' if at == over_the_caps else ''}'")
    got = entry.queries()[name](spark, over_the_caps)
    want = con.sql(entry.oracle_sql()[name])
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows == sorted(want.fetchall()) and len(rows) >= least
    spark.catalog.clearCache()
