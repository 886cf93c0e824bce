"""Graph operators: bounded reverse walks, blast radius, typed expansion, closures, test gaps.

Walks are unrolled joins, one a hop, over edges that are scoped once. Depth is bounded by
contract, and a weaker but shorter path can reach further, so nothing is pruned by score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.lineage import cut
from sparkloom.operators.scope import BudgetExceeded, repo_symbols, scoped_edges, snapshot_graph, within
from sparkloom.schema import BLAST_KINDS, WALK_KINDS, WALKABLE_KINDS, positive, valid_confidence

__all__ = ["BudgetExceeded"]

#: Digits scores are kept to after each hop, so that equal products tie whatever their order.
DIGITS = 12


#: Symbols that a walk may reach and steps that it may take; steps that a typed expansion may take, and its seeds.
MAX_RESULTS, MAX_EXPANSIONS = 10_000, 100_000
EXPANSIONS, SEEDS = 10_000, 8


def walks(edges: DataFrame, seeds: DataFrame, depth: int, decay: float = 0.8, expansions: int | None = None) -> list[DataFrame]:
    """Simple paths against the edges, by depth 0..depth: symbol_id, depth, score, symbol_path, edge_path, kinds.

    seeds: symbol_id. Edges of unknown confidence are no steps. With `expansions` a walk of more steps is
    refused: they are counted hop by hop, before the next hop starts.
    """
    left = expansions
    step = edges.where(valid_confidence()).select(F.col("dst").alias("_at"), F.col("src").alias("_next"), "edge_id", F.col("kind").alias("_kind"), "confidence")
    now = seeds.select("symbol_id", F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.array("symbol_id").alias("symbol_path"), F.array().cast("array<long>").alias("edge_path"), F.array().cast("array<string>").alias("kinds"))
    out = [now]
    for d in range(1, depth + 1):
        weight = F.col("score") * F.col("confidence") * F.lit(1.0 if d == 1 else decay)
        now = now.join(step, (F.col("symbol_id") == F.col("_at")) & ~F.array_contains("symbol_path", F.col("_next"))).select(
            F.col("_next").alias("symbol_id"), F.lit(d).alias("depth"), F.round(weight, DIGITS).alias("score"), F.array_append("symbol_path", F.col("_next")).alias("symbol_path"), F.array_append("edge_path", F.col("edge_id")).alias("edge_path"), F.array_append("kinds", F.col("_kind")).alias("kinds")
        )
        now = now.persist() if d < depth or left is not None else now  # the next hop and the result both read it
        out.append(now)
        if left is not None:
            n = now.limit(left + 1).count()
            if n > left:
                raise BudgetExceeded(f"over {expansions} steps")
            left -= n
    return out


def best_paths(paths: DataFrame) -> DataFrame:
    """The strongest path of each symbol and its least depth of any path: score desc, depth, path, edges.

    One aggregate with map-side merging; no window over all paths of a symbol.
    """
    order = F.struct((-F.col("score")).alias("s"), "depth", "symbol_path", "edge_path", "score", "kinds")
    return paths.groupBy("symbol_id").agg(F.min(order).alias("b"), F.min("depth").alias("min_depth")).select("symbol_id", "b.depth", "min_depth", "b.score", "b.symbol_path", "b.edge_path", "b.kinds")


def reverse_reach(symbols: DataFrame, files: DataFrame, edges: DataFrame, repository_id: int, root: int, depth: int = 4, kinds=WALK_KINDS, cap: int | None = None, expansions: int | None = None) -> DataFrame:
    """Who reaches `root`: best path and least depth of each symbol, root left out.

    With `cap` and `expansions` (MAX_RESULTS, MAX_EXPANSIONS of the service) a walk beyond them is refused.
    """
    positive(depth, "depth", 4)
    if not kinds or not set(kinds) <= set(WALKABLE_KINDS):
        raise ValueError("kinds that can't be walked")
    scoped = repo_symbols(symbols, files, repository_id)
    own = scoped_edges(edges, scoped, kinds).persist()
    hops = walks(own, scoped.where(F.col("symbol_id") == root).select("symbol_id"), depth, expansions=expansions)[1:]
    paths = hops[0]
    for h in hops[1:]:
        paths = paths.union(h)
    best = best_paths(paths).join(scoped.select("symbol_id", "name", "qualname", "kind", "path"), "symbol_id")
    return best if cap is None else within(best, cap, "symbols")


def blast_radius(symbols: DataFrame, files: DataFrame, edges: DataFrame, repository_id: int, seeds: DataFrame, depth: int = 4, decay: float = 0.8) -> DataFrame:
    """Best path of each symbol from any seed (seeds themselves at weight 1, depth 0), with its seed and flags."""
    positive(depth, "depth", 8)
    scoped = repo_symbols(symbols, files, repository_id)
    return _blast(scoped, scoped_edges(edges, scoped, BLAST_KINDS), seeds, depth, decay)


def _blast(scoped: DataFrame, own: DataFrame, seeds: DataFrame, depth: int, decay: float, *more: str) -> DataFrame:
    """blast_radius() over scoped symbols and edges. more: columns of the symbols that the result carries."""
    own = own.persist()
    start = scoped.select("symbol_id").join(seeds.select("symbol_id").distinct(), "symbol_id", "left_semi")
    levels = walks(own, start, depth, decay)
    paths = levels[0]
    for h in levels[1:]:
        paths = paths.union(h)
    best = best_paths(paths).withColumn("seed", F.element_at("symbol_path", 1))
    return best.join(scoped.select("symbol_id", "file_id", "name", "kind", "path", (F.col("kind") == "endpoint").alias("is_endpoint"), *more), "symbol_id")


def snapshot_blast_radius(snapshots: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, repository_id: int, snapshot_id: int, seeds: DataFrame, depth: int = 4, models: DataFrame | None = None, **caps) -> DataFrame:
    """The blast radius inside one ready snapshot, with is_database_model. caps: see snapshot_graph()."""
    positive(depth, "depth", 8)
    own, links = snapshot_graph(snapshots, symbols, files, edges, repository_id, snapshot_id, models, **caps)
    return _blast(own, links.where(F.col("kind").isin(*BLAST_KINDS)), seeds, depth, 0.8, "is_database_model")


def blast_examined(edges: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(skipped, limited): ids of examined edges of unknown confidence; one row, whether a valid edge leads from a path of full depth to a symbol never reached."""
    own = edges.select(F.col("dst").alias("_at"), F.col("src").alias("_next"), "edge_id", "confidence")
    every = levels[0].select("symbol_id", "symbol_path", "depth")
    for h in levels[1:]:
        every = every.union(h.select("symbol_id", "symbol_path", "depth"))
    seen = every.join(own, (F.col("symbol_id") == F.col("_at")) & ~F.array_contains("symbol_path", F.col("_next")))
    skipped = seen.where(~valid_confidence()).select("edge_id").distinct()
    beyond = seen.where((F.col("depth") == len(levels) - 1) & valid_confidence()).select(F.col("_next").alias("symbol_id")).distinct()
    limited = beyond.join(every.select("symbol_id").distinct(), "symbol_id", "left_anti").agg((F.count("*") > 0).alias("depth_limited"))
    return skipped, limited


def exposures(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """EXPOSES edges of affected endpoints: metadata, never a step."""
    ends = hits.where("is_endpoint").select(F.col("symbol_id").alias("dst"))
    return edges.where("kind = 'EXPOSES'").join(ends, "dst", "left_semi").select("src", "dst", "edge_id", F.when(valid_confidence(), F.col("confidence")).alias("confidence"))


# Hops of each intent, in order: kind and direction.
_IN, _OUT = "in", "out"
PATTERNS = {
    "callers": [[("CALLS", _IN)], [("CALLS", _IN), ("CALLS", _IN)]],
    "implementation": [[("CALLS", _OUT)], [("CALLS", _OUT), ("CALLS", _OUT)], [("USES", _OUT)], [("CALLS", _OUT), ("USES", _OUT)]],
    "inheritance": [[("INHERITS", _OUT)], [("INHERITS", _OUT), ("INHERITS", _OUT)]],
    "endpoints": [[("CALLS", _IN)], [("CALLS", _IN), ("CALLS", _IN)], [("CALLS", _IN), ("EXPOSES", _IN)], [("EXPOSES", _IN)], [("EXPOSES", _OUT)], [("EXPOSES", _OUT), ("CALLS", _OUT)], [("CALLS", _OUT)]],
}
PATTERNS["general"] = [list(p) for p in dict.fromkeys(tuple(p) for ps in PATTERNS.values() for p in ps)]


def typed_expand(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, intent: str, least: float = 0.0, per_seed: int = 20, total: int = 80) -> DataFrame:
    """What typed_paths() finds, best first: at most `per_seed` of a seed, `total` in all."""
    return _within_budgets(_numbered(typed_paths(symbols, edges, seeds, intent, least)), per_seed, total)


def typed_expansion(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, intent: str, least: float = 0.0, per_seed: int = 20, total: int = 80, expansions: int = EXPANSIONS) -> tuple[DataFrame, DataFrame]:
    """(rows of typed_expand(), reasons: seed, reason). At most SEEDS seeds; an expansion of more than `expansions` paths is refused.

    Reasons say where results were cut: SEED_LIMIT where a seed had more than its share, TOTAL_LIMIT where the total left some out,
    NO_MATCH where a seed leads nowhere.
    """
    within(seeds.select("symbol_id").distinct(), SEEDS, "seeds")
    every = typed_paths(symbols, edges, seeds, intent, least).persist()
    within(every, expansions, "paths")
    numbered = _numbered(every).persist()
    out = _within_budgets(numbered, per_seed, total)
    over = numbered.where(F.col("nth") > per_seed).select("seed", F.lit("SEED_LIMIT").alias("reason")).distinct()
    cut = numbered.where(F.col("nth") <= per_seed).join(out.select("seed", "nth"), ["seed", "nth"], "left_anti").select("seed", F.lit("TOTAL_LIMIT")).distinct()
    none = seeds.select(F.col("symbol_id").alias("seed")).join(numbered.select("seed"), "seed", "left_anti").select("seed", F.lit("NO_MATCH"))
    return out, over.union(cut).union(none)


def typed_paths(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, intent: str, least: float = 0.0) -> DataFrame:
    """Symbols that the intent's patterns reach from each seed (seeds: symbol_id, seed_rank), with the best path.

    Confidence is the product along the path, without decay. Hop rules: EXPOSES only module to
    endpoint, INHERITS only class to class, and for endpoints an outgoing CALLS only from an
    endpoint to a callable. Seeds and nodes of the path aren't entered again.
    """
    kind = symbols.select("symbol_id", "kind")
    typed = edges.where(valid_confidence()).join(kind.select(F.col("symbol_id").alias("src"), F.col("kind").alias("_sk")), "src").join(kind.select(F.col("symbol_id").alias("dst"), F.col("kind").alias("_dk")), "dst")
    allowed = F.when(F.col("kind") == "EXPOSES", (F.col("_sk") == "module") & (F.col("_dk") == "endpoint")).when(F.col("kind") == "INHERITS", (F.col("_sk") == "class") & (F.col("_dk") == "class")).otherwise(F.lit(True))
    typed = typed.where(allowed).persist()  # every hop of every pattern reads it

    def step(k: str, way: str) -> DataFrame:
        own = typed.where(F.col("kind") == k)
        if intent == "endpoints" and (k, way) == ("CALLS", _OUT):
            own = own.where((F.col("_sk") == "endpoint") & F.col("_dk").isin("function", "method"))
        a, b = ("src", "dst") if way == _OUT else ("dst", "src")
        return own.select(F.col(a).alias("_at"), F.col(b).alias("_next"), "edge_id", F.col("confidence").alias("_c"))

    start = seeds.select(F.col("symbol_id").alias("seed"), "seed_rank", "symbol_id", F.lit(1.0).alias("confidence"), F.array("symbol_id").alias("symbol_path"), F.array().cast("array<long>").alias("edge_path"))
    found, known = None, {}
    first = [p[0] for p in PATTERNS[intent]]
    for pattern in PATTERNS[intent]:
        now = start
        for n, (k, way) in enumerate(pattern):
            if n == 0 and (k, way) in known:  # patterns share their first hops
                now = known[k, way]
                continue
            now = now.join(step(k, way), (F.col("symbol_id") == F.col("_at")) & ~F.array_contains("symbol_path", F.col("_next"))).select(
                "seed", "seed_rank", F.col("_next").alias("symbol_id"), F.round(F.col("confidence") * F.col("_c"), DIGITS).alias("confidence"), F.array_append("symbol_path", F.col("_next")).alias("symbol_path"), F.array_append("edge_path", F.col("edge_id")).alias("edge_path")
            ).where(F.col("confidence") >= least)
            if n == 0:
                known[k, way] = now = now.persist() if first.count((k, way)) > 1 else now
        found = now if found is None else found.union(now)
    return found


def _numbered(found: DataFrame) -> DataFrame:
    """The best path of each seed and symbol, numbered within its seed."""
    order = F.struct((-F.col("confidence")).alias("s"), F.size("edge_path").alias("hops"), "symbol_path", "edge_path", "confidence")
    best = found.groupBy("seed", "seed_rank", "symbol_id").agg(F.min(order).alias("b")).select("seed", "seed_rank", "symbol_id", "b.confidence", "b.hops", "b.symbol_path", "b.edge_path")
    nth = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("confidence"), "hops", "symbol_path", "edge_path"))
    return best.withColumn("nth", nth)


def _within_budgets(best: DataFrame, per_seed: int, total: int) -> DataFrame:
    return best.where(F.col("nth") <= per_seed).orderBy("seed_rank", "nth").limit(total)


def closure(dependencies: DataFrame, start: DataFrame) -> DataFrame:
    """path: start and all that depend on it, directly or not. dependencies: path, needs.

    A frontier joined round by round until none is left, however long the chain. Each round's rows are put away.
    """
    frontier = cut(start.select("path").distinct())
    seen, parts = frontier, int(dependencies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        frontier = cut(dependencies.join(frontier.withColumnRenamed("path", "needs"), "needs").select("path").distinct().join(seen, "path", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier).coalesce(parts))


def dirty_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (ADDED, DELETED, MODIFIED) between two inventories of path, hash."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "DELETED").when(F.col("a") != F.col("b"), "MODIFIED")
    return both.withColumn("change", change).where("change IS NOT NULL").select("path", "change")


def prefix_matches(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """importer, module: names that are equal or one a dotted prefix of the other, as equi-joins on prefixes."""
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda n: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), n), "."))
    down = imports.withColumn("module", F.explode(prefixes(F.col("name")))).join(modules, "module").select("importer", "module")
    up = modules.withColumn("name", F.explode(prefixes(F.col("module")))).join(imports, "name").select("importer", "module")
    return down.union(up).distinct()


def merge_edges(drafts: DataFrame) -> DataFrame:
    """One edge a (src, dst, kind): greatest confidence, sorted references."""
    return drafts.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("reference")).alias("references"))


def two_hop_tests(calls: DataFrame, roles: DataFrame) -> DataFrame:
    """test, helper, target: test calls helper calls target; three nodes, helper and target not tests. min(c1, c2) * 0.8.

    calls: src, dst, confidence. roles: symbol_id, is_test.
    """
    is_test = roles.select("symbol_id", F.coalesce("is_test", F.lit(False)).alias("t"))
    tests, rest = is_test.where("t").select("symbol_id"), is_test.where("not t").select("symbol_id")
    first = calls.join(tests.withColumnRenamed("symbol_id", "src"), "src", "left_semi").join(rest.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi").select(F.col("src").alias("test"), F.col("dst").alias("helper"), F.col("confidence").alias("c1"))
    second = calls.join(rest.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi").select(F.col("src").alias("helper"), F.col("dst").alias("target"), F.col("confidence").alias("c2"))
    met = first.join(second, "helper").where((F.col("helper") != F.col("target")) & (F.col("test") != F.col("target")))
    return met.groupBy("test", "target").agg(F.max(F.round(F.least("c1", "c2") * 0.8, DIGITS)).alias("confidence"))


def test_gaps(changed: DataFrame, edges: DataFrame, roles: DataFrame, links_complete: bool = True) -> DataFrame:
    """symbol_id, status of each changed symbol: LINKED, NO_KNOWN_TEST_LINK, UNKNOWN or NOT_APPLICABLE.

    changed: symbol_id, kind, is_test (null unknown). A link counts with a positive valid
    confidence to another symbol that is a test; any other TESTED_BY edge makes absence unknown.
    """
    links = edges.where("kind = 'TESTED_BY'").join(roles.select(F.col("symbol_id").alias("dst"), F.col("is_test").alias("_t"), F.col("kind").alias("_k")), "dst", "left")
    good = valid_confidence() & (F.col("confidence") > 0) & F.coalesce("_t", F.lit(False)) & (F.col("src") != F.col("dst")) & F.coalesce(F.col("_k").isin("function", "method"), F.lit(False))
    seen = links.groupBy(F.col("src").alias("symbol_id")).agg(F.max(good).alias("linked"), F.max(~good).alias("unsure"))
    out = changed.join(seen, "symbol_id", "left")
    status = F.when(~F.col("kind").isin("function", "method"), "NOT_APPLICABLE").when(F.col("is_test").isNull(), "UNKNOWN").when(F.col("is_test"), "NOT_APPLICABLE")
    status = status.when(F.coalesce("linked", F.lit(False)), "LINKED").when(F.coalesce("unsure", F.lit(False)) | F.lit(not links_complete), "UNKNOWN").otherwise("NO_KNOWN_TEST_LINK")
    return out.select("symbol_id", status.alias("status"))
