"""Registered queries over the derived code graph, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.functions import vectors
from sparkloom.operators import changes, churn, evaluate, graph, recommend, retrieval, risk, scope, writes
from sparkloom.plans.derived import BASE_SQL, Derived
from sparkloom.plans.shapes import SHAPES
from sparkloom.schema import valid_confidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    def add(f: Callable[[Derived], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = (BASE_SQL + ", " + sql.strip().removeprefix("WITH ") if sql.strip().startswith("WITH ") else BASE_SQL + sql) if base else sql
        return f

    return add


def path(c):
    """An array of ids as text, which every engine compares alike."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


VALID = "confidence BETWEEN 0 AND 1"

# --- scans, lookups, projections -------------------------------------------------------------


@query("SELECT path, CASE WHEN ext = '' THEN 'unknown' ELSE coalesce(m[ext], 'unknown') END AS language, ext FROM (SELECT path, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext, MAP {'.py': 'python', '.ts': 'typescript'} AS m FROM files)")
def s4_language(d):
    return d.files.select("path", tx.language(F.col("path")).alias("language"), tx.extension(F.col("path")).alias("ext"))


# The credentials' patterns and what stands in for them, in DuckDB's words.
_REDACT = "documents.text"
for _p, _to in (
    ("\\b((?:aws_access_key_id|aws_secret_access_key|api[_-]?key|secret|password|token)\\b\\s*[:=]\\s*)([''\"]?)[^\\s''\";,]+", "\\1\\2[REDACTED]"),
    ("\\bgh[pousr]_[A-Za-z0-9_]{20,}\\b", "[REDACTED_GITHUB_TOKEN]"),
    ("\\bAKIA[0-9A-Z]{16}\\b", "[REDACTED_AWS_ACCESS_KEY]"),
    ("-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
):
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '{_to}', '{'gi' if 'aws' in _p else 'gs' if 'BEGIN' in _p else 'g'}')"


@query(f"SELECT doc_id, sha256({_REDACT}) AS digest FROM documents", base=False)
def s5_content_hash(d):
    return d.table("documents").select("doc_id", tx.content_hash(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, sha256({_REDACT}) AS digest, {_REDACT} <> text AS redacted FROM documents", base=False)
def s6_redaction(d):
    safe = tx.redact(F.col("text"))
    return d.table("documents").select("doc_id", F.sha2(safe, 256).alias("digest"), (safe != F.col("text")).alias("redacted"))


@query("SELECT symbol_id, name, kind FROM symbols WHERE symbol_id = 7")
def p1_symbol_by_id(d):
    return d.symbols.where("symbol_id = 7").select("symbol_id", "name", "kind")


@query("SELECT symbol_id, start_line FROM symbols WHERE file_id = 3")
def p2_symbols_by_file(d):
    return d.symbols.where("file_id = 3").orderBy("start_line", "symbol_id").select("symbol_id", "start_line")


@query("SELECT symbol_id, path, start_line FROM repo_symbols")
def p3_symbols_by_repository(d):
    return d.repo_symbols.select("symbol_id", "path", "start_line").orderBy("path", "start_line", "symbol_id")


@query("SELECT symbol_id FROM symbols WHERE file_id = 3 AND name = (SELECT min(name) FROM symbols WHERE file_id = 3) ORDER BY symbol_id LIMIT 1")
def p4_symbol_by_name(d):
    own = d.symbols.where("file_id = 3")
    return own.join(F.broadcast(own.agg(F.min("name").alias("name"))), "name").orderBy("symbol_id").limit(1).select("symbol_id")


@query("SELECT symbol_id, name FROM repo_symbols WHERE kind = 'class' AND name = 'red_widget'")
def p5_symbol_filter(d):
    return scope.symbol_filter(d.symbols, d.files, repository_id=1, kind="class", name="red_widget").select("symbol_id", "name")


@query("SELECT edge_id, src, dst, kind FROM edges WHERE dst = 5 OR src = 5")
def p6_edges_of(d):
    return d.edges.where("dst = 5 OR src = 5").select("edge_id", "src", "dst", "kind").orderBy("edge_id")


@query("SELECT symbol_id, name, path FROM repo_symbols WHERE kind = 'method' AND (name ILIKE '%D!_WIDGET%' ESCAPE '!' OR qualname ILIKE '%D!_WIDGET%' ESCAPE '!' OR path ILIKE '%D!_WIDGET%' ESCAPE '!') ORDER BY symbol_id LIMIT 50")
def p7_substring_search(d):
    return scope.substring_search(d.repo_symbols, "D_WIDGET", "method", 50).select("symbol_id", "name", "path")


@query("SELECT chunk_id, CASE WHEN qualname = 'mod_2.blue_bolt' THEN 0 ELSE 1 END AS place FROM chunks WHERE name = 'mod_2.blue_bolt' OR qualname = 'mod_2.blue_bolt' ORDER BY place, chunk_id LIMIT 30")
def p8_exact_search(d):
    hits = scope.exact_search(d.chunks, "mod_2.blue_bolt", 30)
    return hits.select("chunk_id", F.when(F.col("qualname") == "mod_2.blue_bolt", 0).otherwise(1).alias("place"))


@query("SELECT symbol_id, name FROM repo_symbols WHERE symbol_id IN (1, 5, 9, 40, 999999)")
def p9_hydrate(d):
    ids = d.spark.createDataFrame([(i,) for i in (1, 5, 9, 40, 999999)], "symbol_id long")
    return d.repo_symbols.join(F.broadcast(ids), "symbol_id", "left_semi").select("symbol_id", "name")


@query(f"SELECT edge_id FROM repo_edges WHERE {VALID}")
def p10_valid_confidence(d):
    return d.repo_edges.where(valid_confidence()).select("edge_id")


#: URLs of every kind beside the page's own: by the rule, (valid repository, valid pull request) of each is worked out by hand.
_URLS = {
    "https://github.com/ada-l/engine": (True, False), " HTTPS://GitHub.COM/ada/engine.rs/ ": (True, False), "https://github.com/-ada/engine": (False, False), "https://github.com/ada_l/engine": (False, False),
    "https://github.com/ada/..": (False, False), "https://github.com/ada/.git/": (False, False), "https://github.com/ada/.github": (True, False), "https://github.com/ada/en gine": (False, False),
    "https://github.com/ada/engine?x=1": (False, False), "https://github.com/ada/engine/pull/12": (False, True), "https://github.com/ada/engine/pull/0": (False, False), "https://github.com/ada/./pull/3": (False, False),
    "https://github.com/ada/engine/pull/7/": (False, True), "http://github.com/ada/engine": (False, False), "https://example.com/ada/engine": (False, False), "https://github.com/ada": (False, False),
}


@query(f"SELECT page_id, CASE WHEN k = {len(_URLS)} THEN false ELSE list_extract({[a for a, _ in _URLS.values()]}, k + 1) END AS repository, CASE WHEN k = {len(_URLS)} THEN false ELSE list_extract({[b for _, b in _URLS.values()]}, k + 1) END AS pull_request, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM (SELECT *, (page_id % {len(_URLS) + 1})::INTEGER AS k FROM pages)", base=False)
def p13_urls(d):
    made = F.element_at(F.array(*[F.lit(u) for u in _URLS], F.col("url")), (F.col("page_id") % (len(_URLS) + 1) + 1).cast("int"))
    return d.table("pages").select("page_id", tx.repository_url(made).alias("repository"), tx.pull_request_url(made).alias("pull_request"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))


@query("SELECT path, path <> '' AND NOT regexp_matches(path, '(^/|\\\\|(^/)(\\.{0,2})(/|$))') AND NOT regexp_matches(path, '(^|/)\\.{0,2}(/|$)') AS valid FROM files")
def p12_paths(d):
    return d.files.select("path", tx.relative_path(F.col("path")).alias("valid"))


@query("""WITH own AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM own)
SELECT l_orderkey, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line FROM i GROUP BY l_orderkey, island""")
def p14_line_ranges(d):
    return scope.line_ranges(d.table("lineitem").where("l_returnflag = 'R'"), ["l_orderkey"], "l_linenumber")


@query("""WITH own AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('R', 'A')),
i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS island FROM own)
SELECT l_orderkey, l_returnflag AS side, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line FROM i GROUP BY l_orderkey, l_returnflag, island""")
def p15_removed_added_ranges(d):
    rows = d.table("lineitem").where(F.col("l_returnflag").isin("R", "A"))
    return scope.line_ranges(rows, ["l_orderkey", "l_returnflag"], "l_linenumber").withColumnRenamed("l_returnflag", "side")


@query("SELECT o_custkey AS repository_id, max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey", base=False)
def p16_latest(d):
    rows = d.table("orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return scope.latest_by(rows, ["repository_id"], "id")


@query("SELECT symbol_id, CASE WHEN upper(split_part(name, ' ', 1)) IN ('GET','POST','PUT','DELETE','PATCH') OR contains(text, '@app.') OR contains(text, '@router.') THEN 'endpoint' WHEN lower(path) LIKE '%.md' OR lower(path) LIKE 'docs/%' OR lower(path) LIKE '%readme%' THEN 'documentation' ELSE 'symbol' END AS category FROM chunks")
def p17_classify(d):
    return d.chunks.select("symbol_id", scope.classify_hit(F.col("name"), F.col("path"), F.col("text")).alias("category"))


@query("SELECT kind AS category, count(*) AS n FROM repo_symbols WHERE name ILIKE '%bolt%' OR path ILIKE '%bolt%' GROUP BY kind")
def p18_tab_counts(d):
    return d.repo_symbols.where(F.col("name").ilike("%bolt%") | F.col("path").ilike("%bolt%")).groupBy(F.col("kind").alias("category")).agg(F.count("*").alias("n"))


# --- joins -----------------------------------------------------------------------------------


@query("SELECT c.chunk_id, s.name, f.path FROM chunks c JOIN symbols s USING (symbol_id) JOIN files f USING (file_id) WHERE f.repository_id = 1")
def j1_chunks_symbols_files(d):
    own = d.files.where("repository_id = 1").select("file_id", "path")
    return d.chunks.select("chunk_id", "symbol_id").join(d.symbols.select("symbol_id", "file_id", "name"), "symbol_id").join(own, "file_id").select("chunk_id", "name", "path")


@query("SELECT edge_id, src, dst, kind FROM repo_edges WHERE kind IN ('CALLS', 'INHERITS')")
def j2_scoped_edges(d):
    return scope.scoped_edges(d.edges, d.repo_symbols, ("CALLS", "INHERITS")).select("edge_id", "src", "dst", "kind")


@query("SELECT 'out' AS direction, edge_id, e.kind, s.symbol_id, s.name FROM edges e JOIN symbols s ON s.symbol_id = e.dst WHERE e.src = 5 UNION ALL SELECT 'in', edge_id, e.kind, s.symbol_id, s.name FROM edges e JOIN symbols s ON s.symbol_id = e.src WHERE e.dst = 5")
def j3_neighbours(d):
    return scope.neighbours(d.edges, d.symbols, 5).select("direction", "edge_id", "kind", "symbol_id", "name")


@query("SELECT edge_id FROM edges WHERE src IN (SELECT symbol_id FROM symbols WHERE kind IN ('function', 'method', 'class')) AND dst IN (SELECT symbol_id FROM symbols WHERE kind IN ('function', 'method', 'class'))")
def j4_semi_scope(d):
    return scope.scoped_edges(d.edges, d.symbols.where(F.col("kind").isin("function", "method", "class"))).select("edge_id")


@query("""WITH b AS (SELECT o_custkey AS src, o_orderkey % 1000 AS dst, substr(o_orderpriority, 1, 1) AS kind, min(o_orderkey) AS ordinal FROM orders GROUP BY 1, 2, 3),
stored AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 1000 AS dst, substr(o_orderpriority, 1, 1) AS kind FROM orders WHERE o_orderstatus = 'F')
SELECT src, dst, kind, ordinal FROM b ANTI JOIN stored USING (src, dst, kind)""")
def j7_new_edges(d):
    rows = d.table("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst"), F.substring("o_orderpriority", 1, 1).alias("kind"), F.col("o_orderkey").alias("ordinal"), "o_orderstatus")
    return writes.new_edges(rows.drop("o_orderstatus"), rows.where("o_orderstatus = 'F'")).select("src", "dst", "kind", "ordinal")


_LINES = "lines AS (SELECT DISTINCT l_suppkey AS file_id, (l_partkey % 420)::INTEGER AS line FROM lineitem), held AS (SELECT l.*, s.symbol_id, s.end_line - s.start_line AS width FROM lines l JOIN symbols s ON s.file_id = l.file_id AND l.line BETWEEN s.start_line AND s.end_line), best AS (SELECT file_id, line, min(width) AS w FROM held GROUP BY 1, 2), tied AS (SELECT h.file_id, h.line, count(*) AS n, min(symbol_id) AS symbol_id FROM held h JOIN best b ON b.file_id = h.file_id AND b.line = h.line AND b.w = h.width GROUP BY 1, 2)"


def _owners(d):
    lines = d.table("lineitem").select(F.col("l_suppkey").alias("file_id"), (F.col("l_partkey") % 420).cast("int").alias("line")).distinct()
    return scope.innermost(lines, d.symbols.select("file_id", "symbol_id", "start_line", "end_line", (F.col("end_line") - F.col("start_line")).alias("width")))


@query(f"WITH {_LINES} SELECT file_id, line, symbol_id FROM tied WHERE n = 1")
def j8_innermost_symbol(d):
    return _owners(d)[0]


@query(f"WITH {_LINES} SELECT file_id, line, 'AMBIGUOUS_LINE_OWNER' AS code FROM tied WHERE n > 1 UNION ALL SELECT file_id, line, 'MODULE_LEVEL_CHANGE' FROM lines l ANTI JOIN best USING (file_id, line)")
def j8_line_gaps(d):
    return _owners(d)[1]


#: Two versions of every symbol: some are renamed in the second, some have another header or body.
_SIDES = """a AS (SELECT file_id, kind, qualname, count(*) AS n, min(symbol_id) AS id FROM symbols WHERE qualname IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT file_id, kind, qualname || CASE WHEN symbol_id % 10 < 2 THEN '_new' ELSE '' END AS qualname, count(*) AS n, min(symbol_id) AS id FROM symbols WHERE qualname IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"""WITH {_SIDES}, p AS (SELECT 'f' || file_id AS path, kind, qualname, CASE WHEN a.n > 1 OR b.n > 1 THEN 'AMBIGUOUS_SYMBOL_IDENTITY' END AS gap,
  CASE WHEN a.n > 1 OR b.n > 1 THEN NULL WHEN a.n IS NULL THEN 'ADDED' WHEN b.n IS NULL THEN 'REMOVED' WHEN a.id % 4 = 0 THEN 'SIGNATURE_CHANGED' WHEN a.id % 4 = 1 THEN 'BODY_CHANGED' END AS change FROM a FULL JOIN b USING (file_id, kind, qualname))
SELECT path, kind, qualname, change, gap FROM p WHERE change IS NOT NULL OR gap IS NOT NULL""")
def j9_pair_symbols(d):
    k = F.col("symbol_id")
    own = d.symbols.where("qualname IS NOT NULL").select(F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("path"), "kind", "qualname", k.cast("string").alias("local_key"), "complexity", k.alias("k"), F.lit(None).cast("string").alias("error"))
    base = own.withColumns({"header_digest": F.lit("h"), "content_digest": F.lit("c")})
    head = own.withColumns({"qualname": F.concat("qualname", F.when(F.col("k") % 10 < 2, "_new").otherwise("")), "header_digest": F.when(F.col("k") % 4 == 0, "h2").otherwise("h"), "content_digest": F.when(F.col("k") % 4 < 2, "c2").otherwise("c")})
    return changes.pair_symbols(base, head).select("path", "kind", "qualname", "change", "gap")


@query("""WITH m AS (SELECT DISTINCT qualname AS module FROM symbols WHERE qualname IS NOT NULL UNION SELECT DISTINCT split_part(qualname, '.', 1) FROM symbols WHERE qualname IS NOT NULL),
i AS (SELECT DISTINCT file_id AS importer, qualname AS name FROM symbols WHERE qualname IS NOT NULL)
SELECT DISTINCT importer, module FROM i JOIN m ON name = module OR starts_with(name, module || '.') OR starts_with(module, name || '.')""")
def j10_prefix_imports(d):
    q = d.symbols.where("qualname IS NOT NULL")
    head = F.split_part("qualname", F.lit("."), F.lit(1))
    modules = q.select(F.col("qualname").alias("module")).union(q.select(head)).distinct()
    return graph.prefix_matches(q.select(F.col("file_id").alias("importer"), F.col("qualname").alias("name")).distinct(), modules)


@query("SELECT DISTINCT file_id AS importer, qualname AS module FROM symbols s JOIN (SELECT DISTINCT qualname FROM symbols WHERE qualname IS NOT NULL) q USING (qualname) WHERE s.kind <> 'module' UNION SELECT DISTINCT s.file_id, q.qualname FROM symbols s JOIN (SELECT DISTINCT qualname FROM symbols WHERE qualname IS NOT NULL) q ON s.kind = 'module' AND split_part(s.qualname, '.', 1) = split_part(q.qualname, '.', 1)")
def j10_package_imports(d):
    """Modules import the whole package of their name, other symbols their own: names that are prefixes of modules."""
    q = d.symbols.where("qualname IS NOT NULL")
    name = F.when(F.col("kind") == "module", F.split_part("qualname", F.lit("."), F.lit(1))).otherwise(F.col("qualname"))
    return graph.prefix_matches(q.select(F.col("file_id").alias("importer"), name.alias("name")).distinct(), q.select(F.col("qualname").alias("module")).distinct())


@query("""WITH impl AS (SELECT symbol_id, name, 'f' || (file_id % 40) AS stem FROM symbols),
tests AS (SELECT symbol_id + 10000000 AS test, symbol_id, name, CASE WHEN symbol_id % 3 = 0 THEN 'other' ELSE 'f' || (file_id % 40) END AS stem FROM symbols),
called AS (SELECT test, symbol_id AS implementation FROM tests WHERE symbol_id % 5 = 0),
named AS (SELECT t.test, count(*) AS n, min(i.symbol_id) AS implementation FROM tests t JOIN impl i USING (name, stem) WHERE t.test NOT IN (SELECT test FROM called) GROUP BY 1)
SELECT implementation, test, 1::DOUBLE AS confidence, 'direct' AS how FROM called UNION ALL SELECT implementation, test, 0.5::DOUBLE, 'name' FROM named WHERE n = 1""")
def j12_tests_by_name(d):
    """A test beside every symbol: some in a file of another name, some of a name that two symbols of the file share, some that call theirs."""
    from sparkloom.operators.resolve import test_links

    k, stem = F.col("symbol_id"), F.concat(F.lit("f"), (F.col("file_id") % 40).cast("string"))
    impl = d.symbols.select("symbol_id", F.concat(F.lit("src/"), stem, F.lit(".py")).alias("path"), "name", F.col("name").alias("qualname"), F.lit("function").alias("kind"))
    tested = F.when(k % 3 == 0, "other").otherwise(stem)
    test = F.concat(F.lit("test_"), "name")
    tests = d.symbols.select((k + 10_000_000).alias("symbol_id"), F.concat(F.lit("tests/test_"), tested, F.lit(".py")).alias("path"), test.alias("name"), test.alias("qualname"), F.lit("function").alias("kind"))
    calls = d.symbols.where(k % 5 == 0).select((k + 10_000_000).alias("src"), k.alias("dst"), F.lit(1.0).alias("confidence"))
    return test_links(impl.union(tests), calls)


@query(f"""WITH c AS (SELECT src, dst, confidence FROM edges WHERE kind = 'CALLS' AND {VALID}), t AS (SELECT symbol_id, coalesce(is_test, false) AS t FROM symbols)
SELECT a.src AS test, b.dst AS target, max(round(least(a.confidence, b.confidence) * 0.8::DOUBLE, 12)) AS confidence FROM c a JOIN c b ON a.dst = b.src JOIN t x ON x.symbol_id = a.src AND x.t JOIN t y ON y.symbol_id = a.dst AND NOT y.t JOIN t z ON z.symbol_id = b.dst AND NOT z.t
WHERE a.dst <> b.dst AND a.src <> b.dst GROUP BY 1, 2""")
def j13_two_hop_tests(d):
    calls = d.edges.where((F.col("kind") == "CALLS") & valid_confidence()).select("src", "dst", "confidence")
    return graph.two_hop_tests(calls, d.symbols.select("symbol_id", "is_test"))


@query("(SELECT src, dst, kind FROM edges0 WHERE confidence = 1 EXCEPT ALL SELECT src, dst, kind FROM edges0 WHERE confidence = 0.5) UNION ALL (SELECT src, dst, kind FROM edges0 WHERE confidence = 0.5 EXCEPT ALL SELECT src, dst, kind FROM edges0 WHERE confidence = 1)")
def j15_inventory_difference(d):
    nc = d.table("customer").count()
    kind = F.when(F.col("o_orderkey") % 17 == 0, "EXPOSES").otherwise(F.element_at(F.array(*[F.lit(k) for k in ("CALLS", "INHERITS", "USES", "IMPORTS", "TESTED_BY")]), F.substring("o_orderpriority", 1, 1).cast("int")))
    rows = d.table("orders").select("o_orderstatus", F.col("o_custkey").alias("src"), (F.col("o_orderkey") % nc).alias("dst"), kind.alias("kind")).where("src != dst")
    return scope.equal_rows(*[rows.where(F.col("o_orderstatus") == s).select("src", "dst", "kind") for s in "FO"]).drop("side")


@query("""WITH changed AS (SELECT symbol_id, name FROM repo_symbols WHERE path LIKE 'src/%00.py'), t AS (SELECT DISTINCT src FROM repo_edges WHERE kind = 'TESTED_BY'), x AS (SELECT e.dst, count(*) AS n FROM repo_edges e WHERE kind = 'EXPOSES' GROUP BY 1)
SELECT c.symbol_id, c.symbol_id IN (SELECT src FROM t) AS tested, coalesce(x.n, 0)::BIGINT AS exposures FROM changed c LEFT JOIN x ON x.dst = c.symbol_id""")
def j16_changed_path(d):
    return scope.changed_reach(d.repo_symbols.where(F.col("path").like("src/%00.py")), d.repo_edges)


@query(f"""WITH ends AS (SELECT symbol_id FROM symbols WHERE kind = 'endpoint'), l AS (SELECT src, count(DISTINCT dst) AS n, min(dst) AS h FROM edges WHERE kind = 'CALLS' AND {VALID} AND confidence >= 0.5 AND src IN (SELECT symbol_id FROM ends) GROUP BY 1)
SELECT symbol_id AS endpoint, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN h END AS handler FROM ends LEFT JOIN l ON l.src = symbol_id""")
def j18_endpoint_handlers(d):
    return recommend.handlers(d.symbols, d.edges)


# --- aggregates and windows -------------------------------------------------------------------


@query(f"SELECT count(*) AS edges, count(*) FILTER (confidence IS NULL OR NOT ({VALID})) AS skipped FROM repo_edges")
def a1_counts(d):
    return scope.counts(d.repo_edges)


def _churn_sql(days: int) -> str:
    return f"""WITH e AS (SELECT max(ts) AS t FROM commits), p AS (SELECT DISTINCT path FROM commits),
x AS (SELECT path, count(*) FILTER (ts >= t - INTERVAL {days} DAY) AS commit_count, count(DISTINCT author) FILTER (ts >= t - INTERVAL {days} DAY) AS distinct_authors, count(*) FILTER (ts >= t - INTERVAL {days} DAY AND bugfix) AS bugfix_commits, max(ts) AS last FROM commits, e WHERE ts <= t GROUP BY path)
SELECT path, coalesce(commit_count, 0) AS commit_count, coalesce(distinct_authors, 0) AS distinct_authors, coalesce(bugfix_commits, 0) AS bugfix_commits, epoch_us(last) AS last_modified_us, round(CASE WHEN commit_count > 0 THEN bugfix_commits::DOUBLE / commit_count ELSE 0::DOUBLE END, 9) AS bugfix_frequency FROM p LEFT JOIN x USING (path)"""


def _churn(d, days: int):
    end = d.commits.agg(F.max("ts")).first()[0]
    out = churn.churn(d.commits.select("path"), d.commits, F.lit(end), days)
    return out.withColumn("last_modified_us", F.unix_micros("last_modified_at")).drop("last_modified_at")


@query(_churn_sql(90))
def a2_churn_90_days(d):
    return _churn(d, 90)


@query(_churn_sql(7))
def a2_churn_7_days(d):
    return _churn(d, 7)


@query("SELECT src, dst, kind, max(confidence) AS confidence, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM (SELECT o_custkey AS src, o_orderkey % 100 AS dst, substr(o_orderpriority, 1, 1) AS kind, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5::DOUBLE END AS confidence, 'ref_' || (o_orderkey % 7) AS ref FROM orders) GROUP BY 1, 2, 3", base=False)
def a3_merge_edges(d):
    confidence = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5)
    drafts = d.table("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 100).alias("dst"), F.substring("o_orderpriority", 1, 1).alias("kind"), confidence.alias("confidence"), F.concat(F.lit("ref_"), (F.col("o_orderkey") % 7).cast("string")).alias("reference"))
    return graph.merge_edges(drafts).select("src", "dst", "kind", "confidence", F.array_join("references", ",").alias("refs"))


_FAN = f"fan AS (SELECT dst AS symbol_id, count(DISTINCT src) AS fan_in FROM edges WHERE kind = 'CALLS' AND {VALID} AND confidence >= 0.5 AND src IN (SELECT symbol_id FROM symbols WHERE NOT is_test AND kind <> 'endpoint') GROUP BY 1)"


@query(f"WITH {_FAN} SELECT * FROM fan")
def a4_fan_in(d):
    return recommend.fan_in(d.symbols, d.edges).select("symbol_id", "fan_in")


@query("SELECT kind, count(*) FILTER (c = 1) AS exact, count(*) FILTER (c = 0.5) AS inferred, count(*) FILTER (c = 0.4::DOUBLE) AS other, count(*) FILTER (c IS NULL OR c > 1) AS unresolved FROM (SELECT kind, CASE WHEN dst % 7 = 0 THEN 0.4::DOUBLE WHEN dst % 11 = 0 THEN 1.5::DOUBLE ELSE confidence END AS c FROM edges) GROUP BY kind")
def a15_status_histogram(d):
    c = F.when(F.col("dst") % 7 == 0, 0.4).when(F.col("dst") % 11 == 0, 1.5).otherwise(F.col("confidence"))
    return scope.status_histogram(d.edges.withColumn("confidence", c))


_EVAL = "pred AS (SELECT l_suppkey AS c, l_partkey % 50 AS item FROM lineitem WHERE l_discount > 0.05 AND l_suppkey % 7 <> 0 GROUP BY ALL), truth AS (SELECT l_suppkey AS c, l_partkey % 50 AS item FROM lineitem WHERE l_tax > 0.05 AND l_suppkey % 5 <> 0 GROUP BY ALL), cnt AS (SELECT c, count(*) FILTER (p AND t) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM (SELECT *, true AS p FROM pred) FULL JOIN (SELECT *, true AS t FROM truth) USING (c, item) GROUP BY c)"
_METRICS = "round(CASE WHEN tp + fp = 0 THEN CASE WHEN tp + fn = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END ELSE tp::DOUBLE / (tp + fp) END, 9) AS \"precision\", round(CASE WHEN tp + fn = 0 THEN 1::DOUBLE ELSE tp::DOUBLE / (tp + fn) END, 9) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 1::DOUBLE ELSE 2::DOUBLE * tp / (2 * tp + fp + fn) END, 9) AS f1"


def _counts(d):
    rows = d.table("lineitem").select(F.col("l_suppkey").alias("c"), (F.col("l_partkey") % 50).alias("item"), "l_discount", "l_tax")
    return evaluate.set_counts(rows.where("l_discount > 0.05 AND c % 7 != 0"), rows.where("l_tax > 0.05 AND c % 5 != 0"), "c")


@query(f"WITH {_EVAL} SELECT c, tp, fp, fn, {_METRICS} FROM cnt")
def a12_set_metrics(d):
    return evaluate.metrics(_counts(d))


@query(f"WITH {_EVAL}, every AS (SELECT s_suppkey AS c, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM supplier LEFT JOIN cnt ON c = s_suppkey) SELECT round(avg(f1), 9) AS macro_f1, round(2::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, count(*) AS cases FROM (SELECT *, {_METRICS} FROM every)")
def a13_macro_micro_f1(d):
    return evaluate.overall(d.table("supplier").select(F.col("s_suppkey").alias("c")), _counts(d), "c")


@query("""WITH truth AS (SELECT o_custkey AS query, o_orderkey AS item FROM orders WHERE o_orderstatus = 'F'),
top AS (SELECT o_custkey AS query, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
per AS (SELECT t.query, count(top.item)::DOUBLE / count(*) AS r FROM truth t LEFT JOIN top ON top.query = t.query AND top.item = t.item AND top.n <= 5 GROUP BY 1)
SELECT round(avg(r), 9) AS recall, count(*) AS queries FROM per""")
def a14_recall_at_k(d):
    rows = d.table("orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    return evaluate.recall_at(rows, rows.where("o_orderstatus = 'F'"), 5)


_RISK_IN = "r AS (SELECT c_custkey AS change_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 11) / 10.0::DOUBLE END AS blast_radius, CASE c_custkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS sensitivity, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 3) / 2.0::DOUBLE END AS test_gap, (c_custkey % 2) / 2.0::DOUBLE AS contract_changes, (c_custkey % 6) / 5.0::DOUBLE AS complexity_delta, least(1::DOUBLE, c_custkey / 500.0::DOUBLE) AS size FROM customer)"


@query(f"""WITH {_RISK_IN}, s AS (SELECT *, coalesce(blast_radius, 0) * 0.30 + coalesce(sensitivity, 0) * 0.20 + coalesce(test_gap, 0) * 0.20 + contract_changes * 0.15 + complexity_delta * 0.10 + size * 0.05 AS lo, CASE WHEN blast_radius IS NULL THEN 0.3 ELSE 0 END + CASE WHEN test_gap IS NULL THEN 0.2 ELSE 0 END AS gone FROM r)
SELECT change_id, round(lo::DOUBLE, 6) AS lower_bound, round((lo + gone)::DOUBLE, 6) AS upper_bound, CASE WHEN gone = 0 THEN round(lo::DOUBLE, 6) END AS score, CASE WHEN gone = 0 THEN CASE WHEN round(lo::DOUBLE, 9) < 0.25 THEN 'LOW' WHEN round(lo::DOUBLE, 9) < 0.5 THEN 'MEDIUM' WHEN round(lo::DOUBLE, 9) < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END END AS risk_level, CASE WHEN gone = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status FROM s""")
def a17_risk_interval(d):
    k = F.col("c_custkey")
    feats = d.table("customer").select(
        k.alias("change_id"), F.when(k % 5 != 0, (k % 11) / 10.0).alias("blast_radius"), F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.8, 0.6, 0.0)]), (k % 4 + 1).cast("int")).alias("sensitivity"), F.when(k % 9 != 0, (k % 3) / 2.0).alias("test_gap"),
        ((k % 2) / 2.0).alias("contract_changes"), ((k % 6) / 5.0).alias("complexity_delta"), F.least(F.lit(1.0), k / 500.0).alias("size"),
    )
    out = risk.score(feats)
    return out.select("change_id", *[F.round(c, 6).alias(c) for c in ("lower_bound", "upper_bound", "score")], "risk_level", "status")


_CHANGES = "ch AS (SELECT l_orderkey AS pr, CASE l_linenumber % 4 WHEN 0 THEN 'BODY_CHANGED' WHEN 1 THEN 'ADDED' WHEN 2 THEN 'REMOVED' ELSE 'SIGNATURE_CHANGED' END AS classification, CASE l_partkey % 4 WHEN 0 THEN 'LINKED' WHEN 1 THEN 'NO_KNOWN_TEST_LINK' WHEN 2 THEN 'NOT_APPLICABLE' ELSE CASE WHEN l_orderkey % 6 = 0 THEN 'UNKNOWN' ELSE 'LINKED' END END AS status, CASE WHEN l_partkey % 19 = 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE l_suppkey % 9 + 1 END AS o, l_partkey % 14 + 1 AS w FROM lineitem)"


@query(f"""WITH {_CHANGES}, x AS (SELECT *, CASE WHEN kind <> 'function' OR classification = 'REMOVED' THEN 0 ELSE greatest(0, w - CASE WHEN classification = 'ADDED' THEN 0 ELSE o END) END AS rise,
  kind = 'function' AND classification NOT IN ('REMOVED', 'ADDED') AND o IS NULL AS lost FROM ch)
SELECT pr, round(CASE WHEN count(*) FILTER (status = 'UNKNOWN') > 0 THEN NULL WHEN count(*) FILTER (status IN ('LINKED', 'NO_KNOWN_TEST_LINK')) = 0 THEN 0::DOUBLE ELSE count(*) FILTER (status = 'NO_KNOWN_TEST_LINK')::DOUBLE / count(*) FILTER (status IN ('LINKED', 'NO_KNOWN_TEST_LINK')) END, 9) AS test_gap,
  round(avg(CASE classification WHEN 'BODY_CHANGED' THEN 0::DOUBLE WHEN 'ADDED' THEN 0.5::DOUBLE ELSE 1::DOUBLE END), 9) AS contract_changes, round(CASE WHEN bool_or(lost) THEN NULL ELSE least(1::DOUBLE, max(rise)::DOUBLE / 10::DOUBLE) END, 9) AS complexity_delta FROM x GROUP BY pr""")
def a8_a10_change_features(d):
    k = ("BODY_CHANGED", "ADDED", "REMOVED", "SIGNATURE_CHANGED")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = d.table("lineitem").select(
        F.col("l_orderkey").alias("pr"), F.element_at(F.array(*[F.lit(x) for x in k]), F.col("l_linenumber") % 4 + 1).alias("classification"),
        F.when(p % 4 == 0, "LINKED").when(p % 4 == 1, "NO_KNOWN_TEST_LINK").when(p % 4 == 2, "NOT_APPLICABLE").when(F.col("l_orderkey") % 6 == 0, "UNKNOWN").otherwise("LINKED").alias("status"),
        F.when(p % 19 == 0, "class").otherwise("function").alias("kind"), F.when(s % 8 != 0, s % 9 + 1).alias("old_complexity"), (p % 14 + 1).alias("new_complexity"),
    )
    return risk.change_features(rows, ["pr"])


@query("SELECT l_orderkey AS pr, count(*) FILTER (l_returnflag IN ('R', 'A')) AS changed_lines, round(least(1::DOUBLE, count(*) FILTER (l_returnflag IN ('R', 'A')) / 500::DOUBLE), 9) AS size FROM lineitem GROUP BY 1", base=False)
def a11_changed_lines(d):
    kind = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    return risk.changed_lines(d.table("lineitem").select(F.col("l_orderkey").alias("pr"), kind.alias("kind")), ["pr"])


@query("WITH s AS (SELECT l_orderkey AS pr, l_returnflag AS side, sum(l_discount) AS m FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2) SELECT pr, round(max(m), 9) AS blast_mass, round(least(1::DOUBLE, max(m) / 50::DOUBLE), 9) AS blast_radius FROM s GROUP BY 1")
def a6_blast_mass(d):
    hits = d.table("lineitem").where("l_returnflag != 'N'").select(F.col("l_orderkey").alias("pr"), F.col("l_returnflag").alias("side"), F.col("l_discount").alias("score"))
    return risk.blast_mass(hits, ["pr"])


@query("SELECT file_id, max(CASE WHEN symbol_id % 17 = 0 THEN 1::DOUBLE WHEN kind = 'class' AND symbol_id % 2 = 0 THEN 0.8::DOUBLE WHEN kind = 'endpoint' THEN 0.6::DOUBLE ELSE 0::DOUBLE END) AS sensitivity FROM symbols GROUP BY 1")
def a7_sensitivity(d):
    return d.symbols.groupBy("file_id").agg(F.max(risk.sensitivity(F.col("symbol_id") % 17 == 0, (F.col("kind") == "class") & (F.col("symbol_id") % 2 == 0), F.col("kind") == "endpoint")).alias("sensitivity"))


# --- graph --------------------------------------------------------------------------------------


def _walk(kinds: str, start: str, depth: int, decay: float = 0.8) -> str:
    return f"""steps AS MATERIALIZED (SELECT * FROM repo_edges WHERE kind IN ({kinds}) AND {VALID}),
walk AS (SELECT symbol_id, 0 AS depth, 1::DOUBLE AS score, [symbol_id] AS sp, []::BIGINT[] AS ep FROM repo_symbols WHERE {start}
  UNION ALL SELECT e.src, w.depth + 1, round(w.score * e.confidence * CASE WHEN w.depth = 0 THEN 1::DOUBLE ELSE {decay}::DOUBLE END, 12), list_append(w.sp, e.src), list_append(w.ep, e.edge_id)
  FROM walk w JOIN steps e ON e.dst = w.symbol_id WHERE w.depth < {depth} AND NOT list_contains(w.sp, e.src))"""


_BEST = "SELECT *, min(depth) OVER (PARTITION BY symbol_id) AS min_depth, row_number() OVER (PARTITION BY symbol_id ORDER BY score DESC, depth, sp, ep) AS nth FROM walk"


@query(f"WITH {_walk("'CALLS', 'INHERITS'", 'symbol_id = 1', 4)} SELECT b.symbol_id, s.name, s.kind, b.depth, b.min_depth, round(b.score, 9) AS score, array_to_string(b.sp, ',') AS symbol_path, array_to_string(b.ep, ',') AS edge_path FROM ({_BEST} WHERE depth > 0) b JOIN repo_symbols s USING (symbol_id) WHERE nth = 1")
def g1_reverse_reachability(d):
    out = graph.reverse_reach(d.symbols, d.files, d.edges, 1, 1)
    return out.select("symbol_id", "name", "kind", "depth", "min_depth", F.round("score", 9).alias("score"), path("symbol_path").alias("symbol_path"), path("edge_path").alias("edge_path"))


@query(f"WITH {_walk("'CALLS', 'INHERITS', 'USES'", 'symbol_id IN (1, 2, 5)', 3)} SELECT b.symbol_id, b.depth, b.min_depth, round(b.score, 9) AS score, b.sp[1] AS seed, s.file_id, s.kind = 'endpoint' AS is_endpoint, array_to_string(b.ep, ',') AS edge_path FROM ({_BEST}) b JOIN repo_symbols s USING (symbol_id) WHERE nth = 1")
def g3_blast_radius(d):
    seeds = d.spark.createDataFrame([(1,), (2,), (5,)], "symbol_id long")
    out = graph.blast_radius(d.symbols, d.files, d.edges, 1, seeds, 3)
    return out.select("symbol_id", "depth", "min_depth", F.round("score", 9).alias("score"), "seed", "file_id", "is_endpoint", path("edge_path").alias("edge_path"))


@query(f"""WITH {_walk("'CALLS', 'INHERITS', 'USES'", 'symbol_id IN (1, 2, 5)', 2)}, seen AS (SELECT w.depth, e.* FROM walk w JOIN repo_edges e ON e.dst = w.symbol_id WHERE e.kind IN ('CALLS', 'INHERITS', 'USES') AND NOT list_contains(w.sp, e.src))
SELECT count(DISTINCT edge_id) FILTER (confidence IS NULL) AS skipped, count(*) FILTER (depth = 2 AND {VALID} AND src NOT IN (SELECT symbol_id FROM walk)) > 0 AS depth_limited FROM seen""")
def g3_blast_limits(d):
    own = scope.scoped_edges(d.edges, d.repo_symbols, graph.BLAST_KINDS)
    seeds = d.repo_symbols.where(F.col("symbol_id").isin(1, 2, 5)).select("symbol_id")
    skipped, limited = graph.blast_examined(own, graph.walks(own, seeds, 2))
    return skipped.agg(F.count("*").alias("skipped")).crossJoin(limited)


@query(f"WITH {_walk("'CALLS', 'INHERITS', 'USES'", 'symbol_id IN (1, 2, 5)', 2)} SELECT DISTINCT e.src, e.dst, e.edge_id, e.confidence FROM repo_edges e JOIN walk w ON w.symbol_id = e.dst JOIN repo_symbols s ON s.symbol_id = e.dst WHERE e.kind = 'EXPOSES' AND s.kind = 'endpoint'")
def j14_exposures(d):
    seeds = d.spark.createDataFrame([(1,), (2,), (5,)], "symbol_id long")
    return graph.exposures(d.repo_edges, graph.blast_radius(d.symbols, d.files, d.edges, 1, seeds, 2))


@query(f"WITH {_walk("'CALLS', 'INHERITS', 'USES'", 'symbol_id IN (1, 2, 5)', 2)} SELECT s.kind, string_agg(DISTINCT s.symbol_id::VARCHAR, ',' ORDER BY s.symbol_id::VARCHAR) AS ids, count(DISTINCT s.file_id) AS files FROM walk w JOIN repo_symbols s USING (symbol_id) GROUP BY s.kind")
def a16_affected_sets(d):
    seeds = d.spark.createDataFrame([(1,), (2,), (5,)], "symbol_id long")
    hits = graph.blast_radius(d.symbols, d.files, d.edges, 1, seeds, 2)
    return hits.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set(F.col("symbol_id").cast("string"))), ",").alias("ids"), F.count_distinct("file_id").alias("files"))


_TYPED = f"typed AS MATERIALIZED (SELECT e.*, a.kind AS sk, b.kind AS dk FROM repo_edges e JOIN repo_symbols a ON a.symbol_id = e.src JOIN repo_symbols b ON b.symbol_id = e.dst WHERE {VALID} AND CASE e.kind WHEN 'EXPOSES' THEN a.kind = 'module' AND b.kind = 'endpoint' WHEN 'INHERITS' THEN a.kind = 'class' AND b.kind = 'class' ELSE true END), seeds AS (SELECT symbol_id, row_number() OVER (ORDER BY symbol_id) AS seed_rank FROM (SEEDS))"
#: Seeds of an intent: some symbols; for inheritance the first classes that have a base.
_SEEDS = {"inheritance": "SELECT DISTINCT e.src AS symbol_id FROM repo_edges e JOIN repo_symbols a ON a.symbol_id = e.src JOIN repo_symbols b ON b.symbol_id = e.dst WHERE e.kind = 'INHERITS' AND a.kind = 'class' AND b.kind = 'class' ORDER BY 1 LIMIT 6"}


def _expand_sql(intent: str) -> str:
    parts = []
    for pattern in graph.PATTERNS[intent]:
        for n, (k, way) in enumerate(pattern, 1):
            rule = " AND e{n}.sk = 'endpoint' AND e{n}.dk IN ('function', 'method')".replace("{n}", str(n)) if intent == "endpoints" and (k, way) == ("CALLS", "out") else ""
            at, nxt = ("src", "dst") if way == "out" else ("dst", "src")
            before = "s.symbol_id" if n == 1 else last  # noqa: F821
            join = f"JOIN typed e{n} ON e{n}.kind = '{k}' AND e{n}.{at} = {before} AND e{n}.{nxt} <> s.symbol_id{rule}" + (f" AND e{n}.{nxt} <> {before}" if n > 1 else "")
            joins = join if n == 1 else joins + " " + join  # noqa: F821
            last = f"e{n}.{nxt}"
            nodes = f"s.symbol_id, {last}" if n == 1 else nodes + f", {last}"  # noqa: F821
        h = len(pattern)
        conf = " * ".join(f"e{i}.confidence" for i in range(1, h + 1))
        parts.append(f"SELECT s.symbol_id AS seed, s.seed_rank, {last} AS symbol_id, round({conf}, 12) AS confidence, {h} AS hops, [{nodes}] AS sp, [{', '.join(f'e{i}.edge_id' for i in range(1, h + 1))}] AS ep FROM seeds s {joins}")
    typed = _TYPED.replace("SEEDS", _SEEDS.get(intent, "SELECT symbol_id FROM repo_symbols WHERE symbol_id IN (1, 2, 3, 5, 8, 13)"))
    return f"""WITH {typed}, every AS ({' UNION ALL '.join(parts)}),
best AS (SELECT *, row_number() OVER (PARTITION BY seed, symbol_id ORDER BY confidence DESC, hops, sp, ep) AS one FROM every),
top AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, hops, sp, ep) AS nth FROM best WHERE one = 1)
SELECT seed, nth, symbol_id, round(confidence, 9) AS confidence, hops, array_to_string(sp, ',') AS symbol_path, array_to_string(ep, ',') AS edge_path FROM top WHERE nth <= 20 ORDER BY seed_rank, nth LIMIT 80"""


def _expand(intent: str):
    def run(d):
        seeds = d.repo_symbols.where(F.col("symbol_id").isin(1, 2, 3, 5, 8, 13)).select("symbol_id")
        if intent == "inheritance":
            classes = d.repo_symbols.where("kind = 'class'").select("symbol_id")
            seeds = scope.scoped_edges(d.edges, classes, ("INHERITS",)).select(F.col("src").alias("symbol_id")).distinct().orderBy("symbol_id").limit(6)
        seeds = retrieval.ranks(seeds, "symbol_id", "symbol_id").select(F.col("id").alias("symbol_id"), F.col("rank").alias("seed_rank"))
        out = graph.typed_expand(d.repo_symbols, d.repo_edges, seeds, intent)
        return out.select("seed", "nth", "symbol_id", F.round("confidence", 9).alias("confidence"), "hops", path("symbol_path").alias("symbol_path"), path("edge_path").alias("edge_path"))

    run.__name__ = f"g6_expand_{intent}"
    return query(_expand_sql(intent))(run)


for _intent in graph.PATTERNS:
    _expand(_intent)


@query(f"""WITH tb AS (SELECT e.src, bool_or(coalesce({VALID} AND confidence > 0 AND coalesce(t.is_test, false) AND e.src <> e.dst AND t.kind IN ('function', 'method'), false)) AS linked, bool_or(NOT coalesce({VALID} AND confidence > 0 AND coalesce(t.is_test, false) AND e.src <> e.dst AND t.kind IN ('function', 'method'), false)) AS unsure FROM edges e LEFT JOIN symbols t ON t.symbol_id = e.dst WHERE e.kind = 'TESTED_BY' GROUP BY 1)
SELECT s.symbol_id, CASE WHEN kind NOT IN ('function', 'method') THEN 'NOT_APPLICABLE' WHEN is_test IS NULL THEN 'UNKNOWN' WHEN is_test THEN 'NOT_APPLICABLE' WHEN coalesce(linked, false) THEN 'LINKED' WHEN coalesce(unsure, false) THEN 'UNKNOWN' ELSE 'NO_KNOWN_TEST_LINK' END AS status FROM symbols s LEFT JOIN tb ON tb.src = s.symbol_id""")
def g7_test_gaps(d):
    return graph.test_gaps(d.symbols.select("symbol_id", "kind", "is_test"), d.edges, d.symbols.select("symbol_id", "kind", "is_test"))


@query("""WITH deps AS (SELECT DISTINCT a.path AS path, b.path AS needs FROM repo_edges e JOIN repo_symbols a ON a.symbol_id = e.src JOIN repo_symbols b ON b.symbol_id = e.dst WHERE e.kind = 'IMPORTS'),
reach AS (SELECT path FROM files WHERE file_id IN (0, 1) UNION SELECT d.path FROM deps d JOIN reach r ON d.needs = r.path) SELECT path FROM reach""")
def g8_dirty_closure(d):
    own = d.repo_symbols.select("symbol_id", "path")
    a, b = own.withColumnRenamed("symbol_id", "src"), own.withColumnsRenamed({"symbol_id": "dst", "path": "needs"})
    deps = d.repo_edges.where("kind = 'IMPORTS'").join(a, "src").join(b, "dst").select("path", "needs").distinct()
    return graph.closure(deps.persist(), d.files.where("file_id IN (0, 1)").select("path"))


@query("""WITH a AS (SELECT path, file_id % 3 AS hash FROM files), b AS (SELECT path || CASE WHEN file_id % 10 = 1 THEN '.moved' ELSE '' END AS path, file_id % 4 AS hash FROM files)
SELECT path, CASE WHEN a.hash IS NULL THEN 'ADDED' WHEN b.hash IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM a FULL JOIN b USING (path) WHERE a.hash IS DISTINCT FROM b.hash""")
def t7_dirty_paths(d):
    f = d.files
    moved = F.concat("path", F.when(F.col("file_id") % 10 == 1, ".moved").otherwise("")).alias("path")
    return graph.dirty_paths(f.select("path", (F.col("file_id") % 3).alias("hash")), f.select(moved, (F.col("file_id") % 4).alias("hash")))


@query("SELECT f.path || '::' || coalesce(s.qualname, s.name) || '::' || s.kind AS label, start_line, end_line FROM symbols s JOIN files f USING (file_id)")
def g12_canonical_nodes(d):
    return writes.canonical(d.symbols, d.files, d.edges)[0]


# --- retrieval ------------------------------------------------------------------------------------


def _norm_sql(c: str) -> str:
    for pattern, to in tx.IDENTIFIER_SPLITS:
        c = f"regexp_replace({c}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim(lower({c}))"


@query(f"SELECT doc_id, md5({_norm_sql('text')}) AS normal FROM documents", base=False)
def r1_normalise(d):
    return d.table("documents").select("doc_id", F.md5(tx.normalize_identifier(F.col("text"))).alias("normal"))


_TOK = f"tok AS (SELECT *, list_filter(string_split({_norm_sql('name')}, ' ') || string_split({_norm_sql("coalesce(qualname, '')")}, ' '), lambda x: x <> '') AS nt, list_filter(string_split({_norm_sql('text')}, ' '), lambda x: x <> '') AS bt FROM chunks)"


@query(f"WITH {_TOK} SELECT chunk_id FROM tok WHERE list_has_all(nt || bt, ['the', 'widget'])")
def r2_full_text_match(d):
    return retrieval.matches(retrieval.search_columns(d.chunks), "the Widget").select("chunk_id")


_LEX = f"{_TOK}, lex AS (SELECT chunk_id, raw / (raw + 1::DOUBLE) AS s FROM (SELECT chunk_id, len(list_filter(nt, lambda x: list_contains(['the', 'widget'], x)))::DOUBLE * 1.0::DOUBLE + len(list_filter(bt, lambda x: list_contains(['the', 'widget'], x)))::DOUBLE * 0.4::DOUBLE AS raw FROM tok WHERE list_has_all(nt || bt, ['the', 'widget'])) ORDER BY round(s, 9) DESC, chunk_id LIMIT 30)"


@query(f"WITH {_LEX} SELECT chunk_id, round(s, 9) AS score FROM lex")
def t3_lexical_top(d):
    return retrieval.lexical(retrieval.search_columns(d.chunks), "the widget", 30, density=False).select("chunk_id", "score")


@query()
def r3_cover_density(d):
    return retrieval.lexical(retrieval.search_columns(d.chunks), "the widget", 30).select("chunk_id", F.round("score", 9).alias("score"))


_QUERY_VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_QV = "[" + ", ".join(f"{x}::DOUBLE" for x in _QUERY_VECTOR) + "]"
_DIST = f"round(1::DOUBLE - list_dot_product(embedding::DOUBLE[], {_QV}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_QV}, {_QV}))), 9)"


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 20", base=False)
def t1_vector_top(d):
    return retrieval.vector_top(d.table("embeddings"), _QUERY_VECTOR, 20).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b", base=False)
def r6_cosine(d):
    one = d.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    return d.table("embeddings").crossJoin(F.broadcast(one)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("""WITH x AS (SELECT l_partkey AS id, min(struct_pack(a := -l_quantity, b := l_partkey)) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), y AS (SELECT l_partkey AS id, min(struct_pack(a := l_extendedprice, b := l_partkey)) AS o FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
r AS (SELECT id, row_number() OVER (ORDER BY o, id) AS rank FROM x UNION ALL SELECT id, row_number() OVER (ORDER BY o, id) FROM y)
SELECT id, round(sum(1::DOUBLE / (60::DOUBLE + rank)), 12) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 50""")
def r7_rank_fusion(d):
    rows = d.table("lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", (-F.col("l_quantity")).alias("a"), F.col("l_extendedprice").alias("p"))
    x = retrieval.ranks(rows.where("l_returnflag = 'R'"), "k", "a", "k", bounded=False)
    y = retrieval.ranks(rows.where("l_returnflag = 'A'"), "k", "p", "k", bounded=False)
    return retrieval.fuse([x, y], limit=50)


@query(f"""WITH {_LEX}, ex AS (SELECT chunk_id, CASE WHEN qualname = 'the widget' THEN 0 ELSE 1 END AS o FROM chunks WHERE name = 'the widget' OR qualname = 'the widget' ORDER BY o, chunk_id LIMIT 30),
vec AS (SELECT chunk_id, {_DIST} AS o FROM chunks WHERE embedding IS NOT NULL ORDER BY o, chunk_id LIMIT 30),
r AS (SELECT chunk_id, row_number() OVER (ORDER BY o, chunk_id) AS k FROM ex UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY round(s, 9) DESC, chunk_id) FROM lex UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY o, chunk_id) FROM vec)
SELECT chunk_id, round(score, 9) AS score, name FROM (SELECT chunk_id, round(sum(1::DOUBLE / (60::DOUBLE + k)), 12) AS score FROM r GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 10) JOIN chunks USING (chunk_id)""")
def r8_hybrid_search(d):
    chunks = retrieval.search_columns(d.chunks)
    return retrieval.hybrid(chunks, "the widget", _QUERY_VECTOR, 10).select("chunk_id", F.round("score", 9).alias("score"), "name")


@query("SELECT doc_id, i AS chunk_no, substr(text, i * 512 + 1, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 512.0) AS BIGINT)))::INTEGER AS i FROM documents WHERE length(text) > 0)", base=False)
def r11_fixed_chunks(d):
    return retrieval.fixed_chunks(d.table("documents"), 512)


@query("""WITH RECURSIVE rows AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS n FROM conversations),
fold AS (SELECT conv_id, 0::BIGINT AS n, NULL::BIGINT AS turn, 0::BIGINT AS cost, 0::BIGINT AS used, 0::BIGINT AS kept, false AS here FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL SELECT r.conv_id, r.n, r.turn, r.cost, f.used + CASE WHEN f.used + r.cost <= 900 AND f.kept < 6 THEN r.cost ELSE 0 END, f.kept + CASE WHEN f.used + r.cost <= 900 AND f.kept < 6 THEN 1 ELSE 0 END, f.used + r.cost <= 900 AND f.kept < 6 FROM fold f JOIN rows r ON r.conv_id = f.conv_id AND r.n = f.n + 1)
SELECT conv_id, 'E' || kept AS cite, turn::BIGINT AS turn, cost::BIGINT AS cost FROM fold WHERE here""", base=False)
def r15_evidence_budget(d):
    rows = d.table("conversations").select("conv_id", "turn", F.length("text").alias("cost"))
    return retrieval.budget(rows, ["conv_id"], "turn", "cost", entries=6, chars=900).select("conv_id", "cite", F.col("turn").cast("long").alias("turn"), F.col("cost").cast("long").alias("cost"))


@query("SELECT conv_id, turn, '> ' || replace(text, chr(10), chr(10) || '> ') AS marked FROM conversations", base=False)
def r17_spotlight(d):
    return d.table("conversations").select("conv_id", "turn", tx.spotlight(F.col("text")).alias("marked"))


# --- recommendations, reports ----------------------------------------------------------------------

_FOUND = f"""{_FAN}, hl AS (SELECT src, count(DISTINCT dst) AS n, min(dst) AS h FROM edges WHERE kind = 'CALLS' AND {VALID} AND confidence >= 0.5 GROUP BY 1),
plain AS (SELECT s.*, coalesce(fan_in, 0) AS fan_in FROM symbols s LEFT JOIN fan USING (symbol_id) WHERE kind IN ('function', 'method') AND NOT is_test),
ends AS (SELECT s.symbol_id, coalesce(hl.n, 0) AS n, t.kind AS hk, t.docstring AS doc, t.documentation_known AS known FROM symbols s LEFT JOIN hl ON hl.src = s.symbol_id LEFT JOIN symbols t ON t.symbol_id = CASE WHEN hl.n = 1 THEN hl.h END WHERE s.kind = 'endpoint'),
found AS (SELECT symbol_id, 'UNTESTED_HOTSPOT' AS category, fan_in::BIGINT AS measured FROM plain WHERE fan_in >= 5 AND symbol_id NOT IN (SELECT src FROM edges WHERE kind = 'TESTED_BY')
  UNION ALL SELECT symbol_id, 'COMPLEXITY_HOTSPOT', complexity::BIGINT FROM plain WHERE complexity >= 10
  UNION ALL SELECT symbol_id, 'API_DOC_GAP', NULL FROM ends WHERE n = 1 AND hk IN ('function', 'method') AND known AND trim(coalesce(doc, '')) = '')"""


@query(f"WITH {_FOUND} SELECT * FROM found")
def c1_candidates(d):
    return recommend.detect(d.symbols, d.edges)[0]


@query(f"WITH {_FOUND} SELECT symbol_id, 'TEST_ROLE_UNKNOWN' AS code FROM symbols WHERE kind IN ('function', 'method') AND is_test IS NULL UNION ALL SELECT symbol_id, 'COMPLEXITY_UNKNOWN' FROM plain WHERE complexity IS NULL UNION ALL SELECT symbol_id, CASE WHEN n <> 1 THEN 'ENDPOINT_HANDLER_UNKNOWN' WHEN hk NOT IN ('function', 'method') THEN 'ENDPOINT_HANDLER_INVALID' ELSE 'DOCUMENTATION_UNKNOWN' END FROM ends WHERE n <> 1 OR hk NOT IN ('function', 'method') OR NOT known")
def c1_gaps(d):
    return recommend.detect(d.symbols, d.edges)[1]


_FEATS = f"""{_FOUND}, x AS (SELECT f.*, s.complexity, s.end_line - s.start_line + 1 AS lines, greatest(0::DOUBLE, coalesce(measured, s.complexity, 10)::DOUBLE - 10::DOUBLE) AS over FROM found f LEFT JOIN symbols s USING (symbol_id)),
feats AS (SELECT symbol_id, category, measured,
  round(CASE category WHEN 'UNTESTED_HOTSPOT' THEN 5::DOUBLE + greatest(0::DOUBLE, least(5::DOUBLE, (measured - 5) * 0.5::DOUBLE)) WHEN 'COMPLEXITY_HOTSPOT' THEN 4::DOUBLE + least(6::DOUBLE, over * 0.4::DOUBLE) ELSE 4.5::DOUBLE END, 4) AS impact,
  round(CASE category WHEN 'UNTESTED_HOTSPOT' THEN least(0.95::DOUBLE, 0.7::DOUBLE + least(0.2::DOUBLE, measured * 0.02::DOUBLE) + CASE WHEN coalesce(complexity, 0) >= 10 THEN 0.05::DOUBLE ELSE 0::DOUBLE END) WHEN 'COMPLEXITY_HOTSPOT' THEN least(0.95::DOUBLE, 0.55::DOUBLE + least(0.4::DOUBLE, over * 0.03::DOUBLE)) ELSE 0.65::DOUBLE END, 4) AS likelihood,
  round(CASE category WHEN 'UNTESTED_HOTSPOT' THEN 1::DOUBLE + least(3::DOUBLE, coalesce(nullif(complexity, 0), 4)::DOUBLE * 0.15::DOUBLE) + least(2::DOUBLE, coalesce(nullif(lines, 0), 20)::DOUBLE * 0.02::DOUBLE) WHEN 'COMPLEXITY_HOTSPOT' THEN 2::DOUBLE + least(6::DOUBLE, over * 0.3::DOUBLE) ELSE 1::DOUBLE END, 4) AS effort,
  CASE category WHEN 'API_DOC_GAP' THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM x)"""


@query(f"WITH {_FEATS} SELECT * FROM feats")
def c2_features(d):
    return recommend.features(recommend.detect(d.symbols, d.edges)[0], d.symbols)


@query(f"WITH {_FEATS} SELECT symbol_id, category, round(impact * likelihood / greatest(0.5::DOUBLE, effort) * confidence * 1.0::DOUBLE, 4) AS score FROM feats")
def c3_priority(d):
    return recommend.prioritise(recommend.features(recommend.detect(d.symbols, d.edges)[0], d.symbols)).select("symbol_id", "category", "score")


@query(f"WITH {_FEATS}, s AS (SELECT symbol_id, category, round(impact * likelihood / greatest(0.5::DOUBLE, effort) * confidence, 4) AS score FROM feats) SELECT symbol_id, category, score, row_number() OVER (ORDER BY score DESC NULLS LAST, symbol_id, category)::INTEGER AS rank FROM s ORDER BY rank LIMIT 25")
def t4_ranked_findings(d):
    items = recommend.prioritise(recommend.features(recommend.detect(d.symbols, d.edges)[0], d.symbols)).select("symbol_id", "category", "score")
    runs = d.spark.createDataFrame([], "repository_id long, snapshot_id long, digest string")
    return writes.publish(items, runs, 1, 1)[1].orderBy("rank").limit(25).select("symbol_id", "category", "score", "rank")


@query(f"WITH {_FEATS} SELECT symbol_id, category, printf('%s: impact %.2f, likelihood %.2f, effort %.2f, confidence %.2f give priority %.4f.', category, impact, likelihood, effort, confidence, round(impact * likelihood / greatest(0.5::DOUBLE, effort) * confidence, 4)) AS rationale FROM feats")
def c5_rationale(d):
    return recommend.rationale(recommend.prioritise(recommend.features(recommend.detect(d.symbols, d.edges)[0], d.symbols))).select("symbol_id", "category", "rationale")


@query("""WITH r AS (SELECT c_custkey AS change_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 11) / 10.0::DOUBLE END AS b FROM customer),
s AS (SELECT *, round(coalesce(b, 0::DOUBLE) * 0.3::DOUBLE + 0.24::DOUBLE, 9) AS lo FROM r)
SELECT change_id, CASE WHEN b IS NULL THEN printf('Risk between %.2f and %.2f; unknown: blast_radius.', lo, lo + 0.3::DOUBLE) ELSE printf('Risk %s (%s).', printf('%.2f', lo), CASE WHEN lo < 0.25 THEN 'LOW' WHEN lo < 0.5 THEN 'MEDIUM' ELSE 'HIGH' END) END AS summary,
  CASE WHEN b IS NULL THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status, round(b * 0.3::DOUBLE, 6) AS blast, lo AS lower_bound FROM s""", base=False)
def c7_reports(d):
    k = F.col("c_custkey")
    feats = d.table("customer").select(k.alias("change_id"), F.when(k % 5 != 0, (k % 11) / 10.0).alias("blast_radius"), F.lit(0.6).alias("sensitivity"), F.lit(0.5).alias("test_gap"), F.lit(0.0).alias("contract_changes"), F.lit(0.2).alias("complexity_delta"), F.lit(0.0).alias("size"))
    field = lambda p: F.get_json_object("report", p)
    return risk.report(risk.score(feats)).select("change_id", "summary", field("$.status").alias("status"), F.round(field("$.contributions.blast_radius").cast("double"), 6).alias("blast"), F.round(field("$.lower_bound").cast("double"), 9).alias("lower_bound"))


_ENDPOINTS = {"GET /a": "GET", "post /b": "POST", "Delete /c": "DELETE", "PUT /d": "PUT", "patch": "PATCH", "HEAD /e": "UNKNOWN", "get_user": "UNKNOWN", "": "UNKNOWN"}


@query(f"SELECT event_id, list_extract({list(_ENDPOINTS.values())}, (event_id % {len(_ENDPOINTS)})::INTEGER + 1) AS method FROM events", base=False)
def c18_endpoint_method(d):
    made = F.element_at(F.array(*[F.lit(x) for x in _ENDPOINTS]), (F.col("event_id") % len(_ENDPOINTS) + 1).cast("int"))
    return d.table("events").select("event_id", tx.endpoint_method(made).alias("method"))


# Words of a bug fix, in DuckDB's words.
@query("SELECT doc_id, regexp_matches(text, '\\b(?:fix(?:es|ed|ing)?|bugfix(?:es)?|hotfix(?:es)?|bugs?|regressions?)\\b', 'i') AS bugfix FROM documents", base=False)
def c16_bugfix_subject(d):
    return d.table("documents").select("doc_id", tx.is_bugfix(F.col("text")).alias("bugfix"))


@query("SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN url END, 'patch:' || sha256(html)) AS analysis_key FROM pages", base=False)
def c17_analysis_key(d):
    return d.table("pages").select("page_id", tx.analysis_key(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.col("html")).alias("analysis_key"))


@query("SELECT l_orderkey AS pr, count(*) AS changed, round(least(0.02::DOUBLE + count(*) * 0.003::DOUBLE, 0.75::DOUBLE), 2) AS risk, CASE WHEN count(*) > 50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM lineitem GROUP BY 1", base=False)
def h_quick_risk(d):
    per = d.table("lineitem").groupBy(F.col("l_orderkey").alias("pr")).agg(F.count("*").alias("changed"))
    return per.select("pr", "changed", risk.quick_risk(F.col("changed")).alias("risk"), F.when(F.col("changed") > 50, "MEDIUM").otherwise("LOW").alias("level"))


# --- sources: texts made from the tables, so that SQL knows what must come out ------------------------


def _made_files(d, body):
    k = F.col("s_suppkey")
    return d.table("supplier").select((k % 3).alias("repository_id"), F.concat(F.lit("src/p"), k.cast("string"), F.lit(".py")).alias("path"), body(k).cast("binary").alias("content"))


@query("SELECT 'src/p' || s_suppkey || '.py' AS path, 'f' AS name, 'function' AS kind, 1 AS start_line, (s_suppkey % 7 + 2)::INTEGER AS end_line, (1 + 2 * (s_suppkey % 7))::INTEGER AS complexity FROM supplier", base=False)
def x3_symbols_and_complexity(d):
    from sparkloom.sources.pysource import parse_files

    files = _made_files(d, lambda k: F.concat(F.lit("def f(a):\n"), F.expr("repeat('    if a and a: pass\n', int(s_suppkey % 7))"), F.lit("    return a\n")))
    return parse_files(files).select("path", "name", "kind", "start_line", "end_line", "complexity")


@query("SELECT s_suppkey % 3 AS repository_id, 'EXACT' AS status, 'call' AS kind, sum(s_suppkey % 4 + 1)::BIGINT AS n FROM supplier GROUP BY 1 UNION ALL SELECT s_suppkey % 3, 'UNRESOLVED', 'call', count(*) FROM supplier GROUP BY 1", base=False)
def x12_resolution_counts(d):
    from sparkloom.operators.resolve import resolve_references

    files = _made_files(d, lambda k: F.concat(F.lit("def f(): pass\n"), F.expr("repeat('f()\n', int(s_suppkey % 4 + 1))"), F.lit("missing()\n")))
    return resolve_references(files).groupBy("repository_id", "status", "kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS patch, o_orderkey % 5 + 1 AS removed, o_orderkey % 3 + 1 AS added FROM orders", base=False)
def s8_diff_lines(d):
    from sparkloom.sources import diff

    diff.register(d.spark)
    k = "int(o_orderkey % 5 + 1)", "int(o_orderkey % 3 + 1)"
    text = F.expr(f"concat('--- a/m.py\n+++ b/m.py\n@@ -1,', {k[0]}, ' +1,', {k[1]}, ' @@\n', repeat('-x\n', {k[0]}), repeat('+y\n', {k[1]}))")
    d.table("orders").select(F.col("o_orderkey").alias("patch"), text.alias("text")).createOrReplaceTempView("made_patches")
    rows = d.spark.sql("SELECT p.patch, l.kind FROM made_patches p, LATERAL parse_diff(p.text) l")
    return rows.groupBy("patch").agg(F.count_if(F.col("kind") == "-").alias("removed"), F.count_if(F.col("kind") == "+").alias("added"))


@query()
def r9_expanded_search(d):
    from sparkloom.operators.evidence import evidence_pack, expanded_search

    context, _ = expanded_search(retrieval.search_columns(d.chunks), d.repo_symbols, d.repo_edges, "the widget", _QUERY_VECTOR)
    return evidence_pack(context).select("cite", "symbol_id", "path")


@query("SELECT doc_id, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS tp, 1 - CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS fn, CASE WHEN l.quality = 1 THEN 1::DOUBLE ELSE 0::DOUBLE END AS f1 FROM labels l", base=False)
def c14_evaluation_report(d):
    from sparkloom.operators.assess import evaluation_report

    rows = d.table("labels")
    cases = rows.select(F.col("doc_id").alias("case_id"), F.struct(F.lit("complete").alias("status"), F.array(F.lit("x")).alias("paths")).alias("files"))
    predictions = rows.select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("files"), F.lit("ok").alias("status"))
    return evaluation_report(cases, predictions).select(F.col("case_id").alias("doc_id"), "tp", "fn", "f1")


@query("SELECT 'src/p' || s_suppkey || '.py' AS path, name, writes FROM (SELECT s_suppkey, unnest(['os', 'f', 'x', 'y', 'C']) AS name, unnest([1, 2, s_suppkey % 4 + 2, 2, 1])::BIGINT AS writes FROM supplier)", base=False)
def a18_name_writes(d):
    from sparkloom.sources.pysource import module_names

    files = _made_files(d, lambda k: F.concat(F.lit("import os\nfrom a import *\ndef f():\n    z = 1\nfor x in []:\n    y = x\nclass C:\n    w = 2\nf = 3\ndel y\n"), F.expr("repeat('x = 0\n', int(s_suppkey % 4 + 1))")))
    return module_names(files).select("path", "name", "writes")


@query("SELECT s_suppkey % 3 AS repository_id, count(*) AS uses, count(*) * 1.0::DOUBLE AS confidence FROM supplier GROUP BY 1", base=False)
def x16_model_uses(d):
    from sparkloom.operators.resolve import model_uses, resolve_references

    files = _made_files(d, lambda k: F.concat(F.lit("class Item: pass\nclass Other: pass\ndef make():\n    a = Item()\n    b = Item()\n    return Other()\n"), F.expr("repeat('# row\n', int(s_suppkey % 3))")))
    known = files.select("path", F.lit('["class", "Item", 1]').alias("key"))
    out = model_uses(resolve_references(files), known)
    return out.groupBy("repository_id").agg(F.count("*").alias("uses"), F.sum("confidence").alias("confidence"))


@query("SELECT 'src/p' || s_suppkey || '.py' AS path, 'src/p' || abs(s_suppkey - 3) || '.py' AS needs FROM supplier WHERE abs(s_suppkey - 3) IN (SELECT s_suppkey FROM supplier) AND s_suppkey % 3 = abs(s_suppkey - 3) % 3", base=False)
def j19_dependents(d):
    """Each file imports the one three numbers before it, which lies in the same repository."""
    from sparkloom.operators.resolve import dependents, resolve_references

    files = _made_files(d, lambda k: F.concat(F.lit("from p"), F.abs(k - 3).cast("string"), F.lit(" import f as g\ndef f(): pass\n")))
    return dependents(resolve_references(files))


_SNAP = "snap AS (SELECT s.*, f.path, CASE WHEN f.file_id % 4 < 2 THEN 1 ELSE 2 END AS snapshot_id FROM symbols s JOIN files f USING (file_id) WHERE f.repository_id = 1), s1 AS (SELECT * FROM snap WHERE snapshot_id = 1), e1 AS (SELECT * FROM edges WHERE src IN (SELECT symbol_id FROM s1) AND dst IN (SELECT symbol_id FROM s1))"


def _snapshots(d):
    snaps = d.spark.createDataFrame([(1, 1, "ready"), (2, 1, "indexing"), (3, 2, "ready")], "id long, repository_id long, status string")
    return snaps, d.symbols, d.files.withColumn("snapshot_id", F.when(F.col("file_id") % 4 < 2, 1).otherwise(2)), d.edges


@query(f"WITH {_SNAP} SELECT e.edge_id, a.kind = 'class' AS from_model FROM e1 e JOIN s1 a ON a.symbol_id = e.src")
def s11_snapshot_graph(d):
    own, links = scope.snapshot_graph(*_snapshots(d), 1, 1, models=d.repo_symbols.where("file_id % 4 < 2 AND kind = 'class'"), max_nodes=None, max_edges=None)
    return links.join(own.select(F.col("symbol_id").alias("src"), F.col("is_database_model").alias("from_model")), "src").select("edge_id", "from_model")


@query(f"""WITH {_SNAP}, seeds AS (SELECT symbol_id FROM s1 ORDER BY 1 LIMIT 5), {_walk("'CALLS', 'INHERITS', 'USES'", 'symbol_id IN (SELECT symbol_id FROM seeds)', 3).replace('repo_edges', 'e1').replace('repo_symbols', 's1')}
SELECT b.symbol_id, b.depth, b.min_depth, round(b.score, 9) AS score, b.sp[1] AS seed, s.kind = 'class' AS is_database_model FROM ({_BEST}) b JOIN s1 s USING (symbol_id) WHERE nth = 1""")
def g4_snapshot_blast_radius(d):
    snaps, symbols, files, edges = _snapshots(d)
    mine = d.repo_symbols.where("file_id % 4 < 2")
    seeds = mine.select("symbol_id").orderBy("symbol_id").limit(5)
    out = graph.snapshot_blast_radius(snaps, symbols, files, edges, 1, 1, seeds, 3, models=mine.where("kind = 'class'"), max_nodes=None, max_edges=None)
    return out.select("symbol_id", "depth", "min_depth", F.round("score", 9).alias("score"), "seed", "is_database_model")


@query("WITH gone AS (SELECT symbol_id FROM symbols WHERE file_id IN (SELECT file_id FROM files WHERE repository_id = 2)) SELECT 'files' AS part, count(*) AS n, sum(file_id)::BIGINT AS ids FROM files WHERE repository_id <> 2 UNION ALL SELECT 'symbols', count(*), sum(symbol_id)::BIGINT FROM symbols WHERE symbol_id NOT IN (SELECT symbol_id FROM gone) UNION ALL SELECT 'edges', count(*), sum(edge_id % 1000003)::BIGINT FROM edges WHERE src NOT IN (SELECT symbol_id FROM gone) AND dst NOT IN (SELECT symbol_id FROM gone)")
def k4_delete_repository(d):
    files, symbols, edges = writes.delete_repository(d.files, d.symbols, d.edges, 2)
    part = lambda name, df, ids: df.agg(F.count("*").alias("n"), F.sum(ids).alias("ids")).select(F.lit(name).alias("part"), "n", "ids")
    return part("files", files, F.col("file_id")).union(part("symbols", symbols, F.col("symbol_id"))).union(part("edges", edges, F.col("edge_id") % 1000003))


@query(f"WITH {_FOUND}, ev AS (SELECT symbol_id, category, measured FROM found WHERE symbol_id % 3 <> 0) SELECT f.symbol_id, f.category, ev.measured, s.name, s.complexity FROM found f LEFT JOIN ev ON ev.symbol_id = f.symbol_id AND ev.category = f.category LEFT JOIN symbols s ON s.symbol_id = f.symbol_id")
def j11_findings_in_context(d):
    found = recommend.detect(d.symbols, d.edges)[0]
    evidence = found.where("symbol_id % 3 != 0").withColumn("related", F.array().cast("array<long>"))
    return recommend.in_context(found, evidence, d.symbols).select("symbol_id", "category", "measured", "name", "complexity")


@query("""WITH x AS (SELECT *, end_line - start_line + 1 AS lines, CASE symbol_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 9 END AS measured, symbol_id % 9 AS related FROM symbols),
y AS (SELECT *, CASE WHEN coalesce(measured, related) < 1 THEN greatest(related, 5) ELSE coalesce(measured, related) END AS m FROM x)
SELECT symbol_id, round(5::DOUBLE + greatest(0::DOUBLE, least(5::DOUBLE, (m - 5) * 0.5::DOUBLE)), 4) AS impact, round(least(0.95::DOUBLE, 0.7::DOUBLE + least(0.2::DOUBLE, m * 0.02::DOUBLE) + CASE WHEN coalesce(complexity, 0) >= 10 THEN 0.05::DOUBLE ELSE 0::DOUBLE END), 4) AS likelihood FROM y""")
def c2_fan_in_fallback(d):
    k = F.col("symbol_id")
    found = d.symbols.select("symbol_id", F.lit("UNTESTED_HOTSPOT").alias("category"), F.when(k % 3 == 1, 0).when(k % 3 == 2, 9).cast("long").alias("measured"), F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), (k % 9).cast("int")).alias("related"))
    return recommend.features(found, d.symbols).select("symbol_id", "impact", "likelihood")


@query("WITH st AS (SELECT CASE WHEN file_id % 3 = 0 THEN 1 ELSE 2 END AS snapshot_id, * FROM files) SELECT r_regionkey AS id, r_name AS name, 'https://github.com/x/' || lower(r_name) AS url, CASE r_regionkey WHEN 1 THEN 'failed' WHEN 2 THEN 'ready' END AS status, CASE r_regionkey WHEN 1 THEN 12 WHEN 2 THEN 20 END AS snapshot_id, (SELECT count(*) FROM files f WHERE f.repository_id = r_regionkey) AS file_count, (SELECT count(*) FROM symbols s JOIN files f USING (file_id) WHERE f.repository_id = r_regionkey) AS symbol_count FROM region")
def c19_repository_rows(d):
    repos = d.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("full_name"), F.concat(F.lit("https://github.com/x/"), F.lower("r_name")).alias("remote_url"))
    snaps = d.spark.createDataFrame([(10, 1, "ready"), (12, 1, "failed"), (20, 2, "ready")], "id int, repository_id int, status string")
    return scope.repository_rows(repos, snaps, d.files, d.symbols)


@query(f"WITH {_LEX} SELECT chunk_id, round(s, 9) AS score FROM lex")
def t3_lexical_postings(d):
    return retrieval.lexical_by_postings(retrieval.postings(retrieval.search_columns(d.chunks)), "the widget", 30)


@query("SELECT f.path || '::' || coalesce(a.qualname, a.name) || '::' || a.kind AS source, g.path || '::' || coalesce(b.qualname, b.name) || '::' || b.kind AS target, e.kind, e.confidence FROM edges e JOIN symbols a ON a.symbol_id = e.src JOIN files f ON f.file_id = a.file_id JOIN symbols b ON b.symbol_id = e.dst JOIN files g ON g.file_id = b.file_id")
def g12_canonical_edges(d):
    return writes.canonical(d.symbols, d.files, d.edges)[1]


_SHAPE_ROWS = ", ".join(f"({i}, '{kind}', '{text.replace(chr(39), chr(39) * 2)}', {line}, '{status}')" for i, (_, refs) in enumerate(SHAPES) for kind, text, line, status in refs)


@query(f"SELECT 'src/p' || s_suppkey || '.py' AS path, kind, expression, line, status FROM supplier JOIN (VALUES {_SHAPE_ROWS}) v(shape, kind, expression, line, status) ON s_suppkey % {len(SHAPES)} = shape", base=False)
def x9_resolution_shapes(d):
    from sparkloom.operators.resolve import resolve_references

    source = F.element_at(F.array(*[F.lit(s) for s, _ in SHAPES]), (F.col("s_suppkey") % len(SHAPES) + 1).cast("int"))
    return resolve_references(_made_files(d, lambda k: source)).select("path", "kind", "expression", "line", "status")


#: Patches with the two versions of their file, and what they change, worked out by hand.
_PATCHES = [
    ("def f():\n    return 1\n", "def f():\n    return 2\n", "--- a/m.py\n+++ b/m.py\n@@ -1,2 +1,2 @@\n def f():\n-    return 1\n+    return 2\n", [("m.py", "f", "BODY_CHANGED", None)]),
    ("def f(): pass\n", "def f(a): pass\n", "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-def f(): pass\n+def f(a): pass\n", [("m.py", "f", "SIGNATURE_CHANGED", None)]),
    ("def f(): pass\n", "def g(): pass\n", "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-def f(): pass\n+def g(): pass\n", [("m.py", "f", "REMOVED", None), ("m.py", "g", "ADDED", None)]),
    ("class A:\n    def m(self):\n        return 1\n", "class A:\n    def m(self):\n        return 2\n", "diff --git a/m.py b/n.py\nrename from m.py\nrename to n.py\n--- a/m.py\n+++ b/n.py\n@@ -3 +3 @@\n-        return 1\n+        return 2\n", [("n.py", "A.m", "BODY_CHANGED", None)]),
    ("x = 1\n", "x = 2\n", "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-x = 1\n+x = 2\n", [("m.py", None, None, "MODULE_LEVEL_CHANGE"), ("m.py", None, None, "MODULE_LEVEL_CHANGE")]),
    ("def f(): pass\n", "def f(): ...\n", "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-def f(): other\n+def f(): ...\n", [("m.py", None, None, "PATCH_SOURCE_MISMATCH")]),
    ("def f(:\n", "def f(): ...\n", "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-def f(:\n+def f(): ...\n", [("m.py", None, None, "SOURCE_PARSE_ERROR")]),
    ("def f(): pass\ndef f(): pass\n", "def f(): pass\ndef f(): ...\n", "--- a/m.py\n+++ b/m.py\n@@ -2 +2 @@\n-def f(): pass\n+def f(): ...\n", [("m.py", "f", None, "AMBIGUOUS_SYMBOL_IDENTITY")]),
    ("a", "b", "diff --git a/m.py b/m.py\nBinary files a/m.py and b/m.py differ\n", [("m.py", None, None, "BINARY_FILE")]),
    ("a", "b", "--- a/m.md\n+++ b/m.md\n@@ -1 +1 @@\n-a\n+b\n", [("m.md", None, None, "UNSUPPORTED_FILE_TYPE")]),
    ("a", "b", "--- a/other.py\n+++ b/other.py\n@@ -1 +1 @@\n-a\n+b\n", [("other.py", None, None, "MISSING_SOURCE"), ("other.py", None, None, "MISSING_SOURCE")]),
    ("a", "b", "diff --git a/m.py b/n.py\ncopy from m.py\ncopy to n.py\n", [("n.py", None, None, "COPY_UNSUPPORTED")]),
]
_sql = lambda x: "NULL" if x is None else "'" + x + "'"
_PATCH_ROWS = ", ".join(f"({i}, {', '.join(map(_sql, row))})" for i, (*_, rows) in enumerate(_PATCHES) for row in rows)


@query(f"SELECT o_orderkey AS patch, path, qualname, change, code FROM orders JOIN (VALUES {_PATCH_ROWS}) v(shape, path, qualname, change, code) ON o_orderkey % {len(_PATCHES)} = shape", base=False)
def x18_symbol_diff(d):
    k = F.col("o_orderkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in _PATCHES]), (k % len(_PATCHES) + 1).cast("int"))
    own = d.table("orders").select(k.alias("patch"), pick(2).alias("text"), pick(0).cast("binary").alias("base"), pick(1).cast("binary").alias("head"))
    files = lambda side, *names: own.select("patch", F.explode(F.array(*[F.lit(n) for n in names])).alias("path"), F.col(side).alias("content"))
    out = changes.symbol_diff(own.select("patch", "text"), files("base", "m.py"), files("head", "m.py", "n.py"))
    return out.select("patch", "path", "qualname", "change", "code")


@query("SELECT 'src/p' || s_suppkey || '.py' AS path, name, framework, part FROM supplier, (VALUES (0, 'GET /a', 'FastAPI', 'endpoint'), (1, 'PUT /b', 'Flask', 'endpoint'), (1, 'POST /b', 'Flask', 'endpoint'), (3, 'item', 'SQLModel', 'model'), (4, 'rows', 'SQLAlchemy', 'model')) v(shape, name, framework, part) WHERE s_suppkey % 6 = shape", base=False)
def x14_x15_frameworks(d):
    """Routes, a receiver that is written twice (2), tables of both families, and a base that nothing brings in (5)."""
    from sparkloom.sources.pysource import detect_frameworks

    shapes = (
        "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/a')\ndef a(): pass\n@app.get(path)\ndef b(): pass\n",
        "import flask\nbp = flask.Blueprint('x')\n@bp.route('/b', methods=['put', 'POST'])\ndef b(): pass\n",
        "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/a')\ndef a(): pass\napp = None\n",
        "from sqlmodel import SQLModel\nclass Item(SQLModel, table=True): pass\nclass Draft(SQLModel): pass\n",
        "from sqlalchemy.orm import declarative_base\nB = declarative_base()\nclass M(B): pass\nclass Row(M):\n    __tablename__ = 'rows'\n",
        "class Item(SQLModel, table=True): pass\nclass Row(Base):\n    __tablename__ = 'rows'\n",
    )
    source = F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("s_suppkey") % len(shapes) + 1).cast("int"))
    return detect_frameworks(_made_files(d, lambda k: source)).select("path", "name", "framework", "part")


@query("SELECT symbol_id AS old_id, 100 + row_number() OVER (ORDER BY name, symbol_id) AS symbol_id FROM symbols")
def k1_insert_symbols(d):
    order = F.struct("name", "symbol_id")
    rows = d.symbols.select(F.col("symbol_id").alias("old_id"), order.alias("place"), "name", "kind")
    return writes.insert_symbols(rows, "place", 100).select("old_id", "symbol_id")


@query("""WITH f AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_size AS n, (p_partkey % 97) / 100.0::DOUBLE AS s FROM part)
SELECT id, concat_ws(' ', 'Pull request analysis concluded with ' || CASE WHEN k = 0 THEN 'None' ELSE 'HIGH' END || ' risk (score: ' || CASE WHEN k = 0 THEN printf('[%.2f-%.2f] (incomplete)', s, s + 0.5::DOUBLE) ELSE printf('%.2f', s) END || ', status: ' || CASE WHEN k = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END || ').',
  'Diff modifies ' || n || ' lines across ' || (n % 7 + 1) || ' files (' || (n % 5) || ' symbols modified).', 'Downstream ripple traversal identified ' || (n * 2) || ' impacted symbols and ' || (n % 3) || ' affected API endpoints.',
  CASE WHEN n % 4 > 0 THEN (n % 4) || ' modified production callables lack direct static test coverage.' ELSE 'All modified production callables have linked static test associations.' END,
  CASE WHEN k > 1 AND n % 6 > 0 THEN 'Maximum detected callable cyclomatic complexity increase is +' || (n % 6) || '.' END, CASE WHEN n % 2 > 0 THEN 'Assessment contains ' || (n % 2) || ' unmeasured boundary gap(s).' END) AS summary FROM f""", base=False)
def c8_executive_summary(d):
    k, n, s = F.col("p_partkey") % 4, F.col("p_size"), (F.col("p_partkey") % 97) / 100.0
    facts = d.table("part").select(
        F.col("p_partkey").alias("id"), F.when(k > 0, "HIGH").alias("risk_level"), F.when(k > 0, s).alias("risk_score"), F.when(k > 0, "COMPLETE").otherwise("INCOMPLETE").alias("risk_status"), s.alias("lower_bound"), (s + 0.5).alias("upper_bound"),
        n.alias("changed_lines_count"), (n % 7 + 1).alias("files_changed_count"), (n % 5).alias("modified_symbols_count"), (n * 2).alias("impacted_symbols_count"), (n % 3).alias("affected_endpoints_count"), (n % 4).alias("untested_modified_symbols_count"),
        F.when(k > 1, n % 6).alias("maximum_complexity_increase"), (n % 2).alias("gaps_count"),
    )
    return risk.executive_summary(facts).select("id", "summary")


@query("SELECT doc_id, i AS chunk_no, length(chunk)::DOUBLE AS x, (length(chunk) - length(replace(chunk, 'e', '')))::DOUBLE AS y FROM (SELECT doc_id, i, substr(text, i * 512 + 1, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 512.0) AS BIGINT)))::INTEGER AS i FROM documents WHERE length(text) > 0))", base=False)
def r12_baseline_index(d):
    """With a stand-in for the model: a chunk's length and its letters e."""
    from sparkloom.operators.evidence import baseline_index

    out = baseline_index(d.table("documents"), lambda texts: [[len(t), t.count("e")] for t in texts])
    return out.select("doc_id", F.col("chunk_id.chunk_no").alias("chunk_no"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_CHUNK = """'{"path":"src/p' || s_suppkey || '.py","qualname":"f","kind":"function","start_line":2,"end_line":3,"signature":"def f(a)"}' || chr(10) || '---' || chr(10)"""


@query(f"SELECT 'src/p' || s_suppkey || '.py' AS path, 'f' AS name, {_CHUNK} || b AS text, sha256(b) AS digest, 2 AS first_line, true AS intact FROM (SELECT s_suppkey, 'def f(a):' || chr(10) || '    return ' || s_suppkey || chr(10) AS b FROM supplier)", base=False)
def r10_r13_symbol_chunks(d):
    from sparkloom.operators.evidence import split_chunk, symbol_chunks
    from sparkloom.sources.pysource import parse_files

    files = _made_files(d, lambda k: F.concat(F.lit("# first\ndef f(a):\n    return "), k.cast("string"), F.lit("\nx = 1\n")))
    return split_chunk(symbol_chunks(parse_files(files))).select("path", "name", "text", "digest", "first_line", "intact")


@query("SELECT 'src/p' || s_suppkey || '.py' AS path, pos, name, kind, annotation, dflt FROM supplier, (VALUES (0, 'a', 'POSITIONAL_ONLY', NULL, NULL), (1, 'b', 'POSITIONAL_OR_KEYWORD', 'int', NULL), (2, 'c', 'POSITIONAL_OR_KEYWORD', NULL, 'k'), (3, 'args', 'VAR_POSITIONAL', NULL, NULL), (4, 'd', 'KEYWORD_ONLY', 'str', '''x'''), (5, 'kw', 'VAR_KEYWORD', NULL, NULL)) v(pos, name, kind, annotation, d), LATERAL (SELECT CASE WHEN d = 'k' THEN s_suppkey::VARCHAR ELSE d END AS dflt)", base=False)
def x2_parameters(d):
    from sparkloom.sources.pysource import parse_files

    files = _made_files(d, lambda k: F.concat(F.lit("def f(a, /, b: int, c="), k.cast("string"), F.lit(", *args, d: str = 'x', **kw): pass\n")))
    each = parse_files(files).select("path", F.posexplode("parameters").alias("pos", "p"))
    return each.select("path", "pos", "p.name", "p.kind", "p.annotation", F.col("p.default").alias("dflt"))


def _impact(d):
    from sparkloom.operators import assess

    k = F.col("doc_id")
    status = F.when(k % 4 == 0, "partial").when(k % 4 == 1, "unknown").otherwise("complete")
    paths = lambda n: F.transform(F.sequence(F.lit(0), (k % n).cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string")))
    cases = d.table("documents").select(k.alias("case_id"), F.struct(status.alias("status"), paths(3).alias("paths")).alias("files"), F.struct(F.lit("complete").alias("status"), F.slice(paths(5), F.lit(2), F.lit(9)).alias("paths")).alias("tests"))
    said = d.table("documents").where("doc_id % 7 != 3").select(k.alias("case_id"), F.when(k % 6 == 0, "failed").otherwise("ok").alias("status"), paths(4).alias("files"), F.slice(paths(2), F.lit(2), F.lit(9)).alias("tests"))
    return assess.impact_rows(cases, said)


_IMPACT = """d AS (SELECT doc_id AS id, doc_id % 7 = 3 AS missing, doc_id % 6 = 0 AS failed FROM documents),
cat AS (SELECT id, 'files' AS category, CASE id % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'unknown' ELSE 'complete' END AS label, id % 3 + 1 AS truth, id % 4 + 1 AS guess, missing, failed FROM d UNION ALL SELECT id, 'tests', 'complete', id % 5, id % 2, missing, failed FROM d),
cnt AS (SELECT *, CASE WHEN missing THEN 'missing' WHEN failed THEN 'failed' ELSE 'ok' END AS status, NOT (missing OR failed) AS ok FROM cat),
r AS (SELECT *, CASE WHEN ok THEN least(truth, guess) ELSE 0 END AS tp, CASE WHEN ok THEN greatest(0, guess - truth) ELSE 0 END AS fp, CASE WHEN ok THEN greatest(0, truth - guess) ELSE truth END AS fn FROM cnt),
m AS (SELECT *, CASE WHEN NOT ok THEN 0::DOUBLE WHEN tp + fp + fn = 0 THEN 1::DOUBLE ELSE 2::DOUBLE * tp / (2 * tp + fp + fn) END AS f FROM r)"""


@query(f"WITH {_IMPACT} SELECT id AS case_id, category, status AS prediction_status, label AS label_status, CASE WHEN label <> 'unknown' THEN tp END AS tp, CASE WHEN label = 'complete' THEN fp END AS fp, CASE WHEN label <> 'unknown' THEN fn END AS fn, round(CASE WHEN label = 'unknown' THEN NULL WHEN NOT ok THEN 0::DOUBLE WHEN truth = 0 THEN 1::DOUBLE ELSE tp::DOUBLE / truth END, 9) AS recall, round(CASE WHEN label = 'complete' THEN f END, 9) AS f1, CASE WHEN label <> 'unknown' THEN fn END AS missed FROM m", base=False)
def c14_impact_rows(d):
    return _impact(d).select("case_id", "category", "prediction_status", "label_status", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), "recall", "f1", F.when(F.col("missing_known").isNotNull(), F.size("missing_known")).cast("long").alias("missed"))


@query(f"WITH {_IMPACT} SELECT category, count(*) AS complete_label_cases, count(*) FILTER (ok) AS successful_cases, round(avg(f), 9) AS macro_f1, round(2::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(sum(tp)::DOUBLE / (sum(tp) + sum(fp)), 9) AS micro_precision, round(sum(tp)::DOUBLE / (sum(tp) + sum(fn)), 9) AS micro_recall, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m WHERE label = 'complete' GROUP BY category", base=False)
def c14_impact_aggregates(d):
    from sparkloom.operators import assess

    return assess.impact_aggregates(_impact(d))
