"""The code graph's relations derived from the driver's tables, in DataFrames and in SQL for DuckDB.

Both engines build them by the same rules, so that every query has an oracle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB's words for the relations below; every oracle starts with them.
BASE_SQL = """
WITH RECURSIVE n AS (SELECT (SELECT count(*) FROM supplier) AS nf, (SELECT min(s_suppkey) FROM supplier) AS f0, (SELECT count(*) FROM customer) AS nc),
files AS (SELECT s_suppkey AS file_id, CASE WHEN s_suppkey % 10 = 9 THEN 2 ELSE 1 END AS repository_id,
  'src/' || replace(s_name, '#', '_') || CASE s_suppkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.md' ELSE '' END AS path FROM supplier),
symbols AS (SELECT p_partkey AS symbol_id, p_partkey % nf + f0 AS file_id, replace(p_name, ' ', '_') AS name,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'mod_' || (p_partkey % 9) || '.' || replace(p_name, ' ', '_') END AS qualname,
  CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'endpoint' ELSE 'module' END AS kind,
  (p_partkey * 7 % 400 + 1)::INTEGER AS start_line, (p_partkey * 7 % 400 + 1 + p_size)::INTEGER AS end_line,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_size % 23 + 1)::INTEGER END AS complexity,
  CASE WHEN p_partkey % 3 = 0 THEN ' ' WHEN p_partkey % 3 = 1 THEN NULL ELSE 'about ' || p_type END AS docstring,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 7 = 0 END AS is_test, p_partkey % 5 <> 0 AS documentation_known FROM part, n),
edges0 AS (SELECT o_custkey AS src, o_orderkey % nc AS dst,
  CASE WHEN o_orderkey % 17 = 0 THEN 'EXPOSES' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CALLS' WHEN '2' THEN 'INHERITS' WHEN '3' THEN 'USES' WHEN '4' THEN 'IMPORTS' ELSE 'TESTED_BY' END END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5::DOUBLE ELSE NULL END AS confidence FROM orders, n WHERE o_custkey <> o_orderkey % nc),
edges AS (SELECT src * 1000000000 + dst * 10 + CASE kind WHEN 'CALLS' THEN 1 WHEN 'INHERITS' THEN 2 WHEN 'USES' THEN 3 WHEN 'IMPORTS' THEN 4 WHEN 'TESTED_BY' THEN 5 ELSE 6 END AS edge_id,
  src, dst, kind, max(confidence) AS confidence FROM edges0 GROUP BY src, dst, kind),
repo_symbols AS (SELECT s.*, f.path FROM symbols s JOIN files f USING (file_id) WHERE f.repository_id = 1),
repo_edges AS (SELECT e.* FROM edges e WHERE src IN (SELECT symbol_id FROM repo_symbols) AND dst IN (SELECT symbol_id FROM repo_symbols)),
chunks AS (SELECT r.symbol_id * 10 AS chunk_id, r.symbol_id, r.name, r.qualname, r.path, d.text, e.embedding
  FROM repo_symbols r JOIN documents d ON d.doc_id = r.symbol_id LEFT JOIN embeddings e ON e.vec_id = r.symbol_id),
commits AS (SELECT event_type || '/' || (user_id % 20) AS path, ts, user_id::VARCHAR AS author, event_type = 'error' AS bugfix FROM events)
"""


def kind_of(size):
    return F.element_at(F.array(*[F.lit(k) for k in ("function", "method", "class", "endpoint", "module")]), (size % 5 + 1).cast("int"))


@dataclass
class Derived:
    """The relations over one folder of tables, built when asked for."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        k = F.col("s_suppkey")
        suffix = F.element_at(F.array(F.lit(".py"), F.lit(".TS"), F.lit(".md"), F.lit("")), (k % 4 + 1).cast("int"))
        return self.table("supplier").select(k.alias("file_id"), F.when(k % 10 == 9, 2).otherwise(1).alias("repository_id"), F.concat(F.lit("src/"), F.replace("s_name", F.lit("#"), F.lit("_")), suffix).alias("path"))

    @cached_property
    def symbols(self) -> DataFrame:
        nf, f0 = self.table("supplier").agg(F.count("*"), F.min("s_suppkey")).first()
        k, size = F.col("p_partkey"), F.col("p_size")
        name = F.replace("p_name", F.lit(" "), F.lit("_"))
        start = k * 7 % 400 + 1
        return self.table("part").select(
            k.alias("symbol_id"), (k % nf + f0).alias("file_id"), name.alias("name"), F.when(size % 6 != 0, F.concat(F.lit("mod_"), (k % 9).cast("string"), F.lit("."), name)).alias("qualname"), kind_of(size).alias("kind"),
            start.cast("int").alias("start_line"), (start + size).cast("int").alias("end_line"), F.when(k % 11 != 0, size % 23 + 1).cast("int").alias("complexity"),
            F.when(k % 3 == 0, " ").when(k % 3 == 2, F.concat(F.lit("about "), "p_type")).alias("docstring"), F.when(k % 13 != 0, k % 7 == 0).alias("is_test"), (k % 5 != 0).alias("documentation_known"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        nc = self.table("customer").count()
        kinds = {"1": "CALLS", "2": "INHERITS", "3": "USES", "4": "IMPORTS"}
        first, kind = F.substring("o_orderpriority", 1, 1), None
        for c, k in kinds.items():
            kind = F.when(first == c, k) if kind is None else kind.when(first == c, k)
        kind = F.when(F.col("o_orderkey") % 17 == 0, "EXPOSES").otherwise(kind.otherwise("TESTED_BY"))
        confidence = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5)
        drafts = self.table("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % nc).alias("dst"), kind.alias("kind"), confidence.alias("confidence")).where("src != dst")
        digit = F.element_at(F.create_map(*[F.lit(x) for kv in (("CALLS", 1), ("INHERITS", 2), ("USES", 3), ("IMPORTS", 4), ("TESTED_BY", 5), ("EXPOSES", 6)) for x in kv]), F.col("kind"))
        merged = drafts.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))
        return merged.select((F.col("src") * 1_000_000_000 + F.col("dst") * 10 + digit).alias("edge_id"), "src", "dst", "kind", "confidence")

    @cached_property
    def repo_symbols(self) -> DataFrame:
        from sparkloom.operators.scope import repo_symbols

        return repo_symbols(self.symbols, self.files, 1)

    @cached_property
    def repo_edges(self) -> DataFrame:
        from sparkloom.operators.scope import scoped_edges

        return scoped_edges(self.edges, self.repo_symbols)

    @cached_property
    def chunks(self) -> DataFrame:
        own = self.repo_symbols.select("symbol_id", "name", "qualname", "path").withColumn("chunk_id", F.col("symbol_id") * 10)
        text = self.table("documents").select(F.col("doc_id").alias("symbol_id"), "text")
        vecs = self.table("embeddings").select(F.col("vec_id").alias("symbol_id"), "embedding")
        return own.join(text, "symbol_id").join(vecs, "symbol_id", "left")

    @cached_property
    def commits(self) -> DataFrame:
        return self.table("events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 20).cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("author"), (F.col("event_type") == "error").alias("bugfix"))
