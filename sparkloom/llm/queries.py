"""Queries of the training-data operators, one a method, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import phrases

    return phrases.digests(table(spark, sf_dir, "documents"))


def op5_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import tokencount

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs)
    return langid.identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import isomedia

    return isomedia.media_digests(table(spark, sf_dir, "documents"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import capfilters

    return capfilters.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_deep_shallow_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm import suffixes

    return suffixes.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pareto_mixing, op2_concat_and_cut, op3_toxicity_grammar, op4_phrase_automata, op5_pigeonhole_simhash, op6_whole_token_counts, op7_rank_order_language, op8_iso_media, op9_cap_filters, op10_deep_shallow_suffixes)}

#: DuckDB's words for the queries that SQL can express.
ORACLE_SQL = {
    "op1_pareto_mixing": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS text_hash FROM documents),
per0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
per1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM per0),
per2 AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight, 2::DOUBLE * source_size AS top FROM per1),
per3 AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per0)::DOUBLE
  - coalesce(sum(top) OVER (ORDER BY top / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
  / sum(weight) OVER (ORDER BY top / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM per2),
level AS (SELECT arg_min(rate, row(top / weight, nth)) AS level FROM per3 WHERE rate * weight <= top),
per4 AS (SELECT source, source_size, least(top, coalesce(level * weight, top)) AS target FROM per3, level),
per5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0::BIGINT END AS certain FROM per4),
per AS (SELECT *, target - (certain * source_size)::DOUBLE AS rest FROM per5),
sizes AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size),
rates AS (SELECT s.source, s.size,
  (p.rest - coalesce(sum(s.n * s.size) OVER (PARTITION BY s.source ORDER BY s.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(s.n * pow(s.size::DOUBLE, 1.5::DOUBLE)) OVER (PARTITION BY s.source ORDER BY s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate
  FROM sizes s JOIN per p ON s.source IS NOT DISTINCT FROM p.source),
fit AS (SELECT source, max(size) AS whole, arg_max(rate, size) AS rate FROM rates WHERE rate * pow(size::DOUBLE, 0.5::DOUBLE) <= 1 GROUP BY source),
drawn AS (SELECT s.doc_id, s.size, s.text_hash, p.*, CASE WHEN s.size > f.whole THEN 1::DOUBLE ELSE least(1::DOUBLE, f.rate * pow(s.size::DOUBLE, 0.5::DOUBLE)) END AS p,
  (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || s.text_hash), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM sized s JOIN per p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN fit f ON f.source IS NOT DISTINCT FROM s.source),
ranked AS (SELECT *, CASE WHEN size > 0 AND rest > 0 AND p > 0 THEN u / (1::DOUBLE - u) * (1::DOUBLE - p) / p END AS rk FROM drawn),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, rk) AS nth FROM ranked),
steps AS (SELECT source, rk, rest, sum(size)::DOUBLE AS words, count(*) AS m, max(size) AS each FROM ranked WHERE rk IS NOT NULL GROUP BY source, rk, rest),
run AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS before FROM steps),
cut AS (SELECT source, rk AS last, CASE WHEN before + words <= rest THEN m ELSE least(m, floor((rest - before) / each + 0.5::DOUBLE)::BIGINT) END AS k FROM run WHERE before < rest AND before + words >= rest)
SELECT d.doc_id, d.size, d.source_size, d.target,
  (d.size * (d.certain + CASE WHEN d.rk < c.last OR (d.rk = c.last AND d.nth <= c.k) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM numbered d LEFT JOIN cut c ON d.source IS NOT DISTINCT FROM c.source
""",
    "op9_cap_filters": """
WITH fit AS (
  SELECT vec_id, label, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM fit a JOIN fit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[]) / (a.norm * b.norm) >= 0.93::DOUBLE),
reach AS (
  WITH RECURSIVE r(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM r JOIN links l ON r.v = l.u)
  SELECT u, min(v) AS least FROM r GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN reach r ON r.u = e.vec_id
""",
}
