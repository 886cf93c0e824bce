"""Chunks of symbols, hybrid search with typed expansion, and citable evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph, retrieval

SEPARATOR = "\n---\n"
HEADER = ("path", "qualname", "kind", "start_line", "end_line", "signature")


def symbol_chunks(symbols: DataFrame) -> DataFrame:
    """path, local_key, text, digest: a chunk a class, function or method: JSON header, separator, the symbol's exact text.

    A class's chunk holds its methods' text too, on purpose. symbols: parse_files().
    """
    own = symbols.where(F.col("error").isNull() & F.col("kind").isin("class", "function", "method"))
    text = F.concat(F.to_json(F.struct(*HEADER)), F.lit(SEPARATOR), F.col("text"))
    return own.select("path", "local_key", "name", "qualname", text.alias("text"), F.sha2("text", 256).alias("digest"))


def split_chunk(chunks: DataFrame) -> DataFrame:
    """Add header (JSON), body, first_line (of the body) and intact (the body's digest is the chunk's)."""
    at = F.instr("text", SEPARATOR)
    body = F.expr(f"substring(text, instr(text, '{SEPARATOR}') + {len(SEPARATOR)})")
    header = F.when(at > 0, F.substring(F.col("text"), F.lit(1), at - 1))
    out = chunks.withColumn("header", header).withColumn("body", F.when(at > 0, body))
    return out.withColumn("first_line", F.get_json_object("header", "$.start_line").cast("int")).withColumn("intact", F.sha2("body", 256) == F.col("digest"))


def embed(chunks: DataFrame, embedder, batch: int = 32) -> DataFrame:
    """Add embedding (array of float) by embedder(list of texts) -> list of vectors, called with whole batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(texts), batch):
            out += [[float(x) for x in v] for v in embedder(texts.iloc[i : i + batch].tolist())]
        return pd.Series(out)

    return chunks.withColumn("embedding", run("text"))


def baseline_index(docs: DataFrame, embedder, size: int = 512) -> DataFrame:
    """chunk_id (from the document and place), doc_id, text, embedding of fixed-size chunks."""
    parts = retrieval.fixed_chunks(docs, size).select("doc_id", "chunk_no", F.col("chunk").alias("text"))
    return embed(parts.withColumn("chunk_id", F.struct("doc_id", "chunk_no")), embedder)


def expanded_search(chunks: DataFrame, symbols: DataFrame, edges: DataFrame, query: str, query_vector: list[float], intent: str = "general", limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """(context, gaps): ranked hits, then symbols their graph leads to, each with its chunk; expanded symbols without a chunk are gaps.

    context: place (seed rank, 0 for the seed itself, then its neighbours in order), symbol_id, chunk columns.
    """
    hits = retrieval.hybrid(chunks, query, query_vector, min(limit, 8)).select("chunk_id", "symbol_id", "score").persist()
    seeds = retrieval.ranks(hits.withColumn("_o", -F.col("score")), "symbol_id", "_o", "symbol_id").select(F.col("id").alias("symbol_id"), F.col("rank").alias("seed_rank"))
    more = graph.typed_expand(symbols, edges, seeds, intent).select("seed_rank", F.col("nth").cast("int").alias("nth"), "symbol_id", "confidence")
    every = seeds.select("seed_rank", F.lit(0).alias("nth"), "symbol_id", F.lit(1.0).alias("confidence")).union(more)
    first = every.groupBy("symbol_id").agg(F.min(F.struct("seed_rank", "nth", "confidence")).alias("b")).select("symbol_id", "b.*")
    context = first.join(chunks, "symbol_id")
    return context, first.join(chunks.select("symbol_id"), "symbol_id", "left_anti").select("symbol_id", F.lit("NO_CHUNK").alias("code"))


def evidence_pack(context: DataFrame, entries: int = 40, chars: int = 48_000) -> DataFrame:
    """cite, symbol_id, path, text of the context that fits, whole chunks only, in context order."""
    rows = context.withColumn("_g", F.lit(1)).withColumn("_at", F.struct("seed_rank", "nth", "symbol_id")).withColumn("_cost", F.length("text") + F.length(F.coalesce("qualname", F.lit(""))))
    return retrieval.budget(rows.select("_g", "_at", "_cost", "symbol_id", "path", "qualname", "text"), ["_g"], "_at", "_cost", entries, chars).select("cite", "symbol_id", "path", "qualname", "text")


def serialise(pack: DataFrame) -> DataFrame:
    """One row: the entries as JSON in order of their ids, and the map from id to symbol."""
    n = F.substring("cite", 2, 10).cast("int")
    item = F.struct(n.alias("n"), "cite", "symbol_id", "path", "qualname", "text")
    out = pack.agg(F.array_sort(F.collect_list(item)).alias("x"))
    return out.select(F.to_json(F.transform("x", lambda e: F.struct(e["cite"].alias("cite"), e["path"].alias("path"), e["qualname"].alias("qualname"), e["symbol_id"].alias("symbol_id"), e["text"].alias("text")))).alias("json"), F.map_from_entries(F.transform("x", lambda e: F.struct(e["cite"], e["symbol_id"]))).alias("cited"))


def render(pack: DataFrame) -> DataFrame:
    """Each entry as fenced text; the fence is longer than any run of back ticks inside."""
    ticks = F.array_max(F.concat(F.array(F.lit(2)), F.transform(F.regexp_extract_all("text", F.lit("(`+)")), F.length)))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), ticks + 1))
    return pack.withColumn("rendered", F.concat(F.lit("["), "cite", F.lit("] "), F.coalesce("path", F.lit("")), F.lit("\n"), fence, F.lit("\n"), "text", F.lit("\n"), fence))
