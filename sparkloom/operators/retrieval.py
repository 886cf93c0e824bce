"""Retrieval: chunks, lexical and vector rankings, fusion, evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.functions.text import identifier_tokens
from sparkloom.operators.writes import ranked
from sparkloom.schema import positive, query_text, require_none

#: Rank constant and candidates of each ranking.
RRF_K, CANDIDATES = 60, 30
#: Weights of token classes: names and qualified names, bodies.
WEIGHTS = {"A": 1.0, "B": 0.4}


def fixed_chunks(docs: DataFrame, size: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Character ranges of `size`, end to end: doc_id, chunk_no from 0, chunk. Empty texts have none."""
    if size < 1:
        raise ValueError("size must be positive")
    t = F.col(text)
    starts = F.sequence(F.lit(0), ((F.length(t) - 1) / size).cast("int"))
    return docs.where(F.length(t) > 0).select(F.col(doc_id).alias("doc_id"), t.alias("_t"), F.explode(starts).alias("chunk_no")).select("doc_id", "chunk_no", F.substring(F.col("_t"), F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def search_columns(chunks: DataFrame) -> DataFrame:
    """Token arrays kept with the chunks, computed on write: name and qualified name, then body."""
    names = F.concat(identifier_tokens(F.col("name")), identifier_tokens(F.col("qualname")))
    return chunks.withColumn("name_tokens", names).withColumn("body_tokens", identifier_tokens(F.col("text")))


def matches(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold every token of the query (no stems, no stop words).

    A token is a part of the text it comes from, so texts without it as a part are passed over before they are cut into tokens.
    """
    wanted = F.array_distinct(identifier_tokens(F.lit(query_text(query))))
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "qualname", "text") if c in chunks.columns]
    chunks = chunks.where(F.forall(wanted, lambda t: F.contains(F.concat_ws("\n", *fields), t))) if len(fields) == 3 else chunks
    return chunks.where((F.size(wanted) > 0) & (F.size(F.array_except(wanted, F.concat("name_tokens", "body_tokens"))) == 0))


def postings(chunks: DataFrame) -> DataFrame:
    """token, chunk_id, names, bodies: how often each token stands in a chunk's names and body. Made when chunks are written.

    Write it with `write_postings`: a query then reads the files that hold its tokens, not the texts.
    """
    each = chunks.select("chunk_id", F.explode(F.concat(F.transform("name_tokens", lambda t: F.struct(t.alias("token"), F.lit(1).alias("n"), F.lit(0).alias("b"))), F.transform("body_tokens", lambda t: F.struct(t.alias("token"), F.lit(0).alias("n"), F.lit(1).alias("b"))))).alias("t"))
    return each.groupBy("t.token", "chunk_id").agg(F.sum("t.n").alias("names"), F.sum("t.b").alias("bodies"))


def write_postings(chunks: DataFrame, path: str) -> None:
    """Postings in order of their tokens, so that statistics of files and row groups rule out all but a query's."""
    postings(chunks).repartitionByRange("token").sortWithinPartitions("token", "chunk_id").write.mode("errorifexists").parquet(path)


def lexical_by_postings(index: DataFrame, query: str, limit: int = CANDIDATES) -> DataFrame:
    """chunk_id, score: as lexical(density=False), from postings: one filter on tokens (pushed to the files), one narrow aggregate."""
    tokens = index.sparkSession.range(1).select(F.array_distinct(identifier_tokens(F.lit(query_text(query)))).alias("t")).first()["t"]
    if not tokens:
        return index.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    raw = F.sum("names") * WEIGHTS["A"] + F.sum("bodies") * WEIGHTS["B"]
    found = index.where(F.col("token").isin(*tokens)).groupBy("chunk_id").agg(F.count("*").alias("n"), raw.alias("raw")).where(F.col("n") == len(tokens))
    return found.select("chunk_id", F.round(F.col("raw") / (F.col("raw") + 1.0), 9).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def weighted_frequency(query: str) -> Column:
    """A plain score of matches: weighted hits per token, squashed by x / (x + 1)."""
    wanted = F.array_distinct(identifier_tokens(F.lit(query)))
    hits = lambda c: F.size(F.filter(c, lambda t: F.array_contains(wanted, t))).cast("double")
    raw = hits("name_tokens") * WEIGHTS["A"] + hits("body_tokens") * WEIGHTS["B"]
    return raw / (raw + 1.0)


def cover_density(tokens: list[list[str]], wanted: list[str]) -> float:
    """Rank by covers: shortest ranges that hold all wanted tokens, closer and heavier ones more, squashed by x / (x + 1).

    tokens: name tokens, then body tokens; positions run on. A cover counts with its mean harmonic
    weight over one plus the number of other positions inside it.
    """
    need = set(wanted)
    spots = [(i + 1, t, WEIGHTS["A"]) for i, t in enumerate(tokens[0]) if t in need]
    spots += [(len(tokens[0]) + i + 1, t, WEIGHTS["B"]) for i, t in enumerate(tokens[1]) if t in need]
    total, left, have = 0.0, 0, {}
    for right, (_, t, _) in enumerate(spots):
        have[t] = have.get(t, 0) + 1
        if len(have) < len(need):
            continue
        while have[spots[left][1]] > 1:
            have[spots[left][1]] -= 1
            left += 1
        inside = spots[left : right + 1]
        noise = max(0, inside[-1][0] - inside[0][0] - (len(inside) - 1))
        total += len(inside) / sum(1 / w for _, _, w in inside) / (1 + noise)
        del have[spots[left][1]]
        left += 1
    return total / (total + 1)


def lexical(chunks: DataFrame, query: str, limit: int = CANDIDATES, density: bool = True) -> DataFrame:
    """Matches by score, then id. chunks has search_columns()."""
    positive(limit, "limit", 100)
    found = matches(chunks, query)
    if not density:
        return found.withColumn("score", F.round(weighted_frequency(query_text(query)), 9)).orderBy(F.desc("score"), "chunk_id").limit(limit)

    @F.pandas_udf("double")
    def rank(names: pd.Series, bodies: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([cover_density([list(a), list(b)], list(w)) for a, b, w in zip(names, bodies, wanted)], dtype=float)

    score = rank("name_tokens", "body_tokens", F.array_distinct(identifier_tokens(F.lit(query_text(query)))))
    return found.withColumn("score", score).orderBy(F.desc("score"), "chunk_id").limit(limit)


def vector_top(vecs: DataFrame, query: list[float], limit: int = CANDIDATES, vec_id: str = "vec_id", embedding: str = "embedding", strict: bool = False) -> DataFrame:
    """Exact nearest by cosine distance, then id: a top-k without a sort of all rows.

    Vectors without a direction (zero, or with a null or non-finite part) have no distance: they are left out, or with
    `strict` (the baseline's contract) rejected.
    """
    positive(limit, "limit", 100)
    if strict:
        bad = F.col(embedding).isNull() | F.exists(embedding, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | F.forall(embedding, lambda e: e == 0)
        require_none(vecs.where(bad).select(vec_id), "a vector without a direction")
    distance = F.round(F.lit(1.0) - vectors.cosine(F.col(embedding), vectors.literal(query)), 9)
    return vecs.withColumn("distance", distance).where(F.col("distance").isNotNull()).orderBy("distance", vec_id).limit(limit)


def fuse(ranked: list[DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of frames of id, rank (from 1, each id once a frame): id, score; ties by id."""
    every = ranked[0].select("id", "rank")
    for r in ranked[1:]:
        every = every.union(r.select("id", "rank"))
    out = every.groupBy("id").agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))), 12).alias("score")).orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def ranks(df: DataFrame, id_col: str, *order, bounded: bool = True) -> DataFrame:
    """id, rank after dedup. `bounded`: df is a ranking that was cut to its candidates; else it is numbered range by range."""
    first = df.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(*order)).alias("_o"))
    if not bounded:
        return ranked(first, "_o", "id").select("id", "rank")
    return first.select("id", F.row_number().over(Window.orderBy("_o", "id")).alias("rank"))


def hybrid(chunks: DataFrame, query: str, query_vector: list[float], limit: int = 10, density: bool = False) -> DataFrame:
    """Exact, lexical and vector candidates of chunks (with embedding), fused; chunks' columns with score."""
    positive(limit, "limit", 100)
    exact = chunks.where((F.col("name") == query) | (F.col("qualname") == query)).select("chunk_id", F.when(F.col("qualname") == query, 0).otherwise(1).alias("o"))
    exact = exact.orderBy("o", "chunk_id").limit(CANDIDATES)
    words = lexical(chunks, query, CANDIDATES, density).select("chunk_id", (-F.col("score")).alias("o"))
    near = vector_top(chunks.where("embedding IS NOT NULL"), query_vector, CANDIDATES, "chunk_id").select("chunk_id", F.col("distance").alias("o"))
    fused = fuse([ranks(x, "chunk_id", "o", "chunk_id") for x in (exact, words, near)], limit=limit)
    return fused.withColumnRenamed("id", "chunk_id").join(chunks, "chunk_id").orderBy(F.desc("score"), "chunk_id")


def budget(rows: DataFrame, by: list[str], order: str, cost: str, entries: int = 40, chars: int = 48_000) -> DataFrame:
    """Of each group's rows in order: those that fit; one that doesn't is skipped and later ones may fit. Adds `cite` (E1...).

    A sequential fold in the engine over the group's (bounded) candidates.
    """
    rest = [c for c in rows.columns if c not in by]
    item = F.struct(F.col(order).alias("_o"), F.col(cost).cast("long").alias("_c"), *rest)
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("x"))
    kind = listed.schema["x"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("kept"))

    def fold(acc, x):
        fits = (acc["used"] + x["_c"] <= chars) & (F.size(acc["kept"]) < entries)
        return F.when(fits, F.struct((acc["used"] + x["_c"]).alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    kept = listed.select(*by, F.posexplode(F.aggregate("x", start, fold, lambda a: a["kept"])).alias("n", "e"))
    return kept.select(*by, F.concat(F.lit("E"), (F.col("n") + 1).cast("string")).alias("cite"), *[F.col(f"e.{c}").alias(c) for c in rest])


def without_conflicts(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """One row a key; input in which rows of one key disagree is rejected."""
    require_none(conflicting(rows, key, payload), "rows of one key disagree")
    return rows.dropDuplicates([key])


def conflicting(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Keys whose rows disagree; such input is rejected rather than deduplicated."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*payload)).alias("versions")).where("versions > 1")
