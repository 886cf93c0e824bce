"""Similarity of whole sets of shingles, within groups of candidates that fingerprints propose.

Each set goes to its group, and there similarities are computed from the whole sets. A search over
the group keeps the components of the similar pairs and doesn't list the pairs. Groups of over
`SHARE` texts are cut into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, release, text_key
from sparkloom.llm.runs import whole_runs

#: Words of a shingle, least similarity of near copies, texts of a group that a task compares.
WIDTH, LEAST, SHARE = 5, 0.8, 1000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The set of hashes of a text's shingles, sorted. Texts of fewer words are one shingle; no words are one too."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    size = np.fromiter(map(len, words), np.int64, len(words))
    line, end = b" ".join(words), np.cumsum(size + 1) - 1
    start = (end - size)[: max(1, len(words) - width + 1)].tolist() or [0]
    end = end[min(width, len(words)) - 1 :].tolist() or [0]
    return np.unique(np.array([xxh64_intdigest(line[a:z]) for a, z in zip(start, end)], np.uint64))


def similar(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set the first set of its component, where sets of at least that similarity are linked."""
    n, root, left = np.array([len(s) for s in sets]), np.arange(len(sets)), np.ones(len(sets), bool)
    many = indexed = len(sets)
    flat = own = None
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        many -= 1
        while queue and many:
            p = queue.pop()
            if flat is None or 2 * many < indexed:  # what is left, by hash
                now, indexed = np.flatnonzero(left), many
                flat, own = np.concatenate([sets[i] for i in now]), np.repeat(now, n[now])
                order = np.argsort(flat, kind="stable")
                flat, own = flat[order], own[order]
            a, z = np.searchsorted(flat, sets[p], "left"), np.searchsorted(flat, sets[p], "right")
            at = np.repeat(a - np.cumsum(z - a) + (z - a), z - a) + np.arange((z - a).sum())
            common = np.bincount(own[at], minlength=len(sets))
            near = np.flatnonzero(left & (common * (1 + least) >= least * (n[p] + n) - 1e-9))
            left[near], root[near] = False, first
            many -= len(near)
            queue += near.tolist()
    return root


def similar_links(docs: DataFrame, members: DataFrame, doc_id: str, text: str, least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """u, v: links with the components of all pairs of a group whose sets are that similar.

    members: key, cid, n (size of the set), met (the group) and least (the smallest id) of each distinct text of a group of candidates.
    A large group first compares all with its first text; what is joined to that needn't be compared among
    itself. The rest is cut into shares, and pairs of shares are tasks.
    """
    spark, share = docs.sparkSession, SHARE

    @F.pandas_udf("array<long>")
    def whole(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([shingles(t, width).view(np.int64) for t in texts])

    texts = docs.select(text_key(text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = members.select(F.col("key").alias("k"), "cid", "met", F.col("least").alias("d"))
    texts = texts.join(own, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).dropDuplicates(["key"]).select("met", "cid", whole(F.col("text")).alias("s"))
    texts = materialize(spark, texts, "shingles-sets")
    large = materialize(spark, members.groupBy("met").agg(F.count("*").alias("m"), F.min("cid").alias("head")).where(F.col("m") > share), "shingles-large")
    heads = texts.join(large.select(F.col("met").alias("lm"), "head"), F.col("cid") == F.col("head")).select("lm", "head", F.col("s").alias("fs"))

    def near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for s, f in zip(b.column(2), b.column(3)):
                s, f = s.values.to_numpy(), f.values.to_numpy()
                common = len(np.intersect1d(s, f, assume_unique=True))
                near.append(common * (1 + least) >= least * (len(s) + len(f)) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(near, pa.bool_())], names=["met", "cid", "head", "near"])

    told = texts.join(heads, F.col("met") == F.col("lm")).select("met", "cid", "s", "fs", "head").mapInArrow(near_first, "met long, cid long, head long, near boolean")
    told = materialize(spark, told, "shingles-told")
    joined = told.where("near AND cid != head").select(F.col("cid").alias("u"), F.col("head").alias("v"))
    # Shares of what is joined (odd) and of what isn't (even): a pair of shares is a tile unless both are joined.
    parts = told.groupBy("met").agg(F.ceil(F.count_if("near") / F.lit(float(share))).cast("int").alias("on"), F.ceil(F.count_if(~F.col("near")) / F.lit(float(share))).cast("int").alias("off"))
    mine = told.join(parts, "met").withColumn("own", F.when(F.col("near"), 2 * F.pmod(F.xxhash64("cid"), F.col("on")) + 1).otherwise(2 * F.pmod(F.xxhash64("cid"), F.col("off"))).cast("int"))
    others = F.transform(F.sequence(F.lit(1), F.col("off")), lambda i: 2 * i - 2)
    others = F.when(F.col("off") == 0, F.array().cast("array<int>")).otherwise(others)
    more = F.when(F.col("near") | (F.col("on") == 0), F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.col("on")), lambda i: 2 * i - 1))
    tiles = mine.withColumn("by", F.explode(F.concat(others, more))).select("cid", F.least("own", "by").alias("i"), F.greatest("own", "by").alias("j"))
    small = members.join(large.select("met"), "met", "left_anti").select("cid", F.lit(0).alias("i"), F.lit(0).alias("j"))
    work = texts.join(small.union(tiles), "cid").select("met", "i", "j", "cid", "s")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, run in whole_runs(batches, 3):
            cid, s = t.column(3).to_numpy(), t.column(4).combine_chunks()
            edges, flat = s.offsets.to_numpy(), s.values.to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(run, prepend=-1, append=run[-1] + 1))
            root = np.concatenate([similar([flat[edges[i] : edges[i + 1]] for i in range(a, z)], least) + a for a, z in zip(cuts, cuts[1:])])
            link = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(cid[link]), pa.array(cid[root[link]])], names=["u", "v"])
            release()

    verified = work.repartition("met", "i", "j").sortWithinPartitions("met", "i", "j", "cid").mapInArrow(verify, "u long, v long")
    return joined.union(verified)
