"""Concatenate and cut: documents end to end, cut into fixed windows.

Pass 1 encodes each document once, writes its ids to the shared folder with its place in its
partition, and leaves each partition's total. A prefix sum over the totals (one row a partition)
gives every partition's place in the whole; pass 2 reads the ids again and cuts each document at
the multiples of the window, so that a piece is a boundary record: whose, from where, how long,
and where it lies. No row is moved between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, release, short_batches

#: Partitions up to which their totals are broadcast.
BROADCAST_PARTS = 200_000


def token_table(docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pass 1: doc_id, ids (little-endian, 16 bits where the vocabulary fits, else 32), width, n, part, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from sparkloom.llm import vocab

        part, at, enc = TaskContext.get().partitionId(), 0, vocab.encoder(path)
        for b in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in enc.encode(b.column(1))]
            n = np.array([len(x) for x in ids], np.int64)
            width = [2 if x.max() < 1 << 16 else 4 for x in ids]
            raw = [x.astype("<u2" if w == 2 else "<u4").tobytes() for x, w in zip(ids, width)]
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(width, pa.int32()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(start)], names=["doc_id", "ids", "width", "n", "part", "start"])
        enc.forget()
        release()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, width int, n long, part long, start long")


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and then `end_id`, so null and empty texts have one token. Null ids
    and repeated rows are documents of their own, each packed. Only the last sequence can be
    short of the window. Empty tables give no rows; only the id and the text are read.
    """
    spark = docs.sparkSession
    short_batches(spark, 2000)
    table = materialize(spark, token_table(docs, path, end_id, doc_id, text), "pack-ids")
    totals = table.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = materialize(spark, totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "pack-bases")
    if totals.count() <= BROADCAST_PARTS:
        totals = F.broadcast(totals)
    placed = table.join(totals, F.col("part") == F.col("_part")).select("doc_id", "ids", "width", "n", (F.col("base") + F.col("start")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, length, raw = [], [], [], []
            widths, ats = b.column(2).to_pylist(), b.column(4).to_numpy()
            for i, ids in enumerate(b.column(1)):
                x = np.frombuffer(ids.as_buffer(), "<u2" if widths[i] == 2 else "<u4").astype("<u4")
                edges = np.arange(ats[i] // window + 1, (ats[i] + len(x) - 1) // window + 1) * window - ats[i]
                for a, z in zip([0, *edges], [*edges, len(x)]):
                    row.append(i), start.append(a), length.append(z - a), raw.append(x[a:z].tobytes())
            start, length, row = np.array(start, np.int64), np.array(length, np.int64), np.array(row, np.int64)
            at = ats[row] + start
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(raw, pa.binary()), b.column(3).take(pa.array(row)), pa.array(at // window), pa.array(at % window)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        release()

    kind = docs.schema[doc_id].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
