"""Token counts by the whole-token shortcut.

Offline, each worker proves which vocabulary strings encode alone as one token; pre-tokens
among them count as one without a merge, and only the rest is merged (each distinct chunk of
a batch once). Files of sentencepiece have no such cut at spaces and are encoded by the library, the
dealt method's exit for `.model` files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import short_batches


def count_tokens(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Null and empty texts: 0 bytes, 0 tokens. Null ids and repeated rows pass through as they are;
    only the id and the text are read, so other columns can't clash. Empty tables give no rows.
    """
    short_batches(docs.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkloom.llm import vocab

        enc = vocab.encoder(path) if path.endswith(".json") else None
        counter = enc.count if enc else _pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counter(b.column(1)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        if enc:
            enc.forget()

    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: np.array([len(x) for x in model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)
