"""Helpers the training-data operators share: shared-folder tables, Arrow batches, word rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's switch for removing an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows an Arrow batch holds; whole texts can be long, so batches are kept short.
BATCH_ROWS = 1000


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where it names none, a session of one machine (tests) gets a folder of its own that goes with the
    process; on a cluster that is an error, for a folder of one machine would lose what others write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not found and not _own:
        _own.append(tempfile.mkdtemp(prefix="shared-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return (found or f"file://{_own[0]}").rstrip("/")


class _Scopes(threading.local):
    """What is to be done at the end of each open scope of a thread."""

    def __init__(self):
        self.open: list[list[Callable[[], None]]] = []


_scopes = _Scopes()


@contextlib.contextmanager
def scope(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Within it, Arrow batches are short (where `rows` is given); at its end confs are as before, and tables written within are removed but those kept."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n, None) for n in names}
    _scopes.open.append([])
    if rows:
        short_batches(spark, rows)
    try:
        yield
    finally:
        for remove in _scopes.open.pop():
            remove()
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_end(remove: Callable[[], None], keep: bool = False) -> None:
    """A kept table belongs to the scope around the one that wrote it, if there is one."""
    if len(_scopes.open) > keep:
        _scopes.open[-1 - keep].append(remove)


@contextlib.contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """What a write shuffled isn't needed again: its files go with the write, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(spark: SparkSession, df: DataFrame, name: str, keep: bool = False, **options) -> DataFrame:
    """Cut lineage: write a Parquet table to the shared folder and read it again.

    A table that was committed survives the loss of executors; later stages read it
    instead of computing it anew. It goes with the scope it was written in, unless kept.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleanup(spark):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    _at_end(lambda: _remove(spark, path), keep)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that `materialize` wrote, before its scope ends."""
    _remove(df.sparkSession, df._table)


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """`row` (all columns of df in one struct, so that no name of theirs can clash) and the columns given."""
    return df.select(F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def uncarried(rows: DataFrame, df: DataFrame, **new: Column) -> DataFrame:
    """The columns of df out of `row`, with those in `new` in place of theirs or behind them."""
    own = [new.get(c, F.col(f"row.{_quoted(c)}")).alias(c) for c in df.columns]
    return rows.select(*own, *[c.alias(n) for n, c in new.items() if n not in df.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class BucketedTexts:
    """Distinct texts (key, d, text), bucketed by key in the shared folder: joins with narrow rows by key move those rows only."""

    def __init__(self, docs: DataFrame, firsts: DataFrame, doc_id: str, text: str, buckets: int):
        """firsts: key, d of each text that takes part, with the smallest document that holds it."""
        self.spark, name = docs.sparkSession, f"texts_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        rows = docs.select(text_key(text).alias("key"), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.col(text).alias("text"))
        # The least d is the one row's; by this condition rows are dealt by key alone, as the buckets are.
        rows = rows.join(firsts.select("key", F.col("d").alias("least")).hint("shuffle_hash"), "key").where("d <= least").select("key", "d", "text")
        with _cleanup(self.spark):
            rows.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "key").saveAsTable(name)
        self.name = name
        _at_end(lambda: (self.spark.sql(f"DROP TABLE {name}"), _remove(self.spark, path)))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def join(self, narrow: DataFrame) -> DataFrame:
        return self.table().join(narrow.hint("shuffle_hash"), "key")


#: Bytes an Arrow batch may hold where more rows at once save work.
BATCH_BYTES = 6_000_000


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """In a Python worker: give freed memory back to the system, for a worker stays while others run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_key(text: str = "text") -> Column:
    """128 bits of a text: equal texts, equal keys. Null gets a key of its own."""
    t = F.col(text)
    return F.when(t.isNull(), F.lit(b"-")).otherwise(F.unhex(F.md5(t.cast("binary"))))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3 is 1; a null id counts as learnable never, held out always."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def is_held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1
