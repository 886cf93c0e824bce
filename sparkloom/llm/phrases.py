"""Substring dedup over words by repeated-phrase automata.

Confirm: anchors (see anchored.py) find windows that occur in two texts, and which document
owns each: the smallest that holds it. An owner's confirmed windows join into passages.
Compile: passages are dealt into shards; a shard's automaton (Aho-Corasick) holds a key phrase
from every block of its passages. Stream: each document goes through the shards of the passages
it may hold; where a key phrase occurs, the match is extended word by word along the passage, and
a match of a whole window or more, in a document larger than the owner, is removed.

Hashes only propose: what is removed is what the automata found, word for word. Exact copies of
a text are settled by its digest. An owner with very many documents is dealt to several shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.anchored import NO_ID, Scheme, batched, differing, leaders, lists, merged, shared_anchors, signed
from sparkloom.llm.common import carried, discard, materialize, release, scope, text_key, uncarried

#: Words of the anchor's k-gram, of a passage's blocks, and of the key phrase at a block's start.
GRAM, BLOCK, KEY = 8, 25, 12
#: Words of passages in a shard, about; documents that one copy of an owner's passages serves.
SHARD_WORDS, SERVED = 150_000, 2000
#: Words that are worked on at once.
AT_ONCE = 400_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    from xxhash import xxh64_intdigest

    coded = pa.array(words, pa.binary()).dictionary_encode()
    own = np.array([xxh64_intdigest(w, 1) for w in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes part at ASCII white space only


def mark(docs: DataFrame, scheme: Scheme, doc_id: str, text: str) -> DataFrame:
    """One row a document: key, doc_id, d, n_words, sha, and its anchors: anchors, pos, c1, c2 (arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in batched([len(t) if (t := x.as_py()) else 0 for x in b.column(2)], 6 * AT_ONCE):
                part = b.slice(lo, hi - lo)
                words = [split(t) for t in part.column(2).to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
                edges = np.concatenate([[0], np.cumsum(n)])
                values = word_codes([x for w in words for x in w])
                at, h = scheme.anchors(values, edges)
                c1, c2 = scheme.contexts(values, edges, at)
                off = np.searchsorted(at, edges)
                doc = np.searchsorted(edges, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(sha), lists(signed(h), off, pa.int64()), lists((at - edges[doc]).astype(np.int32), off, pa.int32()), lists(signed(c1), off, pa.int64()), lists(signed(c2), off, pa.int32())],
                    names=["key", "doc_id", "n_words", "sha", "anchors", "pos", "c1", "c2"],
                )
            release()

    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(text_key(text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = slim.mapInArrow(run, f"key binary, doc_id {kind}, n_words long, sha string, anchors array<long>, pos array<int>, c1 array<long>, c2 array<int>")
    return out.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def candidates(marks: DataFrame) -> DataFrame:
    """key, d, a, pos, c1, c2: anchors that another text has too; copies of a text are one row, its smallest document's.

    The shared anchors are written first: then both sides of the join are plain shuffles, and an
    anchor that a large share of documents has is split among tasks.
    """
    shared = materialize(marks.sparkSession, shared_anchors(marks), "phrases-shared")
    each = marks.select("key", "d", F.explode(F.arrays_zip("anchors", "pos", "c1", "c2")).alias("x")).select("key", "d", F.col("x.anchors").alias("a"), "x.pos", "x.c1", "x.c2")
    return each.join(shared, "a", "left_semi").groupBy("key", "a", "pos", "c1", "c2").agg(F.min("d").alias("d"))


def _passages(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """mk, m, words (joined by a space): what an owner's ranges hold. runs: mk (the owner's key), s, e (arrays of half-open ranges)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mk, m, out = [], [], []
            for key, d, t, s, e in zip(*(c.to_pylist() for c in b.columns)):
                words = split(t)
                for x, y in zip(*merged(np.array(s), np.array(e))):
                    mk.append(key), m.append(d), out.append(b" ".join(words[x:y]))
            yield pa.RecordBatch.from_arrays([pa.array(mk, pa.binary()), pa.array(m, pa.int64()), pa.array(out, pa.binary())], names=["mk", "m", "words"])
        release()

    return texts.join(runs, texts.key == runs.mk).select("mk", "d", "text", "s", "e").mapInArrow(cut, "mk binary, m long, words binary")


class Shard:
    """An automaton over the key phrases of passages; finds where documents repeat a window of them."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int):
        import ahocorasick

        self.window, self.code, self.owner, self.body, self.words = window, {}, [], [], []
        keys: dict[str, list[tuple[int, int]]] = {}
        block = min(BLOCK, (window + 1) // 2)  # so that every window holds a whole block
        for m, raw in passages:
            words = raw.decode().split(" ")
            for at in range(0, max(1, len(words) - block + 1), block):
                keys.setdefault(" " + " ".join(words[at : at + min(KEY, block)]) + " ", []).append((len(self.body), at))
            self.owner.append(m)
            self.words.append([self.code.setdefault(w, len(self.code)) for w in words])
            self.body.append(np.array(self.words[-1], np.int64))
        self.machine = ahocorasick.Automaton()
        for k, v in keys.items():
            self.machine.add_word(k, (len(k), v))
        if keys:
            self.machine.make_automaton()
        self.empty = not keys

    def find(self, d: int, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of words that repeat a window of a passage whose owner is smaller than d.

        A place inside a range found before can only add to it if it agrees in the word before or behind that range.
        """
        words = [w.decode() for w in split(text)]
        if self.empty or len(words) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line, n = " " + " ".join(words) + " ", len(words)
        begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])  # of the space before each word
        mine = [self.code.get(w, -1) for w in words]
        own = np.array(mine, np.int64)
        done: dict[tuple[int, int], int] = {}
        left_of, right_of = [0] * n, [0] * n  # of the range found around each word
        s, e = [], []
        for last, (size, places) in self.machine.iter(line):
            i = int(np.searchsorted(begin, last - size + 1))
            for p, at in places:
                if self.owner[p] >= d:
                    continue
                lo, hi, known = left_of[i], right_of[i], self.words[p]
                if hi and (hi == n or at + hi - i >= len(known) or known[at + hi - i] != mine[hi]) and (lo == 0 or at + lo - i < 1 or known[at + lo - i - 1] != mine[lo - 1]):
                    continue
                if done.get((p, i - at), -1) >= i:
                    continue
                body, shift = self.body[p], i - at  # word j of the passage lies on word j + shift
                lo, hi = max(0, -shift), min(len(body), n - shift)
                differ = np.flatnonzero(body[lo:hi] != own[lo + shift : hi + shift]) + lo
                k = np.searchsorted(differ, at)
                left = differ[k - 1] + 1 if k else lo
                right = differ[k] if k < len(differ) else hi
                done[p, shift] = right + shift - 1
                if right - left >= self.window:
                    a, z = int(left + shift), int(right + shift)
                    s.append(a), e.append(z)
                    a, z = left_of[a] if right_of[a] else a, max(z, right_of[z - 1])
                    left_of[a:z], right_of[a:z] = [a] * (z - a), [z] * (z - a)
        return merged(np.array(s, np.int64), np.array(e, np.int64))


def find_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(marks, cuts): a narrow row a document, and for each text with a repeat key, d, text, s, e (ranges of words to remove).

    Texts are told apart by their key throughout; an id only says who is smaller.
    """
    spark = docs.sparkSession
    scheme = Scheme(window, min(GRAM, window))
    marks = materialize(spark, mark(docs, scheme, doc_id, text), "phrases-marks", keep=True)
    cand = materialize(spark, candidates(marks), "phrases-candidates")
    # The texts that take part, once each.
    wanted = cand.select("key", "d").distinct()
    texts = docs.select(text_key(text).alias("key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text).alias("text"))
    texts = texts.join(wanted, ["key", "d"], "left_semi")
    texts = materialize(spark, texts.groupBy("key", "d").agg(F.first("text").alias("text")), "phrases-texts")
    lead = materialize(spark, leaders(cand, "d", "key", "pos"), "phrases-leaders")
    need = differing(lead).select("lead.key", "lead.pos")
    # A text that shares a leader's id and its context isn't cut by it, and is compared for itself.
    twins = texts.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    beside = cand.join(twins, "d", "left_semi").join(lead.select("a", "c1", "c2", F.col("lead.d").alias("m"), F.col("lead.key").alias("mk")), ["a", "c1", "c2"]).where("d = m AND key != mk").select("key", "pos")
    need = need.union(beside).groupBy("key").agg(F.collect_set("pos").alias("at"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, d, pos, w1, w2 = [], [], [], [], []
            for one, i, t, at in zip(*(c.to_pylist() for c in b.columns)):
                values = word_codes(split(t))
                first, last = scheme.spans(np.array(at), len(values))
                live = np.zeros(len(values) + 2, np.int64)
                np.add.at(live, first, 1), np.add.at(live, last + 1, -1)
                starts = np.flatnonzero(np.cumsum(live)[: len(values)] > 0)
                x, y = scheme.window_hashes(values, starts)
                key += [one] * len(starts)
                d.append(np.full(len(starts), i, np.int64)), pos.append(starts.astype(np.int32)), w1.append(signed(x)), w2.append(signed(y))
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *(pa.array(np.concatenate(x)) for x in (d, pos, w1, w2))], names=["key", "d", "pos", "w1", "w2"])
        release()

    seen = texts.join(need, "key").select("key", "d", "text", "at").mapInArrow(windows, "key binary, d long, pos int, w1 long, w2 int")
    seen = materialize(spark, seen, "phrases-windows")
    owned = seen.groupBy("w1", "w2").agg(F.min(F.struct("d", "key", "pos")).alias("own"), F.max("d").alias("hi")).where("own.d < hi").select("w1", "w2", F.col("own.d").alias("m"), F.col("own.key").alias("mk"), F.col("own.pos").alias("pos"))
    owned = materialize(spark, owned, "phrases-owned")
    # Owners' ranges: of contexts that larger documents share, and of single windows.
    sizes = marks.groupBy(F.col("key").alias("mk")).agg(F.first("n_words").alias("n"))
    shared = lead.where("lead.d < hi").select(F.col("lead.key").alias("mk"), "lead.pos").join(sizes, "mk")
    whole = shared.select("mk", F.greatest(F.lit(0), F.col("pos") - scheme.w + 1).alias("s"), F.least(F.col("n").cast("int"), F.col("pos") + scheme.k + scheme.w - 1).alias("e"))
    single = owned.select("mk", F.col("pos").alias("s"), (F.col("pos") + window).alias("e"))
    runs = whole.union(single).groupBy("mk").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    passages = materialize(spark, _passages(texts, runs), "phrases-passages")
    # Which text may hold which owner's passages.
    by_context = cand.join(lead.where("lead.d < hi").select("a", "c1", "c2", F.col("lead.d").alias("m"), F.col("lead.key").alias("mk")), ["a", "c1", "c2"]).where("d > m").select("key", "mk")
    by_window = seen.join(owned.select("w1", "w2", "m", "mk"), ["w1", "w2"]).where("d > m").select("key", "mk")
    routes = materialize(spark, by_context.union(by_window).distinct(), "phrases-routes")
    for done in (cand, lead, seen, owned):
        discard(done)
    total = passages.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, total // (6 * SHARD_WORDS) + 1)
    salts = routes.groupBy("mk").agg(F.ceil(F.count("*") / F.lit(float(SERVED))).cast("long").alias("salts"))
    shard = lambda salt: F.pmod(F.xxhash64("mk", salt), F.lit(shards))
    dealt = passages.join(salts, "mk").select("mk", "m", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    dealt = dealt.select(shard(F.col("salt")).alias("shard"), F.lit(0).alias("kind"), F.col("m").alias("d"), F.col("mk").alias("key"), F.col("words").alias("body"))
    sent = routes.join(salts, "mk").select(shard(F.pmod(F.xxhash64("key"), F.col("salts"))).alias("shard"), "key").distinct()
    sent = sent.join(texts, "key").select("shard", F.lit(1).alias("kind"), "d", "key", F.col("text").cast("binary").alias("body"))
    stream = dealt.union(sent).repartition("shard").sortWithinPartitions("shard", "kind", "d")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, machine = None, [], None
        for b in batches:
            key, s, e = [], [], []
            for shard, kind, one, text_key, body in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    now, held, machine = shard, [], None
                if kind == 0:
                    held.append((one, body))
                    continue
                if machine is None:
                    machine, held = Shard(held, window), []
                x, y = machine.find(one, body.decode())
                if len(x):
                    key.append(text_key), s.append(x.tolist()), e.append(y.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(s, pa.list_(pa.int64())), pa.array(e, pa.list_(pa.int64()))], names=["key", "s", "e"])
        held, machine = [], None
        release()

    found = stream.mapInArrow(locate, "key binary, s array<long>, e array<long>")
    found = found.groupBy("key").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("e")).alias("e"))
    return marks, materialize(spark, texts.join(found, "key").select("key", "d", "text", "s", "e"), "phrases-cuts", keep=True)


def kept_words(text: str | None, s, e) -> list[bytes]:
    words, keep = split(text), []
    at = 0
    for x, y in zip(*merged(np.asarray(s, np.int64), np.asarray(e, np.int64))):
        keep += words[at:x]
        at = y
    return keep + words[at:]


def digests(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row.

    Null and empty texts have no words. A null id is larger than any other, so it owns nothing;
    rows of equal id never remove from one another, whether their texts are equal or not, but each
    loses what smaller ids hold. Empty tables give no rows; only the id and the text are read.
    """
    with scope(docs.sparkSession, 500):
        marks, cuts = find_repeats(docs, window, doc_id, text)

        def left(texts: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
            kept = [kept_words(*x) for x in zip(texts, s, e)]
            return pd.DataFrame({"kept": [len(k) for k in kept], "sha": [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]})

        got = cuts.select("key", F.pandas_udf(left, "kept long, sha string")("text", "s", "e").alias("r")).select("key", "r.kept", F.col("r.sha").alias("kept_sha"))
        first = marks.groupBy("key").agg(F.min("d").alias("first"))
        rows = marks.select("key", "doc_id", "d", "n_words", "sha").join(first.join(got, "key", "left"), "key")
        copy = (F.col("d") > F.col("first")) & (F.col("n_words") >= window)
        gone = F.when(copy, F.col("n_words")).when(F.col("kept").isNotNull(), F.col("n_words") - F.col("kept")).otherwise(F.lit(0))
        rows = rows.select("doc_id", "n_words", gone.cast("long").alias("n_removed"), F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))
        rows = materialize(docs.sparkSession, rows, "phrases-rows", keep=True)
        discard(marks), discard(cuts)
    return rows


def deduplicate(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with repeats cut out of their texts (untouched texts stay as they are, white space and all).

    Rows of which nothing is left that was there before go; rows without words (null and empty texts) stay.
    Null, equal and repeated ids count as in `digests`. Other columns pass through, whatever their names.
    Empty tables give no rows.
    """
    with scope(docs.sparkSession, 500):
        marks, cuts = find_repeats(docs, window, doc_id, text)
    first = marks.groupBy("key").agg(F.min("d").alias("first"), F.first("n_words").alias("n"))
    per = first.join(cuts.select("key", "s", "e"), "key", "left")

    def left(texts: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        release()
        return pd.Series([t if a is None else b" ".join(kept_words(t, a, z)).decode() for t, a, z in zip(texts, s, e)], dtype=object)

    rows = carried(docs, key=text_key(text), d=F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), t=F.col(text)).join(per, "key", "left")
    copy = (F.col("d") > F.col("first")) & (F.col("n") >= window)
    rows = rows.where(~F.coalesce(copy, F.lit(False))).withColumn("t", F.when(F.col("s").isNull(), F.col("t")).otherwise(F.pandas_udf(left, "string")("t", "s", "e")))
    return uncarried(rows.where(F.col("s").isNull() | (F.col("t") != "")), docs, **{text: F.col("t")})
