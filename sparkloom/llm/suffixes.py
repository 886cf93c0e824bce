"""Suffix-array dedup over bytes, by deep-shallow sorting.

Each window (50 bytes) has an anchor, the gram in it whose hash is least; windows that adjoin and
agree in their anchor make up a segment, so that every window lies in one segment, and equal windows
have equal anchors at equal places. Steps, each a pass over the distinct texts:

1. Sketch: which anchors do two texts have? Texts send 32 bits an anchor; which ones are shared comes
   back to the texts. (A collision only adds a candidate.)
2. Segments of shared anchors are dealt into buckets by their anchor, bytes and all. In a bucket,
   segments that agree byte for byte are one; their suffixes are ordered as deep as a window:
   ternary multikey quicksort on eight-byte characters to a shallow depth, then a blind trie for
   each group that still ties there and isn't equal throughout. Neighbours with a common prefix of
   a whole window are repeats: all but those of the smallest document lose the window's bytes.
3. What a text loses is cut.

An anchor that very many texts have (a line that a large share of documents has) is no bucket of its
own: its segments are dealt window by window, and sorted in the same way. Of what is equal within a
batch only the smallest document's goes to a bucket: the others lose it in any case. So a bucket
holds an entry for each batch of texts at most, however often a passage occurs.

Texts are told apart by their digest, never by their id; exact copies of a text are settled by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import packed
from sparkloom.llm.anchored import NO_ID, _slide, merged, mixed
from sparkloom.llm.common import BucketedTexts, materialize, release, scope, text_key
from sparkloom.llm.runs import whole_runs

#: Bytes of an anchor, bytes of texts worked on at once, shallow depth in eight-byte characters.
GRAM, AT_ONCE, SHALLOW = 24, 2_000_000, 4
#: Texts that share an anchor beyond which it is crowded; texts in one piece of work beyond which it is at once.
BUCKET, LOCAL = 2000, 64
#: Anchors that a sketch's bucket takes, about (a text has one in 13 bytes); buckets of segments to one of the sketch.
ANCHORS, FINER = 1_500_000, 4
#: Bytes of the texts of a group; groups, and tasks of a shuffle, at most (a task takes several buckets one after the other).
LANE, MOST = 128 << 20, 50_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Multipliers of eight-byte characters.
ODD = np.random.default_rng(50).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
#: Bits of a place in a piece of work, below the bits of a hash.
PLACE = np.uint64((1 << 26) - 1)
CROWDED = np.uint64(1 << 63)
#: In place of an anchor's place: a window dealt alone.
ALONE = (1 << 16) - 1


def words_at(raw: bytes, n: int, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each of the first n places as one number (not aligned: a view)."""
    return np.ndarray((n,), kind, raw, strides=(1,))


def gram_hash(word, k: int) -> np.ndarray:
    """Hash of k bytes: word(i) gives the eight bytes i places on."""
    if k < 8:
        return mixed((word(0) << np.uint64(64 - 8 * k)) * ODD[0])
    places = [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]
    out = word(places[0]) * ODD[0]
    for i, at in enumerate(places[1:], 1):
        out = out + word(at) * ODD[i]
    return mixed(out)


def pieces(whole: list[bytes], most: int, window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, from, bytes) of bounded size; each window starts in one piece."""
    out, total = [], 0
    for i, t in enumerate(whole):
        for a in range(0, len(t) - window + 1, most):
            part = t[a : a + most + window - 1]
            if out and total + len(part) > most:
                yield out
                out, total = [], 0
            out.append((i, a, part))
            total += len(part)
    if out:
        yield out


class Segments:
    """Segments of a piece of work: own (text), s (place in the text), at (place in raw), n (windows), o (the anchor's place in it), e (its hash)."""

    def __init__(self, parts: list[tuple[int, int, bytes]], window: int, k: int):
        self.window, self.k = window, k
        size = np.array([len(p) for _, _, p in parts], np.int64)
        ends = np.cumsum(size)
        total, w = int(ends[-1]), window - k + 1
        self.raw = b"".join(p for _, _, p in parts) + bytes(2 * window + 16)
        word = np.ascontiguousarray(words_at(self.raw, total + window + 8))
        m = total - k + 1
        h = gram_hash(lambda i: word[i : i + m], k)
        least = _slide(h & ~PLACE | np.arange(m, dtype=np.uint64), w, np.minimum) & PLACE  # of equal hashes the first
        inside = np.ones(len(least), bool)
        for e in ends[:-1]:
            inside[max(0, e - window + 1) : e] = False
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        stop = np.append(np.flatnonzero(begin | ~inside), len(least))
        self.at = np.flatnonzero(begin)
        self.n = stop[np.searchsorted(stop, self.at) + 1] - self.at
        place = least[self.at].astype(np.int64)
        self.e, self.o = h[place], place - self.at
        part = np.searchsorted(ends, self.at, "right")
        self.own = np.array([i for i, _, _ in parts], np.int64)[part]
        self.s = np.array([a for _, a, _ in parts], np.int64)[part] + self.at - (ends - size)[part]

    def windows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, place in it) of each window of the segments picked."""
        n = self.n[pick]
        return np.repeat(pick, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def table_of(raw: bytes, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of eight-byte characters: size bytes from each place, then zeros. raw reaches `width` bytes beyond every place."""
    words = words_at(raw, len(raw) - 7, ">u8")
    out = np.empty((len(at), width // 8), np.uint64)
    for j in range(width // 8):
        left = np.clip(size - 8 * j, 0, 8).astype(np.uint64) * np.uint64(8)
        x = words[at + 8 * j].astype(np.uint64)
        out[:, j] = np.where(left == 64, x, x >> (np.uint64(64) - np.maximum(left, np.uint64(1))) << (np.uint64(64) - np.maximum(left, np.uint64(1))))
        out[left == 0, j] = 0
    return out


def row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out += mixed(rows[:, j] + ODD[j]) * ODD[j + 1]
    return mixed(out)


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): equal rows adjoin and share a class number. Hashes only bring them together; rows are compared whole."""
    order = np.argsort(row_hash(rows), kind="stable")
    same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    return order, np.cumsum(np.append(0, ~same))[: len(order)]


def least_of(order: np.ndarray, cls: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The smallest document of each entry's class, in the order given."""
    at = packed.cuts(cls)
    return np.repeat(np.minimum.reduceat(d[order], at[:-1]), np.diff(at)) if len(order) else d


class BlindTrie:
    """Orders byte strings of equal length. Nodes hold a depth and the branching byte of each child only;
    an insertion walks down without comparing, compares once with the leaf it reaches, and branches
    where the two differ. Equal strings share a leaf."""

    def __init__(self, data: bytes, depth: int):
        self.data, self.depth, self.root = data, depth, None

    def _char(self, at: int, d: int) -> int:
        return self.data[at + d]

    def insert(self, name: int, at: int) -> None:
        if self.root is None:
            self.root = [self.depth, None, [(name, at)]]
            return
        node = self.root
        while node[1] is not None:
            node = node[1].get(self._char(at, node[0])) or next(iter(node[1].values()))
        other, d = node[2][0][1], 0
        a, b = self.data[at : at + self.depth], self.data[other : other + self.depth]
        if a == b:
            node[2].append((name, at))
            return
        while a[d] == b[d]:
            d += 1
        up, key, node = None, 0, self.root
        while node[0] < d:
            up, key = node, self._char(at, node[0])
            node = node[1][key]
        leaf = [self.depth, None, [(name, at)]]
        if node[0] == d and node[1] is not None:
            node[1][a[d]] = leaf
            return
        branch = [d, {a[d]: leaf, b[d]: node}, None]
        if up is None:
            self.root = branch
        else:
            up[1][key] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[1] is None:
                out += [n for n, _ in node[2]]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def multikey(chars, order: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ternary multikey quicksort of ranges of `order`, all ranges a round at a time.

    Each round parts every range that is left by a pivot character at its depth: what is less, equal
    and greater. The equal part goes on at the next depth, the others at the same. chars(entries,
    depths) gives characters. Returns the ranges (start, size) of over one entry that tie at depth `most`.
    """
    depth, tied = np.zeros(len(start), np.int64), [(start[:0], size[:0])]
    while True:
        done = depth == most
        tied.append((start[done & (size > 1)], size[done & (size > 1)]))
        left = ~done & (size > 1)
        start, size, depth = start[left], size[left], depth[left]
        if not len(start):
            return np.concatenate([a for a, _ in tied]), np.concatenate([n for _, n in tied])
        first = np.cumsum(size) - size
        g = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(g)) + (start - first)[g]
        names = order[at]
        c = chars(names, depth[g])
        p, q, r = c[first], c[first + size // 2], c[first + size - 1]
        pivot = np.maximum(np.minimum(p, q), np.minimum(np.maximum(p, q), r))[g]
        less, same = c < pivot, c == pivot
        to, counts, base = np.empty(len(g), np.int64), [], start
        for side in (less, same, ~(less | same)):
            seen = np.cumsum(side)
            before = np.where(first > 0, seen[np.maximum(first - 1, 0)], 0)
            n = seen[first + size - 1] - before
            to[side] = (base - before)[g[side]] + seen[side] - 1
            counts.append(n)
            base = base + n
        order[to] = names
        start, size, depth = np.concatenate([start, start + counts[0], start + counts[0] + counts[1]]), np.concatenate(counts), np.concatenate([depth, depth + 1, depth])


def deep_shallow(data: bytes, at: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal): suffixes at `at` in order of (bucket, first `depth` bytes), and whether each agrees with the one before.

    data must reach at least `depth` bytes beyond every suffix's start.
    """
    data = bytes(data) + bytes(8)
    words = words_at(data, len(data) - 7, ">u8")

    def chars(names: np.ndarray, i) -> np.ndarray:
        over = np.maximum(0, 8 * (i + 1) - depth).astype(np.uint64) * np.uint64(8)
        return words[at[names] + 8 * i].astype(np.uint64) >> over

    order = np.argsort(bucket, kind="stable")
    own = packed.cuts(bucket[order])
    last = -(-depth // 8)
    start, size = multikey(chars, order, own[:-1], np.diff(own), min(SHALLOW, last))
    equal = np.zeros(len(order), bool)

    def agree(start: np.ndarray, size: np.ndarray) -> None:
        n = size - 1
        i = np.repeat(start + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
        for j in range(SHALLOW, last):
            i = i[chars(order[i], j) == chars(order[i - 1], j)]
        equal[i] = True

    agree(start, size)
    so_far = np.append(0, np.cumsum(equal))
    deep = np.flatnonzero(so_far[start + size] - so_far[start] < size - 1)
    for g in deep:
        a, z = start[g], start[g] + size[g]
        trie = BlindTrie(data, depth)
        for name in order[a:z].tolist():
            trie.insert(name, int(at[name]))
        order[a:z] = trie.ordered()
        equal[a:z] = False
    agree(start[deep], size[deep])
    return order, equal


def repeats(rows: np.ndarray, size: np.ndarray, group: np.ndarray, place: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place): windows of distinct segments that a smaller owner has too.

    rows: segments as characters; size: their bytes; group and place: the anchor and where it lies. Equal windows
    have equal anchors at equal places, so suffixes are sorted within (group, place - start).
    """
    n = size - window + 1
    seg = np.repeat(np.arange(len(size)), n)
    j = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    bucket = mixed(group[seg] ^ (place[seg] - j).astype(np.uint64) * ODD[63])
    order = np.argsort(bucket, kind="stable")
    x = bucket[order]
    two = np.zeros(len(x), bool)
    two[1:] = x[1:] == x[:-1]
    two[:-1] |= two[1:]
    pick = order[two]  # what shares its bucket with another
    order, equal = deep_shallow(rows.astype(">u8").tobytes(), seg[pick] * (8 * rows.shape[1]) + j[pick], bucket[pick], window)
    first = np.flatnonzero(~equal)
    if not len(first):
        return seg[:0], j[:0]
    pick = pick[order]
    least = np.repeat(np.minimum.reduceat(owner[seg[pick]], first), np.diff(np.append(first, len(pick))))
    lost = pick[owner[seg[pick]] > least]
    return seg[lost], j[lost]


def find_repeats(docs: DataFrame, window: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, BucketedTexts, DataFrame]:
    """(marks, firsts, texts, found): a narrow row a document; key, d of each distinct text that has a window, with its smallest
    document; those texts; and key, s, e (blobs of ranges to remove)."""
    spark = docs.sparkSession
    k, crowd, named = min(GRAM, window), BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions"))
    most, many_texts = AT_ONCE, LOCAL
    width = -(-(2 * window - k) // 8) * 8
    whole = F.coalesce(F.col(text), F.lit(""))
    marks = docs.select(text_key(text).alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"))
    marks = materialize(spark, marks, "suffixes-marks")
    firsts = marks.where(F.col("n_bytes") >= window).groupBy("key").agg(F.min("d").alias("d"), F.min("n_bytes").alias("n_bytes"))
    firsts = materialize(spark, firsts, "suffixes-firsts")
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    # Groups of texts and buckets grow with the bytes, whatever number of partitions the session names.
    lanes = max(named, min(total // LANE, MOST))
    texts = BucketedTexts(docs, firsts, doc_id, text, lanes)
    buckets = max(named, 2 * total // (27 * ANCHORS) + 1)
    tasks = max(lanes, min(buckets, MOST))
    finer = FINER * buckets

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys, whole = [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key not in seen:
                    seen.add(key), keys.append(key), whole.append(t.encode())
            ks, ds = packed.halves(keys), np.zeros(len(keys), np.int64)
            for parts in pieces(whole, most, window):
                x = Segments(parts, window, k)
                own, e = x.own, mixed(x.e)
                first = np.unique(mixed(e + own.astype(np.uint64) * ODD[62]), return_index=True)[1]  # an anchor once a text
                own, e = own[first], e[first]
                g, v = (e % np.uint64(buckets)).astype(np.int64), e >> np.uint64(32)
                order = np.argsort(e, kind="stable")
                at = packed.cuts(e[order])
                n = np.empty(len(e), np.int64)
                n[order] = np.repeat(np.diff(at), np.diff(at))
                lead = np.zeros(len(e), bool)
                lead[order[at[:-1]]] = True
                local = n >= many_texts  # crowded for sure: the bucket hears of it once, the texts at once
                out = packed.Rows("v", "n")
                send = ~local | lead
                out.add(g[send], own[send], ks, ds, v[send].astype("<u4"), np.where(local, 255, 1)[send].astype("u1"))
                out.add(buckets + packed.lane(ks, lanes)[own[local]], own[local], ks, ds, (g[local].astype(np.uint64) << np.uint64(32) | v[local] | CROWDED).astype("<u8"), np.zeros(local.sum(), "u1"))
                yield out.batch()
            release()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_runs(batches, 1):
            out = packed.Rows("v")
            gs = t.column(0).to_numpy()
            known = np.flatnonzero(gs >= buckets)
            if len(known):
                part = t.take(pa.array(known)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array(gs[known] - buckets), *(part.column(i) for i in (1, 2, 3, 4))], names=["g", "ks", "ds", "own", "v"])
            t = t.take(pa.array(np.flatnonzero(gs < buckets)))
            if t.num_rows:
                row, own, ks, ds, v, n = packed.unpack(t, "<u4", "u1")
                code = t.column(0).to_numpy()[row].astype(np.uint64) << np.uint64(32) | v
                order = np.argsort(code, kind="stable")
                at = packed.cuts(code[order])
                count = np.add.reduceat(n[order].astype(np.int64), at[:-1])
                count = np.repeat(np.where(np.maximum.reduceat(n[order], at[:-1]) == 255, crowd + 1, count), np.diff(at))
                pick = (count > 1) & (n[order] < 255)
                own, code = own[order][pick], (code[order] | np.where(count > crowd, CROWDED, np.uint64(0)))[pick]
                out.add(packed.lane(ks, lanes)[own], own, ks, ds, code.astype("<u8"))
                yield out.batch()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys, ids, whole, answers = [], [], [], []
            for key, d, t, v in zip(*(c.to_pylist() for c in b.columns)):
                if key not in seen:
                    seen.add(key), keys.append(key), ids.append(d), whole.append(t.encode()), answers.append(np.frombuffer(v, "<u8"))
            ks, ds = packed.halves(keys), np.array(ids, np.int64)
            salt = lambda own: own.astype(np.uint64) * ODD[61]
            wanted = np.concatenate(answers) if answers else np.zeros(0, np.uint64)
            held = mixed((wanted & ~CROWDED) + salt(np.repeat(np.arange(len(answers)), [len(a) for a in answers])))
            order = np.argsort(held)
            held, wanted = held[order], wanted[order]
            for parts in pieces(whole, most // 2, window):
                x = Segments(parts, window, k)
                e = mixed(x.e)
                code = mixed((e % np.uint64(buckets) << np.uint64(32) | e >> np.uint64(32)) + salt(x.own))
                at = np.minimum(np.searchsorted(held, code), max(len(held) - 1, 0))
                hit = held[at] == code if len(held) else np.zeros(len(code), bool)
                many = hit & (wanted[at] >= CROWDED) if len(held) else hit
                one = np.flatnonzero(hit & ~many)
                seg, j = x.windows(np.flatnonzero(many))
                out = packed.Rows("s", "size", "o", "body")
                for own, s, start, size, o, e in (
                    (x.own[one], x.s[one], x.at[one], x.n[one] + window - 1, x.o[one], e[one]),
                    (x.own[seg], x.s[seg] + j, x.at[seg] + j, np.full(len(seg), window), np.full(len(seg), ALONE), None),
                ):
                    rows = table_of(x.raw, start, size, width)
                    order, cls = classes(np.column_stack([rows, tagged(size, o)]))
                    gone = ds[own[order]] > least_of(order, cls, ds[own])
                    lost, kept = order[gone], order[~gone]
                    nothing = np.zeros((len(lost), 0), "u1")
                    out.add(finer + packed.lane(ks, lanes)[own[lost]], own[lost], ks, ds, s[lost].astype("<u4"), nothing, (s + size)[lost].astype("<u4"), nothing)
                    e = row_hash(rows[kept]) if e is None else e[kept]
                    out.add((e >> np.uint64(8)) % np.uint64(finer), own[kept], ks, ds, s[kept].astype("<u4"), size[kept].astype("<u2"), o[kept].astype("<u2"), rows[kept].astype(">u8"))
                yield out.batch()
            release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_runs(batches, 1):
            gs = t.column(0).to_numpy()
            known = np.flatnonzero(gs >= finer)
            if len(known):
                part = t.take(pa.array(known)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array(gs[known] - finer), *(part.column(i) for i in (1, 2, 3, 4, 6))], names=["g", "ks", "ds", "own", "s", "e"])
            t = t.take(pa.array(np.flatnonzero(gs < finer)))
            if not t.num_rows:
                continue
            _, own, ks, ds, s, size, o, body = packed.unpack(t, "<u4", "<u2", "<u2", ">u8")
            s, size, o, d, body = s.astype(np.int64), size.astype(np.int64), o.astype(np.int64), ds[own], body.astype(np.uint64).reshape(-1, width // 8)
            order, cls = classes(np.column_stack([body, tagged(size, o)]))
            least = least_of(order, cls, d)
            at = packed.cuts(cls)[:-1]
            one = order[at]  # any of a class stands for it
            lo, hi = repeats(body[one], size[one], anchors_of(body[one], o[one], k), o[one], least[at], window)
            # A class loses from its first lost window to the end of its last: windows of a segment overlap.
            first, last = np.full(len(one), window * 2), np.full(len(one), -1)
            np.minimum.at(first, lo, hi), np.maximum.at(last, lo, hi)
            gone = d[order] > least
            own, s, size = own[order], s[order], size[order]
            first, last = np.where(gone, 0, first[cls]), np.where(gone, size, last[cls] + window)
            pick = gone | (last >= window)
            out = packed.Rows("s", "e")
            out.add(packed.lane(ks, lanes)[own[pick]], own[pick], ks, ds, (s + first)[pick].astype("<u4"), (s + last)[pick].astype("<u4"))
            yield out.batch()

    def dealt(df: DataFrame) -> DataFrame:
        return (df.repartition(tasks, "g") if tasks > named else df.repartition("g")).sortWithinPartitions("g")

    shared = dealt(texts.table().select("key", "text").mapInArrow(sketch, packed.rows_schema("v", "n"))).mapInArrow(confirm, packed.rows_schema("v"))
    answers = materialize(spark, dealt(shared).mapInArrow(packed.gather_values, "key binary, v binary"), "suffixes-answers")
    cut = dealt(texts.join(answers).select("key", "d", "text", "v").mapInArrow(segments, packed.rows_schema("s", "size", "o", "body"))).mapInArrow(compare, packed.rows_schema("s", "e"))
    found = materialize(spark, dealt(cut).mapInArrow(packed.gather_spans, "key binary, s binary, e binary"), "suffixes-found")
    return marks, firsts, texts, found


def tagged(size: np.ndarray, o: np.ndarray) -> np.ndarray:
    return size.astype(np.uint64) << np.uint64(32) | o.astype(np.uint64)


def anchors_of(body: np.ndarray, o: np.ndarray, k: int) -> np.ndarray:
    """Hash of each segment's anchor; of a window alone, of the whole window."""
    raw = body.astype(">u8").tobytes() + bytes(8)
    words, at = words_at(raw, len(raw) - 7), np.arange(len(o)) * (8 * body.shape[1]) + np.where(o == ALONE, 0, o)
    return np.where(o == ALONE, row_hash(body), gram_hash(lambda i: words[at + i].astype(np.uint64), k))


def cut_bytes(text: str, s, e) -> tuple[bytes, int]:
    """What is left of a text's bytes, and how many maximal runs went."""
    raw = (text or "").encode()
    s, e = merged(np.asarray(s, np.int64), np.minimum(np.asarray(e, np.int64), len(raw)))
    edges = [0, *np.stack([s, e], 1).reshape(-1).tolist(), len(raw)]
    return b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])), len(s)


def digests(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    Null and empty texts have no bytes. A null id is larger than any other, so it owns nothing;
    rows of equal id never remove from one another, whether their texts are equal or not, but each
    loses what smaller ids hold. Empty tables give no rows; only the id and the text are read.
    """
    spark = docs.sparkSession
    with scope(spark, 500):
        marks, firsts, texts, found = find_repeats(docs, window, doc_id, text)

        @F.pandas_udf("kept long, spans long, sha string")
        def left(whole: pd.Series, s: pd.Series, e: pd.Series) -> pd.DataFrame:
            kept = [cut_bytes(t, np.frombuffer(a, "<i8"), np.frombuffer(z, "<i8")) for t, a, z in zip(whole, s, e)]
            return pd.DataFrame({"kept": [len(x) for x, _ in kept], "spans": [n for _, n in kept], "sha": [hashlib.sha256(x).hexdigest() for x, _ in kept]})

        got = texts.join(found).select("key", left("text", "s", "e").alias("r")).select("key", "r.kept", "r.spans", F.col("r.sha").alias("kept_sha"))
        got = materialize(spark, got.dropDuplicates(["key"]), "suffixes-kept")
        first = firsts.select("key", F.col("d").alias("first")).join(got, "key", "left")
        rows = marks.join(first, "key", "left")
        copy = F.coalesce(F.col("d") > F.col("first"), F.lit(False))
        n = F.when(copy, F.col("n_bytes")).otherwise(F.col("n_bytes") - F.coalesce("kept", "n_bytes"))
        spans = F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0)))
        rows = rows.select("doc_id", "n_bytes", n.cast("long").alias("n_removed"), spans.cast("long").alias("n_spans"), F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))
        return materialize(spark, rows, "suffixes-rows", keep=True)
