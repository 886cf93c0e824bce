"""Content-chosen anchors, so that equal windows of two documents share one, and what both
window operators (over words, over bytes) derive from them.

A window of `window` symbols holds w = window - k + 1 k-grams; those whose hash is the least in
some window are anchors. Equal windows choose the same anchors at the same places, so documents
that share a window share an anchor's hash. The context of an anchor is all that its windows can
reach: w - 1 symbols before the k-gram, w - 1 after it. Two anchors of equal context agree in all
their windows.

Steps that are one shuffle of narrow rows each: which anchors occur in two different texts; of
those, which contexts are equal (a context's leader is its smallest document); which anchors have
contexts that differ, whose leaders have to be compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

#: Odd multipliers of the two rolling hashes, and a mixer's constants (fixed values of public mixers).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: What a null id counts as: larger than any, so that it never owns a repeat.
NO_ID = (1 << 63) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64, for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        have = _powers[base] = tuple(np.cumprod(np.concatenate([one, np.full(size - 1, b, np.uint64)])) for b in (base, inverse))
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    for c in MIX:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any range of a sequence of 64-bit symbols from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _power(base, len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each w adjoining entries, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out, have = pick(out[:-step], out[step:]), have + step
    return out


@dataclass(frozen=True)
class Scheme:
    window: int
    k: int

    @property
    def w(self) -> int:
        return self.window - self.k + 1

    def anchors(self, values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of documents laid end to end (edges: n + 1 offsets)."""
        n, w = len(values), self.w
        if n < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = np.arange(n - self.k + 1)
        h = mixed(Rolling(values, BASES[0]).of(grams, grams + self.k))
        own = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        least = _slide(h, w, np.minimum)
        least[own[: len(least)] != own[self.window - 1 :]] = 0  # windows that reach over a document's end
        reach = _slide(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
        at = np.flatnonzero(reach == h)
        return at, h[at]

    def contexts(self, values: np.ndarray, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each anchor's context, cut where its document ends."""
        doc = np.searchsorted(edges, at, side="right") - 1
        a, z = np.maximum(edges[doc], at - self.w + 1), np.minimum(edges[doc + 1], at + self.k + self.w - 1)
        cut = ((at - a) * (4 * self.window) + (z - at)).astype(np.uint64)
        one, two = (mixed(Rolling(values, b).of(a, z) + mixed(cut + np.uint64(i + 1))) for i, b in enumerate(BASES))
        return one, (two >> np.uint64(32)).astype(np.uint32)

    def window_hashes(self, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = (mixed(Rolling(values, b).of(starts, starts + self.window)) for b in BASES)
        return one, (two >> np.uint64(32)).astype(np.uint32)

    def spans(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last window start of each anchor in a document of n symbols."""
        return np.maximum(0, at - self.w + 1), np.minimum(at, n - self.window)


def lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.view(np.int32)


def batched(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents that together stay under a size (one document may pass it)."""
    a = total = 0
    for i, s in enumerate(sizes):
        if i > a and total + s > most:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of what half-open ranges cover; adjoining ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, s[1:] > e[:-1])
    return s[first], e[np.append(first[1:], True)]


def shared_anchors(marks: DataFrame) -> DataFrame:
    """a: anchors of two different texts. marks: one row a document with key (of its text) and anchors (array of long).

    Copies of one text don't count: they are settled by the key.
    """
    each = marks.select(F.xxhash64("key").alias("t"), F.explode("anchors").alias("a"))
    return each.groupBy("a").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select("a")


def leaders(cand: DataFrame, *lead: str) -> DataFrame:
    """a, c1, c2, lead (struct of the columns named, d first), hi: distinct contexts with their smallest document. cand: key, d, a, pos, c1, c2."""
    return cand.groupBy("a", "c1", "c2").agg(F.min(F.struct(*lead)).alias("lead"), F.max("d").alias("hi"))


def differing(lead: DataFrame) -> DataFrame:
    """Of leaders(): those whose anchor has other contexts too, with n, their number.

    The numbers are written first, so that a crowded anchor's contexts are split among tasks by the join.
    """
    many = lead.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return lead.join(materialize(lead.sparkSession, many, "anchors-many"), "a")
