"""Rows that carry many entries: columns of numbers as binary blobs, one row a group.

An entry that would be a row of its own costs a task far more than its bytes. Entries of one
batch that go to the same place travel as one row: a list of the texts they speak of (16-byte
digests), and for each entry the place of its text in that list and its numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from sparkloom.llm.anchored import merged
from sparkloom.llm.runs import whole_runs


def cuts(x: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal entries in x, and its length."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def halves(keys: list[bytes]) -> np.ndarray:
    """Digests as rows of two numbers."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def lane(keys: np.ndarray, lanes: int) -> np.ndarray:
    """The group of texts that a digest belongs to."""
    return (keys[:, 0] % np.uint64(lanes)).astype(np.int64)


class Rows:
    """Collects packed rows: g, ks (digests), ds (numbers of the texts), own (places in ks) and columns of entries."""

    def __init__(self, *columns: str):
        self.names = ["g", "ks", "ds", "own", *columns]
        self.out: list[list] = [[] for _ in self.names]

    def add(self, g: np.ndarray, own: np.ndarray, keys: np.ndarray, ds: np.ndarray, *columns: np.ndarray) -> None:
        """One row for each distinct g. own: the text of each entry, a place in keys and ds."""
        if not len(g):
            return
        order = np.argsort(g, kind="stable")
        g, own, columns = g[order], own[order], [c[order] for c in columns]
        at = cuts(g)
        for a, z in zip(at[:-1], at[1:]):
            mine, place = np.unique(own[a:z], return_inverse=True)
            for x, v in zip(self.out, (int(g[a]), keys[mine].tobytes(), ds[mine].astype("<i8").tobytes(), place.astype("<u4" if len(mine) > 1 << 16 else "<u2").tobytes(), *(c[a:z].tobytes() for c in columns))):
                x.append(v)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in self.out[1:])], names=self.names)

    @property
    def schema(self) -> str:
        return "g long, " + ", ".join(f"{n} binary" for n in self.names[1:])


def rows_schema(*columns: str) -> str:
    return Rows(*columns).schema


def unpack(t: pa.Table, *kinds: str) -> tuple[np.ndarray, ...]:
    """(row, own, keys, ds, columns...): entries of all rows; own is a place in keys and ds. kinds: types of the columns."""
    ks = t.column(1).to_pylist()
    n = np.array([len(k) // 16 for k in ks], np.int64)
    ds = np.frombuffer(b"".join(t.column(2).to_pylist()), "<i8")
    places = [np.frombuffer(o, "<u4" if k > 1 << 16 else "<u2") for o, k in zip(t.column(3).to_pylist(), n)]
    row = np.repeat(np.arange(len(n)), [len(p) for p in places])
    own = np.concatenate(places).astype(np.int64) + (np.cumsum(n) - n)[row]
    return row, own, halves(ks), ds, *(np.frombuffer(b"".join(t.column(4 + i).to_pylist()), kind) for i, kind in enumerate(kinds))


def by_text(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, offsets): entries in order of their text, and where each text's begin."""
    order = np.argsort(keys[:, 0], kind="stable")
    k = keys[order]
    if ((k[1:, 0] == k[:-1, 0]) & (k[1:, 1] != k[:-1, 1])).any():  # digests that agree in their first half
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        k = keys[order]
    return order, np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])


def gather_values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with one column of 64-bit values, sorted by g, to one row a text: key, v (blob)."""
    for t, _ in whole_runs(batches, 1):
        _, own, keys, _, v = unpack(t, "<u8")
        keys = keys[own]
        order, at = by_text(keys)
        keys, v = keys[order], v[order]
        yield pa.RecordBatch.from_arrays([pa.array([keys[a].tobytes() for a in at[:-1]], pa.binary()), pa.array([v[a:z].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())], names=["key", "v"])


def gather_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with columns s and e (32 bits), sorted by g, to one row a text: key, s, e (blobs of merged ranges)."""
    for t, _ in whole_runs(batches, 1):
        _, own, keys, _, s, e = unpack(t, "<u4", "<u4")
        keys = keys[own]
        order, at = by_text(keys)
        keys, s, e = keys[order], s[order].astype(np.int64), e[order].astype(np.int64)
        spans = [merged(s[a:z], e[a:z]) for a, z in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([keys[a].tobytes() for a in at[:-1]], pa.binary()), *(pa.array([x[i].astype("<i8").tobytes() for x in spans], pa.binary()) for i in (0, 1))], names=["key", "s", "e"])
