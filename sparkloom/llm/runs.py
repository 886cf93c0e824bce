"""Runs of equal keys in partitions that Spark has dealt and sorted by key, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a run ends, with the run's number of each row. The first `keys` columns are the key.

    Holds one batch and the run that reaches over its end.
    """
    rest: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        first = tuple(b.column(i)[0].as_py() for i in range(keys))
        change = _changes(b, keys)
        cuts = np.flatnonzero(change)
        if rest and first != last:
            yield _numbered(rest, keys)
            rest = []
        if len(cuts) == 0:
            rest.append(b)
        else:
            end = int(cuts[-1]) + 1
            yield _numbered([*rest, b.slice(0, end)], keys)
            rest = [b.slice(end)]
        last = tuple(b.column(i)[b.num_rows - 1].as_py() for i in range(keys))
    if rest:
        yield _numbered(rest, keys)


def _changes(b, keys: int) -> np.ndarray:
    """Where the next row's key differs, of rows but the last."""
    out = np.zeros(b.num_rows - 1, bool)
    for i in range(keys):
        x = b.column(i).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(i).to_numpy()
        out |= x[1:] != x[:-1]
    return out


def _numbered(parts: list[pa.RecordBatch], keys: int) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(parts)
    return t, np.concatenate([[0], np.cumsum(_changes(t, keys))])
