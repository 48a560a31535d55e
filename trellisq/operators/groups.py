"""Whole groups of sorted rows inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _numbered(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(len(t), bool)
    for c in t.columns[:keys]:
        codes = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by the first ``keys`` columns, with the group number of each row.

    A table has about ``size`` rows, more only where a single group does.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= size:
            t = pa.Table.from_batches(held)
            g = _numbered(t, keys)
            k = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if k:
                yield t.slice(0, k), g[:k]
            held, rows = t.slice(k).to_batches(), len(t) - k
            size = max(size, 2 * rows)
    if rows:
        t = pa.Table.from_batches(held)
        yield t, _numbered(t, keys)
