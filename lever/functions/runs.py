"""Runs of equal rows in Arrow data that comes in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def starts(marks: pa.Table) -> np.ndarray:
    """Where each run of equal rows begins."""
    new = np.zeros(max(marks.num_rows - 1, 0), bool)
    for column in marks.columns:
        whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        codes = whole.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return np.flatnonzero(np.append(np.ones(min(marks.num_rows, 1), bool), new))
