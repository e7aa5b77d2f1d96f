"""Arrow arrays worked on a few rows at a time.

A batch of Spark's holds up to 10 000 whole texts. Only ``ROWS`` of them are
Python objects at once, so what a worker needs does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

ROWS = 128


def sliced(work: Callable[..., list], kind: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """``work`` turns lists of values into a list of as many results of ``kind``."""
    parts = [pa.array(work(*(a.slice(at, ROWS).to_pylist() for a in arrays)), kind) for at in range(0, len(arrays[0]), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
