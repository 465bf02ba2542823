"""Arrow strings as numpy code-point arrays, and back, without a Python string per row."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

SIZE = 0x110000


def to_codepoints(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all rows one after another, row offsets, null mask) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    nulls = np.asarray(column.is_null(), dtype=bool)
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    starts = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    before = np.concatenate([[0], np.cumsum(starts)])
    return points.astype(np.int64), before[offsets - offsets[0]], nulls


def from_codepoints(points: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The string column of code points and row offsets."""
    raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace"), dtype=np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    where = np.append(starts, len(raw))[offsets].astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(where.tobytes()), pa.py_buffer(raw.tobytes()))
    if nulls is not None and nulls.any():
        out = pa.compute.if_else(pa.array(~nulls), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def keep(points: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points under the mask, with the rows' new offsets."""
    before = np.concatenate([[0], np.cumsum(mask)])
    return points[mask], before[offsets]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


@lru_cache(1)
def letters_and_digits() -> np.ndarray:
    """True for the code points of the Unicode categories L and N."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(SIZE)), bool, SIZE)


@lru_cache(1)
def lower_case() -> np.ndarray:
    """The lower-case form of each code point; of a form of several points, the first."""
    table = np.arange(SIZE, dtype=np.int64)
    for c in range(SIZE):
        if (low := chr(c).lower()) != chr(c):
            table[c] = ord(low[0])
    return table
