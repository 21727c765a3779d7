"""Ring columns of Arrow batches as flat coordinate arrays, and back."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


class RingRows:
    """Positions of all rings of a batch; ``polygon(i)`` gives the rings of a row as (n, 2) arrays."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        rings = column.flatten()
        points = rings.flatten()
        self.xy = np.stack([points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)], axis=1)
        self.ring_at = np.concatenate([[0], np.cumsum(_lengths(rings))])
        self.row_at = np.concatenate([[0], np.cumsum(_lengths(column))])
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.valid)

    def polygon(self, i: int) -> list[np.ndarray] | None:
        """None for a null row."""
        if not self.valid[i]:
            return None
        return [self.xy[self.ring_at[r]:self.ring_at[r + 1]] for r in range(self.row_at[i], self.row_at[i + 1])]

    def with_points(self, xy: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The same rows and rings with other points, ``sizes`` of them per ring."""
        points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT))
        rows = pa.array(self.row_at.astype(np.int32), mask=np.append(~self.valid, False))
        return pa.ListArray.from_arrays(rows, pa.ListArray.from_arrays(_offsets(sizes), points))


def _lengths(column: pa.Array) -> np.ndarray:
    n = np.diff(column.offsets.to_numpy())
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), n, 0)


def _offsets(sizes: list[int], missing: list[bool] | None = None) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.array(at, mask=None if missing is None else np.append(missing, False).astype(bool))


def rings_array(polygons: list[list[np.ndarray] | None]) -> pa.Array:
    """Rings per row; None becomes null."""
    rings = list(chain.from_iterable(p or [] for p in polygons))
    xy = np.concatenate(rings) if rings else np.empty((0, 2))
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT))
    return pa.ListArray.from_arrays(
        _offsets([len(p or []) for p in polygons], [p is None for p in polygons]),
        pa.ListArray.from_arrays(_offsets([len(r) for r in rings]), points))


def parts_array(rows: list[list[list[np.ndarray]] | None]) -> pa.Array:
    """Parts (each with its rings) per row; None becomes null."""
    return pa.ListArray.from_arrays(
        _offsets([len(r or []) for r in rows], [r is None for r in rows]),
        rings_array(list(chain.from_iterable(r or [] for r in rows))))
