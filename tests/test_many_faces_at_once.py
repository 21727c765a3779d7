"""Faces of a large Arrow batch are simplified as flat arrays."""

import tracemalloc

import numpy as np
import pyarrow as pa

from parcelspark.operators import shapes as S


def test_simplified_batch_makes_no_object_per_position():
    n, points = 1500, 401
    turns = np.linspace(0, 2 * np.pi, points)
    x, y = (np.tile(f(turns), n) for f in (np.cos, np.sin))
    ring = pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1) * points, pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), ring)
    simplify = S.simplify_rings(1e-3).func
    tracemalloc.start()
    got = simplify(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak
    first = got[0].as_py()[0]
    assert 4 <= len(first) < points and first[0] == {"x": 1.0, "y": 0.0}
    assert got.value_lengths().to_pylist() == [1] * n and len(set(got.flatten().value_lengths().to_pylist())) == 1


def test_simplified_rings_of_mixed_rows():
    square = [(0, 0), (2, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    tiny = [(0, 0), (1, 0), (0, 0)]
    ring = lambda g: [{"x": float(x), "y": float(y)} for x, y in g]
    rows = pa.array([[ring(square), ring(tiny)], None, [], [ring(square[::-1])]], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    got = S.simplify_rings(0.25).func(rows).to_pylist()
    corners = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert got == [[ring(corners), ring(tiny)], None, [], [ring(corners[::-1])]]
