"""Tiles are labelled and rings put in order many at a time."""

import numpy as np
import pyarrow as pa

from parcelspark.operators import raster as R


def _flood(pixels):
    todo, label = set(pixels), {}
    for start in sorted(pixels):
        if start not in todo:
            continue
        stack = [start]
        todo.discard(start)
        while stack:
            r, c = stack.pop()
            label[r, c] = start
            for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if near in todo:
                    todo.discard(near)
                    stack.append(near)
    return label


def test_tiles_of_one_stream_are_labelled_apart(monkeypatch):
    monkeypatch.setattr(R, "LABELLED_ROWS", 200)
    rng = np.random.default_rng(3)
    rows, want = [], []
    for raster in (None, 0, 1):
        for tile in range(6):
            pixels = sorted({(int(r), int(c)) for r, c in rng.integers(0, 12, (90, 2))})
            label = _flood(pixels)
            rows += [(raster, tile, r, c) for r, c in pixels]
            want += [label[p][0] * R._SHIFT + label[p][1] for p in pixels]
    names = ["raster_id", "tile", "row", "col"]
    table = pa.table({n: pa.array([v[i] for v in rows], pa.int64()) for i, n in enumerate(names)})
    got = pa.Table.from_batches(list(R._label_tiles(2)(iter(table.to_batches(max_chunksize=37)))))
    assert got.select(names).to_pydict() == table.to_pydict()
    assert got.column("local").to_pylist() == want


def test_rings_of_many_components_equal_rings_of_each():
    rng = np.random.default_rng(8)
    groups = []
    for _ in range(40):
        label = _flood(sorted({(int(r), int(c)) for r, c in rng.integers(0, 14, (110, 2))}))
        for start in set(label.values()):
            groups.append([r * R._SHIFT + c for (r, c), s in label.items() if s == start])
    together = R._corners.func(pa.array(groups, pa.list_(pa.int64()))).to_pylist()
    for codes, ring in zip(groups, together, strict=True):
        rows, cols = R._trace(np.array(codes))
        assert [(p["row"], p["col"]) for p in ring] == list(zip(rows.tolist(), cols.tolist(), strict=True))
        assert ring[0] == ring[-1]
