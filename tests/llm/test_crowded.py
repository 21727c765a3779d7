"""Windows around a crowded anchor: the middle of a block rules rows out, and nothing that brute force covers is lost."""

import random
from collections import Counter

from parcelspark.llm import crowded

SIZE = 40
ROWS = "key long, doc_id long, text_key long, at int, left binary, right binary"


def near_copies(n):
    """Contexts of one anchor: a template with a few changed bytes each, the last rows twice with different borders."""
    rng, rows = random.Random(5), []
    template = bytes(rng.choices(range(97, 123), k=2 * SIZE))
    for i in range(n):
        own = bytearray(template)
        for _ in range(rng.choice((1, 2, 3))):
            own[rng.randrange(2 * SIZE)] = rng.randrange(65, 91)
        cut = rng.randrange(0, 6)
        rows.append((7, i, i, 100, bytes(own[cut:SIZE])[::-1], bytes(own[SIZE:2 * SIZE - rng.randrange(0, 6)])))
    return rows


def brute(rows):
    windows = []
    for key, doc, _, at, left, right in rows:
        text = left[::-1] + right
        for w in range(SIZE + 1):
            begin = len(left) - w
            if begin >= 0 and begin + SIZE <= len(text):
                windows.append((doc, at - w, (key, w, text[begin:begin + SIZE])))
    often = Counter(x for *_, x in windows)
    covered = {}
    for doc, start, x in windows:
        if often[x] > 1:
            covered.setdefault(doc, set()).update(range(start, start + SIZE))
    return covered


def covered(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return found


def test_middles_rule_rows_out_and_lose_nothing(spark, monkeypatch):
    rows = near_copies(150)
    frames, store = {}, crowded.stored
    monkeypatch.setattr(crowded, "stored", lambda df, name: frames.setdefault(name, store(df, name)))
    got = covered(crowded.crowded_intervals(spark.createDataFrame(rows, ROWS), SIZE))
    assert got == brute(rows)
    asked = frames["asked-windows"].count()
    frames.clear()
    monkeypatch.setattr(crowded, "_possible", lambda fitting, size, unit: fitting)
    assert covered(crowded.crowded_intervals(spark.createDataFrame(rows, ROWS), SIZE)) == got
    assert asked < frames["asked-windows"].count()


def test_blocks_between_shared_windows_are_not_asked(spark, monkeypatch):
    rows = near_copies(150)
    frames, store = {}, crowded.stored
    monkeypatch.setattr(crowded, "stored", lambda df, name: frames.setdefault(name, store(df, name)))
    monkeypatch.setattr(crowded, "BLOCK", 4)
    got = covered(crowded.crowded_intervals(spark.createDataFrame(rows, ROWS), SIZE))
    assert got == brute(rows)
    asked = sum(f.count() for name, f in frames.items() if name.startswith("asked-windows"))
    possible = frames["possible-contexts"].selectExpr("sum(size(asked))").first()[0]
    assert 0 < asked < possible
