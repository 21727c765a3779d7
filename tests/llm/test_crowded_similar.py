"""Similar windows of groups over the limit, against all pairs and against groups that are compared in memory."""

import numpy as np
import pytest

from parcelspark.llm import crowded_similar, near_passages
from parcelspark.llm import near_passages as N

SIZE = 46


def _contexts(rng, n):
    """Shingle rows around one anchor (at place 45): a common half, copies of other rows with a few others, and rows of their own."""
    common = rng.integers(1, 1 << 62, 91)
    made = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and made:
            row = made[rng.integers(len(made))].copy()
            at = rng.integers(0, 87)
            row[at:at + rng.integers(1, 9)] = rng.integers(1, 1 << 62)
        elif kind < 0.7:
            row = common.copy()
            row[:rng.integers(0, 40)] = rng.integers(1, 1 << 62, 91)[:1]
            row[91 - rng.integers(1, 40):] = rng.integers(1, 1 << 62)
        else:
            row = rng.integers(1, 1 << 62, 91)
        row[45] = 7
        made.append(row)
    return made


@pytest.mark.parametrize("small", [16, 1])
def test_crowded_contexts_find_the_windows_and_classes_of_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(crowded_similar, "SMALL", small)
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for key, n in ((5, 90), (-6, 40), (9, 3)):
        for row in _contexts(rng, n):
            left, right = rng.integers(20, 46), rng.integers(26, 47)
            rows.append((key, int(rng.integers(0, n)) * 10 + key % 10, at % 7, at, row[45 - left:45][::-1].tobytes(), row[45:45 + right].tobytes()))
            at += 1000
    contexts = spark.createDataFrame(rows, "key long, doc_id long, text_key long, at int, left binary, right binary").repartition(3)
    none = spark.createDataFrame([], "key long, doc_id long, text_key long, at int, start int, end int, partner long")
    # a part of what is to be found is known already
    similar = crowded_similar._similar([r[4] for r in rows], [r[5] for r in rows], SIZE, 0.8)
    want, pairs = {}, set()
    for i in range(len(rows)):
        others = np.array([j for j in range(len(rows)) if rows[j][0] == rows[i][0] and rows[j][1] != rows[i][1]])
        a, b, low, high = similar.hits(np.full(len(others), i), others)
        if len(a):
            want[rows[i][1:4]] = (rows[i][3] - high.max(), rows[i][3] + SIZE - low.min())
            pairs |= {(rows[i][1], rows[j][1]) for j in b}
    assert len(want) > 40
    (place, (start, end)), = list(want.items())[:1]
    partner = next(b for a, b in sorted(pairs) if a == place[0])
    key = next(r[0] for r in rows if r[1:4] == place)
    known = spark.createDataFrame([(key, *place, int(start), int(end), partner)], none.schema)
    for parts, links in ((none, none), (known, known.select("doc_id", "partner"))):
        got, mine = {}, set()
        made = crowded_similar.crowded_similar(contexts, parts, links.select("doc_id", "partner"), SIZE, 0.8).collect()
        where = {r[1:3] + (r[3],): r for r in rows}
        for r in [*made, *([(place[0], place[1], int(start), int(end), partner)] if parts is known else [])]:
            own = next(p for p in where if p[:2] == (r[0], r[1]) and r[2] <= p[2] < r[3] and p in want)
            old = got.get(own, (1 << 30, -1))
            got[own] = (min(old[0], r[2]), max(old[1], r[3]))
            mine.add((r[0], r[4]))
        assert mine <= pairs | {(b, a) for a, b in pairs}
        ids = sorted({x for p in pairs for x in p})
        label = lambda some: N._joined(
            np.arange(len(ids)), *(np.array([ids.index(p[k]) for p in sorted(some)]) for k in (0, 1))).tolist()
        assert label(mine) == label(pairs)
        assert got == {p: (int(a), int(b)) for p, (a, b) in want.items()}


def test_similar_passages_of_a_crowded_group_are_found_across_its_parts(spark):
    rng = np.random.default_rng(8)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]

    template, rows = words(30), []
    for i in range(60):  # pairs that share the template and 28 words of which one differs; contexts are sorted by other words on the left
        tail = words(28)
        for changed in (False, True):
            own = tail.copy()
            if changed:
                own[int(rng.integers(8, 20))] = f"x{len(rows)}"
            rows.append(words(20) + template + own + words(20))
    rows += [words(25) + template + words(50) for _ in range(80)]
    order = rng.permutation(len(rows))
    docs = spark.createDataFrame([(int(i), " ".join(rows[i])) for i in order], "doc_id long, text string").repartition(4)
    whole, parts = (
        {r.doc_id: (r.class_id, r.passages) for r in near_passages.near_duplicate_passages(docs, group_limit=limit).collect()} for limit in (4096, 12))
    assert sum(c != i for i, (c, _) in whole.items()) > 40
    assert parts == whole
