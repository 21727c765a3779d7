"""Passages that a document holds more than once."""

import random

import pytest

from parcelspark.llm import near_passages


def covered(row, start, end):
    return any(p.start <= start and end <= p.end for p in row.passages)


@pytest.mark.parametrize("limit", [1024, 2])
def test_a_passage_twice_in_one_document_keeps_its_partner(spark, limit):
    rng = random.Random(3)
    words = lambda n: ["w%d" % rng.randrange(100_000) for _ in range(n)]
    rows, want = [], []
    for d in range(0, 60, 2):  # twice in a document, once in another
        p = words(55)
        a, b, c = words(70), words(60), words(80)
        rows += [(d, a + p + b + p + c), (d + 1, words(66) + p + words(70))]
        want += [(d, 70, 125), (d, 185, 240), (d + 1, 66, 121)]
    for d in range(100, 120, 2):  # in two rows of a document
        p = words(55)
        rows += [(d, words(70) + p + words(60)), (d, words(70) + p + words(30)), (d + 1, words(66) + p + words(70))]
        want += [(d, 70, 125), (d + 1, 66, 121)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    made = near_passages.near_duplicate_passages(docs, group_limit=limit).collect()
    for d, start, end in want:
        own = [r for r in made if r.doc_id == d]
        assert own and all(covered(r, start, end) for r in own), (d, [r.passages for r in own])
        assert {r.class_id for r in own} == {d - d % 2}


def test_similar_windows_are_found_at_every_place_of_a_segment(spark):
    rng = random.Random(4)
    words = lambda n: ["w%d" % rng.randrange(100_000) for _ in range(n)]
    rows = []
    for d in range(0, 20, 2):
        p = words(300)
        changed = ["x%d" % k if k % 50 == 25 else w for k, w in enumerate(p)]
        rows += [(d, words(20) + p + words(60) + p + words(30)), (d + 1, words(40) + changed + words(10))]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    for r in near_passages.near_duplicate_passages(docs).collect():
        if r.doc_id % 2 == 0:
            inside = lambda at: sum(max(0, min(p.end, at + 300) - max(p.start, at)) for p in r.passages)  # noqa: B023, E731
            assert inside(20) >= 200 and inside(380) >= inside(20) - 20, r
