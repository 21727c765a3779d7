"""Exact top-k search against brute force."""

import math
import random

import numpy as np
from parcelspark.llm import vector_search
from parcelspark.llm.vector_search import Block, TopK, exact_top_k
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, rank string, q_block int, asks string"


def brute(rows, every, k):
    usable = [
        (n, r[0], [math.floor(64 * x) for x in r[1]]) for n, r in enumerate(rows)
        if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for n, i, v in usable:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for m, j, w in usable if m != n)[:k]
            out += [(i, rank, j, -s) for rank, (s, j, _) in enumerate(scored, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def make(seed, n, dim):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) if rng.random() < 0.7 else 0.0 for _ in range(dim)], "x", 1, "y") for i in range(n)]
    for i in rng.sample(range(n), n // 3):  # one common vector: many ties
        rows[i] = (i, rows[0][1], "x", 1, "y")
    rows += [
        (20, rows[3][1], "x", 1, "y"), (20, rows[3][1], "x", 1, "y"), (7, None, "x", 1, "y"), (None, rows[1][1], None, None, None),
        (40, [None] + rows[2][1][1:], "x", 1, "y"), (60, [float("nan")] * dim, "x", 1, "y"), (80, [float("inf")] * dim, "x", 1, "y"),
        (9001, [0.5] * (dim + 3), "x", 1, "y"), (9020, [0.25], "x", 1, "y"), (9040, [], "x", 1, "y")]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force_with_ties_repeats_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 32)
    monkeypatch.setattr(vector_search, "QUERIES", 8)
    rows = make(5, 300, 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(exact_top_k(df, F.col("vec_id") % 20 == 0, k=7)) == brute(rows, 20, 7)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    rows = make(6, 12, 3)[:9]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(exact_top_k(df, F.col("vec_id") % 2 == 0, k=20)) == brute(rows, 2, 20)
    assert exact_top_k(df.where("false"), F.col("vec_id") % 2 == 0).count() == 0
    assert exact_top_k(df, F.lit(False)).count() == 0


def test_large_components_stay_exact():
    rng = np.random.default_rng(3)
    for top in (3.0, 1e4, 1e9, 1e13, 1e30):
        values = np.floor(rng.uniform(-top, top, (40, 6)))
        values[:, 4] = 0
        block = Block(np.arange(40), np.arange(40), np.ones(40, bool), np.full(40, 6), values.reshape(-1))
        running = TopK(block.part(np.arange(5)), 4)
        for part in (np.arange(20), np.arange(20, 40)):
            running.meet(block.part(part))
        for q in range(5):
            exact = [(-max(-2**63 + 2, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(values[q], values[c])))), c) for c in range(40) if c != q]
            assert list(zip((-running.scores[q]).tolist(), running.ids[q].tolist())) == sorted(exact)[:4]


def test_blocks_hold_every_vector_once():
    sizes = np.array([3, 0, 5, 1, 1, 7] * 20)
    block = Block(np.arange(120), np.arange(120), np.zeros(120, bool), sizes, np.arange(sizes.sum(), dtype=float))
    for most in (1, 7, 120):
        made = list(vector_search.in_blocks([block.part(np.arange(50)), block.part(np.arange(50, 120))], most))
        assert max(map(len, made)) <= most
        assert np.concatenate([b.ids for b in made]).tolist() == list(range(120))
        assert np.concatenate([b.values for b in made]).tolist() == block.values.tolist()
        assert [Block.read(*[b.packed(1).column(i)[0].as_py() for i in range(3, 8)]).values.tolist() for b in made] == [b.values.tolist() for b in made]


def test_blocks_go_to_the_task_of_their_cell_and_are_not_joined_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 16)
    monkeypatch.setattr(vector_search, "QUERIES", 8)
    rows = [(i, r[1], "x", 1, "y") for i, r in enumerate(make(7, 400, 6)) if r[1]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = exact_top_k(df, F.col("vec_id") % 2 == 0, k=5)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()  # a joined row would hold two blocks
    assert found(made) == brute(rows, 2, 5)


def test_a_task_holds_a_bounded_number_of_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 32)
    monkeypatch.setattr(vector_search, "QUERIES", 4)
    monkeypatch.setattr(vector_search, "HELD", 2)
    rows = make(8, 200, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(exact_top_k(df, F.col("vec_id") % 2 == 0, k=6)) == brute(rows, 2, 6)


def test_running_best_with_ties_over_many_blocks_equals_sorting_all():
    rng = np.random.default_rng(4)
    for top, k in ((2, 3), (40, 9), (1e6, 4), (1e17, 2)):
        values = np.floor(rng.uniform(-top, top, (300, 4)))
        values[rng.integers(0, 300, 120)] = values[0]
        block = Block(rng.integers(0, 150, 300), np.arange(300), np.ones(300, bool), np.full(300, 4), values.reshape(-1))
        running = TopK(block.part(np.arange(70)), k)
        for part in np.array_split(rng.permutation(300), 7):
            running.meet(block.part(part))
        for q in range(70):
            exact = sorted((-max(-2**63 + 2, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(values[q], values[c])))), block.ids[c], c) for c in range(300) if c != q)
            assert list(zip((-running.scores[q]).tolist(), running.ids[q].tolist(), running.rows[q].tolist())) == exact[:k]
