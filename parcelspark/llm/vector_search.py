"""Exact top-k by inner product: every query against every vector, block against block, one component (term) at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 64
CANDIDATES = 2048  # vectors in a candidate block
QUERIES = 4096  # vectors in a query block
TILE = 64  # queries whose dense score rows are filled together
BLOCK_VALUES = 1 << 20  # components in a block, if vectors are long
HELD = 16  # query blocks that a task holds
COLUMNS = ("ids", "rows", "asks", "sizes", "values")
BLOCK = "block long, n int, asked int, ids binary, rows binary, asks binary, sizes binary, values binary"
HITS = "query long, query_id long, vec_ids array<long>, rows array<long>, scores array<long>"


class Block:
    """Vectors with their ids, row numbers and integer components (as doubles, all components one after the other)."""

    def __init__(self, ids, rows, asks, sizes, values):
        self.ids, self.rows, self.asks, self.sizes, self.values = ids, rows, asks, sizes, values
        self.ends = np.cumsum(sizes)

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, chosen: np.ndarray) -> Block:
        keep = np.zeros(len(self), bool)
        keep[chosen] = True
        return Block(self.ids[keep], self.rows[keep], self.asks[keep], self.sizes[keep], self.values[np.repeat(keep, self.sizes)])

    def postings(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """term -> (vectors that hold it, their weights); zero components are not stored."""
        used = np.flatnonzero(self.values)
        vector = np.repeat(np.arange(len(self)), self.sizes)[used]
        term = used - (self.ends - self.sizes)[vector]
        order = np.argsort(term, kind="stable")
        term, vector, weight = term[order], vector[order], self.values[used][order]
        cut = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(cut, len(term))[1:]
        return {int(term[a]): (vector[a:b], weight[a:b]) for a, b in zip(cut, ends, strict=True)}

    def packed(self, number: int) -> pa.RecordBatch:
        small = np.abs(self.values).max(initial=0) < 1 << 15
        columns = {c: getattr(self, c) for c in COLUMNS} | {"values": self.values.astype(np.int16 if small else np.float64)}
        return pa.RecordBatch.from_pydict({
            "block": pa.array([number], pa.int64()), "n": pa.array([len(self)], pa.int32()), "asked": pa.array([self.asks.sum()], pa.int32()),
            **{c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()}})

    @classmethod
    def read(cls, ids: bytes, rows: bytes, asks: bytes, sizes: bytes, values: bytes) -> Block:
        sizes = np.frombuffer(sizes, np.int64)
        kind = np.float64 if len(values) == 8 * sizes.sum() else np.int16
        return cls(
            np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(asks, np.bool_), sizes,
            np.frombuffer(values, kind).astype(np.float64))

    @classmethod
    def joined(cls, parts: list[Block]) -> Block:
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "rows", "asks", "sizes", "values")))


def usable(batch: pa.RecordBatch, first_row: int, scale: float) -> Block:
    """The vectors of a batch (id, vector, asks) that take part, scaled and floored."""
    vectors = batch.column(1)
    lists = vectors.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    sizes[~vectors.is_valid().to_numpy(zero_copy_only=False)] = 0
    values = np.floor(scale * flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    good = lists & (bad[ends] == bad[ends - sizes])
    whole = Block(
        batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), first_row + np.arange(len(sizes)),
        batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool), sizes, values)
    return whole.part(np.flatnonzero(good))


def in_blocks(parts, most: int):
    """Gather blocks into blocks of at most ``most`` vectors and about BLOCK_VALUES components."""
    waiting: list[Block] = []
    for part in parts:
        at = 0
        while at < len(part):
            n = sum(map(len, waiting))
            filled = sum(len(w.values) for w in waiting)
            room = int(np.searchsorted(part.ends - (part.ends[at] - part.sizes[at]), BLOCK_VALUES - filled, "right")) - at
            take = min(most - n, len(part) - at, max(room, 0 if waiting else 1))
            if take > 0:
                waiting.append(part.part(np.arange(at, at + take)))
                at += take
            if at < len(part):
                yield Block.joined(waiting)
                waiting = []
    if waiting:
        yield Block.joined(waiting)


def packed_blocks(vectors: DataFrame, scale: float, most: int) -> DataFrame:
    """All vectors that take part, in blocks; rows are numbered across tasks."""

    def kernel(batches):
        from pyspark import TaskContext

        number = row = TaskContext.get().partitionId() << 40

        def parts():
            nonlocal row
            for batch in batches:
                yield usable(batch, row, scale)
                row += batch.num_rows

        for block in in_blocks(parts(), most):
            yield block.packed(number)
            number += 1

    return vectors.mapInArrow(kernel, BLOCK)


def repacked_queries(blocks: DataFrame, most: int, parts: int) -> DataFrame:
    """The vectors that ask, dealt evenly over ``parts`` and packed into blocks of their own."""

    def blocks_of(batch):
        columns = [batch.column(batch.schema.get_field_index(c)) for c in COLUMNS]
        return (Block.read(*[c[i].as_py() for c in columns]) for i in range(batch.num_rows))

    def asking(batches):
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), blocks_of(batch), strict=True):
                yield block.part(np.flatnonzero(block.asks)).packed(number)

    def gather(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for block in in_blocks((b for batch in batches for b in blocks_of(batch)), most):
            yield block.packed(number)
            number += 1

    return blocks.where("asked > 0").mapInArrow(asking, BLOCK).repartition(parts, "block").mapInArrow(gather, BLOCK)


def best_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The k highest of each row of scores, ties to the smaller id and then row; all three are 2-D."""
    order = np.lexsort((rows, ids, -scores), axis=-1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, ids, rows))


NONE = np.iinfo(np.int64).min + 1  # score of a place that holds no candidate


class TopK:
    """Running top-k of a query block over candidate blocks."""

    def __init__(self, queries: Block, k: int):
        self.k, self.ids_asked, self.rows_asked = k, queries.ids, queries.rows
        self.terms = queries.postings()
        self.highest = float(np.abs(queries.values).max(initial=0))
        self.longest = int(queries.sizes.max(initial=0))
        self.scores = np.full((len(queries), k), NONE, np.int64)
        self.ids, self.rows = np.zeros((2, len(queries), k), np.int64)

    def meet(self, block: Block) -> None:
        """Score all vectors of a block: each query term scatters its weighted postings into the dense scores.

        Terms that nearly all queries and vectors hold are scattered together, as one product of matrices. Sums stay
        below the integers that their kind of number holds, so their order does not matter.
        """
        order = np.lexsort((block.rows, block.ids))
        place = np.empty(len(block), np.int64)
        place[order] = np.arange(len(block))
        ids, rows = block.ids[order], block.rows[order]
        bound = self.highest * float(np.abs(block.values).max(initial=0)) * max(1, min(self.longest, int(block.sizes.max(initial=0))))
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        as_kind = (lambda w: np.array([int(x) for x in w], object)) if kind is object else (lambda w: w.astype(kind))
        terms = {t: (place[v], as_kind(w)) for t, (v, w) in block.postings().items() if t in self.terms}
        n, asking = len(block), len(self.rows_asked)
        full = [t for t, (to, _) in terms.items() if kind is not object and 2 * len(self.terms[t][0]) * len(to) > asking * n]
        ask, post = np.zeros((asking, len(full)), kind), np.zeros((len(full), n), kind)
        for at, t in enumerate(full):
            (q, w), (to, weights) = self.terms[t], terms.pop(t)
            ask[q, at], post[at, to] = w, weights
        asked = {t: (self.terms[t][0], as_kind(self.terms[t][1])) for t in terms}
        own_row = np.argsort(rows)
        at = np.minimum(np.searchsorted(rows, self.rows_asked, sorter=own_row), len(rows) - 1)
        own = own_row[at]
        is_own = rows[own] == self.rows_asked
        made = []
        for start in range(0, asking, TILE):
            until = min(asking, start + TILE)
            scores = ask[start:until] @ post if full else np.zeros((until - start, n), kind)
            for t, (to, weights) in terms.items():
                q, w = asked[t]
                a, b = np.searchsorted(q, [start, until])
                if a < b:
                    scores[np.ix_(q[a:b] - start, to)] += w[a:b, None] * weights
            if kind is object:  # a score beyond a long is held at its end
                scores = np.array([[max(min(x, -NONE), NONE + 1) for x in r] for r in scores], np.int64).reshape(scores.shape)
            hit = np.flatnonzero(is_own[start:until])
            made.append(self.entering(scores, bound, start, hit, own[start:until][hit], ids, rows))
        self.take(*(np.concatenate(x) for x in zip(*made, strict=True)))

    def entering(self, scores, bound, start, hit, own, ids, rows):
        """(query, score, id, row) of the places of a tile that may be among the k best so far; a query's own place counts as no candidate."""
        until = start + len(scores)
        least = self.scores[start:until, -1]
        there = scores >= (least if scores.dtype == np.int64 else least.astype(scores.dtype))[:, None]
        there[hit, own] = False
        if 4 * self.k * len(scores) < np.count_nonzero(there):
            q = np.repeat(np.arange(start, until), min(self.k, scores.shape[1]))
            score, i, r = (x.reshape(-1) for x in self.highest_of(scores, bound, hit, own, ids, rows))
            some = score != NONE
            return q[some], score[some], i[some], r[some]
        q, at = np.nonzero(there)
        score, last = scores[q, at].astype(np.int64), least[q]
        some = (score > last) | (ids[at] <= self.ids[start:until, -1][q])
        return q[some] + start, score[some], ids[at[some]], rows[at[some]]

    def take(self, q, score, ids, rows) -> None:
        """Merge new candidates with the k best so far, ties to the smaller id and then row."""
        if not len(q):
            return
        changed = np.unique(q)
        q = np.r_[np.repeat(np.arange(len(changed)), self.k), np.searchsorted(changed, q)]
        score, ids, rows = (
            np.r_[kept[changed].reshape(-1), new] for kept, new in ((self.scores, score), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -score, q))
        counts = np.bincount(q)
        best = order[((np.cumsum(counts) - counts)[:, None] + np.arange(self.k)).reshape(-1)]
        for kept, new in ((self.scores, score), (self.ids, ids), (self.rows, rows)):
            kept[changed] = new[best].reshape(-1, self.k)

    def highest_of(self, scores, bound, hit, own, ids, rows):
        """(scores, ids, rows) of the k best of each row; a query's own place counts as no candidate."""
        n = scores.shape[1]
        k = min(self.k, n)
        if bound * (n + 1) < 1 << 61:
            # candidates stand in order of their ids, so score and place together have no ties
            key = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
            key[hit, own] = NONE
            found = np.argpartition(key, n - k, axis=1)[:, n - k:]
            key = np.take_along_axis(key, found, 1)
            return np.where(key == NONE, NONE, (key - (n - 1 - found)) // n), ids[found], rows[found]
        whole = scores.astype(np.int64)
        whole[hit, own] = NONE
        return best_of(whole, np.broadcast_to(ids, whole.shape), np.broadcast_to(rows, whole.shape), k)

    def hits(self) -> pa.RecordBatch:
        there = [np.flatnonzero(s != NONE) for s in self.scores]

        def lists(of: np.ndarray) -> pa.Array:
            return pa.array([r[t] for r, t in zip(of, there, strict=True)], pa.list_(pa.int64()))

        return pa.RecordBatch.from_pydict({
            "query": pa.array(self.rows_asked), "query_id": pa.array(self.ids_asked),
            "vec_ids": lists(self.ids), "rows": lists(self.rows), "scores": lists(self.scores)})


def searched(k: int):
    """Stream over the rows of cells, in each the query blocks before the vector blocks: the k best of each query in its cell."""

    def kernel(batches):
        cell, asking = None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("cell", "asking", *COLUMNS)]
            for i in range(batch.num_rows):
                at, is_asking, *values = (c[i].as_py() for c in columns)
                if at != cell:
                    for running in asking:
                        yield running.hits()
                    cell, asking = at, []
                block = Block.read(*values)
                if is_asking:
                    asking.append(TopK(block, k))
                    continue
                for running in asking:
                    running.meet(block)
        for running in asking:
            yield running.hits()

    return kernel


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` highest inner products of every row that ``is_query`` holds for, with all other rows.

    Components are floor(scale * x). Vectors are packed into blocks of a bounded size; each query block meets every
    candidate block once, in a task that holds a bounded number of query blocks while the candidate blocks come by. A query's
    non-zero components walk the posting lists of a block and add the weighted postings to dense score rows; what reaches
    the k best so far is merged over blocks, then over tasks. Nothing grows in a task but k rows per query it holds.

    Rows: query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    Rows with a null id, a null vector or a null or non-finite component take no part. A vector shorter than another
    counts as continued by zeros, an empty one scores 0. Rows that repeat an id are rows of their own, as queries and as
    candidates (only the query's own row is left out). An empty table gives an empty result; other columns, whatever
    their names, are ignored. A score beyond a long is held at its end.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    blocks = stored(packed_blocks(chosen, scale, CANDIDATES), "search-blocks")
    asked, there, n_blocks = blocks.select(F.sum("asked"), F.sum("n"), F.count(F.lit(1))).first()
    asked, there = asked or 0, there or 0
    queries = stored(repacked_queries(blocks, QUERIES, max(1, -(-asked // (8 * QUERIES)))), "search-queries")

    # A grid of cells: each has one of ``down`` parts of the queries and one of ``across`` parts of the vectors.
    # Queries are sent ``across`` times and vectors ``down`` times, so the grid follows their sizes; a cell holds its
    # query blocks (so there is a bound on them) and its vector blocks come by one at a time.
    tasks = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    down = max(1, round((tasks * asked / max(there, 1)) ** 0.5), -(-queries.count() // HELD))
    across = max(1, min(n_blocks, -(-tasks // down)))

    def dealt(parts: int) -> Column:  # blocks of one writer are numbered one by one
        return F.pmod(F.shiftright("block", 40) + F.col("block").bitwiseAND((1 << 40) - 1), F.lit(parts)).cast("int")

    def others(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def cells(of: DataFrame, is_asking: bool, x: Column, y: Column) -> DataFrame:
        return of.select(x.alias("x"), y.alias("y"), "block", *COLUMNS).select(
            (F.col("y") * across + F.col("x")).alias("cell"), F.lit(is_asking).alias("asking"), "block", *COLUMNS)

    met = cells(queries, True, others(across), dealt(down)).unionByName(cells(blocks, False, dealt(across), others(down)))
    hits = met.repartition(down * across, "cell").sortWithinPartitions("cell", F.desc("asking"), "block").mapInArrow(searched(k), HITS)
    each = hits.select("query", "query_id", F.explode(F.arrays_zip("vec_ids", "rows", "scores")).alias("hit")).select(
        "query", "query_id", F.col("hit.vec_ids").alias("vec_id"), F.col("hit.rows").alias("row"), F.col("hit.scores").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
