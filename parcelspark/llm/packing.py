"""Pack tokenised documents into fixed-length sequences by column generation over the histogram of piece lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, runs_by_bytes, stored, texts

SIZE = 1024
END_ID = 0  # fixed: closes every document
CHUNK_ROWS = 50_000  # rows of one length ranked together
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk long"


class Encoder:
    """Token ids of a text as a numpy array.

    The rank file holds the same vocabulary and gives the same ids faster. It is used
    where both libraries are known to split alike, Latin-1 text; the rest goes to the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SIZE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each document's ids with the closing id, cut into full sequences and one rest; ids stay in the task, their checksum goes on."""

    def kernel(batches):
        from zlib import crc32

        from pyspark import TaskContext

        encode = Encoder(tokenizer_path, ranks_path, pattern)
        task = TaskContext.get().partitionId() << 32
        seen = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = byte_rows(batch.column(1))
            for a, b in runs_by_bytes(rows):
                out: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(ids[a:b], rows[a:b], strict=True):
                    tokens = np.append(encode(text.decode("utf-8", "replace")), np.uint32(END_ID)).astype("<u4")
                    n = len(tokens)
                    for start in range(0, n, size):
                        part = tokens[start:start + size]
                        for column, value in zip(out, (doc_id, start, len(part), crc32(part.tobytes()), n, task + seen // CHUNK_ROWS), strict=True):
                            column.append(value)
                        seen += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk"])

    return texts(docs, id_col, text_col).mapInArrow(kernel, PIECES)


def _cost(fill: np.ndarray, size: int) -> np.ndarray:
    """Length of a sequence once padded: a power of two stays, anything else fills up."""
    return np.where((fill & (fill - 1)) == 0, fill, size)


def _best_patterns(lengths: np.ndarray, prices: np.ndarray, size: int, wanted: int) -> list[np.ndarray]:
    """Knapsack by dynamic programming over exact fills: the patterns whose priced value most exceeds their cost."""
    value = np.full(size + 1, -np.inf)
    value[0] = 0.0
    last = np.zeros(size + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for fill in range(1, size + 1):
        k = upto[fill]
        if k:
            options = value[fill - lengths[:k]] + prices[:k]
            last[fill] = options.argmax()
            value[fill] = options[last[fill]]
    fills = np.arange(size + 1)
    gain = value - _cost(fills, size)
    patterns = []
    for fill in np.argsort(-gain[1:])[:wanted] + 1:
        if gain[fill] <= 1e-7 * size:
            break
        pattern = np.zeros(len(lengths))
        while fill:
            pattern[last[fill]] += 1
            fill -= lengths[last[fill]]
        patterns.append(pattern)
    return patterns


def filled_patterns(demand: dict[int, float], size: int, whole: bool) -> list[tuple[dict[int, int], float, list[int]]]:
    """Patterns built longest piece first: one or two more pieces that fill the room exactly if there are any, else the longest that fits.

    Each pattern is used until one of its lengths is used up, so there are at most as many
    patterns as lengths (``whole``: times are whole numbers and the last rest of a length gets a pattern of its own).
    Returns each pattern, how often it is used and the lengths it used up.
    """
    left = {k: v for k, v in demand.items() if v > 0}
    order = sorted(left, reverse=True)
    patterns = []
    while order:
        pattern: dict[int, int] = {order[0]: 1}
        room = size - order[0]

        def free(length: int, taken: int = 0) -> bool:
            need = pattern.get(length, 0) + taken + 1  # noqa: B023
            return left.get(length, 0) >= (need if whole else 1e-9)

        while room > 0:
            if free(room):
                chosen = [room]
            else:
                chosen = next(([a, room - a] for a in order if room // 2 <= a < room and free(a) and free(room - a, int(2 * a == room))), None)
                chosen = chosen or next(([a] for a in order if a <= room and free(a)), None)
            if not chosen:
                break
            for a in chosen:
                pattern[a] = pattern.get(a, 0) + 1
                room -= a
        times = min(left[k] // t if whole else left[k] / t for k, t in pattern.items())
        done = []
        for k, t in pattern.items():
            left[k] -= t * times
            if left[k] < (1 if whole else 1e-9):
                done.append(k)
                del left[k]
                order.remove(k)
        patterns.append((pattern, times, done))
    return patterns


def fractional_patterns(
    lengths: np.ndarray, demand: np.ndarray, size: int, gap: float, max_rounds: int, per_round: int = 8
) -> tuple[np.ndarray, np.ndarray]:
    """Column generation with a revised simplex: (patterns as columns, how often each is used), demand met exactly.

    The first basis holds the longest-first patterns, each of which uses up a length. Every
    sequence costs at least its tokens, so the tokens bound the optimum from below; rounds
    end at a relative ``gap`` to that bound, at the optimum, or after ``max_rounds`` (every
    basis on the way is a whole solution).
    """
    n = len(lengths)
    row_of = {int(k): i for i, k in enumerate(lengths)}
    basis, used, inverse = np.zeros((n, n)), np.zeros(n), np.zeros((n, n))
    column = 0
    # a pattern holds no length used up before it, so the basis is triangular and inverted row by row;
    # of lengths used up together all but one get a pattern of their own, used zero times
    first = filled_patterns(dict(zip(lengths.tolist(), demand.tolist(), strict=True)), size, whole=False)
    for pattern, times, done in first:
        for nth, own in enumerate(done):
            used[column] = 0.0 if nth else times
            for k, t in ({own: size // own} if nth else pattern).items():
                basis[row_of[k], column] = t
            column += 1
    for j, own in enumerate(k for *_, done in first for k in done):
        row = basis[row_of[own]]
        inverse[j, row_of[own]] = 1.0
        for before in np.flatnonzero(row[:j]):
            inverse[j] -= row[before] * inverse[before]
        inverse[j] /= row[j]
    cost = _cost((basis * lengths[:, None]).sum(axis=0).astype(np.int64), size).astype(float)
    bound = float((lengths * demand).sum())
    for _ in range(max_rounds):
        if (cost * used).sum() <= bound * (1 + gap):
            break
        prices = (cost[:, None] * inverse).sum(axis=0)
        moved = False
        for pattern in _best_patterns(lengths, prices, size, per_round):
            price = float(_cost(np.array(int((pattern * lengths).sum())), size))
            worth = float((prices * pattern).sum()) - price
            if worth <= 1e-7 * size:
                continue
            own = np.flatnonzero(pattern)
            direction = (inverse[:, own] * pattern[own]).sum(axis=1)
            ratios = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
            out = int(ratios.argmin())
            if not np.isfinite(ratios[out]):
                continue
            used = np.maximum(used - ratios[out] * direction, 0.0)
            used[out] = ratios[out]
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
            basis[:, out] = pattern
            cost[out] = price
            prices -= worth * row
            moved = True
        if not moved:
            break
    return basis, used


def cutting_plan(histogram: dict[int, int], size: int = SIZE, gap: float = 5e-4, max_rounds: int = 120) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: times) and how many sequences follow each; together they use every piece exactly once.

    At most ``size`` lengths exist, so the work here does not grow with the corpus.
    Whole parts of the fractional solution are kept; the pieces left over, a few
    per pattern whatever the corpus, are packed longest first.
    """
    rest = {k: v for k, v in histogram.items() if v > 0}
    plan: list[tuple[dict[int, int], int]] = []
    if rest.get(size):
        plan.append(({size: 1}, rest.pop(size)))
    if not rest:
        return plan
    lengths = np.array(sorted(rest), np.int64)
    demand = np.array([rest[k] for k in lengths.tolist()], float)
    patterns, used = fractional_patterns(lengths, demand, size, gap, max_rounds)
    left = demand.astype(np.int64)
    for j in np.argsort(-used, kind="stable"):
        pattern = np.rint(patterns[:, j]).astype(np.int64)
        own = pattern > 0
        times = int(min(np.floor(used[j] + 1e-6), (left[own] // pattern[own]).min()))
        if times > 0:
            plan.append(({int(k): int(t) for k, t in zip(lengths[own], pattern[own], strict=True)}, times))
            left -= pattern * times
    over = {int(k): int(t) for k, t in zip(lengths, left, strict=True) if t}
    return plan + [(pattern, int(times)) for pattern, times, _ in filled_patterns(over, size, whole=True)]


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times in a sequence, first sequence, offset) for each length of each pattern."""
    rows, taken, sequence = [], {}, 0
    for pattern, count in plan:
        offset = 0
        for length, times in pattern.items():
            first = taken.get(length, 0)
            taken[length] = first + times * count
            rows.append((length, first, taken[length], times, sequence, offset))
            offset += length * times
        sequence += count
    return rows


def pack(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SIZE,
    id_col: str = "doc_id", text_col: str = "text", gap: float = 5e-4, max_rounds: int = 120,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut into full sequences and one rest. The driver sees only
    the histogram of lengths (at most ``size`` rows): a linear program over
    patterns of lengths, whose columns a knapsack prices, tells how many
    sequences follow each pattern. Pieces of one length are ranked, and each
    rank range of a length belongs to one place of one pattern.

    Null and empty texts are one piece with the closing id; repeated rows are packed each; an empty table
    gives an empty result; ties in rank are broken by id and start; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, tokenizer_path, ranks_path, pattern, size, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        plan_rows(cutting_plan(histogram, size, gap, max_rounds)),
        "length long, first long, end long, times long, sequence long, at long")
    before = counts.select("length", "chunk", (F.sum("n").over(
        Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(inside) - 1).join(before, ["length", "chunk"]).withColumn(
        "rank", F.col("own") + F.col("before"))
    # a few rows per pattern, and patterns are bounded by the number of lengths
    placed = ranked.join(
        F.broadcast(places.withColumnRenamed("length", "of")),
        (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )
