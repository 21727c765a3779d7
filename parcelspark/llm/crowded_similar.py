"""Similar windows around one anchor that has very many different contexts: all pairs that can be similar, without gathering them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, mixed, stored
from .components import components
from .crowded import PLACE
from .similar_windows import SHIFT, Similar

AT_ONCE = 512  # contexts in the arrays of a kernel
PAIRS_AT_ONCE = 4096
HELD = 8192  # contexts in a block; a task holds two blocks
SMALL = 16  # so many members of a bucket meet all others at once
MASKS = [f"{kind}_{half}" for kind in ("asks", "gives", "open") for half in (0, 1)]  # places of a shingle in a context, a bit each
MARKED = f"cell long, id long, {', '.join(f'{c} long' for c in MASKS)}, lowest int, highest int"
SPANS = "doc_id long, text_key long, start int, end int, partner long"


def _similar(left: list[bytes], right: list[bytes], size: int, similarity: float) -> Similar:
    """Contexts as they are passed on (to the left reversed by shingle) on one grid."""
    ahead = [np.frombuffer(b, np.uint64)[::-1] for b in left]
    behind = [np.frombuffer(b, np.uint64) for b in right]
    before, after = (np.array([len(x) for x in side], np.int64) for side in (ahead, behind))
    data = np.concatenate([x for both in zip(ahead, behind, strict=True) for x in both])
    return Similar(data, np.cumsum(before + after) - after, before, after, size, similarity)


def _parts(batches, size: int, similarity: float):
    """(part of a batch, its contexts); the columns are id, key, left, right and others."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield part, _similar(byte_rows(part.column(2)), byte_rows(part.column(3)), size, similarity)


def _cells(part: pa.RecordBatch, similar: Similar) -> np.ndarray:
    """A number for each shingle of a key."""
    return similar.grid + mixed(part.column(1).to_numpy().view(np.uint64))[:, None]


def _places(size: int, similarity: float):
    def kernel(batches):
        for part, similar in _parts(batches, size, similarity):
            row, place = np.nonzero(similar.inside)
            yield pa.RecordBatch.from_arrays([
                pa.array(_cells(part, similar)[row, place].view(np.int64)), pa.array(part.column(0).to_numpy()[row]), pa.array(place.astype(np.int32))],
                ["cell", "id", "place"])

    return kernel


def _marked(size: int, similarity: float):
    """The places of each context by which it meets others, as in ``Similar.candidates``: rare shingles stand first.

    A window asks for what is similar to it by its first shingles, if enough of its shingles are met at all; a context
    gives itself by the first ones of its windows with ``SHIFT`` places on either side.
    """
    def kernel(batches):
        for part, similar in _parts(batches, size, similarity):
            low, high = (part.column(k).to_numpy(zero_copy_only=False)[:, None] for k in (4, 5))
            inside, whole = similar.inside, similar.whole
            met = part.column(6)
            count = np.ones(inside.shape, np.int64)
            known = met.flatten()
            count[np.repeat(np.arange(part.num_rows), np.diff(met.offsets.to_numpy())), known.field(0).to_numpy()] = known.field(1).to_numpy()
            cells = _cells(part, similar)
            order = np.lexsort((cells[inside], count[inside]))
            line = cells[inside][order]
            number = np.empty(len(line), np.int32)
            number[order] = np.cumsum(np.r_[False, line[1:] != line[:-1]])
            rank = np.full(inside.shape, len(line), np.int32)
            rank[inside] = number
            known = inside & (count > 1)
            wide = size + 2 * SHIFT

            def enough(width, pad, known=known):
                sums = np.cumsum(np.pad(known, ((0, 0), (pad + 1, pad))), axis=1)
                return sums[:, width:] - sums[:, :-width] >= similar.need

            possible = whole & enough(size, 0)
            padded = np.pad(rank, ((0, 0), (SHIFT, SHIFT)), constant_values=len(line))
            gives = similar.first_ones(padded, wide, enough(wide, SHIFT))[:, SHIFT:padded.shape[1] - SHIFT] & known
            asks = similar.first_ones(rank, size, possible) & known
            open_ = similar.first_ones(rank, size, possible & ((similar.before < low) | (similar.before > high))) & known
            # windows are numbered from the one that begins at the anchor
            some = possible.any(axis=1)
            lowest = np.where(some, similar.before[size - 1 - possible[:, ::-1].argmax(axis=1)], size)
            highest = np.where(some, similar.before[possible.argmax(axis=1)], -1)
            row, place = np.nonzero(gives | asks)
            order = np.lexsort((cells[row, place], row))
            row, place = row[order], place[order]
            cell = cells[row, place]
            first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])][:len(row)])
            masks = []
            for marks, reach in ((asks, 0), (gives, SHIFT), (open_, 0)):
                for half in (0, 1):
                    bits = np.zeros(len(row), np.uint64)
                    for to in range(-reach, reach + 1):  # what is given is met up to ``SHIFT`` places away
                        there = place + to - 64 * half
                        own = marks[row, place] & (there >= 0) & (there < 64)
                        bits[own] |= np.uint64(1) << there[own].astype(np.uint64)
                    masks.append(np.bitwise_or.reduceat(bits, first).view(np.int64) if len(first) else bits.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(cell[first].view(np.int64)), pa.array(part.column(0).to_numpy()[row[first]]), *map(pa.array, masks),
                *(pa.array(x[row[first]].astype(np.int32)) for x in (lowest, highest))],
                [c.split()[0] for c in MARKED.split(", ")])

    return kernel


def _hits(size: int, similarity: float):
    """The similar ones of the pairs of each cell, in both directions; the contexts of a cell come before its pairs (id, _id)."""
    def kernel(batches):
        cell, ids, left, right, similar = None, [], [], [], None
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1])]) if len(cells) else []
            for at, to in zip(cuts, [*cuts[1:], len(cells)], strict=True):
                if cells[at] != cell:
                    cell, ids, left, right, similar = cells[at], [], [], [], None
                part = batch.slice(at, to - at)
                n = part.num_rows - part.column(2).null_count  # pairs of this part, which stand last
                bodies, pairs = part.slice(0, part.num_rows - n), part.slice(part.num_rows - n)
                ids += bodies.column(1).to_pylist()
                left += byte_rows(bodies.column(3))
                right += byte_rows(bodies.column(4))
                if n and similar is None:
                    similar = _similar(left, right, size, similarity)
                    line = np.array(ids, np.int64)
                    order = np.argsort(line)
                for start in range(0, n, PAIRS_AT_ONCE):
                    one, two = (order[np.searchsorted(line, pairs.column(k).slice(start, PAIRS_AT_ONCE).to_numpy(), sorter=order)] for k in (1, 2))
                    a, b, least, most = similar.hits(np.r_[one, two], np.r_[two, one])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(line[a]), pa.array(line[b]), pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32))],
                        ["id", "_id", "least", "most"])

    return kernel


def _compared(pairs: DataFrame, bodies: DataFrame, size: int, similarity: float) -> DataFrame:
    """(id, _id, least, most) of the similar ones of ``pairs``, in both directions.

    Contexts are dealt into blocks and pairs into cells of two blocks, so a task holds two blocks of contexts, which
    are sent once to each cell that has pairs of them.
    """
    either = pairs.select("id").unionByName(pairs.select(F.col("_id").alias("id")))
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, 1)
    blocks = max(-(-either.distinct().count() // HELD), int(np.ceil((2 * tasks) ** 0.5)))

    def block(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(blocks))

    dealt = pairs.withColumn("cell", block("id") * blocks + block("_id"))
    asked = dealt.select("cell", "id").unionByName(dealt.select("cell", F.col("_id").alias("id"))).distinct()
    none = F.lit(None)
    held = asked.join(bodies.select("id", "left", "right"), "id").select("cell", "id", none.cast("long").alias("_id"), "left", "right")
    return held.unionByName(dealt.select("cell", "id", "_id", none.cast("binary").alias("left"), none.cast("binary").alias("right"))).repartition(
        blocks * blocks, "cell").sortWithinPartitions("cell", "_id").mapInArrow(_hits(size, similarity), "id long, _id long, least int, most int")


def _first_state(rows: DataFrame, parts: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """What is decided before any of ``rows`` meet here: (id, doc_id, label, low, high), the windows low to high of a context and the class of its document."""
    own = parts.join(rows.select("key").distinct(), "key", "left_semi")
    hull = own.groupBy(*PLACE).agg(
        F.min(F.col("at") + size - F.col("end")).alias("low"), F.max(F.col("at") - F.col("start")).alias("high"))
    links = own.select(F.col("doc_id").alias("a"), F.col("partner").alias("b")).unionByName(
        known.select(F.col("doc_id").alias("a"), F.col("partner").alias("b")))
    return _labelled(
        rows.select("id", *PLACE).join(hull, PLACE, "left").select(
            "id", "doc_id", F.col("doc_id").alias("label"), F.coalesce("low", F.lit(size)).alias("low"), F.coalesce("high", F.lit(-1)).alias("high")), links)


def _labelled(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` with the classes joined by ``links`` (a, b) of classes."""
    named = components(links).select(F.col("node").alias("label"), F.col("component").alias("_component"))
    return state.join(named, "label", "left").withColumn("label", F.coalesce("_component", "label")).drop("_component")


def _any(kind: str) -> Column:
    return (F.col(f"{kind}_0") != 0) | (F.col(f"{kind}_1") != 0)


def _pairs(now: DataFrame) -> DataFrame:
    """(id, _id) of what asks with the heads of its bucket at about the same place, if it can tell something new."""
    heads = now.where("head").select(
        "cell", F.col("id").alias("_id"), F.col("gives_0").alias("_0"), F.col("gives_1").alias("_1"), F.col("doc_id").alias("_doc"), F.col("label").alias("_label"))

    def met(kind: str) -> Column:
        return F.col(f"{kind}_0").bitwiseAND(F.col("_0")).bitwiseOR(F.col(f"{kind}_1").bitwiseAND(F.col("_1"))) != 0

    return now.where(_any("asks")).join(heads, "cell").where(
        (F.col("doc_id") != F.col("_doc")) & ((F.col("undecided") & met("open")) | ((F.col("label") != F.col("_label")) & met("asks")))
    ).select(F.least("id", "_id").alias("id"), F.greatest("id", "_id").alias("_id")).distinct()


def _live(marked: DataFrame, state: DataFrame, heads: int, number: int) -> DataFrame:
    """The members of buckets that can still tell something new, with the heads that all others meet in this round."""
    undecided = (F.col("low") > F.col("lowest")) | (F.col("high") < F.col("highest"))
    now = marked.join(state, "id").withColumn("undecided", undecided)
    buckets = now.groupBy("cell").agg(
        F.count_if(_any("gives")).alias("n"), F.max(F.col("undecided") & _any("open")).alias("wanted"), F.min("doc_id").alias("d"), F.max("doc_id").alias("_d"),
        F.min("label").alias("l"), F.max("label").alias("_l")).where("n > 0 AND d <> _d AND (wanted OR l <> _l)").select("cell", "n")
    luck = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(1 << 30)) * F.col("n") < F.lit(heads << 30)
    head: Column = _any("gives") & ((F.col("n") <= SMALL) | luck)
    return now.join(buckets, "cell").select(*marked.columns, "doc_id", "label", "undecided", head.alias("head"))


def crowded_similar(contexts: DataFrame, parts: DataFrame, known: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, text_key, start, end, partner: windows of ``size`` shingles that are similar to the same window around an anchor of the same key in another document.

    ``contexts`` (PLACE, left, right) are all contexts of the keys. ``parts`` (PLACE, start, end, partner) and
    ``known`` (doc_id, partner) is what is found already; all pairs that can add a window or join two classes are looked
    at, so the hull of the similar windows of a context and the classes of documents are those of all pairs.

    Contexts meet by the rarest shingles of their windows. In each round a few members of a bucket (key and shingle) are
    compared with all that ask there, 16 times as many as in the round before, and leave it; what is decided by
    then asks no more, so a group of near copies costs a few comparisons per context.
    """
    spark = contexts.sparkSession
    rows = stored(contexts.withColumn("id", F.monotonically_increasing_id()), "crowded-contexts")
    if rows.isEmpty():
        return spark.createDataFrame([], SPANS)
    state = stored(_first_state(rows, parts, known, size), "similar-state")
    bodies = rows.select("id", "key", "left", "right")
    cells = bodies.mapInArrow(_places(size, similarity), "cell long, id long, place int")
    often = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    need = int(np.ceil(2 * size * similarity / (1 + similarity) - 1e-9))
    met = cells.join(often, "cell").groupBy("id").agg(F.collect_list(F.struct("place", "often")).alias("met")).where(F.size("met") >= need)
    live = stored(
        bodies.join(state.select("id", "low", "high"), "id").join(met, "id").select("id", "key", "left", "right", "low", "high", "met")
        .mapInArrow(_marked(size, similarity), MARKED), "similar-marked")
    columns, found, heads, number = live.columns, [], 1, 0
    while True:
        now = stored(_live(live, state, heads, number), f"similar-live-{number}")
        if now.isEmpty():
            break
        pairs = stored(_pairs(now), f"similar-pairs-{number}")
        hits = stored(_compared(pairs, bodies, size, similarity), f"similar-hits-{number}")
        live = now.select(*[F.when(~F.col("head"), F.col(c)).otherwise(0).alias(c) if c.startswith("gives") else F.col(c) for c in columns]).where(
            _any("gives") | _any("asks"))
        heads, number = heads * 16, number + 1
        if hits.isEmpty():
            continue
        named = hits.join(state.select("id", "label"), "id").join(
            state.select(F.col("id").alias("_id"), F.col("doc_id").alias("partner"), F.col("label").alias("_label")), "_id")
        hull = named.groupBy("id").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("partner").alias("partner"))
        # one link for two classes
        further = stored(named.where("label <> _label").groupBy("label", "_label").agg(
            F.min(F.struct("id", "least", "most", "partner")).alias("link")), f"similar-links-{number}")
        hull = stored(hull, f"similar-hulls-{number}")
        found += [hull, further.select("link.*")]
        state = state.join(hull.drop("partner"), "id", "left").select(
            "id", "doc_id", "label", F.least("low", "least").alias("low"), F.greatest("high", "most").alias("high"))
        state = stored(_labelled(state, further.select(F.col("label").alias("a"), F.col("_label").alias("b"))), f"similar-state-{number}")
    if not found:
        return spark.createDataFrame([], SPANS)
    return reduce(DataFrame.unionByName, found).join(rows.select("id", "doc_id", "text_key", "at"), "id").select(
        "doc_id", "text_key", (F.col("at") - F.col("most")).alias("start"), (F.col("at") + size - F.col("least")).alias("end"), "partner")
