"""Remove every byte covered by a long string that occurs more than once in the corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, byte_rows, mixed, powers, runs_by_bytes, stored
from .crowded import crowded_intervals
from .suffixes import covered_lengths
from .words import BYTE_BASE

LENGTH = 400
GRAM = 48
# Anchors of one key up to this many distinct contexts are sorted in one piece; more are sorted over all tasks.
GROUP_LIMIT = 1024
CHUNK_BYTES = 1 << 19

PLACES = "doc_id long, text_key long, start int, end int, anchor int, key long, segment long, twice boolean"


def window_anchors(data: np.ndarray, valid: np.ndarray, length: int, gram: int, up_down) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, key) of maximal runs of window starts that share an anchor.

    The anchor of a window is the place of its smallest gram hash (the leftmost of equals), so
    equal windows have it at the same distance wherever they stand.
    """
    up, down = up_down
    n = len(data)
    starts = n - length + 1
    width = length - gram + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    places = n - gram + 1
    hashes = mixed((sums[gram:] - sums[:places]) * down[:places])
    ranked = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(places, dtype=np.uint64)
    rows = -(-places // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:places] = ranked
    square = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(behind[:starts], ahead[width - 1:width - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:starts] != valid[:starts - 1])])
    last = np.r_[change[1:], starts] - 1
    kept = valid[change]
    first, last = change[kept], last[kept]
    return first, last, anchor[first], hashes[anchor[first]]


def _pieces(rows: list[bytes], length: int):
    """(row, offset in the row, piece) cut so that every window lies whole in the piece in which it starts."""
    for i, row in enumerate(rows):
        for at in range(0, max(1, len(row) - length + 1), BLOCK_BYTES):
            yield i, at, row[at:at + BLOCK_BYTES + length - 1]


def anchored_segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per run of windows with a common anchor; what repeats inside a task's block is marked at once."""

    def kernel(batches):
        from xxhash import xxh3_64_intdigest

        up_down = powers(BYTE_BASE, 2 * BLOCK_BYTES + 2 * length)
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pieces = [p for p in _pieces(byte_rows(batch.column(2)), length) if len(p[2]) >= length]
            for a, b in runs_by_bytes([p[2] for p in pieces]):
                own = pieces[a:b]
                text = b"".join(p[2] for p in own)
                bounds = np.cumsum([0] + [len(p[2]) for p in own])
                valid = np.zeros(len(text), bool)
                for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                    valid[s:e - length + 1] = True
                first, last, anchor, gram_hash = window_anchors(np.frombuffer(text, np.uint8), valid, length, gram, up_down)
                piece = np.searchsorted(bounds, first, "right") - 1
                segment = np.array([xxh3_64_intdigest(text[s:e]) for s, e in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                segment ^= mixed((anchor - first).astype(np.uint64))
                _, index, inverse, count = np.unique(segment, return_index=True, return_inverse=True, return_counts=True)
                leader = index[inverse] == np.arange(len(segment))
                often = count[inverse] > 1
                # later occurrences within the block are decided; only the first goes on to be compared
                again = ~leader
                offset = np.array([p[1] for p in own], np.int64)[piece] - bounds[piece]
                row = np.array([p[0] for p in own], np.int64)[piece]
                start, end = first + offset, last + length + offset
                done = _merged_runs(row[again], start[again], end[again])
                rows_out = np.r_[row[leader], done[0]]
                m, d = int(leader.sum()), len(done[0])
                flag = np.r_[np.zeros(m, bool), np.ones(d, bool)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r] for r in rows_out.tolist()], pa.int64()), pa.array([keys[r] for r in rows_out.tolist()], pa.int64()),
                    pa.array(np.r_[start[leader], done[1]], pa.int32()), pa.array(np.r_[end[leader], done[2]], pa.int32()),
                    pa.array(np.r_[(anchor + offset)[leader], np.zeros(d, np.int64)].astype(np.int32), mask=flag),
                    pa.array(np.r_[gram_hash[leader], np.zeros(d, np.uint64)].view(np.int64), mask=flag),
                    pa.array(np.r_[segment[leader], np.zeros(d, np.uint64)].view(np.int64), mask=flag),
                    pa.array(np.r_[often[leader], np.ones(d, bool)]),
                ], ["doc_id", "text_key", "start", "end", "anchor", "key", "segment", "twice"])

    return rows.mapInArrow(kernel, PLACES)


def _merged_runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals whose starts and ends both rise within a row, joined where they touch or overlap."""
    if not len(row):
        return row, start, end
    fresh = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > end[:-1])]
    at = np.flatnonzero(fresh)
    return row[at], start[at], np.maximum.reduceat(end, at)


def _segment_bytes(batches):
    """Cut the listed segments out of each document."""
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        texts, places = byte_rows(columns["text"]), columns["places"].to_pylist()
        ids, keys = columns["doc_id"].to_pylist(), columns["text_key"].to_pylist()
        out: list[list] = [[] for _ in range(6)]
        size = 0
        for doc_id, text_key, text, own in zip(ids, keys, texts, places, strict=True):
            for p in own:
                piece = text[p["start"]:p["end"]]
                for column, value in zip(out, (p["key"], doc_id, text_key, p["start"], p["anchor"] - p["start"], piece), strict=True):
                    column.append(value)
                size += len(piece)
            if size > 4 * BLOCK_BYTES:
                yield _segment_batch(out)
                out, size = [[] for _ in range(6)], 0
        yield _segment_batch(out)


SEGMENTS = "key long, doc_id long, text_key long, start int, before int, bytes binary"


def _segment_batch(out):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "doc_id", "text_key", "start", "before", "bytes"])


COMPARED = "key long, doc_id long, text_key long, start int, end int, hot boolean, left binary, right binary"
COMPARED_NAMES = [c.split()[0] for c in COMPARED.split(", ")]


def _compare_groups(length: int, limit: int):
    """Stream over segments sorted by key; groups over ``limit`` are passed on with their bytes."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    names = COMPARED_NAMES

    def kernel(batches):
        # one more group than a chunk may come in before a chunk is compared
        up_down = powers(BYTE_BASE, 2 * CHUNK_BYTES + (limit + 2) * 2 * length)
        waiting: list[tuple] = []  # whole groups, as (group number, row)
        group: list[tuple] = []
        key, number, size, hot = None, 0, 0, False

        def compared(rows):
            segments = [r[1][5] for r in rows]
            data = np.frombuffer(b"".join(segments), np.uint8)
            lengths = np.array([len(s) for s in segments], np.int64)
            begin = np.cumsum(lengths) - lengths
            before = np.array([r[1][4] for r in rows], np.int64)
            least, most, _ = covered_lengths(data, begin + before, before, lengths - before, np.array([r[0] for r in rows]), length, up_down)
            own = np.flatnonzero(most >= 0)
            at = np.array([r[1][3] for r in rows], np.int64) + before
            none = pa.array([None] * len(own), kinds[6])
            return pa.RecordBatch.from_arrays([
                pa.array([rows[i][1][0] for i in own], kinds[0]), pa.array([rows[i][1][1] for i in own], kinds[0]),
                pa.array([rows[i][1][2] for i in own], kinds[0]),
                pa.array((at[own] - most[own]).astype(np.int32)), pa.array((at[own] + length - least[own]).astype(np.int32)),
                pa.array(np.zeros(len(own), bool)), none, none], names)

        def passed_on(rows):
            at = pa.array([r[3] + r[4] for r in rows], kinds[3])
            return pa.RecordBatch.from_arrays([
                *(pa.array([r[k] for r in rows], kinds[k]) for k in range(3)), at, at, pa.array([True] * len(rows)),
                pa.array([r[5][:r[4]][::-1] for r in rows], kinds[6]), pa.array([r[5][r[4]:] for r in rows], kinds[7])], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    if hot and group:
                        yield passed_on(group)
                    elif len(group) > 1:
                        waiting += [(number, r) for r in group]
                        size += sum(len(r[5]) for r in group)
                    if size > CHUNK_BYTES:
                        yield compared(waiting)
                        waiting, size = [], 0
                    key, group, hot = row[0], [], False
                    number += 1
                group.append(row)
                if len(group) > limit:
                    hot = True
                    yield passed_on(group)
                    group = []
        if hot and group:
            yield passed_on(group)
        elif len(group) > 1:
            waiting += [(number, r) for r in group]
        if waiting:
            yield compared(waiting)

    return kernel


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, text_key, start, end (bytes): intervals whose union is covered by strings of ``length`` bytes that start more than once.

    ``docs`` has doc_id, text_key and text. Every window of ``length`` bytes has an anchor, its
    smallest gram; windows that share one form a segment. Only anchors whose gram occurs more
    than once can lie in a repeat. Equal segments are decided by counting their digests, so
    copies and the inside of common passages are never gathered. What is left are segments
    that differ somewhere around an equal gram: they are brought together by the gram and
    suffix sorted on both sides of it. A gram with very many different contexts (the border
    of a common passage) is not gathered; its contexts are sorted over all tasks instead.
    """
    places = stored(anchored_segments(docs.select("doc_id", "text_key", "text"), length, gram), "segments")
    inside = places.where("key IS NULL").select("doc_id", "text_key", "start", "end")
    compared = places.where("key IS NOT NULL")
    several = (
        compared.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"), F.max("twice").alias("twice"))
        .where("n > 1 OR twice").select("key", (F.col("low") == F.col("high")).alias("alike"), "n")
    )
    met = stored(compared.join(several, "key"), "met-segments")
    alike = met.where("alike").select("doc_id", "text_key", "start", "end")
    mixed_keys = met.where("NOT alike")
    segments = stored(
        mixed_keys.groupBy("key", "segment").agg(
            F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"),
            F.min(F.struct("doc_id", "text_key", "start", "end", "anchor")).alias("first"))
        .select("key", "segment", (F.col("twice") | (F.col("n") > 1)).alias("equal"), "first.*"), "distinct-segments")
    counted = mixed_keys.join(segments.where("equal").select("key", "segment"), ["key", "segment"], "left_semi").select("doc_id", "text_key", "start", "end")
    wanted = segments.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("key", "start", "end", "anchor")).alias("places"))
    bodies = docs.select("doc_id", "text_key", "text").join(
        wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    sorted_out = stored(
        bodies.select("doc_id", "text_key", "text", "places").mapInArrow(_segment_bytes, SEGMENTS)
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(_compare_groups(length, group_limit), COMPARED),
        "compared-segments")
    contexts = sorted_out.where("hot").select("key", "doc_id", "text_key", F.col("start").alias("at"), "left", "right")
    hot = crowded_intervals(contexts, length).select("doc_id", "text_key", "start", "end")
    return (
        inside.unionByName(alike).unionByName(counted)
        .unionByName(sorted_out.where("NOT hot").select("doc_id", "text_key", "start", "end")).unionByName(hot)
    )


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A byte goes if any string of ``length`` bytes around it also starts anywhere else, in the same text
    or another; strings are judged on the input. Matches never cross documents.

    Null is an empty text; texts shorter than ``length`` stay whole; repeated rows are copies of
    each other; rows with a null id are treated like any other; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text")
    spans = repeated_intervals(rows, length, gram, group_limit).distinct().groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})

    def kernel(batches):
        for batch in batches:
            texts, own = byte_rows(batch.column(1)), batch.column(2).to_pylist()
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(texts, own, strict=True):
                kept, removed, n, at = [], 0, 0, 0
                for s in spans or ():
                    a, b = s["start"], s["end"]
                    if b <= at:
                        continue
                    if a > at or n == 0:
                        kept.append(text[at:a])
                        n += 1
                    removed += b - max(a, at)
                    at = b
                kept.append(text[at:])
                rest = b"".join(kept)
                for column, value in zip(out, (len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(
        spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left",
    ).select("doc_id", "text", "spans").mapInArrow(kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
