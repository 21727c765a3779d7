"""Draw documents that look like a target set: hashed n-gram frequencies of both, log ratios as weights, Gumbel noise for the draw."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, byte_rows, runs_by_bytes, stored, texts
from .words import WORD_BYTE, word_bounds

BUCKETS = 10_000
LONGEST = 3  # words in a feature
REACH = 256  # bytes from the end of a span that the tables know; longer spans are folded in blocks of this size
SPAN_BYTES = 1 << 19
CRC32_POLYNOMIAL = 0xEDB88320  # reflected


def position_tables(reach: int = REACH) -> np.ndarray:
    """[d, b]: what byte b contributes to the CRC of a span that goes on for d bytes after it."""
    table = np.empty((reach, 256), np.uint32)
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(CRC32_POLYNOMIAL), one >> 1)
    table[0] = one
    for d in range(1, reach):
        table[d] = (table[d - 1] >> 8) ^ one[table[d - 1] & 0xFF]
    return table


class SpanCrc:
    """CRC-32 of many spans of a buffer at once.

    The CRC is linear: it is the XOR of what each byte contributes by its value and its distance from the end of
    the span, and of a constant that depends on the length alone (the CRC of so many zero bytes).
    """

    def __init__(self, reach: int = REACH):
        self.reach, self.table = reach, position_tables(reach)
        self.flat = self.table.reshape(-1)
        constants = [0]
        for n in range(1, reach + 1):
            constants.append(self.ahead(0xFFFFFFFF, n) ^ 0xFFFFFFFF)
        self.constants = np.array(constants, np.uint32)

    def ahead(self, state: int, n: int) -> int:
        """The register after n more zero bytes, n at most ``reach``: its own bytes are the first of them."""
        out = state >> (8 * n) if n < 4 else 0
        for j in range(min(4, n)):
            out ^= int(self.table[n - 1 - j, (state >> (8 * j)) & 0xFF])
        return out

    def long(self, data: np.ndarray) -> int:
        """Fold a long span block by block."""
        state, reach = 0xFFFFFFFF, self.reach
        distance = np.arange(reach - 1, -1, -1)
        whole = len(data) // reach
        for at in range(0, whole, 2048):
            blocks = data[at * reach:min(whole, at + 2048) * reach].reshape(-1, reach)
            for part in np.bitwise_xor.reduce(self.table[distance, blocks], axis=1).tolist():
                state = self.ahead(state, reach) ^ part
        if rest := len(data) - whole * reach:
            part = int(np.bitwise_xor.reduce(self.table[distance[-rest:], data[whole * reach:]]))
            state = self.ahead(state, rest) ^ part
        return state ^ 0xFFFFFFFF

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC of data[start:end] for each span; no span is empty."""
        size = ends - starts
        out = np.empty(len(starts), np.uint32)
        short = np.flatnonzero(size <= self.reach)
        filled = np.cumsum(size[short])
        at = 0
        while at < len(short):
            before = filled[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(filled, before + SPAN_BYTES, "right")))
            some = short[at:until]
            n = size[some]
            offsets = (filled[at:until] - n - before).astype(np.int32)
            place = np.arange(int(filled[until - 1] - before), dtype=np.int32)
            # a byte at place p of a span from ``start`` to ``end``: p + (start - offset) in the buffer
            place += np.repeat((starts[some] - offsets).astype(np.int32), n)
            distance = np.repeat((ends[some] - 1).astype(np.int32), n) - place
            value = data[place].astype(np.int32)
            out[some] = np.bitwise_xor.reduceat(self.flat[(distance << 8) + value], offsets) ^ self.constants[n]
            at = until
        for i in np.flatnonzero(size > self.reach):
            out[i] = self.long(data[starts[i]:ends[i]])
        return out


def spaced(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, row) of the words of lower-cased texts, written with one space after each."""
    low = b"\n".join(rows)
    starts, ends = word_bounds(low)
    size = ends - starts
    row_ends = np.cumsum([len(r) + 1 for r in rows])
    row = np.searchsorted(row_ends, starts, "right")
    to = np.cumsum(size + 1) - (size + 1)
    buffer = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inside = np.frombuffer(low, np.uint8)
    buffer[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = inside[WORD_BYTE[inside]]
    return buffer, to, to + size, row


def pieces(text: bytes, limit: int):
    """(piece, words of it that the piece before had): a long text in overlapping pieces cut between words."""
    start, carried = 0, b""
    while start < len(text):
        end = min(len(text), start + limit)
        while end < len(text) and WORD_BYTE[text[end]]:
            end += 1
        part = carried + text[start:end]
        had, _ = word_bounds(carried)
        yield part, len(had)
        s, e = word_bounds(part)
        carried = b"".join(part[a:b] + b" " for a, b in zip(s[1 - LONGEST:].tolist(), e[1 - LONGEST:].tolist(), strict=True))
        start = end


def feature_buckets(crc: SpanCrc, rows: list[bytes], buckets: int, had: int = 0):
    """(row, bucket) of every feature of lower-cased texts, and the words of each row.

    Features that end within the first ``had`` words are left out: the piece before has them.
    """
    buffer, starts, ends, row = spaced(rows)
    row_of, span_from, span_to = [], [], []
    for k in range(LONGEST):
        last = np.arange(max(k, had), len(starts))
        last = last[row[last] == row[last - k]]
        row_of.append(row[last])
        span_from.append(starts[last - k])
        span_to.append(ends[last])
    found = crc(buffer, np.concatenate(span_from), np.concatenate(span_to)) % np.uint32(buckets)
    return np.concatenate(row_of), found.astype(np.int64), np.bincount(row[had:], minlength=len(rows))


def blocks(rows: list[bytes]):
    """(first row, rows, words had before) in parts of about BLOCK_BYTES, pieces of a longer text one by one."""
    for s, e in runs_by_bytes(rows, BLOCK_BYTES):
        if e - s == 1 and len(rows[s]) > BLOCK_BYTES:
            for piece, had in pieces(rows[s].lower(), BLOCK_BYTES):
                yield s, [piece], had
        else:
            yield s, [r.lower() for r in rows[s:e]], 0


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; the driver sees one number per bucket."""

    def kernel(batches):
        crc, total = SpanCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part, had in blocks(byte_rows(batch.column(0))):
                total += np.bincount(feature_buckets(crc, part, buckets, had)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    made = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(kernel, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in made.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed frequency of each bucket in the target over that in the source."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def feature_weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    buckets = len(gains)

    def kernel(batches):
        crc = SpanCrc()
        for batch in batches:
            rows = byte_rows(batch.column(1))
            words, features, weight = (np.zeros(len(rows), np.int64) for _ in range(3))
            for s, part, had in blocks(rows):
                row, found, n = feature_buckets(crc, part, buckets, had)
                words[s:s + len(part)] += n
                features[s:s + len(part)] += np.bincount(row, minlength=len(part))
                weight[s:s + len(part)] += np.bincount(row, weights=gains[found], minlength=len(part)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(weight)})

    return texts(docs, id_col, text_col).mapInArrow(kernel, "doc_id long, n_words long, n_features long, weight long")


def importance_draw(
    docs: DataFrame, target: DataFrame, share: float = 5, min_words: int = 20, buckets: int = BUCKETS, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Draw ``share`` percent of the documents of at least ``min_words`` words, without replacement, by importance.

    Features are all runs of one to three words, hashed by CRC-32 into buckets. A bucket's gain is the log ratio of
    its smoothed frequencies in ``target`` and in ``docs``, a document's weight the sum over its features, its score
    the weight plus Gumbel noise made from ``seed`` and its id; the highest scores are drawn.

    One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (1, 2, 3... of the drawn, else null).

    The ranks come from a range sort of (score, doc_id) over all tasks: each range numbers its rows and a
    range's offset is the number of rows in the ranges before it.

    Null and empty texts have no words: weight 0, never drawn with ``min_words`` over 0. A null id is hashed as an
    empty string and comes last among equal scores; repeated rows are documents of their own (equal ones take
    consecutive ranks); an empty table gives an empty result, an empty target gives gains from the smoothing alone;
    other columns, whatever their names, are ignored; long texts are read in pieces that overlap by two words.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = feature_weights(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise)

    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fits = F.col("n_words") >= min_words
    # what cannot be drawn is spread by noise; the row number splits rows that repeat an id
    ordered = [
        F.when(fits, 0).otherwise(1), F.when(fits, -F.col("score")).otherwise(F.rand(seed) * (1 << 40)).cast("long"),
        F.col("doc_id").asc_nulls_last(), F.monotonically_increasing_id()]
    names = ["_out", "_score", "_id", "_row"]
    ranged = scored.select("*", *[c.alias(n) if n != "_id" else F.col("doc_id").alias(n) for c, n in zip(ordered, names, strict=True)])
    keys = [F.col("_out"), F.col("_score"), F.col("_id").asc_nulls_last(), F.col("_row")]
    ranged = stored(
        stored(ranged, "importance").repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()).drop("_score", "_id", "_row"), "importance-ranked")
    # the upper bits of the number are the range, the lower ones the place in it
    piece, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = dict(ranged.where("_out = 0").groupBy(piece.alias("piece")).count().collect())  # one row per range
    offsets, before = [], 0
    for k in sorted(sizes):
        offsets += [F.lit(k), F.lit(before)]
        before += sizes[k]
    drawn = int(share * before // 100)
    rank = F.create_map(*offsets)[piece] + place + 1 if offsets else F.lit(None)
    rank = F.when((F.col("_out") == 0) & (rank <= drawn), rank).cast("long")
    return ranged.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, draw: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns."""
    chosen = draw.where("rank IS NOT NULL").select(F.col("doc_id").alias("_chosen")).distinct()
    return docs.join(chosen, docs[id_col] == chosen["_chosen"], "left_semi")
