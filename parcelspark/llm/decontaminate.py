"""Find and remove benchmark passages by word n-grams."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, runs_by_bytes, stored
from .words import byte_powers, window_hashes, word_bounds, word_hashes

WINDOW_WORDS = 10
# A broadcast holds the windows of at most about this many benchmark bytes; a larger benchmark is scanned in blocks.
BENCHMARK_BYTES = 16 << 20
FILTER_BITS = 22

SPANS = "array<struct<start:long,end:long,first_byte:long,end_byte:long>>"
FOUND = f"doc_id long, text_key long, n_words long, spans {SPANS}, items array<string>"


class Windows:
    """The distinct windows of some benchmark items, by size, with an exact check of every hash hit."""

    def __init__(self, items: list[tuple[str, str]], size: int, base_powers):
        self.items_of: dict[bytes, list[str]] = {}
        hashes: dict[int, set[int]] = {}
        for item, text in items:
            low = text.encode().lower()
            starts, ends = word_bounds(low)
            if not len(starts):
                continue
            n = min(size, len(starts))
            words = [low[a:b] for a, b in zip(starts, ends, strict=True)]
            hashes.setdefault(n, set()).update(window_hashes(word_hashes(low, starts, ends, base_powers), n).tolist())
            for key in {b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}:
                self.items_of.setdefault(key, []).append(item)
        self.sizes = {n: np.array(sorted(h), np.uint64) for n, h in hashes.items()}
        self.filters = {}
        for n, h in self.sizes.items():
            self.filters[n] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[n][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def occurrences(self, low: bytes, starts, ends, hashes):
        """(word position, size, items) of every window that occurs."""
        for n, wanted in self.sizes.items():
            seen = window_hashes(hashes, n)
            at = np.flatnonzero(self.filters[n][(seen >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(wanted, seen[at]), len(wanted) - 1)
            for i in at[wanted[place] == seen[at]].tolist():
                key = b" ".join([low[a:b] for a, b in zip(starts[i:i + n], ends[i:i + n], strict=True)])
                if found := self.items_of.get(key):
                    yield i, n, found


def _scan(items: list[tuple[str, str]], size: int):
    def kernel(batches):
        base_powers = byte_powers()
        windows = Windows(items, size, base_powers)
        for batch in batches:
            rows = byte_rows(batch.column(2))
            n_words, spans, found_items = [], [], []
            for a, b in runs_by_bytes(rows):
                # rows of a run are scanned as one text; a line feed between rows ends words, and windows across rows are dropped
                lows = [r.lower() for r in rows[a:b]]
                low = b"\n".join(lows)
                starts, ends = word_bounds(low)
                row_at = np.cumsum([0] + [len(r) + 1 for r in lows])
                first = np.searchsorted(starts, row_at)
                per_row: list[tuple[list, set]] = [([], set()) for _ in lows]
                for i, n, item_ids in windows.occurrences(low, starts, ends, word_hashes(low, starts, ends, base_powers)):
                    row = int(np.searchsorted(first, i, "right")) - 1
                    if i + n > first[row + 1]:
                        continue
                    per_row[row][0].append((i - first[row], i + n - first[row]))
                    per_row[row][1].update(item_ids)
                for row, (hits, own) in enumerate(per_row):
                    n_words.append(int(first[row + 1] - first[row]))
                    merged: list[list[int]] = []
                    for s, e in sorted(hits):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    base, byte = int(first[row]), int(row_at[row])
                    spans.append([{
                        "start": int(s), "end": int(e), "first_byte": int(starts[base + s]) - byte, "end_byte": int(ends[base + e - 1]) - byte,
                    } for s, e in merged])
                    found_items.append(sorted(own))
            span = pa.struct([(k, pa.int64()) for k in ("start", "end", "first_byte", "end_byte")])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                pa.array(spans, pa.list_(span)), pa.array(found_items, pa.list_(pa.string())),
            ], ["doc_id", "text_key", "n_words", "spans", "items"])

    return kernel


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """doc_id, text_key, n_words, spans and items of every row of ``docs``.

    A window is ``size`` consecutive words of an item (all of them, if it has
    fewer). Windows of the benchmark travel to the tasks as a hash set whose
    size is bounded by ``block_bytes`` of benchmark text (or one item, if that
    is longer); a larger benchmark is scanned in as many blocks. Each hash hit
    is checked against the words themselves. spans are the merged runs of hit
    words, as word positions and as byte offsets; items the ids, as strings and
    sorted, of items with an occurring window.

    Null and empty texts have no words and no hits; items that are null, empty
    or without words have no windows; repeated rows and items give the same result
    each; an empty benchmark or table is fine; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(
        F.col("item").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 16 * max(1, -(-total // block_bytes))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(buckets)).cast("int"))
    found, blocks = None, benchmark_blocks(items, block_bytes)
    for first, last in blocks:
        own = [(r.item, r.text) for r in items.where(F.col("bucket").between(first, last)).distinct().toLocalIterator()]
        part = rows.mapInArrow(_scan(own, size), FOUND)
        found = part if found is None else found.unionByName(part)
    return found if len(blocks) == 1 else _merged(found, len(blocks))


def benchmark_blocks(items: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """First and last bucket of each block: neighbouring buckets as long as their measured bytes fit.

    A bucket is a hash of item and text, so the texts of one item fall apart like any others; there are sixteen
    buckets for each block that the whole benchmark would fill.
    """
    sizes = dict(items.groupBy("bucket").agg(F.sum(F.octet_length("text"))).collect())  # one row per bucket
    out, filled = [], 0
    for bucket in sorted(sizes):
        if out and filled + sizes[bucket] <= block_bytes:
            out[-1] = (out[-1][0], bucket)
            filled += sizes[bucket]
        else:
            out.append((bucket, bucket))
            filled = sizes[bucket]
    return out or [(0, 0)]


def _merged(found: DataFrame, blocks: int) -> DataFrame:
    """One row per row again after a scan in blocks: spans of all blocks joined where they touch or overlap."""
    gathered = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), (F.count(F.lit(1)) / blocks).cast("long").alias("copies"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = F.expr(f"""aggregate(raw, cast(array() AS {SPANS}), (acc, x) ->
        CASE WHEN size(acc) > 0 AND x.start <= try_element_at(acc, -1).end
        THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct(
            'start', try_element_at(acc, -1).start, 'end', greatest(try_element_at(acc, -1).end, x.end),
            'first_byte', try_element_at(acc, -1).first_byte, 'end_byte', greatest(try_element_at(acc, -1).end_byte, x.end_byte))))
        ELSE concat(acc, array(x)) END)""")
    return gathered.select("doc_id", "text_key", "n_words", merged.alias("spans"), "items", "copies").select(
        "doc_id", "text_key", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("_")).drop("_")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; see ``benchmark_hits``."""
    hits = benchmark_hits(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its hit spans."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, size: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of the text; a row of which at least
    ``drop_share`` of the words are hit goes. All columns stay; texts without hits are unchanged, null stays null.
    """
    hits = benchmark_hits(docs, benchmark, size)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    # copies of one text have the same spans: one row per text is enough
    dirty = stored(
        hits.where(F.size("spans") > 0).groupBy(F.col("text_key").alias("_text_key")).agg(
            F.first("spans").alias("_spans"), F.first(n_hit >= F.lit(drop_share) * F.col("n_words")).alias("_drop")),
        "dirty")
    names = docs.columns

    def kernel(batches):
        for batch in batches:
            text = byte_rows(batch.column("text"))
            spans = batch.column("_spans").to_pylist()
            cut = [without_spans(t, [(s["first_byte"], s["end_byte"]) for s in x]).decode("utf-8", "replace") for t, x in zip(text, spans, strict=True)]
            arrays = [pa.array(cut, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    keyed = docs.withColumn("_text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).join(dirty, "_text_key", "left")
    clean = keyed.where(F.col("_spans").isNull()).select(*names)
    mended = keyed.where(F.col("_spans").isNotNull() & ~F.col("_drop")).drop("_drop", "_text_key").mapInArrow(kernel, docs.schema)
    return clean.unionByName(mended)
