"""SimHash fingerprints and near-duplicate groups by anchor points of a covering code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, stored, texts
from .components import components

# fixed values of the fingerprint
SEED = 42
SHINGLE_WORDS = 3

SHINGLES_AT_ONCE = 1 << 15
# Groups up to this size are compared in one piece; larger ones are split by the other half first.
GROUP_LIMIT = 4096
SMALL_GROUP = 64


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: only A-Z is lowered, and only the six ASCII spaces split
    n = len(words) - shingle_words + 1
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at:min(n, at + SHINGLES_AT_ONCE) + shingle_words - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(w), SEED) for w in zip(*(part[k:] for k in range(shingle_words)), strict=False)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def kernel(batches):
        for batch in batches:
            prints = np.array([fingerprint(t) for t in byte_rows(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(kernel, "doc_id long, fp long")


def code_masks(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the [31,26] Hamming code, what to flip in a 32-bit word to get its anchors.

    Anchors are the 32-bit words whose low 31 bits are a codeword and whose top
    bit is free: every word is at most one flip from an anchor (the covering
    radius). Row s lists the flips of up to ``reach`` bits that lead from a
    word of syndrome s to anchors; the second array has their number.
    """
    from itertools import combinations

    lists: list[list[int]] = [[] for _ in range(32)]
    for size in range(reach + 1):
        for bits in combinations(range(32), size):
            syndrome, mask = 0, 0
            for b in bits:
                mask |= 1 << b
                syndrome ^= b + 1 if b < 31 else 0
            lists[syndrome].append(mask)
    counts = np.array([len(x) for x in lists], np.int64)
    masks = np.zeros((32, counts.max()), np.uint64)
    for s, x in enumerate(lists):
        masks[s, :len(x)] = x
    return masks, counts


def anchors(half: np.ndarray, masks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``half``, anchor) of all anchors within the reach of each 32-bit word."""
    syndrome = np.zeros(len(half), np.int64)
    for b in range(31):
        syndrome ^= ((half >> np.uint64(b)) & np.uint64(1)).astype(np.int64) * (b + 1)
    n = counts[syndrome]
    which = np.repeat(np.arange(len(half)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, half[which] ^ masks[syndrome[which], nth]


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is connected inside one large group: at most one fewer than its members."""
    left = np.arange(1, len(prints))
    edges, todo = [], [0]
    while True:
        if not todo:
            if not len(left):
                return edges
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        near = np.bitwise_count(prints[left] ^ prints[at]) <= distance
        found = left[near]
        left = left[~near]
        edges += [(at, int(f)) for f in found]
        todo += found.tolist()


def linked(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        for i, j in _forest(prints[s:s + n], distance):
            a.append(prints[s + i])
            b.append(prints[s + j])
    parts_a, parts_b = [np.array(a, np.uint64)], [np.array(b, np.uint64)]
    size_of = np.repeat(sizes, sizes)
    live = np.flatnonzero((size_of > 1) & (size_of <= SMALL_GROUP))
    own = np.repeat(starts, sizes)
    chosen = np.arange(len(keys))  # within a run, the member through which one was reached first

    for shift in range(1, SMALL_GROUP):
        live = live[live + shift < len(keys)]
        live = live[own[live + shift] == own[live]]
        if not len(live):
            break
        hit = live[np.bitwise_count(prints[live] ^ prints[live + shift]) <= distance]
        # one link to each member from each of its neighbours' first members is enough to join a clique
        fresh = chosen[hit] != chosen[hit + shift]
        hit = hit[fresh]
        parts_a.append(prints[hit])
        parts_b.append(prints[hit + shift])
        chosen[hit + shift] = np.minimum(chosen[hit + shift], chosen[hit])
    return np.concatenate(parts_a), np.concatenate(parts_b)


def _compare(distance: int, limit: int | None):
    """Stream over rows sorted by key; runs over ``limit`` are passed on (hot) instead of being compared."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])

    def links(keys, prints):
        a, b = linked(keys, prints, distance)
        return pa.RecordBatch.from_arrays([
            pa.array(np.zeros(len(a), np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
            pa.array(np.zeros(len(a), bool))], schema=schema)

    def hot_rows(key, prints):
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(prints), key, np.int64)), pa.array(prints.view(np.int64)),
            pa.array(prints.view(np.int64)), pa.array(np.ones(len(prints), bool))], schema=schema)

    def kernel(batches):
        keys, prints, hot_key = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            prints = np.r_[prints, batch.column(1).to_numpy().view(np.uint64)]
            if hot_key is not None:
                n = int(np.searchsorted(keys != hot_key, True)) if (keys != hot_key).any() else len(keys)
                yield hot_rows(hot_key, prints[:n])
                keys, prints = keys[n:], prints[n:]
                if not len(keys):
                    continue
                hot_key = None
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            over = sizes > limit if limit else np.zeros(len(sizes), bool)
            whole = ~over
            whole[-1] = False  # the last run may go on in the next batch
            mask = np.repeat(whole, sizes)
            yield links(keys[mask], prints[mask])
            for s, n in zip(starts[over], sizes[over], strict=True):
                yield hot_rows(keys[s], prints[s:s + n])
            if over[-1]:
                hot_key = keys[-1]
                keys, prints = keys[:0], prints[:0]
            else:
                keys, prints = keys[starts[-1]:], prints[starts[-1]:]
        if len(keys):
            yield links(keys, prints)

    return kernel


def near_fingerprints(prints: DataFrame, distance: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) that join all fingerprints connected by pairs of up to ``distance`` (1 to 3) differing bits.

    Of two such fingerprints one 32-bit half differs in at most one bit. Each
    half is replicated to all anchors within the covering radius (1) plus that
    bit, so the two meet at the anchor nearest to either. Groups at an anchor
    hold distinct fingerprints only; one with over ``group_limit`` of them is
    split by the anchors of the other half (radius 1 plus ``distance``).
    """
    if not 1 <= distance <= 3:
        raise ValueError("distance must be 1 to 3: one half may differ in one bit only")
    near, far = code_masks(2), code_masks(1 + distance)
    low = np.uint64(0xFFFFFFFF)

    def replicate(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 20_000):
                part = fp[at:at + 20_000]
                for half, word in enumerate((part & low, part >> np.uint64(32))):
                    which, anchor = anchors(word, *near)
                    yield pa.RecordBatch.from_arrays([
                        pa.array((anchor | np.uint64(half << 32)).view(np.int64)), pa.array(part[which].view(np.int64))],
                        ["key", "fp"])

    def split(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            fp = batch.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 2_000):
                k, part = key[at:at + 2_000], fp[at:at + 2_000]
                other = np.where(k >> np.uint64(32) == 0, part >> np.uint64(32), part & low)
                which, anchor = anchors(other, *far)
                yield pa.RecordBatch.from_arrays([
                    pa.array(k[which].view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(part[which].view(np.int64))],
                    ["outer", "inner", "fp"])

    out = "key long, a long, b long, hot boolean"
    met = stored(
        prints.select("fp").distinct().mapInArrow(replicate, "key long, fp long")
        .repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare(distance, group_limit), out), "met")
    hot = met.where("hot").select("key", F.col("a").alias("fp"))
    # two keys hashed to one: a clash only brings strangers together, which the comparison tells apart
    parted = (
        hot.mapInArrow(split, "outer long, inner long, fp long")
        .select(F.xxhash64("outer", "inner").alias("key"), "fp")
        .repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare(distance, None), out)
    )
    return met.where("not hot").select("a", "b").unionByName(parted.select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one node, whatever their number, so groups of exact
    copies never meet in a task. component_id is the smallest doc_id reachable
    over links of up to ``distance`` differing bits.

    Null and empty texts have fingerprint zero and are linked like any other;
    texts with fewer words than a shingle are hashed whole; repeated rows give
    a row each; a null id is ignored as component_id (null if no other id is reachable).
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    label = components(near_fingerprints(prints, distance, group_limit))
    nodes = (
        prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        .join(label.select(F.col("node").alias("fp"), "component"), "fp", "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    )
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = nodes.join(smallest, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
