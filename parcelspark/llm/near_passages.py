"""Near-duplicate passages by compact windows of min-hashes over word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, mixed, powers, runs_by_bytes, stored
from .components import components
from .crowded import crowded_intervals
from .crowded_similar import crowded_similar
from .similar_windows import Similar
from .suffixes import Extensions, covered_lengths, merge_sorted
from .words import BYTE_BASE, byte_powers, window_hashes, word_bounds, word_hashes

SHINGLE_WORDS = 5
PASSAGE_WORDS = 50
SIMILARITY = 0.8
HASHES = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)  # one odd factor per min-hash
GROUP_LIMIT = 1024
CHUNK_TOKENS = 1 << 18
NEIGHBOURS = 3
PAIRS_AT_ONCE = 4096

PLACES = "doc_id long, text_key long, start int, end int, anchor int, key long, segment long"
FOUND = "key long, doc_id long, text_key long, start int, end int, partner long, hot boolean, left binary, right binary, at int"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def compact_windows(values: np.ndarray, valid: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, node): maximal runs of starts whose ``size`` tokens have the same smallest value.

    The nodes are those of the Cartesian tree over the values whose range holds ``size`` tokens;
    of the subsequences that share a node's signature, these are the ones of ``size`` tokens.
    """
    starts = len(values) - size + 1
    ranked = (values & ~np.uint64(0xFFFFFF)) | np.arange(len(values), dtype=np.uint64)
    rows = -(-len(values) // size)
    padded = np.full(rows * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = ranked
    square = padded.reshape(rows, size)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    node = (np.minimum(behind[:starts], ahead[size - 1:size - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (valid[1:starts] != valid[:starts - 1])])
    last = np.r_[change[1:], starts] - 1
    kept = valid[change]
    return change[kept], last[kept], node[change[kept]]


def shingles(text: bytes, shingle_words: int, base_powers) -> np.ndarray:
    """Hashes of the word shingles of a lower-cased text."""
    starts, ends = word_bounds(text)
    return window_hashes(word_hashes(text, starts, ends, base_powers), shingle_words)


def _token_pieces(rows: list[bytes], shingle_words: int, size: int, base_powers):
    """(row, offset, shingle hashes), long texts in pieces that overlap by one passage."""
    for i, row in enumerate(rows):
        tokens = shingles(row.lower(), shingle_words, base_powers)
        for at in range(0, max(1, len(tokens) - size + 1), CHUNK_TOKENS):
            piece = tokens[at:at + CHUNK_TOKENS + size - 1]
            if len(piece) >= size:
                yield i, at, piece


def windows_of(rows: DataFrame, shingle_words: int, size: int) -> DataFrame:
    """One row per compact window: its place in shingles, the key (hash function and smallest value) and a digest of its shingles."""

    def kernel(batches):
        base_powers = byte_powers()
        up, down = powers(BYTE_BASE, 2 * CHUNK_TOKENS + 2 * size)
        for batch in batches:
            ids, keys = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            texts = byte_rows(batch.column(2))
            for x, y in runs_by_bytes(texts):
                pieces = list(_token_pieces(texts[x:y], shingle_words, size, base_powers))
                a = 0
                while a < len(pieces):
                    b, total = a, 0
                    while b < len(pieces) and (b == a or total + len(pieces[b][2]) <= CHUNK_TOKENS):
                        total += len(pieces[b][2])
                        b += 1
                    yield from _windows(pieces[a:b], ids[x:y], keys[x:y], size, up, down)
                    a = b

    return rows.mapInArrow(kernel, PLACES)


def _windows(own, ids, keys, size, up, down):
    tokens = np.concatenate([p[2] for p in own])
    bounds = np.cumsum([0] + [len(p[2]) for p in own])
    valid = np.zeros(len(tokens), bool)
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        valid[s:e - size + 1] = True
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[:len(tokens)], out=sums[1:])
    row_of, at_of = np.array([p[0] for p in own]), np.array([p[1] for p in own])
    for n, factor in enumerate(HASHES):
        values = mixed(tokens * np.uint64(factor) + np.uint64(n))
        first, last, node = compact_windows(values, valid, size)
        piece = np.searchsorted(bounds, first, "right") - 1
        offset, row = at_of[piece] - bounds[piece], row_of[piece]
        end = last + size
        digest = mixed(mixed((sums[end] - sums[first]) * down[first]) + ((end - first) << 16 | (node - first)).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[row], pa.int64()), pa.array(keys[row]), pa.array((first + offset).astype(np.int32)),
            pa.array((end + offset).astype(np.int32)), pa.array((node + offset).astype(np.int32)),
            pa.array(values[node].view(np.int64)), pa.array(digest.view(np.int64))],
            ["doc_id", "text_key", "start", "end", "anchor", "key", "segment"])


def _context_tokens(shingle_words: int):
    """Cut the shingles of the listed windows out of each document."""

    def kernel(batches):
        base_powers = byte_powers()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3)]
            for doc_id, text_key, own, text in zip(*columns, byte_rows(batch.column(2)), strict=True):
                tokens = shingles(text.lower(), shingle_words, base_powers)
                own = own or []
                for at in range(0, len(own), 10_000):
                    part = own[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([p["key"] for p in part], pa.int64()), pa.array([doc_id] * len(part), pa.int64()),
                        pa.array([text_key] * len(part), pa.int64()), pa.array([p["start"] for p in part], pa.int32()),
                        pa.array([p["anchor"] - p["start"] for p in part], pa.int32()),
                        pa.array([tokens[p["start"]:p["end"]].tobytes() for p in part], pa.binary())],
                        ["key", "doc_id", "text_key", "start", "before", "tokens"])

    return kernel


def neighbour_pairs(order, groups, owner):
    """(a, b) for the nearest ``NEIGHBOURS`` rows b of other owners on either side of each a in the order."""
    n = len(order)
    for line in (order, order[::-1]):
        own = owner[line]
        change = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if n else np.empty(0, np.int64)
        run_end = np.repeat(np.r_[change[1:], n], np.diff(np.r_[change, n])) if n else change
        at = cursor = np.arange(n)
        for _ in range(NEIGHBOURS):
            cursor = cursor + 1
            inside = cursor < n
            at, cursor = at[inside], cursor[inside]
            cursor = np.where(own[cursor] == own[at], run_end[cursor], cursor)
            inside = cursor < n
            at, cursor = at[inside], cursor[inside]
            same = groups[line[at]] == groups[line[cursor]]
            at, cursor = at[same], cursor[same]
            yield line[at], line[cursor]


def _joined(label, a, b):
    """Labels of nodes (each its least reachable one) after the links a, b are added."""
    label = label.copy()
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            short = label[label]
            if np.array_equal(short, label):
                break
            label = short
    return label


def similar_neighbours(data, anchor, left, right, groups, orders, size: int, similarity: float, owner, known=None):
    """(least, most, partner) for each anchor and (a, least, most, b) of further links: windows that are similar to the same window at another owner.

    Each anchor looks at near neighbours of other owners in the orders first. What they leave undecided is looked
    up among all pairs of the group: the windows of anchors that are not similar throughout, and the links
    between owners of a group that are not linked yet. So the hull of an anchor's similar windows and the classes of owners in a
    group are those of all its pairs; not every pair of a class is a link. ``known`` is (least, most, partner) of what is decided already.
    """
    n = len(anchor)
    least, most, partner = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    similar = Similar(data, anchor, left, right, size, similarity)
    node = np.unique(np.rec.fromarrays([groups, owner]), return_inverse=True)[1] if n else np.empty(0, np.int64)
    found = []

    def take(a, b):
        a, b, low, high = similar.hits(a, b)
        found.append((a, low, high, b))
        _, own = np.unique(a, return_index=True)
        fresh = own[partner[a[own]] < 0]
        partner[a[fresh]] = b[fresh]
        least[a[fresh]] = low[fresh]
        np.minimum.at(least, a, low)
        np.maximum.at(most, a, high)
        return a, b

    label = np.arange(node.max(initial=-1) + 1)
    low, high = np.full(n, size), np.full(n, -1)
    if known is not None:
        has = np.flatnonzero(known[2] >= 0)
        label = _joined(label, node[has], node[known[2][has]])
        low[has], high[has] = known[0][has], known[1][has]
    for order in orders:
        for a, b in neighbour_pairs(order, groups, owner):
            a, b = take(a, b)
            label = _joined(label, node[a], node[b])

    def hull():
        return np.where(most >= 0, np.minimum(low, least), low), np.maximum(high, most)

    def undecided():
        """Anchors with windows outside the hull of what was found."""
        lo, hi = hull()
        return (similar.highest >= 0) & ((lo > similar.lowest) | (hi < similar.highest))

    # up to NEIGHBOURS + 1 anchors of a group have all met
    at = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.empty(0, np.int64)
    sizes = np.diff(np.r_[at, n])
    apart = np.maximum.reduceat(label[node], at) != np.minimum.reduceat(label[node], at) if n else np.empty(0, bool)
    rest = (sizes > NEIGHBOURS + 1) & (apart | np.logical_or.reduceat(undecided(), at)) if n else apart
    rows = np.flatnonzero(np.repeat(rest, sizes))
    if len(rows):
        lo, hi = (v[:, None] for v in hull())
        # owners outside the largest class of their group
        own = label[node]
        order = np.lexsort((own, -np.bincount(own)[own], groups_at := np.repeat(np.arange(len(at)), sizes)))
        minor = own != own[order[at]][groups_at]
        for a, b in similar.candidates(rows, groups, (similar.before < lo) | (similar.before > hi), minor):
            asked = (owner[a] != owner[b]) & (undecided()[a] | (label[node[a]] != label[node[b]]))
            pair = np.unique(a[asked] * n + b[asked])
            for i in range(0, len(pair), PAIRS_AT_ONCE):
                a, b = np.divmod(pair[i:i + PAIRS_AT_ONCE], n)
                again = undecided()[a] | (label[node[a]] != label[node[b]])
                a, b = take(a[again], b[again])
                label = _joined(label, node[a], node[b])
    # links that the partners alone do not make
    linked = np.arange(len(label))
    for with_ in (partner, *(known[2:] if known is not None else ())):
        has = np.flatnonzero(with_ >= 0)
        linked = _joined(linked, node[has], node[with_[has]])
    further = []
    for link in found:
        for i in np.flatnonzero(linked[node[link[0]]] != linked[node[link[3]]]).tolist():
            x, y = node[link[0][i]], node[link[3][i]]
            if linked[x] != linked[y]:
                further.append([v[i] for v in link])
                linked = _joined(linked, np.array([x]), np.array([y]))
    return least, most, partner, np.array(further, np.int64).reshape(-1, 4).T


def _compare(size: int, similarity: float, limit: int):
    """Stream over windows sorted by key; a group over ``limit`` is compared in parts first, and its contexts are passed on to be compared whole, over all tasks."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32()]
    names = FOUND_NAMES

    def compared(rows, up_down):
        for at in range(0, len(rows), 2 * limit):
            yield from part_compared(rows[at:at + 2 * limit], up_down)

    def part_compared(rows, up_down):
        tokens = [np.frombuffer(r[1][5], np.uint64) for r in rows]
        data = np.concatenate(tokens)
        lengths = np.array([len(t) for t in tokens], np.int64)
        before = np.array([r[1][4] for r in rows], np.int64)
        anchor = np.cumsum(lengths) - lengths + before
        after = lengths - before
        groups = np.array([r[0] for r in rows])
        owner = np.array([r[1][1] for r in rows], np.int64)
        exact = covered_lengths(data, anchor, before, after, groups, size, up_down, owner)
        at = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[at, len(rows)])
        start_of, size_of = np.repeat(at, sizes), np.repeat(sizes, sizes)
        orders = [
            merge_sorted(Extensions(data, up_down), anchor, after, start_of, size_of)[0],
            merge_sorted(Extensions(data[::-1].copy(), up_down), len(data) - anchor, before, start_of, size_of)[0]]
        *near, further = similar_neighbours(data, anchor, before, after, groups, orders, size, similarity, owner, exact)
        place = np.array([r[1][3] for r in rows], np.int64) + before
        links = []
        for least, most, partner in (exact, near):
            own = np.flatnonzero(most >= 0)
            links.append((own, least[own], most[own], partner[own]))
        for own, least, most, partner in (*links, further):
            none = pa.array([None] * len(own), kinds[7])
            yield pa.RecordBatch.from_arrays([
                *(pa.array([rows[i][1][k] for i in own], kinds[k]) for k in range(3)),
                pa.array((place[own] - most).astype(np.int32)), pa.array((place[own] + size - least).astype(np.int32)),
                pa.array([rows[j][1][1] for j in partner], kinds[5]), pa.array(np.zeros(len(own), bool)), none, none,
                pa.array(place[own].astype(np.int32))], names)

    def passed_on(rows):
        at = pa.array([r[3] + r[4] for r in rows], kinds[3])
        left = [np.frombuffer(r[5], np.uint64)[:r[4]][::-1].tobytes() for r in rows]
        return pa.RecordBatch.from_arrays([
            *(pa.array([r[k] for r in rows], kinds[k]) for k in range(3)), at, at, pa.array([None] * len(rows), kinds[5]),
            pa.array([True] * len(rows)), pa.array(left, kinds[7]), pa.array([r[5][8 * r[4]:] for r in rows], kinds[8]), at], names)

    def kernel(batches):
        up_down = powers(BYTE_BASE, (4 * limit + 2) * 2 * size)
        waiting: list[tuple] = []
        group: list[tuple] = []
        key, number, hot = None, 0, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    if hot and group:
                        yield passed_on(group)
                    if len(group) > 1:
                        waiting += [(number, r) for r in group]
                    if len(waiting) >= limit:
                        yield from compared(waiting, up_down)
                        waiting = []
                    key, group, hot = row[0], [], False
                    number += 1
                group.append(row)
                if len(group) >= limit:
                    hot = True
                    yield passed_on(group)
                    yield from compared([(number, r) for r in group], up_down)
                    number += 1
                    group = []
        if hot and group:
            yield passed_on(group)
        if len(group) > 1:
            waiting += [(number, r) for r in group]
        if waiting:
            yield from compared(waiting, up_down)

    return kernel


def passages(
    docs: DataFrame, passage_words: int = PASSAGE_WORDS, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """doc_id, text_key, start, end (words) and partner (a doc_id) of passages with a near copy in another document.

    ``docs`` has doc_id, text_key and text. Each passage of ``passage_words`` words lies in one
    compact window per hash function; windows with the same smallest shingle hash meet. Equal
    windows are decided by counting their digests, so copies are never gathered. Windows that
    differ are sorted by their shingles to the right and to the left of the shared one:
    equal passages are found exactly, similar ones (Jaccard similarity of the shingles at
    least ``similarity``) among near neighbours in both orders, then among all pairs of the group as
    far as windows or classes are still open. Groups over ``group_limit`` are compared in parts first, and what the
    parts leave open among all pairs of the group, over all tasks (``crowded_similar``).
    """
    size = passage_words - shingle_words + 1
    places = stored(windows_of(docs.select("doc_id", "text_key", "text").where("doc_id IS NOT NULL"), shingle_words, size), "windows")
    several = (
        places.groupBy("key").agg(F.min("doc_id").alias("low_doc"), F.max("doc_id").alias("high_doc"), F.min("segment").alias("low"), F.max("segment").alias("high"))
        .where("low_doc <> high_doc").select("key", "low_doc", "high_doc", (F.col("low") == F.col("high")).alias("alike")))
    met = stored(places.join(several, "key"), "met-windows")
    # of two documents that share a window, each is the other's partner; of more, all but the first are the first one's
    other = F.when(F.col("doc_id") == F.col("low_doc"), F.col("high_doc")).otherwise(F.col("low_doc"))
    alike = met.where("alike").select("doc_id", "text_key", "start", "end", other.alias("partner"))
    different = met.where("NOT alike").drop("low_doc", "high_doc")
    segments = stored(
        different.groupBy("key", "segment").agg(
            F.min("doc_id").alias("low_doc"), F.max("doc_id").alias("high_doc"),
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "start", "end", "anchor")).alias("first"))
        .select("key", "segment", "low_doc", "high_doc", "n", "first.*"), "distinct-windows")
    shared = segments.where("low_doc <> high_doc").select("key", "segment", "low_doc", "high_doc")
    counted = different.join(shared, ["key", "segment"]).select("doc_id", "text_key", "start", "end", other.alias("partner"))
    wanted = segments.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("key", "start", "end", "anchor")).alias("places"))
    bodies = docs.select("doc_id", "text_key", "text")
    found = stored(
        bodies.join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")))
        .select("doc_id", "text_key", "text", "places").mapInArrow(_context_tokens(shingle_words), "key long, doc_id long, text_key long, start int, before int, tokens binary")
        .repartition("key").sortWithinPartitions("key", "tokens")
        .mapInArrow(_compare(size, similarity, group_limit), FOUND), "compared-windows")
    pairs = found.where("NOT hot AND partner <> doc_id").select("doc_id", "text_key", "start", "end", "partner")
    contexts = found.where("hot").select("key", "doc_id", "text_key", "at", "left", "right")
    hot = stored(crowded_intervals(contexts, size, unit=8, across=True), "crowded-passages")
    parts = found.where("NOT hot AND partner <> doc_id").select("key", "doc_id", "text_key", "at", "start", "end", "partner")
    compared = pairs.unionByName(hot).unionByName(crowded_similar(contexts, parts, hot, size, similarity))
    # a segment that only one document repeats was compared at its first place: what was found there holds at the others
    again = different.join(
        segments.where("low_doc = high_doc AND n > 1").select(
            "key", "segment", F.col("text_key").alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end")), ["key", "segment"]
    ).where("text_key <> _key OR start <> _start").select(
        F.col("doc_id").alias("_doc"), "_key", "_start", "_end", F.col("text_key").alias("own_key"), (F.col("start") - F.col("_start")).alias("moved"))
    mapped = compared.join(
        again, (F.col("doc_id") == F.col("_doc")) & (F.col("text_key") == F.col("_key")) & (F.col("start") >= F.col("_start")) & (F.col("end") <= F.col("_end"))
    ).select("doc_id", F.col("own_key").alias("text_key"), (F.col("start") + F.col("moved")).alias("start"), (F.col("end") + F.col("moved")).alias("end"), "partner")
    both = alike.unionByName(counted).unionByName(compared).unionByName(mapped)
    # from shingles to words
    return both.select("doc_id", "text_key", "start", (F.col("end") + shingle_words - 1).alias("end"), "partner")


def near_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, repeated, n_passages, n_repeated_words, passages.

    passages are the merged runs [start, end) of words that lie in a passage with a near copy in
    another document, n_links the number of documents it was matched with directly (of documents
    that share an equal window, one stands for all), class_id the smallest doc_id reachable over links.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. Null, empty and
    short texts have no passages and a class of their own; a row with a null id has no class and no
    passages; repeated rows of one document are no copies of each other; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = stored(passages(rows, **options).distinct(), "passages")
    spans = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("raw"), F.size(F.collect_set("partner")).cast("long").alias("n_links"))
    kind = "array<struct<start:int,end:int>>"
    merged = F.expr(f"""aggregate(raw, cast(array() AS {kind}), (acc, x) ->
        CASE WHEN size(acc) > 0 AND x.start <= try_element_at(acc, -1).end
        THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', try_element_at(acc, -1).start, 'end', greatest(try_element_at(acc, -1).end, x.end))))
        ELSE concat(acc, array(x)) END)""")
    per_doc = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_links", merged.alias("passages"))
    label = components(found.select(F.col("doc_id").alias("a"), F.col("partner").alias("b"))).select(F.col("node").alias("_node"), F.col("component").alias("_class"))
    out = (
        rows.select("doc_id", "text_key").join(per_doc, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
        .join(label, F.col("doc_id") == F.col("_node"), "left"))
    return out.select(
        "doc_id", F.coalesce("_class", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("passages").isNotNull().alias("repeated"), F.coalesce(F.size("passages"), F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce(F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long")).alias("n_repeated_words"),
        F.coalesce("passages", F.expr(f"cast(array() AS {kind})")).alias("passages"))
