"""Align two tokenizers on the same text: byte offsets where both end a token cut the tokens into groups that match each other."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, byte_rows, runs_by_bytes, stored, texts

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
KEPT_WORDS = 400_000  # words whose ids a worker remembers
KEPT_BYTES = 64  # longer words are encoded each time
LINKS_AT_ONCE = 1 << 20
ID = np.dtype("<u4")
STRIDE = 8  # drivers between two that gallop from their coarser neighbour
# Pairs whose counts are broadcast: 16 bytes each, so never more than about 8 MB whatever the corpus.
BROADCAST_PAIRS = 500_000

# A space between two characters that are no space (here: ASCII, and U+00C0 to U+00FF after it): a byte-level BPE with
# its usual word pattern, and a sentencepiece model without pieces that reach across a space, start a new token there.
SAFE_CUT = re.compile(r"(?<=[!-~]) (?=[!-~À-ÿ])")

# Words between which a space is such a cut.
SAFE_ENDS = re.compile(r"[!-~À-ÿ](?s:.*)(?<=[!-~])\Z")
RUN_WORDS = 256  # words encoded as one text


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Place in ``long`` of the first value not less than each of ``short`` (both ascending).

    Every STRIDE-th driver is placed first (by the same rule, coarser and coarser); the others start from
    its place, double their step until they pass their value and halve the last step to find it.
    All drivers of a level move together.
    """
    n = len(short)
    if n == 0:
        return np.empty(0, np.int64)
    if n > STRIDE:
        low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[:n]
    else:
        low = np.zeros(n, np.int64)
    size = len(long)
    high, step = low.copy(), 1  # everything before ``low`` is less than the driver
    moving = np.flatnonzero(high < size)
    moving = moving[long[high[moving]] < short[moving]]
    while len(moving):
        low[moving] = high[moving] + 1
        high[moving] = np.minimum(high[moving] + step, size)
        step *= 2
        moving = moving[high[moving] < size]
        moving = moving[long[high[moving]] < short[moving]]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``a`` and in ``b`` of the values that both ascending lists hold."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    place = gallop(short, long)
    found = np.flatnonzero(place < len(long))
    found = found[long[place[found]] == short[found]]
    return (found, place[found]) if short is a else (place[found], found)


class Vocabularies:
    """Both tokenizers with the bytes, byte lengths and written ids of their entries."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 in order
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {chr(c): c for c in shown}
        alphabet |= {chr(0x100 + i): c for i, c in enumerate(c for c in range(256) if c not in set(shown))}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for text, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
        self.b_bytes, crossing = [], False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            crossing = crossing or bool(re.search("[^▁]▁", piece))
        words = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        # cutting a text is safe where no token of either side can reach across a space
        self.cuts = not crossing and words.get("type") == "ByteLevel" and words.get("use_regex", False)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

        def written(n: int, inside: str, last: str) -> np.ndarray:
            out = np.empty(2 * n, object)
            out[:] = [f"{i // 2}{last if i % 2 else inside}" for i in range(2 * n)]
            return out

        self.a_text, self.b_text = written(len(self.a_bytes), ",", "|"), written(len(self.b_bytes), ",", ";")

        # word -> its ids as bytes; and the words that the tokens of a side do not spell
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.misspelled: set[str] = set()

    def words(self, text: str) -> list[str]:
        """A text cut before spaces; a cut space is left out, as each side puts one in front of a word."""
        return (SAFE_CUT.split(text) if self.cuts else [text]) if text else []

    def spelled(self, ids: np.ndarray, entries: list[bytes]) -> bytes:
        return b"".join(map(entries.__getitem__, ids.tolist()))

    def learn(self, words: set[str]) -> list[str]:
        """Know the ids of all words; those not known are encoded in one batch. Returns the words too long to keep."""
        if len(self.known_a) > KEPT_WORDS:
            for kept in (self.known_a, self.known_b, self.misspelled):
                kept.clear()
        missing = [w for w in words if w not in self.known_a]
        if not missing:
            return []
        safe = [w for w in missing if SAFE_ENDS.match(w)] if self.cuts else []
        rest = [w for w in missing if not SAFE_ENDS.match(w)] if self.cuts else missing
        for some, in_runs in ((safe, self._in_runs), (rest, None)):
            if some:
                self._remember(some, *((in_runs and in_runs(some)) or self._one_by_one(some)))
        return [w for w in missing if len(w) > KEPT_BYTES]

    def _remember(self, words: list[str], sides: list, right: bool) -> None:
        for known, (flat, at, _) in zip((self.known_a, self.known_b), sides, strict=True):
            ids = flat.tobytes()
            places = [ID.itemsize * k for k in at]
            known.update(zip(words, [ids[p:q] for p, q in zip(places[:-1], places[1:], strict=True)], strict=True))
        if not right:
            self.misspelled.update(
                w for k, w in enumerate(words)
                if any(self.spelled(flat[at[k]:at[k + 1]], entries) != b" " + w.encode() for flat, at, entries in sides))

    def _one_by_one(self, words: list[str]):
        """(ids, places of the words in them, entries) of each side, and whether the ids spell the words."""
        sides = []
        for found, entries in (
            ([e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)], self.a_bytes),
            (self.b.encode(words, num_threads=1), self.b_bytes),
        ):
            flat = np.fromiter(chain.from_iterable(found), ID)
            sides.append((flat, np.concatenate([[0], np.cumsum([len(f) for f in found])]).tolist(), entries))
        want = "".join([" " + w for w in words]).encode()
        return sides, all(self.spelled(flat, entries) == want for flat, _, entries in sides)

    def _in_runs(self, words: list[str]):
        """The same from runs of words with a safe cut between, which both sides encode at less cost.

        None if the tokens do not spell the words or do not end with them.
        """
        runs = [" ".join(words[k:k + RUN_WORDS]) for k in range(0, len(words), RUN_WORDS)]
        want = "".join([" " + r for r in runs]).encode()
        space = np.frombuffer("".join([" " + w.replace(" ", "_") for w in words]).encode(), np.uint8) == 32
        ends = np.r_[np.flatnonzero(space)[1:], len(space)]
        sides = []
        for found, sizes, entries in (
            ([e.ids for e in self.a.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)], self.a_size, self.a_bytes),
            (self.b.encode(runs, num_threads=1), self.b_size, self.b_bytes),
        ):
            flat = np.fromiter(chain.from_iterable(found), ID)
            token_ends = np.cumsum(sizes[flat])
            at = np.searchsorted(token_ends, ends)
            if len(token_ends) == 0 or at[-1] == len(flat) or (token_ends[at] != ends).any() or self.spelled(flat, entries) != want:
                return None
            sides.append((flat, [0, *(at + 1).tolist()], entries))
        return sides, True

    def encode(self, rows: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides of each text; none where the bytes of the tokens are not those of the text."""
        split = [self.words(r.decode()) for r in rows]
        long_words = self.learn(set().union(*split))
        a_out, b_out = [], []
        for row, words in zip(rows, split, strict=True):
            a = np.frombuffer(b"".join(map(self.known_a.__getitem__, words)), ID)
            b = np.frombuffer(b"".join(map(self.known_b.__getitem__, words)), ID)
            doubtful = self.misspelled and not self.misspelled.isdisjoint(words)
            if doubtful and not (self.spelled(a, self.a_bytes) == self.spelled(b, self.b_bytes) == b" " + row):
                a, b = a[:0], b[:0]
            a_out.append(a)
            b_out.append(b)
        for w in long_words:
            del self.known_a[w], self.known_b[w]
        return a_out, b_out


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One for all tasks of a worker process."""
    return Vocabularies(a_path, b_path)


def links_of_groups(a, a_cut, b, b_cut):
    """(group, a, b) of every link, some groups at a time; a group of very many links is given as distinct ids with products of counts.

    ``a_cut`` and ``b_cut`` are the places where groups begin, with the end as the last one. Yields (group, a, b, times).
    """
    n_a, n_b = np.diff(a_cut), np.diff(b_cut)
    made = np.cumsum(n_a * n_b)
    g, groups = 0, len(n_a)
    while g < groups:
        before = made[g - 1] if g else 0
        until = max(g + 1, int(np.searchsorted(made, before + LINKS_AT_ONCE, "right")))
        if until == g + 1 and n_a[g] * n_b[g] > LINKS_AT_ONCE:
            ax, an = np.unique(a[a_cut[g]:a_cut[g + 1]], return_counts=True)
            bx, bn = np.unique(b[b_cut[g]:b_cut[g + 1]], return_counts=True)
            wide = max(1, LINKS_AT_ONCE // len(bx))
            for k in range(0, len(ax), wide):
                x, n = ax[k:k + wide], an[k:k + wide]
                yield np.full(len(x) * len(bx), g), np.repeat(x, len(bx)), np.tile(bx, len(x)), (n[:, None] * bn).reshape(-1)
        else:
            # each a token of the groups meets the b tokens of its group: repeat it, count up from the group's first b
            some = slice(a_cut[g], a_cut[until])
            group = np.repeat(np.arange(g, until), n_a[g:until])
            wide = n_b[group]
            first = np.cumsum(wide) - wide
            j = np.arange(int(wide.sum())) + np.repeat(b_cut[group] - first, wide)
            yield np.repeat(group, wide), np.repeat(a[some], wide), b[j], None
        g = until


def summed(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    distinct, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, n if times is None else np.bincount(back, weights=times, minlength=len(distinct)).astype(np.int64)


def align_block(vocab: Vocabularies, rows: list[bytes]):
    """For each text: counts of tokens, groups and links, the written groups, distinct linked pairs (a << 32 | b) and their counts."""
    a_ids, b_ids = vocab.encode(rows)
    a_n, b_n = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = (np.concatenate(ids).astype(np.int64) for ids in (a_ids, b_ids))
    # texts lie one after the other, so the end of each is a common end and no group crosses texts
    a_end, b_end = np.cumsum(vocab.a_size[a]), np.cumsum(vocab.b_size[b])
    a_at, b_at = common_ends(a_end, b_end)
    a_cut, b_cut = np.concatenate([[0], a_at + 1]), np.concatenate([[0], b_at + 1])
    groups = len(a_at)
    doc_of_group = np.searchsorted(np.cumsum(a_n), a_cut[:-1], "right")
    n_groups = np.bincount(doc_of_group, minlength=len(rows))
    links = (np.diff(a_cut) * np.diff(b_cut))
    n_links = np.bincount(doc_of_group, weights=links, minlength=len(rows)).astype(np.int64)

    a_group, b_group = np.repeat(np.arange(groups), np.diff(a_cut)), np.repeat(np.arange(groups), np.diff(b_cut))
    words = np.empty(len(a) + len(b), object)
    last = np.zeros(len(a), np.int64)
    last[a_at] = 1
    words[np.arange(len(a)) + b_cut[a_group]] = vocab.a_text[2 * a + last]
    last = np.zeros(len(b), np.int64)
    last[b_at] = 1
    words[np.arange(len(b)) + a_cut[b_group + 1]] = vocab.b_text[2 * b + last]

    keys, times = [], []
    for group, x, y, n in links_of_groups(a, a_cut, b, b_cut):
        # documents of a block, ids of both sides: one number, so one sort counts the links
        distinct, n = summed((doc_of_group[group] * len(vocab.a_bytes) + x) * len(vocab.b_bytes) + y, n)
        keys.append(distinct)
        times.append(n)
    key, times = summed(np.concatenate(keys), np.concatenate(times)) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    pair, y = np.divmod(key, len(vocab.b_bytes))
    doc, x = np.divmod(pair, len(vocab.a_bytes))
    pair = x << 32 | y
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    word_cut = np.concatenate([[0], np.cumsum(a_n + b_n)])
    for i in range(len(rows)):
        written = "".join(words[word_cut[i]:word_cut[i + 1]].tolist())[:-1]
        yield int(a_n[i]), int(b_n[i]), int(n_groups[i]), int(n_links[i]), written, pair[cut[i]:cut[i + 1]], times[cut[i]:cut[i + 1]]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its groups and its distinct linked pairs, numbered by ``row``."""

    def kernel(batches):
        from pyspark import TaskContext

        vocab = vocabularies(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), byte_rows(batch.column(1))
            for s, e in runs_by_bytes(rows, BLOCK_BYTES):
                made = list(align_block(vocab, rows[s:e]))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(range(row, row + e - s), pa.int64()),
                    "doc_id": pa.array(ids[s:e], pa.int64()),
                    **{n: pa.array([m[k] for m in made], pa.int64()) for k, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                    "groups_sha256": pa.array([hashlib.sha256(m[4].encode()).hexdigest() if m[0] else "" for m in made]),
                    "pairs": pa.array([m[5] for m in made], pa.list_(pa.int64())),
                    "times": pa.array([m[6].astype(np.int32) for m in made], pa.list_(pa.int32())),
                })
                row += e - s

    return texts(docs, id_col, text_col).mapInArrow(kernel, ALIGNED)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether n is the highest count of its first id)."""
    counts = made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", 32)), "alignment-pairs")
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # one row per id of the first vocabulary
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def frequent_from(counts: DataFrame, limit: int) -> int:
    """The least count from which on there are at most ``limit`` pairs."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("pairs")).collect()  # at most 63 rows
    total, least = 0, 62
    for size, pairs in sorted(((r["size"], r["pairs"]) for r in sizes), reverse=True):
        if total + pairs > limit:
            break
        total, least = total + pairs, size
    return 1 << least


def cross_tokenizer_links(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Align a byte-level BPE (A, on space + text) with a sentencepiece model (B, which adds the space) over a corpus.

    The shorter of the two ascending lists of token ends drives an exponential and then binary search into the
    longer; the ends found on both sides cut groups, and differences of their ranks give how many tokens of either
    side a group holds. Every A-B pair inside a group is a link. A pair's count is the number of rows of ``docs``
    that hold it linked.

    One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of
    their A id, ties included), count_sum (sum of the counts of all links), groups_sha256.

    Each row sends its distinct pairs, counted before the shuffle, to the corpus-wide count. The most frequent pairs
    (at most ``broadcast_pairs``) come back as a broadcast, so no frequent pair is a hot key of a join; all others by
    a join on the pair.

    Null and empty texts, and texts whose token bytes differ from space + text, have no tokens (zeros, empty
    groups_sha256). A null id stays null; repeated rows are rows of their own and each counts; an empty table gives an
    empty result; other columns, whatever their names, are ignored. Texts are cut at spaces that no token of either
    side crosses, and a worker encodes a word it remembers only once.
    """
    made = stored(aligned(docs, a_path, b_path, id_col, text_col), "alignment")
    counts = stored(pair_counts(made), "alignment-counts")
    common = F.col("n") >= frequent_from(counts, broadcast_pairs)
    links = made.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"))

    def totals(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    frequent = F.broadcast(counts.where(common))
    rare = links.join(frequent.select("pair"), "pair", "left_anti").join(counts.where(~common), "pair")
    sums = totals(links.join(frequent, "pair")).unionByName(totals(rare)).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return made.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
