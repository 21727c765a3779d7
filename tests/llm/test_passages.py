"""Repeated byte strings and near-duplicate passages against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from parcelspark.llm import near_passages, repeated_bytes, suffixes  # noqa: E402
from parcelspark.llm.common import powers  # noqa: E402
from parcelspark.llm.words import BYTE_BASE  # noqa: E402

SCHEMA = "doc_id long, text string, source string, start long, key string"


def noise(rng, n, letters="abcdefghij klmno"):
    return "".join(rng.choice(letters) for _ in range(n))


def repeat_texts():
    rng = random.Random(21)
    shared, short = noise(rng, 130), noise(rng, 45)
    texts = [None, "", "tiny", noise(rng, 300), "x" * 200, "ab" * 90, noise(rng, 500) + "é日"]
    texts += [noise(rng, rng.randrange(0, 60)) + shared[rng.randrange(0, 40):rng.randrange(70, 130)] + noise(rng, rng.randrange(0, 60)) for _ in range(25)]
    texts += [noise(rng, 50) + short + noise(rng, 50) for _ in range(12)]
    copy = noise(rng, 250)
    texts += [copy] * 6
    for _ in range(8):
        edited = list(copy)
        for _ in range(3):
            edited[rng.randrange(len(edited))] = "Z"
        texts.append("".join(edited))
    return texts


def brute_repeats(texts, length):
    where = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for d, t in enumerate(data):
        for i in range(len(t) - length + 1):
            where[t[i:i + length]].append((d, i))
    gone = [set() for _ in data]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + length))
    for t, g in zip(data, gone, strict=True):
        spans = sum(1 for i in g if i - 1 not in g)
        yield len(t), len(g), spans, hashlib.sha256(bytes(b for i, b in enumerate(t) if i not in g)).hexdigest()


@pytest.mark.parametrize(("gram", "limit"), [(10, 1024), (5, 1024), (10, 4)])
def test_repeated_bytes(spark, gram, limit):
    texts = repeat_texts()
    rows = [(d, t, "s", 0, "k") for d, t in enumerate(texts)] + [(3, texts[3], None, None, None), (None, texts[6], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes.without_repeats(docs, 50, gram, limit).collect())
    want = Counter((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 50), strict=True))
    assert got == want
    assert sum(n for (_, _, removed, _, _), n in want.items() if removed) > 20


def test_repeated_bytes_of_nothing(spark):
    assert repeated_bytes.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_of_a_long_text_hold_every_window(monkeypatch):
    monkeypatch.setattr(repeated_bytes, "BLOCK_BYTES", 64)
    text = bytes(random.Random(1).randrange(97, 123) for _ in range(500))
    seen = Counter()
    for _, at, piece in repeated_bytes._pieces([text], 20):
        for i in range(min(64, len(piece) - 19)):
            seen[at + i] += piece[i:i + 20] == text[at + i:at + i + 20]
    assert seen == Counter(range(481))


def test_common_windows_of_anchors():
    up_down = powers(BYTE_BASE, 1 << 14)
    rng = random.Random(1)
    size = 12
    for trial in range(40):
        parts, groups, anchor, left, right, at = [], [], [], [], [], 0
        for group in range(rng.randrange(1, 6)):
            core = noise(rng, 6, "ab").encode()
            base = [noise(rng, 10, "ab").encode() for _ in range(2)]
            for _ in range(rng.randrange(1, 9)):
                a, b = bytearray(rng.choice(base)), bytearray(rng.choice(base))
                a[rng.randrange(10)] ^= rng.choice([0, 0, 3])
                b[rng.randrange(10)] ^= rng.choice([0, 0, 3])
                a, b = bytes(a)[rng.randrange(5):], bytes(b)[:rng.randrange(5, 11)]
                parts.append(a + core + b)
                groups.append(group)
                anchor.append(at + len(a))
                left.append(len(a))
                right.append(len(core + b))
                at += len(parts[-1])
        data = b"".join(parts)
        least, most, _ = suffixes.covered_lengths(
            np.frombuffer(data, np.uint8), *map(np.array, (anchor, left, right, groups)), size, up_down)
        for i in range(len(anchor)):
            found = [
                w for w in range(size + 1) if w <= left[i] and size - w <= right[i] and any(
                    j != i and groups[i] == groups[j] and w <= left[j] and size - w <= right[j]
                    and data[anchor[i] - w:anchor[i] - w + size] == data[anchor[j] - w:anchor[j] - w + size] for j in range(len(anchor)))]
            assert (least[i], most[i]) == ((found[0], found[-1]) if found else (-1, -1)), (trial, i)


def test_suffixes_of_large_numbers_are_sorted():
    rng = np.random.default_rng(3)
    data = rng.choice(rng.integers(0, 1 << 64, 6, dtype=np.uint64), 600)
    start = np.arange(0, 560)
    group = np.zeros(560, np.int64)
    order, common = suffixes.merge_sorted(
        suffixes.Extensions(data, powers(BYTE_BASE, 1024)), start, np.full(560, 40), group, np.full(560, 560))
    rows = [tuple(data[i:i + 40].astype(np.int64).tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(560)) and rows == sorted(rows)
    for a, b, n in zip(rows, rows[1:], common[1:], strict=False):
        assert a[:n] == b[:n] and (n == 40 or a[n] != b[n])


def test_a_false_hash_is_found_out(monkeypatch):
    """With hashes that call everything equal the result still rests on the bytes."""
    monkeypatch.setattr(suffixes.Extensions, "common", lambda self, a, b, limit: limit.copy())
    data = np.frombuffer(b"aaaaXbbbb" + b"ccccXdddd" + b"aaaaXbbzz", np.uint8)
    least, most, partner = suffixes.covered_lengths(
        data, np.array([4, 13, 22]), np.array([4, 4, 4]), np.array([5, 5, 5]), np.array([0, 0, 0]), 6, powers(BYTE_BASE, 64))
    assert most.tolist() == [4, -1, 4] and least.tolist() == [3, -1, 3] and partner.tolist() == [2, -1, 0]


def words(rng, n):
    return ["w%d" % rng.randrange(5000) for _ in range(n)]


def passage_docs():
    rng = random.Random(9)
    shared, other = words(rng, 60), words(rng, 80)
    rows = {d: words(rng, 120) for d in range(30)}
    for d in (2, 5, 9, 11):
        at = rng.randrange(100)
        rows[d] = rows[d][:at] + shared + rows[d][at:]
    for d in (14, 15):  # one changed word in 60
        changed = list(other)
        if d == 15:
            changed[40] = "changed"
        rows[d] = rows[d][:20] + changed + rows[d][20:]
    rows[20] = list(rows[21])
    rows[25] = rows[25][:30] + shared[:40] + rows[25][30:]  # too short to count
    rows[26] = rows[26][:10] + rows[26][50:110] + rows[26][10:]  # repeats inside one document only
    return rows, shared, other


@pytest.mark.parametrize("limit", [1024, 2])
def test_near_passages(spark, limit):
    rows, shared, other = passage_docs()
    data = [(d, " ".join(w), "s", 0, "k") for d, w in rows.items()]
    data += [(100, None, None, None, None), (101, "", None, None, None), (102, "just a few words", None, None, None), (None, data[2][1], None, None, None), data[3]]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    made = near_passages.near_duplicate_passages(docs, group_limit=limit).collect()
    assert len(made) == len(data)
    got = {r.doc_id: r for r in made}
    assert {d for d, r in got.items() if r.repeated} == {2, 5, 9, 11, 14, 15, 20, 21}
    assert {got[d].class_id for d in (2, 5, 9, 11)} == {2} and got[14].class_id == got[15].class_id == 14 and got[21].class_id == 20
    assert got[3].class_id == 3 and got[None].class_id is None and got[100].n_passages == 0
    for d in (2, 5, 9, 11):  # exact passages are found whole; at a similarity of 0.8 five words around them may come in on either side
        (start, end), = got[d].passages
        text = rows[d][start:end]
        assert " ".join(shared) in " ".join(text) and len(text) <= 70
    assert got[20].n_repeated_words == got[21].n_repeated_words == 120
    assert got[14].n_repeated_words >= 50 and got[15].n_repeated_words >= 50
    assert near_passages.near_duplicate_passages(docs.where("false")).collect() == []
