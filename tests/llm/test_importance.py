"""Importance resampling against a word-by-word version with the library's CRC."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from parcelspark.llm import importance
from parcelspark.llm.importance import SpanCrc, drawn_documents, importance_draw

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = WORDS.findall((text or "").encode().lower())
    return len(words), [zlib.crc32(b" ".join(words[i:i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, share=5, least=20):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for x in docs:
        np.add.at(s, brute_features(x[1])[1], 1)
    for x in target:
        np.add.at(t, brute_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        n, found = brute_features(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[:share * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(n):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeÄßé漢9") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    docs = [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(vocabulary).upper() for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,\t"), (None, docs[3][1] * 3), (n + 3, "w" * 3000 + " " + "v" * 700 + " x y z " * 9)]
    docs += [(5, " ".join(vocabulary[:40]))] * 40  # one id with many rows
    return docs, [" ".join(rng.choice(vocabulary[:50]) for _ in range(30)) for _ in range(20)] + [None, ""]


def test_spans_have_the_checksums_of_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    for reach in (4, 16, 256):
        starts = rng.integers(0, 4000, 300)
        ends = starts + np.concatenate([rng.integers(1, 40, 280), rng.integers(200, 1000, 20)])
        assert SpanCrc(reach)(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_equals_a_version_word_by_word(spark):
    docs, target = corpus(400)
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, score string, _out int").repartition(6)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    made = importance_draw(df, bench)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in made.collect()), key=repr)
    want = brute(docs, target)
    # rows of one id with equal texts are alike; which of them has which rank is open
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert sorted((g[4] or 0, g[0] or -1) for g in got) == sorted((w[4] or 0, w[0] or -1) for w in want)
    ids = {g[0] for g in got if g[4]}
    assert {r.doc_id for r in drawn_documents(df, made).collect()} == ids - {None}
    assert drawn_documents(df, made).columns == df.columns


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_BYTES", 64)
    rng = random.Random(2)
    docs = [(i, " ".join("".join(rng.choice("abcz") for _ in range(rng.randrange(1, 30))) for _ in range(80))) for i in range(30)] + [(99, "q" * 500)]
    for text in [d[1] for d in docs]:
        total = []
        for _, part, had in importance.blocks([text.encode()]):
            total += importance.feature_buckets(SpanCrc(), part, 10_000, had)[1].tolist()
        assert sorted(total) == sorted(brute_features(text)[1])


def test_empty_tables(spark):
    docs, target = corpus(30)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert importance_draw(df.where("false"), bench).count() == 0
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance_draw(df, bench.where("false")).collect()), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in brute(docs, [])]
