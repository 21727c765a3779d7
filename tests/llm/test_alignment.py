"""Alignment of two tokenizers against a version that compares offsets one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

pt = pytest.importorskip("public_tokenizers")

from parcelspark.llm import token_alignment  # noqa: E402
from parcelspark.llm.token_alignment import Vocabularies, common_ends, cross_tokenizer_links, gallop  # noqa: E402

A, B = pt.path("byte_bpe_50k.json"), pt.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_groups(tools, text):
    """[(a ids, b ids)] of one text, by walking both token lists."""
    a, b = tools
    if not text:
        return []
    want = (" " + text).encode()
    alphabet, extra = {}, 0
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte:
            alphabet[chr(byte)] = byte
        else:
            alphabet[chr(256 + extra)] = byte
            extra += 1
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_tokens = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a_ids]
    b_tokens = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        b_tokens.append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(t for _, t in a_tokens) != want or b"".join(t for _, t in b_tokens) != want:
        return []
    groups, i, j, at_a, at_b, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(a_tokens) or j < len(b_tokens):
        if at_a <= at_b:
            ga.append(a_tokens[i][0])
            at_a += len(a_tokens[i][1])
            i += 1
        else:
            gb.append(b_tokens[j][0])
            at_b += len(b_tokens[j][1])
            j += 1
        if at_a == at_b:
            groups.append((ga, gb))
            ga, gb = [], []
    return groups


def brute(tools, docs):
    made = [(d, brute_groups(tools, t)) for d, t in docs]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, g in made]
    count = Counter(p for c in links for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (d, groups), c in zip(made, links):
        written = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((
            d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(c.values()),
            sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def found(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def awkward():
    rng = random.Random(4)
    letters = "ab  \n\t'é漢字🙂ﬁ▁́ <s></s><unk>09.,"
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " "), (503, "<|endoftext|> and <s>"), (504, "<0x41>"), (505, "a" * 3000), (506, " " * 700 + "x"),
             (None, "no id"), (507, "twice"), (507, "twice"), (508, "▁word"), (509, "日本語のテキスト" * 40), (510, "\x00\x07")]
    return docs


def test_equals_a_walk_over_both_lists(spark, tools, monkeypatch):
    docs = awkward()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, pairs string").repartition(4)
    want = brute(tools, docs)
    assert found(cross_tokenizer_links(df, A, B)) == want
    # no pair or only some pairs broadcast: the same counts
    for limit in (0, 40):
        assert found(cross_tokenizer_links(df, A, B, broadcast_pairs=limit)) == want
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", 7)
    vocab, made = Vocabularies(A, B), []
    for _, text in docs:
        made += list(token_alignment.align_block(vocab, [(text or "").encode()]))
    assert sum(int(m[6].sum()) for m in made) == sum(w[4] for w in want)


def test_supplied_documents(spark, tools):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = [(r["doc_id"], r["text"]) for r in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(cross_tokenizer_links(df, A, B)) == brute(tools, docs)


def test_empty_table(spark):
    assert cross_tokenizer_links(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_galloping_finds_the_place_of_every_value():
    rng = np.random.default_rng(7)
    for n, m, top in ((0, 5, 9), (5, 0, 9), (1, 1, 2), (200, 5000, 6000), (5000, 200, 6000), (700, 700, 800), (3, 100_000, 200_000)):
        a, b = (np.sort(rng.choice(np.arange(top), min(k, top), replace=False)) for k in (n, m))
        assert gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
        x, y = common_ends(a, b)
        assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()


def test_words_give_the_tokens_of_whole_texts(tools):
    vocab = Vocabularies(A, B)
    assert vocab.cuts
    rng = random.Random(8)
    letters = "ab é漢🙂ÿ×\u00a0\u3000'.,9 \t\n"
    texts = [t for _, t in awkward() if t] + ["".join(rng.choice(letters) for _ in range(40)) for _ in range(2000)]
    texts.append("plain words 123 and more, words  with spaces and  \n newlines " * 20)
    a_ids, b_ids = vocab.encode([t.encode() for t in texts])
    for text, x, y in zip(texts, a_ids, b_ids):
        groups = brute_groups(tools, text)
        assert x.tolist() == [i for g, _ in groups for i in g] and y.tolist() == [i for _, g in groups for i in g], text
    assert len(vocab.words(texts[-1])) > 50


def test_words_encoded_in_runs_have_the_ids_of_words_alone():
    import public_tokenizers

    from parcelspark.llm import token_alignment as t

    vocab = t.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    words = ["plain", "a", "Ünder!", "<|endoftext|>", "x1.5e-3", "don't", "tab\tinside", "two  spaces", "naïve.", "end▁x", "12345678901234567890"] * 40
    words += [f"w{k}" for k in range(700)]
    safe = [w for w in words if t.SAFE_ENDS.match(w)]
    run, alone = vocab._in_runs([w for w in safe if "▁" not in w and "  " not in w and "\t" not in w]), vocab._one_by_one(
        [w for w in safe if "▁" not in w and "  " not in w and "\t" not in w])
    for (ids, at, _), (ids2, at2, _) in zip(run[0], alone[0], strict=True):
        assert ids.tolist() == ids2.tolist() and list(at) == list(at2)
    # words that the tokens do not spell are left to the way one by one
    assert vocab._in_runs(["good", "end▁x"]) is None
    assert not t.SAFE_ENDS.match(" x") and not t.SAFE_ENDS.match("line\n") and not t.SAFE_ENDS.match("łaska")
