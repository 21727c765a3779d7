"""The whole pipeline against a brute-force version of every stage."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from parcelspark.llm import quality_rules  # noqa: E402
from test_text_operators import brute_fingerprint, brute_groups, brute_stats  # noqa: E402

LICENCE = "All rights are reserved, and these terms apply to every use."


def sentence(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    leak = sentence(rng, 30)
    rows, labels = [], []
    for i in range(150):
        text = "\n".join(sentence(rng, 30) for _ in range(3)) + f"\n{LICENCE}"
        if i % 10 == 1:
            text = " ".join(w + "##" for w in text.split())
        elif i % 10 == 2:
            text = "too short"
        elif i % 10 == 3:
            text = "same words again " * 40
        elif i % 10 == 4:
            text = text.replace("\n", f"\n{leak.upper()}.\n", 1)
        elif i % 10 == 5 and rows:
            text = rows[0][1]
        rows.append((i, text, "en", f"s{i % 14}", len(text)))
        labels.append((i, int(i % 10 not in (1, 2, 3)), 0))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, leak


def kept_by_rules(spark, folder, rows):
    rules = quality_rules.learn_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules
    for row in rows:
        text = row[1] or ""
        n, chars, symbols, dup, repeated, failed = brute_stats(text)
        words = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        values = {
            "n_words": n, "word_length": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "line_repeat_share": dup / max(len(lines), 1),
            "repeat_share": repeated / max(n, 1), "distinct_share": len(set(words)) / max(n, 1), "upper_share": len(re.findall("[A-Z]", text)) / max(chars, 1),
            "mark_share": len(re.findall("[!?]", text)) / max(n, 1), "digit_share": len(re.findall("[0-9]", text)) / max(chars, 1)}
        as_rows = {k: np.array([float(v)]) for k, v in values.items()}
        if not failed and not any(r.covers(as_rows)[0] for r in rules):
            yield row


def without_common_lines(rows):
    sites, places = defaultdict(set), defaultdict(list)
    for r in rows:
        for pos, line in enumerate(r[1].split("\n")):
            if line.strip():
                sites[line.strip()].add(r[3])
                places[line.strip()].append((r[0], pos))
    for r in rows:
        kept = [x for pos, x in enumerate(r[1].split("\n")) if not x.strip() or len(sites[x.strip()]) < 10 or (r[0], pos) == min(places[x.strip()])]
        yield (r[0], "\n".join(kept), *r[2:])


def test_pipeline_equals_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows, leak = corpus
    docs = list(without_common_lines(list(kept_by_rules(spark, folder, rows))))
    prints = {r[0]: brute_fingerprint(r[1]) for r in docs}
    root = brute_groups(prints.values(), 2)
    least = {}
    for d, f in prints.items():
        least[root[f]] = min(d, least.get(root[f], d))
    docs = [r for r in docs if least[root[prints[r[0]]]] == r[0]]
    docs = [(r[0], r[1].replace(leak.upper(), ""), *r[2:]) for r in docs]
    whole = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs:
        ids = whole.encode(r[1], add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 1024):
            part = np.array(ids[at:at + 1024], "<u4")
            want[(r[0], at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    made = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in made) == want
    assert 80 < len(want) < 110  # clean documents stay; junk and copies go
    filled = defaultdict(int)
    for r in sorted(made, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024


def test_stages_keep_the_columns_of_documents(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_dedup", "decontaminate", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        assert stage(spark, docs.where("false"), folder).count() == 0
        docs = made


def test_the_core_does_not_import_these_operators():
    import pathlib

    import parcelspark

    top = pathlib.Path(parcelspark.__file__).parent
    for path in top.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("_llm_", ""), path
