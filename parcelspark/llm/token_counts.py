"""Exact token counts of whole texts, without keeping the tokens."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_rows, runs_by_bytes, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
PIECE_BYTES = 4 << 20  # texts are cut into pieces of about this size, always at white space
KEPT_WORDS = 200_000  # lengths remembered per worker
KEPT_BYTES = 64  # longer words are encoded each time
SPACE = re.compile(rb"[\t-\r ]")


def safe_pieces(text: bytes, limit: int = PIECE_BYTES):
    """Cut a long text at ASCII white space only; a stretch without any stays whole."""
    start = 0
    while len(text) - start > limit:
        found = SPACE.search(text, start + limit)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:] if start else text


class WordLengths(dict):
    """Number of tokens of a word; the missing words of a piece are encoded in one batch."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def encode(self, words: list[bytes]) -> list[int]:
        batch = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [len(e) for e in batch]

    def learn(self, words: set[bytes]) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()
        missing = [w for w in words if w not in self and len(w) <= KEPT_BYTES]
        for at in range(0, len(missing), 50_000):
            part = missing[at:at + 50_000]
            self.update(zip(part, self.encode(part), strict=True))

    def __missing__(self, word: bytes) -> int:
        return self.encode([word])[0]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    For tokenizers that drop white space and never let a token reach across it
    (word-level BPE with word ends), the count of a text is the sum over its
    words, so texts are split at ASCII white space, the safe boundary. Batches
    are regrouped by bytes; each group's unseen words are encoded together and
    only their lengths are remembered (a bounded number per worker).

    Null and empty texts and texts of white space only have 0 tokens; a null id stays null; repeated
    rows are counted each; an empty table gives an empty result; other columns are ignored.
    """

    def kernel(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lengths = WordLengths(Tokenizer.from_file(tokenizer_path))
        for batch in batches:
            rows = byte_rows(batch.column(1))
            counts: list[int] = []
            for a, b in runs_by_bytes(rows, PIECE_BYTES):
                if b - a == 1:
                    total = 0
                    for piece in safe_pieces(rows[a]):
                        words = piece.split()
                        lengths.learn(set(words))
                        total += sum(map(lengths.__getitem__, words))
                    counts.append(total)
                    continue
                split = [r.split() for r in rows[a:b]]
                lengths.learn(set().union(*split))
                counts += [sum(map(lengths.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_bytes": pa.array([len(r) for r in rows], pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "over_limit": pa.array([c > limit for c in counts], pa.bool_()),
            })

    return texts(docs, id_col, text_col).mapInArrow(kernel, SCHEMA)
