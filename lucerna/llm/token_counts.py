"""Token counts by the whole-token shortcut.

Offline proof, from the vocabulary alone: no piece holds a word mark after another character, so merges never cross
the place before a word mark and each pre-token (word marks, then characters up to the next one) can be counted by
itself; and each vocabulary string that the library encodes alone as one token is kept as such. Pre-tokens among
those are counted directly, the others are merged by the library once and remembered in a store of bounded size.

Null and empty texts have no tokens. Texts of any length are counted whole; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def load_model(model: str):
    """model: a file name in the folder of public tokenizers, or a path."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))


def whole_tokens(library) -> dict[str, int]:
    """Pre-tokens, without their first mark, that are proved to be one token; also proves that pre-tokens are independent."""
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece spans two pre-tokens: they can't be counted by themselves")
    words = [p[1:] for p in pieces if p.startswith(MARK)]
    return {w: 1 for w, ids in zip(words, library.encode([w.replace(MARK, " ") for w in words], num_threads=1), strict=True) if len(ids) == 1}


class PreTokenCounts(dict):
    """Tokens of a pre-token, given without its first mark."""

    def __init__(self, library, proved: dict[str, int], limit: int = 300_000):
        super().__init__(proved)
        self.library, self.proved, self.limit = library, proved, limit + len(proved)

    def __missing__(self, word: str) -> int:
        # A mark alone, which ends a text, is seen behind another word: by itself the library would see an empty text.
        n = len(self.library.encode(word.replace(MARK, " "))) if word else len(self.library.encode("a ")) - len(self.library.encode("a"))
        if len(word) > 200:
            return n
        if len(self) >= self.limit:
            self.clear()
            self.update(self.proved)
        self[word] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return sum(self[p[1:]] for p in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)))
        return sum(map(self.__getitem__, text.split(" ")))


def count_tokens(docs: DataFrame, model: str, limit: int) -> DataFrame:
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(load_model(model)))  # as large as the vocabulary at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PreTokenCounts(load_model(model), proved.value)
        for b in slices(batches):
            n = pa.array([counts.of(t) for t in b.column("text").to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", 4096)
