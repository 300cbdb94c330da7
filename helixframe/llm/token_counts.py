"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, places no token of the vocabulary can span: in front of a blank that follows another
character, as the vocabulary has blanks only at the start of a piece (checked when the model is loaded; otherwise texts
are encoded whole). Long and short texts alike so become short chunks; equal chunks of a batch are encoded once, in batches
balanced by bytes, and a worker remembers chunks up to a bounded number. The sum of the chunks' lengths is the length of
the text's encoding.

Defined results: null text counts as empty and has 0 tokens; other columns are left out; an empty table gives an empty
table; repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, small

#: Bytes of text that a worker encodes at a time, chunks that it remembers, and bytes of the longest it remembers.
BATCH_BYTES, REMEMBERED, LONGEST = 1 << 20, 400_000, 64
_SAFE = re.compile("(?<=[^ ▁])[ ▁](?=.)", re.DOTALL)


class ChunkCounter:
    """Counts the tokens of texts with a sentencepiece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, int] = {}

    def chunks(self, text: str) -> list[str]:
        if not self.safe:
            return [text]
        if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
            return _SAFE.split(text)
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.chunks(t) for t in texts]
        new = set().union(*cut).difference(self.known) if cut else set()
        if new:
            for part in batches_of(iter(new), BATCH_BYTES, len):
                self.known.update(zip(part, map(len, self.model.encode(part, num_threads=1)), strict=True))
        get = self.known.__getitem__
        out = [sum(map(get, c)) for c in cut]
        full = len(self.known) > REMEMBERED  # what comes first is what is frequent
        for c in new:
            if full or len(c) > LONGEST:
                del self.known[c]
        return out


_COUNTERS: dict[str, ChunkCounter] = {}


def counter(model_file: str) -> ChunkCounter:
    """One counter a worker process."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = ChunkCounter(model_file)
    return _COUNTERS[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens (no added tokens) and over_limit of each row. The model file is on every machine."""
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"{id_col} {dict(src.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_file)
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            size = [len(t.encode()) for t in texts]
            n: list[int] = []
            for part in batches_of(iter(zip(texts, size, strict=True)), BATCH_BYTES, lambda x: x[1]):
                n += tokens.count([t for t, _ in part])
            counts = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), counts, pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(lengths, schema)
