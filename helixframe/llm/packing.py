"""Hierarchical multi-length packing of tokenised documents into windows of several context sizes.

Each task packs what it reads; nothing is shuffled. Documents (ids, then one end id) are routed to tiers by length:
whole windows' worth of a long document fill windows of their own, the rest goes to the smallest tier (window / 8, / 4, / 2,
whole) that holds it. Each tier is packed to its own context size, the longest first: a window is opened by the tier's
longest piece; the gap that it leaves is filled with the largest pieces of its own and shorter tiers that fit, then
the last gap by cutting a piece of the shortest tier that is left. So every window of a block is full but the last, whose
content is cut at powers of two: such lengths need no padding. Windows are dealt to step groups, longest first, each to the
group with the fewest tokens so far, so a task's groups differ by no more than one window.

Every id of every document lies in exactly one piece. Defined results: null text counts as empty and is its end id alone;
an empty table gives an empty table; repeated rows and rows without an id are packed each; other columns are left out.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heapify, heapreplace
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, small

WINDOW, TIERS, END, STEP = 2048, (256, 512, 1024, 2048), 1, 64
#: Bytes of text packed together (blocks hold whole documents), chunks and bytes of a chunk remembered.
BLOCK_BYTES, REMEMBERED, LONGEST = 6 << 20, 300_000, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


#: How byte-level tokenizers write bytes as letters: printable ones as themselves, the rest from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    Blanks are safe boundaries: the tokenizer drops them and never joins across them. It lower-cases, so A-Z are lowered
    first (not where a special token's string may stand). Chunks are encoded once; a point or comma after a letter is a
    token of its own, so it needs no encoding.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        #: Whether all that holds for this tokenizer, and whether words of letters can go straight to its model.
        self.simple = self._ids("Ab c, D.") == self._ids("ab") + self._ids("c") + self._ids(",") + self._ids("d") + self._ids(".")
        self.direct = all(self._word(w) == self._ids(w) for w in ("straße", "über", "cœur", "élève", "thinking", "ñandú"))
        self.known: dict[bytes, bytes] = {}

    def _word(self, word: str) -> list[int]:
        """Ids of a word of lower-case Latin letters: it is one pre-token, so only the model has work to do."""
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunks(self, text: str) -> list[bytes]:
        if not self.simple or "<|" in text:
            return text.encode().split() if self.simple else [text.encode()]
        return text.encode().lower().split()

    def _learn(self, chunks: set[bytes]) -> None:
        tails = {c: c[:-1] for c in chunks if self.simple and c[-1:] in b".," and c[-2:-1].isalpha()}
        new = (chunks.difference(tails) | set(tails.values()) | {b".", b","}).difference(self.known)
        if self.direct:
            tokenize = self.tokenizer.model.tokenize
            others = []
            for chunk in new:
                word = chunk.decode()
                if word.isalpha() and (word.isascii() or max(word) < "\u0180" and "\u0130" not in word):
                    known = tokenize(word.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))
                    self.known[chunk] = array("I", [t.id for t in known]).tobytes()
                else:
                    others.append(chunk)
            new = others
        for part in batches_of(iter(new), 1 << 18, lambda c: len(c) + 16):
            done = self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
            for chunk, e in zip(part, done, strict=True):
                self.known[chunk] = array("I", e.ids).tobytes()
        for chunk, core in tails.items():
            self.known[chunk] = self.known[core] + self.known[chunk[-1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._chunks(t) for t in texts]
        before = len(self.known)
        self._learn(set().union(*cut).difference(self.known) if cut else set())
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        if before > REMEMBERED:  # full: what comes first is what is frequent
            for c in list(islice(reversed(self.known), len(self.known) - before)):
                del self.known[c]
        else:
            for c in [c for c in islice(reversed(self.known), len(self.known) - before) if len(c) > LONGEST]:
                del self.known[c]
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(file: str) -> ChunkEncoder:
    if file not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[file] = ChunkEncoder(file)
    return _ENCODERS[file]


def tier_of(length: int) -> int:
    return next(t for t in TIERS if length <= t)


def pack(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these lengths: windows of the tiers' sizes, all full, and at
    the end some that are a power of two long."""
    done: list[list[tuple[int, int, int]]] = []
    #: The rest pieces of each tier as (length, document, start), ascending.
    tiers: dict[int, list[tuple[int, int, int]]] = {t: [] for t in TIERS}
    for d, n in enumerate(lengths):
        whole = n - n % window
        done += [[(d, s, window)] for s in range(0, whole, window)]
        if n > whole:
            tiers[tier_of(n - whole)].append((n - whole, d, whole))
    for pieces in tiers.values():
        pieces.sort()
    order = sorted(TIERS, reverse=True)
    while lead := next((t for t in order if tiers[t]), None):
        n, d, s = tiers[lead].pop()
        row, free = [(d, s, n)], lead - n
        while free:
            for t in order:  # the largest piece that fits, from the longest tier down
                if t <= lead and (k := bisect_right(tiers[t], (free, float("inf"), 0))):
                    n, d, s = tiers[t].pop(k - 1)
                    row.append((d, s, n))
                    free -= n
                    break
            else:
                break
        if free and (t := next((t for t in sorted(TIERS) if tiers[t]), None)):  # none fits: cut one of the shortest tier
            n, d, s = tiers[t].pop(0)
            row.append((d, s, free))
            insort(tiers[tier_of(n - free)], (n - free, d, s + free))
            free = 0
        done.append(row)
    if done and sum(x[2] for x in done[-1]) not in TIERS:
        done[-1:] = _at_powers(done[-1])
    return done


def deal(loads: list[tuple[int, int]], sizes: list[int]) -> list[int]:
    """A step group for each window: the one with the fewest tokens so far, longest windows first. loads: a heap of
    (tokens, group), which goes on from block to block."""
    groups = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        tokens, groups[k] = loads[0]
        heapreplace(loads, (tokens + sizes[k], groups[k]))
    return groups


def _at_powers(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A part-filled sequence as sequences whose lengths are powers of two."""
    out: list[list[tuple[int, int, int]]] = []
    left = list(reversed(row))
    total = sum(x[2] for x in row)
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        part, free = [], size
        while free:
            d, s, n = left.pop()
            take = min(n, free)
            part.append((d, s, take))
            free -= take
            if n > take:
                left.append((d, s + take, n - take))
        out.append(part)
    return out


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END) -> DataFrame:
    """One row per piece: document, start, length, crc32 of its ids, the document's ids, sequence, offset there, tier, step group.

    sequence_id is the task's number and a count, so it is unique; the tokenizer file is on every machine.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32() if "int" == x.split()[1] else pa.int64() for x in SCHEMA.split(", ")]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = encoder(tokenizer_file), TaskContext.get().partitionId()
        sequence = task << 36
        # Tasks begin at different groups, so that their last windows don't all go to the first ones.
        loads = [(0, (k + task) % STEP) for k in range(STEP)]
        heapify(loads)
        rows = ((i, t) for b in small(batches) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for block in batches_of(rows, BLOCK_BYTES, lambda r: len(r[1].encode()) + 64):
            ids = [x + end for part in batches_of((t for _, t in block), 1 << 20, len) for x in ids_of.encode(part)]
            out: list[tuple] = []
            rows_of = pack([len(x) // 4 for x in ids])
            sizes = [sum(x[2] for x in row) for row in rows_of]
            for row, total, group in zip(rows_of, sizes, deal(loads, sizes), strict=True):
                at = 0
                tier = next((t for t in TIERS if total <= t), WINDOW)
                for d, s, n in row:
                    out.append((block[d][0], s, n, zlib.crc32(ids[d][4 * s : 4 * (s + n)]), len(ids[d]) // 4, sequence, at, tier, group))
                    at += n
                sequence += 1
            for k in range(0, len(out), 20_000):
                cols = list(zip(*out[k : k + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return src.mapInArrow(run, SCHEMA)
