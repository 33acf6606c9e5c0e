"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made.

A piece of text starts as its bytes. The adjacent pair of the lowest rank is popped from a heap and
merged in a linked list, until no pair has a rank. The count is the number of bytes less the merges.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from leadloom.llm.common import per_step, texts
from leadloom.llm.letters import LETTER, NUMBER, OTHER, settled

#: The pattern of the vocabulary's pre-tokenizer (fixed value), the same with the library's classes for rarer letters, and for texts of ASCII only.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RARE_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|\s+(?!\S)|\s+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Pieces whose counts a Python worker remembers; beyond, it starts to remember anew.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letter:
            letter[b], extra = chr(extra), extra + 1
    return [letter[b] for b in range(256)]


class PieceCounter(dict):
    """Number of tokens by piece, counted when first asked for."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.vocabulary = made["model"]["vocab"]
        self.letters = byte_letters()
        names = self.vocabulary
        pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"])
        #: Pair of symbols -> its rank and the symbol it becomes.
        self.rank = {(names[a], names[b]): (rank, names[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.start = [names[c] for c in self.letters]
        special = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n = self.merged([self.start[b] for b in piece.encode()])
        return n

    def merged(self, symbols: list[int]) -> int:
        """Symbols left after all merges: initial symbols minus merges."""
        n = len(symbols)
        if n < 2:
            return n
        rank, after, before = self.rank, list(range(1, n + 1)), list(range(-1, n - 1))
        current, heap = [-1] * n, []
        for i in range(n - 1):
            if found := rank.get((symbols[i], symbols[i + 1])):
                current[i] = found[0]
                heap.append((found[0] << 32) | i)
        heapify(heap)
        left = n
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            if current[i] != entry >> 32:  # that pair is gone
                continue
            j = after[i]
            symbols[i] = symbol = rank[symbols[i], symbols[j]][1]
            left -= 1
            current[i] = current[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rank.get((symbol, symbols[k])):
                    current[i] = found[0]
                    heappush(heap, (found[0] << 32) | i)
            h = before[i]
            if h >= 0:
                if found := rank.get((symbols[h], symbol)):
                    current[h] = found[0]
                    heappush(heap, (found[0] << 32) | h)
                else:
                    current[h] = -1
        return left

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string inside it is one token."""
        parts = self.special.split(text) if self.special else [text]
        n = len(parts) - 1
        for part in parts:
            n += sum(map(self.__getitem__, (ASCII_PIECES if part.isascii() else PIECES if settled(part) else RARE_PIECES).findall(part)))
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `vocabulary` is the path of a byte-level BPE file on every machine. The work is one narrow pass: no
    shuffle, and a worker holds one batch and a bounded memory of pieces. Null or empty text: no bytes,
    no tokens. A very long piece costs n log n. Repeated rows, equal texts and null ids: a row each.
    Empty table: no rows. Other columns are not read.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(vocabulary).count
        column = batch.column("text")
        tokens = pa.array([count(t) for t in column.to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.binary_length(column).cast(pa.int64()), tokens, pc.greater(tokens, limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(per_step(step), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
