"""BPE encoding and decoding with a pair occurrence index.

The new words of a batch are laid out as one list of symbols. Every pair of neighbours that has a rank
is indexed by all its positions. Active ranks are applied in ascending order, each at all its positions
at once, and the positions of the pairs that a merge makes go to their own lists.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leadloom.llm.common import per_step, texts
from leadloom.llm.letters import LETTER, LOWER, NUMBER, OTHER, settled
from leadloom.llm.token_counts import byte_letters

#: The pattern of the vocabulary's pre-tokenizer (fixed value), the same with the library's classes for rarer letters, and for lower-case texts of ASCII only.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
RARE_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|{OTHER}+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+")
#: Words whose encoding a Python worker remembers, in two halves; when the newer is full, it replaces the older one.
REMEMBERED = 400_000


def normalised(text: str) -> str:
    """Composed (NFC) and lower-cased one code point at a time. White space is left: pieces do not hold it."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # str.lower() looks at neighbours for one letter only, the capital sigma.
    text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return text if settled(text) else text.translate(LOWER)


class WordBpe:
    """Encodes the words of a word-level byte vocabulary with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        names: dict[str, int] = made["model"]["vocab"]
        self.end = made["model"]["end_of_word_suffix"] or ""
        self.name = {i: n for n, i in names.items()} | {t["id"]: t["content"] for t in made["added_tokens"]}
        self.special_id = {t["content"]: t["id"] for t in made["added_tokens"]}
        special = sorted(self.special_id, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        letters = byte_letters()
        self.inner, self.last = [names[c] for c in letters], [names[c + self.end] for c in letters]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        self.rules = [(names[a], names[b], names[a + b]) for a, b in pairs]
        self.rank = {(a, b): rank for rank, (a, b, _) in enumerate(self.rules)}
        self.special_known = {s: (np.array([i], "<u4").tobytes(), s) for s, i in self.special_id.items()}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def merged(self, words: list[str]) -> list[list[int]]:
        """The symbols of each word after all merges, by the pair occurrence index over all words."""
        symbols: list[int] = []
        starts = [0]
        for word in words:
            own = word.encode()
            symbols.extend(self.inner[b] for b in own[:-1])
            symbols.append(self.last[own[-1]])
            starts.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for start in starts[:-1]:
            before[start] = -1
        for end in starts[1:]:
            after[end - 1] = -1
        rank, where = self.rank, {}
        for start, end in pairwise(starts):
            for i in range(start, end - 1):
                r = rank.get((symbols[i], symbols[i + 1]))
                if r is not None:
                    where.setdefault(r, []).append(i)
        active = list(where)
        heapify(active)

        def note(pair: tuple[int, int], i: int) -> None:
            r = rank.get(pair)
            if r is None:
                return
            if r in where:
                where[r].append(i)
            else:
                where[r] = [i]
                heappush(active, r)

        while active:
            r = heappop(active)
            a, b, new = self.rules[r]
            places = where.pop(r)
            if a == b:  # overlapping places: from left to right
                places.sort()
            for i in places:
                j = after[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:  # an earlier merge took it
                    continue
                symbols[i], symbols[j] = new, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    note((new, symbols[k]), i)
                h = before[i]
                if h >= 0:
                    note((symbols[h], new), h)
        return [[s for s in symbols[start:end] if s >= 0] for start, end in pairwise(starts)]

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not yet known, all in one index."""
        if 2 * (len(self.known) + len(words)) > REMEMBERED:  # what was used lately stays, as the older half
            self.known, self.older = {}, self.known
        self.known.update(self.special_known)
        self.known.update((w, self.older[w]) for w in words if w in self.older and w not in self.known)
        new = [w for w in words if w not in self.known]
        for word, ids in zip(new, self.merged(new), strict=True):
            self.known[word] = (np.array(ids, "<u4").tobytes(), self.decoded(ids))

    def decoded(self, ids: list[int]) -> str:
        """This vocabulary file names no decoder: decoding joins the tokens' own strings by a space."""
        return " ".join(self.name[i] for i in ids)

    def pieces(self, text: str) -> list[str]:
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.special_id:
                out.append(part)
            else:
                part = normalised(part)
                out += (ASCII_PIECES if part.isascii() else PIECES if settled(part) else RARE_PIECES).findall(part)
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split) - self.special_id.keys())
        out = []
        for words in split:
            found = [self.known[w] for w in words]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, and ids (array) with decoded text, or their SHA-256.

    `vocabulary` is the path of a BPE file with word ends on every machine. The work is one narrow pass:
    no shuffle; a worker holds one batch and a bounded memory of words. Special tokens' strings inside a
    text become their ids. Null, empty or blank text: no tokens, an empty decoded text. A very long word
    costs n log n. Repeated rows, equal texts and null ids: a row each. Empty table: no rows. Other
    columns are not read.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = encoder(vocabulary).encode(batch.column("text").to_pylist())
        tokens = pa.array([len(ids) // 4 for ids, _ in made], pa.int64())
        if digests:
            rest = [pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in made], pa.string()),
                    pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in made], pa.string())]
        else:
            offsets = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids, _ in made])]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids for ids, _ in made), "<u4").astype(np.int32))),
                    pa.array([text for _, text in made], pa.string())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens, *rest], ["doc_id", "n_tokens", *names])

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(per_step(step), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, {kinds}")
