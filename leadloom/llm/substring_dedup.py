"""Substring deduplication with a count-min prefilter.

A window is a number of consecutive words. Every window is represented by its anchor, the shorter run
inside it with the least hash; equal windows have equal anchors. The first pass counts anchors in a
count-min sketch per partition and merges the sketches. An anchor's estimate is never below the number
of documents in which the window occurs, so a second pass takes only the windows whose anchor is
estimated to be repeated, and groups exactly these by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import steps, texts
from leadloom.llm.hashing import Sequences, mixed, word_hashes

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 50, 20
#: Rows of the sketch; counters per expected anchor in a row; the most counters of a row (bits in memory).
DEPTH, PER_ANCHOR, MOST_CELLS = 2, 8, 1 << 28
#: An anchor estimated to occur so often is hot: its windows are dealt to so many tasks.
HOT, SALTS = 1000, 32
#: A row of the sketch is merged in blocks of this many counters.
BLOCK = 1 << 18


def _positions(values: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes of all words of all texts, the text of each word, and the texts' word counts."""
    split = [v.split() for v in values]
    counts = [len(s) for s in split]
    words = [w for s in split for w in s]
    return word_hashes(words), np.repeat(np.arange(len(values)), counts), counts


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours."""
    covered = 1
    while covered * 2 <= width:
        x = np.minimum(x[:-covered], x[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Windows:
    """Windows of several texts: text and first word of each, and the anchor."""

    def __init__(self, values: list[bytes], window: int) -> None:
        hashes, text, self.counts = _positions(values, window)
        anchor = min(ANCHOR, window)
        n = len(hashes) - window + 1
        if n < 1:
            self.text = self.place = np.zeros(0, np.int64)
            self.anchors = np.zeros(0, np.uint64)
            return
        self.low = Sequences(hashes, 0)
        inside = np.flatnonzero(text[:n] == text[window - 1:])
        self.hashes, self.inside, self.window = hashes, inside, window
        self.text = text[inside]
        first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.place = inside - first[self.text]
        self.anchors = _sliding_min(self.low.runs(anchor), window - anchor + 1)[inside]

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the chosen windows."""
        at = self.inside[chosen]
        return self.low.runs(self.window)[at], Sequences(self.hashes, 1).runs(self.window)[at]


def cells(anchors: np.ndarray, width: int) -> np.ndarray:
    """Counters of each anchor, one in each row of the sketch; width is a power of two."""
    return np.stack([mixed(anchors + np.uint64(d)) & np.uint64(width - 1) for d in range(DEPTH)])


class _Seen:
    """Texts that a task has met. Of equal texts none with a larger id than one before is fresh."""

    def __init__(self) -> None:
        self.least: dict[bytes, int] = {}
        self.again: set[bytes] = set()

    def met(self, ids: list[int], values: list[bytes]) -> list[tuple[bool, bool]]:
        """Of each row whether it is fresh, and whether it is the second of its text."""
        out = []
        for i, v in zip(ids, values, strict=True):
            own = hashlib.blake2b(v, digest_size=16).digest()
            before = self.least.get(own)
            fresh, second = before is None or i <= before, before is not None and own not in self.again
            out.append((fresh, second))
            if fresh:
                self.least[own] = i
            if second:
                self.again.add(own)
        return out


def sketch(rows: DataFrame, width: int, window: int) -> tuple[bytes, np.ndarray]:
    """Of the merged sketch: a bit for each counter, set from 2 on, and the counters of at least HOT.

    A task counts a text that it meets again a second time, whatever the id, and from then on only if it is
    fresh: the anchors of any two rows reach 2 however rows are dealt to tasks and in whatever order.
    Each task sends its nonzero counters by block; the blocks are added up apart from each other, and
    only a bit of each counter comes to the driver (at most DEPTH * MOST_CELLS bits)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, gathered, held = _Seen(), [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            cell, count = np.unique(np.concatenate(gathered), return_counts=True)
            edges = np.flatnonzero(np.diff(cell // BLOCK, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(cell)], strict=True):
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(cell[a] // BLOCK)]), pa.array([(cell[a:b] % BLOCK).astype("<u4").tobytes()]), pa.array([count[a:b].astype("<u4").tobytes()])], ["block", "cell", "count"])

        for batch in batches:
            for step in steps(batch, "text"):
                ids, values = step.column("doc_id").to_pylist(), step.column("text").cast(pa.binary()).to_pylist()
                counts = [fresh or second for fresh, second in seen.met(ids, values)]
                made = Windows([v for v, c in zip(values, counts, strict=True) if c], window)
                if len(made.text):
                    new = np.concatenate([[True], (made.anchors[1:] != made.anchors[:-1]) | (made.text[1:] != made.text[:-1])])
                    own = cells(made.anchors[new], width).astype(np.int64)
                    gathered.append((own + np.arange(DEPTH)[:, None] * width).ravel())
                    held += len(gathered[-1])
                if held > 4_000_000:
                    yield from sent()
                    gathered, held = [], 0
        if gathered:
            yield from sent()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(BLOCK, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None:
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([np.packbits(total >= 2).tobytes()]), pa.array([np.flatnonzero(total >= HOT).astype("<i8").tobytes()])], ["block", "twice", "hot"])

        for batch in batches:
            for b, c, n in zip(*(batch.column(k).to_pylist() for k in ("block", "cell", "count")), strict=True):
                if b != block:
                    yield from done()
                    block, total = b, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(c, "<u4")] += np.frombuffer(n, "<u4")
        yield from done()

    parts = rows.mapInArrow(counted, "block long, cell binary, count binary").repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block long, twice binary, hot binary")
    twice, hot = bytearray(DEPTH * width // 8), []
    for r in parts.toLocalIterator():
        at = r["block"] * BLOCK // 8
        twice[at: at + BLOCK // 8] = r["twice"]
        hot.append(np.frombuffer(bytes(r["hot"]), "<i8") + r["block"] * BLOCK)
    return bytes(twice), np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.int64)


def _twice(bits: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """Whether the estimate of an anchor is at least 2."""
    out = np.ones(own.shape[1], bool)
    for d in range(DEPTH):
        at = own[d].astype(np.int64) + d * width
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def _hot(cells_: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """Whether the estimate of an anchor is at least HOT."""
    return np.all([np.isin(own[d].astype(np.int64) + d * width, cells_) for d in range(DEPTH)], 0)


def repeated_windows(rows: DataFrame, width: int, window: int, twice, hot) -> DataFrame:
    """key_hi, key_lo, salt, doc_id, place of the windows estimated to be repeated. A text that its task has
    met with a smaller id sends one row with place -1 instead: all of it is covered. For windows
    with a hot anchor every task sends its least id to each salt, place null, so that a hot window can be
    dealt to several tasks, each of which knows the least id of all."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, many = np.frombuffer(twice.value, np.uint8), hot.value
        seen, least = _Seen(), {}
        for batch in batches:
            for step in steps(batch, "text"):
                ids, values = step.column("doc_id").to_pylist(), step.column("text").cast(pa.binary()).to_pylist()
                fresh = [f for f, _ in seen.met(ids, values)]
                whole = np.array([i for i, f in zip(ids, fresh, strict=True) if not f], np.int64)
                own_ids = np.array([i for i, f in zip(ids, fresh, strict=True) if f], np.int64)
                made = Windows([v for v, f in zip(values, fresh, strict=True) if f], window)
                hi, lo, salt, doc, place, witness = [], [], [], [], [], []
                if len(made.text):
                    own = cells(made.anchors, width)
                    chosen = np.flatnonzero(_twice(two, own, width))
                    if len(chosen):
                        low, high = made.keys(chosen)
                        warm = _hot(many, own[:, chosen], width)
                        docs = own_ids[made.text[chosen]]
                        hi, lo, doc, place = [high], [low], [docs], [made.place[chosen]]
                        salt = [np.where(warm, docs % SALTS, 0)]
                        witness = [np.zeros(len(chosen), bool)]
                        if len(least) > 500_000:
                            least.clear()
                        said = []
                        for k in np.flatnonzero(warm).tolist():
                            key = (int(high[k]), int(low[k]))
                            if (d := int(docs[k])) < least.get(key, d + 1):
                                least[key] = d
                                said.append(k)
                        if said:
                            for parts, x in ((hi, high), (lo, low), (doc, docs)):
                                parts.append(np.repeat(x[said], SALTS))
                            place.append(np.zeros(len(said) * SALTS, np.int64))
                            salt.append(np.tile(np.arange(SALTS), len(said)))
                            witness.append(np.ones(len(said) * SALTS, bool))
                if len(whole):
                    for parts in (hi, lo):
                        parts.append(whole.view(np.uint64))
                    doc.append(whole)
                    place.append(np.full(len(whole), -1))
                    salt.append(np.zeros(len(whole), np.int64))
                    witness.append(np.zeros(len(whole), bool))
                if doc:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(hi).view(np.int64)), pa.array(np.concatenate(lo).view(np.int64)), pa.array(np.concatenate(salt).astype(np.int32)),
                        pa.array(np.concatenate(doc)), pa.array(np.concatenate(place).astype(np.int32), mask=np.concatenate(witness))], ["key_hi", "key_lo", "salt", "doc_id", "place"])

    return rows.mapInArrow(taken, "key_hi long, key_lo long, salt int, doc_id long, place int")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted windows those that are not in their group's first document."""
    last, first = None, 0
    for batch in batches:
        hi, lo, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key_hi", "key_lo", "doc_id"))
        salt = batch.column("salt").to_numpy(zero_copy_only=False)
        if not len(doc):
            continue
        new = np.concatenate([[last != (hi[0], lo[0], salt[0])], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (salt[1:] != salt[:-1])])
        group = np.cumsum(new)
        firsts = np.concatenate([[first], doc[new]])
        mine = firsts[group]
        place = batch.column("place")
        real = ~place.is_null().to_numpy(zero_copy_only=False)
        keep = real & ((doc > mine) | (place.fill_null(0).to_numpy(zero_copy_only=False) < 0))
        last, first = (hi[-1], lo[-1], salt[-1]), mine[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), place], ["doc_id", "place"]).filter(pa.array(keep))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, and the kept words joined by a space (or their SHA-256).

    A word goes if a window of `window` words covers it whose words also start in a document with a
    smaller id; windows are judged on the input. Windows are grouped by 128 bits of their words. Ids are
    integers. Null, empty or short text: nothing is removed. Rows that repeat an id are one document to
    each other: none is the earlier one, and each loses what the others of its id lose. Null ids: no
    window of theirs counts, and they lose nothing. Equal texts: all but that of the smallest id go. Very
    long texts are steps of their own. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    named = rows.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = 2 * (size // 6) // (window - min(ANCHOR, window) + 2)  # about six bytes a word
    width = min(MOST_CELLS, max(BLOCK, 1 << int(PER_ANCHOR * expected).bit_length()))
    twice, hot = (spark.sparkContext.broadcast(b) for b in sketch(named, width, window))
    found = repeated_windows(named, width, window, twice, hot)
    covered = found.repartition("key_hi", "key_lo", "salt").sortWithinPartitions("key_hi", "key_lo", "salt", "doc_id").mapInArrow(_covered, "doc_id long, place int")
    # Texts and the places removed from them meet by id; a text comes before its places.
    texts_ = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("int").alias("place"))
    places = covered.select("doc_id", F.lit(None).cast("string").alias("text"), "place")
    # Null ids never meet places; they are spread by their text.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    met = texts_.unionByName(places).withColumn("spread", spread).repartition("spread").sortWithinPartitions("doc_id", F.col("text").isNull(), "place")
    last = "kept_sha256" if digests else "kept"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        current, parts = None, []

        def made() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            places = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            out = []
            for text in waiting:
                own = text.split()
                gone = np.zeros(len(own) + 1, np.int64)
                if (places < 0).any():
                    if len(own) >= window:
                        gone[0], gone[-1] = 1, -1
                else:
                    inside = places[places + window <= len(own)]
                    np.add.at(gone, inside, 1)
                    np.add.at(gone, inside + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                left = b" ".join([w for w, k in zip(own, keep.tolist(), strict=True) if k]) if not keep.all() else b" ".join(own)
                out.append((len(own), int((~keep).sum()), hashlib.sha256(left).hexdigest() if digests else left.decode()))
            yield pa.RecordBatch.from_arrays([
                pa.array([current] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()),
                pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["doc_id", "n_words", "n_removed", last])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts_column = batch.column("text").cast(pa.binary())
            is_text = texts_column.is_valid().to_numpy(zero_copy_only=False)
            place = batch.column("place").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1] or is_text[i] or is_text[i - 1]], len(ids)] if ids else []
            for a, b in zip(edges, edges[1:], strict=False):
                if ids[a] is None or ids[a] != current:
                    yield from made()
                    waiting, parts, current = [], [], ids[a]
                if is_text[a]:
                    waiting.append(texts_column[a].as_py())
                else:
                    parts.append(place[a:b])
        yield from made()

    return met.select("doc_id", "text", "place").mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {last} string")
