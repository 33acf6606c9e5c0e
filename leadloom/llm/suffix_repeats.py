"""Repeated byte strings from enhanced suffix arrays, with all their occurrences.

Strings of `length` bytes that start at two or more places are found in three steps. Every such string has an
anchor: the run of ANCHOR bytes inside it with the least hash. Equal strings have equal anchors at equal
offsets, so all places of a string meet under its anchor; only anchors that occur twice are followed. The
places of an anchor form one small generalised suffix array: the suffixes that start in the anchor's range,
ordered by their first `length` bytes and then by what follows, with common prefix lengths and the byte
before each suffix. A stack scan over the common prefixes yields the tree of prefix intervals; an interval
whose suffixes are preceded by different bytes is a maximal repeat, and its leaves are its occurrences.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import steps
from leadloom.llm.hashing import BASES, mixed
from leadloom.sources.tables import materialize, new_path

#: Bytes of a repeat, and of an anchor.
LENGTH, ANCHOR = 400, 100
#: Bytes hashed in one step; places of an anchor that one suffix array takes; bytes of suffix arrays built in one step.
PIECE, TOGETHER, GATHERED = 1 << 20, 2048, 2_000_000
#: A number for each byte.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))


class ByteRuns:
    """Hashes of all runs of k bytes of a buffer."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        n, base = len(data), BASES[which]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, base, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power)])

    def at(self, starts: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[starts + k] - self.sums[starts]) * self.inverse[starts])

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[: n - k + 1])


def _pieces(values: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in groups of about PIECE bytes; of a longer text pieces that overlap, so that each string lies in one."""
    held, size = [], 0
    for k, v in enumerate(values):
        for start in range(0, max(1, len(v) - length + 1), PIECE):
            part = v[start: start + PIECE + length - 1] if len(v) > PIECE else v
            if len(part) < length:
                continue
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((k, start, part))
            size += len(part)
    if held:
        yield held


def anchors(values: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """text, key, place, first, starts of all anchors: the strings that start at first ... first + starts - 1 have
    their least run of bytes, the leftmost of equal ones, at `place`."""
    run = min(ANCHOR, length)
    for group in _pieces(values, length):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        sizes = np.array([len(p) for _, _, p in group])
        begin = np.cumsum(sizes) - sizes
        keys = ByteRuns(data).all(run)
        # The upper bits of a hash with its place below: the least is the leftmost of the least.
        ranked = (keys & np.uint64((1 << 64) - (1 << 24))) | np.arange(len(keys), dtype=np.uint64)
        covered, width = 1, length - run + 1
        while covered * 2 <= width:
            ranked = np.minimum(ranked[:-covered], ranked[covered:])
            covered *= 2
        if rest := width - covered:
            ranked = np.minimum(ranked[: len(ranked) - rest], ranked[rest:])
        counts = sizes - length + 1
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        least = (ranked[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(group)), counts)
        edges = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
        starts = np.diff(np.append(edges, len(at)))
        own = owner[edges]
        text, offset = (np.array([g[k] for g in group])[own] for k in (0, 1))
        yield text, keys[least[edges]].view(np.int64), least[edges] - begin[own] + offset, at[edges] - begin[own] + offset, starts


def _distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """text_id (128 bits), text, copies of the distinct texts, bucketed by id: later joins by id move no text again.
    Copies are combined before the shuffle."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.md5(text.cast("binary")).alias("text_id"), text.alias("text"))
    found = rows.groupBy("text_id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name, path = f"texts_{uuid.uuid4().hex}", new_path(spark, "texts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.write.bucketBy(buckets, "text_id").option("path", path).format("parquet").saveAsTable(name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the plan holds files and buckets
    return texts


def _anchor_counts(length: int):
    """text_id, anchor, times: how often an anchor stands in a text and its copies."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                ids, copies = step.column("text_id"), step.column("copies").to_numpy()
                for text, key, *_ in anchors(step.column("text").cast(pa.binary()).to_pylist(), length):
                    order = np.lexsort((key, text))
                    text, key = text[order], key[order]
                    edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]))
                    times = np.diff(np.append(edges, len(key))) * copies[text[edges]]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text[edges])), pa.array(key[edges]), pa.array(times)], ["text_id", "anchor", "times"])

    return counted


_MEMBERS = pa.list_(pa.struct([("text_id", pa.string()), ("first", pa.int32())]))


def _contexts(length: int):
    """What stands around repeated anchors: anchor, part, context (the bytes of all strings of the anchor's range, up
    to where the last one could end), starts, times, members. Equal contexts of one step are one row."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                ids, copies, values = step.column("text_id").to_pylist(), step.column("copies").to_pylist(), step.column("text").cast(pa.binary()).to_pylist()
                wanted = [dict(zip((w["anchor"] for w in row), (w["total"] for w in row), strict=True)) for row in step.column("wanted").to_pylist()]
                rows: dict[tuple, list] = {}
                for arrays in anchors(values, length):
                    for text, key, place, first, starts in zip(*(x.tolist() for x in arrays), strict=True):
                        if total := wanted[text].get(key):
                            held = rows.setdefault((key, values[text][first: place + length], starts), [total, 0, []])
                            held[1] += copies[text]
                            held[2].append({"text_id": ids[text], "first": first})
                if rows:
                    parts = [-(-total // TOGETHER) for total, _, _ in rows.values()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k for k, _, _ in rows], pa.int64()), pa.array([int(m[0]["text_id"][:8], 16) % n for (_, _, m), n in zip(rows.values(), parts, strict=True)], pa.int32()),
                        pa.array(parts, pa.int32()), pa.array([c for _, c, _ in rows], pa.binary()), pa.array([s for _, _, s in rows], pa.int32()),
                        pa.array([t for _, t, _ in rows.values()], pa.int64()), pa.array([m for _, _, m in rows.values()], _MEMBERS)],
                        ["anchor", "part", "parts", "context", "starts", "times", "members"])

    return taken


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def prefix_intervals(prefixes: list[int], before: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats of a sorted list of suffixes, parents first: prefix length, first and last suffix, parent (-1: none).

    prefixes[i] is what suffix i has in common with suffix i - 1 (prefixes[0] is not used), before[i] the byte before
    suffix i, -1 where the scan does not look further to the left. An interval is kept if it is at least `least` long
    and the bytes before its suffixes differ, or one of them is -1.
    """
    found: list[list] = []
    stack: list[list] = []  # prefix length, first suffix, byte before all of them (None: they differ), kept children

    def joined(x, y):
        return x if x == y and x != -1 else None

    for i in range(1, len(before) + 1):
        now = prefixes[i] if i < len(before) else 0
        lo, left, below = i - 1, before[i - 1] if before[i - 1] != -1 else None, []
        while stack and stack[-1][0] > now:
            length, first, byte, children = stack.pop()
            byte, children = joined(byte, left), children + below
            lo, left = first, byte
            below = children
            if byte is None:
                found.append([length, first, i - 1, -1])
                for child in children:
                    found[child][3] = len(found) - 1
                below = [len(found) - 1]
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = joined(stack[-1][2], left)
                stack[-1][3] += below
            else:
                stack.append([now, lo, left, below])
    last = len(found) - 1
    return [(n, a, b, last - p if p >= 0 else -1) for n, a, b, p in reversed(found)]


class _Out:
    """Columns of occurrences and of strings that other parts of the anchor must be asked for."""

    NAMES = ["text_id", "start", "length", "repeat", "parent", "high", "low", "times"]

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in self.NAMES]

    def add(self, *row) -> None:
        for column, x in zip(self.columns, row, strict=True):
            column.append(x)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], self.NAMES)


def _repeats(rows: list[tuple], length: int, out: _Out) -> None:
    """Suffix arrays of several anchors at once. A row is anchor group, parts, context, starts, times, members."""
    group, parts, contexts, starts, times, members = zip(*rows, strict=True)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes, starts, times = (np.array(x, np.int64) for x in ([len(c) for c in contexts], starts, times))
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), starts)
    offset = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    at = base[row] + offset
    runs = ByteRuns(data)
    prefix = runs.at(at, length)
    name = mixed(prefix ^ mixed(np.array(group, np.int64).view(np.uint64) + np.uint64(1))[row])
    order = np.argsort(name, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    total = np.add.reduceat(times[row[order]], edges)
    before = np.where(offset > 0, data[np.maximum(at - 1, 0)], 255).astype(np.int64)
    cut = np.bitwise_or.reduceat(offset[order] == 0, edges)
    differ = np.minimum.reduceat(before[order], edges) != np.maximum.reduceat(before[order], edges)
    ends = np.append(edges[1:], len(order))
    for k in np.flatnonzero((total >= 2) & (cut | differ)).tolist():
        own = order[edges[k]: ends[k]].tolist()
        suffixes = sorted((contexts[row[w]][offset[w]:], int(row[w]), int(offset[w])) for w in own)
        # A context that occurs several times is two leaves with all in common.
        leaves = [s for s in suffixes for _ in range(1 + (times[s[1]] > 1))]
        texts = [s[0] for s in leaves]
        lcp = [0, *(common_prefix(a, b) for a, b in zip(texts, texts[1:], strict=False))]
        left = [contexts[r][o - 1] if o else -1 for _, r, o in leaves]
        nodes = prefix_intervals(lcp, left, length)
        if not nodes:
            continue
        deepest = np.full(len(leaves), -1)
        digests = [hashlib.blake2b(texts[a][:n], digest_size=16).digest() for n, a, _, _ in nodes]
        for i, (_, a, b, _) in enumerate(nodes):
            deepest[a: b + 1] = i
        said = set()
        for (_, r, o), i in zip(leaves, deepest.tolist(), strict=True):
            if i >= 0 and r not in said:
                said.add(r)
                n, _, _, parent = nodes[i]
                for m in members[r]:
                    out.add(m["text_id"], m["first"] + o, n, digests[i], digests[parent] if parent >= 0 else None, None, None, None)
    dealt = np.array(parts, np.int64) > 1
    asked = np.flatnonzero(dealt[row[order[edges]]])
    if len(asked):
        one = order[edges[asked]]
        low = ByteRuns(data, 1).at(at[one], length).view(np.int64).tolist()
        high = prefix[one].view(np.int64).tolist()
        for w, h, lo, n in zip(one.tolist(), high, low, np.minimum(total[asked], 2).tolist(), strict=True):
            m = members[row[w]][0]
            out.add(m["text_id"], m["first"] + int(offset[w]), length, None, None, h, lo, n)


def _scanned(length: int):
    """Occurrences of the maximal repeats of sorted contexts. The rows of an anchor's part come together."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, number = [], 0, None, 0

        def made() -> Iterator[pa.RecordBatch]:
            out = _Out()
            _repeats(held, length, out)
            if out.columns[0]:
                yield out.batch()

        for batch in batches:
            for step in steps(batch, "context", GATHERED):
                columns = [step.column(c).to_pylist() for c in ("anchor", "part", "parts", "context", "starts", "times", "members")]
                for anchor, part, parts, context, starts, times, members in zip(*columns, strict=True):
                    if (anchor, part) != last:
                        if size > GATHERED:
                            yield from made()
                            held, size = [], 0
                        last, number = (anchor, part), number + 1
                    held.append((number, parts, context, starts, times, members))
                    size += len(context)
        if held:
            yield from made()

    return scanned


def _found(texts: DataFrame, length: int) -> DataFrame:
    """text_id, start, length, repeat, parent of all occurrences, by text."""
    counted = materialize(texts.mapInArrow(_anchor_counts(length), "text_id string, anchor long, times long"), "anchors")
    again = counted.groupBy("anchor").agg(F.sum("times").alias("total")).filter("total > 1")
    wanted = counted.join(again, "anchor").groupBy("text_id").agg(F.collect_list(F.struct("anchor", "total")).alias("wanted"))
    contexts = texts.join(wanted, "text_id").select("text_id", "text", "copies", "wanted").mapInArrow(
        _contexts(length), "anchor long, part int, parts int, context binary, starts int, times long, members array<struct<text_id:string,first:int>>")
    scanned = contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(
        _scanned(length), "text_id string, start int, length int, repeat binary, parent binary, high long, low long, times long")
    scanned = materialize(scanned, "repeats")
    # Strings of an anchor that was dealt in parts: those single in their part meet those of the others.
    parts = scanned.filter("times is not null")
    several = parts.groupBy("high", "low").agg(F.sum("times").alias("total")).filter("total > 1")
    name = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("high", "low"))))
    across = parts.filter("times = 1").drop("times").join(several, ["high", "low"]).select("text_id", "start", "length", name.alias("repeat"), F.lit(None).cast("binary").alias("parent"))
    return scanned.filter("times is null").select("text_id", "start", "length", "repeat", "parent").unionByName(across)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_id"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """repeat, parent, length, doc_id, start: the occurrences of all maximal repeats of at least `length` bytes.

    A row stands for the longest repeat of its place; the occurrences of a repeat are its own rows and those of the
    repeats that name it as parent. A repeat that runs over several anchors is given as a chain of overlapping pieces,
    each with all its occurrences. The strings of an anchor with more than TOGETHER places are scanned in parts: the pieces of
    a part list the places in it, and a string that is single in its part, but not in all, is listed alone with `length` bytes.
    """
    found = _found(_distinct_texts(docs, text_col), length)
    return _named(docs, id_col, text_col).join(found, "text_id").select("repeat", "parent", "length", "doc_id", "start")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, and the bytes left (or their SHA-256).

    Every byte that an occurrence of a maximal repeat covers goes, in all its places, in other texts and the same one;
    occurrences may overlap, and are judged on the input. Strings are compared byte by byte (those of anchors dealt in
    parts by 128 bits); they do not cross texts.

    Equal texts, rows that repeat an id or have none: each row is a text of its own, so a text of at least
    `length` bytes that stands in two rows is removed from both. Null, empty and shorter texts: nothing goes. Very long
    texts are hashed in pieces. Empty table: no rows. Other columns are not read.
    """
    texts = _distinct_texts(docs, text_col)
    spans = _found(texts, length).groupBy("text_id").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    last = "kept_sha256" if digests else "kept"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                spans_ = step.column("spans")
                flat, offsets = spans_.flatten(), np.concatenate([[0], np.cumsum(np.nan_to_num(spans_.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
                start, size = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                out = []
                for k, value in enumerate(step.column("text").cast(pa.binary()).to_pylist()):
                    a, n = start[offsets[k]: offsets[k + 1]], size[offsets[k]: offsets[k + 1]]
                    order = np.argsort(a)
                    a, reach = a[order], np.maximum.accumulate((a + n)[order]) if len(a) else a
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]])) if len(a) else []
                    begins, ends = (a[new].tolist(), reach[np.append(new[1:], len(a)) - 1].tolist()) if len(a) else ([], [])
                    left = b"".join(value[x:y] for x, y in zip([0, *ends], [*begins, len(value)], strict=True))
                    out.append((len(value), len(value) - len(left), len(begins), hashlib.sha256(left).hexdigest() if digests else left))
                yield pa.RecordBatch.from_arrays([step.column("text_id"), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.string() if digests else pa.binary())],
                                                 ["text_id", "n_bytes", "n_removed", "n_spans", last])

    made = texts.join(spans, "text_id", "left").select("text_id", "text", "spans").mapInArrow(
        cut, f"text_id string, n_bytes long, n_removed long, n_spans long, {last} {'string' if digests else 'binary'}")
    return _named(docs, id_col, text_col).join(made, "text_id").select("doc_id", "n_bytes", "n_removed", "n_spans", last)
