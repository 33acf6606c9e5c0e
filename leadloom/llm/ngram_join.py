"""Similarity join on word shingles with R-trees over group counts.

A document's shingles are hashed into groups; the counts of the groups are a point. The sum of the
coordinates' minima of two points bounds the shingles that two documents can share, and the maxima of
a tree node bound all points below it. Points have as many groups as their document needs, a power of
two, and a finer point folds into a coarser one. An R-tree over all documents would still compare
unrelated documents of one size with each other, as their counts hardly differ; so a tree is built for
documents that share one of their rarest shingles, of which two similar documents share at least one.
Pairs that the trees do not rule out are verified by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import steps
from leadloom.llm.components import components
from leadloom.llm.hashing import Sequences, mixed, word_hashes
from leadloom.sources.tables import discard, materialize

#: Words of a shingle; shingles in a group on average, at most; groups of a point, at least.
WORDS, FILL, LEAST_GROUPS = 5, 4, 256
#: Frequent shingles that are put last in the order of rarity; a shingle missing here costs time, not links.
FREQUENT = 50_000
#: A task reports shingles that so many documents of one step have.
REPORTED = 4
#: Points of a tree node; rows of a bucket that one task compares with each other; parts of a document's pairs.
FAN, BLOCK, PARTS = 16, 20_000, 16
#: Bits of the bitmap of nodes, at most (32 MB).
MOST_BITS = 1 << 28


def shingle_sets(values: list[bytes]) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; a text of fewer words is one shingle."""
    split = [v.lower().split() for v in values]
    counts = np.array([len(s) for s in split], np.int64)
    hashes = word_hashes([w for s in split for w in s])
    runs = Sequences(hashes).runs(WORDS)
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            own = np.sort(runs[at:at + n - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(Sequences(hashes[at:at + n]).runs(n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def set_hash(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles as two signed integers."""
    with np.errstate(over="ignore"):
        return tuple(int(mixed(own ^ np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (0x51, 0xA7))


def points(own: np.ndarray) -> np.ndarray:
    """How many shingles are in each group, as bytes."""
    groups = LEAST_GROUPS
    while groups * FILL < len(own):
        groups *= 2
    while True:
        counts = np.bincount(((own >> np.uint64(32)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if not len(own) or counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A point of more groups as one of fewer."""
    return point.reshape(-1, groups).sum(0, dtype=np.int32) if len(point) > groups else point


def shared_at_most(p: np.ndarray, q: np.ndarray) -> int:
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum(dtype=np.int64))


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, hi, lo, point for every document; and, with n null, frequent shingles lo of a step with
    their count hi."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                sets = shingle_sets(step.column("text").cast(pa.binary()).to_pylist())
                both = [set_hash(s) for s in sets]
                found, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                often = times >= REPORTED
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(step.column("doc_id").to_pylist() + [None] * k, pa.int64()),
                    pa.array([len(s) for s in sets] + [None] * k, pa.int64()),
                    pa.array(np.concatenate([np.array([h for h, _ in both], np.int64), times[often].astype(np.int64)])),
                    pa.array(np.concatenate([np.array([lo for _, lo in both], np.int64), found[often].view(np.int64)])),
                    pa.array([points(s).tobytes() for s in sets] + [None] * k, pa.binary())], ["doc_id", "n", "hi", "lo", "point"])

    return docs.mapInArrow(profiled, "doc_id long, n long, hi long, lo long, point binary")


def _prefixes(docs: DataFrame, frequent) -> DataFrame:
    """key, tag, doc_id: the rarest shingles of each document, so many that any two similar documents
    share one. tag stands for the document's set; a task sends each set once."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = frequent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for step in steps(batch, "text"):
                keys, tags, ids, lengths = [], [], [], []
                sets = shingle_sets(step.column("text").cast(pa.binary()).to_pylist())
                for doc, own in zip(step.column("doc_id").to_pylist(), sets, strict=True):
                    n = len(own)
                    if not n or (both := set_hash(own)) in seen:
                        continue
                    seen.add(both)
                    k = n - (4 * n + 4) // 5 + 1
                    place = np.searchsorted(hashes, own)
                    place[place == len(hashes)] = 0
                    known = hashes[place] == own if len(hashes) else np.zeros(n, bool)
                    if known.any():
                        order = np.lexsort((own, np.where(known, ranks[place] if len(hashes) else 0, -1)))
                        keys.append(own[order[:k]])
                    else:
                        keys.append(own[:k])
                    tags.append(both[1])
                    ids.append(doc)
                    lengths.append(k)
                if keys:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(tags, np.int64), lengths)),
                        pa.array(np.repeat(np.array(ids, np.int64), lengths))], ["key", "tag", "doc_id"])

    return docs.mapInArrow(sent, "key long, tag long, doc_id long")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted keys those of two or more sets: key and node, a document of each set."""
    state = None  # key and tag of the last row, the key's first node, and whether that is out already
    for batch in batches:
        key, tag, doc = (batch.column(c).to_numpy() for c in ("key", "tag", "doc_id"))
        if not len(key):
            continue
        if state:
            key, tag, doc = np.append(state[0], key), np.append(state[1], tag), np.append(state[2], doc)
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        chosen = new_key | np.concatenate([[True], tag[1:] != tag[:-1]])
        last_tag = tag[-1]
        key, doc, new_key = key[chosen], doc[chosen], new_key[chosen]
        group = np.cumsum(new_key) - 1
        counts, firsts = np.bincount(group), doc[new_key]
        wanted = counts[group] >= 2
        out = bool(counts[-1] >= 2)
        if state:
            if state[3]:
                wanted[0] = False
                out = out or counts.size == 1
        if wanted.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[wanted]), pa.array(doc[wanted])], ["key", "node"])
        state = (key[-1], last_tag, firsts[-1], out)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id and shingles of the nodes, and of the few documents that share a bit of their bitmap. Texts are
    not shuffled: the bitmap of the nodes goes to every task. It has sixteen bits a node up to MOST_BITS;
    with more nodes it lets more documents pass, which costs space and changes nothing else."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * nodes.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    parts = nodes.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("block")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bitmap"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        bitmap[r["block"] * 4096: (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    marked = docs.sparkSession.sparkContext.broadcast(bitmap)  # MOST_BITS bits at most

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("at").to_numpy()
            there = (marked.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            for step in steps(batch.filter(pa.array(there)), "text"):
                sets = shingle_sets(step.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text", at.alias("at")).mapInArrow(made, "doc_id long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b that link by their shingles. The shingles of b travel with each pair, those of a go once
    to each part of a's pairs; a document of many pairs is dealt to several tasks."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int").alias("part")
    others = pairs.join(sets.select(F.col("doc_id").alias("b"), "shingles"), "b").select("a", part("b"), "b", "shingles")
    own = pairs.select("a", part("b")).distinct().join(sets.select(F.col("doc_id").alias("a"), "shingles"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, mine = None, {}  # a and its sets: rows that repeat an id may have several
        for batch in batches:
            found, shingles = [], batch.column("shingles")
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                other = np.frombuffer(shingles[i].as_py(), np.uint64)
                if b is None:
                    if first != a:
                        first, mine = a, {}
                    mine[other.tobytes()] = other
                elif first == a != b:
                    for own_set in mine.values():
                        joint = np.sort(np.concatenate([own_set, other]), kind="stable")
                        if 9 * int((joint[1:] == joint[:-1]).sum()) >= 4 * (len(own_set) + len(other)):
                            found.append((a, b))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(counted, "a long, b long")


class CountTree:
    """An R-tree over count vectors of one length, packed level by level from points sorted by size and counts."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // max(1, int(len(sizes) ** 0.5))
        widest = np.argsort(-counts.var(0))[:3]
        self.order = np.lexsort((*[counts[:, g] for g in widest[::-1]], slab))
        self.levels = [(counts[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FAN:
            top, least = self.levels[-1]
            at = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, at, 0), np.minimum.reduceat(least, at)))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points that may link with this one: nowhere does a bound rule them out."""
        nodes = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[k]
            nodes = nodes[9 * np.minimum(top[nodes], point).sum(1, dtype=np.int64) >= 4 * (least[nodes] + size)]
            if k:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[k - 1][0])]
        return self.order[nodes]


class _Forest:
    """Trees over the chosen rows, one for each length of points that a query may meet. Two documents that
    link differ in size by a quarter at most, so in groups by a factor of two."""

    def __init__(self, counts: list[np.ndarray], sizes: np.ndarray, chosen: np.ndarray) -> None:
        self.counts, self.sizes = counts, sizes
        groups, self.trees = np.array([len(c) for c in counts]), {}
        for g in np.unique(groups).tolist():
            fine, coarse = np.flatnonzero(chosen & ((groups == g) | (groups == 2 * g))), np.flatnonzero(chosen & (groups == g // 2))
            self.trees[g] = [(rows, k, CountTree(np.stack([folded(counts[r], k) for r in rows]), sizes[rows])) for rows, k in ((fine, g), (coarse, g // 2)) if len(rows)]

    def near(self, i: int) -> np.ndarray:
        """Chosen rows that the bounds do not rule out for row i."""
        found = [rows[tree.near(folded(self.counts[i], k), int(self.sizes[i]))] for rows, k, tree in self.trees[len(self.counts[i])]]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def first_pairs(counts: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows, enough to name every row that is near another. A row is paired with the leaders near
    it. One that has none becomes a leader, and is paired with one row near it if there is one. In a group
    of copies nearly all rows meet the same few leaders, so it is not expanded into all pairs. Of two
    parts only the leaders of each meet the other part: its leaders near them, or else one row near them."""
    if not (left == right).all():
        return _pairs_across(counts, sizes, left, right)
    return _led(counts, sizes, np.flatnonzero(left))[0]


def _led(counts: list[np.ndarray], sizes: np.ndarray, rows: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of one part and its leaders."""
    chosen, leading = np.zeros(len(sizes), bool), np.zeros(len(sizes), bool)
    chosen[rows] = True
    leaders: list[int] = []
    forest, out = None, []
    for i in rows.tolist():
        n, own = int(sizes[i]), counts[i]
        if many := len(leaders) > FAN:
            forest = forest or _Forest(counts, sizes, chosen)
            near = forest.near(i)
            led = near[leading[near]].tolist()
        else:
            led = [j for j in leaders if 5 * min(n, sizes[j]) >= 4 * max(n, sizes[j]) and 9 * shared_at_most(own, counts[j]) >= 4 * (n + sizes[j])]
        if not led:
            leaders.append(i)
            leading[i] = True
            if len(rows) > 2 and i != rows[0]:
                forest = forest or _Forest(counts, sizes, chosen)
                near = near if many else forest.near(i)
                led = near[near < i][:1].tolist()
        out += [(i, j) for j in led]
    return out, leaders


def _pairs_across(counts: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    sides = [(_led(counts, sizes, np.flatnonzero(side))[1], other) for side, other in ((left, right), (right, left))]
    out: set[tuple[int, int]] = set()
    for (leaders, other), (others, _) in zip(sides, sides[::-1], strict=True):
        forest, leading = _Forest(counts, sizes, other), np.zeros(len(sizes), bool)
        leading[others] = True
        for i in leaders:
            near = forest.near(i)
            led = near[leading[near]]
            out.update((max(i, j), min(i, j)) for j in (led if len(led) else near[:1]).tolist())
    return list(out)


def other_pairs(counts: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, kinds: np.ndarray) -> set[tuple[int, int]]:
    """All pairs of a left and a right row of different components that the bounds do not rule out. One of
    the two is outside the largest component, so only such rows are looked up."""
    values, times = np.unique(kinds, return_counts=True)
    outside = kinds != values[times.argmax()]
    out = set()
    for asked, chosen in ((left, right), (right, left)):
        forest = _Forest(counts, sizes, chosen)
        for i in np.flatnonzero(asked & outside).tolist():
            out.update((max(i, j), min(i, j)) for j in forest.near(i).tolist() if kinds[j] != kinds[i])
        if (left == right).all():
            break
    return out


def _tree_join(members: DataFrame, first: bool) -> DataFrame:
    """Pairs a < b from rows of key, part_lo, part_hi, part, node, n, point and, after the first round, component."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def made() -> list[tuple[int, int]]:
            counts, part = [np.frombuffer(r[3], np.uint8) for r in rows], np.array([r[4] for r in rows])
            cell = counts, np.array([r[1] for r in rows], np.int64), part == current[1], part == current[2]
            pairs = first_pairs(*cell) if first else other_pairs(*cell, np.array([r[2] for r in rows], np.int64))
            return [(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in pairs]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "part_lo", "part_hi", "node", "n", "component", "point", "part")]
            found: list[tuple[int, int]] = []
            for key, lo, hi, *row in zip(*columns, strict=True):
                if current != (key, lo, hi):
                    if rows:
                        found += made()
                    current, rows = (key, lo, hi), []
                rows.append(row)
            if found:
                found = list(set(found))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
        if rows and (found := made()):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    cells = ["key", "part_lo", "part_hi"]
    return members.repartition(*cells).sortWithinPartitions(*cells, "node").mapInArrow(joined, "a long, b long").distinct()


def _parted(rows: DataFrame, chosen: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows of the chosen buckets (key, rows) with their points. A bucket of more than BLOCK rows is cut
    into parts, and each pair of parts is a task's work."""
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    cut = rows.join(chosen.select("key", parts.alias("parts")), "key").withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    points_ = profiles.filter("n > 0").select(F.col("doc_id").alias("node"), "n", "point", "hi", "lo").dropDuplicates(["node", "hi", "lo", "n"]).drop("hi", "lo")  # one for each set of an id
    return cut.select("key", F.least("part", "other").alias("part_lo"), F.greatest("part", "other").alias("part_hi"), "part", "node", "component").join(points_, "node")


def _links(docs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Links a, b between documents of different sets, enough of them to connect all that links connect, and
    the written stages that they read."""
    spark = docs.sparkSession
    reported = profiles.filter("n IS NULL").groupBy("lo").agg(F.sum("hi").alias("times")).orderBy(F.desc("times"), "lo").limit(FREQUENT).collect()
    hashes = np.array([r["lo"] for r in reported], np.int64).view(np.uint64)
    ranks = np.array([r["times"] for r in reported], np.int64)
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], ranks[order]))  # at most FREQUENT pairs of numbers
    keyed = _prefixes(docs, frequent).repartition("key").sortWithinPartitions("key", "tag", "doc_id")
    buckets = materialize(keyed.mapInArrow(_buckets, "key long, node long"), "buckets")
    # Buckets of the same nodes are compared once. An id of several sets may be in a bucket twice, which the xor does not see and the sum does.
    alike = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("node")).alias("s"), F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(1)), 32)).alias("t"))
    once = materialize(alike.groupBy("rows", "s", "t").agg(F.min("key").alias("key")).select("key", "rows"), "distinct-buckets")
    rows = buckets.withColumn("component", F.lit(None).cast("long"))
    pairs = materialize(_tree_join(_parted(rows, once, profiles), True), "first-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()  # every node that is near another
    sets = materialize(_sets(docs, nodes), "sets")
    links = materialize(_verified(pairs, sets), "first-links")
    # Buckets of more than a pair, if links do not connect all their nodes that are near another.
    large = buckets.join(once.filter("rows > 2"), "key").select("key", "rows", "node").join(nodes, F.col("node") == nodes["doc_id"], "left_semi")
    placed = large.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed.select("key", "rows", "node", "component"), "large-buckets")
    discard(buckets)
    open_ = placed.groupBy("key", "rows").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key", "rows")
    more = materialize(_tree_join(_parted(placed.drop("rows"), open_, profiles), False).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    discard(once, pairs, placed)
    return links.unionByName(_verified(more, sets)), (links, more, sets)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id that links reach).

    Two documents link when 100 * shared >= 80 * union of their distinct shingles of five words (ASCII
    letters in lower case). Shingles are compared by 64-bit hashes, sets by 128 bits. Documents of equal
    sets are one node; pairs are compared only while their components differ, so a large group of copies
    is not expanded into all pairs. Ids are integers. Null, empty or blank text: no shingles, a component
    of its own. Fewer than five words: the whole sequence is the only shingle. Rows that repeat an id are
    one document: what one links to, the other does. Null ids: no component. Empty table: no rows. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    profiles = materialize(_profiles(rows), "profiles")
    own = profiles.filter("n IS NOT NULL")
    counted = own.filter("n > 0 AND doc_id IS NOT NULL")
    classes = counted.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("least"))
    same = counted.join(classes, ["hi", "lo", "n"]).filter("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    links, read = _links(rows.filter(F.col("doc_id").isNotNull()), profiles)
    found = components(links.unionByName(same))
    discard(*read)
    return own.join(found, own["doc_id"] == found["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of `similar`, that of the smallest id, as it is. Rows without id stay;
    rows that repeat the smallest id stay together."""
    gone = similar(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias("i")).distinct()
    return docs.join(gone, docs[id_col] == gone["i"], "left_anti")
