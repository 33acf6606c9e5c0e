"""Source divergence audit: how far the word use of each source lies from each other source and from its language.

Each kept term of a language is a row of nonzero counts in the order of the sources. Equal rows are
inserted once, with their multiplicity, into a frequent-pattern tree: a node is a source and a count below
the path of the sources before it, and holds the number of terms that pass through it. The divergence of two
sources is a closed form over terms absent from one of them, plus a correction for each term that both hold;
every pair of counts in a row is a node and one of its ancestors, so a correction is computed once for each
node and ancestor and weighted by the node's terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import steps
from leadloom.sources.tables import materialize

#: Documents of a language that a term needs; unit of the probabilities; terms listed for each source.
MIN_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: Distinct terms that a task gathers before it sends their counts on.
HELD = 300_000
#: Sources of a language meet each other in so many parts.
PARTS = 32

#: Letters of ASCII in lower case and all bytes of other characters stay, everything else parts terms.
_KEPT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Terms of a text: runs of ASCII letters and of characters beyond ASCII, A-Z in lower case."""
    return text.translate(_KEPT).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, as far as the task has gathered them."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            n = len(count)
            if n:
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n), pa.array([source] * n), pa.array(list(count), pa.binary()).cast(pa.string()),
                    pa.array(count.values(), pa.int64()), pa.array([docs[t] for t in count], pa.int64())], ["lang", "source", "term", "count", "docs"])
        held.clear()

    for batch in batches:
        for step in steps(batch, "text"):
            for lang, source, text in zip(step.column("lang").to_pylist(), step.column("source").to_pylist(), step.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = Counter(words(text))
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                count.update(own)
                docs.update(own.keys())
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield from sent()
    yield from sent()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total) in whole numbers; null without a total."""
    return 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * count.cast("decimal(20,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def _far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class PatternTree:
    """The tree of one language. Rows come in the order of their paths, so nodes below the current path are
    complete: they are corrected against their ancestors and forgotten, and only one path is held."""

    def __init__(self) -> None:
        self.path: list[list] = []  # source, count, p, p0, terms
        self.sums: dict[tuple[str, str], list[int]] = {}
        self.nodes: list[tuple] = []

    def insert(self, items: list[tuple], times: int) -> None:
        shared = 0
        while shared < len(items) and shared < len(self.path) and self.path[shared][:2] == [items[shared][0], items[shared][1]]:
            self.path[shared][4] += times
            shared += 1
        self.close(shared)
        self.path += [[*item, times] for item in items[shared:]]

    def close(self, depth: int = 0) -> None:
        """Takes the nodes below `depth` off the path, each with its ancestors."""
        while len(self.path) > depth:
            source, _, p, p0, terms = self.path.pop()
            self.nodes += [(a[0], source, a[2], a[3], p, p0, terms) for a in self.path]
        if len(self.nodes) > 200_000:
            self.settle()

    def settle(self) -> None:
        """Corrections of the gathered nodes and ancestors, added up for each pair of sources in both directions."""
        if not self.nodes:
            return
        above, below, *numbers = zip(*self.nodes, strict=True)
        a, a0, b, b0, terms = (np.array(x, np.int64) for x in numbers)
        ab = (_f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0)) * terms
        ba = (_f(b, a) - _f(b, a0) - _f(b0, a) + _f(b0, a0)) * terms
        names, pair = {}, np.empty(len(terms), np.int64)
        for i, key in enumerate(zip(above, below, strict=True)):
            pair[i] = names.setdefault(key, len(names))
        order = np.argsort(pair, kind="stable")
        edges = np.flatnonzero(np.diff(pair[order], prepend=-1))
        for key, x, y in zip(names, np.add.reduceat(ab[order], edges).tolist(), np.add.reduceat(ba[order], edges).tolist(), strict=True):
            own = self.sums.setdefault(key, [0, 0])
            own[0] += x
            own[1] += y
        self.nodes = []


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, item, value: what the trees of a task add to the divergence of `source` from `item`."""
    lang, tree = None, PatternTree()

    def made() -> Iterator[pa.RecordBatch]:
        tree.close()
        tree.settle()
        rows = [(a, b, x) for (a, b), (x, _) in tree.sums.items()] + [(b, a, y) for (a, b), (_, y) in tree.sums.items()]
        if rows:
            a, b, value = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(a), pa.array(b), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

    for batch in batches:
        items = batch.column("items")
        flat = items.flatten()
        parts = list(zip(*(flat.field(k).to_pylist() for k in range(4)), strict=True))
        offsets = items.offsets.to_numpy() - items.offsets[0].as_py()
        for own, times, lo, hi in zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if own != lang:
                yield from made()
                lang, tree = own, PatternTree()
            tree.insert(parts[lo:hi], times)
    yield from made()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs of all terms; tasks add up what they read before they send it."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    gathered = rows.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    return gathered.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: for each source of a language every other one of it, value the sum of
    f = floor((p - q)^2 / q) over all kept terms, p and q the two sources' shares. Part `term`: the `top`
    terms that a source uses more than its language does, value f against the language. A share is
    1 + floor(UNIT * (count + 1) / (N + V)), in whole numbers. Kept terms stand in `min_docs` documents of
    the language. Order: value falling, item by UTF-8 bytes.

    A term is counted in the task that reads it and combined; rows of terms hold one item for each source of
    the language, at most. Terms of one language, and the pairs of its sources, are dealt to many tasks.

    Null text, language or source: the empty one. A language without a kept term: all its pairs are 0 and it
    lists no term. A source alone in its language: no pairs. Repeated rows count again; ids are not read.
    Very long texts are steps of their own. Empty table: no rows. Other columns are not read.
    """
    counts = materialize(term_counts(docs), "terms")
    by_term = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("items"),
    ).filter(F.col("docs") >= min_docs).select("lang", "term", "total", "items")
    by_term = materialize(by_term, "kept-terms")
    kept = by_term.select("lang", "term", "total", F.inline("items"))
    langs = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("n_lang"))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = named.join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "terms", "n_lang"])
    groups = materialize(groups.withColumn("p0", _share(F.lit(1), F.col("n") + F.col("terms"))), "sources")

    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "count", _share(F.col("count") + 1, F.col("n") + F.col("terms")).alias("p"), "p0",
        _share(F.col("total") + 1, F.col("n_lang") + F.col("terms")).alias("q"))
    shares = materialize(shares, "shares")

    over = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))
    rank = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)"
    listed = over.withColumn("rank", F.expr(rank)).filter(F.col("rank") <= top)

    # Every source meets the others of its language in parts of the histogram of its shares.
    base = groups.filter("terms > 0").select("lang", "source", F.lit(None).cast("long").alias("p"), "p0", F.col("terms").alias("times"))
    histogram = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    own = base.unionByName(histogram).withColumn("slot", F.pmod(F.xxhash64("source", "p"), F.lit(PARTS)))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("i0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("slot"))
    met = own.join(others, ["lang", "slot"]).filter("source <> item").select(
        "lang", "source", "item",
        (F.col("times") * F.when(F.col("p").isNull(), _far(F.col("p0"), F.col("i0"))).otherwise(_far(F.col("p"), F.col("i0")) - _far(F.col("p0"), F.col("i0")))).alias("there"),
        F.when(F.col("p").isNotNull(), F.col("times") * (_far(F.col("i0"), F.col("p")) - _far(F.col("i0"), F.col("p0")))).alias("back"))
    met = met.groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    closed = met.select("lang", "source", "item", F.col("there").alias("value")).unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))

    rows = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "count", "p", "p0"))).alias("items"))
    rows = rows.filter(F.size("items") > 1).groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    # Ranges follow the first two items of a path, so the sample that cuts them stays small however long the rows are.
    head = [F.try_element_at("items", F.lit(k))[c] for k in (1, 2) for c in ("source", "count")]
    ordered = materialize(rows, "term-rows").repartitionByRange("lang", *head).sortWithinPartitions("lang", "items")
    corrected = ordered.mapInArrow(_corrections, "lang string, source string, item string, value long")

    zero = groups.filter("terms = 0").select("lang", "source")
    nothing = zero.join(zero.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = closed.unionByName(corrected).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).unionByName(nothing.select("lang", "source", "item", "value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.expr(rank))
    return pairs.unionByName(listed).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
