"""Homomorphic multiset hash of documents, with DataFrame functions only.

A text is a multiset of paragraphs; a paragraph ends with a line or a sentence, so that texts of one
line have parts as well. Each paragraph is hashed to a wide vector of lanes, and the vectors are added
lane by lane modulo 2^32. The sum does not depend on the order, and paragraphs are inserted or deleted
by adding or subtracting their vectors. The hashed values are uniform, so the cosine of two centred
sums estimates how much of the two multisets is shared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import texts

#: Lanes of a fingerprint. A paragraph fills each with 16 bits, four from one 64-bit hash.
LANES, BITS, MODULUS = 80, 16, 1 << 32
#: Rows of one range of ids, and most ranges.
RANGE_ROWS, MAX_RANGES = 512, 16384


def paragraphs(text: Column) -> Column:
    """The paragraphs, without the spaces around them; blank ones do not count."""
    return F.filter(F.transform(F.split(text, r"\n|(?<=[.!?])(?=\s)"), lambda p: F.trim(p)), lambda p: p != "")


def summed(parts: DataFrame, keys: list[str], part: str = "part") -> DataFrame:
    """`vector` by keys: the number of paragraphs, then the lanes' sums. A null part counts nothing."""
    own = F.md5(F.col(part).cast("binary"))
    hashes = [F.xxhash64(own, F.lit(i)).alias(f"h{i}") for i in range(LANES // 4)]
    lane = lambda i: F.shiftrightunsigned(f"h{i // 4}", BITS * (i % 4)).bitwiseAND(F.lit((1 << BITS) - 1))
    there = F.col(part).isNotNull()
    sums = [F.coalesce(F.sum(F.when(F.col("there"), lane(i))), F.lit(0)) % MODULUS for i in range(LANES)]
    wide = parts.select(*keys, there.alias("there"), *hashes).groupBy(*keys).agg(F.count_if("there").alias("lane"), *[s.alias(f"lane{i}") for i, s in enumerate(sums)])
    return wide.select(*keys, F.array("lane", *[f"lane{i}" for i in range(LANES)]).alias("vector"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of a text with the paragraphs of another inserted (sign 1) or deleted (sign -1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(MODULUS)))


def digest(vector: Column) -> Column:
    """A fingerprint as a short string for equality."""
    return F.sha2(F.array_join(F.transform(vector, lambda x: F.hex(x)), ","), 256)


def _centred(vector: Column) -> Column:
    mean = F.element_at(vector, 1).cast("double") * (((1 << BITS) - 1) / 2)
    return F.transform(F.slice(vector, 2, LANES), lambda x: x.cast("double") - mean)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column, a_centred: Column, b_centred: Column) -> Column:
    """0 to 1 from two vectors and their centred sums; equal vectors: 1."""
    size = F.sqrt(_dot(a_centred, a_centred)) * F.sqrt(_dot(b_centred, b_centred))
    return F.when(a == b, 1.0).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a_centred, b_centred) / size))).otherwise(0.0)


def _range_bounds(docs: DataFrame) -> list[int]:
    """Ids at which ranges of about RANGE_ROWS rows begin; they are ids of rows."""
    rows = docs.count()
    ranges = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    least, cuts = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / ranges for i in range(ranges)], 20 * ranges)).first()
    return sorted({least, *cuts}) if least is not None else []


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """0-based range of an id, found in two steps; a null id belongs to the last."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    group = below(F.array(*[F.lit(g[0]) for g in groups]))
    inner = below(F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.greatest(group, F.lit(1))))
    return F.when(doc_id.isNull(), len(bounds) - 1).otherwise((group - 1) * step + inner - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of doc_id, text with the next row's text by ascending doc_id; after the last row comes the
    first. Rows are dealt by ranges of ids; the first row of each range is dealt to the range before as
    well, where it only lends its text (`lent`). Each text is shuffled once. `at` is the position in the range."""
    bounds = _range_bounds(docs.select("doc_id"))
    if not bounds:
        home = F.array(F.struct(F.lit(0).alias("range"), F.lit(False).alias("lent")))
    else:
        own = _range_of(F.col("doc_id"), bounds)
        starts = F.coalesce(F.col("doc_id") == F.element_at(F.array(*[F.lit(b) for b in bounds]), own + 1), F.lit(False))
        there = F.struct(own.alias("range"), F.lit(False).alias("lent"))
        before = F.struct(((own + len(bounds) - 1) % len(bounds)).alias("range"), F.lit(True).alias("lent"))
        home = F.when(starts, F.array(there, before)).otherwise(F.array(there))
    dealt = docs.withColumn("home", F.explode(home)).select("doc_id", "text", F.col("home.range").alias("range"), F.col("home.lent").alias("lent")).repartition("range")
    order = Window.partitionBy("range").orderBy("lent", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.withColumns({"next_text": F.coalesce(F.lead("text").over(order), F.lit("")), "at": F.row_number().over(order)})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, vector, edited_vector, next_vector.

    The edited text has its last half replaced by the start of the next text. Null text: the empty text,
    whose vector is all zero. Equal texts have equal vectors, and so have texts of the same paragraphs in
    another order. Ids are integers; rows that repeat an id follow each other by text; null ids come last,
    and where no row has an id, nothing follows the last row (an empty text). Empty table: no rows. Other
    columns are not read. After the one shuffle of the texts, sums and neighbours stay inside the ranges.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(texts(docs, id_col, text_col)).withColumn("edited", edited)
    kinds = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha"))))
    both = rows.select("range", "at", "lent", "doc_id", n.cast("long").alias("n_chars"), kinds.alias("of")).select("range", "at", "lent", "doc_id", "n_chars", "of.kind", "of.sha", "of.text")
    keys = ["range", "at", "lent", "doc_id", "n_chars", "kind", "sha"]
    sums = summed(both.select(*keys, F.explode_outer(paragraphs(F.col("text"))).alias("part")), keys)
    order = Window.partitionBy("range").orderBy("at", "kind")
    none = F.array_repeat(F.lit(0).cast("long"), LANES + 1)
    beside = sums.withColumns({"edited": F.lead(F.struct("sha", "vector")).over(order), "next_vector": F.coalesce(F.lead("vector", 2).over(order), none)})
    return beside.filter((F.col("kind") == 0) & ~F.col("lent")).select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), "vector", F.col("edited.vector").alias("edited_vector"), "next_vector")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`fingerprints` as digests: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The cases are those of `fingerprints`; two empty texts are alike (1)."""
    made = fingerprints(docs, id_col, text_col)
    names = ("vector", "edited_vector", "next_vector")
    centred = reduce(lambda df, c: df.withColumn(f"{c}_c", _centred(F.col(c))), names, made)
    near = lambda other: likeness(F.col("vector"), F.col(other), F.col("vector_c"), F.col(f"{other}_c"))
    return centred.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("vector")).alias("fingerprint"),
        digest(F.col("edited_vector")).alias("edited_fingerprint"), near("edited_vector").alias("near_edited"), near("next_vector").alias("near_next"))
