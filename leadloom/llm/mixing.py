"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its id. What a source must give beyond whole repeats of itself is taken as
the documents whose hash is below a threshold. The threshold comes from a histogram of words by source
and hash bucket: whole buckets that fit are taken, the bucket that crosses the budget is cut into finer
buckets, and so on. No documents are sorted. What then still misses is filled by further, nested
thresholds over the documents small enough to fit in the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import n_words
from leadloom.sources.tables import materialize

#: Hash bits, the bits of one histogram level, and the number of nested budgets.
BITS, LEVEL_BITS, ROUNDS = 60, 15, 4


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """source, source_size, target from rows (source, source_size), one per source.

    Weights repeat over the sources by code point, null last. All sources share the total by weight;
    a target above `limit` times its source stops there and the excess is shared among the others by
    weight until none is above. Ranks come from range partitions, so no task holds all sources.
    """
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = sizes.withColumn("absent", F.col("source").isNull()).repartitionByRange(parts, "absent", "source")
    dealt = materialize(ranged.withColumn("part", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, {}
    for part, n in sorted(dealt.groupBy("part").count().collect()):  # at most as many rows as shuffle partitions
        offsets[part] = before
        before += n
    weight_of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    start = F.coalesce(*[F.when(F.col("part") == p, F.lit(o)) for p, o in offsets.items()], F.lit(0))
    inside = Window.partitionBy("part").orderBy("absent", "source")
    ranked = materialize(dealt.withColumn("rank", start + F.row_number().over(inside) - 1).withColumn("weight", weight_of)
                         .select("source", "source_size", "weight"), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = None
    while True:
        capped = F.lit(False) if share is None else limit * F.col("source_size") < share * F.col("weight")
        fixed, free = ranked.agg(F.coalesce(F.sum(F.when(capped, limit * F.col("source_size"))), F.lit(0.0)),
                                 F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        new = (total - fixed) / free if free else 0.0
        if share is not None and new <= share:
            break
        share = new
    return ranked.withColumn("target", F.least(limit * F.col("source_size"), F.lit(float(share)) * F.col("weight"))).select("source", "source_size", "target")


def _bucket(level: int) -> Column:
    return F.shiftright("hash", BITS - LEVEL_BITS * (level + 1)) % (1 << LEVEL_BITS)


def budget_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold, given: the largest threshold for which the words of the source's rows with
    hash < threshold do not exceed its budget, and those words. rows: source, hash, size."""
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("threshold"), F.lit(0).cast("long").alias("given"))
    for level in range(BITS // LEVEL_BITS):
        width = 1 << (BITS - LEVEL_BITS * (level + 1))
        # Only the boundary bucket of the level before is looked at.
        inside = rows.join(state.select(F.col("source").alias("s"), "threshold"), F.col("source").eqNullSafe(F.col("s"))) if level else rows.withColumn("threshold", F.lit(0).cast("long"))
        inside = inside.filter((F.col("hash") >= F.col("threshold")) & (F.col("hash") < F.col("threshold") + width * (1 << LEVEL_BITS)))
        histogram = inside.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        running = histogram.withColumn("upto", upto)
        joined = running.join(state.select(F.col("source").alias("s"), "budget", "given"), F.col("source").eqNullSafe(F.col("s")))
        fits = F.col("given") + F.col("upto") <= F.col("budget")
        # The first bucket that does not fit is the boundary; without one, all of the range fits.
        cut = joined.groupBy("source").agg(
            F.coalesce(F.min(F.when(~fits, F.col("bucket"))), F.lit(1 << LEVEL_BITS)).alias("boundary"),
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("more"),
        ).withColumnRenamed("source", "c")
        state = materialize(
            state.join(cut, F.col("source").eqNullSafe(F.col("c")), "left")
            .select("source", "budget",
                    (F.col("threshold") + F.coalesce("boundary", F.lit(0)) * F.lit(width)).cast("long").alias("threshold"),
                    (F.col("given") + F.coalesce("more", F.lit(0))).cast("long").alias("given")), "mix-level")
    return state


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The row as it is, with doc_id, source, size in words and the hash of the id."""
    return docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("mix")), 64 - BITS).alias("hash"))


def mix_rules(rows: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """One row per source: source_size, target, whole (copies of every document) and, for each nested
    budget, the size and the hash below which a document is taken once more. rows: source, size, hash."""
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    whole = F.least(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), F.lit(int(limit)))
    plan = materialize(targets.withColumn("whole", whole.cast("long")).withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "mix-plan")
    left, marks = plan.select("source", F.col("left").alias("budget")), []
    candidates = rows.filter("size > 0").select("source", "hash", "size")
    for _ in range(ROUNDS):
        limits = left.select(F.col("source").alias("s"), F.col("budget").alias("most"))
        fitting = candidates.join(limits, F.col("source").eqNullSafe(F.col("s"))).filter(F.col("size") <= F.col("most")).select("source", "hash", "size")
        state = budget_thresholds(fitting, left)
        marks.append(state)
        below = state.select(F.col("source").alias("s"), F.col("threshold"), F.col("budget").alias("most"))
        # What this budget took is no candidate of the next one.
        candidates = materialize(
            candidates.join(below, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("size") > F.col("most")) | (F.col("hash") >= F.col("threshold")))
            .select("source", "hash", "size"), "mix-rest")
        left = state.select("source", (F.col("budget") - F.col("given")).alias("budget"))
    rules = plan
    for i, state in enumerate(marks):
        named = state.select(F.col("source").alias(f"s{i}"), F.struct("budget", "threshold").alias(f"rule{i}"))
        rules = rules.join(named, F.col("source").eqNullSafe(F.col(f"s{i}"))).drop(f"s{i}")
    return materialize(rules, "mix-rules").withColumnRenamed("source", "s")


def _with_copies(rows: DataFrame, rules: DataFrame) -> DataFrame:
    extra = F.lit(False)
    for i in range(ROUNDS):
        extra = extra | ((F.col("size") <= F.col(f"rule{i}.budget")) & (F.col("hash") < F.col(f"rule{i}.threshold")))
    copies = (F.col("whole") + F.when((F.col("size") > 0) & extra, 1).otherwise(0)).cast("long")
    return rows.join(rules, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    size counts words; copies (0 to `limit`) is how often the mix repeats the document; taken is
    size times copies. The words taken of a source never exceed its target and miss it by less than the
    smallest document that the last nested budget left out. The hash depends on the id alone, so reruns
    agree. Null text: no words. Null source: a source of its own, last. Rows that repeat an id have the
    same hash and are taken together. Null id: hashed as such. Empty table: no rows.
    """
    rows = materialize(_measured(docs, id_col, text_col, source_col).drop("row"), "mix-rows")
    return _with_copies(rows, mix_rules(rows, weights, limit)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[float] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """The documents themselves, each as often as `mix` takes it. The cases are those of `mix`. The rules
    of the sources meet the documents where they lie; texts are not shuffled while the rules are small
    enough for Spark to send them to every task."""
    rows = _measured(docs, id_col, text_col, source_col)
    rules = mix_rules(materialize(rows.select("source", "size", "hash"), "mix-rows"), weights, limit)
    return _with_copies(rows, rules).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
