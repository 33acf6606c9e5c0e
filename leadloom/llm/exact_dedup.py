"""Exact deduplication: 128-bit content hash, bytes compared inside each hash group, one row stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import texts


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by `digest` and, inside a digest, by the bytes of the text, so texts whose digests
    collide stay apart. `keep` is the smallest or the largest id. Grouping is combined before the shuffle:
    a text that a third of all rows share arrives once per task. Rows meet their group again by hashes only.

    Null text: the empty text. Null id: never chosen while a row of the group has an id. Rows that repeat
    id and text: one of them is kept. Empty table: no rows. Other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rows = texts(docs, id_col, text_col).withColumn("digest", digest(F.col("text")))
    chosen = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    groups = (
        rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), chosen.alias("keep_id"))
        .select("digest", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    members = rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")).groupBy("doc_id", "digest", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    return members.join(groups, ["digest", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"), "text_sha256",
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that `exact_dedup` keeps, as they are. They are found again by id and text hash; of rows
    that repeat both, one stays. The cases are those of `exact_dedup`."""
    kept = exact_dedup(docs, id_col, text_col, keep).filter("kept").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    found = rows.join(kept, rows["id"].eqNullSafe(kept["i"]) & (rows["sha"] == kept["s"]), "left_semi")
    return found.dropDuplicates(["id", "sha"]).select("row.*")
