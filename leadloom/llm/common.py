"""What the operators share: words, ids, input columns, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to one step of vectorised Python code, in characters; a longer text is a step of its own.
STEP_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text under fixed names, whatever else the table holds; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The rows that a model may not learn from; a row without id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def steps(batch: pa.RecordBatch, text_col: str, limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a step holds about `limit` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def per_step(function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], text_col: str = "text"):
    """A function for mapInArrow that works step by step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text_col):
                made = function(step)
                if isinstance(made, pa.Table):
                    yield from made.to_batches()
                elif made is not None:
                    yield made

    return run
