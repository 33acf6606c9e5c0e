"""Exact positions inside groups of any size.

A plain window sorts a whole group in one task. Here a group is cut into buckets that follow the
sort order (`levels`, from coarse to fine); bucket sizes are accumulated level by level, and rows
are sorted inside their own bucket. A group with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = tuple[str, bool]  # column name, ascending?


def _sort(name: str, ascending: bool) -> Column:
    return F.col(name).asc() if ascending else F.col(name).desc()


def with_rank(df: DataFrame, group: Sequence[str], order: Sequence[Order],
              levels: Sequence[tuple[Column, bool]], name: str = "rank") -> DataFrame:
    """Adds the 1-based position of each row in its group under a total `order`.

    `levels` are non-null expressions with a direction; comparing rows by them first must agree
    with `order`.
    """
    named = [(f"_level_{i}", ascending) for i, (_, ascending) in enumerate(levels)]
    cut = df.withColumns({n: c for (n, _), (c, _) in zip(named, levels, strict=True)})
    keys = [*group, *(n for n, _ in named)]
    # What lies before a bucket is added up level by level: a window holds the buckets of one level inside
    # one bucket of the level above, never all buckets of a group.
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(*keys, F.lit(0).cast("long").alias("_before_n"))
    for i, (name_, ascending) in enumerate(named):
        above, upto = [*group, *(n for n, _ in named[:i])], [*group, *(n for n, _ in named[: i + 1])]
        earlier = Window.partitionBy(*above).orderBy(_sort(name_, ascending)).rowsBetween(Window.unboundedPreceding, -1)
        level = sizes.groupBy(*upto).agg(F.sum("n").alias("n")).select(*upto, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_own"))
        offsets = offsets.join(level, upto).select(*keys, (F.col("_before_n") + F.col("_own")).alias("_before_n"))
    inside = Window.partitionBy(*keys).orderBy(*(_sort(c, a) for c, a in order))
    return (
        cut.join(offsets, keys)
        .withColumn(name, (F.row_number().over(inside) + F.col("_before_n")).cast("long"))
        .drop("_before_n", *(n for n, _ in named))
    )


def id_levels(df: DataFrame, column: str, ascending: bool = True) -> list[tuple[Column, bool]]:
    """Order-preserving blocks of an identifier, from coarse to fine: blocks of ids for numbers, ever longer
    prefixes for text, so that ids that share their beginning are split as well."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long"):
        return [(F.shiftright(c.cast("long"), 32), ascending), (F.shiftright(c.cast("long"), 16), ascending)]
    return [(F.substring(c, 1, n), ascending) for n in (4, 8, 12)]
