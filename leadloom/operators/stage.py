"""Keeps a computed stage together in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame) -> DataFrame:
    """The same rows through a one-element generator.

    Predicates on the outputs of a long projection are otherwise pushed below it with every
    expression copied into them. A generator stops that, needs no shuffle, and lets each value be
    computed once.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def staged_new(df: DataFrame, *new: str) -> DataFrame:
    """`staged` for the named columns only, which come last: the others are not copied once more."""
    return df.select(*(c for c in df.columns if c not in new), F.inline(F.array(F.struct(*new))))
