"""Registration of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.plans import driver_tables
from leadloom.plans.daily import Daily

Query = Callable[[SparkSession, str], DataFrame]


_PLANS: dict[tuple[str, str], Daily] = {}


def daily(spark: SparkSession, folder: str) -> Daily:
    """The daily plan over one folder. Its shared stages are written once per application; a query
    about a stage itself uses `build`, which computes that stage again."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PLANS:
        inputs = driver_tables.DriverInputs(spark, folder)
        _PLANS[key] = Daily(inputs, driver_tables.WINDOW, driver_tables.LIST_DAYS, materialized=True)
    return _PLANS[key]


def plain(df: DataFrame) -> DataFrame:
    """Counts and keys as long, so results have one integer type."""
    small = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer")]
    return df.withColumns({n: F.col(n).cast("long") for n in small}) if small else df


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            self.queries[name] = lambda spark, folder: plain(function(spark, folder))
            if sql is not None:
                # Integers come back as BIGINT on the other side too.
                self.oracle[name] = sql
            return function

        return register
