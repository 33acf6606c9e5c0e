"""Readings of the four accepted date formats and the rules that settle ambiguous ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions.text import is_blank, strip
from leadloom.operators.stage import staged


def _class_of(stripped: Column) -> Column:
    """Format of an already stripped text. The length decides which pattern is worth trying."""
    size = F.length(stripped)
    return (
        F.when(F.coalesce(stripped, F.lit("")) == "", "vacio")
        .when((size == 19) & stripped.rlike(fixed.DATE_ISO), F.when(F.substring(stripped, 11, 1) == "T", "iso_t").otherwise("iso_espacio"))
        .when((size == 10) & stripped.rlike(fixed.DATE_DAY), "dd-mm-yyyy")
        .when((size == 16) & stripped.rlike(fixed.DATE_SLASH), "barras")
        .otherwise("desconocido")
    )


def date_format_class(c: Column) -> Column:
    return _class_of(strip(c))


def _slash_of(stripped: Column, kind: Column) -> Column:
    """Which reading a stripped text of a known format allows; the pattern of slash dates fixes where the components stand."""
    x, y = F.substring(stripped, 1, 2), F.substring(stripped, 4, 2)
    return (
        F.when(kind != "barras", None)
        .when(x > "12", "ddmm")
        .when(y > "12", "mmdd")
        .when(x == y, "igual")
        .otherwise("ambigua")
    )


def slash_class(c: Column) -> Column:
    """Which reading the components of a slash date allow; NULL for the other formats."""
    return _slash_of(strip(c), date_format_class(c))


def with_classes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column a struct of its name, `formato` and `barras`; every text is stripped and classed once."""
    df = staged(df.select(*(strip(F.col(c)).alias(c) for c in columns)))
    df = staged(df.withColumns({f"_{c}_clase": _class_of(F.col(c)) for c in columns}))
    kind = {c: F.col(f"_{c}_clase") for c in columns}
    return df.select(*(F.struct(F.lit(c).alias("columna"), kind[c].alias("formato"), _slash_of(F.col(c), kind[c]).alias("barras")).alias(c) for c in columns))


def with_readings(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds `{prefix}_a` (only or day-first reading), `{prefix}_b` (month-first reading when it
    differs), `{prefix}_slash` and `{prefix}_precision`. Seconds are read and dropped.

    Built in steps so that every part is computed once per row.
    """
    def n(name: str) -> str:
        return f"_{prefix}_{name}"

    df = df.withColumn(n("text"), strip(F.col(column)))
    df = df.withColumn(n("kind"), _class_of(F.col(n("text"))))
    kind = F.col(n("kind"))
    iso, known = kind.startswith("iso"), ~kind.isin("vacio", "desconocido")

    def part(iso_at: int, other_at: int, size: int = 2) -> Column:
        at = F.when(iso, F.lit(iso_at)).otherwise(F.lit(other_at))
        return F.when(known, F.col(n("text")).substr(at, F.lit(size)).try_cast("int"))

    def clock(at: int) -> Column:
        return F.when(kind == "dd-mm-yyyy", 0).otherwise(part(at, at))

    df = df.withColumns({n("y"): part(1, 7, 4), n("m"): part(6, 4), n("d"): part(9, 1), n("h"): clock(12), n("i"): clock(15)})

    def at(month: str, day: str) -> Column:
        return F.try_make_timestamp_ntz(*(F.col(n(x)) for x in ("y", month, day, "h", "i")), F.lit(0))

    df = df.withColumns({f"{prefix}_a": at("m", "d"), n("b"): F.when(kind == "barras", at("d", "m"))})
    a, b = F.col(f"{prefix}_a"), F.col(n("b"))
    df = df.withColumns({
        f"{prefix}_b": F.when(~b.eqNullSafe(a), b), f"{prefix}_slash": kind == "barras",
        f"{prefix}_precision": F.when(kind == "dd-mm-yyyy", "dia").when(known, "minuto"),
    })
    return df.drop(*(n(x) for x in ("text", "kind", "y", "m", "d", "h", "i", "b")))


def resolve(df: DataFrame, column: str, own: str, other: str | None, is_registration: bool,
            window: tuple[str, str] = fixed.WINDOW) -> DataFrame:
    """Adds `{own}_at` and `{own}_reason` from the readings with prefix `own`.

    The rules apply in order: only one reading, only one reading inside the data window, only one
    reading coherent with the other date, and day-first by default.
    """
    a, b = F.col(f"{own}_a"), F.col(f"{own}_b")
    low, high = F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")

    def inside(c: Column) -> Column:
        return F.coalesce(F.to_date(c).between(low, high), F.lit(False))

    steps = {"_a_in": inside(a), "_b_in": inside(b)}
    if other is not None:
        oa, ob = F.col(f"{other}_a"), F.col(f"{other}_b")
        steps |= {"_oa_in": inside(oa), "_ob_in": inside(ob),
                  "_by_day": F.coalesce(F.col(f"{own}_precision") == "dia", F.lit(False))
                  | F.coalesce(F.col(f"{other}_precision") == "dia", F.lit(False))}
    df = df.withColumns(steps)
    if other is not None:
        def fits(c: Column) -> Column:
            def against(o: Column, o_in: str) -> Column:
                low_side, high_side = (c, o) if is_registration else (o, c)
                ordered = F.when(F.col("_by_day"), F.to_date(low_side) <= F.to_date(high_side)).otherwise(low_side <= high_side)
                none_in = ~(F.col("_oa_in") | F.col("_ob_in"))
                return F.coalesce(ordered & (F.col(o_in) | none_in), F.lit(False))

            return against(oa, "_oa_in") | against(ob, "_ob_in")

        df = df.withColumns({"_a_fits": fits(a), "_b_fits": fits(b)})
    else:
        df = df.withColumns({"_a_fits": F.lit(False), "_b_fits": F.lit(False)})
    reason = (
        F.when(is_blank(F.col(column)), "vacia")
        .when(a.isNull() & b.isNull(), "invalida")
        .when(a.isNull() | b.isNull(), F.when(F.col(f"{own}_slash"), "componente_mayor_12").otherwise("unica"))
        .when(F.col("_a_in") != F.col("_b_in"), "ventana")
        .when(F.col("_a_fits") != F.col("_b_fits"), "coherencia")
        .otherwise("por_defecto")
    )
    df = df.withColumn(f"{own}_reason", reason)
    why = F.col(f"{own}_reason")
    chosen = (
        F.when(why == "ventana", F.when(F.col("_a_in"), a).otherwise(b))
        .when(why == "coherencia", F.when(F.col("_a_fits"), a).otherwise(b))
        .when(why.isin("vacia", "invalida"), None)
        .otherwise(F.coalesce(a, b))
    )
    return df.withColumn(f"{own}_at", chosen).drop("_a_in", "_b_in", "_oa_in", "_ob_in", "_by_day", "_a_fits", "_b_fits")
