"""What one client message says: amounts, models named and the signals of the pattern list."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions.text import FLAGS, matches


def _last(c: Column, pattern: str | Column, group: int) -> Column:
    flagged = F.lit(FLAGS + pattern) if isinstance(pattern, str) else F.concat(F.lit(FLAGS), pattern)
    return F.try_element_at(F.regexp_extract_all(c, flagged, F.lit(group)), F.lit(-1))


def _end(c: Column, pattern: str) -> Column:
    """Position where the last match ends, 0 without a match."""
    return F.length(F.regexp_extract(c, FLAGS + "(?s)^.*(?:" + pattern + ")", 0))


def amount(c: Column) -> Column:
    """Pesos of the amount that ends last in the text, NULL without amounts."""
    units = F.create_map(*(F.lit(x) for pair in fixed.UNIT_PESOS.items() for x in pair))
    number = F.replace(_last(c, fixed.AMOUNT, 1), F.lit(","), F.lit(".")).try_cast("decimal(30,10)")
    slang = F.bround(number * F.try_element_at(units, F.lower(_last(c, fixed.AMOUNT, 2))), 0).try_cast("long")
    full = F.replace(_last(c, fixed.PESOS, 1), F.lit("."), F.lit("")).try_cast("long")
    slang_end, full_end = _end(c, fixed.AMOUNT), _end(c, fixed.PESOS)
    return F.when(slang_end > full_end, slang).when(full_end > 0, full)


def brand_pattern(brands: Sequence[str] | DataFrame) -> Column:
    """Pattern of a brand and what follows it, longest brand first. Brands come as a list or as the
    column `marca` of a catalogue; a catalogue's pattern is a scalar subquery, so nothing is collected."""
    opening, tail = F.lit(r"\b("), F.lit(r")\b([\w\s.\-]*)")
    if not isinstance(brands, DataFrame):
        names = sorted(brands, key=lambda b: (-len(b), b))
        return F.concat(opening, F.lit("|".join(re.sub(r"([^\w\s])", r"\\\1", b) for b in names)), tail)
    name = F.regexp_replace("marca", r"(?U)([^\w\s])", r"\\$1")
    longest_first = F.array_sort(F.collect_set(F.struct((-F.length("marca")).alias("n"), F.col("marca").alias("m"), name.alias("p"))))
    return F.concat(opening, brands.agg(F.array_join(F.transform(longest_first, lambda x: x["p"]), "|").alias("p")).select("p").scalar(), tail)


def with_model(df: DataFrame, column: str, pattern: Column, name: str) -> DataFrame:
    """Adds the last model of a message. The pattern may be a scalar subquery, which functions over arrays
    do not take, so what it finds becomes columns first."""
    found = df.withColumns({"_marca": _last(F.col(column), pattern, 1), "_resto": _last(F.col(column), pattern, 2)})
    return found.withColumn(name, model_of(F.col("_marca"), F.col("_resto"))).drop("_marca", "_resto")


def model_of(brand: Column, tail: Column) -> Column:
    """A model from what the pattern finds: the brand and up to three parts with digits or a capital first."""
    words = F.filter(F.split(tail, r"(?U)\s+"), lambda w: w != "")
    stops = F.transform(words, lambda w: ~(w.rlike(r"\d") | w.rlike(r"^\p{Lu}")))
    first_stop = F.array_position(stops, True)
    keep = F.least(F.when(first_stop > 0, first_stop - 1).otherwise(F.size(words)), F.lit(3)).cast("int")
    parts = F.transform(F.slice(words, F.lit(1), keep), lambda w: F.btrim(w, F.lit(".,;:¿?¡!")))
    return F.when(brand.isNotNull(), F.array_join(F.filter(F.concat(F.array(brand), parts), lambda p: p != ""), " "))


def signals(c: Column) -> dict[str, Column]:
    """One boolean per pattern, evaluated once per message."""
    patterns = {
        "sin_inicial": fixed.NO_DOWN_PAYMENT, "contado": fixed.CASH, "credito": fixed.CREDIT,
        "cita": fixed.APPOINTMENT, "cotizacion": fixed.QUOTE_REQUEST, "urgencia": fixed.URGENCY,
        "desinteres": fixed.DISINTEREST, "unidad": fixed.AMOUNT,
    }
    patterns |= {f"obj_{n}": p for n, p in fixed.OBJECTIONS.items() if n not in ("sin_inicial", "solo_averiguando")}
    return {f"s_{name}": matches(c, p) for name, p in patterns.items()}
