"""Matching of free-text models against the catalogue, and availability by point of sale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import text
from leadloom.functions.similarity import partial_ratio, token_set_ratio, tokens
from leadloom.operators.quality import LEADS_FILE, log_of, problem
from leadloom.operators.stage import staged


def _pairs(c: Column) -> Column:
    """Distinct two-character pieces of a text."""
    starts = F.when(F.length(c) >= 2, F.sequence(F.lit(1), F.length(c) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: c.substr(i, F.lit(2))))


def _repeats(c: Column) -> Column:
    """Pairs of a text beyond the distinct ones."""
    return F.greatest(F.length(c) - 1, F.lit(0)) - F.size(_pairs(c))


def _set_keys(words: Column) -> Column:
    """Blocking keys for `token_set_ratio` of 85 or more. It needs a shared word or, between the
    sorted texts, shared pairs of letters: d insertions and deletions leave at least
    (letters - 2 - 3d) / 2 pairs, and 85 allows d <= 0.15 * letters."""
    joined = F.array_join(words, " ")
    return F.array_union(F.transform(words, lambda w: F.concat(F.lit("w:"), w)),
                         F.transform(_pairs(joined), lambda p: F.concat(F.lit("p:"), p)))


def _best_unique(texts: DataFrame, names: DataFrame, threshold: int) -> DataFrame:
    """For each text (`limpio`, `palabras`) the catalogue row with the highest score, only when it
    reaches the threshold and no other row ties with it.

    Texts and names meet through an equi-join on blocking keys; no row of the catalogue is
    compared with a text it cannot match.
    """
    t = texts.select("limpio", "palabras", F.explode(_set_keys(F.col("palabras"))).alias("clave"))
    n = names.select("sku", "marca", "nombre_palabras", F.explode(_set_keys(F.col("nombre_palabras"))).alias("clave"))
    candidates = (
        t.join(n, "clave").groupBy("limpio", "sku")
        .agg(F.first("marca").alias("marca"), F.first("palabras").alias("palabras"), F.first("nombre_palabras").alias("nombre_palabras"),
             F.count_if(F.col("clave").startswith("w:")).alias("comunes"), F.count_if(F.col("clave").startswith("p:")).alias("pares"))
    )
    a, b = F.array_join("palabras", " "), F.array_join("nombre_palabras", " ")
    enough = F.col("pares") + _repeats(a) >= 0.275 * (F.length(a) + F.length(b)) - 1
    candidates = candidates.filter((F.col("comunes") > 0) | enough)
    scored = candidates.withColumn("puntaje", token_set_ratio(F.col("palabras"), F.col("nombre_palabras")))
    # Scores first, then the best score: neither step gathers the candidates of a text.
    per_score = scored.filter(F.col("puntaje") >= threshold).groupBy("limpio", "puntaje").agg(
        F.count(F.lit(1)).alias("empatados"), F.min("sku").alias("sku"), F.min("marca").alias("marca"))
    best = per_score.groupBy("limpio").agg(F.max_by(F.struct("puntaje", "empatados", "sku", "marca"), "puntaje").alias("m"))
    return best.filter(F.col("m.empatados") == 1).select("limpio", "m.sku", "m.marca", "m.puntaje")


def _best_brand(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """For each text the brand it contains best, when the partial score reaches the threshold.

    A partial score of 85 needs a shared pair of letters, or a shared letter when one side has
    only one.
    """
    def letters(c: Column, prefix: str) -> Column:
        return F.transform(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")), lambda x: F.concat(F.lit(prefix), x))

    none = F.array().cast("array<string>")
    t, b = F.col("limpio"), F.col("marca_baja")
    tk = F.array_union(F.transform(_pairs(t), lambda p: F.concat(F.lit("p:"), p)),
                       F.when(F.length(t) == 1, letters(t, "s:")).otherwise(letters(t, "l:")))
    bk = F.array_union(F.transform(_pairs(b), lambda p: F.concat(F.lit("p:"), p)),
                       F.array_union(letters(b, "s:"), F.when(F.length(b) == 1, letters(b, "l:")).otherwise(none)))
    candidates = (
        texts.select("limpio", F.explode(tk).alias("clave"))
        .join(brands.select("marca", "marca_baja", F.explode(bk).alias("clave")), "clave")
        .groupBy("limpio", "marca").agg(F.first("marca_baja").alias("marca_baja"), F.count(F.lit(1)).alias("pares"))
        .filter(F.col("pares") + _repeats(b) >= 0.478 * F.least(F.length(b), F.length(t)) - 1)
    )
    scored = candidates.withColumn("puntaje", partial_ratio(b, t)).filter(F.col("puntaje") >= fixed.BRAND_MATCH)
    per_score = scored.groupBy("limpio", "puntaje").agg(F.min("marca").alias("marca"))
    best = per_score.groupBy("limpio").agg(F.max_by(F.struct("puntaje", "marca"), "puntaje").alias("m"))
    return best.select("limpio", "m.marca", "m.puntaje")


def match_texts(df: DataFrame, column: str, catalogue: DataFrame) -> DataFrame:
    """One row per distinct text: `column`, `sku`, `marca`, `puntaje`, `regla`.

    Every distinct cleaned text is resolved once, whatever the number of rows that carry it.
    """
    # Staged: the filter on `limpio` would go below the distinct and clean the text of every row.
    originals = staged(df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("limpio", text.clean_model(F.col(column))))
    clean = originals.filter(F.col("limpio").isNotNull()).select("limpio").distinct().withColumn("palabras", tokens(F.col("limpio")))
    full = catalogue.select("sku", "marca", tokens(text.clean_model(F.concat_ws(" ", "marca", "linea"))).alias("nombre_palabras"))
    lines = catalogue.select("sku", "marca", tokens(text.clean_model(F.col("linea"))).alias("nombre_palabras"))
    brands = catalogue.select("marca", F.lower("marca").alias("marca_baja")).distinct()
    # The three rules run side by side over the distinct texts; the first that answers wins.
    answers = (
        _best_unique(clean, full, fixed.FULL_MATCH).withColumn("orden", F.lit(0))
        .unionByName(_best_unique(clean, lines, fixed.LINE_MATCH).withColumn("orden", F.lit(1)))
        .unionByName(_best_brand(clean, brands).select("limpio", F.lit(None).cast("string").alias("sku"), "marca", "puntaje", F.lit(2).alias("orden")))
    )
    first = answers.groupBy("limpio").agg(F.min_by(F.struct("sku", "marca", "puntaje", "orden"), "orden").alias("r"))
    names = F.element_at(F.array(F.lit("coincidencia_completa"), F.lit("coincidencia_linea"), F.lit("modelo_ambiguo")), F.col("r.orden") + 1)
    resolved = first.select("limpio", "r.sku", "r.marca", "r.puntaje", names.alias("regla"))
    rule = F.coalesce("regla", F.when(F.col("limpio").isNull(), "modelo_faltante").otherwise("sin_coincidencia"))
    return originals.join(resolved, "limpio", "left").select(column, "sku", "marca", "puntaje", rule.alias("regla"))


def availability(catalogue_raw: DataFrame) -> DataFrame:
    """Bridge (sku, punto_venta_id) from the pipe-separated list."""
    points = F.explode(F.split(F.col("puntos_venta_disponibles").cast("string"), r"\|"))
    return (
        catalogue_raw.select(text.strip(F.col("sku")).alias("sku"), points.alias("p"))
        .select("sku", text.strip(F.col("p")).alias("punto_venta_id")).filter(F.col("punto_venta_id") != "").distinct()
    )


def with_availability(leads: DataFrame, bridge: DataFrame) -> DataFrame:
    """Adds `modelo_disponible_pv`: NULL without a sku, else whether the point of sale has it."""
    b = bridge.select(F.col("sku").alias("sku_interes"), F.col("punto_venta_id").cast(leads.schema["punto_venta_id"].dataType), F.lit(True).alias("hay"))
    joined = leads.join(b, ["sku_interes", "punto_venta_id"], "left")
    return joined.withColumn(
        "modelo_disponible_pv", F.when(F.col("sku_interes").isNotNull(), F.coalesce("hay", F.lit(False)))
    ).drop("hay")


def assign_models(leads: DataFrame, catalogue: DataFrame, bridge: DataFrame) -> DataFrame:
    """Leads with sku, brand, score, rule and availability."""
    found = match_texts(leads, "modelo_texto_original", catalogue).select(
        "modelo_texto_original", F.col("sku").alias("sku_interes"), F.col("marca").alias("marca_interes"),
        F.col("puntaje").alias("match_modelo_score"), "regla",
    )
    df = leads.join(found, "modelo_texto_original", "left").withColumn("regla", F.coalesce("regla", F.lit("modelo_faltante")))
    return with_availability(df, bridge)


def model_log(matched: DataFrame) -> DataFrame:
    """Log of the leads whose model is ambiguous, missing or unknown."""
    rule = F.col("regla")
    action = (
        F.when(rule == "modelo_ambiguo", F.concat(F.lit("solo marca "), F.col("marca_interes")))
        .when(rule == "modelo_faltante", "sin modelo").otherwise("sin SKU ni marca")
    )
    return log_of(matched, LEADS_FILE, F.col("lead_id"), F.col("empresa_id"), [
        problem(rule.isin("modelo_ambiguo", "modelo_faltante", "sin_coincidencia"), "modelo_interes_texto", rule,
                F.col("modelo_texto_original"), action),
    ])
