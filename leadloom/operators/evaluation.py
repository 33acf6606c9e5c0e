"""Validation of the score on labelled history, policy metrics and extraction quality."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions.stats import ratio, uniform, wilson
from leadloom.functions.text import client_template_key, match_key
from leadloom.operators import regression
from leadloom.operators.ranking import id_levels, with_rank
from leadloom.sources.tables import materialize
from leadloom.operators.scoring import hours_points, temperature

SIGNAL_COLUMNS = {"cita": "pidio_cita", "cuota": "manifesto_cuota_inicial", "contado": "forma_pago_declarada"}


def _scores(name: str) -> Column:
    return F.col(SIGNAL_COLUMNS[name]).isin(*fixed.SCORING_STATES[name])


def prepare(history: DataFrame, split: str = fixed.SPLIT_DATE) -> DataFrame:
    """Managed history with the four signals, quality points, temperature and test mark."""
    df = history.filter(F.col("desenlace") != fixed.UNMANAGED).withColumns({
        "cerrado": (F.col("desenlace") == "Cerrado").cast("int"),
        **{f"s_{n}": F.coalesce(_scores(n), F.lit(False)).cast("int") for n in SIGNAL_COLUMNS},
        "s_precio_alto": (F.col("precio_lista") >= fixed.HIGH_PRICE).cast("int"),
        "prueba": F.col("fecha_registro") >= F.lit(split).cast("date"),
    })
    points = sum((F.col(f"s_{n}") * w for n, w in fixed.POINTS.items()), F.lit(0))
    return df.withColumn("puntos", points).withColumn("temperatura", temperature(F.col("puntos")))


def temperature_table(df: DataFrame) -> DataFrame:
    """Closing rate by temperature on everything and on the test window, with its interval."""
    test = F.col("prueba")
    t = df.groupBy("temperatura").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cerrado").alias("cierres"),
        F.count_if(test).alias("n_prueba"), F.coalesce(F.sum(F.when(test, F.col("cerrado"))), F.lit(0)).alias("cierres_prueba"))
    _, low, high = wilson(F.col("cierres_prueba"), F.col("n_prueba"))
    return t.withColumns({"tasa": ratio(F.col("cierres"), F.col("n")), "tasa_prueba": ratio(F.col("cierres_prueba"), F.col("n_prueba")), "ic_bajo": low, "ic_alto": high})


def hot_cold_ratio(df: DataFrame, minimum: float = fixed.MIN_RATIO) -> DataFrame:
    """How much more the hot leads close than the cold ones, and whether that meets the criterion."""
    def rate(name: str) -> Column:
        chosen = F.col("temperatura") == name
        return ratio(F.sum(F.when(chosen, F.col("cerrado"))), F.count_if(chosen))

    r = df.agg(rate(fixed.HOT).alias("caliente"), rate(fixed.COLD).alias("frio"))
    return r.withColumn("razon", ratio(F.col("caliente"), F.col("frio"))).withColumn("cumple", F.coalesce(F.col("razon") >= minimum, F.lit(False)))


def bootstrap_ratio(df: DataFrame, replicates: int = fixed.BOOTSTRAP, seed: int = 2026) -> DataFrame:
    """Percentile interval of the hot / cold ratio.

    Resampling a group of 0/1 outcomes with replacement only changes its number of successes, which
    is binomial. The history reduces to four counts; each replicate draws two numbers by the inverse of the
    distribution from a hash of seed, replicate and group, so reruns and other engines agree.
    """
    hot, cold = F.col("temperatura") == fixed.HOT, F.col("temperatura") == fixed.COLD
    group = F.when(hot, "caliente").when(cold, "frio")
    counts = df.filter(hot | cold).groupBy(group.alias("grupo")).agg(F.count(F.lit(1)).alias("n"), F.sum("cerrado").alias("x"))
    draws = counts.select("grupo", "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    draws = draws.withColumn("u", uniform(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), "grupo")))
    drawn = inverse_draws(draws, binomial_table(counts), ["grupo"])
    rate = lambda name: F.max(F.when(F.col("grupo") == name, F.col("k") / F.col("n")))
    ratios = drawn.groupBy("rep").agg(rate("caliente").alias("a"), rate("frio").alias("b")).filter("b > 0").select((F.col("a") / F.col("b")).alias("razon"))
    ratios = ratios.filter(F.col("razon").isNotNull())
    return ratios.agg(F.percentile("razon", F.lit(0.025)).alias("bajo"), F.percentile("razon", F.lit(0.975)).alias("alto"), F.count(F.lit(1)).alias("replicas"))


def binomial_table(counts: DataFrame) -> DataFrame:
    """grupo, k, hasta: the distribution of x successes in n resampled, over nine standard deviations on both sides (beyond
    lies less than 1e-17). The table grows with the root of n. A sure outcome is one row."""
    n, x = F.col("n").cast("double"), F.col("x").cast("double")
    reach = F.ceil(9 * F.sqrt(x * (1 - x / n)) + 9)
    sure = (F.col("x") == 0) | (F.col("x") == F.col("n"))
    low = F.when(sure, F.col("x")).otherwise(F.greatest(F.lit(0), F.col("x") - reach)).cast("long")
    high = F.when(sure, F.col("x")).otherwise(F.least(F.col("n"), F.col("x") + reach)).cast("long")
    k = counts.select("grupo", "n", "x", low.alias("desde"), F.explode(F.sequence(low, high)).alias("k"))
    step = F.when(F.col("k") == F.col("desde"), 0.0).otherwise(F.ln((n - F.col("k") + 1) / F.col("k") * (x / (n - x))))
    order = Window.partitionBy("grupo").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = k.withColumn("l", F.sum(step).over(order))
    mass = logs.withColumn("m", F.exp(F.col("l") - F.max("l").over(Window.partitionBy("grupo"))))
    return mass.select("grupo", "k", (F.sum("m").over(order) / F.sum("m").over(Window.partitionBy("grupo"))).alias("hasta"))


def inverse_draws(draws: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Adds k, the least value of the distribution table whose cumulated share exceeds u. Draws and table are sorted together."""
    both = draws.unionByName(table.select(*keys, "k", F.col("hasta").alias("u")), allowMissingColumns=True)
    # Of the table rows above a draw the next one, in falling order the last seen; a table row of the same share does not exceed it.
    order = Window.partitionBy(*keys).orderBy(F.desc("u"), F.col("k").isNotNull(), F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("siguiente", F.last("k", ignorenulls=True).over(order))
    most = table.groupBy(*keys).agg(F.max("k").alias("mayor"))
    return found.filter(F.col("k").isNull()).drop("k").join(most, keys).select(*draws.columns, F.coalesce("siguiente", "mayor").alias("k"))


def auc(df: DataFrame, score: str, label: str, group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half, per group. With `weight` a row stands for so many.

    Rows collapse to counts per score value; cumulative counts run over whole points of score, over
    blocks inside a point, and over values inside a block, so no step holds all values of a group.
    """
    group = group or []
    times = F.lit(1) if weight is None else F.col(weight).cast("long")
    block = F.floor(F.col(score).cast("double") * 4096).cast("long")
    values = df.groupBy(*group, F.col(score).alias("v"), block.alias("b")).agg(
        F.sum(F.col(label).cast("long") * times).alias("pos"), F.sum((1 - F.col(label).cast("long")) * times).alias("neg"))
    point = F.shiftright("b", 12)
    earlier = lambda order, *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = values.groupBy(*group, point.alias("p"), "b").agg(F.sum("neg").alias("n"))
    points_ = blocks.groupBy(*group, "p").agg(F.sum("n").alias("n")).select(*group, "p", earlier("p", *group).alias("antes_p"))
    blocks = blocks.withColumn("antes_b", earlier("b", *group, "p")).join(points_, [*group, "p"]).withColumn("antes", F.col("antes_p") + F.col("antes_b"))
    inside = Window.partitionBy(*group, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.join(blocks.select(*group, "b", "antes"), [*group, "b"]).withColumn("menores", F.col("antes") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("menores") + F.col("neg") / F.lit(2.0)))
    return ranked.groupBy(*group).agg(ratio(wins, F.sum("pos") * F.sum("neg")).alias("auc"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def _grouped(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows with their number: the loss of a regression stays the same, and few rows are left of columns with few values."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("peso"))


def trained_weights_auc(df: DataFrame) -> DataFrame:
    """Test AUC of weights learned on the train window from the four quality signals."""
    features = [f"s_{n}" for n in fixed.POINTS]
    fitted = regression.fit(_grouped(df.filter(~F.col("prueba")), *features, "cerrado"), features, "cerrado", {"m": F.lit(True)})
    return auc(df.filter("prueba").withColumn("proba", regression.probability(features, fitted["m"])), "proba", "cerrado")


def attribute_regression(df: DataFrame, folds: int = 5) -> DataFrame:
    """AUC of a regression on channel, down-payment, payment, appointment and price: cross-validated,
    temporal and in sample. Folds are the rank inside each class modulo the number of folds; all fits
    step together."""
    base = df.withColumns({
        "x_meta": (F.col("canal") == "Meta Ads").cast("double"), "x_whatsapp": (F.col("canal") == "WhatsApp").cast("double"),
        "x_cuota_si": (F.col("manifesto_cuota_inicial") == "SI").cast("double"), "x_cuota_ni": (F.col("manifesto_cuota_inicial") == "NO_INFORMA").cast("double"),
        "x_credito": (F.col("forma_pago_declarada") == "credito").cast("double"), "x_pago_ni": (F.col("forma_pago_declarada") == "no_informa").cast("double"),
        "x_cita": F.col("pidio_cita").cast("double"), "x_precio": F.col("precio_lista") / F.lit(1_000_000.0)})
    features = [c for c in base.columns if c.startswith("x_")]
    base = base.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in features})
    ranked = with_rank(base, ["cerrado"], [("lead_id", True)], id_levels(base, "lead_id"), "r").withColumn("pliegue", F.col("r") % folds)
    rows = materialize(_grouped(ranked, *features, "cerrado", "prueba", "pliegue"), "folds")
    sets = {f"f{k}": F.col("pliegue") != k for k in range(folds)} | {"temporal": ~F.col("prueba"), "todo": F.lit(True)}
    fitted = regression.fit(rows, features, "cerrado", sets)
    of = lambda name: regression.probability(features, fitted[name])
    held = reduce(lambda rest, k: F.when(F.col("pliegue") == k, of(f"f{k}")).otherwise(rest), range(folds), F.lit(None).cast("double"))
    judged = F.explode(F.array(
        F.struct(F.lit("validacion_cruzada").alias("evaluacion"), held.alias("proba")), F.struct(F.lit("temporal").alias("evaluacion"), F.when(F.col("prueba"), of("temporal")).alias("proba")),
        F.struct(F.lit("en_muestra").alias("evaluacion"), of("todo").alias("proba"))))
    scored = rows.select("cerrado", "peso", judged.alias("j")).select("cerrado", "peso", "j.*").filter(F.col("proba").isNotNull())
    return auc(scored, "proba", "cerrado", ["evaluacion"], weight="peso").select("auc", "n", "evaluacion")


def state_table(df: DataFrame) -> DataFrame:
    """Closing rate of every state of every signal with the points it gets, all / train / test."""
    pairs = F.array(*(F.struct(F.lit(n).alias("senal"), F.col(c).cast("string").alias("estado"),
                               F.when(F.col(f"s_{n}") == 1, fixed.POINTS[n]).otherwise(0).alias("puntos_estado")) for n, c in SIGNAL_COLUMNS.items()))
    long = df.select(F.explode(pairs).alias("p"), "cerrado", "prueba").select("p.*", "cerrado", "prueba")

    def rate(when: Column) -> Column:
        return ratio(F.sum(F.when(when, F.col("cerrado"))), F.count_if(when))

    return long.groupBy("senal", "estado", "puntos_estado").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cerrado").alias("cierres"), rate(F.lit(True)).alias("tasa"),
        rate(~F.col("prueba")).alias("tasa_entrenamiento"), rate(F.col("prueba")).alias("tasa_prueba"))


def incoherent_signals(df: DataFrame) -> DataFrame:
    """Per signal, whether a state without points closes more than one with points."""
    t = state_table(df)
    zero = F.col("puntos_estado") == 0
    return t.groupBy("senal").agg(
        F.max(F.when(zero, F.col("tasa"))).alias("max_sin"), F.min(F.when(~zero, F.col("tasa"))).alias("min_con")
    ).withColumn("incoherente", F.coalesce(F.col("max_sin") > F.col("min_con"), F.lit(False)))


def expected_without_chat(df: DataFrame) -> DataFrame:
    """Average points of the three chat signals: what a lead without chat is worth."""
    return df.agg(sum((F.avg(F.col(f"s_{n}")) * fixed.POINTS[n] for n in SIGNAL_COLUMNS), F.lit(0.0)).alias("esperado"))


# --- policies ---------------------------------------------------------------------------------
def day_ranks(df: DataFrame) -> DataFrame:
    """Position of each lead in its day by arrival and by score, and the size of the day."""
    ids = id_levels(df, "lead_id")
    r = with_rank(df, ["fecha_registro"], [("lead_id", True)], ids, "por_llegada")
    r = with_rank(r, ["fecha_registro"], [("puntos", False), ("lead_id", True)], [(F.col("puntos"), False), *ids], "por_puntaje")
    sizes = df.groupBy("fecha_registro").agg(F.count(F.lit(1)).alias("del_dia"))
    return r.join(sizes, "fecha_registro")


def quota(n: Column, fraction: Column) -> Column:
    """Leads handled in a day of n: the fraction rounded up, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(n * fraction).cast("long"))


def captured_closings(df: DataFrame, capacities=fixed.CAPACITIES) -> DataFrame:
    """Closings inside the daily quota by arrival, at random (exact expectation) and by score."""
    day = day_ranks(df).select("fecha_registro", "del_dia", "cerrado", "por_llegada", "por_puntaje",
                               F.explode(F.array(*map(F.lit, capacities))).alias("capacidad"))
    k = quota(F.col("del_dia"), F.col("capacidad"))
    by_day = day.groupBy("capacidad", "fecha_registro").agg(
        F.sum(F.when(F.col("por_llegada") <= k, F.col("cerrado")).otherwise(0)).alias("llegada"),
        F.sum(F.when(F.col("por_puntaje") <= k, F.col("cerrado")).otherwise(0)).alias("puntaje"),
        (F.least(F.first(k), F.first("del_dia")) * F.sum("cerrado") / F.first("del_dia")).alias("azar"))
    total = by_day.groupBy("capacidad").agg(F.sum("llegada").alias("llegada"), F.sum("puntaje").alias("puntaje"), F.sum("azar").alias("azar"))
    gain = F.col("puntaje") - F.col("llegada")
    return total.withColumns({"ganancia": gain, "ganancia_pct": ratio(gain, F.col("llegada")) * 100})


def wait_factors(df: DataFrame, days: int = fixed.MAX_WAIT_DAYS) -> DataFrame:
    """Share of the closing probability kept after whole days of wait, never increasing."""
    rates = df.groupBy(F.floor(F.col("horas_al_primer_contacto") / 24).cast("int").alias("dia")).agg(F.avg("cerrado").alias("tasa"))
    spine = df.sparkSession.range(days + 1).select(F.col("id").cast("int").alias("dia"))
    first = rates.filter("dia = 0").select("tasa").scalar()
    joined = spine.join(rates, "dia", "left").withColumn("f", ratio(F.col("tasa"), first))
    running = Window.orderBy("dia").rowsBetween(Window.unboundedPreceding, 0)  # six rows
    return joined.select("dia", F.least(F.lit(1.0), F.coalesce(F.min("f").over(running), F.lit(1.0))).alias("factor"))


def kept(factor: Column, effect: Column) -> Column:
    return 1 - effect * (1 - factor)


def base_probability(df: DataFrame, factors: DataFrame, effects=fixed.CAUSAL_EFFECTS) -> DataFrame:
    """Same-day closing probability per temperature and assumed causal effect."""
    last = fixed.MAX_WAIT_DAYS
    counts = df.groupBy("temperatura", F.least(F.lit(last), F.greatest(F.lit(0), F.floor(F.col("horas_al_primer_contacto") / 24).cast("int"))).alias("dia")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cerrado").alias("cierres"))
    rows = counts.join(factors, "dia").withColumn("efecto", F.explode(F.array(*map(F.lit, effects))))
    return rows.groupBy("temperatura", "efecto").agg(ratio(F.sum("cierres"), F.sum(F.col("n") * kept(F.col("factor"), F.col("efecto")))).alias("base"))


def expected_closings(attended: DataFrame, base: DataFrame, factors: DataFrame) -> DataFrame:
    """Expected closings of attended leads (`temperatura`, `espera` in days) per assumed effect. A wait
    without a factor or a temperature without a base fails the run: no lead is left out."""
    counts = attended.groupBy("temperatura", F.col("espera").cast("int").alias("dia")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(factors, "dia", "left").join(base, "temperatura", "left")
    known = lambda c, what: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"expected closings: no {c} for "), what.cast("string"))).cast("double"))
    rows = rows.withColumns({"factor": known("factor", F.coalesce("dia", F.lit(-1))), "base": known("base", F.coalesce("temperatura", F.lit("null")))})
    return rows.groupBy("efecto").agg(F.sum(F.col("n") * F.col("base") * kept(F.col("factor"), F.col("efecto"))).alias("cierres_esperados"))


def queue_orders(backlog: DataFrame) -> DataFrame:
    """Position of every pending lead under four policies, as of the newest day of the backlog.

    All four orders compare days and points and then ids, and the urgency of a day is one number, so two positions by
    id, within a day and within its leads of equal points, serve all of them. They are taken inside blocks of ids; what lies
    before a block comes from one table of counts by day, points and block, which meets the leads in one join.
    """
    today = backlog.agg(F.max("fecha_registro").alias("d")).select("d").scalar()
    hours = F.datediff(today, F.col("fecha_registro")) * 24 + fixed.ARRIVAL_HOURS
    block, _ = id_levels(backlog, "lead_id")[-1]
    df = backlog.withColumns({"urgencia": F.col("puntos") + hours_points(hours), "_b": block})
    cell = ["fecha_registro", "_b", "puntos"]
    counts = materialize(df.groupBy(*cell, "urgencia").agg(F.count(F.lit(1)).alias("n")), "backlog-counts")

    def before(name: str, within: list[str], *order: Column) -> DataFrame:
        """Leads before each value of the last key inside the values of the others."""
        window = Window.partitionBy(*within[:-1]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.groupBy(*within).agg(F.sum("n").alias("n")).select(*within, F.coalesce(F.sum("n").over(window), F.lit(0)).alias(name))

    day, down = F.col("fecha_registro"), lambda c: F.col(c).desc()
    parts = [
        before("_vieja", ["fecha_registro"], day.asc()), before("_nueva", ["fecha_registro"], day.desc()), before("_bloque", ["fecha_registro", "_b"], F.col("_b").asc()),
        before("_puntos", ["puntos"], down("puntos")), before("_puntos_dia", ["puntos", "fecha_registro"], day.asc()), before("_bloque_puntos", ["fecha_registro", "puntos", "_b"], F.col("_b").asc()),
        before("_urgencia", ["urgencia"], down("urgencia")), before("_urgencia_dia", ["urgencia", "fecha_registro"], day.asc()),
    ]
    offsets = reduce(lambda table, part: table.join(part, [c for c in part.columns if not c.startswith("_") or c == "_b"]), parts, counts.drop("n"))
    offsets = offsets.select(
        *cell, (F.col("_vieja") + F.col("_bloque")).alias("_1"), (F.col("_nueva") + F.col("_bloque")).alias("_2"),
        (F.col("_puntos") + F.col("_puntos_dia") + F.col("_bloque_puntos")).alias("_3"), (F.col("_urgencia") + F.col("_urgencia_dia") + F.col("_bloque_puntos")).alias("_4"))
    of_day, of_points = (F.row_number().over(Window.partitionBy(*keys).orderBy("lead_id")).cast("long") for keys in (cell[:2], cell))
    placed = df.repartition(*cell[:2]).withColumns({"_d": of_day, "_p": of_points}).join(offsets, cell)
    return placed.withColumns({
        "llegada": F.col("_1") + F.col("_d"), "reciente": F.col("_2") + F.col("_d"), "calidad": F.col("_3") + F.col("_p"), "completo": F.col("_4") + F.col("_p"),
    }).drop("_b", "_d", "_p", "_1", "_2", "_3", "_4")


# --- extraction quality -----------------------------------------------------------------------
def field_accuracy(labels: DataFrame, extraction: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Hits and total per field over reviewed labels that have an extraction.

    `labels` has the evaluated fields, `revisado` and `etiquetados`, the fields the label carries.
    """
    def same(name: str) -> Column:
        want, got = F.col(f"g.{name}"), F.col(f"e.{name}")
        if name == "cuota_inicial_cop":
            near = F.when(want == 0, got == 0).otherwise(F.abs(got - want) <= tolerance * F.abs(want))
            return F.when(want.isNull() | got.isNull(), want.isNull() & got.isNull()).otherwise(near)
        if name == "modelo_texto":
            return match_key(want).eqNullSafe(match_key(got))
        return want.eqNullSafe(got)

    gold = labels.filter("revisado").select("conversacion_id", F.struct(*(c for c in labels.columns if c != "conversacion_id")).alias("g"))
    found = extraction.select("conversacion_id", F.struct(*fixed.EVALUATED_FIELDS).alias("e"))
    both = gold.join(found, "conversacion_id")
    checks = F.array(*(F.struct(F.lit(n).alias("campo"), same(n).alias("acierto"), F.array_contains("g.etiquetados", n).alias("cuenta")) for n in fixed.EVALUATED_FIELDS))
    long = both.select(F.explode(checks).alias("c")).select("c.*").filter("cuenta")
    t = long.groupBy("campo").agg(F.count_if("acierto").alias("aciertos"), F.count(F.lit(1)).alias("total"))
    rate, low, high = wilson(F.col("aciertos"), F.col("total"))
    return t.withColumns({"exactitud": rate, "ic_bajo": low, "ic_alto": high})


def macro_accuracy(table: DataFrame) -> DataFrame:
    return table.agg(F.avg("exactitud").alias("promedio"), F.count(F.lit(1)).alias("campos"))


def rewrite_clients(messages: DataFrame, substitutions: list[tuple[str, str]]) -> DataFrame:
    """Client messages with literal, case-insensitive substitutions, longest first; advisor messages
    stay. Adds `usadas`, the substitutions applied, and `cambiado`."""
    ordered = sorted(substitutions, key=lambda s: (-len(s[0]), s[0]))
    pairs = [(o, "(?iu)" + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", o), n.replace("\\", "\\\\").replace("$", "\\$")) for o, n in ordered]
    steps = F.array(*(F.struct(F.lit(o).alias("original"), F.lit(p).alias("patron"), F.lit(n).alias("nuevo")) for o, p, n in pairs))
    start = F.struct(F.col("texto").alias("texto"), F.array().cast("array<string>").alias("usadas"))

    def apply(state: Column, step: Column) -> Column:
        hit = F.rlike(state["texto"], step["patron"])
        return F.when(hit, F.struct(
            F.regexp_replace(state["texto"], step["patron"], step["nuevo"]).alias("texto"),
            F.array_append(state["usadas"], step["original"]).alias("usadas"))).otherwise(state)

    mine = (F.col("emisor") == "cliente") & F.col("texto").isNotNull()
    df = messages.withColumn("_r", F.when(mine, F.aggregate(steps, start, apply)).otherwise(start))
    return df.withColumns({
        "usadas": F.col("_r.usadas"), "cambiado": ~F.col("_r.texto").eqNullSafe(F.col("texto")), "texto": F.col("_r.texto")}).drop("_r")


def phrase_templates(messages: DataFrame, names: list[str]) -> DataFrame:
    """Client phrases without what varies: models as <MOTO>, figures as <N>."""
    rows = messages.filter(F.col("emisor") == "cliente")
    return rows.select("conversacion_id", "orden", client_template_key(F.col("texto"), names).alias("molde"))


def vocabulary(messages: DataFrame, names: list[str]) -> DataFrame:
    return phrase_templates(messages, names).agg(F.count(F.lit(1)).alias("mensajes"), F.count_distinct("molde").alias("moldes"))


def stratified_sample(messages: DataFrame, chats: DataFrame, brands: Column, size: int = fixed.SAMPLE_SIZE, quota_: int = fixed.PER_STRATUM) -> DataFrame:
    """Deterministic sample: two chats per difficulty, first ids first, completed with ordinary ones.

    Every chat is marked once. Only the first few candidates of each stratum can be chosen, so the
    sequential choice runs over a table whose size depends on the number of strata alone.
    """
    from leadloom.functions.text import FLAGS, matches, squeeze
    from leadloom.operators.extraction import CHAT, client_messages

    said = client_messages(messages)
    pattern = F.replace(brands, F.lit(r"([\w\s.\-]*)"), F.lit(r"[\w\s.\-]{0,20}"))
    found = said.withColumn("halladas", F.regexp_extract_all("texto", F.concat(F.lit(FLAGS), pattern), F.lit(0)))
    marks = found.withColumn("modelos", F.transform("halladas", lambda m: squeeze(m))).groupBy(CHAT).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array_min("modelos")).alias("m1"), F.max(F.array_max("modelos")).alias("m2"),
        *(F.bool_or(matches(F.col("texto"), p)).alias(f"e_{n}") for n, p in fixed.STRATA.items()))
    df = chats.select(CHAT).join(marks, CHAT, "left")
    strata = ["sin_respuesta", "cambio_de_modelo", *fixed.STRATA, "corriente"]
    holds = {"sin_respuesta": F.coalesce("n", F.lit(0)) <= 1, "cambio_de_modelo": F.col("m1") != F.col("m2"), "corriente": F.lit(True),
             **{n: F.col(f"e_{n}") for n in fixed.STRATA}}
    tagged = df.select(CHAT, F.explode(F.filter(F.array(*(F.when(F.coalesce(holds[s], F.lit(False)), i) for i, s in enumerate(strata))), lambda x: x.isNotNull())).alias("estrato_n"))
    first = Window.partitionBy("estrato_n").orderBy(CHAT)
    top = tagged.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= size + quota_)  # partial top-k before the shuffle

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        chosen: dict = {}
        for i, name in enumerate(strata):
            room = size - len(chosen) if name == "corriente" else quota_
            free = [c for c in sorted(rows.loc[rows.estrato_n == i, CHAT]) if c not in chosen]
            chosen.update({c: name for c in free[:room]})
        return pd.DataFrame([(c, s, k + 1) for k, (c, s) in enumerate(chosen.items()) if k < size], columns=[CHAT, "estrato", "posicion"])

    kind = chats.schema[CHAT].dataType.simpleString()
    return top.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(choose, f"{CHAT} {kind}, estrato string, posicion long")
