"""Additive, explainable score of the eligible leads at a cut-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.operators.entities import CLIENT, channels_per_client

REASON = "struct<factor:string,puntos:int,valor:double>"


def cutoff(leads: DataFrame, day: str | None = None) -> DataFrame:
    """One row: `fecha_corte` (given, else the last registration day) and `momento`, the latest
    registration up to the end of that day, else the end of the day."""
    at = F.col("fecha_registro")
    if day is None:
        one = leads.agg(F.to_date(F.max(at)).alias("fecha_corte"), F.max(at).alias("ultimo"))
    else:
        end = F.lit(f"{day} 23:59:59.999999").cast("timestamp_ntz")
        one = leads.agg(F.lit(day).cast("date").alias("fecha_corte"), F.max(F.when(at <= end, at)).alias("ultimo"))
    end = F.expr("cast(fecha_corte as timestamp_ntz) + interval '0 23:59:59.999999' day to second")
    return one.select("fecha_corte", F.coalesce("ultimo", end).alias("momento"))


def with_cutoff(leads: DataFrame, cut: DataFrame) -> DataFrame:
    """Attaches the cut-off as scalar subqueries: it is one row, and no join is planned."""
    return leads.withColumns({
        "fecha_corte": cut.select("fecha_corte").scalar(), "momento": cut.select("momento").scalar()})


def eligible(leads: DataFrame, days: int = fixed.LIST_DAYS) -> DataFrame:
    """Principal, not discarded and registered within the list window; expects `momento`."""
    since = F.expr(f"momento - interval '{days}' day")
    return leads.filter(
        F.col("es_principal") & (F.col("estado_gestion") != fixed.DISCARDED)
        & (F.col("fecha_registro") >= since) & (F.col("fecha_registro") <= F.col("momento"))
    )


def _reason(when: Column, factor: Column | str, points: Column | int, value: Column | None = None) -> Column:
    """One optional reason, with its points counted only where it holds."""
    return F.when(F.coalesce(when, F.lit(False)), F.struct(
        (F.lit(factor) if isinstance(factor, str) else factor).alias("factor"),
        (F.lit(points) if isinstance(points, int) else points).cast("int").alias("puntos"),
        (F.lit(None) if value is None else value).cast("double").alias("valor"),
    ).cast(REASON))


def _listed(reasons: list[Column]) -> Column:
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def _total(reasons: Column) -> Column:
    return F.aggregate(reasons, F.lit(0), lambda acc, r: acc + r["puntos"])


def quality_reasons(price: Column) -> list[Column]:
    p, talked = fixed.POINTS, F.col("con_senales")
    pay = F.col("forma_pago")
    return [
        _reason(~talked, "sin conversación: valor esperado de cita, cuota y contado", fixed.NO_CHAT_POINTS),
        _reason(talked & F.col("pidio_cita"), "pidió cita", p["cita"]),
        _reason(talked & F.col("menciona_cuota").isin(*fixed.SCORING_STATES["cuota"]), "manifestó cuota inicial", p["cuota"], F.col("cuota_inicial_cop")),
        _reason(price >= fixed.HIGH_PRICE, "modelo de gama alta", p["precio_alto"], price),
        _reason(talked & pay.isin(*fixed.SCORING_STATES["contado"]),
                F.when(pay == "contado", "paga de contado").otherwise("no dijo la forma de pago (en el histórico cierra como contado)"), p["contado"]),
    ]


def chat_reasons() -> list[Column]:
    talked, objection = F.col("con_senales"), F.col("objecion")
    return [
        _reason(talked & (F.col("intencion") == "alta"), "intención alta", fixed.HIGH_INTENT),
        _reason(talked & (F.col("intencion") == "baja"), "intención baja", fixed.LOW_INTENT),
        _reason(talked & objection.isin(*fixed.BLOCKING_OBJECTIONS), F.concat(F.lit("objeción: "), objection), fixed.BLOCKING),
        _reason(talked & ~F.col("cliente_respondio"), "el cliente no respondió", fixed.SILENT),
        _reason(F.col("canales") > 1, "escribió por varios canales", fixed.MULTICHANNEL, F.col("canales")),
    ]


def hours_points(hours: Column) -> Column:
    points = F
    for limit, value in fixed.URGENCY_HOURS:
        points = points.when(hours < limit, value)
    return points.otherwise(fixed.URGENCY_LATE)


def state_points(state: Column) -> Column:
    points = F
    for name, value in fixed.URGENCY_STATE.items():
        points = points.when(state == name, value)
    return points.otherwise(fixed.URGENCY_LATE)


def temperature(points: Column) -> Column:
    return F.when(points >= fixed.HOT_FROM, fixed.HOT).when(points >= fixed.WARM_FROM, fixed.WARM).otherwise(fixed.COLD)


def score(leads: DataFrame, signals: DataFrame, prices: DataFrame, cut: DataFrame, days: int = fixed.LIST_DAYS) -> DataFrame:
    """Points, temperature, priority and ordered reasons of every eligible lead.

    `leads` carry the client key, the principal mark and the form sku; `prices` is (sku, precio_lista).
    """
    chosen = eligible(with_cutoff(leads, cut), days)
    known = signals.drop("empresa_id").withColumn("con_senales", F.lit(True))
    df = (
        chosen.join(channels_per_client(leads), list(CLIENT))
        .join(known, "lead_id", "left")
        .join(prices.select(F.col("sku").alias("sku_interes"), F.col("precio_lista")), "sku_interes", "left")
        .withColumn("con_senales", F.coalesce("con_senales", F.lit(False)))
        .withColumn("horas", F.expr("timestampdiff(SECOND, fecha_registro, momento)") / F.lit(3600.0))
    )
    state, hours = F.col("estado_gestion"), F.col("horas")
    waiting = state == fixed.UNMANAGED
    urgency = F.when(waiting, hours_points(hours)).otherwise(state_points(state))
    recent = waiting & (hours < fixed.URGENT_HOURS)
    df = df.withColumns({
        "r_calidad": _listed(quality_reasons(F.col("precio_lista"))), "r_conversacion": _listed(chat_reasons()),
        "puntos_urgencia": urgency, "sin_contacto_reciente": recent,
        "r_urgencia": F.array(_reason(F.lit(True), F.when(waiting, "sin contacto").otherwise(F.concat(F.lit("estado: "), state)),
                                      urgency, F.when(waiting, F.bround(hours, 1)))),
    })
    raw = _total(F.col("r_conversacion"))
    df = df.withColumns({
        "puntos_calidad": _total(F.col("r_calidad")), "bruto": raw,
        "puntos_conversacion": F.greatest(F.lit(-fixed.CHAT_LIMIT), F.least(F.lit(fixed.CHAT_LIMIT), raw)),
    })
    clip = _listed([_reason(F.col("bruto") != F.col("puntos_conversacion"), "ajuste recortado al rango ±3", F.col("puntos_conversacion") - F.col("bruto"))])
    unsupported = F.transform(
        F.coalesce("sin_respaldo", F.array().cast("array<string>")),
        lambda f: F.struct(F.concat(F.lit("sin respaldo en el chat, se toma como desconocido: "), f).alias("factor"),
                           F.lit(0).alias("puntos"), F.lit(None).cast("double").alias("valor")).cast(REASON))
    warm = F.col("puntos_calidad") + F.col("puntos_conversacion")
    heat = F.when(F.col("con_senales"), temperature(warm)).otherwise(fixed.UNRATED)
    return df.select(
        "lead_id", "fecha_corte", F.lit(fixed.SCORE_VERSION).alias("version_score"), "empresa_id", "punto_venta_id", "fecha_registro",
        "puntos_calidad", "puntos_conversacion", "puntos_urgencia", (warm + F.col("puntos_urgencia")).alias("prioridad"),
        heat.alias("temperatura"), F.concat("r_calidad", "r_conversacion", clip, "r_urgencia", unsupported).alias("razones"),
        "sin_contacto_reciente", ((heat == fixed.HOT) | F.col("sin_contacto_reciente")).alias("prioritario"),
    )


def render_reasons(reasons: Column) -> Column:
    """Reasons as one text, for reports."""
    return F.array_join(F.transform(reasons, lambda r: F.concat(r["factor"], F.lit(" "), r["puntos"].cast("string"))), "; ")
