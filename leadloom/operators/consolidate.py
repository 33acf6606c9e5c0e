"""Chat signals brought together on the principal lead of each client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.operators.entities import CLIENT
from leadloom.operators.ranking import with_rank

CHAT = "conversacion_id"


def chats_on_principal(extraction: DataFrame, chats: DataFrame, leads: DataFrame, clients: DataFrame) -> DataFrame:
    """Extractions with the principal lead of their client; orphan chats leave."""
    owner = leads.select("lead_id", *CLIENT)
    principal = clients.select(*CLIENT, "lead_principal")
    return (
        extraction.join(chats.select(CHAT, "lead_id", "inicio"), CHAT)
        .join(owner, "lead_id").join(principal, list(CLIENT)).drop("lead_id").withColumnRenamed("lead_principal", "lead_id")
    )


def _order() -> Column:
    return F.struct(F.coalesce("inicio", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")), F.col(CHAT))


def consolidate(placed: DataFrame) -> DataFrame:
    """One row per lead: the latest informed value of each field, or any for what accumulates."""
    order = _order()

    def latest(name: str, empty: str | None) -> Column:
        told = F.col(name).isNotNull() if empty is None else F.col(name).isNotNull() & (F.col(name) != empty)
        return F.max_by(F.col(name), F.when(told, order))

    fields = [f for f in fixed.EVALUATED_FIELDS]
    agg = placed.groupBy("lead_id", "empresa_id").agg(
        latest("modelo_texto", None).alias("modelo_texto"),
        F.max_by(F.struct("cuota_inicial_cop", "menciona_cuota"), F.when(F.col("cuota_inicial_cop").isNotNull(), order)).alias("con_cifra"),
        latest("menciona_cuota", "NO_INFORMA").alias("mencion"), latest("forma_pago", "no_informa").alias("forma_pago"),
        F.max_by("intencion", order).alias("intencion"), latest("objecion", "ninguna").alias("objecion"),
        F.bool_or("pidio_cita").alias("pidio_cita"), F.bool_or("pidio_cotizacion").alias("pidio_cotizacion"),
        F.bool_or("cliente_respondio").alias("cliente_respondio"), F.count(F.lit(1)).alias("conversaciones"),
        *(F.bool_or(F.array_contains("sin_respaldo", f)).alias(f"_sr_{f}") for f in fields),
    )
    missing = F.filter(F.array(*(F.when(F.col(f"_sr_{f}"), f) for f in sorted(fields))), lambda f: f.isNotNull())
    return agg.select(
        "lead_id", "empresa_id", "modelo_texto", F.col("con_cifra.cuota_inicial_cop").alias("cuota_inicial_cop"),
        F.coalesce("con_cifra.menciona_cuota", "mencion", F.lit("NO_INFORMA")).alias("menciona_cuota"),
        F.coalesce("forma_pago", F.lit("no_informa")).alias("forma_pago"), "intencion",
        F.coalesce("objecion", F.lit("ninguna")).alias("objecion"), "pidio_cita", "pidio_cotizacion", "cliente_respondio",
        "conversaciones", missing.alias("sin_respaldo"),
    )


def chat_order(placed: DataFrame) -> DataFrame:
    """The chats of each lead with their position, oldest first: a relation instead of an array, so
    a lead with very many chats stays spread."""
    df = placed.select("lead_id", CHAT, F.coalesce("inicio", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("inicio"))
    ranked = with_rank(df, ["lead_id"], [("inicio", True), (CHAT, True)], [(F.to_date("inicio"), True)], name="posicion")
    return ranked.select("lead_id", "posicion", CHAT)
