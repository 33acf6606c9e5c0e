"""The quality log: one row per corrected or dropped value, as an output relation of each stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed

LOG_COLUMNS = ("archivo", "registro_id", "campo", "tipo", "valor_original", "accion", "empresa_id")
LEADS_FILE, CHATS_FILE = "leads.csv", "conversaciones.json"


def problem(when: Column, field: Column | str, kind: Column | str, original: Column | None, action: Column | str) -> Column:
    """A log entry where `when` holds, NULL elsewhere."""
    text = F.lit(None).cast("string") if original is None else original.cast("string")
    return F.when(when, F.struct(
        (F.lit(field) if isinstance(field, str) else field).alias("campo"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("tipo"),
        text.alias("valor_original"),
        (F.lit(action) if isinstance(action, str) else action).alias("accion"),
        F.lit(True).alias("_hay"),
    ))


def log_of(df: DataFrame, file: str, record: Column, tenant: Column, problems: list[Column]) -> DataFrame:
    """The non-null problems of each row; no shuffle. All are unfolded, then those that do not hold leave: compiled
    code does both, while a filter on the array goes through it one by one and builds it anew."""
    rows = df.select(record.cast("string").alias("registro_id"), tenant.alias("empresa_id"), F.inline(F.array(*problems))).filter("_hay")
    return rows.select(F.lit(file).alias("archivo"), "registro_id", "campo", "tipo", "valor_original", "accion", "empresa_id")


def union_logs(*logs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), logs)


def counts_by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("tipo").agg(F.count(F.lit(1)).alias("casos"))


def counts_by_tenant(log: DataFrame) -> DataFrame:
    return log.groupBy("empresa_id", "tipo").agg(F.count(F.lit(1)).alias("casos"))


def flags(log: DataFrame) -> DataFrame:
    """Visible problem types per record, distinct and sorted: at most ten values per record."""
    return (
        log.filter(F.col("tipo").isin(*fixed.VISIBLE_FLAGS))
        .groupBy("registro_id").agg(F.array_sort(F.collect_set("tipo")).alias("flags_calidad"))
    )


def with_flags(leads: DataFrame, log: DataFrame) -> DataFrame:
    joined = leads.join(flags(log), leads["lead_id"].cast("string") == F.col("registro_id"), "left").drop("registro_id")
    return joined.withColumn("flags_calidad", F.coalesce("flags_calidad", F.array().cast("array<string>")))


def violations(df: DataFrame, table: str, key: str, checks: dict[str, Column]) -> DataFrame:
    """Rows breaking a domain rule: `checks` maps the rule to the condition that must not be false."""
    broken = F.filter(
        F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(rule)) for rule, ok in checks.items())),
        lambda r: r.isNotNull(),
    )
    return df.select(F.lit(table).alias("tabla"), F.col(key).cast("string").alias("clave"), F.explode(broken).alias("regla"))


def domain_rules() -> dict[str, tuple[str, dict[str, Column]]]:
    """What stored tables promise: table -> (key, rule -> condition that must not be false)."""
    c = F.col
    precision = ("minuto", "dia")
    return {
        "lead": ("lead_id", {
            "canal": c("canal").isNotNull() & c("canal").isin(*fixed.CHANNELS.values()), "estado": c("estado_gestion").isNotNull() & c("estado_gestion").isin(*fixed.STATES.values()),
            "precision_registro": c("fecha_registro_precision").isin(*precision), "precision_contacto": c("fecha_contacto_precision").isin(*precision)}),
        "extraccion": ("conversacion_id", {
            "mencion": c("menciona_cuota").isin("SI", "NO", "NO_INFORMA"), "pago": c("forma_pago").isin("contado", "credito", "no_informa"), "intencion": c("intencion").isin("alta", "media", "baja"),
            "objecion": c("objecion").isin(*fixed.OBJECTIONS, "ninguna")}),
        "mensaje": ("conversacion_id", {"emisor": c("emisor").isin("cliente", "asesor")}),
        "asesor": ("asesor_id", {"capacidad": c("capacidad_diaria") > 0}),
        "asignacion": ("lead_id", {"estado": c("estado").isin("asignado", "sin_cupo"), "con_asesor": (c("estado") == "asignado") == c("asesor_id").isNotNull()}),
    }


def domain_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows of a table that break one of its domain rules."""
    key, checks = domain_rules()[table]
    return violations(df, table, key, checks)


def dangling(df: DataFrame, table: str, key: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent row."""
    keys = parent.select(F.col(parent_key).alias(column)).distinct()
    return (
        df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")
        .select(F.lit(table).alias("tabla"), F.col(key).cast("string").alias("clave"), F.lit(f"{column}_sin_padre").alias("regla"))
    )
