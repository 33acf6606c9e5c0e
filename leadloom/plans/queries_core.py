"""Registered queries: sources, standardisation, quality, entities, assignment without chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import text
from leadloom.operators import assignment, catalogue, entities, quality, scoring, standardize
from leadloom.plans.oracle_base import VISIBLE, key, with_ctes
from leadloom.plans.registry import Registry, daily

reg = Registry()


@reg.query("n3_n6_fields", with_ctes(
    "SELECT lead_id, orden_archivo, canal_n, estado_n, telefono_n, email_n, nombre_n, ciudad_n, " + key("nombre_cliente") + " AS clave_nombre, "
    + "nombre_cliente IS NULL OR trim(nombre_cliente) = '' AS nombre_nulo FROM measured"))
def fields(spark, folder) -> DataFrame:
    raw = daily(spark, folder).raw_leads
    return raw.select(
        "lead_id", "orden_archivo", text.channel(F.col("canal")).alias("canal_n"), text.state(F.col("estado_gestion")).alias("estado_n"),
        text.phone(F.col("telefono")).alias("telefono_n"), text.email(F.col("email")).alias("email_n"),
        text.person_name(F.col("nombre_cliente")).alias("nombre_n"), text.city(F.col("ciudad")).alias("ciudad_n"),
        text.match_key(F.col("nombre_cliente")).alias("clave_nombre"), text.is_blank(F.col("nombre_cliente")).alias("nombre_nulo"),
    )


@reg.query("n7_n8_dates", with_ctes(
    "SELECT lead_id, orden_archivo, CAST(len(reg_all) AS BIGINT) AS lecturas, reg_at, reg_reason, reg_prec AS reg_precision, con_at, con_reason, "
    "con_prec AS con_precision, reg_class AS formato FROM measured"))
def dates_(spark, folder) -> DataFrame:
    from leadloom.functions.dates import date_format_class
    d = daily(spark, folder)
    df = standardize.with_dates(d.raw_leads.select("lead_id", "orden_archivo", "fecha_registro", "fecha_primer_contacto"), d.window)
    return df.select(
        "lead_id", "orden_archivo", (F.col("reg_a").isNotNull().cast("long") + F.col("reg_b").isNotNull().cast("long")).alias("lecturas"),
        "reg_at", "reg_reason", "reg_precision", "con_at", "con_reason", "con_precision", date_format_class(F.col("fecha_registro")).alias("formato"))


@reg.query("n11_standard_leads", with_ctes("SELECT * FROM std"))
def standard_leads(spark, folder) -> DataFrame:
    return daily(spark, folder).build("clean_leads")


@reg.query("q1_lead_log", with_ctes(
    "SELECT 'leads.csv' AS archivo, CAST(lead_id AS VARCHAR) AS registro_id, p.campo AS campo, p.tipo AS tipo, p.valor AS valor_original, "
    "p.accion AS accion, empresa_id FROM log_std"))
def lead_log(spark, folder) -> DataFrame:
    return daily(spark, folder).build("lead_log")


@reg.query("q2_counts_by_tenant", with_ctes("SELECT empresa_id, p.tipo AS tipo, count(*) AS casos FROM log_std GROUP BY ALL"))
def counts_by_tenant(spark, folder) -> DataFrame:
    return quality.counts_by_tenant(daily(spark, folder).lead_log)


@reg.query("a1_a3_clients", with_ctes("SELECT * FROM clients"))
def clients(spark, folder) -> DataFrame:
    return daily(spark, folder).build("clients")


@reg.query("a2_principal", with_ctes("SELECT lead_id, empresa_id, clave_dedup, es_principal FROM ranked"))
def principal(spark, folder) -> DataFrame:
    return daily(spark, folder).build("keyed_leads").select("lead_id", "empresa_id", "clave_dedup", "es_principal")


@reg.query("f2_cutoff", with_ctes("SELECT fecha_corte, momento FROM cut"))
def cutoff(spark, folder) -> DataFrame:
    return daily(spark, folder).cutoff


@reg.query("f1_eligible", with_ctes(
    "SELECT lead_id, empresa_id, punto_venta_id, estado_gestion, fecha_registro FROM ranked WHERE es_principal AND estado_gestion <> 'Descartado' "
    "AND fecha_registro BETWEEN (SELECT momento FROM cut) - INTERVAL 60 DAY AND (SELECT momento FROM cut)"))
def eligible(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return scoring.eligible(scoring.with_cutoff(d.keyed_leads, d.cutoff), d.days).select(
        "lead_id", "empresa_id", "punto_venta_id", "estado_gestion", "fecha_registro")


def urgent_list(d) -> DataFrame:
    """Eligible leads with urgency points only: who to call first when no chat is known."""
    df = scoring.eligible(scoring.with_cutoff(d.keyed_leads, d.cutoff), d.days)
    hours = F.expr("timestampdiff(SECOND, fecha_registro, momento)") / F.lit(3600.0)
    waiting = F.col("estado_gestion") == fixed.UNMANAGED
    return df.withColumns({
        "prioridad": F.when(waiting, scoring.hours_points(hours)).otherwise(scoring.state_points(F.col("estado_gestion"))),
        "prioritario": waiting & (hours < fixed.URGENT_HOURS), "temperatura": F.lit(fixed.UNRATED),
    })


SNAKE = {
    "urgent": (
        "SELECT r.*, CASE WHEN estado_gestion = 'Sin gestión' THEN CASE WHEN h < 2 THEN 5 WHEN h < 24 THEN 4 WHEN h < 72 THEN 2 ELSE 1 END "
        "ELSE CASE estado_gestion WHEN 'Cotización enviada' THEN 3 WHEN 'En proceso' THEN 2 WHEN 'No contesta' THEN 2 ELSE 1 END END AS prioridad, "
        "estado_gestion = 'Sin gestión' AND h < 24 AS prioritario FROM (SELECT k.*, cut.fecha_corte, epoch(cut.momento - fecha_registro) / 3600.0 AS h "
        "FROM ranked AS k, cut WHERE es_principal AND estado_gestion <> 'Descartado' AND fecha_registro BETWEEN cut.momento - INTERVAL 60 DAY AND cut.momento) AS r", ("ranked", "cut")),
    "seats": (
        "SELECT punto_venta_id, asesor_id, orden, row_number() OVER (PARTITION BY punto_venta_id ORDER BY pos) AS turno FROM (SELECT a.punto_venta_id, asesor_id, "
        "s.j AS orden, CAST(floor((s.j - 1) / 2) AS BIGINT) * 2 * n + CASE WHEN s.j % 2 = 1 THEN i ELSE 2 * n - 1 - i END AS pos FROM (SELECT *, row_number() OVER "
        "(PARTITION BY punto_venta_id ORDER BY asesor_id) - 1 AS i, count(*) OVER (PARTITION BY punto_venta_id) AS n FROM adv WHERE activo) AS a, "
        "LATERAL (SELECT unnest(range(1, capacidad_diaria + 1)) AS j) AS s) AS z", ("adv",)),
}


@reg.query("c8_snake_assignment", with_ctes(
    "SELECT u.fecha_corte, u.lead_id, u.punto_venta_id, s.asesor_id, s.orden, CASE WHEN s.asesor_id IS NULL THEN 'sin_cupo' ELSE 'asignado' END AS estado, "
    "CAST(u.prioridad AS BIGINT) AS prioridad, u.prioritario FROM (SELECT *, row_number() OVER (PARTITION BY punto_venta_id ORDER BY prioridad DESC, fecha_registro, lead_id) AS turno "
    "FROM urgent) AS u LEFT JOIN seats AS s USING (punto_venta_id, turno)", SNAKE))
def snake(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return assignment.assign(urgent_list(d), d.advisors).select(
        "fecha_corte", "lead_id", "punto_venta_id", "asesor_id", "orden", "estado", "prioridad", "prioritario")
