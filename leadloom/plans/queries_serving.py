"""Registered queries: sources, idempotent writes, views, visibility and boards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.operators import catalogue, extraction, quality, scoring, serving, standardize
from leadloom.plans import run
from leadloom.plans.oracle_base import CTES, with_ctes
from leadloom.plans.oracle_chat import clean_model
from leadloom.plans.queries_chat import EXT, HASH, LOG, RUNS, new_store, third_chats
from leadloom.plans.registry import Registry, daily
from leadloom.sources import readers, tables

reg = Registry()
ID = "conversacion_id"
RAW = fixed.REQUIRED["leads"]

CTES.update({
    "sig_sku": ("SELECT s.*, r.sku AS sku_extraido FROM signals AS s LEFT JOIN resolved AS r ON r.limpio = "
                + clean_model("s.modelo_texto"), ("signals", "resolved")),
    "versions": ("SELECT * FROM scores UNION ALL SELECT * REPLACE ('v10' AS version_score, prioridad + 1 AS prioridad) FROM scores WHERE lead_id % 2 = 0 "
                 "UNION ALL SELECT * REPLACE ('v2' AS version_score, prioridad + 7 AS prioridad) FROM scores WHERE lead_id % 3 = 0", ("scores",)),
    "two_days": ("SELECT fecha_corte, lead_id, empresa_id, asesor_id, estado, prioritario FROM assigned UNION ALL SELECT CAST(fecha_corte - INTERVAL 1 DAY AS DATE), lead_id, empresa_id, asesor_id + 1, estado, prioritario FROM assigned", ("assigned",)),
    "last_assigned": ("SELECT * FROM two_days AS t WHERE fecha_corte = (SELECT max(fecha_corte) FROM two_days AS z WHERE z.empresa_id = t.empresa_id)", ("two_days",)),
    "sees_client": ("SELECT DISTINCT u.user_id, l.empresa_id, l.clave_dedup FROM usr AS u JOIN last_assigned AS a ON a.asesor_id = u.asesor_id AND a.empresa_id = u.empresa_id JOIN keyed AS l ON l.lead_id = a.lead_id", ("usr", "last_assigned", "keyed")),
    "sees_lead": ("SELECT u.user_id, l.lead_id, l.empresa_id FROM keyed AS l JOIN usr AS u ON u.empresa_id = l.empresa_id AND u.rol = 'gerente' UNION SELECT s.user_id, l.lead_id, l.empresa_id FROM keyed AS l JOIN sees_client AS s "
                  "ON s.empresa_id = l.empresa_id AND s.clave_dedup = l.clave_dedup", ("keyed", "usr", "sees_client")),
    "list_day": (
        "SELECT a.fecha_corte, a.lead_id, a.asesor_id, a.orden, a.estado, a.prioritario, m.empresa_id, m.clave_dedup, m.punto_venta_id, m.canal, m.modelo_texto_original, m.sku_interes, m.marca_interes, m.modelo_disponible_pv, "
        "m.estado_gestion, m.fecha_registro, m.fecha_primer_contacto, c.nombre, c.telefono, f.marca || ' ' || f.linea AS modelo, s.sku_extraido, s.modelo_texto AS ia_modelo_texto, x.marca || ' ' || x.linea AS ia_modelo, x.precio_lista AS ia_precio_lista, "
        + ", ".join(f"s.{c} AS ia_{c}" for c in ("cuota_inicial_cop", "menciona_cuota", "forma_pago", "intencion", "objecion", "pidio_cita", "pidio_cotizacion", "cliente_respondio", "conversaciones"))
        + ", v.version_score, v.prioridad, v.temperatura, v.puntos_calidad, v.puntos_conversacion, v.puntos_urgencia, v.razones FROM assigned AS a JOIN matched AS m USING (lead_id) JOIN clients AS c ON c.empresa_id = m.empresa_id AND c.clave_dedup = m.clave_dedup "
        "LEFT JOIN cat AS f ON f.sku = m.sku_interes LEFT JOIN sig_sku AS s ON s.lead_id = a.lead_id LEFT JOIN cat AS x ON x.sku = s.sku_extraido LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY CAST(substr(version_score, 2) AS INT) DESC) AS k FROM versions) AS v "
        "ON v.lead_id = a.lead_id AND v.k = 1", ("assigned", "matched", "clients", "cat", "sig_sku", "versions")),
})
_END = "round(epoch_us(CAST(fecha_corte AS TIMESTAMP) + INTERVAL 86399999999 MICROSECOND - {x}) / 3600000000.0::DOUBLE, 1)"


def versions(d) -> DataFrame:
    s = d.scores
    def copy(name, every, more):
        return s.filter(F.col("lead_id") % every == 0).withColumns({"version_score": F.lit(name), "prioridad": F.col("prioridad") + more})
    return s.unionByName(copy("v10", 2, 1)).unionByName(copy("v2", 3, 7))


def signals_table(d) -> DataFrame:
    """Signals with the catalogue sku of the model named and their provenance; written once, since it is read several times."""
    if "signals_table" not in d._stages:
        found = catalogue.match_texts(d.signals, "modelo_texto", d.catalogue).select("modelo_texto", F.col("sku").alias("sku_extraido"))
        rows = d.signals.join(found, "modelo_texto", "left").withColumns({"extractor": F.lit(fixed.RULES_NAME), "prompt_version": F.lit(fixed.RULES_VERSION)})
        d._stages["signals_table"] = tables.materialize(rows, "signals_table")
    return d._stages["signals_table"]


def view(d) -> DataFrame:
    if "view" not in d._stages:
        rows = serving.daily_list(d.assignment, d.leads, d.clients, d.catalogue, signals_table(d), versions(d))
        d._stages["view"] = tables.materialize(rows, "view")
    return d._stages["view"]


def two_days(d) -> DataFrame:
    a = d.assignment.select("fecha_corte", "lead_id", "empresa_id", "asesor_id", "estado", "prioritario")
    return a.unionByName(a.withColumns({"fecha_corte": F.date_sub("fecha_corte", 1), "asesor_id": F.col("asesor_id") + 1}))


def users(d) -> DataFrame:
    return d.inputs.users()


# --- sources and writes -----------------------------------------------------------------------
@reg.query("s1_csv_scan", with_ctes("SELECT lead_id::VARCHAR AS lead_id, empresa_id::VARCHAR AS empresa_id, punto_venta_id::VARCHAR AS punto_venta_id, orden_archivo::VARCHAR AS orden_archivo, "
                                    + ", ".join(f"CASE WHEN trim({c}) <> '' THEN {c} END AS {c}" for c in RAW if not c.endswith("_id"))
                                    + " FROM (SELECT * REPLACE (nombre_cliente || chr(10) || '\"2\"' AS nombre_cliente) FROM raw) AS b"))
def csv_scan(spark, folder) -> DataFrame:
    path = tables.new_path(spark, "leads-csv")
    broken = F.concat("nombre_cliente", F.lit("\n\"2\""))  # a line break and quotes inside a quoted field
    daily(spark, folder).raw_leads.withColumn("nombre_cliente", broken).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"')
    return readers.read_csv(spark, path, "leads")


@reg.query("s2_json_scan", with_ctes("SELECT CAST(conversacion_id AS VARCHAR) AS conversacion_id, row_number() OVER (PARTITION BY conversacion_id ORDER BY orden) AS orden, emisor, hora, texto FROM msg"))
def json_scan(spark, folder) -> DataFrame:
    """Chats with all their messages, written as nested JSON objects and read back."""
    path = tables.new_path(spark, "chats-json")
    d = daily(spark, folder)
    said = F.transform(F.array_sort(F.collect_list(F.struct("orden", "emisor", "hora", "texto"))), lambda m: F.struct(m["emisor"].alias("emisor"), m["hora"].alias("hora"), m["texto"].alias("texto")))
    objects = d.messages.groupBy(ID).agg(said.alias("mensajes"))  # a source object is one chat
    d.chats.select(ID, "lead_id", "canal", "fecha_inicio").join(objects, ID).select(*(F.col(c).cast("string").alias(c) for c in (ID, "lead_id", "canal", "fecha_inicio")), "mensajes").write.json(path)
    return readers.flatten_messages(readers.read_chats(spark, path, multi_line=False))


@reg.query("s5_upsert", with_ctes("SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN 'nuevo' ELSE estado_gestion END AS estado_gestion FROM std WHERE lead_id % 2 = 0 OR lead_id % 3 = 0"))
def upsert(spark, folder) -> DataFrame:
    leads = daily(spark, folder).clean_leads.select("lead_id", "estado_gestion")
    target, updates = leads.filter("lead_id % 2 = 0"), leads.filter("lead_id % 3 = 0").withColumn("estado_gestion", F.lit("nuevo"))
    return tables.merge_upsert(target, updates, ["lead_id"])


@reg.query("s6_mirror_delete", with_ctes("SELECT empresa_id, clave_dedup FROM clients WHERE (empresa_id, clave_dedup) IN (SELECT (empresa_id, clave_dedup) FROM keyed WHERE estado_gestion <> 'Descartado')"))
def mirror(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return tables.mirror(d.clients, d.keyed_leads.filter(F.col("estado_gestion") != fixed.DISCARDED), ["empresa_id", "clave_dedup"]).select("empresa_id", "clave_dedup")


@reg.query("s7_partition_replace", with_ctes("SELECT fecha_corte, lead_id, CASE WHEN fecha_corte = (SELECT fecha_corte FROM cut) THEN NULL ELSE asesor_id END AS asesor_id FROM two_days WHERE fecha_corte <> (SELECT fecha_corte FROM cut) OR lead_id % 2 = 0"))
def partition_replace(spark, folder) -> DataFrame:
    """Three dates are written; the last one is replaced by a smaller distribution and the first by nothing."""
    d = daily(spark, folder)
    path, rows = tables.new_path(spark, "asignacion"), two_days(d).select("fecha_corte", "lead_id", "asesor_id")
    emptied = d.assignment.select(F.date_sub("fecha_corte", 2).alias("fecha_corte"), "lead_id", "asesor_id")
    tables.replace_partitions(rows.unionByName(emptied), path, "fecha_corte")
    again = d.assignment.filter("lead_id % 2 = 0").select("fecha_corte", "lead_id", F.lit(None).cast("long").alias("asesor_id"))
    first = emptied.agg(F.min("fecha_corte")).first()[0]
    tables.replace_partitions(again, path, "fecha_corte", [first])
    return spark.read.parquet(path).select(F.col("fecha_corte").cast("date").alias("fecha_corte"), "lead_id", "asesor_id")


@reg.query("s8_score_upsert", with_ctes("SELECT lead_id, fecha_corte, version_score, CASE WHEN version_score = 'v3' THEN prioridad + 100 ELSE prioridad END AS prioridad FROM versions"))
def score_upsert(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    cols = ["lead_id", "fecha_corte", "version_score", "prioridad"]
    path = tables.new_path(spark, "score")
    tables.replace_partitions(versions(d).select(*cols), path, "fecha_corte")
    tables.upsert_partitioned(d.scores.withColumn("prioridad", F.col("prioridad") + 100).select(*cols), path, cols[:3], "fecha_corte")
    return spark.read.parquet(path).withColumn("fecha_corte", F.col("fecha_corte").cast("date"))


SILENT = 9_000_001  # a chat without messages


def cache_table(d) -> DataFrame:
    silent = d.chats.sparkSession.createDataFrame([(SILENT,)], f"{ID} long")
    chats = d.extraction.unionByName(extraction.rule_extraction(silent, d.messages.limit(0), d.brands))
    base = chats.join(extraction.content_hashes(chats, d.messages), ID).select("hash_contenido", *EXT)
    mine = base.withColumns({"extractor": F.lit(fixed.RULES_NAME), "prompt_version": F.when(F.col(ID) % 5 == 0, "reglas_v2").otherwise(fixed.RULES_VERSION),
                             "forma_pago": F.when(F.col(ID) % 3 == 0, None).otherwise(F.col("forma_pago")), "cliente_respondio": F.when(F.col(ID) % 4 == 0, None).otherwise(F.col("cliente_respondio"))})
    return mine


@reg.query("s9_cache_read", with_ctes("SELECT conversacion_id, CASE WHEN conversacion_id % 3 = 0 THEN 'no_informa' ELSE forma_pago END AS forma_pago, CASE WHEN conversacion_id % 4 = 0 THEN true ELSE cliente_respondio END AS cliente_respondio FROM ext WHERE conversacion_id % 5 <> 0 UNION ALL SELECT 9000001, 'no_informa', false"))
def cache_read(spark, folder) -> DataFrame:
    cached = tables.cached_extractions(cache_table(daily(spark, folder)), fixed.RULES_NAME, fixed.RULES_VERSION, fixed.UNKNOWN)
    return cached.select(ID, "forma_pago", "cliente_respondio")


@reg.query("s10_cache_write", with_ctes("SELECT conversacion_id, CASE WHEN conversacion_id % 5 = 0 THEN 'reglas_v2' ELSE 'reglas_v3' END AS prompt_version, CASE WHEN conversacion_id % 2 = 1 AND conversacion_id % 5 <> 0 THEN 'alta' ELSE intencion END AS intencion FROM ext UNION ALL SELECT 9000001, 'reglas_v3', 'alta' "
                                        "UNION ALL SELECT conversacion_id, 'reglas_v3', 'alta' FROM ext WHERE conversacion_id % 10 = 5"))
def cache_write(spark, folder) -> DataFrame:
    cache = cache_table(daily(spark, folder))
    fresh = cache.filter(F.col(ID) % 2 == 1).withColumns({"prompt_version": F.lit(fixed.RULES_VERSION), "intencion": F.lit("alta")})
    return tables.merge_upsert(cache, fresh, ["hash_contenido", "extractor", "prompt_version"]).select(ID, "prompt_version", "intencion")


@reg.query("s11_points_of_sale", with_ctes(
    "SELECT k.punto_venta_id, k.empresa_id, c.ciudad FROM (SELECT punto_venta_id, arg_max(empresa_id, p) AS empresa_id FROM (SELECT punto_venta_id, empresa_id, 0 AS p FROM std UNION ALL SELECT punto_venta_id, empresa_id, 1 FROM adv) AS u GROUP BY 1) AS k "
    "LEFT JOIN (SELECT punto_venta_id, ciudad FROM (SELECT *, row_number() OVER (PARTITION BY punto_venta_id ORDER BY n DESC, ciudad) AS r FROM (SELECT punto_venta_id, ciudad, count(*) AS n FROM std WHERE ciudad IS NOT NULL GROUP BY 1, 2) AS q) AS w WHERE r = 1) AS c USING (punto_venta_id)"))
def points_of_sale(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return serving.points_of_sale(d.clean_leads, d.advisors)


@reg.query("s14_signals_write", with_ctes("SELECT lead_id, empresa_id, 'reglas' AS extractor, 'reglas_v3' AS prompt_version, modelo_texto, sku_extraido, conversaciones FROM sig_sku"))
def signals_write(spark, folder) -> DataFrame:
    """Stored signals keep only leads that still have chats, with today's values."""
    d = daily(spark, folder)
    now = signals_table(d)
    stale = now.withColumns({"conversaciones": F.lit(0).cast("long"), "lead_id": F.col("lead_id") * F.when(F.col("lead_id") % 2 == 0, -1).otherwise(1)})
    stored = tables.mirror(tables.merge_upsert(stale, now, ["lead_id"]), now, ["lead_id"])
    return stored.select("lead_id", "empresa_id", "extractor", "prompt_version", "modelo_texto", "sku_extraido", "conversaciones")


@reg.query("s15_lead_load", with_ctes("SELECT r.lead_id, r.clave_dedup, c.nombre AS cliente, r.es_principal, r.regla, coalesce(f.b, '') AS flags_calidad FROM matched AS r JOIN clients AS c USING (empresa_id, clave_dedup) LEFT JOIN (SELECT registro_id, string_agg(DISTINCT tipo, ',' ORDER BY tipo) AS b FROM all_log WHERE tipo IN ("
                                      + ", ".join(f"'{t}'" for t in fixed.VISIBLE_FLAGS) + ") GROUP BY registro_id) AS f ON f.registro_id = CAST(r.lead_id AS VARCHAR)", LOG))
def lead_load(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    named = d.leads.join(d.clients.select("empresa_id", "clave_dedup", F.col("nombre").alias("cliente")), ["empresa_id", "clave_dedup"])
    return quality.with_flags(named, d.quality_log).select("lead_id", "clave_dedup", "cliente", "es_principal", "regla", F.array_join("flags_calidad", ",").alias("flags_calidad"))


@reg.query("s16_history_load", with_ctes("SELECT lead_id, CASE WHEN lead_id % 2 = 0 THEN 'Perdido' ELSE desenlace END AS desenlace, precio_lista FROM his"))
def history_load(spark, folder) -> DataFrame:
    h = daily(spark, folder).history.select("lead_id", "desenlace", "precio_lista")
    return tables.merge_upsert(h, h.filter("lead_id % 2 = 0").withColumn("desenlace", F.lit("Perdido")), ["lead_id"])


COUNTS = ("leads_crudos", "catalogo", "asesor", "historico_cierre", "cliente", "conversacion", "mensaje", "extraccion_calculadas", "extraccion_reusadas", "extraccion_respaldo",
          "senales_lead", "score", "asignacion", "asignacion_asignados", "asignacion_sin_cupo", "problema_calidad", "lead")
_TABLES = {"catalogo": "cat", "asesor": "adv", "historico_cierre": "his", "cliente": "clients", "conversacion": "chats", "mensaje": "msg"}
_REST = {"extraccion_calculadas": "(SELECT count(DISTINCT hash_contenido) FROM all_hashes)", "extraccion_reusadas": "(SELECT count(*) - count(DISTINCT hash_contenido) FROM all_hashes)",
         "extraccion_respaldo": "(SELECT count(*) FROM (SELECT min(conversacion_id) AS rep FROM all_hashes GROUP BY hash_contenido) AS z WHERE rep % 3 <> 0)",
         "senales_lead": "(SELECT count(*) FROM signals)", "score": "(SELECT count(*) FROM scores)", "asignacion": "(SELECT count(*) FROM assigned)",
         "asignacion_asignados": "(SELECT count(*) FROM assigned WHERE estado = 'asignado')", "asignacion_sin_cupo": "(SELECT count(*) FROM assigned WHERE estado = 'sin_cupo')",
         "problema_calidad": "(SELECT count(*) FROM all_log)", "lead": "(SELECT count(*) FROM std)"}


@reg.query("s17_run_log", with_ctes(
    "SELECT 'r1' AS ejecucion_id, 'ok_con_respaldo' AS estado, (SELECT fecha_corte FROM cut) AS fecha_corte, CAST(NULL AS VARCHAR) AS detalle_error, (SELECT count(*) FROM raw) AS leads_crudos, "
    + ", ".join(f"(SELECT count(*) FROM {t}) AS {n}" for n, t in _TABLES.items()) + ", " + ", ".join(f"{q} AS {n}" for n, q in _REST.items())
    + " UNION ALL SELECT 'r2', 'error', NULL, 'ValueError(''no service'')', (SELECT count(*) FROM raw), " + ", ".join(f"(SELECT count(*) FROM {t})" for t in _TABLES.values()) + ", " + ", ".join("0" for _ in _REST), LOG | HASH | RUNS))
def run_log(spark, folder) -> DataFrame:
    """One whole run that falls back to the rules for most chats, and one whose extractor fails."""
    d, out, store = daily(spark, folder), tables.new_path(spark, "corrida"), new_store(spark)
    log = tables.RunLog(spark, f"{out}/ejecucion")

    def fails(chats, messages):
        raise ValueError("no service")

    run.run(d, out, log, store, third_chats(d), "r1")
    run.run(d, f"{out}-2", log, store, extraction.Extractor("other", "v1", fails), "r2")
    count = lambda n: F.coalesce(F.try_element_at("conteos", F.lit(n)), F.lit(0)).alias(n)
    return log.read().select("ejecucion_id", "estado", "fecha_corte", "detalle_error", *(count(n) for n in COUNTS))


@reg.query("s21_typed_advisors", with_ctes("SELECT * FROM adv"))
def typed_advisors(spark, folder) -> DataFrame:
    return daily(spark, folder).build("advisors")


@reg.query("s21_typed_history", with_ctes("SELECT * FROM his"))
def typed_history(spark, folder) -> DataFrame:
    return daily(spark, folder).build("history")


@reg.query("s21_typed_catalogue", with_ctes("SELECT sku, marca, linea, cilindraje, segmento, precio_lista, unidades_disponibles, marca || ' ' || linea AS nombre_completo FROM cat"))
def typed_catalogue(spark, folder) -> DataFrame:
    return daily(spark, folder).build("catalogue")


@reg.query("s22_tenant_seed", "SELECT CAST(r_regionkey AS VARCHAR) AS empresa_id, r_name AS nombre, lower(r_name) AS region FROM region UNION ALL SELECT * FROM (VALUES "
           + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in fixed.TENANTS) + ") AS t(a, b, c)")
def tenant_seed(spark, folder) -> DataFrame:
    """The seed twice over the tenants of the tables: the second time changes nothing."""
    base = daily(spark, folder).inputs.table("region").select(F.col("r_regionkey").cast("string").alias("empresa_id"), F.col("r_name").alias("nombre"), F.lower("r_name").alias("region"))
    seed = spark.createDataFrame(fixed.TENANTS, "empresa_id string, nombre string, region string")
    return tables.merge_upsert(tables.merge_upsert(base, seed, ["empresa_id"]), seed, ["empresa_id"])


@reg.query("n13_message_hours", with_ctes("SELECT conversacion_id, orden, CASE WHEN regexp_matches(hora, '^([01][0-9]|2[0-3]):[0-5][0-9]$') THEN hora END AS hora FROM msg"))
def hours(spark, folder) -> DataFrame:
    from leadloom.functions.text import message_hour
    return daily(spark, folder).messages.select(ID, "orden", message_hour(F.col("hora")).alias("hora"))


@reg.query("q4_violations", with_ctes(
    "SELECT 'score' AS tabla, CAST(lead_id AS VARCHAR) AS clave, 'prioridad' AS regla FROM versions WHERE prioridad > 10 UNION ALL SELECT 'score', CAST(lead_id AS VARCHAR), 'version' FROM scores WHERE lead_id % 5 = 0 "
    "UNION ALL SELECT 'lead', CAST(lead_id AS VARCHAR), 'canal' FROM raw WHERE canal IS NOT NULL AND canal NOT IN ('WhatsApp', 'Meta Ads', 'Formulario Web') UNION ALL SELECT 'lead', CAST(lead_id AS VARCHAR), 'estado' FROM raw WHERE estado_gestion NOT IN "
    "('Sin gestión', 'No contesta', 'Contactado', 'En proceso', 'Cotización enviada', 'Descartado') UNION ALL SELECT 'usuario', user_id, 'rol_con_asesor' FROM usr WHERE rol = 'gerente' "
    "UNION ALL SELECT 'conversacion', CAST(conversacion_id AS VARCHAR), 'lead_id_sin_padre' FROM chats WHERE lead_id NOT IN (SELECT lead_id FROM std)"))
def violations(spark, folder) -> DataFrame:
    """Domain rules over raw leads, scores with broken versions and users whose role lost its advisor."""
    d = daily(spark, folder)
    c = F.col
    broken = d.scores.withColumn("version_score", F.when(c("lead_id") % 5 == 0, "2").otherwise(c("version_score")))
    checks = [
        quality.violations(versions(d), "score", "lead_id", {"prioridad": c("prioridad") <= 10, "temperatura": c("temperatura").isin(*fixed.TEMPERATURES)}),
        quality.violations(broken, "score", "lead_id", {"version": c("version_score").rlike(serving.VERSION)}),
        quality.violations(d.raw_leads, "lead", "lead_id", {"canal": c("canal").isin(*fixed.CHANNELS.values()), "estado": c("estado_gestion").isin(*fixed.STATES.values())}),
        quality.violations(users(d).withColumn("rol", F.lit("asesor")), "usuario", "user_id", {"rol_con_asesor": (c("rol") != "asesor") | c("asesor_id").isNotNull()}),
        quality.violations(d.advisors, "asesor", "asesor_id", {"capacidad": c("capacidad_diaria") > 0}),
        quality.violations(d.messages, "mensaje", ID, {"emisor": c("emisor").isin("cliente", "asesor")}),
        quality.dangling(d.chats, "conversacion", ID, "lead_id", d.clean_leads, "lead_id"),
        quality.dangling(d.matched, "lead", "lead_id", "sku_interes", d.catalogue, "sku"),
    ]
    return quality.union_logs(*checks)


@reg.query("q4_domain_rules", with_ctes(
    "SELECT 'lead' AS tabla, CAST(lead_id AS VARCHAR) AS clave, 'precision_registro' AS regla FROM std WHERE lead_id % 7 = 0 AND fecha_registro_precision IS NOT NULL UNION ALL SELECT 'lead', CAST(lead_id AS VARCHAR), 'precision_contacto' FROM std WHERE lead_id % 11 = 0 AND fecha_contacto_precision IS NOT NULL "
    "UNION ALL SELECT 'lead', CAST(lead_id AS VARCHAR), 'canal' FROM std WHERE lead_id % 13 = 0 UNION ALL SELECT 'lead', CAST(lead_id AS VARCHAR), 'punto_venta_id_sin_padre' FROM std WHERE lead_id % 10 = 0 AND punto_venta_id IS NOT NULL "
    "UNION ALL SELECT 'extraccion', CAST(conversacion_id AS VARCHAR), 'pago' FROM ext WHERE conversacion_id % 4 = 0 UNION ALL SELECT 'extraccion', CAST(conversacion_id AS VARCHAR), 'mencion' FROM ext WHERE conversacion_id % 5 = 0 "
    "UNION ALL SELECT 'extraccion', CAST(conversacion_id AS VARCHAR), 'intencion' FROM ext WHERE intencion = 'media' UNION ALL SELECT 'extraccion', CAST(conversacion_id AS VARCHAR), 'objecion' FROM ext WHERE objecion = 'precio' "
    "UNION ALL SELECT 'asignacion', CAST(lead_id AS VARCHAR), 'con_asesor' FROM assigned WHERE estado = 'sin_cupo'"))
def domain_rules(spark, folder) -> DataFrame:
    """The rules of stored leads, extractions and assignments, over rows broken on purpose, and points of sale that do not exist."""
    d, c = daily(spark, folder), F.col
    leads = d.clean_leads.withColumns({
        "fecha_registro_precision": F.when((c("lead_id") % 7 == 0) & c("fecha_registro_precision").isNotNull(), "hora").otherwise(c("fecha_registro_precision")),
        "fecha_contacto_precision": F.when((c("lead_id") % 11 == 0) & c("fecha_contacto_precision").isNotNull(), "mes").otherwise(c("fecha_contacto_precision")),
        "canal": F.when(c("lead_id") % 13 == 0, None).otherwise(c("canal"))})
    extractions = d.extraction.withColumns({
        "forma_pago": F.when(c(ID) % 4 == 0, "fiado").otherwise(c("forma_pago")), "menciona_cuota": F.when(c(ID) % 5 == 0, "QUIZA").otherwise(c("menciona_cuota")),
        "intencion": F.regexp_replace("intencion", "^media$", "mediana"), "objecion": F.regexp_replace("objecion", "^precio$", "caro")})
    moved = d.clean_leads.withColumn("punto_venta_id", c("punto_venta_id") + F.when(c("lead_id") % 10 == 0, 100_000).otherwise(0))
    points = serving.points_of_sale(d.clean_leads, d.advisors)
    return quality.union_logs(
        quality.domain_violations(leads, "lead"), quality.domain_violations(extractions, "extraccion"), quality.domain_violations(d.messages, "mensaje"), quality.domain_violations(d.advisors, "asesor"),
        quality.domain_violations(d.assignment.withColumn("asesor_id", F.coalesce("asesor_id", F.lit(0))), "asignacion"), quality.dangling(moved, "lead", "lead_id", "punto_venta_id", points, "punto_venta_id"))


# --- views ------------------------------------------------------------------------------------
@reg.query("w5_latest_version", with_ctes("SELECT lead_id, fecha_corte, version_score, prioridad FROM (SELECT *, row_number() OVER (PARTITION BY lead_id, fecha_corte ORDER BY CAST(substr(version_score, 2) AS INT) DESC) AS k FROM versions) AS v WHERE k = 1"))
def latest_version(spark, folder) -> DataFrame:
    return serving.latest_scores(versions(daily(spark, folder))).select("lead_id", "fecha_corte", "version_score", "prioridad")


@reg.query("j8_daily_list", with_ctes("SELECT * FROM list_day"))
def daily_list(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    rows = serving.daily_list(d.assignment, d.leads, d.clients, d.catalogue, signals_table(d), versions(d))
    return rows.withColumn("razones", scoring.render_reasons(F.col("razones")))


@reg.query("w12_advisor_rows", with_ctes(
    "SELECT fecha_corte, asesor_id, orden, lead_id, temperatura, prioridad, nombre, coalesce(telefono, '—') AS telefono, canal, coalesce(ia_modelo, modelo, '—') AS modelo, ia_cuota_inicial_cop AS cuota, "
    "CASE ia_forma_pago WHEN 'contado' THEN 'Contado' WHEN 'credito' THEN 'Crédito' ELSE '—' END AS pago, " + _END.format(x="fecha_registro") + " AS horas, estado_gestion FROM list_day WHERE asesor_id IS NOT NULL"))
def advisor_rows(spark, folder) -> DataFrame:
    return serving.advisor_rows(view(daily(spark, folder)).filter(F.col("asesor_id").isNotNull()))


_PESOS = "'$' || replace(format('{:,}', ia_cuota_inicial_cop), ',', '.')"


@reg.query("x17_opening_sentence", with_ctes(
    "SELECT fecha_corte, lead_id, CASE WHEN coalesce(ia_conversaciones, 0) = 0 THEN coalesce(nullif(string_split(trim(nombre), ' ')[1], ''), 'El cliente') || ' no tiene conversación de WhatsApp. ' || CASE WHEN coalesce(modelo, modelo_texto_original) IS NULL THEN 'No dejó modelo de interés.' "
    "ELSE 'Pidió información de ' || coalesce(modelo, modelo_texto_original) || ' por ' || canal || '.' END || ' Califíquelo: confirme modelo, forma de pago, cuota inicial y si quiere pasar a verla.' ELSE coalesce(nullif(string_split(trim(nombre), ' ')[1], ''), 'El cliente') || ' ' || "
    "coalesce(nullif(concat_ws(', ', 'preguntó por la ' || coalesce(ia_modelo, ia_modelo_texto), CASE WHEN ia_cuota_inicial_cop <> 0 THEN 'tiene ' || " + _PESOS + " || ' de inicial' END, CASE ia_forma_pago WHEN 'credito' THEN 'va por crédito' WHEN 'contado' THEN 'paga de contado' END), ''), 'escribió sin dar detalles') || "
    "CASE WHEN ia_pidio_cita THEN '. Pidió cita' WHEN ia_pidio_cotizacion THEN '. Pidió cotización' ELSE '' END || CASE WHEN ia_objecion <> 'ninguna' THEN '. Ojo: puso una objeción de ' || replace(ia_objecion, '_', ' ') ELSE '' END || "
    "CASE WHEN NOT ia_cliente_respondio THEN '. No respondió al último mensaje' ELSE '' END || CASE WHEN estado_gestion = 'Sin gestión' THEN '. Lleva ' || CAST(round_even(" + _END.format(x="fecha_registro") + ", 0) AS BIGINT) || ' h sin contacto' ELSE '' END || '.' END AS frase FROM list_day"))
def opening_sentence(spark, folder) -> DataFrame:
    return serving.opening_sentence(view(daily(spark, folder)))


@reg.query("j9_other_leads", with_ctes("SELECT l.lead_id, p.lead_id AS lead_elegido, l.canal, l.estado_gestion FROM ranked AS l JOIN ranked AS p USING (empresa_id, clave_dedup) WHERE p.es_principal AND l.lead_id <> p.lead_id"))
def other_leads(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return serving.other_leads(d.leads, d.leads.filter("es_principal")).select("lead_id", "lead_elegido", "canal", "estado_gestion")


@reg.query("j10_chat_messages", with_ctes("SELECT conversacion_id, orden, emisor, texto FROM msg WHERE conversacion_id IN (SELECT conversacion_id FROM placed)"))
def chat_messages(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return d.messages.join(d.placed.select(ID), ID, "left_semi").select(ID, "orden", "emisor", "texto").orderBy(ID, "orden")


@reg.query("j11_evidence_version", with_ctes("SELECT conversacion_id, intencion FROM ext WHERE conversacion_id % 5 <> 0 AND conversacion_id IN (SELECT conversacion_id FROM placed)"))
def evidence_version(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    used = d.placed.select(ID, F.lit(fixed.RULES_VERSION).alias("prompt_version"))
    return serving.evidence_of_version(cache_table(d), used).select(ID, "intencion")


@reg.query("j13_tenant_scope", with_ctes("SELECT u.user_id, p.empresa_id, count(*) AS puntos, sum(n)::BIGINT AS asesores FROM usr AS u JOIN (SELECT empresa_id, punto_venta_id, count(*) AS n FROM adv GROUP BY 1, 2) AS p USING (empresa_id) GROUP BY 1, 2"))
def tenant_scope(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    per_point = d.advisors.groupBy("empresa_id", "punto_venta_id").agg(F.count(F.lit(1)).alias("n"))
    return serving.in_tenant(per_point, users(d)).groupBy("user_id", "empresa_id").agg(F.count(F.lit(1)).alias("puntos"), F.sum("n").alias("asesores"))


@reg.query("j14_visible_clients", with_ctes("SELECT u.user_id, c.empresa_id, c.clave_dedup FROM clients AS c JOIN usr AS u ON u.empresa_id = c.empresa_id AND u.rol = 'gerente' UNION SELECT * FROM sees_client"))
def visible_clients(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return serving.visible_clients(users(d), d.clients, two_days(d), d.leads)


@reg.query("j14_visible_leads", with_ctes("SELECT * FROM sees_lead"))
def visible_leads(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return serving.visible_leads(users(d), two_days(d), d.leads)


@reg.query("j15_inherited", with_ctes(
    "SELECT 'mensaje' AS tabla, s.user_id, count(*) AS filas FROM sees_lead AS s JOIN chats AS c USING (lead_id) JOIN msg USING (conversacion_id) GROUP BY ALL UNION ALL SELECT 'extraccion', s.user_id, count(*) FROM sees_lead AS s JOIN chats AS c USING (lead_id) JOIN ext USING (conversacion_id) GROUP BY ALL "
    "UNION ALL SELECT 'score', s.user_id, count(*) FROM sees_lead AS s JOIN scores AS c USING (lead_id, empresa_id) GROUP BY ALL UNION ALL SELECT 'senales_lead', s.user_id, count(*) FROM sees_lead AS s JOIN signals AS c USING (lead_id, empresa_id) GROUP BY ALL"))
def inherited(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    seen = serving.visible_leads(users(d), two_days(d), d.leads)
    chats = serving.inherited(d.chats.select(ID, "lead_id"), seen, ["lead_id"]).select("user_id", ID)
    parts = {"mensaje": serving.inherited(d.messages, chats, [ID]), "extraccion": serving.inherited(d.extraction.select(ID), chats, [ID]),
             "score": serving.inherited(d.scores.select("lead_id", "empresa_id"), seen, ["lead_id", "empresa_id"]),
             "senales_lead": serving.inherited(d.signals.select("lead_id", "empresa_id"), seen, ["lead_id", "empresa_id"])}
    counted = [df.groupBy("user_id").agg(F.count(F.lit(1)).alias("filas")).withColumn("tabla", F.lit(n)) for n, df in parts.items()]
    return quality.union_logs(*counted)


@reg.query("j16_visible_assignment", with_ctes(
    "SELECT u.user_id, a.fecha_corte, a.lead_id, a.asesor_id, a.empresa_id FROM two_days AS a JOIN usr AS u ON u.empresa_id = a.empresa_id AND u.rol = 'gerente' UNION SELECT u.user_id, a.fecha_corte, a.lead_id, a.asesor_id, a.empresa_id FROM last_assigned AS a JOIN usr AS u ON u.empresa_id = a.empresa_id AND u.asesor_id = a.asesor_id"))
def visible_assignment(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return serving.visible_assignment(users(d), two_days(d))


@reg.query("j17_manager_only", with_ctes("SELECT u.user_id, h.lead_id, h.desenlace FROM his AS h JOIN usr AS u ON u.empresa_id = h.empresa_id AND u.rol = 'gerente'"))
def manager_only(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return serving.in_tenant(d.history, serving.managers(users(d))).select("user_id", "lead_id", "desenlace")


_USERS3 = "(SELECT user_id, empresa_id, rol, asesor_id FROM usr WHERE user_id IN ('m1', 'a' || (SELECT CAST(min(asesor_id) AS VARCHAR) FROM last_assigned)))"
_VIEWS = {
    "cliente": f"SELECT u.user_id, c.clave_dedup AS clave FROM clients AS c JOIN {_USERS3} AS u ON u.empresa_id = c.empresa_id AND u.rol = 'gerente' UNION ALL SELECT s.user_id, s.clave_dedup FROM sees_client AS s JOIN {_USERS3} AS u USING (user_id) WHERE u.rol <> 'gerente'",
    "lead": f"SELECT s.user_id, CAST(s.lead_id AS VARCHAR) FROM sees_lead AS s JOIN {_USERS3} AS u USING (user_id)",
    "mensaje": f"SELECT s.user_id, CAST(m.conversacion_id AS VARCHAR) || '-' || CAST(m.orden AS VARCHAR) FROM sees_lead AS s JOIN {_USERS3} AS u USING (user_id) JOIN chats AS c USING (lead_id) JOIN msg AS m USING (conversacion_id)",
    "extraccion": f"SELECT s.user_id, CAST(e.conversacion_id AS VARCHAR) FROM sees_lead AS s JOIN {_USERS3} AS u USING (user_id) JOIN chats AS c USING (lead_id) JOIN ext AS e USING (conversacion_id)",
    "score": f"SELECT s.user_id, CAST(c.lead_id AS VARCHAR) FROM sees_lead AS s JOIN {_USERS3} AS u USING (user_id) JOIN scores AS c ON c.lead_id = s.lead_id AND c.empresa_id = s.empresa_id",
    "asignacion": f"SELECT u.user_id, CAST(a.fecha_corte AS VARCHAR) || '/' || CAST(a.lead_id AS VARCHAR) FROM two_days AS a JOIN {_USERS3} AS u ON u.empresa_id = a.empresa_id AND u.rol = 'gerente' UNION ALL "
                  f"SELECT u.user_id, CAST(a.fecha_corte AS VARCHAR) || '/' || CAST(a.lead_id AS VARCHAR) FROM last_assigned AS a JOIN {_USERS3} AS u ON u.empresa_id = a.empresa_id AND u.asesor_id = a.asesor_id AND u.rol <> 'gerente'",
    "historico_cierre": f"SELECT u.user_id, CAST(h.lead_id AS VARCHAR) FROM his AS h JOIN {_USERS3} AS u ON u.empresa_id = h.empresa_id AND u.rol = 'gerente'",
    "problema_calidad": f"SELECT u.user_id, l.registro_id || '/' || l.tipo FROM all_log AS l JOIN {_USERS3} AS u ON u.empresa_id = l.empresa_id AND u.rol = 'gerente'",
    "asesor": f"SELECT u.user_id, CAST(a.asesor_id AS VARCHAR) FROM adv AS a JOIN {_USERS3} AS u USING (empresa_id)",
    "modelo": f"SELECT u.user_id, c.sku FROM cat AS c, (SELECT user_id FROM {_USERS3} UNION ALL SELECT 'nadie') AS u",
    "modelo_punto_venta": f"SELECT u.user_id, b.sku || '@' || CAST(b.punto_venta_id AS VARCHAR) FROM bridge AS b, (SELECT user_id FROM {_USERS3} UNION ALL SELECT 'nadie') AS u",
}


@reg.query("j17_one_user", with_ctes(
    "SELECT user_id, tabla, clave, count(*) AS filas FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tabla, * FROM ({q}) AS z(user_id, clave)" for t, q in _VIEWS.items()) + ") AS y GROUP BY ALL", LOG))
def one_user(spark, folder) -> DataFrame:
    """All that a manager, an advisor and a user without tenant see, table by table, over tables partitioned by tenant."""
    d = daily(spark, folder)
    people = users(d).unionByName(spark.createDataFrame([("nadie", None, "asesor", None)], users(d).schema))
    part = {n: tables.by_partition(t, n, "empresa_id") for n, t in {
        "lead": d.leads.select("lead_id", *serving.CLIENT), "cliente": d.clients.select(*serving.CLIENT), "asignacion": two_days(d), "historico": d.history.select("lead_id", "empresa_id"),
        "problema": d.quality_log.select("empresa_id", "registro_id", "tipo"), "score": d.scores.select("lead_id", "empresa_id")}.items()}
    first = serving.latest_assignment(part["asignacion"]).agg(F.min("asesor_id")).first()[0]
    out = []
    for user in ("m1", f"a{first}", "nadie"):
        me = serving.Scope(people, user)
        leads = me.leads(part["asignacion"], part["lead"])
        chats = me.inherited(d.chats.select(ID, "lead_id"), leads, ["lead_id"])
        key = lambda *c: F.concat_ws("-", *(F.col(x).cast("string") for x in c))
        seen = {
            "cliente": me.clients(part["cliente"], part["asignacion"], part["lead"]).select(F.col("clave_dedup").alias("clave")), "lead": leads.select(key("lead_id")),
            "mensaje": me.inherited(d.messages, chats, [ID]).select(key(ID, "orden")), "extraccion": me.inherited(d.extraction, chats, [ID]).select(key(ID)),
            "score": me.inherited(part["score"], leads, ["lead_id", "empresa_id"]).select(key("lead_id")),
            "asignacion": me.assignment(part["asignacion"]).select(F.concat_ws("/", F.col("fecha_corte").cast("date").cast("string"), F.col("lead_id").cast("string"))),
            "historico_cierre": me.managers_only(part["historico"]).select(key("lead_id")), "problema_calidad": me.managers_only(part["problema"]).select(F.concat_ws("/", "registro_id", "tipo")),
            "asesor": me.of_tenant(d.advisors).select(key("asesor_id")),
            "modelo": d.catalogue.select("sku"), "modelo_punto_venta": d.availability.select(F.concat_ws("@", "sku", F.col("punto_venta_id").cast("string"))),
        }
        out += [df.toDF("clave").select(F.lit(user).alias("user_id"), F.lit(t).alias("tabla"), "clave") for t, df in seen.items()]
    return quality.union_logs(*out).groupBy("user_id", "tabla", "clave").agg(F.count(F.lit(1)).alias("filas"))


@reg.query("w6_latest_cutoff", with_ctes("SELECT empresa_id, max(fecha_corte) AS fecha_corte, count(*) AS filas FROM last_assigned GROUP BY empresa_id"))
def latest_cutoff(spark, folder) -> DataFrame:
    return serving.latest_assignment(two_days(daily(spark, folder))).groupBy("empresa_id").agg(F.max("fecha_corte").alias("fecha_corte"), F.count(F.lit(1)).alias("filas"))


@reg.query("a7_advisor_load", with_ctes("SELECT s.fecha_corte, s.asesor_id, a.empresa_id, a.punto_venta_id, a.nombre, a.capacidad_diaria, s.asignados, s.prioritarios, s.asignados::DOUBLE / a.capacidad_diaria AS uso "
                                        "FROM (SELECT fecha_corte, asesor_id, count(*) AS asignados, count(*) FILTER (prioritario) AS prioritarios FROM assigned WHERE estado = 'asignado' GROUP BY 1, 2) AS s JOIN adv AS a USING (asesor_id) WHERE a.activo"))
def advisor_load(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return serving.advisor_load(d.assignment, d.advisors)


@reg.query("a8_assignment_counts", with_ctes("SELECT count(*) AS asignacion, count(*) FILTER (estado = 'asignado') AS asignados, count(*) FILTER (estado = 'sin_cupo') AS sin_cupo, count(*) FILTER (prioritario) AS prioritarios FROM assigned"))
def assignment_counts(spark, folder) -> DataFrame:
    return serving.assignment_counts(daily(spark, folder).assignment)


@reg.query("a9_temperatures", with_ctes("SELECT t.p::BIGINT AS posicion, t.t AS temperatura, count(s.lead_id) AS leads FROM (VALUES (0, 'Caliente'), (1, 'Tibio'), (2, 'Frío'), (3, 'Sin calificar')) AS t(p, t) LEFT JOIN scores AS s ON s.temperatura = t.t GROUP BY 1, 2"))
def temperatures(spark, folder) -> DataFrame:
    return serving.temperature_counts(daily(spark, folder).scores)


@reg.query("a10_contacted_in_time", with_ctes(
    "SELECT fecha_corte, count(*) FILTER (m AND fecha_primer_contacto IS NOT NULL AND edad - hc <= 24) AS a_tiempo, count(*) FILTER (m) AS medibles FROM (SELECT *, edad >= 24 AND (fecha_primer_contacto IS NOT NULL OR estado_gestion = 'Sin gestión') AS m FROM "
    "(SELECT *, " + _END.format(x="fecha_registro") + " AS edad, " + _END.format(x="fecha_primer_contacto") + " AS hc FROM list_day) AS q) AS w GROUP BY fecha_corte"))
def contacted_in_time(spark, folder) -> DataFrame:
    return serving.contacted_in_time(view(daily(spark, folder)))


@reg.query("a5_channels", with_ctes("SELECT empresa_id, clave_dedup, canales FROM clients"))
def channels(spark, folder) -> DataFrame:
    from leadloom.operators.entities import channels_per_client
    return channels_per_client(daily(spark, folder).keyed_leads)


@reg.query("w1_first_rows", with_ctes("SELECT lead_id, orden_archivo, copia > 1 AS repetida FROM tested"))
def first_rows(spark, folder) -> DataFrame:
    first, again = standardize.split_repeated(daily(spark, folder).raw_leads.select("lead_id", "orden_archivo"))
    return first.withColumn("repetida", F.lit(False)).unionByName(again.withColumn("repetida", F.lit(True)))


@reg.query("w9_unseated", with_ctes("SELECT lead_id, prioritario, prioridad, row_number() OVER (ORDER BY prioritario DESC, prioridad DESC, lead_id) AS posicion FROM assigned WHERE estado = 'sin_cupo'"))
def unseated(spark, folder) -> DataFrame:
    return serving.unseated(daily(spark, folder).assignment).select("lead_id", "prioritario", "prioridad", "posicion")


@reg.query("w9_company_list", with_ctes("SELECT lead_id, prioridad, fecha_registro, row_number() OVER (ORDER BY prioridad DESC, fecha_registro, lead_id) AS posicion FROM assigned WHERE estado = 'asignado'"))
def company_list(spark, folder) -> DataFrame:
    return serving.company_list(daily(spark, folder).assignment).select("lead_id", "prioridad", "fecha_registro", "posicion")


@reg.query("w10_last_run", "SELECT event_id AS ejecucion_id, ts AS iniciado_en, event_type AS estado FROM events ORDER BY event_id DESC LIMIT 1")
def last_run(spark, folder) -> DataFrame:
    """Top one by run id; the events stand for runs."""
    runs = daily(spark, folder).inputs.table("events").select(F.col("event_id").alias("ejecucion_id"), F.col("ts").alias("iniciado_en"), F.col("event_type").alias("estado"))
    return runs.orderBy(F.desc("ejecucion_id")).limit(1)


@reg.query("w11_dates", with_ctes("SELECT DISTINCT fecha_corte FROM two_days"))
def dates(spark, folder) -> DataFrame:
    return two_days(daily(spark, folder)).select("fecha_corte").distinct().orderBy(F.desc("fecha_corte"))


@reg.query("j7_segment_lookup", with_ctes("SELECT h.lead_id, h.modelo_cotizado, c.segmento FROM his AS h LEFT JOIN cat AS c ON c.marca || ' ' || c.linea = h.modelo_cotizado"))
def segment(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    segments = d.catalogue.select(F.col("nombre_completo").alias("modelo_cotizado"), "segmento")
    return d.history.select("lead_id", "modelo_cotizado").join(segments, "modelo_cotizado", "left")
