"""Registered queries: data profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import text
from leadloom.operators import profiling as pf
from leadloom.operators import evaluation as ev
from leadloom.plans.driver_tables import SPLIT_DATE
from leadloom.plans.oracle_base import CTES, date_class, key, with_ctes
from leadloom.plans.queries_evaluation import prepared, rounded, sql_p_value, sql_wilson
from leadloom.plans.registry import Registry, daily

reg = Registry()
ID = "conversacion_id"
RAW = fixed.REQUIRED["leads"]


def measured(d) -> DataFrame:
    """Measured rows with the model rule."""
    return d.measured.join(d.matched.select("lead_id", "regla", "sku_interes", "modelo_disponible_pv"), "lead_id", "left")


@reg.query("p0_measured_rows", with_ctes("SELECT lead_id, orden_archivo, copia > 1 AS repetida, es_prueba, reg_at, reg_reason, con_reason, por_dia, antes AS contacto_antes FROM tested"))
def measured_rows(spark, folder) -> DataFrame:
    return daily(spark, folder).build("measured").select("lead_id", "orden_archivo", "repetida", "es_prueba", "reg_at", "reg_reason", "con_reason", "por_dia", "contacto_antes")


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS columna, CAST({c} AS VARCHAR) AS valor FROM raw" for c in RAW)


@reg.query("p1_column_profile", with_ctes(
    f"SELECT t.columna, t.nulos, t.distintos, v.valor, CASE WHEN distintos <= 12 THEN v.n END AS n, v.k FROM (SELECT columna, (count(*) - count(valor))::BIGINT AS nulos, count(DISTINCT valor) AS distintos FROM ({_LONG}) AS l GROUP BY 1) AS t LEFT JOIN "
    f"(SELECT columna, valor, count(*) AS n, row_number() OVER (PARTITION BY columna ORDER BY valor) AS k FROM ({_LONG}) AS l WHERE valor IS NOT NULL GROUP BY 1, 2) AS v ON v.columna = t.columna AND ((distintos <= 12 AND k <= 12) OR k <= 3)"))
def column_profile(spark, folder) -> DataFrame:
    return pf.column_profile(daily(spark, folder).raw_leads, RAW)


@reg.query("p2_chat_profile", with_ctes(
    f"SELECT 'conversaciones' AS medida, '' AS valor, count(*) AS n FROM chats_raw UNION ALL SELECT 'canal', canal, count(*) FROM chats_raw GROUP BY canal UNION ALL SELECT 'formato_inicio', {date_class('fecha_inicio')}, count(*) FROM chats_raw GROUP BY 2 "
    "UNION ALL SELECT 'emisor', emisor, count(*) FROM msg GROUP BY emisor UNION ALL SELECT 'ids_repetidos', '', 0"))
def chat_profile(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return pf.chat_profile(d.chats, d.messages)


@reg.query("p3_phone_shapes", with_ctes("SELECT regexp_replace(telefono, '[0-9]', '9', 'g') AS forma, count(*) AS n FROM raw GROUP BY 1"))
def phone_shapes(spark, folder) -> DataFrame:
    return pf.count(daily(spark, folder).raw_leads, text.phone_shape(F.col("telefono")).alias("forma"))


def _slash_sql(c: str) -> str:
    x, y = f"substr(trim({c}), 1, 2)", f"substr(trim({c}), 4, 2)"
    return f"CASE WHEN {date_class(c)} <> 'barras' THEN NULL WHEN {x} > '12' THEN 'ddmm' WHEN {y} > '12' THEN 'mmdd' WHEN {x} = {y} THEN 'igual' ELSE 'ambigua' END"


@reg.query("p4_date_classes", with_ctes(" UNION ALL ".join(f"SELECT '{c}' AS columna, {date_class(c)} AS formato, {_slash_sql(c)} AS barras, count(*) AS n FROM raw GROUP BY 2, 3" for c in ("fecha_registro", "fecha_primer_contacto"))))
def date_classes(spark, folder) -> DataFrame:
    return pf.date_classes(daily(spark, folder).raw_leads, ["fecha_registro", "fecha_primer_contacto"])


_official = "CASE " + key("ciudad") + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CITIES.items()) + " END"
_syn = f"{key('ciudad')} IN ({', '.join(repr(s) for s in fixed.CITY_SYNONYMS)})"
_CHECKS = {
    "canal_no_estandar": ("canal IS NOT NULL AND canal IS DISTINCT FROM canal_n", "canal"), "canal_nulo": ("canal IS NULL", "id"),
    "estado_no_estandar": ("estado_gestion IS DISTINCT FROM estado_n", "estado_gestion"), "telefono_no_estandar": ("NOT coalesce(regexp_full_match(telefono, '[0-9]{10}'), false)", "telefono"),
    "telefono_invalido": ("telefono_n IS NULL", "telefono"), "email_nulo": ("email IS NULL", "id"),
    "email_sin_normalizar": ("email IS NOT NULL AND (NOT regexp_full_match(trim(email), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') OR email <> lower(trim(email)))", "email"),
    "nombre_con_espacios": ("nombre_cliente <> trim(nombre_cliente)", "nombre_cliente"), "nombre_todo_igual": ("trim(nombre_cliente) IN (upper(trim(nombre_cliente)), lower(trim(nombre_cliente)))", "trim(nombre_cliente)"),
    "nombre_abreviado": ("regexp_matches(nombre_cliente, '(^|[^\\p{L}])[A-ZÁÉÍÓÚÑ]\\.')", "trim(nombre_cliente)"), "ciudad_sinonimo": (_syn, "ciudad"),
    "ciudad_solo_forma": (f"ciudad IS NOT NULL AND NOT coalesce({_syn}, false) AND ciudad IS DISTINCT FROM {_official}", "ciudad"), "ciudad_bogota": (f"{key('ciudad')} IN ('bogota', 'bogota d.c.')", "ciudad"),
    "ciudad_nula": ("ciudad IS NULL", "id"), "ciudad_sin_mapeo": (f"{key('ciudad')} IS NOT NULL AND {_official} IS NULL", key("ciudad")), "registro_prueba": ("es_prueba", "id"), "lead_repetido": ("copia > 1", "id"),
    "fecha_invalida": ("reg_reason = 'invalida' OR con_reason = 'invalida'", "id"), "contacto_antes": ("antes", "id"), "gestionado_sin_fecha": ("estado_n IS DISTINCT FROM 'Sin gestión' AND fecha_primer_contacto IS NULL", "estado_n"),
    "sin_gestion_con_fecha": ("estado_n = 'Sin gestión' AND fecha_primer_contacto IS NOT NULL", "id"), "fecha_con_barras": ("reg_class = 'barras'", "fecha_registro"),
    "modelo_sin_coincidencia": ("regla = 'sin_coincidencia'", "modelo_interes_texto"), "modelo_no_disponible": ("NOT modelo_disponible_pv", "sku_interes"),
}
_MEASURED = {"full_rows": ("SELECT t.*, CAST(t.lead_id AS VARCHAR) AS id, m.regla, m.sku_interes, m.modelo_disponible_pv FROM tested AS t LEFT JOIN matched AS m USING (lead_id)", ("tested", "matched"))}


@reg.query("p5_quality_table", with_ctes(" UNION ALL ".join(f"SELECT '{n}' AS problema, count(*) AS casos, min({e}) AS ejemplo FROM full_rows WHERE {w}" for n, (w, e) in _CHECKS.items()), _MEASURED))
def quality_table(spark, folder) -> DataFrame:
    return pf.quality_table(measured(daily(spark, folder)))


@reg.query("p6_duplicate_rows", with_ctes("SELECT lead_id, count(*) AS filas, count(DISTINCT (fecha_registro, canal, nombre_cliente, telefono)) = 1 AS identicas FROM raw GROUP BY 1 HAVING count(*) > 1"))
def duplicate_rows(spark, folder) -> DataFrame:
    return pf.duplicate_rows(daily(spark, folder).raw_leads, "lead_id", RAW)


@reg.query("p7_model_rules", with_ctes("SELECT regla, count(*) AS leads, count(DISTINCT modelo_texto_original) AS variantes, count(*) FILTER (NOT modelo_disponible_pv) AS no_disponibles FROM matched GROUP BY 1"))
def model_rules(spark, folder) -> DataFrame:
    return pf.model_rules(daily(spark, folder).matched)


@reg.query("p8_points_of_sale", with_ctes(
    "SELECT s.punto_venta_id, count(DISTINCT s.empresa_id) AS empresas, count(*) AS leads, any_value(c.ciudad) AS ciudad, round(any_value(c.n) / count(s.ciudad)::DOUBLE, 9) AS participacion, count(DISTINCT s.ciudad) AS ciudades FROM std AS s LEFT JOIN (SELECT * FROM (SELECT punto_venta_id, ciudad, count(*) AS n, "
    "row_number() OVER (PARTITION BY punto_venta_id ORDER BY count(*) DESC, ciudad) AS r FROM std WHERE ciudad IS NOT NULL GROUP BY 1, 2) AS q WHERE r = 1) AS c USING (punto_venta_id) GROUP BY 1"))
def points_of_sale(spark, folder) -> DataFrame:
    return rounded(pf.points_of_sale(daily(spark, folder).clean_leads), "participacion")


CTES["g_phone"] = ("SELECT empresa_id, telefono, count(*) AS n, count(DISTINCT canal) AS c FROM std WHERE telefono IS NOT NULL GROUP BY 1, 2", ("std",))


@reg.query("p9_duplicate_statistics", with_ctes(
    "SELECT count(*) FILTER (n > 1) AS grupos, count(*) FILTER (n > 1 AND c > 1) AS multicanal, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS leads_en_grupos, coalesce(max(n) FILTER (n > 1), 0) AS maximo, (SELECT count(*) FROM (SELECT telefono FROM std WHERE telefono IS NOT NULL GROUP BY 1 HAVING count(DISTINCT empresa_id) > 1) AS t) AS compartidos, "
    "(SELECT count(*) FROM sim WHERE similitud < 60 AND clave_dedup LIKE 'tel:%') AS colisiones, (SELECT count(*) FROM (SELECT 1 FROM std WHERE email IS NOT NULL GROUP BY empresa_id, email HAVING count(*) > 1) AS e) AS grupos_email, (SELECT count(*) FROM std WHERE telefono IS NULL AND email IS NOT NULL) AS sin_telefono_con_email FROM g_phone"))
def duplicate_statistics(spark, folder) -> DataFrame:
    return pf.duplicate_statistics(daily(spark, folder).clean_leads)


@reg.query("p10_chat_relation", with_ctes(
    "SELECT (SELECT count(*) FROM chats WHERE lead_id NOT IN (SELECT lead_id FROM std)) AS huerfanas, (SELECT count(*) FROM chats AS c JOIN std AS s USING (lead_id) WHERE CAST(c.inicio AS DATE) < CAST(s.fecha_registro AS DATE)) AS antes_del_registro, count(*) AS con_chat, count(*) FILTER (n = 2) AS con_dos, count(*) FILTER (n > 2) AS con_mas, "
    "round(count(*) / (SELECT count(*) FROM std)::DOUBLE, 9) AS cobertura FROM (SELECT lead_id, count(*) AS n FROM chats JOIN std USING (lead_id) GROUP BY 1) AS p"))
def chat_relation(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return rounded(pf.chat_relation(d.clean_leads, d.chats), "cobertura")


_VARS = {"canal": "canal", "empresa_id": "CAST(empresa_id AS VARCHAR)", "segmento": "segmento", "cuota": "manifesto_cuota_inicial", "pago": "forma_pago_declarada", "cita": "CAST(pidio_cita AS VARCHAR)", "precio_alto": "CAST(s_precio AS VARCHAR)", "contactos": "CAST(numero_contactos AS VARCHAR)"}
_RATES = " UNION ALL ".join(f"SELECT '{n}' AS variable, {e} AS nivel, cerrado FROM pseg" for n, e in _VARS.items())
CTES["pseg"] = ("SELECT p.*, c.segmento FROM prep AS p LEFT JOIN cat AS c ON c.marca || ' ' || c.linea = p.modelo_cotizado", ("prep", "cat"))
_w = sql_wilson("cierres", "n")
_pv = sql_p_value("cierres", "n", "(tc - cierres)", "(tn - n)")


@reg.query("p11_variable_rates", with_ctes(
    f"SELECT variable, nivel, n, cierres, round({_w[0]}, 9) AS tasa, {_w[1]} AS ic_bajo, {_w[2]} AS ic_alto, {_pv} AS p, coalesce({_pv} < 0.05, false) AS significativa FROM (SELECT *, sum(n) OVER (PARTITION BY variable)::BIGINT AS tn, sum(cierres) OVER (PARTITION BY variable)::BIGINT AS tc FROM "
    f"(SELECT variable, nivel, count(*) AS n, sum(cerrado)::BIGINT AS cierres FROM ({_RATES}) AS l WHERE nivel IS NOT NULL GROUP BY 1, 2) AS g) AS w"))
def variable_rates(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    segments = d.catalogue.select(F.col("nombre_completo").alias("modelo_cotizado"), "segmento")
    df = prepared(d).join(segments, "modelo_cotizado", "left")
    c = F.col
    out = pf.rates(df, {"canal": c("canal"), "empresa_id": c("empresa_id"), "segmento": c("segmento"), "cuota": c("manifesto_cuota_inicial"), "pago": c("forma_pago_declarada"),
                        "cita": c("pidio_cita"), "precio_alto": c("s_precio_alto"), "contactos": c("numero_contactos")})
    return rounded(rounded(out, "tasa", "ic_bajo", "ic_alto"), "p", digits=6)


_late = "coalesce(CASE WHEN d THEN date_diff('day', CAST(fecha_registro AS DATE), CAST(fecha_primer_contacto AS DATE)) > 1 ELSE epoch(fecha_primer_contacto - fecha_registro) > 86400 END, false)"
_doubt = "coalesce(d AND date_diff('day', CAST(fecha_registro AS DATE), CAST(fecha_primer_contacto AS DATE)) = 1, false)"


@reg.query("p12_no_contact_in_a_day", with_ctes(
    "SELECT count(*) AS leads, count(*) FILTER (nunca) AS nunca, count(*) FILTER (tarde) AS tarde, count(*) FILTER (dudoso) AS dudosos, round(count(*) FILTER (nunca OR tarde) / count(*)::DOUBLE, 9) AS conservador, round(count(*) FILTER (nunca OR tarde OR dudoso) / count(*)::DOUBLE, 9) AS pesimista, "
    "round(count(*) FILTER (nunca OR coalesce(epoch(fecha_primer_contacto - fecha_registro) > 86400, false)) / count(*)::DOUBLE, 9) AS medianoche, round(count(*) FILTER (maduro AND (nunca OR tarde)) / (count(*) FILTER (maduro))::DOUBLE, 9) AS maduros FROM "
    f"(SELECT *, fecha_primer_contacto IS NULL AS nunca, {_late} AS tarde, {_doubt} AS dudoso, coalesce(fecha_registro <= (SELECT momento FROM cut) - INTERVAL 24 HOUR, false) AS maduro FROM (SELECT *, coalesce(fecha_registro_precision, '') = 'dia' OR coalesce(fecha_contacto_precision, '') = 'dia' AS d FROM std) AS s) AS q"))
def no_contact(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return rounded(pf.no_contact_in_a_day(d.clean_leads, d.cutoff.select("momento").scalar()), "conservador", "pesimista", "medianoche", "maduros")


@reg.query("p13_volume_capacity", with_ctes(
    "SELECT e.empresa_id, round(avg(coalesce(n, 0)), 9) AS media, quantile_cont(coalesce(n, 0), 0.5)::DOUBLE AS mediana, max(coalesce(n, 0)) AS maximo, any_value(asesores) AS asesores, any_value(capacidad)::BIGINT AS capacidad, any_value(abiertos) AS abiertos, round(avg(coalesce(n, 0)) / any_value(capacidad), 9) AS uso FROM "
    "(SELECT DISTINCT empresa_id FROM std WHERE fecha_registro IS NOT NULL) AS e CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(CAST(fecha_registro AS DATE)) FROM std)::TIMESTAMP, (SELECT max(CAST(fecha_registro AS DATE)) FROM std)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS dia) AS s "
    "LEFT JOIN (SELECT empresa_id, CAST(fecha_registro AS DATE) AS dia, count(*) AS n FROM std WHERE fecha_registro IS NOT NULL GROUP BY 1, 2) AS d USING (empresa_id, dia) LEFT JOIN (SELECT empresa_id, count(*) AS asesores, sum(capacidad_diaria) AS capacidad FROM adv WHERE activo GROUP BY 1) AS a USING (empresa_id) "
    "LEFT JOIN (SELECT empresa_id, count(*) AS abiertos FROM std WHERE estado_gestion <> 'Descartado' GROUP BY 1) AS o USING (empresa_id) GROUP BY 1"))
def volume(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return rounded(pf.volume(d.clean_leads, d.advisors), "media", "uso")


@reg.query("p14_outcome_exclusions", with_ctes("SELECT desenlace, count(*) AS n, count(*) FILTER (horas_al_primer_contacto IS NULL) AS horas_nulas, count(*) FILTER (numero_contactos = 0) AS sin_contactos, count(*) FILTER (desenlace = 'Cerrado') AS cierres FROM his GROUP BY 1"))
def exclusions(spark, folder) -> DataFrame:
    return pf.outcome_exclusions(daily(spark, folder).history)


_FACT = {"pidió cita": ("pidio_cita", "NOT pidio_cita"), "cuota contra el resto": ("manifesto_cuota_inicial = 'SI'", "manifesto_cuota_inicial <> 'SI'"), "cuota contra NO": ("manifesto_cuota_inicial = 'SI'", "manifesto_cuota_inicial = 'NO'"),
         "precio alto": ("s_precio = 1", "s_precio = 0"), "contado contra crédito": ("forma_pago_declarada = 'contado'", "forma_pago_declarada = 'credito'"), "no informa contra crédito": ("forma_pago_declarada = 'no_informa'", "forma_pago_declarada = 'credito'")}
_fx = " UNION ALL ".join(f"SELECT '{n}' AS factor, count(*) FILTER ({a}) AS n_si, coalesce(sum(cerrado) FILTER ({a}), 0)::BIGINT AS cierres_si, count(*) FILTER ({b}) AS n_no, coalesce(sum(cerrado) FILTER ({b}), 0)::BIGINT AS cierres_no FROM prep" for n, (a, b) in _FACT.items())


@reg.query("p15_factor_table", with_ctes(f"SELECT *, round(cierres_si / n_si::DOUBLE, 9) AS tasa_si, round(cierres_no / n_no::DOUBLE, 9) AS tasa_no, {sql_p_value('cierres_si', 'n_si', 'cierres_no', 'n_no')} AS p FROM ({_fx}) AS f"))
def factors(spark, folder) -> DataFrame:
    return rounded(rounded(pf.factor_table(prepared(daily(spark, folder))), "tasa_si", "tasa_no"), "p", digits=6)


_V1 = "3 * s_cita + 3 * s_cuota + 2 * s_precio + CAST(forma_pago_declarada = 'contado' AS BIGINT)"


@reg.query("p16_first_score", with_ctes(f"SELECT temperatura, count(*) AS n, sum(cerrado)::BIGINT AS cierres, count(*) FILTER (prueba) AS n_prueba, coalesce(sum(cerrado) FILTER (prueba), 0)::BIGINT AS cierres_prueba FROM (SELECT cerrado, prueba, CASE WHEN {_V1} >= 6 THEN 'Caliente' WHEN {_V1} >= 3 THEN 'Tibio' ELSE 'Frío' END AS temperatura FROM prep) AS q GROUP BY 1"))
def first_score(spark, folder) -> DataFrame:
    return ev.temperature_table(pf.with_first_score(prepared(daily(spark, folder)))).select("temperatura", "n", "cierres", "n_prueba", "cierres_prueba")


@reg.query("p17_chat_lengths", with_ctes(
    "SELECT count(*) AS conversaciones, round(avg(n), 9) AS media, quantile_cont(n, 0.5)::DOUBLE AS mediana, min(n) AS minimo, max(n) AS maximo, round(avg(c), 9) AS media_cliente, count(*) FILTER (coalesce(u <= p, true)) AS sin_respuesta FROM "
    "(SELECT conversacion_id, count(*) AS n, count(*) FILTER (emisor = 'cliente') AS c, min(orden) AS p, max(orden) FILTER (emisor = 'cliente') AS u FROM msg GROUP BY 1) AS q"))
def chat_lengths(spark, folder) -> DataFrame:
    return rounded(pf.chat_lengths(daily(spark, folder).messages), "media", "media_cliente")


def _tags_sql(source: str, idc: str, col: str) -> str:
    k = key(col)
    marks = {n: " OR ".join(f"contains({k}, '{p}')" for p in ps) for n, ps in fixed.LEXICON.items()}
    bound = r"(?:^|$|[^\p{L}\p{N}_])"
    marks |= {n: f"regexp_matches({col if '$' in n else k}, '{p.replace(chr(92) + 'b', bound)}')" for n, p in {**fixed.AMOUNT_SHAPES, "cero": fixed.ZERO_AMOUNT}.items()}
    per = ", ".join(f"coalesce(bool_or(coalesce({m}, false)), false) AS t{i}" for i, m in enumerate(marks.values()))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS etiqueta, count(*) FILTER (t{i}) AS n, round(count(*) FILTER (t{i}) / count(*)::DOUBLE, 9) AS proporcion FROM per" for i, n in enumerate(marks))
    none = " AND ".join(f"NOT t{i}" for i, n in enumerate(marks) if n in fixed.LEXICON_OBJECTIONS)
    rows += f" UNION ALL SELECT 'ninguna', count(*) FILTER ({none}), round(count(*) FILTER ({none}) / count(*)::DOUBLE, 9) FROM per"
    return rows, f"SELECT {idc}, {per} FROM {source} GROUP BY {idc}"


_rows, _per = _tags_sql("(SELECT c.conversacion_id, m.texto FROM chats_raw AS c LEFT JOIN (SELECT * FROM msg WHERE emisor = 'cliente') AS m USING (conversacion_id)) AS m", "conversacion_id", "texto")


@reg.query("x19_chat_tags", with_ctes(_rows, {"per": (_per, ("msg", "chats_raw"))}))
def chat_tags(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    mine = d.messages.filter(F.col("emisor") == "cliente")
    return rounded(pf.lexicon_tags(d.chats, mine, ID, "texto"), "proporcion")


_MENTIONED = (
    "SELECT conversacion_id, sku, min(orden) AS orden, arg_min(lugar, orden) AS lugar FROM (SELECT m.conversacion_id, n.sku, m.orden, min(instr(m.t, n.nombre)) AS lugar FROM (SELECT *, " + key("texto") + " AS t FROM msg WHERE emisor = 'cliente') AS m CROSS JOIN names AS n WHERE instr(m.t, n.nombre) > 0 GROUP BY 1, 2, 3) AS q GROUP BY 1, 2")
_NAMED = {
    "names": ("SELECT nombre, arg_min(sku, (p, sku)) AS sku FROM (SELECT sku, lower(marca || ' ' || linea) AS nombre, 0 AS p FROM cat UNION ALL SELECT sku, lower(linea), 1 FROM cat) AS u GROUP BY nombre", ("cat",)),
}


@reg.query("x18_models_mentioned", with_ctes(_MENTIONED, _NAMED))
def models_mentioned(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return pf.models_mentioned(d.messages, d.catalogue)


@reg.query("x18_model_counts", with_ctes(
    "SELECT count(*) AS conversaciones, count(*) FILTER (n > 0) AS con_modelo, count(*) FILTER (n > 1) AS cambios_modelo FROM chats_raw LEFT JOIN "
    "(SELECT conversacion_id, count(DISTINCT sku) AS n FROM mentioned GROUP BY 1) AS q USING (conversacion_id)", {**_NAMED, "mentioned": (_MENTIONED, ("names", "msg", "chats_raw"))}))
def model_counts(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return pf.model_counts(pf.models_mentioned(d.messages, d.catalogue), d.chats)


_METRICS = "SELECT 'leads' AS metrica, count(*)::DOUBLE AS valor FROM std UNION ALL SELECT 'tasa_cierre', avg(cerrado) FROM prep UNION ALL SELECT 'razon_prueba', avg(cerrado) FILTER (temperatura = 'Caliente') / avg(cerrado) FILTER (temperatura = 'Frío') FROM prep WHERE prueba UNION ALL SELECT 'conversaciones', count(*)::DOUBLE FROM chats_raw UNION ALL SELECT 'historico', count(*)::DOUBLE FROM his"
CLAIMS = [("leads", 14000.0, 0), ("tasa_cierre", 0.3, 1), ("razon_prueba", 1.0, 1), ("conversaciones", None, 0), ("historico", 15000.0, 0)]
_claims = ", ".join(f"('{m}', {c if c is not None else 'NULL'}::DOUBLE, {n})" for m, c, n in CLAIMS)


@reg.query("p18_claim_check", with_ctes(
    f"SELECT c.metrica, c.citado, round(m.valor, 9) AS valor, CASE WHEN citado IS NULL THEN 'informativa' WHEN abs(round(m.valor * pow(10.0::DOUBLE, dec)) / pow(10.0::DOUBLE, dec) - citado) < 1e-9 THEN 'sí' ELSE 'no' END AS coincide FROM (VALUES {_claims}) AS c(metrica, citado, dec) LEFT JOIN metrics AS m USING (metrica)", {"metrics": (_METRICS, ("std", "prep", "chats_raw", "his"))}))
def claim_check(spark, folder) -> DataFrame:
    """Figures a report might claim, against the computed ones."""
    d = daily(spark, folder)
    p = prepared(d)
    def one(name, df, value):
        return df.agg(value.cast("double").alias("valor")).withColumn("metrica", F.lit(name))
    n = F.count(F.lit(1))
    metrics = one("leads", d.clean_leads, n).unionByName(one("tasa_cierre", p, F.avg("cerrado"))).unionByName(
        ev.hot_cold_ratio(p.filter("prueba")).select(F.col("razon").alias("valor"), F.lit("razon_prueba").alias("metrica"))).unionByName(
        one("conversaciones", d.chats, n)).unionByName(one("historico", d.history, n))
    claims = spark.createDataFrame(CLAIMS, "metrica string, citado double, decimales int")
    return rounded(pf.claim_check(metrics, claims), "valor")
