"""Registered queries: catalogue matching, collisions, chat signals, score, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import chat, text
from leadloom.operators import catalogue, consolidate, entities, extraction, quality, scoring, standardize
from leadloom.plans.oracle_base import with_ctes
from leadloom.plans.oracle_chat import CTES, clean_model, pattern  # noqa: F401  (registers the CTEs)
from leadloom.plans.registry import Registry, daily
from leadloom.sources import tables

reg = Registry()
ID = "conversacion_id"


@reg.query("n14_model_cleaning", with_ctes(f"SELECT lead_id, {clean_model('modelo_texto_original')} AS limpio FROM std"))
def model_cleaning(spark, folder) -> DataFrame:
    return daily(spark, folder).clean_leads.select("lead_id", text.clean_model(F.col("modelo_texto_original")).alias("limpio"))


@reg.query("j1_catalogue_match", with_ctes("SELECT lead_id, sku_interes, marca_interes, round(match_modelo_score, 6) AS puntaje, regla FROM matched"))
def catalogue_match(spark, folder) -> DataFrame:
    return daily(spark, folder).build("matched").select("lead_id", "sku_interes", "marca_interes", F.round("match_modelo_score", 6).alias("puntaje"), "regla")


@reg.query("j2_availability", with_ctes("SELECT lead_id, sku_interes, punto_venta_id, modelo_disponible_pv FROM matched"))
def availability(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    leads = d.matched.drop("modelo_disponible_pv")
    return catalogue.with_availability(leads, d.availability).select("lead_id", "sku_interes", "punto_venta_id", "modelo_disponible_pv")


@reg.query("s12_availability_bridge", with_ctes("SELECT * FROM bridge"))
def bridge(spark, folder) -> DataFrame:
    return daily(spark, folder).build("availability").withColumn("punto_venta_id", F.col("punto_venta_id").cast("long"))


@reg.query("a4_name_collisions", with_ctes("SELECT empresa_id, clave_dedup, round(similitud, 6) AS similitud, similitud < 60 AS colision FROM sim"))
def collisions(spark, folder) -> DataFrame:
    sims = entities.name_similarity(entities.with_client_key(daily(spark, folder).clean_leads))
    return sims.select("empresa_id", "clave_dedup", F.round("similitud", 6).alias("similitud"), (F.col("similitud") < fixed.NAME_COLLISION).alias("colision"))


@reg.query("s13_messages", with_ctes(
    "SELECT m.conversacion_id, m.orden, m.emisor, CASE WHEN regexp_matches(m.hora, '^([01][0-9]|2[0-3]):[0-5][0-9]$') THEN m.hora END AS hora, m.texto, s.lead_id IS NULL AS es_huerfana "
    "FROM msg AS m JOIN chats AS c USING (conversacion_id) LEFT JOIN std AS s ON s.lead_id = c.lead_id"))
def messages(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    known = d.clean_leads.select("lead_id", F.lit(False).alias("h"))
    owners = d.chats.select(ID, "lead_id").join(known, "lead_id", "left").select(ID, F.coalesce("h", F.lit(True)).alias("es_huerfana"))
    return d.messages.join(owners, ID).select(ID, "orden", "emisor", text.message_hour(F.col("hora")).alias("hora"), "texto", "es_huerfana")


@reg.query("n12_chat_checks", with_ctes(
    "SELECT 'conversaciones.json' AS archivo, CAST(conversacion_id AS VARCHAR) AS registro_id, 'conversacion_huerfana' AS tipo, NULL::BIGINT AS empresa_id FROM chats WHERE lead_id NOT IN (SELECT lead_id FROM std) "
    "UNION ALL SELECT 'leads.csv', CAST(c.lead_id AS VARCHAR), 'conversacion_antes_de_registro', s.empresa_id FROM chats AS c JOIN std AS s USING (lead_id) WHERE CAST(c.inicio AS DATE) < CAST(s.fecha_registro AS DATE)"))
def chat_checks(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return standardize.check_chats(d.chats, d.clean_leads).select("archivo", "registro_id", "tipo", "empresa_id")


@reg.query("j3_orphans", with_ctes("SELECT conversacion_id, lead_id FROM chats WHERE lead_id NOT IN (SELECT lead_id FROM std)"))
def orphans(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return d.chats.join(d.clean_leads.select("lead_id"), "lead_id", "left_anti").select(ID, "lead_id")


@reg.query("x1_client_messages", with_ctes("SELECT conversacion_id, count(*) AS mensajes, count(*) > 1 AS cliente_respondio FROM cm GROUP BY 1"))
def client_messages(spark, folder) -> DataFrame:
    return extraction.client_messages(daily(spark, folder).messages).groupBy(ID).agg(
        F.count(F.lit(1)).alias("mensajes"), (F.count(F.lit(1)) > 1).alias("cliente_respondio"))


@reg.query("x3_amounts", with_ctes("SELECT conversacion_id, orden, monto FROM sig WHERE monto IS NOT NULL"))
def amounts(spark, folder) -> DataFrame:
    m = extraction.client_messages(daily(spark, folder).messages)
    return m.select(ID, "orden", chat.amount(F.col("texto")).alias("monto")).filter(F.col("monto").isNotNull())


@reg.query("x9_model_mentions", with_ctes("SELECT conversacion_id, orden, modelo FROM sig2 WHERE marca_m IS NOT NULL"))
def mentions(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    m = extraction.client_messages(d.messages)
    return chat.with_model(m, "texto", d.brands, "modelo").select(ID, "orden", "modelo").filter(F.col("modelo").isNotNull())


EXT = ("conversacion_id", "modelo_texto", "cuota_inicial_cop", "menciona_cuota", "forma_pago", "intencion", "objecion", "pidio_cita", "pidio_cotizacion", "cliente_respondio")
EV = {"cuota_inicial_cop": "ev_cuota", "forma_pago": "ev_pago", "pidio_cita": "ev_cita", "pidio_cotizacion": "ev_cotizacion", "objecion": "ev_objecion"}


@reg.query("x10_rule_extraction", with_ctes("SELECT * FROM ext"))
def rule_extraction(spark, folder) -> DataFrame:
    df = daily(spark, folder).build("extraction")
    return df.select(*EXT, *(F.try_element_at("evidencia", F.lit(k)).alias(v) for k, v in EV.items()))


@reg.query("x11_validation", with_ctes("SELECT conversacion_id, cuota_original, cuota_inicial_cop, menciona_cuota, sku_extraido, coalesce(nota, '') AS correcciones FROM checked"))
def validation(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return d.build("checked").select(ID, "cuota_original", "cuota_inicial_cop", "menciona_cuota", "sku_extraido", F.array_join("correcciones", ",").alias("correcciones"))


def _bad():
    """Fields declared unsupported for the check of X12: they follow from the chat number."""
    c = F.col(ID)
    return F.filter(F.array(F.when(c % 3 == 0, "menciona_cuota"), F.when(c % 4 == 0, "forma_pago"), F.when(c % 5 == 0, "objecion"),
                            F.when(c % 2 == 0, "pidio_cita"), F.when(c % 7 == 0, "cliente_respondio"), F.when(c % 6 == 1, "intencion")), lambda x: x.isNotNull())


@reg.query("x12_unknown_fields", with_ctes(
    "SELECT conversacion_id, CASE WHEN conversacion_id % 3 = 0 THEN NULL ELSE cuota_inicial_cop END AS cuota_inicial_cop, CASE WHEN conversacion_id % 3 = 0 THEN 'NO_INFORMA' ELSE menciona_cuota END AS menciona_cuota, "
    "CASE WHEN conversacion_id % 4 = 0 THEN 'no_informa' ELSE forma_pago END AS forma_pago, CASE WHEN conversacion_id % 5 = 0 THEN 'ninguna' ELSE objecion END AS objecion, "
    "CASE WHEN conversacion_id % 2 = 0 THEN false ELSE pidio_cita END AS pidio_cita, CASE WHEN conversacion_id % 7 = 0 THEN true ELSE cliente_respondio END AS cliente_respondio, "
    "CASE WHEN conversacion_id % 6 = 1 THEN 'media' ELSE intencion END AS intencion FROM ext"))
def unknown_fields(spark, folder) -> DataFrame:
    df = extraction.as_unknown(daily(spark, folder).extraction, _bad())
    return df.select(ID, "cuota_inicial_cop", "menciona_cuota", "forma_pago", "objecion", "pidio_cita", "cliente_respondio", "intencion")


def _all_bad():
    """Every field that can fall, by the chat number."""
    every = (("modelo_texto", 8), ("cuota_inicial_cop", 11), ("menciona_cuota", 13), ("forma_pago", 4), ("intencion", 6), ("objecion", 5), ("pidio_cita", 2), ("pidio_cotizacion", 9), ("cliente_respondio", 7))
    return F.filter(F.array(*(F.when(F.col(ID) % k == 0, n) for n, k in every)), lambda x: x.isNotNull())


_BAD_LIST = "list_filter([" + ", ".join(f"CASE WHEN conversacion_id % {k} = 0 THEN '{n}' END" for n, k in (
    ("modelo_texto", 8), ("cuota_inicial_cop", 11), ("menciona_cuota", 13), ("forma_pago", 4), ("intencion", 6), ("objecion", 5), ("pidio_cita", 2), ("pidio_cotizacion", 9), ("cliente_respondio", 7))) + "], lambda x: x IS NOT NULL)"


@reg.query("x12_every_field", with_ctes(
    "SELECT conversacion_id, CASE WHEN conversacion_id % 8 <> 0 THEN modelo_texto END AS modelo_texto, CASE WHEN conversacion_id % 11 <> 0 AND conversacion_id % 13 <> 0 THEN cuota_inicial_cop END AS cuota_inicial_cop, "
    "CASE WHEN conversacion_id % 11 = 0 OR conversacion_id % 13 = 0 THEN 'NO_INFORMA' ELSE menciona_cuota END AS menciona_cuota, CASE WHEN conversacion_id % 4 = 0 THEN 'no_informa' ELSE forma_pago END AS forma_pago, "
    "CASE WHEN conversacion_id % 6 = 0 THEN 'media' ELSE intencion END AS intencion, CASE WHEN conversacion_id % 5 = 0 THEN 'ninguna' ELSE objecion END AS objecion, CASE WHEN conversacion_id % 2 = 0 THEN false ELSE pidio_cita END AS pidio_cita, "
    "CASE WHEN conversacion_id % 9 = 0 THEN false ELSE pidio_cotizacion END AS pidio_cotizacion, CASE WHEN conversacion_id % 7 = 0 THEN true ELSE cliente_respondio END AS cliente_respondio FROM ext"))
def every_field(spark, folder) -> DataFrame:
    return extraction.as_unknown(daily(spark, folder).extraction, _all_bad()).select(ID, *extraction.FIELDS)


@reg.query("a6_unsupported_fields", with_ctes(
    f"SELECT lead_id, empresa_id, coalesce(string_agg(DISTINCT campo, ',' ORDER BY campo), '') AS sin_respaldo FROM (SELECT lead_id, empresa_id, unnest(CASE WHEN len(malos) = 0 THEN [NULL] ELSE malos END) AS campo FROM (SELECT *, {_BAD_LIST} AS malos FROM placed) AS q) AS z GROUP BY 1, 2"))
def unsupported_fields(spark, folder) -> DataFrame:
    """Fields without support of any chat of a lead, over the chats on principal leads."""
    found = consolidate.consolidate(daily(spark, folder).placed.withColumn("sin_respaldo", _all_bad()))
    return found.select("lead_id", "empresa_id", F.array_join("sin_respaldo", ",").alias("sin_respaldo"))


# Claimed quotes, whole messages of every chat: the client's own words, words of the advisor, words with
# a slip, a quote that the advisor may give, and one that crosses two messages of the client.
CLAIMS = (
    "SELECT conversacion_id, 'pidio_cita' AS campo, arg_min(texto, orden) AS fragmento FROM {msg} WHERE emisor = 'cliente' AND trim(texto) <> '' GROUP BY conversacion_id "
    "UNION ALL SELECT conversacion_id, 'objecion', arg_min('asesor [10:00]: ' || texto, orden) FROM {msg} WHERE emisor = 'asesor' AND trim(texto) <> '' GROUP BY conversacion_id "
    "UNION ALL SELECT conversacion_id, 'forma_pago', arg_max(replace(texto, 'en', 'enn'), orden) FROM {msg} WHERE emisor = 'cliente' AND trim(texto) <> '' GROUP BY conversacion_id "
    "UNION ALL SELECT conversacion_id, 'cliente_respondio', arg_max(texto, orden) FROM {msg} WHERE emisor = 'asesor' AND trim(texto) <> '' GROUP BY conversacion_id "
    "UNION ALL SELECT f.conversacion_id, 'pidio_cotizacion', any_value(f.t) || ' ' || arg_min(m.texto, m.orden) FROM (SELECT conversacion_id, min(orden) AS o, arg_min(texto, orden) AS t FROM {msg} "
    "WHERE emisor = 'cliente' AND trim(texto) <> '' GROUP BY conversacion_id) AS f JOIN {msg} AS m ON m.conversacion_id = f.conversacion_id AND m.orden > f.o AND m.emisor = 'cliente' AND trim(m.texto) <> '' GROUP BY f.conversacion_id"
)


def claims(d) -> DataFrame:
    rows = d.messages.sparkSession.sql(CLAIMS.replace("arg_min", "min_by").replace("arg_max", "max_by"), msg=d.messages)
    entry = F.map_from_entries(F.collect_set(F.struct("campo", "fragmento")))  # five quotes per chat at most
    return rows.groupBy(ID).agg(entry.alias("evidencia"))


_QK = "trim(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}_$]+', ' ', 'g'))"
_HEAD = r"(?i)^\s*(cliente|asesor)\s*\[[^\]]*\]\s*:\s*"
LITERAL = {
    "claims": (CLAIMS.replace("{msg}", "msg"), ("msg",)),
    "quotes": (f"SELECT *, {_QK.format(x=f'regexp_replace(fragmento, {chr(39)}{_HEAD}{chr(39)}, {chr(39)}{chr(39)})')} AS cita FROM claims", ("claims",)),
    "full_text": (f"SELECT conversacion_id, string_agg(k, ' ' ORDER BY orden) FILTER (emisor = 'cliente') AS suyo, string_agg(k, ' ' ORDER BY orden) AS todo FROM "
                  f"(SELECT *, {_QK.format(x='texto')} AS k FROM msg) AS z WHERE k <> '' GROUP BY conversacion_id", ("msg",)),
}


@reg.query("x13_literal_quotes", with_ctes(
    "SELECT q.conversacion_id, campo, fragmento FROM quotes AS q LEFT JOIN full_text AS f USING (conversacion_id) WHERE cita <> '' AND NOT coalesce(contains(CASE WHEN campo = 'cliente_respondio' THEN todo ELSE suyo END, cita), false)", LITERAL))
def literal_quotes(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return extraction.unsupported(claims(d), d.messages, fuzzy=False)


@reg.query("x13_evidence_audit")
def evidence_audit(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return extraction.unsupported(claims(d), d.messages)


@reg.query("x14_evidence_map", with_ctes(
    "SELECT conversacion_id, arg_max(texto, orden) FILTER (emisor = 'cliente') AS cliente, arg_max(texto, orden) FILTER (emisor = 'asesor') AS asesor FROM msg GROUP BY conversacion_id"))
def evidence_map(spark, folder) -> DataFrame:
    quotes = daily(spark, folder).messages.select(ID, F.col("emisor").alias("campo"), F.col("texto").alias("fragmento"), "orden")
    df = extraction.evidence_list_to_map(quotes, "orden")
    return df.select(ID, F.try_element_at("evidencia", F.lit("cliente")).alias("cliente"), F.try_element_at("evidencia", F.lit("asesor")).alias("asesor"))


_DIGEST = "sha256(concat_ws(chr(1), CAST(orden AS VARCHAR), coalesce(emisor, chr(0)), coalesce(hora, chr(0)), coalesce(texto, chr(0))))"
HASH = {
    "hashes": ("SELECT conversacion_id, concat_ws('-', CAST(count(*) AS VARCHAR), " + ", ".join(
        f"printf('%x', bit_xor(CAST('0x' || substr(dg, {1 + 15 * i}, 15) AS BIGINT)))" for i in range(4)) + f") AS hash_contenido FROM (SELECT *, {_DIGEST} AS dg FROM msg) AS z GROUP BY conversacion_id", ("msg",)),
    # a second copy of every third chat: equal content under another id; and chats without any message
    "twins": ("SELECT conversacion_id, hash_contenido FROM hashes UNION ALL SELECT conversacion_id + 1000000, hash_contenido FROM hashes WHERE conversacion_id % 3 = 0 "
              "UNION ALL SELECT conversacion_id + 2000000, '0-0-0-0-0' FROM hashes WHERE conversacion_id % 5 = 0", ("hashes",)),
    "cached": ("SELECT DISTINCT hash_contenido FROM hashes WHERE conversacion_id % 4 = 0", ("hashes",)),
}


@reg.query("s4_fingerprint", with_ctes("SELECT * FROM hashes", HASH))
def fingerprint(spark, folder) -> DataFrame:
    return extraction.fingerprints(daily(spark, folder).messages)


def twins(d) -> tuple[DataFrame, DataFrame]:
    """(chats, messages) where every third chat appears again under another id, and for every fifth there
    is a chat without messages."""
    again = F.when(F.col(ID) % 3 == 0, F.array(F.lit(0), F.lit(1000000))).otherwise(F.array(F.lit(0)))
    silent = F.when(F.col(ID) % 5 == 0, F.array(F.lit(2000000))).otherwise(F.array().cast("array<int>"))
    def copied(df, to):
        return df.withColumn("_k", F.explode(to)).withColumn(ID, F.col(ID) + F.col("_k")).drop("_k")
    return copied(d.chats, F.concat(again, silent)), copied(d.messages, again)


def cache_of(d) -> DataFrame:
    """Cached extractions of every fourth chat."""
    hashes = extraction.fingerprints(d.messages).filter(F.col(ID) % 4 == 0)
    return d.extraction.join(hashes, ID).drop(ID).dropDuplicates(["hash_contenido"])


@reg.query("j4_cache_split", with_ctes(
    "SELECT t.conversacion_id, t.hash_contenido, c.hash_contenido IS NOT NULL AS en_cache, CASE WHEN t.conversacion_id < 2000000 THEN e.forma_pago ELSE 'no_informa' END AS forma_pago, CASE WHEN t.conversacion_id < 2000000 THEN e.cuota_inicial_cop END AS cuota_inicial_cop FROM twins AS t LEFT JOIN cached AS c USING (hash_contenido) "
    "JOIN ext AS e ON e.conversacion_id = t.conversacion_id % 1000000", HASH))
def cache_split(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    chats, msgs = twins(d)
    cache = cache_of(d)
    result, _ = extraction.extract_with_cache(
        chats, msgs, extraction.fingerprints(msgs), cache, lambda c, m: extraction.rule_extraction(c, m, d.brands))
    hit = cache.select("hash_contenido", F.lit(True).alias("h"))
    return result.join(hit, "hash_contenido", "left").select(ID, "hash_contenido", F.coalesce("h", F.lit(False)).alias("en_cache"), "forma_pago", "cuota_inicial_cop")


@reg.query("x16_fallback_routing", with_ctes(
    "SELECT conversacion_id, CASE WHEN conversacion_id % 3 = 0 AND conversacion_id % 2 = 0 THEN 'gemini' ELSE 'reglas' END AS extractor, CASE WHEN conversacion_id % 6 = 0 THEN 'alta' ELSE intencion END AS intencion FROM ext"))
def fallback(spark, folder) -> DataFrame:
    """Primary results exist for every third chat; half of them break the schema. An earlier row says
    otherwise, and a later one breaks the schema: the last valid row counts."""
    d = daily(spark, folder)
    primary = d.extraction.filter(F.col(ID) % 3 == 0).withColumn("intencion", F.when(F.col(ID) % 2 == 0, "alta").otherwise("altisima")).withColumn("fila", F.lit(2))
    earlier = primary.filter(F.col(ID) % 2 == 0).withColumns({"intencion": F.lit("baja"), "fila": F.lit(1)})
    later = earlier.withColumns({"intencion": F.lit("ninguna"), "fila": F.lit(3)})
    out = extraction.with_fallback(d.chats, d.messages, primary.unionByName(earlier).unionByName(later), lambda c, m: extraction.rule_extraction(c, m, d.brands), "fila")
    return out.select(ID, "extractor", "intencion")


@reg.query("j5_chat_principal", with_ctes("SELECT conversacion_id, lead_id, posicion FROM placed"))
def chat_principal(spark, folder) -> DataFrame:
    return consolidate.chat_order(daily(spark, folder).build("placed")).select(ID, "lead_id", "posicion")


@reg.query("a6_signals", with_ctes("SELECT * FROM signals"))
def signals(spark, folder) -> DataFrame:
    return daily(spark, folder).build("signals").drop("sin_respaldo")


# Two runs over one store. A primary extractor resolves every third chat (intention `alta`); rules do the rest. The first run
# sees every second chat, the second one all: it reads what the primary has resolved and computes the other contents.
RUNS = {
    "all_hashes": ("SELECT c.conversacion_id, coalesce(h.hash_contenido, '0-0-0-0-0') AS hash_contenido FROM chats AS c LEFT JOIN hashes AS h USING (conversacion_id)", ("chats", "hashes")),
    "run1": ("SELECT hash_contenido, min(conversacion_id) AS rep FROM all_hashes WHERE conversacion_id % 2 = 0 GROUP BY 1", ("all_hashes",)),
    "hits": ("SELECT hash_contenido FROM run1 WHERE rep % 3 = 0", ("run1",)),
    "run2": ("SELECT hash_contenido, min(conversacion_id) AS rep FROM all_hashes WHERE hash_contenido NOT IN (SELECT hash_contenido FROM hits) GROUP BY 1", ("all_hashes", "hits")),
    "tagged": ("SELECT a.conversacion_id, a.hash_contenido, i.hash_contenido IS NOT NULL AS en_cache, CASE WHEN i.hash_contenido IS NOT NULL OR r.rep % 3 = 0 THEN 'gemini' ELSE 'reglas' END AS extractor "
                 "FROM all_hashes AS a LEFT JOIN hits AS i USING (hash_contenido) LEFT JOIN run2 AS r USING (hash_contenido)", ("all_hashes", "hits", "run2")),
}


def third_chats(d) -> extraction.Extractor:
    def extract(chats, messages):
        own = chats.filter(F.col(ID) % 3 == 0)
        return extraction.rule_extraction(own, messages.join(own, ID, "left_semi"), d.brands).withColumn("intencion", F.lit("alta"))

    return extraction.Extractor(fixed.PRIMARY_NAME, "v4", extract)


def new_store(spark) -> tables.ExtractionStore:
    return tables.ExtractionStore(spark, tables.new_path(spark, "extraccion"), extraction.STORED)


@reg.query("x15_extraction_stage", with_ctes(
    "SELECT r.conversacion_id, r.hash_contenido, r.en_cache, r.extractor, c.sku_extraido, e.cuota_inicial_cop AS cuota_cruda, c.cuota_inicial_cop, c.menciona_cuota, "
    "CASE WHEN r.extractor = 'gemini' THEN 'alta' ELSE e.intencion END AS intencion, e.forma_pago, e.objecion, e.pidio_cita, e.pidio_cotizacion, e.modelo_texto, e.ev_cita AS evidencia_cita, p.lead_id AS lead_principal "
    "FROM tagged AS r JOIN ext AS e USING (conversacion_id) JOIN checked AS c USING (conversacion_id) LEFT JOIN placed AS p USING (conversacion_id)", HASH | RUNS))
def extraction_stage(spark, folder) -> DataFrame:
    d, store = daily(spark, folder), new_store(spark)
    some = d.chats.filter(F.col(ID) % 2 == 0)
    extraction.through_store(some, d.messages.join(some.select(ID), ID, "left_semi"), store, third_chats(d), d.rules, "1")
    after = d.with_extraction(store, third_chats(d), "2")
    raw = after.extraction.select(ID, "hash_contenido", "en_cache", "extractor", F.col("cuota_inicial_cop").alias("cuota_cruda"), F.try_element_at("evidencia", F.lit("pidio_cita")).alias("evidencia_cita"))
    checked = after.build("checked").select(ID, "sku_extraido", "cuota_inicial_cop", "menciona_cuota", "intencion", "forma_pago", "objecion", "pidio_cita", "pidio_cotizacion", "modelo_texto")
    return raw.join(checked, ID).join(after.build("placed").select(ID, F.col("lead_id").alias("lead_principal")), ID, "left")


@reg.query("x15_stored_rows", with_ctes(
    "SELECT '1' AS lote, hash_contenido, CASE WHEN rep % 3 = 0 THEN 'gemini' ELSE 'reglas' END AS extractor, 'v4' AS prompt_version, e.forma_pago, CASE WHEN rep % 3 = 0 THEN 'alta' ELSE e.intencion END AS intencion FROM run1 JOIN ext AS e ON e.conversacion_id = rep "
    "UNION ALL SELECT '2', hash_contenido, CASE WHEN rep % 3 = 0 THEN 'gemini' ELSE 'reglas' END, 'v4', e.forma_pago, CASE WHEN rep % 3 = 0 THEN 'alta' ELSE e.intencion END FROM run2 JOIN ext AS e ON e.conversacion_id = rep", HASH | RUNS))
def stored_rows(spark, folder) -> DataFrame:
    """What the two runs leave in the store: a third run over the same chats would add only what rules had to resolve."""
    d, store = daily(spark, folder), new_store(spark)
    some = d.chats.filter(F.col(ID) % 2 == 0)
    for batch, chats in (("1", some), ("2", d.chats)):
        extraction.through_store(chats, d.messages.join(chats.select(ID), ID, "left_semi"), store, third_chats(d), d.rules, batch)
    return store.read().select("lote", "hash_contenido", "extractor", "prompt_version", "forma_pago", "intencion")


@reg.query("c1_c6_score", with_ctes("SELECT * FROM scores"))
def scores(spark, folder) -> DataFrame:
    return daily(spark, folder).build("scores").withColumn("razones", scoring.render_reasons(F.col("razones")))


@reg.query("c8_daily_assignment", with_ctes("SELECT * FROM assigned"))
def assigned(spark, folder) -> DataFrame:
    return daily(spark, folder).build("assignment").drop("turno")


@reg.query("j6_price_lookup", with_ctes("SELECT m.lead_id, m.sku_interes, c.precio_lista FROM matched AS m LEFT JOIN cat AS c ON c.sku = m.sku_interes"))
def price(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return d.matched.select("lead_id", "sku_interes").join(d.catalogue.select(F.col("sku").alias("sku_interes"), "precio_lista"), "sku_interes", "left")


@reg.query("q3_flags", with_ctes(
    "SELECT l.lead_id, coalesce(f.banderas, '') AS flags_calidad FROM std AS l LEFT JOIN (SELECT registro_id, string_agg(DISTINCT tipo, ',' ORDER BY tipo) AS banderas FROM all_log WHERE tipo IN ("
    + ", ".join(f"'{t}'" for t in fixed.VISIBLE_FLAGS) + ") GROUP BY registro_id) AS f ON f.registro_id = CAST(l.lead_id AS VARCHAR)", LOG := {
        "all_log": (
            "SELECT empresa_id, CAST(lead_id AS VARCHAR) AS registro_id, p.tipo AS tipo FROM log_std UNION ALL SELECT empresa_id, CAST(lead_id AS VARCHAR), regla FROM matched WHERE regla IN ('modelo_ambiguo', 'modelo_faltante', 'sin_coincidencia') "
            "UNION ALL SELECT k.empresa_id, CAST(k.lead_id AS VARCHAR), 'posible_colision_telefono' FROM keyed AS k JOIN sim AS s USING (empresa_id, clave_dedup) WHERE s.similitud < 60 "
            "UNION ALL SELECT NULL, CAST(conversacion_id AS VARCHAR), 'conversacion_huerfana' FROM chats WHERE lead_id NOT IN (SELECT lead_id FROM std) "
            "UNION ALL SELECT s.empresa_id, CAST(c.lead_id AS VARCHAR), 'conversacion_antes_de_registro' FROM chats AS c JOIN std AS s USING (lead_id) WHERE CAST(c.inicio AS DATE) < CAST(s.fecha_registro AS DATE) "
            "UNION ALL SELECT s.empresa_id, CAST(c.conversacion_id AS VARCHAR), nota FROM checked AS c JOIN chats USING (conversacion_id) LEFT JOIN std AS s ON s.lead_id = chats.lead_id WHERE nota IS NOT NULL "
            "UNION ALL SELECT s.empresa_id, CAST(c.conversacion_id AS VARCHAR), 'menciona_cuota_incoherente' FROM valid AS c JOIN chats USING (conversacion_id) LEFT JOIN std AS s ON s.lead_id = chats.lead_id "
            "WHERE cuota_inicial_cop IS NOT NULL AND mencion_original <> CASE WHEN cuota_inicial_cop > 0 THEN 'SI' ELSE 'NO' END", ("log_std", "matched", "keyed", "sim", "chats", "std", "checked", "valid"))}))
def flags(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return quality.with_flags(d.clean_leads, d.quality_log).select("lead_id", F.array_join("flags_calidad", ",").alias("flags_calidad"))


@reg.query("q1_quality_log", with_ctes("SELECT empresa_id, registro_id, tipo, count(*) AS veces FROM all_log GROUP BY ALL", LOG))
def quality_log(spark, folder) -> DataFrame:
    return daily(spark, folder).build("quality_log").groupBy("empresa_id", "registro_id", "tipo").agg(F.count(F.lit(1)).alias("veces"))


_ENTRY = "archivo, registro_id, campo, tipo, valor_original, accion, empresa_id"
ENTRIES = {"full_log": (
    "SELECT 'leads.csv' AS archivo, CAST(lead_id AS VARCHAR) AS registro_id, p.campo AS campo, p.tipo AS tipo, p.valor AS valor_original, p.accion AS accion, empresa_id FROM log_std "
    "UNION ALL SELECT 'leads.csv', CAST(lead_id AS VARCHAR), 'modelo_interes_texto', regla, modelo_texto_original, CASE regla WHEN 'modelo_ambiguo' THEN 'solo marca ' || marca_interes WHEN 'modelo_faltante' THEN 'sin modelo' ELSE 'sin SKU ni marca' END, empresa_id "
    "FROM matched WHERE regla IN ('modelo_ambiguo', 'modelo_faltante', 'sin_coincidencia') "
    "UNION ALL SELECT 'leads.csv', CAST(k.lead_id AS VARCHAR), 'nombre_cliente', 'posible_colision_telefono', k.nombre, 'similitud ' || CAST(CAST(round_even(s.similitud, 0) AS INT) AS VARCHAR) || '; se conserva el grupo', k.empresa_id FROM keyed AS k JOIN sim AS s USING (empresa_id, clave_dedup) WHERE s.similitud < 60 "
    "UNION ALL SELECT 'conversaciones.json', CAST(conversacion_id AS VARCHAR), 'lead_id', 'conversacion_huerfana', CAST(lead_id AS VARCHAR), 'se carga sin empresa', NULL FROM chats WHERE lead_id NOT IN (SELECT lead_id FROM std) "
    "UNION ALL SELECT 'leads.csv', CAST(c.lead_id AS VARCHAR), 'fecha_registro', 'conversacion_antes_de_registro', CAST(c.conversacion_id AS VARCHAR), 'bandera', s.empresa_id FROM chats AS c JOIN std AS s USING (lead_id) WHERE CAST(c.inicio AS DATE) < CAST(s.fecha_registro AS DATE) "
    "UNION ALL SELECT 'conversaciones.json', CAST(c.conversacion_id AS VARCHAR), 'cuota_inicial_cop', nota, CAST(c.cuota_original AS VARCHAR), 'valor corregido por la validación', s.empresa_id FROM checked AS c JOIN chats USING (conversacion_id) LEFT JOIN std AS s ON s.lead_id = chats.lead_id WHERE nota IS NOT NULL "
    "UNION ALL SELECT 'conversaciones.json', CAST(c.conversacion_id AS VARCHAR), 'cuota_inicial_cop', 'menciona_cuota_incoherente', CAST(c.cuota_original AS VARCHAR), 'valor corregido por la validación', s.empresa_id FROM valid AS c JOIN chats USING (conversacion_id) LEFT JOIN std AS s ON s.lead_id = chats.lead_id "
    "WHERE cuota_inicial_cop IS NOT NULL AND mencion_original <> CASE WHEN cuota_inicial_cop > 0 THEN 'SI' ELSE 'NO' END", ("log_std", "matched", "keyed", "sim", "chats", "std", "checked", "valid"))}


@reg.query("q1_log_entries", with_ctes(f"SELECT {_ENTRY}, count(*) AS veces FROM full_log GROUP BY ALL", ENTRIES))
def log_entries(spark, folder) -> DataFrame:
    """Every entry of the log with its field, original value and action."""
    return daily(spark, folder).quality_log.groupBy(*_ENTRY.split(", ")).agg(F.count(F.lit(1)).alias("veces"))


@reg.query("q2_counts_by_type", with_ctes("SELECT tipo, count(*) AS casos FROM all_log GROUP BY ALL", LOG))
def counts_by_type(spark, folder) -> DataFrame:
    return quality.counts_by_type(daily(spark, folder).quality_log)
