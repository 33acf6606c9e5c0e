"""Binding of the driver tables to the inputs of the pipeline.

The inputs are messy leads, a catalogue, advisors, closing history and chats. They are derived
from the driver tables by arithmetic on keys, in SQL that Spark and the checking engine both
read, so that both sides start from the same rows. Nothing here is random or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.ranking import with_rank

WINDOW = ("1995-01-01", "2001-08-31")
LIST_DAYS = 60
SPLIT_DATE = "2000-01-01"


def _case(expression: str, values: list[str]) -> str:
    return f"split_part('{'|'.join(values)}', '|', CAST({expression} AS INT) + 1)"


def _two(expression: str) -> str:
    return f"lpad(CAST({expression} AS STRING), 2, '0')"


ADJECTIVES = ["small", "large", "red", "blue", "old", "new", "hot", "cold"]
NOUNS = ["ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod"]
NAMES = ["ana perez", "Jorge  Quintero", "MARIA LOPEZ", " luis gil ", "Ana María Perez", "J. Quintero", "Zoé Núñez"]
CITIES = ["Barranquilla", "B/quilla", "BOGOTA", "Bogotá D.C.", " rio negro", "Sta Marta", "envigado", "MEDELLÍN", "Cartagena de Indias"]
CLIENT_SAYS = [
    "Hola buenas tardes", "Me interesa la small widget 150, gracias", "Tengo 2 palos de inicial",
    "Cuento con 1500mil", "Tengo $1.500.000 y quizas 3 millones", "No tengo con qué dar la inicial",
    "Tengo 0 millones", "Lo pago de contado", "La quiero a CRÉDITO", "Mejor financiada",
    "Paso mañana por la sede", "Los visito hoy", "Ya voy saliendo, voy para allá",
    "Envíemela por favor", "Mándeme la cotización", "Estoy reportado en centrales",
    "La tasa me parece alta", "Busco una usada", "Cuánto demora la entrega",
    "Lo hablo con mi esposa", "Está muy costosa para mí", "Estoy comparando con otra marca",
    "Solo estaba mirando", "La necesito esta semana", "Vi la red gear y la Blue Bolt NS 125.",
    "Voy a consultar en la casa", "Tengo 7,2 millones", "Ok gracias", "Es para ya, urgente",
    "Me sale del presupuesto", "El interés está caro",
]
ADVISOR_SAYS = [
    "Con gusto le ayudo", "Le mando la cotización formal", "Tenemos crédito y contado", "Puede visitarnos hoy",
    "La inicial es de 2 millones",
]

_HOUR, _MINUTE = "CAST(floor((o_orderkey % 1440) / 60) AS INT)", "(o_orderkey % 60)"
_MESSY_DATE = """CASE
  WHEN {k} % 301 = 7 THEN '2001-02-31 10:00:00'
  WHEN {k} % 4 = 0 THEN CAST(year({d}) AS STRING) || '-' || {mm} || '-' || {dd} || ' ' || {hh} || ':' || {mi} || ':09'
  WHEN {k} % 4 = 1 THEN CAST(year({d}) AS STRING) || '-' || {mm} || '-' || {dd} || 'T' || {hh} || ':' || {mi} || ':41'
  WHEN {k} % 4 = 2 THEN {dd} || '-' || {mm} || '-' || CAST(year({d}) AS STRING)
  WHEN floor({k} / 4) % 2 = 0 THEN {dd} || '/' || {mm} || '/' || CAST(year({d}) AS STRING) || ' ' || {hh} || ':' || {mi}
  ELSE {mm} || '/' || {dd} || '/' || CAST(year({d}) AS STRING) || ' ' || {hh} || ':' || {mi} END"""


def _messy_date(key: str, day: str) -> str:
    return _MESSY_DATE.format(k=key, d=day, mm=_two(f"month({day})"), dd=_two(f"day({day})"),
                              hh=_two(_HOUR), mi=_two(_MINUTE))


_PHONE = "'3' || lpad(CAST(o_custkey % 1000 AS STRING), 9, '0')"
RAW_LEADS_ONCE = f"""
SELECT o_orderkey AS lead_id,
  CASE WHEN o_orderkey % 701 = 3 THEN NULL ELSE {_messy_date('o_orderkey', 'o_orderdate')} END AS fecha_registro,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'Fax'
       WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'WHATSAPP' WHEN 1 THEN ' whatsapp ' ELSE 'WhatsApp' END
       WHEN o_orderkey % 3 = 1 THEN CASE o_orderkey % 5 WHEN 0 THEN 'META  ADS' ELSE 'Meta Ads' END
       ELSE CASE o_orderkey % 5 WHEN 0 THEN 'formulario web' ELSE 'Formulario Web' END END AS canal,
  CAST(n_regionkey AS BIGINT) AS empresa_id, CAST(c_nationkey AS BIGINT) AS punto_venta_id,
  CASE WHEN o_orderkey % 211 = 5 THEN 'Prueba prueba' WHEN o_orderkey % 223 = 9 THEN NULL
       ELSE {_case('o_custkey % 7', NAMES)} END AS nombre_cliente,
  CASE WHEN o_orderkey % 53 = 4 THEN '300123' WHEN o_orderkey % 59 = 2 THEN NULL ELSE
    CASE o_orderkey % 7 WHEN 0 THEN {_PHONE} WHEN 1 THEN substr({_PHONE}, 1, 3) || ' ' || substr({_PHONE}, 4, 3) || ' ' || substr({_PHONE}, 7, 4)
      WHEN 2 THEN '+57 ' || {_PHONE} WHEN 3 THEN substr({_PHONE}, 1, 3) || '-' || substr({_PHONE}, 4, 3) || '-' || substr({_PHONE}, 7, 4)
      WHEN 4 THEN ' ' || {_PHONE} || ' ' WHEN 5 THEN '57' || {_PHONE}
      ELSE '(' || substr({_PHONE}, 1, 3) || ') ' || substr({_PHONE}, 4, 3) || '-' || substr({_PHONE}, 7, 4) END END AS telefono,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'C' || CAST(o_custkey % 700 AS STRING) || '@Mail.com '
       WHEN o_orderkey % 83 = 0 THEN 'sin correo' ELSE 'c' || CAST(o_custkey % 700 AS STRING) || '@mail.com' END AS email,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE {_case('(c_nationkey + o_orderkey % 2) % 9', CITIES)} END AS ciudad,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 31 = 1 THEN '  '
       WHEN o_orderkey % 31 = 2 THEN 'zzz qqq' ELSE
    CASE o_orderkey % 6
      WHEN 0 THEN {_case('o_orderkey % 8', ADJECTIVES)} || ' ' || {_case('CAST(floor(o_orderkey / 8) AS BIGINT) % 8', NOUNS)}
      WHEN 1 THEN upper({_case('o_orderkey % 8', ADJECTIVES)}) || '  ' || {_case('CAST(floor(o_orderkey / 8) AS BIGINT) % 8', NOUNS)} || ' 2001'
      WHEN 2 THEN {_case('o_orderkey % 8', ADJECTIVES)}
      WHEN 3 THEN {_case('o_orderkey % 8', ADJECTIVES)} || ' ' || substr({_case('CAST(floor(o_orderkey / 8) AS BIGINT) % 8', NOUNS)}, 2, 9)
      WHEN 4 THEN substr({_case('o_orderkey % 8', ADJECTIVES)}, 1, 2) || {_case('o_orderkey % 8', ADJECTIVES)} || ' ' || {_case('CAST(floor(o_orderkey / 8) AS BIGINT) % 8', NOUNS)}
      ELSE {_case('CAST(floor(o_orderkey / 8) AS BIGINT) % 8', NOUNS)} || ' ' || {_case('o_orderkey % 8', ADJECTIVES)} || ' azul' END END AS modelo_interes_texto,
  CASE WHEN o_orderkey % 89 = 0 THEN 'Otro' WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderkey % 5 WHEN 0 THEN 'SIN GESTION' ELSE 'Sin gestión' END
       WHEN o_orderpriority = '2-HIGH' THEN CASE o_orderkey % 5 WHEN 0 THEN 'contactado' WHEN 1 THEN 'No contesta' ELSE 'Contactado' END
       WHEN o_orderpriority = '3-MEDIUM' THEN 'En proceso'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CASE o_orderkey % 5 WHEN 0 THEN 'Cotizacion  Enviada' ELSE 'Cotización enviada' END
       ELSE 'Descartado' END AS estado_gestion,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 29 <> 0 THEN NULL WHEN o_orderkey % 37 = 1 THEN NULL
       ELSE {_messy_date('floor(o_orderkey / 3)', 'CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - (CASE WHEN o_orderkey % 43 = 0 THEN 6 ELSE 0 END) AS INT)')} END AS fecha_primer_contacto,
  CASE WHEN o_orderkey % 3 = 1 THEN ' promo ' || o_orderstatus WHEN o_orderkey % 3 = 2 THEN '' END AS campania
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

CATALOGUE = """
SELECT sku, split(sku, ' ')[{first}] AS marca, split(sku, ' ')[{second}] AS linea,
  100 + n % 5 * 25 AS cilindraje, CASE length(sku) % 3 WHEN 0 THEN 'Trabajo' WHEN 1 THEN 'Deportiva' ELSE 'Scooter' END AS segmento,
  CAST(floor(price) AS BIGINT) * 10000 + n % 7 * 500000 AS precio_lista,
  CAST(n % 25 AS STRING) || '|' || CAST((n + 3) % 25 AS STRING) || '| ' || CAST((n + 11) % 25 AS STRING) || '|' AS puntos_venta_disponibles,
  n % 30 AS unidades_disponibles
FROM (SELECT p_name AS sku, count(*) AS n, min(p_retailprice) AS price FROM {part} GROUP BY p_name) AS names
"""

ADVISORS = """
SELECT s_suppkey AS asesor_id, ' ' || lower(s_name) AS nombre, CAST(s_nationkey AS BIGINT) AS punto_venta_id, CAST(n_regionkey AS BIGINT) AS empresa_id,
  CAST(1 + s_suppkey % 3 AS STRING) AS capacidad_diaria_leads,
  CASE WHEN s_suppkey % 20 = 0 THEN 'NO' WHEN s_suppkey % 7 = 0 THEN ' si ' ELSE 'SI' END AS activo,
  CASE WHEN s_suppkey % 50 = 3 THEN NULL ELSE '2020-0' || CAST(1 + s_suppkey % 9 AS STRING) || '-11' END AS fecha_ingreso
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

USERS = """
SELECT 'm' || CAST(r_regionkey AS STRING) AS user_id, CAST(r_regionkey AS BIGINT) AS empresa_id, 'gerente' AS rol, CAST(NULL AS BIGINT) AS asesor_id FROM {region}
UNION ALL
SELECT 'a' || CAST(s_suppkey AS STRING), CAST(n_regionkey AS BIGINT), 'asesor', s_suppkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

HISTORY = f"""
SELECT o_orderkey AS lead_id, CAST(o_orderdate AS DATE) AS fecha_registro,
  {_case('o_orderkey % 3', ['WhatsApp', 'META ADS', 'Formulario Web'])} AS canal,
  CAST(n_regionkey AS BIGINT) AS empresa_id, CAST(c_nationkey AS BIGINT) AS punto_venta_id,
  {_case('o_orderkey % 8', ADJECTIVES)} || ' ' || {_case('CAST(floor(o_orderkey / 8) AS BIGINT) % 8', NOUNS)} AS modelo_cotizado,
  CAST(floor(o_totalprice) AS BIGINT) * 50 AS precio_lista,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN NULL
       ELSE {_case('o_orderkey % 7', ['1', '3', '12', '24', '50', '96', '120'])} END AS horas_al_primer_contacto,
  CAST(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 0 ELSE 1 + o_orderkey % 6 END AS STRING) AS numero_contactos,
  {_case('CAST(floor(o_orderkey / 3) AS BIGINT) % 3', ['SI', 'NO', 'NO_INFORMA'])} AS manifesto_cuota_inicial,
  {_case('CAST(floor(o_orderkey / 9) AS BIGINT) % 3', ['contado', 'credito', 'no_informa'])} AS forma_pago_declarada,
  CASE WHEN o_orderkey % 4 = 0 THEN 'SI' ELSE 'NO' END AS pidio_cita,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 'Sin gestión' WHEN o_orderstatus = 'F' THEN 'Cerrado' ELSE 'Perdido' END AS desenlace
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

MESSAGES = f"""
SELECT conv_id AS conversacion_id, turn + 1 AS orden,
  CASE role WHEN 'user' THEN 'cliente' ELSE 'asesor' END AS emisor,
  CASE WHEN (conv_id + turn) % 17 = 0 THEN '25:99' ELSE {_two('(conv_id + turn) % 24')} || ':' || {_two('turn * 7 % 60')} END AS hora,
  CASE WHEN (conv_id + turn * 3) % 19 = 0 THEN '  ' WHEN role = 'user' THEN {_case(f'(conv_id * 7 + turn * 5) % {len(CLIENT_SAYS)}', CLIENT_SAYS)} || '. ' || text
       ELSE {_case(f'(conv_id + turn) % {len(ADVISOR_SAYS)}', ADVISOR_SAYS)} || '. ' || text END AS texto
FROM {{conversations}} WHERE role <> 'system'
"""

CHATS = f"""
SELECT c.conversacion_id, CASE WHEN c.conversacion_id % 25 = 0 THEN -1 ELSE o.lead_id END AS lead_id, 'WhatsApp' AS canal,
  CASE WHEN c.conversacion_id % 40 = 7 THEN 'sin fecha' WHEN c.conversacion_id % 7 = 1 THEN '1999-01-02 08:00:00'
       ELSE '2001-07-' || {_two('1 + c.conversacion_id % 28')} || ' ' || {_two('c.conversacion_id % 24')} || ':15:00' END AS fecha_inicio
FROM (SELECT DISTINCT conv_id AS conversacion_id FROM {{conversations}}) AS c
LEFT JOIN {{owners}} AS o ON o.recency = 2 * c.conversacion_id + 1
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class DriverInputs:
    """The pipeline inputs read from one folder of driver tables; every property is lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str, *tables: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in tables}, **frames)

    def leads_once(self) -> DataFrame:
        return self._sql(RAW_LEADS_ONCE, "orders", "customer", "nation")

    def leads(self) -> DataFrame:
        """One row per order, and every fiftieth order twice: the file has repeated ids."""
        copies = F.when(F.col("lead_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return (
            self.leads_once().withColumn("copy", F.explode(copies))
            .withColumn("orden_archivo", 2 * F.col("lead_id") + F.col("copy")).drop("copy")
        )

    def catalogue(self) -> DataFrame:
        return self._sql(CATALOGUE.replace("{first}", "0").replace("{second}", "1"), "part")

    def advisors(self) -> DataFrame:
        return self._sql(ADVISORS, "supplier", "nation")

    def users(self) -> DataFrame:
        return self._sql(USERS, "region", "supplier", "nation")

    def history(self) -> DataFrame:
        return self._sql(HISTORY, "orders", "customer", "nation")

    def messages(self) -> DataFrame:
        return self._sql(MESSAGES, "conversations")

    def chats(self) -> DataFrame:
        """Chat headers. The owner of chat n is the lead of recency 2n + 1, so chats land on new leads."""
        orders = self.table("orders").select("o_orderkey", "o_orderdate").withColumn("minute", F.col("o_orderkey") % 1440)
        owners = with_rank(
            orders, [], [("o_orderdate", False), ("minute", False), ("o_orderkey", False)],
            [(F.col("o_orderdate"), False), (F.col("minute"), False)], name="recency",
        ).select(F.col("o_orderkey").alias("lead_id"), "recency")
        return self._sql(CHATS, "conversations", owners=owners)
